"""Whitening of embeddings with Spark MLlib's block matrices.

The distinct whole-number vectors, centred by their mean, become the rows of a block matrix. Its transpose times itself is the scatter matrix (dimensions
squared, the only matrix that comes to the driver), whose eigenvectors, divided by the roots of their eigenvalues, make the whitening matrix;
the block matrix times that one projects every distinct vector. Rows of the table take the values of their vector by a join.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import materialise_lean

COMPONENTS = 4
SCALE = 256
#: Rows of a block; blocks are counted on the driver (two numbers each), so raise it with the table.
BLOCK_ROWS = 1024
#: Blocks multiplied and added up in one task.
BLOCKS_A_TASK = 8
#: Eigenvalues below this share of the largest are rounding, not spread.
FLAT = 1e-12


def whole_vectors(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, x) of the usable rows: no null vector, no null or non-finite entry, and of the length that most rows have (ties: the longer).

    An entry whose multiple leaves the range of a long counts as non-finite.
    """
    v = F.col("v")
    found = rows.select(F.col(id_column).alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"))
    found = found.where(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: F.coalesce(F.abs(c) * scale < 9e18, F.lit(False))))
    found = found.select("vec_id", F.transform(v, lambda c: F.floor(c * scale)).alias("x"))
    lengths = found.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return found.where(F.size("x") == (lengths["d"] if lengths else 0))


def fit_list(found: DataFrame) -> DataFrame:
    """(index, x): each distinct vector once, numbered from 0 without gaps."""
    once = materialise_lean(found.select("x").distinct().withColumn("mark", F.monotonically_increasing_id()), "distinct")
    part = F.shiftright("mark", 33)
    sizes = once.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("size"))  # one row for each task that wrote
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    return (once.withColumn("part", part).join(before, "part")
            .select((F.col("before") + F.col("mark").bitwiseAND((1 << 33) - 1)).alias("index"), "x"))


def _sums(once: DataFrame, dimensions: int) -> tuple[int, list[int]]:
    told = once.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("x")[d].cast("decimal(28,0)")).alias(f"s{d}") for d in range(dimensions)]).first()
    return told["n"], [int(told[f"s{d}"]) for d in range(dimensions)]


def centred_blocks(once: DataFrame, mean: list[float], block_rows: int = BLOCK_ROWS) -> BlockMatrix:
    """The centred vectors as a block matrix one block wide."""
    m = F.array(*[F.lit(v) for v in mean])
    vectors = once.select("index", array_to_vector(F.zip_with(F.col("x").cast("array<double>"), m, lambda c, a: c - a)).alias("vector"))
    return IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "vector")).toBlockMatrix(block_rows, len(mean))


def scatter(blocks: BlockMatrix, splits: int) -> np.ndarray:
    """Transpose times itself. Python's multiply lacks the number of splits of the long side, without which one task would get all blocks."""
    turned = blocks.transpose()
    made = turned._java_matrix_wrapper.call("multiply", blocks._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(made, turned.rowsPerBlock, blocks.colsPerBlock).toLocalMatrix().toArray()


def components_of(scatter_matrix: np.ndarray, n: int, components: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues by size, their eigenvectors as columns, trace) of the covariance; only as many as have spread."""
    covariance = (scatter_matrix + scatter_matrix.T) / (2 * n)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    kept = values > max(FLAT * values[0], 0)
    return values[kept], vectors[:, kept], float(np.trace(covariance))


def project(blocks: BlockMatrix, matrix: np.ndarray) -> DataFrame:
    """(index, y): the block matrix times a small matrix, row by row."""
    spark_matrix = Matrices.dense(*matrix.shape, matrix.ravel(order="F").tolist())
    context = blocks.blocks.ctx
    small = BlockMatrix(context.parallelize([((0, 0), spark_matrix)], 1), *matrix.shape)
    made = blocks.multiply(small).toIndexedRowMatrix()
    rows = callMLlibFunc("getIndexedRows", made._java_matrix_wrapper._java_model)  # as its .rows, without a Python object for each
    return rows.select("index", vector_to_array("vector").alias("y"))


def _deviation(n: int, sums: list[int]) -> str:
    """Exact sum of (n x - S) ** 2 in SQL, null beyond a long."""
    total = ",".join(f"cast('{s}' as decimal(38,0))" for s in sums)
    return (f"try_cast(aggregate(zip_with(x, array({total}), (a, s) -> try_subtract(cast(a as decimal(19,0)) * cast('{n}' as decimal(18,0)), s)), "
            "cast(0 as decimal(38,0)), (t, d) -> try_add(t, try_multiply(d, d))) as bigint)")


def whiten(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS,
           scale: int = SCALE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per usable row and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows that hold null vectors, null or non-finite entries go (see ``whole_vectors``). Equal vectors count once in the fit, and each of their rows gets the values; null
    and repeated ids are kept as they are. Components whose eigenvalue is nothing but rounding (constant or too few vectors) can't be scaled to one and
    aren't returned; without any usable row or spread the result is empty. ``deviation`` is exact, and null where it doesn't fit a long. Other columns
    aren't read.
    """
    kind = rows.schema[id_column].dataType.simpleString()
    spark = rows.sparkSession
    nothing = spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    found = whole_vectors(rows, id_column, vector_column, scale)
    once = materialise_lean(fit_list(found), "fit")
    some = once.first()
    if some is None:
        return nothing
    n, sums = _sums(once, len(some["x"]))
    blocks = centred_blocks(once, [s / n for s in sums], block_rows)
    values, vectors, trace = components_of(scatter(blocks, -(-n // (BLOCKS_A_TASK * block_rows))), n, components)
    if not len(values):
        return nothing
    made = once.join(project(blocks, vectors / np.sqrt(values)), "index")
    made = materialise_lean(made.select("x", F.xxhash64("x").alias("h"), "y", F.expr(_deviation(n, sums)).alias("deviation")), "projected")
    pairs = [(i, j) for i in range(len(values)) for j in range(i, len(values))]
    y = [F.col("y")[i] for i in range(len(values))]
    told = made.agg(*[F.avg(c) for c in y], *[F.avg(y[i] * y[j]) for i, j in pairs]).first()
    error = max(abs(told[len(y) + k] - told[i] * told[j] - (i == j)) for k, (i, j) in enumerate(pairs))
    shares = F.array(*[F.lit(float(v / trace)) for v in values])
    return (found.withColumn("h", F.xxhash64("x")).join(made, ["h", "x"])
            .select("vec_id", "deviation", F.posexplode(F.arrays_zip(F.col("y").alias("y"), shares.alias("share"))).alias("k", "of"))
            .select("vec_id", (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", F.col("of.y").alias("whitened"),
                    F.col("of.share").alias("explained"), F.lit(float(error)).alias("identity_error")))
