"""Category encodings.

Codes come from a distributed dictionary: the distinct values are ranged over partitions, each partition numbers its own from an offset, and
rows take their codes by a join, so a column may have any number of values. Wide forms need the values' names as schema: their vocabulary is given, or discovered in
one job. The long and the sparse form need none on the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.aggregate import aggregate_block, category_features, string_columns, vocabulary_table
from riskloom.operators.blocks import factorize_expr, vocabulary_of
from riskloom.session import written


def one_hot(df: DataFrame, columns: Sequence[str] | None = None, null_category: bool = True,
            vocab: Mapping[str, Sequence[str]] | None = None) -> tuple[DataFrame, list[str]]:
    """Every (or each listed) string column to 0/1 int columns ``<col>_<value>`` (+ ``<col>_nan``).

    The original column is replaced; returns the new frame and the new column names.
    """
    cats = list(columns) if columns is not None else string_columns(df)
    voc = vocabulary_of(df, cats, vocab)
    keep = [F.col(f"`{c}`") for c in df.columns if c not in cats]
    new = []
    for c in cats:
        for f in category_features(c, voc[c], null_category):
            new.append(F.expr(f.expr).alias(f.name))
    names = [f.name for c in cats for f in category_features(c, voc[c], null_category)]
    return df.select(*keep, *new), names


def dictionary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, code): the distinct non-NULL values of each column, numbered from 0 in order (UTF-8 bytes).

    Dense ranks without a window over a column: ranges of (column, value) are sorted in their partitions and written with their place, and a place becomes a
    rank by the number of the column's values in the ranges before. Only one row per column and range meets in a window.
    """
    ranged = vocabulary_table(df, columns).repartitionByRange("column", "value").sortWithinPartitions("column", "value")
    placed = written(ranged.withColumn("place", F.monotonically_increasing_id()), "dictionary")
    part = F.shiftright("place", 33)
    ranges = placed.groupBy("column", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    before = F.sum("n").over(Window.partitionBy("column").orderBy("part")) - F.col("n")
    ranges = ranges.select(F.col("column").alias("_c"), "part", "first", before.alias("before"))
    return (placed.withColumn("_p", part).join(ranges, F.expr("column = _c AND _p = part"))
            .select("column", "value", (F.col("before") + F.col("place") - F.col("first")).alias("code")))


def factorize(df: DataFrame, columns: Sequence[str], vocab: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Code by sorted value (NULL = -1), in place: int for the columns of a given vocabulary, long from the dictionary.

    Columns of a given vocabulary are coded in the projection (values outside it are -1). Others take their codes from the distributed
    dictionary by one left join each, whose right side has every value once.
    """
    given = dict(vocab or {})
    rest = [c for c in columns if c not in given]
    out = df.select(*[factorize_expr(c, given[c]).alias(c) if c in given and c in columns else F.col(f"`{c}`") for c in df.columns])
    if not rest:
        return out
    codes = written(dictionary(df, rest), "codes")
    for i, c in enumerate(rest):
        own = codes.where(F.col("column") == c).select(F.col("value").alias(f"_v{i}"), F.col("code").alias(f"_code{i}"))
        out = out.join(own, F.col(f"`{c}`") == F.col(f"_v{i}"), "left").drop(f"_v{i}")
    made = {c: F.coalesce(f"_code{i}", F.lit(-1)).cast("long") for i, c in enumerate(rest)}
    return out.select(*[made[c].alias(c) if c in made else F.col(f"`{c}`") for c in df.columns])


def one_hot_sparse(df: DataFrame, columns: Sequence[str], name: str = "indices", null_category: bool = True) -> tuple[DataFrame, int]:
    """E1 for any number of values: the columns become one sorted ``array<long>`` of the positions that are 1, and the width is returned.

    Positions: column after column, each with its values in order, then one for NULL if asked. Only the number of values per column comes to the driver.
    """
    sizes = {r["column"]: r["n"] for r in vocabulary_table(df, columns).groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    coded, start, places = factorize(df, columns), 0, []
    for c in columns:
        n, code = sizes.get(c, 0), F.col(f"`{c}`")
        places.append(F.when(code >= 0, F.lit(start) + code).otherwise(F.lit(start + n if null_category else None)).cast("long"))
        start += n + null_category
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return coded.select(*kept, F.array_compact(F.array(*places)).alias(name)), start


def category_share(df: DataFrame, key: str, columns: Sequence[str], null_category: bool = True,
                   vocab: Mapping[str, Sequence[str]] | None = None, prefix: str = "") -> DataFrame:
    """Share of each value per key (mean of the indicator), without materialising dummies."""
    voc = vocabulary_of(df, columns, vocab)
    feats = [f for c in columns for f in category_features(c, voc[c], null_category)]
    return aggregate_block(df, key, feats, prefix)


def category_share_long(df: DataFrame, key: str, columns: Sequence[str], null_category: bool = True) -> DataFrame:
    """E3 in long form (key, column, value, share), for any number of values: only shares above 0, value NULL for missing.

    Counts per (key, column, value) are summed map-side; each meets its key's row count in one join.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    rows = df.select(F.col(f"`{key}`"), F.explode(pairs).alias("p")).select(key, "p.column", "p.value")
    if not null_category:
        rows = rows.where(F.col("value").isNotNull())
    total = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed(key, "_key")
    counts = rows.groupBy(key, "column", "value").agg(F.count(F.lit(1)).alias("_c"))
    return counts.join(total, F.col(key).eqNullSafe(F.col("_key"))).select(key, "column", "value", (F.col("_c") / F.col("_n")).alias("share"))
