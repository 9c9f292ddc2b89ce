"""Specification-driven aggregation over a one-to-many table.

A block is one ``groupBy(key).agg(...)`` followed by one ``select``: every aggregate, every category
share and every conditional subset (Active / Closed, Approved / Refused) is computed in the same pass,
so a block costs one scan and one shuffle whatever its width. All aggregates are algebraic (partial
aggregation before the shuffle), so a key holding a large share of the rows does not make one task
large; ``nunique`` uses Spark's distinct-aggregate plan, which shuffles on (key, value) first. Where
many keys have some rows each, spread over the tasks, as in the blocks of clients, partial aggregation
merges little, and its buffers are ten times as wide as a row: there the rows go by key first (``by_key``).

Semantics (SURVEY 1.2): min/max/mean skip NULL and keep infinity; ``sum`` of an all-NULL group is 0;
``var`` is the sample variance (NULL for one row); ``size`` counts rows; ``nunique`` skips NULL. In a
conditional subset a client without any row of the subset gets NULL in every column of that subset.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.naming import agg_name, dummy_name
from riskloom.functions.scalar import missing

FUNCS = ("min", "max", "mean", "sum", "var", "size", "nunique")


@dataclass(frozen=True)
class Feature:
    """A value expression over input rows (Spark SQL text) and the aggregates to take of it.

    Expressions are kept as SQL text: a block of hundreds of aggregates is then built with one parse
    per aggregate on the JVM instead of a chain of py4j calls per expression.
    """

    name: str
    expr: str
    funcs: tuple[str, ...]
    # 0 or 1 in every row, never NULL
    flag: bool = False


@dataclass(frozen=True)
class Subset:
    """A conditional block: rows where ``cond`` (SQL text) holds, aggregated under ``prefix``."""

    prefix: str
    cond: str
    features: tuple[Feature, ...] = field(default_factory=tuple)


def _ref(name: str) -> Column:
    return F.col(f"`{name}`")


def sql_ref(name: str) -> str:
    """Backquoted column reference for SQL text."""
    return "`" + name.replace("`", "``") + "`"


def sql_str(value: str) -> str:
    """Spark SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def value_sql(df: DataFrame, col: str) -> str:
    """A column as an aggregate input: NaN in a float column is a missing value (skipped like NULL),
    infinity stays."""
    r = sql_ref(col)
    if isinstance(df.schema[col].dataType, (T.DoubleType, T.FloatType)):
        return f"nanvl({r}, CAST(NULL AS DOUBLE))"
    return r


def spec_features(df: DataFrame, spec: Mapping[str, Sequence[str]]) -> list[Feature]:
    """Features for ``{column: [funcs]}``; columns the table lacks are skipped."""
    present = set(df.columns)
    out = []
    for col, funcs in spec.items():
        bad = [f for f in funcs if f not in FUNCS]
        if bad:
            raise ValueError(f"unknown aggregate(s) {bad} for {col}")
        if col in present:
            out.append(Feature(col, value_sql(df, col), tuple(funcs)))
    return out


def string_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """The categorical (string) columns, from the schema only."""
    skip = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in skip]


def vocabulary_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value): the distinct non-NULL values of string columns, deduplicated map-side; nothing goes to the driver."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), _ref(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).select("p.column", "p.value").where(F.col("value").isNotNull()).distinct()


def discover_vocabulary(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """Sorted distinct non-NULL values per string column, in one job: the names of a wide row's columns, which the driver needs as
    schema. For columns whose values are no schema, use ``vocabulary_table`` and the long form of the shares."""
    vocab: dict[str, list[str]] = {c: [] for c in columns}
    for r in vocabulary_table(df, columns).collect() if columns else []:
        vocab[r["column"]].append(r["value"])
    return {c: sorted(v) for c, v in vocab.items()}


def category_features(
    column: str, values: Sequence[str], null_category: bool, funcs: Sequence[str] = ("mean",)
) -> list[Feature]:
    """Indicator of each value (0/1 int, NULL-safe), plus ``<col>_nan`` when asked."""
    c = sql_ref(column)
    # a text "nan" would get the name of the NULL indicator
    name = lambda v: f"{column}_nan_text" if null_category and v == "nan" else dummy_name(column, v)
    feats = [Feature(name(v), f"CAST(({c} <=> {sql_str(v)}) AS INT)", tuple(funcs), True) for v in values]
    if null_category:
        feats.append(Feature(dummy_name(column, None), f"CAST(({c} IS NULL) AS INT)", tuple(funcs), True))
    return feats


class _Plain:
    """The plain aggregates of a block, each once, under short names."""

    def __init__(self, prefix: str):
        self.prefix, self.names = prefix, {}

    def name(self, sql: str) -> str:
        return sql_ref(self.names.setdefault(sql, f"_{self.prefix}{len(self.names)}"))


def _finished(func: str, x: str, cond: str | None, flag: bool, floating: bool, plain: _Plain) -> str:
    """An aggregate as SQL text over plain ones. A mean of doubles or flags is a sum over a count, which other aggregates share; NULL rows of a left join
    stay NULL."""
    v = x if cond is None else f"CASE WHEN {cond} THEN {x} END"
    rows = plain.name("count(1)" if cond is None else f"count(CASE WHEN {cond} THEN 1 END)")
    if func in ("min", "max"):
        return plain.name(f"{func}({v})")
    if func == "mean":
        if not (flag or floating):
            return plain.name(f"avg({v})")
        return f"{plain.name(f'sum({v})')} / nullif({rows if flag else plain.name(f'count({v})')}, 0)"
    if func == "var":
        return plain.name(f"var_samp({v})")
    if func == "sum":
        return f"CASE WHEN {rows} > 0 THEN coalesce({plain.name(f'sum({v})')}, 0) END"
    if func == "size":
        return rows if cond is None else f"CASE WHEN {rows} > 0 THEN {rows} END"
    if func == "nunique":
        n = plain.name(f"count(DISTINCT {v})")
        return n if cond is None else f"CASE WHEN {rows} > 0 THEN {n} END"
    raise ValueError(func)


def finite_sql(ref: str) -> str:
    """NaN and +/-inf to NULL, as SQL text."""
    return f"CASE WHEN isnan({ref}) OR abs({ref}) = double('Infinity') THEN NULL ELSE {ref} END"


def by_key(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by the hash of ``key``: an aggregation (``nunique`` included) and a join on it need no other shuffle. A key's rows meet in one task,
    which reads them one after another into one buffer."""
    return df.repartition(_ref(key))


@dataclass(frozen=True)
class Parts:
    """A block before its last projection: ``rows`` of plain aggregates per ``key``, and the block's columns as SQL text over them, which may as well be
    applied after a left join of the rows."""

    key: str
    rows: DataFrame
    columns: tuple[str, ...]

    def finished(self, finite: bool = True) -> DataFrame:
        out = self.rows.selectExpr(sql_ref(self.key), *self.columns)
        if finite:
            items = [sql_ref(self.key)]
            for f in out.schema.fields[1:]:
                r = sql_ref(f.name)
                items.append(f"{finite_sql(r)} AS {r}" if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else r)
            out = out.selectExpr(*items)
        return out


def aggregate_parts(
    df: DataFrame,
    key: str,
    features: Sequence[Feature],
    prefix: str,
    subsets: Sequence[Subset] = (),
    count_name: str | None = None,
) -> Parts:
    """A1: all aggregates, subsets and an optional row count (A11) of each ``key``, as plain aggregates and the text of the columns over them. In a subset,
    sums, sizes and distinct counts are NULL when the key has no row of it.

    Spark compiles an aggregation's output, with the projections on it, to one method. A block's hundred columns make that longer than the JVM compiles (8000
    bytes of code), and then every row of the output costs more than all its input rows. So plain aggregates are few and short, and a wide row of several blocks
    is better finished in one projection after the joins.
    """
    plain = _Plain(prefix)
    of = [(features, prefix, None), *((s.features, s.prefix, s.cond) for s in subsets)]
    every = [f for fs, _, _ in of for f in fs]
    types = df.selectExpr(*[f"{f.expr} AS c{i}" for i, f in enumerate(every)]).schema.fields
    floating = iter([isinstance(t.dataType, (T.DoubleType, T.FloatType)) for t in types])
    columns = []
    for fs, pre, cond in of:
        for f in fs:
            real = next(floating)
            columns += [f"{_finished(func, f.expr, cond, f.flag, real, plain)} AS {sql_ref(agg_name(pre, f.name, func))}" for func in f.funcs]
    if count_name:
        columns.append(f"{plain.name('count(1)')} AS {sql_ref(count_name)}")
    return Parts(key, df.groupBy(key).agg(*[F.expr(e).alias(n) for e, n in plain.names.items()]), tuple(columns))


def aggregate_block(
    df: DataFrame,
    key: str,
    features: Sequence[Feature],
    prefix: str,
    subsets: Sequence[Subset] = (),
    count_name: str | None = None,
    finite: bool = True,
) -> DataFrame:
    """A1: one row per ``key`` with all aggregates, subsets and an optional row count."""
    return aggregate_parts(df, key, features, prefix, subsets, count_name).finished(finite)


def agg_spec(df: DataFrame, key: str, spec: Mapping[str, Sequence[str]], prefix: str = "") -> DataFrame:
    """A1 entry point for a plain ``{column: [funcs]}`` specification."""
    return aggregate_block(df, key, spec_features(df, spec), prefix)


def group_count(df: DataFrame, key: str, name: str = "COUNT") -> DataFrame:
    """Rows per key."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def distinct_ids(df: DataFrame, key: str) -> DataFrame:
    """A12."""
    return df.select(key).distinct()


def class_balance(df: DataFrame, label: str = "TARGET") -> DataFrame:
    """Rows and share per class, and the majority / minority ratio used as positive-class weight."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    w = F.sum("n").over(_all_rows())
    return counts.select(
        _ref(label),
        F.col("n"),
        (F.col("n") / w).alias("share"),
        (F.max("n").over(_all_rows()) / F.min("n").over(_all_rows())).alias("majority_minority_ratio"),
    )


def _all_rows():
    from pyspark.sql import Window

    # Over the per-class table: as many rows as classes.
    return Window.partitionBy(F.lit(0))


def mean_importance(df: DataFrame, feature: str = "feature", importance: str = "importance") -> DataFrame:
    """Mean importance per feature over folds."""
    return df.groupBy(feature).agg(F.avg(importance).alias("importance"))


def contingency(df: DataFrame, x: str, y: str, total: str = "Total") -> DataFrame:
    """Counts by (x, y) with margins labelled ``total``, one ``cube`` (NULL cells skipped)."""
    base = df.where(_ref(x).isNotNull() & _ref(y).isNotNull()).select(_ref(x).cast("string").alias(x), _ref(y).cast("string").alias(y))
    cubed = base.cube(x, y).agg(F.count(F.lit(1)).alias("n"), F.grouping(x).alias("gx"), F.grouping(y).alias("gy"))
    return cubed.select(
        F.when(F.col("gx") == 1, F.lit(total)).otherwise(_ref(x)).alias(x),
        F.when(F.col("gy") == 1, F.lit(total)).otherwise(_ref(y)).alias(y),
        F.col("n"),
    )


def long_row(wide: DataFrame, columns: Sequence[str], value: str) -> DataFrame:
    """One row of results c0, c1, ... as (column, value) rows; the names may hold any character."""
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias(value)) for i, c in enumerate(columns)])
    return wide.select(F.explode(items).alias("r")).select("r.*")


def fill_rate(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Share of values per column that are neither NULL nor NaN, long form, one pass."""
    cols = list(columns) if columns is not None else df.columns
    return long_row(df.agg(*[F.avg((~missing(df, c)).cast("double")).alias(f"c{i}") for i, c in enumerate(cols)]), cols, "fill_rate")
