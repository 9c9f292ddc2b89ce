"""Projections, filters and cleaning steps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.scalar import (
    DAYS_SENTINEL,
    clip_at_zero,
    nonfinite_to_null_all,
    safe_ratio,
    sentinel_to_null,
)
from riskloom.operators.aggregate import fill_rate, long_row, string_columns

ID_COLUMNS = ("SK_ID_CURR", "SK_ID_BUREAU", "SK_ID_PREV", "index")
LABEL = "TARGET"


def _ref(c: str):
    return F.col(f"`{c}`")


def filter_not_value(df: DataFrame, column: str, value) -> DataFrame:
    """Drop rows equal to ``value``; NULL rows stay."""
    return df.where(~_ref(column).eqNullSafe(F.lit(value)))


def filter_category(df: DataFrame, column: str, value) -> DataFrame:
    """Rows of one category."""
    return df.where(_ref(column) == F.lit(value))


def sentinel_to_null_columns(df: DataFrame, columns: Sequence[str], sentinel: float = DAYS_SENTINEL) -> DataFrame:
    """One projection, listed columns only (absent ones ignored)."""
    cols = set(columns)
    return df.select(*[sentinel_to_null(_ref(c), sentinel).alias(c) if c in cols else _ref(c) for c in df.columns])


def nonfinite_to_null(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """+/-inf and NaN to NULL in every floating column."""
    return nonfinite_to_null_all(df, exclude)


def ratio_features(df: DataFrame, ratios: Mapping[str, tuple[str, str]]) -> DataFrame:
    """P5: ``name = num / den`` with the zero-denominator rule of ``safe_ratio``."""
    return df.select("*", *[safe_ratio(n, d).alias(name) for name, (n, d) in ratios.items()])


def difference_features(df: DataFrame, diffs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """``name = a - b``."""
    return df.select("*", *[(_ref(a) - _ref(b)).alias(name) for name, (a, b) in diffs.items()])


def clip_at_zero_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Negative or NULL to 0."""
    cols = set(columns)
    return df.select(*[clip_at_zero(_ref(c)).alias(c) if c in cols else _ref(c) for c in df.columns])


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop, ignoring names the table does not have."""
    return df.drop(*[c for c in columns if c in df.columns])


def select_features(df: DataFrame, features: Sequence[str] | None = None, id_col: str = "SK_ID_CURR",
                    exclude: Sequence[str] = (*ID_COLUMNS, LABEL)) -> DataFrame:
    """The listed features plus the id, or every column but ids and label."""
    if features is None:
        skip = set(exclude)
        features = [c for c in df.columns if c not in skip]
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise ValueError(f"features not in table: {missing[:10]}")
    keep = [c for c in features if c != id_col]
    return df.select(*[_ref(c) for c in keep], _ref(id_col))


def split_columns_by_type(df: DataFrame) -> tuple[list[str], list[str]]:
    """(string columns, other columns), from the schema."""
    s = string_columns(df)
    return s, [c for c in df.columns if c not in s]


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Distinct non-NULL values per column, long form (column, n_distinct).

    Exact: the table is stacked to (column, value) pairs, deduplicated (map-side first) and counted
    per column, so one pass handles any number of columns without one aggregation buffer per column.
    Approximate: ``approx_count_distinct`` of every column in one algebraic pass.
    """
    cols = list(columns) if columns is not None else list(df.columns)
    if not exact:
        return long_row(df.agg(*[F.approx_count_distinct(_ref(c)).alias(f"c{i}") for i, c in enumerate(cols)]), cols, "n_distinct")

    def text(c: str):  # -0.0 + 0.0 is 0.0: the two zeros are one value
        x = _ref(c)
        return (x + F.lit(0.0) if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) else x).cast("string")

    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), text(c).alias("value")) for c in cols
    ])).alias("p")).select("p.column", "p.value").where(F.col("value").isNotNull()).distinct()
    counts = pairs.groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    return names.join(counts, "column", "left").select("column", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"))


def split_columns_by_cardinality(df: DataFrame, columns: Sequence[str] | None = None, max_categorical: int = 2) -> DataFrame:
    """(column, kind): 'categorical' when the column has at most ``max_categorical`` distinct
    non-NULL values, else 'numeric'. Exact and algebraic for the usual bound of 2 (binary columns):

    1. one pass: min and max of every column;
    2. one pass: per column, the number of values that are neither its min nor its max;
    a column is binary (or constant, or empty) exactly when that number is 0. Three small aggregation
    buffers per column, no per-value state. Other bounds use exact distinct counts.
    """
    cols = list(columns) if columns is not None else list(df.columns)
    if max_categorical != 2:
        dc = distinct_counts(df, cols)
        return dc.select("column", F.when(F.col("n_distinct") <= max_categorical, "categorical")
                         .otherwise("numeric").alias("kind"))
    def _val(c: str):  # NaN sorts above every number in Spark and is not a value here (like NULL)
        x = _ref(c)
        return F.when(~F.isnan(x), x) if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) else x

    mm = df.agg(*[x for i, c in enumerate(cols)
                  for x in (F.min(_val(c)).alias(f"mn{i}"), F.max(_val(c)).alias(f"mx{i}"))]).first()
    checks = []
    for i, c in enumerate(cols):
        lo, hi = mm[f"mn{i}"], mm[f"mx{i}"]
        if lo is None:
            checks.append(F.lit(0).alias(f"e{i}"))
            continue
        x = _ref(c)
        valid = x.isNotNull()
        if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
            valid = valid & ~F.isnan(x)
        checks.append(F.count(F.when(valid & (x != F.lit(lo)) & (x != F.lit(hi)), 1)).alias(f"e{i}"))
    extra = df.agg(*checks).first()
    rows = [(c, "categorical" if extra[f"e{i}"] == 0 else "numeric") for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "column string, kind string")


def sparse_column_report(df: DataFrame, min_fill: float, columns: Sequence[str] | None = None) -> DataFrame:
    """P13 decision table: (column, fill_rate, kept)."""
    return fill_rate(df, columns).select("column", "fill_rate", (F.col("fill_rate") >= min_fill).alias("kept"))


def drop_sparse_columns(df: DataFrame, min_fill: float) -> DataFrame:
    """Drop columns filled below ``min_fill`` (one aggregation job; the list is metadata)."""
    drop = [r["column"] for r in sparse_column_report(df, min_fill).where(~F.col("kept")).collect()]
    return df.drop(*drop)


def drop_null_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """P14."""
    return df.dropna(how="any", subset=list(subset) if subset else None)


def fill_zero(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """P15."""
    return df.fillna(0, subset=list(columns) if columns else None)


def downcast_float(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Doubles to float32."""
    cols = set(columns) if columns else {f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)}
    return df.select(*[_ref(c).cast("float").alias(c) if c in cols else _ref(c) for c in df.columns])


def filter_clients(df: DataFrame, ids: DataFrame, key: str = "SK_ID_CURR") -> DataFrame:
    """Rows of a batch of clients (semi join)."""
    return df.join(ids.select(key), key, "left_semi")


def top_feature_rows(long_df: DataFrame, features: DataFrame, feature_col: str = "feature") -> DataFrame:
    """Rows whose feature is in a (small) set, as a semi join."""
    return long_df.join(features.select(feature_col), feature_col, "left_semi")


def transpose_client(df: DataFrame, id_col: str = "SK_ID_CURR", features: Sequence[str] | None = None) -> DataFrame:
    """(id, feature, value) rows for every client, values as double."""
    feats = list(features) if features is not None else [c for c in df.columns if c != id_col]
    wide = df.select(_ref(id_col), *[_ref(c).cast("double").alias(c) for c in feats])
    items = F.array(*[F.struct(F.lit(c).alias("feature"), _ref(c).alias("value")) for c in feats])
    return wide.select(_ref(id_col), F.explode(items).alias("_r")).select(_ref(id_col), "_r.feature", "_r.value")
