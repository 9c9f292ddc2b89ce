"""Client profile and distribution queries (V1-V7) and feature descriptions (F2).

Screens of a dashboard become tables computed for every client at once: histograms, exact group
quartiles, the client's position in its group, the client's strongest features with their values.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.naming import feature_root_name
from riskloom.functions.scalar import missing
from riskloom.operators.joins import semi_join_ids
from riskloom.operators.ordered import ordered_cumsum
from riskloom.operators.ranking import top_k_per_client
from riskloom.operators.sampling import sample_n
from riskloom.session import written

KEYS = ("SK_ID_CURR", "SK_ID_BUREAU", "SK_ID_PREV")
QUARTILES = (("q1", 0.25), ("median", 0.5), ("q3", 0.75))


def _ref(c: str):
    return F.col(f"`{c}`")


def client_history(table: DataFrame, ids: DataFrame, key: str = "SK_ID_CURR", drop: Sequence[str] = KEYS) -> DataFrame:
    """V1: every row of a history table for the given clients, keys dropped (the key is kept as
    ``client`` so rows stay attributable when many clients are asked at once)."""
    rows = semi_join_ids(table, ids, key)
    return rows.withColumnRenamed(key, "client").drop(*[c for c in drop if c in rows.columns and c != key])


def client_balance_history(balance: DataFrame, bureau: DataFrame, ids: DataFrame, key: str = "SK_ID_CURR",
                           child_key: str = "SK_ID_BUREAU") -> DataFrame:
    """V1, two hops: balance rows of the clients' bureau credits, with the client id attached."""
    owner = semi_join_ids(bureau.select(key, child_key), ids, key)
    return balance.join(owner, child_key, "inner").withColumnRenamed(key, "client").drop(child_key)


def grouped_histogram(df: DataFrame, x: str, width: float, lo: float | None = None,
                      hue: str | None = None) -> DataFrame:
    """V2: counts per bin ``floor((x - lo) / width)`` and hue; ``lo`` defaults to the minimum."""
    if lo is None:
        lo = df.agg(F.min(_ref(x))).first()[0]
    b = F.floor((_ref(x).cast("double") - F.lit(float(lo))) / F.lit(float(width))).cast("long")
    keys = [b.alias("bin")] + ([_ref(hue).alias("hue")] if hue else [])
    out = df.where(_ref(x).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("bin_lo", F.lit(float(lo)) + F.col("bin") * F.lit(float(width)))


def value_histogram(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., value, cnt, cum_cnt, n_group): distinct values per group with running counts; NULL and NaN values are left out, a
    NULL group stays."""
    g = list(by)
    hist = df.where(~missing(df, value)).groupBy(*g, value).agg(F.count(F.lit(1)).alias("cnt"))
    return ordered_cumsum(hist, value, ["cnt"], group_cols=g).withColumnRenamed("all_cnt", "n_group")


def box_stats(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """V3: n, min, q1, median, q3, max per group; quartiles exact with linear interpolation.

    Order statistic r (0-based) is the smallest value whose running count exceeds r; the running
    counts come from ``value_histogram`` (distinct values per group, bucketed windows).
    """
    return _box(value_histogram(df, value, by), value, list(by))


def _box(h: DataFrame, value: str, g: list[str]) -> DataFrame:
    n = F.col("n_group")
    aggs = [F.first("n_group").alias("n"), F.min(value).alias("min"), F.max(value).alias("max")]
    for name, q in QUARTILES:
        pos = F.lit(q) * (n - 1)
        lo = F.floor(pos)
        aggs += [F.min(F.when(F.col("cum_cnt") > lo, _ref(value))).alias(f"_{name}_lo"),
                 F.min(F.when(F.col("cum_cnt") > lo + 1, _ref(value))).alias(f"_{name}_hi"),
                 F.first(pos - lo).alias(f"_{name}_f")]
    s = h.groupBy(*g).agg(*aggs)
    cols = [*g, "n", "min"]
    for name, _ in QUARTILES:
        lo_v, hi_v, f = F.col(f"_{name}_lo"), F.coalesce(F.col(f"_{name}_hi"), F.col(f"_{name}_lo")), F.col(f"_{name}_f")
        s = s.withColumn(name, lo_v.cast("double") + f * (hi_v.cast("double") - lo_v.cast("double")))
        cols.append(name)
    return s.select(*cols, "max")


def scatter_sample(df: DataFrame, n: int, columns: Sequence[str], id_col: str = "SK_ID_CURR", seed: int = 0) -> DataFrame:
    """V4: a bounded hash sample of (id, x, y, hue)."""
    return sample_n(df.select(id_col, *columns), n, id_col, seed)


def client_vs_population(df: DataFrame, ids: DataFrame, value: str, by: Sequence[str] = (),
                         id_col: str = "SK_ID_CURR") -> DataFrame:
    """V5: each requested client's value beside its group's quartiles and the share of the group
    strictly below it. The histogram is made once; quartiles and positions both come from it."""
    g = list(by)
    h = written(value_histogram(df, value, g), "histogram")
    stats = _box(h, value, g).select(*[_ref(c).alias(f"_s{i}") for i, c in enumerate(g)], "q1", "median", "q3")
    quart = h.join(stats, _same(g, "_s"), "inner") if g else h.crossJoin(stats)  # without groups, one row of quartiles
    at = quart.select(*[_ref(c).alias(f"_h{i}") for i, c in enumerate(g)], _ref(value).alias("_v"),
                      ((F.col("cum_cnt") - F.col("cnt")) / F.col("n_group")).alias("share_below"), "q1", "median", "q3")
    clients = semi_join_ids(df.select(id_col, *g, value), ids, id_col).where(~missing(df, value))
    same = _ref(value) == F.col("_v")
    out = clients.join(at, same & _same(g, "_h") if g else same, "inner")
    return out.select(id_col, *g, value, "share_below", "q1", "median", "q3")


def _same(g: Sequence[str], prefix: str):
    """NULL-safe equality of the group columns with their renamed copies."""
    return reduce(lambda a, b: a & b, [_ref(c).eqNullSafe(F.col(f"{prefix}{i}")) for i, c in enumerate(g)])


def allowed_pairings(kinds: DataFrame) -> DataFrame:
    """V6: for each x column, the y columns that may be paired with it: numeric ones when x is binary (categorical), any
    column otherwise, itself never; a sorted list and its length. Input: one row per column."""
    options = kinds.groupBy().agg(F.array_sort(F.collect_list("column")).alias("_all"),
                                  F.array_sort(F.collect_list(F.when(F.col("kind") == "numeric", F.col("column")))).alias("_num"))
    row = options.first()  # two lists of column names
    every, numeric = F.array(*map(F.lit, row["_all"])), F.array(*map(F.lit, row["_num"])).cast("array<string>")
    y = F.array_remove(F.when(F.col("kind") == "categorical", numeric).otherwise(every), F.col("column"))
    return kinds.select("column", "kind", F.array_join(y, ",").alias("y_options"), F.size(y).cast("long").alias("n_options"))


def client_top_values(attributions: DataFrame, values_long: DataFrame, k: int = 10, id_col: str = "SK_ID_CURR",
                      feature: str = "feature", phi: str = "phi") -> DataFrame:
    """V7: each client's k strongest features (by |phi|) with the client's current value."""
    top = top_k_per_client(attributions, k, id_col, feature, phi)
    return top.join(values_long.select(id_col, feature, F.col("value")), [id_col, feature], "left").select(
        id_col, "rank", feature, phi, "value")


def describe_features(names: DataFrame, dictionary: DataFrame, derived: DataFrame | None = None,
                      feature: str = "feature") -> DataFrame:
    """description of each feature name.

    The full name, the root name (prefix and suffix stripped, anchored) and every shorter leading-token prefix of it are
    candidates; the longest candidate found wins, a derived-formula entry before a dictionary entry of
    the same length.
    """
    lookup = dictionary.select(F.col("Row"), F.col("Description"), F.lit(0).alias("prio"))
    if derived is not None:
        lookup = lookup.unionByName(derived.select(F.col("Row"), F.col("Description"), F.lit(1).alias("prio")))
    distinct = names.select(feature).distinct()
    tokens = F.split(feature_root_name(F.col(feature)), "_")
    cands = distinct.select(feature, F.posexplode(F.transform(
        F.sequence(F.lit(1), F.size(tokens)), lambda i: F.array_join(F.slice(tokens, 1, i), "_"))).alias("len", "cand"))
    cands = cands.unionByName(distinct.select(feature, F.lit(1000).alias("len"), F.col(feature).alias("cand")))  # the full name wins
    hits = cands.join(lookup, cands["cand"] == lookup["Row"], "inner")
    best = hits.groupBy(feature).agg(F.max_by("Description", F.col("len") * 2 + F.col("prio")).alias("description"))
    return distinct.join(best, feature, "left")
