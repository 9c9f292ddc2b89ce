"""Column functions with the NULL / NaN / infinity rules of the feature engine.

Rules (see SURVEY sec. 1.2):
* a ratio with a zero denominator is +/-infinity, 0/0 is NULL (the source's NaN, skipped by aggregates);
* infinity flows through aggregates and becomes NULL only on block outputs (``nonfinite_to_null``);
* a sentinel day count means "missing".
All are JVM expressions; nothing here runs Python per row.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF = float("inf")

# Fixed value: day offset used by the source data for "no date".
DAYS_SENTINEL = 365243

# Row hashes for sampling, splits and folds: the leading 60 bits of an MD5, identical in Spark and SQL.
HASH_BITS = 60
HASH_MOD = 1 << HASH_BITS

# Probabilities are clipped to [EPS, 1 - EPS] before a logarithm, so a confident wrong score costs much instead of nothing.
LOG_LOSS_EPS = 1e-15

# Risk bands of a default probability (lower bound inclusive).
BAND_SUBSTANTIAL = 0.35
BAND_VERY_HIGH = 0.64
BAND_NAMES = ("none", "substantial", "very high")


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_ratio(num: Column | str, den: Column | str) -> Column:
    """num / den as double: den = 0 gives +/-inf (or NULL when num = 0); NULL operands give NULL.

    Never raises under ANSI mode because the division only runs on non-zero denominators.
    """
    n = _c(num).cast("double")
    d = _c(den).cast("double")
    return (
        F.when(n.isNull() | d.isNull(), F.lit(None).cast("double"))
        .when(d != 0, n / d)
        .when(n > 0, F.lit(INF))
        .when(n < 0, F.lit(-INF))
        .otherwise(F.lit(None).cast("double"))
    )


def is_finite(c: Column | str) -> Column:
    x = _c(c)
    return ~F.isnan(x) & (F.abs(x) != F.lit(INF))


def nonfinite_to_null(c: Column | str) -> Column:
    """+inf, -inf and NaN become NULL; other values (and NULL) pass."""
    x = _c(c)
    return F.when(is_finite(x), x)


def nonfinite_to_null_all(df: DataFrame, exclude: Iterable[str] = ()) -> DataFrame:
    """Apply ``nonfinite_to_null`` to every float/double column in one projection."""
    skip = set(exclude)
    items = []
    for f in df.schema.fields:
        r = "`" + f.name.replace("`", "``") + "`"
        if f.name not in skip and isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            items.append(f"CASE WHEN isnan({r}) OR abs({r}) = double('Infinity') THEN NULL ELSE {r} END AS {r}")
        else:
            items.append(r)
    return df.selectExpr(*items)  # one call for the whole projection


def missing(df: DataFrame, column: str) -> Column:
    """True where a value is NULL, or NaN in a floating column: the one rule for "missing" outside the blocks."""
    x = F.col(f"`{column}`")
    return x.isNull() | F.isnan(x) if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)) else x.isNull()


def sentinel_to_null(c: Column | str, sentinel: float = DAYS_SENTINEL) -> Column:
    x = _c(c)
    return F.when(x != F.lit(sentinel), x)


def clip_at_zero(c: Column | str) -> Column:
    """x if x > 0 else 0; NULL becomes 0 like the source's lambda."""
    x = _c(c)
    return F.when(x > 0, x).otherwise(F.lit(0))


def parity_hash(id_col: Column | str, seed: int = 0) -> Column:
    """Hash in [0, HASH_MOD) of an id of any type (NULL counts as the empty text); other seeds give independent hashes."""
    text = F.concat(F.coalesce(_c(id_col).cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def parity_hash_sql(id_expr: str, seed: int = 0) -> str:
    return f"CAST('0x' || substr(md5(coalesce(CAST({id_expr} AS VARCHAR), '') || ':{seed}'), 1, {HASH_BITS // 4}) AS BIGINT)"


def risk_band(p: Column | str) -> Column:
    x = _c(p)
    return (
        F.when(x < BAND_SUBSTANTIAL, F.lit(BAND_NAMES[0]))
        .when(x < BAND_VERY_HIGH, F.lit(BAND_NAMES[1]))
        .when(x.isNotNull(), F.lit(BAND_NAMES[2]))
    )


def weighted_log_loss_term(y: Column | str, p: Column | str, w: float | Column = 1.0) -> Column:
    """-(w * y * ln p + (1 - y) * ln(1 - p)) for one row, p clipped; sum it for the loss."""
    yy = _c(y).cast("double")
    pp = F.least(F.greatest(_c(p).cast("double"), F.lit(LOG_LOSS_EPS)), F.lit(1.0 - LOG_LOSS_EPS))
    ww = w if isinstance(w, Column) else F.lit(float(w))
    return -(ww * yy * F.ln(pp) + (F.lit(1.0) - yy) * F.ln(F.lit(1.0) - pp))
