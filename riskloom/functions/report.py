"""Report precision: doubles rounded to 30 significant bits (about 9 decimal digits).

Registered queries end in ``report`` so that a value computed by two engines in a different summation
order (a few units in the last place apart) prints the same. The rounding is Veltkamp's split:
c = x * (2^23 + 1); hi = c - (c - x) keeps the 30 leading bits of x, rounded to nearest. It is three
IEEE operations, exact and identical in any engine with IEEE doubles, and small enough to stay inside
generated code for hundreds of columns. Rounding to a power-of-two grid (rather than decimal digits)
also means exact decimals such as sums of prices never sit on a rounding half-point. Non-finite
values pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIG_BITS = 30
_SPLIT = float(2 ** (53 - SIG_BITS) + 1)  # 8388609.0


def round_sig_spark_sql(ref: str) -> str:
    """Spark SQL text of the rounding (double literal suffix D: no decimal arithmetic)."""
    k = f"{_SPLIT:.1f}D"
    return f"CASE WHEN isnan({ref}) OR abs({ref}) >= 1.0E300D THEN {ref} ELSE ({ref} * {k}) - (({ref} * {k}) - {ref}) END"


def round_sig_sql(expr: str, bits: int = SIG_BITS) -> str:
    """DuckDB text of the same rounding."""
    x = f"CAST({expr} AS DOUBLE)"
    k = f"CAST({int(_SPLIT)} AS DOUBLE)"
    return f"CASE WHEN NOT isfinite({x}) OR abs({x}) >= 1e300 THEN {x} ELSE ({x} * {k}) - (({x} * {k}) - {x}) END"


def report(df: DataFrame, bits: int = SIG_BITS) -> DataFrame:
    """Round every double/float column of a result for display and cross-engine comparison."""
    items = []
    for f in df.schema.fields:
        ref = "`" + f.name.replace("`", "``") + "`"
        items.append(f"{round_sig_spark_sql(ref)} AS {ref}" if isinstance(f.dataType, T.DoubleType) else ref)
    return df.selectExpr(*items)  # one call for the whole projection
