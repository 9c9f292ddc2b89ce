"""Feature names: aggregate suffixes, block prefixes, root names (P10, F1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Block prefixes of the wide feature row.
BLOCK_PREFIXES = ("BURO", "PREV", "ACTIVE", "CLOSED", "APPROVED", "REFUSED", "POS", "INSTAL", "CC")
# Aggregate suffixes of the wide feature row.
AGG_SUFFIXES = ("MEAN", "MIN", "MAX", "VAR", "SUM", "SIZE", "NUNIQUE")


def agg_name(prefix: str, column: str, func: str) -> str:
    """``<PREFIX><column>_<FUNC>``; the prefix carries its own underscore ("BURO_")."""
    return f"{prefix}{column}_{func.upper()}"


def dummy_name(column: str, value: str | None) -> str:
    """One-hot column name ``<col>_<value>``; the NULL indicator is ``<col>_nan``."""
    return f"{column}_{'nan' if value is None else value}"


def feature_root_name(name: Column | str) -> Column:
    """Strip one leading block prefix and one trailing aggregate suffix, each anchored (F1).

    Inner tokens are kept, so OCCUPATION_TYPE and AMT_INSTALMENT stay whole.
    """
    c = F.col(name) if isinstance(name, str) else name
    head = "^(" + "|".join(BLOCK_PREFIXES) + ")_"
    tail = "_(" + "|".join(AGG_SUFFIXES) + ")$"
    return F.regexp_replace(F.regexp_replace(c, head, ""), tail, "")


