"""Order-free checksum of a table, the sum of 60 bits of each row's MD5; in its portable form SQL computes the same."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stands for NULL in a row's text; values are parted by SEP.
NULL, SEP = "\x1e", "\x1f"
#: Grid on which the portable form takes floating values: whole multiples of 1 / GRID.
GRID = 1048576.0
#: From so many multiples on (and for NaN) only the fact is told.
WIDE = 9e18


def _text(df: DataFrame, column: str, portable: bool) -> Column:
    x = F.col(f"`{column}`")
    if portable and isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        on_grid = x.cast("double") * F.lit(GRID)
        x = F.when(x.isNotNull(), F.when(F.abs(on_grid) < WIDE, F.floor(on_grid).cast("string")).otherwise(F.lit("wide")))
    return F.coalesce(x.cast("string"), F.lit(NULL))


def row_text(df: DataFrame, columns: Sequence[str] | None = None, portable: bool = False) -> Column:
    """All values of a row as one text, by column name. Two engines print a double differently: the portable form takes it on a grid."""
    cols = sorted(columns if columns is not None else df.columns)
    return F.concat_ws(SEP, *[_text(df, c, portable) for c in cols])


def table_checksum(df: DataFrame, columns: Sequence[str] | None = None, portable: bool = False) -> DataFrame:
    """One row (n_rows, checksum): equal for tables of equal rows in any order, repeats counted; partial sums before the shuffle."""
    h = F.conv(F.substring(F.md5(row_text(df, columns, portable).cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.select(h.alias("h")).agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum("h"), F.lit(0)).cast("string").alias("checksum"))


def checksum_sql(table: str, texts: Sequence[str], doubles: Sequence[str] = ()) -> str:
    """The portable form in SQL: columns whose texts agree (whole numbers, strings, booleans, dates), and floating columns."""
    parts = {c: f'coalesce(CAST("{c}" AS VARCHAR), chr({ord(NULL)}))' for c in texts}
    for c in doubles:
        on_grid = f'CAST("{c}" AS DOUBLE) * CAST({GRID} AS DOUBLE)'
        value = f"CASE WHEN abs({on_grid}) < CAST({WIDE} AS DOUBLE) THEN CAST(CAST(floor({on_grid}) AS BIGINT) AS VARCHAR) ELSE 'wide' END"
        parts[c] = f'CASE WHEN "{c}" IS NULL THEN chr({ord(NULL)}) ELSE {value} END'
    row = ", ".join(parts[c] for c in sorted(parts))
    number = f"CAST(CAST('0x' || substr(md5(concat_ws(chr({ord(SEP)}), {row})), 1, 15) AS BIGINT) AS HUGEINT)"
    return f"SELECT count(*) AS n_rows, CAST(coalesce(sum({number}), 0) AS VARCHAR) AS checksum FROM {table}"
