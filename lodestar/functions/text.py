"""String functions with the semantics of Python's str and re, as column expressions."""

from __future__ import annotations

from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What str.strip() takes away.
WS = r"[\t-\r\x1c-\x20\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def rx(pattern: str, flags: str = "") -> str:
    """A pattern for Spark that matches as Python's re does: Unicode classes, '.' stops at \\n alone."""
    return f"(?dU{flags})" + pattern


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{WS}+|{WS}+\z", "")


def lstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{WS}+", "")


def blank(c: Column) -> Column:
    return F.length(strip(c)) == 0


def lines(c: Column) -> Column:
    return F.split(c, "\n")


def join_lines(c: Column) -> Column:
    return F.array_join(c, "\n")


def first_line(c: Column) -> Column:
    return F.substring_index(c, "\n", 1)


def part(c: Column, separator: str, k: int) -> Column:
    """str.split(separator)[k]; null where there is no such part."""
    return F.get(F.split(c, F.lit(r"\Q" + separator + r"\E")), F.lit(k))


def quote_replacement(c: Column) -> Column:
    """Text that regexp_replace() puts in as it is."""
    return F.regexp_replace(c, r"([\\$])", r"\\$1")


def preview(c: Column, n: int = 100) -> Column:
    return F.concat(F.substring(c, 1, n), F.lit("..."))


def fixed(c: Column, digits: int = 4) -> Column:
    """Python's f"{x:.{digits}f}": the binary value itself is rounded, and an exact half to the even digit."""
    scale = float(10**digits)
    x = c.cast("double")
    size = F.abs(x)
    scaled = size * scale
    whole = F.floor(scaled).cast("double")
    # what `scaled` lost in rounding, by splitting `size` into two halves whose products with the scale are exact
    t = size * 134217729.0
    high = t - (t - size)
    lost = (high * scale - scaled) + (size - high) * scale
    over = (scaled - whole - 0.5) + lost
    up = (over > 0) | ((over == 0) & (F.pmod(whole, F.lit(2.0)) == 1))
    n = F.when(up, whole + 1).otherwise(whole).try_cast("bigint")
    power = F.lit(10**digits)
    sign = F.when(F.signum(x).cast("string").startswith("-"), "-").otherwise("")
    exact = F.concat(sign, F.format_string(f"%d.%0{digits}d", F.floor(n / power), F.pmod(n, power)) if digits else n.cast("string"))
    special = F.when(F.isnan(x), "nan").when(size == float("inf"), F.concat(sign, F.lit("inf")))
    return special.when(scaled < 4503599627370496.0, exact).otherwise(F.format_string(f"%.{digits}f", x))


def percent(c: Column, digits: int = 2) -> Column:
    return F.concat(fixed(c.cast("double") * 100, digits), F.lit("%"))


def duration(seconds: Column) -> Column:
    """Seconds, minutes or hours with one digit."""
    s = seconds.cast("double")
    return F.when(s < 60, F.concat(fixed(s, 1), F.lit("s"))).when(s < 3600, F.concat(fixed(s / 60, 1), F.lit("m"))).otherwise(F.concat(fixed(s / 3600, 1), F.lit("h")))


def line_starts(c: Column) -> Column:
    """The character positions at which the lines of a text begin (null: null), by Arrow batches: built-in functions would
    either go over a text once a line or shuffle its lines."""

    @F.pandas_udf("array<bigint>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [0, *accumulate(len(x) + 1 for x in t.split("\n")[:-1])] for t in texts])

    return run(c)


def line_offsets(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """keys, line_no and position: the character position at which each line of a text begins, a row a line. Positions are
    found inside the row, before its lines are dealt out, so rows of equal keys stay apart and nothing is shuffled."""
    return df.select(*keys, F.posexplode(line_starts(F.col(column))).alias("line_no", "position"))
