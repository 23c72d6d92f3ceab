"""Null rules, targets and class codes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip


def nan_like(c: Column) -> Column:
    """Null, or text that holds 'nan' anywhere: 'finance' too."""
    return c.isNull() | c.contains("nan")


def null_to_blank(c: Column, mode: str = "substring") -> Column:
    """mode 'substring' blanks whatever is nan_like(), 'strict' nulls alone."""
    return F.when(nan_like(c) if mode == "substring" else c.isNull(), F.lit("")).otherwise(c)


def target_from_flag(assertion: Column, flag: Column) -> Column:
    """'exception' for flag -1, else the assertion, stripped; nulls as ''."""
    return strip(F.when(flag == -1, F.lit("exception")).otherwise(F.coalesce(assertion, F.lit(""))))


def target_from_label(exception_label: Column, assertion: Column) -> Column:
    """The assertion where the label is false, 'exception' where it is true or null."""
    return F.when(exception_label == F.lit(False), null_to_blank(assertion)).otherwise(F.lit("exception"))


def is_exception_exact(c: Column) -> Column:
    return c == "exception"


def is_exception_loose(c: Column) -> Column:
    return F.lower(strip(c)) == "exception"


def normalised_except(output: Column) -> Column:
    return F.when(is_exception_exact(output), 1).otherwise(0)


def normalised_assert(output: Column) -> Column:
    """'' for 'exception' and for text that doesn't end a statement."""
    return F.when(is_exception_exact(output) | ~output.endswith(";"), F.lit("")).otherwise(output)


def oracle_type(output: Column) -> Column:
    return F.when(is_exception_loose(output), 1).otherwise(0)


def label_by_substring(c: Column) -> Column:
    """0 where the text form holds a 0, else 1: 1.0 is class 0, -1 and null are class 1."""
    return F.when(c.cast("string").contains("0"), 0).otherwise(1)


def label_numeric(c: Column) -> Column:
    return F.when(c.cast("double") == 0, 0).otherwise(1)


def exact_match(prediction: Column, target: Column) -> Column:
    return strip(prediction) == strip(target)
