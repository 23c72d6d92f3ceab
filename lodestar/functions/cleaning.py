"""Cleaning of test code and extraction of its oracle, as column expressions.

Three assertion patterns live side by side on purpose: they accept different texts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, join_lines, lines, lstrip, rx, strip

# Patterns that decide results, as the inputs' format has them.
UNDECLARED = rx(r"^.*\/\/\s*Undeclared exception!.*$")
TRY_OPEN = rx(r"try\s*\{")
FAIL_CALL = rx(r"fail\s*\([^)]*\);")
CATCH_BLOCK = rx(r"\}\s*catch\s*\([^)]*\)\s*\{.*?\}", "s")
ASSERT_LINE = rx(r"assert\w*\(.*\);")
ASSERT_LAZY = rx(r"assert\w*\(.*?\);", "s")
ASSERT_CALL = rx(r"assert\w*\([^;]*\);")
FAIL_BEFORE_CATCH = rx(r"fail\(.*\).*}\s*catch", "s")


def drop_undeclared(c: Column) -> Column:
    """Lines with the comment, and blank lines, go."""
    return join_lines(F.filter(lines(c), lambda x: ~x.rlike(UNDECLARED) & ~blank(x)))


def strip_exception_block(c: Column) -> Column:
    """try {, fail(...); and } catch (...) {...} up to the first closing brace go, in this order."""
    for p in (TRY_OPEN, FAIL_CALL, CATCH_BLOCK):
        c = F.regexp_replace(c, p, "")
    return c


def remove_blank_lines(c: Column) -> Column:
    return join_lines(F.filter(lines(strip(c)), lambda x: ~blank(x)))


def drop_blank_lines(c: Column) -> Column:
    """As remove_blank_lines(), but the text's own ends stay as they are."""
    return join_lines(F.filter(lines(c), lambda x: ~blank(x)))


def indent_body(c: Column) -> Column:
    """First and last line stripped, those between tab-indented, blank ones gone. One line comes out twice; blank text is null."""
    kept = F.filter(lines(strip(c)), lambda x: ~blank(x))
    inner = F.transform(F.slice(kept, 2, F.greatest(F.size(kept) - 2, F.lit(0))), lambda x: F.concat(F.lit("\t"), lstrip(x)))
    ends = [F.array(strip(F.try_element_at(kept, F.lit(k)))) for k in (1, -1)]
    return F.when(F.size(kept) > 0, join_lines(F.concat(ends[0], inner, ends[1])))


def first_assertion(c: Column) -> Column:
    return F.try_element_at(F.regexp_extract_all(c, F.lit(ASSERT_LINE), F.lit(0)), F.lit(1))


def remove_assertions(c: Column) -> Column:
    return remove_blank_lines(F.regexp_replace(c, ASSERT_LINE, ""))


def has_exception_words(c: Column) -> Column:
    return c.contains("try") & c.contains("catch")


def prepared_prefix(c: Column) -> Column:
    """What a model sees of the test: see prepared_oracle() for the cases."""
    return F.when(has_exception_words(c), indent_body(strip_exception_block(c))).when(c.contains("assert"), remove_assertions(c)).otherwise(c)


def prepared_oracle(c: Column) -> Column:
    """'exception' where the words try and catch occur, else the first one-line assertion, else ''."""
    return F.when(has_exception_words(c), F.lit("exception")).when(c.contains("assert"), F.coalesce(first_assertion(c), F.lit(""))).otherwise(F.lit(""))


def clean_prefix(c: Column) -> Column:
    """The evaluation's cleaning: exception blocks and lazily matched assertions go, then blank lines."""
    return drop_blank_lines(F.regexp_replace(strip_exception_block(c), ASSERT_LAZY, ""))


def is_exception_oracle(c: Column) -> Column:
    return c.rlike(FAIL_BEFORE_CATCH)
