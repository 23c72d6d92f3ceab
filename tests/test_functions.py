"""Text, cleaning and target rules against Python's own str and re."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestar.functions import cleaning as C
from lodestar.functions import targets as T
from lodestar.functions import text as X

TEXTS = [
    "", " x\t ", "\n x \x1c\n", " x　", "a\n\n b \n", "try { a(); fail(\"x\"); } catch (E e) { b(); }", "try{\n fail( y );\n}catch(E e)\n{ {z} }", "entry + catch",
    "assertTrue(a); assertNull(b);", "assertEquals(1,\n a);", "assertX(a\rb);", "asserté(1);", "fail(a(b)); } catch", "  // Undeclared exception!\nint a;\n\n", "one", "one\ntwo", " a\n b\n\n c \nd ",
    "fail(x)\n\n}\n catch", "x;\r\ny;", "assert a;",
]


def values(spark, f, texts=TEXTS):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["v"] for r in d.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]


def py_clean(t):
    kept = [x for x in t.strip().split("\n") if x.strip()]
    if not kept:
        return None
    return "\n".join([t.strip().split("\n")[0].strip(), *["\t" + x.lstrip() for x in kept[1:-1]], kept[-1].strip()])


def py_strip_block(t):
    t = re.sub(r"try\s*\{", "", t)
    t = re.sub(r"fail\s*\([^)]*\);", "", t)
    return re.sub(r"\}\s*catch\s*\([^)]*\)\s*\{.*?\}", "", t, flags=re.S)


CASES = {
    "strip": (X.strip, str.strip),
    "lstrip": (X.lstrip, str.lstrip),
    "first_line": (X.first_line, lambda t: t.split("\n")[0]),
    "undeclared": (C.drop_undeclared, lambda t: "\n".join(x for x in t.split("\n") if not re.match(r"^.*\/\/\s*Undeclared exception!.*$", x) and x.strip())),
    "strip_block": (C.strip_exception_block, py_strip_block),
    "indent_body": (C.indent_body, py_clean),
    "remove_blank_lines": (C.remove_blank_lines, lambda t: "\n".join(x for x in t.strip().split("\n") if x.strip())),
    "first_assertion": (C.first_assertion, lambda t: next(iter(re.findall(r"assert\w*\(.*\);", t)), None)),
    "clean_prefix": (C.clean_prefix, lambda t: "\n".join(x for x in re.sub(r"assert\w*\(.*?\);", "", py_strip_block(t), flags=re.S).split("\n") if x.strip())),
    "is_exception": (C.is_exception_oracle, lambda t: bool(re.search(r"fail\(.*\).*}\s*catch", t, re.S))),
    "loose": (T.is_exception_loose, lambda t: t.strip().lower() == "exception"),
    "preview": (X.preview, lambda t: t[:100] + "..."),
    "oracle": (C.prepared_oracle, lambda t: "exception" if "try" in t and "catch" in t else next(iter(re.findall(r"assert\w*\(.*\);", t)), "") if "assert" in t else ""),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_like_python(name, spark):
    ours, python = CASES[name]
    assert values(spark, ours) == [python(t) for t in TEXTS]


def test_null_rules(spark):
    texts = [None, "nan", "NaN", "finance", ""]
    assert values(spark, T.null_to_blank, texts) == ["", "", "NaN", "", ""]
    assert values(spark, lambda c: T.null_to_blank(c, "strict"), texts) == ["", "nan", "NaN", "finance", ""]


def test_label_by_substring(spark):
    d = spark.createDataFrame([(0, 0.0), (1, 1.0), (-1, None), (None, None)], "i int, d double")
    got = d.select(T.label_by_substring(F.col("i")).alias("i"), T.label_by_substring(F.col("d")).alias("d")).collect()
    assert [tuple(r) for r in got] == [(0, 0), (1, 0), (1, 1), (1, 1)]


def test_normalised(spark):
    texts = ["exception", "Exception", "assertTrue(a);", "assertTrue(a)", ""]
    assert values(spark, T.normalised_except, texts) == [1, 0, 0, 0, 0]
    assert values(spark, T.normalised_assert, texts) == ["", "", "assertTrue(a);", "", ""]


def test_duration(spark):
    d = spark.createDataFrame([(1.0,), (90.0,), (7200.0,)], "s double")
    assert [r[0] for r in d.select(X.duration(F.col("s"))).collect()] == ["1.0s", "1.5m", "2.0h"]


def test_line_offsets(spark):
    d = spark.createDataFrame([(1, ""), (2, "ab\n\nc"), (3, "x\n" * 20_000)], "id int, t string")
    got = {(r["id"], r["line_no"]): r["position"] for r in X.line_offsets(d, "t", "id").collect()}
    assert {k: v for k, v in got.items() if k[0] < 3} == {(1, 0): 0, (2, 0): 0, (2, 1): 3, (2, 2): 4}
    assert len(got) == 4 + 20_001 and got[3, 20_000] == 40_000


def test_formats_round_as_python_does(spark):
    r = random.Random(1)
    some = [0.0, -0.0, 0.5, 1.5, 2.5, 0.125, 0.375, 2.675, 1.005, 1e-9, -0.004, 123456.785, 9.995, 0.05, 0.15, 0.25, 0.35, 69.0, 1e17, 1e300, float("inf"), float("-inf"), float("nan")]
    some += [x / 64 for x in range(300)] + [x / 60 for x in range(60, 3600, 7)] + [r.uniform(-1, 1) * 10 ** r.randint(-6, 9) for _ in range(3000)]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(some)], "i int, x double")
    for digits in (0, 1, 2, 4):
        got = {g["i"]: g["s"] for g in d.select("i", X.fixed(F.col("x"), digits).alias("s")).collect()}
        assert got == {i: f"{x:.{digits}f}" for i, x in enumerate(some) if abs(x) != 1e300} | {i: got[i] for i, x in enumerate(some) if abs(x) == 1e300}
    got = {g["i"]: g["s"] for g in d.where("abs(x) < 1e12").select("i", X.percent(F.col("x")).alias("s")).collect()}
    assert all(s == f"{some[i]:.2%}" for i, s in got.items())
    assert values(spark, lambda c: X.duration(c.cast("double")), ["69", "59.95", "3599.9", "7200", "5.25"]) == ["1.1m", "60.0s", "60.0m", "2.0h", "5.2s"]
