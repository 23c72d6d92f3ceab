"""Row numbers, chunks, zips, skewed joins, batches, running values and injection, against plain Python."""

import random
import subprocess
import sys

import pytest
from conftest import DATA, rows_of
from pyspark.sql import functions as F

from lodestar.functions import text as X
from lodestar.operators import batching, inject, metrics, pairing, scans


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_rows_keep_their_columns_and_get_numbers(spark):
    d = spark.range(3000).selectExpr("2999 - id as k", "cast(id as string) as s", "if(id % 3 = 0, null, id) as n").repartition(5)
    got = pairing.with_row_index(d, "k", total="all")
    assert got.columns == ["k", "s", "n", "row_idx", "all"] and shuffles(got) == 1
    rows = got.collect()
    assert all(r["row_idx"] == r["k"] and r["all"] == 3000 for r in rows) and len(rows) == 3000
    by_two = pairing.with_row_index(d, "n", "k").orderBy("row_idx").collect()
    assert [(r["n"] is not None, r["n"] or 0, r["k"]) for r in by_two] == sorted((r["n"] is not None, r["n"] or 0, r["k"]) for r in rows)


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 1024, 1500])
def test_chunks_hold_their_numbers(spark, n):
    d = pairing.in_chunks(spark.range(n).withColumn("x", -F.col("id")), "x")
    assert sorted((r["row_idx"], r["_chunk"], r["x"]) for r in d.collect()) == [(i, i // 512, i - n + 1) for i in range(n)]


def test_equal_keys_over_chunks(spark):
    d = spark.range(2000).selectExpr("id % 2 as k", "id").repartition(3)
    got = pairing.with_row_index(d, "k").collect()
    assert sorted(r["row_idx"] for r in got) == list(range(2000)) and all((r["row_idx"] >= 1000) == r["k"] for r in got)
    z = pairing.zip_sorted(d, ["k"], spark.range(1500).withColumnRenamed("id", "b"), ["b"])
    assert sorted(r["b"] for r in z.collect()) == list(range(1500))


@pytest.mark.parametrize("n, m", [(1300, 900), (900, 1300), (1024, 1024), (0, 4), (3, 3)])
def test_zip(spark, n, m):
    a, b = spark.range(n).selectExpr("id as a", "id * 2 as `x.y`").repartition(4), spark.range(m).selectExpr("cast(id + 5 as int) as b", "'q' as q").repartition(3)
    got = pairing.zip_sorted(a, ["a"], b, ["b"], name="at")
    assert got.columns == ["at", "a", "x.y", "b", "q"]
    assert sorted(tuple(r) for r in got.collect()) == [(i, i, 2 * i, i + 5, "q") for i in range(min(n, m))]
    if n != m:
        with pytest.raises(ValueError, match="length"):
            pairing.zip_sorted(a, ["a"], b, ["b"], "strict")
    if n > m:
        with pytest.raises(ValueError, match="short"):
            pairing.zip_sorted(a, ["a"], b, ["b"], "left")
    else:
        assert pairing.zip_sorted(a, ["a"], b, ["b"], "left").count() == n


def test_zip_shuffles_each_side_once(spark):
    a, b = (spark.range(3000).selectExpr(f"id as {c}", f"id as {c}2") for c in "ab")
    z = pairing.zip_sorted(a, ["a"], b, ["b"])
    assert shuffles(z) == 2


def test_join_with_one_key_of_most_rows(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        for hot in (7, None):
            a = spark.range(40_000).select(F.when(F.col("id") % 10 < 9, F.lit(hot)).otherwise(F.col("id")).alias("k"), F.col("id").alias("v")).repartition(3)
            b = spark.createDataFrame([(hot, "x"), (hot, "y"), (19, "z"), (None, "n")], "k bigint, v string")
            plain, split = pairing.key_join(a, b, "k"), pairing.key_join(a, b, "k", skewed=True)
            assert split.columns == plain.columns == ["k", "v_x", "v_y"]
            assert split.exceptAll(plain).count() == plain.exceptAll(split).count() == 0
            largest = [d.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] for d in (plain, split)]
            assert largest[0] >= 72_000 and largest[1] < 15_000
        assert pairing.heavy_keys(spark.range(1000), F.col("id")) == {} == pairing.heavy_keys(spark.range(0), F.col("id"))
    finally:
        for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.unset(k)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("size", [1, 7, 8, 600])
def test_batches_lie_in_chunks(spark, size):
    rows = [(i, [1] * (i % 11), [2] * (i % 5)) for i in range(1300)]
    d = spark.createDataFrame(rows, "id bigint, inputs array<int>, outputs array<int>")
    got = batching.pad_right(batching.train_example(batching.batched(d, size, "id")))
    assert shuffles(got) == 1
    longest = {}
    for i, a, b in rows:
        longest[i // size] = max(longest.get(i // size, 0), len(a) + len(b))
    got = got.collect()
    assert len(got) == 1300
    for r in got:
        assert r["batch_id"] == r["id"] // size and len(r["input_ids"]) == len(r["labels"]) == len(r["attention_mask"]) == longest[r["batch_id"]]
        assert r["input_ids"][: r["id"] % 11] == [1] * (r["id"] % 11) and sum(r["attention_mask"]) == r["id"] % 11 + r["id"] % 5
    plain = batching.pad_right(batching.train_example(batching.with_batch(pairing.with_row_index(d, "id"), size)))
    assert sorted((r["id"], r["input_ids"], r["labels"]) for r in plain.collect()) == sorted((r["id"], r["input_ids"], r["labels"]) for r in got)


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_prefix_scan(spark, by, inclusive):
    r = random.Random(4)
    rows = [(r.choice([None, "a", "a", "a", "b", *"cdefgh"]), i, r.choice([None, *range(-50, 50)])) for i in range(900)]
    d = spark.createDataFrame(rows, "g string, i int, v bigint").repartition(4)
    got = scans.prefix_scan(d, ["i"], {"s": ("sum", "v"), "hi": ("max", "v"), "lo": ("min", "v")}, by, inclusive, chunk=64)
    assert got.columns == ["g", "i", "v", "s", "hi", "lo"]
    seen, want = {}, {}
    for g, i, v in rows:
        before = seen.setdefault(g if by else 0, [])
        upto = before + ([v] if v is not None else [])
        use = upto if inclusive else list(before)
        want[i] = (sum(use), max(use), min(use)) if use else (None, None, None)
        seen[g if by else 0] = upto
    assert {x["i"]: (x["s"], x["hi"], x["lo"]) for x in got.collect()} == want
    assert scans.prefix_scan(d.limit(0), ["i"], {"s": ("sum", "v")}).count() == 0


def test_running_best(spark):
    d = spark.createDataFrame([(e, a) for e, a in enumerate([0.0, 0.2, 0.2, 0.1, 0.5])], "epoch int, accuracy double")
    assert [r["saved"] for r in metrics.running_best(d).orderBy("epoch").collect()] == [False, True, False, False, True]


def test_running_best_as_an_application_begins(duck, tmp_path):
    """The columns of an application's first query have numbers as low as those by which Spark compares arguments of lambdas."""
    sf, out = f"{DATA}/sf0.1", f"{tmp_path}/out"
    code = "import __spark_entry__ as e\nfrom lodestar.session import session\ns = session(spark__master='local[2]', spark__ui__enabled='false', spark__sql__shuffle__partitions='4')\n"
    subprocess.run([sys.executable, "-c", f"{code}e.queries()['running_best_checkpoint'](s, {sf!r}).write.parquet({out!r})\ns.stop()\n"], check=True, timeout=120)
    con = duck.cursor()
    con.sql(f"create temp view events as select * from '{sf}/events.parquet'")
    import __spark_entry__ as e

    got, want = con.sql(f"select * from '{out}/*.parquet'"), con.sql(e.oracle_sql()["running_best_checkpoint"])
    assert rows_of(got.columns, got.fetchall()) == rows_of(want.columns, want.fetchall())


def test_line_offsets_of_equal_keys(spark):
    d = spark.createDataFrame([(1, "a\nbé\n"), (1, "xyz\n\nq"), (1, "a\nbé\n"), (2, None), (3, "")], "id int, t string")
    got = sorted(tuple(r) for r in X.line_offsets(d, "t", "id").collect())
    assert got == sorted([(1, 0, 0), (1, 1, 2), (1, 2, 5)] * 2 + [(1, 0, 0), (1, 1, 4), (1, 2, 5), (3, 0, 0)])


def folded(content, todo, strict=True):
    n = 0
    for _, name, oracle in sorted(todo, key=lambda t: t[0]):
        new = inject.inject_by_name(content, name, oracle, strict)
        n, content = n + (new != content), new
    return content, n


METHOD = "@Test(timeout = 1)\n  public void {}() throws E {{\n    int a = 1;\n    {}\n  }}\n"
FILES = {
    "plain": "class T {\n" + METHOD.format("t1", "assertTrue(a);") + METHOD.format("t10", "fail(\"x\");") + METHOD.format("t2", "") + "}",
    "twice": METHOD.format("t1", "assertEquals(1, a);") * 2 + METHOD.format("t2", ""),
    "open": "@Test\npublic void t1() {\n" + METHOD.format("t2", "assertTrue(a);") + METHOD.format("t1", ""),
    "unclosed": METHOD.format("t2", "x();") + "@Test\npublic void t1() {",
    "empty": "",
}
ORACLES = ["assertTrue(x);", "exception", "", None, "foo(a)", "assertThrows(E.class, () -> { run(); })", "if (a) { assertTrue(b); }"]


@pytest.mark.parametrize("odd", [None, ("t1()", "x();"), ("t2", "@Test\n public void t1() { }")])
def test_injection_by_method_is_the_fold_over_files(spark, odd):
    r = random.Random(2)
    todo = [(f, k, r.choice(["t1", "t10", "t2", "t3"]), r.choice(ORACLES)) for f in [*FILES, "missing"] for k in range(12)]
    todo += [("plain", 99, *odd)] if odd else []
    files = spark.createDataFrame([(p, f, c) for p in ("p", None) for f, c in FILES.items()], "project string, file_path string, content string")
    preds = spark.createDataFrame([("p", *t) for t in todo], "project string, file_path string, pred_seq int, test_name string, prediction string").repartition(3)
    for strict in (True, False):
        got = {(x["project"], x["file_path"]): (x["content"], x["n_injected"]) for x in inject.inject_fold(files, preds, strict).collect()}
        assert got == {("p", f): folded(c, [t[1:] for t in todo if t[0] == f], strict) for f, c in FILES.items()} | {(None, f): (c, 0) for f, c in FILES.items()}
    assert inject.method_pieces(FILES["open"]) is None and len(inject.method_pieces(FILES["plain"])) == 7


def test_many_predictions_of_one_file(spark):
    body = "".join(METHOD.format(f"t{i}", "assertTrue(a);") for i in range(200))
    files = spark.createDataFrame([("f", body)], "file_path string, content string")
    preds = spark.range(4000).selectExpr("'f' as file_path", "id as pred_seq", "concat('t', id % 200) as test_name", "concat('assertEquals(', id, ', a);') as prediction")
    got = inject.inject_fold(files, preds).first()
    assert got["n_injected"] == 4000 and all(f"assertEquals({3800 + i}, a);" in got["content"] for i in range(200)) and got["content"].count("assert") == 200


def test_oracles_in_order_equal_one_by_one():
    """A method's oracles in one pass give what injecting each by itself gives."""
    r = random.Random(11)
    some = ["assertTrue(a);", "assertEquals(a, f(b))", "fail(x);", "fail(", "assert", "assertX(", ")", "f(b);", "asassert(a);sert(b);", "ert(c);", "fa", "il(y);", ";", "", None, "exception", "{", "x = 1", "}", "if (a) { b(); }", "asser", "é();"]
    heads = ["@Test\n  public void t() {", "@Test(timeout = 5)\npublic void t() throws E {", "@Test // assertTrue(\n public void t() {", "@Test\npublic void t() } x {"]
    fast = 0
    for _ in range(4000):
        body = "".join(r.choice(["\n", " ", ""]) + (r.choice(some) or "").replace("}", "") for _ in range(r.randint(0, 4)))
        text, oracles = r.choice(heads) + body + "}", [r.choice(some) for _ in range(r.randint(0, 7))]
        want, n = text, 0
        for o in oracles:
            new = inject.inject_by_name(want, "t", o)
            want, n = new, n + (new != want)
        assert inject.inject_in_order(text, "t", oracles) == (want, n), (text, oracles)
        fast += not any("}" in (o or "") for o in oracles)
    assert fast > 1000
