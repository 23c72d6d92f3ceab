"""Search for similar prefixes against plain Python."""

import math
import random
import re
import time

import pytest

from lodestar.operators import search


def plain(corpus, queries, k, least, others):
    sets = {i: set(re.findall(search.TOKEN, t or "")) for i, t, _ in corpus}
    sets = {i: s for i, s in sets.items() if s}
    n, having = len(sets), {}
    for s in sets.values():
        for t in s:
            having[t] = having.get(t, 0) + 1

    def weight(ts):
        return sum(math.floor(1000 * math.log(n / having.get(t, 1))) + 1 for t in ts)

    value, out = {i: v for i, _, v in corpus}, []
    for q, text in queries:
        asked, found = set(re.findall(search.TOKEN, text or "")), []
        for i, s in sets.items():
            if asked and not (others and i == q):
                common = weight(asked & s)
                alike = common / (weight(asked) + weight(s) - common)
                if alike >= least:
                    found.append((-alike, i))
        out += [(q, r + 1, i, value[i], -a) for r, (a, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def texts(seed, n, words):
    r = random.Random(seed)
    return [" ".join(f"w{min(r.randrange(words), r.randrange(words))}" for _ in range(r.choice([1, 3, 6, 12]))) for _ in range(n)]


@pytest.mark.parametrize("least, k, others, block", [(0.3, 1, False, 256), (0.1, 3, True, 4), (0.6, 2, True, 256)])
def test_search_is_exact(spark, monkeypatch, least, k, others, block):
    monkeypatch.setattr(search, "BLOCK", block)
    template = [f"int a = f({i}); assertEquals(1, a); fail(x);" for i in range(150)]
    corpus = [(i, t, f"o{i}") for i, t in enumerate([None, "", "é ñ", *["same thing here"] * 9, *template, *texts(1, 250, 60)])]
    queries = [(i, t) for i, t, _ in corpus if i % 7 == 0] + [(-1, "never seen"), (-2, None), (-3, "same thing here"), (-4, template[3] + " w1")]
    rows = spark.createDataFrame(corpus, "id int, test_prefix string, target string").repartition(3)
    asked = spark.createDataFrame(queries, "id int, test_prefix string")
    got = search.search(search.build(rows, depth=4, least=least), asked, k=k, others=others)
    assert sorted(map(tuple, got.collect()), key=str) == plain(corpus, queries, k, least, others)


def test_terms_and_tables_too_many_to_be_sent(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 8)
    monkeypatch.setattr(search, "MOST_TERMS", 40)
    monkeypatch.setattr(search, "SMALL", 0)
    corpus = [(i, t, f"o{i}") for i, t in enumerate([None, *["same thing here"] * 9, *[f"int a = f({i}); fail(x);" for i in range(80)], *texts(2, 200, 60)])]
    queries = [(i, t) for i, t, _ in corpus if i % 5 == 0] + [(-1, "never seen")]
    index = search.build(spark.createDataFrame(corpus, "id int, test_prefix string, target string"), least=0.2)
    assert index.terms.where("not frequent").count() > 0 and index.terms.where("frequent").count() > 0
    got = search.search(index, spark.createDataFrame(queries, "id int, test_prefix string"), k=3, others=True)
    assert sorted(map(tuple, got.collect()), key=str) == plain(corpus, queries, 3, 0.2, True)


def test_templates_move_few_bytes_a_row(spark):
    """In proportion to the rows, and not several times the text: a token of each of them was moved with its set's name."""
    moved = []
    for n in (5_000, 20_000):
        code = "concat('try { op(', id, '); fail(\"x\"); } catch(E e) { }')"
        rows = spark.range(n).selectExpr("id", f"if(id % 4 = 0, {code}, concat('int a = f(', id, ');')) as test_prefix", "'exception' as target")
        before = shuffled(spark)
        found = search.search(search.build(rows), rows.where("id % 20 = 0"), k=3, others=True)
        assert found.where("rank = 3").count() >= n // 20
        moved.append((shuffled(spark) - before) / n)
    assert moved[1] < 150 and moved[1] < 1.2 * moved[0]


def test_predictions_move_few_bytes_a_row(spark):
    n = 10_000
    rows = spark.range(n).selectExpr("id", "if(id % 4 = 0, concat('try { op(', id, '); fail(\"x\"); } catch(E e) { }'), concat('int a = f(', id, ');')) as test_prefix", "'exception' as target")
    before = shuffled(spark)
    got = search.predict_by_search(rows.where("id % 20 = 0"), search.build(rows), others=True)
    assert got.where("prediction = 'exception'").count() == n // 20
    assert (shuffled(spark) - before) / n < 250


def test_many_queries_move_few_sets_of_the_index(spark, monkeypatch):
    """The index was moved whole, thrice, where queries were too many to be broadcast."""
    n = 20_000
    rows = spark.range(n).selectExpr("id", "if(id % 4 = 0, concat('try { op(', id, '); fail(\"x\"); } catch(E e) { }'), concat('int a = f(', id, ');')) as test_prefix", "'exception' as target")
    index = search.build(rows)
    monkeypatch.setattr(search, "SMALL", 900)  # queries are 1,000
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        got = search.predict_by_search(rows.where("id % 20 = 0"), index, others=True)
        assert got.where("prediction = 'exception'").count() == n // 20
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert (shuffled(spark) - before) / n < 50


def test_among_keeps_what_keys_ask_for(spark, monkeypatch):
    monkeypatch.setattr(search, "SMALL", 10)
    d = spark.range(20_000).selectExpr("id", "concat('t', id) as token", "array(id) as more")
    keys = d.where("id % 20 = 0").unionByName(d.where("id % 40 = 0")).select("token")
    got = search._among(d, keys, "token")
    assert got.columns == d.columns and got.where("id % 20 = 0").count() == 1_000 and got.count() < 4_000
    assert search._among(d, keys.limit(5), "token").count() <= 5
    monkeypatch.setattr(search, "SIEVE", 0)
    assert search._among(d, keys, "token").where("id % 20 = 0").count() == 1_000


def shuffled(spark):
    """Bytes shuffled by the session so far, once its listeners have caught up."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    time.sleep(1)
    return sc.statusStore().executorSummary("driver").totalShuffleWrite()


def test_predictions_and_edges(spark):
    corpus = spark.createDataFrame([(1, "a b c", "x;"), (2, "a b d", "y;"), (3, None, "z;")], "id int, test_prefix string, target string")
    index = search.build(corpus, depth=2)
    d = spark.createDataFrame([(1, "a b c"), (7, "q"), (8, None), (9, "d b")], "id int, test_prefix string")
    got = search.predict_by_search(d, index)
    assert got.columns == ["id", "test_prefix", "prediction"] and {r["id"]: r["prediction"] for r in got.collect()} == {1: "x;", 7: "", 8: "", 9: "y;"}
    assert {r["id"]: r["prediction"] for r in search.predict_by_search(d.where("id = 1"), index, others=True).collect()} == {1: ""}
    with pytest.raises(ValueError, match="2 rows"):
        search.search(index, d, k=3)
    nothing = search.build(corpus.limit(0))
    assert search.search(nothing, d).count() == 0 and search.search(index, d.limit(0)).count() == 0
