"""Pairing, metrics, bug sets, injection, source scanning, predictors, sources, sinks and streams."""

import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from lodestar import schemas, session
from lodestar.operators import batching, bugsets, commands, evaluate, inject, javasrc, logs, metrics, pairing, predict, report, routing, splitting, tokens
from lodestar.sources import readers, sinks
from lodestar.streaming import files as stream


def test_row_index_is_consecutive(spark):
    d = pairing.with_row_index(spark.range(1000).withColumn("k", 1000 - F.col("id")).repartition(7), "k")
    assert [(r["row_idx"], r["k"]) for r in d.orderBy("k").collect()] == [(i, i + 1) for i in range(1000)]
    assert pairing.with_row_index(spark.range(0), "id").count() == 0


def test_key_join_nulls_and_names(spark):
    a = spark.createDataFrame([(1, "a"), (None, "b")], "id int, v string")
    got = pairing.key_join(a, a, "id").orderBy("v_x")
    assert got.columns == ["id", "v_x", "v_y"] and [tuple(r) for r in got.collect()] == [(1, "a", "a"), (None, "b", "b")]


def test_positional_modes(spark):
    a, b = (pairing.with_row_index(spark.range(n).withColumnRenamed("id", c), c) for n, c in ((3, "a"), (2, "b")))
    assert pairing.positional(a, b).count() == 2
    assert pairing.positional(b, a, "left").count() == 2
    with pytest.raises(Exception, match="differ in length"):
        pairing.positional(a, b, "strict")
    with pytest.raises(Exception, match="too short"):
        pairing.positional(a, b, "left").collect()


def test_report_by_hand(spark):
    d = spark.createDataFrame([(0, 0), (0, 0), (0, 1), (1, 1)], "truth int, prediction int")
    got = {r["label"]: r for r in metrics.classification_report(d, "truth", "prediction").collect()}
    assert got["0"]["precision"] == 1.0 and got["0"]["recall"] == pytest.approx(2 / 3) and got["0"]["f1"] == pytest.approx(0.8)
    assert got["1"]["precision"] == 0.5 and got["1"]["recall"] == 1.0 and got["accuracy"]["f1"] == 0.75
    assert got["macro avg"]["precision"] == 0.75 and got["weighted avg"]["recall"] == pytest.approx(0.75)
    only = metrics.per_class(d.where("truth = 0 and prediction = 0"), "truth", "prediction").collect()
    assert len(only) == 1 and only[0]["f1"] == 1.0


def test_exact_match_empty_and_replay(spark):
    d = spark.createDataFrame([(" a ", "a"), ("b", "c")], "prediction string, target string")
    assert metrics.exact_match_accuracy(d).first()["accuracy"] == 0.5
    assert metrics.exact_match_accuracy(d, initial=1).first()["accuracy"] == 1.0
    assert metrics.exact_match_accuracy(d.limit(0)).first()["accuracy"] is None
    assert metrics.micro(metrics.exact_match_by(d.limit(0).withColumn("g", F.lit(1)), "g")).first()["accuracy"] == 0.0


def test_running_best_and_buckets(spark):
    d = spark.createDataFrame([(0, 0.0), (1, 0.5), (2, 0.5), (3, 0.7)], schemas.ACCURACIES)
    assert [r["saved"] for r in metrics.running_best(d).orderBy("epoch").collect()] == [False, True, False, True]
    s = spark.createDataFrame([(0, i, float(i)) for i in range(7)], schemas.LOSSES)
    assert [(r["step"], r["mean_loss"]) for r in metrics.loss_buckets(s, 3).orderBy("step").collect()] == [(0, 0.0), (3, 2.0), (6, 5.0)]


def test_routes_partition(spark):
    d = spark.createDataFrame([("fail(a); } catch", "x"), ("a", "assertTrue(b);"), ("a", None), ("a", "nan"), (None, "x")], "test_prefix string, assert_pred string")
    assert sorted(r["route"] for r in routing.with_route(d).collect()) == ["assertion", "assertion", "exception", "prefix_only", "prefix_only"]


def test_bug_sets(spark):
    d = spark.createDataFrame([("p", 1, "a", "assertion", True), ("p", 1, "b", "exception", True), ("p", 2, "a", "prefix_only", True), ("p", 3, "b", "assertion", None)], "project string, bug_num int, method string, route string, TP boolean")
    assert tuple(bugsets.summary(d, "a", "b").first()) == (2, 1, 1, 0, 1)
    assert tuple(bugsets.summary(d, "a", "b", bugsets.COMPARED).first()) == (1, 1, 0, 0, 1)
    assert tuple(bugsets.summary(d.limit(0), "a", "b").first()) == (0, 0, 0, 0, 0)


def test_split_sizes(spark):
    d = splitting.split(splitting.shuffled(spark.range(100), "id"))
    assert {r["split"]: r["count"] for r in d.groupBy("split").count().collect()} == {"test": 5, "valid": 5, "train": 90}
    assert [r["id"] for r in splitting.shuffled(spark.range(50), "id").orderBy("row_idx").collect()] == [r["id"] for r in splitting.shuffled(spark.range(50).repartition(3), "id").orderBy("row_idx").collect()]


def test_layouts_and_padding(spark):
    d = spark.createDataFrame([(1, [1, 2], None, [3]), (2, [4], [5], [6, 7, 8])], "id bigint, p array<int>, d array<int>, m array<int>")
    parts = {"P": F.col("p"), "D": F.col("d"), "M": F.col("m"), "G": F.col("m")}
    got = d.select(tokens.train_layout("tc_mut_doc", parts, 9).alias("t"), tokens.serve_layout(F.col("p"), F.col("m"), F.col("d"), 9).alias("s")).collect()
    assert got[0]["t"] == [1, 2, 9, 9, 3] and got[0]["s"] == [1, 2, 9, 3] and got[1]["t"] == got[1]["s"] == [4, 9, 5, 9, 6, 7, 8]
    e = batching.train_example(d.select("id", F.col("p").alias("inputs"), F.col("m").alias("outputs")).withColumn("batch_id", F.lit(0)))
    r = batching.pad_right(e).orderBy("id").collect()
    assert r[0]["input_ids"] == [1, 2, 3, 0] and r[0]["labels"] == [-100, -100, 3, -100] and r[0]["attention_mask"] == [1, 1, 1, 0]
    left = batching.pad_left(batching.decode_example(e.select("id", "inputs", "outputs", "batch_id"))).orderBy("id").collect()
    assert left[1]["input_ids"] == [0, 4] and left[0]["labels"] == [-100, -100, 3]
    assert tokens.separator_id(None, "PolyCoder-2.7B", 7) == 2 and tokens.separator_id(None, "x", 7) == 7 and tokens.separator_id(5, "x", 7) == 5


def test_injection():
    body = "class T {\n@Test\npublic void t1() {\n assertTrue(a); fail(\"x\");\n}\n@Test\npublic void t10() {\n b();\n}\n}"
    one = inject.inject_by_name(body, "t1", "assertEquals($1, \\x)")
    assert "assertEquals($1, \\x);\n}" in one and "assertTrue" not in one and one.count("assertEquals") == 1
    assert inject.inject_by_name(body, "t1", "x;", strict=False).count("x;\n}") == 2
    assert inject.inject_by_name(body, "t1", "exception").count("assertTrue") == 0


def test_inject_fold(spark):
    files = spark.createDataFrame([("a.java", "@Test\npublic void t() {\n}"), ("b.java", "x")], "file_path string, content string")
    preds = spark.createDataFrame([(2, "a.java", "t", "two"), (1, "a.java", "t", "one"), (3, "c.java", "t", "z")], "pred_seq int, file_path string, test_name string, prediction string")
    got = {r["file_path"]: r for r in inject.inject_fold(files, preds).collect()}
    assert got["a.java"]["content"].index("one;") < got["a.java"]["content"].index("two;") and got["a.java"]["n_injected"] == 2 and got["b.java"]["content"] == "x"


def test_injection_keeps_projects_apart(spark):
    """Two projects that share ids, paths and test names; of several meta rows of an id the first counts."""
    files = spark.createDataFrame([(p, "a.java", f"// {p}\n@Test\npublic void t() {{\n}}") for p in "xy"], "project string, file_path string, content string")
    preds = spark.createDataFrame([(p, 1, 1, f"only{p}") for p in "xy"] + [("x", 9, 2, "none")], "project string, id bigint, pred_seq bigint, prediction string")
    meta = spark.createDataFrame([("x", 1, "src/test/java/a.java", "T::t", 0), ("x", 1, "src/test/java/b.java", "T::u", 1), ("y", 1, "src/test/java/a.java", "T::t", 0), ("y", 9, "src/test/java/a.java", "T::t", 1)], "project string, id bigint, file_path string, test_name string, at bigint")
    found = inject.located(preds, meta, order="at")
    shared = inject.located(preds, meta.where("project = 'x'").drop("project"), order="at")  # one meta table for all projects
    assert shared.count() == preds.join(meta.where("project = 'x'").select("id").distinct(), "id", "left_semi").count() > 0
    assert "CartesianProduct" not in (plan := shared._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan
    assert sorted((r["project"], r["file_path"], r["prediction"]) for r in found.collect()) == [("x", "a.java", "onlyx"), ("y", "a.java", "onlyy")]
    got = {r["project"]: r for r in inject.inject_fold(files, found).collect()}
    assert all(f"only{p};" in got[p]["content"] and got[p]["content"].startswith(f"// {p}") and got[p]["content"].count("only") == 1 for p in "xy")


def test_timed_and_resumable_predictions(spark, tmp_path):
    d = spark.createDataFrame([(i, f"p{i % 2}", "int a = 1;", "", "", "assertNotNull(a);") for i in range(20)], "id bigint, project string, test_prefix string, focal_method string, docstring string, target string")
    timed = predict.predict_timed(d, predict.RulePredictor).collect()
    assert all(r["prediction"] == "assertNotNull(a);" and r["seconds"] >= 0 for r in timed)
    _, by, micro = evaluate.evaluate_by_project(d, predict.RulePredictor)
    for r in by.collect():
        assert r["num_samples"] == 10 and r["accuracy"] == 1.0 and abs(r["seconds"] / 10 - r["seconds_per_sample"]) < 1e-12
    assert micro.first()["num_matches"] == 20
    path = str(tmp_path / "kept")
    predict.predict_resumable(d.where("id < 12"), predict.RulePredictor, path).count()
    again = predict.predict_resumable(d, lambda: predict.ConstantPredictor("x"), path, parts=3)
    assert {r["id"]: r["prediction"] for r in again.collect()} == {i: "assertNotNull(a);" if i < 12 else "x" for i in range(20)}


def test_file_tokenizers(spark):
    names = pytest.importorskip("public_tokenizers")
    texts = ["int a = 1;", "", None, "assertEquals(é, \"x\");"]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for t in (tokens.FileTokenizer(names.path("byte_bpe_50k.json")), tokens.FileTokenizer(names.path("piece_bpe_32k.model")), tokens.FileTokenizer(names.path("byte_bpe_50k.tiktoken"), names.PATTERN)):
        rows = tokens.decode(tokens.encode(d, "t", "ids", t, normalise=True), "ids", "back", t).collect()
        assert {r["id"]: r["back"] for r in rows} == {i: x or "" for i, x in enumerate(texts)}
        assert all((len(r["ids"]) > 0) == bool(r["t"]) for r in rows)
        assert {r["id"]: list(r["ids"]) for r in rows}[0] == t.encode(texts[0])


def test_phases(spark, tmp_path):
    """A project that does not compile ends there; the others are tested and mutated."""
    for p in ("good", "bad"):
        (tmp_path / p).mkdir()
    (tmp_path / "good" / "ok").write_text("")
    targets = spark.createDataFrame([(p, "llm", str(tmp_path / p)) for p in ("good", "bad")], "project string, version string, folder string")
    plan = {"compile": "test -f ok", "test": "echo Tests run: 5, Failures: 1, Errors: 0, Skipped: 0", "mutation": "echo Line Coverage: 80.5% Killed 3 {project}"}
    with pytest.raises(PermissionError):
        commands.run_phases(targets, plan)
    log = commands.run_phases(targets, plan, allow=True)
    assert sorted((r["project"], r["phase"]) for r in log.collect()) == [("bad", "compile"), ("good", "compile"), ("good", "mutation"), ("good", "test")]
    got = {r["project"]: r for r in logs.phase_table(log).collect()}
    assert (got["good"]["compiled"], got["good"]["tests"], got["good"]["line_coverage"], got["good"]["mutations_killed"], got["good"]["test_strength"]) == (True, 5, 80.5, 3.0, None)
    assert got["bad"]["compiled"] is False and got["bad"]["tests"] is None and got["bad"]["line_coverage"] is None
    assert logs.version_rollup(logs.phase_table(log), 2).first()["passed"] == 4


def test_arrays_templates_and_files(spark, tmp_path):
    d = spark.createDataFrame([(i, {"a": "é"} if i % 2 else None, [1, i]) for i in range(25)], "id int, m map<string, string>, l array<int>").repartition(7)
    path = tmp_path / "x" / "rows.json"
    sinks.save_json_array(d, str(path), "id")
    assert path.read_text() == json.dumps([{"id": i, "m": {"a": "é"} if i % 2 else None, "l": [1, i]} for i in range(25)], indent=2, ensure_ascii=False)
    sinks.save_json_array(d.limit(0), str(path), "id")
    assert path.read_text() == "[]" and [p.name for p in path.parent.iterdir() if not p.name.endswith(".crc")] == ["rows.json"]
    t = spark.createDataFrame([(2, "p", "1", "T::a", "int a;"), (3, "p", "1", "T::b", "try { a(); fail(\"x\"); } catch (E e) { }"), (1, "p", "1", "T::c", "int b;\nassertTrue(b);")], "id bigint, project string, bug_num string, test_name string, test_prefix string")
    sinks.save_oracle_template(t, str(tmp_path / "t"))
    rows = readers.load_csv(spark, str(tmp_path / "t"), "id bigint, except_pred int, assert_pred string, clean_test_prefix string").collect()
    assert [r["id"] for r in rows] == [3, 1, 2] and all(r["except_pred"] == -1 for r in rows)
    a, b = tmp_path / "A.java", tmp_path / "B.java"
    a.write_text("old"), b.write_text("same")
    new = spark.createDataFrame([(str(a), "new é"), (str(b), "same"), (str(tmp_path / "none"), "x")], "path string, content string")
    assert {r["path"][-6:]: r["changed"] for r in sinks.rewrite_in_place(new).collect()} == {"A.java": True, "B.java": False, "0/none"[-6:]: None}
    assert a.read_text() == "new é" and (tmp_path / "A.java.bak").read_text() == "old" and not (tmp_path / "B.java.bak").exists()
    assert sinks.copy_file(spark, str(a), str(tmp_path / "C.java")) and (tmp_path / "C.java").read_text() == "new é"
    assert not sinks.copy_file(spark, str(tmp_path / "nowhere"), str(tmp_path / "D"))


def test_a_cluster_needs_a_shared_folder():
    """No temporary folder of one machine where executors have other disks."""
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        sc = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
        df = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda *_: None)))
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.cut(df)


def test_top_candidate_without_scores(spark):
    d = spark.createDataFrame([(1, "b", 0.5), (1, "a", 0.5), (1, "c", None), (2, "z", None)], "id int, output string, score double")
    assert sorted(tuple(r) for r in predict.top_candidate(d).collect()) == [(1, "a", 0.5), (2, "z", None)]


def test_java_scanner():
    source = """package a; // { not a brace
import x.Y;
public class Outer<T> extends B {
    private int f = g(1);
    static { init(); }
    Outer(int n) { super("}"); }
    @Override @SuppressWarnings("x") public <K> Map<K, int[]> get(final List<String> a, String... rest) throws E { if (a) { return null; } }
    abstract void none();
    enum Color { RED; String tag() { return "{"; } }
    interface I { int size(); }
}
"""
    got = javasrc.scan(source)
    assert [(r["name"], r["class"], r["return_type"], r["kind"]) for r in got] == [
        ("get", "Outer", "Map", "method"), ("none", "Outer", "void", "method"), ("tag", "Color", "String", "method"), ("size", "I", "int", "method"), ("Outer", "Outer", "Outer", "constructor"),
    ]
    assert got[0]["parameters"] == [{"type": "List", "name": "a"}, {"type": "String", "name": "rest"}]
    assert got[0]["body_raw"].endswith("return null; } }") and javasrc.scan("class A { ") == [] and javasrc.scan("") == []


def test_java_grammar():
    source = """@Deprecated package a.b;
import static x.Y.*;
@interface Mark { int level() default 1; String[] names() default {"{"}; }
/* class Not { void no() {} */
public final class Outer<T extends Comparable<? super T>> extends B<int[]> implements C, D {
    private final Map<String, List<Integer>> f = new HashMap<>() {{ put("}", null); }}, g = null;
    static final Runnable r = new Runnable() {
        @Override
        public void run() { class Local { int deep(int[] a[], final java.util.List<? extends T>... b) { return a.length; } } }
    };
    int[] sizes = {1, 2}, more[] = new int[][] {{1}, {2}};
    { Object o = int.class; go(() -> { new Thread() { public void inner() {} }.start(); }, Outer.Inner::new); }
    public <K, V extends K> @Mark(level = 2)
    Outer(Outer<T> this, K k) throws E { super(); }
    protected Outer.Inner<T>[] make(@Mark(names = {"(", ")"}) final int record, String sealed) { record = record + 1; return null; }
    enum Color implements I { RED(1) { @Override int code() { return 2; } }, GREEN(2),; private Color(int c) { } int code() { return 1; } }
    interface I { default int size() { return 0; } static <T> T of(T t) { return t; } int CONSTANT = f(1); }
    record Point(int x, int y) { Point { if (x < y) throw new E(); } int sum() { return x + y; } }
    sealed interface S permits Q {} non-sealed class Q implements S { Q() { this(1); } }
    String text() { return \"\"\"
        void not() { "quoted" }
        \"\"\" + '{' + "\\\"{"; }
}
"""
    got = [(r["name"], r["class"], r["return_type"], [(p["type"], p["name"]) for p in r["parameters"]]) for r in javasrc.scan(source)]
    assert got == [
        ("run", "Outer", "void", []), ("deep", "Local", "int", [("int", "a"), ("java", "b")]), ("inner", "Outer", "void", []),
        ("make", "Outer", "Outer", [("int", "record"), ("String", "sealed")]), ("code", "Color", "int", []), ("code", "Color", "int", []),
        ("size", "I", "int", []), ("of", "I", "T", [("T", "t")]), ("sum", "Point", "int", []), ("text", "Outer", "String", []),
        ("Outer", "Outer", "Outer", [("K", "k")]), ("Color", "Outer", "Outer", [("int", "c")]), ("Q", "Q", "Q", []),
    ]
    for broken in ("class A { void f() { }", "class A { } }", "class A { void f( { } }", "class A { int = 3; }", "class A { void f() { ) } }", "void f() { }"):
        assert javasrc.scan(broken) == [], broken
    assert [r["name"] for r in javasrc.scan("class A {" + "{" * 200 + "}" * 200 + " void f() {} }")] == ["f"]


def test_java_tables(spark):
    d = spark.createDataFrame([("p", "a/B.java", "class B {\n  int f() { return 1; }\n  int f(int x) { return x; }\n}"), ("p", "x.java", None)], "project string, relative_path string, source string")
    m = javasrc.java_methods(d)
    assert sorted(r["content"] for r in m.collect()) == ["  int f() { return 1; }", "  int f(int x) { return x; }"]
    assert {r["content"] for r in javasrc.java_methods(d, slice_mode="legacy").collect()} == {"  int f() { return 1;", "  int f(int x) { return x;"}
    assert javasrc.java_types(m).first()["methods"] == ["f", "f"]


def test_logs(spark):
    texts = ["", "Tests run: 1, Failures: 0, Errors: 0, Skipped: 0\nTests run: 12, Failures: 1, Errors: 2, Skipped: 3", "Line Coverage: 71.5%\nKilled 3 Killed 4"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [tuple(r) for r in d.select(*[c.alias(n) for n, c in logs.test_summary(F.col("t")).items()]).collect()] == [(0, 0, 0, 0), (12, 1, 2, 3), (0, 0, 0, 0)]
    r = d.select(*[c.alias(n) for n, c in logs.mutation_report(F.col("t")).items()]).collect()[2]
    assert r["line_coverage"] == 71.5 and r["mutations_killed"] == 3.0 and r["test_strength"] is None
    c = spark.createDataFrame([("p", "v", "compile", 0, "", "", True), ("p", "v", "test", 0, texts[1], "", True), ("q", "v", "compile", 1, "", "", False)], schemas.COMMANDS)
    v = logs.version_rollup(logs.phase_table(c), 4).first()
    assert (v["compiled"], v["tests"], v["passed"], v["pass_rate"], v["compile_rate"]) == (1, 12, 9, 0.75, 0.25)


def test_predictors_and_evaluation(spark):
    inputs = spark.createDataFrame([(1, "try { a", None, None), (2, "int a = 1;", None, None)], schemas.INPUTS)
    meta = spark.createDataFrame([(1, None, -1), (2, " assertNotNull(a); ", 0)], schemas.META)
    preds, score = evaluate.evaluate_paired(inputs, meta, predict.RulePredictor)
    assert score.first()["accuracy"] == 1.0 and preds.columns == ["id", "test_prefix", "prediction", "target", "exact_match"]

    class Bad:
        def generate(self, *a):
            raise ValueError

    assert {r["prediction"] for r in predict.predict_column(inputs, Bad).collect()} == {""}
    assert {r["prediction"] for r in predict.predict_column(inputs, lambda: predict.ConstantPredictor("x")).collect()} == {"x"}


def test_bug_evaluation_needs_flags(spark):
    d = spark.createDataFrame([(0, "p", 1, "t", "try {", 1, 0, None, None)], "id bigint, project string, bug_num int, test_name string, test_prefix string, exception_bug int, assertion_bug int, focal_method string, docstring string")
    r = evaluate.evaluate_bugs(d, predict.RulePredictor).first()
    assert r["oracle_type"] == 1 and r["ground_truth_type"] == 1
    with pytest.raises(Exception, match="bug flag"):
        evaluate.evaluate_bugs(d.withColumn("exception_bug", F.lit(None).cast("int")), predict.RulePredictor).collect()


def test_csv_round_trip(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,test_prefix, docstring\n1,"a ""q""\nb, \\x\\",NA\n2.0,,"x"\n', encoding="utf-8")
    d = readers.load_csv(spark, str(tmp_path / "a.csv"), schemas.INPUTS)
    assert [tuple(r) for r in d.collect()] == [(1, 'a "q"\nb, \\x\\', None, None), (2, None, None, "x")]
    sinks.save_csv(d, str(tmp_path / "out"))
    assert sorted(map(tuple, readers.load_csv(spark, str(tmp_path / "out"), schemas.INPUTS).collect())) == sorted(map(tuple, d.collect()))
    assert readers.load_existing(spark, {"a": str(tmp_path / "a.csv"), "b": str(tmp_path / "none.csv")}, schemas.INPUTS).count() == 2
    with pytest.raises(FileNotFoundError):
        readers.load_existing(spark, {"b": str(tmp_path / "none.csv")}, schemas.INPUTS, required=True)


def test_json_java_logs_tokens(spark, tmp_path):
    for p in ("one", "two"):
        (tmp_path / "pred" / p).mkdir(parents=True)
        (tmp_path / "pred" / p / "predictions.json").write_text(json.dumps([{"id": 1, "prediction": "x", "target": "é"}]), encoding="utf-8")
    assert {(r["project"], r["target"]) for r in readers.load_project_predictions(spark, str(tmp_path / "pred")).collect()} == {("one", "é"), ("two", "é")}
    (tmp_path / "src" / "p" / "a").mkdir(parents=True)
    (tmp_path / "src" / "p" / "a" / "B.java").write_bytes(b"class B {\r\n}")
    (tmp_path / "src" / "p" / "C.java").write_bytes(b"\xff\xfe")
    assert [tuple(r) for r in readers.load_java(spark, str(tmp_path / "src")).collect()] == [("p", "a/B.java", "class B {\n}")]
    (tmp_path / "log.txt").write_text("a\nb")
    assert readers.load_logs(spark, str(tmp_path / "log.txt")).first()["stdout"] == "a\nb"
    t = spark.createDataFrame([("tc_mut", "test", 1, [1], [2], [1])], schemas.TOKENS)
    sinks.save_tokens(t, str(tmp_path / "tok"))
    assert readers.load_tokens(spark, str(tmp_path / "tok"), "tc_mut", "test").count() == 1 and readers.load_tokens(spark, str(tmp_path / "tok"), "tc_doc").count() == 0
    sinks.save_json_array(t.select("id"), str(tmp_path / "x" / "y.json"))
    assert json.loads((tmp_path / "x" / "y.json").read_text()) == [{"id": 1}]
    sinks.append_metrics(t.select("id"), str(tmp_path / "m"))
    sinks.append_metrics(t.select("id"), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 2


def test_constants_and_report(spark):
    assert readers.projects(spark).count() == 25 and readers.projects(spark, 3).count() == 3 and readers.models(spark).count() == 7
    lines = report.metric_lines(spark.sql("select 0.5d as accuracy, 3 as n").first())
    assert any(x.endswith("0.5000") for x in lines) and any(x.endswith(" 3") for x in lines)


def test_stream(spark, tmp_path):
    (tmp_path / "in" / "p").mkdir(parents=True)
    (tmp_path / "in" / "p" / "1.json").write_text('{"id": 1, "prediction": " a", "target": "a"}\n{"id": 2, "prediction": "b", "target": "c"}\n')
    q = stream.write_running(stream.running_accuracy(stream.read_predictions(spark, str(tmp_path / "in"))), "running", str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert [tuple(r) for r in spark.table("running").collect()] == [("p", 2, 1)]
