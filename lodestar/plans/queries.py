"""Registry of queries over the synthetic tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions import targets as T
from ..functions import text as X
from ..operators import batching as B
from ..operators import bugsets as U
from ..operators import evaluate as E
from ..operators import generate as N
from ..operators import inject as I
from ..operators import javasrc as J
from ..operators import logs as G
from ..operators import metrics as M
from ..operators import pairing as P
from ..operators import predict as D
from ..operators import routing as R
from ..operators import search as H
from ..operators import splitting as S
from ..operators import tokens as K
from .views import duck, table, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SEP, EOS = 2, 3
#: The length that training inputs are held to.
LIMIT = 512

#: What several oracles need in DuckDB's dialect.
WS = "concat(chr(9), chr(10), chr(11), chr(12), chr(13), ' ')"
EXCEPTION = "regexp_matches(test_prefix, '(?s)fail\\(.*\\).*}\\s*catch')"
KEPT_LINES = f"list_filter(string_split({{}}, chr(10)), lambda x: length(trim(x, {WS})) > 0)"
STRIPPED_BLOCK = "regexp_replace(regexp_replace(regexp_replace({}, 'try\\s*\\{{', '', 'g'), 'fail\\s*\\([^)]*\\);', '', 'g'), '(?s)\\}}\\s*catch\\s*\\([^)]*\\)\\s*\\{{.*?\\}}', '', 'g')"


def strip_sql(c: str) -> str:
    return f"trim({c}, {WS})"


def no_blank_sql(c: str) -> str:
    return f"array_to_string({KEPT_LINES.format(strip_sql(c))}, chr(10))"


def indent_sql(c: str) -> str:
    kept = KEPT_LINES.format(strip_sql(c))
    return (
        f"case when len({kept}) > 0 then array_to_string(list_concat([trim(({kept})[1], {WS})], list_transform(({kept})[2:len({kept}) - 1], lambda x: concat(chr(9), ltrim(x, {WS}))),"
        f" [trim(({kept})[-1], {WS})]), chr(10)) end"
    )


def query(oracle: str | None = None, *views: str) -> Callable[[Query], Query]:
    """Register a query under its function's name; views are the base views that its SQL reads."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            sql = oracle.strip()
            ctes = ", ".join(duck(v) for v in views)
            if ctes:
                sql = f"with {ctes}, {sql[5:]}" if sql.startswith("with ") else f"with {ctes} {sql}"
            ORACLES[f.__name__] = sql
        return f

    return register


HIT = f"case when {strip_sql('prediction')} = {strip_sql('target')} then 1 else 0 end"

# --- exact match -----------------------------------------------------------------------------------------------------


@query(f"select project, count(*) as num_samples, cast(sum({HIT}) as bigint) as num_matches, sum({HIT})::double / count(*)::double as accuracy from cases join p using (id) group by project".replace("from cases", "from (select id, project, target from cases)").replace("join p", "join (select id, prediction from preds)"), "cases", "preds")
def exact_match_by_project(spark, sf_dir):
    cases = view(spark, sf_dir, "cases").select("id", "project", "target")
    return M.exact_match_by(P.key_join(cases, view(spark, sf_dir, "preds").select("id", "prediction"), "id"), "project")


@query(f"select count(*) as num_samples, cast(sum({HIT}) as bigint) as num_matches, sum({HIT})::double / count(*)::double as accuracy from preds", "preds")
def exact_match_micro(spark, sf_dir):
    return M.micro(M.exact_match_by(view(spark, sf_dir, "preds"), "project"))


@query(f"select count(distinct id) as matched_ids from preds where {strip_sql('prediction')} = {strip_sql('target')}", "preds")
def distinct_match_ids(spark, sf_dir):
    return M.distinct_matches(view(spark, sf_dir, "preds"))


@query(f"select *, seconds / num_samples as seconds_per_sample from (select project, count(*) as num_samples, cast(sum({HIT}) as bigint) as num_matches, sum({HIT})::double / count(*)::double as accuracy, sum(id % 8 / 4.0::double) as seconds from preds group by project) t", "preds")
def exact_match_seconds_by_project(spark, sf_dir):
    d = view(spark, sf_dir, "preds").withColumn("seconds", F.col("id") % 8 / F.lit(4.0))
    return M.exact_match_by(d, "project", seconds="seconds")


# --- joins and pairing -----------------------------------------------------------------------------------------------


@query("select d.doc_id, lang, source, quality, toxic from documents d join labels l on d.doc_id = l.doc_id")
def inner_join_documents_labels(spark, sf_dir):
    return P.key_join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), table(spark, sf_dir, "labels"), "doc_id")


def _docs_and_labels(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "label_id")


NUMBERED = "with d as (select row_number() over (order by doc_id) - 1 as row_idx, doc_id, lang, n_chars from documents), l as (select row_number() over (order by doc_id) - 1 as row_idx, doc_id as label_id, quality, toxic from labels) "


@query(NUMBERED + "select * from d join l using (row_idx)")
def positional_pair_truncating(spark, sf_dir):
    docs, labels = _docs_and_labels(spark, sf_dir)
    return P.zip_sorted(docs, ["doc_id"], labels, ["label_id"], "truncate")


@query(NUMBERED + "select * from d join l using (row_idx) where row_idx < 100")
def positional_pair_min(spark, sf_dir):
    docs, labels = _docs_and_labels(spark, sf_dir)
    return P.head(P.zip_sorted(docs, ["doc_id"], labels, ["label_id"], "min"), 100)


@query(NUMBERED + ", e as (select row_idx, n_chars + 1 as next_chars from d) select * from d join e using (row_idx)")
def positional_pair_strict(spark, sf_dir):
    docs, _ = _docs_and_labels(spark, sf_dir)
    other = docs.select(F.col("doc_id").alias("_id"), (F.col("n_chars") + 1).alias("next_chars"))
    return P.zip_sorted(docs, ["doc_id"], other, ["_id"], "strict").drop("_id")


@query(NUMBERED + "select l.row_idx, label_id, quality, toxic, doc_id, lang, n_chars from l left join d using (row_idx)")
def positional_pair_left_driven(spark, sf_dir):
    docs, labels = _docs_and_labels(spark, sf_dir)
    return P.zip_sorted(labels, ["label_id"], docs, ["doc_id"], "left")


@query("select c_custkey as user_id, c_mktsegment, event_id, event_type from customer join (select *, row_number() over (partition by user_id order by event_id) as n from events) e on c_custkey = user_id and n = 1")
def first_match_lookup(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return P.first_match(customers, table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("select doc_id, lang, n_chars from documents where doc_id in (select doc_id from labels)")
def semi_join_existing(spark, sf_dir):
    return P.existing(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), table(spark, sf_dir, "labels"), "doc_id")


@query("select doc_id, lang, n_chars from documents where doc_id not in (select doc_id from labels)")
def anti_join_missing(spark, sf_dir):
    return P.missing(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), table(spark, sf_dir, "labels"), "doc_id")


@query("select version, n_name as project from (values ('evosuite'), ('llm'), ('no_oracle')) v(version), nation")
def cross_dimension_version_project(spark, sf_dir):
    versions = spark.createDataFrame([(v,) for v in G.VERSIONS], "version string")
    return P.dimensions(versions, table(spark, sf_dir, "nation").select(F.col("n_name").alias("project")))


@query("with a as (select doc_id, string_split(text, ' ') as w, list_transform(string_split(text, chr(10)), lambda x: length(x)) as n from documents) select doc_id, unnest(w[1:least(len(w), len(n))]) as w, cast(unnest(n[1:least(len(w), len(n))]) as integer) as n from a")
def zip_parallel_arrays(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("w"), F.transform(X.lines(F.col("text")), F.length).alias("n"))
    return P.zip_arrays(d, "w", "n")


# --- projections, nulls, targets -------------------------------------------------------------------------------------


@query("select doc_id, case when text is null or contains(text, 'nan') then '' else text end as text from documents")
def nan_substring_blank(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.null_to_blank(F.col("text")).alias("text"))


@query("select id, coalesce(docstring, '') as docstring, coalesce(focal_method, '') as focal_method from cases", "cases")
def strict_null_blank(spark, sf_dir):
    d = view(spark, sf_dir, "cases")
    return d.select("id", *[T.null_to_blank(F.col(c), "strict").alias(c) for c in ("docstring", "focal_method")])


@query("select id, string_split(focal_method, chr(10))[1] as signature from cases", "cases")
def signature_first_line(spark, sf_dir):
    return view(spark, sf_dir, "cases").select("id", X.first_line(F.col("focal_method")).alias("signature"))


@query(f"select id, {strip_sql(chr(39) + 'exception' + chr(39))} as target from cases where flag = -1 union all select id, {strip_sql('coalesce(gt_assert, ' + chr(39) * 2 + ')')} as target from cases where flag is distinct from -1", "cases")
def target_from_flag(spark, sf_dir):
    return view(spark, sf_dir, "cases").select("id", T.target_from_flag(F.col("gt_assert"), F.col("flag")).alias("target"))


@query("select id, case when flag = -1 or flag is null then 'exception' else case when gt_assert is null or contains(gt_assert, 'nan') then '' else gt_assert end end as target from cases", "cases")
def target_from_label(spark, sf_dir):
    return view(spark, sf_dir, "cases").select("id", T.target_from_label(F.col("flag") == -1, F.col("gt_assert")).alias("target"))


@query(f"select id, project, target from cases where length({strip_sql('target')}) > 0", "cases")
def drop_empty_target(spark, sf_dir):
    return view(spark, sf_dir, "cases").where(F.length(X.strip(F.col("target"))) > 0).select("id", "project", "target")


@query("select doc_id, concat(substring(text, 1, 100), '...') as preview from documents")
def truncate_preview(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.preview(F.col("text")).alias("preview"))


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where l_returnflag = 'R' and l_quantity > 30")
def filter_eq_mask(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity > 30").select("l_orderkey", "l_linenumber", "l_quantity")


@query("select distinct l_returnflag, l_linestatus from lineitem")
def select_columns(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("select id, case when flag = -1 then 1 else 0 end as type_code, prediction, case when lower(" + strip_sql("prediction") + ") = 'exception' then 1 else 0 end as oracle_type from cases join (select id, prediction from preds) using (id)", "cases", "preds")
def type_codes(spark, sf_dir):
    d = P.key_join(view(spark, sf_dir, "cases").select("id", "flag"), view(spark, sf_dir, "preds").select("id", "prediction"), "id")
    return d.select("id", F.when(F.col("flag") == -1, 1).otherwise(0).alias("type_code"), "prediction", T.oracle_type(F.col("prediction")).alias("oracle_type"))


# --- cleaning --------------------------------------------------------------------------------------------------------


def _clean(spark, sf_dir, f, out="cleaned"):
    return view(spark, sf_dir, "cases").select("id", f(F.col("test_prefix")).alias(out))


@query(f"select id, array_to_string(list_filter(string_split(test_prefix, chr(10)), lambda x: not regexp_matches(x, '^.*//\\s*Undeclared exception!.*$') and length(trim(x, {WS})) > 0), chr(10)) as cleaned from cases", "cases")
def line_filter_undeclared(spark, sf_dir):
    return _clean(spark, sf_dir, C.drop_undeclared)


@query("select id, " + STRIPPED_BLOCK.format("test_prefix") + " as cleaned from cases", "cases")
def strip_exception_block(spark, sf_dir):
    return _clean(spark, sf_dir, C.strip_exception_block)


@query(f"select id, {indent_sql('test_prefix')} as cleaned from cases", "cases")
def clean_data_layout(spark, sf_dir):
    return _clean(spark, sf_dir, C.indent_body)


@query(f"select doc_id, {no_blank_sql('text')} as text from documents")
def remove_blank_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.remove_blank_lines(F.col("text")).alias("text"))


@query("select id, list_extract(regexp_extract_all(test_prefix, 'assert\\w*\\(.*\\);'), 1) as oracle from cases", "cases")
def extract_assertion(spark, sf_dir):
    return _clean(spark, sf_dir, C.first_assertion, "oracle")


@query("select id, " + no_blank_sql("regexp_replace(test_prefix, 'assert\\w*\\(.*\\);', '', 'g')") + " as cleaned from cases", "cases")
def remove_assertion(spark, sf_dir):
    return _clean(spark, sf_dir, C.remove_assertions)


WORDS = "contains(test_prefix, 'try') and contains(test_prefix, 'catch')"


@query(
    f"select id, case when {WORDS} then {indent_sql(STRIPPED_BLOCK.format('test_prefix'))} when contains(test_prefix, 'assert') then "
    + no_blank_sql("regexp_replace(test_prefix, 'assert\\w*\\(.*\\);', '', 'g')")
    + f" else test_prefix end as cleaned, case when {WORDS} then 'exception' when contains(test_prefix, 'assert') then coalesce(list_extract(regexp_extract_all(test_prefix, 'assert\\w*\\(.*\\);'), 1), '') else '' end as oracle from cases",
    "cases",
)
def prepare_dispatch(spark, sf_dir):
    c = F.col("test_prefix")
    return view(spark, sf_dir, "cases").select("id", C.prepared_prefix(c).alias("cleaned"), C.prepared_oracle(c).alias("oracle"))


@query("select id, array_to_string(" + KEPT_LINES.format("regexp_replace(" + STRIPPED_BLOCK.format("test_prefix") + ", '(?s)assert\\w*\\(.*?\\);', '', 'g')") + ", chr(10)) as cleaned from cases", "cases")
def clean_prefix_lazy(spark, sf_dir):
    return _clean(spark, sf_dir, C.clean_prefix)


@query(f"select id, cast({EXCEPTION} as integer) as is_exception from cases", "cases")
def is_exception_oracle(spark, sf_dir):
    return _clean(spark, sf_dir, lambda c: C.is_exception_oracle(c).cast("int"), "is_exception")


@query("select id, case when prediction = 'exception' then 1 else 0 end as except_pred, case when prediction = 'exception' or not suffix(prediction, ';') then '' else prediction end as assert_pred from preds", "preds")
def normalise_prediction(spark, sf_dir):
    c = F.col("prediction")
    return view(spark, sf_dir, "preds").select("id", T.normalised_except(c).alias("except_pred"), T.normalised_assert(c).alias("assert_pred"))


@query("select id, case when contains(cast(except_pred as varchar), '0') then 0 else 1 end as by_int, case when contains(cast(except_pred::double as varchar), '0') then 0 else 1 end as by_double from preds", "preds")
def label_parse_substring(spark, sf_dir):
    c = F.col("except_pred")
    return view(spark, sf_dir, "preds").select("id", T.label_by_substring(c).alias("by_int"), T.label_by_substring(c.cast("double")).alias("by_double"))


# --- injection -------------------------------------------------------------------------------------------------------

TEST_CLASS = "concat('class T {', chr(10), '  public void test', id, '() {', chr(10), '    int a = 1;', chr(10), '  }', chr(10), '  public void test', id, '0() {', chr(10), '  }', chr(10), '}')"


@query(f"select id, concat(left({TEST_CLASS}, strpos({TEST_CLASS}, 'int a = 1;') + 10), '  ', chr(10), '    ', concat('assertEquals(', chr(36), '1, a', id, chr(92), ');'), chr(10), substring({TEST_CLASS}, strpos({TEST_CLASS}, 'int a = 1;') + 13)) as content from cases", "cases")
def inject_oracle_strict(spark, sf_dir):
    d = view(spark, sf_dir, "cases").select("id", F.expr(TEST_CLASS).alias("content"), F.expr(r"concat('assertEquals(', chr(36), '1, a', id, chr(92), ');')").alias("oracle"))
    return d.select("id", I.inject_by_number(F.col("content"), F.col("id"), F.col("oracle")).alias("content"))


def _named_class():
    return F.expr("concat('class T {', chr(10), '@Test', chr(10), '  public void t', id % 7, '() {', chr(10), '    assertTrue(b); fail(\"x\");', chr(10), '  }', chr(10), '}')")


NAMED_HEAD = "concat('class T {', chr(10), '@Test', chr(10), '  public void t', id % 7, '() {', chr(10), '     ', chr(10), '  ')"


@query(f"select id, concat({NAMED_HEAD}, case when prediction is null or prediction in ('', 'exception') then '' else concat(chr(10), prediction, case when suffix(prediction, ';') then '' else ';' end) end, chr(10), '}}', chr(10), '}}') as content from preds", "preds")
def inject_oracle_named(spark, sf_dir):
    d = view(spark, sf_dir, "preds").select("id", "prediction", _named_class().alias("content"), F.expr("concat('t', id % 7)").alias("name"))
    return I.inject_named(d, "content", "name", "prediction").select("id", "content")


TEST_ORACLE = "case when prediction is null or prediction in ('', 'exception') then '' else concat(chr(10), prediction, case when suffix(prediction, ';') then '' else ';' end) end"


@query(
    f"with o as (select project, id, concat('t', id % 7) as name, {TEST_ORACLE} as oracle, max(id) over (partition by project, id % 7) as last from preds), m as (select project, name, count(*) as n,"
    " string_agg(concat(case when id = last then oracle else regexp_replace(oracle, 'assert\\w*\\([^;]*\\);', '', 'g') end, chr(10)), '' order by id) as tail from o group by project, name),"
    " f as (select distinct project, concat('t', i) as name, i from preds, unnest(range(7)) t(i)),"
    " b as (select project, n, i, concat('@Test', chr(10), '  public void ', name, '() {', chr(10), '    ', case when tail is null then concat('assertTrue(b);', chr(10), '  }') else concat(chr(10), '  ', tail, '}') end) as body from f left join m using (project, name))"
    " select cast(null as varchar) as project, concat(project, '.java') as file_path, concat('class T {', chr(10), string_agg(body, chr(10) order by i), chr(10), '}') as content, cast(sum(coalesce(n, 0)) as bigint) as n_injected from b group by b.project",
    "preds",
)
def inject_project_fold(spark, sf_dir):
    preds = view(spark, sf_dir, "preds")
    meta = preds.select("id", F.expr("concat('src/test/java/', project, '.java')").alias("file_path"), F.expr("concat('T::t', id % 7)").alias("test_name"))
    found = I.located(preds.select("id", F.col("id").alias("pred_seq"), "prediction"), meta)
    body = F.expr("concat('class T {', chr(10), array_join(transform(sequence(0, 6), i -> concat('@Test', chr(10), '  public void t', i, '() {', chr(10), '    assertTrue(b);', chr(10), '  }')), chr(10)), chr(10), '}')")
    files = preds.select(F.concat("project", F.lit(".java")).alias("file_path")).distinct().withColumn("content", body)
    return I.inject_fold(files, found)


# --- logs ------------------------------------------------------------------------------------------------------------

RUN = "list_extract(regexp_extract_all(stdout, 'Tests run: \\d+, Failures: \\d+, Errors: \\d+, Skipped: \\d+'), -1)"
RUN_FIELDS = ", ".join(f"coalesce(try_cast(nullif(regexp_extract({RUN}, '{G.TEST_LINE}', {k + 1}), '') as integer), 0) as {f}" for k, f in enumerate(G.TEST_FIELDS))


@query(f"select id, {RUN_FIELDS} from logs", "logs")
def parse_test_summary_last(spark, sf_dir):
    return view(spark, sf_dir, "logs").select("id", *[c.alias(n) for n, c in G.test_summary(F.col("stdout")).items()])


@query("select id, " + ", ".join(f"try_cast(nullif(regexp_extract(stdout, '{p}', 1), '') as double) as {f}" for f, p in G.MUTATION_FIELDS.items()) + " from logs", "logs")
def parse_mutation_report(spark, sf_dir):
    return view(spark, sf_dir, "logs").select("id", *[c.alias(n) for n, c in G.mutation_report(F.col("stdout")).items()])


def _phases(spark, sf_dir):
    return view(spark, sf_dir, "logs").select("version", "project", "compiled", *[F.when(F.col("compiled"), c).alias(n) for n, c in G.test_summary(F.col("stdout")).items()])


@query(
    f"with p as (select version, compiled, {RUN_FIELDS} from logs), s as (select version, cast(sum(case when compiled then 1 else 0 end) as bigint) as compiled, "
    + ", ".join(f"cast(coalesce(sum(case when compiled then {f} end), 0) as bigint) as {f}" for f in G.TEST_FIELDS)
    + " from p group by version) select *, tests - failures - errors as passed, coalesce((tests - failures - errors)::double / nullif(tests, 0)::double, 0.0) as pass_rate, compiled::double / 20000::double as compile_rate from s",
    "logs",
)
def version_rollup(spark, sf_dir):
    return G.version_rollup(_phases(spark, sf_dir), 20000)


@query(f"with p as (select id, {RUN_FIELDS} from logs) select id, tests - failures - errors as passed, case when tests > 0 then (tests - failures - errors)::double / tests::double else 0.0 end as pass_rate from p", "logs")
def pass_rate(spark, sf_dir):
    t = G.test_summary(F.col("stdout"))
    d = view(spark, sf_dir, "logs").select("id", *[c.alias(n) for n, c in t.items()])
    n = G.passed(F.col("tests"), F.col("failures"), F.col("errors"))
    return d.select("id", n.alias("passed"), M.ratio(n, F.col("tests")).alias("pass_rate"))


@query("select id, case version when 'evosuite' then 'src' when 'llm' then 'llm_oracle' when 'no_oracle' then 'no_oracle' end as test_dir, case version when 'evosuite' then 'target' when 'llm' then 'llm_oracle/target' when 'no_oracle' then 'no_oracle/target' end as target_dir from logs", "logs")
def version_directories(spark, sf_dir):
    return view(spark, sf_dir, "logs").select("id", G.version_folders(F.col("version")).alias("v")).select("id", "v.test_dir", "v.target_dir")


# --- token layouts and batches ---------------------------------------------------------------------------------------


def _parts():
    return {"P": F.col("p"), "D": F.col("d"), "M": F.col("m"), "G": F.col("g")}


def _joined(c, name="ids"):
    return F.array_join(c, ",").alias(name)


def _layout(name: str) -> None:
    parts = K.LAYOUTS[name].lower()
    sql = f"list_concat({parts[0]}, [{SEP}])" if len(parts) == 1 else parts[0]
    for p in parts[1:]:
        sql = f"list_concat({sql}, [{SEP}], {p})"

    def run(spark, sf_dir):
        d = view(spark, sf_dir, "toks")
        return d.select("id", _joined(K.train_layout(name, _parts(), SEP)), _joined(K.target(F.col("o"), EOS), "outputs"))

    run.__name__ = f"layout_{name}"
    query(f"select id, array_to_string({sql}, ',') as ids, array_to_string(list_concat(o, [{EOS}]), ',') as outputs from toks", "toks")(run)


for _name in K.LAYOUTS:
    _layout(_name)


@query(f"select id, array_to_string(list_concat(p, case when len(d) > 0 then list_concat([{SEP}], d) else [] end, [{SEP}], m), ',') as ids from toks", "toks")
def serve_layout(spark, sf_dir):
    return view(spark, sf_dir, "toks").select("id", _joined(K.serve_layout(F.col("p"), F.col("m"), F.col("d"), SEP)))


def _examples(spark, sf_dir, limit=LIMIT):
    d = view(spark, sf_dir, "toks").select("id", K.train_layout("tc_mut", _parts(), SEP).alias("inputs"), K.target(F.col("o"), EOS).alias("outputs"))
    return B.length_filter(d, limit).withColumn("outputs", B.truncated_outputs(F.col("inputs"), F.col("outputs"), limit))


INPUTS = f"list_concat(p, [{SEP}], m)"
EXAMPLES = f"e as (select id, {INPUTS} as i, list_concat(o, [{EOS}])[1:greatest(0, {LIMIT} - len({INPUTS}))] as t from toks where len({INPUTS}) <= {LIMIT})"


@query(f"with {EXAMPLES} select id, cast(len(i) as integer) as n from e", "toks")
def length_filter(spark, sf_dir):
    return _examples(spark, sf_dir).select("id", F.size("inputs").alias("n"))


@query(f"with {EXAMPLES} select id, array_to_string(t, ',') as outputs from e", "toks")
def truncate_outputs(spark, sf_dir):
    return _examples(spark, sf_dir).select("id", _joined("outputs", "outputs"))


@query(f"select id, array_to_string(case when len({INPUTS}) > {LIMIT // 2} then list_concat(p, [{SEP}]) else {INPUTS} end, ',') as ids from toks", "toks")
def prefix_only_fallback(spark, sf_dir):
    d = view(spark, sf_dir, "toks")
    whole = K.train_layout("tc_mut", _parts(), SEP)
    return d.select("id", _joined(B.prefix_fallback(whole, K.fallback_prefix(F.col("p"), "tc_mut", SEP), LIMIT // 2)))


@query(f"with {EXAMPLES} select id, array_to_string(list_concat(i, t), ',') as ids, array_to_string(list_concat(list_transform(range(len(i)), lambda x: -100), t), ',') as labels, cast(len(i) + len(t) as integer) as attention, array_to_string(i, ',') as prompt, array_to_string(t, ',') as target from e", "toks")
def train_labels_mask(spark, sf_dir):
    d = B.train_example(_examples(spark, sf_dir))
    return d.select("id", _joined("input_ids"), _joined("labels", "labels"), F.size("attention_mask").alias("attention"), _joined(B.prompt_of(F.col("input_ids"), F.col("labels")), "prompt"), _joined(B.target_of(F.col("labels")), "target"))


@query(f"with {EXAMPLES} select id, array_to_string(i, ',') as ids, array_to_string(t, ',') as labels, cast(len(i) as integer) as attention, array_to_string(t, ',') as generated from e", "toks")
def decode_example(spark, sf_dir):
    d = B.decode_example(_examples(spark, sf_dir))
    return d.select("id", _joined("input_ids"), _joined("labels", "labels"), F.size("attention_mask").alias("attention"), _joined(B.generated(F.concat("inputs", "outputs"), F.size("inputs")), "generated"))


NUMBERED_EXAMPLES = EXAMPLES + ", n as (select *, (row_number() over (order by id) - 1) // 8 as batch_id from e)"


def _batched(spark, sf_dir):
    return B.batched(_examples(spark, sf_dir), 8, "id")


@query(
    f"with {NUMBERED_EXAMPLES}, m as (select *, max(len(i) + len(t)) over (partition by batch_id) as m from n) select id, cast(batch_id as bigint) as batch_id, array_to_string(list_concat(i, t, list_transform(range(m - len(i) - len(t)), lambda x: 0)), ',') as ids,"
    " array_to_string(list_concat(list_transform(range(len(i)), lambda x: -100), t, list_transform(range(m - len(i) - len(t)), lambda x: -100)), ',') as labels, array_to_string(list_concat(list_transform(range(len(i) + len(t)), lambda x: 1), list_transform(range(m - len(i) - len(t)), lambda x: 0)), ',') as mask from m",
    "toks",
)
def pad_right_batch(spark, sf_dir):
    d = B.pad_right(B.train_example(_batched(spark, sf_dir)))
    return d.select("id", "batch_id", _joined("input_ids"), _joined("labels", "labels"), _joined("attention_mask", "mask"))


@query(
    f"with {NUMBERED_EXAMPLES}, m as (select *, max(len(i)) over (partition by batch_id) as m, max(len(t)) over (partition by batch_id) as l from n) select id, cast(batch_id as bigint) as batch_id, array_to_string(list_concat(list_transform(range(m - len(i)), lambda x: 0), i), ',') as ids,"
    " array_to_string(list_concat(list_transform(range(l - len(t)), lambda x: -100), t), ',') as labels, array_to_string(list_concat(list_transform(range(m - len(i)), lambda x: 0), list_transform(range(len(i)), lambda x: 1)), ',') as mask from m",
    "toks",
)
def pad_left_batch(spark, sf_dir):
    d = B.pad_left(B.decode_example(_batched(spark, sf_dir)))
    return d.select("id", "batch_id", _joined("input_ids"), _joined("labels", "labels"), _joined("attention_mask", "mask"))


@query("select id, cast(length(test_prefix) as integer) as n, true as same from cases", "cases")
def tokenizer_round_trip(spark, sf_dir):
    t = K.CodePointTokenizer()
    d = K.encode(view(spark, sf_dir, "cases").select("id", "test_prefix"), "test_prefix", "ids", t, normalise=True)
    return K.decode(d, "ids", "text", t).select("id", F.size("ids").alias("n"), (F.col("text") == F.col("test_prefix")).alias("same"))


# --- order, splits, samples ------------------------------------------------------------------------------------------


@query("with n as (select doc_id, row_number() over (order by doc_id) - 1 as row_idx, cast(floor(count(*) over () * 0.05::double) as bigint) as k from documents) select doc_id, row_idx, case when row_idx < k then 'test' when row_idx < 2 * k then 'valid' else 'train' end as split from n")
def split_5_5_90(spark, sf_dir):
    return S.split(P.with_row_index(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", total="total"), "total").drop("total")


@query("select d.doc_id, lang, quality from documents d join labels l on d.doc_id = l.doc_id order by d.doc_id limit 50")
def head_after_join(spark, sf_dir):
    d = P.key_join(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return E.first_rows(d, 50)


@query(NUMBERED + "select row_idx, doc_id, quality from d join l using (row_idx) where row_idx < 50")
def head_before_join(spark, sf_dir):
    docs, labels = _docs_and_labels(spark, sf_dir)
    docs, labels = P.with_row_index(docs.select("doc_id"), "doc_id"), P.with_row_index(labels.select("label_id", "quality"), "label_id")
    return P.positional(P.head(docs, 50), P.head(labels, 50), "min").select("row_idx", "doc_id", "quality")


@query("select label as id, vec_id, score from (select label, vec_id, embedding[1]::double as score, row_number() over (partition by label order by embedding[1] desc, vec_id) as n from embeddings) e where n = 1")
def top1_candidate(spark, sf_dir):
    d = table(spark, sf_dir, "embeddings").select(F.col("label").alias("id"), "vec_id", F.get("embedding", F.lit(0)).cast("double").alias("score"))
    return D.top_candidate(d, "id", "score", "vec_id")


@query("select row_number() over (order by doc_id) - 1 as row_idx, 1 as documents from documents")
def seeded_shuffle_permutation(spark, sf_dir):
    """Every number once: a permutation of the documents, whose order itself hangs on Spark's hash."""
    d = S.shuffled(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    return d.groupBy("row_idx").agg(F.count_distinct("doc_id").cast("int").alias("documents"))


# --- classification metrics ------------------------------------------------------------------------------------------

SIDES = "c as (select k as class, cast(sum(tp) as bigint) as tp, cast(sum(pp) as bigint) as predicted, cast(sum(ap) as bigint) as support from (select truth as k, cast(truth = prediction as integer) as tp, 0 as pp, 1 as ap from labels2 union all select prediction, 0, 1, 0 from labels2) group by k)"
PRF = "r as (select *, case when predicted > 0 then tp::double / predicted::double else 0.0 end as precision, case when support > 0 then tp::double / support::double else 0.0 end as recall, case when predicted + support > 0 then (2 * tp)::double / (predicted + support)::double else 0.0 end as f1 from c)"


@query("select truth, prediction, count(*) as n from labels2 group by truth, prediction", "labels2")
def confusion_counts(spark, sf_dir):
    return M.confusion(view(spark, sf_dir, "labels2"), "truth", "prediction")


@query(f"with {SIDES}, {PRF} select * from r", "labels2")
def prf_per_class(spark, sf_dir):
    return M.per_class(view(spark, sf_dir, "labels2"), "truth", "prediction")


@query(f"with {SIDES}, {PRF} select avg(precision) as precision, avg(recall) as recall, avg(f1) as f1 from r", "labels2")
def prf_macro(spark, sf_dir):
    return M.macro(M.per_class(view(spark, sf_dir, "labels2"), "truth", "prediction"))


@query(
    f"with {SIDES}, {PRF} select cast(class as varchar) as label, precision, recall, f1, support from r"
    " union all select 'accuracy', sum(tp)::double / sum(support)::double, sum(tp)::double / sum(support)::double, sum(tp)::double / sum(support)::double, cast(sum(support) as bigint) from r"
    " union all select 'macro avg', avg(precision), avg(recall), avg(f1), cast(sum(support) as bigint) from r"
    " union all select 'weighted avg', sum(precision * support)::double / sum(support)::double, sum(recall * support)::double / sum(support)::double, sum(f1 * support)::double / sum(support)::double, cast(sum(support) as bigint) from r",
    "labels2",
)
def classification_report(spark, sf_dir):
    return M.classification_report(view(spark, sf_dir, "labels2"), "truth", "prediction")


@query("select epoch, max(step) as step, sum(loss::decimal(18,8))::double / count(*) as mean_loss from (select *, cast(ceil(step / 200.0) as integer) as b from steps) group by epoch, b having max(step) = b * 200", "steps")
def loss_bucket_mean(spark, sf_dir):
    return M.loss_buckets(view(spark, sf_dir, "steps"))


@query("with a as (select epoch, sum(case when loss > 0.5 then 1 else 0 end)::double / count(*)::double as accuracy from steps group by epoch), b as (select *, coalesce(max(accuracy) over (order by epoch rows between unbounded preceding and 1 preceding), 0.0) as best_before from a) select *, accuracy > best_before as saved from b", "steps")
def running_best_checkpoint(spark, sf_dir):
    a = view(spark, sf_dir, "steps").groupBy("epoch").agg(M.ratio(F.sum(F.when(F.col("loss") > 0.5, 1).otherwise(0)), F.count("*")).alias("accuracy"))
    return M.running_best(a)


@query("select l_suppkey as class, l_returnflag as relative_path, array_to_string(list(cast(l_orderkey as varchar) order by l_orderkey, l_linenumber), ',') as methods from lineitem group by l_suppkey, l_returnflag")
def collect_methods_by_class(spark, sf_dir):
    meta = F.struct(F.col("l_suppkey").alias("class"), F.col("l_orderkey").cast("string").alias("name"))
    d = table(spark, sf_dir, "lineitem").select(F.lit("p").alias("project"), F.col("l_returnflag").alias("relative_path"), F.struct("l_orderkey", "l_linenumber").alias("seq"), meta.alias("metadata"))
    return J.java_types(d).select("class", "relative_path", F.array_join("methods", ",").alias("methods"))


# --- routes and bug sets ---------------------------------------------------------------------------------------------


@query(f"select id, case when {EXCEPTION} then 'exception' when not (assert_pred is null or contains(assert_pred, 'nan')) then 'assertion' else 'prefix_only' end as route from (select id, test_prefix from cases) join (select id, assert_pred from preds) using (id)", "cases", "preds")
def route_partition(spark, sf_dir):
    d = P.key_join(view(spark, sf_dir, "cases").select("id", "test_prefix"), view(spark, sf_dir, "preds").select("id", "assert_pred"), "id")
    return R.with_route(d).select("id", "route")


@query(
    f"with t as (select id, project, prediction, case when lower({strip_sql('prediction')}) = 'exception' then 1 else 0 end as oracle_type from preds) select 'assertion' as route, count(*) as n, count(distinct project) as projects from t where oracle_type = 0"
    " union all select 'exception', count(*), count(distinct project) from t where oracle_type = 1 union all select 'prefix_only', count(*), count(distinct project) from t",
    "preds",
)
def route_by_prediction(spark, sf_dir):
    d = view(spark, sf_dir, "preds").withColumn("oracle_type", T.oracle_type(F.col("prediction")))
    parts = [r.agg(F.count("*").alias("n"), F.count_distinct("project").alias("projects")).select(F.lit(name).alias("route"), "n", "projects") for name, r in R.by_prediction(d, ("id", "project", "prediction")).items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _bugs(spark, sf_dir, method=None, routes=None):
    d = view(spark, sf_dir, "bugs")
    return U.bug_set(d.where(F.col("method") == method) if method else d, routes)


@query("select distinct project, bug_num from bugs where tp", "bugs")
def bugs_distinct(spark, sf_dir):
    return _bugs(spark, sf_dir)


@query("select distinct project, bug_num from bugs where tp and route in ('assertion', 'exception') union select project, bug_num from bugs where tp and route = 'prefix_only' and method = 'a'", "bugs")
def bugs_union(spark, sf_dir):
    return U.union(_bugs(spark, sf_dir, routes=U.COMPARED), _bugs(spark, sf_dir, "a", ("prefix_only",)))


@query("select project, bug_num from bugs where tp and method = 'a' and route in ('assertion', 'exception') except select project, bug_num from bugs where tp and method = 'b' and route in ('assertion', 'exception')", "bugs")
def bugs_difference(spark, sf_dir):
    return U.difference(_bugs(spark, sf_dir, "a", U.COMPARED), _bugs(spark, sf_dir, "b", U.COMPARED))


@query("select project, bug_num from bugs where tp and method = 'a' intersect select project, bug_num from bugs where tp and method = 'b'", "bugs")
def bugs_intersection(spark, sf_dir):
    return U.intersection(_bugs(spark, sf_dir, "a"), _bugs(spark, sf_dir, "b"))


@query("with s as (select project, bug_num, max(cast(method = 'a' as integer)) as a, max(cast(method = 'b' as integer)) as b from bugs where tp group by project, bug_num) select cast(sum(a) as bigint) as total_a, cast(sum(b) as bigint) as total_b, cast(sum(a * (1 - b)) as bigint) as only_a, cast(sum(b * (1 - a)) as bigint) as only_b, cast(sum(a * b) as bigint) as both from s", "bugs")
def bugs_summary(spark, sf_dir):
    return U.summary(view(spark, sf_dir, "bugs"), "a", "b")


@query("select count(*) as n from (select distinct project, bug_num from bugs where tp)", "bugs")
def bugs_cardinality(spark, sf_dir):
    return U.cardinality(_bugs(spark, sf_dir))


@query("select id, prediction, case when id % 9 = 0 then null else project end as project from preds", "preds")
def union_by_name_missing(spark, sf_dir):
    d = view(spark, sf_dir, "preds")
    return d.where("id % 9 <> 0").select("id", "prediction", "project").unionByName(d.where("id % 9 = 0").select("id", "prediction"), allowMissingColumns=True)


# --- predictors and source code --------------------------------------------------------------------------------------


@query("select id, case when contains(test_prefix, 'try') then 'exception' when contains(test_prefix, 'int a =') then 'assertNotNull(a);' else '' end as prediction from cases", "cases")
def predict_udf_rule_based(spark, sf_dir):
    return D.predict_column(view(spark, sf_dir, "cases"), D.RulePredictor).select("id", "prediction")


class Failing(D.RulePredictor):
    """Fails on exception tests."""

    def generate(self, test_prefix, focal_method=None, docstring=None):
        if "catch" in test_prefix:
            raise RuntimeError("no oracle")
        return super().generate(test_prefix, focal_method, docstring)


@query("select id, case when contains(test_prefix, 'catch') then '' when contains(test_prefix, 'int a =') then 'assertNotNull(a);' else '' end as prediction, target from cases", "cases")
def predict_error_empty(spark, sf_dir):
    return D.predict_column(view(spark, sf_dir, "cases"), Failing).select("id", "prediction", "target")


#: Searches: the cases whose id is divisible by this, each in all cases.
ASKED = 20
SIMILAR = (
    f"t as (select id, unnest(list_distinct(regexp_extract_all(test_prefix, '{H.TOKEN}'))) as token from cases), w as (select token, 1 + floor(1000 * ln((select count(*) from cases where len(regexp_extract_all(test_prefix, '{H.TOKEN}')) > 0)::double / count(*)::double))::bigint as weight from t group by token),"
    f" tw as materialized (select id, token, weight from t join w using (token)), total as (select id, sum(weight) as total from tw group by id), pairs as (select q.id as query, d.id as id, sum(d.weight) as common from tw q join tw d using (token) where q.id % {ASKED} = 0 and q.id <> d.id group by q.id, d.id),"
    " s as (select query, p.id, common::double / (a.total + b.total - common)::double as similarity from pairs p join total a on a.id = query join total b on b.id = p.id),"
    " r as (select s.query, row_number() over (partition by s.query order by similarity desc, s.id) as rank, s.id, target as value, similarity from s join cases c on c.id = s.id where similarity >= 0.3)"
)


def _case_index(spark, sf_dir):
    cases = view(spark, sf_dir, "cases").select("id", "test_prefix", "target")
    return cases, H.build(cases, depth=4)


@query(f"with {SIMILAR} select query, cast(rank as integer) as rank, id, value, similarity from r where rank <= 3", "cases")
def search_similar_prefixes(spark, sf_dir):
    """The three most similar other cases of every case whose id is divisible by 20, in all cases."""
    cases, index = _case_index(spark, sf_dir)
    return H.search(index, cases.where(F.col("id") % ASKED == 0), k=3, others=True)


@query(f"with {SIMILAR} select c.id, coalesce(value, '') as prediction, target from cases c left join (select query, value from r where rank = 1) on query = c.id where c.id % {ASKED} = 0", "cases")
def predict_search_based(spark, sf_dir):
    """Each of these cases gets the oracle of the most similar other one."""
    cases, index = _case_index(spark, sf_dir)
    return H.predict_by_search(cases.where(F.col("id") % ASKED == 0), index, others=True).select("id", "prediction", "target")


def _beam_sql() -> str:
    """The beam search of generate.py, a step after another."""
    toks = f"regexp_extract_all(coalesce({{}}, ''), '{H.TOKEN}')"
    n, end = N.ORDER - 1, N.END
    ctes = [
        f"b0 as materialized (select id, p[-{n}:] as p, list_concat(p[-{n}:], o, ['{end}']) as s from (select id, {toks.format('test_prefix')} as p, {toks.format('target')} as o from cases))",
        "b1 as (select s, unnest(range(len(p) + 1, len(s) + 1)) as j from b0)",
        f"b2 as (select s, j, unnest(range(0, 1 + least({n}, j - 1))) as size from b1)",
        "b3 as (select size, array_to_string(s[j - size:j - 1], ' ') as context, s[j] as token, count(*) as n from b2 group by all)",
        f"m as materialized (select size, context, token, floor(1000 * ln(n::double / sum(n) over (partition by size, context)::double))::bigint as gain from b3 qualify row_number() over (partition by size, context order by n desc, token) <= {N.BEAMS})",
        "g0 as materialized (select distinct array_to_string(p, ' ') as start, '' as tokens, p as last, 0::bigint as score, false as done from b0)",
    ]
    for k in range(1, N.MAX_NEW + 1):
        ctes.append(
            f"l{k} as materialized (select g.*, coalesce((select max(m.size) from m where m.size > 0 and m.size <= len(g.last) and m.context = array_to_string(g.last[len(g.last) - m.size + 1:], ' ')), 0) as size from g{k - 1} g where not done)"
        )
        ctes.append(
            f"g{k} as materialized (select * from (select start, case when tokens = '' then token else concat(tokens, ' ', token) end as tokens, list_concat(last, [token])[-{n}:] as last, score + gain + {N.BACKOFF} * (len(last) - l.size) as score, token = '{end}' as done"
            f" from l{k} l join m on m.size = l.size and m.context = case when l.size = 0 then '' else array_to_string(last[len(last) - l.size + 1:], ' ') end union all select start, tokens, last, score, done from g{k - 1} where done)"
            f" qualify row_number() over (partition by start order by score desc, tokens) <= {N.BEAMS})"
        )
    ctes.append(f"r as (select start, regexp_replace(tokens, '(^| ){end}$', '') as output, score::double / len(string_split(tokens, ' '))::double as score from g{N.MAX_NEW})")
    return f"with {', '.join(ctes)} select id, cast(row_number() over (partition by id order by score desc, output) as integer) as rank, output, score from b0 join r on array_to_string(p, ' ') = start"


@query(_beam_sql(), "cases")
def generate_beams(spark, sf_dir):
    """Five beams for every case, in order of their scores, by a model of all cases."""
    d = view(spark, sf_dir, "cases").select("id", *[F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(H.TOKEN), F.lit(0)).alias(n) for c, n in (("test_prefix", "prompt"), ("target", "output"))])
    return N.generate(d, N.train(d))


def _sources(spark, sf_dir):
    code = "concat('package x;', chr(10), 'public class C', p_partkey, ' {', chr(10), '  // class Not {', chr(10), '  C', p_partkey, '(int size) { this.s = size; }', chr(10), '  public String name(final List<String> a, int[] b) {', chr(10), '    return \"}\" + a;', chr(10), '  }', chr(10), '}')"
    return table(spark, sf_dir, "part").select(F.lit("p").alias("project"), F.expr("concat('src/C', p_partkey, '.java')").alias("relative_path"), F.expr(code).alias("source"))


NAME = "concat('  public String name(final List<String> a, int[] b) {', chr(10), '    return "


@query(
    f"select concat('src/C', p_partkey, '.java') as relative_path, 0 as seq, {NAME}\"}}') as content, 'name' as name, concat('C', p_partkey) as class, 'String' as return_type, '[{{\"type\":\"List\",\"name\":\"a\"}},{{\"type\":\"int\",\"name\":\"b\"}}]' as parameters from part"
    " union all select concat('src/C', p_partkey, '.java'), 1, concat('  C', p_partkey, '(int size) { this.s = size; }'), concat('C', p_partkey), concat('C', p_partkey), concat('C', p_partkey), '[{\"type\":\"int\",\"name\":\"size\"}]' from part"
)
def java_methods(spark, sf_dir):
    m = J.java_methods(_sources(spark, sf_dir))
    return m.select("relative_path", "seq", "content", F.col("metadata.name").alias("name"), F.col("metadata.class").alias("class"), F.col("metadata.return_type").alias("return_type"), F.to_json("metadata.parameters").alias("parameters"))


@query("select concat('C', p_partkey) as class, concat('src/C', p_partkey, '.java') as relative_path, concat('name,C', p_partkey) as methods from part")
def java_types(spark, sf_dir):
    t = J.java_types(J.java_methods(_sources(spark, sf_dir)))
    return t.select("class", "relative_path", F.array_join("methods", ",").alias("methods"))


@query(
    f"select concat('src/C', p_partkey, '.java') as relative_path, 0 as seq, {NAME}') as content, cast(78 + 2 * length(p_partkey::varchar) as integer) as start, cast(143 + 2 * length(p_partkey::varchar) as integer) as end from part"
    " union all select concat('src/C', p_partkey, '.java'), 1, concat('  C', p_partkey, '(int size) { this.s = size;'), cast(45 + length(p_partkey::varchar) as integer), cast(75 + 2 * length(p_partkey::varchar) as integer) from part"
)
def method_context_slice(spark, sf_dir):
    m = J.java_methods(_sources(spark, sf_dir), slice_mode="legacy")
    return m.select("relative_path", "seq", "content", F.col("metadata.start_line_no").alias("start"), F.col("metadata.end_line_no").alias("end"))


# --- formats ---------------------------------------------------------------------------------------------------------


@query("select o_orderkey, case when s < 60 then format('{:.1f}s', s) when s < 3600 then format('{:.1f}m', s / 60) else format('{:.1f}h', s / 3600) end as duration from (select o_orderkey, (o_orderkey % 5000)::double as s from orders)")
def format_duration(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 5000).cast("double").alias("s"))
    return d.select("o_orderkey", X.duration(F.col("s")).alias("duration"))


@query("select o_orderkey, format('{:.2f}', v) as two, format('{:.4f}', v) as four, concat(format('{:.2f}', 100 * v), '%') as share from (select o_orderkey, (o_orderkey % 64)::double / 64 as v from orders)")
def format_metrics(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select("o_orderkey", ((F.col("o_orderkey") % 64).cast("double") / 64).alias("v"))
    return d.select("o_orderkey", X.fixed(F.col("v"), 2).alias("two"), X.fixed(F.col("v"), 4).alias("four"), X.percent(F.col("v")).alias("share"))


@query("with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents) select doc_id, cast(i - 1 as integer) as line_no, cast(coalesce(sum(length(line) + 1) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as bigint) as position from l")
def lines_cumulative_offset(spark, sf_dir):
    return X.line_offsets(table(spark, sf_dir, "documents"), "text", "doc_id")


__all__ = ["ORACLES", "QUERIES"]
