"""Base views that queries over the synthetic tables share, in Spark SQL and in DuckDB's dialect.

The tables hold no source code, so test code is made from events by one expression that both dialects read alike.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Test code of an event: an exception test, an assertion, comment and blank lines, an assertion over two lines, or neither.
CODE = """case when event_type = 'error' then concat('try {', chr(10), '  op(', event_id, ');', chr(10), '  fail("x");', chr(10), '} catch(E e) {', chr(10), '}')
 when event_type = 'view' then concat('int a = f(', event_id, ');', chr(10), 'assertEquals(', event_id, ', a);')
 when event_type = 'click' then concat(' int a = f(', event_id, ');', chr(10), '  // Undeclared exception!', chr(10), chr(10), '  a++;', chr(10), 'assertTrue(a > ', event_id % 3, '); assertNotNull(a);')
 when event_type = 'signup' then concat('int a = f(', event_id, ');', chr(10), 'assertEquals(1,', chr(10), ' a);')
 else concat('int a = f(', event_id, ');') end"""
TARGET = """case when event_type = 'error' then 'exception' when event_type = 'view' then concat('assertEquals(', event_id, ', a);')
 when event_type = 'click' then concat('assertTrue(a > ', event_id % 3, '); assertNotNull(a);') else '' end"""

CASES = f"""select event_id as id, concat('p', user_id % 25) as project, {CODE} as test_prefix,
 case when event_id % 10 = 0 then null else concat('public int m', event_id % 7, '(int x) {{', chr(10), '  return x;', chr(10), '}}') end as focal_method,
 case when event_id % 3 = 0 then null when event_id % 11 = 0 then 'finance' else concat('Doc ', event_id) end as docstring,
 case when event_type = 'error' then -1 when event_id % 13 = 0 then null else 0 end as flag,
 case when event_type = 'error' then null else concat(' ', {TARGET}, chr(10)) end as gt_assert,
 {TARGET} as target, event_type from events"""

PREDS = f"""select id, project, target, event_type, case id % 5 when 0 then concat('  ', target, chr(9)) when 1 then replace(target, ';', '') when 2 then 'Exception'
 when 3 then target else '' end as prediction, case when event_type = 'view' and id % 4 <> 0 then target when event_type = 'click' then 'nan' else null end as assert_pred,
 case id % 4 when 0 then 0 when 1 then 1 when 2 then -1 else null end as except_pred from ({CASES}) c"""

BUGS = """select event_type as project, user_id as bug_num, case when value > 50 then 'a' else 'b' end as method,
 case event_id % 3 when 0 then 'assertion' when 1 then 'exception' else 'prefix_only' end as route,
 case when event_id % 7 = 0 then null else event_id % 2 = 0 end as TP from events"""

LOGS = """select o_orderkey as id, concat('p', o_custkey % 5) as project, case o_custkey % 3 when 0 then 'evosuite' when 1 then 'llm' else 'no_oracle' end as version,
 o_orderkey % 9 <> 0 as compiled, concat('[INFO] start', chr(10),
 case when o_orderkey % 3 >= 1 then concat('Tests run: ', o_orderkey % 50, ', Failures: 1, Errors: 0, Skipped: 2', chr(10)) else '' end,
 case when o_orderkey % 3 = 2 then concat('Tests run: ', 10 + o_orderkey % 70, ', Failures: ', o_orderkey % 4, ', Errors: ', o_orderkey % 2, ', Skipped: 0', chr(10)) else '' end,
 case when o_orderkey % 4 <> 0 then concat('Line Coverage: ', o_orderkey % 100, '.5%', chr(10), 'Mutation Coverage: ', o_orderkey % 90, '%', chr(10)) else '' end,
 case when o_orderkey % 5 <> 0 then concat('Generated ', o_orderkey % 200, ' mutations Killed ', o_orderkey % 150, chr(10), 'Killed 1', chr(10)) else '' end) as stdout from orders"""

LABELS2 = "select d.doc_id, l.quality as truth, case when d.n_chars > 900 then 1 else 0 end as prediction from documents d join labels l on d.doc_id = l.doc_id"

STEPS = {
    "spark": "select cast(event_id div 1000 as int) as epoch, cast(event_id % 1000 as int) as step, value / 100 as loss from events",
    "duckdb": "select cast(event_id // 1000 as int) as epoch, cast(event_id % 1000 as int) as step, value / 100 as loss from events",
}
#: Token arrays of whole documents: the lengths of all words, dealt over the parts by position: two fifths or more to p, a
#: fifth each to d (to m instead in every ninth document), m, g and o.
TOKS = {
    "spark": "select id, slice(w, 1, n - 4 * q) as p, transform(slice(w, n - 4 * q + 1, e), x -> x + 100) as d, transform(slice(w, n - 4 * q + e + 1, 2 * q - e), x -> x + 200) as m,"
    " transform(slice(w, n - 2 * q + 1, q), x -> x + 300) as g, transform(slice(w, n - q + 1, q), x -> x + 400) as o"
    " from (select *, if(id % 9 = 0, 0, q) as e from (select id, w, size(w) as n, cast(size(w) div 5 as int) as q from (select doc_id as id, text from documents)"
    " lateral view inline(array(named_struct('w', transform(split(text, ' '), x -> length(x))))) t as w))",  # generated, so that a filter on the parts doesn't split the text again for each of them
    "duckdb": "select id, w[1:n - 4 * q] as p, list_transform(w[n - 4 * q + 1:n - 4 * q + e], lambda x: x + 100) as d, list_transform(w[n - 4 * q + e + 1:n - 2 * q], lambda x: x + 200) as m,"
    " list_transform(w[n - 2 * q + 1:n - q], lambda x: x + 300) as g, list_transform(w[n - q + 1:n], lambda x: x + 400) as o"
    " from (select *, case when id % 9 = 0 then 0 else q end as e from (select *, len(w) as n, len(w) // 5 as q from (select doc_id as id, list_transform(string_split(text, ' '), lambda x: length(x)) as w from documents)))",
}
VIEWS = {"cases": CASES, "preds": PREDS, "bugs": BUGS, "logs": LOGS, "labels2": LABELS2, "steps": STEPS, "toks": TOKS}
TABLES = {"cases": ("events",), "preds": ("events",), "bugs": ("events",), "logs": ("orders",), "labels2": ("documents", "labels"), "steps": ("events",), "toks": ("documents",)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base view over the directory's tables."""
    sql = VIEWS[name]["spark"] if isinstance(VIEWS[name], dict) else VIEWS[name]
    for t in TABLES[name]:
        table(spark, sf_dir, t).createOrReplaceTempView(f"lodestar_{t}")
        sql = re.sub(rf"\b(from|join) {t}\b", rf"\1 lodestar_{t}", sql)
    return spark.sql(sql)


def duck(name: str) -> str:
    """The view as a common table expression for DuckDB."""
    sql = VIEWS[name]
    return f"{name} as ({sql['duckdb'] if isinstance(sql, dict) else sql})"
