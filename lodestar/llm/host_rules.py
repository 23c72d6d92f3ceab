"""Host-level quality rules, in DataFrame functions only.

Each document is measured on its whole text; rule failures are counted per host (domain); failure rates are shrunk
towards the corpus with a beta prior fitted to the hosts by moments; a host whose shrunk rate is high gets a verdict
per rule, and a document goes if it fails a base rule, or fails a rule that its host has a verdict for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, aliased, cut, pick, restored

#: rule -> SQL condition on the measured columns under which a document fails it.
RULES = {
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
    "repeats": "100 * n_repeat_words > 20 * n_words",
    "word_length": "word_chars < 3 * n_words or word_chars > 10 * n_words",
}
#: The hash of the window of words w that begins at i.
WINDOW_HASH = "xxhash64(w[i], w[i + 1], w[i + 2])"
BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"
#: A host has a verdict for a rule if its shrunk failure rate exceeds both.
MIN_RATE, TIMES_MEAN = 0.25, 2.0
#: Up to so many hosts with a verdict (a few dozen bytes each) the verdicts are broadcast; beyond, the join is salted.
BROADCAST_HOSTS, SALTS = 100_000, 16


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def measure(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "host")) -> DataFrame:
    """The columns in `keep` and the measured ones of each row; null text has no words.

    A word is in a repeated window if one of the 3-word windows over it occurs twice or more in its text. 64-bit hashes
    find windows that may be equal; their words decide.
    """
    d = docs.select(*keep, F.coalesce("text", F.lit("")).alias("t"))
    d = d.select(*keep, "t", words(F.col("t")).alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD)).alias("lines"))
    d = d.select(
        *keep, F.size("w").cast("bigint").alias("n_words"), F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        F.size("lines").cast("bigint").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.expr(f"case when size(w) >= 3 then transform(sequence(0, size(w) - 3), i -> {WINDOW_HASH}) else array() end").alias("tri"), "w",
    )
    rest = [*keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    twice = "coalesce(e.{0} = get({1}, k - 1).{0}, false) or coalesce(e.{0} = get({1}, k + 1).{0}, false)"
    d = d.select(*rest, "w", F.expr("case when size(array_distinct(tri)) < size(tri) then sort_array(transform(tri, (h, i) -> struct(h as h, i as p))) else array() end").alias("s"))
    d = d.select(*rest, F.expr(f"sort_array(transform(filter(s, (e, k) -> {twice.format('h', 's')}), e -> struct(concat_ws(' ', w[e.p], w[e.p + 1], w[e.p + 2]) as g, e.p as p)))").alias("g"))
    d = d.select(*rest, F.expr(f"sort_array(transform(filter(g, (e, k) -> {twice.format('g', 'g')}), e -> e.p))").alias("p"))
    return d.select(*rest, F.expr("aggregate(transform(p, (x, k) -> least(3, coalesce(get(p, k + 1) - x, 3))), 0L, (a, b) -> a + b)").alias("n_repeat_words"))


def host_verdicts(measured: DataFrame, rules: dict[str, str] = RULES, min_rate: float = MIN_RATE, times_mean: float = TIMES_MEAN) -> DataFrame:
    """Per host: n_docs, and for each rule its failures, shrunk_<rule> and bad_<rule>. The prior is one row of numbers."""
    hosts = cut(measured.groupBy("host").agg(F.count("*").alias("n_docs"), *[F.sum(F.expr(f"case when {c} then 1 else 0 end")).alias(f"fails_{r}") for r, c in rules.items()]))
    moments = hosts.agg(
        *[(F.sum(f"fails_{r}") / F.sum("n_docs")).alias(f"m_{r}") for r in rules],
        *[F.sum(F.expr(f"pow(fails_{r} / n_docs, 2) * n_docs")).alias(f"q_{r}") for r in rules], F.sum("n_docs").alias("n"),
    ).first()
    out = hosts
    for r in rules:
        m = moments[f"m_{r}"] or 0.0
        var = (moments[f"q_{r}"] or 0.0) / moments["n"] - m * m if moments["n"] else 0.0
        strength = min(1e6, max(1.0, m * (1 - m) / var - 1)) if var > 1e-12 else 1e6
        shrunk = (F.col(f"fails_{r}") + F.lit(m * strength)) / (F.col("n_docs") + F.lit(strength))
        out = out.withColumn(f"shrunk_{r}", shrunk).withColumn(f"bad_{r}", shrunk > F.lit(max(min_rate, times_mean * m)))
    return out


def judge(measured: DataFrame, verdicts: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """Join the verdicts back: measured columns, base_failed, host_failed, kept. Nulls in host meet as one host."""
    bad = verdicts.where(" or ".join(f"bad_{r}" for r in rules)).select(F.coalesce("host", F.lit("")).alias("_h"), F.col("host").isNull().alias("_n"), *[f"bad_{r}" for r in rules])
    m = measured.withColumn("_h", F.coalesce("host", F.lit(""))).withColumn("_n", F.col("host").isNull())
    if bad.count() <= BROADCAST_HOSTS:
        j = m.join(F.broadcast(bad), ["_h", "_n"], "left")
    else:
        m = m.withColumn("_s", F.pmod(F.xxhash64("n_words", "word_chars", "n_symbols"), F.lit(SALTS)))
        j = m.join(bad.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))), ["_h", "_n", "_s"], "left").drop("_s")
    failed = " or ".join(f"(coalesce(bad_{r}, false) and ({c}))" for r, c in rules.items())
    j = j.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("host_failed", F.expr(failed))
    return j.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed")).drop("_h", "_n", *[f"bad_{r}" for r in rules])


def apply_host_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", rules: dict[str, str] = RULES) -> DataFrame:
    """Per row: the id, host, measures, base_failed, host_failed, kept.

    Null or empty text: no words, so it fails the base rules. Null hosts form one host. Ids pass through, nulls and
    repeats included, one row out per row in. Empty tables give empty results; further columns are not read.
    """
    measured = cut(measure(pick(df, {"doc_id": id_col, "host": host_col, "text": text_col})))
    return judge(measured, host_verdicts(measured, rules), rules).withColumnRenamed("doc_id", id_col)


def reject_failed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", rules: dict[str, str] = RULES) -> DataFrame:
    """The rows of df, all columns as they are, that the rules keep. Documents are measured twice, for the verdicts and
    for the rows, so that no text is shuffled or stored."""
    d, back = aliased(df)
    name = {c: n for n, c in back.items()}
    d = d.withColumn("host", F.col(name[host_col])).withColumn("text", F.col(name[text_col]))
    verdicts = host_verdicts(cut(measure(d, ("host",))), rules)
    # the row number is not deterministic, so the optimizer leaves the filter above the measures and does not repeat them inside it
    m = measure(d, ("host", *back)).withColumn("row_number", F.monotonically_increasing_id())
    return restored(judge(m, verdicts, rules).where("kept and row_number >= 0"), back)


def oracle_sql() -> str:
    sums = ", ".join(f"cast(sum(case when {c} then 1 else 0 end) as bigint) as f_{r}" for r, c in RULES.items())
    prior = ", ".join(f"sum(f_{r})::double / sum(n) as m_{r}, sum(pow(f_{r}::double / n, 2) * n)::double / sum(n) as q_{r}" for r in RULES)
    k = {r: f"(case when q_{r} - m_{r} * m_{r} > 1e-12 then least(1e6, greatest(1.0, m_{r} * (1 - m_{r}) / (q_{r} - m_{r} * m_{r}) - 1)) else 1e6 end)" for r in RULES}
    bad = ", ".join(f"(f_{r} + m_{r} * {k[r]}) / (n + {k[r]}) > greatest({MIN_RATE}, {TIMES_MEAN} * m_{r}) as bad_{r}" for r in RULES)
    failed = " or ".join(f"(bad_{r} and ({c}))" for r, c in RULES.items())
    return rf"""
with d as (select row_number() over () as rid, doc_id, source, coalesce(text, '') as t from documents),
w as (select rid, doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
tri as (select rid, unnest(range(1, len(w) - 1)) as i, unnest(list_transform(range(1, len(w) - 1), lambda i: concat(w[i], chr(32), w[i + 1], chr(32), w[i + 2]))) as g from w where len(w) >= 3),
named as (select rid, i, count(*) over (partition by rid, g) as c from tri),
covered as (select rid, count(distinct i + o) as n from named, (select unnest([0, 1, 2]) as o) where c > 1 group by rid),
m as (select doc_id, source, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
        cast(len(regexp_extract_all(t, '[#*$%&|<>]')) as bigint) as n_symbols, cast(len(lines) as bigint) as n_lines,
        cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, cast(coalesce(n, 0) as bigint) as n_repeat_words
      from w left join covered using (rid)),
h as (select source, count(*) as n, {sums} from m group by source),
p as (select {prior} from h),
v as (select source, {bad} from h, p)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not host_failed as kept
from (select m.*, {BASE_FAILED} as base_failed, {failed} as host_failed from m join v on m.source is not distinct from v.source)
"""
