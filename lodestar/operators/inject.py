"""Putting predicted oracles into test files."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import part, quote_replacement
from ..session import cut, ship


# The patterns below decide what is replaced.

#: A test method's beginning, of which inject_by_name() knows the name.
HEAD = re.compile(r"@Test[^\n]*\n\s*public void (\w+)")
#: What an injected oracle replaces.
OLD = re.compile(r"assert\w*\([^;]*\);"), re.compile(r"fail\([^)]*\);")


def inject_by_number(content: Column, test_id: Column, oracle: Column) -> Column:
    """Append the oracle before the first closing brace of public void test<id>()."""
    pattern = F.concat(F.lit(r"(?s)(public void test"), test_id.cast("string"), F.lit(r"\(\).*?\{[^}]*?)(\})"))
    return F.regexp_replace(content, pattern, F.concat(F.lit("$1\n    "), quote_replacement(oracle), F.lit("\n}")))


def inject_by_name(content: str, name: str, oracle: str | None, strict: bool = True) -> str:
    """In the @Test method `name`, up to its first closing brace: old assertions and fail calls go, the oracle is appended
    (with a semicolon; nothing for 'exception' or ''). strict takes the name as a whole word; else longer names match too."""
    word = re.escape(name) + (r"\b" if strict else "")
    method = re.compile(rf"(?P<body>@Test[^\n]*\n\s*public void {word}[^{{]*\{{[^}}]*?)\}}", re.S)

    def rewritten(m: re.Match) -> str:
        body = m["body"]
        for old in OLD:
            body = old.sub("", body)
        return body + appended(oracle) + "}"

    return method.sub(rewritten, content)


def appended(oracle: str | None) -> str:
    """What stands before the closing brace once this oracle is injected."""
    if not oracle or oracle == "exception":
        return "\n"
    return f"\n{oracle}" + ("" if oracle.endswith(";") else ";") + "\n"


def inject_in_order(text: str, name: str, oracles: list[str | None]) -> tuple[str, int]:
    """A piece of method_pieces() after inject_by_name() with each oracle in turn, and how many of them changed it.

    What has neither an assertion nor a fail call in it stays as it is from then on, whatever follows on a new line, so only
    the rest is looked at again. Where a head, or an oracle with a closing brace, could change what the method is, each
    oracle is injected by itself."""
    m = HEAD.match(text)
    opened = text.find("{", m.end()) + 1 if m else 0
    marks = ("assert", "fail(")
    n = 0
    if not opened or any(x in text[:opened] for x in marks) or any("}" in (o or "") for o in oracles):
        for oracle in oracles:
            new = inject_by_name(text, name, oracle)
            n, text = n + (new != text), new
        return text, n
    settled, rest = [text[:opened]], text[opened:-1]
    for oracle in oracles:
        new = rest
        for old in OLD:
            new = old.sub("", new)
        end = appended(oracle)
        n += new + end != rest
        if any(x in new for x in marks):
            rest = new + end
        else:
            settled.append(new)
            rest = end
    return "".join([*settled, rest, "}"]), n


def inject_named(df: DataFrame, content: str, name: str, oracle: str, out: str = "content", strict: bool = True) -> DataFrame:
    ship(df.sparkSession)

    @F.pandas_udf("string")
    def run(c: pd.Series, n: pd.Series, o: pd.Series) -> pd.Series:
        return pd.Series([inject_by_name(x, y, z, strict) if x is not None and y is not None else x for x, y, z in zip(c, n, o, strict=True)])

    return df.withColumn(out, run(content, name, oracle))


def located(predictions: DataFrame, meta: DataFrame, windows: bool = False, order: str | None = None) -> DataFrame:
    """project, pred_seq, file_path, test_name, prediction of predictions whose id has a meta row of the same project; the
    path below test/java/, with backslashes where asked. Predictions without a column project are of one project, null;
    meta rows without it speak for all projects.

    Of several meta rows of an id the first counts: by column `order`, or by their place in the files read, which is
    only sure within one file (meta rows of one project are one file)."""
    from .pairing import first_match

    m = meta
    p = predictions if "project" in predictions.columns else predictions.withColumn("project", F.lit(None).cast("string"))
    project = [F.coalesce("project", F.lit("")).alias("project")] if "project" in meta.columns else []
    key = F.struct(*project, F.col("id").cast("bigint").alias("id"))
    m = m.select(key.alias("_k"), "file_path", "test_name", (F.col(order) if order else F.monotonically_increasing_id()).alias("_m"))
    d = first_match(p.withColumn("_k", key), m, "_k", "_m").drop("_m", "_k")
    path = part(F.regexp_replace("file_path", r"\\", "/"), "test/java/", 1)
    path = F.replace(path, F.lit("/"), F.lit("\\")) if windows else path
    return d.select("project", "pred_seq", path.alias("file_path"), part(F.col("test_name"), "::", 1).alias("test_name"), "prediction")


def method_pieces(content: str) -> list[tuple[str | None, str]] | None:
    """A file in pieces, in order: (name, text) of each test method from its @Test to its first closing brace, and (None, text)
    of what lies between. None where two methods overlap, so that they cannot be rewritten apart."""
    pieces, at = [], 0
    for m in HEAD.finditer(content):
        opened = content.find("{", m.end())
        closed = content.find("}", opened) if opened >= 0 else -1
        if closed < 0:
            continue
        if m.start() < at:
            return None
        pieces += [(None, content[at : m.start()]), (m[1], content[m.start() : closed + 1])]
        at = closed + 1
    return [*pieces, (None, content[at:])]


def inject_fold(files: DataFrame, predictions: DataFrame, strict: bool = True) -> DataFrame:
    """project, file_path, content, n_injected: each file rewritten by its predictions one after another, in order of
    pred_seq (then of the prediction). Files and predictions meet by project and path; tables without a column project are of
    one project, null.

    Files (project, file_path, content; null content is empty) without a prediction stay as they are, predictions without a
    file or a method's name are dropped. A file is cut into its test methods in one pass; a method meets its own predictions by name and is folded alone,
    so neither a file nor what is predicted for it is one task's work. Where that could differ from a fold over the whole
    file (methods that overlap, names that are no words, oracles that hold a test, names that match longer ones) the whole
    file is folded.
    """
    ship(files.sparkSession)
    left, right = (d if "project" in d.columns else d.withColumn("project", F.lit(None).cast("string")) for d in (files, predictions))
    key = F.struct(F.col("project").isNull().alias("none"), F.coalesce("project", F.lit("")).alias("project"), "file_path")
    left = left.select(key.alias("_file"), "project", "file_path", "content", F.xxhash64("content").alias("_version"))
    right = right.where(F.col("test_name").isNotNull()).select(key.alias("_file"), "test_name", F.struct("pred_seq", "prediction").alias("p"))
    if not strict:
        return _fold_files(left, right, strict)

    @F.pandas_udf("array<struct<at: int, name: string, first: boolean, text: string>>")
    def cut_up(contents: pd.Series) -> pd.Series:
        def one(c: str | None) -> list[dict] | None:
            pieces, seen, out = method_pieces(c or ""), set(), []
            for k, (name, text) in enumerate(pieces or []):
                out.append({"at": k, "name": name, "first": name not in seen, "text": text})
                seen.add(name)
            return out if pieces is not None else None

        return pd.Series([one(c) for c in contents])

    @F.pandas_udf("struct<text: string, n: bigint>")
    def fold(texts: pd.Series, names: pd.Series, todo: pd.Series) -> pd.DataFrame:
        rows = [inject_in_order(text, name, list(oracles)) if oracles is not None else (text, 0) for text, name, oracles in zip(texts, names, todo, strict=True)]
        return pd.DataFrame(rows, columns=["text", "n"])

    odd = right.where(~F.coalesce(F.col("test_name"), F.lit("")).rlike(r"(?U)\A\w+\z") | F.coalesce(F.col("p.prediction"), F.lit("")).contains("@Test")).select("_file").distinct()
    d = left.withColumn("pieces", cut_up("content"))
    whole = cut(d.where(F.col("pieces").isNull()).select("_file").unionByName(odd))
    none = whole.isEmpty()
    apart = (d if none else d.join(whole, "_file", "left_anti")).withColumn("_id", F.struct("_file", "_version")).select("_id", "_file", "project", "file_path", F.inline("pieces"))
    todo = right.groupBy("_file", F.col("test_name").alias("name")).agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["prediction"]).alias("todo"))
    # dealt by number: by bytes a few small methods would be one task, though each may have many predictions
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    apart = apart.join(todo, ["_file", "name"], "left").repartition(tasks, "_file", "name", "at").withColumn("new", fold("text", "name", "todo")).where(F.col("new").isNotNull())  # without the filter each field would fold anew
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "new.text"))), lambda p: p["text"]), "")
    apart = apart.groupBy("_id").agg(F.first("project").alias("project"), F.first("file_path").alias("file_path"), text.alias("content"), F.sum(F.when(F.col("first"), F.col("new.n")).otherwise(0)).alias("n_injected")).drop("_id")
    return apart if none else apart.unionByName(_fold_files(left.join(whole, "_file", "left_semi"), right.join(whole, "_file", "left_semi"), strict))


def _fold_files(left: DataFrame, right: DataFrame, strict: bool) -> DataFrame:
    """Whole files and their predictions, a file a group."""

    def fold(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        todo = right.sort_values(["pred_seq", "prediction"], kind="stable") if len(right) else right
        for project, path, content in zip(left["project"], left["file_path"], left["content"], strict=True):
            n, content = 0, content or ""
            for name, oracle in zip(todo["test_name"], todo["prediction"], strict=True):
                new = inject_by_name(content, name, oracle, strict)
                n += new != content
                content = new
            rows.append((project, path, content, n))
        return pd.DataFrame(rows, columns=["project", "file_path", "content", "n_injected"])

    right = right.select("_file", "test_name", "p.pred_seq", "p.prediction")
    return left.groupBy("_file").cogroup(right.groupBy("_file")).applyInPandas(fold, "project string, file_path string, content string, n_injected bigint")
