"""Command line: python -m lodestar COMMAND ... (see --help of each)."""

from __future__ import annotations

import argparse
import importlib
import json
import time

from pyspark.sql import functions as F

from . import schemas
from .operators import bugsets, evaluate, inject, javasrc, logs
from .operators.pairing import with_row_index
from .session import session
from .sources import readers, sinks


def predictor(name: str):
    """module:attribute of something that makes a predictor."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def paired(a, spark) -> None:
    inputs = readers.load_csv(spark, a.inputs, schemas.INPUTS)
    preds, score = evaluate.evaluate_paired(inputs, readers.load_csv(spark, a.meta, schemas.META), predictor(a.predictor), a.subset)
    began = time.time()
    sinks.save_json(preds, f"{a.output}/predictions")
    seconds = time.time() - began
    r = score.first().asDict()
    print(json.dumps(r | {"seconds": seconds, "seconds_per_sample": seconds / r["num_samples"] if r["num_samples"] else 0.0}))


def projects(a, spark) -> None:
    all_rows = None
    for p in a.projects.split(",") if a.projects else readers.PROJECTS:
        if not readers.exists(spark, f"{a.base}/{p}"):
            print(f"{p}: no such project, skipped")
            continue
        # rows are paired by their place in the file: read in order, numbered once
        pair = [readers.load_csv(spark, f"{a.base}/{p}/{f}", s).withColumn("at", F.monotonically_increasing_id()) for f, s in (("inputs.csv", schemas.INPUTS), (a.meta_name, schemas.META_LLM))]
        d = evaluate.load_positional(*[with_row_index(x, "at").drop("at") for x in pair], a.subset)
        d = d.select(F.coalesce("id", "row_idx").alias("id"), "test_prefix", "focal_method", "docstring", "target").withColumn("project", F.lit(p))
        all_rows = d if all_rows is None else all_rows.unionByName(d)
    if all_rows is None:
        print(json.dumps({"num_samples": 0, "num_matches": 0, "accuracy": 0.0}))
        return
    preds, by, micro = evaluate.evaluate_by_project(all_rows, predictor(a.predictor))
    sinks.save_json(preds, f"{a.output}/predictions")
    sinks.save_csv(by, f"{a.output}/summary", one_file=True)
    print(json.dumps(micro.first().asDict()))


def versions(a, spark) -> None:
    d = logs.version_rollup(logs.phase_table(spark.read.schema(schemas.COMMANDS).json(a.logs)), a.requested)
    sinks.save_csv(d, f"{a.output}/summary", one_file=True)
    d.show(truncate=False)


def bugs(a, spark) -> None:
    d = bugsets.load_results(spark, a.results, a.method)
    print(json.dumps({"method": a.method, "bugs": bugsets.cardinality(bugsets.bug_set(d)).first()["n"]}))
    if a.other:
        both = d.unionByName(bugsets.load_results(spark, a.other, a.other_method))
        print(json.dumps(bugsets.summary(both, a.method, a.other_method).first().asDict()))


def inject_all(a, spark) -> None:
    # predictions, meta rows and files of a project meet; a meta file that is not below a project's folder speaks for all
    preds = readers.load_project_predictions(spark, a.predictions).select("project", "id", "prediction", "pred_seq")
    files = readers.load_java(spark, a.files).where(F.col("relative_path").contains("test/java/"))
    files = files.select("project", F.regexp_replace("relative_path", r"^.*\Qtest/java/\E", "").alias("file_path"), F.col("source").alias("content"))
    if a.meta.endswith(".csv"):
        meta = readers.load_csv(spark, a.meta, schemas.META_LLM).withColumn("at", F.monotonically_increasing_id())
    else:
        meta = readers.load_project_meta(spark, a.meta)
    inject.inject_fold(files, inject.located(preds, meta, order="at")).write.mode("overwrite").parquet(a.output)


def template(a, spark) -> None:
    sinks.save_oracle_template(readers.load_csv(spark, a.inputs, "id bigint, project string, bug_num string, test_name string, test_prefix string"), a.output)


def extract(a, spark) -> None:
    m = javasrc.java_methods(readers.load_java(spark, a.base), slice_mode=a.slice_mode).cache()
    sinks.save_json(m.select("project", "content", "metadata"), f"{a.output}/methods")
    sinks.save_json_array(javasrc.java_types(m).select("project", "class", "relative_path", "methods"), f"{a.output}/types.json", "project", "class", "relative_path")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestar", description=__doc__)
    sub = p.add_subparsers(required=True)

    def command(name, f, *options, **required):
        c = sub.add_parser(name)
        c.set_defaults(run=f)
        for o in required:
            c.add_argument(f"--{o}", required=True)
        for o, kind, default in options:
            c.add_argument(f"--{o.replace('_', '-')}", type=kind, default=default)

    rule = ("predictor", str, "lodestar.operators.predict:RulePredictor")
    command("paired", paired, ("subset", int, None), rule, inputs=1, meta=1, output=1)
    command("projects", projects, ("projects", str, ""), ("subset", int, None), ("meta_name", str, "meta_llm.csv"), rule, base=1, output=1)
    command("versions", versions, ("requested", int, len(readers.PROJECTS)), logs=1, output=1)
    command("bugs", bugs, ("other", str, None), ("other_method", str, "other"), results=1, method=1)
    command("inject", inject_all, predictions=1, meta=1, files=1, output=1)
    command("template", template, inputs=1, output=1)
    command("extract", extract, ("slice_mode", str, "fixed"), base=1, output=1)
    return p


def main(arguments: list[str] | None = None) -> None:
    a = parser().parse_args(arguments)
    a.run(a, session())


if __name__ == "__main__":
    main()
