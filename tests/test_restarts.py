"""Runs that are killed and start again: predictions by part, commands by lease."""

import os
import subprocess
import sys
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestar.operators import commands, predict


def counting(log):
    """Makes a predictor that notes each prefix it is asked for."""

    class Counting:
        def generate(self, test_prefix, focal_method=None, docstring=None):
            with open(log, "a") as f:
                f.write(f"{test_prefix}\n")
            return f"oracle of {test_prefix}"

    return Counting


def test_a_killed_run_goes_on(spark, tmp_path, monkeypatch):
    log, path = str(tmp_path / "log"), str(tmp_path / "out")
    source = str(tmp_path / "in")
    rows = [(i, f"p{i}", None, None) for i in range(40)] + [(None, "pnull", None, None), (7, "p7", None, None)]
    spark.createDataFrame(rows, "id int, test_prefix string, focal_method string, docstring string").write.parquet(source)
    df = spark.read.parquet(source)
    publish, published = predict.Folder.publish, []

    def dies(self, name, to):
        if len(published) == 2:
            raise KeyboardInterrupt
        published.append(to)
        publish(self, name, to)

    monkeypatch.setattr(predict.Folder, "publish", dies)
    with pytest.raises(KeyboardInterrupt):
        predict.predict_resumable(df, counting(log), path, parts=5)
    monkeypatch.setattr(predict.Folder, "publish", publish)
    first = Path(log).read_text().split()
    assert 0 < len(first) < 41 and len(published) == 2
    os.rename(source, source + "-gone")  # what was laid out is not read again
    again = spark.createDataFrame(rows[:1], df.schema)
    predict.predict_resumable(again, counting(log), path)
    os.rename(source + "-gone", source)
    asked = Path(log).read_text().split()
    assert set(asked) == {f"p{i}" for i in range(40)} | {"pnull"} and len(asked) < 41 + len(first), "published parts are not done again"
    got = predict.predict_resumable(df, counting(log), path)
    assert sorted((str(r["id"]), r["prediction"]) for r in got.collect()) == sorted((str(i), f"oracle of {p}") for i, p, _, _ in rows)
    assert Path(log).read_text().split() == asked, "nothing is predicted anew"
    more = df.unionByName(df.where("id < 3").withColumn("id", F.col("id") + 100))
    assert predict.predict_resumable(more, counting(log), path, parts=3).count() == len(rows) + 3
    assert len(Path(log).read_text().split()) == len(asked) + 3
    assert predict.predict_resumable(df.limit(0), counting(log), str(tmp_path / "none")).count() == 0


def test_a_failed_task_does_not_repeat_its_command(spark, tmp_path):
    ran, failed = tmp_path / "ran", tmp_path / "failed"
    targets = spark.createDataFrame([("p", "v", str(tmp_path))], "project string, version string, folder string")
    plan = {"compile": f"sh -c 'echo compile >> {ran}'", "test": f"sh -c 'echo test >> {ran}; exit 3'"}
    leases = commands.Leases(str(tmp_path / "leases"))

    def once(batches):
        for b in batches:
            if not failed.exists():
                failed.touch()
                raise RuntimeError("the task is lost after its command has run")
            yield b

    job = targets.select("project", "version", F.lit("compile").alias("phase"), F.lit(plan["compile"]).alias("command"), "folder")
    log = commands.run_commands(job, True, leases)
    lossy = log.mapInPandas(once, log.schema)
    with pytest.raises(Exception, match="lost"):
        lossy.collect()
    assert [r["success"] for r in lossy.collect()] == [True] and ran.read_text() == "compile\n"
    for _ in range(2):
        got = {r["phase"]: r["returncode"] for r in commands.run_phases(targets, plan, allow=True, leases=leases).collect()}
        assert got == {"compile": 0, "test": 3} and ran.read_text() == "compile\ntest\n", "phases with a result are skipped"


def test_claims_without_a_result(tmp_path):
    def lost():
        raise KeyboardInterrupt

    leases = commands.Leases(str(tmp_path), poll=0.01)
    with pytest.raises(KeyboardInterrupt):
        leases.once(("p", None), 1, lost)
    began = time.time()
    assert leases.once(("p", None), 0.3, dict)["returncode"] == -1 and time.time() - began < 5
    assert leases.once(("p", ""), 1, lambda: {"x": 1}) == {"x": 1} == leases.once(("p", ""), 1, lost)
    assert commands.Leases(str(tmp_path), rerun_lost=True).once(("p", None), 0.1, lambda: {"x": 2}) == {"x": 2}


def test_checkpoints_go_with_the_driver(tmp_path):
    """What an application cut its lineage with is gone when it has ended, and the folder of others stays."""
    (tmp_path / "other").mkdir()
    code = "from lodestar.session import cut, session\ns = session(spark__checkpoint__dir=DIR, spark__master='local[1]', spark__ui__enabled='false')\nassert cut(s.range(5)).count() == 5\nimport os\nassert len(os.listdir(DIR)) == 2\ns.stop()\n"
    subprocess.run([sys.executable, "-c", f"DIR = {str(tmp_path)!r}\n{code}"], check=True, timeout=120)
    for _ in range(60):
        if os.listdir(tmp_path) == ["other"]:
            break
        time.sleep(0.5)
    assert os.listdir(tmp_path) == ["other"]
