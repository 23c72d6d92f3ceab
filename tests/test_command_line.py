"""The command line over small files."""

import json

import pytest

from lodestar.__main__ import main
from lodestar.operators import commands


def test_paired_and_projects(spark, tmp_path, capsys):
    p = tmp_path / "in" / "one"
    p.mkdir(parents=True)
    (p / "inputs.csv").write_text('id,test_prefix,focal_method,docstring\n1,"try {\n}",,\n2,int a = 1;,,\n3,x,,\n')
    (p / "meta.csv").write_text("id,GTassert,assertORexception\n1,,-1\n2,assertNotNull(a);,0\n3,assertTrue(b);,0\n")
    (p / "meta_llm.csv").write_text("GT_output,file_path,test_name\nexception,a,T::t\nassertNull(a);,a,T::u\n")
    main(["paired", "--inputs", str(p / "inputs.csv"), "--meta", str(p / "meta.csv"), "--output", str(tmp_path / "o1")])
    r = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert (r["num_samples"], r["num_matches"]) == (3, 2)
    main(["projects", "--base", str(tmp_path / "in"), "--projects", "one,none", "--output", str(tmp_path / "o2")])
    out = capsys.readouterr().out
    assert "none: no such project" in out and json.loads(out.strip().splitlines()[-1])["accuracy"] == 0.5


def test_bugs_versions_extract_inject(spark, tmp_path, capsys):
    for m, rows in (("a", "p,1,True\np,2,True\n"), ("b", "p,2,True\np,3,False\n")):
        f = tmp_path / m / "assertion_prefix" / f"{m}_generated"
        f.mkdir(parents=True)
        (f / "test_data.csv").write_text("project,bug_num,TP\n" + rows)
    main(["bugs", "--results", str(tmp_path / "a"), "--method", "a", "--other", str(tmp_path / "b"), "--other-method", "b"])
    r = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert r == {"total_a": 2, "total_b": 1, "only_a": 1, "only_b": 0, "both": 1}
    (tmp_path / "logs.json").write_text(json.dumps({"project": "p", "version": "v", "phase": "compile", "returncode": 0, "stdout": "", "stderr": "", "success": True}))
    main(["versions", "--logs", str(tmp_path / "logs.json"), "--output", str(tmp_path / "v"), "--requested", "2"])
    assert "0.5" in capsys.readouterr().out
    src = tmp_path / "src" / "p" / "test" / "java"
    src.mkdir(parents=True)
    (src / "T.java").write_text("class T {\n@Test\npublic void t() {\n}\n}")
    main(["extract", "--base", str(tmp_path / "src"), "--output", str(tmp_path / "e")])
    assert spark.read.json(str(tmp_path / "e" / "methods")).first()["metadata"]["name"] == "t"
    pred = tmp_path / "pred" / "p"
    pred.mkdir(parents=True)
    (pred / "predictions.json").write_text(json.dumps([{"id": 1, "prediction": "assertTrue(a)"}]))
    (tmp_path / "meta_llm.csv").write_text("id,GT_output,file_path,test_name\n1,,src/test/java/T.java,T::t\n")
    main(["inject", "--predictions", str(tmp_path / "pred"), "--meta", str(tmp_path / "meta_llm.csv"), "--files", str(tmp_path / "src"), "--output", str(tmp_path / "i")])
    assert "assertTrue(a);" in spark.read.parquet(str(tmp_path / "i")).first()["content"]


def test_commands(spark, tmp_path):
    d = spark.createDataFrame([("p", "v", "test", "echo hello", str(tmp_path)), ("p", "v", "test", "false", str(tmp_path)), ("p", "v", "test", "no-such-command", str(tmp_path))], "project string, version string, phase string, command string, folder string")
    with pytest.raises(PermissionError):
        commands.run_commands(d)
    got = commands.run_commands(d, allow=True).collect()
    assert [(r["returncode"], r["success"]) for r in got] == [(0, True), (1, False), (-1, False)] and got[0]["stdout"] == "hello\n"
