"""External commands as a table of results. The engine itself never needs to run one."""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import shlex
import subprocess
import time
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship

#: Seconds by phase, and for phases without their own.
TIMEOUTS, DEFAULT_TIMEOUT = {"compile": 600, "test": 1800, "mutation": 7200}, 3600


def run_one(command: str, folder: str, timeout: float) -> dict:
    """returncode, stdout, stderr, success of one command, without a shell; -1 for timeouts and commands that can't start."""
    try:
        r = subprocess.run(shlex.split(command), cwd=folder, capture_output=True, text=True, timeout=timeout, check=False)
    except subprocess.TimeoutExpired:
        return {"returncode": -1, "stdout": "", "stderr": f"Command timeout after {timeout:g}s", "success": False}
    except (OSError, ValueError) as e:
        return {"returncode": -1, "stdout": "", "stderr": str(e), "success": False}
    return {"returncode": r.returncode, "stdout": r.stdout, "stderr": r.stderr, "success": r.returncode == 0}


class Leases:
    """Claims and results of commands in a folder that all executors mount, one of each a (project, version, phase, command).

    A claim is made by creating its file, which only one task can do; a result appears whole, by a rename. So a command runs
    once, whatever is retried, run twice at once or restarted: who finds a result takes it, who finds a claim without one waits
    for it, as long as its holder may take, and then calls the command lost. Lost ones run again only if asked for."""

    def __init__(self, folder: str, rerun_lost: bool = False, poll: float = 0.2):
        self.folder, self.rerun_lost, self.poll = Path(folder), rerun_lost, poll

    def once(self, key: tuple[str | None, ...], timeout: float, run: Callable[[], dict]) -> dict:
        name = hashlib.sha256("\0".join("" if k is None else f"+{k}" for k in key).encode()).hexdigest()
        self.folder.mkdir(parents=True, exist_ok=True)
        claim, result = self.folder / f"{name}.claim", self.folder / f"{name}.json"
        while True:
            if result.exists():
                return json.loads(result.read_text())
            try:
                os.close(os.open(claim, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
                break
            except FileExistsError:
                try:
                    age = time.time() - claim.stat().st_mtime
                except FileNotFoundError:
                    continue
                if age > timeout:
                    if not self.rerun_lost:
                        return {"returncode": -1, "stdout": "", "stderr": f"No result after {timeout:g}s", "success": False}
                    with contextlib.suppress(FileNotFoundError):
                        claim.rename(self.folder / f"{name}.lost-{uuid.uuid4().hex[:8]}")
                    continue
                time.sleep(self.poll)
        got = run()
        beside = self.folder / f"{name}.{uuid.uuid4().hex[:8]}"
        beside.write_text(json.dumps(got))
        beside.replace(result)
        return got


def run_phases(targets: DataFrame, commands: dict[str, str], allow: bool = False, leases: Leases | None = None) -> DataFrame:
    """Compile, test and, where commands has one, mutate every row of targets (project, version, folder), as a command log:
    a project that does not compile ends there, one whose tests ran is mutated whatever they said. Commands may name
    {project}, {version} and {folder}. Each phase is run once and kept by a checkpoint before the next begins. With leases, a
    phase that has a result is skipped when all starts again."""
    log, todo = None, targets.select("project", "version", "folder")
    for phase in ("compile", "test", "mutation"):
        if phase not in commands:
            continue
        command = F.lit(commands[phase])
        for c in ("project", "version", "folder"):
            command = F.replace(command, F.lit("{" + c + "}"), F.col(c))
        done = cut(run_commands(todo.withColumn("phase", F.lit(phase)).withColumn("command", command), allow, leases))
        log = done if log is None else log.unionByName(done)
        if phase == "compile":
            todo = todo.join(done.where("success").select("project", "version"), ["project", "version"], "left_semi")
    if log is None:
        raise ValueError("no command for any phase")
    return log


def run_commands(df: DataFrame, allow: bool = False, leases: Leases | None = None) -> DataFrame:
    """Run each row's command (columns project, version, phase, command, folder) where the executors are, if `allow` says so.
    Commands have effects and without leases may run again when a task is retried, so this is off unless asked for."""
    if not allow:
        raise PermissionError("commands run only with allow=True")
    ship(df.sparkSession)

    def one(project, version, phase, command, folder) -> dict:
        limit = TIMEOUTS.get(phase, DEFAULT_TIMEOUT)
        if leases is None:
            return run_one(command, folder, limit)
        return leases.once((project, version, phase, command, folder), limit + 60, lambda: run_one(command, folder, limit))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = pd.DataFrame([one(*x) for x in zip(b["project"], b["version"], b["phase"], b["command"], b["folder"], strict=True)], columns=["returncode", "stdout", "stderr", "success"])
            yield pd.concat([b[["project", "version", "phase"]].reset_index(drop=True), got], axis=1)

    return df.select("project", "version", "phase", "command", "folder").mapInPandas(run, "project string, version string, phase string, returncode int, stdout string, stderr string, success boolean")
