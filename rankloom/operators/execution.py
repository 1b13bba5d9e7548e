"""Running programs against tests: an opaque step in Arrow batches, with a process per program.

Programs run with the interpreter's isolated mode, a time limit, a memory limit and no inherited environment. That is no
sandbox against hostile code; a cluster should run the executors themselves in one.
"""

from __future__ import annotations

import resource
import subprocess
import sys
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "task_id string, sid string, trial int, timeout boolean, had_error boolean, return_code int, num_ran int, num_passed int, passed boolean, outcomes array<boolean>, timing map<string,double>"


def _limits(mb: int):
    def set_() -> None:
        resource.setrlimit(resource.RLIMIT_AS, (mb << 20, mb << 20))

    return set_


def run_program(code: str, inputs: list[str], outputs: list[str], first_timeout: float, timeout: float, memory_mb: int, stop_early: bool) -> dict:
    """One program on its tests; the first run may take longer, as it starts cold."""
    began, outcomes, late, error, status = time.perf_counter(), [], False, False, 0
    for i, (given, want) in enumerate(zip(inputs, outputs)):
        try:
            p = subprocess.run([sys.executable, "-I", "-c", code], input=given, capture_output=True, text=True, timeout=first_timeout if i == 0 else timeout, env={}, preexec_fn=_limits(memory_mb))
            status, error = p.returncode, error or p.returncode != 0
            outcomes.append(p.returncode == 0 and p.stdout.split() == want.split())
        except subprocess.TimeoutExpired:
            late, status = True, -9
            outcomes.append(False)
        if stop_early and not outcomes[-1]:
            break
    passed = len(outcomes) == len(inputs) and all(outcomes)
    return {"timeout": late, "had_error": error, "return_code": status, "num_ran": len(outcomes), "num_passed": sum(outcomes), "passed": passed, "outcomes": outcomes, "timing": {"execution_time": time.perf_counter() - began}}


def executed(df: DataFrame, max_tests: int | None = None, first_timeout: float = 30.0, timeout: float = 10.0, memory_mb: int = 512, stop_early: bool = True) -> DataFrame:
    """Trial rows for candidates (``task_id, sid, trial, solution, inputs array<string>, outputs array<string>``).

    At most ``max_tests`` tests each; a null program fails without running. Merge repeated programs before, so that each
    runs once.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                given, want = list(r.inputs)[:max_tests], list(r.outputs)[:max_tests]
                if r.solution is None:
                    got = {"timeout": False, "had_error": True, "return_code": 1, "num_ran": 0, "num_passed": 0, "passed": False, "outcomes": [], "timing": {}}
                else:
                    got = run_program(r.solution, given, want, first_timeout, timeout, memory_mb, stop_early)
                rows.append({"task_id": r.task_id, "sid": str(r.sid), "trial": int(r.trial)} | got)
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.replace("map<string,double>", "map").split(", ")])

    return df.select("task_id", "sid", "trial", "solution", "inputs", "outputs").mapInPandas(work, SCHEMA)
