"""Running generated code against tests. Off unless asked for: there is no sandbox but a process and a time limit."""

from __future__ import annotations

import re
import subprocess
import sys
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from tidemark.functions.code import aliased
from tidemark.functions.text import ASSERTED


def mbpp_program(code: str, setup: str, tests: list[str]) -> str:
    """Code with aliases for the names that its tests ask for, then the set-up, then the tests."""
    wanted = list(dict.fromkeys(name for t in tests for name in re.findall(ASSERTED, t)))
    return "\n\n".join(x for x in (aliased(code, wanted), setup.strip() and setup, "\n".join(tests)) if x)


def humaneval_programs(prompt: str, completion: str, test: str, entry_point: str) -> list[str]:
    """The completion alone, and after its prompt unless it begins with it; none of an empty completion."""
    completion = completion.strip()
    if not completion:
        return []
    bodies = [aliased(completion, [entry_point])]
    if not bodies[0].startswith(prompt.strip()):
        bodies.append(aliased(prompt + bodies[0], [entry_point]))
    return ["\n\n".join((body, test, f"check({entry_point})")) for body in bodies]


def run_program(program: str, seconds: float = 4.0) -> tuple[bool, str]:
    """Whether a program ends well, and up to 300 characters of its error."""
    with tempfile.TemporaryDirectory() as folder:
        try:
            done = subprocess.run([sys.executable, "-I", "-c", program], cwd=folder, capture_output=True, text=True, timeout=seconds, check=False)
        except subprocess.TimeoutExpired:
            return False, "timeout"
    return done.returncode == 0, (done.stderr or "").strip()[-300:]


def execute(rows: DataFrame, program: str, keep: list[str], allow: bool = False, seconds: float = 4.0) -> DataFrame:
    """``keep`` columns, ``passed`` and ``error`` of each row's program, or of its programs in turn until one passes.

    ``program`` is a text or an array of texts; without any, the error is ``empty_code``. ``allow`` must be set: the code is
    not trusted.
    """
    if not allow:
        raise PermissionError("running generated code must be allowed explicitly")

    def tried(programs) -> tuple[bool, str]:
        end = (False, "empty_code")
        for p in [programs] if isinstance(programs, str) else [] if programs is None else programs:
            end = run_program(p, seconds)
            if end[0]:
                break
        return end

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ends = [tried(p) for p in frame[program]]
            yield pd.DataFrame({**{c: frame[c] for c in keep}, "passed": [e[0] for e in ends], "error": [e[1] for e in ends]})

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)
    return rows.select(*keep, program).mapInPandas(run, f"{kept}, passed boolean, error string")
