"""The rest of the library stands without this subpackage."""

from __future__ import annotations

import re
from pathlib import Path

import locusframe


def test_nothing_else_imports_the_subpackage():
    top = Path(locusframe.__file__).parent
    for path in top.rglob("*.py"):
        if "llm" not in path.relative_to(top).parts:
            assert not re.search(r"\bllm\b", path.read_text()), path


def test_native_operators_run_no_python(spark, sf):
    from locusframe.llm.queries import QUERIES

    for name in ("op8_mixing", "op10_secrets"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
