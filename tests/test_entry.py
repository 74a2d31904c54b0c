"""The entry points stand without the optional part."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
SCRIPT = """
import sys
sys.modules[{missing!r}] = None
import __spark_entry__ as entry
from hyperloom import queries
assert not entry.HAS_LLM
assert set(entry.queries()) == set(queries.QUERIES) and set(entry.oracle_sql()) == set(queries.SQL)
"""


def without(missing: str) -> None:
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(missing=missing)], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_without_the_subpackage():
    without("hyperloom.llm")


def test_without_a_library_that_only_the_subpackage_needs():
    without("xxhash")


def test_without_the_pipeline():
    without("corpus_pipeline")
