"""What the entry module hides, and what it doesn't."""

import os
import subprocess
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.mark.parametrize("name", ["ahocorasick", "xxhash", "tidemark.llm.mixing"])
def test_missing_dependency_is_an_error(name):
    """Only an absent subpackage or pipeline is passed over in silence."""
    code = f"import sys; sys.path.insert(0, {HERE!r}); sys.modules[{name!r}] = None; import __spark_entry__"
    got = subprocess.run([sys.executable, "-B", "-c", code], capture_output=True, text=True, timeout=120, cwd=HERE)
    assert got.returncode != 0 and name.rsplit(".", 1)[-1] in got.stderr


def test_absent_pipeline_is_passed_over():
    code = f"import sys; sys.path.insert(0, {HERE!r}); sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'asof_head' in e.queries() and 'pipeline' not in e.queries()"
    assert subprocess.run([sys.executable, "-B", "-c", code], timeout=120, cwd=HERE).returncode == 0
