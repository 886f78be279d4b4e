"""The core stands without the optional parts."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import sys
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] in {names!r} or name in {names!r}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Absent())
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert not any(x.startswith("op") and x[2].isdigit() for x in q) and "pipeline" not in q and set(o) <= set(q) and len(q) > 50
"""


@pytest.mark.parametrize("names", [["public_tokenizers"], ["shelfcast.llm"], ["corpus_pipeline", "shelfcast.llm"]])
def test_entry_without_llm_or_what_it_needs(names):
    done = subprocess.run([sys.executable, "-c", CODE.format(names=names)], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_entry_without_the_pipeline():
    code = CODE.format(names=["corpus_pipeline"]).split("assert")[0] + "assert 'pipeline' not in q"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
