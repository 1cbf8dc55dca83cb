"""The entry without the text operators, or without something that they need."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name in {names!r}:
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert set(o) <= set(q) and len(q) > 170 and "pipeline" not in q and not any(k.startswith("op") for k in q), len(q)
"""


@pytest.mark.parametrize("names", [["trajectorium.llm"], ["public_tokenizers"], ["corpus_pipeline"], ["tokenizers", "sentencepiece", "ahocorasick"]])
def test_other_queries_load(names):
    subprocess.run([sys.executable, "-c", CODE.format(names=names)], cwd=ROOT, check=True, env={**os.environ, "PYTHONPATH": ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")}, timeout=120)
