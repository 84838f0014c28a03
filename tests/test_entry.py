"""The entry module works without the training-data operators."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
BLOCK = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("dealscope.llm"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
names = set(e.queries())
assert "cross_board" in names and "pipeline" not in names and not any(n.startswith("op") and n[2:3].isdigit() for n in names)
assert set(e.oracle_sql()) <= names
"""


def test_entry_without_the_subpackage():
    subprocess.run([sys.executable, "-c", BLOCK], cwd=ROOT, check=True, env=os.environ | {"PYTHONPATH": ROOT})
