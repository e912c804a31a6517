"""The entry point with and without the parts that may be removed."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

HIDDEN = """
import sys
class Hide:
    def find_spec(self, name, path=None, target=None):
        if name == "variorum.llm" or name.startswith("variorum.llm."):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Hide())
import __spark_entry__ as E
names = set(E.queries())
assert "unit_instability" in names and "pipeline" not in names and not any(n.startswith("op") and n[2].isdigit() for n in names), names
assert set(E.oracle_sql()) <= names
"""


def test_other_queries_stay_without_the_subpackage():
    done = subprocess.run([sys.executable, "-c", HIDDEN], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
