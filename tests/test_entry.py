"""The driver's contract: names, and an import that does without the training-data operators."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

WITHOUT = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("loomspark.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import importlib.util
real = importlib.util.find_spec
importlib.util.find_spec = lambda name, *a: None if name.startswith("loomspark.llm") or name == "corpus_pipeline" else real(name, *a)
import __spark_entry__ as e
assert "m0_region_markers" in e.queries() and set(e.oracle_sql()) <= set(e.queries())
assert not [n for n in e.queries() if n.startswith("op") or n == "pipeline"]
"""


def test_names():
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "m0_region_markers" in entry.queries()


def test_import_without_training_data_operators():
    done = subprocess.run([sys.executable, "-c", WITHOUT], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_them():
    for source in (ROOT / "loomspark").rglob("*.py"):
        if "llm" not in source.relative_to(ROOT).parts:
            assert "loomspark.llm" not in source.read_text(), source
