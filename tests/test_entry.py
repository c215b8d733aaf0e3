"""The driver's contract: the flagship runs, every SQL has its query, and the library stands without the corpus operators."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry


def test_flagship(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["region_name", "class", "level", "mv", "holdings"] and frame.count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 340


@pytest.mark.parametrize("gone", [("corpus_pipeline", "ledgerline.llm"), ("ahocorasick",)])
def test_without_the_corpus_operators(tmp_path, gone):
    root = Path(__file__).resolve().parents[1]
    code = f"""
import sys
GONE = {gone!r}
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name in GONE:
            raise ModuleNotFoundError(name)
sys.path.insert(0, {str(root)!r})
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert not any(n.startswith("op") or n == "pipeline" for n in e.queries()) and len(e.queries()) > 330
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)
