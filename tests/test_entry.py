"""The driver's contract."""

import subprocess
import sys

import __spark_entry__ as entry


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "rank", "word", "cnt"] and df.count() > 0


def test_sql_names_are_query_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_works_without_the_llm_subpackage():
    code = """
import sys
class Gone:
    def find_spec(self, name, *a):
        if name == "corpus_pipeline" or name.startswith("corpuslake.llm"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert "top_content_words" in e.queries() and not any(q.startswith("op") and q[2].isdigit() for q in e.queries()) and "pipeline" not in e.queries()
import corpuslake.sources, corpuslake.streaming, corpuslake.schemas, corpuslake.operators.repair
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
