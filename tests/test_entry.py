import subprocess
import sys

import __spark_entry__ as e


def test_entry(spark):
    assert e.entry(spark).count() > 0


def test_library_does_not_need_llm():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("vendorlake.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name, name=".".join(name.split(".")[:2]))
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert "brief_match" in e.queries() and not any(n.startswith("op") and n[2].isdigit() for n in e.queries()) and "pipeline" not in e.queries()
assert set(e.oracle_sql()) <= set(e.queries())
"""
    from conftest import ROOT

    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, capture_output=True)
