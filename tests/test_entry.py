"""The driver contract, with and without the corpus operators."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
CODE = """
import sys
for name in {missing}:
    sys.modules[name] = None
import __spark_entry__ as e
print(len(e.queries()), "pipeline" in e.queries(), set(e.oracle_sql()) <= set(e.queries()))
"""


def run(missing):
    out = subprocess.run([sys.executable, "-c", CODE.format(missing=missing)], cwd=ROOT, capture_output=True, text=True, check=True)
    return out.stdout.split()


def test_catalogue_stands_alone():
    n, pipeline, sound = run(["furrow.llm", "corpus_pipeline"])
    assert int(n) > 80 and (pipeline, sound) == ("False", "True")


def test_entry_query(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
