"""The entry module with and without its optional part."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

HIDDEN = """
import sys

class Hide:
    def find_spec(self, name, path=None, target=None):
        if any(name == h or name.startswith(h + ".") for h in {hidden!r}):
            raise ModuleNotFoundError(name)

sys.meta_path.insert(0, Hide())
import __spark_entry__ as e
print(*sorted(e.queries()))
assert set(e.oracle_sql()) <= set(e.queries())
"""


def names(*hidden):
    got = subprocess.run([sys.executable, "-B", "-c", HIDDEN.format(hidden=hidden)], cwd=ROOT, capture_output=True, text=True)
    assert got.returncode == 0, got.stderr
    return set(got.stdout.split())


def test_without_the_optional_part():
    rest = names("codestrata.llm", "corpus_pipeline")
    assert "duplicate_report" in rest and not any(n == "pipeline" or n.startswith("op") for n in rest)
    assert names("codestrata.llm") == rest          # the pipeline can't be imported either
    assert names("regex") >= rest                   # nor what needs a missing package


def test_every_query_outside_the_optional_part_stays():
    rest = names("codestrata.llm", "corpus_pipeline")
    whole = names()
    assert rest <= whole
