"""queries() and oracle_sql() load in a fresh process that finds no Spark jar and no test data."""

import subprocess
import sys
from pathlib import Path

from tessera.functions.text import english_stop_words

ROOT = Path(__file__).resolve().parent.parent

SCRIPT = """
import builtins, glob, zipfile
glob.glob = lambda *a, **k: []
def refuse(*a, **k):
    raise OSError("no archive may be opened at import")
zipfile.ZipFile = refuse
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert len(q) >= 100 and set(o) <= set(q)
"""


def test_registry_loads_without_jars(tmp_path):
    got = subprocess.run([sys.executable, "-B", "-c", SCRIPT], cwd=tmp_path, capture_output=True, text=True,
                         env={"PYTHONPATH": str(ROOT), "PATH": "/usr/bin:/bin"})
    assert got.returncode == 0, got.stderr[-800:]


def test_stop_words_are_complete():
    words = english_stop_words()
    assert len(words) == len(set(words)) == 181
    assert {"i", "the", "cannot", "would"} <= set(words)
