"""The driver's contract."""

import os
import re
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.abspath(entry.__file__))


def test_names_match():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 80


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert [r.selection for r in rows] == ["all", "open", "open_border"]


def test_library_stands_without_llm(tmp_path):
    """With the subpackage and the pipeline gone, all else imports."""
    for d, _, names in os.walk(os.path.join(ROOT, "orograph")):
        for n in names:
            if n.endswith(".py") and f"{os.sep}llm" not in d:
                assert "orograph.llm" not in re.sub(r'""".*?"""', "", open(os.path.join(d, n)).read(), flags=re.S), n
    code = "import shutil, os, sys; r, t = sys.argv[1:]; shutil.copytree(r, t, ignore=shutil.ignore_patterns('.git', 'llm', 'corpus_pipeline.py')); sys.path.insert(0, t); import __spark_entry__ as e; assert len(e.queries()) > 60 and not any(n.startswith('op') or n == 'pipeline' for n in e.queries())"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-B", "-c", code, ROOT, str(tmp_path / "copy")], check=True, cwd=tmp_path, env=env)
