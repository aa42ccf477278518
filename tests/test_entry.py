"""The entry module with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_imports_without_the_optional_parts(tmp_path):
    for name in ("codeloom", "__spark_entry__.py"):
        src = os.path.join(ROOT, name)
        if os.path.isdir(src):
            shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(src, tmp_path / name)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(q.startswith('op1_') for q in e.queries()))"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    n, m, llm = out.stdout.split()
    assert int(n) > 100
    assert int(m) > 100
    assert llm == "False"


def test_nothing_outside_imports_the_optional_parts():
    for folder, _, files in os.walk(os.path.join(ROOT, "codeloom")):
        if os.sep + "llm" in folder:
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f)) as own:
                    assert "llm" not in own.read(), f


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(5).count() == 5
