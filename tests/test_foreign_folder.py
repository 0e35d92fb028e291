"""The catalogue must work where this checkout is on no search path: the driver loads the
entry file by path from another folder, with no access to Spark's own jar folder listing."""

import os
import subprocess
import sys
import textwrap

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
    import glob, importlib.util, os, zipfile

    def refuse(*a, **k):
        raise RuntimeError("the jar folder is not to be read")

    glob.glob = zipfile.ZipFile = refuse
    spec = importlib.util.spec_from_file_location("__spark_entry__", os.path.join({root!r}, "__spark_entry__.py"))
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    assert len(entry.oracle_sql()) >= 49

    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "4").getOrCreate())
    for name in {names!r}:      # a noop write runs every column, which count() does not
        entry.queries()[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    print("done")
"""
#: The case queries that run Python on the workers.
PYTHON = ["embed_cases", "similar_dense", "similar_cases_text", "predict_heads"]


def run_elsewhere(tmp_path, names):
    script = tmp_path / "q.py"
    script.write_text(textwrap.dedent(SCRIPT.format(root=ROOT, names=names)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    r = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True,
                       text=True, timeout=900)
    assert r.returncode == 0, r.stderr[-2000:]
    assert r.stdout.strip().endswith("done")


def test_runs_from_another_folder(tmp_path):
    run_elsewhere(tmp_path, PYTHON)


def test_scratch_folder_must_be_shared_off_local():
    from casework.session import is_local

    assert is_local("local") and is_local("local[8]")
    assert not is_local("local-cluster[2,1,1024]") and not is_local("yarn")
