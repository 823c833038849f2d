"""The entry module must import without Spark's jars, a JVM or a fixed install layout."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_and_oracles_need_no_jars():
    code = (
        "import glob, zipfile, __spark_entry__ as e\n"
        "assert len(e.queries()) >= 60 and set(e.oracle_sql()) <= set(e.queries())\n"
    )
    hide = "import glob, zipfile\nglob.glob = lambda *a, **k: []\nzipfile.ZipFile = None\n"
    env = os.environ | {"PYTHONPATH": ROOT, "JAVA_HOME": "/nonexistent", "SPARK_HOME": "/nonexistent"}
    out = subprocess.run([sys.executable, "-c", hide + code], env=env, cwd="/", capture_output=True, text=True)
    assert out.returncode == 0, out.stderr


def test_stop_words_equal_sparks_list(spark):
    from pyspark.ml.feature import StopWordsRemover

    from gazette.dims import ENGLISH_STOP_WORDS
    assert list(StopWordsRemover.loadDefaultStopWords("english")) == ENGLISH_STOP_WORDS
