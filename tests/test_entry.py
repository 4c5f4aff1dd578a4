"""The entry module loads, and names its queries and oracles, before there is a session."""

import os
import subprocess
import sys


def test_entry_needs_no_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 100; from pyspark import SparkContext; assert SparkContext._active_spark_context is None"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
