"""The library works without its optional training-data part."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_imports_without_the_optional_part(tmp_path):
    skip = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", "spark-warehouse")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=skip)
    code = ("import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); "
            "assert not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q); "
            "assert 'engineer_features' in q and set(s) <= set(q); "
            "from txsentinel.session import get_session; "
            "spark = get_session('local[2]', shuffle_partitions=2, extra_conf={'spark.ui.enabled': 'false'}); "
            "assert q['engineer_features'](spark, '/root/testdata/sf0.001').count() == 1000")
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
