"""The shared folder of a session that names none."""

import os
import subprocess
import sys

SCRIPT = """
from tidewatch.session import build_session, cut_lineage, scratch_path, shared_folder
spark = build_session("bare", "local[2]", 2)
assert spark.conf.get("spark.checkpoint.dir", None) is None
path = scratch_path(spark, "table")
spark.range(5).write.parquet(path)
assert spark.read.parquet(path).count() == 5 and path.startswith(shared_folder(spark))
assert cut_lineage(spark.range(3)).count() == 3 and shared_folder(spark) == shared_folder(spark)
spark.stop()
print("fine")
"""


def test_a_local_session_without_the_setting(tmp_path):
    env = {k: v for k, v in os.environ.items() if "SPARK" not in k} | {"TMPDIR": str(tmp_path)}
    (tmp_path / "conf").mkdir()  # no defaults file either
    env["SPARK_CONF_DIR"] = str(tmp_path / "conf")
    env["PYSPARK_SUBMIT_ARGS"] = "--conf spark.ui.enabled=false pyspark-shell"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=root, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0 and "fine" in done.stdout, done.stderr[-2000:]
