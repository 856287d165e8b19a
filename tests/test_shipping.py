"""Workers that start elsewhere still find the library."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parents[1]
SCRIPT = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import functions as F
from tabloom.operators import stack as S
from tabloom.session import local_session, ship_package
spark = local_session(1, app="elsewhere")
ship_package(spark)
rows = spark.range(60).select((F.col("id") % 5 / 5.0).alias("m"), (F.col("id") % 3 == 0).cast("int").alias("label"), (F.col("id") % 2).cast("int").alias("fold"))
print("rows", S.newton_fits(rows, ["m"], "label", "fold", {{"all": (None, ["m"])}})["all"].rows)
"""


def test_workers_import_the_library_from_any_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 60" in done.stdout, done.stderr[-2000:]
