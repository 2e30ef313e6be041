"""Scratch tables go with their scope, or with the process."""

import glob
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from panelspark.operators.label import entity_split
from panelspark.sources.scratch import scratch_scope


def folders(spark):
    return set(glob.glob(spark.conf.get("spark.checkpoint.dir").removeprefix("file://") + "/*"))


def test_scopes_delete_what_was_written_in_them(spark):
    df = spark.range(100).select(F.col("id").alias("entity_id"), F.lit(1).alias("step"))
    before = folders(spark)
    with scratch_scope():
        kept = entity_split(df).collect()
        inside = folders(spark)
        with scratch_scope():
            assert entity_split(df).count() == 100
        assert folders(spark) == inside
    assert len(kept) == 100 and inside > before and folders(spark) == before
    with pytest.raises(ValueError), scratch_scope():
        entity_split(df).count()
        raise ValueError
    assert folders(spark) == before


def test_a_process_leaves_nothing(tmp_path):
    code = f"""
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}/shared").config("spark.sql.shuffle.partitions", "1").getOrCreate()
from panelspark.operators.label import entity_split
assert entity_split(spark.range(9).select(F.col("id").alias("entity_id"), F.lit(1).alias("step"))).count() == 9
import os
assert os.listdir("{tmp_path}/shared")
spark.stop()
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], check=True, env=os.environ | {"PYTHONPATH": root}, capture_output=True, timeout=300)
    assert not [f for f in (tmp_path / "shared").rglob("*") if f.is_file()]  # Spark itself makes an empty folder
