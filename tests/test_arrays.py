"""Arrays by split: round trip, what numpy sees, failed tasks."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from modcall.sources.arrays import manifest, read_arrays, write_arrays


def rows_of(spark, n=500):
    rows = spark.range(n).select("id", F.when(F.col("id") % 5 < 3, "train").when(F.col("id") % 5 == 3, "validation").otherwise("test").alias("split"), (F.col("id") % 2).alias("label"))
    nested = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.array(F.col("id") + i, F.lit(0.5)))
    return rows.withColumn("features", nested.cast("array<array<double>>")).repartition(3)


def test_round_trip_of_all_splits(spark, tmp_path):
    rows, path = rows_of(spark), f"file://{tmp_path}/a"
    write_arrays(rows, path, limit=64)
    want = sorted((r.split, float(r.label), 1.0, [float(x) for pair in r.features for x in pair]) for r in rows.collect())
    assert sorted(map(tuple, read_arrays(spark, path).collect())) == want
    listed = manifest(path)
    assert {s: sum(x["rows"] for x in listed if x["split"] == s) for s in ("train", "validation", "test")} == {"train": 300, "validation": 100, "test": 100}
    assert max(x["rows"] for x in listed) <= 64 and len(listed) >= 9
    for x in listed:
        data, labels = (np.load(f"{tmp_path}/a/{x['file']}-{kind}.npy") for kind in ("data", "labels"))
        assert data.shape == (x["rows"], 8) and data.dtype == np.float32 and labels.shape == (x["rows"],)


def test_a_failed_task_leaves_nothing_to_read(spark, tmp_path):
    broken = rows_of(spark).withColumn("features", F.when(F.col("id") == 77, F.array(F.array(F.lit(1.0)))).otherwise(F.col("features")))
    with pytest.raises(Exception, match="different numbers"):
        write_arrays(broken, f"file://{tmp_path}/b", limit=200)
    with pytest.raises(FileNotFoundError):
        manifest(f"file://{tmp_path}/b")
    assert not [p for p in tmp_path.glob("b/**/*") if p.is_file() and not p.name.startswith(".")]
    with pytest.raises(Exception, match="without split"):
        write_arrays(rows_of(spark).withColumn("split", F.lit(None).cast("string")), f"file://{tmp_path}/c")


def test_no_rows(spark, tmp_path):
    write_arrays(rows_of(spark).limit(0), f"file://{tmp_path}/e")
    assert json.loads((tmp_path / "e" / "manifest.json").read_text()) == [] and read_arrays(spark, f"file://{tmp_path}/e").count() == 0
