"""Point files through the data source: pieces, numbers of points, filters, both formats, and writing that is all or nothing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from volreg.sources import pointfiles


@pytest.fixture(scope="module")
def cloud(spark):
    return spark.range(20000).select((F.col("id") % 997 / 4).alias("x"), (F.col("id") % 31 - 400.0).alias("y"), (F.col("id") / 1000).alias("z"), (F.col("id") % 7).cast("smallint").alias("classification"), (F.col("id") % 300).cast("int").alias("intensity"), (F.col("id") % 3 + 1).cast("smallint").alias("return_number"))


def rows(df):
    return sorted(tuple(round(v, 3) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_round_trip_in_pieces(spark, cloud, tmp_path):
    at = str(tmp_path / "las")
    pointfiles.write(cloud.repartition(3), at, pointsPerFile=5000)
    files = sorted(x.name for x in (tmp_path / "las").iterdir())
    assert len(files) == 6 and not any(x.startswith("_") for x in files)
    whole, pieces = pointfiles.read(spark, at), pointfiles.read(spark, at, bytesPerPartition=30_000)
    assert pieces.rdd.getNumPartitions() > 20 > whole.rdd.getNumPartitions()
    assert rows(whole.drop("pid")) == rows(cloud)
    assert rows(whole) == rows(pieces)  # numbers of points do not depend on pieces
    assert whole.select("pid").distinct().count() == 20000
    few = pointfiles.read(spark, at, schema="z double, pid long")
    assert few.columns == ["z", "pid"] and few.count() == 20000
    with pytest.raises(Exception, match="no such fields"):
        pointfiles.read(spark, at, schema="x int").collect()


def test_files_are_pruned_by_their_box(spark, cloud, tmp_path):
    at = str(tmp_path / "las")
    for k in range(4):
        pointfiles.write(cloud.where(F.floor(F.col("z") / 5) == k).coalesce(1), at)
    (tmp_path / "las" / "broken.las").write_bytes(b"LASF" + bytes(10))
    with pytest.raises(Exception, match="not a LAS file"):
        pointfiles.read(spark, at).collect()
    (tmp_path / "las" / "broken.las").unlink()
    # a file whose points are cut off can only be left out
    first = next(x for x in sorted((tmp_path / "las").iterdir()) if pointfiles._Header.of(x.read_bytes()[:375], "").high[2] < 5)
    first.write_bytes(first.read_bytes()[:375])
    assert pointfiles.read(spark, at, z0=6.0).where("z >= 6").count() == 14000
    assert pointfiles.read(spark, at).where("z >= 6 and z < 8").count() == 2000


@pytest.mark.parametrize("order", ["C", "F"])
def test_npy(spark, tmp_path, order):
    a = np.arange(4000.0).reshape(1000, 4)
    a[:, 3] %= 9
    np.save(tmp_path / "p.npy", np.asarray(a, order=order))
    got = pointfiles.read(spark, str(tmp_path / "p.npy"), bytesPerPartition=5000).orderBy("pid").collect()
    assert [(r.x, r.y, r.z, r.classification) for r in got] == [tuple(x) for x in a.tolist()] and got[0].intensity is None and [r.pid for r in got] == list(range(1000))


def test_a_failed_write_leaves_nothing(spark, cloud, tmp_path):
    at = tmp_path / "las"
    with pytest.raises(Exception, match="too far"):
        pointfiles.write(cloud.withColumn("x", F.when(F.col("z") > 19, 1e9).otherwise(F.col("x"))).coalesce(2), str(at))
    assert not at.exists() or not list(at.iterdir())
