"""The tensor data source: reads by key, ranges, commits and aborts."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.sources import tensor_source, tensors


@pytest.fixture(scope="module")
def given(spark):
    tensor_source.register(spark)
    rng = np.random.default_rng(1)
    return [(f"{'enc' if i % 2 else 'dec'}.{i}.weight", [2, 3, i + 1], [float(np.float32(x)) for x in rng.normal(size=6 * (i + 1))]) for i in range(12)] + [("empty", [0], [])]


def table(spark, given):
    return spark.createDataFrame(given, "key string, shape array<int>, data array<float>").withColumn("path", F.lit("-"))


def rows(df):
    return sorted((r["key"], list(r["shape"]), list(r["data"])) for r in df.collect())


def test_round_trip_and_keys(spark, given, tmp_path):
    path = f"{tmp_path}/t"
    table(spark, given).repartition(3).write.format("tensors").option("file", 200).mode("append").save(path)
    names = os.listdir(path)
    assert len(names) > 3 and all(n.endswith(".safetensors") for n in names)
    read = spark.read.format("tensors")
    assert rows(read.load(path)) == sorted(given)
    assert rows(read.load(path)) == rows(tensors.read_safetensors(spark, f"{path}/*.safetensors"))
    assert [k for k, _, _ in rows(spark.read.format("tensors").option("keys", "enc.1.weight,dec.4.weight,none").load(path))] == ["dec.4.weight", "enc.1.weight"]
    assert len(rows(spark.read.format("tensors").option("prefix", "enc.").load(path))) == 6
    # another write is added; an overwrite takes the place of both
    table(spark, given[:2]).write.format("tensors").mode("append").save(path)
    assert len(rows(spark.read.format("tensors").load(path))) == len(given) + 2
    table(spark, given[:1]).write.format("tensors").mode("overwrite").save(path)
    assert rows(spark.read.format("tensors").load(path)) == [given[0]]


def test_filters_reach_the_header(spark, given, tmp_path):
    path = f"{tmp_path}/t"
    table(spark, given).coalesce(1).write.format("tensors").mode("append").save(path)
    reader = tensor_source.TensorReader({"path": path, "range": "60"})
    assert len(reader.partitions()) > 5 and sum(len(p.tensors) for p in reader.partitions()) == len(given)
    left = list(reader.pushFilters([tensor_source.StringStartsWith(("key",), "enc."), tensor_source.In(("key",), ("enc.1.weight", "dec.2.weight")), tensor_source.EqualTo(("path",), "x")]))
    assert left == [tensor_source.EqualTo(("path",), "x")] and [t[0] for p in reader.partitions() for t in p.tensors] == ["enc.1.weight"]
    found = spark.read.format("tensors").load(path)
    assert rows(found.where("key = 'enc.3.weight'")) == [given[3]]
    assert rows(found.where("key LIKE 'dec.%' AND size(shape) = 3")) == sorted(g for g in given if g[0].startswith("dec"))


def test_a_failed_task_leaves_no_file(spark, given, tmp_path):
    path = f"{tmp_path}/t"
    table(spark, given[:3]).coalesce(1).write.format("tensors").mode("append").save(path)
    before = sorted(os.listdir(path))
    bad = table(spark, given).repartition(4, "key").withColumn("shape", F.when(F.col("key") == "dec.6.weight", F.raise_error(F.lit("bad tensor")).cast("array<int>")).otherwise(F.col("shape")))
    with pytest.raises(Exception, match="bad tensor"):
        bad.write.format("tensors").option("file", 100).mode("append").save(path)
    assert sorted(os.listdir(path)) == before


def test_layout_is_checked(spark, given, tmp_path):
    (tmp_path / "x.safetensors").write_bytes(tensors.encode([("a", [1], np.ones(1))], layout="other"))
    with pytest.raises(ValueError, match="Unsupported weight_layout"):
        tensor_source.TensorReader({"path": f"{tmp_path}/x.safetensors"}).partitions()
