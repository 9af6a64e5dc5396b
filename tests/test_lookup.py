import pytest
from pyspark.sql import functions as F

from medalmart.operators.lookup import HOT_SHARE, estimated_bytes, fits_broadcast, hot_keys, hot_keys_of, key_counts, lookup, unmatched


@pytest.fixture(scope="module")
def big(spark):
    # A third of the rows on key 1, a third without a key, the rest spread; 900.. have no partner.
    key = F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.col("id") % 1000).cast("bigint")
    return spark.range(30_000).select("id", key.alias("ref"))


@pytest.fixture(scope="module")
def small(spark):
    return spark.range(900).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))


@pytest.mark.parametrize("limit", [None, 0])
def test_both_ways_equal_the_plain_join(big, small, limit):
    got = lookup(big, small, ("ref", "k"), {"value": "v"}, found="found", limit=limit)
    want = big.join(small, big.ref == small.k, "left").select("id", "ref", F.col("v").alias("value"), F.col("k").isNotNull().alias("found"))
    assert got.columns == ["id", "ref", "value", "found"]
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_large_side_is_not_broadcast_and_hot_keys_are_few(spark, big, small):
    assert {r.ref for r in hot_keys(key_counts(big, "ref"), "ref").collect()} == {1, None}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert not fits_broadcast(small)
        out = lookup(big, small, ("ref", "k"), {"value": "v"})
        text = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [ref" in text or "ShuffledHashJoin [ref" in text
        assert "BroadcastHashJoin [ref" in text
        # Hot and null rows stay in their four input partitions; the rest is shuffled into four.
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert len(sizes) == 8 and max(sizes) < 30_000 * 0.3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert HOT_SHARE <= 10_000


def test_any_set_of_hot_keys_gives_the_same_rows(spark, big, small):
    narrow = big.select("ref")  # many identical rows
    want = lookup(narrow, small, ("ref", "k"), {"value": "v"}, found="found")
    for keys in ([], [1], [None], [1, None, 5, 950]):
        hot = spark.createDataFrame([(k,) for k in keys], "ref bigint")
        got = lookup(narrow, small, ("ref", "k"), {"value": "v"}, found="found", limit=0, hot=hot)
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_size_check_uses_the_estimate(small):
    assert fits_broadcast(small, estimated_bytes(small)) and not fits_broadcast(small, estimated_bytes(small) - 1)


def test_without_values_only_the_finding_is_added(big, small):
    assert lookup(big, small, ("ref", "k"), {}, found="there").columns == ["id", "ref", "there"]


def test_key_types_must_agree(big, small):
    with pytest.raises(ValueError, match="differ in type"):
        lookup(big, small.withColumn("k", F.col("k").cast("int")), ("ref", "k"), {})


def test_unmatched_counts_rows_and_ignores_nulls(big, small):
    got = {r.ref: r.n for r in unmatched(big, "ref", small, "k").collect()}
    want = {r.ref: r["count"] for r in big.filter("ref >= 900").groupBy("ref").count().collect()}
    assert got == want and want


def test_without_hot_keys_the_large_side_is_read_once(spark, tmp_path):
    # Half of the rows, all equal, have no key; they are dealt over the tasks of the one shuffle.
    ref = F.when(F.col("id") % 2 == 0, (F.col("id") % 5000).cast("string"))
    spark.range(0, 20_000, 1, 16).select(ref.alias("ref")).write.parquet(str(tmp_path / "big"))
    rows = spark.read.parquet(str(tmp_path / "big"))
    keys = spark.range(0, 4000).select(F.col("id").cast("string").alias("k"), "id")
    hot = hot_keys(key_counts(rows, "ref"), "ref", share=100)
    assert [r.ref for r in hot.collect()] == [None]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.files.openCostInBytes", "1g")
    try:
        out = lookup(rows, keys, ("ref", "k"), {"value": "id"}, found="found", limit=0, hot=hot)
        assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
        sizes = [r["count"] for r in out.where("ref IS NULL").groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(sizes) == 10_000 and max(sizes) < 7_000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = rows.join(F.broadcast(keys), rows.ref == keys.k, "left").select("ref", F.col("id").alias("value"), F.col("k").isNotNull().alias("found"))
    assert out.exceptAll(want).isEmpty() and want.exceptAll(out).isEmpty()


@pytest.mark.parametrize("buckets", [1, 7, 16384])
def test_hot_keys_by_buckets_are_those_of_all_counts(spark, big, buckets):
    frames = [
        (big, 1000),
        (big.where("ref IS NOT NULL").select(F.col("ref").cast("string").alias("ref")), 1000),
        (big.where("ref = 1 OR ref > 500"), 10),
        (big.where("ref IS NULL"), 1000),
        (big.where("id < 0"), 1000),
    ]
    for rows, share in frames:
        got = hot_keys_of(rows, "ref", share, buckets)
        want = hot_keys(key_counts(rows, "ref"), "ref", share=share)
        assert got.schema["ref"].dataType == rows.schema["ref"].dataType
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_hot_keys_shuffle_buckets_and_no_keys(spark):
    """Before, every key was shuffled to be counted."""
    rows = spark.range(0, 40_000, 1, 2).select((F.col("id") % 20_000).cast("string").alias("ref"))
    # All 16 buckets are hot, of which no key is: the most that is counted, and still right.
    assert hot_keys_of(rows, "ref", buckets=16).isEmpty()
    found = hot_keys_of(rows, "ref")
    assert found.collect() == []
    final = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "hashpartitioning(__place" in final and "hashpartitioning(ref" not in final
