import pytest
from pyspark.sql import functions as F

from medalmart.operators.checks import agreement_check, reference_check
from medalmart.sources.layout import BUCKET_BYTES, FEWEST, buckets_for, linked, read_by_key, unlinked_keys, write_by_key
from medalmart.sources.readers import read_table

ROWS = "k string, id long, v string"


@pytest.fixture()
def still(spark):
    """Broadcasts are off, so that joins show what moves."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


@pytest.fixture()
def layer(spark, tmp_path, still):
    """Facts of 60 keys, of which ``h`` has a third of the rows and some rows none, and 50 parents."""
    key = F.when(F.col("id") % 3 == 0, "h").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("k"), F.col("id") % 60))
    facts = spark.range(900).select(key.alias("k"), "id", F.concat(F.lit("v"), F.col("id") % 7).alias("v"))
    dims = spark.range(50).select(F.concat(F.lit("k"), "id").alias("k"), F.concat(F.lit("v"), F.col("id") % 7).alias("w")).unionByName(spark.sql("SELECT 'h' AS k, 'v0' AS w"))
    write_by_key(facts, str(tmp_path / "f"), "k", 8, ["id"], hot=["h", None])
    write_by_key(dims, str(tmp_path / "d"), "k", 8, ["k"], hot=())
    return read_by_key(spark, str(tmp_path / "f")), read_by_key(spark, str(tmp_path / "d")), facts, dims, tmp_path


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(str, df.collect()))


def test_nothing_is_lost_and_hot_keys_lie_apart(spark, layer):
    by, _, facts, _, path = layer
    assert rows(by.frame) == rows(facts) and rows(by.cold.unionByName(by.hot)) == rows(facts)
    assert {r.k for r in by.hot.select("k").distinct().collect()} == {"h", None} and by.hot_keys == ("h",)
    assert by.cold.where("k IS NULL OR k = 'h'").isEmpty()
    assert rows(read_table(spark, str(path / "f"))) == rows(facts)
    # Hot rows are spread: no file has half of them.
    sizes = [r["count"] for r in by.hot.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) > 4 and max(sizes) * 2 < sum(sizes)
    # Each bucket of the others is one file.
    assert len(list((path / "f" / "__hot=false").glob("part-*"))) <= 8


def test_links_move_no_fact(layer):
    by, dims, facts, parents, _ = layer
    got = linked(by, dims, "k", {"w": "w"}, found="there")
    assert "Exchange hashpartitioning" not in plan(got) and "BroadcastHashJoin" in plan(got)
    want = facts.join(parents, "k", "left").select("k", "id", "v", "w", F.col("w").isNotNull().alias("there"))
    assert rows(got) == rows(want)


def test_checks_move_no_fact(layer):
    by, dims, facts, parents, _ = layer
    for check in (reference_check({"x": (by.cold, "k", dims.keyed, "k")}), agreement_check(by.cold, "k", "v", dims.keyed, "k", "w")):
        assert "Exchange hashpartitioning" not in plan(check)
    got = unlinked_keys(by, dims, "k")
    want = facts.where("k IS NOT NULL").join(parents, "k", "left_anti").groupBy("k").agg(F.count("*").alias("n"))
    assert rows(got) == rows(want) and got.count()


def test_hot_keys_are_found(spark, tmp_path):
    many = spark.range(4000).select(F.when(F.col("id") < 1300, 7).otherwise(F.col("id")).cast("int").alias("k"), "id")
    seen = write_by_key(many, str(tmp_path / "t"), "k", 8, ["id"], metrics=[F.max("id").alias("most")])
    assert seen == {"rows": 4000, "most": 3999}
    by = read_by_key(spark, str(tmp_path / "t"))
    assert by.hot_keys == (7,) and by.hot.count() == 1300 and by.frame.count() == 4000


def test_helpers_serve_metrics_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    seen = write_by_key(spark.createDataFrame([("a", 1, "x")], ROWS), path, "k", 8, ["id"], hot=(), metrics=[F.count_if(F.col("v") == "x").alias("x")], helpers=["v"])
    assert seen == {"rows": 1, "x": 1} and read_table(spark, path).columns == ["k", "id"]


def test_empty_tables(spark, tmp_path):
    path, none = str(tmp_path / "t"), spark.createDataFrame([], ROWS)
    assert write_by_key(none, path, "k", 8, ["id"]) == {"rows": 0}
    by = read_by_key(spark, path)
    assert by.frame.isEmpty() and by.frame.schema == none.schema and linked(by, by, "k", {"w": "v"}).isEmpty()
    assert read_by_key(spark, str(tmp_path / "absent")) is None


def test_a_failed_job_leaves_the_last_table(spark, layer):
    _, _, facts, _, path = layer
    broken = facts.withColumn("v", F.when(F.col("id") == 59, F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        write_by_key(broken, str(path / "f"), "k", 8, ["id"], hot=())
    assert read_table(spark, str(path / "f")).count() == 900
    # It may be read by the write itself; another key and number of buckets are told by the mark.
    write_by_key(read_table(spark, str(path / "f")).where("id < 45"), str(path / "f"), "v", 4, ["id"], hot=())
    again = read_by_key(spark, str(path / "f"))
    assert (again.key, again.buckets, again.frame.count(), again.cold.count()) == ("v", 4, 45, 45)


def test_keys_of_other_types_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="double"):
        write_by_key(spark.range(3).select(F.col("id").cast("double").alias("k")), str(tmp_path / "t"), "k", 8, ["k"], hot=())
    with pytest.raises(ValueError, match="delta"):
        write_by_key(spark.range(3), str(tmp_path / "t"), "id", 8, ["id"], fmt="delta")


def test_buckets_follow_the_largest_table(monkeypatch):
    from medalmart.sources import layout

    monkeypatch.setattr(layout, "estimated_bytes", lambda df: df)
    assert buckets_for(1, 2) == FEWEST
    assert buckets_for(1, 100 * BUCKET_BYTES) == 128
    assert buckets_for(10**18) == layout.MOST
