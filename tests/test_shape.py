from pyspark.sql import functions as F

from medalmart.operators.shape import align, drift, flatten, project, schema_report
from medalmart.sources.readers import read_csv, read_jsonl, undeclared_fields


def test_align_adds_typed_nulls_and_keeps_extras(spark):
    df = spark.createDataFrame([(1, "x")], "b int, z string")
    out = align(df, "a date, b int")
    assert out.dtypes == [("a", "date"), ("b", "int"), ("z", "string")]
    assert align(df, "a date, b int", keep_extra=False).columns == ["a", "b"]
    found = drift(df, "a date, b int")
    assert found.missing == ("a",) and found.extra == ("z",) and found


def test_flatten_passes_over_what_is_absent(spark):
    df = spark.sql("select 1 as id, 'outer' as city, named_struct('city', 'inner', 'zip', '1') as loc")
    out = flatten(df, {"loc": ["city", "zip", "gone"], "other": ["x"]})
    assert out.columns == ["id", "city", "loc_city", "zip", "gone"]
    assert out.first().asDict() == {"id": 1, "city": "outer", "loc_city": "inner", "zip": "1", "gone": None}
    assert flatten(df, {"loc": ["zip"]}, prefix=True).columns == ["id", "city", "loc_zip"]


def test_project_and_schema_report(spark):
    df = spark.createDataFrame([(1, "x", 2)], "a int, b string, c int")
    assert project(df, "b string, a bigint").dtypes == [("b", "string"), ("a", "bigint")]
    rows = {r.column_name: r for r in schema_report(df, "a int, c int, d date").collect()}
    assert rows["a"].conforms and not rows["c"].conforms
    assert rows["d"].found_position is None and rows["b"].expected_position is None


def test_csv_follows_its_header(spark, tmp_path):
    (tmp_path / "x.csv").write_text("b,new,a\n2,n,1\n3\n", encoding="utf-8")
    df = read_csv(spark, str(tmp_path / "x.csv"), "a string, b string, c string")
    assert df.columns == ["a", "b", "c", "new", "_corrupt_record"]
    good, bad = df.orderBy("b").collect()
    assert (good.a, good.b, good.c, good.new, good._corrupt_record) == ("1", "2", None, "n", None)
    assert bad._corrupt_record == "3"


def test_jsonl_is_read_without_inference(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id":"1","v":1.50,"more":1}\n{"id":"2","v":"1.5"}\nnope\n', encoding="utf-8")
    path = str(tmp_path / "x.jsonl")
    rows = read_jsonl(spark, path, "id string, v variant").orderBy(F.col("id").asc_nulls_last()).collect()
    assert [(r.id, r.v_kind) for r in rows] == [("1", "NUMBER"), ("2", "STRING"), (None, None)]
    assert rows[2]._corrupt_record == "nope"
    assert [r._undeclared for r in rows] == [{"more": "1"}, None, None]
    assert [tuple(r) for r in undeclared_fields(read_jsonl(spark, path, "id string, v variant")).collect()] == [("more", 1)]


def test_jsonl_keeps_what_does_not_fit(spark, tmp_path):
    lines = ['{"id":"1","flag":"maybe","new":{"a":[1,2]},"other":null}', '{"id":"2","place":"nowhere"}', '{"id":"3","flag":true,"place":{"x":"y"}}', ""]
    (tmp_path / "x.jsonl").write_text("\n".join(lines) + "\n", encoding="utf-8")
    rows = read_jsonl(spark, str(tmp_path / "x.jsonl"), "id string, flag boolean, place struct<x:string>").orderBy("id").collect()
    assert [r.id for r in rows] == ["1", "2", "3"]
    assert [r._corrupt_record for r in rows] == [lines[0], lines[1], None]
    assert rows[0]._undeclared == {"new": '{"a":[1,2]}', "other": None} and rows[2].place.x == "y"
