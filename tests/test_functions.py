import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from medalmart.functions import (
    band,
    canonical_name,
    compose_timestamp,
    hash_key,
    matched_format,
    parse_date,
    variant_kind,
    variant_text,
    whole_years,
)

FORMATS = ["yyyy-MM-dd", "dd/MM/yyyy"]


def expected_key(text):
    return int(hashlib.sha256(text.encode()).hexdigest()[:15], 16)


def test_hash_key_follows_the_digest(spark):
    df = spark.createDataFrame([("a",), ("",), (None,)], "k string")
    got = [r[0] for r in df.select(hash_key("k")).collect()]
    assert got == [expected_key("a"), expected_key(""), None]
    number = spark.createDataFrame([(42,)], "k bigint").select(hash_key("k")).first()[0]
    assert number == expected_key("42")


def test_composite_key_parts_do_not_run_together(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), ("a\\", "b"), ("a", None)], "x string, y string")
    got = [r[0] for r in df.select(hash_key("x", "y")).collect()]
    assert len(set(got[:3])) == 3
    assert got[3] is None


def test_dates_need_the_whole_pattern(spark):
    texts = ["2025-03-22", "22/03/2025", "2025-3-2", "", "2025-02-30", "2025-03-1 ", "2025-03-22 10:00", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(parse_date("t", FORMATS), matched_format("t", FORMATS), parse_date("t"), F.try_to_date("t", "yyyy-MM-dd")).collect()
    day = dt.date(2025, 3, 22)
    assert [r[0] for r in rows] == [day, day] + [None] * 6
    assert [r[1] for r in rows] == ["yyyy-MM-dd", "dd/MM/yyyy"] + [None] * 6
    # The quick way to read the norm agrees with the pattern parser.
    assert [r[2] for r in rows] == [r[3] for r in rows]


def test_timestamp_needs_both_parts(spark):
    df = spark.createDataFrame([("2025-01-02", "03:04:05"), ("2025-01-02", None), (None, "03:04:05"), ("2025-01-02", "25:00:00")], "d string, t string")
    got = [r[0] for r in df.select(compose_timestamp(parse_date("d"), F.col("t")).cast("string")).collect()]
    assert got == ["2025-01-02 03:04:05", None, None, None]


@pytest.mark.parametrize(
    "age,label",
    [(17, None), (18, "18-25"), (25, "18-25"), (26, "26-35"), (36, "36-45"), (46, "46-55"), (56, "56-65"), (64, "56-65"), (65, "65+"), (None, None)],
)
def test_bands(spark, age, label):
    df = spark.createDataFrame([(age,)], "a int")
    assert df.select(band(F.col("a"))).first()[0] == label


def test_whole_years_use_the_mean_year(spark):
    df = spark.createDataFrame([(dt.date(2000, 1, 1),)], "d date")
    ages = [df.select(whole_years("d", u)).first()[0] for u in (dt.date(2018, 1, 1), dt.date(2018, 1, 2), dt.date(1999, 12, 31))]
    assert ages == [18, 18, -1]
    assert df.select(whole_years("d", dt.date(2001, 1, 1))).first()[0] == 1


def test_canonical_names(spark):
    df = spark.createDataFrame([(" kwazulu-natal",), ("WESTERN   CAPE",), ("kzn",), ("Atlantis",), (None,)], "p string")
    got = [r[0] for r in df.select(canonical_name("p", ["KwaZulu-Natal", "Western Cape"], {"KZN": "KwaZulu-Natal"})).collect()]
    assert got == ["KwaZulu-Natal", "Western Cape", "KwaZulu-Natal", "Atlantis", None]


def test_variants_keep_digits_and_kind(spark):
    docs = ["12345678901234.56", '"12.5"', "1e3", "null", "true", None]
    df = spark.createDataFrame([(d,) for d in docs], "d string").select(F.parse_json("d").alias("v"))
    rows = df.select(variant_text("v"), variant_kind("v")).collect()
    assert [r[0] for r in rows] == ["12345678901234.56", "12.5", "1000", None, "true", None] or rows[2][0] == "1000.0"
    assert [r[1] for r in rows] == ["NUMBER", "STRING", "NUMBER", None, "BOOLEAN", None]


def test_timestamps_do_not_depend_on_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        df = spark.createDataFrame([("2025-03-09", "02:30:00"), ("2025-03-09", "25:61:00")], "d string, t string")
        made = []
        for z in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", z)
            made.append([r[0] for r in df.select(F.unix_timestamp(compose_timestamp(F.col("d").cast("date"), F.col("t")))).collect()])
        assert made[0] == made[1] == [1741487400, None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_quick_days_and_times_agree_with_the_pattern(spark):
    days = ["2024-02-29", "2023-02-29", "2024-1-01", "2024-01-1 ", "2024-01-1T", " 2024-1-1", "12345-1-02", "+10000-01-01", "-0001-01-01", "0000-01-01", "٢٠٢٤-٠١-٠١", None]
    times = ["00:00:00", "23:59:59", "24:00:00", "9:05:05", "12:30:60", "12:30:4Z", "12:30:05 ", "12:30:+5", "12:30:05\n", "١٢:30:05", "", None]
    df = spark.createDataFrame([(d, t) for d in days for t in times], "d string, t string")
    date = F.col("d").try_cast("date")
    whole = F.concat(date.cast("string"), F.lit(" "), F.col("t"), F.lit("+00:00"))
    rows = df.select(
        "d",
        parse_date("d").cast("string").alias("day"),
        (date.cast("string") == F.col("d")).alias("is_norm"),
        F.unix_micros(compose_timestamp(date, F.col("t"))).alias("at"),
        F.unix_micros(F.try_to_timestamp(whole, F.lit("yyyy-MM-dd HH:mm:ssxxx"))).alias("parsed"),
    ).collect()
    assert all(r.day == (r.d if r.is_norm else None) for r in rows)
    assert [r.at for r in rows] == [r.parsed for r in rows] and any(r.at is not None for r in rows)
