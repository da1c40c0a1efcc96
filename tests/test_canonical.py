import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from chronolens.functions import canonical, canonical_sql
from chronolens.plans import catalog

SCHEMA = "zeta string, `Alpha` long, `é\"k` boolean, price decimal(38,18), small decimal(12,6), whole decimal(20,0), day date, at timestamp, bars array<struct<session:date,close:decimal(20,6),tags:array<string>>>, inner struct<b:int,a:struct<x:string>>"


def rows(seed, n):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice('ab"\\\n\r\t\b\f\x00\x01\x1f\x7f\u0085 é😀 /') for _ in range(rng.randrange(12)))

    def number(whole, places):
        return Decimal(rng.choice((1, -1)) * rng.randrange(10 ** rng.randrange(1, whole + places + 1))).scaleb(-places)

    def maybe(value):
        return None if rng.random() < 0.15 else value

    out = []
    for _ in range(n):
        at = dt.datetime(1969, 12, 30, tzinfo=dt.UTC) + dt.timedelta(days=rng.randrange(30_000), microseconds=rng.choice((0, 1, 999_999, 500_000)) + rng.randrange(86_400) * 1_000_000)
        bars = [maybe((maybe(at.date()), maybe(number(14, 6)), maybe([maybe(text()) for _ in range(rng.randrange(3))]))) for _ in range(rng.randrange(4))]
        out.append((maybe(text()), maybe(rng.randrange(-(2**63), 2**63)), maybe(rng.random() < 0.5), maybe(number(20, 18)), maybe(number(6, 6)), maybe(number(20, 0)), maybe(at.date()), maybe(at), maybe(bars), maybe((maybe(rng.randrange(9)), maybe((maybe(text()),))))))
    out.append(("", 0, False, Decimal(0), Decimal("0.000001"), Decimal(0), dt.date(1, 1, 1), dt.datetime(1970, 1, 1, tzinfo=dt.UTC), [], (None, None)))
    out.append(("", 0, False, Decimal("1E-18"), Decimal("-0.5"), Decimal("1E+19"), None, None, None, None))
    out.append(("", 0, False, Decimal("99999999999999999999.999999999999999999"), None, None, None, None, None, None))
    out.append(("", 0, False, Decimal("12345678901.123456789012345675"), None, None, None, None, None, None))
    return out


def plain(row):
    return {k: plain(v) for k, v in row.asDict().items()} if hasattr(row, "asDict") else [plain(x) for x in row] if isinstance(row, list) else row.replace(tzinfo=dt.UTC) if isinstance(row, dt.datetime) else row


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_the_compiled_text_equals_the_plain_one(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame(rows(5, 300), SCHEMA)
        fields = [F.col(f"`{c}`") for c in df.columns]
        got = df.select("*", F.date_format(F.col("at"), "x").alias("offset"), F.unix_micros("at").alias("micros"), canonical_sql.canonical_packet(df, *fields).alias("text")).collect()
        for r in got:
            want = {c: plain(r[c]) for c in df.columns}
            want["at"] = None if r["micros"] is None else dt.datetime(1970, 1, 1, tzinfo=dt.UTC) + dt.timedelta(microseconds=r["micros"])
            assert r["text"] == canonical.canonical_text(want)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_maps_are_objects_and_some_types_are_refused(spark):
    df = spark.createDataFrame([({"b": 1, "a\n": None}, {10: "x", 9: "y"}, 1.5, bytearray(b"x"))], "m map<string,int>, n map<int,string>, f double, b binary")
    assert df.select(canonical_sql.canonical_packet(df, "m", "n")).first()[0] == '{"m":{"a\\n":null,"b":1},"n":{"10":"x","9":"y"}}'
    for bad in (["f"], ["b"], [F.array("f").alias("x")], ["m", F.col("n").alias("m")]):
        with pytest.raises(canonical.UnhashableValueError):
            canonical_sql.canonical_packet(df, *bad)


def test_packets_are_hashed_without_python(spark):
    found = catalog.QUERIES["packet_hash"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and found.count() == 200
