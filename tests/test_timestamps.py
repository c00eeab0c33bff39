import datetime

import pytest
from pyspark.sql import functions as F

from tablado.operators.timestamps import madrid_day, normalise_timestamps

CASES = [
    ("28/03/2026 · Sábado", "2026-03-28"), ("26-09-26", "2026-09-26"), ("27 ABR 2026", "2026-04-27"), ("June 27, 2026", "2026-06-27"), ("2026-03-15 21:00", "2026-03-15T20:00:00.000Z"),
    ("06/07/2026 11:00 CEST", "2026-07-06T09:00:00.000Z"), ("2026-07-04T09:00 Atlantic/Canary", "2026-07-04T08:00:00.000Z"), ("2026-08-18T21:45:00.506516+02:00", "2026-08-18T19:45:00.506Z"), ("20260207T080000Z", "2026-02-07T08:00:00.000Z"),
    ("Sun, 11 Oct 2026 18:00:00 +0200", "2026-10-11T16:00:00.000Z"), ("1780216200", "2026-05-31T08:30:00.000Z"), ("1785618000304", "2026-08-01T21:00:00.304Z"), ("28.6.2026", "2026-06-28"),
    ("24 de marzo de 2026 a las 21:00 (hora canaria)", "2026-03-24T21:00:00.000Z"), ("mar. 17 mar. 2026 - 20.00 h", "2026-03-17T19:00:00.000Z"), ("March 17, 2026 at 6:30 PM", "2026-03-17T17:30:00.000Z"), ("August 2, 2026 at 12:00 AM", "2026-08-01T22:00:00.000Z"),
    ("2026-05-27 12:00:00[America/Bogota]", "2026-05-27T17:00:00.000Z"), ("2026-11-03 21:00:00 -05:00", "2026-11-04T02:00:00.000Z"), ("14 de agosto", "2026-08-14"), ("10 de marzo", "2027-03-10"), ("29 de febrero", "2028-02-29"), ("15 de marzo", "2026-03-15"),
    ("2026-03-29T02:30", "2026-03-29T01:30:00.000Z"), ("2026-10-25 02:30", "2026-10-25T00:30:00.000Z"),
    ("31/02/2026", None), ("00/00/0000", None), ("julio 2026", None), ("TBC", None), ("", None), (None, None), ("2026-01-01 25:00", None), ("2026-01-01 10:00 Mars/Base", None), ("x" * 50_000, None),
]


def frame(spark, values):
    return spark.createDataFrame([(i, v, datetime.datetime(2026, 3, 15, 9)) for i, v in enumerate(values)], "k int, value string, seen timestamp")


def test_cases(spark):
    df = frame(spark, [v for v, _ in CASES]).selectExpr("*", "value as s", "value as p", "k as y")
    got = {r.k: r.norm_value for r in normalise_timestamps(df, "value", anchor=madrid_day(F.col("seen"))).collect()}
    assert {v: got[i] for i, (v, _) in enumerate(CASES)} == dict(CASES)


@pytest.mark.parametrize(("policy", "gap", "twice"), [(("first", "before"), "2026-03-29T01:30:00.000Z", "2026-10-25T00:30:00.000Z"), (("second", "after"), "2026-03-29T00:30:00.000Z", "2026-10-25T01:30:00.000Z"), (("null", "null"), None, None)])
def test_policies(spark, policy, gap, twice):
    df = frame(spark, ["2026-03-29T02:30", "2026-10-25 02:30", "2026-06-01 10:00"])
    got = {r.k: r.norm_value for r in normalise_timestamps(df, "value", ambiguous=policy[0], nonexistent=policy[1]).collect()}
    assert got == {0: gap, 1: twice, 2: "2026-06-01T08:00:00.000Z"}


def test_source_zone_and_empty(spark):
    df = frame(spark, ["2026-06-01 10:00"]).withColumn("zone", F.lit("America/Bogota"))
    assert normalise_timestamps(df, "value", default_zone=F.col("zone")).first().norm_value == "2026-06-01T15:00:00.000Z"
    assert normalise_timestamps(df.limit(0), "value").count() == 0
