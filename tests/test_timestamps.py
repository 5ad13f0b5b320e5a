import random
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from folioflow.operators import timestamps
from folioflow.operators.timestamps import estimate_zones, normalise_timestamps

CASES = [
    ("Tue, 04 Nov 2025 11:00:00 +0100", "2025-11-04 10:00:00"),
    ("Mon, 04 Nov 2025 11:00:00 -0000", "2025-11-04 11:00:00"),
    ("2026-09-03T12:45:12.28+05:30", "2026-09-03 07:15:12.280000"),
    ("20250903T053237Z", "2025-09-03 05:32:37"),
    ("  2025-09-05t09:14:29z\n", "2025-09-05 09:14:29"),
    ("10 Apr 26 05:27 GMT", "2026-04-10 05:27:00"),
    ("Sep 30, 2026 12:36 am CEST", "2026-09-29 22:36:00"),
    ("10 janvier 2026 à 11h19", "2026-01-10 11:19:00"),
    ("10. März 2026, 21:51 Uhr", "2026-03-10 21:51:00"),
    ("10 de mayo de 2026, 08:47", "2026-05-10 08:47:00"),
    ("Fri Apr  3 00:17:30 2026", "2026-04-03 00:17:30"),
    ("Wednesday, 31-Dec-25 23:55:16 GMT", "2025-12-31 23:55:16"),
    ("25/12/2025 04:18", "2025-12-25 04:18:00"),
    ("01.02.2026 06:44", "2026-02-01 06:44:00"),
    ("1756843861", "2025-09-02 20:11:01"),
    ("1756755183183", "2025-09-01 19:33:03.183000"),
    ("2025-09-01", "2025-09-01 00:00:00"),
    ("Thu, 30 Feb 2026 08:15:00 GMT", None),
    ("2026-13-04T09:00:00Z", None),
    ("0000-00-00 00:00:00", None),
    ("0", None),
    ("-1", None),
    ("yesterday, 9 pm", None),
    ("Thu, 01 Jan 2026 00:00:00 XYZ", None),
    ("", None),
    (None, None),
    ("x" * 100_000, None),
]


def test_notations(spark):
    df = spark.createDataFrame([(k, raw) for k, (raw, _) in enumerate(CASES)], "id int, raw string")
    got = {r.id: r.utc_us for r in normalise_timestamps(df, "raw").collect()}
    for k, (raw, expected) in enumerate(CASES):
        want = None if expected is None else round((datetime.fromisoformat(expected) - datetime(1970, 1, 1)).total_seconds() * 1e6)
        assert got[k] == want, raw


@pytest.mark.parametrize(
    ("raw", "zone", "month_first", "expected"),
    [
        ("2025-10-26 02:30:00", "Europe/Berlin", False, "2025-10-26 00:30:00"),  # twice: the earlier
        ("2026-03-29 02:30:00", "Europe/Berlin", False, "2026-03-29 01:30:00"),  # skipped: the offset before
        ("2026-07-01", "America/New_York", False, "2026-07-01 04:00:00"),
        ("03/04/2026 05:00 PM", "America/New_York", True, "2026-03-04 22:00:00"),
        ("2026-07-01 10:00", "Not/AZone", False, "2026-07-01 10:00:00"),
    ],
)
def test_stated_zone(spark, raw, zone, month_first, expected):
    df = spark.createDataFrame([(raw, zone, month_first)], "raw string, zone string, month_first boolean")
    us = normalise_timestamps(df, "raw", stated_zone="zone").first().utc_us
    assert us == round((datetime.fromisoformat(expected) - datetime(1970, 1, 1)).total_seconds() * 1e6)


def test_zone_is_estimated_from_fetches(spark):
    local = [("a", f"2026-0{m}-1{d} 12:00:00", f"2026-0{m}-1{d} {16 if m == 7 else 17}:20:00") for m in (1, 7) for d in range(9)]
    df = spark.createDataFrame(local, "g string, l string, f string").select("g", F.col("l").cast("timestamp_ntz").alias("l"), F.col("f").cast("timestamp_ntz").alias("f"))
    found = estimate_zones(df, "g", "l", "f").first()
    assert (found.estimated_zone, found.violations, found.evidence) == ("America/New_York", 0, 18)
    raw = df.select("g", F.date_format("l", "yyyy-MM-dd HH:mm:ss").alias("raw"), F.col("f").alias("fetched_at"), F.lit("x").alias("used_zone"))
    out = normalise_timestamps(raw, "raw", group="g", fetched="fetched_at")
    assert {r.used_zone for r in out.collect()} == {"America/New_York"}


def test_empty_table_and_repeats(spark):
    df = spark.createDataFrame([], "raw string, g string, fetched_at timestamp_ntz")
    assert normalise_timestamps(df, "raw", group="g", fetched="fetched_at").count() == 0
    twice = spark.createDataFrame([("2026-01-01", "e"), ("2026-01-01", "e")], "raw string, utc_us string")
    assert [r.utc_us for r in normalise_timestamps(twice, "raw").collect()] == [1767225600000000] * 2


ZONES = ["UTC", "Europe/London", "Europe/Paris", "Europe/Moscow", "Asia/Kolkata", "Asia/Tokyo", "Australia/Sydney", "America/New_York", "America/Los_Angeles"]


def test_instants_without_stated_zones(spark):
    """Feeds of unknown zones, with stories fetched hours after and delivered again: the estimated histories give nearly all instants."""
    rng = random.Random(4)
    rows = []
    for g, zone in enumerate(ZONES):
        for k in range(60):
            at = datetime(2026, 1, 1, tzinfo=UTC) + timedelta(minutes=rng.randint(0, 360 * 24 * 60))
            fetched = at + timedelta(seconds=100 + rng.expovariate(1 / 5000) if rng.random() > 0.02 else rng.randint(-30_000, 900_000))
            zoned = k % 3 == 0
            raw = at.strftime("%Y-%m-%dT%H:%M:%SZ") if zoned else at.astimezone(ZoneInfo(zone)).strftime("%Y-%m-%d %H:%M:%S")
            rows += [(g, k, raw, (fetched + timedelta(days=d)).replace(tzinfo=None), int(at.timestamp()) * 1_000_000) for d in range(3)]
    df = spark.createDataFrame(rows, "g int, k int, raw string, fetched_at timestamp_ntz, want bigint")
    got = normalise_timestamps(df, "raw", group="g", fetched="fetched_at").collect()
    assert len(got) == len(rows) and sum(r.utc_us == r.want for r in got) >= 0.98 * len(rows)
    assert {r.zone_source for r in got} == {"stated-offset", "estimated"}


def test_nothing_is_estimated_where_zones_are_stated(spark, monkeypatch):
    monkeypatch.setattr(timestamps, "estimate_zones", lambda *_, **__: pytest.fail("estimated"))
    df = spark.createDataFrame([("2026-07-01 10:00", "Europe/Berlin", "f")], "raw string, zone string, g string").withColumn("fetched_at", F.lit(None).cast("timestamp_ntz"))
    assert normalise_timestamps(df, "raw", group="g", fetched="fetched_at", stated_zone="zone").first().zone_source == "stated-zone"


def test_candidates_are_distinct_histories():
    zones = timestamps.candidate_zones()
    assert len({timestamps.history(z) for z in zones}) == len(zones) and timestamps.history("Europe/Paris") in {timestamps.history(z) for z in zones}
