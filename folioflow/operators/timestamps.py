"""Mixed timestamp notations and zones brought to UTC instants.

A text that states its offset, or that is an epoch, needs nothing else. The others are
local times of some group (a feed, a host). For them the operator aligns the local times
with the instants at which the rows were fetched: under the right offset history a story
is fetched soon after it was published and never before; a wrong history either puts
publications after their fetch or leaves the gap too long. How soon is soon is taken from
the rows of the table whose instants are sure. Per group the history whose violations of that weigh
least is the estimate. It is used where the group has no stated
zone; a stated zone always holds.
"""

from __future__ import annotations

import math
from datetime import UTC, datetime, timedelta
from functools import cache, reduce
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import datetimes as D
from folioflow.session import bounded_broadcast, cut, table

# Zones that name their offset history when several have it, and that are preferred to rarer histories.
COMMON_ZONES = (
    "UTC", "Europe/London", "Europe/Berlin", "Europe/Athens", "Europe/Moscow", "Asia/Kolkata", "Asia/Shanghai", "Asia/Tokyo",
    "Australia/Sydney", "America/New_York", "America/Chicago", "America/Denver", "America/Los_Angeles", "America/Sao_Paulo",
)
BIN_S, EARLIEST_BIN, LATEST_BIN = 1800, -4, 96


def history(zone: str, first: int = 2015, last: int = 2035) -> tuple[int, ...]:
    """Offsets of a zone in minutes, every five days from one year to another."""
    at, found = datetime(first, 1, 1, tzinfo=UTC), []
    while at.year <= last:
        found.append(int(at.astimezone(ZoneInfo(zone)).utcoffset().total_seconds()) // 60)
        at += timedelta(days=5)
    return tuple(found)


@cache
def candidate_zones() -> tuple[str, ...]:
    """One zone for each offset history that any place has; the common ones first."""
    areas = ("Africa/", "America/", "Asia/", "Atlantic/", "Australia/", "Europe/", "Pacific/")
    seen: dict[tuple, str] = {}
    for zone in (*COMMON_ZONES, *sorted(z for z in available_timezones() if z.startswith(areas))):
        seen.setdefault(history(zone), zone)
    return tuple(seen.values())


def _lag_bin(lag_s: Column) -> Column:
    """Half hours from publication to fetch, from 0 for two hours before and more."""
    return F.least(F.greatest(F.floor(lag_s / BIN_S), F.lit(EARLIEST_BIN)), F.lit(LATEST_BIN)).cast("int") - EARLIEST_BIN


def lag_weights(counts: dict[int, int], prior_rows: float = 50.0) -> list[float]:
    """The weight of each bin of lags, from how many sure rows lie in it: the surprise of finding a lag there, 0 for the most usual one.

    A prior of ``prior_rows`` rows says what is known without any: fetches follow within hours, hardly any comes before.
    """
    n = LATEST_BIN - EARLIEST_BIN + 1
    prior = [0.002 if k < -EARLIEST_BIN else math.exp(-(k + EARLIEST_BIN) * BIN_S / 7200) + 0.004 for k in range(n)]
    mass = [counts.get(k, 0) + prior_rows * prior[k] / sum(prior) for k in range(n)]
    # bins of hours are smooth but for the step at the fetch
    level = [m / sum(mass) for m in mass]
    return [round(math.log(max(level) / p), 6) for p in level]


def estimate_zones(df: DataFrame, group: str, local: str, fetched: str, candidates: tuple[str, ...] | None = None, weights: list[float] | None = None, rare: float = 2.0) -> DataFrame:
    """(``group``, ``estimated_zone``, ``violations``, ``evidence``): the offset history whose violations weigh least per group.

    ``local`` and ``fetched`` are timestamps without zone (``fetched`` in UTC). A local time that comes several times is aligned with its first
    fetch. What a row adds to a history is the weight of the lag between its instant and the fetch (``weights``, see :func:`lag_weights`); it
    counts as a violation if it comes before its fetch by more than a bin, or is less usual than one lag in a hundred. A history that isn't common
    starts with ``rare``. Rows with a null in
    any of the three columns are no evidence; a group without evidence has no row; ties go to the earlier candidate.
    Everything is counted by aggregations that are combined before their shuffle, so a group of any size costs few rows per task.
    """
    candidates, weights = candidates or candidate_zones(), weights or lag_weights({})
    rows = df.select(F.col(group).alias("_k"), F.col(local).alias("_l"), F.col(fetched).alias("_f")).dropna().groupBy("_k", "_l").agg(F.min("_f").alias("_f"))
    table_ = F.array(*map(F.lit, weights))
    limit = math.log(100 * math.exp(min(weights)))

    def weight(zone: str) -> Column:
        return F.element_at(table_, _lag_bin(D.civil_seconds(F.col("_f")) - D.civil_seconds(D.local_to_utc(F.col("_l"), F.lit(zone)))) + 1)

    weighed = rows.select("_k", *(weight(z).alias(f"_w{k}") for k, z in enumerate(candidates)))
    counted = weighed.groupBy("_k").agg(
        F.count("*").alias("evidence"),
        *(F.sum(F.col(f"_w{k}").cast("decimal(18,6)")).alias(f"_c{k}") for k in range(len(candidates))),
        *(F.count_if(F.col(f"_w{k}") > limit).alias(f"_v{k}") for k in range(len(candidates))),
    )
    cost = lambda k, z: F.col(f"_c{k}").cast("double") + (0.0 if z in COMMON_ZONES else rare)
    best = F.array_min(F.array(*(F.struct(cost(k, z).alias("cost"), F.lit(k).alias("k"), F.lit(z).alias("zone"), F.col(f"_v{k}").alias("violations")) for k, z in enumerate(candidates))))
    return counted.select(F.col("_k").alias(group), best.alias("_b"), "evidence").select(group, F.col("_b.zone").alias("estimated_zone"), F.col("_b.violations").alias("violations"), "evidence")


def _timed(local: Column) -> Column:
    """Whether a local time says more than the date."""
    return F.date_trunc("day", local) != local


def normalise_timestamps(df: DataFrame, raw: str, *, group: str | None = None, fetched: str | None = None, stated_zone: str | None = None, candidates: tuple[str, ...] | None = None) -> DataFrame:
    """``df`` with ``utc_us``, ``used_zone`` and ``zone_source`` (stated-offset, stated-zone, estimated, default-utc) added.

    ``utc_us`` is microseconds since 1970 in UTC at the precision given, or null for a text that names no real date: null,
    empty, words, impossible dates, unknown zone names, ``0`` and ``-1``. ``stated_zone`` names a column of IANA zones, in which
    local times without an offset are read (a value that is no IANA name counts as absent). With ``group`` and ``fetched`` given, the zone of
    rows without one is estimated per group by :func:`estimate_zones`; what is left is UTC. If all rows have one, nothing is estimated or read for it. Dates with slashes are month
    first where the column ``month_first`` of ``df`` is true; where that is null, they are no evidence, and month first in estimated zones of America
    where the column ``english`` is true. Repeated rows stay repeated, other columns pass through;
    the three added names replace columns of the same name.
    """
    month_first = F.col("month_first") if "month_first" in df.columns else F.lit(False)
    zone = D.known_zone(F.col(stated_zone)) if stated_zone else F.lit(None).cast("string")
    estimated = F.lit(None).cast("string")
    rows = df.drop("_g", "_e")
    if group and fetched and not rows.filter(zone.isNull()).isEmpty():
        at = D.read_instant(F.col(raw), F.coalesce(month_first, F.lit(False)))
        seen = cut(rows.select(F.col(group).alias("_g"), F.col(fetched).cast("timestamp_ntz").alias("_f"), zone.alias("_z"), (F.col(raw).contains("/") & month_first.isNull()).alias("_slash"), at.alias("_at")).filter(F.col("_f").isNotNull() & F.col("_at").isNotNull()))
        sure = seen.filter(F.col("_at.zoned") & F.col("_at.local").isNotNull()).groupBy("_g", (D.civil_seconds(F.col("_at.local")) - F.col("_at.offset_min") * 60).alias("_s")).agg(F.min("_f").alias("_f"))
        lags = {r.b: r.n for r in sure.groupBy(_lag_bin(D.civil_seconds(F.col("_f")) - F.col("_s")).alias("b")).agg(F.count("*").alias("n")).collect()}  # a row per bin
        loose = seen.filter(F.col("_z").isNull() & F.col("_at.local").isNotNull() & ~F.col("_at.zoned") & ~F.coalesce("_slash", F.lit(False)) & _timed(F.col("_at.local")))
        estimates = estimate_zones(loose.select("_g", F.col("_at.local").alias("_local"), "_f"), "_g", "_local", "_f", candidates, lag_weights(lags))
        rows = rows.join(bounded_broadcast(estimates.select("_g", F.col("estimated_zone").alias("_e"))), F.col(group).eqNullSafe(F.col("_g")), "left")
        estimated = F.col("_e")
        if "english" in df.columns:
            month_first = F.coalesce(month_first, F.col("english") & F.col("_e").startswith("America/"))
    read = rows.withColumn("_at", D.read_instant(F.col(raw), F.coalesce(month_first, F.lit(False))))
    used = F.coalesce(zone, estimated, F.lit("UTC"))
    zoned, epoch, local = F.col("_at.zoned"), F.col("_at.epoch_us"), F.col("_at.local")
    seconds = F.when(zoned, D.civil_seconds(local) - F.col("_at.offset_min") * 60).otherwise(D.let(D.local_to_utc(local, used), D.civil_seconds))
    source = F.when(epoch.isNotNull() | zoned, "stated-offset").when(zone.isNotNull(), "stated-zone").when(estimated.isNotNull(), "estimated").otherwise("default-utc")
    utc = F.coalesce(epoch, seconds * 1_000_000 + F.col("_at.frac_us"))
    done = read.withColumn("utc_us", utc)
    return done.withColumns({"used_zone": F.when(F.col("utc_us").isNotNull() & local.isNotNull() & ~zoned, used), "zone_source": F.when(F.col("utc_us").isNotNull(), source)}).drop("_at", "_e", "_g")


def p6_found(spark, sf_dir: str) -> DataFrame:
    """Every value of items, heads and validators that names a real date, as one UTC instant."""
    feeds = table(spark, sf_dir, "feeds").select("feed_pos", "zone", ((F.col("lang") == "en") & F.col("zone").startswith("America/")).alias("month_first"))
    items = table(spark, sf_dir, "items").select("item_id", "feed_pos", "published_raw", "fetched_at").join(bounded_broadcast(feeds), "feed_pos", "left")

    def cases(done: DataFrame, record: str, key: str) -> DataFrame:
        # a generator and not a filter: a filter would be pushed below and make every text be read twice
        return done.select(F.lit(record).alias("record"), F.col(key).alias("record_id"), F.explode(F.array_compact(F.array("utc_us"))).alias("utc_us"))

    parts = [
        cases(normalise_timestamps(items, "published_raw", group="feed_pos", fetched="fetched_at", stated_zone="zone"), "item", "item_id"),
        cases(normalise_timestamps(table(spark, sf_dir, "http_heads").select("fetch_id", "http_date"), "http_date"), "head", "fetch_id"),
        cases(normalise_timestamps(table(spark, sf_dir, "validators").select("validator_id", "last_modified"), "last_modified"), "validator", "validator_id"),
    ]
    return reduce(DataFrame.unionByName, parts)


def p6_estimated(spark, sf_dir: str) -> DataFrame:
    """Every item's instant without any look at the feeds' stated zones: offset histories come from the fetches alone."""
    feeds = table(spark, sf_dir, "feeds").select("feed_pos", (F.col("lang") == "en").alias("english"), F.lit(None).cast("boolean").alias("month_first"))
    items = table(spark, sf_dir, "items").select("item_id", "feed_pos", "published_raw", "fetched_at").join(bounded_broadcast(feeds), "feed_pos", "left")
    done = normalise_timestamps(items, "published_raw", group="feed_pos", fetched="fetched_at")
    return done.filter(F.col("utc_us").isNotNull()).select("item_id", "utc_us", "used_zone", "zone_source")


def p6_zone_estimates(spark, sf_dir: str) -> DataFrame:
    """The estimated offset history of each feed beside the stated one, and how many of its instants the two make equal."""
    feeds = table(spark, sf_dir, "feeds").select("feed_pos", F.col("zone").alias("stated_zone"))
    stated = p6_found(spark, sf_dir).filter("record = 'item'").select(F.col("record_id").alias("item_id"), F.col("utc_us").alias("stated_us"))
    guessed = p6_estimated(spark, sf_dir).filter("zone_source <> 'stated-offset'").join(stated, "item_id")
    feed = table(spark, sf_dir, "items").select("item_id", "feed_pos").join(bounded_broadcast(feeds), "feed_pos")
    found = guessed.join(feed, "item_id").groupBy("feed_pos", "stated_zone").agg(F.max(F.when(F.col("zone_source") == "estimated", F.col("used_zone"))).alias("estimated_zone"), F.count("*").alias("instants"), F.count_if(F.col("utc_us") == F.col("stated_us")).alias("agree"))
    return found.select("feed_pos", "stated_zone", "estimated_zone", "instants", "agree")
