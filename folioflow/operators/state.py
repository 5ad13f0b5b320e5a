"""Keyed state: conditional-fetch ledger, fetch report, validators, read state, and sequences of a device's events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.datetimes import civil_seconds, read_instant
from folioflow.operators.ordering import running, sequenced, with_previous
from folioflow.session import table

FIELD_BYTES, READ_DAYS = 512, 30


def fetch_outcome(status: Column) -> Column:
    """fetched (200), unchanged (304), redirected, or failed."""
    return F.when(status == 200, "fetched").when(status == 304, "unchanged").when(status.isin(301, 302, 303, 307, 308), "redirected").otherwise("failed")


def validator_ledger(log: DataFrame, *by: str) -> DataFrame:
    """The validators that hold after a fetch log: per ``by``, those of the latest 200 with any; 304 and failures change nothing.

    ``log`` has fetched_at, fetch_id, status, etag, last_modified. Fields over 512 bytes count as absent. One aggregation that is combined
    before its shuffle; an address with any share of the rows is one row per task.
    """

    def field(c: str) -> Column:
        return F.when(F.octet_length(c) <= FIELD_BYTES, F.nullif(F.col(c), F.lit("")))

    saved = log.select(*by, "fetched_at", "fetch_id", "status", field("etag").alias("etag"), field("last_modified").alias("last_modified")).filter((F.col("status") == 200) & (F.col("etag").isNotNull() | F.col("last_modified").isNotNull()))
    return saved.groupBy(*by).agg(F.max_by(F.struct("etag", "last_modified", "fetched_at"), F.struct("fetched_at", "fetch_id")).alias("v")).select(*by, "v.*")


def unexpired(state: DataFrame, now: Column, days: int = READ_DAYS) -> DataFrame:
    """Read state that is not older than its time to live."""
    return state.filter(F.col("read_at") >= now - F.make_dt_interval(F.lit(days)))


def first_reads(state: DataFrame) -> DataFrame:
    """One row per device and key, with the first time it was marked."""
    return state.groupBy("device", "item_key").agg(F.min("read_at").alias("read_at"))


# ---------------------------------------------------------------- queries


def validator_ledger_heads(spark, sf_dir: str) -> DataFrame:
    return validator_ledger(table(spark, sf_dir, "http_heads"), "url")


VALIDATOR_LEDGER_SQL = """
with s as (select url, fetched_at, fetch_id, case when strlen(etag) <= 512 then nullif(etag, '') end as etag,
  case when strlen(last_modified) <= 512 then nullif(last_modified, '') end as last_modified from http_heads where status = 200),
k as (select *, row_number() over (partition by url order by fetched_at desc, fetch_id desc) as r from s where etag is not null or last_modified is not null)
select url, etag, last_modified, fetched_at from k where r = 1"""


def latest_validators(spark, sf_dir: str) -> DataFrame:
    """Upsert of saved validators: the last save per device and address."""
    v = table(spark, sf_dir, "validators")
    return v.groupBy("device", "url").agg(F.max_by(F.struct("validator_id", "etag", "last_modified"), F.struct("saved_at", "validator_id")).alias("x")).select("device", "url", "x.*")


LATEST_VALIDATORS_SQL = """
with k as (select *, row_number() over (partition by device, url order by saved_at desc, validator_id desc) as r from validators)
select device, url, validator_id, etag, last_modified from k where r = 1"""


def feed_validators(spark, sf_dir: str) -> DataFrame:
    """Every feed with the validators to send, absent for those never fetched, and what the reader does about them."""
    ledger = validator_ledger_heads(spark, sf_dir)
    return table(spark, sf_dir, "feeds").select("feed_pos", "url").join(ledger, "url", "left").select("feed_pos", "url", "etag", "last_modified", (F.col("etag").isNotNull() | F.col("last_modified").isNotNull()).alias("conditional"))


FEED_VALIDATORS_SQL = f"""
with l as ({VALIDATOR_LEDGER_SQL})
select feed_pos, feeds.url, etag, last_modified, etag is not null or last_modified is not null as conditional from feeds left join l using (url)"""


def fetch_report(spark, sf_dir: str) -> DataFrame:
    """Fetches per outcome with the bytes they announced and the addresses they went to."""
    heads = table(spark, sf_dir, "http_heads")
    return heads.groupBy(fetch_outcome(F.col("status")).alias("outcome")).agg(F.count("*").alias("fetches"), F.sum("content_length").alias("bytes"), F.countDistinct("url").alias("urls"), F.min("fetched_at").alias("first"), F.max("fetched_at").alias("last"))


FETCH_REPORT_SQL = """
select case when status = 200 then 'fetched' when status = 304 then 'unchanged' when status in (301, 302, 303, 307, 308) then 'redirected' else 'failed' end as outcome,
  count(*) as fetches, sum(content_length)::bigint as bytes, count(distinct url) as urls, min(fetched_at) as first, max(fetched_at) as last from http_heads group by 1"""


def feed_problems(spark, sf_dir: str) -> DataFrame:
    """Feeds without any good answer in the last week of the log, and why: the status of their latest answer."""
    heads = table(spark, sf_dir, "http_heads").select("url", "status", "fetched_at", "fetch_id")
    week = heads.filter(F.col("fetched_at") >= heads.agg(F.max("fetched_at")).scalar() - F.expr("interval 7 days"))
    last = week.groupBy("url").agg(F.count_if(F.col("status").isin(200, 304)).alias("good"), F.max_by("status", F.struct("fetched_at", "fetch_id")).alias("last_status"))
    found = table(spark, sf_dir, "feeds").select("feed_pos", "source_name", "url").join(last, "url", "left").filter(F.coalesce("good", F.lit(0)) == 0)
    return found.select("feed_pos", "source_name", F.coalesce(F.concat(F.lit("status "), F.col("last_status").cast("string")), F.lit("never fetched")).alias("reason"))


FEED_PROBLEMS_SQL = """
with w as (select * from http_heads where fetched_at >= (select max(fetched_at) from http_heads) - interval 7 day),
l as (select url, count(*) filter (where status in (200, 304)) as good, arg_max(status, (fetched_at, fetch_id)) as last_status from w group by url)
select feed_pos, source_name, coalesce('status ' || last_status::varchar, 'never fetched') as reason from feeds left join l using (url) where coalesce(good, 0) = 0"""


def clock_discipline(spark, sf_dir: str) -> DataFrame:
    """Per device the first answer after which its clock can be set: the earliest log row with a Date header of 2020 or later."""
    at = read_instant(F.col("http_date"), F.lit(False))
    heads = table(spark, sf_dir, "http_heads").select("device", "fetch_id", "fetched_at", at.alias("at"))
    seconds = F.coalesce(F.floor(F.col("at.epoch_us") / 1_000_000), civil_seconds(F.col("at.local")) - F.coalesce(F.col("at.offset_min"), F.lit(0)) * 60).cast("bigint")
    dated = heads.select("device", "fetch_id", "fetched_at", seconds.alias("server_seconds")).filter(F.col("server_seconds") >= 1_577_836_800)
    return dated.groupBy("device").agg(F.min_by(F.struct("fetch_id", "server_seconds"), F.struct("fetched_at", "fetch_id")).alias("x")).select("device", "x.*")


def read_state_alive(spark, sf_dir: str) -> DataFrame:
    """Keys that are still remembered a month after the newest mark, with their first time, per device."""
    state = table(spark, sf_dir, "read_state")
    return unexpired(first_reads(state), state.agg(F.max("read_at")).scalar())


READ_STATE_ALIVE_SQL = """
with f as (select device, item_key, min(read_at) as read_at from read_state group by 1, 2)
select * from f where read_at >= (select max(read_at) from read_state) - interval 30 day"""


def refresh_policy(spark, sf_dir: str, partials: int = 4) -> DataFrame:
    """Full or partial refresh of each event of a user: full when the context (event type) changes, and after every few partial ones."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    rows = with_previous(sequenced(events, F.col("user_id"), F.col("ts"), F.col("event_id")), "user_id", "event_type")
    changed = F.col("previous_event_type").isNull() | (F.col("previous_event_type") != F.col("event_type"))
    turns = running(rows, F.when(changed, F.col("seq")), "context", "max")
    turn = F.col("seq") - F.col("context")
    return turns.select("event_id", "user_id", turn.alias("turn"), F.when(turn % (partials + 1) == 0, "full").otherwise("partial").alias("refresh"))


REFRESH_POLICY_SQL = """
with p as (select *, lag(event_type) over w as was from events window w as (partition by user_id order by ts, event_id)),
g as (select *, sum(case when was is null or was <> event_type then 1 else 0 end) over (partition by user_id order by ts, event_id) as ctx from p),
t as (select event_id, user_id, row_number() over (partition by user_id, ctx order by ts, event_id) - 1 as turn from g)
select event_id, user_id, turn, case when turn % 5 = 0 then 'full' else 'partial' end as refresh from t"""


def idle_intent(spark, sf_dir: str, doze_s: int = 30, sleep_s: int = 300) -> DataFrame:
    """What a device does in the gap before each of its fetches: stay, doze or sleep."""
    heads = table(spark, sf_dir, "http_heads").select("fetch_id", "device", "fetched_at")
    rows = with_previous(sequenced(heads, F.col("device"), F.col("fetched_at"), F.col("fetch_id")), "device", "fetched_at")
    gap = F.timestamp_diff("SECOND", F.col("previous_fetched_at"), F.col("fetched_at"))
    return rows.select("fetch_id", "device", gap.alias("gap_s"), F.when(gap >= sleep_s, "sleep").when(gap >= doze_s, "doze").when(gap.isNotNull(), "stay").alias("intent"))


IDLE_INTENT_SQL = """
with g as (select fetch_id, device, date_diff('microsecond', lag(fetched_at) over (partition by device order by fetched_at, fetch_id), fetched_at) // 1000000 as gap_s from http_heads)
select *, case when gap_s >= 300 then 'sleep' when gap_s >= 30 then 'doze' when gap_s is not null then 'stay' end as intent from g"""


def idle_sessions(spark, sf_dir: str, gap_s: int = 86_400) -> DataFrame:
    """Sessions of each device: runs of fetches without a gap of a day, numbered over all devices in order."""
    heads = table(spark, sf_dir, "http_heads").select("fetch_id", "device", "fetched_at")
    rows = with_previous(sequenced(heads, F.col("device"), F.col("fetched_at"), F.col("fetch_id")), "device", "fetched_at")
    opens = F.when(F.col("previous_fetched_at").isNull() | (F.timestamp_diff("SECOND", F.col("previous_fetched_at"), F.col("fetched_at")) >= gap_s), 1).otherwise(0)
    return running(rows, opens, "session").groupBy("device", "session").agg(F.count("*").alias("fetches"), F.min("fetched_at").alias("started"), F.max("fetched_at").alias("ended"))


IDLE_SESSIONS_SQL = """
with g as (select device, fetch_id, fetched_at, lag(fetched_at) over (partition by device order by fetched_at, fetch_id) as was from http_heads),
s as (select *, sum(case when was is null or date_diff('microsecond', was, fetched_at) // 1000000 >= 86400 then 1 else 0 end) over (order by device, fetched_at, fetch_id)::bigint as session from g)
select device, session, count(*) as fetches, min(fetched_at) as started, max(fetched_at) as ended from s group by 1, 2"""


def log_tail(spark, sf_dir: str, most: int = 8192) -> DataFrame:
    """The newest lines of an event log that fit into 8 KiB, oldest ones cut first at line ends.

    A line has at least two bytes, so the newest ``most`` / 2 lines hold the answer; the running sum is over these only.
    """
    line = F.octet_length(F.concat_ws(",", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "event_type", "props")) + 1
    events = table(spark, sf_dir, "events").select("event_id", "ts", line.cast("int").alias("bytes")).orderBy(F.desc("ts"), F.desc("event_id")).limit(most // 2)
    total = F.sum("bytes").over(Window.orderBy(F.desc("ts"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("from_end", total).filter(F.col("from_end") <= most)


LOG_TAIL_SQL = """
with l as (select event_id, ts, (strlen(concat_ws(',', strftime(ts, '%Y-%m-%d %H:%M:%S'), event_type, props)) + 1)::int as bytes from events),
t as (select *, sum(bytes) over (order by ts desc, event_id desc)::bigint as from_end from l)
select * from t where from_end <= 8192"""

QUERIES = {
    "validator_ledger": (validator_ledger_heads, VALIDATOR_LEDGER_SQL),
    "latest_validators": (latest_validators, LATEST_VALIDATORS_SQL),
    "feed_validators": (feed_validators, FEED_VALIDATORS_SQL),
    "fetch_report": (fetch_report, FETCH_REPORT_SQL),
    "feed_problems": (feed_problems, FEED_PROBLEMS_SQL),
    "clock_discipline": (clock_discipline, None),
    "read_state_alive": (read_state_alive, READ_STATE_ALIVE_SQL),
    "refresh_policy": (refresh_policy, REFRESH_POLICY_SQL),
    "idle_intent": (idle_intent, IDLE_INTENT_SQL),
    "idle_sessions": (idle_sessions, IDLE_SESSIONS_SQL),
    "battery_log_tail": (log_tail, LOG_TAIL_SQL),
}
