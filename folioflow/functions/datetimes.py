"""Reading written instants with Catalyst expressions only.

Everything here builds Columns; no Python runs per row. A text is first brought to a
plain notation (lower case, single blanks, no accents, weekday and filler words gone),
then matched against a handful of patterns, each of which rewrites it to the same
``|``-separated field list.
"""

from __future__ import annotations

from collections.abc import Callable
from zoneinfo import available_timezones

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names in the languages of the feeds, accents folded.
MONTHS = {
    1: "jan january januar janv janvier ene enero января январь янв",
    2: "feb february februar fev fevr fevrier febrero февраля февраль фев",
    3: "mar march marz maerz mrz mars marzo марта март мар",
    4: "apr april avr avril abr abril апреля апрель апр",
    5: "may mai mayo мая май",
    6: "jun june juni juin junio июня июнь июн",
    7: "jul july juli juil juillet julio июля июль июл",
    8: "aug august aout ago agosto августа август авг",
    9: "sep sept september septembre septiembre setiembre сентября сентябрь сен сент",
    10: "oct october okt oktober octobre octubre октября октябрь окт",
    11: "nov november novembre noviembre ноября ноябрь ноя нояб",
    12: "dec december dez dezember decembre dic diciembre декабря декабрь дек",
}

# Weekday names that may lead a date, accents folded.
WEEKDAYS = (
    "mon monday tue tues tuesday wed wednesday thu thur thurs thursday fri friday sat saturday sun sunday "
    "mo montag di dienstag mi mittwoch do donnerstag fr freitag sa samstag sonnabend so sonntag "
    "lun lundi mardi mer mercredi jeu jeudi ven vendredi sam samedi dim dimanche "
    "lunes martes miercoles mie jueves jue viernes vie sabado sab domingo dom "
    "понедельник вторник среда четверг пятница суббота воскресенье пн вт ср чт пт сб вс"
)

# Zone names with a constant offset, in minutes east of UTC.
ZONE_MINUTES = {
    "z": 0, "ut": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "mez": 60, "cest": 120, "mesz": 120,
    "eet": 120, "eest": 180, "msk": 180, "ist": 330, "hkt": 480, "sgt": 480, "awst": 480, "jst": 540, "kst": 540,
    "acst": 570, "acdt": 630, "aest": 600, "aedt": 660, "nzst": 720, "nzdt": 780,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600,
}

_SPACE = r"[\s\u00a0\u2000-\u200b\u202f\u2060\u3000\ufeff]"
_MONTH = "(" + "|".join(sorted((m for names in MONTHS.values() for m in names.split()), key=len, reverse=True)) + ")"
_TIME = r"(\d{1,2})[:h](\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?: ?([ap])\.?m\b\.?)?"
_ZONE = r"(?: ?((?:gmt|utc)?[+-]\d{1,2}(?::?\d{2})?|[a-z]{1,5})(?: ?\([a-z ]*\))?)?"
_CLOCK = rf"(?:[t ] ?{_TIME})?{_ZONE}"

#: pattern, order of its groups as year|month|day|hour|minute|second|fraction|am-pm|zone; A and B are numeric parts
#: whose meaning depends on the feed.
_NOTATIONS = (
    (rf"^(\d{{4}})[-/](\d{{1,2}})[-/](\d{{1,2}}){_CLOCK}$", "y$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    (r"^(\d{4})(\d{2})(\d{2})t(\d{2})(\d{2})(\d{2})?(?:[.,](\d{1,9}))?" + _ZONE + "$", "y$1|$2|$3|$4|$5|$6|$7||$8"),
    (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}|\d{{2}}){_CLOCK}$", "s$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}|\d{{2}}){_CLOCK}$", "y$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    (rf"^(\d{{1,2}})(?:\.|st|nd|rd|th)?[ -]?{_MONTH}\.?[ -](\d{{4}}|\d{{2}}){_CLOCK}$", "y$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    (rf"^{_MONTH}\.? (\d{{1,2}})(?:st|nd|rd|th)? (\d{{4}}){_CLOCK}$", "y$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    (rf"^{_MONTH}\.? (\d{{1,2}}) {_TIME}(?: ([a-z]{{1,5}}|[+-]\d{{4}}))? (\d{{4}})$", "y$9|$1|$2|$3|$4|$5|$6|$7|$8"),
)


def plain_notation(raw: Column) -> Column:
    """Lower case, single blanks, accents folded, weekday and filler words removed."""
    s = F.regexp_replace(F.lower(raw), _SPACE + "+", " ")
    s = F.translate(s, "éèêëäáàâîïíìôöóòûüúùñç\u2212\u2010\u2011", "eeeeaaaaiiiioooouuuunc---")
    s = F.trim(F.regexp_replace(F.regexp_replace(s, r",", " "), " +", " "))
    s = F.regexp_replace(s, "^(?:" + "|".join(sorted(WEEKDAYS.split(), key=len, reverse=True)) + r")\.? ", "")
    s = F.regexp_replace(s, r" (?:de|del|a|at|um|a las|в|kl) (?=\S)", " ")
    s = F.regexp_replace(s, r" (?:de|del|a|at|um|a las|в|kl) (?=\S)", " ")
    return F.trim(F.regexp_replace(s, r" (?:uhr|h|г\.|года|hrs)(?= |$)", ""))


def _part(fields: Column, k: int) -> Column:
    return F.nullif(F.element_at(fields, k + 1), F.lit(""))


def month_number(name: Column) -> Column:
    pairs = [x for n, names in MONTHS.items() for m in names.split() for x in (F.lit(m), F.lit(n))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), name), name.try_cast("int"))


def zone_minutes(zone: Column) -> Column:
    """Minutes east of UTC of a written offset or zone name; null where the name is not known."""
    pairs = [x for k, v in ZONE_MINUTES.items() for x in (F.lit(k), F.lit(v))]
    offset = F.regexp_extract(zone, r"^(?:gmt|utc)?([+-])(\d{1,2}):?(\d{2})?$", 1)
    hours = F.regexp_extract(zone, r"^(?:gmt|utc)?[+-](\d{1,2}?):?(\d{2})?$", 1).try_cast("int")
    minutes = F.coalesce(F.regexp_extract(zone, r"^(?:gmt|utc)?[+-]\d{1,2}?:?(\d{2})?$", 1).try_cast("int"), F.lit(0))
    value = F.when(offset == "-", -(hours * 60 + minutes)).otherwise(hours * 60 + minutes)
    named = F.try_element_at(F.create_map(*pairs), zone)
    return F.when(offset != "", F.when((hours <= 18) & (minutes < 60), value)).otherwise(named)


def civil_seconds(ntz: Column) -> Column:
    """Seconds from 1970-01-01 00:00 to a timestamp without zone, whatever the session's zone is."""
    return F.unix_date(ntz.cast("date")).cast("bigint") * 86400 + F.hour(ntz) * 3600 + F.minute(ntz) * 60 + F.floor(F.second(ntz)).cast("bigint")


def local_to_utc(ntz: Column, zone: Column) -> Column:
    """UTC wall clock of a local one: a repeated time is its earlier instant, a skipped one takes the offset before."""
    return F.convert_timezone(zone, F.lit("UTC"), ntz)


def known_zone(zone: Column) -> Column:
    """The zone where it is an IANA name, else null."""
    return F.when(zone.isin(*sorted(z for z in available_timezones() if not z.startswith(("posix/", "right/")))), zone)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _local_of(f: Column, slash: Column, month_first: Column) -> Column:
    """Local time, fraction, offset of a field list."""
    swap = slash & ~F.coalesce(month_first, F.lit(False))
    year, zone, half = _part(f, 0).try_cast("int"), _part(f, 8), _part(f, 7)
    hour = let(
        F.coalesce(_part(f, 3).try_cast("int"), F.lit(0)),
        lambda h: F.when(half.isNull(), h).when((h < 1) | (h > 12), None).when(half == "p", h % 12 + 12).otherwise(h % 12),
    )
    fraction = F.coalesce(F.rpad(F.substring(_part(f, 6), 1, 6), 6, "0").try_cast("bigint"), F.lit(0))
    local = F.try_make_timestamp_ntz(
        let(year, lambda y: F.when(y < 100, y + 2000).when(y > 0, y)),
        F.when(swap, _part(f, 2).try_cast("int")).otherwise(month_number(_part(f, 1))),
        F.when(swap, _part(f, 1)).otherwise(_part(f, 2)).try_cast("int"),
        hour,
        F.coalesce(_part(f, 4).try_cast("int"), F.lit(0)),
        F.coalesce(_part(f, 5).try_cast("int"), F.lit(0)).cast("decimal(8,6)"),
    )
    offset = let(zone, zone_minutes)
    return F.struct(
        F.lit(None).cast("bigint").alias("epoch_us"),
        F.when(zone.isNull() | offset.isNotNull(), local).alias("local"),
        fraction.cast("bigint").alias("frac_us"),
        offset.cast("int").alias("offset_min"),
        zone.isNotNull().alias("zoned"),
    )


def read_instant(raw: Column, month_first: Column) -> Column:
    """A struct of what a text states: ``epoch_us`` (bare digits), else ``local`` and its fraction.

    ``local`` is a timestamp without zone and whole seconds, ``frac_us`` its microseconds, ``offset_min`` the stated offset
    or null and ``zoned`` whether any zone was stated. Null when the text has no known notation, ``local`` null when
    the date is impossible or its zone name unknown.
    """
    nothing = F.lit(None)

    def epoch(digits: Column) -> Column:
        n = digits.try_cast("bigint")
        us = F.when(n > 0, n * F.when(F.length(digits) == 13, 1000).otherwise(1_000_000))
        return F.struct(us.alias("epoch_us"), nothing.cast("timestamp_ntz").alias("local"), F.lit(0).cast("bigint").alias("frac_us"), nothing.cast("int").alias("offset_min"), F.lit(False).alias("zoned"))

    def written(plain: Column) -> Column:
        fields = F.coalesce(*(F.when(plain.rlike(p), F.regexp_replace(plain, p, to)) for p, to in _NOTATIONS))
        return let(fields, lambda t: F.when(t.isNotNull(), let(F.split(F.substring(t, 2, 200), r"\|"), lambda f: _local_of(f, t.startswith("s"), month_first))))

    bare = F.regexp_extract(F.regexp_replace(raw, _SPACE, ""), r"^\d{1,13}$", 0)
    return let(bare, lambda digits: F.when(F.length(digits) > 0, epoch(digits)).when(digits.isNotNull(), let(plain_notation(raw), written)))
