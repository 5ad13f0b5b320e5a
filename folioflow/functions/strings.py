"""String and URL functions of the news domain as Columns; lengths are bytes, case is ASCII."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WS = r"[ \t\n\r\f\x0B]+"


def ascii_lower(s: Column) -> Column:
    return F.translate(s, _UPPER, _LOWER)


def ascii_upper(s: Column) -> Column:
    return F.translate(s, _LOWER, _UPPER)


def trim_ws(s: Column) -> Column:
    return F.regexp_replace(s, f"^{_WS}|{_WS}$", "")


def collapse_ws(s: Column) -> Column:
    return trim_ws(F.regexp_replace(s, _WS, " "))


def icontains(s: Column, needle: str) -> Column:
    return F.contains(ascii_lower(s), F.lit(needle.lower()))


def tidy_author(s: Column) -> Column:
    """The name in brackets of a mail address, nothing for a bare address, else the text itself."""
    plain = collapse_ws(s)
    inner = trim_ws(F.regexp_extract(plain, r"\((.*)\)", 1))
    return F.when(inner != "", inner).when(plain.contains("@") & ~plain.contains(" "), "").otherwise(plain)


def byline(author: Column, source: Column, published: Column) -> Column:
    """``By A  ·  Source  ·  1 Jan 2026`` with absent parts left out."""
    by = F.when(author != "", F.concat(F.lit("By "), author))
    return F.concat_ws("  ·  ", by, F.nullif(source, F.lit("")), F.date_format(published, "d MMM yyyy"))


def url_parts(url: Column) -> Column:
    """struct(secure, host, port, path) of an http or https address of at most 2048 bytes, else null. The path keeps query and fragment."""
    pattern = r"(?i)^(https?)://(?:[^/?#@]*@)?([^/?#:@]+)(?::([0-9]+))?([/?#].*)?$"
    secure = ascii_lower(F.regexp_extract(url, pattern, 1)) == "https"
    port = F.coalesce(F.regexp_extract(url, pattern, 3).try_cast("int"), F.when(F.regexp_extract(url, pattern, 3) == "", F.when(secure, 443).otherwise(80)))
    rest = F.regexp_extract(url, pattern, 4)
    path = F.when(rest == "", "/").when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    parts = F.struct(secure.alias("secure"), ascii_lower(F.regexp_extract(url, pattern, 2)).alias("host"), port.alias("port"), path.alias("path"))
    return F.when(url.rlike(pattern) & (F.octet_length(url) <= 2048) & port.between(1, 65535), parts)


def resolve_url(base: Column, ref: Column) -> Column:
    """An absolute address from a base and a reference: absolute, ``//host``, ``/path``, or relative to the base's folder."""
    origin = F.regexp_extract(base, r"(?i)^(https?://[^/?#]+)", 1)
    scheme = F.regexp_extract(base, r"(?i)^(https?:)", 1)
    folder = F.regexp_extract(F.regexp_replace(base, r"[?#].*$", ""), r"(?i)^(https?://[^/]+/(?:.*/)?)", 1)
    folder = F.when(folder == "", F.concat(origin, F.lit("/"))).otherwise(folder)
    return (
        F.when(ref.rlike("(?i)^https?://"), ref)
        .when(ref.startswith("//"), F.concat(scheme, ref))
        .when(ref.startswith("/"), F.concat(origin, ref))
        .otherwise(F.concat(folder, ref))
    )


def seconds_until(clock: str, now: Column) -> Column:
    """Seconds from ``now`` to the next ``HH:MM``; a full day when it is that very second or the clock can't be read."""
    import re

    if not re.fullmatch(r"([01]\d|2[0-3]):[0-5]\d", clock):
        return F.lit(86_400)
    target = int(clock[:2]) * 3600 + int(clock[3:]) * 60
    return F.pmod(F.lit(target - 1) - (F.hour(now) * 3600 + F.minute(now) * 60 + F.second(now)), F.lit(86_400)) + 1


def grey3(v: Column) -> Column:
    """A grey value of 0 to 255 brought to the nearest of eight levels."""
    return F.floor(F.floor((v * 7 + 127) / 255) * 255 / 7).cast("int")
