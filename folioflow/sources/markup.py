"""A tolerant reader of XML and HTML: a text becomes start, end and text tokens; nothing it meets is an error."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html.entities import html5

_NAMES = {k[:-1]: v for k, v in html5.items() if k.endswith(";") and len(k) <= 33}
_FOLDED = {k.lower(): v for k, v in reversed(list(_NAMES.items()))}
_ENTITY = re.compile(r"&(#[xX][0-9a-fA-F]{1,8}|#[0-9]{1,8}|[A-Za-z][A-Za-z0-9]{0,30});")
_ASIDE = re.compile(r"<!--(?:.*?-->|.*)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|$)|<\?.*?(?:\?>|$)", re.S)
# a tag without quotes; as it ends at the next "<" at the latest, trying it at every "<" takes no more than the text's length
_PLAIN_TAG = re.compile(r"<(/?)([A-Za-z_][^\s/<>\"']*)([^<>\"']*)>")
_NAME = re.compile(r"</?([A-Za-z_][^\s/>]*)")
_ATTRIBUTE = re.compile(r"([^\s=/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


def cp1252_char(byte: int) -> str:
    """The character of a windows-1252 byte; the five bytes it leaves open stay control characters."""
    return bytes([byte]).decode("cp1252", "ignore") or chr(byte)


def decode_entity(body: str) -> str | None:
    """The character of ``amp``, ``#233`` or ``#xe9``; null for an unknown one. Numbers 128 to 159 are windows-1252 bytes."""
    if body[0] == "#":
        n = int(body[2:], 16) if body[1] in "xX" else int(body[1:])
        if 0x80 <= n <= 0x9F:
            return cp1252_char(n)
        return chr(n) if 0 < n < 0x110000 and not 0xD800 <= n <= 0xDFFF else "\ufffd"
    return _NAMES.get(body) or _FOLDED.get(body.lower())


def decode_entities(text: str) -> str:
    """Entities replaced; unknown ones stay as they are."""
    return _ENTITY.sub(lambda m: decode_entity(m.group(1)) or m.group(), text) if "&" in text else text


def decode_bytes(raw: bytes) -> str:
    """UTF-8 unless a declaration names another encoding, which is then read as windows-1252; a byte order mark is dropped."""
    raw = raw.removeprefix(b"\xef\xbb\xbf")
    declared = re.search(rb"<\?xml[^>]*encoding\s*=\s*[\"']([^\"']+)", raw[:200])
    if declared and declared.group(1).lower() not in (b"utf-8", b"utf8", b"us-ascii"):
        return "".join(map(cp1252_char, raw))
    return raw.decode("utf-8", "replace")


class _TagEnds:
    """Where the tag that begins at a place ends: at the next ``>`` that isn't quoted. All ends are found in one pass from the back, so reading is linear."""

    def __init__(self, text: str):
        self.at = [m.start() for m in re.finditer("[>\"']", text)]
        self.end = [-1] * (len(self.at) + 1)  # reading on from each sign, outside of quotes
        following = {'"': -1, "'": -1}
        for i in range(len(self.at) - 1, -1, -1):
            sign = text[self.at[i]]
            if sign == ">":
                self.end[i] = self.at[i]
                continue
            if following[sign] >= 0:
                self.end[i] = self.end[following[sign] + 1]
            following[sign] = i

    def after(self, at: int) -> int:
        """The place of the ``>``, or -1."""
        return self.end[bisect_left(self.at, at)]


def tokens(text: str, raw_tags: frozenset[str] = frozenset()) -> Iterator[tuple]:
    """("start", name, attributes, closed), ("end", name) and ("text", text) in order; names in lower case.

    The content of a tag in ``raw_tags`` is passed over up to its literal end tag. A ``<`` that begins no tag is text. Time grows with the length
    of the text, whatever it holds.
    """
    at, size, last = 0, len(text), text.rfind(">")
    ends: _TagEnds | None = None  # made when a tag needs it
    while at < size:
        if text[at] != "<":
            stop = text.find("<", at)
            stop = size if stop < 0 else stop
            yield "text", decode_entities(text[at:stop])
            at = stop
            continue
        if m := _PLAIN_TAG.match(text, at):
            slash, name, rest = m.groups()
            at = m.end()
        else:
            if m := _ASIDE.match(text, at):
                at = m.end()
                if m["cdata"] is not None:
                    yield "text", m["cdata"]
                continue
            if text.startswith("<!", at) and last > at:
                at = text.index(">", at) + 1
                continue
            stop = -1
            if last > at:
                ends = ends or _TagEnds(text)
                stop = ends.after(at)
            m = _NAME.match(text, at, stop) if stop >= 0 else None
            if m is None:
                yield "text", "<"
                at += 1
                continue
            slash, name, rest = text[at + 1] == "/", m.group(1), text[m.end() : stop]
            at = stop + 1
        name = name.lower()
        if slash:
            yield "end", name
            continue
        closed = rest.endswith("/")
        if name in raw_tags:
            if not closed:
                found = re.compile(f"</{re.escape(name)}>", re.I).search(text, at)
                at = found.end() if found else size
            continue
        attributes: dict[str, str] = {}
        for key, a, b, c in _ATTRIBUTE.findall(rest.rstrip("/") if closed else rest):
            attributes.setdefault(key.lower(), decode_entities(a or b or c))
        yield "start", name, attributes, closed
