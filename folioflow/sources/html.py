"""HTML to blocks: paragraphs, headings, quotes, list items, code, rules, images and captions with their inline styles."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, ByteType, IntegerType, StringType, StructField, StructType

from folioflow.sources.markup import tokens

# Tags whose content is dropped, tags that only end a block, and inline tags with their style flag.
DROPPED = frozenset("script style noscript iframe svg form button select template head object video audio canvas map aside".split())
BREAKS = frozenset("div section article main header footer table tr td th tbody thead dl dt dd address figure center fieldset".split())
INLINE = {t: f for f, tags in {1: "b strong", 2: "i em cite var dfn", 4: "code tt kbd samp", 8: "a"}.items() for t in tags.split()}

RUN = StructType([StructField("start", IntegerType()), StructField("length", IntegerType()), StructField("flags", ByteType())])
BLOCK = StructType(
    [StructField("pos", IntegerType()), StructField("type", StringType()), StructField("level", IntegerType()), StructField("ordered", BooleanType()), StructField("list_index", IntegerType())]
    + [StructField("text", StringType()), StructField("runs", ArrayType(RUN)), StructField("src", StringType())]
)
_BLANK = re.compile(r"[ \t\n\r\f\v]+")


@dataclass(frozen=True)
class Limits:
    """What is kept of a page: blocks, bytes of a block's text, runs of a block, and bytes of text up to which rules and images are taken; None is no limit."""

    blocks: int | None = 600
    block_bytes: int | None = 8192
    runs: int | None = 128
    total_bytes: int | None = 256 * 1024


NO_LIMITS = Limits(None, None, None, None)


class _Open:
    """A block while it is read: pieces of text with the style they have."""

    def __init__(self, kind: str, level: int = 0, ordered: bool = False, index: int = 0):
        self.kind, self.level, self.ordered, self.index = kind, level, ordered, index
        self.pieces: list[tuple[str, int]] = []
        self.gap = False  # white space that is written only if more text follows

    def add(self, text: str, flags: int, keep: bool) -> None:
        if keep:
            self.pieces.append((text, flags))
            return
        for k, word in enumerate(_BLANK.split(text)):
            self.gap |= k > 0 and bool(self.pieces)
            if word:
                if self.gap and not self.pieces[-1][0].endswith("\n"):
                    self.pieces.append((" ", 0))
                self.gap = False
                self.pieces.append((word, flags))

    def break_line(self) -> None:
        if self.pieces:
            self.pieces.append(("\n", 0))
            self.gap = False

    def closed(self, keep: bool, limits: Limits, lost: Counter) -> tuple[str, list[tuple[int, int, int]]]:
        """Text and runs in bytes; white space at the ends goes, the last run ends with the text."""
        whole = "".join(p for p, _ in self.pieces)
        lead = len(whole) - len(whole.lstrip(" \t\n\r\f\v")) if keep else 0
        text = whole[lead:].rstrip(" \t\n\r\f\v" if keep else " ")
        if limits.block_bytes is not None and len(raw := text.encode()) > limits.block_bytes:
            text = raw[: limits.block_bytes].decode("utf-8", "ignore")
            lost["texts"] += 1
        size, at, runs = len(text.encode()), -len(whole[:lead].encode()), []
        for piece, flags in self.pieces:
            start, at = at, at + len(piece.encode())
            a, b = max(start, 0), min(at, size)
            if a >= b:
                continue
            if piece == " " and not flags and runs and runs[-1][1] == a:
                runs.append([a, b, -1])  # a gap joins equal styles on both sides of it
            elif runs and runs[-1][1] == a and runs[-1][2] == flags:
                runs[-1][1] = b
            elif len(runs) > 1 and runs[-1][2] == -1 and runs[-2][2] == flags and runs[-1][1] == a:
                runs.pop()
                runs[-1][1] = b
            else:
                runs.append([a, b, flags])
        kept = [(a, b - a, f) for a, b, f in runs if f > 0]
        lost["runs"] += len(kept) - len(kept[: limits.runs])
        return text, kept[: limits.runs]


def html_blocks(html: str | None, limits: Limits = Limits(), lost: Counter | None = None) -> list[dict]:
    """The blocks of a page. Null has none; whatever is malformed is read as far as it goes.

    ``lost`` counts what ``limits`` cut: ``blocks`` left out, ``texts`` shortened, ``runs`` and ``images`` (with rules) left out.
    """
    lost = Counter() if lost is None else lost
    out: list[dict] = []
    inline: list[str] = []
    lists: list[list] = []
    quotes, keep, total = 0, False, 0
    now: _Open | None = None

    def emit(kind: str, text: str, runs: list, level: int = 0, ordered: bool = False, index: int = 0, src: str | None = None) -> None:
        if limits.blocks is not None and len(out) >= limits.blocks:
            lost["blocks"] += 1
        else:
            out.append({"pos": len(out), "type": kind, "level": level, "ordered": ordered, "list_index": index, "text": text, "runs": [{"start": a, "length": n, "flags": f} for a, n, f in runs], "src": src})

    def flush() -> None:
        nonlocal now, total
        if now is not None:
            text, runs = now.closed(keep, limits, lost)
            total += len(text.encode())
            if text:
                emit(now.kind, text, runs, now.level, now.ordered, now.index)
        now = None

    def begin(kind: str, level: int = 0, ordered: bool = False, index: int = 0) -> None:
        nonlocal now
        quoted = quotes and kind in ("paragraph", "blockquote")
        now = _Open("blockquote" if quoted else kind, quotes if quoted else level, ordered, index)

    for token in tokens(html or "", DROPPED):
        if token[0] == "text":
            text = token[1]
            if now is None:
                if keep:
                    begin("code")
                elif text.strip(" \t\n\r\f\v"):
                    begin("paragraph")
                else:
                    continue
            flags = 0
            for tag in inline:
                flags |= INLINE[tag]
            now.add(text, flags, keep)
            continue
        start, tag = token[0] == "start", token[1]
        if tag in DROPPED:
            continue
        if tag in INLINE:
            if start:
                if now is None:
                    begin("paragraph")
                if not token[3]:
                    inline.append(tag)
            elif tag in inline:
                del inline[len(inline) - 1 - inline[::-1].index(tag)]
        elif tag == "br":
            if start and now is not None:
                now.break_line()
        elif tag in ("hr", "img"):
            if start:
                flush()
                src, alt = token[2].get("src", ""), _BLANK.sub(" ", token[2].get("alt", "")).strip(" ")
                if limits.total_bytes is not None and total >= limits.total_bytes:
                    lost["images"] += 1
                elif tag == "hr" or src or alt:
                    emit("rule" if tag == "hr" else "image", "" if tag == "hr" else alt, [], src=src or None if tag == "img" else None)
        elif tag == "p":
            flush()
            if start:
                begin("paragraph")
        elif re.fullmatch("h[1-6]", tag):
            flush()
            if start:
                begin("heading", int(tag[1]))
        elif tag == "blockquote":
            flush()
            quotes = min(quotes + 1, 4) if start else max(quotes - 1, 0)
            if start:
                begin("blockquote", quotes)
        elif tag in ("ul", "ol"):
            flush()
            if start and len(lists) < 6:
                lists.append([tag == "ol", 0])
            elif not start and lists:
                lists.pop()
        elif tag == "li":
            flush()
            if start:
                if lists:
                    lists[-1][1] += 1
                begin("list-item", max(len(lists), 1), bool(lists and lists[-1][0]), lists[-1][1] if lists else 0)
        elif tag == "pre":
            flush()
            keep = start
            if start:
                begin("code")
        elif tag == "figcaption":
            flush()
            if start:
                begin("caption")
        elif tag in BREAKS:
            flush()
    flush()
    return out


def html_to_blocks(page: Column, limits: Limits = Limits()) -> Column:
    """The blocks of each page."""

    @F.pandas_udf(ArrayType(BLOCK))
    def blocks(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: html_blocks(p, limits))

    return blocks(page)


_LOST = ("blocks", "texts", "runs", "images")


def html_losses(page: Column, limits: Limits = Limits()) -> Column:
    """What the limits cut from each page: struct(kept, blocks, texts, runs, images), the first the number of blocks kept."""

    @F.pandas_udf(StructType([StructField(c, IntegerType()) for c in ("kept", *_LOST)]))
    def losses(pages: pd.Series) -> pd.DataFrame:
        rows = []
        for p in pages:
            lost: Counter = Counter()
            rows.append((len(html_blocks(p, limits, lost)), *[lost[c] for c in _LOST]))
        return pd.DataFrame(rows, columns=["kept", *_LOST], dtype="int32")

    return losses(page)


def plain_text(blocks: list[dict], most: int) -> str:
    """The text of blocks on one line, at most ``most`` bytes, cut between words."""
    return clip(_BLANK.sub(" ", " ".join(b["text"] for b in blocks if b["type"] not in ("image", "rule"))).strip(" "), most)


def clip(text: str, most: int) -> str:
    """At most ``most`` bytes and an ellipsis; cut at a blank if there is one in the second half, never inside a character."""
    raw = text.encode()
    if len(raw) <= most:
        return text
    head = raw[: most + 1]
    space = head.rfind(b" ")
    kept = raw[:space] if space > most // 2 else raw[:most]
    return kept.decode("utf-8", "ignore").strip() + "…"
