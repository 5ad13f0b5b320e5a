"""RSS, RDF and Atom documents to items; OPML and TOML subscriptions to feeds."""

from __future__ import annotations

import re
import tomllib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from folioflow.sources.html import BLOCK, clip, html_blocks, plain_text
from folioflow.sources.markup import decode_bytes, tokens

SUMMARY_BYTES, MAX_DEPTH = 480, 32
ITEM = StructType(
    [StructField("item_pos", IntegerType())]
    + [StructField(c, StringType()) for c in ("guid", "title", "author", "link", "published_raw", "source_name", "summary_text", "content_source")]
    + [StructField("text_bytes", LongType()), StructField("blocks", ArrayType(BLOCK))]
)
FEED = StructType([StructField("format", StringType()), StructField("title", StringType()), StructField("items_seen", IntegerType()), StructField("stopped_early", BooleanType()), StructField("items", ArrayType(ITEM))])

# Folder names that stand for no section.
PLACEHOLDERS = frozenset(("uncategorized", "uncategorised", "unsorted", "unfiled", "imported", "subscriptions", "no folder", "(no folder)", "all"))
_BLANK = re.compile(r"[ \t\n\r\f\v]+")


def _line(text: str) -> str:
    return _BLANK.sub(" ", text).strip(" ")


def tidy_title(raw: str) -> str:
    """One line without markup; a title that still has tags or entities is read as HTML once more."""
    text = _line(raw)
    if "<" in text or "&" in text:
        text = _line(" ".join(b["text"] for b in html_blocks(text)))
    return text


def tidy_author(raw: str) -> str:
    """The name in brackets of a mail address, nothing for a bare address."""
    text = _line(raw)
    inner = re.search(r"\((.*)\)", text)
    if inner and inner.group(1).strip():
        return inner.group(1).strip()
    return "" if "@" in text and " " not in text else text


def _replayed(name: str, attributes: dict[str, str]) -> str:
    kept = "".join(f' {k}="{v}"' for k, v in attributes.items() if k in ("src", "alt"))
    return f"<{name}{kept}>"


class _Reader:
    """One pass over the tokens of a feed; items are known by their element, whatever the format is."""

    def __init__(self, max_items: int):
        self.max_items, self.format, self.title = max_items, "", ""
        self.seen, self.items, self.path, self.item = 0, [], [], None
        self.texts: list[str] = []
        self.body: str | None = None  # the element whose markup is collected

    @property
    def full(self) -> bool:
        return len(self.items) >= self.max_items

    def start(self, name: str, attributes: dict[str, str]) -> None:
        prefix, _, local = name.rpartition(":")
        if self.body is not None:
            self.texts.append(_replayed(local, attributes))
            self.path.append(name)
            return
        if not self.format and local in ("rss", "rdf", "feed"):
            self.format = {"feed": "atom"}.get(local, local)
        if self.item is None and not prefix and local in ("item", "entry"):
            self.item = {"dates": {}, "depth": len(self.path)}
        elif self.item is not None:
            if local == "link" and not prefix and attributes.get("href"):
                plain = attributes.get("rel", "") in ("", "alternate") and (not attributes.get("type") or "html" in attributes["type"])
                if plain:
                    self.item.setdefault("link", attributes["href"].strip())
            if (not prefix and local in ("content", "description", "summary")) or name == "content:encoded":
                self.body = name
        self.path.append(name)
        self.texts = []

    def end(self, name: str) -> None:
        if name not in self.path[-MAX_DEPTH:]:
            return
        while self.path:
            top = self.path.pop()
            self.close(top)
            if top == name or self.full:
                return

    def close(self, name: str) -> None:
        prefix, _, local = name.rpartition(":")
        text = "".join(self.texts)
        if self.body is not None and not (name == self.body and self.body not in self.path):
            self.texts.append(f"</{local}>")
            return
        if self.item is None:
            if local == "title" and not prefix and not self.title and not self.seen and len(self.path) <= 2:
                self.title = tidy_title(text)
            self.texts = []
            return
        item = self.item
        if self.body is not None:
            kind = "content" if local in ("content", "encoded") else "summary"
            if text.strip():
                item.setdefault(kind, text)
            self.body = None
        elif not prefix and local == "title" and text.strip():
            item.setdefault("title", tidy_title(text))
        elif not prefix and local == "link" and text.strip():
            item.setdefault("link", text.strip())
        elif not prefix and local in ("guid", "id") and text.strip():
            item.setdefault("guid", text.strip())
        elif not prefix and local == "name" and self.path[-1:] == ["author"] and text.strip():
            item["author"] = tidy_author(text)
        elif (not prefix and local == "author" or name == "dc:creator") and text.strip():
            item.setdefault("author", tidy_author(text))
        elif (not prefix and local in ("pubdate", "published", "issued")) or name == "dc:date":
            item["dates"]["published"] = text.strip()
        elif not prefix and local in ("updated", "modified"):
            item["dates"]["updated"] = text.strip()
        elif not prefix and local in ("item", "entry") and len(self.path) == item["depth"]:
            self.emit()
        self.texts = []

    def emit(self) -> None:
        item, self.item = self.item, None
        self.seen += 1
        content = html_blocks(item["content"]) if item.get("content") else []
        summary = html_blocks(item["summary"]) if item.get("summary") else []
        blocks = content or summary
        if not item.get("title") and not blocks:
            return
        self.items.append(
            {
                "item_pos": len(self.items),
                "guid": item.get("guid", ""),
                "title": item.get("title", ""),
                "author": item.get("author", ""),
                "link": item.get("link", ""),
                "published_raw": item["dates"].get("published") or item["dates"].get("updated"),
                "source_name": self.title,
                "summary_text": plain_text(summary or blocks, SUMMARY_BYTES),
                "content_source": "full-content" if content else "summary" if summary else "none",
                "text_bytes": sum(len(b["text"].encode()) for b in blocks),
                "blocks": blocks,
            }
        )


def parse_feed(text: str | None, max_items: int = 1_000_000) -> dict:
    """Format, title and items of a feed document; stops reading after ``max_items`` items, and none are read for 0.

    Unclosed items are kept, stray end tags are passed over, a text that is no feed has no items.
    """
    reader = _Reader(max_items)
    for token in tokens(text or "") if max_items > 0 else ():
        if token[0] == "text":
            reader.texts.append(token[1])
        elif token[0] == "end":
            reader.end(token[1])
        else:
            reader.start(token[1], token[2])
            if token[3]:
                reader.end(token[1])
        if reader.full:
            break
    else:
        while reader.path and not reader.full:
            reader.close(reader.path.pop())
    return {"format": reader.format or "unknown", "title": reader.title, "items_seen": reader.seen, "stopped_early": reader.full, "items": reader.items}


def feed_items(documents: DataFrame, column: str, max_items: int | None = None) -> DataFrame:
    """Feed documents (text, or binary as read by ``binaryFile``) with ``feed`` added; a column ``max_items`` limits each row."""
    binary = dict(documents.dtypes)[column] == "binary"

    @F.pandas_udf(FEED)
    def read(texts: pd.Series, most: pd.Series) -> pd.DataFrame:
        decoded = texts.map(lambda t: decode_bytes(t) if binary and t is not None else t)
        return pd.DataFrame([parse_feed(t, int(n)) for t, n in zip(decoded, most, strict=True)], columns=FEED.names)

    limit: Column = F.col("max_items") if max_items is None and "max_items" in documents.columns else F.lit(1_000_000 if max_items is None else max_items)
    return documents.withColumn("feed", read(F.col(column), F.coalesce(limit, F.lit(1_000_000))))


OUTLINE = ArrayType(StructType([StructField("pos", IntegerType()), StructField("url", StringType()), StructField("title", StringType()), StructField("section", StringType())]))


def tidy_section(name: str, default: str = "News") -> str:
    """A section name of at most 40 bytes, cut between characters; placeholders and nothing are the default section."""
    text = _line(name)
    if not text or text.lower() in PLACEHOLDERS:
        return default
    return text.encode()[:40].decode("utf-8", "ignore").strip()


def parse_opml(text: str | None) -> list[dict]:
    """Outlines with an ``xmlUrl`` in document order; the outermost folder is the section."""
    folders: list[str | None] = []
    out = []
    for token in tokens(text or ""):
        if token[0] == "start" and token[1] == "outline":
            a = token[2]
            url = a.get("xmlurl", "").strip()
            name = a.get("text") or a.get("title") or ""
            if url:
                outer = next((f for f in folders if f is not None), "")
                out.append({"pos": len(out), "url": url, "title": _line(name), "section": tidy_section(outer)})
            if not token[3]:
                folders.append(None if url else name)
        elif token[0] == "end" and token[1] == "outline" and folders:
            folders.pop()
    return out


def opml_feeds(files: DataFrame, column: str, *order: str) -> DataFrame:
    """(feed_pos, url, title, section) of subscription files merged; the first of each address counts."""

    @F.pandas_udf(OUTLINE)
    def read(texts: pd.Series) -> pd.Series:
        return texts.map(parse_opml)

    rows = files.select(*order, F.explode(read(F.col(column))).alias("o")).select(*order, "o.*")
    first = rows.groupBy("url").agg(F.min_by(F.struct("title", "section"), F.struct(*order, "pos")).alias("x"), F.min(F.struct(*order, "pos")).alias("at"))
    return first.select("url", "x.title", "x.section", "at")


DEFAULTS = {"title": "The Edition", "max_age_days": 3, "max_items": 40, "min_per_section": 2, "max_pages": 0}


def read_config(text: str) -> dict:
    """``edition`` settings and ``feeds`` of a TOML text; unknown keys are ignored. Raises ValueError without a feed or an address."""
    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ValueError(f"not a TOML text: {e}") from None
    feeds = data.get("feed", [])
    if not feeds:
        raise ValueError("no [[feed]]")
    rows = []
    for pos, feed in enumerate(feeds):
        if not feed.get("url"):
            raise ValueError(f"feed {pos + 1} has no url")
        rows.append({"feed_pos": pos, "url": feed["url"], "section": feed.get("section") or "News", "max_items": int(feed.get("max_items", 6))})
    edition = DEFAULTS | {k: v for k, v in data.get("edition", {}).items() if k in DEFAULTS}
    return {"edition": edition, "feeds": rows}


def write_config(feeds: list[dict]) -> str:
    """Feeds as TOML, grouped by section in order of first appearance."""

    def quoted(s: str) -> str:
        return '"' + s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'

    sections = list(dict.fromkeys(f["section"] for f in feeds))
    parts = []
    for section in sections:
        parts += [f"[[feed]]\nurl = {quoted(f['url'])}\nsection = {quoted(section)}\n" for f in feeds if f["section"] == section]
    return "\n".join(parts)


__all__ = ["FEED", "clip", "feed_items", "opml_feeds", "parse_feed", "parse_opml", "read_config", "tidy_author", "tidy_section", "tidy_title", "write_config"]
