"""Text decoded with another encoding than it was written in.

Three passes over the values:

1. Words with non-ASCII characters are counted and keyed by what is left of them without those characters; texts
   that have no ASCII letter are keyed by the places and sizes of what was taken out. Under one key the most frequent
   and the shortest form are taken as the clean twin, and every other form is joined with it (two pairs per form, not
   all pairs).
2. Pairs are aligned: the ASCII characters are anchors, and the runs between two anchors belong together. A run
   pair votes for the ways of (mis)reading that turn the clean run into the garbled one. Texts without a twin whose letter
   pairs are almost unknown to the corpus vote for the ways whose reversal makes them usual ones. The ways that are needed to
   explain the votes are the learned ones; together with the alphabet and the letter pairs of the corpus they make
   the tables of garbled sequences.
   Aligned pairs that no way of the list explains teach a map of their own, of garbled runs to the letters meant: a run
   has to stand for one letter in nearly all words of several keys, and most words with it have to have such a twin.
3. The tables are applied to all values, again and again while that changes something (text garbled twice).

What is collected to the driver is bounded by the ways of misreading (a fixed list), by the letters of one-byte encodings and their pairs, and by the
alphabet (Unicode).
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.fields import values_of, with_texts
from folioflow.session import cut

# Encodings that may have been written, and those that may have been assumed when reading.
WRITTEN = ("utf-8", "cp1252", "cp1251", "koi8-r", "cp866", "iso8859-5", "mac-roman", "cp1250")
READ = ("cp1252", "latin-1", "cp1251", "mac-roman", "cp437", "cp850", "cp1250", "koi8-r", "iso8859-2", "iso8859-15", "cp866", "iso8859-5", "mac-cyrillic")

#: names of ways, alphabet with counts, letter pairs with counts, and runs that alignment alone taught
Learned = tuple[list[str], dict[str, int], dict[str, int], dict[str, str]]

_RUN = re.compile(r"([^\x00-\x7f]+)")
_WORD = re.compile(r"\S+")


def byte_table(codec: str) -> str:
    """The 256 characters of a one-byte encoding; undefined bytes stay control characters."""
    return "".join((bytes([b]).decode(codec, "ignore") or chr(b)) for b in range(256))


class Misreading:
    """Text written in one encoding and read in another one."""

    def __init__(self, written: str, read: str):
        self.written, self.read, self.name = written, read, f"{written}>{read}"
        self.chars = byte_table(read)
        self.bytes_of = {c: bytes([b]) for b, c in reversed(list(enumerate(byte_table(written))))} if written != "utf-8" else None

    def garble(self, text: str) -> str | None:
        """What the reader saw, or null where the text can't be written so."""
        try:
            raw = text.encode("utf-8") if self.bytes_of is None else b"".join(self.bytes_of[c] for c in text)
        except (KeyError, UnicodeEncodeError):
            return None
        return "".join(self.chars[b] for b in raw)


#: what letter pairs have to show: the characters of a text that votes without a twin, and how many nats likelier each of its pairs has to get;
#: the pairs and the nats, in all and each, by which a word's letters are replaced one by one
ALONE_CHARS, ALONE_MARGIN, SWAP_PAIRS, SWAP_GAIN, SWAP_GAIN_EACH = 12, 1.5, 3, 8.0, 2.0
#: what one-byte encodings hold besides ASCII: letter pairs are counted among these only
BYTE_CHARS = frozenset(c for codec in {*WRITTEN, *READ} - {"utf-8"} for c in byte_table(codec)[128:])


def misreadings() -> list[Misreading]:
    return [Misreading(w, r) for w in WRITTEN for r in READ if w != r]


def _letters_only(word: str) -> str:
    return "".join(c for c in word if c.isascii() and c.isalpha())


def count_forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(kind, key, form, n): ``word`` and ``text`` forms by key, ``char`` and ``pair`` counts; summed per batch."""
    for batch in batches:
        words: Counter = Counter()
        texts: Counter = Counter()
        for text in batch["text"]:
            if not text.isascii():
                words.update([w for w in text.split() if not w.isascii()])
                if not any("a" <= c <= "z" or "A" <= c <= "Z" for c in text):
                    texts[text] += 1
        chars: Counter = Counter()
        pairs: Counter = Counter()
        rows = []
        for word, n in words.items():
            for c in set(word):
                if c > "\x7f":
                    chars[c] += n
            for a, b in zip(word, word[1:], strict=False):
                if a in BYTE_CHARS and b in BYTE_CHARS and a.isalpha() and b.isalpha():
                    pairs[a + b] += n
            if len(key := _letters_only(word)) >= 3:
                rows.append(("word", _RUN.sub("", word), word, n))
        rows += [row for t, n in texts.items() for row in (("text", _mask(t), t, n), ("wide", _mask(t, True), t, n))]
        rows += [("char", "", c, n) for c, n in chars.items()] + [("pair", "", p, n) for p, n in pairs.items()]
        yield pd.DataFrame(rows, columns=["kind", "key", "form", "n"])


def _mask(text: str, as_bytes: bool = False) -> str:
    """The text with a mark for each non-ASCII character, or for each byte of them."""
    return _RUN.sub(lambda m: "#" * len(m.group().encode("utf-8", "replace") if as_bytes else m.group()), text)


def votes_of(clean: str, garbled: str, ways: list[Misreading]) -> list[int]:
    """The ways that turn every differing run of ``clean`` into the run of ``garbled`` at the same place, once or twice read."""
    a, b = _RUN.split(clean), _RUN.split(garbled)
    if len(a) != len(b) or a[::2] != b[::2]:
        return []
    runs = [(x, y) for x, y in zip(a[1::2], b[1::2], strict=True) if x != y]
    much = sum(len(x) for x, _ in runs) >= 4 or any("\x80" <= c <= "\x9f" for _, y in runs for c in y)
    found = []
    for k, way in enumerate(ways):
        if runs and (much or way.bytes_of is None) and all((g := way.garble(x)) == y or g is not None and way.garble(g) == y for x, y in runs):
            found.append(k)
    return found


def unexplained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(seen, meant, key): aligned runs of words and their clean twins that no listed way explains; runs of equal length letter by letter."""
    ways = misreadings()
    for batch in batches:
        rows = set()
        for key, form, twin in zip(batch["key"], batch["form"], batch["twin"], strict=True):
            a, b = _RUN.split(twin), _RUN.split(form)
            if len(a) != len(b) or a[::2] != b[::2] or votes_of(twin, form, ways) or votes_of(form, twin, ways):
                continue
            for meant, seen in zip(a[1::2], b[1::2], strict=True):
                letters = zip(seen, meant, strict=True) if len(seen) == len(meant) else [(seen, meant)] if len(meant) == 1 else ()
                rows.update((y, x, key) for y, x in letters if x != y and x.isalpha() and y.isprintable() and "\ufffd" not in y)
        yield with_texts(pd.DataFrame(index=range(len(rows))), **{c: [r[k] for r in sorted(rows)] for k, c in enumerate(("seen", "meant", "key"))})


def learn_map(words: DataFrame, twins: DataFrame, least_keys: int = 5, share: float = 0.9, most_words: float = 0.8, least_letters: int = 3, clean: int = 4) -> dict[str, str]:
    """Garbled runs, and the letters that are meant, that alignment alone teaches.

    ``words`` has key, form and n, ``twins`` key, twin and twin_n. A twin is taken for clean if it is ``clean`` times as frequent. A run is learned that is aligned
    with one letter under ``least_keys`` keys and in ``share`` of all of its own, and if ``most_words`` of the distinct words that hold it have
    such a twin; a run that only some words hold by mistake is a letter of its own. Fewer than ``least_letters`` runs are no encoding, and none is learned.
    At most one row per letter of the alphabet comes to the driver.
    """
    near = words.join(twins, "key").filter((F.col("form") != F.col("twin")) & (F.col("twin_n") >= clean * F.col("n"))).select("key", "form", "twin")
    pairs = cut(near.mapInPandas(unexplained, "seen string, meant string, key string"))
    counted = pairs.groupBy("seen", "meant").agg(F.countDistinct("key").alias("keys"))
    best = counted.groupBy("seen").agg(F.max_by("meant", F.struct("keys", "meant")).alias("meant"), F.max("keys").alias("keys"), F.sum("keys").alias("all"))
    sure = {r.seen: (r.meant, r["keys"]) for r in best.filter((F.col("keys") >= least_keys) & (F.col("keys") >= share * F.col("all"))).collect()}
    if len(sure) < least_letters:
        return {}

    def holding(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held: Counter = Counter()
            for key, form in zip(batch["key"], batch["form"], strict=True):
                held.update((s, key) for s in sure if s in form)
            yield with_texts(pd.DataFrame(index=range(len(held))), seen=[s for s, _ in held], key=[k for _, k in held])

    total = {r.seen: r.n for r in words.select("key", "form").mapInPandas(holding, "seen string, key string").groupBy("seen").agg(F.countDistinct("key").alias("n")).collect()}
    found = {s: meant for s, (meant, keys) in sure.items() if keys >= most_words * total[s]}
    return found if len(found) >= least_letters else {}


def _familiar(text: str, pairs: dict[str, int]) -> float:
    """Mean log count of the non-ASCII letter pairs of a text."""
    own = [math.log(pairs.get(a + b, 0) + 0.5) for a, b in zip(text, text[1:], strict=False) if a in BYTE_CHARS and b in BYTE_CHARS and (a.isalpha() or b.isalpha())]
    return sum(own) / len(own) if own else 0.0


def vote(pairs: dict[str, int]):
    """(ways, votes): twins by the set of ways that explain them; one-to-one ways have to lead from the usual letters to the unusual."""
    ways = misreadings()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            votes: Counter = Counter()
            for form, twin in zip(batch["form"], batch["twin"], strict=True):
                for clean, garbled in ((twin, form), (form, twin)):
                    found = votes_of(clean, garbled, ways)
                    if found and _familiar(clean, pairs) < _familiar(garbled, pairs) + 1:
                        found = [k for k in found if ways[k].bytes_of is None or any("\x80" <= c <= "\x9f" for c in garbled)]
                    if found:
                        votes[",".join(map(str, found))] += 1
            yield pd.DataFrame(list(votes.items()), columns=["ways", "votes"])

    return run


def vote_alone(pairs: dict[str, int]):
    """Votes of texts without twin: their letter pairs are unusual (by ``ALONE_MARGIN`` nats each), and usual ones once a way is undone."""
    margin, total = ALONE_MARGIN, max(1, sum(pairs.values()))
    expected = sum(n * math.log(n + 0.5) for n in pairs.values()) / total
    ways = list(enumerate(misreadings()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backs = [(k, {ord(w.chars[b[0]]): c for c, b in w.bytes_of.items()} if w.bytes_of else {c: bytes([b]) for b, c in reversed(list(enumerate(w.chars)))}) for k, w in ways]
        for batch in batches:
            votes: Counter = Counter()
            for text in batch["form"]:
                seen = _familiar(text, pairs)
                if len(text) >= ALONE_CHARS and seen < expected - margin:
                    usual: dict[int, float] = {}
                    for k, table in backs:
                        if ways[k][1].bytes_of is None:
                            meant = b"".join(table.get(c, b"?") for c in text).decode("utf-8", "replace")
                            if 10 * meant.count("\ufffd") > len(meant):
                                continue
                        else:
                            meant = text.translate(table)
                            if 2 * sum(a != b for a, b in zip(text, meant, strict=True)) < sum(c > "\x7f" for c in text):
                                continue  # most of the text has to be in the other encoding
                        usual[k] = round(_familiar(meant, pairs), 6) if len(meant) >= 8 else 0.0
                    best = max(usual.values(), default=0.0)
                    if best > seen + margin:
                        votes[",".join(str(k) for k, x in usual.items() if x == best)] += 1
            yield pd.DataFrame(list(votes.items()), columns=["ways", "votes"])

    return run


def choose_ways(votes: dict[str, int], least: int) -> list[int]:
    """The fewest ways that explain the votes, greedily; a way has to explain ``least`` pairs that no other one does."""
    open_votes = {tuple(map(int, k.split(","))): n for k, n in votes.items()}
    chosen = []
    while open_votes:
        score: Counter = Counter()
        for ks, n in open_votes.items():
            for k in ks:
                score[k] += n
        best, n = min(score.items(), key=lambda x: (-x[1], x[0]))
        if n < least:
            break
        chosen.append(best)
        open_votes = {ks: n for ks, n in open_votes.items() if best not in ks}
    return chosen


def _java_class(chars: set[str]) -> str:
    """A Java character class, neighbours joined to ranges."""
    ranges: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]"


class Restorer:
    """The learned tables, applied to one text at a time."""

    def __init__(self, ways: list[str], alphabet: dict[str, int], pairs: dict[str, int], runs: dict[str, str] | None = None):
        self.pairs, self.runs = pairs, runs or {}
        self.run_pattern = re.compile("|".join(map(re.escape, sorted(self.runs, key=len, reverse=True)))) if self.runs else None
        self.total = sum(pairs.values()) + 1
        self.tables, self.swaps = [], []
        self.known: dict[tuple[str, str], float] = {}  # words were judged before: texts repeat them
        for name in ways:
            way = Misreading(*name.split(">"))
            table = {g: c for c in sorted(alphabet, key=alphabet.get) if c > "\x7f" and (g := way.garble(c)) and g != c}
            if way.written == "utf-8":
                again = {c for g in table for c in g} | {chr(b) for b in range(0x80, 0xA0)}  # what a second misreading starts from
                table |= {g: c for c in again if (g := way.garble(c)) and g not in table}
                table = {g: c for g, c in table.items() if len(g) > 1}
                table |= {g[:-1] + " ": c for g, c in table.items() if g[-1] == "\xa0" and g[0] < "\u0250"}  # a no-break space often becomes a blank
                self.tables.append((name, table, self._pattern(table, True), self._pattern(table, False)))
            else:
                controls = {g: c for g, c in table.items() if "\x80" <= g <= "\x9f"}
                if controls:
                    self.tables.append((name, controls, *[re.compile("[" + "".join(map(re.escape, controls)) + "]")] * 2))
                letters = {ord(g): c for g, c in table.items() if g.isalpha() or c.isalpha()}
                if sum(c.isalpha() for c in letters.values()) > 20:
                    self.swaps.append((name, letters, {ord(g): c for g, c in table.items()}))

    @staticmethod
    def _pattern(table: dict[str, str], sure: bool) -> re.Pattern:
        """Any garbled sequence. To be ``sure``, those of or with Cyrillic letters have to come in twos, and none ends a capital's word.

        Every branch begins with a plain character: the search then looks for those only.
        """
        once, twice = defaultdict(list), defaultdict(list)
        for g, c in table.items():
            (twice if sure and ("\u0400" <= c <= "\u04ff" or "\u0400" <= g[0] <= "\u04ff") else once)[g[0]].append(g[1:])

        def branches(leads: dict[str, list[str]], after: str = "") -> list[str]:
            out = []
            for lead, rests in leads.items():
                ones = "".join(re.escape(r) for r in rests if len(r) == 1 and r != " ")
                more = [re.escape(r) for r in sorted(rests, key=len, reverse=True) if len(r) > 1]
                if more or ones:
                    out.append(re.escape(lead) + "(?:" + "|".join(more + ([f"[{ones}]"] if ones else [])) + ")" + after)
                if " " in rests:
                    out.append(re.escape(lead) + (f"(?<![A-Z]{re.escape(lead)})" if sure else "") + " " + after)
            return out

        return re.compile("|".join(branches(once) + branches(twice, f"(?:{'|'.join(branches(twice))})+")))

    def suspect(self) -> str:
        """A Java pattern that every text has a match of which ``restore`` may change; ASCII is passed over at once."""
        parts = ["[\\x{80}-\\x{9f}\\x{fffd}]"]
        for _, table, _, _ in self.tables:
            wide = [g for g in table if len(g) > 1]
            if wide:
                parts.append(_java_class({g[0] for g in wide}) + _java_class({g[1] for g in wide}))
        parts += [_java_class({chr(c) for c in letters if c > 127}) + "{3}" for _, letters, _ in self.swaps]
        parts += ["".join(f"\\x{{{ord(c):x}}}" for c in run) for run in self.runs]
        return "(?=[^\\x{00}-\\x{7f}])(?:" + "|".join(parts) + ")"

    def gain(self, seen: str, meant: str) -> tuple[float, int]:
        """How much likelier the letter pairs of ``meant`` are, in nats, and over how many pairs."""
        total, k = 0.0, 0
        for i in range(len(seen) - 1):
            if seen[i] > "\x7f" and seen[i + 1] > "\x7f" and seen[i].isalpha() and meant[i].isalpha() and meant[i + 1].isalpha():
                total += math.log((self.pairs.get(meant[i : i + 2], 0) + 0.5) / (self.pairs.get(seen[i : i + 2], 0) + 0.5))
                k += 1
        return total, k

    def _undo_table(self, text: str) -> tuple[str, str] | None:
        best = None
        for name, table, sure, every in self.tables:
            hits = sure.findall(text)
            if hits and (best is None or sum(map(len, hits)) > best[0]):
                best = (sum(map(len, hits)), name, table, every)
        if best is None:
            return None
        _, name, table, pattern = best
        size = max(map(len, table))

        def back(m: re.Match) -> str:
            s, out, i = m.group(), [], 0
            while i < len(s):
                for k in range(min(size, len(s) - i), 0, -1):
                    if s[i : i + k] in table:
                        out.append(table[s[i : i + k]])
                        i += k
                        break
                else:
                    out.append(s[i])
                    i += 1
            return "".join(out)

        return name, pattern.sub(back, text)

    def _undo_swap(self, text: str) -> tuple[str, str] | None:
        """Words whose letter pairs get much likelier under one-to-one replacement, with their neighbours in between."""
        best = None
        for name, letters, everything in self.swaps:
            spans = []
            for m in _WORD.finditer(text):
                word = m.group()
                if word.isascii():
                    continue
                gained = self.known.get((name, word))
                if gained is None:
                    total, k = self.gain(word, word.translate(letters))
                    most = 2 * sum(ord(c) in letters for c in word) >= sum(c > "\x7f" for c in word)
                    gained = self.known[name, word] = total if most and k >= SWAP_PAIRS and total > SWAP_GAIN_EACH * k and total > SWAP_GAIN else 0.0
                if gained:
                    spans.append((m.start(), m.end(), gained))
            if spans and (best is None or sum(s[2] for s in spans) > best[0]):
                best = (sum(s[2] for s in spans), name, spans[0][0], spans[-1][1], everything)
        if best is None:
            return None
        _, name, start, end, everything = best

        def short(words: list[re.Match]) -> int:
            """How many of the neighbouring words belong to the stretch."""
            n = 0
            for m in words:
                total, k = self.gain(m.group(), m.group().translate(everything))
                if k and total <= 0 or m.group().isascii() and any(c.isalpha() for c in m.group()):
                    break
                n += 1
            return n

        before, after = list(_WORD.finditer(text[:start])), list(_WORD.finditer(text[end:]))
        if k := short(before[::-1]):
            start = before[-k].start()
        if k := short(after):
            end += after[k - 1].end()
        return name, text[:start] + text[start:end].translate(everything) + text[end:]

    def restore(self, text: str) -> tuple[str, str] | None:
        """(ways, restored text), or null when the text isn't garbled; lost characters stay U+FFFD."""
        if len(self.known) > 1_000_000:
            self.known.clear()
        ways, now, met = [], text, {text}
        while (step := self._undo_table(now) or self._undo_swap(now)) and step[1] not in met:
            ways.append(step[0])
            now = step[1]
            met.add(now)
        if self.run_pattern and (mended := self.run_pattern.sub(lambda m: self.runs[m.group()], now)) != now:
            ways.append("aligned")
            now = mended
        if not ways and any("\x80" <= c <= "\x9f" for c in now):
            ways.append("unknown")
        if "\ufffd" in now:
            ways.append("lost")
        return (">".join(ways), now) if ways else None


def count_all(values: DataFrame) -> DataFrame:
    """(kind, key, form, n) over all values, materialised."""
    counted = values.select("text").mapInPandas(count_forms, "kind string, key string, form string, n bigint")
    return cut(counted.groupBy("kind", "key", "form").agg(F.sum("n").alias("n")))


def learn(values: DataFrame, least_votes: int = 3, least_chars: int = 3) -> Learned:
    """What the ``text`` column of ``values`` teaches."""
    return learn_from(count_all(values), least_votes, least_chars)


def learn_from(forms: DataFrame, least_votes: int = 3, least_chars: int = 3) -> Learned:
    """What :func:`learn` gives, from counted forms."""
    letters = forms.filter(F.col("kind").isin("char", "pair") & (F.col("n") >= least_chars)).select("kind", "form", "n").collect()
    alphabet = {r.form: r.n for r in letters if r.kind == "char" and not "\x80" <= r.form <= "\x9f" and r.form != "\ufffd"}
    usual = {r.form: r.n for r in letters if r.kind == "pair"}
    keyed = forms.filter(F.col("kind").isin("word", "text", "wide"))
    twins = keyed.groupBy("kind", "key").agg(F.max_by("form", F.struct("n", "form")).alias("common"), F.min_by("form", F.struct(F.length("form"), "form")).alias("short"), F.count("*").alias("forms"))
    near = twins.filter("forms > 1 and kind <> 'wide'").drop("forms").unionByName(twins.filter("kind = 'wide'").select(F.lit("text").alias("kind"), "key", "common", F.col("common").alias("short")))
    pairs = keyed.filter("kind <> 'wide'").join(near, ["kind", "key"]).select("form", F.explode(F.array_distinct(F.array("common", "short"))).alias("twin")).filter("form <> twin")
    votes = pairs.mapInPandas(vote(usual), "ways string, votes bigint").unionByName(forms.filter("kind = 'text'").select("form").mapInPandas(vote_alone(usual), "ways string, votes bigint"))
    summed = {r.ways: r.votes for r in votes.groupBy("ways").agg(F.sum("votes").alias("votes")).collect()}
    names = misreadings()
    common = keyed.filter("kind = 'word'").groupBy("key").agg(F.max_by("form", F.struct("n", "form")).alias("twin"), F.max("n").alias("twin_n"), F.count("*").alias("forms")).filter("forms > 1").drop("forms")
    runs = learn_map(keyed.filter("kind = 'word'").select("key", "form", "n"), common)
    return [names[k].name for k in choose_ways(summed, least_votes)], alphabet, usual, runs


def restore_encoding(values: DataFrame, learned: Learned | None = None) -> DataFrame:
    """The garbled rows of ``values`` with ``ways`` and ``restored`` added.

    ``values`` has a ``text`` column; null and empty texts are never garbled, other columns pass through and repeated rows stay
    repeated. ``restored`` is the text with every garbled sequence replaced; characters lost in reading stay U+FFFD
    (``ways`` ends in ``lost``). A value's clean or ambiguous stretches stay as they are. A table without rows or
    without twins teaches nothing but U+FFFD and stray control characters, which need no table.
    """
    known = learned or learn(values.filter(F.col("text").isNotNull()))
    suspect = Restorer(*known).suspect()
    extra = [f for f in values.schema.fields if f.name not in ("ways", "restored")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in extra) + ", ways string, restored string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer = Restorer(*known)
        for batch in batches:
            done = [restorer.restore(t) for t in batch["text"]]
            hit = [d is not None for d in done]
            yield with_texts(batch[hit], ways=[d[0] for d in done if d], restored=[d[1] for d in done if d])

    return values.select(*[f"`{f.name}`" for f in extra]).filter((F.length("text") != F.octet_length("text")) & F.col("text").rlike(suspect)).mapInPandas(run, schema)


def fill_lost(restored: DataFrame, forms: DataFrame, *key: str) -> DataFrame:
    """``restored`` with words that lost characters (U+FFFD) replaced by their clean near-twin, where the corpus has one.

    A twin has the same ASCII letters and its other characters at the same places; the most frequent one counts. ``key`` names the columns
    that tell rows apart. Words without a twin keep U+FFFD.
    """
    hole, places = "\ufffd", lambda c: F.regexp_replace(c, r"[^\x{00}-\x{7f}]+", "#")
    words = restored.filter(F.col("restored").contains(hole)).select(*key, F.explode(F.array_distinct(F.split("restored", r"\s+"))).alias("word")).filter(F.col("word").contains(hole))
    wanted = words.select("word", places(F.col("word")).alias("places")).distinct()
    clean = forms.filter((F.col("kind") == "word") & ~F.col("form").contains(hole)).select(places(F.col("form")).alias("places"), "form", "n")
    twins = wanted.join(clean, "places").groupBy("word").agg(F.max_by("form", F.struct("n", "form")).alias("twin"))
    swaps = words.join(twins, "word").groupBy(*key).agg(F.collect_list(F.struct("word", "twin")).alias("_swaps"))  # at most the words of one value
    filled = F.aggregate(F.coalesce("_swaps", F.array()), F.col("restored"), lambda t, s: F.replace(t, s.word, s.twin))
    return restored.join(swaps, list(key), "left").withColumn("restored", filled).drop("_swaps")


def p1_garbled(spark, sf_dir: str) -> DataFrame:
    """Garbled titles, authors and blocks with the restored text."""
    values = values_of(spark.read.parquet(f"{sf_dir}/items.parquet"), author=True)
    forms = count_all(values)
    return fill_lost(cut(restore_encoding(values, learn_from(forms))), forms, "item_id", "field", "pos")


def p1_found(spark, sf_dir: str) -> DataFrame:
    """The garbled values, whether or not they can be restored."""
    return restore_encoding(values_of(spark.read.parquet(f"{sf_dir}/items.parquet"), author=True)).select("item_id", "field", "pos").distinct()
