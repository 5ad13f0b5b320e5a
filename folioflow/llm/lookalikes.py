"""Text that looks the same but is made of other characters.

``skeleton`` follows the confusables method: decompose, replace every character by the prototype of its look-alikes,
decompose again; texts that look alike have one skeleton. Words of the corpus are grouped by equal skeleton, and the form that a group
has chosen, its most frequent one in letters of a single script, is the ordinary form of all words in it. ``plain`` is the consistent form that text
is brought to: a word takes its group's form, or where the corpus knows none, the prototypes of its main script; a character that hides between
others, or is a wide or fancy variant, takes its prototype. Whole words of another script and signs that look different on purpose stay.

Prototypes come from three rules over the Unicode character database (hidden characters, compatibility variants, small capitals) and a list of
letter pairs; ``read_confusables`` takes more of them from a file in the public format of confusable characters.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from folioflow.llm import encoding
from folioflow.llm.fields import values_of, with_texts
from folioflow.session import bounded_broadcast, cut

# Letters of other scripts, and the Latin letters they look like.
_CYRILLIC = "аеорсухѕіјһԁԛԝӏѵёїАВЕЅІЈКМНОРСТУХҮԌЁЇ"
_AS_LATIN = "aeopcyxsijhdqwlvëïABESIJKMHOPCTYXYGËÏ"
_GREEK = "αγικνορυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
_GREEK_AS_LATIN = "ayikvopuxABEZHIKMNOPTYX"
_OTHERS = "ɡɑցհյոսօզԼՏՍՕ" + "ⲟⲣⲥⲞⲢⲤⲎⲔⲘⲚⲦⲬ" + "ᎠᎡᎢᎪᎫᎬᎳᎷᎻᎽᏀᏃᏏᏒᏙᏚᏞᏟᏢᏦᏧᏴ" + "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ" + "𐐄𐐬"
_OTHERS_AS_LATIN = "gaghjnuoqLSUO" + "opcOPCHKMNTX" + "DRTAJEWMHYGZbRVSLCPKdB" + "BPDTGKJCZFMNLSRVHWXYAEIOU" + "Oo"
# Letters of Latin alphabets that look like others; what they are is told by their groups only.
_LATIN_TWINS = {"ı": "i", "ȷ": "j", "ſ": "f", "ƒ": "f", "ꞵ": "ß", "ǃ": "!", "ɩ": "i", "ʋ": "v"}
# Characters without width or with an effect on nothing here.
_HIDDEN = "­͏؜᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩﻿"
_SPACES = "               　"

TO_LATIN = dict(zip(_CYRILLIC + _GREEK + _OTHERS, _AS_LATIN + _GREEK_AS_LATIN + _OTHERS_AS_LATIN, strict=True))
TO_LATIN |= {
    chr(k): (c.lower() if c in "COSUVWXZ" else c)
    for k in range(0x250, 0x1E00)
    if (name := unicodedata.name(chr(k), "")).startswith("LATIN LETTER SMALL CAPITAL ") and len(c := name.rsplit(" ", 1)[-1]) == 1
}  # small capitals
TO_CYRILLIC = dict(zip(_AS_LATIN, _CYRILLIC, strict=True))
MORE: dict[str, str] = {}  # prototypes of further characters, for skeletons


def read_confusables(lines: Iterable[str]) -> dict[str, str]:
    """Prototypes from lines ``source ; prototype ; class # comment`` of hexadecimal code points; other lines are passed over."""
    found = {}
    for line in lines:
        parts = [p.strip() for p in line.split("#")[0].split(";")]
        if len(parts) >= 2 and all(re.fullmatch(r"[0-9A-Fa-f]{4,6}( [0-9A-Fa-f]{4,6})*", p) for p in parts[:2]):
            source, target = ("".join(chr(int(x, 16)) for x in p.split()) for p in parts[:2])
            if len(source) == 1:
                found[source] = target
    return found


def _java_class(chars: Iterable[str]) -> str:
    return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in sorted(set(chars))) + "]"


# ranges that hold all letters above but the Cyrillic and Greek ones: a few ranges are told faster than many letters
_RARER = r"\x{250}-\x{2af}\x{531}-\x{587}\x{13a0}-\x{13fd}\x{1d00}-\x{1d25}\x{2c80}-\x{2cff}\x{a4d0}-\x{a4ff}\x{a730}-\x{a7ff}\x{10400}-\x{1044f}"

_LETTER = re.compile(r"[^\W\d_]")
_WORD = re.compile(rf"(?:[^\W\d_]|[̀-ͯ{_HIDDEN}])+")
_EAST = re.compile(r"[々-ヿ㐀-鿿가-힯]")
_EMOJI = re.compile(r"[←-⯿\U0001f000-\U0001faff️‍]")
_JOINING = re.compile(r"[֐-෿က-႟]")  # scripts in which joiners and marks are spelling

# What a text must hold to hold a case, as Java patterns; every text without it is in plain form already.
_ODD = (
    rf"(?=[^\x{{00}}-\x{{7f}}])(?:[{_HIDDEN}{_SPACES}\x{{300}}-\x{{36f}}\x{{ff01}}-\x{{ffee}}\x{{fb00}}-\x{{fb06}}\x{{2160}}-\x{{217f}}\x{{2126}}\x{{212a}}\x{{212b}}\x{{37e}}\x{{387}}\x{{1d400}}-\x{{1d7ff}}]"
    rf"|[Ͱ-ԯ{_RARER}{''.join(_LATIN_TWINS)}](?:[a-zA-ZÀ-ɏ]|(?<=[a-zA-ZÀ-ɏ].)))"
)
_STANDING = rf"[{_CYRILLIC}{_GREEK}{_RARER}]"
_LONELY = rf"(?=[^\x{{00}}-\x{{7f}}]){_STANDING}(?<!\p{{L}}.){_STANDING}*(?!\p{{L}})"
# Letters of these scripts that look like no Latin one: a text that holds one has words of another script.
_OWN = rf"[\x{{370}}-\x{{3ff}}\x{{400}}-\x{{52f}}&&\p{{L}}&&[^{_CYRILLIC}{_GREEK}]]"


def suspect(text: Column) -> Column:
    return (F.length(text) != F.octet_length(text)) & (text.rlike(_ODD) | (text.rlike(_LONELY) & text.rlike("[a-zA-Z]{3}")))


def prototype(c: str) -> str:
    """The ordinary character that ``c`` looks like, "" for one that isn't seen, itself otherwise; without context."""
    if c in _HIDDEN:
        return ""
    if c in _SPACES:
        return " "
    if "！" <= c <= "～" or "￠" <= c <= "￦" or "ﬀ" <= c <= "ﬆ" or "Ⅰ" <= c <= "ⅿ" or "\U0001d400" <= c <= "\U0001d7ff":
        return unicodedata.normalize("NFKC", c)
    return TO_LATIN.get(c) or _LATIN_TWINS.get(c) or MORE.get(c, c)


def skeleton(text: str) -> str:
    """Equal for texts that look alike: decomposed, every character replaced by its prototype, decomposed again."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFD", "".join(map(prototype, unicodedata.normalize("NFD", text))))


def _script(c: str) -> str:
    if c < "ɐ" or "Ḁ" <= c <= "ỿ":
        return "latin"
    if "Ѐ" <= c <= "ԯ":
        return "cyrillic"
    if "Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿":
        return "greek"
    return "other"


def _foreign(word: str) -> dict[str, str]:
    """Letters of a word of mixed scripts that stand in for letters of its main script."""
    letters = [c for c in unicodedata.normalize("NFC", word) if _LETTER.match(c)]
    scripts = {s: sum(_script(c) == s for c in letters) for s in ("latin", "cyrillic", "greek", "other")}
    if sum(n > 0 for n in scripts.values()) < 2:
        return {}
    for main in sorted(("latin", "cyrillic"), key=lambda s: -scripts[s]):
        table = TO_LATIN if main == "latin" else TO_CYRILLIC | {k: TO_CYRILLIC[v] for k, v in TO_LATIN.items() if v in TO_CYRILLIC and _script(k) != "cyrillic"}
        odd = {c for c in letters if _script(c) != main}
        if scripts[main] and all(c in table for c in odd):
            return {c: table[c] for c in odd}
    return {}


def _stand_ins(words: list[str]) -> tuple[list[str], int]:
    """Words wholly of look-alikes, and the letters of the Latin words beside them; no words where others are of another script."""
    latin = sum(len(w) for w in words if all(_script(c) == "latin" for c in w if _LETTER.match(c)))
    odd = [w for w in words if any(c in TO_LATIN or _script(c) in ("cyrillic", "greek") for c in w)]
    whole = [w for w in odd if all(c in TO_LATIN for c in w)]
    if len(odd) != len(whole) + sum(bool(_foreign(w)) for w in odd):
        return [], latin
    return whole, latin


def latin_form(word: str) -> str:
    """The word with every look-alike as the Latin letter."""
    return "".join(TO_LATIN.get(c) or _LATIN_TWINS.get(c, c) for c in word)


def cyrillic_form(word: str) -> str:
    """The word with every look-alike as the Cyrillic letter."""
    return "".join(TO_CYRILLIC.get(TO_LATIN.get(c, c), c) for c in word)


def _swaps(words: list[str], chosen: dict[str, str]) -> dict[str, str]:
    """What the words of a text are in ordinary letters, where that is something else.

    ``chosen`` has the forms of skeleton groups. A word of mixed scripts without one takes the prototypes of its main script; one wholly of look-alikes
    is replaced in a text whose other words are Latin only: by its group's form, or if it is of up to three letters, too short to be
    told by a group, by its prototypes.
    """
    out = {}
    for w in {w for w in words if not w.isascii()}:
        table = _foreign(w)
        if w in chosen and (table or any(c in _LATIN_TWINS for c in w)):
            out[w] = chosen[w]
        elif table:
            out[w] = w.translate(str.maketrans(table))
    whole, latin = _stand_ins(words)
    size = sum(map(len, whole))
    for w in set(whole):
        if w in chosen and latin >= size:
            out[w] = chosen[w]
        elif len(w) <= 3 and latin >= 4 * size:
            out[w] = latin_form(w)
    return out


def plain(text: str, chosen: dict[str, str] | None = None) -> str:
    """The consistent form of a text: everything that only looks like an ordinary character is that character.

    ``chosen`` has the forms that the skeleton groups of words have chosen.
    """
    out, n = [], len(text)
    for i, c in enumerate(text):
        if c.isascii():
            out.append(c)
            continue
        before, after = text[i - 1] if i else "", text[i + 1] if i + 1 < n else ""
        if c in _HIDDEN:
            keep = bool(c == "‍" and (_EMOJI.match(before) or _EMOJI.match(after)) or c in "‌‍" and (_JOINING.match(before) or _JOINING.match(after)))
        elif c in _SPACES:
            keep = bool(c == "　" and (_EAST.match(before) or _EAST.match(after)))
        elif "！" <= c <= "～" or "￠" <= c <= "￦":
            keep = bool(_EAST.match(before) or _EAST.match(after))
        else:
            keep = c in TO_LATIN or "ﬀ" > c or "ﬆ" < c < "\U0001d400"
            keep = keep and not "Ⅰ" <= c <= "ⅿ"
        out.append(c if keep else prototype(c))
    now = "".join(out)
    composed = unicodedata.normalize("NFC", now)
    swaps = _swaps(_WORD.findall(composed), chosen or {})
    return _WORD.sub(lambda m: swaps.get(m.group(), m.group()), composed) if swaps else composed


def odd_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(id, word, skeleton, whole): the words of each text that hold look-alikes: of mixed scripts, wholly of them in a Latin text, or with twins of Latin letters."""
    for batch in batches:
        rows = []
        for at, text in zip(batch["id"], batch["text"], strict=True):
            words = _WORD.findall(unicodedata.normalize("NFC", text))
            whole, latin = _stand_ins(words)
            whole = set(whole) if latin >= sum(map(len, whole)) else set()
            odd = {w for w in words if not w.isascii() and (w in whole or any(c in _LATIN_TWINS for c in w) or _foreign(w))}
            rows += [(at, w, skeleton(w), w in whole) for w in sorted(odd)]
        found = pd.DataFrame(rows, columns=["id", "word", "skeleton", "whole"])
        yield with_texts(found.astype({"id": "int64", "whole": bool}), word=found["word"].tolist(), skeleton=found["skeleton"].tolist())


@F.pandas_udf(ArrayType(StringType()))
def _ordinary_forms(words: pd.Series) -> pd.Series:
    """The words of a single script that have the same skeleton: all letters Latin, or all Cyrillic, and composed."""

    def forms(word: str) -> list[str]:
        made = {unicodedata.normalize("NFC", f(word)) for f in (latin_form, cyrillic_form)}
        return sorted(m for m in made if m != word and len({_script(c) for c in m if _LETTER.match(c)}) == 1 and skeleton(m) == skeleton(word))

    return words.map(forms)


def chosen_forms(values: DataFrame, odd: DataFrame) -> DataFrame:
    """(word, form): for odd words, the form that their skeleton group has chosen, where that is another one.

    A group holds the odd words of one skeleton and the words of a single script with it, however often each is used. The most frequent of the latter is
    chosen. For words wholly of look-alikes, which are such words themselves, uses in texts of their own script count for them, and for words with
    twins of Latin letters all their uses. The corpus is searched only for the forms of such words.
    """
    words = cut(odd.select("word", "skeleton", "whole").distinct())
    ordinary = words.select("skeleton", "word", F.explode(_ordinary_forms("word")).alias("form"))
    forms = ordinary.select("skeleton", "form").union(words.select("skeleton", F.col("word").alias("form"))).distinct()
    text = F.col("text")
    told = values.select("text", ((F.length(text) != F.octet_length(text)) & text.rlike(_OWN)).alias("other"))  # once a text, not once a word
    each = told.select(F.explode(F.split(text, r"[^\p{L}\p{M}]+")).alias("form"), "other")
    used = cut(each.join(bounded_broadcast(forms), "form").groupBy("skeleton", "form").agg(F.count("*").alias("n"), F.count_if("other").alias("abroad")))
    own = words.join(used.select("skeleton", F.col("form").alias("word"), F.when(F.col("word").isNotNull(), F.col("n")).alias("own"), "abroad").select("skeleton", "word", "own", "abroad"), ["skeleton", "word"], "left")
    best = ordinary.join(used.select("skeleton", "form", "n"), ["skeleton", "form"]).groupBy("skeleton", "word").agg(F.max(F.struct("n", "form")).alias("best"))
    against = F.when(F.col("whole"), F.coalesce("abroad", F.lit(0))).when(F.col("word").rlike(_java_class(_LATIN_TWINS)), F.coalesce("own", F.lit(0))).otherwise(0)
    return own.join(best, ["skeleton", "word"]).filter(F.col("best.n") > against).groupBy("word").agg(F.max("best").alias("best")).select("word", F.col("best.form").alias("form"))


def unify(values: DataFrame, learned: tuple | None = None, keep_garbled: bool = False, groups: bool = True) -> DataFrame:
    """Rows of ``values`` that aren't in plain form, with ``plain``, ``skeleton`` and ``by_group`` added.

    ``values`` has a ``text`` column; null and empty texts are in plain form. Other columns pass through (columns of the added
    names are replaced), repeated rows stay repeated. ``by_group`` tells whether a word took the form that its skeleton group has chosen.
    Texts that were decoded with a wrong encoding, as far as
    ``learned`` tells, are left out unless ``keep_garbled``: their odd characters are not look-alikes. Without ``groups`` only prototypes count.
    """
    added = {"plain": "string", "skeleton": "string", "by_group": "boolean"}
    fields = [f for f in values.schema.fields if f.name not in added]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", " + ", ".join(f"{k} {v}" for k, v in added.items())
    suspects = values.select(*[f"`{f.name}`" for f in fields]).filter(suspect(F.col("text")))
    if groups:
        rows = cut(suspects).withColumn("_id", F.monotonically_increasing_id())
        odd = cut(rows.select(F.col("_id").alias("id"), "text").mapInPandas(odd_words, "id bigint, word string, skeleton string, whole boolean"))
        forms = odd.join(chosen_forms(values.filter(F.col("text").isNotNull()).select("text"), odd), "word").groupBy(F.col("id").alias("_of")).agg(F.collect_list(F.struct("word", "form")).alias("_forms"))  # at most the words of one text
        rows = rows.join(forms, F.col("_id") == F.col("_of"), "left").drop("_id", "_of")
    else:
        rows = suspects.withColumn("_forms", F.lit(None).cast("array<struct<word string, form string>>"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        garbled = encoding.Restorer(*learned).restore if learned and not keep_garbled else lambda _: None
        for batch in batches:
            chosen = [{} if x is None else {f["word"]: f["form"] for f in x} for x in batch["_forms"]]
            texts = batch["text"].tolist()
            done = [plain(t, c) for t, c in zip(texts, chosen, strict=True)]
            odd = [p != t and garbled(t) is None for p, t in zip(done, texts, strict=True)]
            by = [bool(c) and p != plain(t) or any(w in t for w in c) for t, p, c, o in zip(texts, done, chosen, odd, strict=True) if o]
            hit = batch.loc[odd].drop(columns="_forms")
            yield with_texts(hit, plain=[p for p, o in zip(done, odd, strict=True) if o], skeleton=[skeleton(t) for t in hit["text"]]).assign(by_group=pd.Series(by, index=hit.index, dtype=bool))

    return rows.mapInPandas(run, schema)


@F.pandas_udf(StringType())
def skeleton_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else skeleton(t))


def skeleton_of(text: Column) -> Column:
    """The skeleton as a Column; only texts with non-ASCII characters go through Python."""
    return F.when(F.length(text) == F.octet_length(text), text).otherwise(skeleton_udf(text))


def look_alike_groups(values: DataFrame) -> DataFrame:
    """(skeleton, forms, n): skeletons that more than one distinct text has, how many texts and how many rows.

    Rows are counted by text before the skeletons are, so a text of any frequency costs one row per task.
    """
    texts = values.filter(F.col("text").isNotNull()).groupBy("text").agg(F.count("*").alias("n"))
    return texts.select(skeleton_of(F.col("text")).alias("skeleton"), "n").groupBy("skeleton").agg(F.count("*").alias("forms"), F.sum("n").alias("n")).filter("forms > 1")


def p3_unified(spark, sf_dir: str) -> DataFrame:
    """Titles and blocks that hold stand-ins or hidden characters, with their consistent form and skeleton, and whether a skeleton group gave it."""
    values = values_of(spark.read.parquet(f"{sf_dir}/items.parquet"))
    return unify(values, encoding.learn(values))


def p3_found(spark, sf_dir: str) -> DataFrame:
    return p3_unified(spark, sf_dir).select("item_id", "field", "pos").distinct()


def p3_groups(spark, sf_dir: str) -> DataFrame:
    """Titles and blocks that look alike though their characters differ."""
    return look_alike_groups(values_of(spark.read.parquet(f"{sf_dir}/items.parquet")))
