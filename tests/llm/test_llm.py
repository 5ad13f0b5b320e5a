"""Each operator on small cases: brute force, round trips, and the odd inputs that its docstring defines."""

import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

pytest.importorskip("folioflow.llm.queries")

from folioflow.llm import boilerplate, duplicates, encoding, leaks, lookalikes, packing, quality, truncation, words  # noqa: E402
from folioflow.llm.fields import values_of  # noqa: E402
from folioflow.session import shared_folder  # noqa: E402

BLOCKS = "array<struct<pos int, type string, level int, ordered boolean, list_index int, text string, runs array<struct<start int, length int, flags tinyint>>, src string>>"
ITEMS = f"item_id bigint, source_name string, title string, author string, guid string, link string, summary_text string, fetched_at timestamp_ntz, blocks {BLOCKS}, text string"

NAMES = ["Renée Müller", "José Ibáñez", "Zoë Brontë", "François Hélène", "Søren Ångström", "Łukasz Żak", "Peña Larga"]
RUSSIAN = ["Новый музей защитил речной порт", "Старый вокзал обновил школьный театр", "Учителя и инженеры спорят о проекте", "Городской рынок оплатил научный отдел"]


def blocks(*texts, kind="paragraph"):
    return [(k, kind, 0, False, 0, t, [], None) for k, t in enumerate(texts)]


def item(item_id, source="S", title=None, author=None, guid=None, link=None, summary=None, body=()):
    return (item_id, source, title, author, guid, link, summary, None, blocks(*body) if body is not None else None, "clash")


# ------------------------------------------------------------------ 1 encoding


def garbled(text, written, read):
    return encoding.Misreading(written, read).garble(text)


def test_ways_are_learned_and_undone(spark):
    clean = [f"{n} met {m}’s “naïve” friend – again" for n in NAMES for m in NAMES] + [f"{a} и {b.lower()}, {c.lower()}" for a in RUSSIAN for b in RUSSIAN for c in RUSSIAN]
    rows = [(k, t) for k, t in enumerate(clean * 3)]
    planted = {}
    for k, (written, read) in enumerate([("utf-8", "cp1252"), ("utf-8", "mac-roman"), ("utf-8", "cp437"), ("utf-8", "cp1252")] * 4):
        once = garbled(clean[k], written, read)
        planted[10_000 + k] = (garbled(once, written, read) if k >= 12 and read == "cp1252" else once, clean[k])
    for k in range(8):
        written, read = [("utf-8", "cp1251"), ("cp1251", "latin-1"), ("koi8-r", "cp1251"), ("utf-8", "latin-1")][k % 4]
        text = clean[len(NAMES) ** 2 + 7 * k]
        planted[20_000 + k] = (garbled(text, written, read), text)
    rows += [(k, g) for k, (g, _) in planted.items()] + [(30_000, "Ren� M�ller"), (30_001, "SÃO MARENO √2 © 2025 Å–Ø"), (30_002, "CAFÉ» ÂGE"), (30_005, "ПОСЛЕ ДОЛГИХ СПОРОВ ЗАЩИТИЛ"), (30_006, "Учи\xadтеля защи\xadщают на\xadучный о\xadтдел"), (30_003, ""), (30_004, None)]
    df = spark.createDataFrame([(k, t, "w") for k, t in rows], "id int, text string, ways string")
    got = {r.id: r.restored for r in encoding.restore_encoding(df).collect()}
    assert {k: got.get(k) for k in planted} == {k: c for k, (_, c) in planted.items()}
    assert set(got) == set(planted) | {30_000}


def test_maps_outside_the_list_come_from_alignment(spark):
    """A misreading between encodings that aren't listed is learned letter by letter and applied to words without a twin."""
    letters = dict(zip("éèêç", "ŘŤŇĐ", strict=True))  # what an unknown reader made of them
    fitting = {"caf{}": "é", "{}cole": "é", "r{}sum{}": "é", "pi{}ce": "è", "cr{}me": "è", "fr{}re": "è", "p{}che": "ê", "for{}t": "ê", "gar{}on": "ç", "fa{}ade": "ç", "r{}cif": "é", "m{}re": "è", "le{}on": "ç", "fran{}ais": "ç", "d{}but": "é", "l{}gume": "é", "r{}ve": "ê", "f{}te": "ê", "t{}te": "ê", "b{}te": "ê", "for{}at": "ç", "p{}re": "è", "tr{}s": "è", "apr{}s": "è"}
    clean = [s.replace("{}", x) for s, x in fitting.items()]
    garble = lambda t: "".join(letters.get(c, c) for c in t)
    rows = [(k, f"le {w} ici") for k, w in enumerate(clean * 12)] + [(1000 + k, f"le {garble(w)} ici") for k, w in enumerate(clean)] + [(2000, garble("un élève créé")), (2001, "un élève créé"), (2002, "Dvořák a Šťastný"), (2003, "l’hôtel naïf")]
    df = spark.createDataFrame(rows, "id int, text string")
    got = {r.id: (r.ways, r.restored) for r in encoding.restore_encoding(df).collect()}
    assert got == {1000 + k: ("aligned", f"le {w} ici") for k, w in enumerate(clean)} | {2000: ("aligned", "un élève créé")}
    few = df.filter("id < 1003")
    assert encoding.learn(few)[3] == {} and encoding.restore_encoding(few).count() == 0


def test_letters_of_two_alphabets_that_are_ordinary_teach_nothing(spark):
    """Words that differ in one letter by right are no misreading, however many there are."""
    rng = random.Random(8)
    words = ["".join(rng.choice("bcdfgklmnprst") for _ in range(4)) for _ in range(60)]
    rows = [w[:2] + c + w[2:] for w in words for c, n in (("é", 10), ("è", 2)) for _ in range(n)] + ["".join(rng.choice("bcdfgklmnprst") for _ in range(5)) + "è" for _ in range(60)]
    assert encoding.learn(spark.createDataFrame([(t,) for t in rows], "text string"))[3] == {}


def test_lost_characters_come_from_twins(spark):
    df = spark.createDataFrame([(k, f"{n} spoke") for k, n in enumerate(NAMES * 3)] + [(100, "Pe\ufffda Larga, Zo\ufffd Bront\ufffd"), (101, "Unkn\ufffdwn")], "item_id int, text string")
    forms = encoding.count_all(df)
    got = {r.item_id: r.restored for r in encoding.fill_lost(encoding.restore_encoding(df, encoding.learn_from(forms)), forms, "item_id").collect()}
    assert got == {100: "Peña Larga, Zo\ufffd Brontë", 101: "Unkn\ufffdwn"}


def test_encoding_of_nothing(spark):
    assert encoding.restore_encoding(spark.createDataFrame([], "text string")).count() == 0
    values = values_of(spark.createDataFrame([item(1, body=None), item(2, title="t", author="", body=("b", ""))], ITEMS), author=True)
    assert {(r.item_id, r.field, r.pos) for r in values.collect()} == {(2, "title", -1), (2, "block", 0)}


# ------------------------------------------------------------------ 2 duplicates


def test_copies_and_ledger(spark):
    same = [(1, "G-1", "http://a.example/x?b=2&a=1", "News | A «Title»!"), (5, "g 1", "HTTP://a.example/x/?A=1&b=2", "a title | NEWS"), (3, "g1", "http://a.example/x?a=1&b=2", "atitle|news")]
    other = [(7, "g1", "http://a.example/x?a=1&b=2", "atitle|news 2"), (8, None, None, None), (9, None, None, None), (10, "", None, None), (11, "", None, None), (11, "", None, None)]
    df = spark.createDataFrame(same + other, "item_id bigint, guid string, link string, title string").withColumn("fetched_at", F.timestamp_seconds(100 - F.col("item_id")).cast("timestamp_ntz"))
    ledger = duplicates.ledger_of(df, [F.lit(True)]).read()
    assert {tuple(r) for r in duplicates.copies(df, ledger).collect()} == {(1, 3), (1, 5), (8, 9), (10, 11)}
    kept = duplicates.Ledger(spark, shared_folder(spark, "ledger") + "/l", 4)
    assert kept.read().count() == 0
    for name, condition in (("none", "item_id < 0"), ("first", "item_id <= 3"), ("rest", "item_id > 3")):
        assert kept.add(df.filter(condition), name)
    fields = ["key", "copies", "smallest_id", "earliest"]
    want = {tuple(r) for r in ledger.select(fields).collect()}
    assert {tuple(r) for r in kept.read().select(fields).collect()} == want
    assert ledger.filter("smallest_id = 1").first().earliest.id == 5 and ledger.filter("smallest_id = 10").first().copies == 3
    # a batch that comes again counts once, and old versions can go
    assert not kept.add(df.filter("item_id > 3"), "rest") and not kept.add(df.filter("item_id <= 3"), "first")
    kept.vacuum()
    assert {tuple(r) for r in kept.read().select(fields).collect()} == want


def test_a_batch_that_dies_between_buckets_is_counted_once(spark, monkeypatch):
    df = spark.range(400).select(F.col("id").alias("item_id"), (F.col("id") % 150).cast("string").alias("guid"), F.lit(None).cast("string").alias("link"), F.lit("t").alias("title"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("fetched_at"))
    ledger = duplicates.Ledger(spark, shared_folder(spark, "ledger") + "/l", 8, 2)
    ledger.add(df.filter("item_id < 200"), "a")
    count = lambda: (ledger.read().count(), ledger.read().agg(F.sum("copies")).first()[0])
    # some buckets of the batch are written, then its job fails
    failing = df.filter("item_id >= 200").withColumn("title", F.when(F.col("item_id") == 399, F.raise_error(F.lit("lost"))).otherwise(F.col("title")))
    with pytest.raises(Exception, match="lost"):
        ledger.add(failing, "b")
    monkeypatch.setattr(duplicates.Ledger, "_commit", lambda *_: (_ for _ in ()).throw(OSError("driver lost")))
    with pytest.raises(OSError, match="driver lost"):
        ledger.add(df.filter("item_id >= 200"), "b")
    monkeypatch.undo()
    assert count() == (150, 200)
    assert ledger.add(df.filter("item_id >= 200"), "b") and count() == (150, 400)
    ledger.vacuum()
    assert count() == (150, 400) and not ledger.add(df.filter("item_id >= 200"), "b")
    with pytest.raises(RuntimeError, match="another writer"):
        ledger._commit(2, ["x"], {})


def test_one_key_for_a_third_of_all_rows(spark):
    df = spark.range(3000).select(F.col("id").alias("item_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("guid"), F.lit(None).cast("string").alias("link"), F.lit("t").alias("title"), F.current_timestamp().cast("timestamp_ntz").alias("fetched_at"))
    pairs = duplicates.copies(df, duplicates.ledger_of(df, [F.col("item_id") < 1500, F.col("item_id") >= 1500]).read())
    assert pairs.count() == 999 and pairs.select("item_id_a").distinct().collect()[0][0] == 0


# ------------------------------------------------------------------ 3 look-alikes


@pytest.mark.parametrize(
    ("text", "form"),
    [
        ("Ｔｈｅ　ｃａｔ", "The cat"),
        ("no\xa0break space", "no break space"),
        ("zero​width­﻿", "zerowidth"),
        ("café", "café"),
        ("Fаrmerѕ in Рοrt", "Farmers in Port"),
        ("кoмбинaт", "комбинат"),
        ("oﬃce", "office"),
        ("it is а cat here", "it is a cat here"),
        ("\u212bngstrom", "Ångstrom"),
    ],
)
def test_stand_ins(text, form):
    assert lookalikes.plain(text) == form and lookalikes.skeleton(text) == lookalikes.skeleton(form)


@pytest.mark.parametrize("text", ["½ m² № ™ “quotes” – dash…", "Ωmega, Отчёт τέχνη π", "👩‍🚀 up", "港の朝（写真）　夕", "Ещё один отчёт в порту", "São Mareno", "plain", ""])
def test_no_stand_ins(text):
    assert lookalikes.plain(text) == text


def test_unify_and_groups(spark):
    df = spark.createDataFrame([(1, "fаrm", 0), (2, "farm", 0), (3, "farm", 0), (4, None, 0), (5, "", 0), (6, "x​" * 50_000, 0), (7, "plain", 0)], "id int, text string, plain int")
    assert {r.id for r in lookalikes.unify(df).collect()} == {1, 6}
    assert [(r.forms, r.n) for r in lookalikes.look_alike_groups(df).collect()] == [(2, 3)]
    assert lookalikes.unify(df.filter("id < 0")).count() == 0


def test_whole_words_of_stand_ins_have_a_clean_twin(spark):
    texts = ["Officials соре with the winter storm", "They cope well", "The СССР hockey shirt was sold", "Новый отчёт: соха и сосна", "A соха from the north was shown", "A long paper", "хохо", "Рорсоrn and sweets"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string")
    found = {r.id: (r.plain, r.by_group) for r in lookalikes.unify(df).collect()}
    assert found == {0: ("Officials cope with the winter storm", True), 7: ("Popcorn and sweets", False)}


def test_groups_of_equal_skeletons_decide(spark):
    """What a word is comes from the words that look like it: without groups, words of one script only, and of Latin twins, are no cases."""
    texts = ["An old harbour in the city", "the city is open", "it is a topor and it is old", "Новый топор и комбинат", "комбинат снова открыт", "A соре was seen; they cope", "ıt is open", "Sığır and Kadıköy", "Kadıköy is old", "the cıty", "A кoмбинaт opened here"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string")
    with_groups = {r.id: (r.plain, r.by_group) for r in lookalikes.unify(df).collect()}
    assert with_groups == {5: ("A cope was seen; they cope", True), 6: ("it is open", True), 9: ("the city", True), 10: ("A комбинат opened here", True)}
    assert {r.id for r in lookalikes.unify(df, groups=False).collect()} == {10}


@pytest.mark.parametrize(("text", "form"), [("Ꭺpple", "Apple"), ("ꓮpple", "Apple"), ("ʀead", "Read"), ("ⲟk", "ok"), ("ᴏpen", "open")])
def test_letters_of_rarer_scripts(text, form):
    assert lookalikes.plain(text) == form and lookalikes.skeleton(text) == lookalikes.skeleton(form)


def test_more_prototypes_from_a_file(monkeypatch):
    found = lookalikes.read_confusables(["# comment", "A7AE ;\t0069 ;\tMA\t# x", "1D6C2 ; 0061 ; MA", "bad line", "0041 0042 ; 0043 ; MA"])
    assert found == {"Ɪ": "i", "𝛂": "a"}
    monkeypatch.setattr(lookalikes, "MORE", {"⍺": "a"})
    assert lookalikes.skeleton("f⍺rm") == "farm"


def test_groups_hold_blocks(spark, tmp_path):
    rows = [item(1, title="A farm", body=("The fаrm is old", None)), item(2, title="The farm is old", body=("Alone",))]
    spark.createDataFrame(rows, ITEMS).write.parquet(f"{tmp_path}/items.parquet")
    assert [tuple(r) for r in lookalikes.p3_groups(spark, str(tmp_path)).collect()] == [("The farm is old", 2, 2)]


# ------------------------------------------------------------------ 4 repeated lines


def test_chunks_do_not_depend_on_place():
    rng = random.Random(3)
    lines = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 400))) for _ in range(200)]
    line, chunk = boilerplate.chunks_of(lines)
    for k in (0, 7, 199):
        alone = boilerplate.chunks_of([lines[k]])[1]
        assert alone.tolist() == chunk[line == k].tolist()
    assert set(line.tolist()) == set(range(200)) and boilerplate.chunks_of(["", ""])[0].size == 0


def test_repeated_blocks_against_brute_force(spark):
    rng = random.Random(5)
    legal = ["All rights reserved.", "Share this story", "Follow us for more stories like this one, every day of the week and on holidays too"]
    rows = []
    for k in range(400):
        source = rng.choice(["big", "big", "small", None, ""])
        texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) for _ in range(30)) for _ in range(3)]
        texts += [t.upper() if rng.random() < 0.3 else f"– {t} {k}" for t in legal if rng.random() < (0.04 if t is legal[1] else 0.5)] + [None, "123", "Only once? twice"] * (k % 97 == 0)
        rows.append(item(k, source, body=texts if k % 50 else None))
    letters = lambda t: "".join(c for c in (t or "").lower() if c.isalpha())
    totals, seen = Counter(r[1] for r in rows), Counter()
    for r in rows:
        seen.update({(r[1], letters(b[5])) for b in r[8] or []})
    bad = {k for k, n in seen.items() if k[0] is not None and k[1] and n >= 10 and n >= 0.05 * totals[k[0]]}
    want = {(r[1], r[0], b[0]) for r in rows for b in r[8] or [] if (r[1], letters(b[5])) in bad}
    df = spark.createDataFrame(rows, ITEMS)
    got = boilerplate.repeated_blocks(df)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 100
    clean = boilerplate.without_blocks(df, got)
    assert clean.count() == 400 and clean.select(F.sum(F.coalesce(F.size("blocks"), F.lit(0)))).first()[0] <= sum(len(r[8] or []) for r in rows) - len(want) + 400
    assert boilerplate.repeated_blocks(df.filter("item_id < 0")).count() == 0


def test_notices_glued_to_paragraphs_are_cut_out(spark):
    rng = random.Random(9)
    notice = "This article was first published by the Westerpool Harbour Gazette and is reproduced here under a licence that forbids all further copying."
    bodies = ["".join(rng.choice("abcdefghijklmnop ") for _ in range(200)).strip() + "." for _ in range(60)]
    rows = [item(k, "S", body=(f"{b} {notice}" if k % 2 else b, None, "12 3")) for k, b in enumerate(bodies)] + [item(100, "S", body=(notice,)), item(101, None, body=(notice,)), item(102, "S", body=None)]
    got = {(r.item_id, r.pos): r.text for r in boilerplate.cut_chunks(spark.createDataFrame(rows, ITEMS)).collect()}
    starts = 0
    for k, b in enumerate(bodies):
        text = got[k, 0]
        assert got[k, 1] is None and got[k, 2] == "12 3"
        if k % 2 == 0:
            assert text == b
        else:
            assert text.startswith(b) and len(text) < len(b) + len(notice) - 60  # the rest up to the first cut inside the notice may stay
            starts += 1
    assert starts == 30 and (100, 0) not in got or len(got[100, 0]) < len(notice)
    assert got[101, 0] == notice and (102, 0) not in got
    text = "Äb, c–d! " * 30
    (chunks,) = boilerplate.text_chunks(iter([pd.DataFrame({"item_id": [1, 2], "source_name": ["S", "S"], "pos": [0, 1], "text": [text, "?!"]})]))
    spans = sorted(zip(chunks["start"], chunks["stop"], strict=True))
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False)) and set(chunks["item_id"]) == {1}


# ------------------------------------------------------------------ 5 truncation


def test_cut_texts(spark):
    stock = [f"The {a} {b} questioned the {c} in Westerpool before the winter break." for a in ("old", "new", "public") for b in ("newsroom", "theatre", "observatory") for c in ("recycling", "harbour", "cooperative")]
    rows = [item(k, summary=t, body=(t, t)) for k, t in enumerate(stock * 3)]
    rows += [item(500 + k, summary=f"Photos: {p} at dawn", body=None) for k, p in enumerate(["Westerpool", "Harbour"] * 10)]
    cases = {
        1000: ("The public observatory questioned the recy", True), 1001: ("The old newsroom questioned the harbour in", True), 1002: ("The old newsroom questioned…", True),
        1003: ("The old newsroom questioned the [...]", True), 1004: ("The old newsroom Read more", True), 1005: (stock[0] + " https://x.example/live", False), 1006: (stock[1] + " 📷", False),
        1007: (stock[2] + " — the desk", False), 1008: ("He said: “We waited and waited…”", False), 1009: ("Photos: Westerpool at dawn", False), 1010: ("", False), 1011: (None, False), 1012: ("  ", False), 1013: (stock[0] + " Read more", False),
        1014: ("The old newsroom Читать далее", True), 1015: (stock[1] + " Читать далее", False), 1016: (stock[1] + " â€“ PeÃ±a Larga", False), 1017: (stock[1] + " « The old newsroom questioned the harb", True),
    }
    rows += [item(k, summary=t, body=None) for k, (t, _) in cases.items()] + [item(2000, body=(stock[0], "The old theatre questioned the observ")), item(2001, body=None)]
    found = {(r.item_id, r.field) for r in truncation.truncated(spark.createDataFrame(rows, ITEMS)).collect()}
    assert found == {(k, "summary") for k, (_, cut) in cases.items() if cut} | {(2000, "body")}
    assert truncation.truncated(spark.createDataFrame([], ITEMS)).count() == 0


def test_copies_of_a_story_are_no_repeated_lines(spark):
    stock = [f"The {a} {b} questioned the {c} in Westerpool before the winter break." for a in ("old", "new", "public") for b in ("newsroom", "theatre", "observatory") for c in ("recycling", "harbour", "cooperative")]
    rows = [item(k, title=f"Story {k}", body=(f"Number {'x' * k} of the day was drawn.", stock[k % 27], "By the news desk of Westerpool and its harbour")) for k in range(60)]
    rows += [item(100 + k, title="Hot  story!" if k % 2 else "hot story", body=("A whole paragraph comes first in this one.", "The old theatre questioned the observ", "By the news desk of Westerpool and its harbour")) for k in range(40)]
    found = {(r.item_id, r.field) for r in truncation.truncated(spark.createDataFrame(rows, ITEMS)).collect()}
    assert found == {(100 + k, "body") for k in range(40)}


def stock_items():
    return [f"The {a} {b} questioned the {c} in Westerpool before the winter break." for a in ("old", "new", "public") for b in ("newsroom", "theatre", "observatory") for c in ("recycling", "harbour", "cooperative")]


def evidence_of(spark, rows, **how):
    return {(r.item_id, r.field): r.evidence for r in truncation.truncated(spark.createDataFrame(rows, ITEMS + ", text_bytes bigint, truncation string"), **how).collect()}


def test_ends_without_a_mark_need_evidence(spark):
    """The trie alone tells a cut word; a complete text without a mark isn't one; without the trie its rows are gone."""
    row = lambda *a, size=0, hint="none", **k: (*item(*a, **k), size, hint)
    rows = [row(k, summary=t, body=(t,)) for k, t in enumerate(stock_items() * 3)]
    rows += [row(500, summary="Nobody asked the observ", body=None), row(501, summary="Nobody asked the observatory", body=None), row(502, summary="Zzz unheard qqq", body=None)]
    rows += [row(503, body=("Nobody asked the observatory",), size=900), row(504, body=("Nobody asked the theatre",), hint="ellipsis-tail"), row(505, summary="Quite another matter was heard. Nobody asked the observatory", body=None)]
    found = evidence_of(spark, rows)
    assert found == {(500, "summary"): "word", (503, "body"): "bytes", (504, "body"): "bytes", (505, "summary"): "sentence"}
    others = tuple(e for e in truncation.EVIDENCES if e != "word")
    assert (500, "summary") not in evidence_of(spark, rows, evidences=others)


def test_cuts_after_abbreviations_and_behind_long_links(spark):
    stock = stock_items()
    rows = [item(k, summary=t.replace("questioned", "met Dr. Varga and questioned"), body=(t,)) for k, t in enumerate(stock * 3)]
    link = "https://x.example/" + "a" * 500
    rows += [item(600, summary="The old theatre met Dr.", body=None), item(601, summary=f"{stock[0]} {link}", body=None), item(602, summary=f"{stock[1]} {link} {link}" + " " * 300, body=None)]
    rows += [item(603, summary=f"The old newsroom questioned the {link}", body=None), item(604, summary=f"{stock[2][:-1]} and said that the Continue reading.", body=None), item(605, summary=stock[3] + " Continue reading.", body=None)]
    found = evidence_of(spark, [(*r, None, None) for r in rows])
    assert found == {(600, "summary"): "continuing", (603, "summary"): "continuing", (604, "summary"): "sign"}


def test_the_looked_at_end_tells_what_the_whole_text_tells(spark):
    rng = random.Random(11)
    bits = ["word", "Read more", "https://x.example/" + "y" * 90, "…", ".", "!", " ", "    ", "📷", "—", "Ann", "”", "[...]", "\n", "1", "読"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(1, 60))) + rng.choice(["", "." * 30, " " * 200]) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", truncation.stripped_end(F.col("t"))).withColumn("whole", truncation._stripped(F.col("t")))
    for pattern in (truncation._SIGN, truncation._LINK, truncation._SIGNED, truncation._ENDED):
        assert df.filter(F.reverse("e.end").rlike(pattern) != F.reverse("whole").rlike(pattern)).count() == 0
    assert df.filter(F.length("whole") != F.length("t") - F.col("e.off")).count() == 0


def test_trie_makes_the_wanted_nodes(spark):
    words = spark.createDataFrame([("car", 2), ("cart", 3), ("x" * 100_000, 2)], "word string, n bigint")
    wanted = spark.createDataFrame([("ca",), ("car",), ("cart",), ("c",), ("xx",), ("dog",)], "node string")
    nodes = {r.node: (r["words"], r.here) for r in truncation.trie(words, wanted).collect()}
    assert nodes == {"c": (2, 0), "ca": (2, 0), "car": (1, 2), "cart": (0, 3), "xx": (1, 0)}


# ------------------------------------------------------------------ 7 packing


@pytest.mark.parametrize("seed", range(4))
def test_pack_is_tight_and_whole(seed):
    rng = np.random.default_rng(seed)
    sizes = np.minimum(rng.lognormal(4, 1, 2000).astype(int), 512)
    sequence, offset = packing.pack(sizes, 512)
    used = np.bincount(sequence, sizes)
    assert used.max() <= 512 and used.sum() / (len(used) * 512) > 0.97
    for k in range(0, len(used), 50):
        mine = np.flatnonzero(sequence == k)
        order = mine[np.argsort(offset[mine], kind="stable")]
        assert offset[order].tolist() == np.concatenate(([0], np.cumsum(sizes[order])[:-1])).tolist()


def test_lowest_cost_sequence_is_taken():
    sequence, _ = packing.pack(np.array([6, 4, 4, 2]), 10)
    assert sequence.tolist() == [0, 0, 1, 1]


def test_documents_are_packed_once_each(spark):
    docs = spark.createDataFrame([(k, "word " * n) for k, n in enumerate([1, 2000, 0, 5, 5, 700])] + [(9, None), (4, "again")], "doc_id bigint, text string")
    counts = packing.token_counts(docs)
    sizes = Counter({(r.doc_id, r.tokens) for r in counts.collect()})
    containers = spark.createDataFrame([(1, 512), (2, 2048), (3, 0), (4, None)], "container_id int, capacity_tokens int")
    placed = packing.pack_documents(counts, containers).collect()
    assert {r.container_id for r in placed} == {1, 2}
    for c in (1, 2):
        assert sum(r.tokens for r in placed if r.container_id == c) == sum(n for _, n in sizes)
    assert sorted(r.piece for r in placed if r.container_id == 1 and r.doc_id == 1) == [0, 1, 2, 3]
    assert packing.pack_documents(counts.filter("doc_id < 0"), containers).count() == 0
    for c, capacity in ((1, 512), (2, 2048)):
        used: dict = {}
        for r in (r for r in placed if r.container_id == c):
            used.setdefault(r.sequence, []).append((r.offset, r.offset + r.tokens))
        assert all(a[1] <= b[0] for spans in used.values() for a, b in zip(sorted(spans), sorted(spans)[1:], strict=False)) and all(end <= capacity for spans in used.values() for _, end in spans)


def test_long_documents_are_spread_by_their_pieces(spark):
    """A book is many sequences but one open piece, so shards hold what they have to pack, not what documents hold."""
    counts = spark.range(40).select(F.col("id").alias("doc_id"), (F.col("id") * 10_000 + 7).alias("tokens"))
    containers = spark.createDataFrame([(1, 100)], "container_id int, capacity_tokens int")
    placed = packing.pack_documents(counts, containers, shard_pieces=10)
    assert placed.agg(F.sum("tokens")).first()[0] == sum(k * 10_000 + 7 for k in range(40))
    open_ = placed.filter("sequence >= 0")
    assert open_.count() == 40 and open_.select((F.col("sequence") / 2**32).cast("int")).distinct().count() == 4
    assert placed.filter("sequence < 0").select("sequence").distinct().count() == sum(k * 100 for k in range(40))


# ------------------------------------------------------------------ 8 leaks


@pytest.mark.parametrize("seed", range(3))
def test_leaks_against_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = ["ein", "zwei", "drei", "Ärger", "4", "five"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    tests = [(k, text(rng.randint(5, 40))) for k in range(8)] + [(8, None), (9, "")]
    docs = [(k, text(rng.randint(0, 60)) + " / " + (rng.choice(tests[:8])[1].upper().replace(" ", " – ") if k % 3 == 0 else "") + text(5)) for k in range(60)] + [(60, None), (61, ""), (0, tests[0][1])]
    split = lambda t: "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()

    def longest(a, b):
        """Length and places of the longest common run, the first in the text and then in the test."""
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        return best[0], -best[1], -best[2]

    want = Counter((d, e, n, i, j) for d, t in docs for e, u in tests for n, i, j in [longest(split(t), split(u))] if n >= 12)
    got = leaks.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(tests, "eval_id bigint, text string"), block=3)
    assert Counter(map(tuple, got.collect())) == want
    assert leaks.leaks(spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([], "eval_id bigint, text string")).count() == 0


def test_repeated_words_make_no_pairs():
    tests = leaks.Tests([1, 2], ["so " * 500, "so it " * 300], 12)
    expanded, real = [], leaks._expanded

    def counted(low, high):
        found = real(low, high)
        expanded.append(len(found[0]))
        return found

    leaks._expanded = counted
    try:
        got = leaks.shard_matches(["so " * 20_000, "it so " * 5_000, ("so " * 12) * 3], tests)
    finally:
        leaks._expanded = real
    assert sorted(zip(*(x.tolist() for x in got), strict=True)) == [(0, 0, 500, 0, 0), (1, 1, 600, 1, 0), (2, 0, 36, 0, 0)]
    assert sum(expanded) < 80_000


def test_words_match_plain_splitting():
    texts = ["Ein Straße, 12x – ja!", "", None, "日本 語", "a" * 10_000]
    chars = words.Chars.of(texts)
    found = words.Words.of(chars)
    assert np.bincount(found.text, minlength=5).tolist() == [4, 0, 0, 2, 1] and found.size[-1] == 10_000
    assert list(words.slices(texts, 30)) == [(0, 4), (4, 5)]


# ------------------------------------------------------------------ 9 quality


def documents(spark):
    rng = random.Random(2)
    prose = lambda: " ".join(f"The {rng.choice(['old', 'new'])} council of the town met in the {rng.choice(['hall', 'house'])} and they said it was late." for _ in range(6))
    listed = lambda: "\n".join(f"{k + 1}. {rng.choice(['Bread', 'Milk', 'Two apples'])}" for k in range(20))
    tabled = lambda: "\n".join(f"| {rng.choice(['A', 'B'])} | {rng.randint(0, 9999)} | {rng.random():.3f} |" for _ in range(15))
    junk = lambda: "".join(rng.choice("<>{}#%&=/\\abcdef01") for _ in range(400))
    rows = [(k, [prose, listed, tabled, junk][k % 4](), "en" if k % 3 else None) for k in range(240)]
    kinds = ["prose", "list", "table", "junk"]
    labels = [(k, kinds[k % 4] if k % 16 else "junk") for k in range(160)]
    return spark.createDataFrame(rows + [(900, None, "en"), (901, "", "xx")], "doc_id bigint, text string, lang string"), spark.createDataFrame(labels, "doc_id bigint, kind string")


def test_ranks_are_exact_and_kinds_are_learned(spark):
    docs, labels = documents(spark)
    stats = quality.cut(quality.text_statistics(docs))
    rows = stats.toPandas()
    assert rows[rows.doc_id == 900].iloc[0].words == 0
    ranks = {(r.doc_id, r.stat): (r.value, r.below, r.upto, r.total) for r in quality.exact_ranks(stats).collect()}
    for k, c in enumerate(quality.RANKED):
        for _, group in rows.groupby("lang") if c in quality.STATISTICS else [("*", rows)]:
            for doc_id, value in zip(group["doc_id"], group[c], strict=True):
                assert ranks[doc_id, k] == (value, (group[c] < value).sum(), (group[c] <= value).sum(), len(group))
    want = lambda k: ["prose", "list", "table", "junk"][k % 4]
    got = {r.doc_id: r.kind for r in quality.quality(docs, labels).collect()}
    assert sum(got.get(k, "prose") == want(k) for k in range(160, 240)) >= 78
    assert quality.quality(docs, labels.filter("doc_id < 0")).count() == 0
    assert quality.quality(docs.filter("doc_id < 0"), labels).count() == 0


def test_a_value_over_several_ranges_has_one_rank(spark):
    values = [0.0] * 500 + [1.5] * 300 + list(range(2, 100)) + [7.0] * 200
    stats = quality.cut(spark.createDataFrame([(k, "en", float(v)) for k, v in enumerate(values)], "doc_id bigint, lang string, words double").repartition(3))
    got = {r.doc_id: (r.below, r.upto, r.total) for r in quality.exact_ranks(stats, ("words",)).collect()}
    array = np.array(values, float)
    assert got == {k: ((array < v).sum(), (array <= v).sum(), len(values)) for k, v in enumerate(array)}


def test_whether_a_text_is_prose_is_decided_by_tail_scores(spark):
    """With flat tail scores in place of the real ones nothing is told apart."""
    docs, labels = documents(spark)
    scored = quality.tail_scores(quality.cut(quality.text_statistics(docs)))
    known = quality.known_kinds(labels)
    assert quality.not_prose(scored, known).count() > 150
    flat = scored.withColumns({c: F.lit(0.0) for c in quality.PROSE_COLUMNS})
    assert quality.not_prose(flat, known).select("doc_id").distinct().count() in (0, 242)


def test_statistics_of_one_text():
    got = quality.measure(["One two. 34!\n\nfive", "", None], [np.empty(0, np.int64)] * 3)
    assert got["words"].tolist() == [4, 0, 0] and got["mean_word_length"][0] == 3.0 and got["punctuated_line_share"].tolist() == [0.5, 0, 0]
