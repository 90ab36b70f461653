"""Operators for text data: against plain versions, round trips and odd cases."""

import random
import unicodedata
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kairolog.llm import byte_bpe, conversations, lookalike, packing, personal, residue, shared_spans

ODD = "ab 's'tre'llve  \n\t\r　é漢字が12٣!?\x00\x1c\x85🙂👩‍💻<|endoftext|>¼²ⅷ_-​́"


# ----------------------------------------------------------------- p8


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(byte_bpe.default_path())
    t.encode_special_tokens = True
    return t


def mine(texts):
    out = []
    for _, _, flat, n in byte_bpe.encode_column(byte_bpe.load(byte_bpe.default_path()), pa.array(texts, pa.string()), 3000):
        o = np.concatenate([[0], np.cumsum(n)])
        out += [flat[o[i] : o[i + 1]].tolist() for i in range(len(n))]
    return out


def test_ids_are_those_of_the_public_encoder(public):
    random.seed(3)
    texts = ["".join(random.choice(ODD) for _ in range(random.randrange(0, 60))) for _ in range(3000)]
    texts += [None, "", " ", "a" * 5000, "漢" * 700, " " * 300, "'" * 40, "don't we'll 's's ''s 'rest", "<|endoftext|> x", "x\n\ny \n z  "]
    assert mine(texts) == [e.ids for e in public.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(max_codepoint=0x3000, exclude_categories=["Cs", "Cn"])), max_size=8))
def test_ids_of_any_text(public, texts):
    assert mine(texts) == [e.ids for e in public.encode_batch(texts, add_special_tokens=False)]


def test_encode_a_table(spark, public):
    df = spark.createDataFrame([(1, "a b", 9), (1, "a b", 9), (2, None, 9), (None, "", 9), (3, "x" * 100, 9)], "doc_id long, text string, ids int")
    rows = byte_bpe.encode(df).collect()
    assert sorted((r.doc_id or 0, r.ids) for r in rows) == sorted([(1, public.encode("a b").ids)] * 2 + [(2, []), (0, []), (3, public.encode("x" * 100).ids)])
    assert byte_bpe.encode(df.limit(0)).count() == 0
    assert {(r.doc_id, r.n_tokens) for r in byte_bpe.sizes(df).collect() if r.doc_id != 3} == {(1, 2), (2, 0), (None, 0)}


# ----------------------------------------------------------------- p9


def plain_best_fit(sizes, capacity):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fit = min(((r, i) for i, r in enumerate(rooms) if r >= s), default=None)
        if fit:
            rooms[fit[1]] -= s
        else:
            rooms.append(capacity - s)
    return sorted(rooms)


def test_plan_is_item_wise_best_fit_decreasing():
    random.seed(1)
    for _ in range(200):
        capacity = random.choice([10, 32, 50, 100])
        sizes = [random.randrange(1, capacity + 1 if random.random() < 0.6 else max(2, capacity // 4)) for _ in range(random.randrange(0, 200))]
        counts = {s: sizes.count(s) for s in sizes}
        used = defaultdict(int)
        for size, _, items, each, first in packing.best_fit_decreasing(counts, capacity):
            for i in range(items):
                used[first + i // each] += size
        assert sorted(capacity - u for u in used.values()) == plain_best_fit(sizes, capacity)


def test_pack(spark):
    random.seed(2)
    sizes = [random.choice([3, 3, 3, 7, 20, 64, 65, 200, 0, None]) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n_tokens long")
    rows = packing.pack(df, capacity=64, per_group=20).collect()
    bins = defaultdict(int)
    for r in rows:
        if r.n_tokens:
            bins[r.container] += r.n_tokens
        else:
            assert r.container is None
    whole = [s for s in sizes if s and s <= 64] + [x for s in sizes if s and s > 64 for x in [64] * (s // 64) + [s % 64] * (s % 64 > 0)]
    assert max(bins.values()) <= 64 and sorted(64 - b for b in bins.values()) == plain_best_fit(whole, 64)
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append((r.piece, r.first_token, r.n_tokens))
    assert all([p for p, *_ in sorted(v)] == list(range(len(v))) and sum(n for *_, n in v) == (sizes[d] or 0) and sorted(v)[0][1] == 0 for d, v in by.items()) and len(by) == 500
    assert packing.pack(df.limit(0), capacity=64).count() == 0


# ----------------------------------------------------------------- p10


def plain_shared(rows, least=160):
    held = defaultdict(set)
    for d, t in rows:
        for p in range(len(t or "") - least + 1):
            held[t[p : p + least]].add(d)
    out = defaultdict(set)
    for d, t in rows:
        for p in range(len(t or "") - least + 1):
            if len(held[t[p : p + least]]) > 1:
                out[d].update(range(p, p + least))
    return {d: len(v) for d, v in out.items()}


def spliced(seed, alphabet, docs=60):
    random.seed(seed)
    word = lambda n: "".join(random.choice(alphabet) for _ in range(n))
    spans = [word(random.choice([158, 159, 160, 161, 170, 300, 900])) for _ in range(8)]
    rows = []
    for d in range(docs):
        parts = [word(random.randrange(0, 200))]
        for _ in range(random.randrange(0, 3)):
            s = random.choice(spans)
            cut = random.randrange(0, 40)
            parts += [s[cut:] if random.random() < 0.5 else s, word(random.randrange(0, 120))]
        rows.append((d, "".join(parts)))
    return rows


@pytest.mark.parametrize(("seed", "alphabet"), [(1, "abcdefgh "), (2, "ab"), (3, "aé漢🙂 \n")])
def test_shared_spans_against_all_windows(spark, seed, alphabet):
    rows = spliced(seed, alphabet)
    rows += [(900, "x" * 500), (901, "x" * 165), (902, "y" * 400), (903, None), (904, ""), (905, rows[3][1]), (906, ("ab" * 200)), (907, "ab" * 90 + "c"), (908, "z" * 159), (909, "z" * 159)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.shared_chars for r in shared_spans.shared_chars(df).collect()}
    assert got == plain_shared(rows)


def test_spans_of_one_record_alone_and_repeated_rows(spark):
    rows = [(1, "q" * 999), (1, "q" * 999), (2, "abc" * 100 + "d" + "abc" * 100), (None, "abc" * 100), (None, "abc" * 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert shared_spans.shared_chars(df).count() == 0 and shared_spans.shared_chars(df.limit(0)).count() == 0


@pytest.mark.parametrize("batch", [1, 2, 10_000])
def test_spans_repeated_within_a_record(spark, batch):
    """The other holder stands in another chunk (1: each record is one), or in the same one with other text around it."""
    random.seed(12)
    word = lambda n: "".join(random.choice("abcdefgh ") for _ in range(n))
    spans = [word(n) for n in (200, 260, 500, 700)]
    rows = [(1, spans[2] + word(80) + spans[2]), (2, word(50) + spans[2]), (3, spans[3] + word(9) + spans[3])]
    rows += [(d, "".join(x for _ in range(random.randrange(1, 5)) for x in (random.choice([word(random.randrange(0, 90)), "-" * 30]), random.choice(spans[:2])))) for d in range(4, 24)]
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, batch)
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        got = {r.doc_id: r.shared_chars for r in shared_spans.shared_chars(df).collect()}
    finally:
        spark.conf.set(size, before)
    assert got == plain_shared(rows) and got[1] == 1000 and 3 not in got


def test_spans_of_rulers(spark):
    """Stretches whose ends agree and whose middles differ, as rulers and frames have them."""
    ruler = lambda g: "a" * 200 + "|" + "|".join("a" * n for n in g) + "|" + "a" * 200
    frame = lambda w: "\n".join("+" + "+".join("-" * n for n in w) + "+" for _ in range(9))
    pairs = [([51, 56, 50], [56, 51, 50]), ([60, 60, 61], [60, 61, 60]), ([40, 41, 42, 43], [40, 42, 41, 43])]
    rows = [(i, t) for i, t in enumerate([*(ruler(g) for p in pairs for g in p), frame([9, 12, 7]), frame([12, 9, 7]), frame([9, 12, 8])])]
    got = {r.doc_id: r.shared_chars for r in shared_spans.shared_chars(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert got == plain_shared(rows)
    assert {r.shared_chars for r in shared_spans.shared_chars(spark.createDataFrame(rows[:2], "doc_id long, text string").coalesce(1)).collect()} == {555}


@pytest.mark.parametrize("batch,hot", [(10_000, 3), (1, 3), (2, 20_000)])
def test_spans_with_a_hot_symbol(spark, monkeypatch, batch, hot):
    """A heading before ever different text, and a boilerplate; groups that go on over many blocks."""
    random.seed(4)
    word = lambda n: "".join(random.choice("abcdefgh ") for _ in range(n))
    head, long = word(110), word(300)
    rows = [(i, (head if i % 3 else "") + word(120) + (long if i % 4 == 0 else "")) for i in range(40)] + [(7, head + word(100))]
    monkeypatch.setattr(shared_spans, "HOT", hot)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, batch)
    try:
        for least in (60, 160):
            df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
            assert {r.doc_id: r.shared_chars for r in shared_spans.shared_chars(df, least=least).collect()} == plain_shared(rows, least)
    finally:
        spark.conf.set(size, before)


def test_pieces_of_one_hash_are_compared_verbatim(monkeypatch):
    monkeypatch.setattr(shared_spans, "mix", lambda x: x & np.uint64(0))
    random.seed(8)
    a, b = ("".join(random.choice("ab") for _ in range(90)) for _ in range(2))
    rows = shared_spans._rows(np.array([5, 5, 5]), np.array([1, 2, 3]), np.array([1, 2, 3]), np.zeros(3), None, np.array([31, 31, 31]), pa.array([a, b, "b" + a[:89]]))
    row, first, n = shared_spans.shared_in(rows, 60)
    assert [(int(r), int(f), int(k)) for r, f, k in zip(row, first, n)] == [(0, 0, 30), (2, 1, 30)]


def test_symbols_of_equal_windows_are_equal():
    random.seed(9)
    for alphabet in ("ab", "abcdefg", "aab"):
        inner = "".join(random.choice(alphabet) for _ in range(160))
        seen = set()
        for _ in range(60):
            left, right = ("".join(random.choice(alphabet) for _ in range(random.randrange(0, 40))) for _ in range(2))
            c = shared_spans.Chunk(np.frombuffer((left + inner + right).encode(), np.uint8), np.array([len(left) + 160 + len(right)]))
            seen.add(int(c.symbol[len(left)]))
        assert len(seen) == 1


# ----------------------------------------------------------------- p2


def reference_form(x):
    out = []
    for i, ch in enumerate(x):
        pict = lambda c: bool(c) and bool(lookalike._pictograph(np.array([ord(c)]))[0])
        if ch == "\r":
            out.append("" if x[i + 1 : i + 2] == "\n" else "\n")
        elif ch == "‍" and i and pict(x[i - 1]) and pict(x[i + 1 : i + 2]):
            out.append(ch)
        else:
            out.append(lookalike._one(ord(ch)))
    return unicodedata.normalize("NFC", "".join(out))


def test_forms_compose_as_the_standard():
    random.seed(5)
    blocks = [(32, 0x250), (0x300, 0x370), (0x370, 0x400), (0x900, 0xE00), (0x1100, 0x1200), (0x1E00, 0x2070), (0x3040, 0x3100), (0xAC00, 0xD7A4), (0xFB00, 0xFB18), (0xFF00, 0xFFE7)]
    texts = ["".join(chr(random.randrange(*random.choice(blocks))) for _ in range(random.randrange(0, 30))) for _ in range(5000)]
    texts += ["", "👩‍💻 x", "a‍b", "a\r\nb\rc", "ạ́̇", "x" * 10_000]
    assert lookalike.canonical_column(pa.array(texts)).to_pylist() == [reference_form(x) for x in texts]


@pytest.mark.parametrize(("a", "b"), [("ｆｕｌｌ ｗｉｄｔｈ", "full width"), ("café", "café"), ("zero​width", "zerowidth"), ("no break", "no break"), ("ﬁne", "fine"), ("pаypаl", "paypal"), ("ｶﾞｽ", "ガス"), ("Ѕο", "So"), ("пοезд", "поезд"), ("soft­hy", "softhy"), ("ＡＢＣ", "ΑΒC"), ("한글", "한글")])
def test_same_looking(a, b):
    x, y = lookalike.canonical_column(pa.array([a, b])).to_pylist()
    assert x == y and lookalike.canonical_column(pa.array([x])).to_pylist() == [x]


@pytest.mark.parametrize(("a", "b"), [("H₂O", "H2O"), ("½", "1/2"), ("Ⅳ", "IV"), ("™", "TM"), ("①", "1"), ("A", "a"), ("ano", "año"), ("👩💻", "👩‍💻"), ("a  b", "a b"), ("поезд", "noeзд")])
def test_different_looking(a, b):
    x, y = lookalike.canonical_column(pa.array([a, b])).to_pylist()
    assert x != y


def test_pairs(spark):
    long = "a text of more than twenty characters"
    rows = [(1, long), (2, long), (3, long.replace(" ", " ")), (4, long.replace("a", "а")), (5, "short"), (6, "sh​ort"), (7, None), (8, long.upper()), (9, long.replace(" ", " "))]
    df = spark.createDataFrame(rows, "rowid long, text string")
    got = {tuple(r) for r in lookalike.same_looking_pairs(df).collect()}
    assert got == {(1, 3), (2, 3), (1, 4), (2, 4), (3, 4), (1, 9), (2, 9), (4, 9)}
    assert lookalike.same_looking_pairs(df.limit(0)).count() == 0


# ----------------------------------------------------------------- p3

FOUND = [
    ("mail jonas.k@post.test now", "mail [EMAIL] now"), ("x＠haus.example", "[EMAIL]"), ("at clara at mail dot example dot com!", "at [EMAIL]!"), ("メールはa_b@c.orgへ", "メールは[EMAIL]へ"), ("s [at] dept [dot] example [dot] net", "[EMAIL]"), ("<mailto:a@b.co>", "<[EMAIL]>"),
    ("Call +44 20 7946 0115.", "Call [PHONE]."), ("電話は212-555-0185です", "電話は[PHONE]です"), ("(212) 555-0183", "[PHONE]"), ("Tel. 555-0134", "Tel. [PHONE]"), ("Call 617 555 0134 ext. 54 today", "Call [PHONE] today"), ("０２０ ７９４６ ０１５０ rang", "[PHONE] rang"),
    ("SSN 123-45-6789.", "SSN [ID]."), ("マイナンバーは1234-5678-9012.", "マイナンバーは[ID]."), ("DNI 12345678-T", "DNI [ID]"), ("passport no. XZ7805182", "passport no. [ID]"), ("numéro de sécu 3 61 84 75 213 942 55", "numéro de sécu [ID]"),
    ("to 882 Oxgate Lane, Apt 3, Vernois 68819.", "to [ADDRESS]."), ("住所は346, avenue Cobble, Harnfeldです", "住所は[ADDRESS]です"), ("Wrenstraße 510a, 57039 Morvale", "[ADDRESS]"), ("PO Box 80, Harnfeld 28162", "[ADDRESS]"), ("〒123-4567 霞野市北浜12番地", "[ADDRESS]"), ("霞野市東原9丁目9-18", "[ADDRESS]"),
    ("Signed, Noor Fennovar", "Signed, [NAME]"), ("Signed, Verhagen, Aiko", "Signed, [NAME]"), ("Was it Frau Oskrick?", "Was it [NAME]?"), ("FELIX QUILSTEAD paid", "[NAME] paid"), ("Dr. Galdmund", "[NAME]"), ("桐野 慎也様から", "[NAME]から"), ("mira tolberg came", "[NAME] came"),
]
CLEAN = ["Order no. 123-45-678 covers it", "Tracking 1234 5678 9012", "Build 12.3.45 failed", "Ring 3 times.", "worth 1,234.56", "Box 12 of the list is full", "mira QX-00123456", "The main street view has 3 pins", "Carmen said so", "Ping 10.0.0.12", "see #123456/00 and rec_aa12", "@@due@@ {{email}}", "Call again in 41 seconds", "", "Project Vanostead 2025-12-11 10:00"]


def replaced(texts):
    column = pa.array(texts, pa.string())
    out = list(texts)
    for i, text, spans in personal.found_in(column, tuple(personal.GIVEN_NAMES), 200):
        out[i] = personal.redact(text, spans)
    return out


def test_personal_items():
    assert replaced([a for a, _ in FOUND]) == [b for _, b in FOUND]


def test_no_personal_items():
    assert replaced([*CLEAN, None]) == [*CLEAN, None]


def test_every_spelling_has_its_anchor():
    texts = [f"12 Oakhill {w}" for w in personal.AFTER_NAME] + [f"7 {w} Bellecour" for w in personal.BEFORE_NAME] + [f"Wren{w} 34" for w in personal.ENDINGS] + [f"{w} Larga, 5" for w in personal.BEFORE_NUMBER]
    texts += ["12 allée Verte", "P.O. Box 80", "P O Box 80", "POBox 80", "P. O. Box 80", "Postfach 12", "Apartado 31", "Apartado de correos 31", "BP 77", "boîte postale 9", *(f"北浜{c}東12番地" for c in personal.DISTRICTS), "渋谷区神南1-2-3", "〒123-4567"]
    texts += [f"{x} Тверская, д. 12" for w in personal.RUSSIAN for x in (w, w.capitalize(), w.upper())] + ["Ленинский проспект, 30, кв. 4", "г. Москва, ул. Большая Ордынка, дом 5", "ул. Мира 7"]
    assert [a for a, b in zip(texts, replaced(texts), strict=True) if b not in ("[ADDRESS]", "[ADDRESS].")] == []
    texts = ["juan arroba correo punto es", "x at firma punkt de", "x at firma dot de", "jean arobase exemple point fr", "jean chez exemple point fr"]
    texts += [f"x{s}{a}{i}{at}{i}{b}{s}firma.de" for at in personal.ATS for a, b in ("[]", "()", "{}", "<>") for i in ("", " ") for s in ("", " ")]
    assert [a for a, b in zip(texts, replaced(texts), strict=True) if b != "[EMAIL]"] == []
    clean = ["We met at some point in May", "He was at this point de facto alone", "Chez Marie on mange bien", "Улица была пуста, 12 человек шли домой", "Box 12 of 30", "The place had 12 seats", "Drop 12 by the way"]
    assert replaced(clean) == clean


def test_names_outside_the_list():
    found = [
        ("Signed, James Miller", "Signed, [NAME]"), ("Best regards, Mary Oldenham", "Best regards, [NAME]"), ("Hello, my name is George Brown.", "Hello, my name is [NAME]."), ("Name: Elizabeth Harrow", "Name: [NAME]"), ("From: Richard T. Oakes", "From: [NAME]"), ("Mit freundlichen Grüßen\nUwe Brandt", "Mit freundlichen Grüßen\n[NAME]"),
        ("Cordialement, Thibault Moreau", "Cordialement, [NAME]"), ("Иван Петров просил счёт", "[NAME] просил счёт"), ("звонила Мария Ивановна Кузнецова", "звонила [NAME]"), ("АННА СМИРНОВА", "[NAME]"), ("Передайте Ивану Петрову", "Передайте [NAME]"), ("Меня зовут Олег Ким", "Меня зовут [NAME]"), ("氏名: 山田太郎", "氏名: [NAME]"), ("山田 太郎と申します", "[NAME]と申します"), ("担当者は佐藤 花子", "担当者は[NAME]"),
    ]
    assert replaced([a for a, _ in found]) == [b for _, b in found]
    clean = ["From: Atlas Project Desk", "I am Here Today", "Улица Пушкина пуста", "Звонил Петров", "Город Иваново", "Contact the Green Party", "name is too long", "Kind regards from all of us", "Проект Гагарина"]
    assert replaced(clean) == clean


def test_items_of_a_table(spark):
    df = spark.createDataFrame([(1, "a@b.org and c@d.org, Tel. 555-0134"), (2, None), (3, ""), (1, "a@b.org and c@d.org, Tel. 555-0134"), (4, "x" * 100_000 + " a@b.org")], "id int, text string")
    rows = {r.id: (r.kinds, r.redacted[-30:]) for r in personal.items(df, ["id"]).collect()}
    assert rows[1] == (["EMAIL", "PHONE"], "AIL] and [EMAIL], Tel. [PHONE]") and rows[4][0] == ["EMAIL"] and set(rows) == {1, 4}
    assert personal.items(df.limit(0), ["id"]).count() == 0
    every = {(r.id, (r.redacted or "")[-7:]) for r in personal.items(df, ["id"], every=True).collect()}
    assert every == {(1, "[PHONE]"), (2, ""), (3, ""), (4, "[EMAIL]")}


# ----------------------------------------------------------------- p5


def test_conversations(spark):
    at = lambda m: f"2026-01-01T10:{m:02d}:00Z"
    files = {
        "good": [(0, at(0), "user", "q"), (1, at(2), "assistant", "late"), (2, at(1), " System ", "note"), (3, at(1), "Human", " "), (4, at(3), "AI", "a")],
        "hole": [(0, at(0), "user", "q"), (2, at(1), "ai", "a")], "late": [(1, at(0), "user", "q"), (2, at(1), "ai", "a")], "norole": [(0, at(0), "user", "q"), (1, at(1), "bot", "a")], "nulls": [(0, at(0), "user", "q"), (1, at(1), None, "a")],
        "nots": [(0, "soon", "user", "q"), (1, at(1), "ai", "a")], "noreply": [(0, at(0), "user", "q"), (1, at(1), "ai", None)], "ai first": [(0, at(0), "ai", "q"), (1, at(1), "ai", "a")], "empty": [(0, at(0), "user", ""), (1, at(1), "ai", "　")],
        "ends with system": [(0, at(0), "user", "q"), (1, at(1), "ai", "a"), (2, at(2), "system", "s")],
    }
    rows, n = [], 0
    for name, lines in files.items():
        for line, ts, role, text in lines:
            for _ in range(2 if name == "good" else 1):
                n += 1
                rows.append((n, f"raw/{name}.jsonl", line, ts, role, text, 1))
    rows.append((n + 1, None, 0, at(0), "user", "q", 1))
    log = spark.createDataFrame(rows, "log_id long, src_file string, line_no int, ts string, role string, text string, cfg_id int")
    cfg = spark.createDataFrame([(1, "UTC")], "cfg_id int, timezone string")
    got = sorted((r.session, r.pos, r.log_id) for r in conversations.rebuild(log, cfg).collect())
    assert [g[:2] for g in got] == [*(("ends with system", i) for i in range(3)), *(("good", i) for i in range(4))]
    assert [g[2] for g in got if g[0] == "good"] == [1, 5, 3, 9]
    assert conversations.rebuild(log.limit(0), cfg).count() == 0


# ----------------------------------------------------------------- p7

CASES = [
    "Dear {{first_name}}, your order is ready.", "Hello [YOUR NAME],", "Total: ${total} (3 items)", "<%= name %>様、ありがとう", "Due on XX/XX/XXXX", "Ηеllo __RECIPIENT__!", "*|FNAME|*様", "404 Not Found", "HTTP Error 502: Bad Gateway. Request id 7", "<html><head><title>503</title></head></html>", "Traceback (most recent call last): KeyError: 'x'",
    "Please enable JavaScript to view this page.", "JavaScriptを有効にしてください。", "Veuillez activer les scripts de votre navigateur pour continuer.", "Session expired. Please log in again.", "Loading... Loading... Loading...", "test test test 12", "null", "Your text here", "Lorem ipsum dolor sit amet", "Access denied. You do not have permission to view this.",
    "This content is no longer available.", "One moment please. Checking your browser before you continue...", "TODO: write the summary of the plan here", "Site en maintenance, revenez plus tard.", "{\"error\":{\"code\":500}}",
]
TALK = [
    "JavaScript is still my favourite.", "Set $HOME and %TEMP% before you start.", "In the code: total = {k: v * 3 for k, v in rows}", "How do I escape a double brace in the template?", "We got 502 gateway errors since Monday, so it is late.", "Access to the room was denied yesterday.", "The placeholder colour should be darker.",
    "My TODO: call about the plan", "I wrote a test, it ran 12 times without an error.", "ok", "Hmm.", "Replace the sample paragraph with the budget, please.", "", " ", "Please log the hours you worked on Friday in the usual sheet for the whole team before noon, thanks a lot",
]


def test_residue(spark):
    rows = [(i, x) for i, x in enumerate([*CASES, *TALK, None])]
    got = {r.i for r in residue.residue(spark.createDataFrame(rows, "i int, text string"), ["i"]).collect()}
    assert [x for i, x in rows if (i in got) != (i < len(CASES))] == []


def test_residue_of_any_length(spark):
    css = "body{margin:0}" * 150
    cases = [
        f"<!DOCTYPE html><html><head><style>{css}</style><title>503 Service Temporarily Unavailable</title></head><body><h1>503</h1><p>{'nginx ' * 400}</p></body></html>",
        f"<html><head><title>shop</title><script>{css}</script></head><body><h1>Access denied</h1></body></html>",
        "Traceback (most recent call last):\n" + "".join(f'  File "/srv/app/part{i}.py", line {i}, in call\n    for i in run(x{i}):\n' for i in range(90)) + "KeyError: 'x'",
        "java.lang.IllegalStateException: closed\n" + "".join(f"\tat org.app.Part{i}.run(Part{i}.java:{i})\n" for i in range(200)),
        '{"error": {"code": 500, "stack": "' + "frame, " * 900 + '"}}', '{"message": "no", "trace": "' + "frame, " * 900 + '"}',
        "Please enable JavaScript to view this page. " + "Open the settings of your browser, allow scripts for this site and reload the page. Why have I been blocked? The website needs cookies. " * 30,
        "Lorem ipsum dolor sit amet, " * 200, "test " * 9000, "---- " * 3000, "Hello {{ customer.address.street | default('the street that we have on file for you today') | upper }}!",
    ]
    talk = [
        "Access denied. That is what my browser said when I opened the page, and the site did not say why. " * 20,
        "Session expired. " + "Then Renate went to the market, bought bread and cheese, and came home late in the rain. " * 20,
        f"<html><head><style>{css}</style><title>Bread of the valley</title></head><body><h1>Bread</h1>{'flour and water ' * 200}</body></html>",
        "Plain words of a long letter, " * 9000, '{"message": "' + "see you tomorrow, " * 200 + '"}', "-" * 3000 + "x",
    ]
    rows = list(enumerate([*cases, *talk]))
    got = {r.i for r in residue.residue(spark.createDataFrame(rows, "i int, text string"), ["i"]).collect()}
    assert [x[:60] for i, x in rows if (i in got) != (i < len(cases))] == []


def test_slots_are_told_from_literals_by_alignment(spark):
    names = ["{name}", "{first}", "%FNAME%", "{0}"]
    rows = [(i, f"You owe {n} the sum of {i} coins") for i, n in enumerate(names)] + [(10 + i, f"run it with $HOME as folder {i}") for i in range(4)]
    df = spark.createDataFrame(rows, "i int, text string")
    assert {r.i for r in residue.residue(df, ["i"]).collect()} == {0, 1, 2, 3}
    assert residue.without_residue(df, ["i"]).count() == 4 and residue.residue(df.limit(0), ["i"]).count() == 0


def test_slots_that_share_their_surroundings(spark):
    rows = [(1, "Set $HOME and {name} now"), (2, "{a} {b} $HOME"), (3, "Put $HOME or %TEMP% here")]
    df = spark.createDataFrame(rows, "i int, text string")
    assert {r.i for r in residue.residue(df, ["i"]).collect()} == {1, 2}
    held = residue.slots(df.withColumnRenamed("text", "canonical"), ["i"]).where("i = 2").collect()
    assert sorted(r.held for r in held) == ["$HOME", "{a}", "{b}"]


def test_filler_vocabulary_is_induced(spark):
    rows = [(i, f"Lorem {a} ipsum {b} {a} {b}.") for i, (a, b) in enumerate([("vexil", "tarsum"), ("quorin", "vexil"), ("tarsum", "quorin")])] + [(7, "Vexil tarsum quorin vexil tarsum."), (8, "please send the notes to me today"), (9, "we said lorem once in the notes today")]
    got = {r.i for r in residue.filler_texts(lookalike.canonicalize(spark.createDataFrame(rows, "i int, text string"), "i"), ["i"]).collect()}
    assert got == {0, 1, 2, 7}


def test_keys_keep_their_types(spark):
    df = spark.createDataFrame([("meta", 1 << 40, "404 Not Found")], "src_table string, row_id long, text string")
    assert residue.residue(df, ["src_table", "row_id"]).first() == ("meta", 1 << 40)
    assert df.select(F.lit(1)).count() == 1


def test_slots_aligned_with_filled_records(spark):
    """Blanks and defaults are told by what records of the same template hold; marked names that never change are none."""
    filled = [f"The parcel for {a} {b} left on {d} May." for (a, b), d in zip([("Anna", "Smith"), ("Bo", "Lund"), ("Kwame", "Mensah")], (3, 4, 5), strict=True)]
    cases = ["The parcel for Firstname Lastname left on 7 May.", "The parcel for ________ left on 9 May.", "The parcel for $CLIENT left on 9 May.", "Dear ______, your invoice of ____ is due", "Hello Firstname Lastname, your order Ordernumber shipped", "Erreur interne du serveur", "Erreur interne du serveur"]
    cases += ["Fehler im Modul 7: abgebrochen"] * 3 + ["503 Service Unavailable: the upstream of this site did not answer the request in time, please reload the page or contact the administrator of the server. " * 6]
    talk = ["we set $LAYOUT in the build script", "we set $LAYOUT in the build script today", "Run it with $HOME as folder", "def __init__(self): pass", "She waited... and left", "Fehler im Modul 8, das ärgert mich sehr", "User name rules were discussed", *filled]
    rows = list(enumerate([*cases, *talk]))
    got = {r.i for r in residue.residue(spark.createDataFrame(rows, "i int, text string"), ["i"]).collect()}
    assert [x[:70] for i, x in rows if (i in got) != (i < len(cases))] == []


def test_residue_of_null_keys_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "404 Not Found", "a", 1), (None, "404 Not Found", "b", 2), (3, None, "c", 3), (1, "404 Not Found", "a", 1)], "what int, text string, held string, around int")
    assert [r.what for r in residue.residue(df, ["what"]).collect()] == [1]


# ----------------------------------------------------------------- p3: anchors


def kinds_in(texts):
    out = [set() for _ in texts]
    for row, _, spans in personal.found_in(pa.array(texts, pa.string()), tuple(personal.GIVEN_NAMES)):
        out[row] = {k for *_, k in spans}
    return out


def test_names_outside_the_list():
    texts = ["I met Wendell Okafor yesterday", "please ask Tiago Moreira about it", "Signed, Kwame Mensah", "Bjorn Halvorsen called about the lease", "Ich sprach mit Gunhild Aasen", "On a demandé à Thibault Lemoine", "Hablé con Xiomara Quintana", "Meine Kollegin: Frau Oduya kommt", "Signé: Solveig Dahl", "Wilhelmina Vanderberg wrote to us", "Меня зовут Радомир Соколов", "氏名：鳴瀬 美緒"]
    assert [t for t, k in zip(texts, kinds_in(texts), strict=True) if k != {"NAME"}] == []
    none = ["I asked Project Harrow Ledger", "we met Monday Morning Team", "ask Harrow Works about it", "Wren Suite called", "She said Maybe Later", "They told Quilmark Depot"]
    assert [t for t, k in zip(none, kinds_in(none), strict=True) if k] == []


def test_numbers_with_check_digits_need_no_cue():
    texts = ["mine is 12345678Z ok", "use X1234567L", "le 1 85 05 78 006 084 91 est faux ou vrai", "meu 529.982.247-25"]
    wrong = ["mine is 12345678A ok", "use X1234567A", "meu 529.982.247-26", "order 12345678Z"]
    key = 97 - int("1850578006084") % 97
    texts[2] = f"le 1 85 05 78 006 084 {key:02d} suffit"
    assert [t for t, k in zip(texts, kinds_in(texts), strict=True) if k != {"ID"}] == []
    assert [t for t, k in zip(wrong, kinds_in(wrong), strict=True) if "ID" in k] == []


def test_items_of_long_texts_are_found_in_linear_time():
    import time

    item = "mail ana.kovac@example.org, call +49 151 2345678, SSN: 123-45-6789, 12 Oak Street, signed Emma Brown. "
    filler = "words that say nothing at all and go on for a while " * 20

    def took(n):
        text = (filler + item) * n
        began = time.perf_counter()
        (_, _, spans), = personal.found_in(pa.array([text]), tuple(personal.GIVEN_NAMES))
        assert len(spans) == 5 * n and all(a < b for a, b, _ in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
        return time.perf_counter() - began

    took(2)
    assert took(160) < 14 * max(took(20), 0.05)


# ----------------------------------------------------------------- p5: the automaton


def test_functions_compose_as_the_automaton_runs():
    rng = np.random.default_rng(3)
    moves = rng.integers(0, 4, 500)
    piece = np.sort(rng.integers(0, 60, 500))
    first, ends = conversations.composed(conversations.NEXT[:, moves].T.copy(), piece)
    for k, a in enumerate(first):
        b = first[k + 1] if k + 1 < len(first) else 500
        for state in range(4):
            s = state
            for m in moves[a:b]:
                s = conversations.NEXT[s, m]
            assert ends[k, state] == s


@pytest.mark.parametrize("batch", [1, 3, 10_000])
def test_conversations_against_a_plain_version(spark, batch):
    random.seed(batch)
    rows, key = [], 0
    for c in range(60):
        n = random.randrange(1, 9)
        for line in range(n):
            if random.random() < 0.03:
                continue
            day = random.randrange(1, 4)
            ts = f"2026-05-0{day}T{random.randrange(0, 3):02d}:00:00Z" if random.random() > 0.02 else "soon"
            row = (f"raw/c{c}.jsonl", line, ts, random.choice(["user", "Human ", "assistant", "ai", "AI", "system"] + ["bot"] * (random.random() < 0.1)), random.choice(["hello", "x", " ", None, "y"]), 1)
            for _ in range(2 if random.random() < 0.2 else 1):
                key += 1
                rows.append((key, *row))
            if random.random() < 0.1:
                key += 1
                rows.append((key, *row[:4], "other", 1))
    expected = []
    for c in range(60):
        once = {}
        for k, *row in rows:
            if row[0] == f"raw/c{c}.jsonl":
                once.setdefault(tuple(row), k)
        own = [(r[2], r[1], k, conversations.ROLES.get(r[3].strip().lower()), bool((r[4] or "").strip())) for r, k in once.items()]
        lines = {r[1] for r in own}
        if not own or lines != set(range(len(lines))) or any(r[0] == "soon" or r[3] is None for r in own):
            continue
        own.sort()
        spoken = [r[3] for r in own if r[4] and r[3] != "system"]
        if spoken and spoken[0] == "user" and spoken[-1] == "assistant":
            expected += [(f"c{c}", i, r[2]) for i, r in enumerate(r for r in own if r[4])]
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, batch)
    try:
        log = spark.createDataFrame(rows, "log_id long, src_file string, line_no int, ts string, role string, text string, cfg_id int")
        cfg = spark.createDataFrame([(1, "UTC")], "cfg_id int, timezone string")
        got = sorted(tuple(r) for r in conversations.positions(log, cfg).collect())
    finally:
        spark.conf.set(size, before)
    assert got == sorted(expected) and len(expected) > 10


# ----------------------------------------------------------------- p2: many marks, large classes


def test_many_marks_compose_in_linear_time():
    import time

    def took(n):
        data = ("e" + "̣́" * n).encode()
        began = time.perf_counter()
        lookalike.canonical_chunk(np.frombuffer(data, np.uint8), np.array([len(data)]))
        return time.perf_counter() - began

    took(10)
    assert took(16_000) < 14 * max(took(2_000), 0.02)
    text = "e" + "̣́̈" * 40
    data = text.encode()
    assert lookalike.canonical_chunk(np.frombuffer(data, np.uint8), np.array([len(data)]))[0].as_py() == unicodedata.normalize("NFC", text)


def test_classes_and_pairs_of_a_large_class(spark):
    plain = "a boilerplate that many rows carry"
    wide = plain.replace(" ", "\u00a0")
    rows = [(i, plain if i % 3 else wide) for i in range(90)] + [(7, plain), (200, "another text of some length"), (None, plain), (201, None)]
    df = spark.createDataFrame(rows, "rowid long, text string")
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if (i % 3 == 0) != (j % 3 == 0)}
    for per_group in (10, 2000):
        got = [tuple(r) for r in lookalike.same_looking_pairs(df, per_group=per_group).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    classes = {r.rowid: (r["class"], r.links) for r in lookalike.same_looking_classes(df).collect()}
    assert classes == {i: (0, 60 if i % 3 == 0 else 30) for i in range(90)}
    assert lookalike.same_looking_classes(df.limit(0)).count() == 0


def test_a_vocabulary_too_large_for_packed_pairs_is_refused(tmp_path):
    import json

    file = tmp_path / "large.json"
    file.write_text(json.dumps({"model": {"vocab": {"a": 1 << 16}, "merges": []}}))
    with pytest.raises(ValueError):
        byte_bpe.ByteBpe(str(file))
