"""Document operators against brute force, and their edge cases."""

import hashlib
import json
import re
import string
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from skygauge.llm import boosting, counting, jaccard, mixing, packing, pii, quality, rules
from skygauge.llm.bpe import byte_bpe, tokenizer_path, word_pieces
from skygauge.llm.text import shingle_hashes, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size long, spans string"
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
ROWS = [
    (1, "one two three four five six seven eight nine ten eleven", "en", "a"),
    (1, "one two three four five six seven eight nine ten eleven", "en", "a"),
    (2, None, None, None), (3, "", "xx", "b"), (4, " \t\n ", "de", None), (None, "null id with mail a.b@c.example.org in it", "fr", "b"),
    (5, LONG, "en", "a"), (6, "ÄÖ ñé İß x 日本語 <|endoftext|> \x1c end", "es", "c"), (7, "up up up up up up up up up up up up", "en", "c"),
    (8, "call +1 (269) 555-3296 4524132264652876 or 10.20.30.40", "en", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, None, "clash", -1, "clash") for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen = Counter(grams)
    again = {j for i, g in enumerate(grams) if seen[g] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again)


def test_base_counts_equal_brute_force(spark, docs):
    table = [r[0] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    for text in [r[1] for r in ROWS] + table + ["a b c d e a b c d e f", "x\n x\nx\n\nx y", "a a a a a a a"]:
        assert rules.base_counts(text)[0] == brute_base(text)


def test_rules_verdicts(docs, none):
    got = {(r.doc_id, r.text): r for r in rules.judge(docs).collect()}
    assert len(got) == len(ROWS) - 1 and rules.judge(docs).count() == len(ROWS)
    for (_, text), r in got.items():
        n, *_, again = brute_base(text)
        assert r.base_failed == (n < 10 or 100 * again > 20 * n) and r.kept <= (not r.base_failed)
    assert got[1, ROWS[0][1]].kept is True and got[7, ROWS[8][1]].base_failed and got[2, None].base_failed
    assert rules.judge(none).count() == 0


def test_rules_reject_junk_and_keep_prose(spark):
    rows = rules.judge(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").select("quality", "base_failed", "kept").collect()
    good = [r for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r for r in rows if r.quality == 0]
    assert all(r.kept for r in good) and sum(not r.kept for r in bad) > 0.9 * len(bad)


RUSSIAN = "Утром мы вышли из дома и пошли к реке, потому что погода была хорошая и никто не спешил. На берегу стояли лодки, а рыбаки говорили о том, что вода в этом году поднялась выше обычного. Мы сидели на траве, пили чай и смотрели, как дети бегают по песку и смеются. Вечером стало холодно, и все вернулись в деревню, где уже горел свет и пахло свежим хлебом."
GREEK = "Το πρωί βγήκαμε από το σπίτι και πήγαμε προς το ποτάμι, γιατί ο καιρός ήταν καλός και κανείς δεν βιαζόταν. Στην όχθη υπήρχαν βάρκες και οι ψαράδες έλεγαν ότι το νερό φέτος ανέβηκε πιο πολύ από άλλες χρονιές. Καθίσαμε στο γρασίδι, ήπιαμε καφέ και κοιτούσαμε τα παιδιά να τρέχουν στην άμμο και να γελούν μέχρι το βράδυ."
CHINESE = "早上 我们 离开 家 走 到 河边 ， 因为 天气 很好 ， 没有 人 着急 。 岸边 停着 几条 小船 ， 渔民 说 今年 的 水位 比 往年 高 。 我们 坐在 草地 上 喝茶 ， 看 孩子们 在 沙滩 上 跑 。"
ITALIAN = "La mattina siamo usciti di casa e siamo andati verso il fiume, perché il tempo era bello e nessuno aveva fretta. Sulla riva c'erano alcune barche e i pescatori dicevano che quest'anno l'acqua era salita più del solito. Ci siamo seduti sull'erba, abbiamo bevuto il tè e guardato i bambini che correvano sulla sabbia e ridevano fino a sera."


@pytest.mark.parametrize("beside", [True, False])
def test_prose_of_any_language_stays(spark, beside):
    prose = [(t, lang) for t, own in ((RUSSIAN, "ru"), (GREEK, "el"), (CHINESE, "zh"), (ITALIAN, "it")) for lang in (own, None)]
    rows = spark.createDataFrame([(-i - 1, t, lang) for i, (t, lang) in enumerate(prose)], "doc_id long, text string, lang string")
    every = rows.unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(*rows.columns)) if beside else rows
    got = {r.doc_id: r for r in rules.judge(every).where("doc_id < 0").collect()}
    for i, (text, lang) in enumerate(prose):
        assert got[-i - 1].kept and not got[-i - 1].base_failed, (text[:20], lang)
        if lang is not None:
            assert got[-i - 1].class_distance is None and got[-i - 1].common_distance is None


def test_verdict_equals_a_plain_loop(spark):
    """References and distances by dictionaries, per language."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rows = table.collect() + [T.Row(doc_id=-1, text=ITALIAN, lang="it"), T.Row(doc_id=-2, text=None, lang="en"), T.Row(doc_id=-3, text="# $ % " * 60 + "a b c d e f g h", lang=None)]
    more = spark.createDataFrame(rows, table.schema)
    passed = {}
    for r in rows:
        n, _, _, _, again = brute_base(r.text)
        passed.setdefault(r.lang, []).append(r.text) if not (n < 10 or 100 * again > 20 * n) and r.lang else None

    def distance(p, q):
        a, b, total = sum(p.values()), sum(q.values()), 0.0
        for k in {*p, *q}:
            x, y = p.get(k, 0) / a, q.get(k, 0) / b
            total += (x * np.log2(2 * x / (x + y)) if x else 0) + (y * np.log2(2 * y / (x + y)) if y else 0)
        return np.sqrt(max(total, 0) / 2)

    kind = lambda t: Counter(rules.CLASSES[rules._TABLE[min(ord(c), 0x250)]] for c in t)
    refs = {}
    for lang, texts in passed.items():
        w = Counter(x for t in texts for x in words(t))
        if sum(w.values()) >= rules.LEAST_WORDS:
            top = dict(sorted(w.items(), key=lambda x: (-x[1], x[0]))[: rules.N_COMMON])
            refs[lang] = sum((kind(t) for t in texts), Counter()), top | {"": sum(w.values()) - sum(top.values())}
    assert set(refs) == {"en", "de", "fr", "es"}
    got = {r.doc_id: r for r in rules.judge(more).collect()}
    for r in rows:
        n, _, _, _, again = brute_base(r.text)
        kept = not (n < 10 or 100 * again > 20 * n)
        if kept:
            length = len(r.text)
            if r.lang in refs:
                far = lambda a, b: (length >= 300 and a > 0.28) or (n >= 100 and b > 0.36) or (n >= 300 and b > 0.32)  # noqa: B023, E731
                to = {k: (distance(kind(r.text), c), distance(Counter(x if x in w else "" for x in words(r.text)), w)) for k, (c, w) in refs.items()}
                by_class, by_word = to[r.lang] if not far(*to[r.lang]) else (min(a for a, _ in to.values()), min(b for _, b in to.values()))
                assert got[r.doc_id].class_distance == pytest.approx(by_class) and got[r.doc_id].common_distance == pytest.approx(by_word)
                kept = not far(by_class, by_word)
            elif r.lang is None:
                kept = not (length >= 300 and min(distance(kind(r.text), c) for c, _ in refs.values()) > 0.28)
        assert got[r.doc_id].kept == kept
    assert not got[-3].kept and got[-1].kept


def test_other_columns_stay_as_they_are(spark):
    rows = [(1, "one two three", "en", float("nan"), None, [1, None], True, None, 2.5), (2, None, None, 1.5, 7, None, None, "k", float("nan"))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, size int, list array<int>, flag boolean, kept string, _masked double")
    show = lambda d: sorted(map(str, d.select("doc_id", "score", "size", "list", "flag", "_masked").collect()))
    for made in (rules.judge(df), pii.find(df), pii.mask(df)):
        assert show(made) == show(df)
    assert sorted(map(str, pii.mask(df).collect())) == sorted(map(str, df.collect()))


def test_divergence():
    same = np.array([[1.0, 3.0], [0.0, 0.0], [4.0, 0.0]])
    assert np.allclose(rules.divergence(same, np.array([2.0, 6.0])), [0, 0, rules.divergence(same, np.array([2.0, 6.0]))[2]])
    assert np.isclose(rules.divergence(np.array([[1.0, 0.0]]), np.array([0.0, 5.0]))[0], 1)


def test_byte_ids_equal_library():
    own, lib = byte_bpe(tokenizer_path("byte_bpe_50k.json")), Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    pieces, whole = word_pieces(tokenizer_path("word_bpe_49k.json")), Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    rng = np.random.default_rng(1)
    parts = ["a", "B ", "  ", "\n", " ", "'s", "é", "İ", "ß", " ", " ", "1", "٣", "!", "<|endoftext|>", "\x1c", "日本", "\t", "'ll ", "é", "😀", "Σ", "²", "É.", "<|startoftext|>"]
    texts = [r[1] for r in ROWS if r[1]] + ["".join(rng.choice(parts, rng.integers(0, 25))) for _ in range(3000)]
    for t in texts:
        assert own.ids(t) == np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t
        assert sum(pieces.pieces[p] for c in pieces.chunks(t) for p in pieces.pretokens(c)) == len(whole.encode(t, add_special_tokens=False).ids), t


def test_byte_ids_of_white_space_runs():
    own, lib = byte_bpe(tokenizer_path("byte_bpe_50k.json")), Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    rng = np.random.default_rng(12)
    marks = [" ", " ", "\u00a0", "\u00a0", "a", "price:", "10", "\u3000", "\u2009", "\t", "\n", "\x85", "\x1c", "\r\n", "\u200b"]
    texts = ["a \u00a0 \u00a0", "price: \u00a0 \u00a0 \u00a0 10 euro", " \u00a0" * 9, "x" * 5000, "ab" * 3000] + ["".join(rng.choice(marks, rng.integers(1, 16))) for _ in range(20_000)]
    for t in texts:
        assert own.ids(t) == np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


def test_token_counts(docs, none, monkeypatch):
    lib = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = sorted((r[0] or -1, len((r[1] or "").encode()), len(lib.encode(r[1] or "", add_special_tokens=False).ids)) for r in ROWS)
    got = counting.token_counts(docs, n_buckets=7).collect()
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got) and any(r.over_limit for r in got)
    assert counting.token_counts(none).count() == 0


def test_pretokens_with_signs_equal_library():
    path = tokenizer_path("word_bpe_49k.json")
    words, whole = word_pieces(path), Tokenizer.from_file(path)
    rng = np.random.default_rng(5)
    parts = [*string.punctuation, "'s", "'LL", "a", "Zé", "ß", "Ⱥ", "Ⱦ", "İ", "ǅ", "ſ", "ª", "7", "²", "\u0338", "\x1f", "\u00a0", "<|endoftext|>"]
    texts = ["wow!!!", "é$$$", "it''s", "<b>", "&&&'s"] + ["".join(rng.choice(parts, rng.integers(1, 9))) for _ in range(5000)]
    for t in texts:
        assert sum(words.pieces[p] for c in words.chunks(t) for p in words.pretokens(c)) == len(whole.encode(t, add_special_tokens=False).ids), repr(t)


def test_blocks_cut_and_hash_each_name_once(monkeypatch):
    path = tokenizer_path("word_bpe_49k.json")
    words, whole = word_pieces(path), Tokenizer.from_file(path)
    texts = ["Même mot, mot!! it's 42 <|endoftext|> x-y", "", "mot mot mot\tend", None, "\t \n"]
    want = [len(whole.encode(t or "", add_special_tokens=False).ids) for t in texts]
    cut, hashed = Counter(), Counter()
    work = words.work
    monkeypatch.setattr(words, "work", lambda chunk: cut.update([chunk]) or work(chunk))
    monkeypatch.setattr(counting, "crc32", lambda raw: hashed.update([raw]) or zlib.crc32(raw))
    known = counting.Numbered(words, 3)
    for remember, blocks in ((100, 3), (0, 2)):
        monkeypatch.setattr(counting, "REMEMBER", remember)
        for number in range(blocks):
            chunks = [np.array([known[c] for c in words.chunks(t)], np.int64) for t in texts]
            row = counting.block(known, number, list(range(5)), [0] * 5, chunks).iloc[0]
            names = [(b["bucket"], p) for b in row.buckets for p in json.loads(zlib.decompress(b["pretokens"]))]
            assert len(set(names)) == len(names) and all(b == zlib.crc32(p.encode()) % 3 for b, p in names)
            of = np.repeat([words.pieces[p] for _, p in names], counting.inflate(row.uses, "<u2"))
            assert np.bincount(counting.inflate(row.doc, "<u2"), of * counting.inflate(row.n, "<u4"), 5).tolist() == want
        if remember:
            assert cut and hashed and {*cut.values(), *hashed.values()} == {1} and len(known)
    assert not known and not known.names and not known.each


def test_plan_is_gapless_and_tight():
    rng = np.random.default_rng(3)
    for counts in ({1024: 3, 1: 5}, {600: 4, 400: 3, 24: 9}, {int(k): int(rng.integers(1, 60)) for k in rng.integers(1, 1025, 300)}, {}):
        space = Counter()
        for length, first, last, each, seq, offset in packing.plan(counts, 1024):
            for k in range(last - first + 1):
                space[seq + k // each, offset + k % each * length, length] += 1
        ends = Counter()
        for seq, offset, length in sorted(space):
            assert space[seq, offset, length] == 1 and ends[seq] == offset
            ends[seq] += length
        assert Counter({k: v for k, v in counts.items()}) == Counter(length for _, _, length in space) and max(ends.values(), default=0) <= 1024
        total = sum(k * v for k, v in counts.items())
        assert len(ends) <= 1.25 * -(-total // 1024) + 1


def test_packing_round_trip(docs, none):
    lib = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    got = packing.pack(docs, with_ids=True, n_buckets=3).toPandas()
    per_doc = Counter()
    for row in got.itertuples():
        ids = np.asarray(row.ids, "<u4")
        assert len(ids) == row.length <= 1024 and zlib.crc32(ids.tobytes()) == row.ids_crc32
        assert row.length == 1024 or row.piece == 0
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= 1024
    for r in ROWS:
        per_doc[r[0]] += len(lib.encode(r[1] or "", add_special_tokens=False).ids) + 1
    assert {k: v for k, v in per_doc.items() if k} == got.groupby("doc_id").length.sum().to_dict()
    assert packing.pack(none).count() == 0


def brute_links(texts):
    sets = [set(shingle_hashes(words(t)).tolist()) for t in texts]
    return {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j and a and 5 * len(a & b) >= 4 * len(a | b)}


def test_shingle_hashes_are_sets_of_grams():
    a = words("a b c d e f a b c d e")
    assert len(shingle_hashes(a)) == len({tuple(a[i : i + 5]) for i in range(len(a) - 4)})
    assert len(shingle_hashes(words("a b"))) == 1 and not len(shingle_hashes([]))
    assert set(shingle_hashes(words("x a b c d e y"))) >= set(shingle_hashes(words("a b c d e")))


def test_jaccard_join_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr("skygauge.llm.blocks.BLOCK", 16)
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(80)]
    texts = [" ".join(w if rng.random() > 0.01 else f"n{rng.integers(1e6)}" for w in base) for _ in range(90)]
    texts += [texts[0]] * 5 + ["short one"] * 2 + ["short one two", "", None]
    texts += [" ".join(f"v{rng.integers(1e6)}" for _ in range(50)) for _ in range(20)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, node string")
    links = brute_links(texts)
    low = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, j in links:
            if low[j] < low[i]:
                low[i], changed = low[j], True
    got = {r.doc_id: r for r in jaccard.jaccard_join(df).collect()}
    assert len(got) == len(texts)
    n = Counter(i for i, _ in links)
    for i in range(len(texts)):
        assert (got[i].component_id, got[i].n_links, got[i].kept) == (low[i], n[i], low[i] == i)
    assert sorted(r.doc_id for r in jaccard.one_of_each(df).collect()) == sorted(set(low))


def test_jaccard_edges(docs, none):
    got = jaccard.jaccard_join(docs).collect()
    assert len(got) == len(ROWS) and sorted(r.n_links for r in got)[-2:] == [1, 1]
    assert len(jaccard.one_of_each(docs).collect()) == len(ROWS) - 1
    assert jaccard.jaccard_join(none).count() == 0


def test_alike_sparse_and_dense():
    import pandas as pd

    rng = np.random.default_rng(2)
    texts = pd.Series([" ".join(f"w{x}" for x in rng.integers(0, 4, 12)) for _ in range(40)] + ["a b c d e f"] * 3 + [""])
    want = brute_links(list(texts))
    full = jaccard.alike(texts, None, 5, 0.8)
    np.fill_diagonal(full, False)
    assert {(int(i), int(j)) for i, j in zip(*np.nonzero(full))} == want
    split = jaccard.alike(texts[:20], texts[20:], 5, 0.8)
    assert {(int(i), int(j) + 20) for i, j in zip(*np.nonzero(split))} == {(i, j) for i, j in want if i < 20 <= j}


def test_mixing(docs, none):
    got = mixing.mix(mixing.sized(docs)).collect()
    assert len(got) == len(ROWS)
    sources = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and r.taken == sum(p.words for p in r.passes) and all(0 <= p.position <= 1 for p in r.passes)
        sources.setdefault(r.source, []).append(r)
    assert None in sources
    for rows in sources.values():
        assert sum(r.size for r in rows) == rows[0].source_size and abs(sum(r.taken for r in rows) - rows[0].target) <= 0.5
        assert rows[0].target <= 3 * rows[0].source_size
    assert abs(sum(rows[0].target for rows in sources.values()) - sum(r.size for r in got)) < 1e-6
    assert mixing.mix(mixing.sized(none)).count() == 0
    order = [r.position for r in mixing.training_order(mixing.mix(mixing.sized(docs))).collect()]
    assert order == sorted(order)


def test_clashing_names_of_mixing_and_near_copies(spark):
    names = ["target", "source_size", "taken", "passes", "cls", "_src", "_bucket", "_extra", "pass", "words", "row", "_id", "_own", "hash", "id"]
    rows = [(k, LONG[:200] + f" end{k // 2}", "ab"[k % 2], *[float("nan")] * len(names)) for k in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` double" for n in names))
    one = jaccard.one_of_each(df).collect()
    assert len(one) == 1 and one[0].doc_id == 0 and all(np.isnan(one[0][n]) for n in names)
    got = mixing.mix(mixing.sized(df))
    assert sorted(got.columns) == sorted([*df.columns, "size"])
    plain = {r.doc_id: (r.target, r.taken, r.source_size) for r in mixing.mix(mixing.sized(df.select("doc_id", "text", "source"))).collect()}
    for r in got.collect():
        assert plain[r.doc_id] == (r.target, r.taken, r.source_size) and all(np.isnan(r[n]) for n in names if n not in ("target", "source_size", "taken", "passes"))
    read = mixing.training_order(got)
    assert read.count() == sum(len(r.passes) for r in got.collect()) and read.columns.count("words") == 1


def test_training_time_inverts_the_integral(spark):
    from pyspark.sql import functions as F

    schedules = (((0.0, 2.0), (0.5, 0.5), (1.0, 1.0)), ((0.0, 1.0), (1.0, 1.0)))
    shares = np.linspace(0.01, 0.99, 23)
    df = spark.createDataFrame([(float(s), c) for s in shares for c in (0, 1)], "s double, c int")
    grid = np.linspace(0, 1, 200_001)
    for c, knots in enumerate(schedules):
        cumulative = np.cumsum(np.interp(grid, *zip(*knots)))
        for r in df.where(F.col("c") == c).select("s", mixing.training_time(F.col("s"), F.col("c"), schedules).alias("t")).collect():
            assert abs(np.interp(r.s, cumulative / cumulative[-1], grid) - r.t) < 1e-4


def brute_spans(text):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for k, (name, pattern) in enumerate(kinds.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda: 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[name]()
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_patterns(spark):
    rng = np.random.default_rng(8)
    texts = ["".join(rng.choice(list("1234@@..a-+ (x)"), rng.integers(1, 30))) for _ in range(8000)]
    texts += [r[0] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()] + [r[1] for r in ROWS]
    for t in texts:
        assert pii.base_spans(t) == brute_spans(t), t


def test_field_on_held_out_lines():
    field, rng = pii.trained(), np.random.default_rng(99)
    hit = wrong = missed = 0
    for _ in range(300):
        text, gold = pii._example(rng)
        found = set(field.decode(text, [(m[0], m.start(), m.end()) for m in pii._TOKEN.finditer(text)]))
        hit, wrong, missed = hit + len(found & set(gold)), wrong + len(found - set(gold)), missed + len(set(gold) - found)
    assert hit / (hit + wrong) > 0.95 and hit / (hit + missed) > 0.95


def test_find_and_mask(docs, none):
    got = {(r.doc_id, r.text): r for r in pii.find(docs).collect()}
    assert len(got) == len(ROWS) - 1
    for (_, text), r in got.items():
        base = brute_spans(text)
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and set(filter(None, joined.split(","))) <= set(r.spans.split(","))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for _, x, _ in base) for k in range(4))
    assert "phone:5:22" in got[8, ROWS[-1][1]].spans and "card:23:39" in got[8, ROWS[-1][1]].spans
    masked = {r.doc_id: r.text for r in pii.mask(docs).collect()}
    assert masked[8] == "call [PHONE] [CARD] or [IP]" and masked[None] == "null id with mail [EMAIL] in it" and masked[2] is None and masked[5] == LONG
    assert pii.find(none).count() == 0 and pii.mask(none).count() == 0


def test_quality_held_out(spark, docs, none):
    sf = "/root/testdata/sf0.1"
    full, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(full, labels)
    rows = quality.score(full, model).join(labels, "doc_id").collect()
    for r in rows[:200]:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.97
    got = quality.score(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert quality.score(none, quality.train(none, labels)).count() == 0


def test_boosting_learns_and_traverses():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < 0)).astype(float)
    model = boosting.fit(x[:2000], y[:2000], trees=40)
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    for row in x[2000:2010]:  # one tree after the other, node by node
        total = model.start
        for k in model.roots:
            while model.left[k] != k:
                k = model.left[k] + int(row[model.feature[k]] > model.cut[k])
            total += model.value[k]
        assert np.isclose(model.score(row[None])[0], 1 / (1 + np.exp(-total)))
    assert np.isclose(boosting.fit(np.zeros((0, 2)), np.zeros(0)).score(np.zeros((1, 2)))[0], 0.5)


def test_text_type_of_ids_survives(docs):
    assert dict(rules.judge(docs).dtypes)["doc_id"] == "bigint" and isinstance(pii.find(docs).schema["size"].dataType, T.LongType)


# Written for the test: none of these names, hosts or sentences are in the lines that the field is trained on.
USERS = ("john", "mary", "peter.smith", "Susan", "t.miller", "robert22", "olivia_brown", "james", "emily.clark", "Thomas", "k.jones", "linda")
PLACES = ("example", "northwind", "contoso", "uni-koeln", "library", "bakery", "sunrise", "mountain")
BEFORE = ("", "Contact: ", "please write to ", "You can reach me under ", "Questions go to ", "our editor is ")
AFTER = ("", " for more.", " or come by.", " today", ".", ", thanks")


@pytest.mark.parametrize("form", ["{u} (at) {h} (dot) {t}", "{u} (AT) {h} (DOT) {t}", "{u} [at] {h}.{t}", "{u} @ {h}.{t}", "{u} at {h} dot {t}", "{u} AT {h} DOT {t}", "{u}[at]{h}[dot]{t}"])
def test_spelt_out_addresses(form):
    model, rng = pii.trained(), np.random.default_rng(77)
    pick = lambda x: x[rng.integers(len(x))]
    right = 0
    for _ in range(200):
        address, lead = form.format(u=pick(USERS), h=pick(PLACES), t=pick(("com", "org", "net", "de", "fr"))), pick(BEFORE)
        right += pii.all_spans(lead + address + pick(AFTER), model)[1] == [(len(lead), 0, len(lead) + len(address))]
    assert right >= 190


@pytest.mark.parametrize("number", ["030 1234567", "0171/2345678", "06 12 34 56 78", "(030) 123 45 67", "212 555 0199", "0221 987654", "415-555-0133"])
def test_national_phones(number):
    for lead in ("", "Tel. ", "call ", "Phone: ", "ring us on "):
        for tail in AFTER:
            assert pii.all_spans(lead + number + tail, pii.trained())[1] == [(len(lead), 3, len(lead) + len(number))]


@pytest.mark.parametrize("text", [
    "The year 1999 was good, and 2004 too.", "On 12 May 2004 we met at the dot of noon.", "It cost 1 234 567 euro in 2001.", "Section 3.2.1 of version 4.5.6", "between 10:30 and 11:45, room 204",
    "He scored 12 23 31 points", "see pages 120 130 140", "a total of 4567 8910 units", "look at 20 people at the shop", "0.1234567 percent", "population 82 345 678", "It ended in 1988. At noon we left."])
def test_clean_lines_have_no_spans(text):
    assert pii.all_spans(text, pii.trained())[1] == []


def test_segments_are_the_best_of_all(monkeypatch):
    """Every cut of short lines into outside tokens and typed segments, scored one by one."""
    model, rng = pii.trained(), np.random.default_rng(31)
    for _ in range(25):
        text = pii._example(rng)[0][:40]
        tokens = [(m[0], m.start(), m.end()) for m in pii._TOKEN.finditer(text)][:9]
        segments = {}
        for i, j in pii.candidates(tokens):
            segments.setdefault(i, []).append((j, model.scores(pii.features(text, tokens, i, j)) - 1.0))

        def best(i):
            if i == len(tokens):
                return 0.0, []
            score, rest = best(i + 1)
            top = (score + model.outside.get(pii._shape(tokens[i][0]), 0.0), rest)  # noqa: B023
            for j, scores in segments.get(i, ()):  # noqa: B023
                score, rest = best(j)
                for k, s in enumerate(scores):
                    top = max(top, (score + s, [(tokens[i][1], k, tokens[j - 1][2]), *rest]), key=lambda x: x[0])  # noqa: B023
            return top

        assert model.decode(text, tokens) == best(0)[1]
