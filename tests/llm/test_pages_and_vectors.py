"""Page and vector operators against brute force, and their edge cases."""

import html
import itertools
import re

import numpy as np
import pandas as pd
import pytest

from skygauge.llm import blocks, components, extract, forest, labelled_pages, warc
from skygauge.llm.dom import leaf_blocks


def test_leaf_blocks_of_broken_markup():
    page = "<!-- a > b --><body><P CLASS=x>one &amp; <b>two<br>three<p>four</b><script>var t='</p>';</script><ul><li>five<li>six</ul><div style='display: none'>seven</div><table><tr><td>eight<td>nine</table> ten < eleven &#x41;&nbsp; end"
    assert [b.text for b in leaf_blocks(page)] == ["one & two three", "four", "five", "six", "seven", "eight", "nine", "ten < eleven A end"]
    assert leaf_blocks(None) == leaf_blocks("") == leaf_blocks("<script>x") == leaf_blocks("<!-- open") == []
    assert [b.text for b in leaf_blocks('<p title="a > b">x</p>\n\t<p>  </p>y')] == ["x", "y"]
    assert len(leaf_blocks("<p>word" * 20_000)) == 20_000


def test_field_on_held_out_pages():
    model, rng = extract.trained(), np.random.default_rng(4321)
    right = total = 0
    for _ in range(200):
        text, gold = labelled_pages.page(rng)
        label = {}
        for t, y in gold:
            label.setdefault(" ".join(t.split()), y)
        blocks = leaf_blocks(text)
        assert [b.text for b in blocks] and all(b.text in label for b in blocks)
        found = model.decode(extract.block_features(blocks))
        right, total = right + sum(label[b.text] == y for b, y in zip(blocks, found)), total + len(blocks)
    assert right / total > 0.98


def test_extraction_of_the_table(spark):
    rows = extract.extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()
    assert len(rows) == 250
    for r in rows:  # every page of the table has one article element
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1].replace("<br>", " ")
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", article))
        assert r.text == "\n\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_extraction_edges(spark):
    page = (
        "<div class='cookie-notice'><p>We use cookies.</p></div><header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></ul></nav><div id=main><h1>Title of it</h1><p>Para one is here. It is long enough."
        "<div class='share'>Share this</div><p>Para two.</p><aside><p>Read also this one here. Yes.</p></aside><form><p>Subscribe now.</p><button>Go</button></form></div>"
        "<div id='comments'><h3>2 comments</h3><div class='comment'><p>I think this is good. Really so.</p></div></div><footer>(c) 2020</footer>"
    )
    rows = [(1, page, "x"), (1, page, "x"), (2, None, "x"), (None, "", None), (3, "<br><hr>", "x")]
    df = spark.createDataFrame(rows, "page_id long, html string, n_chars string")
    got = sorted(((r.page_id or 0), r.text, r.n_chars) for r in extract.extract(df).collect())
    want = "Title of it\n\nPara one is here. It is long enough.\n\nPara two."
    assert got == [(0, "", 0), (1, want, len(want)), (1, want, len(want)), (2, "", 0), (3, "", 0)]
    assert extract.extract(spark.createDataFrame([], df.schema)).count() == 0


def test_warc_links_and_round_trip(spark, tmp_path):
    rows = [(1, "http://a.example/", "<html lang=en><title> T &amp; U </title><body><p>one<p>two <a href='/l?a=1&amp;b=2'>x</a></html>"), (2, None, None), (2, None, None), (None, "http://b.example/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    source = warc.responses(pages).collect()
    made = warc.derive(warc.responses(pages)).collect()
    assert len(made) == 2 * len(rows)
    ids = {r.record_id for r in source}
    for r in made:
        assert r.refers_to in ids and r.block_digest == warc.digest(bytes(r.block))
        assert r.payload_digest == next(s.payload_digest for s in source if s.record_id == r.refers_to)
    first = {r.type: r for r in made if r.target_uri == "http://a.example/"}
    assert bytes(first["conversion"].block).decode() == "one\ntwo x"
    facts = warc.json.loads(bytes(first["metadata"].block))
    assert facts["html"] == {"title": "T & U", "lang": "en", "links": ["/l?a=1&b=2"]} and facts["http"]["status"] == 200
    assert facts["source"]["WARC-Record-ID"] == first["metadata"].refers_to and facts["http"]["headers"]["content-type"] == "text/html; charset=utf-8"
    warc.write_warc(warc.derive(warc.responses(pages)), str(tmp_path / "w"))
    key = lambda r: (r.record_id, r.type, r.target_uri, r.date, r.refers_to, r.content_type, r.block_digest, r.payload_digest, bytes(r.block))
    assert sorted(map(str, map(key, warc.read_warc(spark, str(tmp_path / "w")).collect()))) == sorted(map(str, map(key, made)))


def test_warc_other_media_and_headers():
    block = b"HTTP/1.1 301 Moved\r\nX-A: 1\r\nX-a: 2\r\nContent-Type: text/plain; charset=latin-1\r\n\r\ncaf\xe9"
    base = {"record_id": "<urn:x>", "target_uri": "u", "date": "d", "block": block, "block_digest": None, "payload_digest": "p", "headers": {"WARC-IP-Address": "1.2.3.4"}}
    meta, text = warc.derived(base)
    facts = warc.json.loads(meta["block"])
    assert text["block"].decode() == "café" and facts["http"]["headers"]["x-a"] == "1, 2" and facts["source"]["WARC-IP-Address"] == "1.2.3.4" and facts["http"]["status"] == 301
    assert [r["type"] for r in warc.derived(base | {"block": block.replace(b"text/plain", b"image/png ")})] == ["metadata"]
    assert warc.derived(base | {"block": None})[1]["block"] == b""


def test_warc_coded_bodies():
    import gzip
    import zlib

    page = "<html><title>T</title><body><p>caf\u00e9 au lait</p></html>".encode()
    zipped = gzip.compress(page)
    chunked = lambda b: b"".join(b"%x;x=1\r\n%s\r\n" % (len(b[i : i + 7]), b[i : i + 7]) for i in range(0, len(b), 7)) + b"0\r\n\r\n"
    raw = zlib.compressobj(9, zlib.DEFLATED, -15)
    cases = [
        ("Content-Encoding: gzip", zipped, ["gzip"]), ("Content-Encoding: gzip", page, None), ("Transfer-Encoding: chunked", chunked(page), ["chunked"]),
        ("Transfer-Encoding: chunked", page, None), ("Transfer-Encoding: chunked\r\nContent-Encoding: gzip", chunked(zipped), ["chunked", "gzip"]),
        ("Content-Encoding: deflate", zlib.compress(page), ["deflate"]), ("Content-Encoding: deflate", raw.compress(page) + raw.flush(), ["deflate"]), ("Content-Encoding: deflate", page, None),
        ("Content-Encoding: gzip, gzip", gzip.compress(zipped), ["gzip", "gzip"]),
    ]
    base = {"record_id": "<urn:x>", "target_uri": "u", "date": "d", "block_digest": "b", "payload_digest": "p", "headers": {}}
    for head, body, codings in cases:
        meta, text = warc.derived(base | {"block": f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n{head}\r\n\r\n".encode() + body})
        facts = warc.json.loads(meta["block"])
        assert text["block"].decode() == "caf\u00e9 au lait" and facts["http"].get("decoded") == codings and facts["html"]["title"] == "T", head
        assert facts["http"]["length"] == len(body) and meta["payload_digest"] == "p"
    only = warc.derived(base | {"block": b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Encoding: br\r\n\r\n\x8b\x00\x01"})
    assert [r["type"] for r in only] == ["metadata"] and warc.json.loads(only[0]["block"])["http"]["not_decoded"] == ["br"]


def test_warc_malformed_records_are_told():
    good = warc.to_bytes({"type": "response", "record_id": "<urn:1>", "block": b"WARC/ inside"}) + warc.END
    data = good + b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: x\r\n\r\nlost" + warc.END + good + b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 99\r\n\r\ncut"
    got = [(r["type"], r["block"], r["headers"].get("WARC-Type")) for r in warc.from_bytes(data)]
    assert got == [("response", b"WARC/ inside", None), ("malformed", b"lost", "response"), ("response", b"WARC/ inside", None), ("malformed", b"cut", "warcinfo")]
    assert list(warc.from_bytes(b"")) == []


def test_pairs_that_met_before():
    rng = np.random.default_rng(3)
    sides = [pd.Series([np.unique(rng.integers(0, 60, rng.integers(0, 9))) for _ in range(n)]) for n in (30, 20)]
    for share in (0.0, 0.1, 1.0):
        hit = rng.random((30, 20)) < share
        hit[0, 0] = True
        met = blocks._met_before(*sides, 30, hit)
        want = np.array([[any(g < 30 for g in np.intersect1d(a, b)) for b in sides[1]] for a in sides[0]])
        assert ((hit & ~met) == (hit & ~want)).all()


def test_components(spark):
    rng = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(k, k + 1) for k in range(1000, 1200)] + [(5000, x) for x in range(5001, 5100)] + [(1, None), (7, 7)]
    low = {n: n for e in edges if None not in e and e[0] != e[1] for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a in low and b in low and low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                changed = True
    got = components.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.component for r in got} == low and len(got) == len(low)
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("block", [1024, 24])
def test_near_vectors_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr("skygauge.llm.blocks.BLOCK", block)
    rng = np.random.default_rng(9)
    hot = rng.normal(size=16)
    x = [*rng.normal(size=(300, 16)), *(hot + 0.15 * rng.normal(size=(120, 16))), *([hot] * 3)]
    x = [v.tolist() for v in x] + [None, [0.0] * 16, [float("nan")] * 16, [None, *[1.0] * 15], [], [1.0, 2.0], [2.0, 4.0]]
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(x)], "vec_id long, embedding array<double>, node string")
    got = {r.vec_id: r for r in forest.near_vectors(df, leaf=64).collect()}
    assert len(got) == len(x)
    usable = [i for i, v in enumerate(x) if v and None not in v and np.isfinite(v).all() and np.any(v)]
    unit = {i: np.array(x[i]) / np.linalg.norm(x[i]) for i in usable}
    links = {(i, j) for i in usable for j in usable if i != j and len(x[i]) == len(x[j]) and unit[i] @ unit[j] >= 0.9}
    found = sum(r.n_links for r in got.values())
    assert 0.98 * len(links) <= found <= len(links)
    for i, r in got.items():
        assert r.n_links <= sum(a == i for a, _ in links) and r.kept == (r.component_id == i)
        if i not in usable:
            assert (r.n_links, r.component_id) == (0, i)
    assert forest.near_vectors(spark.createDataFrame([], df.schema)).count() == 0


def test_vectors_travel_to_cells_not_to_leaves(spark, monkeypatch):
    """Deep trees in small cells, a tree a round: a vector is dealt a few times at once, not to every leaf of every tree. Vectors
    that differ by a factor fall together in all trees, so that their cells are dealt into blocks; each pair counts once."""
    dealt, deal = [], forest.deal

    def counted(members, *sizes):
        dealt.append(members.count())
        return deal(members, *sizes)

    monkeypatch.setattr(forest, "deal", counted)
    monkeypatch.setattr(forest, "CELL", 100 * 64, raising=False)
    monkeypatch.setattr(forest, "ROUND", 1, raising=False)
    monkeypatch.setattr("skygauge.llm.blocks.BLOCK", 64)
    rng = np.random.default_rng(10)
    x = rng.normal(size=(600, 16))
    x = np.concatenate([x, x[:100] + 0.1 * rng.normal(size=(100, 16)), rng.normal(size=16) * rng.uniform(1, 9, (300, 1))]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in forest.near_vectors(df, leaf=16).collect()}
    assert max(dealt) <= 2.5 * len(x)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = (u @ u.T >= 0.9).sum(axis=1) - 1
    assert all(got[i].n_links == links[i] == 299 and got[i].component_id == 700 for i in range(700, 1000))
    assert all(got[i].n_links <= links[i] for i in got) and sum(got[i].n_links for i in got) >= 0.99 * links.sum()


def test_projections_are_exact_in_any_batch():
    rng = np.random.default_rng(12)
    x = rng.normal(size=(500, 61))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree, grid = forest.fit_tree(x.astype(np.float32), 9, 0.12, 3), forest.on_grid(x, 13)
    assert (grid @ tree.directions.T == grid.astype(float) @ tree.directions.T.astype(float)).all()
    whole = set(zip(*(a.tolist() for a in forest.leaves(tree, grid))))
    rows, cell = forest.leaves(tree, grid, last=4)
    at, leaf = forest.leaves(tree, grid[rows], cell, 4)
    assert set(zip(rows[at].tolist(), leaf.tolist())) == whole
    assert {(i, g) for i in range(500) for g in forest.leaves(tree, grid[i : i + 1])[1].tolist()} == whole


def test_recall_on_the_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    u = np.array([r.embedding for r in rows], float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    true = (u @ u.T >= 0.9).sum() - len(u)
    got = forest.near_vectors(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"))
    assert sum(r.n_links for r in got.collect()) >= 0.9 * true


PARAGRAPHS = ["The committee met on Tuesday to discuss the new bridge. It will cost more than planned.",
              "Residents said that they had waited for years, and that the old one was no longer safe.",
              "Work begins in spring. The mayor hopes that it will be done within two years."]
PS, NAV, FOOT = "".join(f"<p>{p}</p>" for p in PARAGRAPHS), "<nav><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></nav>", "<footer><p>© 2020 The Paper. All rights reserved.</p></footer>"


@pytest.mark.parametrize("layout", [
    f"<body>{PS}</body>", f"<div>{PS}</div>", f"<body><form action=x>{NAV}<div>{PS}</div>{FOOT}</form></body>", f"<body class='has-sidebar single-post'>{NAV}{PS}{FOOT}</body>",
    f"<body class='has-sidebar single-post'><article>{PS}</article></body>", f"<body>{NAV}<article><div class='read-more-content'>{PS}</div></article>{FOOT}",
    f"<body>{NAV}<article>{PS.replace('<p>', '<p class=header-image-caption>', 1)}</article>{FOOT}", f"<article><div class='post-comment-text'>{PS}</div></article>",
    f"<body>{NAV}<div class=content>{PS}</div>{FOOT}", f"<article><div class=more-content>{PS}</div></article>",
    f"<body>{NAV}<table><tr><td>{PS}</td><td><ul><li><a href=1>Ten best bridges</a><li><a href=2>Why rivers flood</a><li><a href=3>Town news</a></ul></td></tr></table><div>Sponsored</div>{FOOT}</body>",
])
def test_layouts_that_no_rule_draws(layout):
    assert extract.main_text(layout, extract.trained()) == "\n\n".join(PARAGRAPHS)


def test_viterbi_is_the_best_of_all_labellings():
    model, rng = extract.trained(), np.random.default_rng(8)
    for _ in range(30):
        rows = extract.block_features(leaf_blocks(labelled_pages.page(rng)[0]))[:8]

        def score(labels):
            own = sum(model.weights.get(f, 0.0) for feats, y in zip(rows, labels) if y for f in feats) + model.first * labels[0]  # noqa: B023
            return own + sum(model.steps[a, b] for a, b in zip(labels, labels[1:]))

        best = max(itertools.product((0, 1), repeat=len(rows)), key=score)
        assert score(model.decode(rows)) == pytest.approx(score(best))
