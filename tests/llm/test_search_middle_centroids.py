"""Nearest neighbours, fill-in-middle documents and centroid clustering against brute force, and their edge cases."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from skygauge.llm import centroids, middle, nearest

ODD = [None, [], [0.0] * 8, [float("nan")] * 8, [None, *[1.0] * 7], [float("inf"), *[1.0] * 7]]


def brute_nearest(rows, k, ask):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = []
    for place, (i, v) in enumerate(ok):
        if not ask(i):
            continue
        found = sorted((-nearest.products(v[None], w[None])[0], j) for other, (j, w) in enumerate(ok) if other != place and len(w) == len(v))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize("part", [(512, 4096), (3, 16)])
def test_nearest_equals_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(nearest, "PART", part)
    monkeypatch.setattr(nearest, "LEAST_BLOCK", 50)
    rng = np.random.default_rng(3)
    hot = rng.normal(size=8)
    x = [*rng.normal(size=(200, 8)), *(hot + 1e-4 * rng.normal(size=(150, 8))), *([hot] * 60)]  # near copies closer than the codes tell apart
    x = [v.tolist() for v in x] + ODD + [[1.0, 2.0], [2.0, 4.0], [1e200] * 3, [-1e200, 1e200, 1e200]]
    rows = list(enumerate(x)) + [(20, x[20]), (40, x[41]), (None, x[0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, node string, width int")
    got = sorted(tuple(r) for r in nearest.nearest(df, k=7, every=10).collect())
    assert got == brute_nearest(rows, 7, lambda i: i % 10 == 0)


def test_nearest_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert nearest.nearest(spark.createDataFrame([], schema)).count() == 0
    assert nearest.nearest(spark.createDataFrame([(20, [1.0]), (3, None)], schema)).count() == 0  # no candidate but itself
    few = spark.createDataFrame([(20, [1.0]), (3, [2.0]), (4, [-1.0])], schema)
    assert [tuple(r) for r in nearest.nearest(few).orderBy("rank").collect()] == [(20, 1, 3, 2.0), (20, 2, 4, -1.0)]
    asked = spark.createDataFrame([(7, [3.0])], schema)  # queries of their own: no row of the table is left out
    assert sorted(r.vec_id for r in nearest.nearest(few, asked).collect()) == [3, 4, 20]


def test_code_bounds_hold():
    rng = np.random.default_rng(5)
    for x in (rng.normal(size=(60, 64)), rng.standard_cauchy(size=(60, 64)), rng.normal(size=(60, 64)) * 1e-30):
        step = np.abs(x).max(axis=1) / 127
        q = np.rint(x / step[:, None])
        error, norm = np.linalg.norm(x - q * step[:, None], axis=1), np.linalg.norm(x, axis=1)
        about = (q @ q.T) * np.multiply.outer(step, step)
        slack = np.multiply.outer(norm + error, error) + np.multiply.outer(error, norm)
        assert (np.abs(about - x @ x.T) <= slack * (1 + 1e-9)).all()


def brute_middle(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    code = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(code[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, text, sha(text), sha(text))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return (doc_id, n, form, len(p), len(m), out, sha(out), sha(text))


def odd_texts():
    rng = np.random.default_rng(8)
    alphabet = list("ab Z.<PSM>/\n\té漢\U0001f600\x00")
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 60))) for _ in range(300)]
    return texts + ["", None, "x" * 50_000, "ab " * 30_000, "<P>", "<P", "a<S>b", "<" * 40 + "P" * 30, "é" * 40_000, " "]


@pytest.mark.parametrize("chunk", [1024, 4])
def test_middle_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(middle, "SLICE", 7000)
    rows = [(i, t) for i, t in enumerate(odd_texts())] + [(5, odd_texts()[5])] * 30 + [(5, "other"), (None, "no id, some text"), (None, None)]
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, form string, n int").repartition(3)
    want = sorted((brute_middle(*r) for r in rows), key=str)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    got = sorted((tuple(r) for r in middle.digests(df, chunk).collect()), key=str)
    assert got == sorted(((*w[:5], *w[6:]) for w in want), key=str)
    texts = middle.fill_in_middle(df, chunk).collect()
    assert sorted((tuple(r) for r in texts), key=str) == sorted((w[:1] + w[1:6] for w in want), key=str)
    assert sorted(middle.restore(r.output, r.form) for r in texts) == sorted(t or "" for _, t in rows)


def test_middle_pieces_are_bounded_and_in_order(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd_texts())], "doc_id long, text string")
    made = middle.assembled(df, 512)
    assert made.agg(F.max(F.length("piece"))).first()[0] <= middle.MOST_CHARS + 3
    whole = {}
    for r in made.collect():  # partition after partition, in their order
        whole[r.doc_id] = whole.get(r.doc_id, "") + r.piece
    assert whole == {str(i): brute_middle(i, t)[5] for i, t in enumerate(odd_texts())}
    assert middle.digests(spark.createDataFrame([], df.schema)).count() == middle.fill_in_middle(spark.createDataFrame([], df.schema)).count() == 0
    plan = middle.digests(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # restoring sorts within the partitions of the assembly


def brute_clusters(rows, width, clusters, rounds):
    kept = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if v is not None and len(v) == width and None not in v and np.isfinite(v).all()]
    kept = [(i, [max(-(1 << 27), min(1 << 27, x)) for x in v]) for i, v in kept]
    code = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    c = [v for _, v in sorted(kept, key=lambda r: (code(r[0]), r[1]))[:clusters]]
    far = lambda v, w: sum((a - b) ** 2 for a, b in zip(v, w))
    for step in range(rounds + 1):
        to = [min(range(len(c)), key=lambda k: (far(v, c[k]), k)) for _, v in kept]
        if step < rounds:
            for k in range(len(c)):
                own = [v for (_, v), t in zip(kept, to) if t == k]
                if own:
                    c[k] = [sum(col) // len(own) for col in zip(*own)]
    far_out = [far(v, c[t]) for (_, v), t in zip(kept, to)]
    each = [sum(d for d, t in zip(far_out, to) if t == k) for k in range(len(c))]
    sha = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in c]
    return sorted(((i, t, d, each[t], sum(far_out), sha[t]) for (i, _), t, d in zip(kept, to, far_out)), key=str)


@pytest.mark.parametrize("block", [4096, 7])
def test_clusters_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(centroids, "BLOCK", block)
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(120, 8)) * 0.3)]
    rows += [(i, v) for i, v in enumerate(ODD)] + [(7, [0.25] * 8)] * 40 + [(None, [1.0] * 8), (500, [-1.0] * 7), (501, [1.0] * 9), (502, [-0.001] * 8)]
    df = spark.createDataFrame([(i, v, 9) for i, v in rows], "vec_id long, embedding array<double>, cluster int")
    got = sorted((tuple(r) for r in centroids.centroid_clusters(df, width=8, clusters=10).collect()), key=str)
    assert got == brute_clusters(rows, 8, 10, 5)


def test_cluster_edges(spark):
    schema = "vec_id long, embedding array<double>"
    assert centroids.centroid_clusters(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, [0.5] * 64), (2, [1e300] * 64), (3, [-1e6] * 64)]  # fewer than 40; values held at the bound
    got = sorted((tuple(r) for r in centroids.centroid_clusters(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == brute_clusters(rows, 64, 40, 5)
