"""Hard negatives, quality and whitening against brute force, known answers and odd rows."""

import math
import random
import zlib

import numpy as np
import pytest

from sessionloom.llm import hard_negatives, quality, whitening
from sessionloom.llm.common import crc_of

VECTORS = "vec_id long, embedding array<float>, label int, x string, rank int, block int, n int"
NAN, INF = float("nan"), float("inf")


def vector_rows(rng, n=130, dims=6):
    """Clustered and tied vectors, repeats, and rows that take no part."""
    centres = rng.standard_normal((5, dims))
    rows = []
    for i in range(n):
        v = np.round(centres[i % 5] + 0.2 * rng.standard_normal(dims), 2 if i % 3 else 1)
        rows.append((i * 5, v.tolist(), int(rng.integers(0, 4)), "a", 1, 2, 3))
    rows += [(3, rows[4][1], 1, "a", 1, 2, 3), (4, rows[4][1], 2, "a", 1, 2, 3), (6, rows[4][1], None, "a", 1, 2, 3)]
    rows += [(8, None, 1, "a", 1, 2, 3), (9, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1, "a", 1, 2, 3), (11, [NAN] + [1.0] * 5, 1, "a", 1, 2, 3), (12, [INF] + [1.0] * 5, 0, "a", 1, 2, 3)]
    return rows + [(13, [0.0] * dims, 1, "a", 1, 2, 3), (16, [-0.0] * dims, 2, "a", 1, 2, 3), (17, [1.0, 2.0], 3, "a", 1, 2, 3), (18, [], 3, "a", 1, 2, 3)]


def whole(rows, dims=6):
    """(vec_id, label, integers) of the rows that take part, as Python numbers."""
    out = []
    for vec_id, v, label, *_ in rows:
        if vec_id is not None and v is not None and all(c is not None and math.isfinite(c) for c in v):
            x = [math.floor(256 * float(np.float32(c))) for c in v] + [0] * (dims - len(v))
            out.append((vec_id, label, x))
    return out


def brute_negatives(rows, every):
    taking = [(i, (lb + 1) % 10 if i % 7 == 0 else lb, x) for i, lb, x in whole(rows) if lb is not None]
    out = set()
    for a, label, ax in taking:
        if a % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(ax, x, strict=True)), i, lb) for i, lb, x in taking if i != a)
        for p, pos, _ in [s for s in scored if s[2] == label][:5]:
            fit = [(s, i) for s, i, lb in scored if lb != label and 80 * -p <= 100 * -s <= 100 * -p][:5]
            out |= {(a, pos, r, i, -p, -s) for r, (s, i) in enumerate(fit, 1)}
    return out


# Hard negatives.


@pytest.mark.parametrize("seed", range(40))
def test_threshold_search_is_exact(seed, monkeypatch):
    """Any depth, ties, signs, zeros and numbers that a double can't hold."""
    monkeypatch.setattr(hard_negatives, "DEPTH", 1 + seed % 4)
    rng = np.random.default_rng(seed)
    n, dims, k = int(rng.integers(1, 60)), int(rng.integers(1, 8)), int(rng.integers(1, 6))
    scale = (3, 40, 1 << 40)[seed % 3]
    x, a = rng.integers(-scale, scale + 1, (n, dims)), rng.integers(-scale, scale + 1, dims)
    if seed % 5 == 0:
        a[:] = 0
    allowed = rng.random(n) < 0.7
    exact = [sum(int(p) * int(q) for p, q in zip(r, a, strict=True)) for r in x]
    tops = sorted({exact[i] for i in rng.integers(0, n, 3)})
    windows = [(-hard_negatives.NO_BOUND, hard_negatives.NO_BOUND), *((-(-4 * p // 5), p) for p in tops)]
    got = hard_negatives.Lists(x).search(a, allowed, windows, k)
    for (low, high), (rows, scores) in zip(windows, got, strict=True):
        want = sorted((-exact[i], i) for i in range(n) if allowed[i] and low <= exact[i] <= high)[:k]
        assert [(-int(s), int(i)) for i, s in zip(rows, scores, strict=True)] == want


def test_threshold_search_stops_early():
    """With one cluster near the anchor, most of the rows are never scored."""
    rng = np.random.default_rng(1)
    x = rng.integers(-20, 21, (20_000, 8))
    x[:50] += 300
    lists = hard_negatives.Lists(x)
    met = []
    scored = lists.wide

    class Counting(np.ndarray):
        def __getitem__(self, at):
            met.append(len(at) if isinstance(at, np.ndarray) else 0)
            return super().__getitem__(at)

    lists.wide = scored.view(Counting)
    [(rows, _)] = lists.search(x[0], np.arange(len(x)) != 0, [(-hard_negatives.NO_BOUND, hard_negatives.NO_BOUND)], 5)
    assert set(rows) < set(range(50)) and sum(met) < 2000


@pytest.mark.parametrize("cells", [24, 60, 1 << 21])
def test_negatives_brute_force(spark, monkeypatch, cells):
    """Groups and batches of any size give the rows of all pairs."""
    monkeypatch.setattr(hard_negatives, "CELLS", cells * 64)
    monkeypatch.setattr(hard_negatives, "LEAST_ROWS", 20)
    rows = vector_rows(np.random.default_rng(3))
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    from pyspark.sql import functions as F

    got = hard_negatives.hard_negatives(hard_negatives.labelled_vectors(df), F.col("vec_id") % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got)) and set(got) == brute_negatives(rows, 10) and len(got) > 100


def test_negatives_odd_rows(spark):
    from pyspark.sql import functions as F

    mine = lambda rows: hard_negatives.hard_negatives(hard_negatives.labelled_vectors(spark.createDataFrame(rows, VECTORS)), F.col("vec_id") % 10 == 0).collect()
    assert mine([]) == []
    rest = ("a", 1, 2, 3)
    assert mine([(100, [1.0], 1, *rest)]) == []
    assert mine([(None, [1.0], 1, *rest), (100, [], 1, *rest), (1, [], 1, *rest), (2, [], 2, *rest)])[0][:4] == (100, 1, 1, 2)
    # A repeated vec_id takes part once, by its smallest label.
    got = mine([(100, [1.0], 1, *rest), (1, [1.0], 1, *rest), (1, [1.0], 1, *rest), (2, [0.9], 3, *rest), (2, [0.9], 2, *rest)])
    assert [tuple(r) for r in got] == [(100, 1, 1, 2, 65536, 256 * math.floor(256 * float(np.float32(0.9))))]
    # Products beyond 64 bits don't fail.
    assert mine([(100, [3e16], 1, *rest), (1, [3e16], 1, *rest), (2, [3e16], 2, *rest)]) == []


# Whitening.


def test_exact_gram():
    rng = np.random.default_rng(2)
    for scale in (2, 1 << 18, 1 << 45):
        z = rng.integers(-scale, scale, (70, 5))
        assert (whitening.exact_gram(z) == z.astype(object).T @ z.astype(object)).all()


@pytest.mark.parametrize("values", [[1, 1 - 1e-9, 1 - 2e-9, 0.5, 0.5 - 1e-13, 0.1, 0.01, 0], [3, 2, 2, 2, 1, 1, 0, 0], [5, 4, 3, 2, 1, 0.5, 0.25, 1e-9], [1] * 8, [0] * 8])
def test_refined_eigenvectors(values):
    """Close and equal eigenvalues: orthonormal, residual at the last bit, known vectors where these are unique."""
    rng, eye = np.random.default_rng(5), np.eye(8, dtype=np.longdouble)
    q = np.linalg.qr(rng.standard_normal((8, 8)))[0].astype(np.longdouble)
    for _ in range(4):
        q = q + q @ (eye - q.T @ q) / 2
    want = np.array(values, np.longdouble)
    a = (q * want) @ q.T
    got, x = whitening.refined_eigenvectors(a)
    assert np.abs(got - want).max() < 1e-17 and np.abs(x.T @ x - eye).max() < 1e-17 and np.abs(a @ x - x * got).max() < 1e-17
    for i in range(8):
        gap = float(np.abs(np.delete(want, i) - want[i]).min())
        if gap:
            assert min(np.abs(x[:, i] - q[:, i]).max(), np.abs(x[:, i] + q[:, i]).max()) < 1e-17 / gap + 1e-17


def test_whitening_brute_force(spark):
    rows = vector_rows(np.random.default_rng(7))
    rows += [rows[3], rows[3], (None, *rows[5][1:])]
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(3)).toPandas()
    taking = [(r[0], np.array(v, object)) for r in rows for v in [w[2] for w in whole([(0, *r[1:])])]]
    assert len(got) == 4 * len(taking)
    fit = np.array(sorted({tuple(v) for _, v in taking}), float)
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:4], vectors[:, ::-1][:, :4]
    vectors = vectors * np.sign(np.take_along_axis(vectors, np.abs(vectors).argmax(0)[None], 0)[0])
    assert set(got["n"]) == {n} and got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-12
    shares = got.groupby("component")["explained"].first()
    assert np.abs(shares - values / np.trace(centred.T @ centred / n)).max() < 1e-12
    want = sorted((-1 if i is None else i, int(((n * v - sums.astype(int)) ** 2).sum()), c + 1, float((v.astype(float) - sums / n) @ vectors[:, c] / np.sqrt(values[c]))) for i, v in taking for c in range(4))
    have = sorted((-1 if r.vec_id != r.vec_id else int(r.vec_id), int(r.deviation), int(r.component), r.whitened) for r in got.itertuples())
    assert [h[:3] for h in have] == [w[:3] for w in want]
    assert max(abs(h[3] - w[3]) for h, w in zip(have, want, strict=True)) < 1e-10


def test_whitening_odd_tables(spark):
    rest = (1, "a", 1, 2, 3)
    white = lambda rows: whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    assert white([]) == [] and white([(1, None, *rest), (2, [NAN], *rest)]) == [] and white([(1, [], *rest)]) == []
    one = white([(1, [0.5, 0.5], *rest), (2, [0.5, 0.5], *rest)])
    assert [(r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["identity_error"]) for r in one] == [(i, c, 1, 0, None, None) for i in (1, 2) for c in (1, 2)]
    line = white([(i, [float(i), 2.0 * i, 0.0], *rest) for i in range(4)])
    assert len(line) == 12 and all((r["whitened"] is None) == (r["component"] > 1) for r in line)
    assert all(abs(r["explained"] - (r["component"] == 1)) < 1e-15 for r in line)
    huge = white([(1, [1e30], *rest), (2, [-1e30], *rest), (3, [2e9], *rest)])
    assert all(r["deviation"] is None for r in huge if r["vec_id"] < 3)


# Quality.


def test_measures_of_a_text_are_its_own():
    texts = [b"", b"  ", b"hello world hello hello", b"x" * 50, " é ñ ## $$$ a a a a".encode(), b" ".join(b"w%d" % i for i in range(300)), b"\n\n", b"A!! B!! C!!", b" lead", b"tail "]
    x, count = quality.measures(texts)
    assert count.tolist() == [1, 1, 1, 1, 1, 3, 1, 1, 1, 1] and x.shape == (12, quality.MEASURES)
    ends = np.cumsum(count)
    for i, t in enumerate(texts):
        assert np.array_equal(quality.measures([t])[0], x[ends[i] - count[i] : ends[i]])


def test_gradient_equals_differences():
    x, count = quality.measures([b"one two", b" ".join(b"w%d" % i for i in range(300)), b"A!! B!!", b""])
    net = quality.Network.start(x.mean(0).astype(float), np.ones(quality.MEASURES), 0.7)
    y = np.array([1.0, 0, 1, 0])
    _, slope = net.gradient(x.astype(float), count, y)
    at = [*range(quality.Network.FIXED, len(slope), 97), *range(len(slope) - 30, len(slope))]
    for i in at:
        loss = []
        for step in (1e-6, -1e-6):
            values = net.values.copy()
            values[i] += step
            loss.append(quality.Network(values).gradient(x.astype(float), count, y)[0])
        assert abs((loss[0] - loss[1]) / 2e-6 - slope[i]) < 1e-6


def test_score_runs_on_over_pieces(monkeypatch):
    """Attention over the pieces of a long text is one softmax."""
    rng = random.Random(1)
    texts = [" ".join(rng.choice(("ab", "cde", "F!", "g")) for _ in range(n)) for n in (3000, 2, 900, 0, 5000)]
    rng = np.random.default_rng(0)
    net = quality.Network(rng.standard_normal(quality.Network.size()))
    monkeypatch.setattr(quality, "SEGMENT", 1000)
    got, passages = net.scores(texts)
    for i, t in enumerate(texts):
        raw = t.encode()
        x = np.concatenate([quality.measures([raw[lo : lo + 1000]])[0] for lo in range(0, max(len(raw), 1), 1000)])
        _, h, _, _, e = net.passages(x)
        a = np.exp(e - e.max())
        s = float((a[:, None] * h).sum(0) / a.sum() @ net.out + net.bias[0])
        assert abs(got[i] - 1 / (1 + math.exp(-s))) < 1e-9 and passages[i] == len(x)


DOCS = "doc_id long, text string, label int, score double"


def test_quality_held_out(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "of", "and", "the"]
    rows, labels = [], []
    for i in range(400):
        good = i % 4 != 0
        clean = [rng.choice(words) for _ in range(rng.randint(150, 400))]
        if not good:  # one passage of junk among clean ones
            at = rng.randrange(len(clean) // 128 + 1) * 128
            clean[at : at + 128] = [w + "###" for w in clean[at : at + 128]]
        rows.append((i, " ".join(clean), 7, 0.5))
        labels.append((i, int(good)))
    rows += [(None, None, 1, 0.1), (1000, "", 1, 0.1), rows[5], (1001, "word " * 40_000, 1, 0.1)]
    labels += [(None, 1), (5000, None), labels[8]]
    docs, known = spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality.score_quality(docs, known).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert all(r["held_out"] == (crc_of(r["doc_id"]) % 4 == 2) for r in got) and zlib.crc32(b"") == 0
    truth = dict(labels[:400])
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 60 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) > 0.95 * len(held)
    none = quality.score_quality(docs, known.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.score_quality(docs.limit(0), known).collect() == []


def test_attention_finds_the_junk_passage(spark):
    """Labels of documents alone teach which passage decides."""
    rng = random.Random(4)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "of", "the"])
    rows = [(int(i % 2), " ".join([word() for _ in range(128 * 2)] + [word() + ("" if i % 2 else "%%%") for _ in range(128)])) for i in range(80)]
    net = quality.fit_network(spark.createDataFrame(rows, "label int, text string").repartition(2))
    x, _ = quality.measures([rows[0][1].encode()])
    _, h, _, _, e = net.passages(x.astype(float))
    assert len(e) == 3 and e.argmax() == 2
