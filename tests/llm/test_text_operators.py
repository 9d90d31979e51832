"""Text operators against brute force, and on null, empty, repeated and clashing rows."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from sessionloom.llm import context_tree, decontaminate, embedding_dup, mixing, near_dup, secret_scan, substring_dedup, token_files, toxicity, warc
from sessionloom.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, source string, row long, n long, key long"
WORDS = [a + b for a in ("th", "er", "on", "is", "wal", "gen", "mor", "pi") for b in ("", "ing", "ed", "ly", "tion", "s,", "ness", ".")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Texts with copies, near copies, shared passages, repeats, and odd rows."""
    rng = random.Random(4)
    texts = [sentence(rng, rng.randint(1, 80)) for _ in range(60)]
    passage = sentence(rng, 30)
    texts += [f"{sentence(rng, 5)} {passage} {sentence(rng, 7)}" for _ in range(6)]
    base = sentence(rng, 120)
    texts += [base, base]
    for i in range(8):
        w = base.split()
        w[i * 13] = "changed"
        texts.append(" ".join(w))
    texts += [passage + " " + passage, "", "a", "one two three", "   ", None, sentence(rng, 30_000)]
    rows = [(i, t, f"s{i % 3}" if i % 7 else None, 1, 2, 3) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return [*rows, (None, passage, "s0", 1, 2, 3), rows[0]]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(t, lower=False):
    raw = (t or "").encode()
    return (raw.lower() if lower else raw).split()


# Secrets.


def test_secret_base_spans_and_entropy():
    text = "API_key = 'abcdef' token:abc token: tokens-x password=hunter22 AKIA" + "A1" * 8 + " " + "0a" * 12 + " ſecret=abcdefgh"
    base, added = secret_scan.scan_text(text)
    plain = [(m.start(), m.end(), "assign") for m in re.finditer(r"""(?:[Pp]assword|token|API_key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 6]
    assert [x for x in base if x[2] == "assign"] == plain
    assert [x[2] for x in base if x[2] != "assign"] == ["access", "hex"]
    assert secret_scan.scan_text("x 550e8400-e29b-41d4-a716-446655440000 abcdefghijklmnopqrstuvwxyz")[1] == []
    key = "aB3dE6gH9jK2mN5pQ8sT1vW4"
    assert [text[2]for text in secret_scan.scan_text(f"use {key} now")[1]] == ["entropy_base64"]


def test_secrets_of_a_long_text_take_linear_time():
    """1.3 MB of digests, apart and in one candidate, and a window of one character over and over."""
    for sep in (" ", "/", "-" + "a" * 30 + "-"):
        text = sep.join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(20_000))
        base, added = secret_scan.scan_text(text)
        assert len(base) >= 20_000 and all(b - a >= 20 for a, b, _ in added)
    assert secret_scan.scan_text("x" * 40 + "1" * 40)[1] == []


def test_allowed_strings_spare_only_themselves():
    for before, key in (("store/2024-05-01/", "aB3dE5fG7hI9jK1lM3nO5pQ7rS9"), ("//cdn/example/v1/", "Zx9Kq2Lm8Pw4Rt6Yb1Nc3Vd5"), ("run=550e8400-e29b-41d4-a716-446655440000/", "Zx9Kq2Lm8Pw4Rt6Yb1Nc3Vd5")):
        text = before + key
        added = secret_scan.scan_text(text)[1]
        assert any(a <= len(before) and b == len(text) for a, b, _ in added), (text, added)
    for text in ("job/550e8400-e29b-41d4-a716-446655440000/Step-Name", "sha256-47DEQpj8HBSa+/TImW+5JCeuQeRkm5NMpJWZG3hSuFU=", "your_api_key_Example_1234567890ab", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "logs/2024-05-01/2024-05-02/Some-Words"):
        assert secret_scan.scan_text(text)[1] == []


@pytest.mark.parametrize("seed", range(5))
def test_incremental_entropy_equals_direct(seed):
    rng = random.Random(seed)
    s = "".join(rng.choice("abcdef0123456789") for _ in range(80))
    direct = set()
    for i in range(len(s) - 19):
        c = Counter(s[i : i + 20]).values()
        if -sum(x / 20 * math.log2(x / 20) for x in c) >= 3.2:
            direct |= set(range(i, i + 20))
    assert {i for a, b in secret_scan.high_windows(s, 20, 3.2) for i in range(a, b)} == direct


def test_secret_rows(spark, docs, empty, corpus):
    got = secret_scan.scan_secrets(docs).collect()
    assert len(got) == len(corpus) and {r["base_sha256"] for r in got} == {hashlib.sha256(b"").hexdigest()}
    assert secret_scan.scan_secrets(empty).count() == 0


def test_secret_base_digest(spark):
    """Base spans of all kinds in one text: counts and digest by plain regular expressions."""
    rng = random.Random(2)
    texts = []
    for i in range(40):
        parts = [sentence(rng, 4), f"Password = 'hunter{i}22'", "AKIA" + "Z9" * rng.randint(5, 12), sentence(rng, 3), "0f" * rng.randint(8, 20), f"api_key:{'q' * rng.randint(1, 9)}", "é tokenx=abc123 token=AKIA" + "Q7" * 10]
        rng.shuffle(parts)
        texts.append(" ".join(parts))
    texts += [None, "", "secret=" + "a" * 40]
    patterns = (("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|passwd|secret|token|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6), ("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24))
    got = {r["doc_id"]: r for r in secret_scan.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        found = []
        for order, (kind, pattern, least) in enumerate(patterns):
            for m in re.finditer(pattern, t or ""):
                if len(m[2] if kind == "assign" else m[0]) >= least:
                    found.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
        spans = [x[2] for x in sorted(found)]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s.startswith(k) for s in spans) for k in ("assign", "access", "hex")]
        assert set(spans) <= set(got[i]["spans"].split(","))


# Substring dedup.


def test_substring_dedup_brute_force(docs, empty, corpus):
    first = {}
    for i, t, *_ in corpus:
        if i is not None:
            w = words(t)
            for j in range(len(w) - 12):
                k = tuple(w[j : j + 13])
                first[k] = min(first.get(k, i), i)
    want = Counter()
    for i, t, *_ in corpus:
        w = words(t)
        gone = set()
        for j in range(len(w) - 12) if i is not None else ():
            if first[tuple(w[j : j + 13])] < i:
                gone |= set(range(j, j + 13))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        want[(i, len(w), len(gone), hashlib.sha256(kept).hexdigest())] += 1
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(docs).collect())
    assert got == want
    assert any(k[2] for k in want)
    assert substring_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("parts", [1, 2, 7, 32])
def test_substring_dedup_any_layout(spark, parts):
    """Documents that repeat a passage within themselves, in whichever task their smaller copies are."""
    rng = random.Random(6)
    passages = [sentence(rng, n) for n in (13, 14, 20, 45)]
    texts = [" ".join([sentence(rng, rng.randint(0, 9)), p, sentence(rng, 3), p, p]) for p in passages for _ in range(4)]
    texts += [sentence(rng, 12), passages[0], (passages[1] + " ") * 9]
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
    first = {}
    for i, t in rows:
        w = words(t)
        for j in range(len(w) - 12):
            first[tuple(w[j : j + 13])] = min(first.get(tuple(w[j : j + 13]), i), i)
    gone = {i: {x for j in range(len(words(t)) - 12) if first[tuple(words(t)[j : j + 13])] < i for x in range(j, j + 13)} for i, t in rows}
    assert {r["doc_id"]: r["n_removed"] for r in got} == {i: len(g) for i, g in gone.items()}


# Near duplicates.


def shingle_set(t, k):
    w = words(t, True)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def test_near_duplicates_brute_force(docs, empty, corpus):
    sets = [(i, shingle_set(t, 4)) for i, t, *_ in corpus]
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if i is not None and j is not None and i < j and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    want = Counter((i, len(s), find(i) if i is not None else None) for i, s in sets)
    rows = near_dup.near_duplicates(docs).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows) == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows if r["doc_id"] is not None)
    assert near_dup.near_duplicates(empty).count() == 0
    kept = near_dup.keep_one(docs, 4)
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted({find(i) for i, _ in sets if i is not None})


def test_hyperminhash_estimate():
    rng = np.random.default_rng(3)
    for n, shared in ((60, 45), (900, 800), (5000, 1000)):
        u = rng.integers(0, 2**64, 2 * n - shared, dtype=np.uint64)
        a, b = np.sort(u[:n]), np.sort(u[n - shared :])
        got = near_dup.estimate(near_dup.registers(a)[None], near_dup.registers(b)[None], np.array([float(n)]), np.array([float(n)]))[0]
        assert abs(got - shared / (2 * n - shared)) < 0.08


def test_large_group_without_base(spark):
    """Near copies of a text that isn't there: more than a key's small size, some pairs linked."""
    rng = random.Random(9)
    base = sentence(rng, 150).split()
    rows = []
    for i in range(40):
        w = list(base)
        for _ in range(rng.randint(1, 6)):
            w[rng.randrange(150)] = f"w{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    sets = [shingle_set(t, 4) for _, t in rows]
    root = list(range(40))
    for _ in range(40):
        for i in range(40):
            for j in range(40):
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(root))


def test_keep_one_judges_rows_that_share_a_doc_id(spark):
    rng = random.Random(3)
    base, other = sentence(rng, 60), sentence(rng, 50)
    near = base + " end"
    rows = [(1, base, 7), (5, near, 8), (5, other, 9), (6, other, 1), (6, other, 2), (None, base, 3), (8, None, 4), (8, "", 5)]
    got = near_dup.keep_one(spark.createDataFrame(rows, "doc_id long, text string, near_key int")).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter([(1, base), (5, other), (None, base), (8, None), (8, "")])
    assert got[0].asDict().keys() == {"doc_id", "text", "near_key"}


# Embeddings.


def test_e8_decoder_is_nearest():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 8)) * 2
    got = embedding_dup.nearest_e8(x)
    roots = embedding_dup.e8_roots()
    assert len({tuple(r) for r in roots}) == 240
    d = ((2 * x - got) ** 2).sum(1)
    assert all((((2 * x - (got + r)) ** 2).sum(1) >= d - 1e-9).all() for r in roots)


def test_vectors_brute_force(spark):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(30, 16))
    vecs = [(c + rng.normal(size=16) * s).astype(np.float32).tolist() for c in centers for s in (0.0, 0.02, 0.05, 0.1)]
    vecs += [vecs[0]] * 5
    rows = [(i, v, i % 2, "x") for i, v in enumerate(vecs)]
    n = len(rows)
    rows += [(n, None, 0, "x"), (n + 1, [0.0] * 16, 0, "x"), (n + 2, [float("nan")] + [1.0] * 15, 0, "x"), (n + 3, vecs[0], None, "x"), (n + 4, [], 1, "x"), (n + 5, [None] + [1.0] * 15, 1, "x"), (n + 6, vecs[0][:8], 0, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rep string")
    good = [(i, np.array(v, float), lab) for i, v, lab, _ in rows[:n]] + [(n + 6, np.array(vecs[0][:8], float), 0)]
    links = Counter()
    root = {r[0]: r[0] for r in rows}
    for _ in range(5):
        for i, a, x in good:
            for j, b, y in good:
                if i != j and x == y and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.98:
                    links[i, j] = 1
                    root[i] = root[j] = min(root[i], root[j])
    want = {i: (sum(1 for p in links if p[0] == i), root[i]) for i in root}
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dup.near_duplicate_vectors(df, block=4).collect()}
    assert got == want
    assert embedding_dup.near_duplicate_vectors(df.limit(0)).count() == 0


def test_vectors_in_blocks(spark):
    """Two dense groups of near vectors, far over a block, and a recall of all links at the threshold."""
    rng = np.random.default_rng(3)
    vecs = [c + rng.normal(size=24) * 0.02 for c in rng.normal(size=(2, 24)) for _ in range(60)]
    for _ in range(60):  # pairs at a cosine of 0.981
        a = rng.normal(size=24)
        b = rng.normal(size=24)
        a, b = a / np.linalg.norm(a), b - a * (a @ b) / (a @ a)
        vecs += [a, 0.981 * a + math.sqrt(1 - 0.981**2) * b / np.linalg.norm(b)]
    unit = np.array(vecs) / np.linalg.norm(vecs, axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.98) & ~np.eye(len(vecs), dtype=bool)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(vecs)], "vec_id long, embedding array<double>, label int")
    for block in (7, 2048):
        got = {r["vec_id"]: r["n_links"] for r in embedding_dup.near_duplicate_vectors(df, block=block).collect()}
        assert got == dict(enumerate(linked.sum(1).tolist()))


# WARC.


def test_warc_round_trip_and_magic_inside(spark, tmp_path):
    big = "<html>" + "x" * 200 + "</html>"
    fake = "text WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n" + "é" * 70
    rows = [(5, big, "u"), (2, big, "u"), (9, big, "u"), (1, fake, "u"), (3, None, "u"), (4, "short", "u"), (6, "short", "u"), (7, fake, "u"), (8, "WARC/1.1\r\n\r\n", "u")]
    rows += [(20 + i, f"page {i} " + "y" * (i * 7), "u") for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, html string, digest string").repartition(2)
    got = {r["page_id"]: r for r in warc.archive_table(df).collect()}
    first = {}
    for p, h, _ in sorted(rows):
        first.setdefault(h or "", p)
    assert set(got) == {r[0] for r in rows}
    for p, h, _ in rows:
        data = (h or "").encode()
        src = first[h or ""] if len(data) >= 100 else p
        assert got[p]["payload_bytes"] == len(data) and got[p]["payload_digest"] == hashlib.sha256(data).hexdigest()
        assert (got[p]["record_type"], got[p]["refers_to"]) == (("response", None) if src == p else ("revisit", src))
    assert warc.archive_table(df.limit(0)).count() == 0


def test_warc_numbers_of_any_length(spark):
    heads = [f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{page}>\r\nContent-Length: {n}\r\n\r\nab\r\n\r\n" for kind in ("response", "revisit") for n in ("9" * 20, "1" * 5000, "2", "0" * 30 + "2") for page in ("7", "9" * 20, "-" + "8" * 5000)]
    rows = [(i, h * 3) for i, h in enumerate(heads)] + [(100, "".join(heads)), (101, "HTTP/1.1 200 OK\r\nContent-Length: " + "9" * 30 + "\r\n\r\n"), (2**63 - 1, "x"), (-(2**63), "y"), (102, "WARC/1.1\r\n" * 500 + "X: 1\r\n" * 9000)]
    got = {r["page_id"]: r["payload_digest"] for r in warc.archive_table(spark.createDataFrame(rows, "page_id long, html string")).collect()}
    assert got == {i: hashlib.sha256(h.encode()).hexdigest() for i, h in rows}


def test_nested_headers_take_linear_time(spark):
    """A page of 4,000 headers that all end where the record ends, with small whole records between."""
    tiny = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 2\r\n\r\nok\r\n\r\n"
    html, parts = "tail " * 20, []
    for i in range(4000):
        head = f"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: {len(html)}\r\n\r\n"
        html = (tiny if i % 2 else "") + head + html
    parts = [(1, html), (2, "x" * 200), (3, html), (4, "y" + html), (5, None)]
    took = time.process_time()
    starts = [m.start() for m in re.finditer("WARC/1.1", html)]
    assert len(starts) == 6000
    assert warc.overlapping([(0, 5), (1, 3), (4, 9), (9, 10), (12, 13)]) == [(0, 3, 9), (3, 4, 10), (4, 5, 13)]
    got = {r["page_id"]: r for r in warc.archive_table(spark.createDataFrame(parts, "page_id long, html string")).collect()}
    assert time.process_time() - took < 60 and set(got) == {1, 2, 3, 4, 5}
    for i, t in parts:
        assert got[i]["payload_digest"] == hashlib.sha256((t or "").encode()).hexdigest() and got[i]["payload_bytes"] == len((t or "").encode())
    assert got[3]["refers_to"] == 1 and got[4]["record_type"] == "response"


def test_warc_large_pages(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 1 << 18)
    rows = [(i, chr(97 + i % 26) * (1 << (i % 20)) + str(i)) for i in range(60)] + [(60, None)]
    got = {r["page_id"]: r["payload_bytes"] for r in warc.archive_table(spark.createDataFrame(rows, "page_id long, html string").repartition(1)).collect()}
    assert got == {i: len(t or "") for i, t in rows}


# Mixing.


def water_fill(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, target, free = sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    left = float(total)
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s] + 1e-9]
        if not over:
            return target | share
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
            free.discard(s)
    return target


def test_mixing(docs, empty, corpus):
    sizes = Counter()
    for _, t, s, *_ in corpus:
        sizes[s] += len(words(t))
    want = water_fill(sizes)
    rows = mixing.mix_sources(docs, block=8).collect()
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((i, len(words(t))) for i, t, *_ in corpus)
    taken = Counter()
    for r in rows:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(want.values()) and r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    assert set(rows) == set(mixing.mix_sources(docs.repartition(7), block=8).collect())
    assert mixing.mix_sources(empty).count() == 0
    assert mixing.mixed_documents(docs).count() == sum(r["copies"] for r in mixing.mix_sources(docs).collect())


def test_mixing_hits_targets(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(1, 60), f"s{min(i % 9, 4)}") for i in range(3000)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=64).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 60 for s in target)


def test_settle_keeps_mass():
    rng = np.random.default_rng(1)
    size = np.sort(rng.integers(1, 500, 300))[::-1].astype(float)
    mass = rng.random(300)
    out = mixing.settle(mass, size, rng.random(300))
    assert abs(out @ size - mass @ size) < 1e-6
    assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 3


def test_mixing_clashing_names_and_equal_rows(spark):
    rows = [(1, "a b c", "s", 5, 6, 7)] * 25 + [(None, f"w{i} x", None, 5, 6, 7) for i in range(30)] + [(2, None, "s", 1, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, m_doc int, mix_draw int, copies int")
    mix = mixing.mix_sources(df).collect()
    assert len(mix) == len(rows) and len({(r["draw"], r["row"]) for r in mix}) == len(rows)
    got = mixing.mixed_documents(df)
    assert got.columns == df.columns
    want = Counter()
    for r in mix:
        want[r["doc_id"], r["size"]] += r["copies"]
    assert Counter((r["doc_id"], len((r["text"] or "").split())) for r in got.collect()) == +want


def test_pivot_keeps_mass():
    rng = np.random.default_rng(0)
    mass, size = rng.random(200).tolist(), rng.integers(1, 50, 200).astype(float).tolist()
    out, keep = mixing.pivot(mass, size, rng.random(200).tolist())
    assert abs(np.dot(out, size) - np.dot(mass, size)) < 1e-6
    assert all(x in (0.0, 1.0) for i, x in enumerate(out) if i != keep)


# Tokens.


def test_codes_random_access():
    rng = np.random.default_rng(0)
    for ids in (rng.integers(0, 50257, 5000), rng.integers(0, 2**31, 700), np.array([2]), np.array([0, 255, 256, 65535, 65536]), np.zeros(0, np.int64)):
        codes = token_files.Codes(token_files.encode_codes(ids))
        assert codes.n == len(ids) and [codes[i] for i in range(0, len(ids), 7)] == ids[::7].tolist()
        for a in range(0, len(ids), 311):
            n = min(97, len(ids) - a)
            assert (codes.slice(a, n) == ids[a : a + n]).all()


def test_token_table(spark, docs, empty, corpus):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_path())
    extra = [(500, "don't  stop\n\n it's ½ x² über\tfin <|endoftext|> y ", "s", 1, 2, 3), (501, " lead space 12a3", "s", 1, 2, 3)]
    both = docs.unionByName(spark.createDataFrame(extra, DOCS))
    got = token_files.token_table(both, tokenizer_path()).collect()
    ids = {}
    for i, t, *_ in [*corpus, *extra]:
        x = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        ids.setdefault(i, []).append((len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((i, *x) for i, xs in ids.items() for x in xs)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"]) if r["doc_id"] is not None]
    assert order == sorted(order)
    assert token_files.token_table(empty, tokenizer_path()).count() == 0


# Language model.


def test_base_score_brute_force(docs, empty, corpus):
    train = [t for i, t, *_ in corpus if zlib.crc32((str(i) if i is not None else "").encode()) % 7 != 2]
    c = Counter(w for t in train for w in [*words(t, True), None])
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t, *_ in corpus:
        w = [*words(t, True), None]
        want[(i, len(w), sum(c[x] > 0 for x in w), round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 4))] += 1
    rows = context_tree.score_documents(docs, context_tree.in_training()).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in rows) == want
    assert all(r["score"] < 0 and r["train_tokens"] == n for r in rows)
    assert context_tree.score_documents(empty, context_tree.in_training()).count() == 0


def test_context_tree_is_a_distribution(spark):
    """After seen and unseen contexts, the probabilities of all 256 bytes sum to one."""
    n = Counter(c for t in ("abracadabra", "banana") for c in context_tree.byte_grams([t])[0].tolist())
    contexts = (0x6162726163, 0, 0x7A7A7A7A7A, 0x7A7A6E616E)
    rows = n | {c << 8 | byte: n[c << 8 | byte] for c in contexts for byte in range(256)}
    got = {r["code"]: r["log_p"] for r in context_tree.gram_table(spark.createDataFrame(list(rows.items()), "code long, n long")).collect()}
    assert got.keys() == rows.keys()
    for c in contexts:
        assert abs(sum(10 ** got[c << 8 | byte] for byte in range(256)) - 1) < 1e-9


def brute_force_ctw(train, texts, depth):
    """log10 P of each text by the definition: counts of every context in plain dictionaries."""
    counts, children = {}, {}

    def decisions(t):
        data = bytes(depth) + (t or "").encode() + b"\0"
        for i in range(depth, len(data)):
            m = 1
            for shift in range(7, -1, -1):
                bit = data[i] >> shift & 1
                yield [(data[i - d : i], m) for d in range(depth + 1)], bit
                m = m << 1 | bit

    for t in train:
        for nodes, bit in decisions(t):
            for d, node in enumerate(nodes):
                counts.setdefault((d, node), [0, 0])[bit] += 1
                if d:
                    children.setdefault((d - 1, nodes[d - 1]), set()).add((d, node))

    def kt(n0, n1):
        return math.lgamma(n0 + 0.5) + math.lgamma(n1 + 0.5) - math.log(math.pi) - math.lgamma(n0 + n1 + 1)

    weighted, own = {}, {}
    for node in sorted(counts, key=lambda x: -x[0]):
        pe, below = kt(*counts[node]), sum(weighted[c] for c in children.get(node, ()))
        if node[0] == depth:
            weighted[node], own[node] = pe, 1.0
        else:
            hi = max(pe, below)
            weighted[node] = hi + math.log((math.exp(pe - hi) + math.exp(below - hi)) / 2)
            own[node] = 1 / (1 + math.exp(min(below - pe, 700)))
    out = []
    for t in texts:
        total = 0.0
        for nodes, bit in decisions(t):
            q = 0.5
            known = [(d, n) for d, n in enumerate(nodes) if (d, n) in counts]
            for i, node in enumerate(reversed(known)):
                n0, n1 = counts[node]
                p1 = (n1 + 0.5) / (n0 + n1 + 1)
                q = p1 if i == 0 else own[node] * p1 + (1 - own[node]) * q
            total += math.log10(q if bit else 1 - q)
        out.append(total)
    return out


def test_scores_equal_brute_force_ctw(spark, monkeypatch):
    rng = random.Random(12)
    texts = [sentence(rng, rng.randint(0, 25)) for _ in range(40)] + [None, "", "abracadabra é ü 漢字 abracadabra", "z" * 60]
    rows = list(enumerate(texts))
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    want = brute_force_ctw(train, texts, context_tree.DEPTH)
    for most in (context_tree.GRAMS, 40):  # the size of the cache changes no result
        monkeypatch.setattr(context_tree, "GRAMS", most)
        got = {r["doc_id"]: r["score"] for r in context_tree.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), context_tree.in_training()).collect()}
        assert all(abs(got[i] - want[i]) < 1e-6 * max(1, -want[i]) for i, _ in rows)


# Decontamination.


def test_block_max_wand_finds_all():
    rng = random.Random(1)
    items = [(i, sentence(rng, rng.randint(3, 40))) for i in range(60)]
    index = decontaminate.Index.build(items)
    for _ in range(40):
        passage = decontaminate.normal_words(rng.choice(items)[1] + " " + sentence(rng, 20))
        terms = sorted({index.terms[w] for w in passage if w in index.terms})
        score = Counter()
        for t in terms:
            for i, x in zip(*index.postings[t], strict=True):
                score[int(i)] += float(x)
        got = {i: s for b in range(index.block_max.shape[1]) for i, s in index.block_max_wand(terms, b, 0.6)}
        assert {i for i, s in score.items() if s >= 0.6} == set(got)


def test_leaks(spark, docs, empty):
    rng = random.Random(7)
    items = [(i, sentence(rng, 12).replace(".", "") + ". Answer " + sentence(rng, 4).replace(".", "")) for i in range(9)]
    bench = spark.createDataFrame([*items, (None, items[0][1]), (50, None), (51, "")], "item_id long, text string")
    planted = [(900 + i, f"{sentence(rng, 70)} {t.upper()} {sentence(rng, 90)}", "s", 1, 2, 3) for i, t in items]
    half = [(950, sentence(rng, 40) + " " + " ".join(items[3][1].split()[:6]), "s", 1, 2, 3)]
    both = docs.unionByName(spark.createDataFrame([*planted, *half], DOCS))
    scores = []
    for step in (2000, 4, 1):
        got = decontaminate.find_leaks(both, bench, index_items=step).collect()
        pairs = {(r["doc_id"], r["item_id"]) for r in got if r["item_id"] is not None}
        assert pairs == {(900 + i, i) for i, _ in items}
        scores.append(sorted((r["doc_id"], r["item_id"] or -1, round(r["score"], 9)) for r in got))
    assert scores[0] == scores[1] == scores[2]
    named = both.withColumnsRenamed({"row": "row_id", "n": "leak_key"})
    left = decontaminate.clean_documents(named, bench)
    assert left.columns == named.columns and {r["row_id"] for r in left.collect()} == {1}
    assert decontaminate.clean_documents(both, bench).count() == both.count() - len(items)
    assert decontaminate.find_leaks(empty, bench).count() == 0 and decontaminate.find_leaks(docs, bench.limit(0)).count() == 0


def test_long_items_are_found_by_parts_and_change_nothing_else(spark):
    """Hits of the other items stay when an item of 3,000 words joins; the long one is found where
    enough of its shingles occur, though no passage holds it."""
    rng = random.Random(11)
    items = [(i, f"what is item {i} {sentence(rng, 12)}".replace(".", "") + f". Answer {i}x " + sentence(rng, 4).replace(".", "")) for i in range(9)]
    long_item = " ".join(f"{rng.choice(WORDS)}{rng.randint(0, 500)}" for _ in range(3000)).replace(".", "")
    kept = long_item.split()
    rows = [(i, f"{sentence(rng, 70)} {t} {sentence(rng, 90)}", "s", 1, 2, 3) for i, t in items]
    rows += [(100, f"{sentence(rng, 500)} {long_item} {sentence(rng, 100)}", "s", 1, 2, 3), (101, " ".join(kept[:2700]), "s", 1, 2, 3), (102, " ".join(kept[:1500]), "s", 1, 2, 3)]
    docs = spark.createDataFrame(rows, DOCS)
    find = lambda bench: {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert find(items) == {(i, i) for i, _ in items}
    assert find([*items, (500, long_item)]) == {(i, i) for i, _ in items} | {(100, 500), (101, 500)}
    assert [len(p) for p in decontaminate.item_parts(" ".join(map(str, range(130))))] == [43, 43, 44] and decontaminate.item_parts(None) == []


# Toxicity.


def test_restores_disguised_words(spark):
    rng = random.Random(5)
    text = " ".join(rng.choice(["idiot", "the", "stupid", "table", "and", "trash", "with", "moron"]) for _ in range(4000))
    lm = toxicity.language_model(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    for disguise, word in (("1d10t", "idiot"), ("5tup1d", "stupid"), ("m0r0n", "moron"), ("tr@sh!", "trash"), ("stuuuupid", "stupid"), ("mor.on", "moron"), ("table,", "table"), ("$$$", ""), ("1234", "")):
        assert toxicity.restore_token(disguise, lm).rstrip("i") == word or toxicity.restore_token(disguise, lm) == word
    assert "idiot" in toxicity.restore_text("you i d i o t you", lm)


@pytest.fixture(scope="module")
def letters():
    rng = random.Random(5)
    text = " ".join(rng.choice(["idiot", "the", "stupid", "a", "you", "are", "bastard", "and", "fool", "is", "better"]) for _ in range(6000))
    tri = toxicity.count_trigrams([text]).reshape((toxicity.SIZE,) * 3)
    uni = (tri.sum((0, 1)) + 1) / (tri.sum() + toxicity.SIZE)
    bi = (tri.sum(0) + 5 * uni) / (tri.sum((0, 2))[:, None] + 5)
    return np.log((tri + 5 * bi[None]) / (tri.sum(2, keepdims=True) + 5))


@pytest.mark.parametrize(
    ("text", "found"),
    [("you are a s t u p i d fool", "stupid"), ("s t u p i d i d i o t", "stupid idiot"), ("s  t  u  p  i  d", "stupid"), ("s\nt\tu p\n\ni d", "stupid"), ("b @ s t a r d", "bastard"), ("a stu pid fool", "stupid"), ("you i d 1 o t!", "idiot"), ("i.d i.o.t", "idiot")],
)
def test_restores_spaced_words(letters, text, found):
    got = toxicity.restore_text(text, letters)
    assert set(found.split()) <= set(got), got
    assert set(toxicity.restore_text("you and the fool is a fool", letters)) == {"you", "and", "the", "fool", "is", "a"}


def test_restores_long_and_doubled_tokens(letters):
    glued = ".".join(["the", "idiot", "and"] * 6)
    for token, word in (("idi" + "o" * 60 + "t", "idiot"), ("i" + "." * 30 + "di" + "-" * 30 + "ot", "idiot"), (glued, "idiot"), ("iiddiioott", "idiot"), ("stuupid", "stupid"), ("better", "better"), ("fool", "fool")):
        assert word in toxicity.restore_token(token, letters).split(), (token, toxicity.restore_token(token, letters))


def test_separators_in_tokens_of_any_length(letters):
    """39 and 49 characters, and more, read alike: a separator is a word bound or nothing."""
    for times in (1, 4, 5, 40):
        got = toxicity.restore_token("i.d.i.o.t." * times, letters).split()
        assert len(got) == times and set(got) == {"idiot"}, (times, got)


def brute_readings(token):
    """All readings of a token with their channel costs."""
    out, before = [((), 0.0)], ""
    for ch in token:
        if ch in " \t":
            ways = [(" ", 0.0), ("", toxicity.JOIN_COST if ch == " " else toxicity.CHUNK_COST)]
        elif ch.isalpha():
            ways = [(ch, 0.0)] + [("", toxicity.REPEAT_COST)] * (ch == before)
        else:
            ways = [(x, toxicity.SWAP_COST) for x in toxicity.SIGNS.get(ch, "")]
            if ch in toxicity.DROPPED or not ways or ch == before:
                ways.append(("", toxicity.DROP_COST))
        out, before = [((*word, x) if x else word, cost + c) for word, cost in out for x, c in ways], ch
    return out


def likelihood(word, cost, lm):
    """log P of a reading per letter, its word bounds and the channel's costs included."""
    p, q, score = toxicity.BOUND, toxicity.BOUND, -cost
    for x in word:
        if x == " " and q == toxicity.BOUND:
            continue
        c = toxicity.BOUND if x == " " else toxicity._letter(x)
        score, p, q = score + lm[p][q][c], q, c
    n = sum(x != " " for x in word)
    return (score + (lm[p][q][toxicity.BOUND] if q != toxicity.BOUND else 0.0)) / (n + 1) if n else -math.inf


def test_decoder_equals_all_readings(letters):
    """The decoded word is the likeliest of all readings that end in its letters (Viterbi keeps the
    best reading for each last two letters, and ends are compared by likelihood per letter)."""
    rng = random.Random(9)
    for _ in range(300):
        token = "".join(rng.choice("idiotstup1034!.-  \t$@|") for _ in range(rng.randint(1, 9)))
        ends: dict = {}
        for word, cost in brute_readings(token):
            p, q, score = toxicity.BOUND, toxicity.BOUND, -cost
            for x in word:
                if x == " " and q == toxicity.BOUND:
                    continue
                c = toxicity.BOUND if x == " " else toxicity._letter(x)
                score, p, q = score + letters[p][q][c], q, c
            if (p, q) not in ends or score > ends[p, q][0] + 1e-12:
                ends[p, q] = (score, word, cost)
        best = max(likelihood(word, cost, letters) for _, word, cost in ends.values())
        got = toxicity.viterbi(token, letters)
        costs = [likelihood(word, cost, letters) for word, cost in brute_readings(token) if " ".join("".join(word).split()) == " ".join(got.split())]
        assert costs and (max(costs) >= best - 1e-9 or best == -math.inf), (token, got)


def test_toxicity_held_out(spark, empty):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        w = sentence(rng, 40).split()
        if toxic:
            for x in rng.sample(["idiot", "scumbag", "worthless"], 2):
                w.insert(rng.randrange(len(w)), x if i % 2 else x.replace("i", "1").replace("o", "0"))
        rows.append((i, " ".join(w), "s", 1, 2, 3))
        labels.append((i, int(toxic), 9))
    rows += [(700, None, "s", 1, 2, 3), (701, "", "s", 1, 2, 3), (None, "x", "s", 1, 2, 3)]
    docs = spark.createDataFrame(rows, DOCS)
    lab = spark.createDataFrame([*labels, (None, 1, 9), (5, None, 9)], "doc_id long, toxic int, score int")
    got = toxicity.score_toxicity(docs, lab).collect()
    truth = {i: t for i, t, _ in labels}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    assert all(r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0) for r in got)
    assert toxicity.keep_clean(docs, lab).columns == docs.columns
    assert toxicity.score_toxicity(empty, lab).count() == 0 and toxicity.score_toxicity(docs, lab.limit(0)).where("predicted = 1").count() == 0


def test_ascii_words_are_those_of_any_text():
    """ASCII texts are cut by a pattern of their own."""
    rng = np.random.default_rng(6)
    signs = [*map(chr, range(128)), " ", " ", "  ", "'s", "'re", "'LL", "a", "b", "7", "\n ", "_"]
    for _ in range(3000):
        text = "".join(signs[i] for i in rng.integers(0, len(signs), rng.integers(0, 12)))
        assert token_files.pre_words(text) == token_files.PRE_WORD.findall(text)
        assert token_files.pre_words(text + "é") == token_files.PRE_WORD.findall(text + "é")
