"""What a worker of the context tree holds, in bytes for each byte of text and each cached gram."""

import random
import tracemalloc
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from sessionloom.llm import context_tree


def peak(f):
    tracemalloc.start()
    try:
        out = f()
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def texts(n: int) -> list[str]:
    rng = random.Random(3)
    return ["".join(rng.choice("abcdefgh é") for _ in range(2000)) for _ in range(n)]


def test_grams_are_made_in_place():
    given = texts(200)
    size = sum(len(t.encode()) for t in given)
    (codes, _, _), most = peak(lambda: context_tree.byte_grams(given))
    assert most < 14 * size  # 25 when each byte's shift had arrays of its own
    raw = b"".join(bytes(5) + t.encode() + b"\0" for t in given)
    for i in (5, 17, len(raw) - 1):
        assert int(codes[i]) == int.from_bytes(raw[i - 5 : i + 1], "big")


def test_counting_holds_few_copies():
    given = texts(400)
    size = sum(len(t.encode()) for t in given)
    chosen = [zlib.crc32(str(i).encode()) % 7 != 2 for i in range(len(given))]
    for marks in (chosen, [True] * len(given), [False] * len(given)):
        batch = pa.record_batch([pa.array(given), pa.array(marks)], names=["text", "training"])
        got, most = peak(lambda b=batch: [x for x in context_tree._tally(iter([b]))])
        rows = {(k, c): n for x in got for k, c, n in zip(*(c.to_pylist() for c in x.columns), strict=True)}
        want: dict[int, int] = {}
        for t, x in zip(given, marks, strict=True):
            codes, starts, _ = context_tree.byte_grams([t])
            for c in codes[starts[0] :].tolist():
                want[c] = want.get(c, 0) + x
        assert {c: n for (k, c), n in rows.items() if k == context_tree.GRAM_KIND} == want
        assert most < 60 * size, most / size


def test_cache_is_not_copied_in_a_worker():
    """The arrays of the broadcast are looked into; a worker built 64 MB and two copies beside them."""
    rng = np.random.default_rng(1)
    codes = np.unique(rng.integers(0, 1 << 48, 20_000).astype(np.uint64))
    rng.shuffle(codes)
    logs = -rng.random(len(codes))
    known = context_tree.Cache.of(codes, rng.integers(0, 9, len(codes)), logs)
    asked = np.concatenate([codes[:500], rng.integers(0, 1 << 48, 500).astype(np.uint64)])
    value, hit = known.look(asked)
    of = dict(zip(codes.tolist(), logs.tolist(), strict=True))
    assert hit.tolist() == [c in of for c in asked.tolist()] and value.tolist() == [of.get(c, 0.0) for c in asked.tolist()]
    batch = pa.record_batch([pa.array([1, 2]), pa.array(["aa bb", "cc"])], names=["doc_id", "text"])
    shared = SimpleNamespace(value={"words": np.zeros(0, np.uint64), "logs": np.zeros(0), "grams": known})
    rows, most = peak(lambda: list(context_tree._score(shared)(iter([batch]))))
    assert sum(r.num_rows for r in rows) == 2 and most < 1_000_000


def test_cache_without_grams():
    known = context_tree.Cache.of(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0))
    value, hit = known.look(np.array([1, 2], np.uint64))
    assert not hit.any() and not value.any()
