"""Operator 1: secret scans.

Three fixed patterns give the base spans. The method adds spans: over candidate strings of a
character class a window slides, its character counts change by one in and one out, and with
them the sum of c*log2(c), so that the Shannon entropy of each window costs O(1). Windows at
or above the class's threshold merge into spans; an allow-list of well-known harmless strings
suppresses the spans of which too little is left outside its matches.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs [0-9a-f]+ of 24 or more
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex")

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long"
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")


@dataclass(frozen=True)
class CharClass:
    """``needs``: patterns of which each must occur in a span."""

    name: str
    run: re.Pattern
    window: int
    bits: float
    needs: tuple[re.Pattern, ...]


_DIGIT, _LOWER, _UPPER = re.compile(r"[0-9]"), re.compile(r"[a-z]"), re.compile(r"[A-Z]")
CLASSES = (
    CharClass("entropy_hex", re.compile(r"(?<![A-Za-z0-9])(?:[0-9a-f]{20,}|[0-9A-F]{20,})(?![A-Za-z0-9])"), 20, 3.0, (_DIGIT, re.compile(r"[A-Fa-f]"))),
    CharClass("entropy_alnum", re.compile(r"[a-z0-9]{20,}|[A-Z0-9]{20,}"), 20, 3.6, (re.compile(r"[0-9].*[0-9].*[0-9]"), re.compile(r"[A-Za-z]"))),
    CharClass("entropy_base64", re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 20, 3.9, (_DIGIT, _LOWER, _UPPER)),
)
#: Harmless strings: UUIDs, dates, counting sequences, placeholders, subresource digests, paths of words.
ALLOW = (
    re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),
    re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}"),
    re.compile(r"0123456789|abcdefghij|ABCDEFGHIJ"),
    re.compile(r"^sha(?:1|256|384|512)-[A-Za-z0-9+/]+=*"),
    re.compile(r"^/?(?:[A-Za-z]+|[0-9]{1,6})(?:[/_=-]+(?:[A-Za-z]+|[0-9]{1,6}))*[/_=-]*$"),
)

#: A placeholder stands for all of its part between slashes and equals signs.
PLACEHOLDER, PARTS = re.compile(r"(?i)example|placeholder|dummy|changeme|your[_-]|xxxxxx|test[_-]?key"), re.compile(r"[^/=]+")


def high_windows(s: str, window: int, bits: float) -> list[tuple[int, int]]:
    """Merged spans of the windows of ``s`` whose Shannon entropy is at least ``bits``."""
    if len(s) < window:
        return []
    nlog = [0.0] + [c * math.log2(c) for c in range(1, window + 2)]  # one more is in before one goes out
    most = window * (math.log2(window) - bits) + 1e-9  # entropy >= bits: sum of c*log2(c) <= most
    counts: dict[str, int] = {}
    total, spans = 0.0, []
    for i, ch in enumerate(s):
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += nlog[c + 1] - nlog[c]
        if i >= window:
            old = s[i - window]
            c = counts[old]
            counts[old] = c - 1
            total += nlog[c - 1] - nlog[c]
        if i >= window - 1 and total <= most:
            if spans and i - window + 1 <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((i - window + 1, i + 1))
    return spans


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def _allowed(s: str) -> list[tuple[int, int]]:
    """Where the allow-list matches in a candidate."""
    out = [m.span() for p in ALLOW for m in p.finditer(s)]
    if PLACEHOLDER.search(s):
        out += [m.span() for m in PARTS.finditer(s) if PLACEHOLDER.search(m.group())]
    return out


class Spans:
    """Spans by start, with the furthest end up to each: what touches a place is found by bisection."""

    def __init__(self, spans: list[tuple]):
        self.spans = sorted(spans)
        self.starts = [x[0] for x in self.spans]
        self.ends = list(accumulate((x[1] for x in self.spans), max))

    def hold(self, a: int, b: int) -> bool:
        """Whether one of them holds all of a .. b."""
        n = bisect_right(self.starts, a)
        return n > 0 and self.ends[n - 1] >= b

    def touching(self, a: int, b: int) -> list[tuple]:
        """Those that may overlap a .. b, in order."""
        return self.spans[bisect_right(self.ends, a) : bisect_left(self.starts, b)]


def _rest(s: str, a: int, b: int, allowed: Spans) -> str:
    """``s[a:b]`` without the allowed places."""
    out = []
    for x, y in allowed.touching(a, b):
        if a < y and x < b:
            out.append(s[a:x] if x > a else "")
            a = max(a, min(y, b))
    return "".join(out) + s[a:b]


def entropy_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans that the entropy windows find, first class first; a span inside another is dropped.

    Spans of one class don't overlap, nor do those of two candidates, so a span is only compared
    with the earlier classes' spans of its own candidate.
    """
    out: list[tuple[int, int, str]] = []
    for cand in CANDIDATE.finditer(text):
        s = cand.group()
        if not _DIGIT.search(s):
            continue
        allowed, own = Spans(_allowed(s)), []
        for kind in CLASSES:
            before, found = Spans(own), []
            for run in kind.run.finditer(s):
                for a, b in high_windows(run.group(), kind.window, kind.bits):
                    a, b = run.start() + a, run.start() + b
                    rest = _rest(s, a, b, allowed)
                    if len(rest) < kind.window and 2 * len(rest) <= b - a:
                        continue
                    if all(p.search(rest) for p in kind.needs) and not before.hold(a, b):
                        found.append((a, b, kind.name))
            own += found
        out += [(cand.start() + a, cand.start() + b, name) for a, b, name in own]
    return out


def scan_text(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and the spans that the method adds (none inside a base span)."""
    text = text or ""
    base = base_spans(text)
    covered = Spans(base)
    return base, [x for x in entropy_spans(text) if not covered.hold(x[0], x[1])]


def _join(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    order = {k: i for i, k in enumerate((*KINDS, *(c.name for c in CLASSES)))}
    for b in slices(batches):
        cols: list[list] = [[] for _ in range(6)]
        for text in b.column(1).to_pylist():
            base, added = scan_text(text)
            kinds = [x[2] for x in base]
            for col, v in zip(cols, (kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(_join(base).encode()).hexdigest(), _join(sorted([*base, *added], key=lambda x: (x[0], order[x[2]]))), len(added)), strict=True):
                col.append(v)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs (doc_id, text, ...)``: counts, digest and spans of its secrets.

    Null and empty texts have no spans; texts of any length are scanned whole; a null doc_id stays
    null; repeated rows give repeated rows; base spans win over added ones at the same place; other columns are ignored; an empty table gives an empty result. Offsets are code
    points, ends exclusive; all spans are sorted by start, base kinds before added ones.
    """
    return docs.select("doc_id", "text").mapInArrow(_scan, SCHEMA)
