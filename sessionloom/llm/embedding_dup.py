"""Operator 8: near-duplicate vectors by lattice hashing.

Each table projects the unit vectors on eight random directions, scales, shifts and decodes the
point to the nearest point of the lattice E8 (the better of its two cosets D8 and D8 + 1/2).
A vector is at home in its own cell and a guest in the neighbouring cells nearest to its
residual; two vectors are compared if one is at home where the other is at home or a guest, in
any table. Cosines are computed exactly, in double precision.

Equal vectors of one label collapse first. A large cell is cut into blocks, and each pair of
blocks is a comparison of its own, so neither a cell nor its pairs meet in one place; tasks return
only counts of links and a spanning forest of them, never the pairs. A pair counts in one cell
alone: that of the first table which brings the two together (of two such cells of one table,
the one with the smaller key).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, mixed, shuffle_partitions, stored

TABLES, PROBES = 8, 2
#: Lattice units for a distance of 1 between unit vectors. At cosine 0.98 (distance 0.2) a
#: projection moves by about 0.2 * SCALE * sqrt(8 / 64) units; measured: no pair at cosine 0.98 of
#: 3,000 missed in 16 or 64 dimensions, and 0.3 % of random pairs compared.
SCALE = 8.0
#: Vectors in a block; a task holds two blocks, and the cosines of ROWS rows at once.
BLOCK, ROWS = 2048, 256
SEED = 11


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with integer coordinates and an even sum."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(1) % 2 != 0)
    d = x[odd] - r[odd]
    worst = np.abs(d).argmax(1)
    r[odd, worst] += np.where(d[np.arange(len(odd)), worst] >= 0, 1, -1)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points (doubled coordinates, so integers) of the rows of ``x``."""
    a, b = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return np.where(closer[:, None], 2 * a, 2 * b).astype(np.int64)


def e8_roots() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled: +-2 +-2 in two places, or all +-1 with an even number of minuses."""
    out = []
    for i in range(8):
        for j in range(i):
            for s in (2, -2):
                for t in (2, -2):
                    v = np.zeros(8, np.int64)
                    v[i], v[j] = s, t
                    out.append(v)
    for m in range(256):
        signs = np.array([-1 if m >> i & 1 else 1 for i in range(8)])
        if (signs == -1).sum() % 2 == 0:
            out.append(signs)
    return np.array(out)


def cell_keys(unit: np.ndarray, label: np.ndarray, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE) -> np.ndarray:
    """(vectors, tables, 1 + probes) hashes of each vector's own cell, then the neighbouring ones."""
    n, dims = unit.shape
    rng, roots = np.random.default_rng(SEED), e8_roots()
    keys = np.zeros((n, tables, 1 + probes), np.uint64)
    for table in range(tables):
        basis = np.linalg.qr(rng.standard_normal((max(dims, 8), 8)))[0][:dims] * scale
        x = unit @ basis * np.sqrt(max(dims, 8) / 8 / 8) + rng.random(8) * 2
        cell = nearest_e8(x)
        residual = 2 * x - cell
        nearer = np.argsort(-(residual @ roots.T), axis=1, kind="stable")[:, :probes]
        for i, c in enumerate((cell, *(cell + roots[nearer[:, p]] for p in range(probes)))):
            h = np.full(n, np.uint64(table + 1)) * np.uint64(0x9E3779B97F4A7C15) + label.astype(np.int64).view(np.uint64)
            for d in range(8):
                h = h * np.uint64(0xC2B2AE3D27D4EB4F) + c[:, d].view(np.uint64)
            keys[:, table, i] = mixed(h + np.uint64(dims))
    return keys


def _units(vectors: np.ndarray) -> np.ndarray:
    v = vectors / np.abs(vectors).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``keys``: the own and neighbouring cells of all tables, one after another."""
    for b in batches:
        vectors, labels = b.column(1), b.column(2).to_numpy()
        sizes = np.asarray(pc.list_value_length(vectors))
        keys = np.zeros((b.num_rows, TABLES * (1 + PROBES)), np.uint64)
        for dims in np.unique(sizes):
            at = np.flatnonzero(sizes == dims)
            part = vectors.take(pa.array(at)).flatten().to_numpy().reshape(-1, dims).astype(np.float64)
            keys[at] = cell_keys(_units(part), labels[at]).reshape(len(at), -1)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.view(np.int64).ravel()))
        yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*b.schema.names, "keys"])


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For links a-b among rows 0 .. n-1, each row's smallest reachable row."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        best = root.copy()
        np.minimum.at(best, a, least)
        np.minimum.at(best, b, least)
        best = best[best]
        if (best == root).all():
            return root
        root = best


def _meet(own: np.ndarray, other: np.ndarray, table: int) -> np.ndarray:
    """Whether two vectors (rows of keys) meet in a table: one's own cell is the other's own or neighbouring cell."""
    x, y = own[:, table], other[:, table]
    met = x[:, 0] == y[:, 0]
    for p in range(1, x.shape[1]):
        met |= (x[:, 0] == y[:, p]) | (x[:, p] == y[:, 0])
    return met


def _links(cosine: float, key: int, table: int, same: bool, unit: np.ndarray, keys: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (as rows) of one group that count here: no earlier table has brought the two
    together, and of two cells of this table that both would do, this one has the smaller key."""
    left, right = (np.arange(len(unit)),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo in range(0, len(left), ROWS):
        rows = left[lo : lo + ROWS]
        linked = unit[rows] @ unit[right].T >= cosine
        if same:
            linked &= rows[:, None] < right[None, :]
        i, j = np.nonzero(linked)
        a, b = rows[i], right[j]
        for t in range(table):
            if not len(a):
                break
            new = ~_meet(keys[a], keys[b], t)
            a, b = a[new], b[new]
        if not same and len(a):  # a is at home here and b is not; a may be b's guest elsewhere
            home = keys[b, table, 0]
            twice = (home != key) & (keys[a, table, 1:] == home[:, None]).any(1) & (home < key)
            a, b = a[~twice], b[~twice]
        out_a.append(a)
        out_b.append(b)
    return np.concatenate(out_a), np.concatenate(out_b)


_GROUP = ("key", "lo", "hi")


def _compare(cosine: float):
    """Groups (cell, pair of blocks) come sorted, one after another; a group of more rows than two
    blocks doesn't exist. Returns each vector's counted links and its smallest vector reached."""

    def group(c: dict[str, np.ndarray], lo: int, hi: int) -> tuple | None:
        order = lo + np.argsort(c["rep"][lo:hi], kind="stable")
        side, rep, mult = c["side"][order], c["rep"][order], c["mult"][order]
        same = c["lo"][lo] == c["hi"][lo]
        if not same and (side == side[0]).all():
            return None
        unit = np.stack([c["embedding"][i] for i in order]).astype(np.float64)
        a, b = _links(cosine, c["key"][lo], int(c["tab"][lo]), same, _units(unit), c["keys"][order], side)
        if not len(a):
            return None
        n = np.bincount(a, mult[b], len(order)) + np.bincount(b, mult[a], len(order))
        some = np.flatnonzero(n > 0)
        return rep[some], n[some].astype(np.int64), rep[_roots(len(order), a, b)[some]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            c = {n: b.column(n).to_numpy(zero_copy_only=False) for n in ("lo", "hi", "side", "tab", "rep", "mult", "embedding")}
            c["key"] = b.column("key").to_numpy().view(np.uint64)
            c["keys"] = b.column("keys").flatten().to_numpy().view(np.uint64).reshape(b.num_rows, TABLES, 1 + PROBES)
            if held is not None:
                c = {n: np.concatenate([held[n], c[n]]) for n in c}
            new = np.zeros(len(c["key"]), bool)
            for n in _GROUP:
                new[1:] |= c[n][1:] != c[n][:-1]
            cuts = np.append(0, np.flatnonzero(new))
            found = [x for lo, hi in zip(cuts[:-1], cuts[1:], strict=True) if hi - lo > 1 and (x := group(c, lo, hi))]
            held = {n: x[cuts[-1] :] for n, x in c.items()}  # the last group may go on
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["rep", "n", "up"])
        if held is not None and len(held["key"]) > 1 and (x := group(held, 0, len(held["key"]))):
            yield pa.RecordBatch.from_arrays([pa.array(y) for y in x], names=["rep", "n", "up"])

    return run


def _tasks(reps: DataFrame, block: int) -> DataFrame:
    """``key, tab, lo, hi, side, rep``: which vectors each comparison of a cell's blocks holds.

    A cell's own vectors (at home) are compared with each other and with its guests, the vectors
    of neighbouring cells. Blocks of the former are numbered from 0, of the latter from -1 down.
    """
    width = 1 + PROBES
    cells = reps.select("rep", F.posexplode("keys").alias("i", "key"))
    cells = cells.select("rep", "key", F.floor(F.col("i") / width).cast("int").alias("tab"), (F.col("i") % width == 0).alias("home"))
    sizes = cells.groupBy("key").agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("guests")).where("homes > 0 and homes + guests > 1")
    placed = stored(cells.join(sizes, "key"), "vec-cells")
    count = lambda c: F.ceil(F.col(c) / block).cast("int")
    mine = lambda n: F.pmod(F.xxhash64("rep"), F.greatest(count(n), F.lit(1))).cast("int")
    homes = placed.where("home").withColumn("mine", mine("homes"))
    upto = lambda c: F.explode(F.sequence(F.lit(0), count(c) - 1))
    lo, hi = F.least("mine", "other"), F.greatest("mine", "other")
    among = homes.where("homes > 1").withColumn("other", upto("homes"))
    among = among.select("key", "tab", lo.alias("lo"), hi.alias("hi"), F.when(F.col("mine") == lo, 0).otherwise(1).alias("side"), "rep")
    hosts = homes.where("guests > 0").withColumn("other", upto("guests")).select("key", "tab", F.col("mine").alias("lo"), (-1 - F.col("other")).alias("hi"), F.lit(0).alias("side"), "rep")
    guests = placed.where("not home").withColumn("other", upto("homes")).select("key", "tab", F.col("other").alias("lo"), (-1 - mine("guests")).alias("hi"), F.lit(1).alias("side"), "rep")
    return among.unionByName(hosts).unionByName(guests)


def near_duplicate_vectors(rows: DataFrame, cosine: float = 0.98, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``rows (vec_id, embedding, label, ...)``.

    Vectors are compared when their labels are equal and not null and their lengths are equal.
    Null, empty or zero vectors and those with null or non-finite components, and rows with a
    null vec_id, link with nothing (n_links 0, component_id = vec_id). Equal vectors are linked
    with each other; rows that repeat a vec_id are vectors of their own under one name, with a row each;
    extra columns are ignored; an empty table gives an empty result.
    """
    kind = "array<float>" if dict(rows.dtypes)["embedding"] == "array<float>" else "array<double>"  # floats travel as such
    rows = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast(kind), F.col("label").cast("long"))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce(good & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    # -0.0 equals 0.0, so both become 0.0 before equal vectors are grouped.
    clean = rows.where(good).withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)).cast(kind))
    clean = clean.withColumn("digest", F.sha2(F.to_json(F.struct("label", "embedding")), 256))
    reps = clean.groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"), F.any_value("embedding").alias("embedding"), F.any_value("label").alias("label"))
    filed = reps.select("rep", "embedding", "label", "mult", "digest").mapInArrow(_file, f"rep long, embedding {kind}, label long, mult long, digest string, keys array<long>")
    reps = stored(filed, "vec-reps")
    tasks = _tasks(reps, block).join(reps.select("rep", "mult", "embedding", "keys"), "rep")
    tasks = tasks.repartition(shuffle_partitions(rows.sparkSession), *_GROUP).sortWithinPartitions(*_GROUP)
    found = stored(tasks.mapInArrow(_compare(cosine), "rep long, n long, up long"), "vec-found")
    links = found.groupBy("rep").agg(F.sum("n").alias("n"))
    parts = components(found.where("rep <> up").select(F.col("rep").alias("a"), F.col("up").alias("b")), "vec").withColumnRenamed("node", "rep")
    of = reps.select("digest", "rep", "mult").join(links, "rep", "left").join(parts, "rep", "left")
    of = stored(of.select("digest", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")), "vec-of")
    named = clean.select("vec_id", "digest").join(of, "digest").select("vec_id", "n_links", F.col("component").alias("component_id"))
    alone = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return named.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
