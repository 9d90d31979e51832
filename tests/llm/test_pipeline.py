"""The corpus pipeline end to end: planted cases, nulls, repeats, clashing names, empty tables."""

import random
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from sessionloom.llm import mixing, near_dup
from sessionloom.llm.queries import tokenizer_path

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ", row_id long, m_doc string, score double, near_key int, copies int, draw int, Doc_Key int"
SYLLABLES = ["ba", "ko", "ri", "tu", "me", "sal", "ven", "dor", "pli", "qua", "zen", "hof"]


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(2, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def world(tmp_path_factory, spark):
    """Tables on disk: clean documents, toxic ones, copies, near copies, benchmark passages, odd rows."""
    rng = random.Random(11)
    docs, labels, bench, kinds = [], [], [], {}

    def add(text, kind, source="s1"):
        i = len(docs)
        docs.append((i, text, "xx", source, len(text or "")))
        kinds[i] = kind
        return i

    for i in range(300):
        toxic = i % 6 == 0
        words = prose(rng, 50).split()
        if toxic:
            for w in ("blargface", "snotgoblin"):
                words.insert(rng.randrange(50), w if i % 12 else w.replace("a", "@").replace("o", "0"))
        labels.append((add(" ".join(words), "toxic" if toxic else "clean", f"s{i % 4}"), 0, int(toxic)))
    base = [prose(rng, 60) for _ in range(3)]
    for text in base:
        add(text, "first")
        for _ in range(4):
            add(text, "copy", "s2")
        add(text + " one more", "copy", "s3")
    for i in range(4):
        item = f"{prose(rng, 12)}. {prose(rng, 5)}."
        bench.append((i, item))
        add(f"{prose(rng, 60)} {item} {prose(rng, 40)}", "leak")
    plain = prose(rng, 30).split()
    for text, source in ((None, "s1"), ("", "s1"), ("x", None), ("  ", None), (" ".join(rng.choice(plain) for _ in range(30_000)), "s0")):
        add(text, "odd", source)
    extra = [(7, "text", 0.5, 3, 4, 5, 6)]
    rows = [r + extra[0] for r in docs]
    rows += [(None, prose(rng, 20), "xx", "s1", 9) + extra[0], rows[1], rows[1]]
    folder = tmp_path_factory.mktemp("world")
    spark.createDataFrame(rows, COLUMNS + CLASHING).repartition(5).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    return str(folder), kinds


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages(world, spark):
    folder, kinds = world
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    everyone = ids(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, corpus_pipeline.stored(stage(spark, docs, folder), name)
        assert docs.columns == before.columns
        gone = everyone - ids(docs)
        odd = {i for i, k in kinds.items() if k == "odd"} | {None}
        if name == "toxicity":
            assert {kinds[i] for i in gone} == {"toxic"}, {i: kinds[i] for i in gone if kinds[i] != "toxic"}
            assert sum(gone.values()) == sum(k == "toxic" for k in kinds.values())
        elif name == "near_duplicates":
            assert all(everyone[i] - gone[i] == 1 for i, k in kinds.items() if k in ("first", "clean"))
            assert all(gone[i] for i, k in kinds.items() if k == "copy") and not odd & set(gone)
        elif name == "decontamination":
            assert all(gone[i] for i, k in kinds.items() if k == "leak") and not odd & set(gone)
        else:  # the mix: as the operator says for its own input
            want = Counter()
            for r in mixing.mix_sources(before).collect():
                want[r["doc_id"]] += r["copies"]
            assert ids(docs) == +want
    out = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert Counter(r["doc_id"] for r in out) == ids(docs)

    from tokenizers import Tokenizer

    import numpy as np

    lib, text, at = Tokenizer.from_file(tokenizer_path()), {r["doc_id"]: r["text"] for r in docs.collect()}, 0
    for r in sorted(out, key=lambda r: r["start"]):
        x = [*lib.encode(text[r["doc_id"]] or "", add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
        at += len(x)


def test_run_is_the_stages(world, spark):
    """``run`` gives what the stages give one after another, and the same again."""
    folder, _ = world
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, folder), name)
    key = lambda df: sorted((r["start"], r["doc_id"] or -1, r["ids_crc32"]) for r in df.collect())
    assert key(corpus_pipeline.run(spark, folder)) == key(docs)


def test_empty_tables(world, spark, tmp_path):
    folder, _ = world
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).count() == docs.count()  # no labels: nothing is toxic
    assert corpus_pipeline.drop_benchmark(spark, docs, str(tmp_path)).count() == docs.count()


def test_near_duplicate_stage_takes_five_words():
    assert corpus_pipeline.SHINGLE == 5 and corpus_pipeline.SIMILARITY == (80, 100) and near_dup.keep_one.__defaults__[0] == 5
