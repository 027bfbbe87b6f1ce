"""The incremental index: after any batches and merges it is what a rebuild gives."""

import random

import pytest
from pyspark.sql import functions as F

from lexgrove.operators import index, retrieve, segments

CHUNKS = "chunk_id string, file string, heading string, text string"


def chunks_of(files):
    return [(f"{f}#{k}", f, "h", t) for f, texts in files.items() for k, t in enumerate(texts)]


def rows(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


def check(spark, store, files):
    chunks = spark.createDataFrame(chunks_of(files), CHUNKS)
    posts = index.postings(chunks)
    assert rows(store.live("postings"), "chunk_id", "term", "tf", "n_tokens") == rows(posts, "chunk_id", "term", "tf", "n_tokens")
    assert rows(store.live("chunks"), "chunk_id", "file", "text") == rows(chunks, "chunk_id", "file", "text")
    assert rows(store.live("lengths"), "chunk_id", "n_tokens") == rows(index.lengths(chunks), "chunk_id", "n_tokens")
    assert rows(store.document_frequency(), "term", "df") == rows(index.document_frequency(posts), "term", "df")
    assert rows(store.statistics(), "n_chunks", "n_tokens") == rows(index.corpus_statistics(index.lengths(chunks)), "n_chunks", "n_tokens")
    assert {r.file for r in store.files().collect()} == set(files)
    asked = spark.createDataFrame([(1, "red fox"), (2, "blue of the 17")], "qid long, question string")
    full = retrieve.bm25(posts, index.corpus_statistics(index.lengths(chunks)), index.document_frequency(posts), asked)
    assert rows(retrieve.bm25(*segments.bm25_inputs(store), asked), "qid", "chunk_id", "bm25") == rows(full, "qid", "chunk_id", "bm25")


@pytest.mark.parametrize("seed", [1])
def test_equals_a_rebuild(spark, tmp_path, seed):
    rnd = random.Random(seed)
    text = lambda: " ".join(rnd.choice(["red", "fox", "blue", "17", "the", "seen-by", "Foxes"]) for _ in range(rnd.randint(0, 8)))
    store, files, before = segments.Segments(spark, str(tmp_path / "i")), {}, set()
    with pytest.raises(LookupError):
        store.live("postings")
    for _ in range(7):
        batch, changed = [], {}
        for f in rnd.sample([f"f{k}" for k in range(12)], 4):
            if f in files and rnd.random() < 0.3:
                batch.append((f, None))
                del files[f]
            else:
                files[f] = changed[f] = files[f] if f in files and rnd.random() < 0.3 else [text() for _ in range(rnd.randint(0, 3))]
                batch.append((f, repr(changed[f])))
        store.apply(spark.createDataFrame(batch, "file string, sha256 string"), spark.createDataFrame(chunks_of(changed), CHUNKS))
        before |= {s["name"] for s in store._manifest()[1]}
    assert len(store._manifest()[1]) < len(before)  # some were merged
    check(spark, store, files)
    now = {s["name"] for s in store._manifest()[1]}
    assert set(store.vacuum()) >= before - now and store.vacuum() == []
    version, all_ = store._manifest()
    store.merge(version, [(s["name"], s["seg"], s["postings"]) for s in all_], [(s["name"], s["seg"], s["postings"]) for s in all_])
    assert len(store._manifest()[1]) == 1
    check(spark, store, files)
    assert store.apply(spark.createDataFrame([("f99", None), *((f, repr(t)) for f, t in files.items())], "file string, sha256 string"), spark.createDataFrame(chunks_of(files), CHUNKS)) == 0


def test_unchanged_texts_are_not_read(spark, tmp_path):
    """A batch with a chunk whose text can't be read fails, unless its file is as stored."""
    store = segments.Segments(spark, str(tmp_path / "i"))
    some = spark.createDataFrame(chunks_of({"a": ["red"], "b": ["fox"]}), CHUNKS)
    hashes = lambda *h: spark.createDataFrame(list(h), "file string, sha256 string")
    assert store.apply(hashes(("a", "1"), ("b", "1")), some) == 2
    broken = some.withColumn("text", F.when(F.col("file") == "a", F.raise_error(F.lit("read"))).otherwise(F.lit("blue")))
    assert store.apply(hashes(("a", "1"), ("b", "2")), broken) == 1
    assert rows(store.live("chunks"), "file", "text") == [("a", "red"), ("b", "blue")]
