"""Operators that compare documents, packing, and the pipeline."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from pyspark.sql import functions as F

from lexgrove.llm import bm25, packing, queries, simhash, substring

from . import test_near
from .conftest import SCHEMA, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), seed=42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(prints, distance=2):
    """Root of each fingerprint, by comparing all pairs."""
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    ps = sorted(root)
    for i, a in enumerate(ps):
        for b in ps[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {p: find(p) for p in ps}


def signed(p):
    return p - (1 << 64) if p >> 63 else p


def test_near_copies_of_messy_rows(docs, nothing):
    rows = simhash.groups(docs).collect()
    prints = {d: fingerprint(t) for d, t, *_ in documents()}
    roots = linked(set(prints.values()))
    least = defaultdict(list)
    for d, p in prints.items():
        if d is not None:
            least[roots[p]].append(d)
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.fp, r.component_id) == (signed(prints[r.doc_id]), min(least[roots[prints[r.doc_id]]]))
    assert simhash.groups(nothing).count() == 0


def test_one_of_each_group_stays_with_all_columns(docs):
    kept = simhash.keep_one(docs)
    rows = kept.collect()
    groups = {r.doc_id: r.component_id for r in simhash.groups(docs).collect()}
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in rows) == Counter({c: 1 for d, c in groups.items() if d is not None} | {None: 1})


@pytest.mark.parametrize("bucket_rows", [1, 3, 1000])
def test_links_connect_all_near_pairs_also_in_crowded_buckets(spark, bucket_rows):
    rnd = random.Random(4)
    prints = {rnd.getrandbits(64) for _ in range(150)}
    for center in list(prints)[:4]:
        for _ in range(60):
            prints.add(center ^ sum(1 << b for b in rnd.sample(range(64), rnd.choice([1, 2, 3]))))
    prints |= {0, 1, 3, 1 << 63, (1 << 64) - 1}
    frame = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    found = [(r.u & (1 << 64) - 1, r.v & (1 << 64) - 1) for r in simhash.links(frame, bucket_rows).collect()]
    assert all((u ^ v).bit_count() <= 2 for u, v in found)
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for u, v in found:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    assert {p: find(p) for p in prints} == linked(prints)


def test_links_broadcast_no_exploded_table(spark, monkeypatch):
    """A fingerprint has some 34 probes, of which Spark's sizes know nothing: broadcast, they filled the driver at 0.6 GB."""
    plans, kept = [], simhash.materialise
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(simhash, "materialise", lambda df, label: (plans.append(plan(df)), kept(df, label))[1])
    plans.append(plan(simhash.links(spark.range(100).select(F.xxhash64("id").alias("fp")))))
    assert len(plans) == 2 and all("SortMergeJoin" in p and "Broadcast" not in p for p in plans)


def repeats(rows, length=13):
    words = [(d, WORD.findall(t or "")) for d, t, *_ in rows]
    least = {}
    for d, w in words:
        for i in range(len(w) - length + 1):
            if d is not None:
                k = tuple(w[i : i + length])
                least[k] = min(d, least.get(k, d))
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if d is not None and least[tuple(w[i : i + length])] < d:
                gone[i : i + length] = [True] * length
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize(("batch", "most"), [(8 << 20, 500_000), (2000, 40), (500, 2), (3000, 1)])
def test_repeated_windows_go(docs, nothing, monkeypatch, batch, most):
    monkeypatch.setattr(substring, "BATCH_BYTES", batch)
    monkeypatch.setattr(substring._without, "__defaults__", (most,))
    rows = substring.without_repeats(docs).collect()
    key = lambda x: tuple(str(y) for y in x)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in rows), key=key) == sorted(repeats(documents()), key=key)
    for r in rows:
        assert sum(b - a for a, b in zip(r.removed[::2], r.removed[1::2], strict=True)) == r.n_removed
    assert substring.without_repeats(nothing).count() == 0


def test_repeats_of_short_windows(spark):
    rnd = random.Random(8)
    rows = [(k, " ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 12)))) for k in range(40)]
    got = substring.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=4).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.text) for r in got) == sorted(repeats(rows, 4))


@pytest.mark.parametrize("most", [1, 5, 50, 500])
def test_groups_of_windows_are_bounded(spark, docs, monkeypatch, most):
    """Prefixes are lengthened until each has few windows; all windows but those too many by themselves are in a group."""
    monkeypatch.setattr(substring, "BATCH_BYTES", 1000)
    batches = docs.mapInArrow(substring._packed, substring._ROWS).cache()
    windows = substring._windows(batches, 13).where(f"kind = {substring.WINDOWS}").cache()
    long = substring.long_prefixes(windows, 13, most)
    sent = spark.sparkContext.broadcast(long)
    sizes = [r.n for r in substring._groups(windows, 13, most, sent).groupBy("bucket").agg(F.sum("n").alias("n")).collect()]
    lone = windows.mapInArrow(lambda it: substring._alone(it, 13, sent), "batch long, window int, least long, words binary")
    assert max(sizes, default=0) <= 4 * most and sum(sizes) + lone.count() == windows.agg(F.sum("n")).first()[0]
    assert (most > 5 or len(long[1])) and all(r["count"] > most for r in lone.groupBy("words").count().collect())


@given(st.lists(st.lists(st.integers(0, 3), min_size=5, max_size=5), min_size=1, max_size=60))
def test_trees_have_the_repeats_below_their_deep_nodes(rows):
    rows = np.array(rows, np.int32)
    order, depth = substring.suffix_tree(rows)
    assert [tuple(x) for x in rows[order]] == sorted(map(tuple, rows))
    for a, b, d in zip(rows[order], rows[order][1:], depth, strict=False):
        assert (a[:d] == b[:d]).all() and (d == 5 or a[d] != b[d])
    for least in range(1, 6):
        parts = np.split(rows[order], substring.deep_nodes(depth, least)[1:])
        assert len(parts) == len({tuple(x[:least]) for x in rows}) and all(len({tuple(x[:least]) for x in p}) == 1 for p in parts)


def test_texts_without_repeats_stay_as_they_are(docs):
    kept = substring.drop_repeats(docs)
    assert kept.columns == docs.columns
    lost = {d: (n, t) for d, _, n, t in repeats(documents())}
    for r in kept.collect():
        if r.doc_id is not None:
            before = dict((d, t) for d, t, *_ in documents())[r.doc_id]
            assert r.text == (lost[r.doc_id][1] if lost[r.doc_id][0] else before) and r.Score == 0.5


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=12), st.sampled_from(["norm", "dot"]), st.integers(1, 9), st.integers(2500, 6000))
def test_packing_keeps_every_constraint(histogram, kind, documents_, attention):
    capacity = packing.Capacity(50, documents_, attention)
    runs, total = packing.pack(histogram, capacity, packing.Rule(kind))
    held, placed = defaultdict(list), Counter()
    for length, rank, n, first, offset in runs.tolist():
        for k in range(n):
            held[first + k].append((offset, length))
            placed[length, rank + k] += 1
    assert placed == Counter((length, r) for length, n in histogram.items() for r in range(n)) and len(held) == total
    for items in held.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 50 and len(items) <= documents_ and sum(n * n for _, n in items) <= attention


def test_packing_is_close_to_the_bound():
    rnd = random.Random(3)
    histogram = Counter(rnd.randint(1, 1024) for _ in range(20_000))
    _, total = packing.pack(histogram)
    assert total <= 1.03 * math.ceil(sum(n * c for n, c in histogram.items()) / 1024)
    with pytest.raises(ValueError):
        packing.pack({2000: 1})


def test_ids_equal_the_tokenizers():
    path, theirs = public_tokenizers.path("byte_bpe_50k.tiktoken"), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    from .test_texts import fuzz

    for t in fuzz():
        assert packing.encode(t, path).tolist() == theirs.encode(t, add_special_tokens=False).ids + [2], ascii(t)


def test_long_texts_are_encoded_in_parts(monkeypatch):
    path, text = public_tokenizers.path("byte_bpe_50k.tiktoken"), " ".join(t for _, t, *_ in documents() if t)
    whole = packing.encode(text, path).tolist()
    monkeypatch.setattr(packing, "PART_CHARS", 50)
    assert packing.encode(text, path).tolist() == whole


def check_packed(rows, texts):
    """texts: doc_id -> texts of its rows."""
    theirs = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: np.array(theirs.encode(t[0] or "", add_special_tokens=False).ids + [2], "<u4") for d, t in texts.items()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for d, rs in by_doc.items():
        n, copies = len(ids[d]), len(texts[d])
        first = n % 1024 or 1024
        cuts = [0, *range(first, n + 1, 1024)] if n > 1024 else [0, n]
        expected = [(k, a, b - a, zlib.crc32(ids[d][a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rs) == sorted(expected * copies)
    for rs in by_sequence.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    return len(by_sequence), sum(r.length for r in rows)


def test_packing_of_messy_rows(docs, nothing):
    texts = defaultdict(list)
    for d, t, *_ in documents():
        texts[d].append(t)
    sequences, tokens = check_packed(packing.best_fit(docs).collect(), texts)
    assert sequences <= 1.1 * tokens / 1024 + 1 and packing.best_fit(nothing).count() == 0


def ranked(rows, ids, k):
    words = [(d, Counter(re.findall(r"[^\W_]+", (t or "").lower()))) for d, t in rows if d is not None]
    n, average = len(words), sum(sum(c.values()) for _, c in words) / max(1, len(words)) or 1
    df = Counter(w for _, c in words for w in c)
    out = {}
    for q, asked in words:
        if q in ids:
            s = []
            for d, c in words:
                x = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * sum(c.values()) / average)) for w in asked if w in c)
                if x > 0:
                    s.append((-round(x, 6), d))
            out[q] = [(d, -x) for x, d in sorted(s)[:k]]
    return out


@pytest.mark.parametrize(("shard", "block", "cells", "dense"), [(32 << 20, 64, 1 << 21, 1 / 16), (600, 4, 50, 0), (600, 4, 50, 0.4), (32 << 20, 16, 50, 1)])
def test_top_k_is_exact(spark, docs, nothing, monkeypatch, shard, block, cells, dense):
    monkeypatch.setattr(bm25, "DENSE_SHARE", dense)
    monkeypatch.setattr(bm25, "SHARD_BYTES", shard)
    monkeypatch.setattr(bm25, "BLOCK_DOCS", block)
    monkeypatch.setattr(bm25, "CELLS", cells)
    monkeypatch.setattr(bm25, "ENTRIES", cells)
    monkeypatch.setattr(bm25, "POSTINGS", 40)
    rows = [(d, t) for d, t, *_ in documents()][:-3]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    monkeypatch.setattr(bm25, "QUERY_BLOCK", 7)
    ids = {d for d, _ in rows if d % 2 == 0}
    got = defaultdict(list)
    for r in bm25.top_k(frame, frame.where("doc_id % 2 = 0"), 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.doc_id, r.score))
    expected = {q: x for q, x in ranked(rows, ids, 5).items() if x}
    assert set(got) == set(expected)
    for q, x in expected.items():
        assert [d for d, _ in got[q]] == [d for d, _ in x] and np.allclose([s for _, s in got[q]], [s for _, s in x], atol=2e-6)
    assert bm25.top_k(docs, nothing).count() == 0 and bm25.top_k(nothing, docs).count() == 0 and bm25.top_k(docs, docs).count() > 0


def shard_row(texts):
    """One row of the index, made without Spark."""
    class Context:
        partitionId = staticmethod(lambda: 0)

    bm25.TaskContext, kept = type("T", (), {"get": staticmethod(Context)}), bm25.TaskContext
    try:
        return next(bm25._shards(iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])]), 1 << 40, 1 << 40)).to_pylist()[0]
    finally:
        bm25.TaskContext = kept


def test_blocks_are_passed_over_and_results_stay_exact():
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9))) + (f" rare{k % 900}" if k % 3 == 0 else "") for k in range(6000)]
    row = shard_row(texts)
    lists = [np.unique(bm25.terms(t)) for t in ("a rare3 rare33", "b c rare600", "h", "", "nowhere")]
    distinct, numbers = np.unique(np.concatenate(lists), return_inverse=True)
    shard = bm25._Shard(row)
    place = shard.places(distinct)
    df = np.where(place >= 0, np.diff(shard.starts)[place], 0)
    q = bm25._Queries(np.arange(len(lists)), distinct, np.cumsum([0, *map(len, lists)]), numbers, bm25.Bm25().idf(len(texts), df), shard.lengths.mean())
    counted = {}
    query, doc, score = bm25.search(row, q, 5, bm25.Bm25(), counted)
    assert counted["passed"] > 2 * counted["scored"] > 0
    norm = 1.5 * (0.25 + 0.75 * shard.lengths / q.average)
    for number, terms in enumerate(lists):
        full = np.zeros(len(texts))
        for t in terms:
            p = shard.places(np.array([t]))[0]
            if p >= 0:
                at = slice(shard.starts[p], shard.starts[p + 1])
                full[shard.docs[at]] += q.idf[np.searchsorted(distinct, t)] * shard.tf[at] * 2.5 / (shard.tf[at] + norm[shard.docs[at]])
        full = np.round(full, 6)
        top = [d for d in np.lexsort((np.arange(len(texts)), -full))[:5].tolist() if full[d] > 0]
        mine = query == number
        assert sorted(doc[mine].tolist()) == sorted(top) and np.allclose(sorted(score[mine]), sorted(full[top]), atol=2e-6)


def test_rare_terms_of_different_documents_are_no_bound():
    """A block where each document has one of a query's rare terms isn't scored once a document with all of them is known, here or in another shard."""
    texts = [" ".join(f"r{k}" for k in range(40)), *(f"r{k % 40} of {k}" for k in range(4000))]
    row, terms = shard_row(texts), np.unique(bm25.terms(texts[0]))
    shard = bm25._Shard(row)
    q = bm25._Queries(np.array([7]), terms, np.array([0, 40]), np.arange(40), bm25.Bm25().idf(len(texts), np.diff(shard.starts)[shard.places(terms)]), shard.lengths.mean())
    counted = {}
    query, doc, score = bm25.search(row, q, 1, bm25.Bm25(), counted)
    assert doc.tolist() == [0] and counted == {"scored": 1, "passed": -(-len(texts) // bm25.BLOCK_DOCS) - 1}
    assert bm25.search(row, q, 1, bm25.Bm25(), None, score)[1].tolist() == [0]
    assert bm25.search(row, q, 1, bm25.Bm25(), (counted := {}), score + 1)[1].tolist() == [] and counted["scored"] == 0


@pytest.mark.parametrize("first", [1, 3, 10])
def test_thresholds_of_the_first_shards_lose_nothing(spark, monkeypatch, first):
    monkeypatch.setattr(bm25, "_first_shards", lambda shards: sorted(r["shard"] for r in shards.collect())[:first])
    monkeypatch.setattr(bm25, "SHARD_BYTES", 600)
    rows = [(d, t) for d, t, *_ in documents()][:-3]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = defaultdict(list)
    for r in bm25.top_k(frame, frame, 3).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.doc_id)
    assert got == {q: [d for d, _ in x] for q, x in ranked(rows, {d for d, _ in rows}, 3).items() if x}


def test_many_empty_texts_are_many_shards(spark):
    empty = spark.range(200_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "").alias("text")).coalesce(1)
    shards = [r.n_docs for r in bm25.index(empty).select("n_docs").collect()]
    assert max(shards) <= bm25.SHARD_DOCS and sum(shards) == 200_000
    some = empty.union(spark.createDataFrame([(-1, "only one text")], "doc_id long, text string"))
    assert [(r.query_id, r.doc_id) for r in bm25.top_k(some, some.where("doc_id < 2")).collect()] == [(-1, -1)]


SF = "/root/testdata/sf0.001"


def test_registered_queries_match_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op2_substring_dedup(spark, SF).collect()}
    assert got == {d: (n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in repeats(rows)}
    prints = {d: fingerprint(t) for d, t in rows}
    roots, least = linked(set(prints.values())), defaultdict(list)
    for d, p in prints.items():
        least[roots[p]].append(d)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op9_simhash_neardup(spark, SF).collect()}
    assert got == {d: (f"{p:016x}", min(least[roots[p]])) for d, p in prints.items()}
    check_packed(queries.op4_best_fit_packing(spark, SF).collect(), {d: [t] for d, t in rows})
    ids = {d for d, _ in rows if d % 100 == 0}
    got = defaultdict(list)
    for r in queries.op8_bm25_topk(spark, SF).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.doc_id)
    assert got == {q: [d for d, _ in x] for q, x in ranked(rows, ids, 10).items()}


def test_all_registered_queries_give_a_row_for_each_row(spark):
    documents_, pages = (spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("documents", "pages"))
    for name in ("op1_license_scan", "op3_sentencepiece", "op5_toxicity", "op6_token_counts", "op10_media_columns", "op11_minhash_neardup", "op12_periodic_runs"):
        assert queries.QUERIES[name](spark, SF).count() == documents_
    assert queries.QUERIES["op7_html_extract"](spark, SF).count() == pages and len(queries.QUERIES) == 13


def test_pipeline(spark):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    docs, sizes = source, []
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        out = corpus_pipeline.materialise(stage(spark, docs, SF), name)
        if name != "packing":
            assert out.columns == source.columns and out.schema == source.schema
            after = {r.doc_id: r.text for r in out.select("doc_id", "text").collect()}
            if name == "substring":
                lost = {d: (n, t) for d, _, n, t in repeats(list(before.items()))}
                assert after == {d: lost[d][1] if lost[d][0] else t for d, t in before.items()}
            else:
                assert all(before[d] == t for d, t in after.items())
            if name == "simhash":
                assert sorted(after) == test_near.kept(list(before.items()))
        else:
            check_packed(out.collect(), {d: [t] for d, t in before.items()})
        docs = out
        sizes.append(out.count())
    assert corpus_pipeline.run(spark, SF).count() == sizes[-1]


def test_pipeline_of_messy_rows(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3 * k, 1, int(k % 7 == 0)) for k in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/empty/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/empty/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
