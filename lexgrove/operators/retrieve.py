"""Ranked retrieval for batches of questions: BM25, cosine, fusion, quotas, rescues, and the gate before generation.

Rankings have a total order: rounded score, then corpus_pos. Everything is set-based over (qid, chunk_id).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import keep, parts
from . import index as I

# The ranking constants.
K1, B = 1.5, 0.75
RRF_K, DENSE_WEIGHT = 60, 0.5
#: Terms of a batch of questions that are broadcast, at most.
BROADCAST_TERMS = 200_000
#: Scores of a question's term in a chunk that a task sums, about.
TASK_SCORES = 4_000_000
#: Scores whose difference is less may be equal once they are rounded to nine places.
ROUNDED = 2e-9
#: Steps of a BM25 score of one in which scores are counted.
SCORE_STEPS = 20
TOP_K, MIN_SCORE, DENSE_MIN, REASON_TOP_K = 5, 1.0, 0.5, 8
QUOTA_MIN, RESCUE_DIGITS, RESCUE_MAX = 3, 3, 2
GENERIC_FOLDER_WORDS = ["firm", "ip", "law", "llp", "llc", "pc", "group", "partners", "the", "and", "of", "co"]


def question_terms(questions: DataFrame) -> DataFrame:
    """(qid, term), each once."""
    return X.terms(questions, F.col("question"), "qid").distinct()


def bm25(posts: DataFrame, statistics: DataFrame, df: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, chunk_id, bm25) for chunks with a term of the question; the others score 0.

    posts may be those of a scope; statistics and df are those of the whole corpus. Up to BROADCAST_TERMS the questions' terms are broadcast, after a count, and
    postings are cut down to them where they are; more of them are joined by a shuffle. What is left is dealt out by chunk, to as many tasks as the terms' document frequencies ask for.
    """
    terms = keep(question_terms(questions), "terms")
    few = F.broadcast if terms.count() <= BROADCAST_TERMS else lambda df: df
    asked = few(terms.select("term").distinct())
    n, average = (statistics.select(c).scalar() for c in ("n_chunks", "avg_tokens"))
    idf = F.ln(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = keep(df.join(asked, "term", "left_semi").select("term", "df", idf.alias("idf")), "weighted")
    n_parts = parts(weighted.join(few(terms), "term"), TASK_SCORES, F.col("df"))
    weighted = few(weighted.select("term", "idf"))
    tf = F.col("tf")
    part = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("n_tokens") / average))
    scored = posts.join(weighted, "term").select("term", "chunk_id", part.alias("part")).repartition(n_parts, "chunk_id")
    return scored.join(few(terms), "term").groupBy("qid", "chunk_id").agg(F.round(F.sum("part"), 6).alias("bm25"))


def top(scores: DataFrame, score: str, k: int, by: str = "qid", tie: str = "chunk_id") -> DataFrame:
    """The k best rows for each question, with their rank; the limit goes below the shuffle (WindowGroupLimit)."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), tie))).where(F.col("rank") <= k)


def unit(vector: Column) -> Column:
    """Length 1 and five places; a zero vector stays."""
    v = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: F.round(x / F.when(norm == 0, 1.0).otherwise(norm), 5))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


#: Parts of unit vectors are counted in steps of 1e-5, so that a cosine is a whole number of 1e-10 wherever it is computed, and ties are ties.
_STEPS = 100_000


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row of a with each row of b, to six places, halves up."""
    exact = np.rint(a * _STEPS) @ np.rint(b * _STEPS).T
    return np.floor((exact + 5_000) / 10_000) / 1e6


def cosine_of(a: Column, b: Column) -> Column:
    """The same for two columns."""
    steps = lambda v: F.transform(v.cast("array<double>"), lambda x: F.rint(x * _STEPS))
    return F.floor((dot(steps(a), steps(b)) + 5_000) / 10_000) / 1e6


def _blocks(asked: DataFrame, block: int) -> Iterator[tuple[list, np.ndarray]]:
    """The asked vectors (qid, q), some `block` at a time, as their numbers and a matrix."""
    n = max(1, -(-asked.count() // block))
    for k in range(n):
        rows = asked.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == k).orderBy("qid").collect()
        if rows:
            yield [r["qid"] for r in rows], np.array([r["q"] for r in rows], np.float64)


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _kinds(vectors: DataFrame, asked: DataFrame) -> str:
    return f"qid {asked.schema['qid'].dataType.simpleString()}, chunk_id {vectors.schema['vec_id'].dataType.simpleString()}"


def cosine(vectors: DataFrame, asked: DataFrame, k: int | None, block: int = 512) -> DataFrame:
    """(qid, chunk_id, cos[, rank]): the k nearest of all vectors (vec_id, v) for each asked one (qid, q), both of unit length; without k all of them.

    Blocks of asked vectors, of bounded size, go to all tasks one after another. A batch of vectors meets a block in one matrix product, and a
    task gives its k best for each question only. Vectors of one table have one length; null vectors are left out.
    """
    results = []
    for ids, matrix in _blocks(asked.where("q is not null"), block):

        def near(batches: Iterator[pa.RecordBatch], ids=ids, matrix=matrix) -> Iterator[pa.RecordBatch]:
            who, best = [[] for _ in ids], [np.zeros(0) for _ in ids]
            for b in batches:
                names = np.array(b.column(0).to_pylist(), object)
                score = _cosines(_matrix(b.column(1)), matrix) if len(b) else np.zeros((0, len(ids)))
                for i, qid in enumerate(ids):
                    if k is None:
                        yield pa.RecordBatch.from_arrays([pa.array([qid] * len(names)), pa.array(names.tolist()), pa.array(score[:, i])], ["qid", "chunk_id", "cos"])
                        continue
                    s, w = np.concatenate([best[i], score[:, i]]), [*who[i], *names.tolist()]
                    if len(s) > k:  # ties at the k-th score all stay until the last
                        keep = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
                        keep = keep[sorted(range(len(keep)), key=lambda x: (-s[keep[x]], w[keep[x]]))[:k]]
                        s, w = s[keep], [w[x] for x in keep]
                    best[i], who[i] = s, w
            for qid, w, s in zip(ids, who, best, strict=True):
                if len(w):
                    yield pa.RecordBatch.from_arrays([pa.array([qid] * len(w)), pa.array(w), pa.array(s)], ["qid", "chunk_id", "cos"])

        results.append(vectors.where("v is not null").select("vec_id", "v").mapInArrow(near, f"{_kinds(vectors, asked)}, cos double"))
    if not results:
        found = asked.sparkSession.createDataFrame([], f"{_kinds(vectors, asked)}, cos double")
    else:
        found = reduce(DataFrame.union, results)
    return found if k is None else top(found, "cos", k)


def cosine_ranks(vectors: DataFrame, asked: DataFrame, wanted: DataFrame, block: int = 512) -> DataFrame:
    """(qid, chunk_id, cos, rank) of wanted pairs (qid, chunk_id): the rank of a vector among all for a question, by counting, without ranking all.

    Each task counts how many of its vectors come before each wanted one, and the counts are summed. wanted is what a question's candidates are, so
    that a block's are few.
    """
    pairs = wanted.join(vectors.select(F.col("vec_id").alias("chunk_id"), "v"), "chunk_id").join(asked, "qid")
    scored = pairs.select("qid", "chunk_id", cosine_of(F.col("v"), F.col("q")).alias("cos"))
    results = []
    for ids, matrix in _blocks(asked.where("q is not null"), block):
        held = scored.join(asked.sparkSession.createDataFrame([(i,) for i in ids], asked.select("qid").schema), "qid", "left_semi").orderBy("qid", F.desc("cos"), "chunk_id").collect()
        lists = {qid: [(r["cos"], r["chunk_id"]) for r in held if r["qid"] == qid] for qid in {r["qid"] for r in held}}

        def before(batches: Iterator[pa.RecordBatch], ids=ids, matrix=matrix, lists=lists) -> Iterator[pa.RecordBatch]:
            counts = {qid: np.zeros(len(x), np.int64) for qid, x in lists.items()}
            for b in batches:
                if not len(b):
                    continue
                names = np.array(b.column(0).to_pylist(), object)
                score = _cosines(_matrix(b.column(1)), matrix)
                for i, qid in enumerate(ids):
                    if qid not in lists:
                        continue
                    rising = -np.array([c for c, _ in lists[qid]])
                    place = np.searchsorted(rising, -score[:, i], "right")  # wanted ones after the vector or equal to it are to count it
                    counts[qid] += np.cumsum(np.bincount(place, minlength=len(rising) + 1))[: len(rising)]
                    for row in np.flatnonzero(np.searchsorted(rising, -score[:, i], "left") < place):
                        for j, (c, name) in enumerate(lists[qid]):
                            if c == score[row, i] and names[row] < name:
                                counts[qid][j] += 1
            for qid, x in lists.items():
                yield pa.RecordBatch.from_arrays([pa.array([qid] * len(x)), pa.array([n for _, n in x]), pa.array([c for c, _ in x]), pa.array(counts[qid])], ["qid", "chunk_id", "cos", "before"])

        if lists:
            counted = vectors.where("v is not null").select("vec_id", "v").mapInArrow(before, f"{_kinds(vectors, asked)}, cos double, before long")
            results.append(counted.groupBy("qid", "chunk_id", "cos").agg((F.sum("before") + 1).alias("rank")))
    if not results:
        return asked.sparkSession.createDataFrame([], f"{_kinds(vectors, asked)}, cos double, rank long")
    return reduce(DataFrame.union, results)


def lexical_ranks(bm: DataFrame, wanted: DataFrame) -> DataFrame:
    """(qid, chunk_id, rank) of wanted rows (qid, chunk_id, bm25) of bm: their ranks among all of a question, by counting, without sorting all.

    Scores are counted in steps, and those above a wanted one's step are summed; within its step each row is compared with it. Only counts are shuffled.
    """
    bm = bm.withColumn("_step", F.floor(F.col("bm25") * SCORE_STEPS))
    sought = wanted.select("qid", F.floor(F.col("bm25") * SCORE_STEPS).alias("_step"), F.col("chunk_id").alias("_id"), F.col("bm25").alias("_score"))
    steps = bm.join(wanted.select("qid").distinct(), "qid", "left_semi").groupBy("qid", "_step").agg(F.count("*").alias("_n"))
    above = steps.select("qid", "_step", (F.sum("_n").over(Window.partitionBy("qid").orderBy(F.desc("_step"))) - F.col("_n")).alias("_above"))
    earlier = (F.col("bm25") > F.col("_score")) | ((F.col("bm25") == F.col("_score")) & (F.col("chunk_id") < F.col("_id")))
    inside = bm.join(sought, ["qid", "_step"]).where(earlier).groupBy("qid", "_id").agg(F.count("*").alias("_inside"))
    ranks = sought.join(above, ["qid", "_step"]).join(inside, ["qid", "_id"], "left")
    return ranks.select("qid", F.col("_id").alias("chunk_id"), (F.col("_above") + F.coalesce("_inside", F.lit(0)) + 1).alias("rank"))


def fused_top(bm: DataFrame, vectors: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(qid, chunk_id, rrf, rank): the k best by reciprocal ranks, for any k, without ranking everything for a question. asked: qid, q.

    A threshold algorithm. Both rankings are read to a depth at which what neither has shown, at most 1.5 / (61 + depth), can't reach the k-th of the lexical
    ones, 1 / (60 + k); where fewer have a term all of those are read, and the nearest k fill up. A candidate's known part is its lower bound, and
    with what a rank just below the depth would add its upper one; the k-th lower bound of a question leaves few whose other rank is looked for: it is
    counted, by cosine and by BM25. ROUNDED is what scores are rounded by, so that ties are those of rrf().
    """
    depth = int(1.5 / (1 / (RRF_K + k) - ROUNDED)) - RRF_K
    pair = ["qid", "chunk_id"]
    lexical = keep(top(bm.where("bm25 > 0"), "bm25", depth).select(*pair, F.col("rank").alias("_rb")), "lexical")
    near = keep(cosine(vectors, asked, depth).select(*pair, F.col("rank").alias("_rc")), "near")
    part = lambda weight, rank: F.coalesce(weight / (RRF_K + F.col(rank)), F.lit(0.0))
    both = lexical.join(near, pair, "full_outer").withColumn("_low", part(F.lit(1.0), "_rb") + part(F.lit(DENSE_WEIGHT), "_rc"))
    missing = F.when(F.col("_rb").isNull(), 1.0).otherwise(0.0) + F.when(F.col("_rc").isNull(), DENSE_WEIGHT).otherwise(0.0)
    least = both.withColumn("_n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("_low")))).where(F.col("_n") == k).select("qid", F.col("_low").alias("_least"))
    live = both.join(least, "qid", "left").where(F.col("_low") + missing / (RRF_K + 1 + depth) >= F.coalesce("_least", F.lit(0.0)) - ROUNDED)
    live = keep(live.select(*pair, "_rb", "_rc"), "candidates")
    counted = cosine_ranks(vectors, asked, live.where("_rc is null").select(*pair)).select(*pair, F.col("rank").alias("_more_rc"))
    scored = keep(live.where("_rb is null").select(*pair).join(bm.where("bm25 > 0"), pair), "late")
    read = lexical_ranks(bm.where("bm25 > 0"), scored).select(*pair, F.col("rank").alias("_more_rb"))
    ranked = live.join(counted, pair, "left").join(read, pair, "left").select(*pair, F.coalesce("_rb", "_more_rb").alias("_rb"), F.coalesce("_rc", "_more_rc").alias("_rc"))
    return top(ranked.select(*pair, F.round(part(F.lit(1.0), "_rb") + part(F.lit(DENSE_WEIGHT), "_rc"), 9).alias("rrf")), "rrf", k)


def rrf(bm: DataFrame, cos: DataFrame | None) -> DataFrame:
    """(qid, chunk_id, bm25, cos, rrf): reciprocal ranks, of positive BM25 scores and, at half weight, of cosines."""
    w = lambda s: Window.partitionBy("qid").orderBy(F.desc(s), "chunk_id")
    lexical = bm.where("bm25 > 0").withColumn("_rb", F.row_number().over(w("bm25")))
    if cos is None:
        return lexical.select("qid", "chunk_id", "bm25", F.lit(None).cast("double").alias("cos"), F.round(1.0 / (RRF_K + F.col("_rb")), 9).alias("rrf"))
    dense = cos.withColumn("_rc", F.row_number().over(w("cos")))
    both = lexical.join(dense, ["qid", "chunk_id"], "full_outer")
    fused = F.coalesce(1.0 / (RRF_K + F.col("_rb")), F.lit(0.0)) + F.coalesce(DENSE_WEIGHT / (RRF_K + F.col("_rc")), F.lit(0.0))
    return both.select("qid", "chunk_id", F.coalesce("bm25", F.lit(0.0)).alias("bm25"), "cos", F.round(fused, 9).alias("rrf"))


def diverse(ranked: DataFrame, score: str, k: int) -> DataFrame:
    """The best chunk of each bucket first, by rank, then the others by rank. ranked: qid, chunk_id, bucket, score.

    No more than k of a bucket can be chosen, so that the limit goes below both shuffles (WindowGroupLimit).
    """
    first = F.row_number().over(Window.partitionBy("qid", "bucket").orderBy(F.desc(score), "chunk_id"))
    order = Window.partitionBy("qid").orderBy(F.col("_first") > 1, F.desc(score), "chunk_id")
    ranked = ranked.withColumn("_first", first).where(F.col("_first") <= k)
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("_first")


def round_robin(chunks: DataFrame, budget: int) -> DataFrame:
    """One chunk of each bucket per turn, buckets in the order of their first chunk, until the budget. chunks: chunk_id, bucket, corpus_pos."""
    w = Window.partitionBy("bucket")
    turns = chunks.withColumn("turn", F.row_number().over(w.orderBy("corpus_pos"))).where(F.col("turn") <= budget)  # no later turn can be chosen
    return turns.withColumn("_start", F.min("corpus_pos").over(w)).orderBy("turn", "_start").limit(budget).drop("_start")


def folders_named(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, folder) for questions that name two folders at least by a distinctive word."""
    folder = F.split_part("file", F.lit("/"), F.lit(1))
    folders = chunks.where(F.instr("file", "/") > 0).select(folder.alias("folder")).distinct()
    words = folders.select("folder", F.explode(F.array_distinct(F.split(F.lower("folder"), r"[-_. ]+"))).alias("word"))
    words = words.where((F.col("word") != "") & ~F.col("word").isin(GENERIC_FOLDER_WORDS))
    asked = questions.select("qid", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("question"), F.lit("[a-z0-9]+"), F.lit(0)))).alias("word"))
    named = asked.join(words, "word").select("qid", "folder").distinct()
    return named.withColumn("_n", F.count("*").over(Window.partitionBy("qid"))).where("_n >= 2").drop("_n")


def quota(scores: DataFrame, members: DataFrame, groups: DataFrame, k: int = TOP_K) -> DataFrame:
    """Each group's own best chunks, then the best of all up to k, for questions with groups.

    scores: qid, chunk_id, bm25, cos, rrf. members: qid, grp, chunk_id. groups: qid, grp. Both rankings are made anew inside a
    group before they are fused; every group gets max(3, k // groups) places. The order shown is by bm25 + 10 cos.
    """
    counted = groups.groupBy("qid").agg(F.count("*").alias("_groups"))
    inside = scores.drop("rrf").join(members, ["qid", "chunk_id"]).join(counted, "qid")
    w = Window.partitionBy("qid", "grp")
    by_bm, by_cos = F.row_number().over(w.orderBy(F.desc("bm25"), "chunk_id")), F.row_number().over(w.orderBy(F.desc_nulls_last("cos"), "chunk_id"))
    fused = F.when(F.col("bm25") > 0, 1.0 / (RRF_K + by_bm)).otherwise(0.0) + F.when(F.col("cos").isNotNull(), DENSE_WEIGHT / (RRF_K + by_cos)).otherwise(0.0)
    inside = inside.withColumn("_rrf", F.round(fused, 9))
    place = F.row_number().over(w.orderBy(F.desc("_rrf"), "chunk_id"))
    own = inside.withColumn("_p", place).where((F.col("_p") <= F.greatest(F.lit(QUOTA_MIN), F.floor(F.lit(k) / F.col("_groups")))) & ((F.col("bm25") > 0) | (F.coalesce("cos", F.lit(0.0)) > 0)))
    picked = own.select("qid", "chunk_id", F.lit(0).alias("_late")).distinct()
    every = scores.join(counted, "qid", "left_semi").join(picked, ["qid", "chunk_id"], "left").withColumn("_late", F.coalesce("_late", F.lit(1)))
    order = Window.partitionBy("qid").orderBy("_late", F.desc("rrf"), "chunk_id")
    ranked = every.withColumn("_r", F.row_number().over(order)).where((F.col("_late") == 0) | (F.col("_r") <= k))
    shown = F.round(F.col("bm25") + 10 * F.coalesce("cos", F.lit(0.0)), 6)
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(shown), "chunk_id"))).drop("_late", "_r")


def embed(chunks: DataFrame, function, size: int = 32, kind: str = "search_document") -> DataFrame:
    """(chunk_id, v): unit vectors of heading and text, by a function from a list of texts to a list of vectors, in batches.

    A function with an attribute prefixed that is true gets each text behind what it is for ("search_document: ", "search_query: ").
    """
    before = f"{kind}: " if getattr(function, "prefixed", False) else ""
    import pandas as pd

    def made(batches):
        for b in batches:
            vectors = []
            for at in range(0, len(b), size):
                vectors += [list(map(float, v)) for v in function([before + t for t in b["t"].iloc[at : at + size]])]
            yield pd.DataFrame({"chunk_id": b["chunk_id"], "v": vectors})

    texts = chunks.select("chunk_id", F.concat_ws("\n", F.nullif("heading", F.lit("")), "text").alias("t"))
    id_kind = chunks.schema["chunk_id"].dataType.simpleString()
    return texts.mapInPandas(made, f"chunk_id {id_kind}, v array<double>").select("chunk_id", unit(F.col("v")).alias("v"))


def dense_rescue(hits: DataFrame, cos: DataFrame, least: float = DENSE_MIN) -> DataFrame:
    """The chunk of the best cosine of the whole ranking rides along with BM25 0 if it is absent and near enough."""
    best = top(cos, "cos", 1).where(F.col("cos") >= least).select("qid", "chunk_id", F.lit(0.0).alias("bm25"), "cos")
    absent = best.join(hits.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_anti")
    return hits.select("qid", "chunk_id", "bm25", "cos", F.lit("ranked").alias("origin")).union(absent.withColumn("origin", F.lit("dense")))


def question_numbers(question: Column) -> Column:
    """Figures of three digits at least, without commas; no years, and no parts of ISO dates."""
    found = F.regexp_extract_all(F.regexp_replace(question, r"\b\d{4}-\d{2}-\d{2}\b", " "), F.lit(r"\d[\d,]*(?:\.\d+)?"), F.lit(0))
    clean = F.transform(found, X.bare)
    return F.array_distinct(F.filter(clean, lambda n: (F.length(F.replace(n, F.lit("."), F.lit(""))) >= RESCUE_DIGITS) & ~n.rlike("^(19|20)[0-9][0-9]$")))


def held_numbers(text: Column) -> Column:
    """Figures of a text, without commas, that stand by themselves: no digit or dot before, no digit behind.

    A figure that another starts (4800 of 4800.50) is held as well, so that a lookup by equality finds what a search
    by pattern would.
    """
    flat = F.replace(text, F.lit(","), F.lit(""))
    found = F.regexp_extract_all(flat, F.lit(r"(?<![\d.])\d+(?:\.\d+)*"), F.lit(0))
    whole = F.transform(found, lambda n: F.split_part(n, F.lit("."), F.lit(1)))
    return F.array_distinct(F.concat(found, whole))


def number_rescue(hits: DataFrame, chunks: DataFrame, questions: DataFrame, bm: DataFrame) -> DataFrame:
    """At most two chunks, by BM25, that hold a figure of the question and are no hits; their cosine counts as 0."""
    asked = questions.select("qid", F.explode(question_numbers(F.col("question"))).alias("number"))
    body = F.concat_ws("\n", F.coalesce("heading", F.lit("")), F.coalesce("text", F.lit("")))
    holders = chunks.select("chunk_id", F.explode(held_numbers(body)).alias("number")).join(asked, "number").select("qid", "chunk_id").distinct()
    absent = holders.join(hits.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_anti").join(bm, ["qid", "chunk_id"], "left")
    return top(absent.select("qid", "chunk_id", F.coalesce("bm25", F.lit(0.0)).alias("bm25")), "bm25", RESCUE_MAX).select("qid", "chunk_id", "bm25", F.lit(0.0).alias("cos"))


def gate(hits: DataFrame, questions: DataFrame, min_score: float = MIN_SCORE, dense_min: float = DENSE_MIN) -> DataFrame:
    """(qid, n_hits, bm25_top, cos_top, refused): refused without positive hits, or if neither score is high enough."""
    positive = hits.where("bm25 > 0 or cos > 0").groupBy("qid").agg(F.count("*").alias("n_hits"), F.max("bm25").alias("bm25_top"), F.max("cos").alias("cos_top"))
    all_ = questions.select("qid").join(positive, "qid", "left").withColumn("n_hits", F.coalesce("n_hits", F.lit(0)))
    low = F.coalesce(F.col("bm25_top") < min_score, F.lit(True)) & ~F.coalesce(F.col("cos_top") >= dense_min, F.lit(False))
    return all_.withColumn("refused", (F.col("n_hits") == 0) | low)
