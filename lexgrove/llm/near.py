"""Near copies by the similarity of their shingles: fingerprints find those that differ little, prefix filtering the rest, sets decide.

Texts of similarity 0.8 differ in ten of 64 fingerprint bits or so, where small Hamming balls no longer tell them from others. So fingerprints and
multi-index hashing link what they can, which takes large groups of copies together, and a prefix filter completes the links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import materialise, release, whole_blocks
from .components import components, looked_up
from .simhash import SEED, keep_least


@dataclass(frozen=True)
class Similarity:
    """words: words of a shingle. Two texts are near copies if their sets of shingles have a Jaccard similarity of at least part / whole."""

    words: int = 5
    part: int = 4
    whole: int = 5


#: One document of so many tells which shingles are common, from so many of these on; at most so many are told to tasks.
SAMPLE, COMMON_FROM, COMMON_MOST = 16, 4, 500_000
#: A posting list with more pairs for each of its nodes is long: its nodes are compared with hubs first, in so many rounds at most, and
#: as long as one of so many comparisons connects two.
LIST_PAIRS, HUB_ROUNDS, HUB_SHARE = 32, 8, 8
#: A hub's cluster is settled in blocks of so many nodes if it leaves so many apart at least, and if it connects one for each HUB_SHARE of these or a list
#: would make pairs of one in so many of its nodes.
BLOCK_NODES, APART, LIST_SHARE = 256, 32, 8


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """Sorted XXH64 of the distinct shingles of A-Z-lowered words (a text of fewer words is one shingle); none without words."""
    import xxhash

    digest = xxhash.xxh64_digest
    w = text.lower().split() if text else []
    if not w:
        return np.zeros(0, np.int64)
    joined = b" ".join(w)
    if len(w) <= words:
        parts = [joined]
    else:
        ends = [e + i for i, e in enumerate(accumulate(map(len, w)))]
        parts = [joined[a:b] for a, b in zip([0, *(e + 1 for e in ends)], ends[words - 1 :], strict=False)]
    return np.unique(np.frombuffer(b"".join([digest(p, SEED) for p in parts]), ">i8").astype(np.int64))


def node(hashes: np.ndarray) -> int:
    """A long for the set of shingles; 0 for the empty set."""
    import xxhash

    return int.from_bytes(xxhash.xxh64_digest(hashes.tobytes(), SEED), "big", signed=True) if len(hashes) else 0


def prefix(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray], how: Similarity) -> np.ndarray:
    """The rarest shingles, so many that any near copy has one of them among its own rarest; common: sorted hashes, counts."""
    n = len(hashes)
    if not n:
        return hashes
    known, counts = common
    rank = np.zeros(n, np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        rank = np.where(known[at] == hashes, counts[at], 0)
    keep = n - -(-n * how.part // how.whole) + 1
    return hashes[np.argsort(rank, kind="stable")[:keep]]


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def _common(docs: DataFrame, how: Similarity) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample finds common, sorted, with counts. They only set the order of shingles, for which any choice is right."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.concatenate([np.zeros(0, np.int64), *(shingles(t.as_py(), how.words) for t in b.column(0).cast(pa.binary()))])
            values, counts = np.unique(found, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts)], ["shingle", "n"])

    sample = docs.where(f"pmod(xxhash64(doc_id), {SAMPLE}) = 0").select("text").mapInArrow(hashes, "shingle long, n long")
    found = sample.groupBy("shingle").agg(F.sum("n").alias("n")).where(f"n >= {COMMON_FROM}").orderBy(F.desc("n"), "shingle").limit(COMMON_MOST).toArrow()
    known, counts = (found.column(k).to_numpy().astype(np.int64) for k in (0, 1))
    order = np.argsort(known)
    return known[order], counts[order]


def similar_pairs(pairs: DataFrame, sets: Callable[[DataFrame], DataFrame], how: Similarity) -> DataFrame:
    """Of distinct (u, v), those whose sets are as similar as that; sets: gives (node, hashes) of the nodes (node) asked for."""
    pairs = materialise(pairs, "near-pairs")
    found = sets(pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct())
    left = found.select(F.col("node").alias("u"), F.col("hashes").alias("a"))
    right = found.select(F.col("node").alias("v"), F.col("hashes").alias("b"))
    both = pairs.select("u", "v").join(left, "u").join(right, "v").withColumn("shared", F.size(F.array_intersect("a", "b")))
    return materialise(both.where(f"{how.whole} * shared >= {how.part} * (size(a) + size(b) - shared)").select("u", "v"), "near-similar")


def close_links(nodes: DataFrame, sets: Callable[[DataFrame], DataFrame], how: Similarity) -> DataFrame:
    """nodes (node, fp) -> similar pairs (u, v) among those whose fingerprints multi-index hashing finds within its radius.

    A fingerprint's nodes are compared with the least of them, and the least ones of linked fingerprints with each other.
    """
    first = nodes.groupBy("fp").agg(F.min("node").alias("v"))
    near = simhash.links(first.select("fp"))
    across = near.join(first.select(F.col("fp").alias("u"), F.col("v").alias("a")), "u").select("a", F.col("v").alias("fp")).join(first, "fp").select(F.col("a").alias("u"), "v")
    same = nodes.join(first, "fp").where("node != v").select(F.col("node").alias("u"), "v")
    return similar_pairs(across.union(same).distinct(), sets, how)


def _linked(batches: Iterator[pa.RecordBatch], how: Similarity) -> Iterator[pa.RecordBatch]:
    """Rows (cluster, i, j, node, comp, side, hashes) by block (cluster, i, j) -> similar pairs that connect all similar ones of a block; side: 2 where a block meets itself.

    Nodes that are connected, by what is found here too, aren't compared.
    """
    for rows, sizes in whole_blocks(batches):
        found: list[tuple[int, int]] = []
        for start, size in zip((np.cumsum(sizes) - sizes).tolist(), sizes.tolist(), strict=True):
            block = rows.slice(start, size)
            node_, label, side = block.column(3).to_numpy(), block.column(4).to_numpy().copy(), block.column(5).to_numpy()
            values, ids = np.unique(block.column(6).flatten().to_numpy(), return_inverse=True)
            n = block.column(6).value_lengths().to_numpy().astype(np.int64)
            ends, mark, place = np.cumsum(n), np.zeros(len(values), bool), np.arange(size)
            for u in np.flatnonzero(side != 1).tolist():
                other = np.where(side == 2, place > u, side == 1) & (label != label[u]) & (how.whole * np.minimum(n, n[u]) >= how.part * np.maximum(n, n[u]))
                if not other.any():
                    continue
                own = ids[ends[u] - n[u] : ends[u]]
                mark[own] = True
                held = np.cumsum(np.concatenate([np.zeros(1, np.int64), mark[ids]]))
                mark[own] = False
                shared = held[ends] - held[ends - n]
                for v in np.flatnonzero(other & (how.whole * shared >= how.part * (n + n[u] - shared))).tolist():
                    if label[u] != label[v]:
                        found.append((int(node_[u]), int(node_[v])))
                        label[label == label[v]] = label[u]
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["u", "v"])
    release()


def clusters(met: DataFrame, found: DataFrame, early: DataFrame) -> DataFrame:
    """met (node, hub) -> (node, comp, cluster, a, b) of clusters to settle: a hub's component, of b nodes, and the a nodes that met the hub and are apart from it. early: (shingle, node) that may make pairs."""
    comps = components(found)
    own = comps.join(met, "node", "full_outer").select("node", "hub", F.coalesce("root", "node").alias("comp"))
    of = own.join(comps.select(F.col("node").alias("hub"), "root"), "hub", "left").select("node", "comp", F.coalesce("root", "hub", "comp").alias("cluster"))
    of = materialise(of, "near-clusters")
    sized = of.groupBy("cluster").agg(F.count_if(F.col("comp") != F.col("cluster")).alias("a"), F.count_if(F.col("comp") == F.col("cluster")).alias("b"))
    sized = sized.where(f"a >= {APART}")
    listed = early.join(of.select("node", "cluster"), "node").join(sized, "cluster", "left_semi").groupBy("shingle", "cluster").agg(F.count("*").alias("c")).groupBy("cluster").agg(F.max("c").alias("c"))
    dense = sized.join(listed, "cluster").where(f"b * {HUB_SHARE} >= a or c * {LIST_SHARE} >= a + b").select("cluster", "a", "b")
    return of.join(dense, "cluster")


def within(clustered: DataFrame, sets: Callable[[DataFrame], DataFrame], how: Similarity) -> DataFrame:
    """Similar pairs (u, v) that connect all similar ones of a cluster. Its nodes apart meet each other and those of the hub's component, all as whole sets.

    Both are cut into blocks. A task has two blocks and gives links only, so that no row is made for a pair.
    """
    blocks = lambda c: F.ceil(F.col(c) / BLOCK_NODES).cast("long")
    rows = clustered.select("node", "comp", "cluster", (F.col("comp") != F.col("cluster")).alias("apart"), blocks("a").alias("a"), blocks("b").alias("b"))
    part = lambda n: F.pmod(F.xxhash64("node"), n)
    placed = rows.withColumn("own", F.when(F.col("apart"), part(F.col("a"))).otherwise(F.col("a") + part(F.col("b"))))
    last = F.when(F.col("apart"), F.col("a") + F.col("b")).otherwise(F.col("a")) - 1
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    side = F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int"))
    ends = F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
    met = placed.select("cluster", *ends, "node", "comp", side.alias("side")).join(sets(clustered.select("node")), "node").select("cluster", "i", "j", "node", "comp", "side", "hashes")
    met = met.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    return materialise(met.mapInArrow(lambda it: _linked(it, how), "u long, v long"), "near-within")


def links(postings: DataFrame, found: DataFrame, sets: Callable[[DataFrame], DataFrame], how: Similarity) -> DataFrame:
    """postings (shingle, pos, node, n) of prefixes, links found so far -> links (u, v) that connect all near copies: only similar pairs, but not all of them.

    pos is a shingle's place in its set, rarest first. Pairs of nodes that are connected already are never made. Nodes of long posting lists are first
    compared with one node of the list only, in the first round the one that has most of the long lists, as the text that others are copies of has, then
    any other; this connects most of a large group. What a hub leaves apart of its group is compared as a cluster then (see within()). The pairs that are left are made where a list holds the first shingle that both can have in
    common: nothing before it is shared, so what follows it in either set has to be enough. Most of these go by the shingles that their prefixes share: k
    common ones, and what the prefix that ends first leaves of its set, are the most that two sets share.
    """
    part, both = how.part, how.part + how.whole

    def labelled() -> DataFrame:
        return materialise(postings.join(components(found), "node", "left").select(*postings.columns, F.coalesce("root", "node").alias("comp")), "near-listed")

    def early_of(listed: DataFrame) -> DataFrame:
        # of each list the nodes for which its shingle may be the first one shared with a set as small as the list's smallest, or as a near copy's can be
        several = listed.groupBy("shingle").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.min("n").alias("least_n")).where("a != b").select("shingle", "least_n")
        return listed.join(several, "shingle").where(f"(n - pos) * {both * how.whole} >= {part} * greatest({how.whole} * (n + least_n), {both} * n)")

    listed, met = labelled(), None
    for turn in range(HUB_ROUNDS + 1):
        parts = listed.groupBy("shingle", "comp").agg(F.count("*").cast("double").alias("k"))
        whole = parts.groupBy("shingle").agg(F.sum("k").alias("c"), F.sum(F.col("k") * F.col("k")).alias("same")).where("c * c > same")
        crowded = whole.where(f"c * c - same > 2 * {LIST_PAIRS} * c")
        if turn == HUB_ROUNDS or crowded.isEmpty():
            break
        long_ = listed.join(crowded.select("shingle"), "shingle", "left_semi")
        if turn == 0:
            long_ = long_.join(long_.groupBy("node").agg((-F.count("*")).alias("place")), "node")
        else:
            long_ = long_.withColumn("place", F.xxhash64("node", F.lit(turn)))
        hubs = long_.groupBy("shingle").agg(F.min(F.struct("place", "node", "comp", "n")).alias("hub")).select("shingle", *(F.col(f"hub.{c}").alias(f"hub_{c}") for c in ("place", "node", "comp", "n")))
        near = long_.join(hubs, "shingle").where(f"comp != hub_comp and {how.whole} * least(n, hub_n) >= {part} * greatest(n, hub_n)")
        if turn == 0:
            met = materialise(near.groupBy("node").agg(F.min(F.struct("hub_place", "hub_node")).alias("hub")).select("node", F.col("hub.hub_node").alias("hub")), "near-met")
        compared = materialise(near.select(F.col("node").alias("u"), F.col("hub_node").alias("v")).distinct(), "near-hubs")
        near = similar_pairs(compared, sets, how)
        found = found.union(near)
        listed = labelled()
        if near.count() * HUB_SHARE < compared.count():
            break
    settled = None
    if met is not None:
        settled = clusters(met, found, early_of(listed))
        found = found.union(within(settled, sets, how))
        listed = labelled()
    listed = listed.withColumn("cluster", F.lit(None).cast("long")) if settled is None else listed.join(settled.select("node", "cluster"), "node", "left")
    early = early_of(listed)
    # a row for each list, component and cluster, so that the join makes pairs of different ones only; the smaller side is taken apart first
    grouped = early.groupBy("shingle", "comp", "cluster").agg(F.collect_list(F.struct("node", "n", "pos")).alias("nodes"), F.max(F.col("n") - F.col("pos")).alias("rest"), F.min("n").alias("low"))
    other = grouped.select("shingle", *(F.col(c).alias(f"{c}_") for c in ("comp", "cluster", "nodes", "rest", "low")))
    crossed = grouped.join(other, "shingle").where(f"comp < comp_ and coalesce(cluster != cluster_, true) and least(rest, rest_) * {both} >= {part} * (low + low_)")
    less = F.size("nodes") <= F.size("nodes_")
    crossed = crossed.select(F.when(less, F.col("nodes")).otherwise(F.col("nodes_")).alias("few"), F.when(less, F.col("nodes_")).otherwise(F.col("nodes")).alias("many"))
    crossed = crossed.select(F.explode("few").alias("x"), "many")

    def may(y):
        n, m = F.col("x.n"), y["n"]
        close = how.whole * F.least(n, m) >= part * F.greatest(n, m)
        return close & (both * F.least(n - F.col("x.pos"), m - y["pos"]) >= part * (n + m))

    crossed = crossed.select("x", F.explode(F.filter("many", may)).alias("y"))
    ends = F.least("x.node", "y.node").alias("u"), F.greatest("x.node", "y.node").alias("v")
    pairs = materialise(crossed.select(*ends, (F.col("x.n") + F.col("y.n")).alias("sum"), F.greatest("x.n", "y.n").alias("most")).distinct(), "near-candidates")
    asked = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    held = postings.join(asked, "node", "left_semi").groupBy("node").agg(F.collect_list("shingle").alias("prefix"))
    first, second = (held.select(F.col("node").alias(k), F.col("prefix").alias(f"{k}_prefix")) for k in ("u", "v"))
    counted = pairs.join(first, "u").join(second, "v").withColumn("k", F.size(F.array_intersect("u_prefix", "v_prefix")))
    left = f"(most * {part} + {how.whole} - 1) div {how.whole} - 1"
    rest = similar_pairs(counted.where(f"(k + {left}) * {both} >= {part} * sum").select("u", "v"), sets, how)
    return found.union(rest)


def groups(docs: DataFrame, how: Similarity = Similarity()) -> DataFrame:
    """documents with a doc_id -> (doc_id, component_id), a row for each row.

    component_id: the smallest doc_id reachable over pairs of near copies, its own included. Two sets of n and m shingles of that similarity
    share so many that, in any one order of all shingles, the first n - ceil(n part / whole) + 1 of the one and as many of the other have one
    in common: only texts with such a one are compared, and none that is similar is missed. Shingles and equal sets are known by 64-bit
    hashes. Equal sets, those of empty texts too, are one node.
    """
    sent = docs.sparkSession.sparkContext.broadcast(_common(docs, how))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets_ = [shingles(t.as_py(), how.words) for t in b.column(1).cast(pa.binary())]
            found = [pa.array([node(s) for s in sets_], pa.int64()), pa.array([simhash.majority(s.astype(">i8").tobytes()) for s in sets_], pa.int64())]
            found += [pa.array([len(s) for s in sets_], pa.int64()), _lists([prefix(s, sent.value, how) for s in sets_])]
            yield pa.RecordBatch.from_arrays([b.column(0), *found], ["doc_id", "node", "fp", "n", "prefix"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets_ = [shingles(t.as_py(), how.words) for t in b.column(0).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array([node(s) for s in sets_], pa.int64()), _lists(sets_)], ["node", "hashes"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    prints = materialise(docs.select("doc_id", "text").mapInArrow(prefixes, f"doc_id {kind}, node long, fp long, n long, prefix array<long>"), "near")
    ids = materialise(prints.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), F.min("fp").alias("fp")), "near-nodes")
    each = prints.select(F.posexplode("prefix").alias("pos", "shingle"), "node", "n")
    shared = each.groupBy("shingle").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a != b").select("shingle")
    postings = materialise(each.join(shared, "shingle", "left_semi").distinct(), "near-postings")

    def sets(nodes: DataFrame) -> DataFrame:
        least = ids.join(nodes, "node", "left_semi").select(F.col("least").alias("doc_id"))
        texts = docs.join(least, "doc_id", "left_semi").select("text")
        return materialise(texts.mapInArrow(whole, "node long, hashes array<long>"), "near-sets")

    roots = components(links(postings, close_links(ids.select("node", "fp"), sets, how), sets, how))
    merged = roots.join(ids, "node").groupBy("root").agg(F.min("least").alias("reached")).join(roots, "root").select("node", "reached")
    found = materialise(ids.join(merged, "node", "left").select("node", F.coalesce("reached", "least").alias("component_id"), "n"), "near-ids")
    return looked_up(prints.select("doc_id", "node"), found, "node").select("doc_id", "component_id")


def keep_one(docs: DataFrame, how: Similarity = Similarity()) -> DataFrame:
    """The rows of documents, all columns unchanged, without near copies: of each group the row with its smallest doc_id stays.

    Of repeated rows with that doc_id one stays (the one with the least hash of its text). Rows whose doc_id is null all stay.
    """
    return keep_least(docs, groups(docs.where("doc_id is not null"), how))
