"""MinHash near copies: banded candidates, sequential Bayesian tests of signature batches, exact confirmation, groups."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release, whole_blocks
from .components import components, looked_up
from .near import Similarity, node, shingles


@dataclass(frozen=True)
class Scheme:
    """bands of so many rows find candidates; another `tests` hashes, in batches, decide which of them are confirmed on their sets.

    A pair at the threshold s meets in no band with probability (1 - s ** rows) ** bands (5e-6 at 0.8). A test drops a pair when, after
    the hashes seen, the probability that its similarity reaches the threshold is below miss.
    """

    bands: int = 40
    rows: int = 6
    tests: int = 128
    batch: int = 32
    miss: float = 1e-6
    seed: int = 11


#: Nodes of one block of a cluster or bucket; two blocks are compared in a task at once.
BLOCK_NODES = 256
_CHUNK, _PAIRS = 2048, 1 << 18


@cache
def _hashes(scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(scheme.seed)
    k = scheme.bands * scheme.rows + scheme.tests
    return rng.integers(0, 1 << 32, k, dtype=np.uint32), rng.integers(0, 1 << 31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def signature(shingle_hashes: np.ndarray, scheme: Scheme) -> tuple[np.ndarray, bytes]:
    """Least values of all hash functions over a set that isn't empty -> the keys of its bands, and 16 bits of each testing hash."""
    flip, factor = _hashes(scheme)
    x = (shingle_hashes.astype(np.uint64) >> np.uint64(32)).astype(np.uint32) ^ shingle_hashes.astype(np.uint64).astype(np.uint32)
    least = np.full(len(flip), np.iinfo(np.uint32).max, np.uint32)
    for k in range(0, len(x), _CHUNK):
        y = (x[k : k + _CHUNK, None] ^ flip) * factor
        np.minimum(least, y.min(axis=0), out=least)
    cut = scheme.bands * scheme.rows
    banded = least[:cut].astype(np.uint64).reshape(scheme.bands, scheme.rows)
    keys = np.arange(1, scheme.bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(scheme.rows):
        keys = (keys ^ banded[:, k]) * np.uint64(0xBF58476D1CE4E5B9)
        keys ^= keys >> np.uint64(29)
    mixed = least[cut:] * np.uint32(0x85EBCA6B)
    return keys.view(np.int64), (mixed >> np.uint32(16)).astype("<u2").tobytes()


def reaches(matched: int, seen: int, part: int, whole: int) -> float:
    """Posterior probability of a similarity of part / whole or more, given so many equal hashes of those seen (every similarity being as likely before).

    The posterior is Beta(matched + 1, seen - matched + 1); its upper tail is the chance of at most `matched` heads of seen + 1 coins that show heads with that similarity.
    """
    n = seen + 1
    return sum(comb(n, j) * part**j * (whole - part) ** (n - j) for j in range(matched + 1)) / whole**n


@cache
def fewest(scheme: Scheme, how: Similarity) -> list[int]:
    """After each batch, the fewest equal hashes with which a pair goes on."""
    ends = range(scheme.batch, scheme.tests + 1, scheme.batch)
    return [next(m for m in range(n + 1) if reaches(m, n, how.part, how.whole) >= scheme.miss) for n in ends]


def plausible(a: np.ndarray, b: np.ndarray, scheme: Scheme, how: Similarity) -> np.ndarray:
    """Rows of test hashes, side by side -> the rows that pass every batch: those that fail one aren't compared further."""
    alive, equal = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, least in enumerate(fewest(scheme, how)):
        at = slice(k * scheme.batch, (k + 1) * scheme.batch)
        equal = equal + (a[alive, at] == b[alive, at]).sum(axis=1)
        go = equal >= least
        alive, equal = alive[go], equal[go]
    return alive


def _matrix(column: pa.Array, scheme: Scheme) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, scheme.tests)


def _tested(batches: Iterator[pa.RecordBatch], scheme: Scheme, how: Similarity) -> Iterator[pa.RecordBatch]:
    """(u, v, n, m, a, b): sizes and test hashes of both -> the pairs that go on."""
    for batch in batches:
        n, m = (batch.column(k).to_numpy() for k in (2, 3))
        sized = np.flatnonzero(how.whole * np.minimum(n, m) >= how.part * np.maximum(n, m))
        part = batch.take(pa.array(sized))
        go = plausible(_matrix(part.column(4), scheme), _matrix(part.column(5), scheme), scheme, how)
        yield part.take(pa.array(go)).select(["u", "v"])


@lru_cache(maxsize=64)
def _pairs_of(size: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(size, 1)


def _crossed(batches: Iterator[pa.RecordBatch], scheme: Scheme, how: Similarity) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, i, j, node, comp, cluster, n, side, tests) by block (bucket, i, j) -> plausible pairs of different components and clusters within a block.

    side: 2 where a block meets itself, else which of two blocks the node belongs to.
    """
    for rows, sizes in whole_blocks(batches):
        node_, comp, cluster, n, side = (rows.column(k).to_numpy() for k in range(3, 8))
        tests, held, count = _matrix(rows.column(8), scheme), [], 0
        starts = np.cumsum(sizes) - sizes
        for k, (start, size) in enumerate(zip(starts.tolist(), sizes.tolist(), strict=True)):
            i, j = (x + start for x in _pairs_of(size))
            ok = (comp[i] != comp[j]) & (cluster[i] != cluster[j]) & ((side[i] != side[j]) | (side[i] == 2)) & (how.whole * np.minimum(n[i], n[j]) >= how.part * np.maximum(n[i], n[j]))
            held.append((i[ok], j[ok]))
            count += len(held[-1][0])
            if count > _PAIRS or k == len(sizes) - 1:
                i, j = (np.concatenate(x) for x in zip(*held, strict=True))
                held, count = [], 0
                u, v = np.minimum(node_[i], node_[j]), np.maximum(node_[i], node_[j])
                order = np.lexsort((v, u))
                first = np.ones(len(order), bool)
                first[1:] = (np.diff(u[order]) != 0) | (np.diff(v[order]) != 0)
                once = order[first]
                go = once[plausible(tests[i[once]], tests[j[once]], scheme, how)]
                yield pa.RecordBatch.from_arrays([pa.array(u[go]), pa.array(v[go])], ["u", "v"])
    release()


def _linked(batches: Iterator[pa.RecordBatch], scheme: Scheme, how: Similarity) -> Iterator[pa.RecordBatch]:
    """Rows (cluster, i, j, node, comp, n, side, tests, hashes) by block -> links that connect all similar pairs of a block, each confirmed on the whole sets.

    Of an implausible pair the sets aren't looked at, and what links found here connect isn't given again.
    """
    for rows, sizes in whole_blocks(batches):
        node_, comp, n, side = (rows.column(k).to_numpy() for k in range(3, 7))
        found: list[tuple[int, int]] = []
        for start, size in zip((np.cumsum(sizes) - sizes).tolist(), sizes.tolist(), strict=True):
            one = slice(start, start + size)
            i, j = _pairs_of(size) if (side[one] == 2).all() else (x.ravel() for x in np.meshgrid(np.flatnonzero(side[one] == 0), np.flatnonzero(side[one] == 1), indexing="ij"))
            c, m = comp[one], n[one]
            ok = (c[i] != c[j]) & (how.whole * np.minimum(m[i], m[j]) >= how.part * np.maximum(m[i], m[j]))
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            tests, lists = _matrix(rows.column(7).slice(start, size), scheme), rows.column(8).slice(start, size)
            go = np.concatenate([k + plausible(tests[i[k : k + _PAIRS]], tests[j[k : k + _PAIRS]], scheme, how) for k in range(0, len(i), _PAIRS)])
            i, j = i[go], j[go]
            flat = lists.flatten().to_numpy()
            ids = np.unique(flat, return_inverse=True)[1]
            ends = np.cumsum(m)
            root = {int(x): int(x) for x in c}

            def top(x: int, root=root) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            mark = np.zeros(int(ids.max()) + 1, bool) if len(ids) else np.zeros(0, bool)
            bounds = np.flatnonzero(np.diff(i, prepend=-1, append=-1)) if len(i) else []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):  # one node and what it is plausibly similar to
                u, others = int(i[a]), j[a:b]
                own = ids[ends[u] - m[u] : ends[u]]
                mark[own] = True
                shared = np.array([np.count_nonzero(mark[ids[ends[v] - m[v] : ends[v]]]) for v in others.tolist()])
                mark[own] = False
                for v in others[how.whole * shared >= how.part * (m[u] + m[others] - shared)].tolist():
                    x, y = top(int(c[u])), top(int(c[v]))
                    if x != y:
                        root[max(x, y)] = min(x, y)
                        found.append((int(node_[start + u]), int(node_[start + v])))
        ends_ = np.array(found, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(ends_.min(axis=1)), pa.array(ends_.max(axis=1))] if len(ends_) else [pa.array([], pa.int64())] * 2, ["u", "v"])
    release()


def fingerprinted(docs: DataFrame, scheme: Scheme, how: Similarity) -> DataFrame:
    """documents -> (doc_id, key, node, n, bands, tests): key is a hash of the text, node one of its set (0: empty, then without bands), n its size."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py(), how.words) for t in b.column(2).cast(pa.binary())]
            made = [signature(s, scheme) if len(s) else (np.zeros(0, np.int64), b"") for s in sets]
            ends = np.cumsum([0, *(len(k) for k, _ in made)]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *(k for k, _ in made)])))
            found = [pa.array([node(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), bands, pa.array([t for _, t in made], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *found], ["doc_id", "key", "node", "n", "bands", "tests"])
        release()

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    return rows.mapInArrow(prints, f"doc_id {kind}, key long, node long, n long, bands array<long>, tests binary")


class _Search:
    """The steps of groups(), over the tables they share: nodes are distinct sets, postings their bands, sets the whole sets of nodes with candidates."""

    def __init__(self, docs: DataFrame, scheme: Scheme, how: Similarity):
        self.scheme, self.how = scheme, how
        self.prints = materialise(fingerprinted(docs, scheme, how), "minhash")
        at = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("at")
        self.nodes = materialise(self.prints.where("n > 0").groupBy("node").agg(at, F.count("*").alias("copies"), *(F.any_value(c).alias(c) for c in ("n", "tests", "bands"))), "minhash-nodes")
        each = self.nodes.select("node", F.explode("bands").alias("bucket"))
        shared = each.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
        self.postings = materialise(each.join(shared, "bucket"), "minhash-postings")
        self.sets = materialise(self._sets(docs), "minhash-sets")

    def _sets(self, docs: DataFrame) -> DataFrame:
        """(node, hashes) of the nodes that share a band with another, from the text of one document for each."""
        words = self.how.words

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [shingles(t.as_py(), words) for t in b.column(1).cast(pa.binary())]
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *found])))], ["node", "hashes"])
            release()

        asked = self.postings.select("node").distinct()
        at = self.nodes.join(asked, "node", "left_semi").select("node", F.col("at.doc_id").alias("_id"), F.col("at.key").alias("_key"))
        texts = docs.select(F.col("doc_id").alias("_d"), F.xxhash64("text").alias("_k"), "text")
        same = F.col("_d").eqNullSafe(F.col("_id")) & (F.col("_k") == F.col("_key"))
        one = texts.join(at, same).select("node", "text").dropDuplicates(["node"]) if self._repeated() else texts.join(at, same).select("node", "text")
        return one.mapInArrow(whole, "node long, hashes array<long>")

    def _repeated(self) -> bool:
        """Whether some doc_id has equal texts more than once."""
        return not self.prints.groupBy("doc_id", "key").agg(F.count("*").alias("k")).where("k > 1").isEmpty()

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Of distinct (u, v) those whose whole sets are as similar as asked."""
        pairs = materialise(pairs, "minhash-pairs")
        asked = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
        sets = materialise(self.sets.join(asked, "node", "left_semi"), "minhash-asked")
        left, right = (sets.select(F.col("node").alias(k), F.col("hashes").alias(h)) for k, h in (("u", "a"), ("v", "b")))
        both = pairs.join(left, "u").join(right, "v").withColumn("shared", F.size(F.array_intersect("a", "b")))
        return materialise(both.where(f"{self.how.whole} * shared >= {self.how.part} * (size(a) + size(b) - shared)").select("u", "v"), "minhash-links")

    def tested(self, pairs: DataFrame) -> DataFrame:
        """Of (u, v) those that pass the Bayesian tests."""
        facts = self.nodes.select("node", "n", "tests")
        left, right = (facts.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("tests").alias(f"tests_{k}")) for k in "uv")
        rows = pairs.join(left, "u").join(right, "v").select("u", "v", "n_u", "n_v", "tests_u", "tests_v")
        scheme, how = self.scheme, self.how
        return rows.mapInArrow(lambda it: _tested(it, scheme, how), "u long, v long")

    def hubs(self) -> DataFrame:
        """(node, hub): of the buckets' hubs that a node meets the one that counts most, itself if it meets none that counts more.

        A bucket's hub is its node with most candidates in all, as the text that others are copies of has.
        """
        rows = self.postings.join(self.postings.groupBy("node").agg(F.sum("size").alias("weight")), "node")
        of = rows.groupBy("bucket").agg(F.max(F.struct("weight", "node")).alias("hub"))
        return rows.join(of, "bucket").groupBy("node").agg(F.max("hub").alias("hub")).select("node", "hub.node").toDF("node", "hub")

    def clustered(self, hubs: DataFrame, found: DataFrame) -> DataFrame:
        """(node, comp, cluster): its component, and that of its hub."""
        comps = components(found).select("node", "root")
        own = hubs.join(comps, "node", "left").select("node", "hub", F.coalesce("root", "node").alias("comp"))
        return own.join(comps.select(F.col("node").alias("hub"), "root"), "hub", "left").select("node", "comp", F.coalesce("root", "hub").alias("cluster"))

    def within_clusters(self, clusters: DataFrame) -> DataFrame:
        """Links (u, v) among the nodes of a cluster that the hub doesn't connect, and between these and the others. What the hub connects isn't compared with itself.

        Both are cut into blocks of BLOCK_NODES or so; a task has two blocks with their whole sets, and gives links only.
        """
        rows = clusters.withColumn("apart", F.col("comp") != F.col("cluster"))
        open_ = rows.groupBy("cluster").agg(F.count_if("apart").alias("a"), F.count_if(~F.col("apart")).alias("b")).where("a > 0 and a + b > 1")
        blocks = lambda c: F.ceil(F.col(c) / BLOCK_NODES).cast("long")
        rows = rows.join(open_.select("cluster", blocks("a").alias("a"), blocks("b").alias("b")), "cluster")
        own = F.pmod(F.xxhash64("node"), F.when(F.col("apart"), F.col("a")).otherwise(F.col("b")))
        numbered = rows.withColumn("own", F.when(F.col("apart"), own).otherwise(F.col("a") + own))
        count = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
        placed = numbered.withColumn("other", F.explode(F.when(F.col("apart"), count(F.col("a") + F.col("b"))).otherwise(count(F.col("a")))))
        return self._compared(placed, "cluster", ["node", "comp"], self.nodes.select("node", "n", "tests").join(self.sets, "node"), ["n", "side", "tests", "hashes"], _linked)

    def within_buckets(self, clusters: DataFrame) -> DataFrame:
        """Plausible pairs (u, v) that share a bucket, and neither component nor cluster (as within_clusters() had them). A bucket over BLOCK_NODES is cut into blocks, each two of which meet in a place of their own."""
        rows = self.postings.select("bucket", "node").join(clusters, "node")
        ends = (f(c).alias(f"{n}_{c}") for c in ("comp", "cluster") for f, n in ((F.min, "low"), (F.max, "high")))
        open_ = rows.groupBy("bucket").agg(*ends, F.ceil(F.count("*") / BLOCK_NODES).alias("c")).where("low_comp < high_comp and low_cluster < high_cluster").select("bucket", "c")
        cut = rows.join(open_, "bucket").withColumn("own", F.pmod(F.xxhash64("node"), F.col("c"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1)))
        return self._compared(cut, "bucket", ["node", "comp", "cluster"], self.nodes.select("node", "n", "tests"), ["n", "side", "tests"], _crossed)

    def _compared(self, placed: DataFrame, key: str, columns: list[str], facts: DataFrame, more: list[str], compare) -> DataFrame:
        """placed: a row for each block (other) that a node, of the block own, meets."""
        side = F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int"))
        rows = placed.select(key, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *columns, side.alias("side")).join(facts, "node").select(key, "i", "j", *columns, *more)
        scheme, how = self.scheme, self.how
        return rows.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j").mapInArrow(lambda it: compare(it, scheme, how), "u long, v long").distinct()

    def links(self) -> DataFrame:
        """Similar pairs (u, v) that connect all similar ones that meet in a bucket; pairs that others connect already are left out.

        Each node meets its hub first. A hub's component and the nodes that came to it are a cluster, whose other pairs are settled next, each once and
        without giving them out. Buckets are left with pairs across clusters.
        """
        hubs = materialise(self.hubs(), "minhash-hubs")
        apart = hubs.where("node <> hub").select(F.least("node", "hub").alias("u"), F.greatest("node", "hub").alias("v")).distinct()
        found = self.confirmed(self.tested(apart))
        clusters = materialise(self.clustered(hubs, found), "minhash-clusters")
        found = found.union(materialise(self.within_clusters(clusters), "minhash-links"))
        # the clusters stay those that were settled: where links made one component of two hubs', the nodes apart from both haven't met
        comps = components(found).select("node", "root")
        settled = clusters.select("node", "cluster").join(comps, "node", "left").select("node", F.coalesce("root", "node").alias("comp"), "cluster")
        return found.union(self.confirmed(self.within_buckets(materialise(settled, "minhash-clusters"))))


def groups(docs: DataFrame, scheme: Scheme = Scheme(), how: Similarity = Similarity(words=2)) -> DataFrame:
    """documents -> (doc_id, n_shingles, component_id, kept), a row for each row.

    A text's set: its distinct shingles of A-Z-lowered words (fewer words: all of them as one). Two documents are linked if their sets' Jaccard
    similarity is part / whole or more; component_id is the smallest doc_id reachable. kept: the document is that one. Documents without a word, null texts too,
    are linked with nothing. Rows without a doc_id link, but are never kept; where only such are reachable, component_id is null. Repeated rows get equal values. An empty table gives an empty table.

    Equal sets are one node. Nodes that share a band are candidates. Each first meets one hub only; what this leaves apart meets in blocks, of the hub's
    cluster and then of buckets. Each pair is tested on batches of hashes, and what passes is confirmed on whole sets. There is no cap: what
    isn't found is lost with the probabilities of Scheme, to which a component can be blind only if all its pairs across are.
    """
    search = _Search(docs, scheme, how)
    roots = components(search.links()).select("node", "root")
    own = roots.join(search.nodes.select("node", F.col("at.doc_id").alias("least")), "node")
    merged = own.groupBy("root").agg(F.min("least").alias("reached")).join(roots, "root").select("node", "reached")
    ids = search.nodes.join(merged, "node", "left").select("node", F.coalesce("reached", "at.doc_id").alias("component_id"), F.col("copies").alias("n"))
    ids = materialise(ids, "minhash-ids")
    filled = looked_up(search.prints.where("n > 0").select("doc_id", F.col("n").alias("n_shingles"), "node"), ids, "node")
    empty = search.prints.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    every = filled.select("doc_id", "n_shingles", "component_id").union(empty)
    return every.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
