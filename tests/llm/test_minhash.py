"""MinHash near copies against exact similarity of all pairs, and the parts of the search."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from lexgrove.llm import minhash, queries
from lexgrove.llm.common import table
from lexgrove.llm.minhash import Scheme
from lexgrove.llm.near import Similarity

SF, TWO = "/root/testdata/sf0.001", Similarity(words=2)


def shingles(text):
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    return frozenset(zip(w, w[1:], strict=False)) if len(w) > 1 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """[(doc_id, text)] -> per row (n_shingles, component_id)."""
    sets = [shingles(t) for _, t in rows]
    up, by = list(range(len(rows))), defaultdict(list)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, s in enumerate(sets):
        shared = Counter(j for x in s for j in by[x])
        for j, n in shared.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                up[root(k)] = root(j)
        for x in s:
            by[x].append(k)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return [(i, len(s), least.get(root(k)) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))]


def held(frame):
    rows = frame.collect()
    assert all(r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["component_id"]) for r in rows)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows), key=repr)


def test_groups_equal_brute_force(spark, docs, nothing):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert held(minhash.groups(docs)) == sorted(brute(rows), key=repr)
    assert minhash.groups(nothing).collect() == []


@pytest.mark.parametrize("block", [8, 256])
def test_large_groups(spark, monkeypatch, block):
    """A large group of near copies, some chains and copies: hubs and blocks give the same groups."""
    monkeypatch.setattr(minhash, "BLOCK_NODES", block)
    rnd = random.Random(1)
    base = [f"w{k}" for k in range(150)]

    def edited(words, k):
        words = list(words)
        for _ in range(k):
            words[rnd.randrange(len(words))] = f"x{rnd.randrange(10**6)}"
        return words

    texts = [edited(base, rnd.randint(0, 14)) for _ in range(120)]
    chain = [edited(base, 60)]
    for _ in range(15):
        chain.append(edited(chain[-1], 6))
    texts += chain + [["only"], ["only"], ["Only"], [], ["a", "b"], ["a", "B"]]
    rows = [(k * 7 % 1000, " ".join(t)) for k, t in enumerate(texts)] + [(None, " ".join(base)), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert held(minhash.groups(docs)) == sorted(brute(rows), key=repr)


def test_clusters_that_become_one(spark):
    """x met the hub h and w met x: what connects x with h makes one component of both clusters, but w and v, which met different hubs, still have to meet."""

    def moved(first, last, mark=None):
        words = [(f"p{k}_5" if k < first else f"q{119 - k}_5" if k >= 120 - last else f"a{k}_5") for k in range(120)]
        return " ".join(words if mark is None else [*words[:60], mark, *words[61:]])

    h, y, x, v, w = (moved(*m) for m in ((0, 0), (12, 0), (24, 0), (24, 16), (34, 16)))
    texts = [h, x, y, w, v, *(moved(0, 0, f"eh{k}") for k in range(30)), *(moved(24, 0, f"ex{k}") for k in range(6))]
    rows = list(enumerate(texts))
    expected = sorted(brute(rows), key=repr)
    assert len({c for _, _, c in expected}) == 2
    assert held(minhash.groups(spark.createDataFrame(rows, "doc_id long, text string"))) == expected


def test_posterior():
    """Its upper tail against a sum over a fine grid of similarities; fewer matches are never more probable."""
    grid = (np.arange(200_000) + 0.5) / 200_000
    for m, n in ((10, 32), (25, 32), (60, 64), (90, 128)):
        density = grid**m * (1 - grid) ** (n - m)
        assert minhash.reaches(m, n, 4, 5) == pytest.approx(density[grid >= 0.8].sum() / density.sum(), rel=1e-3)
    assert all(minhash.reaches(m, 64, 4, 5) <= minhash.reaches(m + 1, 64, 4, 5) for m in range(64))
    least = minhash.fewest(Scheme(), TWO)
    assert len(least) == 4 and all(minhash.reaches(m, 32 * (k + 1), 4, 5) >= 1e-6 > minhash.reaches(m - 1, 32 * (k + 1), 4, 5) for k, m in enumerate(least))


def test_candidates_at_the_threshold():
    """Pairs of similarity 0.8 share a band and pass the tests; pairs far below mostly don't pass."""
    rng, scheme, lost, passed = np.random.default_rng(3), Scheme(), 0, 0
    for _ in range(300):
        same, one, two = np.split(rng.integers(-(2**63), 2**63 - 1, 200), [160, 180])  # 160 of 200
        (a, s), (b, t) = (minhash.signature(np.concatenate([same, x]), scheme) for x in (one, two))
        u, v = (np.frombuffer(x, "<u2")[None] for x in (s, t))
        lost += not (a == b).any() or not len(minhash.plausible(u, v, scheme, TWO))
        far = minhash.signature(np.concatenate([same[:80], rng.integers(-(2**63), 2**63 - 1, 100)]), scheme)[1]
        passed += len(minhash.plausible(u, np.frombuffer(far, "<u2")[None], scheme, TWO))
    assert lost == 0 and passed < 5


def test_registered_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    out = queries.op11_minhash_neardup(spark, SF)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert held(out) == sorted(brute(rows), key=repr)
