"""Periodic runs against a brute-force search, over strings, fixtures and the registered query's whole table."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from lexgrove.llm import periodic, queries
from lexgrove.llm.common import table
from lexgrove.llm.periodic import Least

SF = "/root/testdata/sf0.001"


def brute(s, least=Least()):
    ids, found = np.unique(np.array(s, dtype=object), return_inverse=True)[1] if s else np.zeros(0, int), {}
    for q in range(1, len(s) // least.times + 1):
        same = np.concatenate([[False], ids[q:] == ids[:-q], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            if least.holds(int(b - a) + q, q):
                found.setdefault((int(a), int(b) + q), q)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def test_runs_equal_brute_force():
    rnd = random.Random(5)
    for _ in range(4000):
        least, letters, n = rnd.choice([Least(), Least(6), Least(3), Least(9)]), rnd.choice([1, 2, 3, 4, 50]), rnd.randint(0, 90)
        s = [rnd.randrange(letters) for _ in range(n)]
        for _ in range(rnd.randint(0, 3) if n > 3 else 0):
            a = rnd.randrange(n)
            p = 1 + rnd.randrange(max(1, (n - a) // 3 + 1))
            for i in range(a + p, rnd.randint(a, n)):
                s[i] = s[a + (i - a) % p]
        if rnd.random() < 0.3:  # a later copy of what has runs
            s = [*s, 77, *s[rnd.randrange(len(s) + 1) :], *s]
        want = brute(s, least)
        assert periodic.runs(s, least) == want
        assert periodic.runs_of([str(x).encode() for x in s], least) == want


def test_factors_are_longest_earlier_pieces():
    rnd = random.Random(2)
    for _ in range(300):
        s = [rnd.randrange(rnd.choice([2, 5])) for _ in range(rnd.randint(1, 60))]
        at = 0
        for start, length, source in periodic.factors(s):
            assert start == at
            earlier = lambda k: any(s[j : j + k] == s[at : at + k] for j in range(at))
            assert length == max([1, *(k for k in range(1, len(s) - at + 1) if earlier(k))])
            assert source == -1 if not earlier(1) else source < at and s[source : source + length] == s[at : at + length]
            at += length
        assert at == len(s)


def test_no_stretch_in_copied_passages():
    rnd = random.Random(3)
    passage = [b"%d" % rnd.randrange(10**6) for _ in range(60)]
    other = lambda: [b"%d" % rnd.randrange(10**6) for _ in range(200)]
    assert periodic.candidates(periodic.numbered(passage + other() + passage + other())) == []
    assert periodic.runs_of(passage * 3) == [(0, 180, 60)]


def test_long_texts():
    rnd = random.Random(4)
    base = [b"%d" % rnd.randrange(300) for _ in range(40_000)]
    assert periodic.runs_of(base * 3 + [b"end"]) == [(0, 120_000, 40_000)]
    assert periodic.runs_of([b"w"] * 200_000) == [(0, 200_000, 1)]


def test_rows_and_columns(spark, docs, nothing):
    rows = docs.select("*", docs["fp"].alias("RUNS"))
    out = periodic.collapse_runs(rows)
    assert out.columns == [*rows.columns, "runs_"]
    made, given = out.toPandas(), rows.toPandas()
    assert len(made) == len(given) and made[["lang", "n_chars"]].isna().sum().tolist() == given[["lang", "n_chars"]].isna().sum().tolist()
    known = {r["doc_id"]: r for r in out.collect() if r["doc_id"] is not None}
    for r in docs.where("doc_id is not null").collect():
        words = (r["text"] or "").encode().split()
        assert [tuple(x) for x in known[r["doc_id"]]["runs_"]] == brute(words)
        assert known[r["doc_id"]]["text"].encode() == periodic.collapsed(words, brute(words))
    assert any(r["runs_"] for r in known.values())
    assert periodic.collapse_runs(nothing).collect() == []


def test_planted_periods(spark, docs):
    made = {r["doc_id"]: r["text"] for r in periodic.planted(docs).collect()}
    written = 0
    for r in docs.collect():
        words, i = (r["text"] or "").encode().split(), r["doc_id"]
        h = zlib.crc32(str(i).encode())
        if i is None or h % 10 or not words:
            assert made[i] == r["text"] or i is None
            continue
        g, n, written = h // 10, len(words), written + 1
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        assert made[i].encode() == b" ".join(words[:a] + [words[a + (k - a) % p] for k in range(a, n)])
    assert written


@pytest.mark.parametrize("name", ["documents"])
def test_registered_query(spark, name):
    out = {r["doc_id"]: r for r in queries.op12_periodic_runs(spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in periodic.planted(table(spark, SF, name)).collect()}
    assert set(out) == set(texts) and any(r["n_runs"] for r in out.values())
    for i, text in texts.items():
        words = (text or "").encode().split()
        found = sorted(brute(words), key=lambda r: (r[0], r[2]))
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
        r = out[i]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(found), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if found else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in found).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(periodic.collapsed(words, found)).hexdigest()
