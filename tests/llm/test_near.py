"""The pipeline's near copies against all pairs."""

import random

import pytest

import corpus_pipeline
from lexgrove.llm import near

from .conftest import documents


def sets(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def kept(rows):
    found = [(d, sets(t)) for d, t in rows if d is not None]
    root = {s: s for _, s in found}

    def find(s):
        while root[s] is not s and root[s] != s:
            s = root[s]
        return s

    distinct = list(root)
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if a and b and 5 * len(a & b) >= 4 * len(a | b):
                root[find(a)] = find(b)
    least = {}
    for d, s in found:
        least[find(s)] = min(d, least.get(find(s), d))
    return sorted(least.values())


def planted(seed=3):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(5000)]
    line = [rnd.choice(words) for _ in range(12)]
    texts = [[rnd.choice(words) for _ in range(rnd.randint(4, 300))] + (line if rnd.random() < 0.5 else []) for _ in range(120)]
    for t in texts[:40]:
        for share in (0.005, 0.01, 0.02, 0.04):
            texts.append([rnd.choice(words) if rnd.random() < share else w for w in t])
    texts += [[rnd.choice(words) if rnd.random() < 0.01 else w for w in texts[50]] for _ in range(60)]
    return [(k, " ".join(t)) for k, t in enumerate(texts)]


@pytest.mark.parametrize(("pairs", "common"), [(32, 4), (0, 1), (2, 1 << 40)])
def test_the_stage_finds_planted_near_copies(spark, monkeypatch, pairs, common):
    monkeypatch.setattr(near, "LIST_PAIRS", pairs)
    monkeypatch.setattr(near, "COMMON_FROM", common)
    rows = planted()
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    expected = kept(rows)
    assert len(expected) < 250 and sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, frame, "").collect()) == expected


def test_near_copies_of_messy_rows(docs, nothing):
    out = near.keep_one(docs)
    rows = sorted(r.doc_id for r in out.collect() if r.doc_id is not None)
    assert out.columns == docs.columns and rows == kept([(d, t) for d, t, *_ in documents()]) and near.keep_one(nothing).count() == 0
    assert out.where("doc_id is null").count() == 1


def test_a_large_group_makes_no_row_for_each_pair(spark, monkeypatch):
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(5000)]
    base = [rnd.choice(words) for _ in range(120)]
    texts = [base]
    for k in range(240):  # one word changed costs five shingles of 116: most stay similar to the first text, and few to each other
        cut = rnd.sample(range(120), 2 + k % 2)
        texts.append([rnd.choice(words) if i in cut else w for i, w in enumerate(base)])
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    made = []
    real = near.materialise

    def counted(df, label):
        out = real(df, label)
        if label in ("near-candidates", "near-pairs"):
            made.append(out.count())
        return out

    monkeypatch.setattr(near, "materialise", counted)
    found = sorted(r.doc_id for r in near.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert found == kept(rows)
    assert sum(made) < 8 * len(rows), made
