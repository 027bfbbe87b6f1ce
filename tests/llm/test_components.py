import random

import lexgrove.llm.components as C


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_random_graphs_in_one_part_and_in_many(spark, monkeypatch):
    rnd = random.Random(3)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(230)] + [(k, k + 1) for k in range(1000, 1080)] + [(5000, -7), (5000, -7), (9, 9)]
    frame = spark.createDataFrame(edges, "u long, v long").repartition(5)
    expected = {k: v for k, v in brute(edges).items() if any(k in e and e[0] != e[1] for e in edges)}
    for most in (1_000_000, 20):
        monkeypatch.setattr(C, "PART_LINKS", most)
        got = [tuple(r) for r in C.components(frame).collect()]
        assert dict(got) == expected and len(got) == len(expected)


def test_no_edges(spark):
    assert C.components(spark.createDataFrame([], "u long, v long")).count() == 0
