"""The audit of five filters against its SQL, against a plain recount, and over many small ranges."""

import glob
import os
import random
from itertools import permutations

import duckdb
import pytest

from lexgrove.llm import filter_audit, queries

SF = "/root/testdata/sf0.001"


def fails(text, words=None):
    words = (text or "").encode().split()
    t = text or ""
    signs = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), any(c in "#$%&*|" for c in t)]
    return "".join(f for f, bad in zip("ABCD", signs, strict=True) if bad)


def recount(rows, labels):
    """rows (doc_id, text, source) one by one, order by order."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    masked = [(i, s or "", fails(t) + ("E" if i is not None and least[t or ""] < i else "")) for i, t, s in rows]
    out, shapley = {}, {}
    for o in map("".join, permutations("ABCDE")):
        for i, part, f in masked:
            gone = False
            for step, x in enumerate(o, 1):
                c = out.setdefault((part, o, step), [0] * 6)
                if x in f:
                    c[3] += f == x
                    if gone:
                        c[2] += 1
                    else:
                        c[1] += 1
                        c[4] += i in good
                        c[5] += i in toxic
                        shapley[part, x] = shapley.get((part, x), 0) + 1
                        gone = True
                c[0] += not gone
    return {k: (*c, shapley.get((k[0], k[1][k[2] - 1]), 0)) for k, c in out.items()}


def found(frame):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in filter_audit.COUNTS) for r in frame.collect()}


def test_against_a_recount(spark, docs, nothing):
    labels = spark.createDataFrame([(k, k % 2, k % 3 if k % 5 else None) for k in range(0, 150, 3)] + [(6, 0, 1), (6, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    assert found(filter_audit.audit(docs, labels)) == recount(rows, [tuple(r) for r in labels.collect()])
    assert found(filter_audit.audit(nothing, labels)) == {}
    none = found(filter_audit.audit(docs, labels.limit(0)))
    assert all(c[4] == c[5] == 0 for c in none.values()) and len(none) == 600 * len({r[2] or "" for r in rows})


@pytest.mark.parametrize("seed", range(3))
def test_copies_across_ranges(spark, seed):
    """Many ranges cut through the rows of one text; equal hashes of other texts stand between."""
    rnd = random.Random(seed)
    rows = [(rnd.randrange(400) if rnd.random() > 0.05 else None, rnd.choice(["same"] * 6 + ["two", None, "", f"one {rnd.random()}"]), "s") for _ in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        copies = filter_audit.failures(docs).where("mask >= 16").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r["doc_id"] for r in copies) == sorted(i for i, t, _ in rows if i is not None and least[t or ""] < i)


def test_equal_hashes_of_different_texts():
    """Within a range and across the ends of ranges, texts decide and not their hashes."""
    import pyarrow as pa

    def part(rows):
        names, kinds = ["fp", "text", "doc_id", "part", "mask"], [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32()]
        batches = [pa.RecordBatch.from_arrays([pa.array([r[k]], kinds[k]) for k in range(5)], names) for r in rows]
        return [x for b in filter_audit._neighbours(iter(batches)) for x in b.to_pylist()]

    first = part([(1, "a", 5, "s", 0), (1, "a", 7, "s", 0), (1, "b", 2, "s", 0)])
    assert [(x["doc_id"], x["mask"]) for x in first[:3]] == [(5, 0), (7, 16), (2, 0)]
    second = part([(1, "a", 9, "s", 0), (1, "b", 1, "s", 0), (2, "c", 3, "s", 0)])
    tells = {x["key"]: x["doc_id"] for x in first[3:]}
    assert sorted(tells.values()) == [2, 5]
    waiting = [x for x in second if x["part"] and x["key"]]
    assert [(x["doc_id"], tells[x["key"]] < x["doc_id"]) for x in waiting] == [(9, True), (1, False)]


def test_registered_query_equals_its_sql(spark):
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    cursor = c.execute(queries.ORACLE_SQL["op13_filter_audit"])
    names = [d[0] for d in cursor.description]
    frame = queries.op13_filter_audit(spark, SF)
    assert sorted(names) == sorted(frame.columns)
    assert sorted(tuple(r) for r in frame.select(*names).collect()) == sorted(cursor.fetchall())
