"""What larger tables bring: repeated keys, and tasks that hold a bounded share of the input."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexgrove.functions import text
from lexgrove.operators import corpus, index, quoted, retrieve, score
from lexgrove.plans import queries


def test_a_number_that_the_corpus_repeats_counts_once(spark):
    claims = spark.createDataFrame([("s", True)], "scope string, grounded boolean")
    flagged = spark.createDataFrame([("s", "7"), ("s", "8")], "scope string, number string")
    corpus = spark.createDataFrame([("7",), ("7",)], "number string")
    assert [tuple(r) for r in score.faithfulness(claims, flagged, corpus).collect()] == [("s", 1, 1, 1, 1)]


def test_terms_are_counted_in_more_tasks_for_more_text(spark, monkeypatch):
    chunks = spark.range(200).select(F.col("id").alias("chunk_id"), F.repeat(F.lit("one two three "), 20).alias("text"), F.lit("h").alias("heading"), F.lit("f").alias("file"))
    monkeypatch.setattr(index, "TASK_CHARACTERS", 4_000, raising=False)
    tasks = index.postings(chunks).groupBy(F.spark_partition_id().alias("task")).agg(F.countDistinct("chunk_id").alias("n")).collect()
    assert sum(r["n"] for r in tasks) == 200 and max(r["n"] for r in tasks) < 40


def test_placeholders_and_checks_of_files_go_to_more_tasks_for_more_rows(spark, monkeypatch):
    monkeypatch.setattr(corpus, "TASK_ROWS", 20, raising=False)
    used, declared = (spark.range(a, a + 300).select(F.col("id").alias("file"), F.col("id").alias("id")) for a in (0, 150))
    problems = corpus.undeclared(used, declared)
    assert problems.groupBy("problem").count().orderBy("problem").collect() == [("undeclared", 150), ("unused", 150)]
    chunks = spark.range(300).select(F.col("id").cast("string").alias("file"), F.lit(2).alias("n"), F.lit(2).alias("of"), F.lit("").alias("date"), F.lit(None).cast("boolean").alias("overview"))
    found = corpus.structure(chunks, chunks.select("file"), spark.createDataFrame([("0", False), ("0", True), ("x", True), ("y", False)], "file string, partial boolean"))
    assert found.groupBy("check").count().orderBy("check").collect() == [("no single overview", 300), ("numbers with gaps", 300), ("partly read but not indexed", 1), ("skipped but indexed", 1)]
    for rows in (problems, found):
        assert max(r["n"] for r in rows.groupBy(F.spark_partition_id()).agg(F.countDistinct("file").alias("n")).collect()) <= 60


def test_answers_of_one_item_stay_in_their_tasks(spark):
    runs = spark.range(800).repartition(8).select(F.when(F.col("id") >= 0, "en").otherwise("de").alias("item"), F.concat(F.lit("A "), F.col("id").cast("string")).alias("answer"))
    rules = spark.createDataFrame([("en", 1, "^a 7", "right"), ("de", 1, "a", "wrong")], "item string, place int, pattern string, verdict string")
    found = score.verdicts(runs, rules)
    assert found.where("verdict = 'right'").count() == 111
    assert "BroadcastHashJoin" in found._jdf.queryExecution().sparkPlan().toString() and found.select(F.spark_partition_id()).distinct().count() > 1


def test_python_reads_references_not_texts(spark):
    rows = spark.createDataFrame([("&lt;a&gt; b &amp;amp; c&",), ("none",), ("",), (None,), ("&#65;&notit; &nosuch;",)], "x string").coalesce(1)
    out = rows.select(text.unescape(F.col("x")).alias("y"))
    assert [r.y for r in out.collect()] == ["<a> b &amp; c&", "none", "", None, "A\u00acit; &nosuch;"]
    assert "regexp_extract_all" in next(p for p in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "ArrowEvalPython" in p)


def test_lines_of_a_thread_are_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(line):
        seen.add(1)
        return line

    lines = ["own", "> From: A B <a@x.example>", "> Date: 1 May 2026", "> Subject: s", ">", "> quoted"]
    rows = spark.createDataFrame([("f", k, x) for k, x in enumerate(lines)], "file string, line_no long, line string").repartition(2)
    got = quoted.split(rows.select("file", "line_no", told("line").alias("line"))).orderBy("pos").collect()
    assert [(r["from"], r.text) for r in got] == [("", "own"), ("A B <a@x.example>", "quoted")] and seen.value == len(lines)


def test_a_week_of_events_arrives_in_few_files_and_one_batch(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(queries, "scratch", lambda *_: f"file://{tmp_path}/place")
    at = F.timestamp_seconds(1_704_067_200 + F.col("id") * 3_600).cast("timestamp_ntz").alias("ts")
    events = spark.range(24 * 30).select(F.col("id").alias("event_id"), at, F.lit("x").alias("event_type"), F.lit(1.0).alias("value"))
    events.repartition(9).write.parquet(f"{tmp_path}/events.parquet")
    found = queries.event_windows_stream(spark, str(tmp_path)).collect()
    assert sum(r.n for r in found) == 24 * 30 and len(found) == 4 * 30 and all(r.total == r.n for r in found)
    weeks = list((tmp_path / "place" / "in").iterdir())
    assert max(len(list(w.glob("*.parquet"))) for w in weeks) <= 4
    assert len(list((tmp_path / "place" / "out" / "log").iterdir())) <= len(weeks)


def test_of_a_bucket_no_more_is_shuffled_than_can_be_chosen(spark):
    n = F.col("id")
    ranked = spark.range(3_000).select((n % 3).alias("qid"), n.alias("chunk_id"), F.concat(F.lit("b"), (n * n % 7).cast("string")).alias("bucket"), (n * 37 % 101 / 10).alias("bm25"))
    found = retrieve.diverse(ranked, "bm25", 8)
    for qid in range(3):
        rows = sorted(((r.bm25, r.chunk_id, r.bucket) for r in ranked.where(F.col("qid") == qid).collect()), key=lambda r: (-r[0], r[1]))
        firsts = {b: next(r for r in rows if r[2] == b) for b in {r[2] for r in rows}}
        best = sorted(rows, key=lambda r: (firsts[r[2]] != r, -r[0], r[1]))[:8]
        assert [r.chunk_id for r in found.where(F.col("qid") == qid).orderBy("rank").collect()] == [r[1] for r in best]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2 * plan.count("Window [")


def test_lexical_ranks_are_counted_without_sorting_all(spark):
    n = F.col("id")
    bm = spark.range(4_000).select((n % 4).alias("qid"), n.alias("chunk_id"), (n * 7919 % 523 / 97).alias("bm25"))
    wanted = bm.where("chunk_id % 41 = 0 and qid < 3")
    ranked = bm.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("bm25"), "chunk_id")))
    found = retrieve.lexical_ranks(bm, wanted)
    expected = ranked.join(wanted.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_semi").select("qid", "chunk_id", "rank")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect())) != []
    assert all("_step" in w and "chunk_id" not in w for w in found._jdf.queryExecution().sparkPlan().toString().split("\n") if "Window [" in w)
