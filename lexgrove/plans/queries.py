"""The registered queries: each applies one operator to the whole of the tables it reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as X
from ..operators import audit as U
from ..operators import corpus as P
from ..operators import coverage as V
from ..operators import index as I
from ..operators import phrases as H
from ..operators import quoted as Q
from ..operators import retrieve as R
from ..operators import score as E
from ..operators import segment as S
from ..operators import segments as G
from ..operators import sessions as M
from ..operators import threads as T
from ..operators import verify as C
from ..session import keep, parts, scratch
from ..sources.files import audit, parse_questions
from ..streaming import live as L
from . import cases, derived, prompts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _rows(spark: SparkSession, table: cases.Table) -> DataFrame:
    return spark.createDataFrame(table.rows, table.schema)


def _chunks(spark, sf):
    return I.chunks_of(_t(spark, sf, "documents"))


def _asked(spark, sf):
    return _t(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def _bm25(spark, sf, questions):
    chunks = _chunks(spark, sf)
    posts = keep(I.postings(chunks), "postings")
    return R.bm25(posts, I.statistics_of(posts, chunks), I.document_frequency(posts), questions)


def _long(*names):
    return [F.col(n).cast("long").alias(n) for n in names]


# -- index and ranking
@query
def tokenize_terms(spark, sf):
    return I.postings(_chunks(spark, sf)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query
def term_frequencies(spark, sf):
    p = I.postings(_chunks(spark, sf))
    return p.groupBy("chunk_id").agg(F.count("*").alias("terms"), F.max("tf").alias("most"), F.max("n_tokens").cast("long").alias("n_tokens"))


@query
def corpus_stats(spark, sf):
    return I.corpus_statistics(I.lengths(_chunks(spark, sf))).select("n_chunks", F.col("n_tokens").cast("long").alias("n_tokens"), F.round("avg_tokens", 6).alias("avg_tokens"))


@query
def bm25_batch_benchmark(spark, sf):
    return R.top(_bm25(spark, sf, _asked(spark, sf)), "bm25", 5).select("qid", *_long("rank"), "chunk_id", "bm25")


@query
def bm25_scoped_global_stats(spark, sf):
    chunks = _chunks(spark, sf)
    posts = keep(I.postings(chunks), "postings")
    scoped = posts.join(chunks.where(X.in_scope(F.col("file"), F.lit("src1/"))).select("chunk_id"), "chunk_id", "left_semi")
    bm = R.bm25(scoped, I.statistics_of(posts, chunks), I.document_frequency(posts), _asked(spark, sf))
    return R.top(bm, "bm25", 5).select("qid", *_long("rank"), "chunk_id", "bm25")


@query
def incremental_index(spark, sf):
    """BM25 after four batches: most documents, the others, then a third of all changed, replaced or removed."""
    docs = _t(spark, sf, "documents")
    index = G.Segments(spark, scratch(spark, "index"))
    third = F.pmod(F.col("doc_id"), F.lit(9))
    amended = docs.where(third.isin(1, 2)).withColumn("text", F.when(third == 1, F.concat("text", F.lit(" amended and amended again"))).otherwise(F.concat(F.lit("replaced by "), F.left("text", F.lit(200)))))
    for part, gone in ((docs.where(third != 0), False), (docs.where(third == 0), False), (amended, False), (docs.where(third == 3), True)):
        chunks = I.chunks_of(part)
        hashes = chunks.select("file", F.lit(None).cast("string").alias("sha256") if gone else F.sha2("text", 256).alias("sha256"))
        index.apply(hashes, chunks)
    bm = R.bm25(*G.bm25_inputs(index), _asked(spark, sf))
    return R.top(bm, "bm25", 5).select("qid", *_long("rank"), "chunk_id", "bm25")


def _vectors(spark, sf):
    return _t(spark, sf, "embeddings").select("vec_id", R.unit(F.col("embedding")).alias("v"))


@query
def normalise_vectors(spark, sf):
    v = _vectors(spark, sf)
    return v.select("vec_id", F.size("v").cast("long").alias("n"), F.get("v", F.lit(0)).alias("first"), F.round(R.dot(F.col("v"), F.col("v")), 3).alias("norm"))


@query
def cosine_topk(spark, sf):
    v = _vectors(spark, sf)
    asked = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("v").alias("q"))
    return R.cosine(v, asked, 5).select("qid", *_long("rank"), "chunk_id", F.round("cos", 4).alias("cos"))


def _asked_vectors(spark, sf):
    """Synthetic pairing: a benchmark item asks with the vector of its number, and vectors belong to the documents of theirs."""
    return _vectors(spark, sf).join(_asked(spark, sf).select(F.col("qid").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("qid"), F.col("v").alias("q"))


@query
def rrf_fusion(spark, sf):
    fused = R.fused_top(keep(_bm25(spark, sf, _asked(spark, sf)), "bm25"), _vectors(spark, sf), _asked_vectors(spark, sf), 10)
    return fused.select("qid", *_long("rank"), "chunk_id", F.round("rrf", 8).alias("rrf"))


@query
def diverse_topk(spark, sf):
    bm = _bm25(spark, sf, _asked(spark, sf)).where("bm25 > 0")
    bucketed = bm.join(_chunks(spark, sf).select("chunk_id", X.source_key(F.col("file"), F.col("heading")).alias("bucket")), "chunk_id")
    return R.diverse(bucketed, "bm25", 8).select("qid", *_long("rank"), "chunk_id", "bucket")


@query
def round_robin_select(spark, sf):
    bucketed = _chunks(spark, sf).select("chunk_id", "corpus_pos", X.source_key(F.col("file"), F.col("heading")).alias("bucket"))
    return R.round_robin(bucketed, T.SUMMARY_BUDGET).select("chunk_id", "bucket", *_long("turn"))


@query
def source_buckets(spark, sf):
    root = F.when(F.col("chunk_id") % 3 == 0, F.col("chunk_id").cast("string")).otherwise(F.col("file"))
    return _chunks(spark, sf).select(X.source_key(root, F.col("heading")).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


@query
def folder_mention(spark, sf):
    return R.folders_named(_rows(spark, cases.QUESTIONS), _chunks(spark, sf))


@query
def quota_retrieval(spark, sf):
    questions, chunks = _rows(spark, cases.QUESTIONS), _chunks(spark, sf)
    fused = keep(R.rrf(_bm25(spark, sf, questions), None), "fused")
    folder = chunks.select("chunk_id", F.split_part("file", F.lit("/"), F.lit(1)).alias("grp"))
    groups = R.folders_named(questions, chunks).withColumnRenamed("folder", "grp")
    kept = R.quota(fused, groups.join(folder, "grp"), groups, 8)
    return kept.join(folder, "chunk_id").select("qid", *_long("rank"), "chunk_id", "grp")


@query
def dense_rescue(spark, sf):
    cos = R.cosine(_vectors(spark, sf), _asked_vectors(spark, sf), 2).select("qid", "chunk_id", "cos").where("qid <> chunk_id")
    hits = R.top(_bm25(spark, sf, _asked(spark, sf)).withColumn("cos", F.lit(None).cast("double")), "bm25", 5)
    return R.dense_rescue(hits, cos, 0.2).where("origin = 'dense'").select("qid", "chunk_id", F.round("cos", 4).alias("cos"))


def _figure_questions(spark, sf):
    """One question for each source, about its largest figure of 3 to 15 digits."""
    found = _chunks(spark, sf).select(F.split_part("file", F.lit("/"), F.lit(1)).alias("s"), F.explode(F.regexp_extract_all("text", F.lit(r"[0-9]+"), F.lit(0))).alias("n"))
    big = found.where("length(n) between 3 and 15 and not n rlike '^(19|20)[0-9][0-9]$'").groupBy("s").agg(F.max(F.col("n").cast("long")).alias("n"))
    return big.select(F.regexp_replace("s", "src", "").cast("long").alias("qid"), F.concat(F.lit("the and of "), F.col("n").cast("string")).alias("question"))


@query
def number_rescue(spark, sf):
    questions = _figure_questions(spark, sf)
    bm = keep(_bm25(spark, sf, questions), "bm25")
    hits = R.top(bm, "bm25", 1)
    return R.number_rescue(hits, _chunks(spark, sf), questions, bm).select("qid", "chunk_id", "bm25")


@query
def refusal_gate(spark, sf):
    questions = _asked(spark, sf).union(_rows(spark, cases.QUESTIONS).select("qid", "question"))
    hits = R.top(_bm25(spark, sf, questions).withColumn("cos", F.lit(None).cast("double")), "bm25", 5)
    return R.gate(hits, questions, min_score=20.0).select("qid", *_long("n_hits"), "bm25_top", "refused")


@query
def scope_filter(spark, sf):
    scopes = _rows(spark, cases.SCOPES)
    pairs = _chunks(spark, sf).select("file").join(F.broadcast(scopes), X.in_scope(F.col("file"), F.col("scope")))
    return pairs.groupBy("scope").agg(F.count("*").alias("n"))


@query
def token_estimate(spark, sf):
    d = _t(spark, sf, "documents").groupBy("source").agg(F.sum(F.length("text")).alias("chars"))
    return d.select("source", X.estimate_tokens(F.col("chars")).cast("long").alias("tokens"))


@query
def prompt_assembly(spark, sf):
    chunks = _chunks(spark, sf).withColumn("title", F.lit(""))
    hits = R.top(_bm25(spark, sf, _asked(spark, sf)), "bm25", 2).withColumnRenamed("rank", "label").join(chunks, "chunk_id")
    p = prompts.sources_prompt(hits, _asked(spark, sf))
    return p.select("qid", F.length("prompt").cast("long").alias("chars"), F.sha2("prompt", 256).alias("sha256"))


# -- segmentation
@query
def html_strip(spark, sf):
    p = X.html_stripped(_t(spark, sf, "pages").select("page_id", F.col("html").alias("text")), "text")
    return p.select("page_id", F.length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("sha256"))


def _page_lines(spark, sf):
    return S.forward_headings(S.lines(S.sections(S.page_lines(_t(spark, sf, "pages")))))


@query
def heading_forward_fill(spark, sf):
    rows = _page_lines(spark, sf).where("not is_heading")
    return rows.groupBy("file").agg(F.count("*").alias("lines"), F.countDistinct("heading").alias("headings"), F.max("heading").alias("last_heading"))


@query
def segment_lines(spark, sf):
    raw = S.raw_chunks(_page_lines(spark, sf)).where("text <> ''")
    return raw.select("file", *_long("first_line"), "heading", "title", F.sha2("text", 256).alias("sha256"))


@query
def merge_fold(spark, sf):
    m = S.merge(S.raw_chunks(_page_lines(spark, sf)).where("text <> ''"))
    return m.select("chunk_id", "heading", F.length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("sha256"))


@query
def page_split(spark, sf):
    turns = _t(spark, sf, "conversations")
    docs = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\f").alias("text"))
    parts = S.sections(docs.select(F.col("conv_id").cast("string").alias("file"), "text"))
    return parts.select("file", *_long("section"), F.col("base").alias("heading"), F.length("text").cast("long").alias("chars"))


@query
def markdown_chunks(spark, sf):
    return S.chunk(derived.markdown(spark, sf)).select("chunk_id", "heading", "title", "text")


# -- threads
def _messages(spark, sf):
    """Turns as messages: the roles write to each other; threads of even number have dates."""
    c = _t(spark, sf, "conversations")
    day = F.date_add(F.to_date(F.lit("2024-03-01")), (F.col("turn") / 2).cast("int"))
    to = F.when(F.col("role") == "user", "assistant").otherwise("user")
    return c.select(
        F.col("conv_id").cast("string").alias("file"), F.col("turn").cast("int").alias("pos"), F.col("role").alias("sender"), F.when(F.col("turn") == 5, F.col("role")).otherwise(to).alias("recipient"),
        F.when(F.col("conv_id") % 2 == 0, F.date_format(day, "yyyy-MM-dd")).otherwise("").alias("date"), F.concat(F.when(F.col("turn") % 3 == 1, "Re: ").when(F.col("turn") % 3 == 2, "Fwd: ").otherwise(""), F.lit("topic")).alias("subject"),
        F.lit(False).alias("subject_inherited"), "text",
    )


@query
def thread_order(spark, sf):
    return T.ordered(_messages(spark, sf)).select("file", *_long("pos", "n", "of"), "date")


@query
def thread_overview(spark, sf):
    return T.overview(T.ordered(_messages(spark, sf))).select("file", *_long("of"), "names", "text")


@query
def nth_message(spark, sf):
    m = T.ordered(_messages(spark, sf))
    second, last = T.nth_of_sender(m, 2), T.nth_of_sender(m, -1)
    return second.select(F.lit("second").alias("which"), "file", "sender", *_long("n")).union(last.select(F.lit("last").alias("which"), "file", "sender", *_long("n")))


@query
def message_meta_join(spark, sf):
    m = T.ordered(_messages(spark, sf))
    head = F.trim(F.concat_ws(" ", F.nullif("date", F.lit("")), F.concat_ws(" -> ", "sender", "recipient")))
    return T.with_meta(m.select("file", head.alias("heading"), "pos"), m).select("file", "heading", *_long("pos", "n"), "sender")


@query
def gather_budget(spark, sf):
    m = T.ordered(_messages(spark, sf))
    chunks = m.select(F.col("file").alias("thread"), F.concat_ws("#", "file", "pos").alias("chunk_id"), F.col("n").cast("long").alias("corpus_pos"), (F.col("n") == 1).alias("overview"), F.col("sender").alias("bucket"))
    return T.gather(chunks, 4).select("thread", "chunk_id", "overview", *_long("dropped"))


_MAIL_QUESTIONS = [(1, "What did the assistant say in the last message?"), (2, "What did the user write on 2024-03-02?"), (3, "Summarise the whole thread"), (4, "Nothing of the kind")]


def _mail(spark, sf):
    """Questions, and all messages as chunks."""
    m = T.marked_self(T.ordered(_messages(spark, sf)))
    chunks = m.select("file", "n", "sender", "date", "is_self", F.lit(False).alias("overview"), F.concat_ws("#", "file", F.col("pos").cast("string")).alias("chunk_id"), (F.col("file").cast("long") * 100 + F.col("pos")).alias("corpus_pos"), F.col("pos").cast("string").alias("heading"))
    return spark.createDataFrame(_MAIL_QUESTIONS, "qid long, question string"), keep(chunks, "mail")


@query
def message_targets(spark, sf):
    """Whose messages questions mean, and which of them: by an ordinal, by a day."""
    asked, chunks = _mail(spark, sf)
    target = T.targets(asked, chunks)
    found = T.target_chunks(asked, chunks, target).groupBy("qid", "sender").agg(F.count("*").alias("chunks"), F.min("corpus_pos").alias("first"), F.max("corpus_pos").alias("last"))
    return target.join(found, ["qid", "sender"], "left").select("qid", "sender", "via", "chunks", "first", "last")


@query
def message_reads(spark, sf):
    """What is read whole for the same questions: the messages meant if they are few, all within a budget for a broad one."""
    asked, chunks = _mail(spark, sf)
    return T.reads(asked, chunks, T.targets(asked, chunks)).select("qid", "chunk_id", *_long("place", "dropped"))


@query
def plan_read(spark, sf):
    t = _messages(spark, sf).groupBy("file").agg(F.count("*").alias("chunks"), F.count_if(F.col("sender") == "user").alias("target_chunks"))
    planned = T.plan_read(t, F.col("chunks") % 2 == 0, F.col("chunks") % 3 > 0, most=2)
    return planned.select("file", "chunks", "target_chunks", "plan")


@query
def thread_split(spark, sf):
    m = Q.split(derived.threads(spark, sf))
    return m.select("file", *_long("pos"), F.col("from").alias("sender"), F.col("to").alias("recipient"), "subject", "date_raw", F.sha2("text", 256).alias("sha256"))


@query
def nested_messages(spark, sf):
    """Turns as attached messages: each hangs under the one of half its number; every third has a subject of its own."""
    c = _t(spark, sf, "conversations")
    parent = F.when(F.col("turn") > 0, F.floor((F.col("turn") - 1) / 2))
    subject = F.when(F.col("turn") == 0, F.concat(F.lit("Re: top "), F.col("conv_id").cast("string"))).when(F.col("turn") % 3 == 2, F.concat(F.lit("Fwd: part "), F.col("turn").cast("string")))
    n = T.nested(c.select(F.col("conv_id").alias("file"), F.col("turn").alias("part"), parent.alias("parent"), subject.alias("subject")))
    return n.select("file", "part", "subject", "inherited", *_long("depth"), "path")


@query
def first_seen_names(spark, sf):
    m = _messages(spark, sf).groupBy("file", "sender").agg(F.min("pos").alias("at"))
    return m.groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "sender"))), lambda x: x["sender"]), ", ").alias("names"))


@query
def senders_named(spark, sf):
    return T.senders_named(derived.sender_questions(spark, sf), derived.senders(spark, sf))


@query
def dates_named(spark, sf):
    days = _t(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    named = T.dates_named(_rows(spark, cases.ROUTING), days)
    return named.groupBy("qid").agg(F.count("*").alias("days"), F.min(F.date_format("day", "yyyy-MM-dd")).alias("first"), F.max(F.date_format("day", "yyyy-MM-dd")).alias("last"))


@query
def ordinals_named(spark, sf):
    return derived.ordinal_questions(spark, sf).select("qid", T.ordinals_named(F.col("question")).cast("long").alias("ordinal"))


@query
def subject_verbs(spark, sf):
    s = derived.subjects(spark, sf)
    return s.select("id", X.base_subject(F.col("subject")).alias("base"), X.subject_verb(F.col("subject"), F.lit(False), F.lit(False)).alias("verb"))


@query
def display_names(spark, sf):
    return derived.parties(spark, sf).select("id", X.display_name(F.col("party")).alias("name"))


@query
def date_parse_cascade(spark, sf):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 8
    c = lambda *f: F.concat(*(F.date_format(d, x) for x in f))
    raw = (
        F.when(k == 0, c("EEEE, MMMM d, yyyy 'at' h:mm a")).when(k == 1, c("d MMMM yyyy HH:mm")).when(k == 2, c("yyyy-MM-dd HH:mm")).when(k == 3, c("dd.MM.yyyy"))
        .when(k == 4, c("M/d/yyyy")).when(k == 5, F.concat(F.date_format(d, "yyyy"), F.lit("년 "), F.date_format(d, "M"), F.lit("월 "), F.date_format(d, "d"), F.lit("일")))
        .when(k == 6, c("MMM d, yyyy")).otherwise(F.lit("no date"))
    )
    return _t(spark, sf, "orders").select("o_orderkey", D.loose_date(raw).alias("iso"))


@query
def human_dates(spark, sf):
    o = _t(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d")).groupBy("d").agg(F.count("*").alias("n"))
    return o.select(F.date_format("d", "yyyy-MM-dd").alias("iso"), D.human_date(F.col("d")).alias("text"), "n")


# -- checks
@query
def verify_numbers(spark, sf):
    d = _t(spark, sf, "documents")
    answers = d.select(F.col("doc_id").alias("qid"), F.col("text").alias("answer"))
    sources = d.select((F.col("doc_id") - 1).alias("qid"), F.lit("").alias("heading"), "text")
    return C.unverified_numbers(answers, sources)


@query
def phrase_mentions(spark, sf):
    """Beginnings of the benchmark's items in all documents."""
    start = F.regexp_extract("text", r"^(?:\S+\s){4}\S+", 0)
    return H.phrases_in(_t(spark, sf, "documents"), ["doc_id"], "text", _t(spark, sf, "benchmark").select(start.alias("phrase"))).select("doc_id", F.lower("phrase").alias("phrase")).distinct()


@query
def verify_citation_numbers(spark, sf):
    return C.mis_cited(derived.answers(spark, sf), derived.sources(spark, sf))


@query
def verify_citations(spark, sf):
    return C.forged(derived.answers(spark, sf), derived.sources(spark, sf)).select("qid", *_long("label"))


@query
def verify_attribution(spark, sf):
    return C.unverified_attributions(derived.answers(spark, sf), derived.sources(spark, sf))


@query
def verify_negatives(spark, sf):
    return C.unverified_negatives(derived.answers(spark, sf), derived.sources(spark, sf))


@query
def verify_grounding(spark, sf):
    return C.ungrounded(derived.answers(spark, sf)).select("qid", *_long("claim_no"), "claim")


@query
def inference_labels(spark, sf):
    return derived.answers(spark, sf).select("qid", C.missing_inference(F.col("answer")).alias("missing"))


@query
def cap_citations(spark, sf):
    return derived.answers(spark, sf).select("qid", C.cap_citations(F.col("answer")).alias("answer"))


@query
def resolve_citations(spark, sf):
    return C.resolve_citations(derived.answers(spark, sf), derived.sources(spark, sf))


@query
def spelled_numbers(spark, sf):
    return derived.spelled(spark, sf).select("id", F.array_join(C.spelled_numbers(F.col("text")), ",").alias("numbers"))


@query
def refusal_text(spark, sf):
    d = _t(spark, sf, "documents")
    made = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("**Not in the documents.** "), F.col("text"))).when(F.col("doc_id") % 5 == 1, F.concat("text", F.lit(" It is not specified in the sources [S2]."))).otherwise(F.col("text"))
    return d.select("lang", X.is_refusal(made).alias("refusal")).groupBy("lang", "refusal").agg(F.count("*").alias("n"))


@query
def loop_detector(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", X.looks_stuck(F.col("text")).alias("stuck"))


@query
def finish_status(spark, sf):
    e = _t(spark, sf, "events")
    finish = F.when(F.col("event_type") == "error", "length").when(F.col("event_type") == "signup", "loop").otherwise("stop")
    answer = F.when(F.col("value") < 5, " ").otherwise("text")
    return e.select(F.coalesce(C.finish_warning(finish, answer), F.lit("none")).alias("warning")).groupBy("warning").agg(F.count("*").alias("n"))


# -- audit and scores
def _audit(spark, sf):
    """Events as audit records: errors failed, low values were refused by the gate, views end in a refusal by the model."""
    e = _t(spark, sf, "events")
    return e.select(
        "event_id", "user_id", "event_type", "ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("when"), F.when(F.col("event_type") == "error", "failed").alias("error"), (F.col("value") < 10).alias("refused"),
        F.when(F.col("event_type") == "view", "Not in the documents.").otherwise("an answer [S1]").alias("answer"), F.when(F.col("value") > 90, F.array(F.lit("TRUNCATED: x"))).otherwise(F.array().cast("array<string>")).alias("warnings"),
        F.struct(F.get_json_object("props", "$.k").cast("long").alias("total_tokens")).alias("usage"),
    )


@query
def audit_counters(spark, sf):
    return U.counters(_audit(spark, sf), ["user_id"])


@query
def audit_last_wins(spark, sf):
    last = U.last_wins(_audit(spark, sf), F.col("user_id"), "event_id")
    return last.select("user_id", "event_id", "event_type", "refused")


@query
def history_tail(spark, sf):
    return U.history(_t(spark, sf, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type", 20).select("user_id", "event_id", "event_type")


@query
def history_lines(spark, sf):
    d = _t(spark, sf, "documents")
    e = U.encode_line(F.col("text"))
    return d.select("doc_id", F.sha2(e, 256).alias("encoded"), (U.decode_line(e) == F.col("text")).alias("same"))


@query
def note_blockers(spark, sf):
    return U.note_blocker(_audit(spark, sf)).groupBy(F.coalesce("blocker", F.lit("none")).alias("blocker")).agg(F.count("*").alias("n"))


@query
def note_names(spark, sf):
    e = _audit(spark, sf).select("event_id", F.col("when").alias("ts"), F.col("event_id").alias("qid"), F.concat_ws(" ", F.lit("What of"), "event_type", F.lit("for the 1st user, please, again?")).alias("question"))
    return U.note_names(e).select("event_id", "note")


@query
def machine_slugs(spark, sf):
    s = _t(spark, sf, "supplier")
    return s.select("s_suppkey", X.machine_slug(F.concat(F.lit("--"), F.col("s_name"), F.lit(".Local Net!"))).alias("slug"))


@query
def event_windows(spark, sf):
    w = L.event_counters(_t(spark, sf, "events"), "6 hours")
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@query
def event_windows_stream(spark, sf):
    """The same counts from a stream: parts of a week, in the order in which events arrive, up to two hours late; some are sent again, long after."""
    e = _t(spark, sf, "events").select("event_id", "ts", "event_type", "value")
    late = F.make_interval(mins=F.pmod(F.xxhash64("event_id"), F.lit(120)).cast("int"))
    arrival = F.col("ts") + late
    first = e.agg(F.date_trunc("day", F.min("ts").cast("timestamp"))).scalar()
    part = F.floor(F.datediff(arrival.cast("timestamp"), first) / 7).cast("int")
    again = e.where("event_id % 10 = 0").withColumn("part", part + 2)
    place = scratch(spark, "arrivals")
    sent = e.withColumn("part", part).union(again)
    files = L.arrive(sent, f"{place}/parts", f"{place}/in")  # one part for each week of events
    stream = spark.readStream.schema(e.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files).parquet(f"{place}/in")
    L.follow_counters(stream, f"{place}/out", f"{place}/checkpoint", "6 hours", "8 days").awaitTermination()
    w = L.current_counters(spark, f"{place}/out")
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


def _turns(spark, sf):
    """Events as turns of a chat with their users."""
    a = _audit(spark, sf)
    return a.select(F.col("user_id").alias("user"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.concat_ws(" ", F.lit("about"), "event_type").alias("question"), F.when(F.col("event_type") != "error", F.col("answer")).alias("answer"), "refused")


@query
def session_memory(spark, sf):
    m = M.remembered(_turns(spark, sf), 600)
    return m.select(F.col("seq").alias("event_id"), F.date_format("session", "yyyy-MM-dd HH:mm:ss").alias("session"), F.col("previous.seq").alias("previous"), "query")


@query
def session_table(spark, sf):
    s = M.sessions(_turns(spark, sf), 600)
    return s.select("user", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.date_format("end", "yyyy-MM-dd HH:mm:ss").alias("end"), "turns", "kept")


def _scored(spark, sf):
    """Two rules that predict a label: by length, and by script."""
    d = _t(spark, sf, "documents").join(_t(spark, sf, "labels"), "doc_id")
    label = F.when(F.col("toxic") == 1, "WRONG").when(F.col("quality") == 1, "CORRECT").otherwise("SILENT")
    return d.select("doc_id", "lang", "source", label.alias("label"), (F.col("n_chars") > 1000).alias("warned"), ((F.col("n_chars") > 500).cast("int") == F.col("quality")).alias("passed"), (F.length(F.regexp_replace("text", "[ -~]", "")) * 20 < F.length("text")).alias("ascii"), "quality")


@query
def class_table(spark, sf):
    return E.class_table(_scored(spark, sf), "lang")


@query
def wilson_interval(spark, sf):
    return E.pass_rates(_scored(spark, sf), "source")


@query
def scorecard_rollup(spark, sf):
    return E.scorecard(_scored(spark, sf), "lang")


@query
def mcnemar_exact(spark, sf):
    s = _scored(spark, sf)
    b = s.select("doc_id", (F.col("ascii").cast("int") == F.col("quality")).alias("passed"))
    return E.paired(s, b, "doc_id", "source")


@query
def pairs_agree(spark, sf):
    g = E.pairs_agree(_scored(spark, sf).withColumn("pair", F.floor(F.col("doc_id") / 2)), "pair")
    return g.agg(F.count("*").alias("pairs"), F.count_if("all_correct").alias("all_correct"), F.count_if("any_wrong").alias("any_wrong"))


@query
def sweep_table(spark, sf):
    e = _t(spark, sf, "events")
    runs = e.select(F.col("event_type").alias("setting"), (F.col("user_id") % 10).alias("item"), F.col("props").alias("answer"), F.when(F.col("value") > 50, "correct").otherwise("wrong").alias("verdict"))
    return E.sweep(runs)


@query
def score_items(spark, sf):
    return E.passes(derived.items(spark, sf)).select("n", "passed")


@query
def score_three_way(spark, sf):
    return E.three_way(derived.items(spark, sf)).select("n", "label")


def _cast(kind: str):
    return F.array().cast(kind)


@query
def score_judged(spark, sf):
    """Documents as answers about one party's fee: the number of each decides which condition it meets."""
    d = _t(spark, sf, "documents").select("doc_id", "lang")
    k, fee = F.col("doc_id") % 12, (F.col("doc_id") + 1000).cast("string")
    when = lambda n, value: F.when(k == n, value)
    said = F.concat(F.when((k == 7) & (F.col("lang") == "de"), "Firm Bravo").otherwise("Firm Alpha"), F.lit(" quoted $"), fee, F.lit(" [S1]."))
    answer = F.when(k == 0, None).when(k.isin(3, 4), "Not in the documents.").when(k == 11, "As in [S9].").otherwise(said)
    price, none = F.concat(F.lit("$"), fee), _cast("array<string>")
    items = d.select(
        F.col("doc_id").alias("qid"), F.when(k == 4, "refuse").otherwise("fact").alias("type"), F.lit("What did Alpha quote?").alias("question"), answer.alias("answer"), when(1, "failed").alias("error"), F.lit(False).alias("refused"),
        *(none.alias(c) for c in ("warnings", "names", "cite_must", "cite_must_not", "expect_warning", "forbid_warning")), when(5, F.array(F.lit("9 May"))).alias("must"), _cast("array<array<string>>").alias("any"),
        when(2, F.array(price)).alias("must_not"), when(8, F.array(F.struct(price.alias("token"), F.array(F.lit("per patent")).alias("licences")))).alias("must_not_unless"),
        when(9, F.array(F.struct(F.lit("alpha").alias("token"), F.lit("quoted .[0-9]").alias("pattern")))).alias("cooccur"), (k == 10).alias("forbid_amounts"), when(7, F.array(F.lit("Bravo"))).alias("names_not"), F.lit(True).alias("local"),
    )
    held = F.when(k == 6, F.col("doc_id") + 1001).otherwise(F.col("doc_id") + 1000).cast("string")
    sources = d.select(F.col("doc_id").alias("qid"), F.lit(1).alias("label"), F.lit("alpha/fees.md").alias("file"), F.concat(F.lit("Fee of "), held).alias("text"))
    numbers = d.where("doc_id % 24 <> 19").select(fee.alias("number"))
    found = E.judged(items, sources, _rows(spark, cases.ALIASES), numbers)
    return found.select("qid", "label", F.array_join("reasons", "; ").alias("reasons"), "forged", "misplaced")


@query
def banned_sources(spark, sf):
    """Amounts that only a file has which must not be cited."""
    items = derived.answers(spark, sf).withColumn("cite_must_not", F.array(F.lit("alpha/"), F.lit("bravo/")))
    return E.banned_sources(items, derived.sources(spark, sf)).select("qid", "amount", "fragment")


@query
def summary_faithfulness(spark, sf):
    """Answers as summaries of their source: claims with and without citation, and numbers that its documents don't have but perhaps others do."""
    said = derived.answers(spark, sf)
    scope = _t(spark, sf, "documents").select(F.col("doc_id").alias("qid"), F.col("source").alias("scope"))
    lines = said.select("qid", F.explode(F.split("answer", "\n")).alias("claim"))
    bare = C.ungrounded(said).groupBy("qid").agg(F.count("*").alias("_n"))
    claims = lines.groupBy("qid").agg(F.count("*").alias("_all")).join(bare, "qid", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    flags = F.transform(F.sequence(F.lit(1).cast("long"), F.col("_all")), lambda i: i > F.col("_n"))
    claims = claims.join(scope, "qid").select("scope", F.explode(flags).alias("grounded"))
    flagged = C.unverified_numbers(said, derived.sources(spark, sf)).join(scope, "qid").select("scope", F.regexp_replace("number", ",", "").alias("number"))
    corpus = _t(spark, sf, "orders").select((F.col("o_orderkey") * 1000).cast("string").alias("number")).union(_t(spark, sf, "part").select((F.col("p_partkey") + 2311000).cast("string")))
    return E.faithfulness(claims, flagged, corpus)


@query
def envelope_lines(spark, sf):
    return E.envelope(E.class_table(_scored(spark, sf), "lang"), "lang").select(*_long("line_no"), "line")


@query
def audit_log(spark, sf):
    """Records appended by two machines as JSON lines and read again, with lines between that are none."""
    place = scratch(spark, "audit")
    records = _audit(spark, sf).withColumn("qid", F.col("event_id")).select("ts", "qid", "user_id", "error", "refused", "answer", "warnings", "usage")
    for machine, k in (("Left Desk", 0), ("right.desk", 1)):
        U.append(records.where(F.pmod("qid", F.lit(2)) == k), place, machine)
    records.limit(0).select(F.lit("x")).union(spark.range(3).select(F.lit("no record"))).coalesce(1).write.mode("append").text(f"{place}/machine=right-desk")
    kind = "qid long, user_id long, error string, refused boolean, answer string, warnings array<string>, usage struct<total_tokens: bigint>"
    return U.counters(audit(spark, place, kind), ["user_id"])


@query
def notes_of_records(spark, sf):
    """Notes of all records that may become one, each with two sources."""
    a = _audit(spark, sf).select("event_id", "user_id", F.col("when").alias("ts"), F.col("event_id").alias("qid"), F.concat_ws(" ", F.lit("What of"), "event_type", F.lit("for  the 1st user, please, again?")).alias("question"), "refused", "answer", "warnings")
    rows = F.array(*(F.struct(F.lit(n).alias("label"), F.concat(F.lit(f"file{n}/"), F.col("user_id").cast("string")).alias("file"), F.lit(h).alias("heading")) for n, h in ((1, "Fees"), (2, ""))))
    n = U.rendered_notes(a, a.select("qid", F.explode(rows).alias("s")).select("qid", "s.*"))
    return n.select(F.col("qid").alias("event_id"), "note", F.sha2("text", 256).alias("sha256"))


@query
def sweep_best(spark, sf):
    return E.best_setting(sweep_table(spark, sf))


@query
def sweep_verdicts(spark, sf):
    runs = _t(spark, sf, "documents").select(F.col("lang").alias("item"), F.col("text").alias("answer"))
    found = E.verdicts(runs, _rows(spark, cases.VERDICTS))
    return found.groupBy("item", "verdict").agg(F.count("*").alias("n"))


@query
def sealed_gap(spark, sf):
    g = E.sealed_gap(_scored(spark, sf).withColumn("sealed", F.col("doc_id") % 2 == 0))
    return g.select(*(F.round(c, 6).alias(c) for c in ("public", "sealed", "gap")))


@query
def corpus_numbers(spark, sf):
    n = _t(spark, sf, "documents").select(F.explode(F.transform(X.numbers(F.col("text")), X.bare)).alias("number"))
    return n.distinct()


@query
def fabricated_numbers(spark, sf):
    d = _t(spark, sf, "documents")
    return E.fabricated(d.where("lang = 'en'").select(F.col("doc_id").alias("qid"), F.col("text").alias("answer")), d.where("lang <> 'en'").select("text"))


# -- coverage and corpora
_EXTS = [".md", ".pdf", ".docx", ".png", ".xlsx", ".doc", ".zip", ".eml"]


def _files(spark, sf):
    """Parts as files: two by two they share a stem within a folder, some are hidden."""
    p = _t(spark, sf, "part")
    stem = F.concat(F.when(F.col("p_partkey") % 11 == 0, ".").otherwise(""), F.lit("f"), F.floor(F.col("p_partkey") / 2).cast("string"))
    ext = F.element_at(F.array(*map(F.lit, _EXTS)), (F.col("p_size") % 8 + 1).cast("int"))
    f = p.select(F.col("p_partkey").alias("key"), F.concat("p_type", F.lit("/")).alias("dir"), stem.alias("stem"), ext.alias("ext"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))
    return f.withColumn("file", F.concat("dir", F.col("key").cast("string"), F.lit("-"), "stem", "ext"))


def _classified(spark, sf):
    f = _files(spark, sf)
    return V.classify(f, f.where("size % 5 = 0"), ["textutil"])


@query
def coverage_classify(spark, sf):
    return _classified(spark, sf).select("file", "status", F.coalesce("why", F.lit("")).alias("why"))


@query
def coverage_report(spark, sf):
    return V.report(_classified(spark, sf).where("status = 'skipped'"))


@query
def coverage_diff(spark, sf):
    c = _classified(spark, sf).where("status = 'indexable'")
    return V.diff(c, _files(spark, sf).where("size % 2 = 0"))


@query
def folder_inventory(spark, sf):
    c = _classified(spark, sf)
    return V.folders(c.where("status = 'indexable'"), c.where("status = 'skipped'"), c.where("status = 'covered'"))


@query
def conversion_decision(spark, sf):
    k, s = F.col("key"), F.col("size")
    rows = _files(spark, sf).where(F.col("ext").isin(".pdf", ".doc")).select(
        "file", F.concat(F.lit("h"), (k % 7).cast("string")).alias("sha256"), (k % 50).alias("mtime"), (s % 2 == 0).alias("sidecar_exists"), (s % 40).cast("long").alias("sidecar_mtime"), (k % 3 > 0).alias("ours"),
        F.concat(F.lit("h"), (k % 14 % 8).cast("string")).alias("known_hash"), (k % 5 == 0).alias("known_empty"), (k % 13 == 0).alias("other_companion"), (s % 4 > 0).alias("has_tool"),
    )
    return V.conversion_decision(rows).select("file", "decision")


def _versions(spark, sf):
    d = _t(spark, sf, "documents")
    f = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    old = d.where("source <> 'src4'").select(f.alias("file"), F.sha2("text", 256).alias("sha256"))
    new = d.where("source <> 'src3'").select(f.alias("file"), F.sha2(F.when(F.col("lang") == "de", F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"))
    return old, new


@query
def content_hash_diff(spark, sf):
    return I.file_changes(*_versions(spark, sf))


@query
def manifest_prune(spark, sf):
    old, new = _versions(spark, sf)
    manifest = old.select(F.concat("file", F.lit(".txt")).alias("sidecar"), F.col("file").alias("source"), F.col("sha256").alias("hash"))
    return V.live_manifest(manifest, new).select("sidecar", "source")


@query
def substring_collisions(spark, sf):
    amounts = _t(spark, sf, "part").select(F.floor("p_retailprice").cast("long").cast("string").alias("digits"))
    more = _t(spark, sf, "part").select((F.col("p_size") * 10).cast("string").alias("digits"))
    return P.substring_collisions(amounts.union(more))


@query
def shape_columns(spark, sf):
    p = _t(spark, sf, "part")
    k = F.col("p_partkey")
    shapes = p.select(
        F.floor(k / 6).alias("slide"), k.alias("shape"), (k * 7919 % 8 * 1100000).alias("x"), (k * 104729 % 5000000).alias("y"), F.when(F.col("p_size") % 9 == 0, 6000000).otherwise(900000).alias("cx"), F.lit(9144000).alias("width")
    )
    return P.slide_order(shapes).select("slide", "shape", *_long("place"))


@query
def template_render(spark, sf):
    p = _t(spark, sf, "part")
    docs = p.select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("Part {{amount:p"), F.col("p_partkey").cast("string"), F.lit("}} of {{brand:p"), F.col("p_partkey").cast("string"), F.lit("}}, see {{amount:none}}.")).alias("text"))
    i = F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    constants = p.select(F.lit("amount").alias("kind"), i.alias("id"), P.money(F.floor("p_retailprice")).alias("value")).union(p.where("p_size <> 7").select(F.lit("brand"), i, F.col("p_brand")))
    return P.render(docs, constants)


def _timeline(spark, sf):
    o = _t(spark, sf, "orders")
    kind = F.when(F.col("o_orderstatus") == "O", "message").when(F.col("o_orderstatus") == "F", "call").otherwise("note")
    rows = o.select("o_orderkey", F.col("o_custkey").alias("party"), kind.alias("kind"), F.when(F.col("o_totalprice") > 200000, "in").otherwise("out").alias("direction"))
    return P.register(rows, _t(spark, sf, "customer").select(F.col("c_custkey").alias("party"), F.col("c_name").alias("name")))


@query
def register_rows(spark, sf):
    return _timeline(spark, sf)[0].select("o_orderkey", "name", "kind", "direction")


@query
def silent_parties(spark, sf):
    return _timeline(spark, sf)[1].select("party", "name")


@query
def placeholder_check(spark, sf):
    l = _t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("file"), F.col("l_partkey").alias("id"), "l_returnflag", "l_linestatus")
    return P.undeclared(l.where("l_returnflag <> 'A'"), l.where("l_linestatus = 'O' or l_returnflag = 'A'"))


@query
def corpus_problems(spark, sf):
    """Parts as sources of a corpus, of four kinds."""
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, "Pay $4,500 on 2026-01-02.").when(k == 1, "{{amount:fee}} is due").when(k == 2, "{{amount:nope}} {{TODO}}").otherwise("The secret names are kept.")
    ids = F.when(k == 1, F.array(F.lit("fee"))).when(k == 2, F.array(F.lit("nope"))).when(k == 3, F.array(F.lit("old")))
    docs = _t(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(".md")).alias("file"), text.alias("text"), ids.alias("declared"))
    days, never, files = (spark.createDataFrame([(v,)], f"{n} string") for n, v in (("day", "2026-03-03"), ("phrase", "secret names"), ("file", "old.md")))
    return P.source_problems(docs, _rows(spark, cases.CONSTANTS), days, never, files)


@query
def build_manifest(spark, sf):
    d = _t(spark, sf, "documents")
    f = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    content = F.when(F.col("lang") == "de", F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    written = d.select(f.alias("file"), F.col("lang").alias("kind"), content.alias("content"))
    return P.build_manifest(written, d.where("source <> 'src3'").select(f.alias("file"), F.col("text").alias("content")))


@query
def corpus_structure(spark, sf):
    """Threads as an index: some have lost their second message, some have no overview, some files are named as skipped."""
    messages = _messages(spark, sf)
    messages = messages.repartition(parts(messages, P.TASK_ROWS), "file")
    m = keep(T.ordered(messages).select("file", "n", "of", "date", F.lit(None).cast("boolean").alias("overview")), "messages")
    files = m.select("file").distinct()
    number = F.col("file").cast("long")
    views = files.where(number % 5 != 0).select("file", F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(None).cast("string"), F.lit(True))
    named = lambda prefix, every: files.where(number % every == 0).select(F.concat(F.lit(prefix), F.col("file")).alias("file"))
    skipped = named("", 7).withColumn("partial", F.lit(False)).union(named("p", 11).withColumn("partial", F.lit(True)))
    return P.structure(m.where((number % 3 != 0) | (F.col("n") != 2)).union(views), files.union(named("x", 13)), skipped)


@query
def question_overrides(spark, sf):
    q = parse_questions(derived.overrides(spark, sf))
    return q.select("qid", "scope", *_long("top_k"), "diverse", "question", F.col("error").isNotNull().alias("bad"))


@query
def stream_answers(spark, sf):
    return L.answers(derived.frames(spark, sf)).select("answer_id", "answer", "tokens", "finish", "error")


@query
def haystack(spark, sf):
    filler = _t(spark, sf, "documents").select(F.col("doc_id").alias("pos"), "text")
    h = P.hidden_in(filler, "The vault code is 4711.", 0.5)
    return h.select("pos", F.contains("text", F.lit("vault code is 4711")).alias("needle"))
