"""The commands: ingest, coverage, ask, reason, summarize, batch. Each works on a batch of questions as one set of jobs."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import audit as U
from ..operators import coverage as V
from ..operators import index as I
from ..operators import retrieve as R
from ..operators import segment as S
from ..operators import segments as G
from ..operators import threads as T
from ..operators import verify as C
from ..sources import files as files_
from ..sources import mail, office
from . import prompts as P
from .generate import Generator

NOTES = "model-notes"


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """A stored table, None if there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


@dataclass
class Matter:
    """A namespace: a folder of documents, and under `store` its tables: an index in segments, to which each ingest adds what has changed, and the list of what can't be read."""

    spark: SparkSession
    docs: str
    store: str

    def generation(self) -> dict | None:
        """The newest ingest: index (its folder), version (of the chunks), vectors (whether there are any), skipped (a folder)."""
        found = _read(self.spark, f"{self.store}/current")
        row = found.orderBy(F.desc("at")).first() if found is not None else None
        return row.asDict() if row else None

    def table(self, name: str) -> DataFrame:
        """chunks, postings, lengths, files, vectors or skipped, as they are now."""
        now = self.generation()
        if now is None:
            raise LookupError(f"nothing is ingested in {self.store}")
        if name == "skipped":
            return self.spark.read.parquet(f"{self.store}/{now['skipped']}")
        index = G.Segments(self.spark, f"{self.store}/{now['index']}")
        return index.files() if name == "files" else index.live(name).drop("seg")


def matters(spark: SparkSession, base: str) -> list[str]:
    """Names of the matters below a folder: its folders with a folder docs."""
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in files.listStatus(path) if s.isDirectory()] if files.exists(path) else []
    return sorted(p.getName() for p in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "docs")))


def _mail_text(messages: DataFrame) -> DataFrame:
    """A file's messages in order as text, each under its heading, after an overview of a thread."""
    m = T.ordered(messages)
    head = F.concat(F.lit("# "), F.trim(F.concat_ws(" ", F.nullif("date", F.lit("")), F.concat_ws(" -> ", "sender", "recipient"))))
    body = F.concat_ws("\n", head, F.concat(F.lit("Subject: "), F.coalesce(F.nullif("subject", F.lit("")), F.lit("(none)"))), F.lit(""), F.array_join("lines", "\n"), F.lit(""))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", body.alias("b")))), lambda x: x["b"]), "\n")
    texts = m.groupBy("file").agg(joined.alias("text"))
    over = T.overview(m).select("file", F.concat(F.lit("# thread overview ("), "names", F.lit(")\n"), "text", F.lit("\n\n")).alias("_o"))
    return texts.join(over, "file", "left").select("file", F.concat(F.coalesce("_o", F.lit("")), "text").alias("text"))


def _slide_text(slides: DataFrame) -> DataFrame:
    """Slides as sections of their file: form feeds part them."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("slide", "text"))), lambda x: x["text"]), "\f")
    return slides.groupBy("file").agg(joined.alias("text"))


def convert(matter: Matter, runner: Callable[[str, str, str], tuple[bool, str | None]], tools: list[str], dry_run: bool = False) -> DataFrame:
    """(file, event, detail) of files that a local tool turns into a readable one beside them; the manifest of what was made is kept under the store.

    runner(tool, source, sidecar) runs a tool and gives (whether it worked, the text of what it made); it is called by tasks, once for each file
    to convert. A sidecar without text is a scan: it is remembered by its source's hash. Sources that are gone leave the manifest.
    """
    spark, path = matter.spark, f"{matter.store}/manifest"
    found = files_.walk(spark, matter.docs)
    known = _read(spark, path)
    manifest = known.select("sidecar", "source", "hash", "empty") if known is not None else spark.createDataFrame([], V.MANIFEST)
    decided = V.conversion_decision(V.convertible(found, manifest, tools), dry_run)

    def run(batches):
        import pandas as pd

        for rows in batches:
            done = [runner(t, f, s) if d == "convert" else (True, None) for t, f, s, d in zip(rows["tool"], rows["file"], rows["sidecar"], rows["decision"], strict=True)]
            yield pd.DataFrame({**{c: rows[c] for c in ("file", "sidecar", "sha256", "tool", "decision")}, "ok": [o for o, _ in done], "text": [t for _, t in done]})

    ran = decided.select("file", "sidecar", "sha256", "tool", "decision").mapInPandas(run, "file string, sidecar string, sha256 string, tool string, decision string, ok boolean, text string")
    events = _kept(matter, uuid.uuid4().hex, "conversions", V.after_conversion(ran).where("event is not null").select("file", "sidecar", "sha256", "tool", "event"))
    if not dry_run:
        after = V.next_manifest(manifest, events, found)
        _kept(matter, uuid.uuid4().hex, "manifest", after).write.mode("overwrite").parquet(path)
    return events.select("file", "event", F.concat("sidecar", F.lit(" ("), "tool", F.lit(")")).alias("detail"))


def ingest(matter: Matter, tools: list[str] | None = None, embedder=None) -> bool:
    """Read, segment and index a matter's documents, with vectors if there is a function that makes them; False if nothing has changed.

    Nothing has changed if the files are the same, the chunks are of this version, and vectors are there or can't be made. If only files have
    changed, those alone are parsed, and their postings and vectors are added as a segment; else the index is made anew, without vectors if they can't be made.
    """
    spark, now, run = matter.spark, matter.generation(), uuid.uuid4().hex
    listed = files_.walk(spark, matter.docs)
    known = V.classify(listed.select("file", "dir", "stem", "ext", "sha256"), tools=tools)
    readable = _kept(matter, run, "readable", listed.join(known.where("status = 'indexable'").select("file"), "file", "left_semi").select("file", "sha256"))
    if now is not None:
        changes = _kept(matter, run, "changes", I.file_changes(matter.table("files"), readable))
        if I.up_to_date(changes, now["version"], now["vectors"], embedder is not None):
            return False
    as_is = now is not None and now["version"] == I.CHUNK_VERSION and now["vectors"] == (embedder is not None)
    if not as_is:
        changes = readable.select("file", F.lit("added").alias("status"))
    more = changes.where("status in ('added', 'changed')")
    found = files_.walk(spark, matter.docs, content=True).join(more, "file", "left_semi")
    words = _kept(matter, run, "word", office.word_files(found))
    decks = _kept(matter, run, "decks", office.deck_rows(found))
    mails = _kept(matter, run, "mail", mail.mail_files(found))
    broken = words.where("error is not null").select("file", "error").union(office.deck_facts(decks).where("error is not null").select("file", "error"))
    partial = words.where("size(dropped) > 0").select("file", F.concat(F.lit("partially read: text of its "), F.array_join("dropped", ", "), F.lit(" is not indexed")).alias("why"))
    skipped = known.where("status = 'skipped'").select("file", "why", F.lit(False).alias("partial"))
    skipped = skipped.union(broken.select("file", F.concat(F.lit("can't be read: "), "error"), F.lit(False))).union(partial.select("file", "why", F.lit(True)))
    if as_is:  # what was found of files that are as they were
        skipped = skipped.union(matter.table("skipped").join(changes.where("status = 'same'").select("file"), "file", "left_semi").select("file", "why", "partial"))
    skipped.write.parquet(f"{matter.store}/skipped/{run}")
    texts = files_.texts(found).union(words.where("error is null").select("file", "text"))
    texts = texts.union(_slide_text(office.slide_texts(decks))).union(_mail_text(mails))
    meta = T.with_meta(S.chunk(texts), T.marked_self(T.ordered(mails)))
    overview = F.startswith("heading", F.lit("thread overview (")) & F.endswith("file", F.lit(".eml"))
    # files in the order of their paths, then chunks: a fixed-width key sorts so without a global sort
    place = F.concat_ws("#", "file", F.lpad(F.col("chunk_pos").cast("string"), 9, "0"))
    chunks = meta.withColumn("corpus_pos", place).withColumn("overview", overview).withColumn("is_self", F.coalesce("is_self", F.lit(False)))
    chunks = chunks.select("chunk_id", "file", "chunk_pos", "heading", "title", "text", "corpus_pos", "n", "of", "sender", "recipient", "date", "is_self", "overview")
    folder = now["index"] if as_is else f"index-{run}"
    makers = {"vectors": lambda own: R.embed(own, embedder)} if embedder is not None else {}
    batch = more.join(readable, "file").select("file", "sha256").union(changes.where("status = 'removed'").select("file", F.lit(None).cast("string")))
    G.Segments(spark, f"{matter.store}/{folder}", makers).apply(batch, chunks)
    row = (folder, I.CHUNK_VERSION, embedder is not None, f"skipped/{run}")
    named = spark.createDataFrame([row], "index string, version int, vectors boolean, skipped string")
    named.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{matter.store}/current")
    return True


def coverage(matter: Matter) -> DataFrame:
    """(file, state, why) of what is not indexed yet, is gone, is skipped or could not be read, or is read only in part."""
    found = files_.walk(matter.spark, matter.docs)
    known = V.classify(found)
    d = V.diff(known.where("status = 'indexable'"), matter.table("files")).withColumn("why", F.lit(None).cast("string"))
    read = matter.table("skipped").join(known.where("status = 'indexable'").select("file"), "file", "left_semi")
    return d.union(known.where("status = 'skipped'").select("file", "status", "why")).union(read.select("file", F.when(F.col("partial"), "partial").otherwise("skipped"), "why"))


def coverage_lines(matter: Matter) -> DataFrame:
    """(line): what is said before an answer: how many files can't be seen, how many only in part, with the first names of each."""
    return V.warning_lines(matter.table("skipped"))


def _kept(matter: Matter, run: str, name: str, df: DataFrame) -> DataFrame:
    """A step's result, written under the store for one run and read again, so that what uses it more than once doesn't compute it again."""
    path = f"{matter.store}/run/{run}/{name}"
    df.write.mode("overwrite").parquet(path)
    return matter.spark.read.schema(df.schema).parquet(path)


def _overrides(questions: DataFrame, top_k: int, diverse: bool) -> DataFrame:
    """qid, scope, top_k, diverse: each question's own settings, or the given ones."""
    have = set(questions.columns)
    k = F.coalesce("top_k", F.lit(top_k)) if "top_k" in have else F.lit(top_k)
    spread = F.coalesce("diverse", F.lit(False)) | F.lit(diverse) if "diverse" in have else F.lit(diverse)
    return questions.select("qid", F.col("scope") if "scope" in have else F.lit(None).cast("string").alias("scope"), k.alias("top_k"), spread.alias("diverse"))


def search(matter: Matter, questions: DataFrame, top_k: int = R.TOP_K, notes: bool = False, diverse: bool = False, embedder=None, me: list[str] | None = None) -> DataFrame:
    """(qid, label, chunk_id, bm25, cos, read, dropped, file, heading, title, text): what each question gets to read.

    A question about few messages, or a broad one about a thread, reads them whole. The others are searched: BM25, fused with
    cosines if there is a function that embeds questions; folders and senders that a question names get places of their own; the nearest chunk and
    holders of its figures ride along, and with any message the thread's overview. Statistics are those of all chunks but, for ask,
    the derived notes, unless a question's scope lies in them; a question's scope limits what is ranked, and its own top_k and diverse go before the given ones.
    """
    if not notes and "scope" in questions.columns:
        inside = F.coalesce(X.in_scope(F.coalesce("scope", F.lit("")), F.lit(NOTES)), F.lit(False))
        if not questions.where(inside).isEmpty():
            own = (questions.where(inside), True), (questions.where(~inside), False)
            first, second = (_search(matter, q, top_k, n, diverse, embedder, me) for q, n in own)
            return first.union(second)
    return _search(matter, questions, top_k, notes, diverse, embedder, me)


def _search(matter: Matter, questions: DataFrame, top_k: int, notes: bool, diverse: bool, embedder, me: list[str] | None) -> DataFrame:
    chunks, posts, run = matter.table("chunks"), matter.table("postings"), uuid.uuid4().hex
    if not notes:
        chunks = chunks.where(~F.startswith("file", F.lit(NOTES + "/")))
        posts = posts.join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    lens = matter.table("lengths").join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    bm = R.bm25(posts, I.corpus_statistics(lens), I.document_frequency(posts), questions)
    place = chunks.select("chunk_id", "file", "heading", "title", "text")
    own = _overrides(questions, top_k, diverse)
    scoped_ = lambda hits: (
        hits.join(place.select("chunk_id", "file"), "chunk_id").join(own.select("qid", "scope"), "qid").where(X.in_scope(F.col("file"), F.col("scope"))).select(*hits.columns)
    )
    scoped = _kept(matter, run, "bm25", scoped_(bm))
    cos = None
    if embedder is not None and matter.generation()["vectors"]:  # else some chunks have no vector
        asked = R.embed(questions.select(F.col("qid").alias("chunk_id"), F.lit("").alias("heading"), F.col("question").alias("text")), embedder, kind="search_query").select(F.col("chunk_id").alias("qid"), F.col("v").alias("q"))
        cos = R.cosine(matter.table("vectors").withColumnRenamed("chunk_id", "vec_id"), asked, None)
        cos = _kept(matter, run, "cosines", scoped_(cos))
    fused = R.rrf(scoped, cos)
    target = _kept(matter, run, "targets", T.targets(questions, chunks, me))
    read = _kept(matter, run, "reads", T.reads(questions, chunks, target))
    searched = _kept(matter, run, "fused", fused.join(read.select("qid").distinct(), "qid", "left_anti"))
    # plain and diverse rankings
    bucketed = searched.join(place.select("chunk_id", "file", "heading"), "chunk_id").withColumn("bucket", X.source_key(F.col("file"), F.col("heading"))).select(*fused.columns, "bucket").join(own, "qid")
    first = F.row_number().over(Window.partitionBy("qid", "bucket").orderBy(F.desc("rrf"), "chunk_id"))
    order = Window.partitionBy("qid").orderBy(F.col("diverse") & (F.col("_first") > 1), F.desc("rrf"), "chunk_id")
    ranked = bucketed.withColumn("_first", first).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("top_k"))
    # places for folders and senders that are named
    folders = R.folders_named(questions, chunks)
    top = F.split_part("file", F.lit("/"), F.lit(1))
    members = folders.join(chunks.select("chunk_id", top.alias("folder")), "folder").select("qid", F.concat(F.lit("folder "), "folder").alias("grp"), "chunk_id")
    members = members.union(T.target_chunks(questions, chunks, target).select("qid", F.concat(F.lit("sender "), "sender"), "chunk_id"))
    groups = folders.select("qid", F.concat(F.lit("folder "), "folder").alias("grp")).union(target.select("qid", F.concat(F.lit("sender "), "sender")))
    grouped = R.quota(searched, members, groups, top_k)
    columns = ["qid", "chunk_id", "bm25", "cos", "rank"]
    hits = _kept(matter, run, "ranked", ranked.join(groups.select("qid"), "qid", "left_anti").select(*columns).union(grouped.select(*columns)))
    late = F.lit(1 << 30).alias("rank")
    if cos is not None:
        near = R.dense_rescue(hits, cos.join(read.select("qid").distinct(), "qid", "left_anti")).where("origin = 'dense'")
        hits = hits.union(near.select("qid", "chunk_id", "bm25", "cos", late))
    held = R.number_rescue(hits, place, questions.join(read.select("qid").distinct(), "qid", "left_anti"), scoped)
    hits = hits.union(held.select("qid", "chunk_id", "bm25", "cos", late)).where("bm25 > 0 or cos > 0")
    with_mail = hits.join(chunks.where("sender is not null").select("chunk_id"), "chunk_id", "left_semi").select("qid").distinct()
    overviews = T.with_all(with_mail, chunks.where("overview").select("chunk_id")).join(hits, ["qid", "chunk_id"], "left_anti")
    hits = hits.union(overviews.select("qid", "chunk_id", F.lit(0.0), F.lit(None).cast("double"), F.lit((1 << 30) + 1)))
    whole = read.join(scoped, ["qid", "chunk_id"], "left").select("qid", "chunk_id", F.coalesce("bm25", F.lit(0.0)).alias("bm25"), F.lit(None).cast("double").alias("cos"), F.col("place").alias("rank"), F.lit(True).alias("read"), "dropped")
    hits = hits.select(*columns, F.lit(False).alias("read"), F.lit(0).alias("dropped")).union(whole)
    label = F.row_number().over(Window.partitionBy("qid").orderBy("rank", F.desc("bm25"), "chunk_id"))
    return hits.withColumn("label", label).drop("rank").join(place, "chunk_id")


def check(answers: DataFrame, sources: DataFrame, mode: str = "ask") -> DataFrame:
    """(qid, class, detail): the warnings that a mode's checks give."""
    w = lambda df, name, detail: df.select("qid", F.lit(name).alias("class"), detail.cast("string").alias("detail"))
    out = [
        w(C.unverified_numbers(answers, sources), "UNVERIFIED NUMBER", F.col("number")),
        w(C.mis_cited(answers, sources), "MIS-CITED NUMBER", F.concat_ws(" ", "number", "cited")),
        w(C.unverified_attributions(answers, sources), "UNVERIFIED ATTRIBUTION", F.col("name")),
        w(C.unverified_negatives(answers, sources), "UNVERIFIED NEGATIVE", F.col("party")),
        w(C.forged(answers, sources), "FORGED CITATION", F.col("label")),
    ]
    if mode == "reason":
        out.append(w(answers.where(C.missing_inference(F.col("answer"))), "NO INFERENCE LABEL", F.lit("")))
        if "reasoning_tokens" in answers.columns:
            thought = C.no_thinking(F.col("answer"), F.col("reasoning_tokens"))
            out.append(w(answers.where(thought.isNotNull()), "NO THINKING", F.lit("the model did not think")))
    if mode == "summary":
        out.append(w(C.ungrounded(answers), "UNGROUNDED SENTENCE", F.col("claim")))
    if "finish" in answers.columns:
        out.append(w(answers.where(C.finish_warning(F.col("finish"), F.col("answer")).isNotNull()), "FINISH", C.finish_warning(F.col("finish"), F.col("answer"))))
    warnings = out[0]
    for more in out[1:]:
        warnings = warnings.union(more)
    return warnings.distinct()


def answer(
    matter: Matter, questions: DataFrame, generator: Generator, mode: str = "ask", top_k: int | None = None, min_score: float = R.MIN_SCORE, machine: str = "local", embedder=None, me: list[str] | None = None,
    previous: DataFrame | None = None,
) -> DataFrame:
    """Questions (qid, question, scope) -> audit records, appended to the matter's audit folder as well. previous: (qid, question, answer), the turns before.

    The gate's refusals never reach the generator: what passes is written out before it is asked, once. If the generator fails as a whole, records
    with its error are appended before the error goes on.
    """
    spark, run = matter.spark, uuid.uuid4().hex
    reason = mode == "reason"
    questions = questions.select(*(c for c in ("qid", "question", "scope", "top_k", "diverse") if c in questions.columns))
    if "scope" not in questions.columns:
        questions = questions.withColumn("scope", F.lit(None).cast("string"))
    k = max(top_k or 0, R.REASON_TOP_K) if reason else top_k or R.TOP_K
    hits = _kept(matter, run, "hits", search(matter, questions, k, notes=mode != "ask", diverse=reason, embedder=embedder, me=me))
    read = hits.where("read").groupBy("qid").agg(F.max("dropped").alias("gather_dropped"), F.count("*").alias("gathered"))
    gated = R.gate(hits, questions, min_score).join(read, "qid", "left").withColumn("refused", F.col("refused") & F.col("gathered").isNull())
    rules = {"ask": P.ANSWER_RULES, "reason": P.REASON_RULES, "summary": P.SUMMARY_RULES}[mode]
    asked = P.sources_prompt(hits.join(gated.where("not refused").select("qid"), "qid", "left_semi"), questions, rules)
    if previous is not None:
        turns = previous.select("qid", F.col("question").alias("_q"), F.col("answer").alias("_a"))
        asked = asked.join(turns, "qid", "left").select("qid", P.with_previous(F.col("prompt"), F.col("_q"), F.coalesce("_a", F.lit(""))).alias("prompt"))
    prompts = _kept(matter, run, "prompts", asked)
    config = F.to_json(F.struct(
        F.lit(mode).alias("mode"), F.lit(k).alias("top_k"), F.lit(min_score).alias("min_score"), F.lit(embedder is not None).alias("dense"), F.lit(machine).alias("machine"),
        *(F.lit(str(v)).alias(n) for n, v in getattr(generator, "facts", dict)().items()),
    ))
    none = F.array().cast("array<string>")
    base = questions.join(gated, "qid").join(U.used_chunks(hits), "qid", "left")

    def recorded(rows: DataFrame, answered, warnings, tokens, error) -> DataFrame:
        return rows.select(
            F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("ts"), "qid", "question", F.col("scope").alias("only"), F.round("bm25_top", 3).alias("top_score"), F.round("cos_top", 3).alias("cos_top"),
            "refused", "chunks", F.when(F.col("refused"), "Not in the documents.").otherwise(answered).alias("answer"), warnings.alias("warnings"), "gathered", config.alias("config"), F.struct(tokens.cast("long").alias("total_tokens")).alias("usage"), error.alias("error"),
        )

    try:
        answers = _kept(matter, run, "answers", generator.answer(prompts))
    except Exception as e:
        text = F.lit(None).cast("string")
        U.append(recorded(base, text, none, F.lit(None), F.when(F.col("refused"), text).otherwise(f"{type(e).__name__}: {e}"[:500])), f"{matter.store}/audit", machine)
        raise
    answers = answers.join(questions.select("qid", "question"), "qid")
    if mode == "summary":
        answers = answers.withColumn("answer", C.cap_citations(F.col("answer")))
    warned = check(answers.where("answer is not null"), hits, mode).groupBy("qid").agg(F.sort_array(F.collect_set(F.concat_ws(": ", "class", "detail"))).alias("warnings"))
    coverage_ = F.when(F.col("gather_dropped") > 0, F.array(F.concat(F.lit("COVERAGE: "), F.col("gather_dropped").cast("string"), F.lit(" chunks were left out")))).otherwise(none)
    rows = base.join(answers.drop("question"), "qid", "left").join(warned, "qid", "left")
    done = _kept(matter, run, "audit", recorded(rows, F.col("answer"), F.concat(F.coalesce("warnings", none), coverage_), F.col("tokens"), F.col("error")))
    U.append(done, f"{matter.store}/audit", machine)
    return done


def batch(matter: Matter, question_file: str, generator: Generator, **more) -> DataFrame:
    """A question file -> counters; the records are in the audit folder."""
    asked = files_.questions(matter.spark, question_file).where("error is null")
    return U.counters(answer(matter, asked, generator, **more))


def summary_chunks(matter: Matter, scope: str | None, budget: int = T.SUMMARY_BUDGET) -> DataFrame:
    """The chunks of a scope: all of them in the order of file and id as text, or a turn of each source up to the budget."""
    chunks = matter.table("chunks").where(X.in_scope(F.col("file"), F.lit(scope)))
    bucketed = chunks.withColumn("bucket", X.source_key(F.col("file"), F.col("heading")))
    return R.round_robin(bucketed, budget).orderBy("file", "chunk_id")


def summarize(matter: Matter, generator: Generator, scope: str | None = None, out: str | None = None, budget: int = T.SUMMARY_BUDGET) -> DataFrame:
    """One summary of a scope: (qid, answer, warnings). It is written to `out` only if it isn't empty. There is no gate."""
    spark = matter.spark
    kept = summary_chunks(matter, scope, budget).withColumn("qid", F.lit(0).cast("long"))
    label = F.row_number().over(Window.partitionBy("qid").orderBy("file", "chunk_id"))
    run = uuid.uuid4().hex
    sources = _kept(matter, run, "summary", kept.select("qid", label.alias("label"), "chunk_id", "file", "title", "heading", "text"))
    questions = spark.createDataFrame([(0, "Summarise the sources.")], "qid long, question string")
    answers = _kept(matter, run, "summary_answer", generator.answer(P.sources_prompt(sources, questions, P.SUMMARY_RULES)))
    answers = answers.join(questions, "qid").withColumn("answer", C.cap_citations(F.coalesce("answer", F.lit(""))))
    warned = check(answers, sources, "summary").groupBy("qid").agg(F.sort_array(F.collect_set(F.concat_ws(": ", "class", "detail"))).alias("warnings"))
    done = answers.join(warned, "qid", "left").select("qid", "answer", F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"))
    if out and not done.where("trim(answer) <> ''").isEmpty():
        done.select("answer").coalesce(1).write.mode("overwrite").text(out)
    return done


def write_notes(matter: Matter, records: DataFrame) -> DataFrame:
    """Derived notes of usable answers, as (note, text) rows under the store, with the chunks that the records name as sources; what was written."""
    hits = records.select("qid", F.posexplode("chunks").alias("label", "c")).select("qid", (F.col("label") + 1).alias("label"), "c.file", "c.heading")
    notes = U.rendered_notes(records, hits)
    notes.write.mode("append").parquet(f"{matter.store}/notes")
    return notes


def drop_note(matter: Matter, name: str) -> bool:
    """Take a note away, by its name with or without .md; whether there was one."""
    path = f"{matter.store}/notes"
    notes = _read(matter.spark, path)
    if notes is None or U.without(notes, name).count() == notes.count():
        return False
    _kept(matter, uuid.uuid4().hex, "notes", U.without(notes, name)).write.mode("overwrite").parquet(path)
    return True
