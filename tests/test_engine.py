"""Parsers, streams and commands, and rules that the data never exercise."""

import email.message
import io
import json
import os
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lexgrove import schema
from lexgrove.functions import dates, stats, text
from lexgrove.operators import audit, corpus, coverage, index, phrases, quoted, retrieve, score, segment, threads, verify
from lexgrove.plans import api, prompts
from lexgrove.plans.generate import RecordedGenerator
from lexgrove.sources import files, mail, office
from lexgrove.streaming import live

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(column(F.col("x"))).collect()]


def test_tokens(spark):
    rows = spark.createDataFrame([(1, "The Fees of Zilka-Kotab are v1.2 glass, to-be"), (2, ""), (3, None)], "k long, t string").coalesce(1)
    assert [tuple(r) for r in text.terms(rows, F.col("t"), "k").collect()] == [(1, t) for t in ("fee", "zilka-kotab", "zilka", "kotab", "v1.2", "v1", "2", "glass", "to-be")]


@pytest.mark.parametrize("raw", ["Tue, 03 Mar 2026 16:40:00 +0100", "3 Mar 26 16:40 GMT", "Tuesday, March 3, 2026 4:40 PM", "3 March 2026 16:40", "2026-03-03 16:40", "2026년 3월 3일 (화)", "03.03.2026", "3/3/2026", "3/3/26", "March 3rd, 2026", "3. mar 2026"])
def test_dates_in_many_spellings(spark, raw):
    assert one(spark, dates.loose_date, raw) == ["2026-03-03"]


def test_dates_that_are_none(spark):
    assert one(spark, dates.loose_date, "no date", "", "Foo 7, 2026") == ["", "", ""]


@pytest.mark.parametrize(("middle", "party"), [
    ("Tue, March 3, 2026 at 4:40 PM, Tomas Brandl <tb@x.example>", "Tomas Brandl <tb@x.example>"), ("2026-03-03 16:40 CET Ines Halvorsen", "Ines Halvorsen"), ("3 March 2026, tb@x.example", "tb@x.example"),
    ("Monday, Ines Halvorsen <ines@x.example>", "Ines Halvorsen <ines@x.example>"), ("3/3/26 16:40", ""), ("the other hand he", None),
])
def test_introduced_parties(middle, party):
    assert mail.introduced(middle) == party


def test_heads_of_quoted_messages():
    lines = ["Hi", "", "________________", "Von: A <a@x.example>", "Gesendet: 3. März 2026", "An: b@x.example;", "  c@x.example", "Betreff: Preis", "", "Text", "From: nobody", "is no head", "On March 3, 2026 at 4:40 PM, Tomas", "Brandl wrote:", "> older"]
    got = mail.split_thread(lines)
    assert [(m["from"], m["to"], m["subject"], m["lines"]) for m in got] == [("", "", "", ["Hi"]), ("A <a@x.example>", "b@x.example", "Preis", ["Text", "From: nobody", "is no head"]), ("Tomas Brandl", "", "", ["older"])]
    assert mail.clean_party("'Ines H' <ines@x.example>; tb@x.example [mailto:tb@x.example]") == "Ines H <ines@x.example>, tb@x.example" and mail.split_thread([])[0]["lines"] == []


def test_refusals(spark):
    assert one(spark, text.is_refusal, "**Not in the documents.** [S1]", "I think it is not specified in the sources [S2].", "It is 5.", None) == [True, True, False, False]


def test_stuck(spark):
    assert one(spark, text.looks_stuck, "ab" * 600, "x" * 100, "".join(map(str, range(2000)))) == [True, False, False]


def test_mcnemar_and_wilson(spark):
    from math import comb

    rows = [(b, c) for b in (0, 1, 5, 40, 200) for c in (0, 1, 7, 60)]
    got = spark.createDataFrame(rows, "b long, c long").select("b", "c", stats.mcnemar(F.col("b"), F.col("c")).alias("p"), *stats.wilson(F.col("b"), F.col("b") + F.col("c"))).collect()
    for r in got:
        n, k = r.b + r.c, min(r.b, r.c)
        assert r.p == pytest.approx(1.0 if n == 0 else min(1.0, 2 * sum(comb(n, i) for i in range(k + 1)) / 2**n), abs=1e-9)
        assert r[3] is None or 0 <= r[3] <= r[4] <= 1
    # large counts, against exact sums
    for n, ks in ((1001, (300, 450, 470, 499, 500)), (20_000, (9_000, 9_700, 9_900, 9_990, 10_000)), (100_000, (48_000, 49_500, 49_990, 25_000, 3))):
        at, total, want = 1, 0, {}
        for k in range(max(ks) + 1):
            total += at
            want[k] = total
            at = at * (n - k) // (k + 1)
        got = spark.createDataFrame([(k, n - k) for k in ks], "b long, c long").select("b", stats.mcnemar(F.col("b"), F.col("c")).alias("p")).collect()
        for r in got:
            exact = want[r.b] * 2 * 10**60 // 2**n / 10**60 if want[r.b] * 10**30 > 2**n else None
            assert r.p < 1e-29 if exact is None else r.p == pytest.approx(min(1.0, exact), rel=1e-9)
    far = spark.createDataFrame([(49_999_000, 50_001_000), (5 * 10**7, 5 * 10**7), (10**6, 10**8)], "b long, c long").select(stats.mcnemar(F.col("b"), F.col("c")).alias("p"))
    assert [r.p for r in far.collect()] == [pytest.approx(0.841, abs=1e-3), 1.0, 0.0]


def test_quota_reranks_inside_groups(spark):
    rows = [(1, c, 9.0 - c, None, 1.0 / (60 + c)) for c in range(1, 11)]
    scores = spark.createDataFrame(rows, "qid long, chunk_id long, bm25 double, cos double, rrf double")
    members = spark.createDataFrame([(1, g, c) for c, g in enumerate("aaaaaabbcc", 1)], "qid long, grp string, chunk_id long")
    groups = spark.createDataFrame([(1, "b"), (1, "c")], "qid long, grp string")
    kept = [r.chunk_id for r in retrieve.quota(scores, members.where("grp <> 'a'"), groups, 6).collect()]
    assert set(kept) >= {7, 8} and len(kept) == 6  # those of group c score 0 and below


def test_numbers_held(spark):
    assert sorted(one(spark, retrieve.held_numbers, "Fee 4,800.50 and v.77 and 1.2.3")[0]) == ["1", "1.2.3", "4800", "4800.50"]
    assert one(spark, retrieve.question_numbers, "who quoted 11,750 in 2024 on 2026-09-15 or 12?")[0] == ["11750"]


def test_index_is_up_to_date_only_without_changes(spark):
    docs = index.chunks_of(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    posts = index.postings(docs)
    assert sorted(index.lengths_of(posts, docs).collect()) == sorted(index.lengths(docs).collect())
    assert index.statistics_of(posts, docs).first().asDict() == index.corpus_statistics(index.lengths(docs)).first().asDict()
    a = spark.createDataFrame([("x", "1"), ("y", "2")], "file string, sha256 string")
    assert index.up_to_date(index.file_changes(a, a), index.CHUNK_VERSION, True, True)
    assert not index.up_to_date(index.file_changes(a, a.limit(1)), index.CHUNK_VERSION, True, True)
    assert not index.up_to_date(index.file_changes(a, a), index.CHUNK_VERSION, False, True) and not index.up_to_date(index.file_changes(a, a), 0, True, True)


def test_quoted_chains_are_split_alike_by_rows_and_by_file(spark):
    rnd = random.Random(8)
    pieces = [
        "Thanks, filed.", "", "   ", "From: Tomas Brandl <tb@x.example>\nSent: Tuesday, March 3, 2026 4:40 PM\nTo: Ines <ines@x.example>; Al\n\tNg <al@x.example>\nCc: 'X' <x@x.example>\nSubject: RE: Fees", "From: alone\nno date here",
        "*Von:* Tomas\n*Gesendet:* 03.03.2026\n*An:* Ines\n*Betreff:* AW: x", "On Mon, Mar 2, 2026 at 9:12 AM Ines Halvorsen <ines@x.example> wrote:", "On Mon, Mar 2, 2026, Ines Halvorsen\n<ines@x.example> wrote:", "On reflection he wrote:", "Le 2 mars 2026 à 10:00, Zoé a écrit :",
        "2026. 3. 2. 오후 3:10, 이수진 님이 작성:", "-----Original Message-----", "Begin forwarded message:", "__________", "From: a\nDate: 2026-01-01\nFrom: b <b@x.example>\nDate: 2026-01-02\nSubject: s", "Subject: no sender\nDate: 2026-01-01",
        "From: long\n one\n two\n three\n four\n five\n six\nDate: 2026-01-01\nTo: x", "Note: text", "> quoted\n>> deeper", "On the 5th, x@y.example writes:", "Am 5. Mai 2026 schrieb Karl <k@x.example>:", "Date: 2026-01-01 From: x", "보낸 사람: 김\n보낸 날짜: 2026-03-01\n받는 사람: 이\n제목: 건",
    ]
    bodies = {}
    for k in range(60):
        out, depth = [], 0
        for _ in range(rnd.randint(0, 9)):
            out += ["> " * depth + x + rnd.choice(["", "", "\r"]) for x in rnd.choice(pieces).split("\n")]
            depth += rnd.random() < 0.3
        bodies[f"f{k:02d}"] = out
    rows = [(f, k, x) for f, lines in bodies.items() for k, x in enumerate(lines)]
    got = quoted.split(spark.createDataFrame(rows, "file string, line_no int, line string").repartition(3)).orderBy("file", "pos").collect()
    have = [(r.file, r.pos, r["from"], r.to, r.cc, r.subject, r.date_raw, r.text) for r in got]
    want = [(f, k, m["from"], m["to"], m["cc"], m["subject"], m["date_raw"], "\n".join(m["lines"])) for f, lines in sorted(bodies.items()) if lines for k, m in enumerate(mail.split_thread(lines))]
    assert have == want


def docx(body, **parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        for name, content in parts.items():
            z.writestr(f"word/{name}.xml", f"<w:x {W}>{content}</w:x>")
    return out.getvalue()


def par(t, style="", extra=""):
    style = f'<w:pStyle w:val="{style}"/>' if style else ""
    return f"<w:p><w:pPr>{style}{extra}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>"


def test_word_files():
    row = "<w:tr><w:tc>" + par("a") + "</w:tc><w:tc>" + par("b") + "</w:tc></w:tr>"
    body = par("Plan", "Title") + par("Fees", "Heading1") + par("Text.") + par("item", "", "<w:numPr/>") + f"<w:tbl>{row}</w:tbl>" + f"<w:sdt><w:sdtContent>{par('Inside')}</w:sdtContent></w:sdt>"
    lines, dropped = office.docx_lines(docx(body, footnotes=par("A note of substance"), header1=par("Page 1 of 3"), footer1=par("Text.")))
    assert lines == ["# Plan", "## Fees", "Text.", "", "- item", "", "| a | b |", "", "Inside", ""] and dropped == ["footnotes"]


def pptx(shapes, notes=""):
    ns = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
    sp = "".join(f'<p:sp><p:spPr><a:xfrm><a:off x="{x}" y="{y}"/><a:ext cx="{cx}" cy="1"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>' for x, y, cx, t in shapes)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("ppt/presentation.xml", f'<p:presentation {ns}><p:sldSz cx="9144000" cy="1"/></p:presentation>')
        z.writestr("ppt/slides/slide1.xml", f"<p:sld {ns}><p:cSld><p:spTree>{sp}</p:spTree></p:cSld></p:sld>")
        if notes:
            z.writestr("ppt/notesSlides/notesSlide1.xml", f"<p:notes {ns}><a:p><a:r><a:t>{notes}</a:t></a:r></a:p><a:p><a:r><a:t>1</a:t></a:r></a:p></p:notes>")
    return out.getvalue()


SHAPES = [(5000000, 3000000, 900000, "v2"), (100000, 2000000, 900000, "l1"), (0, 100, 9000000, "Title"), (5000000, 2000000, 900000, "l2"), (100000, 3000000, 900000, "v1")]


def message(body, **headers):
    m = email.message.EmailMessage()
    for k, v in headers.items():
        m[k.replace("_", "-")] = v
    m.set_content(body)
    return m


CHAIN = """Thanks, filed.

On Tue, March 3, 2026 at 4:40 PM, Tomas Brandl <tb@x.example> wrote:
> We can meet the fee of 4,800.
>
> -----Original Message-----
> From: Ines Halvorsen <ines@x.example>
> Sent: Sunday, March 1, 2026 7:05 AM
> To: Tomas Brandl <tb@x.example>
> Subject: Fees
>
> What is the fee?
"""


def test_quoted_chains():
    got = mail.messages(email.message_from_bytes(message(CHAIN, From="Ines Halvorsen <ines@x.example>", To="Ines Halvorsen <ines@x.example>", Subject="Re: Fees", Date="Wed, 04 Mar 2026 10:00:00 +0000").as_bytes(), policy=email.policy.default))
    assert [(m["from"], m["date_raw"], m["lines"][0]) for m in got] == [
        ("Ines Halvorsen <ines@x.example>", "Wed, 04 Mar 2026 10:00:00 +0000", "Thanks, filed."), ("Tomas Brandl <tb@x.example>", "Tue, March 3, 2026 at 4:40 PM, Tomas Brandl <tb@x.example>", "We can meet the fee of 4,800."), ("Ines Halvorsen <ines@x.example>", "Sunday, March 1, 2026 7:05 AM", "What is the fee?"),
    ]
    assert got[1]["to"] == "Ines Halvorsen <ines@x.example>" and got[1]["subject"] == "Fees" and got[1]["subject_inherited"]


def test_attached_mails_and_html():
    inner = message("Inner text", From="A <a@x.example>", To="b@x.example", Subject="Inner")
    outer = message("Outer", From="B <b@x.example>", To="c@x.example", Subject="=?utf-8?q?F=C3=BCr_dich?=")
    outer.add_attachment(inner)
    outer.add_attachment(b"x", maintype="application", subtype="pdf", filename="fees.pdf")
    got = mail.messages(email.message_from_bytes(outer.as_bytes(), policy=email.policy.default))
    assert [m["subject"] for m in got] == ["Für dich", "Inner"] and got[0]["attachments"] == ["fees.pdf"]
    assert text.stripped("<style>x</style><p>a&amp;b</p><br>c").split() == ["a&b", "c"]


@pytest.fixture(scope="module")
def matter(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("matter")
    for name, content in {
        "firm-alpha/fees.md": b"# Firm Alpha\n\nThe flat fee for a filing is $11,750.\n\n## Terms\nPayment within thirty days.",
        "firm-bravo/fees.txt": b"Page one\fThe hourly rate of Firm Bravo is 480.",
        "firm-bravo/plan.docx": docx(par("Plan", "Heading1") + par("Bravo plans three filings.")),
        "deck.pptx": pptx(SHAPES, "Say hello"),
        "mail/thread.eml": message(CHAIN, From="Ines Halvorsen <ines@x.example>", To="Ines Halvorsen <ines@x.example>", Subject="Re: Fees", Date="Wed, 04 Mar 2026 10:00:00 +0000").as_bytes(),
        "scan.pdf": b"%PDF", "photo.png": b"x", ".hidden": b"x", "~$lock.docx": b"x", "broken.docx": b"no archive",
    }.items():
        p = root / "docs" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(content)
    m = api.Matter(spark, str(root / "docs"), str(root / "store"))
    assert api.ingest(m) and not api.ingest(m)
    return m


def test_ingest_reads_every_format(matter):
    chunks = {(r.file, r.heading): r.text for r in matter.table("chunks").collect()}
    assert chunks["firm-alpha/fees.md", "Firm Alpha"] == "The flat fee for a filing is $11,750."
    assert chunks["firm-bravo/fees.txt", "page 2"] == "The hourly rate of Firm Bravo is 480."
    assert chunks["firm-bravo/plan.docx", "Plan"] == "Bravo plans three filings."
    deck = "\n\n".join(t for (f, _), t in chunks.items() if f == "deck.pptx")
    assert deck == "Title\n\nl1\n\nv1\n\nl2\n\nv2\n\nSpeaker notes:\nSay hello"
    overview = next(t for (f, h), t in chunks.items() if h.startswith("thread overview"))
    assert "Message 3 of 3: Ines Halvorsen replied the thread to themselves on 2026-03-04" in overview and "ends with message 2" in overview
    assert "4,800" in chunks["mail/thread.eml", "2026-03-03 Tomas Brandl <tb@x.example> -> Ines Halvorsen <ines@x.example>"]


def test_coverage(matter):
    state = {r.file: (r.state, r.why) for r in api.coverage(matter).collect()}
    assert state["scan.pdf"][0] == "skipped" and "pdftotext" in state["scan.pdf"][1] and "image" in state["photo.png"][1] and ".hidden" not in state and "firm-alpha/fees.md" not in state


def test_ask_answers_refuses_and_warns(spark, matter, tmp_path):
    (tmp_path / "q.txt").write_text("# comment\n\nWhat is the flat fee for a filing?\n--only firm-bravo :: What is the hourly rate?\nqqqq zzzz\n--bad :: x\n")
    asked = files.questions(spark, str(tmp_path / "q.txt")).where("error is null")
    by_text = {r.question: r.qid for r in asked.collect()}
    recorded = spark.createDataFrame([(by_text["What is the flat fee for a filing?"], "The fee is $11,750 [S1]."), (by_text["What is the hourly rate?"], "It is 999 an hour [S7].")], "qid long, answer string")
    done = {r.question: r for r in api.answer(matter, asked, RecordedGenerator(recorded), min_score=0.5).collect()}
    assert done["What is the flat fee for a filing?"].warnings == [] and not done["What is the flat fee for a filing?"].refused
    assert done["What is the hourly rate?"].warnings == ["FORGED CITATION: 7", "UNVERIFIED NUMBER: 999"]
    assert done["qqqq zzzz"].refused and done["qqqq zzzz"].answer == "Not in the documents."
    logged = files.audit(spark, f"{matter.store}/audit", schema.AUDIT)
    assert audit.counters(logged).first().asDict() == {"answered": 2, "gate_refused": 1, "model_refused": 0, "errors": 0, "warned": 1, "tokens": 0}
    assert {r.file.split("/")[0] for r in api.search(matter, asked.where("scope is not null"), 8).collect()} == {"firm-bravo"}
    assert api.summary_chunks(matter, "firm-alpha").count() == 2
    reasoned = api.answer(matter, asked, RecordedGenerator(recorded), mode="reason", min_score=0.5)
    assert reasoned.count() == 3


def test_follow_up_prompt(spark):
    row = spark.createDataFrame([("Sources\n\nQuestion: b?", "a $1?", "x" * 20), ("Question: c?", None, None)], "p string, q string, a string")
    got = [r[0] for r in row.select(prompts.with_previous(F.col("p"), F.col("q"), F.col("a"), 5)).collect()]
    assert got == ["Sources\n\nPrevious question: a $1?\nPrevious answer: xxxxx\nQuestion: b?", "Question: c?"]


def test_conversion_events(spark):
    rows = spark.createDataFrame([("convert", False, None), ("convert", True, " short "), ("convert", True, "x" * 30), ("stale", None, None), ("none", None, None)], "decision string, ok boolean, text string")
    assert [r.event for r in coverage.after_conversion(rows).collect()] == ["failed", "empty", "converted", "stale", None]


def test_notes(spark):
    notes = spark.createDataFrame([("a.md", "x\n# Note: fees\n"), ("b.md", "none")], "note string, text string")
    got = {r.note: (r.heading, r.indexed) for r in audit.listed(notes, spark.createDataFrame([("a.md",)], "file string")).collect()}
    assert got == {"a.md": ("Note: fees", True), "b.md": ("", False)}


def test_scores(spark):
    assert one(spark, lambda c: score.present(F.lit("24"), text.normalise(c)), "in 2024", "it is 24.", "$24", "1,240 of 24") == [False, True, False, True]
    assert one(spark, score.scoped, "Alpha is it. Bravo is not. Done.") == ["Alpha is it. Done."]
    assert one(spark, score.amounts, "pay $1,200 or 300 dollars, 4,800 in all, page 7") == [["$1,200", "300 dollars", "4,800"]]


def test_mail_rules(spark):
    assert one(spark, text.display_name, '"Halvorsen, Ines" <m@x.example>') == ["Halvorsen, Ines"]
    assert one(spark, threads.ordinals_named, "the latest email", "first and second reply", "his 3rd message") == [-1, None, 3]
    assert one(spark, verify.labels, "[S1, S3] [2] [S1-S3] [S4: a > b; S5: c] [INFERENCE]") == [[1, 3, 4, 5]]


def test_table_stays_whole(spark):
    rows = [("f", "| a |\n| b |\n\ntext\n| c |")]
    got = [r.text for r in segment.chunk(spark.createDataFrame(rows, "file string, text string")).orderBy("chunk_pos").collect()]
    assert got == ["| a |\n| b |", "text", "| c |"]


def test_streams_equal_batches(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = live.event_counters(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), late="60 days")
    q = stream.writeStream.format("memory").queryName("counted").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = live.event_counters(events)
    assert {tuple(r)[:3] for r in spark.table("counted").collect()} <= {tuple(r)[:3] for r in batch.collect()}


def test_incremental_index(spark, tmp_path):
    kind = "file string, sha256 string, text string"
    a = spark.createDataFrame([("x", "1", "one"), ("y", "2", "two")], kind)
    a.coalesce(1).write.json(str(tmp_path / "in"))
    follow = lambda: live.follow_folder(spark.readStream.schema(kind).json(str(tmp_path / "in")), str(tmp_path / "index"), str(tmp_path / "state")).awaitTermination()
    follow()
    spark.createDataFrame([("x", "1", "one"), ("y", "3", "new"), ("z", "4", "z")], kind).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    follow()
    stored = spark.read.parquet(str(tmp_path / "index"))
    assert stored.count() == 4 and {(r.file, r.text) for r in live.latest(stored).collect()} == {("x", "one"), ("y", "new"), ("z", "z")}


def test_answers_from_frames_in_a_stream(spark, tmp_path):
    word = 'data: {"choices":[{"delta":{"content":"' + "word " * 20 + '"}}]}'
    first = [(1, 1, 'data: {"choices":[{"delta":{"content":"a"}}]}'), (1, 2, "data: [DONE]"), (2, 1, 'data: {"choices":[{"delta":{"content":"b"}}]}'), *((3, k, word) for k in range(60))]
    for k, rows in enumerate((first, [(3, 61, word)], [(4, 1, "data: [DONE]")])):
        (tmp_path / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("answer_id", "seq", "line"), r, strict=True))) for r in rows))
        os.utime(tmp_path / f"{k}.json", (1_700_000_000 + 10 * k,) * 2)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else batches without data go on for the sake of timeouts
    stream = spark.readStream.schema("answer_id long, seq long, line string").option("maxFilesPerTrigger", 1).json(str(tmp_path))
    q = live.answers_stream(stream, patience_ms=1).writeStream.format("memory").queryName("frames").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = sorted((r.answer_id, r.finish, r.error) for r in spark.table("frames").collect())
    assert got == [(1, None, None), (2, None, "no end"), (3, "loop", None), (4, None, "empty stream")]
    loop = live.fold_frames([word] * 60)
    assert loop["finish"] == "loop"


def test_files_that_go_leave_the_index(spark, tmp_path):
    kind, path = "file string, sha256 string, text string", str(tmp_path / "i")
    for rows in ([("x", "1", "one"), ("y", "2", "two")], [("x", None, None), ("y", "2", "two")]):
        live.upsert_index(spark.createDataFrame(rows, kind), path)
    assert [r.file for r in live.latest(spark.read.parquet(path)).collect()] == ["y"] and spark.read.parquet(path).count() == 3


def test_substring_collisions_and_money(spark):
    got = corpus.substring_collisions(spark.createDataFrame([("15",), ("1150",), ("11",), ("9",)], "digits string")).collect()
    assert {tuple(r) for r in got} == {("15", "1150"), ("11", "1150")}
    assert spark.range(1).select(corpus.money(F.lit(1234.5))).first()[0] == "$1,234.50"


def test_references_and_lines_of_markup(spark):
    raw = "Caf&eacute; &#x27;x&#39; &mdash; A&#8217;s &amp;lt; &nosuch; &#0; &#xD800; &#1114112; AT&T &copy;&#128512; &amp b &CounterClockwiseContourIntegral; &notit;"
    assert one(spark, text.unescape, raw, "none", None) == ["Caf\u00e9 'x' \u2014 A\u2019s &lt; &nosuch; \ufffd \ufffd \ufffd AT&T \u00a9\U0001f600 & b \u2233 \u00acit;", "none", None]
    markup = {
        "<style>x</style><p>a&amp;b</p><br>c&nbsp;d": "\na&b\n\nc d",
        "<div>c<p>d</p></div>": "\nc\nd\n\n",
        "<SCRIPT a='b'>1<2</script>x <i>y</i>  \t</td></table>z<h3>t</H3>": "x y\nzt\n",
        "<p class=x>one<blockquote>two</blockquote>\n\n\n\n</li>three": "\none\ntwo\n\nthree",
    }
    assert one(spark, text.strip_html, *markup, None) == [*markup.values(), None]
    assert [text.stripped(x) for x in markup] == list(markup.values())


def test_history_lines_are_decoded_in_one_pass(spark):
    rows = ["a\u0000b", "a\\nb", "\\", "x\ny\\\\\nz", "", "\\\n"]
    assert one(spark, lambda c: audit.decode_line(audit.encode_line(c)), *rows) == rows


def test_slides_without_a_place_come_last_and_bands_round(spark):
    rows = [(1, 1, None, None, 0, 12192000), (1, 2, 5, 330000, 10, 12192000), (1, 3, 0, 470000, 10, 12192000), (1, 4, 0, 0, 9000000, 12192000)]
    got = corpus.slide_order(spark.createDataFrame(rows, "slide long, shape long, x long, y long, cx long, width long"))
    assert [r.shape for r in got.orderBy("place").collect()] == [4, 3, 2, 1] or [r.shape for r in got.orderBy("place").collect()] == [4, 2, 3, 1]
    assert [r.shape for r in got.orderBy("place").collect()][-1] == 1


def test_ranks_by_cosine_are_those_of_all_vectors(spark):
    rng = np.random.default_rng(2)
    m = np.round(rng.normal(size=(300, 6)), 1)
    m[100:200] = m[:100]  # ties
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(m)]
    v = spark.createDataFrame(rows, "vec_id long, e array<double>").select("vec_id", retrieve.unit(F.col("e")).alias("v")).repartition(5)
    asked = v.where("vec_id < 20").select(F.col("vec_id").alias("qid"), F.col("v").alias("q"))
    full = {}
    for r in retrieve.cosine(v, asked, None, block=7).collect():
        full.setdefault(r.qid, []).append((-r.cos, r.chunk_id))
    ranks = {(q, c): k for q, x in full.items() for k, (_, c) in enumerate(sorted(x), 1)}
    assert len(full) == 20 and all(len(x) == 300 for x in full.values())
    near = retrieve.cosine(v, asked, 5, block=7).collect()
    assert {(r.qid, r.chunk_id): r["rank"] for r in near} == {k: x for k, x in ranks.items() if x <= 5}
    wanted = v.where("vec_id % 7 = 0").select(F.col("vec_id").alias("chunk_id")).join(asked.select("qid").where("qid % 2 = 0"))
    assert {(r.qid, r.chunk_id): r["rank"] for r in retrieve.cosine_ranks(v, asked, wanted, block=7).collect()} == {(q, c): x for (q, c), x in ranks.items() if q % 2 == 0 and c % 7 == 0}
    bm = spark.createDataFrame([(q, int(c), float(s)) for q in range(20) for c, s in zip(rng.permutation(300)[: 3 + 15 * q], np.round(rng.random(300) * 9, 2), strict=False)], "qid long, chunk_id long, bm25 double")
    cos = retrieve.cosine(v, asked, None).select("qid", "chunk_id", "cos")
    fused = retrieve.rrf(bm, cos)
    for k in (1, 5, 60, 100, 1000):
        whole = retrieve.top(fused, "rrf", k).select("qid", "rank", "chunk_id", "rrf").collect()
        got = retrieve.fused_top(bm, v, asked, k).select("qid", "rank", "chunk_id", "rrf").collect()
        assert set(map(tuple, got)) ^ set(map(tuple, whole)) == set(), k


def test_plans_have_no_nested_loops(spark):
    sf = "/root/testdata/sf0.001"
    for name in ("cosine_topk", "rrf_fusion", "dense_rescue", "bm25_batch_benchmark", "quota_retrieval", "number_rescue", "score_judged", "fabricated_numbers"):
        plan = __spark_entry__.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name
    plan = index.postings(index.chunks_of(spark.read.parquet(f"{sf}/documents.parquet")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("Exchange") == 1  # of texts, by chunk; terms and lengths are counted behind it


PARTIES = [("Alpha", ["Firm Alpha", "Alpha"], ["Alpha IP Group"]), ("Bravo", ["Firm Bravo", "Bravo"], []), ("Delta", ["Firm Delta"], None)]


def test_parties_are_named_by_whole_words_and_not_by_others(spark):
    parties = spark.createDataFrame(PARTIES, "party string, aliases array<string>, not_aliases array<string>")
    rows = spark.createDataFrame([(1, "alpha and Bravo."), (2, "The Alpha IP Group"), (3, "Alphabet, Bravos"), (4, "Alpha, not the alpha ip group; firm delta!"), (5, "Delta")], "qid long, t string")
    got = sorted(tuple(r) for r in score.mentions(rows, ["qid"], "t", parties).collect())
    assert got == [(1, "Alpha"), (1, "Bravo"), (4, "Alpha"), (4, "Delta")]
    said = spark.createDataFrame([(1, "What did Alpha quote?", "Alpha quoted $5,000. Bravo quoted $7,000. It is low. Alpha is not cheap."), (2, "Who is cheap?", "Bravo quoted $7,000. Nobody but Bravo.")], "qid long, question string, answer string")
    assert {r.qid: r.scope for r in score.attributed(said, parties).collect()} == {1: "Alpha quoted $5,000. It is low.", 2: "Bravo quoted $7,000."}


ITEM = "qid long, type string, question string, answer string, error string, refused boolean, warnings array<string>, must array<string>, any array<array<string>>, must_not array<string>, must_not_unless array<struct<token:string,licences:array<string>>>, cooccur array<struct<token:string,pattern:string>>, forbid_amounts boolean, names array<string>, names_not array<string>, local boolean, cite_must array<string>, cite_must_not array<string>, expect_warning array<string>, forbid_warning array<string>"


def test_three_way_scores_by_all_conditions(spark):
    base = {"type": "fact", "question": "What did Alpha quote?", "answer": "Alpha quoted $5,000 [S1].", "local": True}
    cases = {
        1: ({}, "CORRECT", []), 2: ({"answer": None}, "WRONG", ["no record"]), 3: ({"error": "x"}, "WRONG", ["error"]), 4: ({"must_not": ["$5,000"]}, "WRONG", ["forbidden token"]),
        5: ({"answer": "Bravo quoted $7,000 [S2].", "must_not": ["$7,000"]}, "CORRECT", []), 6: ({"answer": "Alpha quoted $7,000 [S1]."}, "WRONG", ["amount not in the cited source"]),
        7: ({"answer": "It is $9,100."}, "WRONG", ["amount in no chunk"]), 8: ({"answer": "It is $9,100 [INFERENCE]."}, "CORRECT", []), 9: ({"answer": "As in [S9]."}, "WRONG", ["forged label"]),
        10: ({"must_not_unless": [("$5,000", ["per patent"])]}, "WRONG", ["token without licence"]), 11: ({"must_not_unless": [("$5,000", ["Alpha"])]}, "CORRECT", []),
        12: ({"cooccur": [("alpha", "quoted .5")]}, "WRONG", ["token beside pattern"]), 13: ({"forbid_amounts": True}, "WRONG", ["amount given"]), 14: ({"names_not": ["Alpha"]}, "WRONG", ["forbidden name"]),
        15: ({"names": ["Bravo"]}, "SILENT", ["required name missing"]), 16: ({"must": ["9 May"]}, "SILENT", ["required token missing"]), 17: ({"any": [["x", "y"]]}, "SILENT", ["none of a group"]),
        18: ({"cite_must": ["alpha/"]}, "CORRECT", []), 19: ({"cite_must": ["echo/"]}, "SILENT", ["required source missing"]), 20: ({"cite_must_not": ["alpha/"]}, "WRONG", ["amount of a banned file"]),
        21: ({"expect_warning": ["LOOP"]}, "SILENT", ["warning missing"]), 22: ({"warnings": ["LOOP: x"], "forbid_warning": ["LOOP"]}, "SILENT", ["warning fired"]),
        23: ({"answer": "Not in the documents."}, "SILENT", ["refused"]), 24: ({"answer": "Not in the documents.", "type": "refuse", "any": [["q"]]}, "CORRECT", []),
    }
    names = [c.split()[0] for c in ITEM.replace("struct<token:string,licences:array<string>>", "s").replace("struct<token:string,pattern:string>", "s").split(", ")]
    items = spark.createDataFrame([tuple((base | {"qid": q} | c).get(n) for n in names) for q, (c, _, _) in cases.items()], ITEM)
    sources = spark.createDataFrame([(q, *x) for q in cases for x in ((1, "alpha/fees.md", "Fee of 5,000"), (2, "bravo/fees.md", "Fee of 7,000"))], "qid long, label int, file string, text string")
    numbers = spark.createDataFrame([("5000",), ("7000",)], "number string")
    parties = spark.createDataFrame(PARTIES, "party string, aliases array<string>, not_aliases array<string>")
    got = {r.qid: (r.label, r.reasons) for r in score.judged(items, sources, parties, numbers).collect()}
    assert got == {q: (label, reasons) for q, (_, label, reasons) in cases.items()}


def test_sweeps(spark):
    rules = spark.createDataFrame([("a", 1, r"\byes\b", "wrong"), ("a", 2, "no|not", "correct")], "item string, place int, pattern string, verdict string")
    runs = spark.createDataFrame([("0.0", "a", "No."), ("0.0", "a", "Yes, not so."), ("0.5", "a", "Perhaps"), ("0.5", "b", "x"), ("0.0", "a", None)], "setting string, item string, answer string")
    assert sorted(r.verdict for r in score.verdicts(runs, rules).collect()) == ["ambiguous", "ambiguous", "ambiguous", "correct", "wrong"]
    t = spark.createDataFrame([("0.0", "a", 4, 2, 3), ("0.0", "b", 4, 4, 1), ("0.5", "a", 4, 4, 1), ("0.5", "b", 4, 2, 1), ("1.0", "a", 4, 0, 4)], "setting string, item string, n long, correct long, distinct_answers long")
    assert sorted((r.setting, r["mean"], r.best) for r in score.best_setting(t).collect()) == [("0.0", 0.75, True), ("0.5", 0.75, False), ("1.0", 0.0, False)]


def test_problems_of_a_corpus_source(spark):
    docs = spark.createDataFrame([("a.md", "Pay $4,500 by 2026-01-02, {{amount:fee}} {{amount:nope}} {{TODO}}", ["fee", "old"]), ("b.md", "On 2026-03-03: {{name:who}}", ["who"])], "file string, text string, declared array<string>")
    constants = spark.createDataFrame([("amount", "fee", "$1,500", "b.md"), ("amount", "cap", "$500", None), ("name", "who", "secret name", None), ("date", "d", "x", "gone.md")], "kind string, id string, value string, file string")
    days, never, files = spark.createDataFrame([("2026-03-03",)], "day string"), spark.createDataFrame([("Secret name",), ("secret name",)], "phrase string"), spark.createDataFrame([("old.md",)], "file string")
    got = {tuple(r) for r in corpus.source_problems(docs, constants, days, never, files).collect()}
    assert got == {
        ("a.md", "literal amount", "$4,500"), ("a.md", "unknown date", "2026-01-02"), ("b.md", "never to be written", "secret name"), ("a.md", "undeclared", "nope"), ("a.md", "unused", "old"), ("a.md", "unknown constant", "amount:nope"),
        ("a.md", "unfinished", ""), ("gone.md", "no such file", "d"), ("b.md", "not placed", "fee"), (None, "amount within another", "500 in 1500"),
    }
    built = corpus.build_manifest(spark.createDataFrame([("a", "md", b"1"), ("b", "inherited", b"2"), ("c", "inherited", b"3")], "file string, kind string, content binary"), spark.createDataFrame([("b", b"2"), ("c", b"x")], "file string, content binary"))
    assert {r.file: r.same for r in built.collect()} == {"a": True, "b": True, "c": False}
    chunks = spark.createDataFrame([("t.eml", 1, 2, "2026-01-02", False), ("t.eml", 2, 2, "2026-01-01", False), ("u.eml", 1, 3, "", False), ("u.eml", None, None, None, True), ("n.md", None, None, None, False)], "file string, n int, of int, date string, overview boolean")
    skipped = spark.createDataFrame([("s.pdf", False), ("p.docx", True), ("n.md", False)], "file string, partial boolean")
    found = corpus.structure(chunks, spark.createDataFrame([("t.eml",), ("s.pdf",), ("x.md",)], "file string"), skipped)
    assert {tuple(r) for r in found.collect()} == {("t.eml", "messages out of order"), ("u.eml", "numbers with gaps"), ("t.eml", "no single overview"), ("x.md", "neither indexed nor skipped"), ("p.docx", "partly read but not indexed"), ("n.md", "skipped but indexed")}


def test_conversions_keep_a_manifest(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    for name in ("a.pdf", "scan.pdf", "c.doc", "own.pdf", "own.md"):
        (docs / name).write_bytes(name.encode())

    def runner(tool, source, sidecar):
        if "scan" in source:
            return True, " "
        text = f"text of {source} by {tool}, long enough"
        (docs / sidecar).write_text(text)
        return True, text

    m = api.Matter(spark, str(docs), str(tmp_path / "store"))
    events = lambda dry=False: {r.file: r.event for r in api.convert(m, runner, ["pdftotext"], dry).collect()}
    assert events(True) == {"a.pdf": "pending", "scan.pdf": "pending"} and events() == {"a.pdf": "converted", "scan.pdf": "empty"} and events() == {}
    manifest = lambda: {r.source: (r.sidecar, r.empty) for r in spark.read.parquet(f"{m.store}/manifest").collect()}
    assert manifest() == {"a.pdf": ("a.txt", False), "scan.pdf": ("scan.txt", True)}
    (docs / "a.pdf").unlink()
    assert events() == {} and set(manifest()) == {"scan.pdf"}


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_questions_about_messages_read_them(spark, matter):
    asked = spark.createDataFrame([(1, "What did Tomas write on March 3?", None), (2, "Give me an overview of the thread", None), (3, "What did he answer in his last reply?", None), (4, "What is the hourly rate?", None)], "qid long, question string, scope string")
    got = {}
    for r in api.search(matter, asked).orderBy("qid", "label").collect():
        got.setdefault(r.qid, []).append((r.read, r.heading.split(" (")[0][:23]))
    assert got[1] == [(True, "thread overview"), (True, "2026-03-03 Tomas Brandl")] and got[3] == got[1]
    assert len(got[2]) == 4 and all(read for read, _ in got[2]) and not any(read for read, _ in got[4])


def test_dense_search_summary_and_notes(spark, matter, tmp_path):
    vectors = lambda texts: [[float("rate" in t.lower()), float("fee" in t.lower()), 0.1] for t in texts]
    assert api.ingest(matter, embedder=vectors) and not api.ingest(matter, embedder=vectors)  # vectors can be made now, so they are
    asked = spark.createDataFrame([(1, "Which rates?", "firm-bravo"), (2, "Compare alpha and bravo fee", None)], "qid long, question string, scope string")
    hits = api.search(matter, asked, embedder=vectors).collect()
    assert any(r.qid == 1 and "hourly rate" in r.text and r.cos > 0.9 for r in hits) and {r.file.split("/")[0] for r in hits if r.qid == 2} >= {"firm-alpha", "firm-bravo"}
    recorded = RecordedGenerator(spark.createDataFrame([(0, "- Bravo plans three filings [S1][S2][S3][S4].\n- An item without any citation."), (1, "The rate is 480 [S1].")], "qid long, answer string"))
    done = api.summarize(matter, recorded, "firm-bravo", str(tmp_path / "out")).first()
    assert "[S1][S2][S3]." in done.answer and "UNGROUNDED SENTENCE: An item without any citation." in done.warnings and spark.read.text(str(tmp_path / "out")).count() == 2
    records = api.answer(matter, asked.where("qid = 1"), recorded, embedder=vectors)
    note = api.write_notes(matter, records).first()
    assert note.note.endswith("-which-rates.md") and "## Answer\n\nThe rate is 480 [S1: firm-bravo/fees.txt > page 2]." in note.text


def test_ingest_again_reads_what_changed(spark, tmp_path_factory, monkeypatch):
    root = tmp_path_factory.mktemp("again")
    put = lambda name, content: (root / "docs" / name).write_bytes(content)
    (root / "docs").mkdir()
    for name, content in {"a.md": b"red fox", "b.txt": b"blue fox", "c.md": b"green", "bad.docx": b"no archive"}.items():
        put(name, content)
    m = api.Matter(spark, str(root / "docs"), str(root / "store"))
    assert api.ingest(m)
    before, parsed = {r.chunk_id: r.text for r in m.table("chunks").collect()}, []
    monkeypatch.setattr(api.files_, "texts", lambda found, f=api.files_.texts: (parsed.extend(r.file for r in found.select("file").collect()), f(found))[1])
    put("b.txt", b"blue and yellow"), put("d.md", b"white fox"), (root / "docs" / "c.md").unlink()
    assert api.ingest(m) and not api.ingest(m)
    assert sorted(parsed) == ["b.txt", "d.md"]
    chunks = {r.chunk_id: r.text for r in m.table("chunks").collect()}
    assert chunks == {"a.md#0": before["a.md#0"], "b.txt#0": "blue and yellow", "d.md#0": "white fox"}
    assert {(r.term, r.chunk_id) for r in m.table("postings").where("term in ('fox', 'blue', 'green')").collect()} == {("fox", "a.md#0"), ("blue", "b.txt#0"), ("fox", "d.md#0")}
    assert [r.file for r in m.table("skipped").collect()] == ["bad.docx"] and {r.file for r in m.table("files").collect()} == {"a.md", "b.txt", "d.md", "bad.docx"}
    hits = api.search(m, spark.createDataFrame([(1, "fox")], "qid long, question string")).collect()
    assert {r.chunk_id for r in hits} == {"a.md#0", "d.md#0"}


def test_reports(spark):
    table = spark.createDataFrame([("b", 4, 2, 1, 1, 1), ("a", 2, 2, 0, 0, 0)], "cls string, n long, correct long, silent long, wrong long, silent_wrong long")
    lines = [r.line for r in score.envelope(table, "cls").orderBy("line_no").collect()]
    assert len(lines) == 4 and lines[3].startswith("| b | 4 | 2 | 1 | 1 | 1 | 0.250 | ")
    gap = score.sealed_gap(spark.createDataFrame([("CORRECT", False), ("WRONG", False), ("CORRECT", True)], "label string, sealed boolean")).first()
    assert (gap.public, gap.sealed, gap.gap) == (0.5, 1.0, -0.5)
    claims, flagged = spark.createDataFrame([("s", True), ("s", False)], "scope string, grounded boolean"), spark.createDataFrame([("s", "1"), ("s", "2")], "scope string, number string")
    assert tuple(score.faithfulness(claims, flagged, spark.createDataFrame([("1",)], "number string")).first()) == ("s", 2, 1, 1, 1)


def folded(rows, most):
    """Chunks of (heading, title, text) by a plain fold."""
    out = []
    for h, t, x in rows:
        last = out[-1] if out else None
        if last and last[:2] == [h, t] and len(last[2]) + len(x) < most and not x.lstrip().startswith("|") and not last[2].lstrip().startswith("|"):
            last[2] += "\n\n" + x
        else:
            out.append([h, t, x])
    return out


@pytest.mark.parametrize("seed", range(4))
def test_merging_equals_a_fold(spark, seed):
    rnd = random.Random(seed)
    most, rows = rnd.choice([12, 30, 900]), []
    for f in range(12):
        heading = "h"
        for k in range(rnd.choice([1, 2, 9, 200])):
            heading = heading if rnd.random() > 0.1 else rnd.choice("hgk")
            rows.append((f"f{f}", k // 70, k, heading, "", rnd.choice(["", " |"] + [""] * 5) + "x" * rnd.choice([1, 1, 2, 3, 7, 11, most - 1, most, most * 3])))
    got = segment.merge(spark.createDataFrame(rows, "file string, section int, first_line int, heading string, title string, text string").repartition(5), most)
    have = [(r.file, r.chunk_pos, r.heading, r.title, r.text) for r in got.orderBy("file", "chunk_pos").collect()]
    want = [(f, k, *c) for f in sorted({r[0] for r in rows}) for k, c in enumerate(folded([r[3:] for r in rows if r[0] == f], most))]
    assert have == want


def test_merging_one_long_file(spark):
    """200,000 pieces of one file without a heading."""
    raw = spark.range(200_000).select(F.lit("f").alias("file"), F.lit(0).alias("section"), F.col("id").cast("int").alias("first_line"), F.lit("").alias("heading"), F.lit("").alias("title"), F.repeat(F.lit("x"), (F.col("id") % 97 + 1).cast("int")).alias("text"))
    found = segment.merge(raw).agg(F.count("*"), F.sum(F.length("text"))).first()
    want = folded([("", "", "x" * (k % 97 + 1)) for k in range(200_000)], 900)
    assert tuple(found) == (len(want), sum(len(c[2]) for c in want))


def test_phrases_in_parts(spark):
    texts = spark.createDataFrame([(1, "The RED fox and the red foxes"), (2, "ox"), (3, None), (4, ""), (1, "fox")], "k long, t string")
    said = spark.createDataFrame([("red fox",), ("Fox",), ("ox",), (None,), ("",), ("é",), ("fox",)], "phrase string")
    for size in (1, 8, 1 << 20):
        got = sorted(map(tuple, phrases.phrases_in(texts, ["k"], "t", said, size).collect()))
        assert got == [(1, "Fox"), (1, "Fox"), (1, "fox"), (1, "fox"), (1, "ox"), (1, "ox"), (1, "red fox"), (2, "ox")]
    assert phrases.phrases_in(texts, ["k"], "t", said.limit(0)).collect() == [] and phrases.phrases_in(texts.limit(0), ["k"], "t", said).collect() == []


def test_figures_lie_within_runs_of_digits(spark):
    answers = spark.createDataFrame([(1, "", "It is 4,800 or 4.5, not 77 [S1]."), (2, "", "4800"), (3, "", "12 and 1.2"), (4, "", "none")], "qid long, question string, answer string")
    sources = spark.createDataFrame([(1, 1, "f", "", "148,005 a 14.55"), (1, 2, "f", "h 7", "x7x7"), (3, 1, "f", "", "a11.2.3b")], "qid long, label int, file string, heading string, text string")
    assert sorted(map(tuple, verify.unverified_numbers(answers, sources).collect())) == [(1, "77"), (2, "4800"), (3, "12")]


def test_nested_messages(spark):
    rows = [("f", 0, None, "Re: Fees"), ("f", 1, 0, None), ("f", 2, 1, " "), ("f", 3, 2, "Own"), ("f", 4, 3, None), ("g", 0, None, None), ("g", 1, 9, "lost"), ("g", 2, 2, "loop")]
    got = {(r.file, r.part): (r.subject, r.inherited, r.depth) for r in threads.nested(spark.createDataFrame(rows, "file string, part int, parent int, subject string")).collect()}
    assert got == {("f", 0): ("Re: Fees", False, 0), ("f", 1): ("Fees", True, 1), ("f", 2): ("Fees", True, 2), ("f", 3): ("Own", False, 3), ("f", 4): ("Own", True, 4), ("g", 0): ("", False, 0)}


def test_numbers_of_questions_are_lines(spark, tmp_path):
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "a.txt").write_text("# c\n\nOne?\nTwo?\n")
    (tmp_path / "q" / "b.txt").write_text("Three?\r\n--diverse :: Four?")
    assert [(r.qid, r.question) for r in files.questions(spark, str(tmp_path / "q")).orderBy("qid").collect()] == [(3, "One?"), (4, "Two?"), ((1 << 32) + 1, "Three?"), ((1 << 32) + 2, "Four?")]
