"""Operators that work text by text."""

import hashlib
import html
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexgrove.llm import html_text, licenses, media, pieces, token_counts, toxicity

from .conftest import documents

ODD = list("ab tTheing  \n\t.,'s0129<|>_-éÉñßΣσİ中文²①Ⅷ́\x1c\x85\xa0 🎉▁{}()")


def fuzz(n=400, seed=1):
    rnd = random.Random(seed)
    made = ["".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 60))) for _ in range(n)]
    return made + ["", "<|endoftext|>a<|startoftext|>", "   ", "▁▁ a", "x" * 3000, " " * 100, "the " * 50, "ΑΣ ΣΑΣ don't we'LL 'S"] + [t for _, t, *_ in documents() if t]


def test_token_counts_equal_the_tokenizers():
    mine, theirs = token_counts.counter(public_tokenizers.path("word_bpe_49k.json")), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for t in fuzz():
        assert mine.count(t) == len(theirs.encode(t, add_special_tokens=False).ids), ascii(t)


def test_token_counts_of_messy_rows(docs, nothing):
    rows = token_counts.counts(docs, limit=100).collect()
    assert len(rows) == docs.count() and nothing.count() == token_counts.counts(nothing).count()
    theirs = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_id = {d: t or "" for d, t, *_ in documents()}
    for r in rows:
        t = by_id[r.doc_id]
        n = len(theirs.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 100)


def test_pieces_equal_the_library_and_come_back():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    mine, theirs = pieces.pieces_of(path), sentencepiece.SentencePieceProcessor(model_file=path)
    for t in fuzz():
        ids = mine.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == theirs.encode(t), ascii(t)
        if "▁" not in t:
            assert mine.decode(ids) == t


def test_stream_commits_the_same_pieces_from_any_parts():
    model = pieces.pieces_of(public_tokenizers.path("piece_bpe_32k.model"))
    text = "▁" + "▁".join("thetion erstation international 1234567 ((( wordswithoutspaces".split()) + "ab" * 200
    whole = list(model.stream([text]))
    assert "".join(whole) == text
    for size in (1, 7, 50):
        stream = model.stream(text[k : k + size] for k in range(0, len(text), size))
        assert list(stream) == whole


def test_short_runs_look_at_few_boundaries_and_give_the_same_pieces(monkeypatch):
    rnd, model = random.Random(5), pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    runs = ["▁" + "".join(rnd.choice(["th", "er", "tion", "ing", "ation", "ment", "é", "q", "auß", "\u0416", "\U0001f600"]) for _ in range(rnd.randint(1, 12))) for _ in range(400)]
    found = [model.encode(r[1:]) for r in runs]
    looked = len(model.by_prefix)
    assert found == [b"".join(np.array(model._numbers(p), "<u4").tobytes() for x in model.cut.findall(r) for p in model.stream([x])) for r in runs]
    assert looked < 0.9 * len({x[:i] for r in runs for x in model.cut.findall(r) for i in range(1, min(16, len(x) + 1))})
    monkeypatch.setattr(pieces, "PREFIX_ENTRIES", 0)  # without room for what is met, the same
    for held in (model.by_prefix, model.pair_ok, model.known):
        held.clear()
    assert [model.encode(r[1:]) for r in runs] == found


def test_unigram_search_finds_the_best_path():
    model = object.__new__(pieces.Pieces)
    rnd = random.Random(2)
    vocabulary = {c: i for i, c in enumerate("abc")} | {"".join(rnd.choice("abc") for _ in range(rnd.randint(2, 4))): 10 + i for i in range(25)}
    model.ids = {p: k for k, p in enumerate(sorted(vocabulary))}
    model.score = [-rnd.random() * len(p) for p in sorted(vocabulary)]
    model.merges, model.longest, model.lengths, model.pair_ok, model.by_prefix = False, 4, {}, {}, {}

    def best(t):
        top = [(0.0, [])]
        for i in range(1, len(t) + 1):
            top.append(max((top[j][0] + model.score[model.ids[t[j:i]]], top[j][1] + [t[j:i]]) for j in range(max(0, i - 4), i) if t[j:i] in model.ids))
        return top[-1][0]

    for _ in range(30):
        t = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 90)))
        found = list(model.stream([t]))
        assert "".join(found) == t and abs(sum(model.score[model.ids[p]] for p in found) - best(t)) < 1e-9


def test_encode_and_decode_messy_rows(docs, nothing):
    by_id = {d: t for d, t, *_ in documents()}
    rows = pieces.decode(pieces.encode(docs)).collect()
    assert len(rows) == docs.count() and all(r.text == (by_id[r.doc_id] or "").replace("▁", " ") for r in rows)
    assert pieces.encode(nothing).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T &amp; U</title><script>var a="</p>";</script></head><body><header class="site">Site</header>
<nav><ul><li><a href="/a">One</a></li></ul></nav><div id="cookie-notice">We use cookies <div>really</div></div>{open}<h1>A  title</h1><p>First&nbsp;line &amp; more, long enough to be read as text of an article.
<p>Second <b>line</b> with a <a href="x">link</a><br>and another.</p><div class="ad-box ad">Buy <p>now</p></div><aside>Aside</aside><form><input>Name</form><p>Third line, which comes after the advert and is text again.</p><p>.</p>{close}
<section class="comments"><article class="comment">Nice!</article></section><footer>&copy; Foot</footer></body></html>"""
TEXT = "A title\nFirst line & more, long enough to be read as text of an article.\nSecond line with a link\nand another.\nThird line, which comes after the advert and is text again.\n."


def test_main_text_with_and_without_an_article_element():
    assert html_text.extract(PAGE.format(open="<article>", close="</article>")) == TEXT
    assert html_text.extract(PAGE.format(open="<div>", close="</div>")).startswith("A title\nFirst line")
    assert "Third line" in html_text.extract(PAGE.format(open="", close=""))
    for page in (None, "", "<html></html>", "<p>", "<", "<script>x", "<!-- ", "<a href='"):
        assert html_text.extract(page) in ("", "<", "<a href='")


def test_main_text_of_the_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in html_text.main_text(pages).join(pages.select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"<(?:/?p|/?h1|br)>", body)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)
    odd = spark.createDataFrame([(1, None, None, 2), (1, "u", "", 2), (None, "u", "<p>x</p>", 2)], "page_id long, url string, html string, text int")
    assert sorted((r.text, r.n_chars) for r in html_text.main_text(odd).collect()) == [("", 0), ("", 0), ("x", 1)]
    assert html_text.main_text(odd.limit(0)).count() == 0


def test_surge_and_dive():
    assert html_text.region([0, 5, 0, 0, 0, 60, 70, 0, 40, 0, 0, 0, 3]) == (5, 9)
    assert html_text.region([]) == (0, 0) and html_text.region([0, 0]) == (0, 0) and html_text.region([4]) == (0, 1)


def test_media_columns_round_trip(docs, nothing):
    by_id = {d: (t or "").encode() for d, t, *_ in documents()}
    rows = media.media_columns(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        b = by_id[r.doc_id]
        p = b + b" " * ((-len(b)) % 192 or (192 if not b else 0))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        png = media.to_png(p)
        assert r.media_sha256 == hashlib.sha256(png).hexdigest() and media.from_png(png) == p
    same = {(r.media_sha256, r.feature) for r in rows if by_id[r.doc_id] == b""}
    assert len(same) == 1 and media.media_columns(nothing).count() == 0


def test_archives_are_read_by_range_and_members_are_tried_again(docs, tmp_path):
    folder = media.store(docs, most=20_000)
    reader = media._Reader({"path": folder, "rangebytes": "3000"})
    ranges = reader.partitions()
    names = [r.column(0).to_pylist() for p in ranges for r in reader.read(p)]
    assert len(ranges) > 5 and Counter(x for n in names for x in n) == Counter(d for d, *_ in documents())
    files, _ = media._files(folder)
    first = next(p for p in ranges if p.path)
    import zipfile

    with files.open_input_file(first.path) as f, zipfile.ZipFile(f) as z:
        i = z.infolist()[0]

    class Flaky:
        def __init__(self, fails):
            self.left, self.opened = fails, 0

        def open_input_file(self, path):
            self.opened += 1
            if self.left:
                self.left -= 1
                raise OSError("gone")
            return files.open_input_file(path)

    flaky = Flaky(2)
    reader._open = None
    assert len(reader.member(flaky, first.path, i.header_offset, i.compress_size, i.CRC)) == i.compress_size and flaky.opened == 3
    reader._open = None
    with pytest.raises(OSError):
        reader.member(Flaky(3), first.path, i.header_offset, i.compress_size, i.CRC)
    with pytest.raises(ValueError):
        media.from_png(media.to_png(b" " * 192)[:-20] + b"x" * 20)


def test_licences(docs, nothing):
    m = licenses.model()
    text = "Some words.\nLicensed under the Apache License, Version 2.0.\nthe the the the\n\nReleased under the MIT License.\nThe licence plate of the car was public."
    n, found = m.paragraphs(text)
    assert n == 5 and [(k, f, ok) for k, f, _, _, ok in found] == [(1, "apache", True), (3, "mit", True)]
    lines = {"All rights reserved.": "all-rights-reserved", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "This work is licensed under the GNU General Public License, version 3.": "gpl"}
    for line, family in lines.items():
        assert [f for _, f, *_ in m.paragraphs(line)[1]] == [family]
    assert m.paragraphs(None) == (0, []) and m.paragraphs(" \n") == (0, [])
    rows = licenses.scan(docs).collect()
    assert len(rows) == docs.count() and not any(x.confirmed for r in rows for x in r.licences) and licenses.scan(nothing).count() == 0


def test_licences_held_out():
    m, rnd = licenses.model(), random.Random(99)
    right = 0
    cases = [(f, g.format(n)) for f, names in licenses.NAMES.items() for n in names for g in licenses.GRANTS[:4]]
    for f, t in cases:
        words = "".join(rnd.choice("abcde") for _ in range(5))
        right += [x[1] for x in m.paragraphs(f"{words} {t}")[1]] == [f]
    assert right / len(cases) > 0.95
    wrong = sum(bool(m.paragraphs(" ".join(rnd.choice(licenses.COMMON) for _ in range(rnd.randint(1, 30))))[1]) for _ in range(500))
    assert wrong <= 3


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.scores(d, labels).join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    clean, toxic = [r for r in rows if not r.toxic], [r for r in rows if r.toxic]
    assert sum(r.predicted for r in clean) / len(clean) < 0.01 and sum(r.predicted for r in toxic) / len(toxic) > 0.75


def test_toxicity_of_messy_rows(spark, docs, nothing):
    labels = spark.createDataFrame([(3 * k, 1, k % 2) for k in range(40)] + [(0, 1, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.scores(docs, labels).collect()
    assert len(rows) == docs.count() and len({r.score for r in rows if not (dict((d, t) for d, t, *_ in documents())[r.doc_id] or "").strip()}) == 1
    assert toxicity.keep_clean(docs, labels).columns == docs.columns
    assert {r.predicted for r in toxicity.scores(docs, labels.limit(0)).collect()} == {0}
    assert toxicity.scores(nothing, labels).count() == 0
