"""Registered columns of the queries that work text by text, against the libraries."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from lexgrove.llm import media, queries

SF = "/root/testdata/sf0.001"


def test_registered_columns_equal_the_libraries(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    words = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in queries.op6_token_counts(spark, SF).collect():
        t = texts[r.doc_id]
        n = len(words.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 2048)
    for r in queries.op3_sentencepiece(spark, SF).collect():
        t = texts[r.doc_id]
        ids = np.array(pieces.encode(t), "<u4")
        assert (r.n_ids, r.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
        assert r.text_sha256 == hashlib.sha256(t.replace("▁", " ").encode()).hexdigest()
    for r in queries.op10_media_columns(spark, SF).collect():
        b = texts[r.doc_id].encode()
        p = b + b" " * (-len(b) % 192 or (0 if b else 192))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(media.to_png(p)), hashlib.sha256(media.to_png(p)).hexdigest())
