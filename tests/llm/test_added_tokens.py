"""Ids of the vocabulary's JSON file: added tokens and long white space."""

from __future__ import annotations

import zlib

import numpy as np

from tideline.llm import packing


def test_queries_emit_added_tokens_as_tokenizers_does(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline
    from tideline.llm.queries import op4

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [f"one {end} two", end, f"{end}{end}a", f"a\n\n{end}  b {end}", f"x {end[:-1]} y", "plain text", "", None]
    docs = spark.createDataFrame(enumerate(texts), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for d, x in enumerate(texts):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        want[d] = (len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
    for out in (op4(spark, str(tmp_path)), corpus_pipeline.pack(spark, docs, "")):
        assert {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in out.collect()} == want


def test_long_white_space_is_encoded():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    e = packing.Encoder(*packing._rank_file(), packing._added_tokens())
    n = packing._RUN_CHARS
    cases = [" " * 2_000_000, "\n" * 1_200_000 + "a", "a b" + " " * n + "c d", "a" + "\n" * n + "b", "a " + "\t" * (n + 1) + " b", "é" + "　" * n, " \n" * n + "<|endoftext|>" + " " * n + "x", " " * (n - 1) + "x", "a" + "\x1c" * n + "b"]
    for x in cases:
        assert e.ids(x) == np.array(t.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes()
