"""Packing by best fit: ids, laws of the sequences, and the search against a plain one."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.helpers import documents, empty
from tideline.llm import best_fit, bpe
from tideline.llm.queries import QUERIES


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_file())


def plain_best_fit(sizes, capacity):
    windows, rooms = [], []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [r for r in rooms if r >= sizes[i]]
        if fits:
            k = max(k for k, r in enumerate(rooms) if r == min(fits))
            rooms[k] -= sizes[i]
            windows[k].append(i)
        else:
            windows.append([i])
            rooms.append(capacity - sizes[i])
    return windows


@pytest.mark.parametrize("seed", range(8))
def test_the_tightest_window_is_found(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 5, 64, 1000, 1024])
    sizes = [rng.randint(1, capacity) for _ in range(rng.choice([0, 1, 50, 400]))]
    got, want = best_fit.best_fit_decreasing(sizes, capacity), plain_best_fit(sizes, capacity)
    fills = lambda windows: sorted(sum(sizes[i] for i in w) for w in windows)
    assert fills(got) == fills(want) and sorted(i for w in got for i in w) == list(range(len(sizes)))


@pytest.mark.parametrize("seed", range(12))
def test_filling_up_keeps_every_token(seed):
    rng = random.Random(seed)
    sizes = [600] * 40 if seed == 0 else [rng.randint(1, 1023) for _ in range(rng.choice([0, 1, 2, 9, 300]))]
    slack = rng.choice([0, 3, 8])
    out = best_fit.fill_up([[(i, 0, sizes[i]) for i in w] for w in best_fit.best_fit_decreasing(sizes, 1024)], 1024, slack)
    runs = defaultdict(list)
    for window in out:
        n = sum(x[2] for x in window)
        assert 0 < n <= 1024 and (1024 - n <= slack or n & (n - 1) == 0)
        for i, start, length in window:
            runs[i].append((start, length))
    assert len(out) <= -(-sum(sizes) // (1024 - slack)) + 11
    for i, size in enumerate(sizes):
        at = 0
        for start, length in sorted(runs[i]):
            assert start == at and length > 0
            at += length
        assert at == size


def test_ids_are_those_of_the_library():
    rng = random.Random(11)
    encode, own = bpe.encoder(), library()
    pieces = [*"ab 'sé\n\t 1!  _", "\n\n", ". ", "\n", " <|endoftext|>", "'s", " \x1c", "　", "​", "\x85", "\r\n", " the"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(14))) for _ in range(4000)] + ["", "x" * 5000, "word " * 3000, "w\n" * 3000]
    for text, ids in zip(texts, encode.encode(texts), strict=True):
        assert np.frombuffer(ids, f"<u{encode.width}").tolist() == own.encode(text, add_special_tokens=False).ids, repr(text)


def laws(rows, texts):
    """Every id of every document once, with its checksum; sequences without gaps; little padding."""
    own, pieces, sequences = library(), defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"], r["ids_crc32"]))
    ids_of = [(d, np.array([*own.encode(t or "", add_special_tokens=False).ids, 0], "<u4")) for d, t in texts]
    every = Counter()
    for d, ids in ids_of:
        every[d, len(ids)] += 1
    assert set(every) == set(pieces)
    by_key = {(d, len(ids)): ids for d, ids in ids_of}
    for key, found in pieces.items():
        ids, covered = by_key[key], Counter()
        for start, length, crc in found:
            covered.update(range(start, start + length))
            assert 0 < length <= 1024
            if every[key] == 1:
                assert crc == zlib.crc32(ids[start : start + length].tobytes())
        assert covered == Counter({i: every[key] for i in range(len(ids))})
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
        padding += 1024 - at if at & (at - 1) else 0
    return padding / sum(len(ids) for _, ids in ids_of)


def test_documents_of_all_kinds(spark):
    docs = documents(spark, extra=True)
    docs = docs.union(docs.limit(1).selectExpr("500 AS doc_id", "repeat('word ', 4095) AS text", *docs.columns[2:])).union(docs.limit(1).selectExpr("501", "'a <|endoftext|> b'", *docs.columns[2:]))
    texts = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    for blocks in (16, best_fit.BLOCK_PIECES):
        rows = best_fit.pack_windows(docs, block_pieces=blocks).collect()
        assert laws(rows, texts) <= best_fit.SLACK / 1000
    assert best_fit.pack_windows(docs, slack=0).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert best_fit.pack_windows(empty(spark)).count() == 0


def test_equal_lengths_leave_no_padding(spark):
    docs = spark.range(0, 300, 1, 4).selectExpr("id AS doc_id", "repeat('word ', 599) AS text")
    rows = best_fit.pack_windows(docs).collect()
    assert laws(rows, [(r["doc_id"], r["text"]) for r in docs.collect()]) <= best_fit.SLACK / 1000


def test_query(spark):
    from tests.conftest import SF

    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert laws(QUERIES["op11_best_fit"](spark, SF).collect(), texts) < 0.002
