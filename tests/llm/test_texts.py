from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import documents, empty, sentence
from tideline.llm import decontam, jaccard_join, lang_id, line_dedup, masked_lm, packing, suffix_dedup

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows(df, *cols):
    return Counter(tuple(r) for r in df.select(*cols).collect())


# benchmark decontamination


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(ASCII))


def leaks(docs, items, n):
    grams = {}
    for i, t in items:
        w = words(t)
        k = min(n, len(w))
        for a in range(len(w) - k + 1) if w else []:
            grams.setdefault(tuple(w[a : a + k]), set()).update([] if i is None else [str(i)])  # no id: a hit, but no name
    out = []
    for d, t in docs:
        w, hit, seen = words(t), set(), set()
        for k in {len(g) for g in grams}:
            for a in range(len(w) - k + 1):
                if (found := grams.get(tuple(w[a : a + k]))) is not None:
                    hit |= set(range(a, a + k))
                    seen |= found
        out.append((d, len(w), len(hit), len(seen), hashlib.sha256(",".join(sorted(seen)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


@pytest.fixture
def items(spark):
    rng = random.Random(9)
    base = [t for (t,) in documents(spark).select("text").collect() if t]
    made = [(i, " ".join(words(base[i * 7])[2:30])) for i in range(8)]
    made += [(50, "The End"), (51, "the end!"), (52, None), (53, "..."), (None, base[1]), (54, sentence(rng, 5)), (54, base[2]), (55, "ÉCOLE"), (56, "spam " * 12)]
    return spark.createDataFrame(made, "item_id long, text string")


def test_decontamination(spark, items):
    docs = documents(spark, extra=True).union(documents(spark, extra=True).where("doc_id = 0").withColumn("text", F.lit("a École b Kelvin K THE end")))
    got = rows(decontam.report(docs, items), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == leaks([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.collect()], 10)
    assert decontam.report(empty(spark), items).count() == 0
    assert rows(decontam.report(docs, items.limit(0)), "n_hit") == Counter({(0,): docs.count()})


def test_removal(spark, items):
    docs = documents(spark, extra=True)
    kept = decontam.decontaminate(docs, items)
    want = leaks([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.collect()], 10)
    assert kept.columns == docs.columns and kept.count() == sum(n for r, n in want.items() if not r[5])
    cut = decontam.decontaminate(docs, items, remove="spans")
    assert cut.columns == docs.columns and cut.count() == docs.count()
    left = sorted((r["doc_id"] or -1, len(words(r["text"]))) for r in cut.collect())
    assert left == sorted((r[0] or -1, r[1] - r[2]) for r in want.elements())


# line dedup


def test_line_dedup(spark):
    data = [(i, "h1", f"menu\nown {i}\n  menu ") for i in range(20)] + [(i, "h2", f"line {i}\n" + ("foot" if i < 25 else "")) for i in range(20, 40)]
    data += [(50, None, "menu\nx"), (51, "h1", None), (52, "h1", ""), (53, "h3", "menu"), (0, "h1", "menu\nown 0\n  menu ")]
    df = spark.createDataFrame(data, "doc_id long, source string, text string").withColumn("lines", F.lit(1)).withColumn("host", F.lit(2)).withColumn("n", F.lit(3))
    got = rows(line_dedup.dedup_lines(df), "doc_id", "text", "n_lines", "n_dropped")
    want = Counter([(i, f"own {i}", 3, 2) for i in range(20)] + [(i, f"line {i}", 2, 1) if i < 25 else (i, f"line {i}\n", 2, 0) for i in range(20, 40)])
    want += Counter([(50, "menu\nx", 2, 0), (51, None, 0, 0), (52, "", 1, 0), (53, "menu", 1, 0), (0, "own 0", 3, 2)])
    assert got == want
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


# n-gram Jaccard join


def shingles(t):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(ASCII)) if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near(docs):
    sets = [shingles(t) for _, t in docs]
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for g, (d, _) in zip(group, docs):
        least[g] = min((x for x in (least.get(g), d) if x is not None), default=None)
    return Counter((d, len(s), least[g]) for g, (d, _), s in zip(group, docs, sets)), len({g for g, s in zip(group, sets) if s}) + sum(not s for s in sets)


@pytest.mark.parametrize("limits", [(4_000_000, 2048), (3000, 3)])
def test_jaccard_join(spark, monkeypatch, limits):
    monkeypatch.setattr(jaccard_join, "GROUP_BYTES", limits[0])  # the second cuts families into many groups
    monkeypatch.setattr(jaccard_join, "GROUP_SETS", limits[1])
    docs = documents(spark, extra=True)
    want, groups = near([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert rows(jaccard_join.jaccard_components(docs), "doc_id", "n_shingles", "component_id") == want
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == groups


def test_jaccard_join_empty(spark):
    assert jaccard_join.jaccard_components(empty(spark)).count() == 0
    assert jaccard_join.keep_one(empty(spark)).count() == 0


# suffix arrays


def repeats(docs, span):
    data = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(x[i : i + span] for _, x in data for i in range(len(x) - span + 1))
    out = []
    for d, x in data:
        hit = np.zeros(len(x) + 1, int)
        for i in range(len(x) - span + 1):
            if seen[x[i : i + span]] > 1:
                hit[i] += 1
                hit[i + span] -= 1
        inside = np.cumsum(hit[:-1]) > 0
        out.append((d, int(inside.sum()), int((np.diff(np.concatenate([[0], inside.astype(int), [0]])) == 1).sum()), bytes(np.frombuffer(x, np.uint8)[~inside]) if x else b""))
    return Counter(out)


@pytest.mark.parametrize("shard", [3_000_000, 3000])
@pytest.mark.parametrize("span", [400, 90])
def test_suffix_dedup(spark, shard, span):
    docs = documents(spark, extra=True)
    got = suffix_dedup.remove_repeats(docs, span=span, shard_bytes=shard)
    assert got.columns == [*docs.columns, "spans", "kept"]
    mine = Counter((r["doc_id"], sum(x["end"] - x["begin"] for x in r["spans"]), len(r["spans"]), bytes(r["kept"])) for r in got.collect())
    assert mine == repeats([tuple(r) for r in docs.select("doc_id", "text").collect()], span)


def test_suffix_dedup_empty(spark):
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


@pytest.mark.parametrize("span", [40, 90, 400])
def test_every_string_has_one_anchor(span):
    """Strings that are equal have the same anchor at the same distance, so that shards dealt by anchor need no merging."""
    from tideline.llm.anchors import Prints, anchors

    rng = random.Random(span)
    passage = sentence(rng, 150)
    texts = [sentence(rng, 60) + passage + sentence(rng, 60), passage + sentence(rng, 40), "spam " * 300, "short", "a" * 700, passage[50:] + "spam " * 200]
    rows = [t.encode() for t in texts]
    raw, starts = np.frombuffer(b"".join(rows), np.uint8), np.cumsum([0, *map(len, rows)])
    strings, anchor = Counter(), {}
    for at, a, row, first, last in zip(*(x.tolist() for x in anchors(raw, starts, span, Prints(raw))), strict=True):
        for s in range(first, last + 1):
            assert starts[row] <= s <= at < s + span <= starts[row + 1]
            strings[s] += 1
            assert anchor.setdefault(raw[s : s + span].tobytes(), (a, at - s)) == (a, at - s)
    assert strings == Counter(s for a, b in zip(starts, starts[1:]) for s in range(a, b - span + 1))


def test_regions_of_a_common_anchor_are_halved(spark):
    """Each string of a region is in one half, equal strings have the same new anchor, and regions that run apart part."""
    rng = random.Random(5)
    common = sentence(rng, 40).encode()[:100]  # 60 bytes before the anchor, 40 after its begin
    data = [common[60 - k :] + sentence(rng, 40).encode()[:40] for k in (60, 60, 10)]
    at = [60, 60, 10]
    rows = [(7, k, 500, 10, 10 + len(x), at[k], 0, 60, bytearray(x)) for k, x in enumerate(data)]
    regions = spark.createDataFrame(rows, "a long, t long, n long, lo long, hi long, at long, near long, far long, data binary")
    got = suffix_dedup._halves(regions, 80).collect()
    strings, anchor = Counter(), {}
    for r in got:
        x = bytes(r["data"])
        assert len(x) == r["hi"] - r["lo"] and x == data[r["t"]][r["lo"] - 10 : r["hi"] - 10]
        for k in range(len(x) - 79):
            strings[r["t"], r["lo"] + k] += 1
            assert r["near"] <= r["at"] - k <= r["far"]
            assert anchor.setdefault(x[k : k + 80], (r["a"], r["at"] - k)) == (r["a"], r["at"] - k)
    assert strings == Counter((k, 10 + s) for k, x in enumerate(data) for s in range(len(x) - 79) if 0 <= at[k] - s <= 60)
    assert len({r["a"] for r in got}) == 4  # of the nearer strings, which run on into different bytes, each stands alone


@pytest.mark.parametrize("seed", range(12))
def test_suffix_array(seed):
    rng = random.Random(seed)
    raw = np.array([rng.choice(b"ab"[: 1 + seed % 2]) for _ in range(rng.randrange(1, 400))], np.uint8)
    order, _, _ = suffix_dedup.suffix_array(raw, 10_000)
    text = raw.tobytes()
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    order, rank, close = suffix_dedup.suffix_array(raw, 20)
    got = suffix_dedup.common_prefixes(raw, order, rank, close, 20)
    for k in range(1, len(order)):
        a, b = text[order[k - 1] :][:20], text[order[k] :][:20]
        same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert got[k] == same if same >= 10 else got[k] <= 20


# packing


def test_tokens_and_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    odd = ["a  b", " lead", "trail ", "x \n y", "tab\tq  ", "it's 'quoted' <|endoftext|> 1234 é", "  nb  s", "x" * 5000, "word " * 2047, "w " * 4096]
    docs = documents(spark, extra=True).select("doc_id", "text", "pid", "n").union(spark.createDataFrame([(1000 + i, x, 1, 2) for i, x in enumerate(odd)], "doc_id long, text string, pid int, n int"))
    want = Counter()
    for d, x in docs.select("doc_id", "text").collect():
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        at = 0
        for k in range(-(-len(ids) // 1024)):
            size = (len(ids) - 1) % 1024 + 1 if k == 0 else 1024
            want[d, k, at, size, zlib.crc32(np.array(ids[at : at + size], dtype="<u4").tobytes())] += 1
            at += size
    out = packing.pack_documents(docs).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    held = {}
    for r in out:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r["length"] for r in out)
    assert len(held) <= -(-total // 1024) * 1.03 + 1
    assert packing.pack_documents(empty(spark)).count() == 0


def test_crossover_keeps_every_piece():
    rng = random.Random(4)
    sizes = np.array([rng.randint(1, 1023) for _ in range(700)])
    first = [packing.first_solution(sizes, 1024, x, rng) for x in (0.0, 0.3, 0.6)]
    ranked = packing.evolve(first, sizes, 1024, 30, rng)
    assert all(np.bincount(x, weights=sizes).max() <= 1024 and np.bincount(x).min() > 0 for x in ranked)
    assert packing.fitness(ranked[0], sizes, 1024) >= max(packing.fitness(x, sizes, 1024) for x in first)


# language


def test_language(spark):
    rng = random.Random(2)
    syllables = {"xx": ["ba", "lo", "mi", "ru"], "yy": ["stra", "eck", "ung", "zw"]}
    make = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    train = spark.createDataFrame([(make(x, 40), x) for x in ("xx", "yy") for _ in range(30)] + [("?", "xx"), (None, "yy"), ("ab", None)], "text string, lang string")
    model = lang_id.fit(train)
    assert model.languages == ["xx", "yy"]
    data = [(i, make("xx" if i % 2 else "yy", 1 + 10 * (i % 40)), i % 2) for i in range(80)] + [(900, None, 9), (901, "", 9), (902, "12 !?", 9), (904, "² ½", 9), (905, "Ⅷ①②_", 9), (903, make("xx", 60_000), 1)]
    got = lang_id.identify(spark.createDataFrame(data, "doc_id long, text string, score int"), model).join(spark.createDataFrame(data, "doc_id long, t string, odd int").drop("t"), "doc_id").collect()
    assert len(got) == len(data) and all(0 <= r["score"] <= 1 for r in got)
    right = [r["lang_pred"] == ("xx" if r["odd"] else "yy") for r in got if r["odd"] < 9]
    assert sum(right) >= 0.97 * len(right)
    assert all(r["lang_pred"] == "und" and r["rejected"] and r["score"] == 0 for r in got if r["odd"] == 9)
    nothing = lang_id.identify(train, lang_id.fit(train.limit(0)))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}
    assert lang_id.identify(train.limit(0), model).count() == 0


def test_held_out_language(spark):
    from tests.conftest import SF
    from tideline.llm.queries import op9

    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    got = [r for r in op9(spark, SF).collect() if r["held_out"] and truth[r["doc_id"]]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in got) >= 0.95 * len(got)


# language model


def test_language_model(spark):
    rng = random.Random(8)
    known = [" ".join(f"{a} {b} {c}" for a, b, c in ((rng.choice("xyz") + "1", rng.choice("uvw") + "2", "end") for _ in range(40))) for _ in range(40)]
    data = list(enumerate([*known, None, "", "  "])) + [(5, known[5])]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("n_words", F.lit("clash")).withColumn("bucket", F.lit(1))
    counts = masked_lm.bucket_counts(docs)
    assert counts.sum() == sum(len((t or "").split()) for _, t in data)
    model = masked_lm.train(docs)
    got = masked_lm.score(docs, model).collect()
    assert len(got) == len(data)
    assert all(r["n_words"] == len((r["text"] or "").split()) for r in got)
    assert all((r["mean_log_likelihood"] is None) == (r["n_words"] == 0) and (r["n_words"] or r["log_likelihood"] == 0) for r in got)
    mixed = [" ".join(rng.sample(t.split(), len(t.split()))) for t in known]
    other = masked_lm.score(spark.createDataFrame(enumerate(mixed), "doc_id long, text string"), model).collect()
    mean = lambda rs: sum(r["log_likelihood"] for r in rs if r["n_words"]) / sum(r["n_words"] for r in rs)
    assert mean(got) > mean(other)
    assert masked_lm.score(empty(spark), masked_lm.train(empty(spark))).count() == 0


def test_network_gradient_lowers_loss():
    rng = np.random.default_rng(0)
    around = rng.integers(0, masked_lm.CLASSES, (512, 4)) + np.arange(4) * (masked_lm.CLASSES + 1)
    target = around[:, 1] - (masked_lm.CLASSES + 1)
    net, squares = masked_lm.Network(rng.normal(0, 0.1, masked_lm.Network.size()).astype(np.float32)), np.zeros(masked_lm.Network.size(), np.float32)
    loss = lambda: -net.log_probs(around)[1][np.arange(512), target].mean()
    before = loss()
    for _ in range(200):
        net.learn(around, target, squares, 0.15)
    assert loss() < 0.3 * before


def test_prints_do_not_depend_on_the_block():
    from tideline.llm.anchors import Prints

    one, two = (Prints(np.frombuffer(x, np.uint8)) for x in (b"some text to find", b"xx text to f and more of it, longer than before"))
    at = lambda p, a, b: p.of(np.array([a]), np.array([b]))[0]
    assert at(one, 4, 14) == at(two, 2, 12) != at(two, 3, 13)


def test_search_for_fewer_sequences_goes_beyond_the_first_solution():
    """With the query's own parameters the search saves sequences that five children in two epochs do not find."""
    first = found = 0
    for seed in range(60):
        sizes = np.random.default_rng(seed).integers(200, 500, 200).astype(np.int64)
        rng = random.Random(7)
        island = [packing.first_solution(sizes, 1024, noise, rng) for noise in [0.0, *[0.05 * rng.random() for _ in range(packing.POPULATION - 1)]]]
        first += -packing.fitness(island[0], sizes, 1024)[0]
        for _ in range(packing.EPOCHS):
            island = packing.evolve(island, sizes, 1024, packing.CHILDREN, rng)
        fill = np.bincount(island[0], weights=sizes)
        assert fill.max() <= 1024 and fill.sum() == sizes.sum()
        found += len(fill)
    assert found <= first - 6
