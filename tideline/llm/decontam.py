"""Benchmark decontamination by a broadcast set of word n-grams, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import broadcast_if_small, stored

N = 10
#: a word is a run of anything but these, after lower-casing A-Z
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MARK = -1  # hash value that every document has once, so that documents without hits stay


def words(text: Column) -> Column:
    """Normalised words of a text, none for null."""
    plain = F.octet_length(text) == F.char_length(text)
    low = F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), _GAP), "")


def _join(one: Column, two: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(one, two), 1)  # never negative, so never the mark


def _computed(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column that Spark computes once, rather than writing its expression into every lambda that uses it."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def _with_windows(rows: DataFrame, sizes: list[int], all_name: str) -> DataFrame:
    """Adds `all_name`: the mark and then, for each size in turn, a hash for every start in the word array `ws`.

    Hashes of 2, 4, 8 words come from those of half as many, other sizes from these, so a text of any length costs a few passes
    over an array. Where a window would end beyond the text its hash means nothing.
    """
    rows = _computed(rows, "w1", F.transform("ws", lambda w: F.shiftrightunsigned(F.xxhash64(w), 1)))
    made, width = {1}, 2

    def shifted(name: str, by: int) -> Column:
        return F.slice(name, by + 1, F.greatest(F.size(name) - by, F.lit(0)))

    while width <= max(sizes, default=1):
        rows = _computed(rows, f"w{width}", F.zip_with(f"w{width // 2}", shifted(f"w{width // 2}", width // 2), _join))
        made.add(width)
        width *= 2
    for size in sizes:
        done = 1 << (size.bit_length() - 1)
        while done < size:
            part = 1 << ((size - done).bit_length() - 1)
            if done + part not in made:
                rows = _computed(rows, f"w{done + part}", F.zip_with(f"w{done}", shifted(f"w{part}", done), _join))
                made.add(done + part)
            done += part
    return rows.withColumn(all_name, F.concat(F.array(F.lit(_MARK).cast("long")), *(F.col(f"w{s}") for s in sizes))).drop(*(f"w{m}" for m in made))


def windows(items: DataFrame, item_id: str, text: str, n: int, null_ids: bool = True) -> DataFrame:
    """gram (words), size, items: the distinct windows of n words of the items; an item of fewer is one window.

    Items without id have windows too, unless null_ids is false, and are named in no list.
    """
    rows = items if null_ids else items.where(F.col(item_id).isNotNull())
    rows = rows.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("ws")).where(F.size("ws") > 0)
    rows = rows.withColumn("size", F.least(F.lit(n), F.size("ws")))
    rows = rows.select("item", "size", F.explode(F.expr("transform(sequence(1, size(ws) - size + 1), i -> slice(ws, i, size))")).alias("gram"))
    rows = rows.groupBy("gram", "size").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return rows


def find_hits(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = N, null_ids: bool = True) -> DataFrame:
    """doc_id, text_hash, copies, n_words, hits (start, size in words), items: one row per distinct (doc_id, text).

    Every window of a text is hashed, hashes are looked up in the broadcast set of item windows, and a found window is compared
    word by word. The text is read once and only hits and one mark per document are shuffled. The set is broadcast when its
    counted size allows, else joined by a shuffle. Null and empty texts have no words; items without words have no windows; items without id give
    hits like any other, unless null_ids is false.
    """
    grams = stored(windows(items, item_id, item_text, n, null_ids), "grams")
    sizes = sorted(r[0] for r in grams.select("size").distinct().collect())  # at most n numbers
    own_hash = F.element_at("all", F.array_position(F.array(*map(F.lit, sizes or [0])), F.col("size")).cast("int") * F.col("size") - F.col("size") + 2)
    grams = _with_windows(grams.withColumn("ws", F.col("gram")), sizes, "all").select("gram", "size", "items", own_hash.alias("h"))
    held = grams.agg(F.coalesce(F.sum(F.length(F.array_join("gram", " ")) * 2 + F.size("items") * 32 + 200), F.lit(0))).first()[0]
    mark = docs.sparkSession.range(1).select(F.lit(None).cast("array<string>").alias("gram"), F.lit(0).alias("size"), F.lit(None).cast("array<string>").alias("items"), F.lit(_MARK).cast("long").alias("h"))
    known = broadcast_if_small(grams.select("gram", "size", "items", "h").union(mark), 0 if held <= 32_000_000 else 2**40)

    rows = _computed(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "ws", words(F.col("text")))
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "ws", F.size("ws").alias("n_words"))
    rows = _with_windows(rows, sizes, "all")
    rows = rows.select("doc_id", "text_hash", "n_words", "ws", F.posexplode_outer("all").alias("ix", "h")).join(known, "h")
    start = F.expr("(ix - 1) % greatest(n_words, 1)")
    own = F.element_at(F.array(*map(F.lit, sizes or [0])), (F.expr("(ix - 1) div greatest(n_words, 1)") + 1).cast("int"))
    exact = F.when(F.col("ix") == 0, F.col("gram").isNull()).otherwise((own == F.col("size")) & (F.slice("ws", start + 1, F.col("size")) == F.col("gram")))
    rows = rows.where(exact).select("doc_id", "text_hash", "n_words", F.when(F.col("ix") > 0, F.struct(start.alias("start"), F.col("size"))).alias("hit"), "items")
    return rows.groupBy("doc_id", "text_hash", "n_words").agg(
        F.count(F.when(F.col("hit").isNull(), 1)).alias("copies"),
        F.sort_array(F.collect_set("hit")).alias("hits"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )


def n_hit(hits: Column) -> Column:
    """Words inside any of the hits (ascending by start)."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def add(a: Column, x: Column) -> Column:
        end = x["start"] + x["size"]
        return F.struct((a["n"] + F.greatest(F.lit(0), end - F.greatest(a["end"], x["start"]))).cast("int").alias("n"), F.greatest(a["end"], end).cast("int").alias("end"))

    return F.aggregate(hits, zero, add)["n"].cast("long")


def report(docs: DataFrame, items: DataFrame, n: int = N) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs (doc_id, text); repeated rows stay.

    Null and empty texts have no words and no hits; a null doc_id stays null. An item without id counts for n_hit and contaminated,
    and is left out of n_items and items_sha256.
    """
    found = find_hits(docs, items, n=n).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return found.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit(F.col("hits")).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, remove: str = "documents", doc_id: str = "doc_id", text: str = "text", n: int = N, null_ids: bool = True) -> DataFrame:
    """docs without contaminated documents, or with the hit words (and what parts them from the next word) cut out of `text`.

    remove is `documents` or `spans`. All columns stay as they are, rows without hits untouched; a null text has no hits. A text
    that is all hits becomes what stands before its first word. Items without id count unless null_ids is false.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    bad = find_hits(docs, items, doc_id=doc_id, text=text, n=n, null_ids=null_ids).where(F.size("hits") > 0)
    bad = stored(bad.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("hits").alias("__hits")), "hits")
    size = bad.agg(F.coalesce(F.sum(F.size("__hits") * 16 + 64), F.lit(0))).first()[0]
    bad = broadcast_if_small(bad, 0 if size <= 32_000_000 else 2**40)
    same = docs[doc_id].eqNullSafe(F.col("__id")) & (F.xxhash64(docs[text]) == F.col("__hash"))
    if remove == "documents":
        return docs.join(bad, same, "left_anti")
    word = _GAP.replace("[", "[^", 1)
    parts = F.regexp_extract_all(text, F.lit(f"({word}{_GAP.replace('+', '*')})"), F.lit(0))
    kept = F.filter(parts, lambda w, i: ~F.exists("__hits", lambda x: (i >= x["start"]) & (i < x["start"] + x["size"])))
    lead = F.regexp_extract(text, f"^({_GAP})", 1)
    out = docs.join(bad, same, "left")
    return out.withColumn(text, F.when(F.col("__hits").isNotNull(), F.concat(lead, F.array_join(kept, ""))).otherwise(F.col(text))).drop("__id", "__hash", "__hits")
