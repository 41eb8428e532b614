"""Benchmark decontamination by a positional inverted index, with DataFrame functions only.

The index holds a row (term, document, position) for each training token whose
term a benchmark item has (all tokens, where the benchmark's terms are too many
to broadcast), dealt by document: lists of one document are in one task, and a
term that is everywhere loads no task more than others. Then, for each window
of an item:

1. the lists of its two rarest terms that occur at all are read and shifted by
   the terms' places in the item; where both name the same document and the same
   alignment, the window may occur there, or near there, if they are within SLOP
   places of it;
2. for these alignments only, the lists of the window's other terms are
   intersected in the same way; unbroken runs as long as a window are exact
   phrase matches;
3. a proximity match has NEAR_PERCENT or more of a window's terms within SLOP
   places of an alignment.

Defined results: null text has no words; rows without doc_id are judged by
their text; rows that repeat give repeated results; items of equal words all
count; an empty table on either side gives no hits; other columns are ignored.
doc_id is an integer; item_id may be of any type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import runtime

#: What isn't \x00-\x2F, \x3A-\x60 or \x7B-\x7F; Java matches this form much faster than the negated one.
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
WINDOW = 13
SLOP = 3
NEAR_PERCENT = 80
MIN_PERCENT = 5
#: Benchmark terms and anchors up to this many are broadcast.
SMALL = 500_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DOC = ["k1", "k2"]


def words(text: Column) -> Column:
    """The words of a text with A-Z, and no other letters, lower-cased."""
    text = F.coalesce(text, F.lit(""))
    folded = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.regexp_extract_all(folded, F.lit(WORD), F.lit(0))


def item_words(benchmark: DataFrame, folder: str) -> DataFrame:
    """item (its id as a string), q, word, n: a row for each place of each item."""
    rows = benchmark.select(F.coalesce(benchmark["item_id"].cast("string"), F.lit("")).alias("item"), words(benchmark["text"]).alias("w"))
    # items of one id count as one item but are matched one by one
    rows = rows.distinct().withColumn("n", F.size("w")).withColumn("text_no", F.xxhash64("w")).select("item", "text_no", "n", F.posexplode("w").alias("q", "word"))
    return runtime.written(rows, folder, "items")


def build_index(docs: DataFrame, terms: DataFrame | None, folder: str) -> DataFrame:
    """Writes and returns the index: k1, k2 (the document), doc_id, pos, word, term.

    terms: word, term (the only ones to be kept), or None: all, a term being the
    word's hash. One row for each document has a null word, its pos is the number of words.
    """
    key = F.xxhash64("text")
    rows = runtime.only(docs).select("doc_id", F.coalesce(F.col("doc_id").cast("long"), key).alias("k1"), key.alias("k2"), words(F.col("text")).alias("w"))
    rows = rows.select("doc_id", *DOC, F.posexplode(F.concat("w", F.array(F.lit(None).cast("string")))).alias("pos", "word"))
    if terms is None:
        rows = rows.withColumn("term", F.xxhash64("word"))
    else:
        rows = rows.join(F.broadcast(terms), "word", "left").where("term is not null or word is null")
    return runtime.written(rows.select("doc_id", *DOC, "pos", F.when(F.col("word").isNotNull(), F.col("term")).alias("term")), folder, "index")


def _near(both: DataFrame, windows: DataFrame, items: DataFrame, postings: DataFrame, slop: int, folder: str) -> DataFrame:
    """k1, k2, item of proximity matches: alignments at which NEAR_PERCENT of a window's terms are within slop places.

    Windows of one alignment share their terms: each term is looked up once, in the one or two stretches of 2 slop + 1
    places that hold the places near its own.
    """
    width, group = 2 * slop + 1, [*DOC, "item", "text_no", "delta"]
    at = both.join(runtime.if_small(windows.select("item", "text_no", "p1", "p2", "s", "len"), SMALL), ["item", "text_no", "p1", "p2"])
    at = runtime.written(at.groupBy(*group).agg(F.collect_set("s").alias("starts"), F.first("len").alias("len")), folder, "near-windows")
    terms = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + F.col("len") - 1))))
    wanted = at.select(*group, F.explode(terms).alias("q"))
    wanted = wanted.join(runtime.if_small(items.select("item", "text_no", "q", "term"), SMALL), ["item", "text_no", "q"]).withColumn("place", F.col("delta") + F.col("q"))
    stretch = lambda x: F.floor(x / width).cast("int")
    wanted = wanted.withColumn("stretch", F.explode(F.array_distinct(F.array(stretch(F.col("place") - slop), stretch(F.col("place") + slop)))))
    asked = runtime.written(at.select(*DOC).distinct(), folder, "near-asked")
    there = postings.join(runtime.if_small(asked), DOC, "left_semi").select(*DOC, "term", stretch(F.col("pos")).alias("stretch"), "pos").distinct()
    met = wanted.join(there, [*DOC, "term", "stretch"]).where(F.abs(F.col("pos") - F.col("place")) <= slop)
    met = met.groupBy(*group).agg(F.collect_set("q").alias("met")).join(at, group)
    enough = F.exists("starts", lambda s: 100 * F.size(F.filter("met", lambda q: (q >= s) & (q < s + F.col("len")))) >= NEAR_PERCENT * F.col("len"))
    return met.where(enough).select(*DOC, "item").distinct()


def _aligned(lists: DataFrame, slop: int) -> DataFrame:
    """k1, k2, item, text_no, p1, p2, delta, bits of alignments of the first anchor's list (side 1) that have a place of the second's
    (side 2) within slop; bits 7: exactly there.

    Alignments meet in stretches of 2 slop + 1. In a stretch's number the lowest bits say which of its alignments the
    first list has, the next which from slop before to slop after it the second has: a bitwise or adds lists up.
    """
    width = 2 * slop + 1
    if 2 * width + 2 * slop > 62:
        raise ValueError("slop is at most 9")
    key = [*DOC, "item", "text_no", "p1", "p2"]
    stretch = lambda x: F.floor(x / width)
    near = F.array_distinct(F.array(stretch(F.col("delta") - slop), stretch(F.col("delta") + slop)))
    lists = lists.withColumn("stretch", F.explode(F.when(F.col("side") == 1, F.array(stretch(F.col("delta")))).otherwise(near)))
    off = (F.col("delta") - F.col("stretch") * width).cast("int")
    bit = F.expr("shiftleft(1L, _off)")
    marked = lists.withColumn("_off", F.when(F.col("side") == 1, off).otherwise(off + slop + width)).select(*key, "stretch", bit.alias("bits"))
    met = marked.groupBy(*key, "stretch").agg(F.bit_or("bits").alias("bits")).where(f"bits & {(1 << width) - 1} <> 0 and bits >> {width} <> 0")
    each = met.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    each = each.where("shiftright(bits, k) & 1 = 1").where(f"shiftright(bits, k + {width}) & {(1 << width) - 1} <> 0")
    exact = F.expr(f"shiftright(bits, k + {width + slop}) & 1 = 1")
    return each.select(*key, (F.col("stretch") * width + F.col("k")).cast("int").alias("delta"), F.when(exact, 7).otherwise(3).alias("bits"))


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """doc_id, k1, k2, n_words, n_hit, items (sorted array of ids), near_items (of proximity matches), a row for each row of docs."""
    folder = runtime.work_folder(docs.sparkSession, "index")
    items = item_words(benchmark, folder)
    vocabulary = runtime.written(items.select("word").distinct().withColumn("term", F.xxhash64("word")), folder, "terms")
    terms = vocabulary if vocabulary.count() <= SMALL else None
    index = build_index(docs, terms, folder)
    postings = index.where("term is not null")
    counts = runtime.written(postings.groupBy("term").count(), folder, "counts")
    items = items.withColumn("term", F.xxhash64("word")).drop("word").withColumn("len", F.least(F.col("n"), F.lit(window)))
    # windows whose terms all occur somewhere (exact matches), or enough of them (proximity), with their two rarest places
    in_window = items.join(counts, "term").withColumn("s", F.explode(F.sequence(F.greatest(F.lit(0), F.col("q") - F.col("len") + 1), F.least(F.col("q"), F.col("n") - F.col("len")))))
    ranked = in_window.groupBy("item", "text_no", "len", "s").agg(F.sort_array(F.collect_list(F.struct("count", "q", "term"))).alias("r"))
    ranked = ranked.where(100 * F.size("r") >= NEAR_PERCENT * F.col("len")).withColumn("whole", F.size("r") == F.col("len"))
    windows = runtime.written(ranked.select("item", "text_no", "len", "s", "whole", F.col("r")[0]["q"].alias("p1"), F.col("r")[0]["term"].alias("t1"), F.coalesce(F.get("r", F.lit(1))["q"], F.col("r")[0]["q"]).alias("p2"), F.coalesce(F.get("r", F.lit(1))["term"], F.col("r")[0]["term"]).alias("t2")), folder, "windows")
    anchors = windows.select("item", "text_no", "p1", "p2", F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("t1").alias("term"), F.col("p1").alias("q")), F.struct(F.lit(2).alias("side"), F.col("t2").alias("term"), F.col("p2").alias("q")))).alias("a")).select("item", "text_no", "p1", "p2", "a.*").distinct()
    anchors = runtime.written(anchors, folder, "anchors")
    lists = postings.join(runtime.if_small(anchors, SMALL), "term").withColumn("delta", F.col("pos") - F.col("q"))
    both = _aligned(lists, slop)
    both = runtime.written(both, folder, "aligned")
    # the other terms of the windows that are aligned: what must be where
    aligned = both.where("bits = 7").join(runtime.if_small(windows.where("whole").select("item", "text_no", "p1", "p2", "s", "len"), SMALL), ["item", "text_no", "p1", "p2"])
    wanted = aligned.select(*DOC, "item", "text_no", "len", "delta", F.explode(F.sequence(F.col("s"), F.col("s") + F.col("len") - 1)).alias("q")).distinct()
    wanted = wanted.join(runtime.if_small(items.select("item", "text_no", "q", "term"), SMALL), ["item", "text_no", "q"]).withColumn("pos", F.col("delta") + F.col("q"))
    wanted = runtime.written(wanted, folder, "wanted")
    asked = runtime.written(wanted.select(*DOC).distinct(), folder, "asked")
    there = postings.join(runtime.if_small(asked), DOC, "left_semi").select(*DOC, "pos", "term").distinct()
    met = wanted.join(there, [*DOC, "pos", "term"])
    line = Window.partitionBy(*DOC, "item", "text_no", "delta").orderBy("q")
    runs = met.withColumn("run", F.col("q") - F.row_number().over(line)).groupBy(*DOC, "item", "text_no", "len", "delta", "run").agg(F.min("pos").alias("low"), F.max("pos").alias("high")).where("high - low + 1 >= len")
    runs = runtime.written(runs, folder, "runs")
    hit = runs.select(*DOC, F.explode(F.sequence("low", "high")).alias("pos")).distinct().groupBy(*DOC).agg(F.count(F.lit(1)).alias("n_hit"))
    found = runs.groupBy(*DOC).agg(F.sort_array(F.collect_set("item")).alias("items"))
    near = runtime.written(_near(both, windows, items, postings, slop, folder), folder, "near")
    near = near.groupBy(*DOC).agg(F.sort_array(F.collect_set("item")).alias("near_items"))
    every = index.where("term is null").select("doc_id", *DOC, F.col("pos").cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    out = every.join(hit, DOC, "left").join(found, DOC, "left").join(near, DOC, "left")
    out = out.select("doc_id", *DOC, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items"))
    return runtime.settled(out, folder, "matches")


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= MIN_PERCENT * F.col("n_words"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that aren't contaminated, with the columns of docs."""
    id_, key = runtime.fresh("contaminated_id", docs), runtime.fresh("contaminated_key", docs)
    bad = matches(docs, benchmark).where(contaminated()).select(F.col("k1").alias(id_), F.col("k2").alias(key)).distinct()
    bad = runtime.written(bad, runtime.work_folder(docs.sparkSession, "contaminated"), "rows")
    hashed = F.xxhash64(docs["text"])
    return docs.join(runtime.if_small(bad), (F.coalesce(docs["doc_id"].cast("long"), hashed) == bad[id_]) & (hashed == bad[key]), "left_anti")
