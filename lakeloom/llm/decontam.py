"""Benchmark decontamination with a positional inverted index, in DataFrame functions only.

1. Words of the benchmark are counted over all documents. Of every window of an item the two rarest words are its anchors;
   a window with a word that no document holds cannot occur and has none.
2. The index holds the postings (word, document, position) of the anchors' words.
3. Postings meet the anchors by word; each hit stands for the place in the document where the item would start. Two
   anchors of one item at the same place make a candidate: the intersection of the offset-adjusted lists from the rarest
   terms. Anchors whose places differ by at most `slop` are a proximity match.
4. At each candidate place the item's words are joined with the document's by position; runs of a window's length or more
   are occurrences, and the union of a document's runs is what is hit.

Documents are named by 128 bits of their text, so copies are looked into once, and no step holds a document's hits in one row: only
the ids of the items found are listed. The words of the benchmark, and the candidates, are broadcast only after they have been
counted (up to MOST_TERMS), else joined by shuffle; texts are never shuffled but those of candidates.
Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. A null text has no words. Items without words match
nothing; items shorter than a window are one window. Repeated rows of either table are allowed: each document row is
judged by its own text, items count by item_id (a null item_id counts once and is not listed). Empty tables are allowed; other
columns are not read.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm._common import dropped, stored

WINDOW, SLOP = 10, 5
MOST_TERMS = 500_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    lower = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(lower, _BETWEEN), "")


def _held(df: DataFrame) -> DataFrame:
    """Broadcast if it is small enough by count, else as it is."""
    return F.broadcast(df) if df.count() <= MOST_TERMS else df


def items_of(benchmark: DataFrame, window: int) -> DataFrame:
    """item_id, item (a key of the row's text), words, n, span (words in a window)."""
    own = benchmark.select("item_id", F.xxhash64("item_id", "text").alias("item"), words(F.col("text")).alias("words")).withColumn("n", F.size("words"))
    return own.filter("n > 0").withColumn("span", F.least("n", F.lit(window))).dropDuplicates(["item"])


def anchors_of(items: DataFrame, docs: DataFrame, scratch: list[str] | None = None) -> DataFrame:
    """item, word, at: the two rarest words of every window, as positions in the item."""
    placed = items.select("item", "n", "span", F.posexplode("words").alias("at", "word"))
    terms = stored(placed.select("word").distinct(), "terms", scratch)
    counts = stored(docs.select(F.explode(words(F.col("text"))).alias("word")).join(_held(terms), "word").groupBy("word").count(), "term-counts", scratch)
    counted = placed.join(counts, "word", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    first, last = F.greatest(F.lit(0), F.col("at") - F.col("span") + 1), F.least("at", F.col("n") - F.col("span"))
    of_window = counted.select("item", F.explode(F.sequence(first, last)).alias("start"), F.struct("count", "at", "word").alias("term"))
    rarest = of_window.groupBy("item", "start").agg(F.slice(F.array_sort(F.collect_list("term")), 1, 2).alias("terms"))
    return rarest.filter(F.col("terms")[0]["count"] > 0).select("item", F.explode("terms").alias("term")).select("item", "term.word", "term.at").distinct()


KEY = ["h1", "h2"]


def keyed(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) → doc_id, text (null: empty), h1, h2: 128 bits that name the text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))


def postings_of(docs: DataFrame, anchors: DataFrame) -> DataFrame:
    """word, h1, h2, at: where the anchors' words stand in the documents."""
    terms = anchors.select("word").distinct()
    return keyed(docs).select(*KEY, F.posexplode(words(F.col("text"))).alias("at", "word")).join(_held(terms), "word").select("word", *KEY, "at").distinct()


def places(postings: DataFrame, anchors: DataFrame, items: DataFrame, slop: int) -> DataFrame:
    """h1, h2, item, place (where the item would start), least and most (of the anchors that say so), near (whether anchors there or at
    the place before make a proximity match)."""
    group = [*KEY, "item"]
    hits = postings.join(anchors.withColumnRenamed("at", "item_at"), "word").select(*group, (F.col("at") - F.col("item_at")).alias("place"), "item_at")
    each = hits.repartition(*group).groupBy(*group, "place").agg(F.min("item_at").alias("least"), F.max("item_at").alias("most"))
    line = Window.partitionBy(*group).orderBy("place")
    before = lambda c: F.lag(c).over(line)
    apart = (F.col("place") - before("place") <= slop) & ((F.col("least") != before("least")) | (F.col("most") != before("most")))
    near = each.withColumn("near", (F.col("least") < F.col("most")) | F.coalesce(apart, F.lit(False)))
    own = items.select("item", "n")
    return near.join(own, "item").select(*group, "place", "least", "most", (F.col("near") | (F.col("n") == 1)).alias("near"), ((F.col("least") < F.col("most")) | (F.col("n") == 1)).alias("exact")).filter("near")


def occurrences(docs: DataFrame, candidates: DataFrame, items: DataFrame) -> DataFrame:
    """candidates(h1, h2, item, place) → h1, h2, item, start, stop: runs of the item's words that hold a window, by position in the document."""
    wanted = candidates.select(*KEY).distinct()
    texts = keyed(docs).join(_held(wanted), KEY, "left_semi").select(*KEY, "text").dropDuplicates(KEY)
    own = texts.select(*KEY, F.posexplode(words(F.col("text"))).alias("at", "word"))
    of_item = items.select("item", "span", F.posexplode("words").alias("i", "word"))
    asked = candidates.join(_held(of_item), "item").select(*KEY, "item", "place", "span", "i", "word", (F.col("place") + F.col("i")).alias("at"))
    same = asked.join(own, [*KEY, "at", "word"]).select(*KEY, "item", "place", "span", "i")
    line = Window.partitionBy(*KEY, "item", "place").orderBy("i")
    runs = same.withColumn("run", F.col("i") - F.row_number().over(line)).groupBy(*KEY, "item", "place", "span", "run").agg(F.min("i").alias("first"), F.count("*").alias("n"))
    start = F.col("place") + F.col("first")
    return runs.filter("n >= span").select(*KEY, "item", start.cast("long").alias("start"), (start + F.col("n")).alias("stop"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """docs(doc_id, text) and benchmark(item_id, text) → doc_id, n_words, n_hit (words inside an occurrence of a window), n_items,
    item_ids (of items with occurring windows, sorted as strings), n_near (items with a proximity match), contaminated."""
    scratch: list[str] = []  # what only the search reads
    held = functools.partial(stored, scratch=scratch)
    items = held(items_of(benchmark, window), "items")
    anchors = held(anchors_of(items, docs, scratch), "anchors")
    postings = held(postings_of(docs, anchors), "postings")
    found = held(places(postings, anchors, items, slop), "places")
    runs = held(occurrences(docs, found.filter("exact").select(*KEY, "item", "place"), items), "occurrences")
    ids = items.select("item", "item_id")
    listed = runs.select(*KEY, "item").distinct().join(ids, "item").groupBy(*KEY).agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    line = Window.partitionBy(*KEY).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce(F.max("stop").over(line), F.lit(0))))
    hit = runs.withColumn("fresh", fresh).groupBy(*KEY).agg(F.sum("fresh").alias("n_hit"))
    near = found.select(*KEY, "item").distinct().join(ids, "item").groupBy(*KEY).agg(F.countDistinct("item_id").alias("n_near"))
    whole = stored(near.join(hit, KEY, "left").join(listed, KEY, "left"), "contaminated")
    dropped(docs.sparkSession, scratch)
    own = keyed(docs).select("doc_id", *KEY, F.size(words(F.col("text"))).cast("long").alias("n_words")).join(whole, KEY, "left")
    none = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    item_ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return own.select("doc_id", "n_words", none("n_hit").alias("n_hit"), F.size(item_ids).cast("long").alias("n_items"), item_ids.alias("item_ids"), none("n_near").alias("n_near"), (none("n_hit") > 0).alias("contaminated"))


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated")
