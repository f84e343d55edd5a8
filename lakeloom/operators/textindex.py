"""Stored text search: n-gram postings with block maxima, and the join of many keywords with many names by similarity.

Ids of a block are those whose hash falls on it, so blocks have no order in common with what is searched. A posting row holds a gram's ids and
counts within one block, and the greatest of those counts. A search first reads the maxima alone (a narrow projection) and gives each block
its bound. It scores the FIRST blocks by bound, then GROWTH times as many, and so on, as long as there are blocks whose bound reaches the
last of the best so far: the result is that of scoring everything (search.full_text, a keyword at a time).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.functions.columns import characters, grams, similarity
from lakeloom.sources.tables import Generations, counted, spread, stored

FIRST, GROWTH = 2, 4
SLACK = 1e-6  # scores are told apart to six places


class GramIndex:
    """Generations of `texts` (id, block, hash) and `postings` (gram, block, best, n, ids, counts), both in buckets by block. sync() makes anew only
    the blocks of texts that came, changed or went."""

    def __init__(self, spark: SparkSession, root: str, n: int = 2, blocks: int = 64):
        self.store, self.n, self.blocks = Generations(spark, root), n, blocks

    def sync(self, documents: DataFrame) -> dict[str, int]:
        """documents(id, text), ids distinct and not null → texts held, blocks made anew."""
        now = documents.select("id", F.pmod(F.xxhash64("id"), F.lit(self.blocks)).cast("int").alias("block"), F.coalesce("text", F.lit("")).alias("text"))
        texts = now.select("id", "block", F.sha2("text", 256).alias("hash"))
        held = self.store.current("texts")
        if held is None:
            shadows: dict = {"texts": self.store.write_buckets("texts", texts, "block"), "postings": self.store.write_buckets("postings", self._postings(now), "block")}
            changed = texts.select("block").distinct().count()
        else:
            differ = texts.join(held, ["id", "block", "hash"], "left_anti").select("block").union(held.join(texts, ["id", "block", "hash"], "left_anti").select("block"))
            blocks = stored(differ.distinct(), "blocks")  # at most self.blocks rows
            changed = blocks.count()
            own = lambda df: df.join(F.broadcast(blocks), "block", "left_semi")
            rest = lambda df: df.join(F.broadcast(blocks), "block", "left_anti")
            shadows = {
                "texts": self.store.patch_buckets("texts", blocks, lambda old: rest(old).unionByName(own(texts))),
                "postings": self.store.patch_buckets("postings", blocks, lambda old: rest(old).unionByName(self._postings(own(now)))),
            }
        self.store.swap(shadows)
        return {"texts": self.store.current("texts").count(), "blocks": changed}

    def _postings(self, texts: DataFrame) -> DataFrame:
        each = texts.select("id", "block", F.explode(grams(F.lower("text"), self.n)).alias("gram")).groupBy("id", "block", "gram").agg(F.count("*").cast("int").alias("tf"))
        rows = each.groupBy("gram", "block").agg(F.max("tf").alias("best"), F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("id", "tf"))).alias("held"))
        return rows.select("gram", "block", "best", "n", "held.id", "held.tf").withColumnsRenamed({"id": "ids", "tf": "counts"})

    def search(self, keywords: DataFrame, most: int = 10) -> DataFrame:
        """keywords(kid, keyword) → kid, id, score, rank: the `most` best of each keyword by full_text's score."""
        return self._searched(keywords, most)[0]

    def _searched(self, keywords: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
        postings, n = self.store.current("postings"), self.store.current("texts").count()
        wanted = stored(keywords.select("kid", F.explode(F.array_distinct(grams(F.lower("keyword"), self.n))).alias("gram")).distinct(), "wanted")
        heads = stored(postings.select("gram", "block", "best", "n").join(wanted.select("gram").distinct(), "gram", "left_semi"), "heads")
        weight = F.pow(F.log10(F.lit(n) / F.sum("n")), 2)
        weights = heads.groupBy("gram").agg(weight.alias("weight"))
        asked = stored(wanted.join(weights, "gram").filter("weight > 0"), "asked")
        bounds = heads.join(asked, "gram").groupBy("kid", "block").agg(F.sum(F.col("best") * F.col("weight")).alias("bound"))
        order = Window.partitionBy("kid").orderBy(F.desc("bound"), "block")
        bounds = stored(bounds.withColumn("place", F.row_number().over(order)), "bounds")
        ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("kid").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= most)
        chosen, found, read, upto = bounds.filter(F.col("place") <= FIRST), None, None, FIRST
        while True:
            scored = stored(self._scored(postings, asked, chosen, heads), "scored")
            found = ranked(scored if found is None else found.unionByName(scored)).drop("rank")
            read = chosen.select("kid", "block") if read is None else read.union(chosen.select("kid", "block"))
            found = stored(found, "found")
            last = ranked(found).filter(F.col("rank") == most).select("kid", F.col("score").alias("floor"))
            left = bounds.filter(F.col("place") > upto).join(last, "kid", "left").filter(F.col("bound") >= F.coalesce("floor", F.lit(0.0)) - SLACK)
            left, n, _ = counted(left.select("kid", "block", "place"), "left")
            if not n:
                break
            upto *= GROWTH
            chosen = left.filter(F.col("place") <= upto)
        return ranked(found).select("kid", "id", "score", "rank"), bounds.select("kid", "block").join(read.withColumn("read", F.lit(True)), ["kid", "block"], "left").na.fill(False, ["read"])

    @staticmethod
    def _scored(postings: DataFrame, asked: DataFrame, chosen: DataFrame, heads: DataFrame) -> DataFrame:
        """(kid, id, score) of the texts of chosen(kid, block). Lists of ids move, not their entries: a text lies in one block, so it is summed where the
        lists of its keyword and block are."""
        wanted = asked.join(chosen.select("kid", "block"), "kid")
        rows = heads.join(wanted, ["gram", "block"]).agg(F.sum("n")).first()[0] or 0
        read = postings.select("gram", "block", "ids", "counts").join(wanted, ["gram", "block"])
        read = spread(read.select("kid", "block", "weight", F.arrays_zip("ids", "counts").alias("held")), rows, "kid", "block")
        each = read.select("kid", "block", "weight", F.explode("held").alias("x")).select("kid", "block", F.col("x.ids").alias("id"), (F.col("x.counts") * F.col("weight")).alias("part"))
        return each.groupBy("kid", "block", "id").agg(F.round(F.sum("part"), 6).alias("score")).filter("score > 0").select("kid", "id", "score")


# --- similarity join -----------------------------------------------------------------------------------------------------

WORD = 62  # characters whose row of the LCS fits one long


def char_masks(text: Column) -> Column:
    """character → the places where a text of at most WORD characters has it, as bits."""
    chars = characters(text)
    places = lambda c: F.aggregate(F.transform(chars, lambda x, i: F.when(x == c, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, v: s.bitwiseOR(v))
    distinct = F.array_distinct(chars)
    return F.map_from_arrays(distinct, F.transform(distinct, places))


def lcs_by_bits(masks: Column, size: Column, other: Column) -> Column:
    """Length of the longest common subsequence of a text (its char_masks and size) and another: a row of the table is a long, whose zeros
    are the steps; each character of the other costs an addition and three bit operations."""
    whole = F.call_function("shiftleft", F.lit(1).cast("long"), size) - 1
    mask = lambda c: F.coalesce(F.try_element_at(masks, c), F.lit(0).cast("long"))
    step = lambda v, c: (v + v.bitwiseAND(mask(c))).bitwiseOR(v.bitwiseAND(F.bitwise_not(mask(c)))).bitwiseAND(whole)
    return size - F.bit_count(F.aggregate(characters(other), whole, step))


def _least_common(total: Column, least: float) -> Column:
    """The least LCS of two texts of `total` characters together whose similarity reaches least."""
    return F.ceil(total * (least / 200) - 1e-9).cast("int")


def _prefixes(texts: DataFrame, counts: DataFrame, least: float, q: int) -> DataFrame:
    """text, size and the rarest of its q-grams, so many that texts similar enough share one of them. A pair of total length s has at least
    3 * LCS - s - 1 bigrams in common: each unmatched character breaks two of its own text and one of the other (characters: LCS in common).
    Repeated grams are numbered, and count by number."""
    sized = texts.select("text", F.char_length("text").alias("size"))
    shortest = F.ceil(F.col("size") * (least / (200 - least)) - 1e-9).cast("int")
    total = F.col("size") + shortest
    common = 3 * _least_common(total, least) - total - 1 if q == 2 else _least_common(total, least)
    each = sized.select("text", "size", F.greatest(common, F.lit(1)).alias("common"), F.explode(grams(F.col("text"), q)).alias("gram"))
    each = each.groupBy("text", "size", "common", "gram").agg(F.count("*").alias("k")).select("text", "size", "common", F.explode(F.transform(F.sequence(F.lit(1), F.col("k")), lambda i: F.concat_ws("#", "gram", i.cast("string")))).alias("token"))
    ordered = each.join(counts, "token", "left").groupBy("text", "size").agg(F.max("common").alias("common"), F.array_sort(F.collect_list(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "token"))).alias("tokens"))
    return ordered.select("text", "size", F.explode(F.slice("tokens", 1, F.greatest(F.size("tokens") - F.col("common") + 1, F.lit(0)))).alias("t")).select("text", "size", "t.token")


def candidates(keywords: DataFrame, names: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of distinct texts of keywords(text) and names(text) that may be similar: they share a rare gram and their lengths allow it.
    Bigrams where the threshold leaves some in common at every length, single characters below that."""
    q = 2 if all(3 * -(-s * least // 200) - s - 1 >= 1 for s in range(4, 400)) else 1
    grams_of = names.select(F.explode(grams(F.col("text"), q)).alias("gram"), "text").groupBy("text", "gram").agg(F.count("*").alias("k"))
    counts = grams_of.select(F.explode(F.transform(F.sequence(F.lit(1), F.col("k")), lambda i: F.concat_ws("#", "gram", i.cast("string")))).alias("token")).groupBy("token").agg(F.count("*").alias("held"))
    counts = stored(counts, "gram-counts")
    a = _prefixes(keywords, counts, least, q).withColumnsRenamed({"text": "a", "size": "size_a"})
    b = _prefixes(names, counts, least, q).withColumnsRenamed({"text": "b", "size": "size_b"})
    fits = 200 * F.least("size_a", "size_b") >= least * (F.col("size_a") + F.col("size_b"))
    shared = a.join(b, "token").filter(fits).select("a", "b").distinct()
    equal = keywords.select(F.col("text").alias("a")).join(names.select(F.col("text").alias("b")), F.col("a") == F.col("b"))  # texts too short for grams too
    return shared.union(equal).distinct()


def fuzzy_join(keywords: DataFrame, names: DataFrame, least: float = 85.0) -> DataFrame:
    """keywords(kid, keyword), names(id, names: array) → kid, id, confidence: every pair whose best indel ratio reaches `least` (more than 0), as
    search.fuzzy finds them for one keyword. Nulls are left out."""
    if not 0 < least <= 100:
        raise ValueError("least is a percentage above 0")
    flat = stored(names.select("id", F.explode("names").alias("text")).filter("text is not null").distinct(), "names")
    asked = keywords.select("kid", F.col("keyword").alias("text")).filter("text is not null").distinct()
    pairs = stored(candidates(asked.select("text").distinct(), flat.select("text").distinct(), least), "candidates")
    sizes = F.char_length("a")
    short = pairs.filter((sizes <= WORD)).withColumn("masks", char_masks(F.col("a")))
    both = sizes + F.char_length("b")
    ratio = F.when(both == 0, 100.0).otherwise(200.0 * lcs_by_bits(F.col("masks"), sizes, F.col("b")) / both)
    scored = short.select("a", "b", ratio.alias("score")).union(pairs.filter(sizes > WORD).select("a", "b", similarity(F.col("a"), F.col("b"))))
    good = stored(scored.filter(F.col("score") >= least), "good")
    met = good.join(asked.groupBy(F.col("text").alias("a")).agg(F.count("*").alias("of_a")), "a").join(flat.groupBy(F.col("text").alias("b")).agg(F.count("*").alias("of_b")), "b")
    n = met.agg(F.sum(F.col("of_a") * F.col("of_b"))).first()[0] or 0
    found = good.join(asked.withColumnRenamed("text", "a"), "a").join(flat.withColumnRenamed("text", "b"), "b")
    return spread(found.select("kid", "id", "score"), n, "kid", "id").groupBy("kid", "id").agg(F.round(F.max("score") / 100, 4).alias("confidence"))
