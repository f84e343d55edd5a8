"""Term search in three stages — exact, n-gram and fuzzy, vectors — and hashed embeddings."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.functions.columns import admission, cosine, grams, hashed_grams, similarity
from lakeloom.operators.diff import hash_diff
from lakeloom.operators.graph import families
from lakeloom.sources.tables import Generations, stored

DIMENSIONS, MOST_QUERIES = 256, 1000
CASELESS = "UNICODE_CI_AI"


def exact(glossary: DataFrame, tables: DataFrame, columns: DataFrame, keyword: str, most: int = 50) -> DataFrame:
    """Active terms equal to the keyword (case and accents aside) or with it as an alias; tables by name; columns by name (at most
    `most`, by full name): kind, candidate, node, confidence."""
    word = F.collate(F.lit(keyword), CASELESS)
    same = lambda c: F.collate(F.col(c), CASELESS) == word
    one = F.lit(1.0).alias("confidence")
    terms = glossary.filter("status = 'active'").filter(same("term") | F.array_contains("aliases", keyword)).select(F.lit("term").alias("kind"), F.col("term").alias("candidate"), F.col("ref_table").alias("node"), one)
    online = tables.filter("is_online and coalesce(layer, '') <> 'tmp'")
    named = online.filter(same("table_name") | same("full_name")).select(F.lit("table").alias("kind"), F.col("full_name").alias("candidate"), F.col("full_name").alias("node"), one)
    own = columns.join(online.select("full_name"), "full_name", "left_semi").filter(same("column_name")).orderBy("full_name").limit(most)
    return terms.unionByName(named).unionByName(own.select(F.lit("column").alias("kind"), F.concat_ws(".", "full_name", "column_name").alias("candidate"), F.col("full_name").alias("node"), one))


def full_text(documents: DataFrame, keyword: str, n: int = 2, most: int = 10) -> DataFrame:
    """documents(id, text) by the sum over the keyword's n-grams of tf * idf ** 2, idf = log10(documents / documents with the gram):
    id, score (above 0: a gram that all documents have finds none), confidence (at most 0.99). For many keywords see textindex.GramIndex."""
    spark = documents.sparkSession
    wanted = spark.range(1).select(F.explode(F.array_distinct(grams(F.lower(F.lit(keyword)), n))).alias("gram"))
    held = documents.select("id", F.explode(grams(F.lower("text"), n)).alias("gram")).join(F.broadcast(wanted), "gram").groupBy("id", "gram").agg(F.count("*").alias("tf"))
    df = held.groupBy("gram").agg(F.count("*").alias("df")).crossJoin(F.broadcast(documents.agg(F.count("*").alias("n"))))
    scored = held.join(F.broadcast(df), "gram").groupBy("id").agg(F.sum(F.col("tf") * F.pow(F.log10(F.col("n") / F.col("df")), 2)).alias("score"))
    return scored.withColumn("score", F.round("score", 6)).filter("score > 0").orderBy(F.desc("score"), "id").limit(most).withColumn("confidence", F.least("score", F.lit(0.99)))


def fuzzy(terms: DataFrame, keyword: str, least: float = 85.0) -> DataFrame:
    """terms(id, names: term and aliases) whose best indel ratio with the keyword reaches `least`: id, confidence."""
    best = F.array_max(F.transform("names", lambda x: similarity(x, F.lit(keyword))))
    return terms.select("id", best.alias("best")).filter(F.col("best") >= least).select("id", F.round(F.col("best") / 100, 4).alias("confidence"))


def nearest(vectors: DataFrame, query: DataFrame, k: int = 5, least: float | None = None) -> DataFrame:
    """vectors(id, embedding), query(query_id, embedding) of MOST_QUERIES rows at most → for each query the k nearest by cosine: rank, confidence. A
    scan of all vectors; vectorcells.VectorCells leaves cells out and takes any number of queries."""
    if query.limit(MOST_QUERIES + 1).count() > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries: use VectorCells")
    near = vectors.join(F.broadcast(query.withColumnRenamed("embedding", "q"))).select("query_id", "id", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("confidence"))
    order = Window.partitionBy("query_id").orderBy(F.desc("confidence"), "id")
    ranked = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked if least is None else ranked.filter(F.col("confidence") >= least)


def _entries(texts: DataFrame) -> DataFrame:
    """id, entries (dim, value) of each text, made row by row without state: texts alone are shuffled, dealt to the cores by id. Texts of one id count as one."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = texts.select("id", F.coalesce("text", F.lit("")).alias("text")).repartition(parts, "id").groupBy("id").agg(F.collect_list("text").alias("held"))
    each = own.select("id", F.flatten(F.transform("held", hashed_grams)).alias("grams"))
    return each.mapInArrow(_summed, f"id {dict(texts.dtypes)['id']}, entries array<struct<dim:int,value:double>>")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams of texts → their entries. Dimension and sign of a gram as columns.bucket_of gives them, once for each distinct gram of a batch."""
    for batch in batches:
        n, grams_of = batch.num_rows, batch.column("grams")
        flat = grams_of.flatten().dictionary_encode()
        digests = [hashlib.md5(g.encode()).digest() for g in flat.dictionary.to_pylist()]
        dims, signs = np.array([d[7] for d in digests], np.int64), np.array([1 - 2 * (d[6] % 2) for d in digests], np.int64)
        code = flat.indices.to_numpy()
        row = np.repeat(np.arange(n), grams_of.value_lengths().to_numpy())
        sums = np.bincount(row * DIMENSIONS + dims[code], weights=signs[code], minlength=n * DIMENSIONS).reshape(n, DIMENSIONS)
        norm = np.sqrt((sums * sums).sum(1))
        sums[norm == 0, 0], norm[norm == 0] = 1, 1
        at, dim = np.nonzero(sums)
        entries = pa.StructArray.from_arrays([pa.array(dim, pa.int32()), pa.array(sums[at, dim] / norm[at], pa.float64())], ["dim", "value"])
        offsets = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=n))]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(offsets), entries)], ["id", "entries"])


def hash_parts(texts: DataFrame) -> DataFrame:
    """texts(id, text) → id, dim, value: the non-zero entries of the normalised hashed n-gram embedding. A text without n-grams is
    the first unit vector."""
    return _entries(texts).select("id", F.inline("entries"))


def hash_embedding(texts: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """texts(id, text) → id, embedding (array of doubles)."""
    entries = _entries(texts).select("id", F.map_from_entries("entries").alias("m"))
    return entries.select("id", F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda d: F.coalesce(F.try_element_at("m", d), F.lit(0.0))).alias("embedding"))


def aliases_of(text: Column) -> Column:
    """Aliases kept as a JSON list; none for null or what is not a list."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def embedded(texts: DataFrame, embed: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """texts(id, text) → id, embedding: by `embed`, a function from a list of texts to a list of vectors that workers can import (it gets
    batches), or by hashed n-grams without one."""
    if embed is None:
        return hash_embedding(texts)
    def run(batches):
        for batch in batches:
            vectors = embed(batch.column(1).fill_null("").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[float(x) for x in v] for v in vectors], pa.list_(pa.float64()))], ["id", "embedding"])

    kind = dict(texts.dtypes)["id"]
    return texts.select("id", "text").mapInArrow(run, f"id {kind}, embedding array<double>")


class Collection:
    """A stored vector collection: id, text, content_hash, embedding, kept as generations. Only texts whose hash changed are embedded
    again; ids that are no longer wanted go."""

    def __init__(self, spark: SparkSession, root: str):
        self.store = Generations(spark, root)

    def get(self) -> DataFrame | None:
        return self.store.current("vectors")

    def sync(self, wanted: DataFrame, embed: Callable[[list[str]], list[list[float]]] | None = None) -> dict[str, int]:
        """wanted(id, text, content_hash), ids distinct → how many were upserted, deleted and unchanged."""
        held = self.get()
        if held is None:
            action = wanted.select("id", F.lit("upsert").alias("action"))
        else:
            action = hash_diff(wanted, held)
        action = stored(action, "vector-diff")
        fresh = wanted.join(action.filter("action = 'upsert'"), "id", "left_semi")
        new = fresh.join(embedded(fresh, embed), "id").select("id", "text", "content_hash", "embedding")
        if held is not None:
            new = new.unionByName(held.join(action.filter("action = 'unchanged'"), "id", "left_semi"))
        self.store.swap({"vectors": self.store.write_shadow("vectors", new)})
        counts = {r.action: r["count"] for r in action.groupBy("action").count().collect()}
        return {k: counts.get(k, 0) for k in ("upsert", "delete", "unchanged")}

    def query(self, text: str, k: int = 5, least: float | None = 0.6, embed: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
        """The nearest ids; nothing from a collection that was never synced."""
        held, spark = self.get(), self.store.spark
        if held is None:
            return spark.createDataFrame([], "query_id long, id string, confidence double, rank int")
        asked = embedded(spark.createDataFrame([(0, text)], "id long, text string"), embed).withColumnRenamed("id", "query_id")
        return nearest(held.select("id", "embedding"), asked, k, least)


def vector_texts(glossary: DataFrame, columns: DataFrame, tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, text, content_hash) of terms and of admitted columns, and the counts of columns left out by reason."""
    terms = glossary.filter("status = 'active'").select(F.concat(F.lit("term:"), "term").alias("id"), F.concat_ws(" ", "term", "caliber").alias("text")).withColumn("content_hash", F.sha1("text"))
    online = tables.filter("is_online and coalesce(layer, '') <> 'tmp'").select("full_name", F.col("comment").alias("table_comment"), "layer", "domain")
    joined = columns.join(online, "full_name").withColumn("reason", admission(F.col("column_name"), F.col("comment")))
    key = F.concat_ws(".", "full_name", "column_name")
    own = joined.filter("reason is null").select(F.concat(F.lit("column:"), key).alias("id"), F.concat_ws(" ", "comment", "table_comment", "layer", "domain").alias("text"), F.sha1(F.concat_ws("|", "full_name", "column_name", "comment")).alias("content_hash"))
    return terms.unionByName(own), joined.filter("reason is not null").groupBy("reason").count()


def search(glossary: DataFrame, tables: DataFrame, columns: DataFrame, closed: DataFrame, keyword: str, domain: str | None = None, vectors: DataFrame | Collection | None = None) -> DataFrame:
    """The first stage that finds anything, its candidates merged into families (see graph.families). vectors: (id, embedding), or a stored
    collection, for the last stage."""
    found = exact(glossary, tables, columns, keyword)
    if found.isEmpty():
        online = tables.filter("is_online and coalesce(layer, '') <> 'tmp'")
        texts = online.select(F.col("full_name").alias("id"), F.concat_ws(" ", "table_name", "comment").alias("text"))
        names = glossary.filter("status = 'active'").select(F.struct("term", "ref_table").alias("id"), F.concat(F.array("term"), F.coalesce("aliases", F.array().cast("array<string>"))).alias("names"))
        by_text = full_text(texts, keyword).select(F.lit("table").alias("kind"), F.col("id").alias("candidate"), F.col("id").alias("node"), "confidence")
        found = by_text.unionByName(fuzzy(names, keyword).select(F.lit("term").alias("kind"), F.col("id.term").alias("candidate"), F.col("id.ref_table").alias("node"), "confidence"))
        if vectors is not None and found.isEmpty():
            if isinstance(vectors, Collection):
                near = vectors.query(keyword)
            else:
                query = hash_embedding(tables.sparkSession.createDataFrame([(0, keyword)], "id long, text string")).withColumnRenamed("id", "query_id")
                near = nearest(vectors, query, 5, 0.6)
            found = near.select(F.lit("vector").alias("kind"), F.col("id").alias("candidate"), F.regexp_extract("id", r"^column:(.*)\.[^.]*$", 1).alias("node"), "confidence")
            found = found.withColumn("node", F.when(F.col("node") != "", F.col("node")))
    about = tables.select(F.col("full_name").alias("node"), "layer", "domain").dropDuplicates(["node"])
    certified = glossary.groupBy(F.col("term").alias("candidate")).agg(F.max(F.col("certified").cast("int")).alias("certified"))
    full = found.join(about, "node", "left").join(certified, "candidate", "left").na.fill(0, ["certified"])
    full = full.withColumn("domain_match", F.coalesce(F.col("domain") == F.lit(domain), F.lit(False)).cast("int")).drop("domain").dropDuplicates(["candidate"])
    return families(full, closed)
