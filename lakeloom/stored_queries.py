"""Queries of what is stored and kept up to date: bucketed generations, indexes, state of streams and of days, guards over views of the given
tables, each with the SQL that it must equal."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.operators import daily, diff, quality, search, textindex, vectorcells
from lakeloom.plans import metrics as M
from lakeloom.plans import rebuild
from lakeloom.platform_queries import ALLOWED, PEOPLE, folder
from lakeloom.queries import key, query, views
from lakeloom.sources.tables import Generations, stored, table
from lakeloom.streaming import gate

# --- streams ------------------------------------------------------------------------------------------------------------


def published(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(key("u", "user_id").alias("sql_id"), F.col("event_type").alias("sql_text"), F.col("ts").cast("timestamp").alias("published_at"))


@query("""WITH e AS (SELECT 'u' || user_id AS sql_id, event_type AS sql_text, ts, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, sha256(event_type)) AS before FROM events)
SELECT sql_id, sql_text, CAST(epoch_us(ts) AS BIGINT) AS at FROM e WHERE before IS DISTINCT FROM sql_text""")
def change_gate(spark, sf):
    """All events in four files by time, a file a batch; between the halves the stream is stopped and started again, and old rows come once more."""
    root, e = folder(spark, "gate"), stored(published(spark, sf), "published")
    cuts = [None, *e.select(F.unix_micros("published_at").alias("t")).approxQuantile("t", [0.25, 0.5, 0.75], 0.01), None]
    t = F.unix_micros("published_at")

    def land(k: int) -> None:
        part = e if cuts[k] is None else e.filter(t >= cuts[k])
        (part if cuts[k + 1] is None else part.filter(t < cuts[k + 1])).coalesce(1).write.mode("append").parquet(f"{root}/in")

    def run() -> None:
        stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        writer = gate.changes(stream).writeStream.outputMode("update").foreachBatch(lambda batch, _: batch.write.mode("append").parquet(f"{root}/out"))
        writer.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    for k in (0, 1):
        land(k)
    run()
    for k in (0, 2, 3):
        land(k)
    run()
    return spark.read.parquet(f"{root}/out").select("sql_id", "sql_text", F.unix_micros("published_at").alias("at"))


# --- buckets ------------------------------------------------------------------------------------------------------------


@query("""WITH m AS (SELECT max(l_orderkey) AS k FROM lineitem)
SELECT CASE WHEN l_returnflag = 'A' THEN 'manual' ELSE 'sql' END AS src_type, CAST(sum(CASE WHEN l_orderkey = k AND l_returnflag <> 'A' THEN 0 ELSE 1 END) + CASE WHEN l_returnflag = 'A' THEN 0 ELSE 1 END AS BIGINT) AS n, true AS others_kept
FROM (SELECT l_orderkey, CASE WHEN l_returnflag = 'A' THEN 'A' ELSE 'x' END AS l_returnflag, k FROM lineitem, m) GROUP BY l_returnflag""")
def edge_buckets(spark, sf):
    """The edges of one statement give way to a new one; only its bucket is written, all other files stay as they are."""
    own = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sql_id"), F.when(F.col("l_returnflag") == "A", "manual").otherwise("sql").alias("src_type"), F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    store = Generations(spark, folder(spark, "buckets"))
    store.swap({"edges": store.write_buckets("edges", own, "sql_id")})
    ids = own.agg(F.max("sql_id").alias("sql_id"))
    new = ids.withColumns({"src_type": F.lit("sql"), "src": F.lit(0).cast("long"), "dst": F.lit(0).cast("long")})
    before = {*store.current("edges").inputFiles()}
    store.swap({"edges": store.patch_buckets("edges", ids, lambda held: diff.replaced(held, new, ids))})
    after = store.current("edges")
    one = len(before - {*after.inputFiles()}) == 1 and len(before) > 1
    return after.groupBy("src_type").agg(F.count("*").alias("n")).withColumn("others_kept", F.lit(one))


# --- stored indexes -----------------------------------------------------------------------------------------------------


def words(spark, sf) -> DataFrame:
    """Keywords from the table itself: each word of a name followed by each type."""
    p = table(spark, sf, "part")
    each = p.select(F.explode(F.split("p_name", " ")).alias("word"), F.lower("p_type").alias("type")).distinct()
    return each.select(F.concat_ws(" ", "word", "type").alias("keyword")).distinct().select(F.col("keyword").alias("kid"), "keyword")


INDEXED = """k AS (SELECT DISTINCT word || ' ' || lower(p_type) AS kid FROM (SELECT unnest(string_split(p_name, ' ')) AS word, p_type FROM part)),
kg AS (SELECT DISTINCT kid, substr(kid, CAST(i AS INTEGER), 2) AS gram FROM k, range(1, 60) r(i) WHERE i < length(kid)),
d AS (SELECT p_partkey AS id, lower(p_name || ' ' || p_type) AS t FROM part), n AS (SELECT count(*) AS n FROM d),
f AS (SELECT id, gram, count(*) AS tf FROM (SELECT id, substr(t, CAST(i AS INTEGER), 2) AS gram FROM d, range(1, 200) r(i) WHERE i < length(t)) GROUP BY ALL), df AS (SELECT gram, count(*) AS df FROM f GROUP BY 1),
s AS (SELECT kid, id, round(sum(tf * pow(log10(n / df), 2)), 6) AS score FROM kg JOIN f USING (gram) JOIN df USING (gram), n GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY kid ORDER BY score DESC, id) AS INTEGER) AS rank FROM s WHERE score > 0)"""


@query(f"WITH {INDEXED} SELECT kid, id, score, rank FROM r WHERE rank <= 10")
def keyword_table(spark, sf):
    """The ten best parts of every keyword of a table, from an index that was synced twice."""
    texts = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    index = textindex.GramIndex(spark, folder(spark, "grams"))
    index.sync(texts.filter("id % 7 <> 0").withColumn("text", F.when(F.col("id") % 5 == 0, "another text").otherwise(F.col("text"))).union(spark.createDataFrame([(-1, "a text that goes")], "id long, text string")))
    index.sync(texts)
    return index.search(words(spark, sf))


KEYWORD = "substr(p_name, 2) || left(p_type, 1)"


@query(f"""WITH RECURSIVE k AS (SELECT DISTINCT {KEYWORD} AS kid FROM part), n AS (SELECT p_partkey AS id, unnest([p_name, p_type]) AS name FROM part), d AS (SELECT DISTINCT name FROM n),
l(kid, name, i, r) AS (SELECT kid, name, 0, [0 FOR x IN range(length(kid))] FROM d, k UNION ALL
  SELECT kid, name, i + 1, [list_max([CASE WHEN substr(kid, CAST(j AS INTEGER), 1) = substr(name, i + 1, 1) THEN (CASE WHEN j = 1 THEN 0 ELSE r[j - 1] END) + 1 ELSE r[j] END FOR j IN range(1, m + 1)]) FOR m IN range(1, length(kid) + 1)] FROM l WHERE i < length(name)),
s AS (SELECT kid, name, 200.0 * r[length(kid)] / (length(name) + length(kid)) AS score FROM l WHERE i = length(name))
SELECT kid, id, round(max(score) / 100, 4) AS confidence FROM s JOIN n USING (name) WHERE score >= 85 GROUP BY kid, id""")
def keyword_join(spark, sf):
    """Misspelt names (a letter lost, one added) against all names and types."""
    p = table(spark, sf, "part")
    keywords = p.select(F.expr(KEYWORD).alias("kid")).distinct().withColumn("keyword", F.col("kid"))
    return textindex.fuzzy_join(keywords, p.select(F.col("p_partkey").alias("id"), F.array("p_name", "p_type").alias("names")))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
r AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(v.e, q.e), 6) AS confidence FROM v, v q WHERE q.vec_id % 50 = 0)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, id) AS INTEGER) AS rank FROM r) WHERE rank <= 5""")
def cell_neighbours(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    cells = vectorcells.VectorCells(spark, folder(spark, "cells"))
    cells.build(v)
    return cells.search(v.filter("id % 50 = 0").withColumnRenamed("id", "query_id"))


MISSPELT = "the {} of all"


@query("""WITH w AS (SELECT DISTINCT p_name FROM part), q AS (SELECT min(p_name) AS name FROM w),
t AS (SELECT p_name AS id, lower(regexp_replace(p_name, '\\s+', '', 'g')) AS t FROM w UNION ALL SELECT '', lower(regexp_replace(name || ' ' || name, '\\s+', '', 'g')) FROM q),
g AS (SELECT id, substr(t, CAST(i AS INTEGER), CAST(n AS INTEGER)) AS gram FROM t, range(1, 200) a(i), range(1, 4) b(n) WHERE i + n - 1 <= length(t)),
b AS (SELECT id, CAST('0x' || substr(md5(gram), 15, 2) AS INTEGER) AS dim, CASE WHEN CAST('0x' || substr(md5(gram), 13, 2) AS INTEGER) % 2 = 0 THEN 1 ELSE -1 END AS sign FROM g),
s AS (SELECT id, dim, sum(sign) AS v FROM b GROUP BY ALL HAVING sum(sign) <> 0), n AS (SELECT id, sqrt(sum(v * v)) AS n FROM s GROUP BY id),
c AS (SELECT x.id, round(sum(x.v * y.v) / (any_value(nx.n) * any_value(ny.n)), 6) AS confidence FROM s x JOIN s y ON y.id = '' AND x.id <> '' AND x.dim = y.dim JOIN n nx ON nx.id = x.id JOIN n ny ON ny.id = '' GROUP BY x.id)
SELECT 'vector' AS kind, 'term:' || id AS candidate, confidence FROM c WHERE confidence >= 0.6 ORDER BY confidence DESC, 'term:' || id LIMIT 5""")
def search_by_vector(spark, sf):
    """A doubled name, which no stage but the last finds: its neighbours come from a stored collection."""
    names = stored(table(spark, sf, "part").select("p_name").distinct(), "names")
    least = names.agg(F.min("p_name")).first()[0]
    wanted = names.select(F.concat(F.lit("term:"), "p_name").alias("id"), F.col("p_name").alias("text")).withColumn("content_hash", F.sha1("text"))
    held = search.Collection(spark, folder(spark, "collection"))
    held.sync(wanted)
    glossary = names.select(F.col("p_name").alias("term"), F.array().cast("array<string>").alias("aliases"), F.lit("active").alias("status"), F.lit(None).cast("string").alias("ref_table"), F.lit(False).alias("certified"))
    none = table(spark, sf, "customer").select(key("db.", "c_name").alias("full_name"), F.col("c_name").alias("table_name"), F.col("c_mktsegment").alias("comment"), F.lit("dwd").alias("layer"), F.lit("d").alias("domain"), F.lit(False).alias("is_online"))
    columns = none.select("full_name", F.col("comment").alias("column_name"))
    closed = spark.createDataFrame([], "ancestor string, descendant string, min_hops int, path_cnt long")
    return search.search(glossary, none, columns, closed, f"{least} {least}", vectors=held).select("kind", "candidate", "confidence")


# --- days ---------------------------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT CAST(ts AS DATE) AS day, user_id, value FROM events), d AS (SELECT DISTINCT day FROM e),
w AS (SELECT d.day, user_id, value FROM d JOIN e ON e.day <= d.day AND e.day > d.day - 7)
SELECT day, CAST(count(*) AS BIGINT) AS requests, CAST(count(DISTINCT user_id) AS BIGINT) AS users, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, true AS users_close, true AS p50_close FROM w GROUP BY day""")
def daily_windows(spark, sf):
    """Every week of days: exact figures, and whether the merged sketches are near them."""
    audit = table(spark, sf, "events").select(F.to_date("ts").alias("day"), "user_id", F.col("value").alias("cost"))
    out = daily.usage_windows(audit)
    near = F.abs(F.col("about_users") - F.col("users")) <= 0.06 * F.col("users") + 1
    spread = stored(audit, "audit")
    bounds = out.select(F.col("day").alias("end"), "about_p50", "requests")
    below = daily.within(spread, out.select("day"), 7).join(bounds, "end").groupBy("end").agg((F.count_if(F.col("cost") <= F.col("about_p50")) / F.max("requests")).alias("share"))
    out = out.join(below, out["day"] == below["end"])
    return out.select("day", "requests", "users", "p50", "p95", near.alias("users_close"), (F.abs(F.col("share") - 0.5) < 0.05).alias("p50_close"))


# --- guards, health, pools ----------------------------------------------------------------------------------------------

BARRED = {"customer": ("customer", "CUSTOMER", "{db}.customer", "spark_catalog.{db}.customer", "`{db}`.`Customer`", "(SELECT * FROM {db}.customer LIMIT 5)", "orders WHERE EXISTS (SELECT 1 FROM spark_catalog.{db}.customer)")}


@query("""SELECT * FROM (SELECT 'orders' AS name, CAST((SELECT count(*) FROM orders) AS BIGINT) AS n UNION ALL SELECT 'nation', (SELECT count(*) FROM nation)
UNION ALL SELECT unnest(['customer', 'CUSTOMER', 'db', 'spark_catalog', 'quoted', 'subquery', 'exists', 'path', 'text path', 'format', 'with']), NULL) t""")
def guarded_tables(spark, sf):
    """Counts of views over the given tables; the barred one has none, under whatever name it is asked for, nor has a file."""
    db = f"guard_{uuid.uuid4().hex}"
    views(spark, sf)
    spark.sql(f"CREATE DATABASE {db}")
    before = spark.catalog.currentDatabase()
    try:
        for t in ("orders", "nation", "customer"):
            spark.sql(f"CREATE VIEW {db}.{t} AS SELECT * FROM parquet.`{sf}/{t}.parquet`")
        spark.catalog.setCurrentDatabase(db)
        asked = {"orders": f"{db}.orders", "nation": f"spark_catalog.{db}.nation"} | dict(zip(("customer", "CUSTOMER", "db", "spark_catalog", "quoted", "subquery", "exists"), (x.format(db=db) for x in BARRED["customer"]), strict=True))
        asked |= {"path": f"parquet.`{sf}/customer.parquet`", "text path": "text.`/etc/hostname`", "format": "csv.customers"}

        def answer(sql: str) -> int | None:
            try:
                M.guard_select(spark, sql, {f"{db}.customer"})
            except M.Rejected:
                return None
            return spark.sql(sql).first()[0]

        rows = [(name, answer(f"SELECT count(*) AS n FROM {source} LIMIT 1")) for name, source in asked.items()]
        rows.append(("with", answer(f"WITH c AS (SELECT * FROM spark_catalog.{db}.customer) SELECT count(*) AS n FROM c LIMIT 1")))
    finally:
        spark.catalog.setCurrentDatabase(before)
        spark.sql(f"DROP DATABASE {db} CASCADE")
    return spark.createDataFrame(rows, "name string, n long")


@query("SELECT unnest(['closure_empty', 'too_many_failed_sql']) AS problem WHERE (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') > 200 UNION ALL SELECT 'closure_empty' WHERE (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') <= 200")
def health_of_runs(spark, sf):
    """An aborted run, a failed one and then a good one, as the warehouse records them: only what the tables hold is a problem."""
    w = rebuild.Warehouse(spark, folder(spark, "runs"))
    with w.run("full"):
        raise rebuild.Aborted("too much")
    try:
        with w.run("full"):
            raise ValueError("broken")
    except ValueError:
        pass
    with w.run("full") as stats:
        stats["n"] = 1
    failed = table(spark, sf, "orders").filter("o_orderstatus = 'F'").count()
    return quality.health(w.runs(), 0, failed, F.current_timestamp())


@query("SELECT 'semantic' AS pool, CAST(round(sum(c_acctbal), 2) AS DOUBLE) AS answer FROM customer WHERE c_nationkey IN (1, 2) UNION ALL SELECT 'adhoc', CAST(count(*) AS DOUBLE) FROM nation")
def pool_receipts(spark, sf):
    """A metric and a free question, each with the scheduler pool that its jobs ran in."""
    db = f"pools_{uuid.uuid4().hex}"
    views(spark, sf)
    spark.sql(f"CREATE DATABASE {db}")
    try:
        spark.sql(f"CREATE VIEW {db}.n AS SELECT * FROM parquet.`{sf}/nation.parquet`")
        free = M.query_adhoc(spark, "how many", [f"{db}.n"], lambda q, c: f"SELECT count(*) AS n FROM {db}.n")
    finally:
        spark.sql(f"DROP DATABASE {db} CASCADE")
    metric = M.query_metric(spark, {"spent": PEOPLE}, {"metric": "spent"}, ALLOWED)
    return spark.createDataFrame([(x["data"]["pool"], round(float(x["data"]["rows"][0][0]), 2)) for x in (metric, free)], "pool string, answer double")
