"""Tables in the shared folder: driver tables, intermediate results, and versioned generations with guards."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lakeloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Written to a fresh path of the shared folder and read again: lineage is cut and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/lakeloom/{label}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, label: str, *flags: Column) -> tuple[DataFrame, int, list[bool]]:
    """As stored, with the number of rows and whether any row has each flag, all observed while it is written: one job."""
    seen = Observation()
    marks = [F.max(f.cast("int")).alias(f"f{k}") for k, f in enumerate(flags)]
    out = stored(df.observe(seen, F.count(F.lit(1)).alias("n"), *marks), label)
    found = seen.get
    return out, found["n"], [bool(found[f"f{k}"]) for k in range(len(flags))]


PER_TASK = 500_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Dealt by keys to partitions of about PER_TASK of `rows` rows, never fewer than shuffles have: what a task holds does not grow with the input."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // PER_TASK + 1), *keys)


BUCKET = "bucket_number"


def bucket_of(key: str, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias(BUCKET)


@dataclass
class Generations:
    """Tables kept as written generations under one folder. One pointer file names the serving generation of each table and the ones
    before; it is written beside and renamed over the old one, so all tables change at once or none does."""

    spark: SparkSession
    root: str

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _pointer(self) -> dict:
        path = self._path("CURRENT")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return {}
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.root}/CURRENT").collect()))

    def _point(self, to: dict) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        new, current = self._path(f"CURRENT.{uuid.uuid4().hex}"), self._path("CURRENT")
        out = new.getFileSystem(conf).create(new, True)
        out.write(bytearray(json.dumps(to).encode()))
        out.close()
        kinds = jvm.org.apache.hadoop.fs.Options.Rename
        over = self.spark.sparkContext._gateway.new_array(kinds, 1)
        over[0] = kinds.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.getFileSystem(conf).getUri(), conf).rename(new, current, over)

    def _read(self, name: str, generation: str | dict) -> DataFrame:
        """A generation is one folder; that of a bucketed table names a folder for each bucket (see write_buckets)."""
        if isinstance(generation, str):
            return self.spark.read.parquet(f"{self.root}/{name}/{generation}")
        return self._buckets(name, generation, generation["folders"])

    def _buckets(self, name: str, generation: dict, numbers: Iterable[str]) -> DataFrame:
        schema = StructType.fromJson(generation["schema"])
        paths = [f"{self.root}/{name}/{generation['folders'][b]}/{BUCKET}={b}" for b in numbers]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def current(self, name: str) -> DataFrame | None:
        found = self._pointer().get("current", {}).get(name)
        return self._read(name, found) if found else None

    def write_shadow(self, name: str, df: DataFrame) -> str:
        generation = f"gen-{uuid.uuid4().hex}"
        df.write.options(compression="zstd").parquet(f"{self.root}/{name}/{generation}")
        return generation

    def shadow(self, name: str, generation: str | dict) -> DataFrame:
        """A generation that may not serve yet."""
        return self._read(name, generation)

    def write_buckets(self, name: str, df: DataFrame, key: str, n: int = 64) -> dict:
        """A shadow whose rows are dealt to n buckets by a hash of key. A bucket without rows has no folder."""
        return {"key": key, "n": n, "schema": df.schema.jsonValue(), "folders": self._dealt(name, df, key, n)}

    def patch_buckets(self, name: str, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> dict:
        """A shadow of a bucketed table in which only the buckets of keys (a column of the table's key) are made anew, by change from
        their rows; every other bucket keeps its folder and files. change must not move rows to keys of other buckets. A table without
        buckets is an error. Nothing is overwritten: readers of the serving generation read on."""
        now = self._pointer()["current"][name]
        key, n = now["key"], now["n"]
        touched = sorted(str(r[0]) for r in keys.select(bucket_of(key, n)).distinct().collect())  # at most n
        held = [b for b in touched if b in now["folders"]]
        new = change(self._buckets(name, now, held)).select(StructType.fromJson(now["schema"]).names)
        folders = {b: f for b, f in now["folders"].items() if b not in touched} | self._dealt(name, new, key, n)
        return now | {"folders": folders}

    def _dealt(self, name: str, df: DataFrame, key: str, n: int) -> dict[str, str]:
        generation = f"gen-{uuid.uuid4().hex}"
        dealt = df.withColumn(BUCKET, bucket_of(key, n)).repartition(BUCKET)
        dealt.write.options(compression="zstd").partitionBy(BUCKET).parquet(f"{self.root}/{name}/{generation}")
        path = self._path(f"{name}/{generation}")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path)
        names = [f.getPath().getName() for f in found]
        return {x.partition("=")[2]: generation for x in names if x.startswith(f"{BUCKET}=")}

    def delta(self, name: str, shadow: str | dict) -> float:
        """Relative change of the row count against the serving generation (0 without one)."""
        now = self.current(name)
        if now is None or not (before := now.count()):
            return 0.0
        return abs(self._read(name, shadow).count() - before) / before

    def swap(self, shadows: dict[str, str | dict]) -> None:
        now = self._pointer().get("current", {})
        self._point({"current": now | shadows, "previous": now})

    def swap_guarded(self, shadows: dict[str, str | dict], bounds: dict[str, float]) -> str | None:
        """Swaps all shadows together if each table of bounds stays within its bound of relative change; else the old generations keep
        serving and the table that changed too much is named."""
        for name, most in bounds.items():
            if (found := self.delta(name, shadows[name])) > most:
                return f"{name} changed by {found:.0%}, more than {most:.0%}"
        self.swap(shadows)
        return None

    def rollback(self) -> bool:
        previous = self._pointer().get("previous")
        if not previous:
            return False
        self._point({"current": previous, "previous": None})
        return True


def latest_schema(snapshots: DataFrame, upto=None) -> DataFrame:
    """snapshots(full_name, snap_date, columns) → the last snapshot of each table, on or before a date if given."""
    own = snapshots if upto is None else snapshots.filter(F.col("snap_date") <= F.lit(upto))
    return own.groupBy("full_name").agg(F.max("snap_date").alias("snap_date"), F.max_by("columns", "snap_date").alias("columns"))


def metastore_tables(tbls: DataFrame, dbs: DataFrame, params: DataFrame, columns: DataFrame, partitions: DataFrame, owner_keys: list[str]) -> DataFrame:
    """Catalog tables from a metastore's own tables: full_name, table_type, comment, owner (a parameter by priority of keys, else the
    table's), columns as an ordered array with partition keys last."""
    comment = params.filter("param_key = 'comment'").select("tbl_id", F.col("param_value").alias("comment"))
    rank = F.array_position(F.array(*map(F.lit, owner_keys)), F.col("param_key"))
    owner = params.filter(F.col("param_key").isin(owner_keys)).groupBy("tbl_id").agg(F.min_by("param_value", rank).alias("param_owner"))
    entry = lambda part: F.struct(F.lit(part).alias("part"), "integer_idx", F.col("name"), F.col("type"))
    own = columns.groupBy("sd_id").agg(F.collect_list(entry(0)).alias("own"))
    keys = partitions.groupBy("tbl_id").agg(F.collect_list(entry(1)).alias("keys"))
    none = F.array().cast("array<struct<part:int,integer_idx:int,name:string,type:string>>")
    joined = tbls.join(dbs, "db_id").join(comment, "tbl_id", "left").join(owner, "tbl_id", "left").join(own, "sd_id", "left").join(keys, "tbl_id", "left")
    ordered = F.array_sort(F.concat(F.coalesce("own", none), F.coalesce("keys", none)))
    return joined.select(
        F.concat_ws(".", "db_name", "tbl_name").alias("full_name"),
        F.when(F.col("tbl_type").contains("VIEW"), "view").otherwise("table").alias("table_type"),
        "comment",
        F.coalesce("param_owner", "owner").alias("owner"),
        F.transform(ordered, lambda c: F.struct(c["name"].alias("name"), c["type"].alias("type"))).alias("columns"),
    )
