"""Feeds of statements: paged services with retries, folders of .sql files, and gold-standard annotations."""

from __future__ import annotations

import itertools
import json
import time
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ATTEMPTS = 4
FIELDS = {"task_id": "task_id", "node_seq": "node_seq", "target_table": "target_table", "sql_text": "sql_text"}


def retried(call: Callable[[], dict], attempts: int = ATTEMPTS, wait: Callable[[float], None] = time.sleep) -> dict:
    """call(), again after 2, 4, 8, ... seconds if it fails; the last failure is raised."""
    for k in range(attempts):
        try:
            return call()
        except Exception:
            if k + 1 == attempts:
                raise
            wait(2.0 ** (k + 1))
    raise AssertionError


def pages(fetch: Callable[[int, int], list[dict]], size: int = 200, wait: Callable[[float], None] = time.sleep) -> Iterator[dict]:
    """Items of fetch(page, size), page 1, 2, ... until one is empty or short."""
    page = 1
    while items := retried(lambda: fetch(page, size), wait=wait):  # noqa: B023
        yield from items
        if len(items) < size:
            return
        page += 1


def statements_of(items: Iterator[dict], fields: dict[str, str] = FIELDS) -> Iterator[dict]:
    """Items renamed by fields (ours: theirs); those without target or text are dropped."""
    for item in items:
        own = {k: item.get(theirs) for k, theirs in fields.items()}
        if own.get("target_table") and own.get("sql_text"):
            yield own


def http_fetch(url: str, updated_since: str | None = None, timeout_s: float = 30) -> Callable[[int, int], list[dict]]:
    from urllib.parse import urlencode
    from urllib.request import urlopen

    def fetch(page: int, size: int) -> list[dict]:
        query = {"page": page, "size": size} | ({"updated_since": updated_since} if updated_since else {})
        with urlopen(f"{url}?{urlencode(query)}", timeout=timeout_s) as answer:
            found = json.loads(answer.read())
        return found.get("items", []) if isinstance(found, dict) else found

    return fetch


class SchedulerSource(DataSource):
    """spark.read.format("scheduler").option("url", ...).option("updated_since", ...): statements of a scheduler service."""

    @classmethod
    def name(cls) -> str:
        return "scheduler"

    def schema(self) -> str:
        return "task_id string, node_seq int, target_table string, sql_text string"

    def reader(self, schema) -> DataSourceReader:
        return _SchedulerReader(dict(self.options))


class _SchedulerReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        """With option `pages` (how many pages are known to be there) so many tasks share the listing by turns, and the last goes on after
        them until a page is short; without it the pages follow each other in one task."""
        return [InputPartition(k) for k in range(max(1, min(int(self.options.get("pages", 1)), int(self.options.get("tasks", 32)))))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fetch, size = http_fetch(self.options["url"], self.options.get("updated_since")), int(self.options.get("size", 200))
        known = int(self.options.get("pages", 1))
        tasks = max(1, min(known, int(self.options.get("tasks", 32))))
        own = itertools.chain.from_iterable(retried(lambda: fetch(page, size)) for page in range(partition.value + 1, known + 1, tasks))  # noqa: B023
        if partition.value == tasks - 1:
            own = itertools.chain(own, pages(lambda page, n: fetch(page + known, n), size))
        for s in statements_of(own):
            yield str(s["task_id"]), int(s["node_seq"] or 1), s["target_table"], s["sql_text"]


def sql_folder(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each .sql file: case_id (its stem), sql_text."""
    files = spark.read.text(f"{folder}/*.sql", wholetext=True)
    return files.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.sql$", 1).alias("case_id"), F.col("value").alias("sql_text"))


def read_schema(path: str) -> dict[str, dict[str, dict[str, str]]]:
    """{db: {table: {column: type}}} from a JSON file, columns in the file's order."""
    return json.loads(Path(path).read_text())


def read_dialects(folder: str) -> dict[str, str]:
    """dialects.json of a folder of statements: {case_id: dialect}; empty without the file."""
    path = Path(folder) / "dialects.json"
    return json.loads(path.read_text()) if path.exists() else {}


def schema_of(snapshots: DataFrame) -> dict[str, dict[str, dict[str, str]]]:
    """snapshots(full_name, columns: array of name, type), one row a table → the schema that the parser takes, which lives on the driver."""
    out: dict[str, dict[str, dict[str, str]]] = {}
    for r in snapshots.select("full_name", "columns").toLocalIterator():
        db, _, name = r.full_name.rpartition(".")
        out.setdefault(db or "default", {})[name] = {c["name"]: c["type"] for c in r["columns"]}
    return out


def read_annotation(path: str) -> dict:
    import yaml

    return yaml.safe_load(Path(path).read_text()) or {}


def prefilled(case_id: str, sql_file: str, dialect: str, parsed) -> dict:
    """An annotation to be checked by a person, from a parse result (plans.lineage.Parsed)."""
    columns = [{"dst_col": e.dst_column, "src_table": e.src_table, "src_col": e.src_column, "expr": e.transform_expr if len(e.transform_expr) <= 160 else e.transform_expr[:160] + "…"} for e in parsed.edges if e.edge_level == "column"]
    return {"case_id": case_id, "sql_file": sql_file, "dialect": dialect, "machine_status": parsed.status, "machine_reason": parsed.reason, "verified": False, "notes": "", "target_table": parsed.target, "table_sources": [e.src_table for e in parsed.edges if e.edge_level == "table"], "column_edges": columns}


def write_annotation(path: str, annotation: dict, force: bool = False) -> bool:
    """Writes it unless the file is there (force: overwrites it), and never over one that a person has verified."""
    import yaml

    old = Path(path)
    if old.exists() and (not force or read_annotation(path).get("verified")):
        return False
    old.write_text(yaml.safe_dump(annotation, allow_unicode=True, sort_keys=False))
    return True
