"""A reproducible synthetic warehouse of a parcel carrier: layered tables and ETL statements of seven shapes, for benchmarks."""

from __future__ import annotations

import random

#: Shares of layers and of statement shapes, in per cent, as published with the figures to compare with.
LAYER_SHARES = {"ods": 32, "dwd": 28, "dws": 18, "ads": 12, "dim": 10}
SHAPE_SHARES = {"simple": 40, "join": 25, "window": 15, "agg": 10, "self_dep": 5, "tmp_chain": 3, "lateral": 2}
FEEDS_ON = {"dwd": ("ods",), "dws": ("dwd",), "ads": ("dws", "dwd")}
THINGS = ("parcel", "depot", "route", "scan", "driver", "claim", "pallet", "tariff")
#: Columns that every table has: what statements join, group and order by.
COMMON = {"parcel_no": "string", "depot_code": "string", "lane": "string", "happened_at": "timestamp", "labels": "array<string>"}
TAIL = {"load_day": "string"}


def shares(total: int, parts: dict[str, int]) -> dict[str, int]:
    """total split by largest remainder."""
    whole = sum(parts.values())
    out = {k: total * v // whole for k, v in parts.items()}
    for k in sorted(parts, key=lambda k: (-(total * parts[k] % whole), k))[: total - sum(out.values())]:
        out[k] += 1
    return out


class Carrier:
    """Tables and statements drawn from one seed."""

    def __init__(self, tables: int, seed: int):
        self.random = random.Random(seed)
        self.schema: dict[str, dict[str, dict[str, str]]] = {}
        self.by_layer = {layer: [self._table(layer, k) for k in range(n)] for layer, n in shares(tables, LAYER_SHARES).items()}

    def _table(self, layer: str, number: int) -> str:
        thing = self.random.choice(THINGS)
        width = min(60, max(4, round(self.random.gauss(20, 8))))
        own = {f"{thing}_{self.random.choice('abcdefgh')}{k}": ("decimal(12,3)", "bigint", "string", "date", "double")[k * 7 % 5] for k in range(width)}
        name = f"{layer}_{thing}_{number:04d}"
        self.schema.setdefault(layer, {})[name] = COMMON | own | TAIL
        return f"{layer}.{name}"

    def columns(self, table: str) -> dict[str, str]:
        db, name = table.split(".")
        return self.schema[db][name]

    def pick(self, layer: str) -> str:
        """Tables near the front are used most (weight 1 / rank)."""
        own = self.by_layer[layer]
        return self.random.choices(own, [1 / (k + 1) for k in range(len(own))])[0]

    def value(self, alias: str, column: str, kind: str) -> str:
        """An expression over one column; half of all are the column itself."""
        plain = f"{alias}.{column}"
        if self.random.random() < 0.5:
            return plain
        if kind in ("string", "array<string>"):
            return f"trim({plain})" if kind == "string" else f"size({plain})"
        if kind in ("date", "timestamp"):
            return f"date_trunc('MONTH', {plain})"
        return self.random.choice((f"round({plain}, 1)", f"if({plain} > 0, {plain}, 0)", f"{plain} * 2 + 1"))

    def values(self, source: str, alias: str) -> str:
        have = self.columns(source)
        chosen = self.random.sample(sorted(have), min(len(have), self.random.randint(3, 14)))
        return ", ".join(self.value(alias, c, have[c]) for c in chosen)

    def statements(self, shape: str, number: int) -> list[str]:
        layer = self.random.choice(tuple(FEEDS_ON))
        target, source, other = self.pick(layer), self.pick(self.random.choice(FEEDS_ON[layer])), self.pick("dim")
        into = f"INSERT OVERWRITE TABLE {target}"
        if shape == "simple":
            return [f"{into}\nSELECT {self.values(source, 's')}\nFROM {source} s\nWHERE s.load_day = '2031-03-04' AND s.lane IS NOT NULL"]
        if shape == "join":
            return [f"{into}\nSELECT {self.values(source, 's')}, {self.values(other, 'o')}\nFROM {source} s JOIN {other} o ON s.depot_code = o.depot_code\nWHERE s.load_day = '2031-03-04'"]
        if shape == "window":
            return [f"WITH latest AS (SELECT s.*, rank() OVER (PARTITION BY parcel_no ORDER BY happened_at DESC) AS place FROM {source} s)\n{into}\nSELECT {self.values(source, 'l')} FROM latest l WHERE l.place = 1"]
        if shape == "agg":
            return [f"{into}\nSELECT s.depot_code, s.lane, min(s.happened_at), count(DISTINCT s.parcel_no) FROM {source} s GROUP BY s.depot_code, s.lane HAVING count(1) > 1"]
        if shape == "self_dep":
            return [f"{into}\nSELECT parcel_no, depot_code, lane FROM {source}\nUNION ALL\nSELECT t.parcel_no, t.depot_code, t.lane FROM {target} t WHERE t.load_day < '2031-03-04'"]
        if shape == "tmp_chain":
            step = f"tmp_steps.step_{number}"
            self.schema.setdefault("tmp_steps", {})[f"step_{number}"] = {"parcel_no": "string", "lane": "string", "last_seen": "timestamp"}
            return [f"INSERT OVERWRITE TABLE {step}\nSELECT parcel_no, lane, max(happened_at) FROM {source} GROUP BY parcel_no, lane", f"{into}\nSELECT x.parcel_no, upper(x.lane), x.lane FROM {step} x"]
        return [f"{into}\nSELECT s.parcel_no, one, s.lane FROM {source} s LATERAL VIEW explode(s.labels) e AS one"]


def generate(tables: int, statements: int, seed: int = 42) -> tuple[dict, list[tuple[str, str]]]:
    """(schema, [(sql_id, text)]): `statements` pieces of ETL, of which a tmp chain has two statements."""
    carrier, out = Carrier(tables, seed), []
    for shape, n in shares(statements, SHAPE_SHARES).items():
        for _ in range(n):
            out += [(f"{shape}_{len(out) + k}", text) for k, text in enumerate(carrier.statements(shape, len(out)))]
    return carrier.schema, out


def stored(spark, folder: str, tables: int, statements: int, seed: int = 42) -> dict[str, str]:
    """Writes a generated warehouse as Parquet tables (catalogue, columns, schema snapshots, statements) under the folder; their paths."""
    schema, texts = generate(tables, statements, seed)
    flat = [(f"{db}.{t}", db if db in LAYER_SHARES else "tmp", list(c.items())) for db, own in schema.items() for t, c in own.items()]
    frames = {
        "tables": spark.createDataFrame([(n, layer, True) for n, layer, _ in flat], "full_name string, layer string, is_online boolean"),
        "columns": spark.createDataFrame([(n, c, t, k) for n, _, own in flat for k, (c, t) in enumerate(own)], "full_name string, column_name string, data_type string, place int"),
        "snapshots": spark.createDataFrame([(n, "2031-03-04", own) for n, _, own in flat], "full_name string, snap_date string, columns array<struct<name:string,type:string>>"),
        "statements": spark.createDataFrame([(i, t, True) for i, t in texts], "sql_id string, sql_text string, is_active boolean"),
    }
    paths = {}
    for name, df in frames.items():
        paths[name] = f"{folder}/{name}"
        df.write.mode("overwrite").parquet(paths[name])
    return paths
