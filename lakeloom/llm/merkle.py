"""Merkle manifest of a table: the digest of every row, a tree of digests for each group of rows, one over the groups, and for every
row the path of siblings by which anyone can check it against the root without the other rows.

A row's leaf is the hash (lower-case hex sha256) of its columns, each `-` if null, else its number of UTF-8 bytes, `:` and the value.
The leaves of a group ascend by the order column; level by level every two neighbours become the hash of both, a last one without
a neighbour the hash of itself, until one is left: the group's subroot (of one row: its leaf). The subroots, ordered by group (null
first, else by UTF-8 bytes), give the root in the same way.

Rows get their places by a sort into range partitions and a sum over the partitions' counts. Aligned blocks of 2**HEIGHT leaves are
packed into one row each; their roots are packed again by 2**UPPER until each tree has one node, then the subroots likewise. On the way
back each block is joined with the path of its root and walked leaf by leaf (traversal), so a task holds one block and its
stacked subtrees, and the upper proofs are appended block by block. All of that moves digests only, never texts.

Nulls are values of their own; rows that are equal in group and order column follow each other by their leaves, equal rows stand beside each
other with equal leaves. An empty table gives an empty manifest. Further columns take no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.llm._common import in_order, stored, tidied, tune

HEIGHT, UPPER, SUB = 8, 12, 4
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:boolean,digest:string>>"


def hashed(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(columns: Sequence[Column]) -> Column:
    value = [c.cast("string") for c in columns]
    return hashed(F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in value)))


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""

    def step(at: Column, x: Column) -> Column:
        return hashed(F.when(x.digest.isNull(), at).when(x.left, F.concat(x.digest, at)).otherwise(F.concat(at, x.digest)))

    return F.aggregate(path, start, step)


def proof_digest(path: Column) -> Column:
    """The hash of the path's siblings, from the leaf to the root; levels without one add nothing."""
    return hashed(F.array_join(F.transform(path, lambda x: x.digest), ""))


def _hash(left: str | None, right: str | None) -> str | None:
    return left and hashlib.sha256((left + right if right else left).encode()).hexdigest()


def subtree_root(leaves: Sequence[str], height: int) -> str:
    level = list(leaves)
    for _ in range(height):
        level = [_hash(level[i], level[i + 1] if i + 1 < len(level) else None) for i in range(0, len(level), 2)]
    return level[0]


def _grown(leaves: Sequence[str], low: int, top: int, first: int, nodes: dict) -> Iterator[None]:
    """Fills nodes, by (level, number), with the levels low to top - 1 under node `first` of level top; one leaf or one hash a step. Below
    low it keeps no more than a stack of one node a level."""
    stack: list[tuple[int, str | None]] = []
    for i in range(first << top, (first + 1) << top):
        level, node = 0, leaves[i] if i < len(leaves) else None
        while True:
            if low <= level:
                nodes[level, i >> level] = node
            yield
            if not (stack and stack[-1][0] == level and level < top - 1):
                break
            level, node = level + 1, _hash(stack.pop()[1], node)
        stack.append((level, node))


def traversal(leaves: Sequence[str], height: int, sub: int = SUB) -> Iterator[list[str | None]]:
    """The siblings of each leaf in turn, from level 0 up (None: there is none). Fractal traversal: of every `sub` levels the existing
    subtree over the leaf and the desired one beside it are kept; a desired subtree grows by two steps a leaf, so that it is whole
    when its leaves' turn comes."""
    layers = [(low, min(height, low + sub)) for low in range(0, height, sub)]
    existing: list[dict] = [{} for _ in layers]
    desired: list[tuple[dict, Iterator[None]] | None] = [None for _ in layers]

    def begin(k: int, first: int) -> None:
        low, top = layers[k]
        nodes: dict = {}
        desired[k] = (nodes, _grown(leaves, low, top, first, nodes)) if first << top < min(len(leaves), 1 << height) else None

    for k, (low, top) in enumerate(layers):
        for _ in _grown(leaves, low, top, 0, existing[k]):
            pass
        begin(k, 1)
    for s in range(len(leaves)):
        yield [existing[k][level, (s >> level) ^ 1] for k, (low, top) in enumerate(layers) for level in range(low, top)]
        for k, (_, top) in enumerate(layers):
            if desired[k]:
                for _ in range(2):
                    next(desired[k][1], None)
            if not (s + 1) & ((1 << top) - 1) and desired[k]:
                for _ in desired[k][1]:
                    pass
                existing[k] = desired[k][0]
                begin(k, ((s + 1) >> top) + 1)


def _height(n: int, height: int) -> int:
    """Of the blocks of a tree of n nodes: all of them full height, unless there is one block alone."""
    return height if n > 1 << height else (n - 1).bit_length()


def _packed(nodes: DataFrame, height: int) -> DataFrame:
    """nodes: tree, pos, n (nodes of its tree), digest, own. A row for each aligned block with its root."""
    blocks = nodes.groupBy("tree", F.shiftright("pos", height).alias("block")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "digest", "own"))).alias("nodes"))

    def run(batches):
        for batch in batches:
            sizes = batch.column("n").to_pylist()
            digests = [x.field("digest").to_pylist() for x in _lists(batch.column("nodes"))]
            yield batch.append_column("root", pa.array([subtree_root(d, _height(n, height)) for d, n in zip(digests, sizes, strict=True)], pa.string()))

    return stored(blocks.mapInArrow(tidied(run), T.StructType([*blocks.schema.fields, T.StructField("root", T.StringType())])), "merkle")


def _lists(column: pa.Array) -> Iterator[pa.StructArray]:
    at = column.offsets.to_pylist()
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield column.values.slice(a, b - a)


def _unpacked(packed: DataFrame, proofs: DataFrame, height: int, subroots: bool = False) -> DataFrame:
    """proofs: tree, pos, path, subroot, root of the blocks' roots. The same of the blocks' nodes, with digest and own; subroots: these nodes are
    subroots themselves."""
    above = proofs.select(F.col("tree").alias("of"), F.col("pos").alias("at"), "path", "subroot", F.col("root").alias("top"))
    joined = packed.join(above, (F.col("tree") == F.col("of")) & (F.col("block") == F.col("at"))).select("tree", "n", "nodes", "path", "subroot", "top")
    own = packed.schema["nodes"].dataType.elementType["own"].dataType.simpleString()
    kinds = pa.struct([("left", pa.bool_()), ("digest", pa.string())])

    def run(batches):
        for batch in batches:
            trees, sizes, subs, tops = (batch.column(c).to_pylist() for c in ("tree", "n", "subroot", "top"))
            for k, (nodes, path) in enumerate(zip(_lists(batch.column("nodes")), _lists(batch.column("path")), strict=True)):
                digests, places = nodes.field("digest"), nodes.field("pos")
                ups, up_left = path.field("digest").to_pylist(), path.field("left").to_pylist()
                siblings: list[str | None] = []
                lefts: list[bool] = []
                offsets = [0]
                h = _height(sizes[k], height)
                for pos, own_path in zip(places.to_pylist(), traversal(digests.to_pylist(), h), strict=True):
                    siblings += own_path
                    siblings += ups
                    lefts += [bool(pos >> level & 1) for level in range(h)]
                    lefts += up_left
                    offsets.append(len(siblings))
                paths = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(lefts, pa.bool_()), pa.array(siblings, pa.string())], fields=list(kinds)))
                n = len(digests)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([trees[k]] * n, pa.int64()), places, digests, nodes.field("own"), paths, digests if subroots else pa.array([subs[k]] * n, pa.string()), pa.array([tops[k]] * n, pa.string())],
                    ["tree", "pos", "digest", "own", "path", "subroot", "root"],
                )

    return joined.mapInArrow(tidied(run), f"tree long, pos long, digest string, own {own}, path {PATH}, subroot string, root string")


def _levels(nodes: DataFrame, first: int) -> list[tuple[DataFrame, int]]:
    """Packed blocks and their height, level by level up to one node a tree."""
    out = []
    height = first
    while True:
        packed = _packed(nodes, height)
        out.append((packed, height))
        if not (packed.agg(F.max("n")).first()[0] or 0) > 1 << height:
            return out
        nodes = packed.select("tree", F.col("block").alias("pos"), F.expr(f"(n + {(1 << height) - 1}) div {1 << height}").alias("n"), F.col("root").alias("digest"), F.lit(None).cast("byte").alias("own"))
        height = UPPER


def _placed(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """leaves: grp, ord, digest, own. (Nodes of the groups' trees, the number of each group as tree with its size.)"""
    ranked = in_order(leaves, ["grp", "ord", "digest"], "merkle-leaves")
    part = F.shiftright("at", 33)
    counts = ranked.groupBy(part.alias("part"), "grp").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = stored(counts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))), "merkle-counts")  # a row for each part and each group
    groups = counts.groupBy("grp").agg(F.min("first").alias("start"), F.sum("n").alias("total")).withColumn("part", F.shiftright("start", 33))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a part
    parts = groups.groupBy("part").agg(F.count("*").alias("k")).select(F.col("part").alias("of"), F.coalesce(F.sum("k").over(earlier), F.lit(0)).alias("k"))
    number = F.row_number().over(Window.partitionBy("part").orderBy("start")) - 1
    groups = stored(groups.join(parts, F.col("part") == F.col("of")).select("grp", "total", (F.col("k") + number).alias("tree")), "merkle-groups")
    places = counts.alias("c").join(groups.alias("g"), F.col("c.grp").eqNullSafe(F.col("g.grp"))).select(F.col("c.part").alias("p"), F.col("c.grp").alias("of"), "first", "offset", "total", "tree")
    nodes = ranked.withColumn("part", part).join(places, (F.col("part") == F.col("p")) & F.col("grp").eqNullSafe(F.col("of")))
    return nodes.select("tree", (F.col("at") - F.col("first") + F.col("offset")).alias("pos"), F.col("total").alias("n"), "digest", "own"), groups


def manifest(docs: DataFrame, columns: Sequence[str] = COLUMNS, group: str = "lang", order: str = "doc_id", presented: Column | None = None) -> DataFrame:
    """For every row: the order and group columns, leaf, presented (the leaf of the row as someone shows it, if given), subroot, root,
    and path: its siblings from the leaf to the root with their sides, digest null at levels where it has none."""
    tune(docs.sparkSession)
    own = F.struct(F.col(order).alias("ord"), F.col(group).alias("grp"), *([presented.alias("presented")] if presented is not None else []))
    leaves = stored(docs.select(F.col(group).alias("grp"), F.col(order).alias("ord"), leaf([F.col(c) for c in columns]).alias("digest"), own.alias("own")), "merkle-rows")
    nodes, groups = _placed(leaves)
    levels = _levels(nodes, HEIGHT)
    subroots = levels[-1][0].filter("block = 0").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.col("root").alias("digest"), F.lit(None).cast("byte").alias("own"))
    subroots = _levels(subroots.withColumn("n", F.lit(groups.count()).cast("long")), UPPER)
    top = subroots[-1][0]
    proofs = top.select("tree", F.col("block").alias("pos"), F.array().cast(PATH).alias("path"), F.lit(None).cast("string").alias("subroot"), "root")
    for k, (packed, height) in reversed(list(enumerate(subroots))):
        proofs = stored(_unpacked(packed, proofs, height, subroots=k == 0), "merkle-proofs")
    proofs = proofs.select(F.col("pos").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", "subroot", "root")
    for packed, height in levels[:0:-1]:
        proofs = stored(_unpacked(packed, proofs, height), "merkle-proofs")
    rows = _unpacked(levels[0][0], proofs, levels[0][1])
    return rows.select(F.col("own.ord").alias(order), F.col("own.grp").alias(group), F.col("digest").alias("leaf"), *(["own.presented"] if presented is not None else []), "subroot", "root", "path")


def tampered(every: int = 7) -> Column:
    """The leaf of a documents row whose n_chars someone raised by one, where `every` divides the crc32 of its doc_id in decimals."""
    more = F.when(F.crc32(F.col("doc_id").cast("string")) % every == 0, 1).otherwise(0)
    changed = {"n_chars": (F.col("n_chars").cast("decimal(38,0)") + more).cast("decimal(38,0)")}
    return leaf([changed.get(c, F.col(c)) for c in COLUMNS])


def verified(docs: DataFrame) -> DataFrame:
    """The manifest of documents held against their tampered rows."""
    found = manifest(docs, presented=tampered())
    folded = fold(F.col("presented"), F.col("path"))
    out = found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
