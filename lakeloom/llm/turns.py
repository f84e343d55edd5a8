"""Conversation structure repair: the cheapest edits that bring the roles of a conversation's rows into the form (s?(ua)+)?

Rows go by turn (nulls first; rows of one turn by role and then by a hash of role and text). Each row's first fault counts: blank (nothing but ASCII space), duplicate (role
and text seen earlier in the conversation), truncated (its last character other than ASCII space is not one of . ! ?). A row is kept
at no cost, rerolled to user or assistant at 3, or deleted at 4, and must be deleted if blank or duplicate; a truncated row that stays
costs 3 more; a message without text is inserted anywhere at 3. Of equally cheap edits those whose initials (D, I, K, R) come first in ASCII win.

A row is one of nine symbols, and the four states of the form (nothing yet, s, ..u, ..a) have a cost each. Lazy weighted determinisation:
the vector of these costs, less its least, is a state of a deterministic automaton; states and the table of transitions are made as they
are met, and as costs that can lie on no cheapest way are left out of a vector, there are few. A scan of the table gives the cost; a
trace back over tight arcs marks what lies on some cheapest way, and the edits follow those marks from the front.

Rows are sorted into range partitions, so whatever lies between a partition's first and last conversation is whole and done in the
same task. What may go on in the next partition, and what is longer than SEGMENT_ROWS or SEGMENT_BYTES, is cut into segments of that
size: a first pass gives each segment's costs from every state to every state, streams over segments carry the costs from the
front and from the back, a second pass traces each segment between them, and a stream over the pieces chains and hashes them. Those streams hold
one segment at a time, so a conversation of a third of all rows meets in no task (sha256 is by its nature taken in one pass).

Nulls of role and text count as one space; a null conv_id is a conversation of its own; null turns come first and count in no gap. An empty table gives
an empty result. Further columns take no part, whatever their names. Rows must be read from files (see _common.spread).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.llm._common import partition_id, spread, squeeze, stored, tidied, tune, unsqueeze

KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
NONE, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 50
INSERTED = {NONE: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEPT = {(NONE, 0): SYSTEM, (NONE, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
ENDS = (0, 2 * INSERT, INSERT, 0)
SYMBOLS, GONE = 9, 0
BLANK, DUPLICATE, TRUNCATED, DROPPED = 1, 2, 3, 9
SEGMENT_ROWS, SEGMENT_BYTES = 4096, 1 << 18
SPACE = " \t\n\x0b\x0c\r"


class Automaton:
    """Cost vectors as states, made when they are first met."""

    def __init__(self) -> None:
        self.ids: dict[tuple[int, ...], int] = {}
        self.vectors: list[tuple[int, ...]] = []
        self.next: list[int] = []
        self.cost: list[int] = []
        self.marks: dict[tuple[int, int, int], int] = {}
        self.edits: dict[tuple[int, int, int, int, int], tuple[str, int]] = {}

    def state(self, costs: Sequence[int]) -> tuple[int, int]:
        """The state of these costs, and what they have in common."""
        v = list(costs)
        for _ in range(2):
            for a, b in INSERTED.items():
                v[b] = min(v[b], v[a] + INSERT)
        if v[NONE] > v[ASSISTANT] + DELETE:  # what follows costs from there DELETE more than from ..a at most
            v[NONE] = FAR
        if v[SYSTEM] > v[ASSISTANT]:
            v[SYSTEM] = FAR
        least = min(v)
        key = tuple(FAR if x >= FAR else x - least for x in v)
        if key not in self.ids:
            self.ids[key] = len(self.vectors)
            self.vectors.append(key)
            self.next += [-1] * SYMBOLS
            self.cost += [0] * SYMBOLS
        return self.ids[key], least

    @staticmethod
    def arcs(symbol: int) -> Iterator[tuple[str, int, int, int]]:
        """(initial, from, to, cost) of what may be done with a row."""
        for q in range(4):
            yield "D", q, q, DELETE
        if symbol != GONE:
            kind, more = (symbol - 1) // 2, CUT * ((symbol - 1) % 2)
            for (q, role), to in KEPT.items():
                if role == kind:
                    yield "K", q, to, KEEP + more
            for q, to in INSERTED.items():
                yield "R", q, to, REROLE + more

    def _fill(self, state: int, symbol: int) -> int:
        v, out = self.vectors[state], [FAR] * 4
        for _, q, to, cost in self.arcs(symbol):
            out[to] = min(out[to], v[q] + cost)
        at = state * SYMBOLS + symbol
        self.next[at], self.cost[at] = self.state(out)
        return self.next[at]

    def scan(self, state: int, symbols: bytes) -> tuple[list[int], int]:
        """States after 0, 1, ... rows, and the cost they have in common at the end."""
        trail, total, follow, cost = [state], 0, self.next, self.cost
        for x in symbols:
            at = state * SYMBOLS + x
            state = follow[at]
            if state < 0:
                state = self._fill(at // SYMBOLS, x)
            total += cost[at]
            trail.append(state)
        return trail, total

    def _mark(self, state: int, symbol: int, after: int) -> int:
        """Which of the form's states before a row lie on a cheapest way, by those after it."""
        key = (state, symbol, after)
        if key not in self.marks:
            at = state * SYMBOLS + symbol
            v, w, common, out = self.vectors[state], self.vectors[self.next[at]], self.cost[at], 0
            for _, q, to, cost in self.arcs(symbol):
                if after >> to & 1 and v[q] < FAR and v[q] + cost == w[to] + common:
                    out |= 1 << q
            for _ in range(2):
                for a, b in INSERTED.items():
                    if out >> b & 1 and v[a] < FAR and v[a] + INSERT == v[b]:
                        out |= 1 << a
            self.marks[key] = out
        return self.marks[key]

    def _edit(self, state: int, symbol: int, q: int, before: int, after: int) -> tuple[str, int]:
        """Initials up to the row's own, and the form's state after it."""
        key = (state, symbol, q, before, after)
        if key not in self.edits:
            at = state * SYMBOLS + symbol
            v, w, common, letters = self.vectors[state], self.vectors[self.next[at]], self.cost[at], ""
            while True:
                ways = [(name, to) for name, a, to, cost in self.arcs(symbol) if a == q and after >> to & 1 and v[q] + cost == w[to] + common]
                more = INSERTED[q]
                if before >> more & 1 and v[q] + INSERT == v[more]:
                    ways.append(("I", more))
                name, q = min(ways)
                letters += name
                if name != "I":
                    break
            self.edits[key] = (letters, q)
        return self.edits[key]

    def traced(self, trail: list[int], symbols: bytes, ends: Sequence[int]) -> list[int]:
        """Marks before each row and at the end. ends: the cost of what follows, by state."""
        v = self.vectors[trail[-1]]
        least = min(a + b for a, b in zip(v, ends, strict=True))
        mark = sum(1 << q for q in range(4) if v[q] + ends[q] == least)
        out = [mark]
        for k in range(len(symbols) - 1, -1, -1):
            mark = self._mark(trail[k], symbols[k], mark)
            out.append(mark)
        return out[::-1]

    def audit(self, trail: list[int], symbols: bytes, marks: list[int], q: int, last: bool = True) -> tuple[str, int]:
        """Initials of the edits from the form's state q on, and the state they end in."""
        out = []
        for k, x in enumerate(symbols):
            letters, q = self._edit(trail[k], x, q, marks[k], marks[k + 1])
            out.append(letters)
        while last and ENDS[q]:
            out.append("I")
            q = INSERTED[q]
        return "".join(out), q


def cheapest(automaton: Automaton, symbols: bytes) -> tuple[int, str]:
    """Cost and initials of the edits of a whole conversation."""
    start, common = automaton.state((0, FAR, FAR, FAR))
    trail, total = automaton.scan(start, symbols)
    least = min(a + b for a, b in zip(automaton.vectors[trail[-1]], ENDS, strict=True))
    return common + total + least, automaton.audit(trail, symbols, automaton.traced(trail, symbols, ENDS), NONE)[0]


def edited(audit: str, q: int, roles: Sequence[str], texts: Sequence[str]) -> list[str]:
    """The messages after the edits, `role:text` each."""
    out, at = [], 0
    for letter in audit:
        if letter == "I":
            q = INSERTED[q]
            out.append(f"{NAMES[q]}:")
            continue
        if letter == "K":
            q = KEPT[q, {"s": 0, "u": 1, "a": 2}[roles[at][:1]]]
            out.append(f"{roles[at]}:{texts[at]}")
        elif letter == "R":
            q = INSERTED[q]
            out.append(f"{NAMES[q]}:{texts[at]}")
        at += 1
    return out


def faults(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, dropped) → conv, turn, role, text, kind (of its role: 0 to 3), fault without duplicates, same (a hash of role and text)."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    last = F.right(F.rtrim(text, F.lit(SPACE)), F.lit(1))
    first = F.left(role, F.lit(1))
    kind = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    fault = F.when(F.col("dropped"), DROPPED).when(last == "", BLANK).when(last.isin(".", "!", "?"), 0).otherwise(TRUNCATED)
    out = rows.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), kind.alias("kind"), fault.alias("fault"))
    key = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return out.withColumn("same", F.when(F.col("fault").isin(0, TRUNCATED), F.unhex(F.sha2(key.cast("binary"), 256))))


class _Rows:
    """Some consecutive rows of a conversation."""

    NAMES = ("turn", "role", "text", "kind", "fault", "same")
    SCHEMA = "turns array<long>, roles array<string>, texts array<string>, kinds binary, faults binary, sames array<binary>"

    def __init__(self, columns: Sequence[list] = ()):
        self.turn, self.role, self.text, self.kind, self.fault, self.same = ([*c] for c in columns) if columns else ([] for _ in range(6))
        self.bytes = 0

    def add(self, columns: Sequence[list], a: int, b: int) -> None:
        for own, c in zip((self.turn, self.role, self.text, self.kind, self.fault, self.same), columns, strict=True):
            own += c[a:b]

    def mark_repeats(self, first: set[int] | None = None) -> None:
        """first: places of the rows whose role and text were not seen before; found among these rows if not given."""
        seen: set[bytes] = set()
        for k, same in enumerate(self.same):
            if same is not None and (same in seen if first is None else k not in first):
                self.fault[k] = DUPLICATE
            seen.add(same)

    def live(self) -> list[int]:
        return [k for k, f in enumerate(self.fault) if f != DROPPED]

    def symbols(self, live: list[int]) -> bytes:
        return bytes(GONE if self.fault[k] in (BLANK, DUPLICATE) else 1 + 2 * self.kind[k] + (self.fault[k] == TRUNCATED) for k in live)

    def counts(self, live: list[int]) -> dict:
        """Additive counts, and what is needed to add them up."""
        turns = [t for k in live if (t := self.turn[k]) is not None]
        kinds = [self.kind[k] for k in live]
        return {
            "low": turns[0] if turns else None, "high": turns[-1] if turns else None, "turns": sum(a != b for a, b in zip(turns, [None, *turns])),
            **{name: sum(self.fault[k] == f for k in live) for name, f in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))},
            "illegal": sum(illegal(a, b) for a, b in zip(kinds, kinds[1:])), "first_kind": kinds[0] if kinds else None, "last_kind": kinds[-1] if kinds else None,
        }


def illegal(a: int, b: int) -> bool:
    return (a, b) not in ((0, 1), (1, 2), (2, 1))


def gaps(low: int | None, high: int | None, turns: int) -> int:
    return 0 if low is None else high - low + 1 - turns


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, repaired string"
COUNTS = "low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, first_kind int, last_kind int"


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _schema(df: DataFrame, text: str) -> T.StructType:
    """conv as in df, then the fields of text."""
    return T.StructType([T.StructField("conv", df.schema["conv"].dataType), *T.StructType.fromDDL(text).fields])


def _batches(rows: Iterator[dict], schema: pa.Schema, limit: int = 1024, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    size = 0
    for r in rows:
        held.append(r)
        size += r.pop("_bytes", 0)
        if len(held) >= limit or size >= most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _cut(sorted_rows: DataFrame, texts: bool) -> DataFrame:
    """Results of the conversations that lie within a partition (place null), and segments of the others."""
    schema = _schema(sorted_rows, f"place long, {RESULT}, {_Rows.SCHEMA}")
    arrow, most_rows, most_bytes = _arrow(schema), SEGMENT_ROWS, SEGMENT_BYTES

    def run(batches):
        automaton, base = Automaton(), partition_id() << 32

        def segment(conv, rows: _Rows) -> dict:
            nonlocal base
            base += 1
            return {"conv": conv, "place": base, "turns": rows.turn, "roles": rows.role, "texts": rows.text, "kinds": bytes(rows.kind), "faults": bytes(rows.fault), "sames": rows.same, "_bytes": rows.bytes}

        def whole(conv, rows: _Rows) -> dict:
            rows.mark_repeats()
            live = rows.live()
            x = rows.counts(live)
            cost, audit = cheapest(automaton, rows.symbols(live))
            text = "\n".join(edited(audit, NONE, [rows.role[k] for k in live], [rows.text[k] for k in live]))
            return {"conv": conv, "gaps": gaps(x["low"], x["high"], x["turns"]), "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(text.encode()).hexdigest(), "repaired": text if texts else None, "_bytes": rows.bytes} | {k: x[k] for k in ("blank", "duplicate", "truncated", "illegal")}

        def out() -> Iterator[dict]:
            rows, conv, border, begun = _Rows(), None, True, False
            for batch in batches:
                convs = batch.column(0).to_pylist()
                columns = [batch.column(c).to_pylist() for c in _Rows.NAMES]
                for k, c in enumerate(convs):
                    if begun and c != conv:
                        yield segment(conv, rows) if border else whole(conv, rows)
                        rows, border = _Rows(), False
                    begun, conv = True, c
                    rows.add(columns, k, k + 1)
                    rows.bytes += len(columns[2][k]) + 64
                    if len(rows.fault) >= most_rows or rows.bytes >= most_bytes:
                        yield segment(conv, rows)
                        rows, border = _Rows(), True
            if begun and rows.fault:
                yield segment(conv, rows)

        yield from _batches(out(), arrow)

    return stored(sorted_rows.mapInArrow(tidied(run), schema), "turns")


def _weighed(segments: DataFrame) -> DataFrame:
    """Segments with repeats marked, their counts, and weights: the cost from each state of the form to each, row by row."""
    seen = segments.select("conv", "place", F.posexplode("sames").alias("pos", "same")).filter("same is not null")
    first = seen.groupBy("conv", "same").agg(F.min(F.struct("place", "pos")).alias("at")).groupBy(F.col("at.place").alias("of")).agg(F.collect_list("at.pos").alias("firsts"))
    schema = _schema(segments, f"place long, turns array<long>, roles array<string>, texts array<string>, kinds binary, faults binary, {COUNTS.replace('turns', 'n_turns')}, weights array<long>")
    arrow = _arrow(schema)

    def run(batches):
        automaton = Automaton()
        units = [automaton.state([0 if q == p else FAR for q in range(4)])[0] for p in range(4)]

        def out() -> Iterator[dict]:
            for batch in batches:
                for r in batch.to_pylist():
                    rows = _Rows([r["turns"], r["roles"], r["texts"], r["kinds"], r["faults"], r["sames"]])
                    rows.mark_repeats({*(r["firsts"] or ())})
                    live = rows.live()
                    symbols, weights = rows.symbols(live), []
                    for unit in units:
                        trail, total = automaton.scan(unit, symbols)
                        weights += [min(FAR, x + total) for x in automaton.vectors[trail[-1]]]
                    x = rows.counts(live)
                    yield {k: r[k] for k in ("conv", "place", "turns", "roles", "texts", "kinds")} | {"faults": bytes(rows.fault), "n_turns": x.pop("turns"), "weights": weights, "_bytes": sum(map(len, r["texts"]))} | x

        yield from _batches(out(), arrow)

    return stored(segments.join(first, F.col("place") == F.col("of"), "left").select(*segments.columns, "firsts").mapInArrow(tidied(run), schema), "turns")


def _stream(rows: DataFrame, order: Column) -> DataFrame:
    """The rows of each conversation one after another in one task, which holds one at a time."""
    return rows.repartition("conv").sortWithinPartitions(F.col("conv"), order)


def _after(v: Sequence[int], weights: Sequence[int]) -> list[int]:
    return [min(FAR, min(v[p] + weights[4 * p + q] for p in range(4))) for q in range(4)]


def _before(weights: Sequence[int], b: Sequence[int]) -> list[int]:
    return [min(FAR, min(weights[4 * p + q] + b[q] for q in range(4))) for p in range(4)]


def _borders(weighed: DataFrame) -> DataFrame:
    """place, front: the costs of what comes before a segment; back: of what follows it; last: nothing follows."""
    slim = weighed.select("conv", "place", "weights")

    def forward(batches):
        start = [0, FAR, INSERT, 2 * INSERT]
        conv, v, begun = None, start, False
        for batch in batches:
            out = []
            for c, w in zip(batch.column("conv").to_pylist(), batch.column("weights").to_pylist(), strict=True):
                if not begun or c != conv:
                    begun, conv, v = True, c, start
                out.append(v)
                v = _after(v, w)
            yield pa.RecordBatch.from_arrays([batch.column("place"), pa.array(out, pa.list_(pa.int64()))], ["place", "front"])

    def backward(batches):
        conv, b, begun = None, [*ENDS], False
        for batch in batches:
            out, ends = [], []
            for c, w in zip(batch.column("conv").to_pylist(), batch.column("weights").to_pylist(), strict=True):
                ends.append(not begun or c != conv)
                if ends[-1]:
                    begun, conv, b = True, c, [*ENDS]
                out.append(b)
                b = _before(w, b)
            yield pa.RecordBatch.from_arrays([batch.column("place"), pa.array(out, pa.list_(pa.int64())), pa.array(ends, pa.bool_())], ["of", "back", "last"])

    front = _stream(slim, F.col("place")).mapInArrow(tidied(forward), "place long, front array<long>")
    back = _stream(slim, F.col("place").desc()).mapInArrow(tidied(backward), "of long, back array<long>, last boolean")
    return front.join(back, F.col("place") == F.col("of")).select(F.col("place").alias("border"), "front", "back", "last")


def _pieces(weighed: DataFrame, borders: DataFrame) -> DataFrame:
    """For each segment and state before it that a cheapest way may pass: its edits and messages."""
    schema = _schema(weighed, f"place long, q int, ends int, {COUNTS.replace('turns', 'n_turns')}, cost long, audit string, messages long, piece binary")
    arrow = _arrow(schema)

    def run(batches):
        automaton = Automaton()

        def out() -> Iterator[dict]:
            for batch in batches:
                for r in batch.to_pylist():
                    rows = _Rows([r["turns"], r["roles"], r["texts"], r["kinds"], r["faults"], []])
                    live = rows.live()
                    symbols = rows.symbols(live)
                    start, common = automaton.state(r["front"])
                    trail, total = automaton.scan(start, symbols)
                    cost = common + total + min(a + b for a, b in zip(automaton.vectors[trail[-1]], r["back"], strict=True))
                    marks = automaton.traced(trail, symbols, r["back"])
                    for q in range(4):
                        if marks[0] >> q & 1:
                            audit, ends = automaton.audit(trail, symbols, marks, q, r["last"])
                            messages = edited(audit, q, [rows.role[k] for k in live], [rows.text[k] for k in live])
                            piece = squeeze("\n".join(messages).encode())
                            yield {k: r[k] for k in ("conv", "place", "low", "high", "n_turns", "blank", "duplicate", "truncated", "illegal", "first_kind", "last_kind")} | {"q": q, "ends": ends, "cost": cost, "audit": audit, "messages": len(messages), "piece": piece, "_bytes": len(piece)}

        yield from _batches(out(), arrow)

    return weighed.drop("weights").join(borders, F.col("place") == F.col("border")).drop("border").mapInArrow(tidied(run), schema)


def _chained(pieces: DataFrame, texts: bool) -> DataFrame:
    """Results of the conversations whose pieces these are."""
    schema = _schema(pieces, RESULT)
    arrow = _arrow(schema)

    def run(batches):
        def out() -> Iterator[dict]:
            now: dict | None = None
            for batch in batches:
                for r in batch.to_pylist():
                    if now is None or r["conv"] != now["conv"]:
                        if now is not None:
                            yield done(now)
                        now = {"conv": r["conv"], "place": None, "state": NONE, "hash": hashlib.sha256(), "messages": 0, "audit": [], "texts": [], "turns": 0, "low": None, "high": None, "kind": None, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": r["cost"]}
                    if r["place"] != now["place"]:
                        now["place"], now["q"] = r["place"], now["state"]
                        joined(now, r)
                    if r["q"] == now["q"]:
                        text = unsqueeze(r["piece"])
                        if r["messages"]:
                            now["hash"].update((b"\n" if now["messages"] else b"") + text)
                            now["messages"] += r["messages"]
                            if texts:
                                now["texts"].append(text.decode())
                        now["audit"].append(r["audit"])
                        now["state"] = r["ends"]
            if now is not None:
                yield done(now)

        def joined(now: dict, r: dict) -> None:
            if r["low"] is not None:
                now["turns"] += r["n_turns"] - (now["high"] == r["low"])
                now["low"] = r["low"] if now["low"] is None else now["low"]
                now["high"] = r["high"]
            for k in ("blank", "duplicate", "truncated", "illegal"):
                now[k] += r[k]
            if r["first_kind"] is not None:
                now["illegal"] += now["kind"] is not None and illegal(now["kind"], r["first_kind"])
                now["kind"] = r["last_kind"]

        def done(now: dict) -> dict:
            return {k: now[k] for k in ("conv", "blank", "duplicate", "truncated", "illegal", "cost")} | {"gaps": gaps(now["low"], now["high"], now["turns"]), "audit": "".join(now["audit"]), "repaired_sha256": now["hash"].hexdigest(), "repaired": "\n".join(now["texts"]) if texts else None}

        yield from _batches(out(), arrow)

    return _stream(pieces, F.col("place")).mapInArrow(tidied(run), schema)


def repair(rows: DataFrame, texts: bool = False) -> DataFrame:
    """rows: conv_id, turn, role, text, and dropped where rows only name their conversation. For each conversation: conv_id, gaps,
    blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, and with texts the repaired messages, `role:text` by line."""
    tune(rows.sparkSession)
    if "dropped" not in rows.columns:
        rows = rows.withColumn("dropped", F.lit(False))
    first = _cut(spread(faults(rows), ["conv", "turn", "role", "same"]), texts)
    weighed = _weighed(first.filter("place is not null").select("conv", "place", *T.StructType.fromDDL(_Rows.SCHEMA).names))
    names = [f.name for f in T.StructType.fromDDL(RESULT).fields if texts or f.name != "repaired"]
    whole = first.filter("place is null").select("conv", *names)
    split = _chained(_pieces(weighed, _borders(weighed)), texts).select("conv", *names)
    return whole.unionByName(split).withColumnRenamed("conv", "conv_id")


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations with rows dropped, emptied, stripped of their ends of sentences, repeated or given to the user, by the crc32 of `conv_id:turn` modulo 20. A dropped
    row stays as the name of its conversation."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), fate.alias("fate"))
    text = F.when(F.col("fate").isin(0, 1), "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fate") == 0).alias("dropped"), F.explode(times).alias("copy")).drop("copy")
