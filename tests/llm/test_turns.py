import hashlib
import itertools
import random
import zlib

import pytest

from lakeloom.llm import turns

SPACE = " \t\n\x0b\x0c\r"
STEP = {"": "u", "s": "u", "u": "a", "a": "u"}
ROLE = {"u": "user", "a": "assistant"}


def cheapest(rows):
    """rows: (initial, must go, cut). (cost, audit) by keeping the least of both for every state of the form."""

    def inserted(best):
        for _ in range(3):
            for a, b in STEP.items():
                if a in best:
                    best[b] = min(best.get(b, (10**9, "")), (best[a][0] + 3, best[a][1] + "I"))
        return best

    best = inserted({"": (0, "")})
    for initial, gone, cut in rows:
        after = {}

        def put(q, cost, audit, after=after):
            after[q] = min(after.get(q, (10**9, "")), (cost, audit))

        for q, (cost, audit) in best.items():
            put(q, cost + 4, audit + "D")
            if not gone:
                more = 3 if cut else 0
                if (initial == "s" and q == "") or initial == STEP[q]:
                    put(initial, cost + more, audit + "K")
                put(STEP[q], cost + 3 + more, audit + "R")
        best = inserted(after)
    return min(best[q] for q in ("", "a") if q in best)


def brute(rows):
    by = {}
    for conv, turn, role, text in rows:
        own = by.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fate == 1:
            text = ""
        if fate == 2:
            text = "".join(c for c in text if c not in ".!?")
        if fate == 4:
            role = "user"
        same = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
        own += [(turn is not None, turn or 0, role, same, text, turn)] * ((fate != 0) + (fate == 3))
    out = []
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0], r[1], r[2].encode(), r[3] if r[4].strip(SPACE) else b""))
        numbers = [r[5] for r in own if r[5] is not None]
        seen, symbols, count = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, _, text, _ in own:
            tail = text.rstrip(SPACE)[-1:]
            blank, again = not tail, (role, text) in seen
            cut = not blank and not again and tail not in ".!?"
            seen.add((role, text))
            count["blank"] += blank
            count["duplicate"] += again and not blank
            count["truncated"] += cut
            symbols.append((role[:1], blank or again, cut))
        cost, audit = cheapest(symbols)
        repaired, q, rest = [], "", iter(own)
        for letter in audit:
            role, text = ("", "") if letter == "I" else ((r := next(rest))[2], r[4])
            if letter != "D":
                q = role[0] if letter == "K" else STEP[q]
                repaired.append(f"{role if letter == 'K' else ROLE[q]}:{text}")
        roles = "".join(s[0] or "-" for s in symbols)
        bad = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(symbols))
        assert len(roles) == len(symbols)
        text = "\n".join(repaired)
        out.append((conv, max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, *count.values(), bad, cost, audit, hashlib.sha256(text.encode()).hexdigest(), text))
    return sorted(out, key=str)


def test_automaton_equals_plain_costs():
    r = random.Random(2)
    automaton = turns.Automaton()
    symbols = [(k, i, cut) for i, k in (("s", 0), ("u", 1), ("a", 2), ("x", 3)) for cut in (False, True)]
    for _ in range(4000):
        rows = [r.choice([("s", True, False), *((i, False, cut) for _, i, cut in symbols)]) for _ in range(r.randrange(12))]
        code = bytes(0 if gone else 1 + 2 * "suax".index(i) + cut for i, gone, cut in rows)
        assert turns.cheapest(automaton, code) == cheapest(rows)
    assert len(automaton.vectors) < 100  # there are few states, however long the conversations


def conversation(r, conv, n):
    texts = ["Yes.", "No!", "cut", "", " \t", "Well? ", None, "é🙂.", "a" * 300 + "."]
    return [(conv, r.choice([None, *range(n), *range(n)]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), r.choice([*texts, f"{k}.", f"{k}."])) for k in range(n)]


@pytest.mark.parametrize("segment", (turns.SEGMENT_ROWS, 3))
def test_equals_brute_force(spark, monkeypatch, segment):
    monkeypatch.setattr(turns, "SEGMENT_ROWS", segment)
    r = random.Random(9)
    rows = [x for conv in [None, *range(60)] for x in conversation(r, conv, r.randrange(1, 14))]
    rows += conversation(r, 1000, 700) + [(1001, 5, "user", "the same.")] * 300 + [(1002, k, ("user", "assistant")[k % 2], f"{k}.") for k in range(400)] + [(1003, k, "system", "x.") for k in range(50)]
    df = spark.createDataFrame([(*x, "z", 1) for x in rows], "conv_id long, turn long, role string, text string, place string, conv int").repartition(7)
    assert sorted((tuple(x) for x in turns.repair(turns.damaged(df), texts=True).collect()), key=str) == brute(rows)


def test_odd_tables(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert turns.repair(spark.createDataFrame([], schema)).collect() == []
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    only = turns.repair(turns.damaged(spark.createDataFrame([(gone, 0, "user", "a.")], schema))).collect()
    assert [tuple(x) for x in only] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    plain = turns.repair(spark.createDataFrame([(1, 0, "system", "s."), (1, 1, "user", "u."), (1, 2, "assistant", "a" * 400_000 + ".")], schema)).collect()
    assert [(x.cost, x.audit, x.illegal) for x in plain] == [(0, "KKK", 0)]
