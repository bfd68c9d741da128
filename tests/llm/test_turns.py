"""Operator 13: the parser against a search over all edits, the query against plain Python, and awkward conversations."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest
from test_operators import clashing

from lodestack.llm import turns

SCHEMA = "conv_id long, turn long, role string, text string"
#: The pattern (s?(ua)+)? as an automaton: state to (letter, state) pairs; 0 and 4 accept.
STEPS = {0: [("s", 1), ("u", 2)], 1: [("u", 2)], 2: [("a", 4)], 4: [("u", 2)]}


def search(rows):
    """Least (cost, audit, roles) over all edits, by uniform cost and without any sharing; rows: (initial, truncated, must go)."""
    heap = [(0, "", 0, 0, "")]
    while True:
        cost, audit, at, state, roles = heapq.heappop(heap)
        if at == len(rows) and state in (0, 4):
            return cost, audit, roles
        if at < len(rows):
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, state, roles))
        for letter, to in STEPS[state]:
            if letter in "ua":
                heapq.heappush(heap, (cost + 3, audit + "I", at, to, roles + letter))
            if at < len(rows) and not rows[at][2]:
                if rows[at][0] == letter:
                    heapq.heappush(heap, (cost + 3 * rows[at][1], audit + "K", at + 1, to, roles + letter))
                elif letter in "ua":
                    heapq.heappush(heap, (cost + 3 + 3 * rows[at][1], audit + "R", at + 1, to, roles + letter))


def code(row):
    return "sua?".index(row[0]) | 4 * row[1] | 8 * row[2]


def test_parse_is_the_least_of_all_edits():
    rng = random.Random(8)
    for _ in range(1500):
        rows = [(rng.choice("suauau?"), int(rng.random() < 0.2), int(rng.random() < 0.15)) for _ in range(rng.randint(0, 5))]
        rows = [(a, 0 if c else b, c) for a, b, c in rows]
        assert turns.parse(bytes(map(code, rows))) == search(rows), rows


def test_parse_takes_long_conversations():
    cost, audit, roles = turns.parse(bytes([1, 2] * 20_000 + [1]))
    assert cost == 3 and len(audit) == 40_002 and audit.count("I") == 1 and roles == "ua" * 20_001


def plain(rows):
    """The contract's figures in plain Python, by conversation, the edits by search()."""
    given, made = dict.fromkeys(r[0] for r in rows), defaultdict(list)
    for conv, turn, role, text in rows:
        space = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        text = re.sub("[.!?]", "", space(text)) if kind == 2 else "" if kind == 1 else space(text)
        row = (turn, "user" if kind == 4 else space(role), text)
        made[conv] += [row] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv in given:
        own = sorted(made[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).digest()))
        seen, items, counts = set(), [], [0, 0, 0]
        for _, role, text in own:
            bare = text.rstrip(" \t\n\x0b\f\r")
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else 3
            seen.add((role, text))
            if fault < 3:
                counts[fault] += 1
            items.append((role[:1] if role[:1] in ("s", "u", "a") else "?", int(fault == 2), int(fault < 2)))
        firsts = [r[1][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:], strict=False))
        known = {r[0] for r in own if r[0] is not None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        cost, audit, letters = search(items)
        lines, rest, letters = [], iter(own), iter(letters)
        for edit in audit:
            row = next(rest) if edit != "I" else None
            if edit != "D":
                role = {"u": "user", "a": "assistant", "s": "system"}[next(letters)]
                lines.append(f"{row[1] if edit == 'K' else role}:{row[2] if row else ''}")
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations():
    rng = random.Random(2)
    texts = ["Yes.", "No!", "Why?", "and then", "", " \n", "See. ", "é?", None]
    rows = []
    for conv in [*range(260), None]:
        for turn in range(rng.randint(1, 6)):
            role = ["user", "assistant"][turn % 2] if rng.random() < 0.75 else rng.choice(["system", "user", "assistant", "tool", "", None])
            rows.append((conv, turn if rng.random() < 0.95 else None, role, rng.choice(texts) if rng.random() < 0.3 else f"Text {turn}."))
    return [*rows, (1000, 3, "user", "Same."), (1000, 3, "user", "Same."), (1000, 9, "user", "Same."), (1001, None, "user", "x" * 300_000)]


def test_report_is_plain_python(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r["conv_id"]: tuple(r)[1:] for r in turns.report(turns.damaged(clashing(df))).collect()}
    assert got == plain(rows)


def test_repair_gives_well_formed_conversations(spark):
    rows = conversations()
    out = defaultdict(list)
    for r in turns.repair(spark.createDataFrame(rows, SCHEMA)).collect():
        out[r["conv_id"]].append((r["position"], r["role"], r["text"], r["edit"]))
    for conv, found in out.items():
        found.sort()
        assert [x[0] for x in found] == list(range(len(found)))
        assert re.fullmatch("s?(ua)+", "".join(x[1][0] for x in found)), conv
        assert all((x[3] == "I") <= (x[2] == "") for x in found)
    assert len(out) > 200


def test_no_rows_and_a_conversation_of_a_third_of_all(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert turns.report(turns.damaged(empty)).count() == turns.repair(empty).count() == 0
    rows = [(7 if i % 3 else i, i, ["user", "assistant"][i % 2], f"Text {i}.") for i in range(3000)]
    got = {r["conv_id"]: r for r in turns.report(turns.damaged(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert set(got) == {r[0] for r in rows} and len(got[7]["audit"]) >= 1800


@pytest.mark.parametrize("text", ["", " ", "\n\t"])
def test_blank_rows_go(spark, text):
    df = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], SCHEMA)
    assert turns.repair(df).count() == 0
