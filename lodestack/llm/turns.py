"""Operator 13, conversation structure repair: error-correcting Earley parsing with a weighted grammar of roles.

A conversation is well formed if the initials of its roles are nothing, or an s or none and then one or more pairs u, a. The parser reads
its rows from the last to the first, by a grammar of the reversed language, so that the audit of what is left of a row can be
put before the audit of what follows: of two audits for the same rest the lesser stays the lesser whatever is put before it, which
isn't so the other way round. Besides keeping a row, error productions delete it, give it another role or insert a row. Each
chart item retains the least (cost, audit); an audit is held by its first edit and the item before, and compared by
its rank among the items of that row, so a step takes constant time and a conversation of any length a few bytes a row.

The work is dealt by conversation and streamed in the order of turns, twice: first only the initials and faults of its rows
meet, a byte each, and are parsed; then the rows pass by, one at a time, under the audit that leads them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lodestack.llm.textkit import slices, table

#: The language read backwards; upper case is a rule's name. The name of a rule can stand at its beginning only, so that all items begin
#: at the last row.
RULES: list[tuple[str, str]] = [("S", ""), ("S", "P"), ("P", "B"), ("P", "Bs"), ("B", "au"), ("B", "Bau")]
START = "S"
KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
#: What a truncated row costs that isn't deleted.
TRUNCATED = 3
#: Initials of the roles that rows can be given, or inserted with.
ROLES = {"u": "user", "a": "assistant"}
#: Rows that are parsed at most once for equal initials and faults; longer conversations differ.
SHORT = 24

# A row's code: its initial as 0 (s), 1 (u), 2 (a) or 3 (any other), plus 4 if it is truncated, plus 8 if it must be deleted.
_INITIALS = "sua"


class Value(NamedTuple):
    """Of an item: its cost, its audit for comparison (see parse), and the edit and item that it came from."""

    cost: int
    key: tuple
    edit: str
    back: tuple[int, int] | None


Item = tuple[int, int]  # rule, and how many of its symbols are behind


def _next(item: Item) -> str:
    """The symbol after the dot, or nothing."""
    return RULES[item[0]][1][item[1] : item[1] + 1]


def _complete(chart: dict[Item, Value], todo: list[Item]) -> None:
    """Predict, insert and complete until no item of this row gets less."""

    def offer(item: Item, value: Value) -> None:
        old = chart.get(item)
        if old is None or value[:2] < old[:2]:
            chart[item] = value
            todo.append(item)

    while todo:
        item = todo.pop()
        value, symbol = chart[item], _next(item)
        if symbol in ROLES:
            offer((item[0], item[1] + 1), Value(value.cost + INSERT, ("I", *value.key), "I" + symbol, item))
        elif not symbol:
            for rule, (_, body) in enumerate(RULES):
                if body[:1] == RULES[item[0]][0]:
                    offer((rule, 1), value._replace(edit="", back=item))


def parse(codes: bytes) -> tuple[int, str, str]:
    """Cost, audit and the initials of the repaired rows, of the cheapest edits of rows with such codes; the least audit of equally cheap ones.

    A key compares the audits of two items of a row: the inserts that an audit begins with, then the edit of the row and the rank of
    the rest among the items of the row after it; after the last row nothing."""
    todo = [(rule, 0) for rule, (_, body) in enumerate(RULES) if not body or body[0].islower()]
    chart = {item: Value(0, (), "", None) for item in todo}
    _complete(chart, todo)
    rows = [chart]
    for code in reversed(codes):
        initial, extra, must_go = "sua?"[code & 3], TRUNCATED * (code >> 2 & 1), code & 8
        rank = {key: k for k, key in enumerate(sorted({v.key for v in chart.values()}))}
        new: dict[Item, Value] = {}

        def offer(item: Item, cost: int, edit: str, back: Item, new: dict[Item, Value] = new, chart: dict[Item, Value] = chart, rank: dict[tuple, int] = rank) -> None:
            value = Value(chart[back].cost + cost, (edit[0], rank[chart[back].key]), edit, back)
            if item not in new or value[:2] < new[item][:2]:
                new[item] = value

        for item in chart:
            symbol = _next(item)
            if symbol and symbol.islower() or not symbol and RULES[item[0]][0] == START:
                offer(item, DELETE, "D", item)
            if symbol and symbol.islower() and not must_go:
                if symbol == initial:
                    offer((item[0], item[1] + 1), KEEP + extra, "K" + symbol, item)
                elif symbol in ROLES:
                    offer((item[0], item[1] + 1), REROLE + extra, "R" + symbol, item)
        chart = new
        _complete(chart, list(chart))
        rows.append(chart)
    at, item = len(codes), min((i for i in chart if RULES[i[0]][0] == START and not _next(i)), key=lambda i: chart[i][:2])
    cost, audit, roles = chart[item].cost, [], []
    while item is not None:
        value = rows[at][item]
        if value.edit:
            audit.append(value.edit[0])
            roles.append(value.edit[1:])
            at -= value.edit[0] != "I"
        item = value.back
    return cost, "".join(audit), "".join(roles)


_parse_short = lru_cache(maxsize=1 << 16)(parse)


def _damage() -> Column:
    """crc32 of conv_id and turn, modulo 20."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of conversations after the damage by crc32, and `gone` for rows that it drops, which stay marked.

    Null roles and texts become one space."""
    kind = _damage()
    text = F.coalesce("text", F.lit(" "))
    plain = rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (kind == 0).alias("gone"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return plain.drop("copy")


_GROUP = ["conv_id"]
_ORDER = ["turn", "role", "digest"]


def _digest() -> Column:
    return F.unhex(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256))


def _coded(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, gone and code of rows: no texts."""
    trimmed = F.rtrim("text", F.lit(" \t\n\x0b\f\r"))
    fault = F.when(trimmed == "", 8).when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), 4).otherwise(0)
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    keyed = rows.select("conv_id", "turn", "role", _digest().alias("digest"), "gone", fault.alias("fault"), code.alias("code"))
    # equal rows of one conversation, told by their turns; of equal turns too, any one is the first
    again = F.row_number().over(Window.partitionBy("conv_id", "digest", "gone").orderBy("turn")) > 1
    return keyed.withColumn("again", again & (F.col("fault") != 8))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, dict]]:
    """Rows as dictionaries, a megabyte at a time, with whether they begin a conversation."""
    before: object = _runs  # equal to no id
    for b in batches:
        for part in slices(b, 1 << 20):
            for row in part.to_pylist():
                yield row["conv_id"] != before or (row["conv_id"] is None) != (before is None), row
                before = row["conv_id"]


class _Tally:
    """What is gathered of a conversation's rows as they pass by."""

    def __init__(self, conv_id: object) -> None:
        self.conv_id, self.codes, self.turns = conv_id, bytearray(), 0
        self.first: int | None = None
        self.last: int | None = None
        self.before: str | None = None
        self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, row: dict) -> None:
        if row["gone"]:
            return
        if (turn := row["turn"]) is not None:
            self.turns += turn != self.last
            self.first = turn if self.first is None else self.first
            self.last = turn
        self.blank += row["fault"] == 8
        self.duplicate += row["again"]
        self.truncated += row["fault"] == 4 and not row["again"]
        initial = row["role"][:1]
        self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
        self.before = initial
        self.codes.append(row["code"] | (8 if row["again"] else row["fault"]))

    def result(self) -> dict:
        codes = bytes(self.codes)
        cost, audit, roles = _parse_short(codes) if len(codes) <= SHORT else parse(codes)
        gaps = self.last - self.first + 1 - self.turns if self.first is not None else 0
        return {"conv_id": self.conv_id, "gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "cost": cost, "audit": audit, "roles": roles}


_FIGURES = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _emit(schema: pa.Schema, rows: Iterator[dict], size: int) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += 64 + sum(len(v) for v in row.values() if isinstance(v, str))
        if weight >= size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _streamed(df: DataFrame, order: list[str], work: Callable[[Iterator[tuple[bool, dict]]], Iterator[dict]], schema: str) -> DataFrame:
    """work() over the rows of whole conversations, one after the other, each in the order of the columns (nulls first)."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    sorted_rows = df.repartition(*_GROUP).sortWithinPartitions(*_GROUP, *order)
    return sorted_rows.mapInArrow(lambda batches: _emit(arrow, work(_runs(batches)), 1 << 20), schema)


def _parsed(coded: DataFrame, id_type: str) -> DataFrame:
    def work(rows: Iterator[tuple[bool, dict]]) -> Iterator[dict]:
        tally: _Tally | None = None
        for begins, row in rows:
            if begins:
                if tally is not None:
                    yield tally.result()
                tally = _Tally(row["conv_id"])
            tally.add(row)
        if tally is not None:
            yield tally.result()

    # of equal rows the first isn't the repeated one
    return _streamed(coded, [*_ORDER, "again"], work, f"conv_id {id_type}, {_FIGURES}, roles string")


def _edited(rows: Iterator[tuple[bool, dict]]) -> Iterator[tuple[dict, str, str, dict | None]]:
    """(head, edit, initial after it, row if it isn't inserted), conversation by conversation; a last one with edit '' ends each."""
    head: dict | None = None
    at = role = 0

    def due() -> Iterator[tuple[dict, str, str, dict | None]]:
        nonlocal at, role
        while at < len(head["audit"]) and head["audit"][at] == "I":
            yield head, "I", head["roles"][role], None
            at, role = at + 1, role + 1

    for begins, row in rows:
        if begins:
            if head is not None:
                yield from due()
                yield head, "", "", None
            head, at, role = row, 0, 0
            continue
        if row["gone"]:
            continue
        yield from due()
        edit = head["audit"][at]
        at += 1
        yield head, edit, head["roles"][role] if edit != "D" else "", row
        role += edit != "D"
    if head is not None:
        yield from due()
        yield head, "", "", None


def _under_audits(rows: DataFrame) -> tuple[DataFrame, str]:
    """The rows with the figures of their conversation, as a row before them."""
    id_type = rows.schema["conv_id"].dataType.simpleString()
    coded = _coded(rows)
    heads = _parsed(coded, id_type).withColumn("head", F.lit(0))
    return heads.unionByName(rows.withColumns({"digest": _digest(), "head": F.lit(1)}), allowMissingColumns=True), id_type


def report(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for every conv_id of rows(conv_id, turn, role, text, gone).

    Rows that are `gone` count for nothing, but their conversation has a row of zeros if there are no others. Null turns come first;
    rows of one turn go by role, then by SHA-256. A null conv_id is a conversation. Repeated rows are duplicates. Roles other than s,
    u, a by their first letter, empty ones too, can't be kept. An empty table gives none; other columns may have any name. Texts are
    read one at a time, of any length; a conversation of any number of rows takes some hundred bytes a row while it is parsed."""

    def work(stream: Iterator[tuple[bool, dict]]) -> Iterator[dict]:
        total, any_row = hashlib.sha256(), False
        for head, edit, initial, row in _edited(stream):
            if not edit:
                yield {k: head[k] for k in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")} | {"repaired_sha256": total.hexdigest()}
                total, any_row = hashlib.sha256(), False
            elif edit != "D":
                role = row["role"] if edit == "K" else ROLES[initial]
                total.update((("\n" if any_row else "") + role + ":" + (row["text"] if row else "")).encode())
                any_row = True

    both, id_type = _under_audits(rows.select("conv_id", "turn", "role", "text", "gone"))
    return _streamed(both, ["head", *_ORDER], work, f"conv_id {id_type}, {_FIGURES}, repaired_sha256 string")


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, position, edit, turn, role, text of the repaired rows of rows(conv_id, turn, role, text): what training takes.

    Positions count from 0 in each conversation; inserted rows have a null turn and an empty text. Nulls in role and text become one space; the rest is as in
    report()."""

    def work(stream: Iterator[tuple[bool, dict]]) -> Iterator[dict]:
        position = 0
        for head, edit, initial, row in _edited(stream):
            if not edit:
                position = 0
            elif edit != "D":
                yield {"conv_id": head["conv_id"], "position": position, "edit": edit, "turn": row["turn"] if row else None, "role": row["role"] if edit == "K" else ROLES[initial], "text": row["text"] if row else ""}
                position += 1

    space = lambda c: F.coalesce(c, F.lit(" ")).alias(c)
    both, id_type = _under_audits(rows.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text"), F.lit(False).alias("gone")))
    return _streamed(both, ["head", *_ORDER], work, f"conv_id {id_type}, position long, edit string, turn long, role string, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(damaged(table(spark, sf_dir, "conversations")))
