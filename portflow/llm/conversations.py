"""Repair of conversations: the cheapest edits that make the roles ``(s?(ua)+)?``, by integer minima over a DAG of rows.

A conversation's rows are taken by turn (null first), rows of one turn by role and text. Edits, with their letters:
Keep (cost 0), Rerole to user or assistant (3), Delete (4; a blank or duplicate row must be deleted), Insert a user or
assistant with empty text anywhere (3); a truncated row that is not deleted adds 3. Among the cheapest edits, the ones
whose letters are least in ASCII (the audit) are taken. A row's fault is the first of: blank (no character but white
space), duplicate (role and text seen earlier in the conversation), truncated (the last other character is not . ! ?).

Nodes of the DAG are (rows done, state), the state being what the roles so far allow next: nothing yet, a system row,
a user, an assistant. An edge weighs one whole number: its cost in the high digits, below them its letter as an octal
digit (D 1, I 2, K 3, R 4) at its place in the audit, all later places 0. The number of a path orders it by cost, then
by audit, and the ordinary minimum of numbers decides at each node. That minimum stands for all that may follow: paths
to one node have done the same rows and a letter's cost is set by row and letter, so of two equally cheap ones neither
audit begins with the other, and they differ at a place that both have.

Conversations of any length: rows are dealt by ranges of (conv_id, turn, role, text), so a long conversation lies in
many tasks, and equal rows are one row with a number. A conversation that lies within a task and has at most ``ROWS``
rows is finished there. Others are cut into segments of about ``ROWS`` rows; a segment is a small matrix, the least
number from each state to each, and one task adds up a conversation's segments in order, keeping one audit in memory,
then passes over its rows once, in order, to write or hash what is kept: the digest of a whole text is a chain and
can't be split. Duplicates are found by an aggregation with map-side combine, not by remembering rows in a task.

Edge cases: a null role or text is one space (so such a row is blank), a null turn sorts first and is left out of the
gaps, a null conv_id is a conversation of its own; repeated rows are duplicates of one another; an empty role has no
initial, which is legal beside nothing; no rows give no result row (``with_ids`` adds conversations that lost all their
rows, with zeros, an empty audit and the digest of the empty string); an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_enough, stored, tidy

ROWS = 256  # rows of a segment
TEXT = 1 << 20  # bytes of text of one conversation that a task holds at most (one row alone may have more)
# Costs, letters in ASCII order from 1, and which state follows.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
D, I, K, R = 1, 2, 3, 4
LETTERS = str.maketrans({"0": None, "1": "D", "2": "I", "3": "K", "4": "R"})
NONE, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = {"s": {NONE: SYSTEM}, "u": {NONE: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
NEXT = {NONE: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}  # what Rerole and Insert may write
NAME = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
BLANK, DUPLICATE, CUT, FINE = range(4)


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage by crc32(`conv_id:turn`) % 20 (nulls: one space): 0 drops the row, 1 empties
    its text, 2 takes its . ! ? out, 3 repeats it, 4 makes it the user's."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = conversations.select(
        "conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")], (F.crc32(key) % 20).alias("harm")
    ).where("harm <> 0")
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("harm") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


# --- integer minima ---------------------------------------------------------------------------------------------------


def paths(rows: tuple[tuple[str, int, int], ...], starts: tuple[int, ...]) -> dict[tuple[int, int], tuple[int, str]]:
    """(cost, audit) by (first, last state) of rows (initial, fault, number of equal rows); remembered for short ones."""
    return _short_paths(rows, starts) if len(rows) <= 16 else _paths(rows, starts)


@lru_cache(maxsize=20_000)
def _short_paths(rows, starts):
    return _paths(rows, starts)


def _paths(rows: tuple[tuple[str, int, int], ...], starts: tuple[int, ...]) -> dict[tuple[int, int], tuple[int, str]]:
    places = sum(n for _, _, n in rows) + 2 * (len(rows) + 1)  # two inserts between rows always do
    out = {}
    for start in starts:
        best = _insert({start: (0, 0)}, places)
        for initial, fault, n in rows:
            after: dict[int, tuple[int, int]] = {}
            for state, node in best.items():
                if fault in (BLANK, DUPLICATE):
                    _least(after, state, _edge(node, DELETE, D, places, n))
                    continue
                extra = TRUNCATED if fault == CUT else 0
                _least(after, state, _edge(node, DELETE, D, places))
                if state in FOLLOWS.get(initial, ()):
                    _least(after, FOLLOWS[initial][state], _edge(node, KEEP + extra, K, places))
                _least(after, NEXT[state], _edge(node, REROLE + extra, R, places))
            if fault not in (BLANK, DUPLICATE) and n > 1:  # its copies
                after = {state: _edge(node, DELETE, D, places, n - 1) for state, node in after.items()}
            best = _insert(after, places)
        for state, (number, _) in best.items():
            low = number & ((1 << 3 * places) - 1)
            out[start, state] = number >> 3 * places, format(low, f"0{places}o").translate(LETTERS)
    return out


def _edge(node: tuple[int, int], cost: int, letter: int, places: int, times: int = 1) -> tuple[int, int]:
    """The node's number (and letters so far) with ``times`` equal letters added."""
    number, done = node
    digits = letter if times == 1 else int(str(letter) * times, 8)
    return number + (cost * times << 3 * places) + (digits << 3 * (places - done - times)), done + times


def _least(nodes: dict[int, tuple[int, int]], state: int, node: tuple[int, int]) -> None:
    nodes[state] = min(nodes[state], node) if state in nodes else node


def _insert(nodes: dict[int, tuple[int, int]], places: int) -> dict[int, tuple[int, int]]:
    out = dict(nodes)
    for state in (NONE, SYSTEM, ASSISTANT):
        if state in nodes:
            _least(out, USER, _edge(nodes[state], INSERT, I, places))
    if USER in out:
        _least(out, ASSISTANT, _edge(out[USER], INSERT, I, places))
    return out


class Whole:
    """Segments of one conversation, added up in order."""

    def __init__(self):
        self.done: list[str] = []
        self.best: dict[int, tuple[int, str]] = {NONE: (0, "")}

    def add(self, matrix: dict[tuple[int, int], tuple[int, str]]) -> None:
        after: dict[int, tuple[int, str]] = {}
        for (a, b), (cost, audit) in matrix.items():
            if a in self.best:
                path = self.best[a][0] + cost, self.best[a][1] + audit
                after[b] = min(after[b], path) if b in after else path
        same = os.path.commonprefix([audit for _, audit in after.values()])  # what all share is settled
        self.done.append(same)
        self.best = {state: (cost, audit[len(same) :]) for state, (cost, audit) in after.items()}

    def end(self) -> tuple[int, str]:
        cost, audit = min(self.best[state] for state in (NONE, ASSISTANT) if state in self.best)
        return cost, "".join(self.done) + audit


def edits(audit: str, rows: Iterator[tuple[str, str, int]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of what the audit keeps of rows (role, text, number) and inserts, in order."""
    state, at = NONE, 0

    def written() -> tuple[str, str, str]:
        nonlocal state
        state = NEXT[state]
        return "I", NAME[state], ""

    for role, text, n in rows:
        for copy in range(n):
            while audit[at] == "I":
                yield written()
                at += 1
            letter, at = audit[at], at + 1
            if letter == "R":
                yield "R", written()[1], text
            elif letter == "K":
                state = FOLLOWS[role[:1]][state]
                yield "K", role, text
            if copy == 0 and n > 1 and audit.startswith("D" * (n - 1), at):  # copies stand together
                at += n - 1
                break
    while at < len(audit):
        yield written()
        at += 1


# --- a conversation's rows in Spark -----------------------------------------------------------------------------------

_STATS = ["rows", "first", "last", "illegal", "blank", "duplicate", "truncated", "low", "high", "turns"]


def stats(rows: list[dict]) -> dict:
    """Counts of consecutive rows of one conversation, in order; ``joined`` adds those of neighbours."""
    out = None
    for r in rows:
        n, initial, fault, turn = r["n"], r["initial"], r["fault"], r["turn"]
        copies = n if fault == BLANK else n - (fault != DUPLICATE)
        one = {
            "rows": n, "first": initial, "last": initial, "illegal": n - 1, "blank": copies if fault == BLANK else 0,
            "duplicate": copies if fault != BLANK else 0, "truncated": int(fault == CUT), "low": turn, "high": turn, "turns": int(turn is not None),
        }
        out = one if out is None else joined(out, one)
    return out


def joined(a: dict, b: dict) -> dict:
    sums = {k: a[k] + b[k] for k in ("rows", "illegal", "blank", "duplicate", "truncated", "turns")}
    sums["illegal"] += a["last"] + b["first"] not in LEGAL
    sums["turns"] -= a["high"] is not None and a["high"] == b["low"]
    low, high = (a["low"] if a["low"] is not None else b["low"]), (b["high"] if b["high"] is not None else a["high"])
    return sums | {"first": a["first"], "last": b["last"], "low": low, "high": high}


def _symbols(rows: list[dict]) -> tuple[tuple[str, int, int], ...]:
    return tuple((r["initial"] if r["initial"] in FOLLOWS else "", r["fault"], r["n"]) for r in rows)


def _digest(found: Iterator[tuple[str, str, str]]) -> str:
    h, first = hashlib.sha256(), True
    for _, role, text in found:
        h.update(f"{'' if first else chr(10)}{role}:{text}".encode())
        first = False
    return h.hexdigest()


_RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _result(s: dict, cost: int) -> dict:
    gaps = 0 if s["low"] is None else s["high"] - s["low"] + 1 - s["turns"]
    return {"gaps": gaps, "cost": cost} | {k: s[k] for k in _RESULT[1:-1]}


def _prepared(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conv_id, turn, role, text, n (equal rows are one), stored; the same with initial and fault."""
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    hashes = [F.xxhash64("role", "text").alias("h0"), F.xxhash64("text", F.lit(1), "role").alias("h1")]
    rows = stored(rows.select("*", *hashes), "turns")
    seen = rows.groupBy("conv_id", "h0", "h1").agg(F.count("*").alias("c"), F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("earliest")).where("c > 1")
    seen = seen.select(F.col("conv_id").alias("c"), F.col("h0").alias("g0"), F.col("h1").alias("g1"), F.col("earliest.turn").alias("first_turn"))
    seen = stored(seen, "seen")
    side = F.broadcast(seen) if small_enough(seen) else seen
    same = rows["conv_id"].eqNullSafe(side["c"]) & (rows["h0"] == side["g0"]) & (rows["h1"] == side["g1"])
    marked = rows.join(side, same, "left")
    again = F.col("g0").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first_turn"))
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK).when(again, DUPLICATE)
    fault = fault.when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), CUT).otherwise(FINE)
    return rows, marked.select("conv_id", "turn", "role", "text", "n", F.substring("role", 1, 1).alias("initial"), fault.cast("int").alias("fault"))


_ORDER = ["conv_id", "turn", "role", "text"]
_ALL = (NONE, SYSTEM, USER, ASSISTANT)
_PLACES = [(a, b) for a in _ALL for b in _ALL]


def _repair(turns: DataFrame, write: bool) -> DataFrame:
    """One row a conversation, or (``write``) one a kept or inserted turn."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    rows, marked = _prepared(turns)
    stat_types = {"first": "string", "last": "string"}
    segment_sql = ", ".join([f"{c} {stat_types.get(c, 'bigint')}" for c in _STATS] + ["costs array<bigint>", "audits array<string>"])
    written = "place bigint, edit string, role string, text string"
    result = written if write else "gaps bigint, cost bigint, audit string, repaired_sha256 string"  # other counts are a segment's as well
    schema = f"conv_id {kind}, segment bigint, {segment_sql}, {result}"
    names = [c.split()[0] for c in schema.split(", ")]
    arrow: dict[str, pa.DataType] = {"bigint": pa.int64(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    types = [arrow.get(c.split()[1]) for c in schema.split(", ")]

    def batch(out: list[dict], conv_type: pa.DataType) -> pa.RecordBatch:
        cols = [pa.array([r.get(c) for r in out], t or conv_type) for c, t in zip(names, types)]
        return pa.RecordBatch.from_arrays(cols, names=names)

    def ended(conv, s: dict, cost: int, audit: str, kept: Iterator[tuple[str, str, int]]) -> Iterator[dict]:
        found = edits(audit, kept)
        if write:
            for place, (edit, role, text) in enumerate(found):
                yield {"conv_id": conv, "place": place, "edit": edit, "role": role, "text": text}
        else:
            yield {"conv_id": conv, "audit": audit, "repaired_sha256": _digest(found)} | _result(s, cost)

    def gathered(found: Iterator[dict], conv_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for r in found:
            out.append(r)
            size += 100 + len(r.get("text") or "") + len(r.get("audit") or "") + 4 * len((r.get("audits") or [""])[0] or "")
            if size > TEXT:
                yield batch(out, conv_type)
                out, size = [], 0
        if out:
            yield batch(out, conv_type)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for values in zip(*(c.to_pylist() for c in b.columns)):
                yield dict(zip(b.schema.names, values))

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Conversations that lie within this task, finished; segments of the others."""
        at, held, cut = TaskContext.get().partitionId() << 33, [], True  # cut: the conversation may have other segments

        def segment() -> dict:
            nonlocal at
            at += 1
            found = paths(_symbols(held), _ALL)
            costs, audits = zip(*(found.get(place, (None, None)) for place in _PLACES))
            return {"conv_id": held[0]["conv_id"], "segment": at, "costs": costs, "audits": audits} | stats(held)

        def close() -> Iterator[dict]:
            if held and cut:
                yield segment()
            elif held:
                cost, audit = min(v for (_, end), v in paths(_symbols(held), (NONE,)).items() if end in (NONE, ASSISTANT))
                yield from ended(held[0]["conv_id"], stats(held), cost, audit, ((x["role"], x["text"], x["n"]) for x in held))

        def run(rows_of: Iterator[dict]) -> Iterator[dict]:
            nonlocal held, cut
            now, n, size = (), 0, 0
            for r in rows_of:
                if (r["conv_id"],) != now:
                    yield from close()
                    held, n, size, cut, now = [], 0, 0, not now, (r["conv_id"],)  # a task's first one may have begun in another
                held.append(r)
                n += r["n"]
                size += len(r["text"]) + len(r["role"])
                if n >= ROWS or size >= TEXT:
                    yield segment()
                    held, n, size, cut = [], 0, 0, True
            cut = True  # its last one may go on in another
            yield from close()

        first = next(batches, None)
        if first is not None:
            conv_type = first.column(0).type

            def every():
                yield first
                yield from batches

            yield from gathered(run(of(every())), conv_type)

    dealt = marked.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
    out = stored(dealt.mapInArrow(tidy(within), schema), "conversations")
    whole = out.where("segment is null")
    parts = out.where("segment is not null")

    # the others, by conversation: segments first, then rows
    ids = parts.select(F.col("conv_id").alias("_c")).distinct()  # two a task at most, and the long ones
    ids = F.broadcast(ids) if small_enough(ids) else ids
    again = rows.join(ids, rows["conv_id"].eqNullSafe(ids["_c"]), "left_semi").select(*_ORDER, "n")
    fields = ["segment", *_STATS, "costs", "audits"]
    empty = [F.lit(None).cast(out.schema[c].dataType).alias(c) for c in fields]
    mixed = parts.select("conv_id", *[F.lit(None).cast(t).alias(c) for c, t in (("turn", "bigint"), ("role", "string"), ("text", "string"), ("n", "bigint"))], *fields)
    mixed = mixed.unionByName(again.select(*_ORDER, "n", *empty)).withColumn("is_row", F.col("segment").isNull())
    mixed = mixed.repartition("conv_id").sortWithinPartitions("conv_id", "is_row", "segment", "turn", "role", "text")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return

        def every():
            yield first
            yield from batches

        def run() -> Iterator[dict]:
            rows_of = of(every())
            r = next(rows_of, None)
            while r is not None:
                conv, s, total = r["conv_id"], None, Whole()
                while r is not None and not r["is_row"]:
                    total.add({p: (c, a) for p, c, a in zip(_PLACES, r["costs"], r["audits"]) if c is not None})
                    s = r if s is None else joined(s, r)
                    r = next(rows_of, None)

                def kept():
                    nonlocal r
                    while r is not None and r["is_row"] and r["conv_id"] == conv:
                        row, r = r, next(rows_of, None)
                        yield row["role"], row["text"], row["n"]

                yield from ended(conv, s, *total.end(), kept())

        yield from gathered(run(), first.column(0).type)

    rest = mixed.mapInArrow(tidy(across), schema)
    columns = ["conv_id", *([c.split()[0] for c in written.split(", ")] if write else [*_RESULT, "audit", "repaired_sha256"])]
    return whole.select(*columns).unionByName(rest.select(*columns))


def repair(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 (`role:text` of the repaired turns,
    joined by newlines) of every conversation of ``turns`` (conv_id, turn, role, text)."""
    return _repair(turns, False)


def repaired_turns(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 0), edit (K, R or I), role, text: the repaired conversations themselves."""
    return _repair(turns, True)


def with_ids(repaired: DataFrame, ids: DataFrame) -> DataFrame:
    """``repair``'s rows for all conv_id of ``ids``; one without rows has zeros, no edits and no text."""
    ids = ids.select(F.col("conv_id").alias("_c")).distinct()
    none = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()} | {c: 0 for c in _RESULT}
    out = ids.join(repaired, ids["_c"].eqNullSafe(repaired["conv_id"]), "left")
    return out.select(F.col("_c").alias("conv_id"), *[F.coalesce(F.col(c), F.lit(none[c])).alias(c) for c in repaired.columns if c != "conv_id"])
