"""Repair of conversations: the cheapest edits that leave turns in a legal order.

A legal conversation is empty, or an optional system turn and then pairs of user and assistant.
Each turn is kept (0), given the role user or assistant (1) or deleted (2, required for a blank
turn or one said before); an empty user or assistant turn may be inserted anywhere (5); a
truncated turn that stays costs 5 more. Edits are written K, R, D, I in order; among the cheapest
the least in ASCII counts.

The audit is a dynamic programme over four states (nothing yet, after system, after user, after
assistant). Its edit prefixes share linked nodes with ancestors at powers of two and a rolling
hash, so that a tie is settled by a search for the longest common prefix; prefixes that the
hashes call equal are read again letter by letter, once. An insertion stands directly before a
turn that stays, or at the end, for behind a deletion it is never later in ASCII. Hence two
prefixes over the same turns are equal or differ within both.

A conversation of any length is spread over tasks: turns are sorted by range and cut into
segments of at most SEGMENT turns; a segment is solved from each state it may be entered in, and
keeps costs and the order of its audits. One narrow row a segment is joined up in order to choose
the states, then every segment writes its own edits. Copies of a row are counted before they are
moved. Only the digest of a conversation, which is sequential by nature, streams its repaired
text through one task, in bounded memory.

Defined cases. Null role and text are one space. Turns run in order, nulls first; rows of one turn
by role, then by MD5 of the text; equal rows are adjacent and all but the first are duplicates.
Turns are whole numbers; a conv_id may be of any type, and null is a conversation of its own.
Texts of any length are only hashed and looked at from the end. An empty table gives no rows.
Other columns, whatever their names, play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cmp_to_key, lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfare.llm.common import BLANKS, digest
from wayfare.scratch import write_table

#: Turns of a segment, and copies of a row that a segment spells out (more end it as a run).
SEGMENT, COPIES = 2048, 64
LEGAL = {"su", "ua", "au"}
START, SYSTEM, USER, ASSISTANT = range(4)
BASE, PRIME = 911_382_323, 2**61 - 1


class Trails:
    """Strings as nodes linked to their prefix."""

    def __init__(self):
        self.up: list[list[int]] = [[]]
        self.letter, self.depth, self.hash = [""], [0], [0]
        self.equal: set[tuple[int, int]] = set()

    def add(self, node: int, letters: str) -> int:
        for c in letters:
            ups = [node]
            while len(self.up[ups[-1]]) >= len(ups):
                ups.append(self.up[ups[-1]][len(ups) - 1])
            self.up.append(ups)
            self.letter.append(c)
            self.depth.append(self.depth[node] + 1)
            self.hash.append((self.hash[node] * BASE + ord(c)) % PRIME)
            node = len(self.up) - 1
        return node

    def lift(self, node: int, steps: int) -> int:
        while steps:
            k = steps.bit_length() - 1
            node = self.up[node][k]
            steps -= 1 << k
        return node

    def verified(self, a: int, b: int) -> int:
        """How many letters from the end of two prefixes of one depth must go until they are equal."""
        seen, cut, step = [], 0, 0
        while a != b and (a, b) not in self.equal:
            step += 1
            if self.letter[a] == self.letter[b]:
                seen.append((a, b))
            else:
                cut, seen = step, []
            a, b = self.up[a][0], self.up[b][0]
        self.equal.update(seen)
        return cut

    def shared(self, a: int, b: int) -> int:
        """Length of the longest common prefix."""
        depth = min(self.depth[a], self.depth[b])
        a, b = self.lift(a, self.depth[a] - depth), self.lift(b, self.depth[b] - depth)
        if self.hash[a] != self.hash[b]:
            for k in range(len(self.up[a]) - 1, -1, -1):
                if k < len(self.up[a]) and self.hash[self.up[a][k]] != self.hash[self.up[b][k]]:
                    a, b = self.up[a][k], self.up[b][k]
            a, b = self.up[a][0], self.up[b][0]
        return self.depth[a] - self.verified(a, b)

    def order(self, a: int, b: int) -> int:
        """-1, 0 or 1 as the string of a is before, equal to or after that of b."""
        if a == b:
            return 0
        n, da, db = self.shared(a, b), self.depth[a], self.depth[b]
        if n in (da, db):
            return (da > db) - (da < db)
        x, y = (self.letter[self.lift(v, d - n - 1)] for v, d in ((a, da), (b, db)))
        return (x > y) - (x < y)

    def text(self, node: int) -> str:
        letters = []
        while node:
            letters.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(letters))


Way = tuple[int, int]  # cost and node


def _best(trails: Trails, choices: list[tuple[int, int, str]]) -> tuple[int, int, str] | None:
    """The least (cost, node, letters) by cost, then by the string."""
    best = None
    for c in choices:
        if best is None or c[0] < best[0]:
            best = c
        elif c[0] == best[0]:
            side = trails.order(c[1], best[1])
            if side < 0 or side == 0 and c[2] < best[2]:
                best = c
    return best


def solve(codes: str, entry: int, trails: Trails) -> list[Way | None]:
    """Cheapest way to each state over turns entered in one state.

    codes: a letter a turn: the initial of its role (o for any other), upper case where the turn
    is truncated, or D where it must go.
    """
    ways: list[Way | None] = [None] * 4
    ways[entry] = (0, 0)
    for c in codes:
        if c == "D":
            ways = [w and (w[0] + 2, trails.add(w[1], "D")) for w in ways]
            continue
        extra, role = 5 * c.isupper(), c.lower()
        choices: list[list[tuple[int, int, str]]] = [[(w[0] + 2, w[1], "D")] if w else [] for w in ways]
        if role == "s" and ways[START]:
            choices[SYSTEM].append((ways[START][0] + extra, ways[START][1], "K"))
        for to, own in ((USER, "u"), (ASSISTANT, "a")):
            op, cost = ("K", extra) if role == own else ("R", extra + 1)
            for state, w in enumerate(ways):
                if w:
                    next_ = (state == USER) == (to == ASSISTANT)  # else the other role is inserted first
                    choices[to].append((w[0] + cost, w[1], op) if next_ else (w[0] + cost + 5, w[1], "I" + op))
        chosen = [_best(trails, x) for x in choices]
        ways = [b and (b[0], trails.add(b[1], b[2])) for b in chosen]
    return ways


@lru_cache(4096)
def _summary(codes: str, opens: bool) -> tuple[list[int], list[int]]:
    """Cost (-1: no way) and rank among the audits, for entry * 4 + exit."""
    trails = Trails()
    ways = [w for e in range(4) for w in (solve(codes, e, trails) if e == START or not opens else [None] * 4)]
    rank, last = {}, None
    for node in sorted({w[1] for w in ways if w}, key=cmp_to_key(trails.order)):
        rank[node] = 0 if last is None else rank[last] + (trails.order(last, node) != 0)
        last = node
    return [w[0] if w else -1 for w in ways], [rank[w[1]] if w else -1 for w in ways]


@lru_cache(4096)
def _audit(codes: str, entry: int, exit_: int) -> str:
    trails = Trails()
    return trails.text(solve(codes, entry, trails)[exit_][1])


_SEGMENT = "segment long, turns array<long>, roles array<string>, digests array<binary>, codes string, run long, n_turns long, blank long, duplicate long, truncated long, illegal long, low long, high long, last_turn long, first_initial string, last_initial string, cost array<long>, rank array<int>"


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _segments(schema: T.StructType, most: int):
    """Sorted turns to segments."""

    def made(conv, number: int, opens: bool, rows: list[tuple], run: int) -> tuple:
        codes, turns, roles, digests, counts, illegal = [], [], [], [], [0, 0, 0, 0], 0
        for turn, role, key, copies, fault in rows:
            spelt = 1 if copies - 1 > COPIES else copies
            first = role[:1] if role[:1] in ("s", "u", "a") else "o"
            codes.append(("D" if fault in (1, 2) else first.upper() if fault == 3 else first) + "D" * (spelt - 1))
            illegal += (roles[-1][:1] + role[:1] not in LEGAL if roles else 0) + copies - 1
            turns += [turn] * spelt
            roles += [role] * spelt
            digests += [key] * spelt
            counts[fault] += 1
            counts[1 if fault == 1 else 2] += copies - 1
        said, known = "".join(codes), [t for t in turns if t is not None]
        cost, rank = _summary(said, opens)
        return (
            conv, number, turns, roles, digests, said, run, len(set(known)), *counts[1:], illegal,
            known[0] if known else None, known[-1] if known else None, turns[-1], roles[0][:1], roles[-1][:1], cost, rank,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, base, number = _arrow(schema), TaskContext.get().partitionId() << 40, 0
        held, conv, opens, out, seen = [], None, False, [], False

        def end(copies: int) -> None:
            nonlocal number, held
            out.append(made(conv, base + number, opens, held, copies))
            number += 1
            held = []

        def batch_of() -> pa.RecordBatch:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), shape, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, schema=shape)

        for batch in batches:
            for c, *row in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "turn", "role", "digest", "copies", "fault")), strict=True):
                if c != conv or not seen:
                    if held:
                        end(0)
                    conv, opens, seen = c, seen, True  # the first of a task may be another task's conversation
                held.append(tuple(row))
                if len(held) >= most or row[3] - 1 > COPIES:
                    end(row[3] - 1 if row[3] - 1 > COPIES else 0)
                    opens = False
                if len(out) >= 1000:
                    yield batch_of()
        if held:
            end(0)
        if out:
            yield batch_of()

    return run


def _choices(schema: T.StructType):
    """Narrow rows of segments, in order, to the states each is entered and left in; totals stand in the first."""

    def chosen(conv, rows: list[dict]) -> Iterator[tuple]:
        now, back = {START: (0, 0)}, []  # cost and rank of the audit so far
        total = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "n_turns"), 0)
        low = high = None
        for i, r in enumerate(rows):
            ways = {}
            for exit_ in range(4):
                some = [(v[0] + r["cost"][4 * s + exit_], v[1], r["rank"][4 * s + exit_], s) for s, v in now.items() if r["cost"][4 * s + exit_] >= 0]
                if some:
                    ways[exit_] = min(some)
            order = {x: k for k, x in enumerate(sorted({w[1:3] for w in ways.values()}))}
            back.append({x: w[3] for x, w in ways.items()})
            now = {x: (w[0] + 2 * r["run"], order[w[1:3]]) for x, w in ways.items()}
            for k in total:
                total[k] += r[k]
            before = rows[i - 1] if i else None
            if before:
                total["illegal"] += before["last_initial"] + r["first_initial"] not in LEGAL
                total["n_turns"] -= before["last_turn"] is not None and before["last_turn"] == r["low"]
            low, high = r["low"] if low is None else low, r["high"] if r["high"] is not None else high
        ends = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
        cost, _, close, exit_ = min((v[0] + 5 * len(ends[s]), v[1], ends[s], s) for s, v in now.items())
        gaps = 0 if low is None else high - low + 1 - total.pop("n_turns")
        total.pop("n_turns", None)
        path = []
        for r, step in zip(reversed(rows), reversed(back), strict=True):
            path.append((r["segment"], step[exit_], exit_))
            exit_ = step[exit_]
        for i, (segment, entry, left) in enumerate(reversed(path)):
            mine = (gaps, *total.values(), cost) if not i else [None] * 6
            yield conv, segment, i, entry, left, close if i == len(path) - 1 else "", *mine

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, conv, held, out = _arrow(schema), None, [], []
        for batch in batches:
            for r in batch.to_pylist():
                if held and r["conv_id"] != conv:
                    out += chosen(conv, held)
                    held = []
                conv = r["conv_id"]
                held.append(r)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), shape, strict=True)], schema=shape)
                out = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*chosen(conv, held), strict=True), shape, strict=True)], schema=shape)

    return run


def _edits(schema: T.StructType):
    """Segments with their states to a row with the audit (place -1) and one for each turn that stays."""

    def rows(r: dict) -> Iterator[tuple]:
        audit = _audit(r["codes"], r["entry"], r["left"])
        yield r["conv_id"], r["ordinal"], -1, None, None, None, None, audit + "D" * r["run"] + r["close"]
        state, at, place = r["entry"], -1, 0
        for letter in audit + r["close"]:
            at += letter != "I"
            if letter == "D":
                continue
            if letter == "K" and r["roles"][at][:1] == "s":
                state = SYSTEM
            else:
                state = ASSISTANT if state == USER else USER
            role = r["roles"][at] if letter == "K" else "user" if state == USER else "assistant"
            said = (r["turns"][at], r["roles"][at], r["digests"][at]) if letter != "I" else (None, None, None)
            yield r["conv_id"], r["ordinal"], place, role, *said, None
            place += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = _arrow(schema)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                out = [x for r in batch.slice(i, 256).to_pylist() for x in rows(r)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), shape, strict=True)], schema=shape)

    return run


def _digests(schema: T.StructType):
    """Edits in order to each conversation's whole audit and the digest of its repaired turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, conv, audit, sha, lines, seen, out = _arrow(schema), None, [], None, 0, False, []

        def done() -> None:
            out.append((conv, "".join(audit), sha.hexdigest()))

        for batch in batches:
            for c, piece, role, text in zip(*(batch.column(x) for x in ("conv_id", "audit", "role", "text")), strict=True):
                c = c.as_py()
                if not seen or c != conv:
                    if seen:
                        done()
                    conv, audit, sha, lines, seen = c, [], hashlib.sha256(), 0, True
                if role.is_valid:
                    sha.update(("\n" if lines else "").encode() + f"{role.as_py()}:{text.as_py() or ''}".encode())
                    lines += 1
                else:
                    audit.append(piece.as_py())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), shape, strict=True)], schema=shape)
                out.clear()
        if seen:
            done()
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), shape, strict=True)], schema=shape)

    return run


def _join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which nulls are equal; the keys of the left side stay."""
    right = right.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return left.join(right, on, how).drop(*(f"_of_{k}" for k in keys))


def repair(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """(report, repaired).

    report: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 (of
    role:text, joined by newlines). repaired: conv_id, ordinal, place, role, text, in the order of
    ordinal and place.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), said(role).alias("role"), said(text).alias("text"))
    rows = rows.withColumn("digest", digest(F.col("text")))
    last = F.right(F.rtrim(F.col("text"), F.lit(BLANKS)), F.lit(1))
    narrow = rows.select("conv_id", "turn", "role", "digest", (last == "").alias("blank"), (~last.isin(*".!?")).alias("cut"))
    counted = write_table(narrow.groupBy("conv_id", "turn", "role", "digest", "blank", "cut").agg(F.count("*").alias("copies")), "turn-rows")
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = counted.filter("not blank").groupBy("conv_id", "role", "digest").agg(F.count("*").alias("times"), F.min(place).alias("first")).filter("times > 1")
    marked = _join(counted, first, ["conv_id", "role", "digest"], "left").select(
        "conv_id", "turn", "role", "digest", "copies",
        F.when(F.col("blank"), 1).when(place > F.col("first"), 2).when(F.col("cut"), 3).otherwise(0).alias("fault"),
    )
    order = ["conv_id", "turn", "role", "digest"]
    conv = T.StructField("conv_id", rows.schema["conv_id"].dataType)
    kinds = lambda ddl: T.StructType([conv, *T.StructType.fromDDL(ddl).fields])
    shape = kinds(_SEGMENT)
    segments = write_table(marked.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_segments(shape, segment), shape), "turn-segments")
    at = [F.get(c, F.lit(0)).alias(f"at_{c}") for c in ("turns", "roles", "digests")]
    short = segments.select("conv_id", "segment", "run", "n_turns", "blank", "duplicate", "truncated", "illegal", "low", "high", "last_turn", "first_initial", "last_initial", "cost", "rank", *at)
    short = short.repartition("conv_id").sortWithinPartitions("conv_id", "at_turns", "at_roles", "at_digests")
    shape = kinds("segment long, ordinal long, entry int, left int, close string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long")
    chosen = write_table(short.mapInArrow(_choices(shape), shape), "turn-choices")
    states = segments.select("conv_id", "segment", "turns", "roles", "digests", "codes", "run").join(chosen.select("segment", "ordinal", "entry", "left", "close"), "segment")
    shape = kinds("ordinal long, place long, role string, turn long, was string, digest binary, audit string")
    edits = write_table(states.mapInArrow(_edits(shape), shape), "turn-edits")
    kept = edits.filter("digest is not null").select("conv_id", "turn", F.col("was").alias("role"), "digest", "ordinal", "place", F.col("role").alias("new_role"))
    # any copy of a row has its text
    found = _join(kept, rows, order).select("conv_id", "ordinal", "place", F.col("new_role").alias("role"), "text").dropDuplicates(["conv_id", "ordinal", "place"])
    empty = edits.filter("digest is null and role is not null").select("conv_id", "ordinal", "place", "role", F.lit("").alias("text"))
    repaired = found.unionByName(empty)
    stream = repaired.withColumn("audit", F.lit(None).cast("string")).unionByName(edits.filter("role is null").select("conv_id", "ordinal", "place", "audit", "role", F.lit(None).cast("string").alias("text")))
    shape = kinds("audit string, repaired_sha256 string")
    whole = stream.repartition("conv_id").sortWithinPartitions("conv_id", "ordinal", "place").mapInArrow(_digests(shape), shape)
    totals = chosen.filter("ordinal = 0").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return _join(totals, whole, ["conv_id"]), repaired
