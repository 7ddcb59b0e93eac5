"""Conversation repair against a search over every edit and a plain damage of the given turns."""

import collections
import hashlib
import heapq
import os
import random
import zlib

import pytest

from wayfare.llm import queries
from wayfare.llm import turn_repair as R

SF = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")
SCHEMA = "conv_id long, turn long, role string, text string, audit string, cost int"
BLANK = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """Least (cost, audit, repaired rows) by a search in order of cost and audit; rows: (role, text, fault)."""
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, kept = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return cost, audit, kept
        for role in ("user", "assistant"):
            if role[0] in after[last]:
                heapq.heappush(heap, (cost + 5, audit + "I", i, role[0], (*kept, (role, ""))))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, last, kept))
            if fault in (None, "truncated"):
                extra = 5 * (fault is not None)
                if role[:1] and role[:1] in after[last]:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, role[:1], (*kept, (role, text))))
                for new in ("user", "assistant"):
                    if new[0] in after[last]:
                        heapq.heappush(heap, (cost + 1 + extra, audit + "R", i + 1, new[0], (*kept, (new, text))))
    raise AssertionError


def plain(rows):
    """Report of one conversation's rows (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
    seen, marked, count = set(), [], collections.Counter()
    for _, role, text in rows:
        fault = "blank" if not text.strip(BLANK) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(BLANK)[-1] not in ".!?" else None
        seen.add((role, text))
        marked.append((role, text, fault))
        count[fault] += 1
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    cost, audit, kept = cheapest(marked)
    said = "\n".join(f"{r}:{t}" for r, t in kept)
    return gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256(said.encode()).hexdigest()


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def reported(df):
    return {r[0]: tuple(r[1:]) for r in (tuple(r[c] for c in COLUMNS) for r in df.collect())}


def made(rng, n):
    text = lambda: rng.choice(["", " \t", "one.", "two!", "three", "four? ", "five", "."])
    return [(rng.choice([None, *range(12)]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]), text()) for _ in range(n)]


@pytest.mark.parametrize("segment", [1, 3, 2048])
def test_reports_equal_a_search_over_every_edit(spark, segment):
    rng = random.Random(segment)
    rows = {c: made(rng, rng.randint(1, 14)) for c in [None, *range(60)]}
    rows[61] = [(3, "user", "copy")] * 90 + [(4, "assistant", "end.")] + [(5, "user", "copy")] * 70  # runs of copies
    rows[62] = [(i, "user" if i % 2 == 0 else "assistant", f"{i}.") for i in range(200)] + [(i, "user", "same.") for i in range(200)]
    table = [(c, *r, "x", 1) for c, some in rows.items() for r in some]
    rng.shuffle(table)
    report, repaired = R.repair(spark.createDataFrame(table, SCHEMA).repartition(7), segment=segment)
    assert reported(report) == {c: plain(some) for c, some in rows.items()}
    assert repaired.filter("text is null or role is null").count() == 0


def test_segments_join_to_the_whole():
    """Entry and exit states of segments of any length give the cheapest audit of the whole."""
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(1, 9)
        codes = "".join(rng.choice("suaoSUAOD") for _ in range(n))
        rows = [("tool" if c in "oO" else {"s": "system", "u": "user", "a": "assistant"}.get(c.lower(), "user"), "x", "blank" if c == "D" else "truncated" if c.isupper() else None) for c in codes]
        cut = sorted(rng.sample(range(1, n), min(n - 1, rng.randint(0, 3)))) if n > 1 else []
        parts = [codes[a:b] for a, b in zip([0, *cut], [*cut, n], strict=True)]
        now = {0: (0, "")}
        for p in parts:
            cost, rank = R._summary(p, False)
            for e in range(4):
                texts = [(rank[4 * e + x], R._audit(p, e, x)) for x in range(4) if cost[4 * e + x] >= 0]
                assert all((a[0] < b[0]) == (a[1] < b[1]) for a in texts for b in texts)
            now = {x: min((v[0] + cost[4 * e + x], v[1] + R._audit(p, e, x)) for e, v in now.items() if cost[4 * e + x] >= 0) for x in range(4) if any(cost[4 * e + x] >= 0 for e in now)}
        got = min((v[0] + c, v[1] + s) for v, c, s in ((now[x], *end) for x, end in {0: (0, ""), 1: (10, "II"), 2: (5, "I"), 3: (0, "")}.items() if x in now))
        assert got == cheapest(rows)[:2], codes


def test_prefix_order_with_and_without_collisions(monkeypatch):
    rng = random.Random(7)
    for base in (R.BASE, 0):  # with base 0 the hash is that of the last letter: nearly all collide
        monkeypatch.setattr(R, "BASE", base)
        trails, nodes = R.Trails(), [0]
        for _ in range(400):
            nodes.append(trails.add(rng.choice(nodes[-40:]), rng.choice("DK")))
        for _ in range(3000):
            a, b = rng.choice(nodes), rng.choice(nodes)
            x, y = trails.text(a), trails.text(b)
            assert trails.order(a, b) == (x > y) - (x < y)
            assert trails.shared(a, b) == len(os.path.commonprefix([x, y]))


def test_no_rows(spark):
    report, repaired = R.repair(spark.createDataFrame([], SCHEMA))
    assert report.count() == 0 and repaired.count() == 0


@given
def test_query_over_the_given_conversations(spark):
    rows, every = collections.defaultdict(list), set()
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        every.add(r.conv_id)
        kind = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        text = "" if kind == 1 else r.text.translate({ord(c): None for c in ".!?"}) if kind == 2 else r.text
        rows[r.conv_id] += [(r.turn, "user" if kind == 4 else r.role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert reported(queries.op11_turn_repair(spark, SF)) == {c: plain(rows[c]) if rows[c] else nothing for c in every}
