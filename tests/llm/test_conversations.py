"""Repair against a search over all edits, cheapest first and least audit first."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from receiptlake.llm import conversations
from receiptlake.llm.common import table

FOLLOWS = {"": "su", "s": "u", "u": "a", "a": "u"}
ROLES = {"u": "user", "a": "assistant"}


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        last = re.findall(r"[^ \t-\r]", text)
        fault = "" if last else "blank"
        if not fault and (role, text) in seen:
            fault = "duplicate"
        if not fault and last[-1] not in ".!?":
            fault = "truncated"
        out.append(fault)
        seen.add((role, text))
    return out


def searched(rows, faults):
    """Cost, audit and repaired lines."""
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return cost, audit, lines
        if (i, state) in done:
            continue
        done.add((i, state))
        for to in set(FOLLOWS[state]) & set(ROLES):
            heapq.heappush(heap, (cost + 2, audit + "I", i, to, (*lines, ROLES[to] + ":")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, lines))
            if faults[i] in ("", "truncated"):
                more = cost + (faults[i] == "truncated")
                if role[:1] and role[0] in FOLLOWS[state]:
                    heapq.heappush(heap, (more, audit + "K", i + 1, role[0], (*lines, f"{role}:{text}")))
                for to in set(FOLLOWS[state]) & set(ROLES):
                    heapq.heappush(heap, (more + 2, audit + "R", i + 1, to, (*lines, f"{ROLES[to]}:{text}")))


def plain(rows):
    """conv_id to the row that repair gives."""
    kept = {}
    for conv, turn, role, text in rows:
        own = kept.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        own += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = {}
    for conv, own in kept.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        faults = faults_of(own)
        cost, audit, lines = searched(own, faults)
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        count = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def repaired(df, **sizes):
    rows = conversations.repair(df, **sizes).collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r)[1:] for r in rows}


SHAPE = "conv_id long, turn long, role string, text string"


def frame(spark, rows):
    df = spark.createDataFrame(rows, SHAPE)
    names = "conv part number kinds hash times cost audit start c t kind gone"
    return df.selectExpr("*", *[f"1 AS {n}" for n in names.split()])


@pytest.mark.parametrize("sf", ["sf_small", "sf_dir"])
def test_tables(spark, request, sf):
    df = table(spark, request.getfixturevalue(sf), "conversations")
    want = plain([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()])
    assert repaired(df) == want
    assert sum(w[-2].count("I") for w in want.values()) and sum(w[-2].count("R") for w in want.values())


def odd_rows(seed, count, conversations=8, turns=40):
    rng = random.Random(seed)
    return [
        (
            rng.choice([None, *range(conversations)]),
            rng.choice([None, *range(turns)]),
            rng.choice([None, "", "user", "assistant", "system", "tool", "user", "assistant", "assist"]),
            rng.choice([None, "", " ", "Hi.", "Hi", "Yes!\n", "no no ", "b?", "é.\t", "." * 30]),
        )
        for _ in range(count)
    ]


@pytest.mark.parametrize("size, per_partition", [(1, 10), (3, 40), (7, 50), (1024, 200_000)])
def test_odd_rows_in_blocks_of_all_sizes(spark, size, per_partition):
    """Long conversations in many blocks and partitions, all but the first row of some gone."""
    rows = odd_rows(size, 500) + [(99, n, "user", "Same.") for n in range(60)] + [(98, 5, "user", "Same.")] * 70
    rows += [(97, n, ("user", "assistant")[n % 2], f"Text {n}.") for n in range(300)]
    want = plain(rows)
    assert repaired(frame(spark, rows), size=size, rows_per_partition=per_partition) == want


def test_single_and_short_conversations(spark):
    rng = random.Random(3)
    rows = []
    for conv in range(600):
        for turn in range(rng.randint(1, 5)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["a.", "b", "c!", ""])))
    assert repaired(frame(spark, rows)) == plain(rows)


def test_none(spark):
    assert repaired(frame(spark, [])) == {}
    gone = next(n for n in range(1000) if zlib.crc32(f"{n}:0".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert repaired(frame(spark, [(gone, 0, "user", "x.")])) == {gone: (0, 0, 0, 0, 0, 0, "", empty)}


def test_far_turns(spark):
    rows = [(1, -(2**63), "user", "a."), (1, 2**63 - 1, "assistant", "b."), (2, None, "user", "x" * 300_000 + ".")]
    got = repaired(frame(spark, rows))
    want = plain(rows)
    assert got[2] == want[2] and got[1][1:] == want[1][1:] and got[1][0] == min(want[1][0], 2**63 - 1)


def test_splitting_equals_reading_from_the_left():
    """Crossings against the least of all paths, for short runs of kinds."""
    rng = random.Random(5)
    for _ in range(300):
        kinds = [rng.choice("suaoSUAOd") for _ in range(rng.randint(1, 7))]
        best = {(0, ""): 0}
        for kind in kinds:
            nxt = {}
            for (state, audit), cost in best.items():
                for (a, b), (c, text) in conversations.KINDS[kind].items():
                    if a == state:
                        key = b, audit + text
                        nxt[key] = min(nxt.get(key, conversations.INF), cost + c)
            best = nxt
        whole = conversations.combined([conversations.UNITS[k] for k in kinds])
        for end in range(4):
            options = sorted((c, t) for (s, t), c in best.items() if s == end)
            if options:
                assert whole.cost[0][end] == options[0][0]
                assert "".join(conversations.audits("".join(kinds), 0, end)) == options[0][1]
