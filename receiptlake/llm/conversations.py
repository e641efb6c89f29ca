"""Conversation structure repair by Hirschberg divide and conquer.

The rows of a conversation are read by an automaton of four states (nothing yet, a system
row, a user row, an assistant row) whose edges are the edits: keep, rerole, delete, insert.
Forward and backward cost vectors of these states meet in the middle of the rows; the
crossing of least cost, and among those the one whose audit is least, splits the work in
two, down to single rows, so no table of rows by states is kept. An audit's first part ends
with the edit of a row, so none is the beginning of another, and their order is carried as
ranks beside the costs.

What a row does to the four states is a table of four by four costs and ranks, and so is
what a block of rows does. Hence a conversation of any length is cut into blocks of rows
that follow each other (by a range partitioning, which splits a conversation that holds a
third of all rows), the blocks' tables are made where the blocks are, crossings are found
between blocks in the same way as between rows, over groups of blocks of bounded size, and
then every block repairs itself. Rows that are alike are counted before they are shuffled;
texts travel only for the rows that stay. Only the hash of the repaired text is sequential
by nature: its pieces stream through the task that has the conversation, one batch at a
time, and so does the audit, a letter for each row, since a conversation gives one row.

Nulls: a null role or text is one space, and so is a null id or turn where it is hashed for
the damage; a null id is a conversation of its own, null turns come first. Rows of the same
turn go by role, then by the text's SHA-256; repeated rows are duplicates. A role other than
those that begin with s, u or a, the empty one included, cannot be kept. Empty tables stay
empty. Other input columns are ignored.
"""

import hashlib
from collections.abc import Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from receiptlake.llm.common import cut, short_batches

# Rows of a block; rows (alike ones count once) of a partition of blocks, and the partitions
# from which on these grow instead.
BLOCK = 1024
ROWS_PER_PARTITION = 10_000
MOST_PARTITIONS = 20_000

INF = 1 << 60
# What edits cost, and what a truncated row adds that stays.
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1

# States: 0 nothing yet, 1 system, 2 user, 3 assistant. What may come next in each, and what
# is missing at the end.
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
INSERTED = {0: 2, 1: 2, 2: 3, 3: 2}
ENDING = ("", "II", "I", "")
ROLES = {2: "user", 3: "assistant"}


def row_paths(initial: str, cut_off: bool, gone: bool) -> dict[tuple[int, int], tuple[int, str]]:
    """(from, to) to the cost and the least audit of a row: inserts before it, and its edit.
    ``gone``: it has to be deleted."""
    best: dict[tuple[int, int], tuple[int, str]] = {}

    def offer(start: int, to: int, cost: int, audit: str) -> None:
        if (cost, audit) < best.get((start, to), (INF, "")):
            best[start, to] = cost, audit

    for start in range(4):
        at = start
        for inserts in range(3):  # a third one comes back to a state that had been reached
            cost, audit = inserts * INSERT, "I" * inserts
            offer(start, at, cost + DELETE, audit + "D")
            if not gone:
                stays = cost + CUT_OFF * cut_off
                if initial in NEXT[at]:
                    offer(start, NEXT[at][initial], stays + KEEP, audit + "K")
                for role in "ua":
                    if role in NEXT[at]:
                        offer(start, NEXT[at][role], stays + REROLE, audit + "R")
            at = INSERTED[at]
    return best


class Table:
    """Costs from each state to each, and the rank of the least audits from a state."""

    def __init__(self, cost: list[list[int]], rank: list[list[int]]):
        self.cost, self.rank = cost, rank

    def flat(self) -> list[int]:
        return [min(c, INF) for row in self.cost for c in row] + [r for row in self.rank for r in row]

    @staticmethod
    def of(flat) -> "Table":
        rows = [list(map(int, flat[i : i + 4])) for i in range(0, 32, 4)]
        return Table(rows[:4], rows[4:])


def _ranked(keys: list) -> list[int]:
    order = sorted(range(4), key=lambda t: keys[t])
    return [order.index(t) for t in range(4)]


# Kinds of rows are letters: s, u, a or o (another initial); a truncated row
# has a capital; d has to go.
KINDS = {k: row_paths(k.lower(), k.isupper(), k == "d") for k in "suaoSUAOd"}
UNITS = {
    kind: Table(
        [[paths.get((a, b), (INF, ""))[0] for b in range(4)] for a in range(4)],
        [_ranked([paths.get((a, b), (INF, "~"))[1] for b in range(4)]) for a in range(4)],
    )
    for kind, paths in KINDS.items()
}


def forward(cost: list[int], rank: list[int], table: Table) -> tuple[list[int], list[int]]:
    """Cost and rank of the states after an item, from those before it."""
    out, keys = [], []
    for to in range(4):
        c, r, s = min((cost[s] + table.cost[s][to], rank[s], s) for s in range(4))
        out.append(min(c, INF))
        keys.append((r, table.rank[s][to]))
    return out, _ranked(keys)


def backward(cost: list[int], table: Table) -> list[int]:
    return [min(INF, *(table.cost[s][t] + cost[t] for t in range(4))) for s in range(4)]


def start_at(state: int) -> tuple[list[int], list[int]]:
    return [0 if s == state else INF for s in range(4)], [0, 1, 2, 3]


def combined(items: list[Table]) -> Table:
    """The table of items that follow each other."""
    rows = []
    for state in range(4):
        vector = start_at(state)
        for item in items:
            vector = forward(*vector, item)
        rows.append(vector)
    return Table([r[0] for r in rows], [r[1] for r in rows])


def crossings(items: list[Table], start: int, end: int) -> list[int]:
    """The states before each item, and after the last, of the cheapest path whose audit is
    least: meet in the middle, then the same for both halves."""
    states = [start] * (len(items) + 1)
    states[-1] = end
    open_ = [(0, len(items))]
    while open_:
        i, j = open_.pop()
        if j - i < 2:
            continue
        middle = (i + j) // 2
        cost, rank = start_at(states[i])
        for item in items[i:middle]:
            cost, rank = forward(cost, rank, item)
        rest = start_at(states[j])[0]
        for item in reversed(items[middle:j]):
            rest = backward(rest, item)
        states[middle] = min(range(4), key=lambda s: (cost[s] + rest[s], rank[s]))
        open_ += [(i, middle), (middle, j)]
    return states


def last_state(table: Table) -> tuple[int, int]:
    """Where a conversation ends, and its cost with what has to be inserted there."""
    cost, rank = table.cost[0], table.rank[0]
    end = min(range(4), key=lambda s: (cost[s] + INSERT * len(ENDING[s]), rank[s]))
    return end, cost[end] + INSERT * len(ENDING[end])


def audits(kinds: str, start: int, end: int) -> list[str]:
    """The audit of each row of a block, inserts before the row's own edit."""
    states = crossings([UNITS[k] for k in kinds], start, end)
    return [KINDS[k][a, b][1] for k, a, b in zip(kinds, states, states[1:])]


def damaged(df: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Columns conv, turn, role, text, times (how often the row stands there)."""
    blank = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), blank), F.coalesce(F.col(turn_col).cast("string"), blank))
    kind = F.col("kind")
    text = F.coalesce(F.col("text"), blank)
    rows = df.select(
        F.col(id_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.col(role_col).alias("role"),
        F.col(text_col).alias("text"),
        (F.crc32(key.cast("binary")) % 20).alias("kind"),
    )
    return rows.filter(kind != 0).select(
        "conv",
        "turn",
        F.when(kind == 4, "user").otherwise(F.coalesce("role", blank)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 3, 2).otherwise(1).cast("bigint").alias("times"),
    )


def faults(rows: DataFrame) -> DataFrame:
    """Rows that are alike as one: conv, turn, role, hash, times, blank, cut_off, and again
    (role and text stood in an earlier turn)."""
    text = F.col("text")
    last = F.regexp_extract(text, r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    alike = rows.select(
        "conv",
        "turn",
        "role",
        F.unhex(F.sha2(text, 256)).alias("hash"),
        (~text.rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
        (~last.isin(".", "!", "?")).alias("cut_off"),
        "times",
    )
    alike = alike.groupBy("conv", "turn", "role", "hash", "blank", "cut_off").agg(F.sum("times").alias("times"))
    first = alike.groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("hash").alias("h")).agg(
        F.min(F.struct("turn")).alias("first")
    )
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("hash") == F.col("h"))
    again = ~F.col("turn").eqNullSafe(F.col("first.turn"))
    return alike.join(first, same).withColumn("again", again).drop("c", "r", "h", "first")


def counts(found: DataFrame) -> DataFrame:
    """Per conversation gaps, blank, duplicate, truncated."""
    times, blank, again = F.col("times"), F.col("blank"), F.col("again")
    copies = F.when(again, times).otherwise(times - 1)
    by_turn = found.groupBy("conv", "turn").agg(
        F.sum(F.when(blank, times).otherwise(0)).alias("blank"),
        F.sum(F.when(blank, 0).otherwise(copies)).alias("duplicate"),
        F.sum(F.when(F.col("cut_off") & ~blank & ~again, 1).otherwise(0)).alias("truncated"),
    )
    wide = F.col("turn").cast("decimal(20,0)")
    span = F.coalesce(F.max(wide) - F.min(wide) + 1 - F.count("turn"), F.lit(0))
    gaps = F.least(span, F.lit(2**63 - 1).cast("decimal(22,0)")).cast("bigint")  # as far as long reaches
    return by_turn.groupBy("conv").agg(
        gaps.alias("gaps"),
        *[F.sum(c).cast("bigint").alias(c) for c in ("blank", "duplicate", "truncated")],
    )


_LEGAL = {"su", "ua", "au"}


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _sent(rows: Iterator[dict], schema: pa.Schema, size: int = 200) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, size)):
        yield pa.RecordBatch.from_pylist(some, schema)


class Types:
    """The types of ids and turns, for Spark and for Arrow."""

    def __init__(self, df: DataFrame):
        self.conv, self.turn = (df.schema[c].dataType.simpleString() for c in ("conv", "turn"))

    def schema(self, shape: str) -> str:
        return shape.replace("$conv", self.conv).replace("$turn", self.turn)

    def arrow(self, shape: str) -> pa.Schema:
        kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        fields = [f.strip().split(" ", 1) for f in self.schema(shape).split(",")]
        return pa.schema([(n, pa.list_(kinds[k[6:-1]]) if k[:6] == "array<" else kinds[k]) for n, k in fields])


_BLOCKS = (
    "conv $conv, part int, number bigint, kinds string, first string, last string, illegal bigint, "
    "table array<bigint>, at array<int>, turn array<$turn>, role array<string>, hash array<binary>"
)


def blocks(found: DataFrame, size: int = BLOCK, rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """Rows in order, as blocks of at most ``size`` rows: conv, part (the partition), number,
    kinds, initials of the first and last row, illegal pairs inside, table, and of the rows
    that may stay their place in the block and their key. Number 0 is the summary of all
    blocks that the partition has of the conversation."""
    types = Types(found)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        yield from _sent(_cut_up(_streamed(batches), part, size), types.arrow(_BLOCKS))

    order = ["conv", "turn", "role", "hash", "chunk"]
    chunk = F.explode(F.sequence(F.lit(0), F.expr(f"(times - 1) div {size}")))
    chunks = found.withColumn("chunk", chunk).withColumns(
        {
            "times": F.least(F.lit(size), F.col("times") - F.col("chunk") * size),
            "gone": F.col("blank") | F.col("again") | (F.col("chunk") > 0),
        }
    )
    spread = min(max(1, -(-chunks.count() // rows_per_partition)), MOST_PARTITIONS)
    laid = chunks.repartitionByRange(spread, *order).sortWithinPartitions(*order)
    laid = laid.select("conv", "turn", "role", "hash", "times", "cut_off", "gone")
    return laid.mapInArrow(made, types.schema(_BLOCKS))


def _cut_up(rows: Iterator[dict], part: int, size: int) -> Iterator[dict]:
    for conv, own in groupby(rows, key=lambda r: (r["conv"],)):
        tables, ends, illegal, last = [], [], 0, None
        for number, block in enumerate(_blocks_of(own, size), 1):
            table = combined([UNITS[k] for k in block["kinds"]])
            tables.append(table)
            illegal += block["illegal"] + (number > 1 and last + block["first"] not in _LEGAL)
            ends.append(block["first"])
            last = block["last"]
            yield {"conv": conv[0], "part": part, "number": number, "table": table.flat(), **block}
        yield {
            "conv": conv[0], "part": part, "number": 0, "first": ends[0], "last": last,
            "illegal": illegal, "table": combined(tables).flat(),
        }


def _blocks_of(rows: Iterator[dict], size: int) -> Iterator[dict]:
    def singly():
        for row in rows:
            initial = row["role"][:1] if row["role"][:1] in ("s", "u", "a") else "o"
            stays = None if row["gone"] else row
            yield initial, "d" if row["gone"] else initial.upper() if row["cut_off"] else initial, stays
            for _ in range(row["times"] - 1):
                yield initial, "d", None

    each = singly()
    while some := list(islice(each, size)):
        initials = [i for i, _, _ in some]
        stay = [(at, row) for at, (_, _, row) in enumerate(some) if row]
        yield {
            "kinds": "".join(k for _, k, _ in some),
            "first": initials[0],
            "last": initials[-1],
            "illegal": sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:])),
            "at": [at for at, _ in stay],
            **{c: [row[c] for _, row in stay] for c in ("turn", "role", "hash")},
        }


_TOP = "conv $conv, part int, start int, end int, final int, cost bigint, illegal bigint"


def parts_crossed(made: DataFrame, types: Types) -> DataFrame:
    """Per conversation and partition the states before its first and after its last row, and
    what holds for the whole conversation: cost and illegal pairs. A conversation has at most
    one summary per partition here."""

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            for conv, own in groupby(_streamed(batches), key=lambda r: (r["conv"],)):
                own = list(own)
                tables = [Table.of(r["table"]) for r in own]
                end, cost = last_state(combined(tables))
                states = crossings(tables, 0, end)
                illegal = sum(r["illegal"] for r in own)
                illegal += sum(a["last"] + b["first"] not in _LEGAL for a, b in zip(own, own[1:]))
                for n, r in enumerate(own):
                    yield {
                        "conv": conv[0], "part": r["part"], "start": states[n], "end": states[n + 1],
                        "final": int(n + 1 == len(own)), "cost": cost, "illegal": illegal,
                    }

        yield from _sent(out(), types.arrow(_TOP))

    summaries = made.filter("number = 0").select("conv", "part", "first", "last", "illegal", "table")
    order = summaries.repartition("conv").sortWithinPartitions("conv", "part")
    return order.mapInArrow(crossed, types.schema(_TOP))


_EDITS = (
    "conv $conv, part int, number bigint, at int, audit string, turn $turn, role string, hash binary, "
    "new_role string"
)


def edits(made: DataFrame, top: DataFrame, types: Types) -> DataFrame:
    """Per block its audit (at -1), and per row that the repaired conversation has its new
    role and, unless it is inserted, its key."""

    def repaired(block: dict, tables_end: int) -> Iterator[dict]:
        state = block["from"]
        keys = dict(zip(block["at"], zip(block["turn"], block["role"], block["hash"])))
        parts = audits(block["kinds"], state, tables_end)
        if block["closes"]:
            parts.append(ENDING[tables_end])
        head = {"conv": block["conv"], "part": block["part"], "number": block["number"]}
        yield {**head, "at": -1, "audit": "".join(parts)}
        place = 0
        for at, edit in enumerate("".join(p) for p in parts):
            for letter in edit:
                line = {**head, "at": place}
                if letter == "I":
                    state = INSERTED[state]
                    line["new_role"] = ROLES[state]
                elif letter == "D":
                    continue
                else:
                    turn, role, hash_ = keys[at]
                    state = NEXT[state][role[0]] if letter == "K" else INSERTED[state]
                    line |= {"turn": turn, "role": role, "hash": hash_}
                    line["new_role"] = role if letter == "K" else ROLES[state]
                place += 1
                yield line

    def made_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            for _, own in groupby(_streamed(batches), key=lambda r: (r["conv"], r["part"])):
                own = list(own)
                states = crossings([Table.of(b["table"]) for b in own], own[0]["start"], own[0]["end"])
                for n, block in enumerate(own):
                    block |= {"from": states[n], "closes": block["final"] and n + 1 == len(own)}
                    yield from repaired(block, states[n + 1])

        yield from _sent(out(), types.arrow(_EDITS), 1000)

    states = top.select(F.col("conv").alias("c"), F.col("part").alias("p"), "start", "end", "final")
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))
    joined = made.filter("number > 0").drop("first", "last", "illegal").join(states, same).drop("c", "p")
    laid = joined.repartition("conv", "part").sortWithinPartitions("conv", "part", "number")
    return laid.mapInArrow(made_, types.schema(_EDITS))


_REPAIRED = "conv $conv, audit string, repaired_sha256 string"


def assembled(lines: DataFrame, types: Types) -> DataFrame:
    """Per conversation its audit and the hash of its repaired lines, which stream by."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            for conv, own in groupby(_streamed(batches), key=lambda r: (r["conv"],)):
                audit, digest, first = [], hashlib.sha256(), True
                for row in own:
                    if row["at"] < 0:
                        audit.append(row["audit"])
                        continue
                    digest.update(("" if first else "\n").encode() + row["line"].encode("utf-8", "surrogatepass"))
                    first = False
                yield {"conv": conv[0], "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}

        yield from _sent(out(), types.arrow(_REPAIRED))

    order = ["conv", "part", "number", "at"]
    laid = lines.select(*order, "audit", "line").repartition("conv").sortWithinPartitions(*order)
    return laid.mapInArrow(hashed, types.schema(_REPAIRED))


def repaired_lines(df: DataFrame, edit: DataFrame) -> DataFrame:
    """``edit`` with the line role:text of each row that is there after repair."""
    texts = df.select("conv", "turn", "role", F.unhex(F.sha2("text", 256)).alias("hash"), "text")
    texts = texts.dropDuplicates(["conv", "turn", "role", "hash"])
    same = (
        F.col("e.conv").eqNullSafe(F.col("t.conv"))
        & F.col("e.turn").eqNullSafe(F.col("t.turn"))
        & (F.col("e.role") == F.col("t.role"))
        & (F.col("e.hash") == F.col("t.hash"))
    )
    columns = ["e.conv", "e.part", "e.number", "e.at", "e.audit"]
    old = edit.filter("hash IS NOT NULL").alias("e").join(texts.alias("t"), same)
    old = old.select(*columns, F.concat_ws(":", "e.new_role", "t.text").alias("line"))
    new = edit.filter("hash IS NULL").alias("e")
    return old.unionAll(new.select(*columns, F.concat("e.new_role", F.lit(":")).alias("line")))


def repair(
    df: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    **sizes: int,
) -> DataFrame:
    """The damaged rows of ``df`` repaired: one row per original ``id_col`` with gaps, blank,
    duplicate, truncated, illegal, cost, audit and repaired_sha256."""
    short_batches(df)
    rows = damaged(df, id_col, turn_col, role_col, text_col)
    types = Types(rows)
    found = cut(faults(rows), "faults")
    made = cut(blocks(found, **sizes), "blocks")
    top = cut(parts_crossed(made, types), "crossings")
    edit = cut(edits(made, top, types), "edits")
    whole = assembled(repaired_lines(rows, edit), types)
    out = df.select(F.col(id_col).alias("id")).distinct()
    for part in (counts(found), top.filter("final = 1").select("conv", "cost", "illegal"), whole):
        out = out.join(part.withColumnRenamed("conv", "c"), F.col("id").eqNullSafe(F.col("c")), "left").drop("c")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    digest = F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")
    return out.select(F.col("id").alias(id_col), *zero, F.coalesce("audit", F.lit("")).alias("audit"), digest)
