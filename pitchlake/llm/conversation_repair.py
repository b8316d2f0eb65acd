"""Repair of conversation structure: the cheapest edits that make a conversation's roles `(s?(ua)+)?`.

A conversation is a graph: a node is (rows consumed, what the roles so far allow), an arc an edit. Least costs from the
start and to the end say which arcs lie on a cheapest path; the set of nodes reached so far then goes along the least edit
letter at each step, which gives the ASCII-least of all cheapest edits.

Rows are range-sorted by (conversation, turn), so that a conversation of any size lies in the pieces of many tasks. What a
task holds whole it solves; of the rest it keeps a byte a row, in segments, with the least costs between the states at
their ends (a 4 x 4 matrix). The matrices of a conversation give each segment its costs from the start and to the end;
the segments are solved apart, from each state that a cheapest path may enter by, and chained.

Only the hash of the repaired text must see a conversation's texts one after another: they stream through one task, in
order, with its edits before them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import materialize, read_table

WHITE = " \t\n\x0b\x0c\r"
SEGMENT_ROWS = 1 << 16
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
NONE = 1 << 40
#: What the roles so far allow: 0 all but an answer, 1 (after system) and 3 (after an answer) a user, 2 an answer.
START, SYSTEM, USER, ANSWER = range(4)
#: The state that an inserted or changed role leads to, and those that kept initials s, u, a lead to.
MADE = (USER, USER, ANSWER, USER)
KEPT = ({0: SYSTEM, 1: USER}, {1: USER}, {2: ANSWER}, {1: USER})
LEGAL = {(0, 1), (1, 2), (2, 1)}
#: A row as a byte: its initial (s, u, a, other) and 4 times its state (whole, truncated, to be deleted).
FINE, CUT, GONE = 0, 4, 8


def row_arcs(code: int, q: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits of a row in state q, letters ascending."""
    out = [("D", DELETE, q)]
    if code < GONE:
        extra = TRUNCATED if code >= CUT else 0
        if (to := KEPT[q].get(code & 3)) is not None:
            out.append(("K", extra, to))
        out.append(("R", REROLE + extra, MADE[q]))
    return out


ARCS = [[row_arcs(c, q) for q in range(4)] for c in range(12)]


def _before(cost: list[int]) -> list[int]:
    """Costs to the end from before the insertions at a place, given those from after them."""
    user, answer = min(cost[USER], INSERT + cost[ANSWER]), min(cost[ANSWER], INSERT + cost[USER])
    return [min(cost[START], INSERT + user), min(cost[SYSTEM], INSERT + user), user, answer]


def backward(codes: bytes, end: list[int]) -> list[list[int]]:
    """Least costs to the end from each state before each row; `end`: from each state after the last."""
    out = [end]
    for c in reversed(codes):
        after = out[-1]
        out.append(_before([min(cost + after[to] for _, cost, to in ARCS[c][q]) for q in range(4)]))
    out.reverse()
    return out


def forward(codes: bytes, start: list[int]) -> list[list[int]]:
    """Least costs from the start to each state before each row, insertions there included; and after the last, without."""
    out = []
    cost = start
    for c in codes:
        user = min(cost[USER], INSERT + min(cost[START], cost[SYSTEM], cost[ANSWER]))
        cost = [cost[START], cost[SYSTEM], user, min(cost[ANSWER], INSERT + user)]
        out.append(cost)
        after = [NONE] * 4
        for q in range(4):
            for _, extra, to in ARCS[c][q]:
                after[to] = min(after[to], cost[q] + extra)
        cost = after
    return [*out, cost]


END = _before([0, NONE, NONE, 0])


def traverse(codes: bytes, start: list[int], end: list[int], entry: int, last: bool) -> tuple[str, int]:
    """Letters of the least cheapest edits of a segment entered in state `entry`, and the state after it. `last`: the
    conversation ends with it, so that insertions after its last row are part of it."""
    to_end, from_start = backward(codes, end), forward(codes, start)
    best = min(a + b for a, b in zip(start, to_end[0], strict=True))
    letters: list[str] = []
    front, n = {(0, entry)}, len(codes)
    while True:
        if not last and any(i == n for i, _ in front):
            return "".join(letters), next(q for i, q in front if i == n)
        tight: dict[str, set] = {}
        for i, q in front:
            here = from_start[i][q]
            if i == n:  # only insertions are left
                here = best - to_end[i][q]
                if to_end[i][q] == 0:
                    return "".join(letters), q
                arcs = []
            else:
                arcs = [(x, cost, (i + 1, to)) for x, cost, to in ARCS[codes[i]][q]]
            arcs.append(("I", INSERT, (i, MADE[q])))
            for x, cost, (j, to) in arcs:
                if here + cost + to_end[j][to] == best:
                    tight.setdefault(x, set()).add((j, to))
        letter = min(tight)
        letters.append(letter)
        front = tight[letter]


def solve(codes: bytes) -> tuple[int, str]:
    """Least cost and least cheapest edits of a whole conversation."""
    audit, _ = traverse(codes, [0, NONE, NONE, NONE], END, START, True)
    return backward(codes, END)[0][START], audit


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[..., :, :, None] + b[..., None, :, :]).min(-2), NONE)


def _step(code: int) -> list[list[int]]:
    """Costs from each state before a row, and before the insertions there, to each state after it."""
    ends = [[0 if q == to else NONE for q in range(4)] for to in range(4)]
    return np.array([backward(bytes([code]), e)[0] for e in ends], np.int64).T.tolist()


STEPS = np.minimum(np.array([_step(c) for c in range(12)], np.int64), NONE)


def matrix(codes: bytes) -> np.ndarray:
    """The same for a segment: the product of its rows' matrices, by halves."""
    m = STEPS[np.frombuffer(codes, np.uint8)]
    while len(m) > 1:
        odd = m[len(m) - 1 :] if len(m) % 2 else m[:0]
        m = np.concatenate([_product(m[0 : len(m) - 1 : 2], m[1::2]), odd])
    return m[0]


# ---- rows

def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with the faults of the contract of op11, by crc32 of conv_id:turn; null counts as a space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    x = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    return x.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy")
    ).drop("copy")


def _prepared(rows: DataFrame) -> DataFrame:
    """Adds to a row: late (a turn is known), key (a hash of role and text), code (initial, and whether it is truncated; GONE
    if blank)."""
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    initial = F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 1).when(F.col("role").startswith("a"), 2).otherwise(3)
    state = F.when(bare == "", GONE).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), FINE).otherwise(CUT)
    key = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))
    return rows.select("conv_id", F.col("turn").isNotNull().alias("late"), "turn", key.alias("key"), (initial + state).cast("int").alias("code"), "role", "text")


COUNTS = ("blank", "duplicate", "truncated", "illegal")


class Segment:
    """Rows of one conversation, one after another."""

    def __init__(self, conv, index: int, open_: bool) -> None:
        self.conv, self.index, self.open = conv, index, open_
        self.codes = bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_turn = self.last_turn = self.low = self.high = None

    def add(self, turn, code: int, n: int, first: bool) -> None:
        """n equal rows of one turn; `first`: none before them in the conversation is equal."""
        if self.codes and (self.codes[-1] & 3, code & 3) not in LEGAL:
            self.illegal += 1
        if n > 1 and (code & 3, code & 3) not in LEGAL:
            self.illegal += n - 1
        whole = first and code < GONE
        if code >= GONE:
            self.blank += n
        else:
            self.duplicate += n - whole
            self.truncated += whole and code >= CUT
        if turn is not None and (self.turns == 0 or turn != self.last_turn):
            self.turns += 1
        if not self.codes:
            self.first_turn = turn
        self.last_turn = turn
        if turn is not None:
            self.low, self.high = turn if self.low is None else self.low, turn
        self.codes += (bytes([code]) if whole else b"") + bytes([code & 3 | GONE]) * (n - whole)

    def row(self, piece: int, open_: bool) -> dict:
        codes = bytes(self.codes)
        cost, audit = (None, None) if open_ else solve(codes)
        return {
            "conv_id": self.conv, "piece": piece, "idx": self.index, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated,
            "illegal": self.illegal, "turns": self.turns, "low": self.low, "high": self.high, "first_turn": self.first_turn, "last_turn": self.last_turn,
            "first_code": codes[0], "last_code": codes[-1], "cost": cost, "audit": audit, "codes": codes if open_ else None,
            "matrix": matrix(codes).ravel().tolist() if open_ else None
        }


SEGMENT = (
    "conv_id {id}, piece int, idx int, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, first_turn long, last_turn long, "
    "first_code int, last_code int, cost long, audit string, codes binary, matrix array<long>"
)
BOUND = "conv_id {id}, piece int, idx int, start array<long>, stop array<long>, last boolean, blank long, duplicate long, truncated long, illegal long, gaps long, cost long"
SOLVED = "conv_id {id}, piece int, idx int, letters array<string>, exits array<int>, blank long, duplicate long, truncated long, illegal long, gaps long, cost long"
REPORT = "conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _table(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(rows, schema)


def _schema(df: DataFrame, template: str) -> tuple[str, pa.Schema]:
    text = template.format(id=df.schema["conv_id"].dataType.simpleString())
    return text, df.sparkSession.createDataFrame([], text).toArrow().schema


def _segments(marked: DataFrame, segment_rows: int) -> DataFrame:
    spark_type, arrow_type = _schema(marked, SEGMENT)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, now, out = TaskContext.get().partitionId(), None, []
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "turn", "code", "n", "first"))
            for conv, turn, code, n, first in zip(*columns, strict=True):
                if now is None or now.conv != conv:
                    if now is not None:
                        out.append(now.row(piece, now.open))
                    # the first of a task may have begun in the one before
                    now = Segment(conv, 0, now is None)
                while n:
                    if len(now.codes) >= segment_rows:
                        out.append(now.row(piece, True))
                        now = Segment(conv, now.index + 1, True)
                    some = min(n, segment_rows - len(now.codes))
                    now.add(turn, code, some, first)
                    n, first = n - some, False
                if len(out) >= 4096:
                    yield from _table(out, arrow_type).to_batches()
                    out = []
        if now is not None:  # the last may go on in the next
            out.append(now.row(piece, True))
        yield from _table(out, arrow_type).to_batches()

    order = ["conv_id", "late", "turn", "key"]
    return marked.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, spark_type)


def _bounds(open_: DataFrame) -> DataFrame:
    """Costs from the start and to the end at the ends of each segment, from the matrices of a conversation's segments."""
    spark_type, arrow_type = _schema(open_, BOUND)

    def walk(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["piece"], r["idx"]))
        steps = [np.array(r["matrix"], np.int64).reshape(4, 4) for r in rows]
        start, stop = [np.array([0, NONE, NONE, NONE])], [np.array(END, np.int64)]
        for m in steps[:-1]:
            start.append(np.minimum((start[-1][:, None] + m).min(0), NONE))
        for m in reversed(steps):
            stop.append(np.minimum((m + stop[-1][None, :]).min(1), NONE))
        stop.reverse()
        total = {c: sum(r[c] for r in rows) for c in COUNTS}
        total["illegal"] += sum((a["last_code"] & 3, b["first_code"] & 3) not in LEGAL for a, b in zip(rows, rows[1:], strict=False))
        turns = sum(r["turns"] for r in rows) - sum(a["last_turn"] is not None and a["last_turn"] == b["first_turn"] for a, b in zip(rows, rows[1:], strict=False))
        low, high = min((r["low"] for r in rows if r["low"] is not None), default=None), max((r["high"] for r in rows if r["high"] is not None), default=None)
        total |= {"gaps": 0 if low is None else high - low + 1 - turns, "cost": int(stop[0][START])}
        return _table(
            [
                {"conv_id": r["conv_id"], "piece": r["piece"], "idx": r["idx"], "start": a.tolist(), "stop": b.tolist(), "last": i == len(rows) - 1, **total}
                for i, (r, a, b) in enumerate(zip(rows, start, stop[1:], strict=True))
            ], arrow_type
        )

    return open_.drop("codes", "audit", "cost").groupBy("conv_id").applyInArrow(walk, spark_type)


def _solved(open_: DataFrame) -> DataFrame:
    """The report of conversations in several segments (or at the end of a task's rows)."""
    codes = open_.select(F.col("conv_id").alias("c"), F.col("piece").alias("p"), F.col("idx").alias("i"), "codes")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("piece") == F.col("p")) & (F.col("idx") == F.col("i"))
    x = _bounds(open_).join(codes, same).drop("c", "p", "i")
    (spark_type, arrow_type), (report_type, report_arrow) = _schema(open_, SOLVED), _schema(open_, REPORT)

    def letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                to_end = backward(r["codes"], r["stop"])[0]
                found = [
                    traverse(r["codes"], r["start"], r["stop"], q, r["last"]) if r["start"][q] + to_end[q] == r["cost"] else (None, None) for q in range(4)
                ]
                out.append(r | {"letters": [a for a, _ in found], "exits": [b for _, b in found]})
            yield from _table(out, arrow_type).to_batches()

    def chain(table: pa.Table) -> pa.Table:
        rows, state, parts = sorted(table.to_pylist(), key=lambda r: (r["piece"], r["idx"])), START, []
        for r in rows:
            parts.append(r["letters"][state])
            state = r["exits"][state]
        return _table([rows[0] | {"audit": "".join(parts)}], report_arrow)

    return x.mapInArrow(letters, spark_type).groupBy("conv_id").applyInArrow(chain, report_type)


def report(rows: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Per conversation with rows: gaps, blank, duplicate, truncated, illegal, cost and audit."""
    light = rows.groupBy("conv_id", "late", "turn", "key").agg(F.count(F.lit(1)).alias("n"), F.max("code").alias("code"))
    light = materialize(light, "turns")
    # the first of equal rows, without a task that holds them all: a row of its own marks it
    firsts = light.groupBy("conv_id", "key").agg(F.min(F.struct("late", "turn")).alias("t"))
    marks = firsts.select("conv_id", "t.late", "t.turn", "key", F.lit(0).cast("long").alias("n"), F.lit(None).cast("int").alias("code"), F.lit(True).alias("first"))
    marked = light.withColumn("first", F.lit(False)).unionByName(marks).groupBy("conv_id", "late", "turn", "key").agg(
        F.sum("n").alias("n"), F.max("code").alias("code"), F.max("first").alias("first")
    )
    segments = materialize(_segments(marked, segment_rows), "segments")
    gaps = F.when(F.col("turns") > 0, F.col("high") - F.col("low") + 1 - F.col("turns")).otherwise(0).cast("long").alias("gaps")
    done = segments.where("codes is null").select("conv_id", gaps, *COUNTS, "cost", "audit")
    return materialize(done.unionByName(_solved(segments.where("codes is not null"))), "reports")


def repair(conversations: DataFrame, ids: DataFrame | None = None, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated, illegal (pairs of roles), cost and audit of the cheapest edits, and
    repaired_sha256, the hash of the repaired conversation.

    conversations: conv_id, turn, role, text; null role and text count as one space. ids: the conversations to report, also
    those without rows (zeros, an empty audit, the hash of nothing); those of the rows if not given. A null conv_id is a
    conversation of its own. Rows go by turn, null first; different rows of one turn go by a hash of role and text, equal rows
    lie side by side. A conversation may have any number of rows; its edits are one string. Texts may be of any length. An
    empty table gives no rows; extra columns are not read."""
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = _prepared(conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text")))
    reports = report(rows, segment_rows)
    ids = (conversations if ids is None else ids).select("conv_id").distinct()
    names = ("gaps", *COUNTS, "cost")
    other = reports.select(F.col("conv_id").alias("c"), *names, "audit")
    heads = ids.join(other, F.col("conv_id").eqNullSafe(F.col("c")), "left").select(
        "conv_id", F.lit(None).cast("boolean").alias("late"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("key"),
        F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), *(F.coalesce(c, F.lit(0)).alias(c) for c in names),
        F.coalesce("audit", F.lit("")).alias("audit")
    )
    # a blank row is never kept, so its text isn't needed
    texts = rows.select("conv_id", "late", "turn", "key", "role", F.when(F.col("code") < GONE, F.col("text")).alias("text"))
    both = heads.unionByName(texts, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions(
        "conv_id", F.col("late").asc_nulls_first(), F.col("turn").asc_nulls_first(), "key"
    )
    text_type, arrow_type = _schema(both, REPORT + ", repaired_sha256 string")
    return both.mapInArrow(lambda batches: hash_repaired(batches, arrow_type), text_type)


ROLE = {USER: b"user", ANSWER: b"assistant"}
INITIAL = {"s": 0, "u": 1, "a": 2}


class Repaired:
    """The hash of one conversation, line by line along its edits."""

    def __init__(self, head: dict) -> None:
        self.head, self.at, self.state, self.empty = head, 0, START, True
        self.sha = hashlib.sha256()

    def line(self, role: bytes, text: bytes) -> None:
        self.sha.update((b"" if self.empty else b"\n") + role + b":" + text)
        self.empty = False

    def inserted(self) -> None:
        audit = self.head["audit"]
        while self.at < len(audit) and audit[self.at] == "I":
            self.at += 1
            self.state = MADE[self.state]
            self.line(ROLE[self.state], b"")

    def row(self, role: str, text: str | None) -> None:
        self.inserted()
        letter = self.head["audit"][self.at]
        self.at += 1
        if letter == "K":
            self.state = KEPT[self.state][INITIAL[role[0]]]
            self.line(role.encode(), text.encode())
        elif letter == "R":
            self.state = MADE[self.state]
            self.line(ROLE[self.state], text.encode())

    def end(self) -> dict:
        self.inserted()
        return self.head | {"repaired_sha256": self.sha.hexdigest()}


def hash_repaired(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A head row of each conversation, then its rows in order, to the report with the hash. Text is held a batch at a time."""
    now, out = None, []
    heads = [n for n in schema.names if n != "repaired_sha256"]
    for batch in batches:
        late, role, text = (batch.column(c).to_pylist() for c in ("late", "role", "text"))
        for i, known in enumerate(late):
            if known is None:
                if now is not None:
                    out.append(now.end())
                now = Repaired({n: batch.column(n)[i].as_py() for n in heads})
            elif now is not None:
                now.row(role[i], text[i])
        if len(out) >= 4096:
            yield from _table(out, schema).to_batches()
            out = []
    if now is not None:
        out.append(now.end())
    yield from _table(out, schema).to_batches()


def op11_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read_table(spark, sf_dir, "conversations")
    return repair(damage(conversations), conversations)
