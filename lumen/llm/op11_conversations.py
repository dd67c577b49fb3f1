"""Conversation repair: the cheapest edits that give a conversation legal roles.

The edits of a conversation are a path through a directed acyclic graph of (row, state),
where the states start, s, u and a follow the role grammar ``(s?(ua)+)?``. A path's weight is
one integer: its high digits are the cost, its low digits a fixed width of three-bit places
that spell the audit letters from the left (D 1, I 2, K 3, R 4), zeros at the end. Integers
then compare as (cost, audit), a prefix before its extensions, and putting an edge before a
path adds its cost and moves the letters one place right, which keeps that order. So a plain
integer minimum from the last row to the first decides cost and ties together.

Rows are ordered by (turn, nulls first; role; MD5 of the text); equal rows are one row with a
count. The order is a range sort of thin rows, so a conversation may span many tasks. One that
lies inside a task is solved there. Of one that spans several, or is longer than ``BLOCK``
rows, each block gives the least weight from each state to each state, and these tables are
composed. Tables leave Insert edges out: an insertion costs more than deleting two rows, and
any inserted turn can instead be dropped with its partner (and a lone system row), so no
cheapest path inserts, and all its paths have one letter a row, which makes weights compose.

The repaired text is hashed in order by one streaming pass; SHA-256 is sequential, so a
conversation's texts pass through one task, but are never held there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumen.llm.common import materialize, read_table

BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Letters solved at once as one integer.
BLOCK = 1024
START, S, U, A = range(4)
_INITIAL = {"s": 1, "u": 2, "a": 3}
_TRUNC, _GONE = 4, 8
_LETTERS = str.maketrans("1234", "DIKR")
_MANY = 1 << 60


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): ``rows`` with seeded faults, nulls as one space.

    n is how often a row stands there after damage by the CRC-32 of "conv_id:turn" modulo 20:
    0 drops the row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes it user's.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    d = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", space)
    return rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.when(d == 4, F.lit("user")).otherwise(F.coalesce("role", space)).alias("role"),
        F.when(d == 1, F.lit("")).when(d == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(d == 0, F.lit(0)).when(d == 3, F.lit(2)).otherwise(F.lit(1)).cast("long").alias("n"))


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _facts(rows: DataFrame) -> DataFrame:
    """One thin row for each distinct (conv_id, turn, role, text): its count and faults."""
    bare = F.rtrim("text", F.lit(BLANKS))
    thin = materialize(
        rows.select("conv_id", "turn", "role", _digest(F.col("text")).alias("h"), (bare == "").alias("blank"),
                    (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"), "n")
        .groupBy("conv_id", "turn", "role", "h", "blank", "cut").agg(F.sum("n").alias("n")))
    first = (thin.where("n > 0").groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("h").alias("d"))
             .agg(F.min(F.struct(F.col("turn").isNotNull().alias("some"), "turn")).alias("first")))
    again = ~F.col("turn").eqNullSafe(F.col("first.turn"))
    # a table of one row for each text of a conversation is written first, so that adaptive
    # execution can split the join where one text fills a conversation
    return thin.join(materialize(first), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r"))
                     & (F.col("h") == F.col("d")), "left").select(
        "conv_id", "turn", "role", "h", "n", "blank", "cut", ((F.col("n") > 0) & again).alias("again"))


def cheapest(letters: list[int]) -> tuple[int, str]:
    """(cost, audit) of a whole conversation; ``letters``: a row's role class (1 s, 2 u, 3 a,
    0 other), plus 4 if truncated, 8 if it must go."""
    places = len(letters) + (DELETE * len(letters) + INSERT) // INSERT + 2
    bits = 3 * places
    top, low = bits - 3, (1 << bits) - 1
    none = _MANY << bits
    keep, rerole, delete, insert = ((c << bits) + (d << top) for c, d in (
        (KEEP, 3), (REROLE, 4), (DELETE, 1), (INSERT, 2)))
    fine = TRUNCATED << bits

    def behind(w: int) -> int:
        return w - (w & low) + ((w & low) >> 3)

    # the end: only insertions are left
    v = [0, none, none, 0]
    for code in [None, *reversed(letters)]:
        if code is not None:
            p, s, u, a = map(behind, v)
            v = [p + delete, s + delete, u + delete, a + delete]
            if not code & _GONE:
                more = fine if code & _TRUNC else 0
                role = code & 3
                to_u = u + more + (keep if role == 2 else rerole)
                to_a = a + more + (keep if role == 3 else rerole)
                v = [min(v[START], to_u), min(v[S], to_u), min(v[U], to_a), min(v[A], to_u)]
                if role == 1:
                    v[START] = min(v[START], s + more + keep)
        u, a = behind(v[U]) + insert, behind(v[A]) + insert
        v[U], v[A] = min(v[U], a), min(v[A], u)
        u = behind(v[U]) + insert
        v[START], v[S] = min(v[START], u), min(v[S], u)
    return v[START] >> bits, _spell(v[START] & low, places).rstrip("0")


def _spell(audit: int, places: int) -> str:
    return oct(audit)[2:].rjust(places, "0").translate(_LETTERS) if places else ""


Table = tuple[int, list[list[int | None]]]


def table_of(letters: list[int]) -> Table:
    """(letters, least weight from state to state) of a block, without Insert edges."""
    n = len(letters)
    bits = 3 * n
    out: list[list[int | None]] = [[None] * 4 for _ in range(4)]
    none = _MANY << bits
    for end in range(4):
        v = [none] * 4
        v[end] = 0
        for k, code in enumerate(reversed(letters)):
            d, kp, rr = (1 << 3 * k) + (DELETE << bits), (3 << 3 * k) + (KEEP << bits), (4 << 3 * k) + (REROLE << bits)
            p, s, u, a = v
            v = [p + d, s + d, u + d, a + d]
            if not code & _GONE:
                more, role = (TRUNCATED << bits if code & _TRUNC else 0), code & 3
                to_u, to_a = u + more + (kp if role == 2 else rr), a + more + (kp if role == 3 else rr)
                v = [min(v[START], to_u), min(v[S], to_u), min(v[U], to_a), min(v[A], to_u)]
                if role == 1:
                    v[START] = min(v[START], s + more + kp)
        for state in range(4):
            out[state][end] = v[state] if v[state] < none else None
    return n, out


def deletions(n: int) -> Table:
    """The table of ``n`` rows that must go."""
    weight = (n * DELETE << 3 * n) + ((1 << 3 * n) - 1) // 7
    return n, [[weight if i == j else None for j in range(4)] for i in range(4)]


def compose(x: Table, y: Table) -> Table:
    n, m = x[0], y[0]
    low = (1 << 3 * m) - 1
    moved = [[None if w is None else ((w >> 3 * m) << 3 * (n + m)) + (w & low) for w in row] for row in y[1]]
    out = []
    for row in x[1]:
        out.append([min((a << 3 * m) + b for a, b in zip(row, (moved[k][end] for k in range(4))) if a is not None and b is not None)
                    if any(row[k] is not None and moved[k][end] is not None for k in range(4)) else None for end in range(4)])
    return n + m, out


def compose_all(tables: list[Table]) -> Table:
    while len(tables) > 1:
        tables = [compose(*tables[i:i + 2]) if i + 1 < len(tables) else tables[i] for i in range(0, len(tables), 2)]
    return tables[0] if tables else deletions(0)


def answer(table: Table) -> tuple[int, str]:
    n, w = table
    best = min(x for x in (w[START][START], w[START][A]) if x is not None)
    return best >> 3 * n, _spell(best & ((1 << 3 * n) - 1), n)


class Piece:
    """The rows of one conversation met by one task: counts, borders, and the letters."""

    def __init__(self, conv, first: tuple) -> None:
        self.conv, self.first = conv, first
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = self.rows = 0
        self.low = self.high = self.last_turn = self.first_turn = self.head = self.tail = None
        self.letters: list[int] = []
        self.tables: list[Table] = []

    def add(self, turn, role: str, n: int, blank: bool, cut: bool, again: bool) -> None:
        if not n:
            return
        if turn is not None:
            if turn != self.last_turn:
                self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = self.last_turn = turn
        start = role[:1]
        if self.rows:
            self.illegal += self.tail + start not in ("su", "ua", "au")
        else:
            self.head = start
        self.illegal += n - 1
        self.tail = start
        self.rows += n
        gone = n
        if blank:
            self.blank += n
        elif again:
            self.duplicate += n
        else:
            self.duplicate += n - 1
            self.truncated += cut
            gone = n - 1
            self.letters.append(_INITIAL.get(start, 0) | (_TRUNC if cut else 0))
        if gone > BLOCK:
            self._close()
            self.tables.append(deletions(gone))
        else:
            self.letters.extend([_GONE] * gone)
        if len(self.letters) > BLOCK:
            self._close()

    def _close(self) -> None:
        if self.letters:
            self.tables.append(table_of(self.letters))
            self.letters = []

    def table(self) -> Table:
        self._close()
        self.tables = [compose_all(self.tables)]
        return self.tables[0]

    def solved(self) -> tuple[int, str]:
        return answer(self.table()) if self.tables else cheapest(self.letters)


COUNTS = ["rows", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high"]
ROW = ("whole boolean, turn long, role string, h binary, head string, tail string, "
       + ", ".join(f"{c} long" for c in COUNTS) + ", cost long, audit string, size long, weights array<binary>")


def _piece_row(p: Piece, whole: bool) -> dict:
    row = {"conv_id": p.conv, "whole": whole, "turn": p.first[0], "role": p.first[1], "h": p.first[2], "head": p.head,
           "tail": p.tail, **{c: getattr(p, c) for c in COUNTS}, "cost": None, "audit": None, "size": None, "weights": None}
    if whole:
        row["cost"], row["audit"] = p.solved()
    else:
        row["size"], table = p.table()
        row["weights"] = [None if w is None else w.to_bytes((w.bit_length() + 7) // 8, "little") for r in table for w in r]
    return row


def _joined(pieces: list[dict]) -> dict:
    """A conversation's pieces, in order, as one row."""
    out = dict(pieces[0], whole=True)
    tables = []
    for k, p in enumerate(pieces):
        w = [None if x is None else int.from_bytes(x, "little") for x in p["weights"]]
        tables.append((p["size"], [w[i:i + 4] for i in range(0, 16, 4)]))
        if not k:
            continue
        for c in ("rows", "blank", "duplicate", "truncated", "illegal", "turns"):
            out[c] += p[c]
        if p["rows"]:
            if out["tail"] is not None:
                out["illegal"] += out["tail"] + p["head"] not in ("su", "ua", "au")
            out["tail"] = p["tail"]
        if p["high"] is not None:
            out["turns"] -= out["high"] == p["low"]
            out["low"] = p["low"] if out["low"] is None else out["low"]
            out["high"] = p["high"]
    out["cost"], out["audit"] = answer(compose_all(tables))
    return dict(out, size=None, weights=None)


def _plans(facts: DataFrame) -> DataFrame:
    """The counts, cost and audit of every conversation of ``facts``."""
    conv_type = facts.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {conv_type}, {ROW}"
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "h"]
    columns = ["conv_id", "turn", "role", "h", "n", "blank", "cut", "again"]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        arrow = None
        piece, first = None, True
        for batch in batches:
            arrow = arrow or _arrow(batch.schema.field("conv_id").type)
            for conv, turn, role, h, n, blank, cut, again in zip(*(batch.column(c).to_pylist() for c in columns)):
                if piece is None or conv != piece.conv:
                    # the first and the last conversation of a task may go on in its neighbours
                    if piece is not None:
                        out.append(_piece_row(piece, not first))
                        first = False
                    piece = Piece(conv, (turn, role, h))
                piece.add(turn, role, n, blank, cut, again)
            if len(out) > 2000:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
        if piece is not None:
            out.append(_piece_row(piece, False))
            yield pa.RecordBatch.from_pylist(out, arrow)

    def join(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda p: (p["turn"] is not None, p["turn"] or 0, p["role"].encode(), p["h"]))
        return pa.Table.from_pylist([_joined(rows)], group.schema)

    pieces = materialize(facts.select(*columns).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(solve, schema))
    split = pieces.where("NOT whole").groupBy("conv_id").applyInArrow(join, schema)
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0).cast("long"))
    return pieces.where("whole").union(split).select(
        "conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def _arrow(conv: pa.DataType) -> pa.Schema:
    kinds = {"boolean": pa.bool_(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary())}
    return pa.schema([("conv_id", conv)] + [(name, kinds[kind]) for name, kind in (f.split(" ") for f in ROW.split(", "))])


class Repaired:
    """The hash of one conversation's repaired lines, its audit followed row by row."""

    def __init__(self, conv, audit: str) -> None:
        self.conv, self.audit, self.at, self.sha, self.state, self.some = conv, audit, 0, hashlib.sha256(), START, False

    def _line(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.some else "") + role + ":" + text).encode())
        self.some, self.state = True, {"s": S, "u": U, "a": A}[role[:1]]

    def _next(self) -> str:
        return "assistant" if self.state == U else "user"

    def inserted(self) -> None:
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            self._line(self._next(), "")

    def row(self, role: str, text: str) -> None:
        self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self._line(role if edit == "K" else self._next(), text)

    def digest(self) -> str:
        self.inserted()
        return self.sha.hexdigest()


def repair(rows: DataFrame) -> DataFrame:
    """One row per conv_id of ``rows`` (conv_id, turn, role, text, n): conv_id, gaps, blank,
    duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``n`` says how often a row stands there (0: not at all, yet its conversation is returned,
    with zeros, an empty audit and the empty string's hash). role and text must not be null;
    conv_id and turn may be (null conversations are one; null turns come first). Rows of equal
    turn are ordered by role, then by the MD5 of the text. Blank: only white space; duplicate:
    role and text seen earlier; truncated: ends in none of ``.!?``; a row's first fault counts.
    Keep costs 0, Rerole 1, Delete 2 (required for blank and duplicate rows), Insert 5, an
    undeleted truncated row 5 more; the audit is the cheapest edits' initials, ties to the
    smallest string. Extra columns are ignored; an empty table has no rows.
    """
    columns = ["conv_id", "turn", "role", "text", "n"]
    rows = rows.select(*columns)
    plan = materialize(_plans(_facts(rows)))
    results = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    texts = rows.where("n > 0").select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "n",
                                       _digest(F.col("text")).alias("h"), *[F.lit(None).cast(plan.schema[c].dataType).alias(c) for c in results])
    heads = plan.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
                        F.lit("").alias("text"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("binary").alias("h"), *results)
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, " + ", ".join(
        f"{c} {plan.schema[c].dataType.simpleString()}" for c in results) + ", repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, head, kind = None, {}, None
        done: list[dict] = []
        for batch in batches:
            kind = kind or pa.schema([batch.schema.field("conv_id"), *(batch.schema.field(c) for c in results), ("repaired_sha256", pa.string())])
            heads_here = batch.select(results)
            for i, (conv, what, role, text, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text", "n")))):
                if what == 0:
                    if now is not None:
                        done.append(dict(head, repaired_sha256=now.digest()))
                    head = {"conv_id": conv, **{c: heads_here.column(c)[i].as_py() for c in results}}
                    now = Repaired(conv, head["audit"])
                else:
                    for _ in range(n):
                        now.row(role, text)
            if len(done) > 2000:
                yield pa.RecordBatch.from_pylist(done, kind)
                done = []
        if now is not None:
            done.append(dict(head, repaired_sha256=now.digest()))
            yield pa.RecordBatch.from_pylist(done, kind)

    order = [F.col("conv_id").asc_nulls_first(), "kind", F.col("turn").asc_nulls_first(), "role", "h"]
    return heads.unionByName(texts).repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, schema)


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damage(read_table(spark, sf_dir, "conversations")))
