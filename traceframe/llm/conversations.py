"""Repair of conversation structure: the cheapest edits that give `(s?(ua)+)?`, found by divide and conquer.

Rows lie in one order over all partitions and are cut into pieces of bounded size, so a conversation of any length is many
pieces. A piece is summed up by what it costs from each of four states to each; the sums of a conversation say in which
states its pieces begin and end. Inside a piece, and over the pieces, a forward vector (cost and order of the edit strings)
and a backward vector (cost) of the four states meet in the middle, the least crossing is kept and both halves follow, so no
table of moves is held. Only the last pass, which hashes the repaired text, reads a conversation from end to end, as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceframe.llm.common import squeezed_text, stored, unsqueezed_text

# States: nothing said, after system, after user, after assistant. A repaired conversation ends in the first or the last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NOTHING, ASSISTANT)
FAR = 1 << 60
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
PIECE_ROWS, PIECE_BYTES = 4096, 4 << 20
#: What may be inserted before a row: target state and edits, from each state; more than two never help.
INSERTS = {
    NOTHING: ((NOTHING, ""), (USER, "I"), (ASSISTANT, "II")),
    SYSTEM: ((SYSTEM, ""), (USER, "I"), (ASSISTANT, "II")),
    USER: ((USER, ""), (ASSISTANT, "I")),
    ASSISTANT: ((ASSISTANT, ""), (USER, "I")),
}

Steps = tuple[tuple[tuple[int, int, str], ...], ...]
Vector = tuple[list[int], list[int]]


def spoken(state: int, initial: str) -> int | None:
    """State after a row with that role initial, if it may follow."""
    if initial == "u" and state != USER:
        return USER
    if initial == "a" and state == USER:
        return ASSISTANT
    return SYSTEM if initial == "s" and state == NOTHING else None


def row_steps(initial: str, must_go: bool, truncated: bool) -> Steps:
    """For each state after the row: (state before, cost, edits), the cheapest and then ASCII-least edits of each pair."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for before, ways in INSERTS.items():
        for state, put in ways:
            moves = [(state, DELETE, "D")]
            if not must_go:
                extra = TRUNCATED * truncated
                moves += [(spoken(state, initial), KEEP + extra, "K"), (spoken(state, "u"), REROLE + extra, "R")]
                moves += [(spoken(state, "a"), REROLE + extra, "R")]
            for after, cost, edit in moves:
                if after is not None:
                    found = (cost + INSERT * len(put), put + edit)
                    best[before, after] = min(found, best.get((before, after), found))
    return tuple(tuple((b, *best[b, a]) for b in range(4) if (b, a) in best) for a in range(4))


INITIALS = "sua "
#: Steps by code: 3 * initial + (0 whole, 1 truncated, 2 must go); the last code ends a conversation.
STEPS = [row_steps(i, k == 2, k == 1) for i in INITIALS for k in range(3)]
CLOSE = len(STEPS)
STEPS.append(tuple(tuple((b, INSERT * len(put), put) for b in range(4) for a, put in INSERTS[b] if a == after) for after in range(4)))


def forward(steps: Sequence[Steps], vector: Vector) -> Vector:
    """Least cost of each state after `steps`, and the order of the states' least edit strings.

    Strings of two states differ before either ends, each having one edit of every row; so order follows from the order
    before and, from the same state, from the edits of the row.
    """
    cost, order = vector
    for step in steps:
        found = []
        for ways in step:
            best = (FAR, 9, "")
            for before, more, edits in ways:
                way = (cost[before] + more, order[before], edits)
                if way < best:
                    best = way
            found.append(best)
        ranks = {w: i for i, w in enumerate(sorted({f[1:] for f in found}))}
        cost, order = [min(f[0], FAR) for f in found], [ranks[f[1:]] for f in found]
    return cost, order


def backward(steps: Sequence[Steps], cost: list[int]) -> list[int]:
    """Least cost from each state to the end."""
    for step in reversed(steps):
        new = [FAR] * 4
        for after, ways in enumerate(step):
            for before, more, _ in ways:
                new[before] = min(new[before], more + cost[after])
        cost = new
    return cost


def _only(states: Sequence[int]) -> list[int]:
    return [0 if s in states else FAR for s in range(4)]


def crossing(steps: Sequence[Steps], start: int, ends: Sequence[int], mid: int) -> int:
    """State in which the audit-least of the cheapest ways stands after `mid` steps."""
    cost, order = forward(steps[:mid], (_only([start]), [0] * 4))
    rest = backward(steps[mid:], _only(ends))
    return min(range(4), key=lambda s: (cost[s] + rest[s], order[s]))


def best_edits(steps: Sequence[Steps], start: int, end: int, out: list[str]) -> None:
    """Edits of each step on the audit-least cheapest way from `start` to `end`; halves follow their crossing, depth is log n."""
    if len(steps) == 1:
        out.append(min((cost, edits) for before, cost, edits in steps[0][end] if before == start)[1])
    elif steps:
        mid = len(steps) // 2
        state = crossing(steps, start, (end,), mid)
        best_edits(steps[:mid], start, state, out)
        best_edits(steps[mid:], state, end, out)


def summed(steps: Sequence[Steps]) -> list[int]:
    """Costs and orders of a piece from each state to each: 32 numbers."""
    out: list[int] = []
    for start in range(4):
        cost, order = forward(steps, (_only([start]), [0] * 4))
        out += [*cost, *order]
    return out


def as_steps(sums: Sequence[int]) -> Steps:
    """A summed piece as one step; its order numbers stand for its edits."""
    return tuple(
        tuple((b, sums[8 * b + a], f"{sums[8 * b + 4 + a]:02d}") for b in range(4) if sums[8 * b + a] < FAR) for a in range(4)
    )


def piece_states(sums: Sequence[Sequence[int]]) -> list[int]:
    """States before and after each piece of a conversation, the end included."""
    steps = [as_steps(s) for s in sums] + [STEPS[CLOSE]]
    last = crossing(steps, NOTHING, ENDS, len(steps) - 1)
    states = [NOTHING] * (len(steps) - 1) + [last]

    def halve(lo: int, hi: int) -> None:
        if hi - lo > 1:
            mid = (lo + hi) // 2
            states[mid] = crossing(steps[lo:hi], states[lo], (states[hi],), mid - lo)
            halve(lo, mid)
            halve(mid, hi)

    halve(0, len(steps) - 1)
    return states


# ------------------------------------------------------------------ rows


def _marks(text: Column) -> tuple[Column, Column]:
    """(blank, truncated): no character but white space; the last other character ends no sentence."""
    core = F.rtrim(F.translate(text, "\t\n\x0b\x0c\r", "     "))
    return core == "", ~F.right(core, F.lit(1)).isin(".", "!", "?")


@dataclass
class _Piece:
    """Rows of one conversation next to each other."""

    conv: object
    rows: int = 0
    size: int = 0

    def __post_init__(self) -> None:
        self.codes, self.first_seen, self.digests, self.seen = bytearray(), [], [], set()
        self.words: list[bytes] = []
        self.low = self.high = self.last_turn = None
        self.turns = self.blank = self.truncated = self.illegal = 0
        self.first_initial = self.last_initial = None

    def add(self, turn: int | None, role: str, text: str, blank: bool, cut: bool) -> None:
        initial = role[:1]
        said = role.encode() + b"\x00" + text.encode()
        digest = hashlib.blake2b(f"{len(role)}:".encode() + said, digest_size=16).digest()
        again = digest in self.seen
        self.seen.add(digest)
        kind = 2 if blank or again else int(cut)
        self.codes.append(3 * (INITIALS.index(initial) if initial and initial in "sua" else 3) + kind)
        self.blank += blank
        if not blank and not again:  # what an earlier piece may have seen
            self.first_seen.append(self.rows)
            self.digests.append(digest)
        self.truncated += not blank and not again and cut
        self.illegal += self.rows > 0 and self.last_initial + initial not in LEGAL
        self.first_initial = initial if self.rows == 0 else self.first_initial
        self.last_initial = initial
        if turn is not None:
            self.turns += turn != self.last_turn
            self.low, self.high, self.last_turn = turn if self.low is None else self.low, turn, turn
        head = role.encode()
        self.words.append(len(head).to_bytes(4, "little") + head + len(text.encode()).to_bytes(8, "little") + text.encode())
        self.rows += 1
        self.size += len(text)


PIECE_TYPES = [
    ("part", pa.int32()), ("seq", pa.int32()), ("n", pa.int64()), ("codes", pa.binary()), ("fresh", pa.list_(pa.int32())),
    ("digests", pa.list_(pa.binary())), ("blank", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
    ("first_initial", pa.string()), ("last_initial", pa.string()), ("turns", pa.int64()), ("low", pa.int64()), ("high", pa.int64()),
    ("said", pa.binary()),
]


def _pieces(batches: Iterator[pa.RecordBatch], rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """Pieces of sorted rows, in the order of partitions."""
    part, seq = TaskContext.get().partitionId(), 0
    conv_type, held, piece = None, [], None
    held_bytes = 0

    def closed(p: _Piece) -> tuple:
        said = squeezed_text(b"".join(p.words))
        return (
            p.conv, part, seq, p.rows, bytes(p.codes), p.first_seen, p.digests, p.blank, p.truncated, p.illegal, p.first_initial,
            p.last_initial, p.turns, p.low, p.high, said,
        )

    def sent() -> pa.RecordBatch:
        columns = list(zip(*held))
        arrays = [pa.array(columns[0], conv_type), *[pa.array(c, t) for c, (_, t) in zip(columns[1:], PIECE_TYPES)]]
        return pa.RecordBatch.from_arrays(arrays, names=["conv", *[n for n, _ in PIECE_TYPES]])

    for batch in batches:
        conv_type = batch.schema.field(0).type
        for lo in range(0, batch.num_rows, 256):  # a long text is a Python string only for a while
            for conv, turn, role, text, blank, cut in zip(*[c.to_pylist() for c in batch.slice(lo, 256).columns]):
                if piece is None or piece.conv != conv or piece.rows >= rows or piece.size >= size:
                    if piece is not None:
                        held.append(closed(piece))
                        held_bytes += len(held[-1][-1])
                        seq += 1
                    piece = _Piece(conv)
                    if len(held) >= 2048 or held_bytes >= size:
                        yield sent()
                        held, held_bytes = [], 0
                piece.add(turn, role, text, blank, cut)
    if piece is not None:
        held.append(closed(piece))
    if held:
        yield sent()


def _with_repeats(codes: bytes, repeats: Sequence[int] | None) -> list[int]:
    out = list(codes)
    for i in repeats or ():
        out[i] = 3 * (out[i] // 3) + 2
    return out


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[tuple[int, ...], list[int]] = {}
    for batch in batches:
        sums = []
        for codes, repeats in zip(batch.column("codes").to_pylist(), batch.column("repeats").to_pylist()):
            full = tuple(_with_repeats(codes, repeats))
            if len(full) > 16 or full not in known:
                found = summed([STEPS[c] for c in full])
                if len(full) <= 16 and len(known) < 50_000:
                    known[full] = found
            else:
                found = known[full]
            sums.append(found)
        kept = [batch.column(c) for c in ("conv", "part", "seq", "repeats")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(sums, pa.list_(pa.int64()))], names=["conv", "part", "seq", "repeats", "sums"])


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States of the pieces; the sums of a conversation come together, some 300 bytes for each 4,096 rows."""
    held: list[dict] = []

    def solved() -> Iterator[dict]:
        states = piece_states([r["sums"] for r in held])
        for r, start, end in zip(held, states, states[1:]):
            yield {"conv": r["conv"], "part": r["part"], "seq": r["seq"], "start": start, "end": end, "repeats": r["repeats"]}

    schema = None
    for batch in batches:
        schema = pa.schema(
            [("conv", batch.schema.field("conv").type), ("part", pa.int32()), ("seq", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("repeats", pa.list_(pa.int32()))]
        )
        out = []
        for row in batch.select(["conv", "part", "seq", "sums", "repeats"]).to_pylist():
            if held and held[0]["conv"] != row["conv"]:
                out += solved()
                held = []
            held.append(row)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
    if held:
        yield pa.RecordBatch.from_pylist(list(solved()), schema=schema)


def _said(blob: bytes) -> Iterator[tuple[str, str]]:
    data, at = unsqueezed_text(blob), 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        role, at = data[at + 4 : at + 4 + n], at + 4 + n
        m = int.from_bytes(data[at : at + 8], "little")
        text, at = data[at + 8 : at + 8 + m], at + 8 + m
        yield role.decode(), text.decode()


NAMES = {USER: "user", ASSISTANT: "assistant"}


def repaired_rows(edits: Sequence[str], said: Iterator[tuple[str, str]], state: int) -> Iterator[tuple[str, str]]:
    """(role, text) of what the edits of each row leave or insert, from `state` on."""
    for edit, (role, text) in zip(edits, said):
        for move in edit:
            if move == "K":
                state = spoken(state, role[:1])
                yield role, text
            elif move != "D":
                state = ASSISTANT if state == USER else USER
                yield NAMES[state], text if move == "R" else ""


class _Conversation:
    """What is kept of a conversation while its pieces pass by."""

    def __init__(self, conv: object) -> None:
        self.conv = conv
        self.rows = self.cost = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.initial = None
        self.state = NOTHING
        self.audit: list[str] = []
        self.digest = hashlib.sha256()
        self.said = 0

    def add(self, piece: dict, ways: dict) -> Iterator[tuple[str, str]]:
        repeats = ways["repeats"] or ()
        self.rows += piece["n"]
        self.blank += piece["blank"]
        self.duplicate += piece["n"] - piece["blank"] - len(piece["fresh"]) + len(repeats)
        self.truncated += piece["truncated"] - sum(piece["codes"][i] % 3 == 1 for i in repeats)
        self.illegal += piece["illegal"]
        if self.initial is not None:
            self.illegal += self.initial + piece["first_initial"] not in LEGAL
        self.initial = piece["last_initial"]
        if piece["low"] is not None:
            self.turns += piece["turns"] - (piece["low"] == self.high)
            self.low, self.high = piece["low"] if self.low is None else self.low, piece["high"]
        codes = _with_repeats(piece["codes"], repeats)
        edits: list[str] = []
        best_edits([STEPS[c] for c in codes], ways["start"], ways["end"], edits)
        for code, e in zip(codes, edits):
            self.cost += INSERT * (len(e) - 1) + COSTS[e[-1]] + TRUNCATED * (code % 3 == 1 and e[-1] != "D")
        self.audit.append("".join(edits))
        self.state = ways["end"]
        for role, text in repaired_rows(edits, _said(piece["said"]), ways["start"]):
            self.say(role, text)
            yield role, text

    def say(self, role: str, text: str) -> None:
        self.digest.update(("\n" if self.said else "").encode() + f"{role}:{text}".encode())
        self.said += 1

    def close(self) -> Iterator[tuple[str, str]]:
        """Rows that have to be inserted at the end."""
        cost, put = min((c, e) for end in ENDS for b, c, e in STEPS[CLOSE][end] if b == self.state)
        self.cost += cost
        self.audit.append(put)
        for _ in put:
            self.state = ASSISTANT if self.state == USER else USER
            self.say(NAMES[self.state], "")
            yield NAMES[self.state], ""

    def report(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        counts = (self.rows, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost)
        return self.conv, *counts, "".join(self.audit), self.digest.hexdigest()


LEGAL = ("su", "ua", "au")
COSTS = {"K": KEEP, "R": REROLE, "D": DELETE}
REPORT = [(c, pa.int64()) for c in "n_rows gaps blank duplicate truncated illegal cost".split()] + [("audit", pa.string()), ("repaired_sha256", pa.string())]
TURNS = [("position", pa.int64()), ("role", pa.string()), ("text", pa.string())]


def _walk(batches: Iterator[pa.RecordBatch], turns: bool) -> Iterator[pa.RecordBatch]:
    """Reports of conversations, or their repaired rows, from pieces in order, each behind its states."""
    now: _Conversation | None = None
    ways: dict = {}
    out: list[tuple] = []
    size = 0
    schema = None

    def sent() -> pa.RecordBatch:
        nonlocal size
        arrays = [pa.array(c, t) for c, t in zip(zip(*out), schema.types)]
        out.clear()
        size = 0
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def done(rows: Iterator[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
        nonlocal size
        for role, text in rows:
            if turns:
                out.append((now.conv, now.said, role, text))
                size += len(text)
                if size > PIECE_BYTES:
                    yield sent()

    for batch in batches:
        schema = pa.schema([("conv", batch.schema.field("conv").type), *(TURNS if turns else REPORT)])
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            if now is None or row["conv"] != now.conv:
                if now is not None:
                    yield from done(now.close())
                    if not turns:
                        out.append(now.report())
                now = _Conversation(row["conv"])
            if row["kind"] == 0:
                ways = row
            else:
                yield from done(now.add(row, ways))
        if out:
            yield sent()
    if now is not None:
        yield from done(now.close())
        if not turns:
            out.append(now.report())
        if out:
            yield sent()


def _matched(a: DataFrame, b: DataFrame, columns: Sequence[str], how: str) -> DataFrame:
    """Join on `columns`, nulls equal each other; the columns of `b` that are not in `columns` come along."""
    other = b.withColumnsRenamed({c: f"__{c}" for c in columns})
    on = [a[c].eqNullSafe(other[f"__{c}"]) for c in columns]
    return a.join(other, on, how).drop(*[f"__{c}" for c in columns])


def _ordered_pieces(rows: DataFrame) -> tuple[DataFrame, str]:
    """Pieces of all conversations behind the states in which they begin and end, in order within partitions."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    base = rows.select(F.col("conv_id").alias("conv"), F.col("turn").cast("bigint").alias("turn"), space("role").alias("role"), space("text").alias("text"))
    key = dict(base.dtypes)["conv"]
    blank, truncated = _marks(F.col("text"))
    order = ["conv", "turn", F.left("role", F.lit(64)), F.left("text", F.lit(64)), F.xxhash64("role", "text")]
    marked = base.withColumns({"blank": blank, "truncated": truncated})
    dealt = marked.repartitionByRange(*order).sortWithinPartitions(*order)
    names = {pa.int32(): "int", pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary", pa.list_(pa.int32()): "array<int>", pa.list_(pa.binary()): "array<binary>"}
    schema = ", ".join([f"conv {key}", *[f"{n} {names[t]}" for n, t in PIECE_TYPES]])
    pieces = stored(dealt.mapInArrow(partial(_pieces, rows=PIECE_ROWS, size=PIECE_BYTES), schema))

    place = ["conv", "part", "seq"]
    several = pieces.groupBy("conv").agg(F.count("*").alias("k")).where("k > 1").select("conv")
    cut = _matched(pieces.select(*place, "fresh", "digests"), several, ["conv"], "left_semi")
    seen = cut.select(*place, F.explode(F.arrays_zip("fresh", "digests")).alias("d")).select(*place, F.col("d.fresh").alias("i"), F.col("d.digests").alias("digest"))
    first = seen.groupBy("conv", "digest").agg(F.min(F.struct("part", "seq")).alias("f"), F.count("*").alias("k")).where("k > 1")
    again = _matched(seen, first, ["conv", "digest"], "inner").where(F.struct("part", "seq") > F.col("f"))
    repeats = again.groupBy(*place).agg(F.collect_list("i").alias("repeats"))
    known = _matched(pieces.select(*place, "codes"), repeats, place, "left")
    sums = known.mapInArrow(_sums, f"conv {key}, part int, seq int, repeats array<int>, sums array<bigint>")
    ways = sums.repartition("conv").sortWithinPartitions(*place)
    ways = ways.mapInArrow(_chosen, f"conv {key}, part int, seq int, start int, end int, repeats array<int>")
    both = ways.withColumn("kind", F.lit(0)).unionByName(pieces.drop("digests").withColumn("kind", F.lit(1)), allowMissingColumns=True)
    return both.repartition("conv").sortWithinPartitions(*place, "kind"), key


def repair_conversations(rows: DataFrame) -> DataFrame:
    """One row per conversation of `rows` (conv_id, turn, role, text): its faults and the cheapest edits that mend it.

    n_rows, gaps (turns missing between the first and the last), blank, duplicate, truncated (the first fault of each row),
    illegal (neighbours whose role initials are not su, ua or au), cost, audit (initials of the edits: Delete, Insert, Keep,
    Rerole; ASCII-least among the cheapest) and repaired_sha256 (of `role:text` lines).
    Rows are ordered by turn, nulls first, then by role, the first 64 characters of the text and a hash, so repeated rows lie
    together. A null role or text is one space; null conversations are one; an empty role can't be kept. Further columns
    do not matter. Without rows there is no result. A conversation of any length costs a task the codes of one piece; only
    its text is read as one stream in the last pass, since a hash runs through it.
    """
    ordered, key = _ordered_pieces(rows)
    fields = ", ".join(f"{n} {'bigint' if t == pa.int64() else 'string'}" for n, t in REPORT)
    return ordered.mapInArrow(partial(_walk, turns=False), f"conv {key}, {fields}").withColumnRenamed("conv", "conv_id")


def repaired_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, position from 1, role, text): the conversations of `rows` after the edits of `repair_conversations`."""
    ordered, key = _ordered_pieces(rows)
    return ordered.mapInArrow(partial(_walk, turns=True), f"conv {key}, position bigint, role string, text string").withColumnRenamed("conv", "conv_id")
