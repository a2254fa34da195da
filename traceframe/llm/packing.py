"""Best-fit packing of token pieces into sequences under several capacities.

Tokens are made once per document in Arrow batches. Pieces are dealt by hash into groups of bounded expected size; each group is
packed by vector best-fit in decreasing order of length. The more groups, the more sequences stay part-filled: about one
per group, which is a few in ten thousand at the default size.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceframe.llm.common import grouped, stored

PIECES = "piece int, start long, length long, ids_crc32 long"
PACKED = "sequence_id long, offset long"
#: The memo of a worker process is emptied before a document when it has more entries. It bounds memory only.
MEMO_ENTRIES = 800_000
# The pre-tokenizer's pattern, written out for the characters of SIMPLE in lower case; those are the ones whose
# lower case and normal form are one character each.
_LETTERS = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u017e"
_NUMBERS = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
PRETOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^ \\t\\n\\r{_LETTERS}{_NUMBERS}]+")
SIMPLE = re.compile("[ \\t\\n\\r!-~\u00a1-\u012f\u0131-\u017e]*")


class _Encoder:
    """Text -> ids as little-endian 32-bit bytes, for a BPE file whose pre-tokens end in `</w>`.

    Texts of simple characters are cut into pre-tokens here and each is looked up in a memo; the unknown ones of a document
    are encoded in one call, as a list with spaces between, and told apart by the end mark. All other texts, and those with
    a special token's `<|`, go to the tokenizer as they are.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo: dict[str, bytes] = {}
        names = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(names.values()) + 1, dtype=bool)
        self.ends[[i for name, i in names.items() if name.endswith("</w>")]] = True

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def learn(self, runs: list[str]) -> None:
        ids = self.ids(" ".join(runs))
        stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(stops) != len(runs):
            raise ValueError("the vocabulary file does not end each pre-token with </w>")
        raw = ids.tobytes()
        self.memo.update(zip(runs, map(raw.__getitem__, map(slice, [0, *stops], stops))))

    def document(self, text: str) -> bytes:
        if not SIMPLE.fullmatch(text) or "<|" in text:
            return self.ids(text).tobytes()
        runs = PRETOKEN.findall(text.lower())
        if len(self.memo) > MEMO_ENTRIES:
            self.memo.clear()
        missing = set(runs).difference(self.memo)
        if missing:
            self.learn(list(missing))
        return b"".join(map(self.memo.__getitem__, runs))


_encoders: dict[str, _Encoder] = {}


def encoder(path: str) -> _Encoder:
    """The encoder of this worker process for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = _Encoder(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, tokenizer: str, size: int, end_id: int = 1, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: the id, `piece` from 0, `start` among the document's ids, `length`, `ids_crc32`.

    A document is its ids and `end_id`; only one longer than `size` is cut, into pieces of `size` and a rest. A null text is empty and
    gives one piece of one id. Repeated rows give their pieces again.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            for i, value in enumerate(batch.column(1)):
                ids = encode.document(value.as_py() or "") + end
                n = len(ids) // 4
                view = memoryview(ids)
                for k in range(0, n, size):
                    part = view[4 * k : 4 * (k + size)]
                    rows.append((i, k // size, k, len(part) // 4, zlib.crc32(part)))
            at, piece, start, length, crc = map(list, zip(*rows)) if rows else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                names=[id_column, "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text).mapInArrow(cut, f"`{id_column}` {kind}, {PIECES}")


@dataclass(frozen=True)
class Capacities:
    """Limits of one sequence. Attention cost is the sum of squared piece lengths."""

    tokens: int
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.1, 0.1)
    rule: str = "norm"

    def limits(self) -> np.ndarray:
        """Open limits are set to what no sequence can exceed anyway."""
        documents = self.tokens if self.documents is None else self.documents
        attention = self.tokens * self.tokens if self.attention is None else self.attention
        return np.array([self.tokens, documents, attention], dtype=np.int64)


def best_fit(lengths: np.ndarray, cap: Capacities) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece, by vector best-fit in decreasing length.

    Among the bins where every residual stays at zero or more, rule `norm` takes the one with the smallest weighted norm of
    the residual left, rule `dot` the one whose residual has the smallest weighted product with the piece, so that scarce
    room goes first. Ties go to the bin opened first. A piece that alone exceeds a capacity gets a bin of its own.
    """
    limits = cap.limits()
    weight = np.array(cap.weights) / limits.astype(float) ** 2
    order = np.argsort(-lengths, kind="stable")
    smallest = lengths.min() if len(lengths) else 0
    room = np.empty((max(16, len(lengths)), 3), dtype=np.int64)
    names = np.empty(len(room), dtype=np.int64)
    n = bins = 0
    chosen, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    for i in order:
        need = np.array([lengths[i], 1, lengths[i] * lengths[i]], dtype=np.int64)
        best = -1
        fits = np.flatnonzero((room[:n] >= need).all(axis=1))
        if len(fits):
            left = room[fits]
            score = (((left - need) ** 2.0) @ weight) if cap.rule == "norm" else (left * need.astype(float)) @ weight
            best = fits[np.argmin(score)]
        if best < 0:
            best, names[n], room[n] = n, bins, limits
            n, bins = n + 1, bins + 1
        chosen[i], offset[i] = names[best], limits[0] - room[best, 0]
        room[best] -= need
        if (room[best] < (smallest, 1, smallest * smallest)).any():  # full for every piece to come: close it, keep the order
            room[best : n - 1], names[best : n - 1] = room[best + 1 : n].copy(), names[best + 1 : n].copy()
            n -= 1
    return chosen, offset


def pack(pieces: DataFrame, cap: Capacities, keys: tuple[str, ...] = ("doc_id", "piece"), group_pieces: int = 20_000) -> DataFrame:
    """`pieces` (with `length`) and where each goes: `sequence_id` (any long), `offset`, gapless from 0.

    The number of groups follows the number of pieces, so neither a task nor the driver ever holds more than a group. `pieces` is read
    twice: give a stored table. An empty table gives an empty result.
    """
    n = pieces.count()
    groups = max(1, -(-n // group_pieces))
    dealt = pieces.drop("sequence_id", "offset", "__group").withColumn(
        "__group", F.pmod(F.xxhash64(*keys), F.lit(groups)).cast("int")
    )
    columns = [f for f in dealt.schema.fields if f.name != "__group"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns) + ", " + PACKED

    def place(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        # a fixed order within the group: a task that runs again gives the same bins
        rows = rows.sort_by([(k, "ascending") for k in keys]).combine_chunks()
        chosen, offset = best_fit(rows["length"].to_numpy(), cap)
        base = rows["__group"][0].as_py() << 32
        out = rows.select([f.name for f in columns])
        out = out.append_column("sequence_id", pa.array(chosen + base)).append_column("offset", pa.array(offset))
        yield from out.to_batches()

    return grouped(dealt, ["__group"], place, schema, groups)


def pack_documents(docs: DataFrame, tokenizer: str, cap: Capacities, end_id: int = 1) -> DataFrame:
    """Tokens, pieces and sequences of `docs`; other columns of `docs` are not read."""
    return pack(stored(token_pieces(docs, tokenizer, cap.tokens, end_id)), cap)
