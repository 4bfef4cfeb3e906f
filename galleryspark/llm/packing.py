"""Best-fit packing of tokenized documents into sequences of bounded length.

Documents become pieces of at most CAPACITY tokens. Pieces and gaps are kept in size order and run-length coded: as
sizes are whole numbers up to CAPACITY, either list has at most CAPACITY runs however many pieces there are. In each
round the pieces of one length, the longest first, sweep over the gaps: each takes the smallest gap that is left
and large enough. Pieces of a length that want the same gaps are told apart by their ranks: the first so many
take the first run of gaps, the next ones its successor; pieces without a gap open sequences. The gaps are then
updated and the next round begins. Rounds only move runs (a placement is "ranks a to b of length l go to
sequences s, s+1, ... at offset o"); Spark counts the lengths, ranks the pieces inside their length (salted, so no
length is one task) and looks every piece up in the placements, which are bounded by CAPACITY squared.

Cases: null and empty texts are one end token; repeated rows are packed as often as they occur, also with equal or
null doc_ids; ties among pieces of a length go by salt and are free; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from galleryspark.llm.common import store
from galleryspark.operators.ordering import bucketed_rank

CAPACITY = 1024
END = 2
SALTS = 1024


class Tokenizer:
    """Byte-level BPE from a rank file, made once per worker; the same ids as the JSON form of the vocabulary."""

    _made: dict[str, object] = {}

    @classmethod
    def of(cls, ranks: str, pattern: str, special: Mapping[str, int]):
        if ranks not in cls._made:
            import tiktoken

            with open(ranks, "rb") as lines:
                merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            cls._made[ranks] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens=dict(special))
        return cls._made[ranks]


def _default_tokenizer() -> tuple[str, str, dict[str, int]]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, {"<|endoftext|>": 50256}


def piece_bounds(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens; the first may be shorter."""
    head = n % capacity or min(n, capacity)
    return [(0, head)] + [(start, capacity) for start in range(head, n, capacity)]


def _pieces(tokenizer, capacity: int, with_ids: bool):
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = Tokenizer.of(*tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encoding.encode(text.as_py() or "", allowed_special="all"), END], "<u4")
                for piece, (start, length) in enumerate(piece_bounds(len(ids), capacity)):
                    part = ids[start : start + length]
                    rows.append((doc, piece, start, length, zlib.crc32(part.tobytes())) + (part.astype(np.int32),) * with_ids)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
            columns = list(zip(*rows)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return run


def pieces(docs: DataFrame, tokenizer=None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_pieces(tokenizer or _default_tokenizer(), capacity, with_ids), schema)


def best_fit(counts: Mapping[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Placements (length, first rank, last rank + 1, first sequence, offset) for so many pieces of each length."""
    sizes: list[int] = []  # of the gaps there are, in order
    gaps: dict[int, list[tuple[int, int]]] = {}  # size -> runs (first sequence, number)
    out: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def add(size: int, first: int, number: int) -> None:
        if size and number:
            if size not in gaps:
                gaps[size] = []
                bisect.insort(sizes, size)
            gaps[size].append((first, number))

    for length in sorted((x for x in counts if counts[x]), reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(sizes, length)
            if at == len(sizes):  # no gap fits: open sequences, filled with this length as far as it goes
                each = capacity // length
                full, rest = divmod(left, each)
                for k in range(each if full else 0):
                    out.append((length, rank, rank + full, sequences, k * length))
                    rank += full
                add(capacity - each * length, sequences, full)
                sequences += full
                for k in range(rest):
                    out.append((length, rank, rank + 1, sequences, k * length))
                    rank += 1
                add(capacity - rest * length, sequences, 1 if rest else 0)
                sequences += 1 if rest else 0
                left = 0
                continue
            size = sizes[at]
            first, number = gaps[size].pop()
            if not gaps[size]:
                del gaps[size]
                sizes.pop(at)
            took = min(left, number)
            out.append((length, rank, rank + took, first, capacity - size))
            add(size, first + took, number - took)
            add(size - length, first, took)
            rank += took
            left -= took
    return out


def _lookup(plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, rows = plan.value  # sorted by length and first rank
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy() - 1
            row = rows[np.searchsorted(starts, length * (1 << 52) + rank, "right") - 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(row[:, 2] + rank - row[:, 1]), pa.array(row[:, 3])],
                names=[*batch.schema.names[:-1], "sequence_id", "offset"],
            )

    return run


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    parts = store(parts, "pieces")
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # <= capacity rows
    placed = np.array(sorted(best_fit(counts, capacity)), np.int64).reshape(-1, 5)
    rows = np.stack([placed[:, 0], placed[:, 1], placed[:, 3], placed[:, 4]], axis=1)
    plan = parts.sparkSession.sparkContext.broadcast((rows[:, 0] * (1 << 52) + rows[:, 1], rows))
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS))
    ranked = bucketed_rank(parts, ["length"], salt, [F.col("doc_id"), F.col("piece")], "rank")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_lookup(plan), schema)


def packed(docs: DataFrame, tokenizer=None, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all documents, placed."""
    return pack(pieces(docs, tokenizer, capacity), capacity)


def sequences(docs: DataFrame, placed: DataFrame, tokenizer=None, capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, ids, doc_ids): the packed sequences themselves; a group is at most ``capacity`` tokens."""
    keys = ["doc_id", "piece", "ids_crc32"]
    tokens = pieces(docs, tokenizer, capacity, with_ids=True)
    join = [tokens[k].eqNullSafe(placed[k]) for k in keys]
    both = tokens.join(placed, join).select(placed["sequence_id"], placed["offset"], tokens["doc_id"], tokens["ids"])
    row = F.sort_array(F.collect_set(F.struct("offset", "doc_id", "ids")))
    return both.groupBy("sequence_id").agg(row.alias("r")).select(
        "sequence_id", F.flatten(F.col("r.ids")).alias("ids"), F.col("r.doc_id").alias("doc_ids")
    )
