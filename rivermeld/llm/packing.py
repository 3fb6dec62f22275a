"""Vector best-fit packing of token pieces into sequences under several capacities.

Texts are encoded where they are read; only piece lengths are shuffled. Pieces are dealt by hash into pools of a
bounded number of pieces, longest first within a pool, and each pool is packed by itself: every piece goes to the open
sequence that takes it under all capacities (tokens, documents, attention cost as the sum of squared lengths) and
whose residual vector it fits best.

Defined cases: a null or empty text is one piece that holds the end id; a null identifier stays null; repeated rows
are packed each on their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivermeld.llm.shared import query, table
from rivermeld.llm.tokens import default_path, encoder
from rivermeld.session import written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class Capacity:
    """Limits of one sequence. The defaults of the last two bind no sequence that its tokens do not bind."""

    tokens: int = 4096
    documents: int = 4096
    attention: int = 4096 * 4096

    def longest(self) -> int:
        """The longest piece that an empty sequence takes."""
        return max(1, min(self.tokens, math.isqrt(self.attention)))


@dataclass(frozen=True)
class Fit:
    """How a sequence is chosen: least weighted norm of what stays free, or largest weighted dot product."""

    measure: str = "norm"
    weights: tuple[float, float, float] = (1.0, 0.001, 0.001)


def best_fit(lengths, capacity: Capacity, fit: Fit):
    """(sequence number, offset) for each length; `lengths` is a numpy array in packing order, longest first."""
    import numpy as np

    n = len(lengths)
    sequence, offset = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    if not n:
        return sequence, offset
    caps = np.array([capacity.tokens, capacity.documents, capacity.attention], dtype=np.int64)
    scale = np.array(fit.weights) ** 0.5 / caps  # weights and capacities in one factor per dimension
    shortest = int(lengths.min())
    room = np.zeros((3, 1024), dtype=np.int64)  # open sequences only: what is left of each capacity
    number = np.zeros(1024, dtype=np.int64)
    live = made = 0
    for i in range(n):
        length = int(lengths[i])
        need = (length, 1, length * length)
        at = -1
        if live:
            r = room[:, :live]
            fits = (r[0] >= need[0]) & (r[1] >= need[1]) & (r[2] >= need[2])
            if fit.measure == "dot":
                score = -sum(r[d] * (need[d] * scale[d] * scale[d]) for d in range(3))
            else:
                score = sum(((r[d] - need[d]) * scale[d]) ** 2 for d in range(3))
            score[~fits] = np.inf
            at = int(score.argmin())
            if not fits[at]:
                at = -1
        if at < 0:
            if live == room.shape[1]:
                room = np.concatenate([room, np.zeros_like(room)], axis=1)
                number = np.concatenate([number, np.zeros_like(number)])
            at, live, made = live, live + 1, made + 1
            room[:, at], number[at] = caps, made - 1
        sequence[i], offset[i] = number[at], capacity.tokens - room[0, at]
        room[:, at] -= need
        if room[0, at] < shortest or room[1, at] < 1 or room[2, at] < shortest * shortest:
            live -= 1  # nothing that is still to come fits: the last open one takes its place
            room[:, at], number[at] = room[:, live], number[live]
    return sequence, offset


def token_pieces(docs: DataFrame, end_id: int, longest: int, tokenizer: str) -> DataFrame:
    """PIECES of every whole text: its ids and the end id, cut only where they exceed `longest`."""
    end, step = end_id.to_bytes(4, "little"), 4 * longest

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encode = encoder(tokenizer)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "") + end
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at:at + step]
                    for column, value in zip(out, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = [x.split()[0] for x in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def pack(pieces: DataFrame, capacity: Capacity = Capacity(), fit: Fit = Fit(), per_pool: int = 16_384) -> DataFrame:
    """PIECES with sequence_id and offset. `pieces` is a written table; no piece is longer than `capacity.longest()`."""
    pools = max(1, -(-pieces.count() // per_pool))
    schema = PIECES + ", sequence_id long, offset long"

    def packed(frames: Iterator) -> Iterator:
        import pandas as pd
        from pyspark import TaskContext

        frames = [f for f in frames if len(f)]
        if not frames:
            return
        pool = pd.concat(frames, ignore_index=True)  # at most about `per_pool` rows of five numbers
        pool = pool.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True],
                                kind="stable", ignore_index=True)
        sequence, offset = best_fit(pool["length"].to_numpy(), capacity, fit)
        yield pool.assign(sequence_id=sequence + (TaskContext.get().partitionId() << 40), offset=offset)

    return pieces.repartition(pools, "doc_id", "piece", "length", "ids_crc32").mapInPandas(packed, schema)


def packed_documents(docs: DataFrame, end_id: int = 1, capacity: Capacity = Capacity(), fit: Fit = Fit(),
                     tokenizer: str | None = None) -> DataFrame:
    """Encode, cut and pack every document; one row per piece."""
    pieces = written(token_pieces(docs, end_id, capacity.longest(), tokenizer or default_path()), "pieces")
    return pack(pieces, capacity, fit)


@query("op3_best_fit_packing")
def op3(spark, sf_dir):
    return packed_documents(table(spark, sf_dir, "documents"))
