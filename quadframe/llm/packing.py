"""Best-fit packing of token sequences in bounded space."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import encoder, ids_crc32, slices, written


class OpenBins:
    """Online best fit over a fixed number of open bins.

    Bit ``f`` of one integer says that some open bin has ``f`` free places, so the
    fullest bin that still takes a piece is the lowest set bit at or above its length.
    When a new bin would exceed ``most``, the fullest open bin (the lowest set bit) closes.
    """

    def __init__(self, capacity: int, most: int, first_id: int = 0):
        self.capacity, self.most = capacity, most
        self.bits, self.open, self.next_id = 0, 0, first_id
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        found = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece of 1 to ``capacity`` places."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            if self.open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, number = self.capacity, self.next_id
            self.next_id += 1
        left = free - length
        if left:
            self.by_free[left].append(number)
            self.bits |= 1 << left
            self.open += 1
        return number, self.capacity - free


#: The pieces of sequences that are less full than this are packed once more, so many to a task; as many are broadcast at most.
LOOSE, LOOSE_PER_TASK, BROADCAST = 0.97, 50_000, 500_000


def _pack_loose(pieces: DataFrame, capacity: int, open_bins: int) -> DataFrame:
    """sequence_id, offset, to_id, to_offset: the pieces of the loose sequences of all partitions, packed anew."""
    loose = pieces.groupBy("sequence_id").agg(F.sum("length").alias("used")).where(F.col("used") < LOOSE * capacity).select("sequence_id")
    moving = written(pieces.select("sequence_id", "offset", "length").join(loose, "sequence_id", "left_semi"), "loose")
    tasks = -(-moving.count() // LOOSE_PER_TASK) or 1

    def pack(batches):
        # numbers above those of the first packing
        bins = OpenBins(capacity, open_bins, (1 << 62) + (TaskContext.get().partitionId() << 40))
        for b in batches:
            found = np.array([bins.place(n) for n in b.column(2).to_pylist()], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found[:, 0]), pa.array(found[:, 1])], ["sequence_id", "offset", "to_id", "to_offset"])

    # the longest first, which leaves the short ones to fill gaps
    dealt = moving.repartition(tasks, F.xxhash64("sequence_id", "offset")).sortWithinPartitions(F.desc("length"), "sequence_id", "offset")
    return written(dealt.mapInArrow(pack, "sequence_id long, offset long, to_id long, to_offset long"), "moved")


def pack_tokens(df: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 0, open_bins: int = 1024, with_ids: bool = False) -> DataFrame:
    """Encode each text, append ``end_id``, and pack the ids into sequences of at most ``capacity``.

    Only a document of more than ``capacity`` ids is cut, into pieces of ``capacity`` and a
    rest.  Each input partition packs its own pieces as they come, with ``open_bins`` open
    bins, so a task keeps a bounded state; the pieces are written.  The sequences that are not full, most of them open at
    the end of a partition, are then packed once more by the same rule, over all partitions and the longest pieces first, so that
    many small partitions waste no more than a few large ones.  Sequence ids carry the partition in their upper bits, those of the second packing start at 2^62.

    Returns one row per piece: the key, piece, start, length, ids_crc32, sequence_id, offset,
    and the ids too when ``with_ids``.  A null or empty text is the end id alone.  Repeated rows are packed
    each for itself, null keys like others; other columns of ``df`` are ignored, and an empty table gives no rows.
    """
    kind = df.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + (", ids array<int>" if with_ids else "")

    def pack(batches):
        coder = encoder(tokenizer)
        bins = OpenBins(capacity, open_bins, TaskContext.get().partitionId() << 40)
        for batch in slices(batches):
            keys, rows, pieces = [], [], []
            for k, own in zip(batch.column(0).to_pylist(), coder.encode_all(batch.column(1).to_pylist())):
                ids = np.append(own.astype("<u4"), np.uint32(end_id))
                for n, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    keys.append(k)
                    rows.append((n, start, len(part), ids_crc32(part), *bins.place(len(part))))
                    if with_ids:
                        pieces.append(part.astype("<i4"))
            columns = np.array(rows, np.int64).reshape(-1, 6).T
            out = [pa.array(keys, batch.column(0).type), pa.array(columns[0].astype(np.int32)), *map(pa.array, columns[1:])]
            if with_ids:
                out.append(pa.array(pieces, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(out, [x.split()[0] for x in schema.split(", ")])

    pieces = written(df.select(F.col(key), F.col(text).cast("string").alias(text)).mapInArrow(pack, schema), "pieces")
    moved = _pack_loose(pieces, capacity, open_bins)
    found = pieces.join(F.broadcast(moved) if moved.count() <= BROADCAST else moved, ["sequence_id", "offset"], "left")
    place = {"sequence_id": F.coalesce("to_id", "sequence_id"), "offset": F.coalesce("to_offset", "offset")}
    return found.select(*[place[c].alias(c) if c in place else F.col(c) for c in pieces.columns])
