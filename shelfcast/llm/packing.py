"""Best-fit packing of token sequences with a bounded number of open bins."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shelfcast.llm.bpe import packed_encoder
from shelfcast.llm.common import ship

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


@dataclass(frozen=True)
class Packing:
    """capacity: tokens of a sequence. open_bins: bins that a task keeps open. rows_per_task: documents whose pieces one packing task gets, about."""

    json_path: str
    ranks_path: str
    pattern: str
    capacity: int = 1024
    end_id: int = 2
    open_bins: int = 4096
    rows_per_task: int = 100_000


class OpenBins:
    """Online best fit over a fixed number of open bins. Bit f of the set says that some open bin has f tokens free."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.free: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        self.bits = self.n_open = self.made = 0

    def place(self, length: int) -> tuple[int, int]:
        """The bin and the offset for a piece: the open bin that it fills best, else a new one."""
        if fits := self.bits >> length:
            f = length + (fits & -fits).bit_length() - 1
            bin_ = self._take(f)
        else:
            bin_, f = self.made, self.capacity
            self.made += 1
        if left := f - length:
            if self.n_open >= self.most:
                fullest = (self.bits & -self.bits).bit_length() - 1
                if left <= fullest:
                    return bin_, self.capacity - f  # the bin just filled is the fullest itself and closes
                self._take(fullest)
            self.free[left].append(bin_)
            self.bits |= 1 << left
            self.n_open += 1
        return bin_, self.capacity - f

    def _take(self, f: int) -> int:
        bin_ = self.free[f].pop()
        self.n_open -= 1
        if not self.free[f]:
            self.bits ^= 1 << f
        return bin_


def lengths(n: int, capacity: int) -> list[int]:
    """Only a longer document is cut: into full pieces, but for the first."""
    first = n % capacity
    return [first] * bool(first) + [capacity] * (n // capacity)


def pieces(docs: DataFrame, how: Packing) -> DataFrame:
    """One row for each piece of each document: doc_id, piece, start, length, ids_crc32."""
    ship(docs.sparkSession)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = packed_encoder(how.json_path, how.ranks_path, how.pattern)
        end = how.end_id.to_bytes(4, "little")
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for doc_id, text in zip(ids, texts, strict=True):
                buf = encode(text.as_py() or "") + end
                start = 0
                for k, n in enumerate(lengths(len(buf) // 4, how.capacity)):
                    crc = zlib.crc32(memoryview(buf)[4 * start : 4 * (start + n)])
                    for column, value in zip(out, (doc_id, k, start, n, crc), strict=True):
                        column.append(value)
                    start += n
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(cut_up, PIECES)


def pack(rows: DataFrame, how: Packing, n_tasks: int) -> DataFrame:
    """Adds sequence_id and offset to rows with a length of 1 to how.capacity. Rows are dealt out evenly, whatever their keys."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40
        bins = OpenBins(how.capacity, how.open_bins)
        for batch in batches:
            put = np.array([bins.place(n) for n in batch.column("length").to_pylist()], dtype=np.int64).reshape(-1, 2)
            yield batch.append_column("sequence_id", pa.array(put[:, 0] + first)).append_column("offset", pa.array(put[:, 1]))

    return rows.repartition(n_tasks).mapInArrow(fill, PACKED)


def best_fit_pack(docs: DataFrame, how: Packing) -> DataFrame:
    """Packs all documents into sequences of at most how.capacity tokens.

    docs needs doc_id and text; other columns are ignored. A null text counts as empty: its document is the end
    token alone. Equal rows, doc_ids that repeat and null doc_ids are packed like any others, row by row. A text of
    any length is encoded whole. An empty table gives no rows.
    """
    n_tasks = max(1, -(-docs.count() // how.rows_per_task))
    return pack(pieces(docs, how), how, n_tasks)
