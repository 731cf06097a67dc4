"""Hierarchical packing into windows of several context sizes.

A document's ids (with an end id) are cut into full windows of the largest
tier; what is left is routed to the smallest tier that holds it.  Tiers are
packed from the largest down: an item opens a window of its tier, and the gap
is filled from shorter tiers, longest item that fits first; where none fits,
an item is cut to fill the gap to the last id.  Every window is therefore full
but the last ones of a task, which use ever smaller powers of two.  Finished
windows are dealt to step groups of about ``step_tokens`` ids, always to the
group with the least attention work so far.

Packing is done within the partitions of the input, with no shuffle: a lost
task is redone whole, and memory is bounded by ``chunk_tokens`` and one text.
Null and empty texts are documents of the end id alone.  Repeated rows are
separate documents.  Strings of the vocabulary's added tokens in a text have
those tokens' ids, as its tokenizer gives them; with ``added={}`` they are
ordinary text.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .subwords import default_added, default_ranks, encode_with_added

TIERS = (256, 512, 1024)


class Packer:
    """Packs items (doc_id, start, ids, doc_tokens) of one task into windows."""

    def __init__(self, tiers: tuple[int, ...], step_tokens: int, task: int):
        self.tiers, self.step_tokens, self.task = tuple(sorted(tiers)), step_tokens, task
        self.pool: list[tuple[int, int, tuple]] = []  # (length, serial, item), sorted
        self.tokens = self.serial = self.sequence = self.groups = 0
        self.out: list[tuple] = []
        self.finished: list[tuple[int, list]] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        top, n = self.tiers[-1], len(ids)
        full = n - n % top
        for at in range(0, full, top):
            self.finished.append((top, [(doc_id, at, ids[at : at + top], n)]))
        if full < n:
            self._keep((doc_id, full, ids[full:], n))

    def _keep(self, item: tuple) -> None:
        self.serial += 1
        self.tokens += len(item[2])
        insort(self.pool, (len(item[2]), self.serial, item))

    def _take(self, at: int) -> tuple:
        n, _, item = self.pool.pop(at)
        self.tokens -= n
        return item

    def pack(self, last: bool) -> None:
        """Fill windows from the pool; unless ``last``, the last window's worth of ids stays for later."""
        top = self.tiers[-1]
        while self.pool and self.tokens >= top:
            first = self._take(len(self.pool) - 1)
            tier = next(t for t in self.tiers if t >= len(first[2]))
            self._window(tier, first)
        if last:
            while self.pool:
                self._window(1 << (min(self.tokens, top).bit_length() - 1), None)
        self._deal()

    def _window(self, size: int, first: tuple | None) -> None:
        row, gap = ([first], size - len(first[2])) if first else ([], size)
        while gap and self.pool:
            at = bisect_right(self.pool, (gap, 1 << 62)) - 1
            if at >= 0:
                item = self._take(at)
            else:
                doc_id, start, ids, n = self._take(0)
                item = (doc_id, start, ids[:gap], n)
                self._keep((doc_id, start + gap, ids[gap:], n))
            row.append(item)
            gap -= len(item[2])
        self._finish(size, row)

    def _finish(self, size: int, row: list) -> None:
        self.finished.append((size, row))

    def _deal(self) -> None:
        if not self.finished:
            return
        total = sum(size for size, _ in self.finished)
        count = max(1, round(total / self.step_tokens))
        heap = [(0, 0, self.groups + k) for k in range(count)]
        self.groups += count
        for size, row in sorted(self.finished, key=lambda x: -x[0]):
            work, tokens, group = heap[0]
            heapq.heapreplace(heap, (work + size * size, tokens + size, group))
            offset = 0
            for doc_id, start, ids, n in row:
                self.out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, self.task << 33 | self.sequence, offset, size, self.task << 33 | group))
                offset += len(ids)
            self.sequence += 1
        self.finished = []

    def rows(self) -> pa.RecordBatch:
        cols = list(zip(*self.out)) or [()] * 9
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], FIELDS)


FIELDS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step_group"]


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS, end_id: int = 0, step_tokens: int = 1 << 16, chunk_tokens: int = 1 << 21, ranks_path: str | None = None, added: dict[str, int] | None = None) -> DataFrame:
    """One row a piece; ``window`` is the sequence's context size, ``step_group`` its training step."""
    path = ranks_path or default_ranks()
    special = default_added() if added is None and ranks_path is None else added or {}

    def run(batches):
        packer = Packer(tiers, step_tokens, TaskContext.get().partitionId())
        held = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                for doc_id, text in zip(batch.column(0).slice(at, 128).to_pylist(), batch.column(1).slice(at, 128).to_pylist()):
                    ids = np.append(encode_with_added(text or "", path, special), np.uint32(end_id))
                    packer.add(doc_id, ids)
                    held += len(ids)
                if held > chunk_tokens:
                    packer.pack(False)
                    held = packer.tokens
                    yield packer.rows()
        packer.pack(True)
        yield packer.rows()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, ", ".join(f"{c} long" for c in FIELDS))


def op2_hierarchical_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
