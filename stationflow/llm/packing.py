"""Packing of token sequences by vector bin packing.

Every task packs its own documents. Pieces as long as a whole sequence stand
alone; what is left of each document waits in a pool of bounded size. A bin is
filled from the pool by the dot-product heuristic: of the pieces that fit the
bin's remaining tokens, segments and loss-bearing tokens, the one whose demand
has the largest dot product with what remains goes in (all measured in shares
of the limits). Where none fits, the best one is cut to the room that is left.
A bin that closes before it is full is cut into sequences whose lengths are
powers of two, which need no padding.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from stationflow.llm.common import release, steps
from stationflow.llm.token_files import END_ID, end_each
from stationflow.llm.tokens import TOKEN_STEP, encoder

MAX_TOKENS = 4096
MAX_SEGMENTS = 128
POOL = 1024


class Packer:
    """Packs pieces of documents; finished pieces gather in ``out``.

    A document's loss-bearing tokens are its last ``loss`` ones.
    """

    def __init__(self, first_id: int, max_tokens: int, max_segments: int, max_loss: int, pool: int):
        if min(max_tokens, max_segments, max_loss, pool) < 1 or max_tokens & (max_tokens - 1):
            raise ValueError("limits are positive, and max_tokens is a power of two")
        self.limits = np.array([max_tokens, max_segments, max_loss], float)
        self.next_id, self.pool_size = first_id, pool
        self.need = np.zeros((pool, 3))
        self.items: list[tuple | None] = [None] * pool  # (document, first token, its ids)
        self.free = list(range(pool))
        self.out: list[tuple] = []

    def add(self, doc: object, ids: np.ndarray, loss: int) -> None:
        """One document, its last ``loss`` tokens loss-bearing."""
        tokens, _, most_loss = (int(x) for x in self.limits)
        doc = (doc, len(ids), len(ids) - loss)  # its id, tokens and first loss-bearing token
        start = 0
        while len(ids) - start >= tokens:
            length = self._cut(doc, start, tokens, most_loss)
            if length < tokens:
                break  # the limit on loss cuts it shorter: the pool's work
            self._close([(doc, start, ids[start : start + length])])
            start += length
        while start < len(ids):
            length = self._cut(doc, start, min(tokens, len(ids) - start), most_loss)
            if not self.free:
                self._fill(self.pool_size // 2)
            self._put((doc, start, ids[start : start + length]))
            start += length

    def finish(self) -> None:
        self._fill(0)

    @staticmethod
    def _loss(doc: tuple, start: int, length: int) -> int:
        return max(0, start + length - max(start, doc[2]))

    @staticmethod
    def _cut(doc: tuple, start: int, length: int, loss: int) -> int:
        """The most tokens from ``start``, up to ``length``, that bear at most ``loss``."""
        return min(length, max(0, doc[2] - start) + loss)

    def _put(self, item: tuple) -> None:
        at = self.free.pop()
        doc, start, ids = item
        self.items[at] = item
        self.need[at] = len(ids), 1, self._loss(doc, start, len(ids))

    def _take(self, at: int) -> tuple:
        item = self.items[at]
        self.items[at] = None
        self.need[at] = 0
        self.free.append(at)
        return item

    def _fill(self, down_to: int) -> None:
        """Fill bins until the pool holds at most ``down_to`` pieces."""
        while self.pool_size - len(self.free) > down_to:
            room, segments = self.limits.copy(), []
            while room[0] >= 1 and room[1] >= 1 and len(self.free) < self.pool_size:
                scores = self.need @ (room / self.limits**2)
                waiting = self.need[:, 0] > 0
                fits = waiting & (self.need <= room).all(1)
                at = int(np.argmax(np.where(fits if fits.any() else waiting, scores, -1)))
                if fits.any():
                    doc, start, ids = self._take(at)
                else:
                    doc, start, ids = self.items[at]
                    length = self._cut(doc, start, int(room[0]), int(room[2]))
                    if not length:
                        break
                    self._take(at)
                    self._put((doc, start + length, ids[length:]))
                    ids = ids[:length]
                segments.append((doc, start, ids))
                room -= len(ids), 1, self._loss(doc, start, len(ids))
            self._close(segments)

    def _close(self, segments: list[tuple]) -> None:
        """Write a bin: as one sequence if it is full, else as sequences of a power of two."""
        total = sum(len(ids) for _, _, ids in segments)
        size, offset = 1 << (total.bit_length() - 1), 0
        for doc, start, ids in segments:
            while len(ids):
                part = ids[: size - offset]
                crc = zlib.crc32(np.ascontiguousarray(part, "<u4").data)
                self.out.append((doc[0], start, len(part), crc, doc[1], self.next_id, offset, self._loss(doc, start, len(part))))
                start, ids, offset = start + len(part), ids[len(part) :], offset + len(part)
                if offset == size:
                    total -= size
                    self.next_id, offset = self.next_id + 1, 0
                    size = 1 << (total.bit_length() - 1) if total else 0


def pack(
    docs: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    loss_col: str | None = None,
    loss_share: float = 1.0,
    end_id: int = END_ID,
    max_tokens: int = MAX_TOKENS,
    max_segments: int = MAX_SEGMENTS,
    max_loss: int | None = None,
    pool: int = POOL,
) -> DataFrame:
    """One row per piece: the id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id``, ``offset`` and ``loss_tokens``.

    ``loss_col`` names a column with the number of a document's last tokens that
    bear loss (held to 0 .. its tokens); where it is NULL or there is no such column, the last
    ``loss_share`` of the tokens do (rounded up: an answer behind its question).
    ``max_loss`` is ``max_tokens`` unless given. Each token of each document, with
    ``end_id`` after a text's own, lies in exactly one piece; NULL and empty texts
    are documents of ``end_id`` alone. Repeated rows are packed each on its own,
    an empty table gives no rows, other columns are left out. A very long text is cut
    into as many pieces as it takes. A sequence belongs
    to one task's rows, so ids are unique and tasks pack side by side.
    """
    cols = [id_col, text_col] + ([loss_col] if loss_col else [])
    docs = docs.select(*cols)
    id_type = docs.schema[id_col].dataType
    long = T.LongType()
    schema = T.StructType(
        [T.StructField(id_col, id_type)]
        + [T.StructField(c, long) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens")]
    )
    limits = (max_tokens, max_segments, max_loss or max_tokens, pool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = encoder(vocabulary)
        packer = Packer(TaskContext.get().partitionId() << 33, *limits)
        arrow = None

        def written() -> pa.RecordBatch:
            made, packer.out = packer.out, []
            columns = list(zip(*made, strict=True)) or [()] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(columns[0], arrow), *(pa.array(c, pa.int64()) for c in columns[1:])], names=schema.names)

        for batch in batches:
            arrow = batch.schema.field(id_col).type
            for part in steps(batch, text_col, TOKEN_STEP):
                ids, lengths = end_each(*texts.encode(part.column(text_col)), end_id)
                ends = np.cumsum(lengths).tolist()
                loss = part.column(loss_col).to_pylist() if loss_col else [None] * len(ends)
                for doc, end, n, own in zip(part.column(id_col).to_pylist(), ends, lengths.tolist(), loss, strict=True):
                    packer.add(doc, ids[end - n : end], math.ceil(n * loss_share) if own is None else min(max(int(own), 0), n))
                yield written()
        packer.finish()
        if packer.out:
            yield written()
        release()

    return docs.mapInArrow(run, schema)
