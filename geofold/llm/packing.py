"""Vector bin packing of examples into fixed-length training sequences.

An example demands a vector (tokens, segments, loss-bearing tokens); a sequence
has a capacity for each. Each task packs what it reads: an open sequence takes,
again and again, the buffered example with the largest dot product of demand and
remaining capacity (both as shares of the capacities) among those that fit. If
none fits but capacity remains in every dimension, the best-aligned example is cut.
The work is a map over input partitions: no shuffle, and a task that is run
again yields the same sequences.

Defined cases: null and empty texts are one-token documents (the end token);
texts longer than a sequence are cut; equal rows are packed each on its own;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from geofold.llm.common import mapped
from geofold.llm.tokens import encoder

MAX_TOKENS = 1024
MAX_SEGMENTS = 256
#: Examples among which the dot product chooses; bounds a task's memory.
BUFFER = 512
END_ID = 0
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, loss_tokens long, sequence_id long, offset long"
#: Sequence numbers of a task start at its partition's number times this.
STRIDE = 1 << 40

class Packer:
    """Packs examples of one task; ``pieces()`` hands out what is placed."""

    def __init__(self, first_sequence: int, max_tokens=MAX_TOKENS, max_segments=MAX_SEGMENTS, max_loss=None, buffer=BUFFER):
        self.cap = np.array([max_tokens, max_segments, max_tokens if max_loss is None else max_loss], float)
        if self.cap.min() < 1:
            raise ValueError("each limit must be at least 1")
        self.next_sequence, self.buffer = first_sequence, buffer
        self.demand = np.zeros((2 * buffer + 2, 3))
        self.waiting: list = []  # (key, ids as bytes, start, doc_tokens, loss flags or None)
        self.out: list[tuple] = []

    def add(self, key, ids: bytes, loss: np.ndarray | None = None) -> None:
        """Queue a document's ids; whole sequences' worth is cut off at once. loss: a flag for each id, or None for all."""
        total, start, step = len(ids) // 4, 0, int(self.cap[0])
        while loss is None and self.cap[2] >= step and total - start >= step:
            self._emit(key, ids, start, step, total, step, self._new(), 0)
            start += step
        while start < total:
            stop = min(total, start + step)
            if loss is not None or self.cap[2] < step:
                stop = start + self._prefix(loss, start, stop, self.cap[0], self.cap[2])
            self._queue((key, ids[4 * start : 4 * stop], start, total, None if loss is None else loss[start:stop]))
            start = stop
        while len(self.waiting) >= self.buffer:
            self._fill()

    def finish(self) -> None:
        while self.waiting:
            self._fill(last=True)

    def pieces(self) -> list[tuple]:
        out, self.out = self.out, []
        return out

    def _new(self) -> int:
        self.next_sequence += 1
        return self.next_sequence - 1

    @staticmethod
    def _prefix(loss, start: int, stop: int, tokens: float, loss_left: float) -> int:
        """Most tokens from start that keep both limits; at least 1 if both are."""
        n = int(min(stop - start, tokens))
        if loss is None:
            return int(min(n, loss_left))
        return int(np.searchsorted(np.cumsum(loss[start : start + n]), loss_left, side="right"))

    def _queue(self, item) -> None:
        _, ids, _, _, loss = item
        n = len(ids) // 4
        if len(self.waiting) == len(self.demand):
            self.demand = np.vstack([self.demand, np.zeros_like(self.demand)])
        self.demand[len(self.waiting)] = (n, 1, n if loss is None else int(loss.sum()))
        self.waiting.append(item)

    def _take(self, i: int):
        """Remove item i; the last one moves into its place."""
        item, last = self.waiting[i], len(self.waiting) - 1
        self.waiting[i] = self.waiting[last]
        self.demand[i] = self.demand[last]
        self.waiting.pop()
        return item

    def _fill(self, last: bool = False) -> None:
        """Fill one sequence from the buffer."""
        left, placed = self.cap.copy(), []
        while self.waiting and left.min() >= 1:
            d = self.demand[: len(self.waiting)]
            score = d @ (left / self.cap**2)
            fits = (d <= left).all(axis=1)
            if fits.any():
                i = int(np.argmax(np.where(fits, score, -1)))
                key, ids, start, total, loss = self._take(i)
            else:
                i = int(np.argmax(score))
                key, ids, start, total, loss = self._take(i)
                n = self._prefix(loss, 0, len(ids) // 4, left[0], left[2])
                self._queue((key, ids[4 * n :], start + n, total, None if loss is None else loss[n:]))
                ids, loss = ids[: 4 * n], None if loss is None else loss[:n]
            n = len(ids) // 4
            borne = n if loss is None else int(loss.sum())
            placed.append((key, ids, start, n, total, borne))
            left -= (n, 1, borne)
        used = sum(p[3] for p in placed)
        sequence, offset, parts = self._new(), 0, self._tail(used) if last and not self.waiting else [used]
        for key, ids, start, n, total, borne in placed:
            done = 0
            while done < n:
                m = min(n - done, parts[0] - offset)
                if m < n:
                    self._emit(key, ids[4 * done : 4 * (done + m)], start + done, m, total, min(m, borne), sequence, offset, whole=False)
                else:
                    self._emit(key, ids, start, n, total, borne, sequence, offset, whole=False)
                done, offset = done + m, offset + m
                if offset == parts[0]:
                    parts = parts[1:]
                    sequence, offset = (self._new() if parts else sequence), 0

    def _tail(self, used: int) -> list[int]:
        """The task's last tokens: sequences of powers of two need no padding."""
        return [1 << b for b in range(used.bit_length() - 1, -1, -1) if used >> b & 1] if used < self.cap[0] else [used]

    def _emit(self, key, ids, start, n, total, borne, sequence, offset, whole=True) -> None:
        crc = zlib.crc32(ids[4 * start : 4 * (start + n)] if whole else ids)
        self.out.append((key, start, n, crc, total, borne, sequence, offset))


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None, buffer: int = BUFFER) -> DataFrame:
    """Pieces of all documents with their places, by ``SCHEMA``; every token bears loss."""
    return _packed(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), tokenizer_path, max_tokens, max_segments, max_loss, buffer)


def pack_examples(examples: DataFrame, tokenizer_path: str, id_col: str = "doc_id", prompt_col: str = "prompt", response_col: str = "response", max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None, buffer: int = BUFFER) -> DataFrame:
    """Instruction data: only the response and the end token bear loss."""
    return _packed(examples.select(examples[id_col].cast("long").alias("doc_id"), examples[prompt_col].alias("prompt"), examples[response_col].alias("text")), tokenizer_path, max_tokens, max_segments, max_loss, buffer)


def _packed(df: DataFrame, path: str, max_tokens, max_segments, max_loss, buffer) -> DataFrame:
    """df: doc_id and text, or doc_id, prompt and text."""
    end, prompted = np.array([END_ID], "<u4").tobytes(), "prompt" in df.columns
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def rows(pieces: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*pieces, strict=True)) if pieces else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = Packer(TaskContext.get().partitionId() * STRIDE, max_tokens, max_segments, max_loss, buffer)
        encode = encoder(path)
        for batch in batches:
            texts = encode.batch(batch.column(batch.schema.get_field_index("text")))
            prompts = encode.batch(batch.column(1)) if prompted else [b""] * len(texts)
            for key, head, ids in zip(batch.column(0).to_pylist(), prompts, texts, strict=True):
                ids, loss = ids + end, None
                if prompted:
                    loss = np.repeat([0, 1], [len(head) // 4, len(ids) // 4])
                    ids = head + ids
                packer.add(key, ids, loss)
            if len(packer.out) > 20_000:
                yield rows(packer.pieces())
        packer.finish()
        yield rows(packer.pieces())

    return mapped(df, pack, SCHEMA)
