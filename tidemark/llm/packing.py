"""Harmonic packing of token sequences into bins of fixed capacity.

A length in (C/(k+1), C/k] belongs to class k, and a bin of class k takes exactly k pieces. Every worker
packs its own rows, one open bin a class, and needs nothing from the others: there is no shuffle. Documents may be
cut, so a length that would leave much of its class's slot empty gives up a piece that fills a slot instead, and
the rest is classed again. The bins still open at a worker's end are joined end to end and cut at the capacity, the last at
powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tokens import Encoder, le32, slices

FIELDS = (("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("doc_tokens", "long"), ("sequence_id", "long"), ("offset", "long"))


def cut_length(length: int, capacity: int, classes: int, slack: float) -> list[tuple[int, int]]:
    """(piece, class) in document order; every piece but those of the last class fills 1 - slack of its slot or more."""
    out = []
    while length:
        k = max(1, min(capacity // length, classes))
        slot = capacity // k
        if length <= slot and (length >= slot * (1 - slack) or k == classes):
            piece = length
        else:
            k = 1 if length > capacity else k + 1
            piece = capacity // k
        out.append((piece, k))
        length -= piece
    return out


class HarmonicPacker:
    """Packs pieces as they come; memory is bounded by the open bins, one a class."""

    def __init__(self, capacity: int, classes: int, slack: float, first_id: int) -> None:
        self.capacity, self.classes, self.slack, self.next_id = capacity, classes, slack, first_id
        self.open: dict[int, list] = {}

    def _close(self, pieces: list) -> Iterator[tuple]:
        offset = 0
        for doc, start, ids, total in pieces:
            yield doc, start, len(ids) // 4, zlib.crc32(ids), total, self.next_id, offset
            offset += len(ids) // 4
        self.next_id += 1

    def add(self, doc, ids: bytes) -> Iterator[tuple]:
        total, start = len(ids) // 4, 0
        for piece, k in cut_length(total, self.capacity, self.classes, self.slack):
            bin_ = self.open.setdefault(k, [])
            bin_.append((doc, start, ids[4 * start : 4 * (start + piece)], total))
            start += piece
            if len(bin_) == k:
                yield from self._close(self.open.pop(k))

    def finish(self) -> Iterator[tuple]:
        left = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        rest = sum(len(p[2]) // 4 for p in left)
        sequence: list = []
        filled, room = 0, self._room(rest)
        for doc, start, ids, total in left:
            while ids:
                take = min(room - filled, len(ids) // 4)
                sequence.append((doc, start, ids[: 4 * take], total))
                start, ids, filled, rest = start + take, ids[4 * take :], filled + take, rest - take
                if filled == room:
                    yield from self._close(sequence)
                    sequence, filled, room = [], 0, self._room(rest)

    def _room(self, rest: int) -> int:
        return self.capacity if rest >= self.capacity else 1 << (rest.bit_length() - 1) if rest else 0


def pack(
    docs: DataFrame, *, vocabulary: str, capacity: int = 2048, end_id: int = 1, classes: int = 256, slack: float = 1 / 32, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is a document of its end id alone; a null id stays null. Repeated rows are documents of
    their own. A text of any length is cut into pieces of the capacity and a rest. Sequence ids are unique, not
    dense: the task's number, then a count. Other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    doc_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder.of(vocabulary), le32([end_id])
        packer = HarmonicPacker(capacity, classes, slack, TaskContext.get().partitionId() << 40)
        kind = None

        def batch_of(pieces: list) -> pa.RecordBatch:
            columns = list(zip(*pieces))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(x, pa.int64()) for x in columns[1:])], names=["doc_id", *(n for n, _ in FIELDS)])

        for batch in batches:
            kind = batch.column(0).type
            for part in slices(list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())), size=lambda x: len(x[1] or "")):
                pieces = [p for (doc, _), ids in zip(part, encoder.encode([t for _, t in part])) for p in packer.add(doc, ids + end)]
                if pieces:
                    yield batch_of(pieces)
        if pieces := list(packer.finish()):
            yield batch_of(pieces)

    return rows.mapInArrow(run, f"doc_id {doc_type}, " + ", ".join(f"`{n}` {t}" for n, t in FIELDS))
