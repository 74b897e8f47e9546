"""Lines that many documents share, found with two Bloom filters.

Every task enters the hash of each line, once a document, in a filter of what it has seen; what it has seen already goes in a second one. The tasks' filters are
joined block by block: a bit that two tasks have in the first belongs to the second. So each line of two documents has all its bits in the second filter, which every executor gets; it has a
fixed size. Only lines that it suspects are shuffled, counted by task before, and counted exactly there; their first occurrence is found along with that.

What is confirmed is sent to all tasks while its number, counted first, allows that; otherwise it meets the documents by shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from tidemark.llm import sketch
from tidemark.llm.shared import cut, small_batches

#: Stripped at both ends of a line.
WHITE = b" \t\n\x0b\x0c\r"
#: Bits that a line sets, bits of a filter for each line, and a filter's least and most bits as powers of two.
HASHES, BITS_PER_LINE, LEAST_BITS, MOST_BITS = 4, 5, 15, 28
#: Confirmed lines that are sent to every task at most (16 bytes each, and where the first one stands).
BROADCAST_KEYS = 1_000_000
#: Suspected lines that a task holds before it passes them on.
HELD_KEYS = 100_000


def key_of(line: bytes, min_chars: int) -> bytes | None:
    """A line's 128-bit digest, stripped and A-Z in lower case; None if it has fewer code points."""
    line = line.strip(WHITE).lower()  # of bytes, only A-Z have another case
    if len(line) < min_chars or min_chars > 1 and len(line.decode("utf-8", "replace")) < min_chars:
        return None
    return hashlib.blake2b(line, digest_size=16).digest()


def _texts(column: pa.Array) -> Iterator[bytes]:
    """Texts as bytes, a null one empty; a few at a time."""
    for i in range(0, len(column), 256):
        for text in column.slice(i, 256).cast(pa.binary()).to_pylist():
            yield text or b""


def _bits(digests: list[bytes], bits: int) -> np.ndarray:
    """(digests, HASHES): the bits that each sets."""
    h = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
    return (((h[:, :1] + np.arange(HASHES, dtype=np.uint64) * (h[:, 1:] | np.uint64(1))) >> np.uint64(1)) & np.uint64((1 << bits) - 1)).astype(np.int64)


def _has(filter_: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((filter_[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def _enter(filter_: np.ndarray, at: np.ndarray) -> None:
    at = at.ravel()
    np.bitwise_or.at(filter_, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))


def seen_twice(docs: DataFrame, bits: int, min_chars: int, text_col: str) -> np.ndarray:
    """The second filter over all tasks: every key of two documents has all its bits there."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(1 << (bits - 3), np.uint8), np.zeros(1 << (bits - 3), np.uint8)
        for batch in batches:
            keys: list[bytes] = []
            for text in _texts(batch.column(0)):
                keys += {k for k in (key_of(line, min_chars) for line in text.split(b"\n")) if k}
            if keys:
                at = _bits(keys, bits)
                _, first, n = np.unique(np.frombuffer(b"".join(keys), np.uint64)[::2], return_index=True, return_counts=True)
                at = at[first]
                _enter(twice, at[(n > 1) | _has(once, at)])
                _enter(once, at)
        # Halves of a block: the first filter's bytes, then the second's.
        half = min(sketch.BLOCK, 2 * len(once)) // 2
        yield from sketch.blocks_of(np.concatenate([once.reshape(-1, half), twice.reshape(-1, half)], axis=1).ravel())

    def fold(held: np.ndarray | None, more: np.ndarray) -> np.ndarray:
        if held is None:
            return more
        half = len(held) // 2
        return np.concatenate([held[:half] | more[:half], held[half:] | more[half:] | held[:half] & more[:half]])

    second = lambda held: held.reshape(-1, 2, min(sketch.BLOCK, len(held)) // 2)[:, 1].ravel()
    return sketch.merged(docs.select(text_col).mapInArrow(fill, sketch.SCHEMA), fold, second, 1 << (bits - 2))


def repeated(docs: DataFrame, *, min_docs: int, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Any]:
    """(key, docs, first) of every line that ``min_docs`` rows hold, and the filter (broadcast) that suspected them.

    ``first`` says where a line is first, by id (nulls last), the text's digest and the line's number.
    """
    lines = F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit("\n"))) + 1
    bits = sketch.bits_for(BITS_PER_LINE * sketch.total(docs, lines), LEAST_BITS, MOST_BITS)
    spread = docs.sparkSession.sparkContext.broadcast((seen_twice(docs, bits, min_chars, text_col), bits))  # 2^(MOST_BITS - 3) bytes at most
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = StructType([StructField("key", BinaryType()), StructField("docs", LongType()), StructField("none", BooleanType()), StructField("id", rows.schema["id"].dataType), StructField("digest", BinaryType()), StructField("line", IntegerType())])

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for id_, text in zip(batch.column(0).to_pylist(), _texts(batch.column(1))):
                places = {}
                for i, line in enumerate(text.split(b"\n")):
                    k = key_of(line, min_chars)
                    if k:
                        places.setdefault(k, i)
                if not places:
                    continue
                keys, digest = list(places), hashlib.blake2b(text, digest_size=16).digest()
                for j in np.flatnonzero(_has(spread.value[0], _bits(keys, spread.value[1]))).tolist():
                    here = (id_ is None, id_, digest, places[keys[j]])
                    was = held.setdefault(keys[j], [0, here])
                    was[0] += 1
                    if before(here, was[1]):
                        was[1] = here
            if len(held) > HELD_KEYS:
                yield out(held, kind)
                held = {}
        if held:
            yield out(held, kind)

    def before(a: tuple, b: tuple) -> bool:
        return (a[0], a[2:]) < (b[0], b[2:]) if a[1] is None or b[1] is None else a < b

    def out(held: dict[bytes, list], kind: pa.DataType) -> pa.RecordBatch:
        firsts = list(zip(*(x[1] for x in held.values())))
        types = (pa.bool_(), kind, pa.binary(), pa.int32())
        columns = [pa.array(list(held), pa.binary()), pa.array([x[0] for x in held.values()], pa.int64()), *(pa.array(c, t) for c, t in zip(firsts, types))]
        return pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    counted = rows.mapInArrow(suspects, schema).groupBy("key").agg(F.sum("docs").alias("docs"), F.min(F.struct("none", "id", "digest", "line")).alias("first"))
    return counted.filter(F.col("docs") >= min_docs), spread


def drop_lines(docs: DataFrame, *, min_docs: int = 2, min_chars: int = 1, keep_first: bool = True, id_col: str = "doc_id", text_col: str = "text", broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept: every row with its text less the lines that ``min_docs`` rows hold; with ``keep_first`` the first occurrence of each stays.

    Lines end at \\n; they are alike if they are with white space stripped at both ends and A-Z in lower case. Those of fewer than ``min_chars`` code points are never
    dropped, and a row's repeats of a line count once, though all are dropped. Each row is a document of its own, also where an id is null or repeated; rows alike in id and text fare
    alike. The first occurrence is that of the smallest id (nulls last), of equal ids that of the smaller digest of the text, there the first line. A null or empty text is one empty line and is
    kept as an empty text. Long texts are read whole. An empty table gives no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    found, spread = repeated(docs, min_docs=min_docs, min_chars=min_chars, id_col=id_col, text_col=text_col)
    found = cut(found)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sent = None
    if found.count() <= broadcast_keys:
        some = found.select("key", "first").toArrow()
        sent = docs.sparkSession.sparkContext.broadcast({k: (tuple(f.values()) if keep_first else ()) for k, f in zip(some.column(0).to_pylist(), some.column(1).to_pylist())})
    else:
        rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
        schema = "row long, key binary"

        def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: tuple[list, list] = [], []
                for row, text in zip(batch.column(0).to_pylist(), _texts(batch.column(1))):
                    keys = list({k for k in (key_of(line, min_chars) for line in text.split(b"\n")) if k})
                    for j in np.flatnonzero(_has(spread.value[0], _bits(keys, spread.value[1]))).tolist() if keys else ():
                        out[0].append(row)
                        out[1].append(keys[j])
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary())], names=["row", "key"])

        # A document's keys are no more than its lines.
        mine = rows.select("row", "text").mapInArrow(asked, schema).join(found.select("key", "first"), "key").groupBy("row").agg(F.collect_list(F.struct("key", "first")).alias("met"))
        rows = rows.join(mine, "row", "left").select("doc_id", "text", "met")
    schema = StructType([rows.schema["doc_id"], StructField("n_lines", LongType()), StructField("n_dropped", LongType()), StructField("kept", StringType())])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, dropped, kept = [], [], []
            each = batch.column(2).to_pylist() if sent is None else [None] * batch.num_rows
            for id_, text, met in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), each):
                drop = sent.value if sent is not None else {m["key"]: (tuple(m["first"].values()) if keep_first else ()) for m in met or ()}
                lines, mine = text.split(b"\n"), []
                own = hashlib.blake2b(text, digest_size=16).digest() if keep_first and drop else b""
                for i, line in enumerate(lines):
                    k = key_of(line, min_chars) if drop else None
                    if k not in drop or keep_first and drop[k] == (id_ is None, id_, own, i):
                        mine.append(line)
                counts.append(len(lines))
                dropped.append(len(lines) - len(mine))
                kept.append(b"\n".join(mine))
            # As it came: what Spark holds as text is not judged here.
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary()).view(pa.string())], names=schema.fieldNames())

    return rows.mapInArrow(clean, schema)
