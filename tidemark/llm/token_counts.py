"""Token counts of fields or sections from one encoding of each whole document.

A document is encoded once and its tokens' character spans are joined by interval with its sections. A
token that crosses a boundary is given by rule: ``start`` to the section of its first character,
``overlap`` to the one that holds most of it (the earlier of two alike), ``share`` to all in proportion to their characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tokens import Encoder, slices

RULES = ("start", "overlap", "share")


def line_spans(text: str) -> np.ndarray:
    """(start, end) of each line with its line break; an empty text is one empty line."""
    ends = np.cumsum([len(x) + 1 for x in text.split("\n")])
    ends[-1] -= 1
    starts = np.concatenate([[0], ends[:-1]])
    return np.stack([starts, ends], 1)


def allocate(tokens: np.ndarray, spans: np.ndarray, rule: str) -> tuple[np.ndarray, float]:
    """Tokens of each section, and those in none. ``spans`` are ascending and do not overlap."""
    counts = np.zeros(len(spans))
    if not len(tokens) or not len(spans):
        return counts, float(len(tokens))
    starts, ends = spans[:, 0], spans[:, 1]
    t0, t1 = tokens[:, 0], np.maximum(tokens[:, 1], tokens[:, 0] + 1)
    first = np.searchsorted(ends, t0, side="right")  # the first section that ends after the token starts
    if rule == "start":
        inside = (first < len(spans)) & (starts[np.minimum(first, len(spans) - 1)] <= t0)
        np.add.at(counts, first[inside], 1)
        return counts, float(len(tokens) - inside.sum())
    last = np.searchsorted(starts, t1, side="left")  # one past the last section that starts before it ends
    n = np.maximum(last - first, 0)
    token = np.repeat(np.arange(len(tokens)), n)
    section = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    held = np.minimum(ends[section], t1[token]) - np.maximum(starts[section], t0[token])
    token, section, held = token[held > 0], section[held > 0], held[held > 0]
    if rule == "share":
        part = held / (t1 - t0)[token]
        np.add.at(counts, section, part)
        return counts, float(len(tokens) - part.sum())
    order = np.lexsort((section, -held, token))
    _, best = np.unique(token[order], return_index=True)
    np.add.at(counts, section[order][best], 1)
    return counts, float(len(tokens) - len(best))


def attribute(docs: DataFrame, *, vocabulary: str, rule: str = "start", sections: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and section: doc_id, section (from 0), start, end, n_tokens, doc_tokens.

    ``sections`` names a column of array<struct<start, end>> in characters, ascending and apart; without it the
    sections are the lines, which leave no character out. Tokens in no section are counted as section -1,
    if there are any, with null bounds. Null text is empty text: one empty line with no token; a null or empty section list leaves the document's
    tokens in section -1. Repeated rows are counted each; other columns are ignored; an empty table gives no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    spans_col = F.lit(None).cast("array<struct<start:long,end:long>>") if sections is None else F.col(sections).cast("array<struct<start:long,end:long>>")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), spans_col.alias("spans"))
    doc_type = rows.schema["doc_id"].dataType.simpleString()
    by_line = sections is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(vocabulary)
        for batch in batches:
            kind = batch.column(0).type
            for some in slices(list(zip(*(batch.column(i).to_pylist() for i in range(3)))), size=lambda x: len(x[1] or "")):
                ids: list = []
                out: list[np.ndarray] = []
                for (doc_id, text, given), tokens in zip(some, encoder.offsets([x[1] for x in some])):
                    spans = line_spans(text or "") if by_line else np.array([(s["start"], s["end"]) for s in given or [] if s], np.int64).reshape(-1, 2)
                    counts, outside = allocate(tokens, spans, rule)
                    block = np.column_stack([np.arange(len(spans)), spans, counts])
                    if outside > 1e-9 or not len(spans):
                        block = np.vstack([block, [-1, np.nan, np.nan, outside]])
                    ids += [doc_id] * len(block)
                    out.append(np.column_stack([block, np.full(len(block), float(len(tokens)))]))
                m = np.vstack(out)
                whole = lambda x: pa.array(x, from_pandas=True).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(ids, kind), whole(m[:, 0]), whole(m[:, 1]), whole(m[:, 2]), pa.array(m[:, 3]), whole(m[:, 4])], names=["doc_id", "section", "start", "end", "n_tokens", "doc_tokens"])

    return rows.mapInArrow(run, f"doc_id {doc_type}, section long, start long, end long, n_tokens double, doc_tokens long")
