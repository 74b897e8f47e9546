"""Token ids of whole texts by the ``tokenizers`` library, a vocabulary file's path being a parameter.

Both public vocabularies split a text before they merge, and never across a space between two words. So a
batch's texts are split at spaces and at stops, each distinct chunk goes through the tokenizer once, and a text's ids
are its chunks' ids in order. A text where a space is not such a boundary (a run of white space) goes through
the tokenizer whole. Ids are kept as little-endian 32-bit numbers.
"""

from __future__ import annotations

import array
import os
import re
import sys
from collections.abc import Iterable

import numpy as np
import pyarrow as pa

from tidemark.llm.shared import held

#: Chunks that a worker keeps, in two generations: a full one becomes the old one, from which what is met again comes back.
CACHE_CHUNKS = 200_000
#: Longer chunks are not kept.
CACHE_CHARS = 64
#: New words that go through the tokenizer as one text.
TOGETHER = 400
#: Where a space is not a boundary of its own: within three or more white spaces, or after another one at the end.
_RUN = re.compile(r"\s\s(?:\s|$)")
#: White space to str.split() alone.
_SEPARATORS = re.compile("[\x1c-\x1f]")
#: How a special token's string starts, which is looked for across all other boundaries.
_SPECIAL = "<|"
#: A stop or comma after a plain letter or digit and before white space is a token of its own, and so is a line break between others.
_PLAIN = "[0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]"
_STOP = re.compile(rf"[.,](?<={_PLAIN}[.,])(?=\s|\Z)")
_STOP_OR_LINE = re.compile(rf"[.,](?<={_PLAIN}[.,])(?=[ \n]|\Z)|\n(?<=\S\n)(?=\S)")
#: Last letter of the blocks in which lower case is decided letter by letter and no letter combines with another; and what is not of them (U+0130 has a lower case of two letters).
_LATIN = "\u017f"
_BEYOND = re.compile("[^\x00-\u012f\u0131-\u017f]")


class Encoder:
    """Encodes batches of texts; one per vocabulary file and worker."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # A vocabulary that normalizes drops white space and case altogether; the others keep a space as part of the next word.
        self.normalizes = self.tokenizer.normalizer is not None
        # Tokens that end a word, or those that start with its space.
        vocabulary = self.tokenizer.get_vocab()
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        self.edge[[i for t, i in vocabulary.items() if (t.endswith("</w>") if self.normalizes else t.startswith("\u0120"))]] = True
        self.ids: tuple[dict, dict] = {}, {}
        self.spans: tuple[dict, dict] = {}, {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        return held(f"encoder of {path}", lambda: cls(path))

    def _chunks(self, text: str) -> list[str] | None:
        if _SPECIAL in text:
            return None
        if self.normalizes:
            if _SEPARATORS.search(text):
                return None
            if text.isascii() or not _BEYOND.search(text):
                text = text.lower()
            return _STOP.sub(r" \g<0>", text).split()
        if _RUN.search(text) or "\0" in text:
            return None
        return _STOP_OR_LINE.sub("\0\\g<0>\0", text).replace(" ", "\0 ").replace("\0\0", "\0").split("\0") if text else []

    def _encode_each(self, chunks: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(chunks), 20_000):
            out += [le32(e.ids) for e in self.tokenizer.encode_batch_fast(chunks[i : i + 20_000], add_special_tokens=False)]
        return out

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of chunks that are a word of plain letters each: many are encoded as one text, whose tokens tell where a word ends or starts."""
        out: list[bytes] = []
        between = " " if self.normalizes else ""
        for i in range(0, len(words), 50 * TOGETHER):
            runs = [words[j : j + TOGETHER] for j in range(i, min(i + 50 * TOGETHER, len(words)), TOGETHER)]
            for run, e in zip(runs, self.tokenizer.encode_batch_fast([between.join(x) for x in runs], add_special_tokens=False)):
                ids = np.array(e.ids, "<u4")
                at = np.flatnonzero(self.edge[ids])
                bounds = np.concatenate([[0], at + 1]) if self.normalizes else np.concatenate([at, [len(ids)]])
                if len(bounds) != len(run) + 1 or bounds[0] or bounds[-1] != len(ids):
                    out += self._encode_each(run)
                    continue
                raw, ends = ids.tobytes(), (4 * bounds).tolist()
                out += [raw[a:b] for a, b in zip(ends, ends[1:])]
        return out

    def _learn(self, wanted: set[str]) -> tuple[dict[str, bytes], list[str]]:
        """Ids of every wanted chunk, and the new chunks too long to keep."""
        young, old = self.ids
        if len(young) > CACHE_CHUNKS:
            young, old = self.ids = {}, young
        new = wanted.difference(young)
        again = new & old.keys()
        for x in again:
            young[x] = old[x]
        new -= again
        first = 0 if self.normalizes else 1
        plain = [x for x in new if x[first:].isalpha() and (first == 0 or x[0] == " ") and (x.isascii() or max(x) <= _LATIN)]
        young.update(zip(plain, self._encode_words(plain)))
        others = list(new.difference(plain))
        young.update(zip(others, self._encode_each(others)))
        return young, [x for x in new if len(x) > CACHE_CHARS]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids; null texts count as empty."""
        split = [self._chunks(x or "") for x in texts]
        wanted: set[str] = set().union(*[x for x in split if x])
        (known, long), out = self._learn(wanted), []
        get = known.__getitem__
        for text, chunks in zip(texts, split):
            out.append(le32(self.tokenizer.encode(text, add_special_tokens=False).ids) if chunks is None else b"".join(map(get, chunks)))
        for x in long:
            del known[x]
        return out

    def offsets(self, texts: list[str | None]) -> list[np.ndarray]:
        """Each text's token spans as rows (start, end) in characters, each text encoded once."""
        split = [None if self.normalizes else self._chunks(x or "") for x in texts]
        wanted: set[str] = set().union(*[x for x in split if x])
        young, old = self.spans
        if len(young) > CACHE_CHUNKS // 2:
            young, old = self.spans = {}, young
        new = wanted.difference(young)
        again = new & old.keys()
        for x in again:
            young[x] = old[x]
        order = list(new - again)
        for i in range(0, len(order), 20_000):
            some = order[i : i + 20_000]
            for x, e in zip(some, self.tokenizer.encode_batch(some, add_special_tokens=False)):
                young[x] = array.array("i", [v for span in e.offsets for v in span]).tobytes()
        get, out = young.__getitem__, []
        for text, chunks in zip(texts, split):
            if chunks is None:
                found = np.array(self.tokenizer.encode(text or "", add_special_tokens=False).offsets, np.int64).reshape(-1, 2)
            else:
                parts = list(map(get, chunks))
                found = np.frombuffer(b"".join(parts), np.int32).reshape(-1, 2).astype(np.int64)
                lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
                counts = np.fromiter(map(len, parts), np.int64, len(parts)) >> 3
                found += np.repeat(np.cumsum(lengths) - lengths, counts)[:, None]
            out.append(found)
        for x in order:
            if len(x) > CACHE_CHARS:
                del young[x]
        return out


def le32(ids: list[int]) -> bytes:
    a = array.array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


def slices(rows: list, chars: int = 2 << 20, size=lambda x: len(x or "")) -> Iterable[list]:
    """Runs of rows of about so many characters, so that no step holds a whole batch's tokens."""
    run, n = [], 0
    for x in rows:
        run.append(x)
        n += size(x)
        if n >= chars:
            yield run
            run, n = [], 0
    if run:
        yield run


def text_parts(batch: pa.RecordBatch, texts) -> Iterable[tuple[pa.RecordBatch, list]]:
    """A batch's rows in runs of about two million characters, each with what ``texts`` finds in it, so that no step holds a whole batch's strings."""
    for i in range(0, batch.num_rows, 1024):
        part, at = batch.slice(i, 1024), 0
        for some in slices(texts(part).to_pylist()):
            yield part.slice(at, len(some)), some
            at += len(some)
