"""Phrases whose words belong together, by top-order marginalisation.

At every word starts one window of the longest length, its columns the word and those that lead on from it, padded where the piece ends. Only these
windows are counted; a ROLLUP over their columns sums them to every shorter prefix and, at its root, to the number of words. As each word starts one window, the
sums are the frequencies of all phrases of every length.

A window also ends before a word with which it would certainly be too rare: two passes count words and pairs, then longer runs of such pairs, by hash in arrays of
fixed size, and what falls in a cell of fewer than ``min_count`` is in no phrase that is asked for, nor in a part of one; neither is a word that is in no such pair. Cells that
several share only let more through, so frequencies are exact. Where data outgrow the arrays they spare less, and the windows that are counted become more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import sketch
from tidemark.llm.shared import cut, sent_small, small_batches

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
UNKNOWN = "und"
#: Cells of an array, as a power of two.
BITS = 24
#: Bytes of text of a task at least, beside which the array and the counts that it sends are small.
TASK_BYTES = 128 << 20
#: Bytes of text at a time, of which several arrays of eight bytes each are made; and windows that a task adds up before it passes them on.
PART_BYTES, HELD_ROWS = 1 << 20, 400_000
#: What tells words that are in a possible pair from phrases in the second array.
_USEFUL = np.uint64(0xD6E8FEB86659FD93)
#: What a byte is: part of a word, a blank between words, the end of a piece.
WORD, BLANK, END = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = BLANK
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = END
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


class Words:
    """The words of some texts: their place in ``data`` (lower-cased bytes), the text of each, whether the next is in the same piece, and hashes that take in the language.

    ``raw``: the texts' bytes, ``starts``: where each begins, ``lang``: its language's number in ``langs``.
    """

    def __init__(self, raw: np.ndarray, starts: np.ndarray, lang: np.ndarray, langs: pa.Array) -> None:
        self.data, self.langs = _LOWER[raw], langs
        kind = _KIND[raw]
        is_word = kind == WORD
        fresh = np.zeros(len(raw) + 1, bool)  # where a text begins, or where all end
        fresh[starts] = fresh[-1] = True
        before = np.zeros(len(raw), bool)
        before[1:] = is_word[:-1]
        self.start = np.flatnonzero(is_word & ~(before & ~fresh[:-1]))
        after = np.zeros(len(raw), bool)
        after[:-1] = is_word[1:]
        self.end = np.flatnonzero(is_word & ~(after & ~fresh[1:])) + 1
        self.text = np.searchsorted(starts, self.start, side="right") - 1
        piece = np.cumsum(kind == END, dtype=np.int32)[self.start]
        self.joined = np.zeros(len(self.start), bool)
        self.joined[:-1] = (piece[1:] == piece[:-1]) & (self.text[1:] == self.text[:-1])
        self.lang = lang[self.text]

    def hashes(self, max_words: int) -> list[np.ndarray]:
        """64-bit hashes of every word, of every word with the next, and so on up to ``max_words``; where there is no next, of no meaning."""
        n = len(self.data)
        power = np.full(n + 1, _BASE)
        power[:1] = 1
        power = np.cumprod(power, dtype=np.uint64)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.data.astype(np.uint64) * power[:-1], out=sums[1:])
        back = np.full(n + 1, _BASE_INVERSE)
        back[:1] = 1
        back = np.cumprod(back, dtype=np.uint64)
        own = np.array([int.from_bytes(x.encode("utf-8", "surrogatepass")[:8], "little") for x in self.langs.to_pylist()], np.uint64)
        word = (sums[self.end] - sums[self.start]) * back[self.start]
        word = _mixed(word ^ (_mixed(own)[self.lang] if len(own) else np.uint64(0)) ^ (self.end - self.start).astype(np.uint64))
        found = [word]
        for m in range(1, max_words):
            longer = np.zeros(len(word), np.uint64)
            longer[: len(word) - m] = _mixed(found[-1][: len(word) - m] * np.uint64(3) + word[m:])
            found.append(longer)
        return found

    def strings(self, which: np.ndarray) -> pa.Array:
        """The words at the given places, dictionary-encoded."""
        start, size = self.start[which], (self.end - self.start)[which]
        offsets = np.zeros(len(which) + 1, np.int64)
        np.cumsum(size, out=offsets[1:])
        at = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
        return pa.LargeStringArray.from_buffers(len(which), pa.py_buffer(offsets), pa.py_buffer(self.data[at])).dictionary_encode()


def _cells(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A cell in each half of the array, from bits of the hash that have nothing to do with each other."""
    half = BITS - 1
    first, second = hashes >> np.uint64(64 - half), (hashes >> np.uint64(64 - 2 * half)) & np.uint64((1 << half) - 1)
    return first.astype(np.int64), second.astype(np.int64) + (1 << half)


def _holds(cells: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    found = np.ones(len(hashes), bool)
    for c in _cells(hashes):
        found &= (cells[c >> 3] >> (7 - (c & 7)).astype(np.uint8) & 1).astype(bool)
    return found


def possible(words: Words, hashes: list[np.ndarray], arrays: list[np.ndarray]) -> list[np.ndarray]:
    """For each length: whether a phrase of so many words starts at a word and may be frequent. The first of ``arrays`` knows words and pairs, the second longer ones and the words of possible pairs; without one all are taken that their parts allow."""
    found: list[np.ndarray] = []
    for m, h in enumerate(hashes, 1):
        if m == 1:
            on = np.ones(len(h), bool)
        else:
            follows = np.zeros(len(h), bool)
            follows[:-1] = found[-1][1:] & words.joined[:-1]
            on = found[-1] & follows
        which = 0 if m <= 2 else 1
        found.append(on & _holds(arrays[which], h) if which < len(arrays) else on)
        if m == 1 and len(arrays) > 1:
            found[0] &= _holds(arrays[1], _mixed(h ^ _USEFUL))
    return found


def parts(batch: pa.RecordBatch) -> Iterator[Words]:
    """The words of a batch (lang, text), about PART_BYTES at a time; long texts are cut between pieces."""
    texts, langs = batch.column(1).fill_null("").cast(pa.large_string()), batch.column(0).fill_null(UNKNOWN).dictionary_encode()
    lang = np.asarray(langs.indices)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    length = int(offsets[-1] - offsets[0])
    if not length:
        return
    raw, offsets = np.frombuffer(texts.buffers()[2], np.uint8, length, int(offsets[0])), offsets - offsets[0]
    edges = np.union1d(np.flatnonzero(_KIND[raw] == END) + 1, offsets)
    at = 0
    while at < length:
        to = int(edges[min(len(edges) - 1, np.searchsorted(edges, at + PART_BYTES))])
        first, last = np.searchsorted(offsets, at, side="right") - 1, np.searchsorted(offsets, to, side="left")
        yield Words(raw[at:to], np.maximum(offsets[first:last], at) - at, lang[first:last], langs.dictionary)
        at = to


def frequent_cells(texts: DataFrame, min_count: int, orders: list[int], known: list[np.ndarray]) -> np.ndarray:
    """A bit for each cell of phrases of ``orders`` words, two of each phrase: whether it holds ``min_count`` occurrences. Only what ``known`` arrays allow is counted; beside a known array words of possible pairs count as such. ``texts``: lang, text."""
    most = min(min_count, 255)
    spread = texts.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << BITS, np.uint8)
        for words in (w for batch in batches for w in parts(batch)):
            hashes = words.hashes(max(2, *orders, 2))
            on = possible(words, hashes, spread.value)
            number, n = np.unique(np.concatenate([c for m in orders for c in _cells(hashes[m - 1][on[m - 1]])] or [np.empty(0, np.int64)]), return_counts=True)
            cells[number] = np.minimum(n + cells[number], most)
            if spread.value:
                useful = on[1].copy()
                useful[1:] |= on[1][:-1]
                for c in _cells(_mixed(hashes[0][useful] ^ _USEFUL)):
                    cells[c] = most
        yield from sketch.blocks_of(cells)

    fold = lambda held, more: more if held is None else np.minimum(held.astype(np.uint16) + more, most).astype(np.uint8)
    return sketch.merged(texts.mapInArrow(count, sketch.SCHEMA), fold, lambda held: np.packbits(held >= most), 1 << BITS)


def _combined(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The first place of every distinct row of ``columns``, and how often it is there."""
    key = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        wide = int(c.max(initial=0)) + 1
        if (int(key.max(initial=0)) + 1) * wide >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        key = key * wide + c
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    return first, n


def windows(texts: DataFrame, max_words: int, arrays: list[np.ndarray]) -> DataFrame:
    """lang, w1 to w``max_words``, n: the padded windows that start at every word, counted by task as far as it can hold them; padding is an empty string."""
    spread = texts.sparkSession.sparkContext.broadcast(arrays)  # twice 2^(BITS - 3) bytes
    names = [f"w{i + 1}" for i in range(max_words)]

    def of(words: Words) -> pa.Table:
        on = possible(words, words.hashes(max_words), spread.value)
        which = np.flatnonzero(on[0])
        strings = words.strings(which)
        code = np.zeros(len(words.start) + max_words, np.int64)  # 0 is padding
        code[which] = np.asarray(strings.indices) + 1
        columns = [words.lang.astype(np.int64), *(np.where(x, code[i : i + len(x)], 0) for i, x in enumerate(on))]
        first, n = _combined(columns)
        values = pa.concat_arrays([pa.array([""], pa.large_string()), strings.dictionary]).cast(pa.string())
        taken = [values.take(pa.array(c[first])) for c in columns[1:]]
        langs = words.langs.cast(pa.string()).take(pa.array(columns[0][first]))
        return pa.Table.from_arrays([langs, *taken, pa.array(n, pa.int64())], names=["lang", *names, "n"])

    def summed(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by(["lang", *names], use_threads=False).aggregate([("n", "sum")]).rename_columns(["lang", *names, "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for words in (w for batch in batches for w in parts(batch)):
            if len(words.start):
                held.append(of(words))
            if sum(t.num_rows for t in held) > 2 * HELD_ROWS:
                held = [summed(held)]
                if held[0].num_rows > HELD_ROWS:
                    yield from held.pop().to_batches(max_chunksize=10_000)
        if held:
            yield from summed(held).to_batches(max_chunksize=10_000)

    return texts.mapInArrow(count, "lang string, " + "".join(f"{c} string, " for c in names) + "n long")


def frequencies(texts: DataFrame, max_words: int, min_count: int) -> DataFrame:
    """lang, words (array), f: every phrase of up to ``max_words`` words found ``min_count`` times, and each language's number of words under no words at all."""
    # Fewer tasks, but never fewer than there are cores.
    cores = texts.sparkSession.sparkContext.defaultParallelism
    texts = texts.coalesce(max(cores, sketch.total(texts, F.octet_length("text")) // TASK_BYTES))
    arrays = [frequent_cells(texts, min_count, [1, 2], [])]
    arrays.append(frequent_cells(texts, min_count, list(range(3, max_words + 1)), arrays))
    counted = windows(texts, max_words, arrays)
    names = [f"w{i + 1}" for i in range(max_words)]
    rolled = counted.rollup("lang", *names).agg(F.sum("n").alias("f"), F.bit_count(F.grouping_id()).alias("above"))
    m = F.lit(max_words) - F.col("above")
    # The root over all languages goes; so do sums of windows that are padded within the prefix.
    rolled = rolled.filter(f"above <= {max_words}").withColumn("words", F.slice(F.array(*names), 1, m))
    whole = F.when(m == 0, True).otherwise((F.col("f") >= min_count) & (F.try_element_at("words", m) != ""))
    return rolled.filter(whole).select("lang", "words", "f")


def mine(docs: DataFrame, *, max_words: int = 5, min_count: int = 100, top: int = 2_000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of 2 to ``max_words`` words of each language.

    Texts in lower case (A-Z) are cut at ``[.,;:!?]`` and line ends into pieces, these at blanks and tabs into words; phrases lie within pieces, overlaps count. A null
    language is ``und``, with those that are named so. ``a`` is a phrase's frequency, ``n`` the language's words; of its cuts the one with the lowest floor(1000 a n / (l r))
    counts, ties to the shortest first part, whose frequency is ``l``, that of the rest ``r``. A phrase inside a longer one that is as frequent goes; as frequency only
    falls with length, such a one with one word more is there as well, so those are compared. Ranks go by score, ``a``, then the phrase's bytes.

    Null, empty and blank texts have no words; long texts are read whole; repeated rows count each. Languages without such a phrase, and an empty
    table, give no rows. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text"))
    found = cut(frequencies(texts, max_words, min_count))
    n_words = sent_small(found.filter("size(words) = 0").select("lang", F.col("f").alias("n")))  # a row per language
    phrases = found.filter("size(words) > 0").select("lang", F.array_join("words", " ").alias("phrase"), "words", "f")
    candidates = phrases.filter("size(words) > 1")
    # Both parts of every cut, looked up by their text.
    part = lambda start, size: F.array_join(F.slice("words", start, size), " ")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.select("lang", "phrase", F.col("f").alias("a"), "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.size("words") - F.col("k")).alias("right"))
    of = lambda name, count: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    cuts = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"]).join(n_words, "lang")
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    cuts = cuts.withColumn("score", F.expr(f"({wide('a')} * {wide('n')} * 1000) div ({wide('l')} * {wide('r')})"))
    scored = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("b")).select("lang", "phrase", "b.*")
    ends = F.array(part(F.lit(1), F.size("words") - 1), part(F.lit(2), F.size("words") - 1))
    longer = candidates.filter("size(words) > 2").select("lang", F.explode(ends).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").filter("longer is null or 100 * longer < 100 * a")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    # The rank's limit is applied before the shuffle too.
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
