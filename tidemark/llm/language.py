"""Language identification by words first, shorter character n-grams for words not known.

The model counts, per language, the words of a bounded sample of its documents. A known word scores its log frequency in every language. A
word that no language knows is cut into n-grams of its letters, edges marked, and scored by the longest order of
which it has a known n-gram, then by shorter ones, down to single letters. A document's score is the sum over its words.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tidemark.llm.shared import at_hash, cut, held, letter_words, sent_small, small_batches
from tidemark.llm.tokens import text_parts

UNKNOWN = "und"
ORDERS = (5, 4, 3, 2, 1)
#: Words of evidence after which the score's certainty grows no more.
FULL_WORDS = 40
#: Numbers of a model's table up to which a worker spreads it over all languages, for speed.
SPREAD_CELLS = 4_000_000
#: Numbers that a worker keeps of words met before: a row of all languages each.
CACHE_CELLS = 500_000


def n_grams(word: str, order: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[i : i + order] for i in range(len(marked) - order + 1)] if order > 1 else list(word)


class Counts:
    """How often each key (a word, an n-gram) occurs in each language that has it; ``kind`` groups keys that share totals."""

    def __init__(self, found: pa.Table, n_languages: int, kind) -> None:
        """``found``: language (a number), key, n."""
        key = found.column("key").combine_chunks().dictionary_encode()
        number, language = key.indices.to_numpy(zero_copy_only=False), found.column("language").to_numpy()
        order = np.lexsort((language, number))
        self.keys = key.dictionary.to_pylist()
        self.language, n = language[order].astype(np.int32), found.column("n").to_numpy()[order]
        self.start = np.searchsorted(number[order], np.arange(len(self.keys) + 1))
        # A key's log frequency in a language is that of a key not seen there, and this much more.
        self.more = np.log(2.0 * n + 1).astype(np.float32)
        self.kinds = [kind(x) for x in self.keys]
        per_entry = np.repeat(np.array(self.kinds, np.int64), np.diff(self.start))
        self.unseen = {}
        for k in set(self.kinds):
            mine = per_entry == k
            totals = np.bincount(self.language[mine], n[mine], n_languages)
            self.unseen[k] = np.log(0.5 / (totals + 0.5 * self.kinds.count(k) + 1))
        self.number: dict[str, int] = {}
        self.spread: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"number": {}, "spread": None}

    def _row(self, i: int) -> np.ndarray:
        row = self.unseen[self.kinds[i]].copy()
        a, b = self.start[i], self.start[i + 1]
        row[self.language[a:b]] += self.more[a:b]
        return row

    def row(self, key: str) -> np.ndarray | None:
        """The key's log frequency in every language; nothing if none has it."""
        if not self.number:
            self.number = {x: i for i, x in enumerate(self.keys)}
            if self.keys and len(self.keys) * len(self._row(0)) <= SPREAD_CELLS:
                self.spread = np.array([self._row(i) for i in range(len(self.keys))])
        i = self.number.get(key)
        if i is None:
            return None
        return self._row(i) if self.spread is None else self.spread[i]


class Model:
    """Log frequencies of words and n-grams by language."""

    def __init__(self, languages: list[str], words: pa.Table, grams: pa.Table) -> None:
        self.languages = languages
        self.words, self.grams = Counts(words, len(languages), lambda _: 0), Counts(grams, len(languages), len)

    def word(self, word: str) -> np.ndarray:
        """Log scores of a word in every language; of a word of unknown letters all alike."""
        known = self.words.row(word)
        if known is not None:
            return known
        for order in ORDERS:
            rows = [r for g in n_grams(word, order) if (r := self.grams.row(g)) is not None]
            if rows:
                return sum(rows[1:], rows[0]) / len(rows)
        return np.zeros(len(self.languages))


class Scorer:
    """Scores documents in a worker; words met again, in later tasks too, are not cut up again."""

    def __init__(self, model: Model) -> None:
        self.model, self.number = model, {}
        self.at = {x: i for i, x in enumerate(model.languages)}
        self.table = np.empty((1024, len(model.languages)))

    def start(self, texts: list[list[str]]) -> None:
        """A row of scores for every word of the texts."""
        wanted = set().union(*texts)
        new = wanted.difference(self.number)
        if (len(self.number) + len(new)) * len(self.model.languages) > CACHE_CELLS:
            self.number, new = {}, wanted
        n = len(self.number)
        if n + len(new) > len(self.table):
            larger = np.empty((2 * (n + len(new)), self.table.shape[1]))
            larger[:n] = self.table[:n]
            self.table = larger
        for i, w in enumerate(new, n):
            self.number[w] = i
            self.table[i] = self.model.word(w)

    def score(self, words: list[str], named: str | None = None) -> tuple[str, float, float | None, float | None]:
        """The language, its share of the certainty, and against the named one: its log odds, and the named one's share of the words' evidence between the two."""
        at = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        mean = self.table[at].mean(axis=0)
        certain = np.exp((mean - mean.max()) * min(len(words), FULL_WORDS))
        best = int(np.argmax(mean))
        i = self.at.get(named)
        odds = share = None
        if i is not None:
            ahead = self.table[at, best] - self.table[at, i]
            total = float(np.abs(ahead).sum())
            odds = float((mean[best] - mean[i]) * min(len(words), FULL_WORDS))
            share = float(-ahead[ahead < 0].sum()) / total if total else 1.0
        return self.model.languages[best], float(certain[best] / certain.sum()), odds, share


def fit(docs: DataFrame, *, docs_per_language: int = 1_500, max_docs: int = 300_000, keys_per_language: int = 40_000, max_keys: int = 400_000) -> Model:
    """Learns every language of the table, each from at most ``docs_per_language`` of its documents and ``max_docs`` divided by all languages.

    Rows with null text or lang teach nothing; equal texts of a language teach once. Of a language its most frequent words and n-grams are kept,
    ``keys_per_language`` of either at most and ``max_keys`` divided by all languages, so the model's size is bounded whatever the number of languages.
    """
    rows = docs.select("doc_id", "text", "lang").filter("text is not null and lang is not null")
    counts = cut(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")))
    n_languages = max(1, counts.count())
    most = max(1, min(docs_per_language, max_docs // n_languages))
    # A threshold on the hash leaves about twice as many as asked for, whatever a language's size; only those are shuffled and ranked.
    near = rows.join(sent_small(counts), "lang").filter(at_hash(29, "doc_id", "text") < 2.0 * most / F.col("rows"))
    by_language = Window.partitionBy("lang").orderBy(F.xxhash64("text", F.lit(29)), "text")
    texts = near.select("text", "lang").distinct().withColumn("turn", F.row_number().over(by_language)).filter(F.col("turn") <= most).select("text", "lang")

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, Counter] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(lang, Counter()).update(letter_words(text))
            for lang, c in ((lang, c) for lang, c in by.items() if c):
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(c), "key": list(c), "n": list(c.values())})

    words = cut(texts.repartition(F.xxhash64("text")).mapInArrow(count_words, "lang string, key string, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")))

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c: Counter = Counter()
            for lang, word, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for order in ORDERS:
                    for g in n_grams(word, order):
                        c[lang, g] += n
            if c:
                yield pa.RecordBatch.from_pydict({"lang": [x[0] for x in c], "key": [x[1] for x in c], "n": list(c.values())})

    grams = words.mapInArrow(cut_up, "lang string, key string, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    languages = sorted(r["lang"] for r in counts.select("lang").collect())
    numbered = docs.sparkSession.createDataFrame(list(enumerate(languages)), "language int, lang string")
    keys = max(1, min(keys_per_language, max_keys // n_languages))
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "key")

    def kept(df: DataFrame) -> pa.Table:
        top = df.filter("n > 1").withColumn("turn", F.row_number().over(first)).filter(F.col("turn") <= keys)
        return top.join(sent_small(numbered), "lang").select("language", "key", "n").toArrow()

    return Model(languages, kept(words), kept(grams))


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", named_col: str | None = None, with_row: bool = False) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) of every row, from its text alone; ``with_row`` adds ``row``, the whole of it.

    ``named_col``, the language a row names, adds how lang_pred compares with it: named_odds, the log odds of lang_pred against it, and named_share, what
    part of the words' evidence between the two is for the one named (0 to 1). Both are null where the model does not know the language named.

    Text that is null, empty or has no letter is ``und`` with score 0. So is every text if the model knows no language. Ties go to the first language
    by name. Long texts are read whole, repeated rows score alike, other columns are ignored, an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    spread, name = docs.sparkSession.sparkContext.broadcast(model), f"scorer {uuid.uuid4().hex}"
    named = F.col(named_col) if named_col else F.lit(None).cast("string")
    # The text goes to the workers once, within the row or by itself.
    sent = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row") if with_row else F.col(text_col).alias("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), named.alias("named"), sent)
    added = [StructField(n, DoubleType()) for n in ("score", "named_odds", "named_share")]
    schema = StructType([rows.schema["doc_id"], StructField("lang_pred", StringType()), *added, *([rows.schema["row"]] if with_row else [])])
    at = docs.columns.index(text_col)
    texts_of = (lambda part: part.column(2).field(at)) if with_row else (lambda part: part.column(2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held(name, lambda: Scorer(spread.value))
        for batch in batches:
            for part, some in text_parts(batch, texts_of):
                texts = [letter_words(t) for t in some]
                scorer.start(texts)
                found = [scorer.score(w, n) if w and scorer.model.languages else (UNKNOWN, 0.0, None, None) for w, n in zip(texts, part.column(1).to_pylist())]
                numbers = [pa.array([x[i] for x in found], pa.float64()) for i in (1, 2, 3)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x[0] for x in found], pa.string()), *numbers, *part.columns[2 + (not with_row) :]], names=schema.fieldNames())

    out = rows.mapInArrow(run, schema)
    return out if named_col else out.drop("named_odds", "named_share")
