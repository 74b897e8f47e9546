"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Examples are a bounded sample of labelled documents, so many of each label at most. Terms are words and their first letters (which carry
a stem to endings not seen before), of both labels alike. A term's weight is its inverse document frequency times what it says of the label (its log odds, as far as they are sure): a
long text is hundreds of words that say nothing, and with inverse frequency alone the chance matches among them decide who is near. Words that
say nothing keep a small weight, so a text with any known word has neighbours.

An inverted index over the examples' unit vectors is cut into blocks of examples, each term knowing its largest weight in each block where it occurs.
A text's blocks are scored by falling upper bound, the first few, then those that can beat the k-th best cosine found there. The neighbours vote by
cosine; the share of toxic votes is turned into a probability by an isotonic fit to the examples' own left-one-out votes.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from tidemark.llm.shared import at_hash, cut, held, letter_words, small_batches
from tidemark.llm.tokens import text_parts

STEM = 5
BLOCK = 128
FIRST_BLOCKS = 4
#: Chi-square of a term and the label at which its log odds count half.
HALF_CHI2 = 30.0
EVIDENCE = (("score", DoubleType()), ("neighbours", ArrayType(LongType())), ("cosines", ArrayType(DoubleType())))


def stem(word: str) -> str | None:
    """The first letters of a longer word, marked by a star."""
    return word[:STEM] + "*" if len(word) > STEM else None


def terms(text: str | None) -> dict[str, tuple[int, int]]:
    """Words in lower case and stems, each with its number and the least hash of its neighbours on both sides.

    Copies of a passage have a term between the same neighbours, other texts hardly ever.
    """
    words = letter_words(text)
    found: dict[str, tuple[int, int]] = {}
    for word, left, right in zip(words, ["", *words[:-1]], [*words[1:], ""]):
        beside = zlib.crc32(f"{left} {right}".encode("utf-8", "surrogatepass"))
        for term in (word, stem(word)):
            if term:
                n, least = found.get(term, (0, beside))
                found[term] = n + 1, min(least, beside)
    return found


class Index:
    """Unit vectors of the examples in postings by term, with block maxima.

    ``names`` and ``weights``: the terms. ``ids``, ``labels``: the examples. ``doc``, ``term``, ``count``: how often a term is in an example.
    ``stands``: how many labelled documents an example of each label stands for.
    """

    def __init__(self, names: list[str], weights: np.ndarray, ids: np.ndarray, labels: np.ndarray, doc: np.ndarray, term: np.ndarray, count: np.ndarray, stands: tuple[float, float], k: int) -> None:
        self.names, self.weights, self.ids, self.labels, self.k = names, weights, ids, labels, k
        self.stands = np.where(labels == 1, stands[1], stands[0])
        self.blocks = max(1, -(-len(ids) // BLOCK))
        order = np.lexsort((doc, term))
        doc, term = doc[order].astype(np.int32), term[order]
        value = weights[term] * (1 + np.log(count[order]))
        norm = np.sqrt(np.bincount(doc, value * value, max(1, len(ids))))
        self.doc, self.value = doc, value / norm[doc]
        # Runs of one term and block: where they start in the postings, and their maxima.
        new = np.ones(len(doc), bool)
        new[1:] = (term[1:] != term[:-1]) | (doc[1:] // BLOCK != doc[:-1] // BLOCK)
        at = np.flatnonzero(new)
        self.run_start = np.append(at, len(doc)).astype(np.int32)
        self.run_block = (doc[at] // BLOCK).astype(np.int16)
        # Rounded up, so that bounds stay bounds.
        self.run_max = np.nextafter((np.maximum.reduceat(self.value, at) if len(at) else np.empty(0)).astype(np.float32), np.float32(2))
        self.term_run = np.searchsorted(term[at], np.arange(len(names) + 1))
        self.steps: tuple[np.ndarray, np.ndarray] = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
        self.number: dict[str, int] = {}
        if len(ids):
            own = np.argsort(doc, kind="stable")
            ends = np.searchsorted(doc[own], np.arange(len(ids) + 1))
            votes = np.array([self.vote(*self.nearest(term[own[a:b]], self.value[own[a:b]], leave=i)[:2]) for i, (a, b) in enumerate(zip(ends, ends[1:]))])
            self.steps = isotonic(votes, labels.astype(float), self.stands)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"number": {}, "names": "\n".join(self.names)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.names = state["names"].split("\n") if state["names"] else []

    def counts(self, text: str | None) -> dict[int, int]:
        """How often each term is in a text, by its number."""
        if not self.number:
            self.number = {x: i for i, x in enumerate(self.names)}
        number, out = self.number.get, {}
        for word, n in Counter(letter_words(text)).items():
            t = number(word)
            if t is not None:
                out[t] = out.get(t, 0) + n
            t = number(word[:STEM] + "*") if len(word) > STEM else None
            if t is not None:
                out[t] = out.get(t, 0) + n
        return out

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers and unit weights of a text's counts by term number."""
        t = np.fromiter(counts.keys(), np.int64, len(counts))
        w = self.weights[t] * (1 + np.log(np.fromiter(counts.values(), float, len(counts))))
        norm = math.sqrt(float(w @ w))
        return t, w / norm if norm else w

    def nearest(self, t: np.ndarray, w: np.ndarray, leave: int = -1) -> tuple[np.ndarray, np.ndarray, int]:
        """Examples and exact cosines of the k nearest (ties to smaller ids), and how many blocks were scored."""
        if not len(t):
            return np.empty(0, np.int64), np.empty(0), 0
        first, n = self.term_run[t], self.term_run[t + 1] - self.term_run[t]
        run = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        weight, block = np.repeat(w, n), self.run_block[run]
        bounds = np.bincount(block, weight * self.run_max[run], self.blocks)
        order = np.argsort(-bounds, kind="stable")
        best_ids, best, scored = np.empty(0, np.int64), np.empty(0), 0
        # First a few blocks, then all whose bound is above the k-th best cosine of those.
        for some in (order[:FIRST_BLOCKS], order[FIRST_BLOCKS:]):
            some = some[bounds[some] > 0]
            if len(best) == self.k:
                some = some[bounds[some] >= best[-1] - 1e-12]
            if not len(some):
                break
            chosen = np.zeros(self.blocks, bool)
            chosen[some] = True
            mine = chosen[block]
            a, size, x = self.run_start[run[mine]], self.run_start[run[mine] + 1] - self.run_start[run[mine]], weight[mine]
            at = np.repeat(a - np.cumsum(size) + size, size) + np.arange(size.sum())
            sums = np.bincount(self.doc[at], np.repeat(x, size) * self.value[at], len(self.ids))
            if leave >= 0:
                sums[leave] = 0
            found = np.flatnonzero(sums > 0)
            if len(found) > self.k:
                # All that tie with the k-th stay, so that ties go by id.
                found = found[sums[found] >= np.partition(sums[found], -self.k)[-self.k] - 1e-12]
            ids, cosines = np.concatenate([best_ids, found]), np.concatenate([best, sums[found]])
            top = np.lexsort((ids, -cosines.round(12)))[: self.k]
            best_ids, best = ids[top], cosines[top]
            scored += len(some)
        return best_ids, best, scored

    def vote(self, ids: np.ndarray, cosines: np.ndarray) -> float:
        """Toxic share of the neighbours' votes, weighted by cosine and by how many documents an example stands for; -1 without neighbours."""
        if not len(ids):
            return -1.0
        w = cosines * self.stands[ids]
        return float((w * self.labels[ids]).sum() / w.sum())

    def probability(self, vote: float) -> float:
        return float(np.interp(vote, *self.steps))

    def score(self, counts: dict[int, int]) -> tuple[float, np.ndarray, np.ndarray]:
        if not len(self.ids):
            return 0.0, self.ids, np.empty(0)
        ids, cosines, _ = self.nearest(*self.vector(counts))
        return self.probability(self.vote(ids, cosines)), self.ids[ids], cosines


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y to x, each level drawn to the mean by one example, and a hundredth of x kept so that no two votes score alike."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # lowest x, highest x, weighted y, weight
    for a, b, w in zip(x[order], y[order], weight[order]):
        if pools and pools[-1][1] == a:
            pools[-1][2] += b * w
            pools[-1][3] += w
        else:
            pools.append([a, a, b * w, w])
        while len(pools) > 1 and pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3]:
            last = pools.pop()
            pools[-1] = [pools[-1][0], last[1], pools[-1][2] + last[2], pools[-1][3] + last[3]]
    xs = np.array([v for p in pools for v in (p[0], p[1])])
    mean = float((y * weight).sum() / weight.sum())
    ys = np.maximum.accumulate([(p[2] + mean) / (p[3] + 1) for p in pools for _ in (0, 1)])
    return xs, np.clip(0.99 * ys + 0.01 * np.clip(xs, 0, 1), 0, 1)


def _sample(labels: DataFrame, most: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, toxic): at most ``most`` ids of each label by hash, and how many ids each label has; of an id with both labels the higher counts."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = cut(known)
    count = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    # A threshold on the hash leaves about twice as many as asked for, whatever the table's size; only those are ranked.
    share = F.when(F.col("toxic") == 1, 2.0 * most / max(1, count.get(1, 0))).otherwise(2.0 * most / max(1, count.get(0, 0)))
    by_label = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id", F.lit(23)), "doc_id")
    ranked = known.filter(at_hash(23, "doc_id") < share).withColumn("turn", F.row_number().over(by_label))
    return ranked.filter(F.col("turn") <= most).drop("turn"), count


def fit(docs: DataFrame, labels: DataFrame, *, max_examples: int = 1_500, max_terms: int = 40_000, k: int = 10) -> Index:
    """The index over at most ``max_examples`` examples of each label, in at most ``max_terms`` terms that two examples share at least.

    Equal texts count once. A term counts once for all examples that have it between the same words, so a family of near copies does not make its
    chance words look like signs of its label. Words in over a fiftieth of the examples (and in more than two) that say next to nothing of the label are stop words.
    """
    spark = docs.sparkSession
    chosen, count = _sample(labels, max_examples)
    chosen = cut(chosen)
    texts = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(chosen), "doc_id")  # twice max_examples rows at most
    # Of an id that very many rows repeat one text stays, before the shuffle.
    texts = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).groupBy("text").agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id"))
    texts = cut(texts)
    examples = texts.select("doc_id", "toxic").orderBy("doc_id").toArrow()
    ids, toxic = examples.column(0).to_numpy().astype(np.int64), examples.column(1).to_numpy().astype(np.int8)
    n1, n0 = int((toxic == 1).sum()), int((toxic == 0).sum())
    none = np.empty(0, np.int64)
    if not n1 or not n0:
        return Index([], np.empty(0), none, none.astype(np.int8), none, none, none, (1.0, 1.0), k)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c = terms(row["text"])
                if not c:
                    continue
                n, beside = zip(*c.values())
                yield pa.RecordBatch.from_pydict({"doc_id": [row["doc_id"]] * len(c), "toxic": pa.array([row["toxic"]] * len(c), pa.int32()), "term": list(c), "n": pa.array(n, pa.int64()), "beside": pa.array(beside, pa.int64())})

    per_doc = cut(texts.repartition(F.col("doc_id")).select("doc_id", "toxic", "text").mapInArrow(counted, "doc_id long, toxic int, term string, n long, beside long"))
    apart = per_doc.groupBy("term", "toxic", "beside").agg(F.count(F.lit(1)).alias("docs"))
    side = lambda label: F.sum(F.when(F.col("toxic") == label, 1.0).otherwise(0.0))
    df = apart.groupBy("term").agg(side(1).alias("a"), side(0).alias("b"), F.sum("docs").alias("docs")).filter("docs >= 2")
    both = float(n1 + n0)
    # With the correction for small counts, without which two chance sightings on the rarer side look like a sign.
    chi2 = F.expr(f"{both}D * power(greatest(abs(a * ({n0}D - b) - b * ({n1}D - a)) - {both / 2}D, 0D), 2) / ({n1}D * {n0}D * (a + b) * greatest({both}D - a - b, 0.5D))")
    odds = F.abs(F.log((F.col("a") + 0.5) / n1) - F.log((F.col("b") + 0.5) / n0))
    df = df.withColumn("sure", chi2 * chi2 / (chi2 * chi2 + HALF_CHI2**2)).withColumn("says", F.greatest(F.col("sure") * odds, F.lit(1e-3)))
    picked = df.filter((F.col("docs") <= max(2.0, both / 50)) | (F.col("sure") >= 0.05)).orderBy(F.desc("says"), F.desc("docs"), "term").limit(max_terms)
    picked = picked.select("term", F.col("says") * F.log(1 + both / F.col("docs"))).toArrow()
    names = picked.column(0).to_pylist()
    numbered = spark.createDataFrame(pa.table({"term": pa.array(names, pa.string()), "t": pa.array(range(len(names)), pa.int32())}))
    rows = per_doc.join(F.broadcast(numbered), "term").select("doc_id", "t", F.col("n").cast("int").alias("n")).toArrow()  # of the bounded sample
    stands = (count[0] / n0, count[1] / n1)
    doc = np.searchsorted(ids, rows.column(0).to_numpy())
    return Index(names, picked.column(1).to_numpy().astype(float), ids, toxic, doc, rows.column(1).to_numpy().astype(np.int64), rows.column(2).to_numpy(), stands, k)


def score(docs: DataFrame, index: Index, *, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", with_row: bool = False) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 at ``threshold`` or above) and the evidence of every row; ``with_row`` adds ``row``, the whole of it.

    Only the text is an input. ``neighbours`` are the nearest examples' ids, ``cosines`` theirs; of examples with equal cosines those of smaller ids.
    A null, empty or unknown text has no neighbours and scores as the examples that have none. Long texts are read whole. Repeated rows score
    alike; columns of ``docs`` other than the id and text are ignored, whatever their names; an empty table gives no rows; without examples of
    both labels every score is 0.
    """
    small_batches(docs.sparkSession)
    spread, name = docs.sparkSession.sparkContext.broadcast(index), f"index {uuid.uuid4().hex}"
    # The text goes to the workers once, within the row or by itself.
    sent = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row") if with_row else F.col(text_col).alias("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), sent)
    schema = StructType([rows.schema["doc_id"], *(StructField(n, t) for n, t in EVIDENCE), *([rows.schema["row"]] if with_row else [])])
    at = docs.columns.index(text_col)
    texts = (lambda part: part.column(1).field(at)) if with_row else (lambda part: part.column(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held(name, lambda: spread.value)
        none = model.probability(-1.0) if len(model.ids) else 0.0
        for batch in batches:
            for part, some in text_parts(batch, texts):
                out = []
                for text in some:
                    counts = model.counts(text)
                    out.append(model.score(counts) if counts else (none, [], []))
                c = list(zip(*out))
                found_columns = [pa.array(c[0], pa.float64()), pa.array(c[1], pa.list_(pa.int64())), pa.array(c[2], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *found_columns, *part.columns[1 + (not with_row) :]], names=schema.fieldNames())

    return rows.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
