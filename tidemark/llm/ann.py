"""Approximate nearest neighbours by cosine with a forest of hash prefixes.

Each tree turns a vector by a random rotation and gives it a long string: the numbers and signs of its largest coordinates there, largest
first. Near vectors share a long prefix with far better odds than sides of random planes would give them. A tree is the array of all rows sorted by string.
A query descends in every tree to its longest matching prefix and then ascends in all trees at once, a bit at a time, until the rows that share the
prefix, summed over the trees, are enough: the table's size to a power below one, so a larger table is read less deeply in proportion.

How far to ascend is found in a bounded sample of the strings, sorted, which every task has; with few rows that is all of them. A query far
from a direction that most rows share ascends to the root, where it meets every row once. The arrays lie in blocks by their first bits, as many as
the table's size asks for (a block with very many equal prefixes is split by hash). In them vectors are single floats; of each tree's rows that a query meets, all
go on that those floats' rounding does not tell from its k-th best, and what goes on of all trees is scored again on the original vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import vectors
from tidemark.llm.shared import at_hash, cut, sent_small

#: A string has as many symbols as fit in so many bits.
MOST_BITS = 56
#: Coordinates of a rotated vector at most.
WIDEST = 64


class Forest:
    """The trees' rotations, drawn from a seed."""

    def __init__(self, d: int, trees: int, seed: int) -> None:
        self.d, self.trees, self.seed = d, trees, seed
        self.wide = max(1, min(d, WIDEST))
        self.symbol_bits = max(1, math.ceil(math.log2(2 * self.wide)))
        self.symbols = max(1, min(self.wide, MOST_BITS // self.symbol_bits))
        self.bits = self.symbols * self.symbol_bits

    def rotations(self) -> list[np.ndarray]:
        rng = np.random.default_rng(self.seed)
        return [np.linalg.qr(rng.standard_normal((self.d, self.wide)))[0] for _ in range(self.trees)]

    def strings(self, v: np.ndarray, rotations: list[np.ndarray]) -> np.ndarray:
        """(rows, trees): each tree's string as a number whose binary order is the string's."""
        out = np.empty((len(v), self.trees), np.int64)
        rows = np.arange(len(v))[:, None]
        for t, turn in enumerate(rotations):
            y = v @ turn
            size = np.abs(y)
            most = np.argpartition(-size, self.symbols - 1, axis=1)[:, : self.symbols] if self.symbols < self.wide else np.tile(np.arange(self.wide), (len(v), 1))
            most = np.take_along_axis(most, np.argsort(-size[rows, most], axis=1, kind="stable"), 1)
            symbol = (y[rows, most] > 0).astype(np.int64) << (self.symbol_bits - 1) | most
            key = np.zeros(len(v), np.int64)
            for s in range(self.symbols):
                key = key << self.symbol_bits | symbol[:, s]
            out[:, t] = key
        return out


#: What a cosine of single floats may be off by: their sum's rounding, twice over, in each of d terms and the norms.
def float_error(d: int) -> float:
    return 4 * (d + 4) * float(np.finfo(np.float32).eps)


def within(scores: np.ndarray, k: int, error: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of every score that may be among its row's k highest, given what each may be off by."""
    if scores.shape[1] <= k:
        return np.nonzero(np.ones(scores.shape, bool))
    return np.nonzero(scores >= np.partition(scores, -k, axis=1)[:, -k, None] - 2 * error)


def level_of(keys: np.ndarray, sample: np.ndarray, bits: int, enough: float) -> np.ndarray:
    """Each query's deepest level at which its prefixes, summed over the trees, hold ``enough`` rows of ``sample`` (sorted, a row per tree); 0 without."""
    level, open_ = np.zeros(len(keys), np.int64), np.ones(len(keys), bool)
    for bit in range(bits, 0, -1):
        at = np.flatnonzero(open_)
        if not len(at):
            break
        total = np.zeros(len(at))
        for t, tree in enumerate(sample):
            low = (keys[at, t] >> (bits - bit)) << (bits - bit)
            total += np.searchsorted(tree, low + (1 << (bits - bit))) - np.searchsorted(tree, low)
        done = at[total >= enough]
        level[done], open_[done] = bit, False
    return level


def _score(a: str, b: str):
    """Cosine in double precision, summed in the vectors' order on every row alike; scaled first, so that no square overflows or vanishes."""
    unit = lambda c: F.transform(c, lambda x: x / F.array_max(F.transform(c, F.abs)))
    dot = F.aggregate(F.zip_with(unit(a), unit(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda c: F.sqrt(F.aggregate(unit(c), F.lit(0.0), lambda s, x: s + x * x))
    return dot / (norm(a) * norm(b))


def search(
    rows: DataFrame,
    *,
    k: int = 5,
    every: int = 50,
    trees: int = 48,
    power: float = 0.9,
    part: float = 0.9,
    sample_rows: int = 16_384,
    seed: int = 11,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    points_block: int = vectors.POINTS,
    queries_block: int = vectors.QUERIES,
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id ``every`` divides the k nearest found, ties to smaller ids.

    A query ascends until it meets ``part`` * n ** ``power`` rows of n, summed over the trees, and k + 1 rows in every tree on average at least.

    Vectors that are null, empty, all zero or hold nulls or non-finite numbers take no part, nor do rows without an id; shorter vectors count as
    if zeros followed. Rows alike in id and vector count once; rows that repeat an id with other vectors are rows of their own. Equal vectors of several
    ids all appear. Fewer candidates than k give fewer rows, an empty table none. Other columns are ignored.
    """
    keep = k + 1
    clean, d = vectors.padded(vectors.valid(rows, id_col, vector_col).filter(F.exists("v", lambda x: x != 0)))
    clean = cut(clean)
    points = cut(vectors.distinct_vectors(clean, keep))
    n = points.count()
    owners, queries = vectors.queries_of(clean, points, every)
    owners, queries = cut(owners), cut(queries)
    forest = Forest(d, trees, seed)
    bits, error = forest.bits, float_error(d)

    def unit(v: np.ndarray) -> np.ndarray:
        v = v / np.abs(v).max(axis=1, keepdims=True)
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotations = None
        for batch in batches:
            rotations = rotations or forest.rotations()
            for i in range(0, batch.num_rows, 2048):
                part_ = batch.slice(i, 2048)
                v = unit(vectors.matrix(part_.column("v"), d))
                small = [x.tobytes() for x in v.astype(np.float32)]
                yield pa.RecordBatch.from_arrays([part_.column("rep"), pa.array(small, pa.binary()), pa.array(list(forest.strings(v, rotations)), pa.list_(pa.int64()))], names=["rep", "small", "keys"])

    point_keys = cut(points.select("rep", "v").mapInArrow(strings, "rep long, small binary, keys array<long>"))
    some = point_keys.select("keys").filter(at_hash(3, "rep") < sample_rows / max(1, n)).toArrow() if n else None
    sample = np.sort(vectors.matrix(some.column(0).combine_chunks(), trees).T, axis=1) if n else np.empty((trees, 0), np.int64)
    enough = max(part * n**power, trees * min(keep, n)) * sample.shape[1] / max(1, n)
    strung = rows.sparkSession.sparkContext.broadcast(sample)

    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = vectors.matrix(batch.column("keys"), trees)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(level_of(keys, strung.value, bits, enough), pa.int32())], names=["rep", "small", "keys", "level"])

    query_keys = cut(point_keys.join(queries.select("rep"), "rep", "left_semi").mapInArrow(levels, "rep long, small binary, keys array<long>, level int"))

    depth = min(bits, max(0, math.ceil(math.log2(max(1, n / points_block)))))
    by_tree = lambda df, *more: df.select("rep", "small", *more, F.posexplode("keys").alias("tree", "key")).withColumn("block", F.shiftright("key", bits - depth))
    # At the root one tree's blocks hold every row once; between the root and the blocks' depth those below the prefix are asked.
    sent = by_tree(query_keys, "level").filter("level > 0 or tree = 0")
    low = F.expr(f"shiftleft(shiftright(block, greatest({depth} - level, 0)), greatest({depth} - level, 0))")
    sent = sent.withColumn("block", F.explode(F.sequence(low, low + F.expr(f"shiftleft(1L, greatest({depth} - level, 0))") - 1))) if depth else sent
    placed = by_tree(point_keys)
    number = lambda df, size, name: df.groupBy("tree", "block").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    # A row per tree and block: small, and its size is checked before it is sent.
    sizes = cut(number(placed, points_block, "parts").join(number(sent, queries_block, "chunks"), ["tree", "block"]))
    sizes = sent_small(sizes)
    every_one = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    one_of = lambda c, seed_: F.pmod(F.xxhash64("rep", F.lit(seed_)), F.col(c)).cast("int")
    point_side = placed.join(sizes, ["tree", "block"]).withColumn("part", one_of("parts", 5)).withColumn("chunk", every_one("chunks")).select("tree", "block", "part", "chunk", F.lit(1).alias("side"), "key", "rep", "small", F.lit(0).alias("level"))
    query_side = sent.join(sizes, ["tree", "block"]).withColumn("part", every_one("parts")).withColumn("chunk", one_of("chunks", 4)).select("tree", "block", "part", "chunk", F.lit(0).alias("side"), "key", "rep", "small", "level")
    keys = ["tree", "block", "part", "chunk"]
    both = point_side.unionByName(query_side).repartition(*keys).sortWithinPartitions(*keys, "side", "key", "rep")

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in vectors.grouped(batches, keys):
            side, key, rep = (t.column(c).to_numpy() for c in ("side", "key", "rep"))
            m = int((side == 0).sum())
            if not m or m == len(side):
                continue
            v = np.frombuffer(b"".join(t.column("small").to_pylist()), np.float32).reshape(-1, d)
            shift = bits - t.column("level").to_numpy()[:m].astype(np.int64)
            lo = np.searchsorted(key[m:], (key[:m] >> shift) << shift, side="left")
            hi = np.searchsorted(key[m:], ((key[:m] >> shift) + 1) << shift, side="left")
            order = np.lexsort((hi, lo))
            turns = np.flatnonzero(np.r_[True, (np.diff(lo[order]) != 0) | (np.diff(hi[order]) != 0), True])
            found: list[list[np.ndarray]] = [[], [], []]
            for a, b in zip(turns, turns[1:]):
                run = order[a:b]
                i, j = int(lo[run[0]]), int(hi[run[0]])
                for first in range(0, len(run) if j > i else 0, 512):
                    mine = run[first : first + 512]
                    s = v[mine] @ v[m + i : m + j].T
                    at, best = within(s, keep, error)
                    for to, x in zip(found, (rep[mine][at], rep[m + i + best], s[at, best])):
                        to.append(x)
            if found[0]:
                yield pa.RecordBatch.from_pydict(dict(zip(("query_rep", "rep", "near"), (np.concatenate(x) for x in found))))

    found = both.mapInArrow(nearest, "query_rep long, rep long, near float").groupBy("query_rep", "rep").agg(F.max("near").alias("near"))
    by_query = Window.partitionBy("query_rep")
    found = found.withColumn("turn", F.row_number().over(by_query.orderBy(F.desc("near"), "rep")))
    least = F.max(F.when(F.col("turn") == keep, F.col("near"))).over(by_query)
    few = found.withColumn("least", least).filter(F.col("least").isNull() | (F.col("near") >= F.col("least") - 2 * error)).select("query_rep", "rep")
    with_vectors = few.join(points.select("rep", F.col("v").alias("pv")), "rep").join(queries.select(F.col("rep").alias("query_rep"), F.col("v").alias("qv")), "query_rep")
    best = with_vectors.select("query_rep", "rep", _score("qv", "pv").alias("score"))
    return vectors.results(best, points, owners, k)
