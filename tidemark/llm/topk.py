"""Exact top-k by inner product in three phases with a uniform threshold.

The dimensions are divided among ``nodes``. A node holds its part of every vector, in blocks of candidates; a candidate's score is the sum of its partial
scores at the nodes.

1. Every node gives each query a local list of its ``listed`` highest partial scores. The scores of the candidates listed anywhere are looked up, and
   the k-th highest of those is a cutoff that the result cannot fall below.
2. The cutoff goes to the nodes. A candidate that reaches it has at some node an equal share of it or more, so every node sends its
   entries at or above that share, and no others. Candidates whose length at the node rules that out are not multiplied.
   A candidate sent by all nodes is known exactly, and raises the cutoff; one sent by some lies below what was sent and the share of the other nodes together.
3. Candidates that could still reach the cutoff are looked up, and the scores ranked.

A look-up sends pairs of numbers to the blocks that hold the candidates, never vectors to pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import vectors
from tidemark.llm.shared import cut

#: Doubles hold the sums of integer products up to this.
EXACT = 2.0**53
LONG = (1 << 63) - 1


def scaled(rows: DataFrame, scale: int) -> DataFrame:
    """Components as floor(scale * x) in doubles; beyond a long the nearest long."""
    return rows.withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("double")))


def as_long(x: np.ndarray) -> np.ndarray:
    """Python integers as longs; beyond a long the nearest one."""
    return np.array([max(-LONG - 1, min(LONG, int(v))) for v in x.ravel()], np.int64).reshape(x.shape)


def products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Integer inner products of all pairs: doubles where they are exact, else Python's integers."""
    if not q.size or not p.size or np.abs(q).max() * np.abs(p).max() * q.shape[1] < EXACT:
        return q @ p.T
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object)
    return whole(q) @ whole(p).T


def top_k(
    rows: DataFrame,
    *,
    k: int = 5,
    every: int = 50,
    scale: int = 256,
    nodes: int = 2,
    listed: int = 32,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    points_block: int = vectors.POINTS,
    queries_block: int = vectors.QUERIES,
    sent: dict[str, int] | None = None,
) -> DataFrame:
    """query_id, rank, vec_id, score (long): for each row whose id ``every`` divides its k highest scores, ties to smaller ids.

    Vectors that are null or hold nulls or non-finite numbers take no part, as rows without an id; shorter vectors count as if zeros followed. Rows alike
    in id and vector count once; rows that repeat an id with other vectors are rows of their own. Equal vectors of several ids all appear. Components
    and scores beyond a long stand as the nearest long. Fewer candidates than k give fewer rows, an empty table none. Other columns are ignored.

    ``sent`` gets how many entries each phase sends: lists, entries, looked_up.
    """
    keep = k + 1
    listed = max(listed, keep)
    clean, d = vectors.padded(vectors.valid(rows, id_col, vector_col))
    ints = cut(scaled(clean, scale))
    points = cut(vectors.distinct_vectors(ints, keep))
    owners, queries = vectors.queries_of(ints, points, every)
    owners, queries = cut(owners), cut(queries)
    n_blocks, n_chunks = max(1, -(-points.count() // points_block)), max(1, -(-queries.count() // queries_block))
    nodes = max(1, min(nodes, d))
    bounds = [round(i * d / nodes) for i in range(nodes + 1)]
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def by_node(df: DataFrame) -> DataFrame:
        """A row for each node's part of a vector."""
        parts = F.array(*[F.struct(F.lit(i).alias("node"), F.slice("v", a + 1, b - a).alias("v")) for i, (a, b) in enumerate(zip(bounds, bounds[1:]))])
        return df.withColumn("part", F.explode(parts)).drop("v").select("*", "part.*").drop("part")

    no_pair, no_cutoff = F.lit(None).cast("long").alias("other"), F.lit(None).cast("double").alias("cutoff")
    point_side = points.select(vectors.spread("rep", n_blocks, 3).alias("block"), all_of(n_chunks).alias("chunk"), F.lit(1).alias("side"), "rep", "v", no_pair, no_cutoff)
    query_side = queries.select(all_of(n_blocks).alias("block"), vectors.spread("rep", n_chunks, 4).alias("chunk"), F.lit(0).alias("side"), "rep", "v", no_pair, no_cutoff)

    def at_nodes(query_side: DataFrame) -> DataFrame:
        keys = ["node", "block", "chunk"]
        return by_node(point_side.unionByName(query_side)).repartition(*keys).sortWithinPartitions(*keys, "side", "rep")

    def blocks(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple]:
        for key, t in vectors.grouped(batches, keys):
            side = t.column("side").to_numpy()
            m, n = np.searchsorted(side, [1, 2])
            if m and n > m:
                v = [vectors.matrix(t.column("v").slice(i, j - i).combine_chunks(), len(t.column("v")[i])) for i, j in ((0, m), (m, n))]
                yield key, v[0], v[1], t.column("rep").to_numpy(), int(m), int(n), t

    def local_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, q, p, rep, m, n, _ in blocks(batches, ["node", "block", "chunk"]):
            for i in range(0, m, 512):
                s = products(q[i : i + 512], p).astype(float)
                best = vectors.top_columns(s, listed)
                width = best.shape[1]
                yield pa.RecordBatch.from_pydict({"query_rep": np.repeat(rep[i : min(m, i + 512)], width), "node": np.full(best.size, key[0], np.int32), "rep": rep[m:n][best].ravel(), "part": np.take_along_axis(s, best, 1).ravel()})

    at_node = Window.partitionBy("query_rep", "node").orderBy(F.desc("part"), "rep")
    lists = at_nodes(query_side).mapInArrow(local_lists, "query_rep long, node int, rep long, part double")
    lists = cut(lists.withColumn("turn", F.row_number().over(at_node)).filter(F.col("turn") <= listed).select("query_rep", "rep"))

    def look_up(pairs: DataFrame) -> DataFrame:
        """(query_rep, rep, score) of distinct pairs: they go to the blocks that hold their candidates."""
        asked = pairs.select(vectors.spread("rep", n_blocks, 3).alias("block"), vectors.spread("query_rep", n_chunks, 4).alias("chunk"), F.lit(2).alias("side"), F.col("query_rep").alias("rep"), F.lit(None).cast("array<double>").alias("v"), F.col("rep").alias("other"), no_cutoff)
        keys = ["block", "chunk"]
        both = point_side.unionByName(query_side).unionByName(asked).repartition(*keys).sortWithinPartitions(*keys, "side", "rep", "other")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, q, p, rep, m, n, t in blocks(batches, keys):
                a, b = rep[n:], t.column("other").slice(n).to_numpy()
                x, y = np.searchsorted(rep[:m], a), np.searchsorted(rep[m:n], b)
                exact = np.abs(q).max(initial=0) * np.abs(p).max(initial=0) * q.shape[1] < EXACT
                for i in range(0, len(a), 8192):
                    left, right = q[x[i : i + 8192]], p[y[i : i + 8192]]
                    if exact:
                        score = np.einsum("ij,ij->i", left, right).astype(np.int64)
                    else:
                        score = as_long(np.array([sum(int(u) * int(w) for u, w in zip(*pair)) for pair in zip(left, right)], object))
                    yield pa.RecordBatch.from_pydict({"query_rep": a[i : i + 8192], "rep": b[i : i + 8192], "score": score})

        return both.mapInArrow(run, "query_rep long, rep long, score long")

    by_score = Window.partitionBy("query_rep").orderBy(F.desc("score"))
    # With fewer candidates than asked for, the lowest of them: all are in the lists then.
    lowest = lambda known: known.withColumn("turn", F.row_number().over(by_score)).filter(F.col("turn") <= keep).groupBy("query_rep").agg(F.min("score").alias("cutoff"))
    first_known = cut(look_up(lists.distinct()))
    cutoffs = cut(lowest(first_known))

    def reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, q, p, rep, m, n, t in blocks(batches, ["node", "block", "chunk"]):
            share = t.column("cutoff").slice(0, m).to_numpy() / nodes
            reach = np.linalg.norm(q, axis=1)
            # Longest candidates first; a query needs those that its share asks for at least.
            length = np.linalg.norm(p, axis=1)
            order = np.argsort(-length, kind="stable")
            p, at, length = p[order], rep[m:n][order], length[order]
            with np.errstate(divide="ignore", invalid="ignore"):
                need = np.where(share > 0, share / reach * (1 - 1e-9), 0)
            asked = np.argsort(-need, kind="stable")
            for i in range(0, m, 512):
                some = asked[i : i + 512]
                upto = int(np.searchsorted(-length, -need[some].min(), side="right"))
                if not upto:
                    continue
                s = products(q[some], p[:upto]).astype(float)
                row, column = np.nonzero(s >= (share[some] - 1e-6 * np.abs(share[some]) - 1e-6)[:, None])
                yield pa.RecordBatch.from_pydict({"query_rep": rep[:m][some[row]], "rep": at[column], "part": s[row, column]})

    told = query_side.drop("cutoff").join(cutoffs.select(F.col("query_rep").alias("rep"), F.col("cutoff").cast("double").alias("cutoff")), "rep")
    entries = at_nodes(told).mapInArrow(reaching, "query_rep long, rep long, part double")
    entries = cut(entries.groupBy("query_rep", "rep").agg(F.count(F.lit(1)).alias("nodes"), F.sum("part").alias("part")))
    # What all nodes sent is a score, less what rounding may have added.
    known = entries.filter(F.col("nodes") == nodes).select("query_rep", "rep", (F.col("part") - F.abs("part") * 1e-9).alias("score"))
    known = known.unionByName(first_known.withColumn("score", F.col("score").cast("double"))).groupBy("query_rep", "rep").agg(F.max("score").alias("score"))
    able = entries.join(lowest(known).withColumnRenamed("cutoff", "at_least"), "query_rep").join(cutoffs, "query_rep")
    able = able.filter(F.col("part") + (F.lit(nodes) - F.col("nodes")) * F.col("cutoff") / nodes >= F.col("at_least") - F.abs("at_least") * 1e-6 - 1e-3)
    asked = cut(able.select("query_rep", "rep"))
    if sent is not None:
        sent |= {"lists": lists.count(), "entries": entries.agg(F.sum("nodes")).first()[0] or 0, "looked_up": asked.count()}
    found = look_up(asked).join(points.select("rep", F.col("ids")[0].alias("least")), "rep")
    best = found.withColumn("turn", F.row_number().over(Window.partitionBy("query_rep").orderBy(F.desc("score"), "least", "rep"))).filter(F.col("turn") <= keep)
    return vectors.results(best.select("query_rep", "rep", "score"), points, owners, k)
