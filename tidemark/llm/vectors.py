"""What the two vector searches share: valid rows, equal vectors as one, blocks, and results for every query row.

Queries are a stated set of rows. Vectors that are equal are searched once, each with its ``keep`` least ids, which is
all that a result of fewer rows can name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of candidates, and of a block of queries.
POINTS, QUERIES = 16_384, 32_768


def valid(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array<double>): rows whose id and vector are not null and whose components are all finite; rows alike in both count once."""
    rows = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter("id is not null and v is not null")
    return rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).distinct()


def padded(rows: DataFrame) -> tuple[DataFrame, int]:
    """Shorter vectors with zeros up to the longest one's length, and that length: their products and norms stay."""
    d = rows.agg(F.max(F.size("v"))).first()[0] or 0
    return rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(d) - F.size("v")))), d


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """(rep, ids, v): each distinct vector with its ``keep`` least ids and a number of its own. Ranks are limited before the shuffle."""
    # Of a vector that a third of all rows hold only ``keep`` rows leave each task.
    ranked = rows.withColumn("turn", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("turn") <= keep)
    return ranked.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.monotonically_increasing_id().alias("rep"), "ids", "v")


def queries_of(rows: DataFrame, points: DataFrame, every: int) -> tuple[DataFrame, DataFrame]:
    """(id, rep) of every query row, and (rep, v) of the distinct vectors among them."""
    owners = rows.filter(F.col("id") % every == 0).withColumnRenamed("v", "qv").join(points, F.col("qv") == F.col("v")).select("id", "rep")
    return owners, points.join(owners.select("rep").distinct(), "rep").select("rep", "v")


def spread(rep: str, parts: int, seed: int) -> Column:
    """A block number from the hash of a vector's number."""
    return F.pmod(F.xxhash64(rep, F.lit(seed)), F.lit(parts)).cast("int")


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows that follow each other with equal keys, as tables; a group may span batches."""
    last, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for i, j in zip(starts, starts[1:]):
            key = tuple(c[i].item() for c in columns)
            if key != last and held:
                yield last, pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(i, j - i))
    if held:
        yield last, pa.Table.from_batches(held)


def top_columns(scores: np.ndarray, k: int) -> np.ndarray:
    """Column numbers of each row's k highest scores, in no order."""
    if scores.shape[1] <= k:
        return np.tile(np.arange(scores.shape[1]), (scores.shape[0], 1))
    return np.argpartition(-scores, k - 1, axis=1)[:, :k]


def results(best: DataFrame, points: DataFrame, owners: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score from ``best`` (query_rep, rep, score): the ids of equal vectors put back, the query's own left out."""
    named = best.join(points.select("rep", "ids"), "rep").select("query_rep", "rep", "score", F.explode("ids").alias("vec_id"))
    # Of each distinct query vector no more ids than a result can name, before they meet its rows.
    first = Window.partitionBy("query_rep").orderBy(F.desc("score"), "vec_id", "rep")
    named = named.withColumn("turn", F.row_number().over(first)).filter(F.col("turn") <= k + 1).drop("turn")
    met = owners.select(F.col("id").alias("query_id"), F.col("rep").alias("query_rep")).join(named, "query_rep").filter("vec_id != query_id or rep != query_rep")
    final = Window.partitionBy("query_id", "query_rep").orderBy(F.desc("score"), "vec_id", "rep")
    return met.withColumn("rank", F.row_number().over(final).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
