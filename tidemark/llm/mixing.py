"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key. A source's key range is divided into equal intervals, enough of
them that one holds a bounded number of rows, so that a source with a third of all rows is spread over
as many tasks as its size asks for. Rows are sorted within each interval, running word counts are taken
there, and the intervals' totals (a small table) give the offsets: distributed prefix sums. A source's
budget is cut at the exact word; a budget above the source's size repeats whole epochs first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import WORD, cut

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: Sources or intervals up to this number go to every executor as a table; more are joined by shuffle.
BROADCAST_SOURCES = 100_000


def _sent(small: DataFrame) -> DataFrame:
    return F.broadcast(small) if small.count() <= BROADCAST_SOURCES else small


def word_count(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, epochs: int = 2) -> DataFrame:
    """One row per source: n_rows, source_size, target.

    ``sizes`` has source and size. Targets are shares of ``share`` times all sizes by weight; none is above
    ``epochs`` times its source's size, and what that leaves over is shared again by weight. A source is
    at its cap exactly if, in order of cap/weight, the water level up to it reaches its cap.
    """
    by_source = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("source_size"))
    # One row per source: the windows over all of them are small whatever the corpus holds.
    everything = Window.partitionBy(F.lit(0))
    turn = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.array(*[F.lit(w) for w in weights])[turn % len(weights)]
    by_source = by_source.withColumn("weight", weight).withColumn("cap", F.col("source_size") * epochs)
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    ascending = everything.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = ascending.rowsBetween(Window.unboundedPreceding, -1)
    capped = F.coalesce(F.sum("cap").over(before), F.lit(0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    by_source = by_source.withColumn("total", total).withColumn("level", (total - capped) / open_weight)
    # Sources below the level are full; the first that is not sets the level of all that follow.
    by_source = by_source.withColumn("full", F.col("cap") <= F.col("weight") * F.col("level"))
    rest = F.col("total") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(everything)
    rest_weight = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(everything)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * (rest / F.nullif(rest_weight, F.lit(0))))
    return by_source.select("source", "n_rows", "source_size", target.cast("double").alias("target"))


def _key(seed: int, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """128 random bits as hexadecimal digits, whose order is that of the numbers. They come from the id and the text, so rows that share an id, or have none, are spread like any others."""
    text = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), text).cast("binary"))


def _laid_out(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.5,
    epochs: int = 2,
    rows_per_interval: int = 50_000,
    seed: int = 17,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every row with its key, its source's figures and its interval; the sources (whole, budget); the intervals (interval_size, offset: the words before them, budget).

    Sources and intervals are small tables. Each is computed once, so that what is built on them has a plan of a few steps.
    """
    sizes = cut(
        docs.select(
            F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), _key(seed, id_col, text_col).alias("key")
        )
    )
    sources = source_targets(sizes, weights, share, epochs)
    sources = sources.withColumn("intervals", F.greatest(F.lit(1), F.ceil(F.col("n_rows") / rows_per_interval)).cast("long"))
    sources = sources.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    sources = cut(sources.withColumn("budget", F.floor("target") - F.col("whole") * F.col("source_size")))
    # 52 of the bits choose the interval.
    unit = F.conv(F.substring("key", 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    keyed = sizes.withColumnRenamed("source", "s").join(_sent(sources), F.col("s").eqNullSafe(F.col("source"))).drop("s")
    keyed = keyed.withColumn("interval", F.floor(unit * F.col("intervals")))
    intervals = keyed.groupBy("source", "interval").agg(F.sum("size").alias("interval_size"), F.first("budget").alias("budget"))
    running = Window.partitionBy("source").orderBy("interval").rowsBetween(Window.unboundedPreceding, -1)
    return keyed, sources, cut(intervals.withColumn("offset", F.coalesce(F.sum("interval_size").over(running), F.lit(0))))


def _placed(keyed: DataFrame, intervals: DataFrame) -> DataFrame:
    """The rows of whole intervals with ``last``: the words that their source's last, partial epoch takes of each."""
    within = Window.partitionBy("source", "interval").orderBy("key", "doc_id", "size", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    before = keyed.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    offsets = intervals.select(F.col("source").alias("s"), F.col("interval").alias("i"), "offset")
    placed = before.join(_sent(offsets), F.col("s").eqNullSafe(F.col("source")) & (F.col("i") == F.col("interval")))
    return placed.withColumn("last", F.least(F.col("size"), F.greatest(F.lit(0), F.col("budget") - F.col("offset") - F.col("before"))).cast("long"))


def _place(docs: DataFrame, **options) -> DataFrame:
    """Every row with its key, the whole epochs of its source and the words that the last, partial epoch takes of it."""
    keyed, _, intervals = _laid_out(docs, **options)
    return _placed(keyed, intervals).select("doc_id", "text_key", "key", "size", "source", "source_size", "target", "whole", "last")


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per input row: doc_id, size, source, source_size, target, taken.

    Options: id_col, text_col, source_col; weights in the sources' order, repeating; share of all sizes; epochs at most;
    rows_per_interval; seed. ``taken`` counts words with repeats; a source's sum is its target rounded down. Null texts and empty
    texts have size 0 and are taken 0 times; a null source is a source of its own, last in order; a null id is an
    id like any other. Repeated rows count each; which of two identical rows the cut falls on is immaterial.
    Keys come from id and text, so only rows alike in both share one, and with it an interval.
    Other columns are ignored, an empty table gives an empty result.
    """
    placed = _place(docs, **options)
    return placed.select("doc_id", "size", "source", "source_size", "target", (F.col("whole") * F.col("size") + F.col("last")).cast("long").alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word, white space kept."""
    words = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.array_join(F.slice(words, 1, n), "")


def mixed_documents(docs: DataFrame, seed: int = 17, **options) -> DataFrame:
    """The documents that the mix takes, in the columns of ``docs``: whole epochs as repeated rows, the last one cut at the budget.

    A source's last epoch takes the rows before its cut, a row of (key, id, size, text); so a small table of cuts decides for every document where it
    lies, and texts are not shuffled. The intervals' totals tell in which of them a source's cut lies, so only that one is sorted. ``n_chars``, where there is such a column, follows the text.
    Documents of which no word is taken go. Identical rows at the cut share what it takes of them evenly; the remainder, fewer words than there are such rows, goes with the cut.
    """
    keyed, sources, intervals = _laid_out(docs, seed=seed, **options)
    # The last interval of which a word is taken, its source null or not.
    at_cut = intervals.filter("interval_size > 0 and offset < budget").groupBy("source").agg(F.max("interval").alias("i")).select(F.col("source").alias("_s"), "i")
    rows = _placed(keyed.join(_sent(at_cut), F.col("source").eqNullSafe(F.col("_s")) & (F.col("i") == F.col("interval"))).drop("_s", "i"), intervals)
    # Identical rows have one key, and so one interval.
    alike = rows.groupBy("source", F.struct("key", "doc_id", "size", "text_key").alias("end")).agg(F.sum("last").alias("some"), F.count(F.lit(1)).alias("n"))
    ends = alike.filter("some > 0").groupBy("source").agg(F.max(F.struct("end", F.floor(F.col("some") / F.col("n")).alias("each"))).alias("_at")).select(F.col("source").alias("_s"), "_at")
    cuts = sources.join(ends, F.col("source").eqNullSafe(F.col("_s")), "left").select(F.struct("source", "whole", F.col("_at.end").alias("end"), F.col("_at.each").alias("each")).alias("_tm_cut"))
    small = _sent(cut(cuts))
    here = F.struct(_key(seed).alias("key"), F.col("doc_id"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_key"))
    joined = docs.withColumn("_tm_here", here).join(small, F.col("source").eqNullSafe(F.col("_tm_cut.source")))
    size, end = F.col("_tm_here.size"), F.col("_tm_cut.end")
    last = F.when(end.isNull() | (F.col("_tm_here") > end), F.lit(0)).when(F.col("_tm_here") == end, F.col("_tm_cut.each")).otherwise(size)
    joined = joined.withColumn("_tm_size", size).withColumn("_tm_mine", (F.col("_tm_cut.whole") * size + last).cast("long")).filter("_tm_mine > 0")
    copies = F.expr("transform(sequence(1L, cast(ceil(_tm_mine / _tm_size) as bigint)), k -> least(_tm_size, _tm_mine - (k - 1) * _tm_size))")
    joined = joined.withColumn("_tm_words", F.explode(copies))
    text = F.when(F.col("_tm_words") < F.col("_tm_size"), first_words(F.col("text"), F.col("_tm_words").cast("int"))).otherwise(F.col("text"))
    joined = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.length("text").cast("long"))
    return joined.select(*docs.columns)
