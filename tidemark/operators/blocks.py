"""Series in time blocks: what a window over a whole series does, done block by block, so that a service with most of the rows is many tasks.

A block is a run of ``seconds`` of one series. What a block needs from earlier ones comes to it as extra rows: those of the block before that a frame reaches, or
the last row of the block before it. Only tables with a row per series and block are gathered by series; their length is that of time, not of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Blocks of an as-of join are so many times as long as what it looks back.
FRAMES = 4
#: Seconds of a block where there is no frame.
DAY = 86_400


def block_of(epoch: Column | str, seconds: int) -> Column:
    return F.floor((F.col(epoch) if isinstance(epoch, str) else epoch) / seconds)


def framed(rows: DataFrame, keys: list[str], frames: dict[str, tuple[int, Column]], epoch: str = "epoch") -> DataFrame:
    """Adds each of ``frames`` (name: seconds, sum or count): the aggregate over the rows of the series not older than so many seconds, both ends included.

    A block is a second longer than the frame, so a frame is the head of its own block and the tail of the one before; both are running aggregates, whose work is
    that of the rows, however many of them a frame holds, and nothing is subtracted. A null time is in no other row's frame, and rows of null times share one.
    """
    added = rows.columns
    for seconds in dict.fromkeys(s for s, _ in frames.values()):
        # A row is handed on to the next block at the last time that asks for it.
        block, once = block_of(epoch, seconds + 1), F.array(F.lit(0))
        both = rows.withColumn("_later", F.explode(F.when(F.col(epoch).isNull(), once).otherwise(F.array(F.lit(0), F.lit(1)))))
        both = both.withColumns({"_block": block + F.col("_later"), "_until": F.col(epoch) + F.col("_later") * seconds})
        in_block = Window.partitionBy(*keys, "_block")
        head = in_block.orderBy("_later", "_until").rangeBetween(Window.unboundedPreceding, 0)
        tail = in_block.orderBy(F.desc("_later"), F.desc("_until")).rangeBetween(Window.unboundedPreceding, 0)
        back = in_block.orderBy(F.desc("_until")).rangeBetween(Window.unboundedPreceding, 0)
        own = {name: aggregate for name, (s, aggregate) in frames.items() if s == seconds}
        both = both.withColumns({f"_head_{name}": aggregate.over(head) for name, aggregate in own.items()}).withColumns({f"_tail_{name}": aggregate.over(tail) for name, aggregate in own.items()})
        tails = F.struct(*[f"_tail_{name}" for name in own])
        both = both.withColumn("_tails", F.last(F.when(F.col("_later") == 1, tails), ignorenulls=True).over(back)).filter("_later = 0")
        merge = lambda h, t: F.coalesce(h + t, h, t)
        rows = both.withColumns({name: merge(F.col(f"_head_{name}"), F.col("_tails")[f"_tail_{name}"]) for name in own})
        added = [*added, *own]
        rows = rows.select(*added)
    return rows.select(*added[: len(added) - len(frames)], *frames)


def _blocks(rows: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """Rows of a block table (keys, _block, ``columns``) as one array per series, in the blocks' order: ``_all``."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_block", *columns))).alias("_all"))


def previous(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str, epoch: str = "epoch", seconds: int = DAY) -> DataFrame:
    """Adds ``name``: ``value`` of the row before in the series' order (``order`` begins with what ``epoch`` rises with), null for the first."""
    rows = rows.withColumn("_block", block_of(epoch, seconds))
    kept = F.struct(*[F.col(c) for c in dict.fromkeys([*order, value])])
    last = rows.groupBy(*keys, "_block").agg(F.max_by(kept, F.struct(*order)).alias("_last"))
    # Each block but the first gets the last row of the one before it, wherever that is.
    handed = _blocks(last, keys, "_last").select(*keys, F.inline(F.expr("transform(slice(_all, 2, size(_all)), (b, i) -> struct(b._block as _block, _all[i]._last as _last))")))
    handed = handed.select(*keys, "_block", "_last.*").withColumn("_handed", F.lit(True))
    both = rows.unionByName(handed, allowMissingColumns=True)
    by_block = Window.partitionBy(*keys, "_block").orderBy(*order)
    return both.withColumn(name, F.lag(value).over(by_block)).filter("_handed is null").drop("_handed", "_block")


def as_of(rows: DataFrame, asked: DataFrame, keys: list[str], order: list[str], kept: list[str], name: str, stale: int, epoch: str = "epoch") -> DataFrame:
    """Adds to each row of ``asked`` (keys, ``epoch``, more) the struct ``name`` of ``kept``, from the last row of ``rows`` at or before it that is not older than ``stale`` seconds.

    As blocks are no shorter than that, only the block before can still hold it: its last row is handed on.
    """
    size = max(FRAMES * (stale + 1), 600)
    found = F.struct(*kept).alias(name)
    given = rows.select(*keys, epoch, *[c for c in order if c not in (epoch, *keys)], found, block_of(epoch, size).alias("_block"), F.lit(0).alias("_asks"))
    tails = given.groupBy(*keys, "_block").agg(F.max_by(F.struct(*[c for c in given.columns if c not in (*keys, "_block")]), F.struct(*order)).alias("_t"))
    tails = tails.select(*keys, (F.col("_block") + 1).alias("_block"), "_t.*")
    asks = asked.withColumns({"_block": block_of(epoch, size), "_asks": F.lit(1)})
    both = given.unionByName(tails).unionByName(asks, allowMissingColumns=True)
    # At equal times rows come before what asks for them.
    before = Window.partitionBy(*keys, "_block").orderBy(epoch, "_asks", *[c for c in order if c != epoch]).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("_asks") == 0, F.struct(F.col(epoch).alias("at"), F.col(name).alias("row"))), ignorenulls=True).over(before)
    out = both.withColumn("_seen", seen).filter("_asks = 1")
    fresh = F.col(epoch) - F.col("_seen.at") <= stale
    return out.withColumn(name, F.when(fresh, F.col("_seen.row"))).select(*asked.columns, name)


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str, epoch: str = "epoch", seconds: int = DAY) -> DataFrame:
    """Adds ``name``: each row's number in its series' order, from 1; numbers within blocks plus the rows of the blocks before."""
    rows = rows.withColumn("_block", block_of(epoch, seconds))
    sizes = rows.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    # The number of rows before each block, by one walk over the series' blocks.
    walk = "aggregate(_all, struct(0L as total, cast(array() as array<struct<_block: bigint, _before: bigint>>) as done), (s, b) -> struct(s.total + b._n as total, concat(s.done, array(struct(b._block as _block, s.total as _before))) as done)).done"
    offsets = _blocks(sizes, keys, "_n").select(*keys, F.inline(F.expr(walk)))
    by_block = Window.partitionBy(*keys, "_block").orderBy(*order)
    return rows.withColumn("_turn", F.row_number().over(by_block)).join(offsets, [*keys, "_block"]).withColumn(name, F.col("_before") + F.col("_turn")).drop("_turn", "_before", "_block")


# Exact ranks


#: Buckets of values: 256 to a doubling, so the values of one differ by 0.3 % at most.
PER_DOUBLING, BEYOND = 256, 1 << 30


def value_bucket(v: Column) -> Column:
    """A number that rises with the value: its logarithm in steps, negative for negative values; infinities and NaN at the ends."""
    size = F.floor(F.log2(F.abs(v)) * PER_DOUBLING) + 300_000  # of a double never below -275,000
    return F.when(F.isnan(v), BEYOND + 1).when(F.abs(v) == float("inf"), F.signum(v) * BEYOND).when(v == 0, 0).otherwise(F.signum(v) * size).cast("bigint")


def ranked(counted: DataFrame, keys: list[str], wanted: dict[str, Column]) -> DataFrame:
    """(keys, n, names): the values at given ranks. ``counted`` has each value ``_v`` (double, not null) once per key, with its count ``_n``; ``wanted`` gives a rank (from 1) by ``_all``, the count of the key.

    Counts per bucket of values tell which bucket holds a rank, and how many values lie before it; only that bucket's values are sorted.
    """
    # A struct of the keys is never null, nor is a bucket: so a join adds no filter to one of its sides, both read the same exchange, and null keys keep their rows.
    counted = counted.select(F.struct(*keys).alias("_k"), "_v", "_n", F.coalesce(value_bucket(F.col("_v")), F.lit(0).cast("bigint")).alias("_b"))
    sizes = counted.groupBy("_k", "_b").agg(F.sum("_n").alias("_n"))
    table = sizes.groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("_b", "_n"))).alias("_buckets"), F.sum("_n").alias("_all"))
    ranks = F.array(*[F.struct(F.lit(name).alias("_name"), rank.cast("bigint").alias("_rank")) for name, rank in wanted.items()])
    ranks = table.select("_k", "_buckets", "_all", F.inline(ranks))
    # The first bucket up to which there are as many values as the rank, and the values before it.
    walk = "aggregate(_buckets, struct(0L as before, cast(null as bigint) as b), (s, x) -> if(s.b is not null, s, if(s.before + x._n >= _rank, struct(s.before as before, x._b as b), struct(s.before + x._n as before, cast(null as bigint) as b))))"
    ranks = ranks.withColumn("_at", F.expr(walk)).select("_k", "_all", "_name", F.coalesce("_at.b", F.lit(0).cast("bigint")).alias("_b"), (F.col("_rank") - F.col("_at.before")).alias("_within"))
    upto = F.sum("_n").over(Window.partitionBy("_k", "_b", "_name").orderBy("_v"))
    hit = counted.join(ranks, ["_k", "_b"]).withColumn("_upto", upto).filter("_upto >= _within")
    found = hit.groupBy("_k").agg(F.max("_all").alias("n"), *[F.min(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in wanted])
    return found.select("_k.*", "n", *wanted)
