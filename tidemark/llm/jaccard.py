"""N-gram Jaccard join of whole texts by grouped prefixes.

A text's set is its distinct 5-word shingles, as 64-bit hashes in one global order: shingles that are frequent in a bounded sample come
last, the most frequent at the very end, ties by hash. Two sets at the threshold share a shingle among the first
n - ceil(0.8 n) + 1 of each, at positions that leave room for the overlap they need.

1. Documents with the same prefix and size collapse into one group, equal sets into one class.
2. Groups meet at shared prefix shingles. At each shingle the group with the least position (of a family of near copies the least edited) is its
   head; every group's members are verified against the members of the heads that it meets most, exactly, from whole texts.
3. Connected classes are clusters. Every pair of classes that meet, fit in size and position, and are not of one cluster
   yet, is then expanded and verified as well. So no link between clusters is lost, and a family of thousands of near copies costs
   about as many verifications as it has members, not their square.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm import shared
from tidemark.llm.shared import cut, held, new_dir, sent_small, small_batches, small_parts
from tidemark.llm.tokens import slices

#: Multipliers of a shingle's words, and those of the finishing mix (odd 64-bit numbers).
_TURNS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: Documents per task of one verification key.
FAN = 512
#: Shared shingles of a class that are looked back on.
BEFORE = 4


class _WordHashes(dict):
    """Words' hashes; the most recent are kept."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_hashes(words: list[bytes], width: int = 5) -> np.ndarray:
    """The hash of every run of ``width`` words; fewer words than that are one shingle, no words none."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(held("word hashes", _WordHashes).__getitem__, words), np.uint64, len(words))
    n = len(h) - width + 1
    if n < 1:
        mixed = np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(h))], np.uint64)
    else:
        mixed = np.zeros(n, np.uint64)
        for i in range(width):
            mixed += h[i : i + n] * _TURNS[i % len(_TURNS)]
            mixed ^= mixed >> np.uint64(29)
    mixed = (mixed ^ (mixed >> np.uint64(30))) * _MIX[0]
    mixed = (mixed ^ (mixed >> np.uint64(27))) * _MIX[1]
    return mixed ^ (mixed >> np.uint64(31))


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """The distinct shingles' hashes, ascending."""
    return np.unique(shingle_hashes((text or "").encode("utf-8", "surrogatepass").lower().split(), width))


def least_overlap(n: int, percent: int) -> int:
    """Of a set of n, what any set at the threshold shares with it at least."""
    return -(-percent * n // 100)


def frequent_shingles(docs: DataFrame, width: int, sample_docs: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several documents of a sample share, ascending, and their rank by frequency.

    The sample is ``sample_docs`` documents or a sixteenth of all, whichever is more. The ranks only order the shingles: any order gives the
    same links. ``least`` holds at every size: were it a share of the documents, unlisted shingles would have ever more holders, and pairs
    would grow with the square of the input. ``most`` bounds what is collected and sent to the tasks.
    """
    n = docs.count()
    sample_docs = max(sample_docs, n // 16)
    part = min(1.0, sample_docs / max(1, n))
    sample = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < F.lit(int(part * 1_000_000) + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch.column(0).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array([shingle_set(x, width).view(np.int64) for x in some], pa.list_(pa.int64()))], names=["tokens"])

    counted = sample.select("text").mapInArrow(run, "tokens array<long>").select(F.explode("tokens").alias("token")).groupBy("token").count()
    rows = counted.filter(F.col("count") >= least).orderBy(F.desc("count"), "token").limit(most).toArrow()
    token = rows.column("token").to_numpy().astype(np.int64).view(np.uint64)
    rank = np.arange(len(token), 0, -1)
    order = np.argsort(token)
    return token[order], rank[order]


def parity_bits(s: np.ndarray) -> np.ndarray:
    """For each low end of a hash whether an odd number of the set's hashes has it, as bits of longs: the power of two from n on, 64 at least.

    Two sets' bits differ at most where one of the sets has a shingle that the other has not.
    """
    size = max(64, 1 << (len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(size - 1)).view(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _profiles(docs: DataFrame, width: int, percent: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, text_key, n, cid (class: hash of the set), gid (group: hash of size and prefix), prefix (in global order), bits (parity_bits)."""
    spread = docs.sparkSession.sparkContext.broadcast(frequent)
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, rank = spread.value
        for batch in batches:
            at_row = 0
            for some in slices(batch.column(1).to_pylist()):
                out = []
                for text in some:
                    s = shingle_set(text, width)
                    if not len(s):
                        out.append((0, None, None, None, None))
                        continue
                    n, ordered = len(s), s
                    if len(common):
                        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                        weight = np.where(common[at] == s, rank[at], 0)
                        if weight.any():
                            ordered = s[np.lexsort((s, weight))]
                    prefix = ordered[: n - least_overlap(n, percent) + 1].view(np.int64)
                    cid = xxhash.xxh3_64_intdigest(s.tobytes(), seed=n & 0x7FFFFFFF)
                    gid = xxhash.xxh3_64_intdigest(prefix.tobytes(), seed=n & 0x7FFFFFFF)
                    out.append((n, cid - (1 << 63), gid - (1 << 63), prefix, parity_bits(s)))
                columns = list(zip(*out))
                part = batch.slice(at_row, len(some))
                at_row += len(some)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), *(pa.array(x, pa.int64()) for x in columns[:3]), *(pa.array(x, pa.list_(pa.int64())) for x in columns[3:])],
                    names=["doc_id", "text_key", "n", "cid", "gid", "prefix", "bits"],
                )

    return docs.mapInArrow(run, f"doc_id {doc_type}, text_key long, n long, cid long, gid long, prefix array<long>, bits array<long>")


def _likely(profiles: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose parity bits differ in no more places than sets at the threshold can.

    Sets at the threshold differ in at most n_a + n_b less twice the needed overlap, and bits differ in no more. Of bits of twice the other's
    length one half is laid over the other; still longer ones aren't compared.
    """
    ids = cut(pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct())
    have = profiles.select("cid", "n", "bits").join(sent_small(ids), "cid").groupBy("cid").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    side = lambda c: have.select(F.col("cid").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    of_a, of_b = F.size("bits_a"), F.size("bits_b")
    laid = lambda bits, to: F.when(F.size(bits) > to, F.zip_with(F.slice(bits, 1, to), F.slice(bits, to + 1, to), lambda x, y: x.bitwiseXOR(y))).otherwise(F.col(bits))
    differing = F.zip_with(laid("bits_a", of_b), laid("bits_b", of_a), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    need = F.expr(f"({percent} * (n_a + n_b) + {99 + percent}) div {100 + percent}")
    within = F.aggregate(differing, F.lit(0), lambda total, x: total + x) <= F.col("n_a") + F.col("n_b") - 2 * need
    return both.filter(F.when(F.greatest(of_a, of_b) <= 2 * F.least(of_a, of_b), within).otherwise(True)).select("a", "b")


def _verified(docs: DataFrame, profiles: DataFrame, places: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets are at the threshold, by exact intersection of whole sets.

    ``places`` names a document of each class by its id or, of a class whose ids are all null, by its text's hash. ``b`` is the side with many partners: they come to it in runs of FAN documents.
    """
    pairs = cut(_likely(profiles, cut(pairs), percent))
    runs = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / FAN).cast("int").alias("runs"))
    to_b = pairs.join(runs, "b").select(F.col("a").alias("cid"), F.col("b").alias("key"), F.pmod(F.xxhash64("a"), F.col("runs")).cast("int").alias("run"), F.lit(True).alias("member"))
    own = runs.select(F.col("b").alias("cid"), F.col("b").alias("key"), F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("run"), F.lit(False).alias("member"))
    jobs = cut(places.join(to_b.union(own), "cid").select(F.col("place").alias("doc_id"), "place_key", "cid", "key", "run", "member"))
    # A document's text goes on once for each of its pairs as a set, which is made where the text is read.
    per_doc = jobs.groupBy("doc_id", "place_key", "cid").agg(F.collect_list(F.struct("key", "run", "member")).alias("jobs"))
    n_jobs, columns = jobs.count(), ["text", "cid", "jobs"]
    if n_jobs > shared.BROADCAST_ROWS:
        per_doc = cut(per_doc)
    # Texts stay where they are: what is beyond one broadcast goes to them in several.
    texts = [docs.select("doc_id", "text").join(part, "doc_id").select(columns) for part in small_parts(per_doc.filter("doc_id is not null"), "doc_id", n_jobs)]
    if not jobs.filter("doc_id is null").isEmpty():
        unnamed = docs.filter("doc_id is null").select("text", "text_key")
        texts += [unnamed.join(part, F.col("text_key") == F.col("place_key")).dropDuplicates(["text_key"]).select(columns) for part in small_parts(per_doc.filter("doc_id is null"), "place_key", n_jobs)]
    texts = reduce(DataFrame.union, texts)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at_row = 0
            for some in slices(list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())), size=lambda x: len(x[0] or "")):
                tokens, keep = [], []
                for i, (text, cid) in enumerate(some):
                    s = shingle_set(text, width)
                    if len(s) and xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s) & 0x7FFFFFFF) - (1 << 63) == cid:
                        tokens.append(s.tobytes())
                        keep.append(at_row + i)
                at_row += len(some)
                if keep:
                    yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(keep)), batch.column(2).take(pa.array(keep)), pa.array(tokens, pa.binary())], names=["cid", "jobs", "tokens"])

    found = texts.mapInArrow(sets, "cid long, jobs array<struct<key:long,run:int,member:boolean>>, tokens binary")
    # Rows that repeat an id and a text give a set again; the links are the same.
    sent = found.select("cid", "tokens", F.explode("jobs").alias("job")).select("job.*", "cid", "tokens")
    sent = sent.repartition(F.col("key"), F.col("run")).sortWithinPartitions("key", "run", "member")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head_key, head, size = None, np.empty(0, np.uint64), 0
        for batch in batches:
            left, right = [], []
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for key, run, member, cid, tokens in zip(*columns):
                s = np.frombuffer(tokens, np.uint64)
                if not member:
                    head_key, head, size = (key, run), s, len(s)
                elif head_key == (key, run):
                    at = np.searchsorted(head, s)
                    both = int((head[np.minimum(at, size - 1)] == s).sum())
                    if 100 * both >= percent * (size + len(s) - both):
                        left.append(cid)
                        right.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return cut(sent.mapInArrow(compare, "a long, b long").distinct())


def _groups(own: DataFrame, repeated: DataFrame) -> DataFrame:
    """gid, n and prefix of each group, once. Only the prefixes of groups of several rows (``repeated``) are gathered, while those fit a broadcast."""
    once = lambda rows: rows.groupBy("gid").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    if repeated.count() > shared.BROADCAST_ROWS:
        return once(own)
    repeated = F.broadcast(repeated)
    return own.join(repeated, "gid", "left_anti").select("gid", "n", "prefix").union(once(own.join(repeated, "gid", "left_semi")))


def join(
    docs: DataFrame, *, width: int = 5, percent: int = 80, heads: int = 2, sample_docs: int = 16_000, frequent_least: int = 5, frequent_most: int = 300_000, id_col: str = "doc_id", text_col: str = "text", detail: bool = False
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (least id reachable by links, the own one included).

    Null, empty and wordless texts have no shingles and link with nothing: component_id is their own id. Repeated rows and equal
    sets are of one class and always linked. Rows with a null id take part; a component of such rows alone has a null id.
    Rows that repeat an id with other texts are documents of their own. Very long texts are used whole. Other columns are ignored; an empty table gives no rows.
    Sets are compared as 64-bit hashes of shingles. ``detail`` adds ``component``, which is not null for any row with shingles, and
    ``text_key``, the text's hash.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
    spark = docs.sparkSession
    small_batches(spark)
    at = new_dir(spark, "shingle-profiles")
    _profiles(docs, width, percent, frequent_shingles(docs, width, sample_docs, frequent_least, frequent_most)).write.parquet(at)
    profiles = spark.read.parquet(at)
    own = profiles.filter("n > 0")
    # A class's place is the least id that holds it, or a text's hash where no id does.
    classes = cut(own.groupBy("gid", "cid").agg(F.min("doc_id").alias("place"), F.min(F.when(F.col("doc_id").isNull(), F.col("text_key"))).alias("key"), F.first("n").alias("n"), F.count(F.lit(1)).alias("times")))
    places = classes.select("cid", "place", F.when(F.col("place").isNull(), F.col("key")).alias("place_key"))
    members = classes.select("gid", "cid")
    groups = _groups(own, cut(classes.groupBy("gid").agg(F.sum("times").alias("times")).filter("times > 1").select("gid")))
    postings = groups.select("gid", "n", F.posexplode("prefix").alias("pos", "token"))
    at_token = Window.partitionBy("token")
    meeting = postings.withColumn("met", F.count(F.lit(1)).over(at_token)).withColumn("head", F.min(F.struct("pos", "gid", "n")).over(at_token)).filter("met > 1").drop("met")
    kept_at = new_dir(spark, "shingle-postings")
    meeting.write.parquet(kept_at)
    meeting = spark.read.parquet(kept_at)

    fits = "least(n - pos, {n} - {p}) * (100 + {t}) >= {t} * (n + {n})"
    star = meeting.filter("gid != head.gid").filter(fits.format(n="head.n", p="head.pos", t=percent)).groupBy("gid", F.col("head.gid").alias("head")).count()
    star = star.withColumn("turn", F.row_number().over(Window.partitionBy("gid").orderBy(F.desc("count"), "head"))).filter(F.col("turn") <= heads)
    first_of = members.groupBy("gid").agg(F.min("cid").alias("first"))
    to_heads = star.join(members, "gid").join(first_of.withColumnRenamed("gid", "head"), "head").select(F.col("cid").alias("a"), F.col("first").alias("b"))
    within = members.join(first_of, "gid").filter("cid != first").select(F.col("cid").alias("a"), F.col("first").alias("b"))
    star_links = _verified(docs, profiles, places, to_heads.union(within).distinct(), width, percent)
    clusters = components(star_links)

    known = cut(members.join(clusters.withColumnRenamed("node", "cid"), "cid", "left").select("gid", "cid", F.coalesce("component", "cid").alias("cluster")))
    # A group's own members meet at a token of their own, at the first position.
    several = known.join(known.groupBy("gid").agg(F.count(F.lit(1)).alias("k")).filter("k > 1"), "gid", "left_semi").join(classes.select("gid", "cid", "n"), ["gid", "cid"])
    met = meeting.select("token", "gid", "n", "pos").join(known, "gid").select("token", "cid", "cluster", "n", "pos")
    met = met.union(several.select(F.xxhash64(F.lit("group"), "gid").alias("token"), "cid", "cluster", "n", F.lit(0).alias("pos")))
    mixed = met.withColumn("lo", F.min("cluster").over(at_token)).withColumn("hi", F.max("cluster").over(at_token)).filter("lo != hi").drop("lo", "hi")
    # Each class's shared shingles in order, so that a pair is made at the first one that it has in common.
    placed = mixed.groupBy("cid", "cluster", "n").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("seq"))
    placed = placed.select("cid", "cluster", "n", "seq", F.posexplode("seq").alias("at", "here"))
    # Of a long prefix only the nearest BEFORE, so a pair may be made again, but never lost.
    before = F.transform(F.slice("seq", F.greatest(F.lit(1), F.col("at") - (BEFORE - 1)), F.least(F.col("at"), F.lit(BEFORE))), lambda e: e["token"])
    placed = cut(placed.select("here.token", "here.pos", "cid", "cluster", "n", before.alias("before")))
    x, y = placed.alias("x"), placed.alias("y")
    cross = x.join(
        y,
        F.expr("x.token = y.token and x.cluster != y.cluster and (x.n < y.n or x.n = y.n and x.cid < y.cid) and 100 * x.n >= {t} * y.n and least(x.n - x.pos, y.n - y.pos) * (100 + {t}) >= {t} * (x.n + y.n) and not arrays_overlap(x.before, y.before)".format(t=percent)),
    ).select(F.col("x.cid").alias("p"), F.col("y.cid").alias("q"))
    cross_links = _verified(docs, profiles, places, cross.distinct().select(F.col("p").alias("a"), F.col("q").alias("b")), width, percent)
    linked = components(star_links.union(cross_links)) if not cross_links.isEmpty() else clusters

    least_id = classes.groupBy("cid").agg(F.min("place").alias("place"))
    by_class = least_id.join(linked.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    by_component = by_class.groupBy("component").agg(F.min("place").alias("component_id"))
    named = by_class.join(by_component, "component").select("cid", "component", "component_id")
    result = profiles.select("doc_id", F.col("n").alias("n_shingles"), "cid", "text_key").join(named, "cid", "left")
    more = ["component", "text_key"] if detail else []
    return result.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), *more)


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` (columns doc_id and text) that stay: of each component one row, that with the least id; rows without words all.

    Rows of a component with null ids alone, or with one id and several texts, come down to the least text hash; of rows alike in both
    the first by the other columns stays.
    """
    rows = cut(join(docs, detail=True, **options).filter("n_shingles > 0").groupBy("component", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("times")))
    best = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "text_key")).alias("best"))
    judged = rows.join(best, "component").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_key") == F.col("best.text_key")))
    judged = cut(judged.select(F.col("doc_id").alias("_tm_id"), F.col("text_key").alias("_tm_key"), "stays", "times"))
    same = lambda other: docs["doc_id"].eqNullSafe(other["_tm_id"]) & (F.xxhash64(docs["text"]) == other["_tm_key"])
    several = judged.filter("stays and times > 1").select("_tm_id", "_tm_key")
    go = judged.filter("not stays").select("_tm_id", "_tm_key").union(several)
    # What goes is less than what stays, and texts stay where they are: what is beyond one broadcast goes to them in several.
    kept = reduce(lambda left, part: left.join(part, same(part), "left_anti"), small_parts(go, "_tm_key"), docs)
    if several.isEmpty():
        return kept
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    first = Window.partitionBy("doc_id", "text").orderBy(*(F.col(f"`{c}`") for c in others) if others else [F.lit(0)])
    again = reduce(DataFrame.union, [docs.join(part, same(part), "left_semi") for part in small_parts(several, "_tm_key")])
    again = again.withColumn("_tm_turn", F.row_number().over(first)).filter("_tm_turn = 1")
    return kept.unionByName(again.select(*docs.columns))
