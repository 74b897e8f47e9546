import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, source string, n_chars long, taken int, size int, key string"


def level_targets(sizes, weights=(3, 1, 2)):
    """Shares again and again until no source is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        per = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * sizes[s] < weight[s] * per}
        for s in full or open_:
            target[s] = 2.0 * sizes[s] if full else weight[s] * per
        left -= sum(2 * sizes[s] for s in full)
        open_ = open_ - full if full else set()
    return target


def random_key(i, text):
    own = "" if i is None else i
    return hashlib.md5(f"17:{own}:{hashlib.md5((text or '').encode()).hexdigest()}".encode()).hexdigest()


def make(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["a"] * 8 + ["b", "c", "B", "é", None, "tiny"])
        k = rng.choice([0, 1, 3, 50]) if source != "tiny" else 1
        text = rng.choice([" ", "", "\n"]) + " \t".join(f"w{j}" for j in range(k)) if rng.random() > 0.05 else None
        rows.append((i, text, source, 0 if text is None else len(text), 7, 7, "k"))
    return rows, spark.createDataFrame(rows, COLUMNS)


@pytest.mark.parametrize("interval", [7, 2000])
def test_targets_and_cuts(spark, interval):
    rows, df = make(spark)
    got = {r.doc_id: r for r in mixing.mix(df, rows_per_interval=interval).collect()}
    size, texts = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}, {r[0]: r[1] for r in rows}
    by = defaultdict(int)
    for r in rows:
        by[r[2]] += size[r[0]]
    targets = level_targets(dict(by))
    for s in by:
        ids = sorted((r[0] for r in rows if r[2] == s), key=lambda i: random_key(i, texts[i]))
        whole = int(targets[s] // by[s]) if by[s] else 0
        left = int(targets[s]) - whole * by[s]
        for i in ids:
            take = min(size[i], left)
            left -= take
            assert got[i].size == size[i] and got[i].source_size == by[s] and got[i].target == pytest.approx(targets[s])
            assert got[i].taken == whole * size[i] + take <= 2 * size[i]


def test_mixed_documents_are_what_the_mix_takes(spark):
    rows, df = make(spark, 300, 2)
    df = df.union(df.filter("doc_id < 5"))
    taken = Counter()
    for r in mixing.mix(df).collect():
        taken[r.doc_id] += r.taken
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    text = {r[0]: r[1] for r in rows}
    words = Counter()
    for r in out.collect():
        assert text[r.doc_id].startswith(r.text) and r.n_chars == len(r.text) and (r.taken, r.key) == (7, "k")
        words[r.doc_id] += len(WORD.findall(r.text))
    off = {i: taken[i] - words[i] for i in set(taken) | set(words) if taken[i] != words[i]}
    assert all(i < 5 and 0 < d < 2 for i, d in off.items())


def test_odd_tables(spark):
    assert mixing.mix(spark.createDataFrame([], COLUMNS)).count() == 0
    assert mixing.mixed_documents(spark.createDataFrame([], COLUMNS)).count() == 0
    rows = [(None, "a b c", None, 5, 1, 1, "")] * 3 + [(1, None, "x", 0, 1, 1, ""), (1, "", "x", 0, 1, 1, "")]
    df = spark.createDataFrame(rows, COLUMNS)
    got = mixing.mix(df).collect()
    assert sum(r.taken for r in got if r.source is None) == 13 and sum(r.taken for r in got if r.source == "x") == 0
    assert mixing.mixed_documents(df).filter(F.col("text").isNull()).count() == 0


def test_rows_without_an_id_are_spread_and_cut_like_any_others(spark):
    rows = [(None if i % 3 else 5, f"w{i} " * (i % 7 + 1), "hot" if i % 4 else "cold", 0, 1, 1, "") for i in range(3000)]
    df = spark.createDataFrame(rows, COLUMNS)
    places = mixing._place(df, rows_per_interval=100)
    assert places.select("key").distinct().count() == 3000
    # By tenths of the key space no part has more than twice its share.
    assert max(Counter(int(r.key[:2], 16) // 26 for r in places.select("key").collect()).values()) < 600
    size = {random_key(r[0], r[1]): (len(WORD.findall(r[1])), r[2]) for r in rows}
    by = Counter()
    for n, s in size.values():
        by[s] += n
    targets = level_targets(dict(by))
    got = {r.key: r.whole * r["size"] + r["last"] for r in places.collect()}
    for s in by:
        whole = int(targets[s] // by[s])
        left = int(targets[s]) - whole * by[s]
        for k in sorted(k for k in size if size[k][1] == s):
            take = min(size[k][0], left)
            left -= take
            assert got[k] == whole * size[k][0] + take


def test_no_python_in_the_plan(spark):
    plan = mixing.mix(make(spark)[1])._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_rows_alike_at_the_cut_share_what_it_takes(spark):
    """Of 13 words nine are a whole epoch; the other four go to three rows, those that the cut itself leaves out among them, and never come to more."""
    df = spark.createDataFrame([(None, "a b c", None, 5, 1, 1, "")] * 3, COLUMNS)
    words = Counter(r.source for r in mixing.mixed_documents(df).collect() for _ in r.text.split())
    assert 13 - 3 < words[None] <= 13


def test_plans_are_of_a_few_steps(spark):
    """Sources and intervals are computed once: where rows are placed, only the words before a row within its interval are a window."""
    plan = mixing._place(make(spark)[1])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and plan.count("Join ") == 2
