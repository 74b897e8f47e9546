import random
from collections import defaultdict

import pytest

from tidemark.llm import line_dedup
from tidemark.llm.queries import op12_line_dedup

SCHEMA = "doc_id long, text string, key string, docs int, first string, row int, kept string"
WHITE = " \t\n\x0b\x0c\r"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(WHITE).translate(ASCII)


def plain(rows, min_docs, min_chars, keep_first):
    seen = defaultdict(set)
    for r, (_, text) in enumerate(rows):
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                seen[key(line)].add(r)
    common = {k for k, v in seen.items() if len(v) >= min_docs}
    spent, out = {}, [None] * len(rows)
    # First by id, nulls last; texts under one id are unlike in these rows or alike altogether.
    for r in sorted(range(len(rows)), key=lambda r: (rows[r][0] is None, rows[r][0] or 0)):
        lines, kept = (rows[r][1] or "").split("\n"), []
        for i, line in enumerate(lines):
            first = keep_first and spent.setdefault(key(line), (rows[r], i)) == (rows[r], i)
            if key(line) not in common or first:
                kept.append(line)
        out[r] = (rows[r][0], len(lines), len(lines) - len(kept), "\n".join(kept))
    return sorted(out, key=repr)


def make(n, seed):
    rng = random.Random(seed)
    lines = ["", " ", "Home", "home ", "\tHOME\r", "İ", "i̇", "é", "É", "x" * 3000, *(f"line {i}" for i in range(40))]
    for i in range(n):
        yield i, rng.choice([None, ""]) if rng.random() < 0.05 else "\n".join(rng.choice(lines) if rng.random() < 0.7 else f"own {i} {j}" for j in range(rng.choice([1, 2, 9])))


@pytest.mark.parametrize("broadcast_keys", [1_000, 0])
@pytest.mark.parametrize(("min_docs", "min_chars", "keep_first"), [(10, 1, False), (2, 1, True), (3, 5, True), (2, 4, False)])
def test_equals_plain_counting(spark, min_docs, min_chars, keep_first, broadcast_keys):
    rows = list(make(150, min_docs))
    rows += rows[:10] + [(None, "null id\nline 3"), (700, "\n".join(f"line {i % 60}" for i in range(20_000)))]
    df = spark.createDataFrame([(i, t, "k", 1, "f", 2, "x") for i, t in rows], SCHEMA).repartition(6)
    got = line_dedup.drop_lines(df, min_docs=min_docs, min_chars=min_chars, keep_first=keep_first, broadcast_keys=broadcast_keys)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows, min_docs, min_chars, keep_first)


def test_filter_suspects_every_repeat_and_little_else(spark):
    texts = [f"twice {i % 500}\nonce {i}" for i in range(1000)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    filter_ = line_dedup.seen_twice(df, 15, 1, "text")
    has = lambda lines: line_dedup._has(filter_, line_dedup._bits([line_dedup.key_of(x.encode(), 1) for x in lines], 15))
    assert has([f"twice {i}" for i in range(500)]).all() and has([f"once {i}" for i in range(1000)]).mean() < 0.1


def test_query_drops_all_lines_of_ten_rows(spark, tmp_path):
    rows = [(i, f"Shared\nown {i}\nshared ") for i in range(10)] + [(50, "nine\n")] * 9
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = op12_line_dedup(spark, str(tmp_path)).collect()
    assert {(r.n_lines, r.n_dropped) for r in got if r.doc_id < 10} == {(3, 2)} and {(r.n_lines, r.n_dropped) for r in got if r.doc_id == 50} == {(2, 0)}


def test_empty_table(spark):
    assert line_dedup.drop_lines(spark.createDataFrame([], SCHEMA)).collect() == []
