import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import collocations

SCHEMA = "doc_id long, text string, lang string, n long, rank int, phrase string, words string, f int"
ASCII = str.maketrans(collocations.UPPER, collocations.LOWER)


def plain(rows, max_words, min_count, top):
    """By counting every phrase of every length."""
    total, count = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(ASCII)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for m in range(1, max_words + 1):
                for i in range(len(words) - m + 1):
                    count[lang][tuple(words[i : i + m])] += 1
    out = []
    for lang, c in count.items():
        wanted = [p for p, a in c.items() if len(p) > 1 and a >= min_count]
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        scored = []
        for p in wanted:
            a = c[p]
            if any(len(q) > len(p) and c[q] >= a and inside(p, q) for q in wanted):
                continue
            score, k = min((1000 * a * total[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def texts(n, seed):
    rng = random.Random(seed)
    words = ["The", "of", "NEW", "York", "é", "über", "İ", "a b", "x" * 40, *(f"w{i}" for i in range(30))]
    for i in range(n):
        body = "".join(rng.choice(words[: rng.choice([5, 39])]) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\r\n"]) for _ in range(rng.choice([0, 1, 5, 40])))
        yield i, rng.choice([None, "", " \n"]) if rng.random() < 0.05 else body + rng.choice(["", "new york city"]), rng.choice(["en", "en", "de", None, "und"]), 1, 2, "p", "w", 3


@pytest.mark.parametrize(("max_words", "min_count", "top"), [(5, 3, 2000), (3, 2, 4), (2, 300, 10)])
def test_equals_plain_counting(spark, max_words, min_count, top):
    rows = list(texts(250, max_words))
    rows += rows[:20] + [(9_000, " ".join(["very", "long", "text"] * 4_000), "en", 1, 2, "p", "w", 3)]
    got = collocations.mine(spark.createDataFrame(rows, SCHEMA).repartition(7), max_words=max_words, min_count=min_count, top=top)
    assert got.dtypes == [("lang", "string"), ("rank", "bigint"), ("phrase", "string"), *((c, "bigint") for c in ("a", "l", "r", "n", "score"))]
    assert sorted(map(tuple, got.collect())) == plain([(r[1], r[2]) for r in rows], max_words, min_count, top)


def test_a_full_array_lets_through_but_changes_nothing(spark, monkeypatch):
    full = lambda texts, min_count, orders, known: np.full(1 << (collocations.BITS - 3), 255, np.uint8)
    monkeypatch.setattr(collocations, "frequent_cells", full)
    rows = list(texts(120, 9))
    assert sorted(map(tuple, collocations.mine(spark.createDataFrame(rows, SCHEMA), min_count=3).collect())) == plain([(r[1], r[2]) for r in rows], 5, 3, 2000)


def test_arrays_know_every_frequent_phrase_and_few_others(spark):
    rows = [(None if i % 3 else "en", f"all of them again {i} and {i} more {i % 7} times") for i in range(300)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    first = collocations.frequent_cells(df, 100, [1, 2], [])
    second = collocations.frequent_cells(df, 100, [3, 4, 5], [first])
    (words,) = collocations.parts(pa.RecordBatch.from_arrays([pa.array([None] * 2, pa.string()), pa.array(["all of them again and more", "of all 7 times and"])], names=["lang", "text"]))
    on = collocations.possible(words, words.hashes(5), [first, second])
    assert [x.tolist() for x in on] == [[True] * 4 + [False, False, True, True] + [False] * 3, [True, True, True] + [False] * 8, [True, True] + [False] * 9, [True] + [False] * 10, [False] * 11]


def test_rows_alike_and_empty_tables(spark):
    rows = [(None, "a b c", "en", 1, 2, "p", "w", 3)] * 300
    got = [tuple(r) for r in collocations.mine(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert got == [("en", 1, "a b c", 300, 300, 300, 900, 3000)]
    assert collocations.mine(spark.createDataFrame([], SCHEMA)).collect() == []
    assert collocations.mine(spark.createDataFrame([(1, None, None, 1, 2, "p", "w", 3)], SCHEMA)).collect() == []


def test_scores_beyond_64_bits_are_exact(spark):
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    a, n, x, y = 10**13 + 7, 9 * 10**17 + 11, 10**15 + 3, 3 * 10**14 + 1
    row = spark.range(1).selectExpr(f"{a}L as a", f"{n}L as n", f"{x}L as l", f"{y}L as r")
    assert row.selectExpr(f"({wide('a')} * {wide('n')} * 1000) div ({wide('l')} * {wide('r')}) as s").first().s == 1000 * a * n // (x * y)


def test_words_of_a_batch(monkeypatch):
    batch = pa.RecordBatch.from_arrays([pa.array(["x", "x", None, "y", "y"]), pa.array(["Ab c.d", None, "", "e\tF  g", "h", "i j"])[1:]], names=["lang", "text"])
    (words,) = collocations.parts(batch)
    assert words.strings(np.arange(len(words.start))).to_pylist() == ["e", "f", "g", "h", "i", "j"]
    assert words.joined.tolist() == [True, True, False, False, True, False] and words.text.tolist() == [0, 0, 0, 1, 2, 2]
    word, _ = words.hashes(2)
    (more,) = collocations.parts(pa.RecordBatch.from_arrays([pa.array(["und"]), pa.array(["zz g g"])], names=["lang", "text"]))
    again, _ = more.hashes(2)
    assert word[2] == again[1] == again[2] and len(set(word.tolist())) == 6
    monkeypatch.setattr(collocations, "PART_BYTES", 2)
    cut = list(collocations.parts(batch))
    assert [w.strings(np.arange(len(w.start))).to_pylist() for w in cut] == [["e", "f", "g"], ["h", "i", "j"]] and np.array_equal(np.concatenate([w.hashes(1)[0] for w in cut]), word)
    long = pa.RecordBatch.from_arrays([pa.array([None, "x"]), pa.array(["a b.c d,e", "f"])], names=["lang", "text"])
    assert [(w.strings(np.arange(len(w.start))).to_pylist(), w.joined.tolist(), w.lang.tolist()) for w in collocations.parts(long)] == [(["a", "b"], [True, False], [0, 0]), (["c", "d"], [True, False], [0, 0]), (["e", "f"], [False, False], [0, 1])]
