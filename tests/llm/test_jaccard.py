import random
import re
from collections import defaultdict

import pytest

from tidemark.llm import jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    """(doc_id, n, component) of every row by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in holders[x] if j > i}:
            both = len(s & sets[j])
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                top[find(j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min((x for x in (least.get(find(i)), d) if x is not None), default=None)
    return sorted(((d, len(s), least[find(i)] if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(df, **options).collect()), key=str)


def family(rng, words, size, edits, n):
    base = [rng.choice(words) for _ in range(size)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(size)] = rng.choice(words) + str(rng.random())
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    texts = []
    for size, edits, n in ((150, 5, 60), (40, 2, 30), (12, 2, 20), (300, 25, 30)):
        texts += family(rng, words, size, edits, n)
    for _ in range(40):
        texts.append(passage + " " + " ".join(rng.choice(words) for _ in range(rng.randrange(5, 30))))
    texts += ["", None, "  \n", "one", "One", "two words", "TWO  words", "a b c d e", "a b c d e f"]
    texts += ["word " * 30000, "word " * 30000 + "end"]
    texts += texts[:20]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    rows = [(3, text), (3, text), (None, text), (5, text + " nu"), (7, None), (7, ""), (None, ""), (3, "a different text of six words"), (None, "only null ids hold this text here")]
    rows += [(None, text + " nu xi"), (None, text + " nu xi"), (None, "other words " + "a b c d e f g h i j k l m n o p q r"), (None, "other words " + "a b c d e f g h i j k l m n o p q r s")]
    # A row with a null id joins two that are too far apart for a link of their own.
    rows += [(40, "p q r s t u v w x y z 1 2 3 4 5 6 7 8 9 10 11"), (None, "p q r s t u v w x y z 1 2 3 4 5 6 7 8 9 10 11 12 13 14"), (41, "p q r s t u v w x y z 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17")]
    assert (41, 24, 40) in brute(rows)
    assert run(spark, rows) == brute(rows)


def test_empty_and_clashing_columns(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([(1, "a b c d e f", 9, 9, 9)], "doc_id long, text string, cid long, n long, component_id long")
    assert [tuple(r) for r in jaccard.join(df).collect()] == [(1, 2, 1)]


def test_any_order_of_shingles_gives_the_same_links(spark):
    rng = random.Random(3)
    words = ["w%d" % i for i in range(50)]
    rows = list(enumerate(family(rng, words, 60, 4, 80)))
    assert run(spark, rows, frequent_most=0) == run(spark, rows, sample_docs=10) == brute(rows)


def test_frequent_shingles_need_as_many_holders_at_any_size(spark):
    # 24,000 documents of one shingle each, five of them of the same one.
    df = spark.range(24_000).selectExpr("id as doc_id", "case when id < 5 then 'a b c d e' else concat('w', id, ' x y z') end as text")
    token, rank = jaccard.frequent_shingles(df, 5, 24_000, 5, 300_000)
    assert token.tolist() == jaccard.shingle_set("a b c d e").tolist() and rank.tolist() == [1]


def test_pairs_that_cannot_link_go_before_sets_are_sent(spark):
    rng = random.Random(4)
    fresh = lambda n: [str(rng.random()) for _ in range(n)]
    rows, pairs = [], []
    # Both sides of a power of two, far from it, and sets of a few shingles.
    for size in (5, 6, 9, 60, 64, 68, 70, 130, 250, 300, 2000):
        base = fresh(size + 4)
        for share in (0.5, 0.75, 0.89, 0.9, 0.95, 1):
            for more in (0, 0.05, 0.1, 0.25):
                other = base[: round((size + 4) * share)] + fresh(round((size + 4) * (1 - share + more)))
                pairs.append((len(rows), len(rows) + 1))
                rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(other))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "xxhash64(text) as text_key")
    none = (jaccard.np.empty(0, "uint64"), jaccard.np.empty(0, int))
    profiles = jaccard._profiles(df, 5, 80, none).localCheckpoint()
    cid = {r.doc_id: r.cid for r in profiles.collect()}
    asked = spark.createDataFrame([(cid[a], cid[b]) for a, b in pairs], "a long, b long")
    stay = {tuple(r) for r in jaccard._likely(profiles, asked, 80).collect()}
    sets = [shingles(t) for _, t in rows]
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in pairs}
    assert {x for x in alike if alike[x] >= 0.8} <= {x for x in alike if (cid[x[0]], cid[x[1]]) in stay}
    far = [x for x in alike if 0.5 < alike[x] < 0.65 and len(sets[x[0]]) >= 130]
    assert len(far) >= 4 and not [x for x in far if (cid[x[0]], cid[x[1]]) in stay]


def test_texts_do_not_move_beyond_a_broadcast(spark, monkeypatch):
    rng = random.Random(5)
    rows = list(enumerate(family(rng, ["w%d" % i for i in range(50)], 60, 3, 14)))
    rows += [(None, t + " z") for _, t in rows[:4]]
    plans, cut = [], jaccard.cut

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(jaccard, "cut", noted)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 10, raising=False)
    monkeypatch.setattr("tidemark.llm.shared.BROADCAST_ROWS", 10)
    assert run(spark, rows) == brute(rows)
    sent = [p for p in plans if "tokens" in p and "MapInArrow" in p]
    assert sent and not [p for p in sent if re.search(r"hashpartitioning\(doc_id#\d+L?, \d+\)", p)]


def test_only_groups_of_several_rows_are_gathered(spark, monkeypatch):
    df = spark.createDataFrame([(1, 1, 1, [5, 6]), (2, 1, 1, [5, 6]), (3, 2, 1, [7])], "doc_id long, gid long, n long, prefix array<long>")
    repeated = spark.createDataFrame([(1,)], "gid long")
    want = [(1, 1, [5, 6]), (2, 1, [7])]
    assert sorted(map(tuple, jaccard._groups(df, repeated).collect())) == want
    monkeypatch.setattr("tidemark.llm.shared.BROADCAST_ROWS", 0)
    assert sorted(map(tuple, jaccard._groups(df, repeated).collect())) == want
