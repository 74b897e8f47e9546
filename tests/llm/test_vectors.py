import numpy as np
import pytest

from tidemark.llm import ann, topk

SCHEMA = "vec_id long, embedding array<float>, rank int, score string, v int"


def make(spark, n, d, seed, copies=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)).astype(np.float32)
    x[:copies] = x[0]
    rows = [(i, [float(v) for v in row], 1, "s", 2) for i, row in enumerate(x)]
    return rows, x


def odd_rows(d):
    return [(50_000, None, 1, "s", 2), (None, [1.0] * d, 1, "s", 2), (50_050, [1.0] * (d - 1) + [None], 1, "s", 2), (50_100, [float("nan")] * d, 1, "s", 2), (50_150, [float("inf")] + [0.0] * (d - 1), 1, "s", 2), (None, None, 1, "s", 2)]


def ranked(scores, ids, k):
    """{query: [(id, score)]}, ties to smaller ids."""
    out = {}
    for i, q in enumerate(ids):
        if q % 50 == 0:
            order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-scores[i, j], ids[j]))[:k]
            out[q] = [(ids[j], scores[i, j]) for j in order]
    return out


def collected(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r.rank
    return out


@pytest.mark.parametrize(("n", "d", "copies", "blocks"), [(700, 16, 300, (100, 5)), (60, 3, 0, (1000, 1000)), (4, 2, 4, (2, 2))])
def test_exact_top_k(spark, n, d, copies, blocks):
    rows, x = make(spark, n, d, 1, copies)
    df = spark.createDataFrame(rows + odd_rows(d) + rows[:3], SCHEMA)
    ints = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    want = ranked(ints @ ints.T, list(range(n)), 5)
    assert collected(topk.top_k(df, points_block=blocks[0], queries_block=blocks[1])) == want


def test_exact_top_k_of_large_numbers(spark):
    rng = np.random.default_rng(5)
    x = (rng.integers(-1000, 1000, (120, 4)) * 997.0).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r], 1, "", 1) for i, r in enumerate(x)], SCHEMA)
    ints = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    assert collected(topk.top_k(df)) == ranked(ints @ ints.T, list(range(120)), 5)


def test_large_components_stay(spark):
    rows = [(0, [1.0, 2.0]), (1, [2e6, 0.0]), (2, [1.0, 1.0]), (3, [1e18, 1.0]), (4, [0.5, -1.0]), (5, [0.0, 1.0])]
    got = collected(topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert [i for i, _ in got[0]] == [3, 1, 2, 5, 4]
    assert dict(got[0])[1] == 256 * 512_000_000 and dict(got[0])[3] == (1 << 63) - 1


def test_phases_send_little(spark):
    rows, x = make(spark, 3000, 32, 8)
    sent = {}
    got = collected(topk.top_k(spark.createDataFrame(rows, SCHEMA), points_block=500, sent=sent))
    ints = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    assert got == ranked(ints @ ints.T, list(range(3000)), 5)
    assert sent["lists"] <= 60 * 2 * 32 and sent["entries"] < 0.1 * 60 * 3000 and sent["looked_up"] <= sent["entries"]


def test_shorter_vectors_count_as_if_zeros_followed(spark):
    rows = [(0, [1.0, 0.0, 1.0]), (1, [1.0]), (2, [0.0, 0.0, 2.0]), (3, []), (0, [3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    scores = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df).collect())
    x = 65536
    assert scores == [(0, 1, 0, 3 * x), (0, 1, 0, 3 * x), (0, 2, 1, 3 * x), (0, 2, 2, 2 * x), (0, 3, 1, x), (0, 3, 2, 0), (0, 4, 3, 0), (0, 4, 3, 0)]
    near = [(r.query_id, r.rank, r.vec_id) for r in ann.search(df).collect()]
    assert len(near) == 6 and not any(v == 3 for _, _, v in near)


def exact(x, n):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    return u @ u.T, ranked((u @ u.T).round(12), list(range(n)), 5)


def recall(got, want):
    return sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / sum(map(len, want.values()))


def test_nearest_finds_most_and_scores_exactly(spark):
    rows, x = make(spark, 2500, 24, 2, 40)
    df = spark.createDataFrame(rows + odd_rows(24) + [(60_000, [0.0] * 24, 1, "s", 2)] + rows[:3], SCHEMA)
    scores, want = exact(x, 2500)
    got = collected(ann.search(df, points_block=200, queries_block=9))
    assert got.keys() == want.keys()
    assert recall(got, want) >= 0.9
    assert [i for i, _ in got[0]] == [1, 2, 3, 4, 5]
    for q, found in got.items():
        assert len(found) == 5
        for i, s in found:
            assert s == pytest.approx(scores[q, i], abs=1e-12)


def test_recall_on_a_larger_clustered_table(spark):
    n, d = 6_000, 48
    rng = np.random.default_rng(4)
    x = (rng.standard_normal((40, d))[rng.integers(0, 40, n)] + 0.4 * rng.standard_normal((n, d))).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in row], 1, "s", 2) for i, row in enumerate(x)], SCHEMA)
    _, want = exact(x, n)
    got = collected(ann.search(df, points_block=500, sample_rows=1_000))
    assert recall(got, want) >= 0.9 and all(len(found) == 5 for found in got.values())


def test_queries_far_from_a_hot_direction_meet_all_rows(spark):
    n, d = 5_000, 8
    x = np.random.default_rng(9).standard_normal((n, d)) * 0.15
    x[:, 0] += 1
    outliers = {0: 1, 50: 2, 100: None}
    for q, axis in outliers.items():  # at 150 and 180 degrees from the others
        x[q] = 0
        x[q, 0] = -1
        if axis:
            x[q, [0, axis]] = -np.cos(np.pi / 6), np.sin(np.pi / 6)
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in row], 1, "s", 2) for i, row in enumerate(x)], SCHEMA)
    _, want = exact(x, n)
    got = collected(ann.search(df, points_block=400))
    assert got.keys() == want.keys() and all(len(found) == 5 for found in got.values())
    for q in outliers:
        assert {i for i, _ in got[q]} == {i for i, _ in want[q]}
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=1e-11)
    assert recall(got, want) >= 0.9


def test_few_and_no_vectors(spark):
    for search in (ann.search, topk.top_k):
        assert collected(search(spark.createDataFrame([], SCHEMA))) == {}
        one = spark.createDataFrame([(0, [1.0, 0.0], 1, "", 1)], SCHEMA)
        assert collected(search(one)) == {}
        three = spark.createDataFrame([(0, [1.0, 0.0], 1, "", 1), (7, [1.0, 0.0], 1, "", 1), (8, [0.0, 1.0], 1, "", 1)], SCHEMA)
        assert [i for i, _ in collected(search(three))[0]] == [7, 8]


def test_strings_group_what_is_near():
    rng = np.random.default_rng(3)
    a = rng.standard_normal((200, 16))
    near, far = a + 0.05 * rng.standard_normal(a.shape), rng.standard_normal(a.shape)
    forest = ann.Forest(16, 4, 11)
    s, t, u = (forest.strings(x, forest.rotations()) for x in (a, near, far))
    shared = lambda p, q: np.mean(forest.bits - np.floor(np.log2((p ^ q) + 1)))
    assert shared(s, t) > 2 * shared(s, u)


@pytest.mark.parametrize("noise", [0.02, 0.005])
def test_near_copies_are_found(spark, noise):
    rng = np.random.default_rng(8)
    x = (rng.standard_normal((15, 64))[rng.integers(0, 15, 4500)] + noise * rng.standard_normal((4500, 64))).astype(np.float32)
    got = collected(ann.search(spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")))
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = ranked(unit @ unit.T, list(range(len(x))), 5)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 5 for q in want]) >= 0.9


def test_scores_within_rounding_all_go_on():
    s = np.array([[0.9, 0.5, 0.9 - 1e-7, 0.9 - 1e-3], [0.1, 0.2, 0.3, 0.4]], np.float32)
    rows, columns = ann.within(s, 1, 1e-6)
    assert list(zip(rows.tolist(), columns.tolist())) == [(0, 0), (0, 2), (1, 3)]
    assert len(ann.within(s, 4, 1e-6)[0]) == 8
