import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language, licenses, toxicity
from tidemark.llm.shared import crc_mod

RNG = random.Random(8)
CLEAN = ["".join(RNG.choice("abdegilmnorstu") for _ in range(RNG.randrange(3, 9))) for _ in range(900)]
BAD = ["zwick", "zwickel", "zwickern", "quork", "quorkish", "frumpf"]


def toxic_rows(n, seed):
    rng, rows = random.Random(seed), []
    for i in range(n):
        words = [rng.choice(CLEAN) for _ in range(rng.randrange(5, 80))]
        bad = i % 4 == 0
        for _ in range(rng.randrange(1, 4) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_rows(1200, 1)
    docs = spark.createDataFrame([(i, t, 5.0, "x") for i, t, _ in rows] + [(None, None, 1.0, "y"), (9001, "", 1.0, "y"), (9002, "zwick " * 20000, 1.0, "y"), (0, rows[0][1], 1.0, "y")], "doc_id long, text string, score double, label string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None), (77777, 1)], "doc_id long, toxic int")
    index = toxicity.fit(docs, labels.filter(crc_mod("doc_id", 3) != 1), max_examples=300)
    assert len(index.ids) <= 600
    got = toxicity.score(docs, index, with_row=True).withColumn("held_out", crc_mod("doc_id", 3) == 1).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    y = {i: v for i, _, v in rows}
    held = [r for r in got if r.held_out and r.doc_id in y]
    assert sum(r.predicted == y[r.doc_id] for r in held) > 0.97 * len(held)
    assert all(r.row.label == "x" or r.doc_id in (None, 0, 9001, 9002) for r in got)
    by = {r.doc_id: r for r in got}
    assert by[None].predicted == by[9001].predicted == 0 and by[9002].predicted == 1 and by[9002].neighbours


def dense_index(index):
    """The examples' vectors as rows, from the postings."""
    dense = np.zeros((len(index.ids), len(index.names)))
    for t in range(len(index.names)):
        a, b = index.run_start[index.term_run[t]], index.run_start[index.term_run[t + 1]]
        dense[index.doc[a:b], t] = index.value[a:b]
    return dense


def test_nearest_examples_are_the_exact_ones():
    rng = random.Random(4)
    counts = [{rng.randrange(60): rng.randrange(1, 4) for _ in range(rng.randrange(1, 9))} for _ in range(700)]
    entries = np.array([(i, t, n) for i, c in enumerate(counts) for t, n in c.items()])
    weights = np.array([1 + rng.random() for _ in range(60)])
    index = toxicity.Index([f"t{i}" for i in range(60)], weights, np.arange(700), np.array([rng.randrange(2) for _ in counts]), *entries.T, (1.0, 1.0), 10)
    plain = np.zeros((700, 60))
    for i, t, n in entries:
        plain[i, t] = weights[t] * (1 + np.log(n))
    plain /= np.linalg.norm(plain, axis=1, keepdims=True)
    assert dense_index(index) == pytest.approx(plain)
    blocks = 0
    for _ in range(100):
        t, w = index.vector({rng.randrange(60): 1 for _ in range(3)})
        q = np.zeros(60)
        q[t] = w
        cosines = (plain @ q).round(12)
        want = [i for i in sorted(range(700), key=lambda i: (-cosines[i], i)) if cosines[i] > 0][:10]
        ids, near, scored = index.nearest(t, w)
        assert ids.tolist() == want and near == pytest.approx(cosines[want])
        blocks += scored
    assert blocks < 100 * index.blocks


def test_scores_and_evidence_are_those_of_all_cosines(spark):
    rows = toxic_rows(400, 5)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 2], "doc_id long, toxic int")
    index = toxicity.fit(docs, labels)
    dense, number = dense_index(index), {x: i for i, x in enumerate(index.names)}
    stands = {y: sum(1 for i, _, v in rows if i % 2 and v == y) / max(1, int((index.labels == y).sum())) for y in (0, 1)}
    for r in toxicity.score(docs, index).collect():
        q, words = np.zeros(len(number)), rows[r.doc_id][1].split()
        for w in [*words, *(w[:5] + "*" for w in words if len(w) > 5)]:
            if w in number:
                q[number[w]] += 1
        q = np.where(q > 0, index.weights * (1 + np.log(np.maximum(q, 1))), 0)
        cosines = (dense @ q / (np.linalg.norm(q) or 1)).round(12)
        best = [i for i in sorted(range(len(cosines)), key=lambda i: (-cosines[i], i)) if cosines[i] > 0][:10]
        assert r.neighbours == index.ids[best].tolist() and r.cosines == pytest.approx(cosines[best])
        votes = [cosines[i] * stands[int(index.labels[i])] for i in best]
        vote = sum(v for v, i in zip(votes, best) if index.labels[i] == 1) / sum(votes) if votes else -1
        assert r.score == pytest.approx(np.interp(vote, *index.steps)) and r.predicted == int(r.score >= 0.7)


def test_copies_and_long_clean_texts(spark):
    rng, rows = random.Random(12), toxic_rows(800, 7)
    family = [rng.choice(CLEAN) + "ora" for _ in range(120)]
    copies = [(2000 + i, " ".join([*family[:i % 100], "other", *family[i % 100 + 1 :], "quork"]), 1) for i in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows + copies], "doc_id long, text string")
    index = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows + copies], "doc_id long, toxic int"))
    # A family's chance words say little, a long clean text with neighbours stays clean, and a copy of an example finds it.
    weight = dict(zip(index.names, index.weights))
    assert max(weight.get(w, 0) for w in family) < 0.2 * weight["quork"]
    probe = [(1, " ".join(rng.choice(CLEAN) for _ in range(20_000))), (2, copies[3][1]), (3, " ".join([*family[:100], *[rng.choice(CLEAN) for _ in range(300)]])), (3, rows[0][1]), (3, rows[0][1])]
    got = toxicity.score(spark.createDataFrame(probe, "doc_id long, text string"), index).collect()
    assert [r.predicted for r in got] == [0, 1, 0, 1, 1] and all(r.neighbours for r in got) and got[3].score == got[4].score
    assert 2003 in got[1].neighbours or got[1].cosines[0] == pytest.approx(1)


def test_isotonic_is_the_least_squares_fit():
    x, y = toxicity.isotonic(np.array([0.1, 0.2, 0.3, 0.4, 0.5]), np.array([0.0, 1.0, 0.0, 1.0, 1.0]), np.full(5, 1e9))
    assert np.interp([0.1, 0.2, 0.3, 0.45], x, y) == pytest.approx([0.001, 0.497, 0.498, 0.9945], abs=2e-3)


def test_no_labels_and_no_rows(spark):
    none, labels = spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0
    one = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert toxicity.score(one, toxicity.fit(one, labels)).first().predicted == 0
    assert language.identify(none, language.fit(none)).count() == 0
    assert language.identify(one, language.fit(one)).first().lang_pred == "und"
    assert licenses.scan(none).count() == 0


def test_language_on_held_out_rows(spark):
    sounds = {"aa": ["ka", "lo", "mi", "ru"], "bb": ["sch", "ein", "gel", "ung"], "cc": ["ña", "ción", "llo", "rre"]}
    rng, rows = random.Random(3), []
    for i in range(600):
        lang = rng.choice(list(sounds))
        rows.append((i, " ".join("".join(rng.choice(sounds[lang]) for _ in range(rng.randrange(2, 6))) for _ in range(rng.randrange(3, 40))), lang, "x"))
    odd = [(None, None, None, "x"), (7001, "", "aa", "x"), (7002, "123 !!", "aa", "x"), (7003, "ЖЖЖ", None, "x"), (7004, "kalo " * 30000, None, "x"), (7005, "one language only", "zz", "x"), (7006, "½ ² Ⅷ", "aa", "x"), (0, rows[0][1], "aa", "x")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score string")
    model = language.fit(docs.filter(crc_mod("doc_id", 4) != 2), docs_per_language=100)
    got = {r.doc_id: r for r in language.identify(docs, model, with_row=True).collect()}
    assert len(got) == len(rows) + len(odd) - 1 and all(0 <= r.score <= 1 for r in got.values())
    held = [r[0] for r in spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").filter(crc_mod("doc_id", 4) == 2).select("doc_id").collect()]
    assert sum(got[i].lang_pred == rows[i][2] for i in held) > 0.99 * len(held)
    assert {got[i].lang_pred for i in (None, 7001, 7002, 7006)} == {"und"} and got[7003].lang_pred != "und" and got[7004].lang_pred == "aa"
    assert got[0].row.score == "x"


def counts(*rows):
    return pa.table({"language": pa.array([r[0] for r in rows], pa.int32()), "key": [r[1] for r in rows], "n": pa.array([r[2] for r in rows], pa.int64())})


def test_unknown_words_back_off_to_shorter_n_grams():
    model = language.Model(["a", "b"], counts((0, "kalo", 5)), counts((0, "kal", 4), (1, "kal", 1), (1, "x", 3)))
    assert np.array_equal(model.word("kalo"), model.words.row("kalo"))
    assert np.array_equal(model.word("kale"), model.grams.row("kal")) and np.array_equal(model.word("xyz"), model.grams.row("x"))
    assert not model.word("qq").any()
    # Add-half frequencies of the language's words, and of its n-grams of that length.
    assert model.word("kalo") == pytest.approx(np.log([5.5 / 6.5, 0.5 / 1.5])) and model.word("kale") == pytest.approx(np.log([4.5 / 5.5, 1.5 / 2.5]))


def test_languages_of_a_small_table_by_plain_counting(spark):
    rng, rows = random.Random(9), []
    for i in range(120):
        lang = rng.choice(["aa", "bb"])
        rows.append((i, " ".join("".join(rng.choice({"aa": "kalo", "bb": "kagu"}[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 6))), lang))
    model_rows, words, grams = rows[:80], {}, {}
    for _, text, lang in {(0, t, x) for _, t, x in model_rows}:
        for w in text.split():
            words[w, lang] = words.get((w, lang), 0) + 1
            for n in language.ORDERS:
                for g in language.n_grams(w, n):
                    grams[g, lang] = grams.get((g, lang), 0) + 1
    words, grams = ({k: v for k, v in c.items() if v > 1} for c in (words, grams))

    def frequency(c, key, lang, same):
        keys = {k for k, _ in c if same(k)}
        return np.log((c.get((key, lang), 0) + 0.5) / (sum(v for (k, x), v in c.items() if x == lang and same(k)) + 0.5 * len(keys) + 1))

    def of_word(w, lang):
        if any((w, x) in words for x in ("aa", "bb")):
            return frequency(words, w, lang, lambda k: True)
        for n in language.ORDERS:
            known = [g for g in language.n_grams(w, n) if any((g, x) in grams for x in ("aa", "bb"))]
            if known:
                return np.mean([frequency(grams, g, lang, lambda k: len(k) == n) for g in known])
        return 0.0

    schema = "doc_id long, text string, lang string"
    got = language.identify(spark.createDataFrame(rows, schema), language.fit(spark.createDataFrame(model_rows, schema))).collect()
    for r in got:
        text = rows[r.doc_id][1].split()
        mean = {x: np.mean([of_word(w, x) for w in text]) for x in ("aa", "bb")}
        best = max(sorted(mean), key=mean.get)
        assert r.score == pytest.approx(1 / (1 + np.exp((min(mean.values()) - max(mean.values())) * min(len(text), 40))), abs=1e-5)
        assert r.lang_pred == best or abs(mean["aa"] - mean["bb"]) < 1e-5


def test_many_languages_are_all_learned(spark):
    rows = [(i, f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} same words here here", f"l{i % 300:03d}") for i in range(900)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_docs=600, max_keys=3000)
    assert len(model.languages) == 300 and len(model.words.more) <= 3000


def plain_matches(text):
    """Templates of which the text's shingles hold the needed part within some run as long as a window."""
    got, found = [bytes(w) for w in licenses.words(text)], set()
    runs = [tuple(got[i : i + 5]) for i in range(len(got) - 4)] or ([tuple(got)] if got else [])
    for t, (_, notice) in enumerate(licenses.TEMPLATES):
        w = licenses.words(notice)
        want = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        for i in range(len(runs)):
            if len(want & set(runs[i : i + (1 << (len(want) - 1).bit_length())])) >= 0.8 * len(want):
                found.add(t)
    return found


def test_licenses_against_plain_comparison(spark):
    rng, texts = random.Random(6), []
    for i in range(250):
        words = [rng.choice(CLEAN) for _ in range(rng.randrange(0, 200))]
        for _ in range(rng.randrange(0, 3)):
            notice = rng.choice(licenses.TEMPLATES)[1].split()
            if rng.random() < 0.3 and len(notice) > 24:
                notice[rng.randrange(len(notice))] = "changed"
            at = rng.randrange(len(words) + 1)
            words[at:at] = notice
        texts.append(" ".join(words))
    texts += [None, "", "MIT", "license " * 50000 + licenses.TEMPLATES[0][1]]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, license string, template int")
    rows = licenses.scan(df.repartition(3)).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, set()).add(r.template)
        words = licenses.words(texts[r.doc_id])[r.start_word : r.end_word]
        assert r.containment >= 0.8 and r.license == licenses.TEMPLATES[r.template][0] and len(words) == r.end_word - r.start_word
    for i, t in enumerate(texts[:-1]):
        assert got.get(i, set()) == plain_matches(t), t
    assert got[len(texts) - 1] == {0}
