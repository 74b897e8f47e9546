import random

import pytest

import corpus_pipeline
from tidemark.llm import jaccard

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(2)
    sounds = {"aa": ["ka", "lo", "mi", "ru"], "bb": ["sch", "ein", "gel", "ung"]}
    word = lambda lang: "".join(rng.choice(sounds[lang]) for _ in range(rng.randrange(2, 6)))
    rows, labels = [], []
    for i in range(240):
        lang = rng.choice(["aa", "bb"])
        words = [word(lang) for _ in range(rng.randrange(8, 60))]
        toxic = i % 6 == 0
        if toxic:
            words[3:3] = ["zwick", "quork"]
        labels.append((i, int(toxic)))
        rows.append([i, " ".join(words), lang, f"s{i % 3}"])
    rows += [[500 + k, rows[1][1], rows[1][2], "s0"] for k in range(5)] + [[600, "12 34 !", "aa", "s1"], [601, None, None, None], [602, "", "aa", None], [1, rows[1][1], rows[1][2], "s1"], [700, "schgel einung " * 30, "aa", "s1"]]
    at = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], COLUMNS)
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at), {r[0]: r for r in rows}


def test_stages_keep_what_they_should(spark, corpus):
    at, rows = corpus
    docs, kept = spark.read.parquet(f"{at}/documents.parquet"), {}
    docs_in = docs.count()
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, at)
        assert out.columns == docs.columns
        kept[name] = docs = spark.createDataFrame(out.collect(), out.schema)
    ids = {n: sorted(r.doc_id for r in df.collect()) for n, df in kept.items()}
    toxic = {i for i in range(240) if i % 6 == 0}
    assert not toxic & set(ids["toxicity"]) and len(ids["toxicity"]) == docs_in - len(toxic)
    gone = set(ids["toxicity"]) - set(ids["language"])
    assert {600, 601, 602} <= gone <= {600, 601, 602, 700}
    assert ids["near_duplicates"].count(1) == 1 and not {500, 501, 502, 503, 504} & set(ids["near_duplicates"])
    assert set(ids["language"]) - set(ids["near_duplicates"]) == {500, 501, 502, 503, 504}
    words = sum(len(r.text.split()) for r in kept["mixing"].collect())
    have = sum(len(rows[i][1].split()) for i in ids["near_duplicates"])
    assert abs(words - 1.5 * have) <= 3


def test_language_stage_drops_wrongly_labelled_and_keeps_mixed(spark, corpus):
    at, rows = corpus
    rng = random.Random(7)
    # 'bc' is a relative of 'bb': three of four sounds are common.
    sounds = {"aa": ["ka", "lo", "mi", "ru"], "bb": ["sch", "ein", "gel", "ung"], "bc": ["sch", "ein", "gel", "øj"], "zz": ["ño", "xy", "çà", "quw"]}
    text = lambda lang, n: " ".join("".join(rng.choice(sounds[lang]) for _ in range(rng.randrange(2, 6))) for _ in range(n))
    more = [(800 + i, text("bc", 30), "bc") for i in range(60)]
    wrong = [(900 + i, text("bb", 25), "aa") for i in range(4)] + [(910, text("bc", 25), "aa"), (911, text("aa", 25), "bc")]
    mixed = [(920 + i, text("bb", 30) + " " + text("aa", 10), "aa") for i in range(4)] + [(930, text("bb", 10), None), (931, text("zz", 25), "zz")]
    docs = spark.read.parquet(f"{at}/documents.parquet")
    added = spark.createDataFrame([(i, t, lang, "s0", len(t)) for i, t, lang in more + wrong + mixed], COLUMNS)
    for df, gone in ((docs, {700}), (docs.unionByName(added), {700} | {r[0] for r in wrong})):
        kept = [r.doc_id for r in corpus_pipeline.keep_languages(spark, df, at).collect()]
        have = [r.doc_id for r in df.collect()]
        assert sorted(kept) == sorted(i for i in have if i not in gone | {600, 601, 602})


def test_run_packs_everything(spark, corpus):
    at, _ = corpus
    rows = corpus_pipeline.run(spark, at).collect()
    assert rows and all(r.length > 0 and r.offset + r.length <= 2048 for r in rows)


def test_deduplicate_keeps_one_row_of_each_component(spark):
    text = "one two three four five six seven eight"
    rows = [(3, text, "b"), (3, text, "a"), (2, text + " nine", "c"), (9, "", "d"), (9, "", "e"), (None, None, "f"), (None, "only here by itself today", "g"), (None, "only here by itself today", "h"), (4, "quite another text of some words", "i")]
    df = spark.createDataFrame(rows, "doc_id long, text string, extra string")
    got = sorted((str(r.doc_id), r.extra) for r in jaccard.deduplicate(df).collect())
    assert got == [("2", "c"), ("4", "i"), ("9", "d"), ("9", "e"), ("None", "f"), ("None", "g")]


def test_deduplicate_moves_no_text_beyond_a_broadcast(spark, monkeypatch):
    rows = [(i, " ".join(f"w{i // 3}_{k}" for k in range(12)), "x") for i in range(60)] + [(0, " ".join(f"w0_{k}" for k in range(12)), "a"), (57, " ".join(f"w19_{k}" for k in range(12)), "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, extra string")
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 25, raising=False)
    monkeypatch.setattr("tidemark.llm.shared.BROADCAST_ROWS", 25)
    out = jaccard.deduplicate(df)
    assert sorted((r.doc_id, r.extra) for r in out.collect()) == [(i, "a" if i in (0, 57) else "x") for i in range(0, 60, 3)]
    assert "SortMergeJoin" not in out._jdf.queryExecution().optimizedPlan().toString() + out._jdf.queryExecution().sparkPlan().toString()
