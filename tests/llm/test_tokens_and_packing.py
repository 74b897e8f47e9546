import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import packing, token_counts, token_output
from tidemark.llm.tokens import Encoder, le32

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "  ", "a", " a", "a ", "a  ", "a\n", "a \n", "a\n b", "a\n \nb", "a \n \n b", "\n\n\na", "a\tb  c", "don't stop's it'll", "x y", "x  y", "  z", "a\x1cb", "a\x85b",
    "ΑΣ ΑΣ, ΟΔΟΣ.", "İstanbul, İ.", "éa ́b", "1234 56,7 8.", "100%, $$$ ###.", "日本語 です。", "a,b. c,,. d..", "Straße. ẞ, ŸŸ,", "ﬁ ﬂ. Ǆ, ŉn.", "x" * 5000, "word " * 3000,
]


def random_texts(n, seed=1):
    rng, letters = random.Random(seed), "aB cD\n\t  .,é'Σ1 ́"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 40))) for _ in range(n)]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_chunks_give_the_tokenizer_s_own_ids_and_offsets(path):
    plain, encoder = Tokenizer.from_file(path), Encoder(path)
    texts = ODD + random_texts(1500)
    assert encoder.encode(texts) == [le32(plain.encode(x, add_special_tokens=False).ids) for x in texts]
    assert encoder.encode(texts[::-1])[::-1] == encoder.encode(texts)
    assert [x.tolist() for x in encoder.offsets(texts)] == [[list(o) for o in plain.encode(x, add_special_tokens=False).offsets] for x in texts]


def test_old_chunks_come_back(monkeypatch):
    monkeypatch.setattr("tidemark.llm.tokens.CACHE_CHUNKS", 20)
    encoder, plain = Encoder(BYTES), Tokenizer.from_file(BYTES)
    for i in range(8):
        texts = [f"common words {i * j} here." for j in range(10)]
        assert encoder.encode(texts) == [le32(plain.encode(x, add_special_tokens=False).ids) for x in texts]


def docs(spark, texts, extra=False):
    df = spark.createDataFrame([(None if i == 3 else i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return df.withColumns({"start": F.lit("x"), "ids": F.lit(1), "n": F.lit(2)}) if extra else df


def test_pieces_tile_documents_and_sequences(spark):
    texts = ODD + [None, "long text " * 4000] + random_texts(300, 2)
    rows = packing.pack(docs(spark, texts, True).repartition(3), vocabulary=BYTES).collect()
    plain = Tokenizer.from_file(BYTES)
    per_doc, per_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        per_doc[r.doc_id].append(r)
        per_sequence[r.sequence_id].append(r)
    assert len(per_doc) == len(texts)
    for i, text in enumerate(texts):
        ids, at = plain.encode(text or "", add_special_tokens=False).ids + [1], 0
        for r in sorted(per_doc[None if i == 3 else i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            at += r.length
            assert zlib.crc32(le32(ids[r.start : at])) == r.ids_crc32
        assert at == len(ids)
    padding = total = 0
    for pieces in per_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        padding, total = padding + (0 if at & (at - 1) == 0 else 2048 - at), total + at
    assert padding < 0.02 * total


@pytest.mark.parametrize(("capacity", "classes"), [(2048, 256), (100, 7), (64, 64), (5, 1)])
def test_cut_lengths_fill_their_class(capacity, classes):
    for length in range(1, 3 * capacity):
        pieces = packing.cut_length(length, capacity, classes, 1 / 32)
        assert sum(p for p, _ in pieces) == length
        for piece, k in pieces:
            assert 1 <= k <= classes and k * piece <= capacity
            assert k == classes or piece >= (capacity // k) * (1 - 1 / 32) - 1e-9


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(none, vocabulary=BYTES).count() == 0
    assert token_counts.attribute(none, vocabulary=BYTES).count() == 0
    assert token_output.round_trip(none, vocabulary=WORDS).count() == 0


def test_files_hold_all_ids_in_order(spark):
    texts = ODD + [None] + random_texts(200, 3)
    df = docs(spark, texts, True)
    df = df.union(df.filter("doc_id < 6"))
    rows = token_output.round_trip(df.repartition(5), vocabulary=WORDS, frame_ids=50).orderBy("start").collect()
    plain, at, seen = Tokenizer.from_file(WORDS), 0, []
    ids = {i: plain.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        mine = ids[3 if r.doc_id is None else r.doc_id]
        assert bytes(r.ids) == le32(mine) and r.ids_crc32 == zlib.crc32(le32(mine))
        at += r.n_tokens
        seen.append(-1 if r.doc_id is None else r.doc_id)
    assert seen == sorted(seen) and len(seen) == df.count()


def test_frames_are_read_alone_and_checked(tmp_path):
    path = tmp_path / "x.tok.zst"
    ids = {i: le32(list(range(i, i + 10 + 7 * i))) for i in range(40)}
    with path.open("wb") as out:
        writer = token_output.FrameWriter(out, 100, 3)
        for i, x in ids.items():
            writer.add(i, x)
        writer.finish()
    import zstandard

    with path.open("rb") as source:
        whole = zstandard.ZstdDecompressor().stream_reader(source, read_across_frames=True).read()
    assert whole == b"".join(ids.values())
    with path.open("rb") as source:
        reader = token_output.FrameReader(source)
        read, reader.read_frame = [], lambda k, f=reader.read_frame: read.append(k) or f(k)
        assert dict(reader.documents([5, 39])) == {5: ids[5], 39: ids[39]}
        assert len(read) == 2 < len(reader.table)
    data = bytearray(path.read_bytes())
    data[reader.starts[3] + 12] ^= 1
    path.write_bytes(data)
    with path.open("rb") as source:
        reader = token_output.FrameReader(source)
        with pytest.raises(Exception):  # noqa: B017, PT011
            list(reader.documents([i for i, f in zip(reader.doc_id, reader.frame) if f == 3]))
        assert list(reader.documents([39]))[0][1] == ids[39]


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_attribution_against_plain_loops(rule):
    rng = random.Random(5)
    for _ in range(150):
        cuts = sorted(rng.sample(range(60), rng.randrange(2, 9)))
        spans = np.array([(a, b) for a, b in zip(cuts, cuts[1:]) if rng.random() < 0.8], np.int64).reshape(-1, 2)
        marks = sorted(rng.sample(range(61), rng.randrange(2, 20)))
        tokens = np.array(list(zip(marks, marks[1:])), np.int64).reshape(-1, 2)
        want, outside = [0.0] * len(spans), 0.0
        for a, b in tokens.tolist():
            held = [max(0, min(b, e) - max(a, s)) for s, e in spans.tolist()]
            if rule == "start":
                owner = [i for i, (s, e) in enumerate(spans.tolist()) if s <= a < e]
                for i in owner:
                    want[i] += 1
                outside += not owner
            elif rule == "overlap":
                best = max(range(len(held)), key=lambda i: (held[i], -i), default=None)
                if best is None or not held[best]:
                    outside += 1
                else:
                    want[best] += 1
            else:
                for i, h in enumerate(held):
                    want[i] += h / (b - a)
                outside += 1 - sum(held) / (b - a)
        got, left = token_counts.allocate(tokens, spans, rule)
        assert got == pytest.approx(want) and left == pytest.approx(outside)


def test_sections_of_lines_and_of_a_column(spark):
    texts = ["one two\nthree\n\nfour", "", None, "x\n"]
    rows = token_counts.attribute(docs(spark, texts, True), vocabulary=BYTES).collect()
    plain = Tokenizer.from_file(BYTES)
    for i, text in enumerate(texts):
        mine = sorted((r for r in rows if r.doc_id == (None if i == 3 else i)), key=lambda r: r.section)
        lines, offsets, at = (text or "").split("\n"), plain.encode(text or "", add_special_tokens=False).offsets, 0
        assert len(mine) == len(lines)
        for r, line in zip(mine, lines):
            end = min(len(text or ""), at + len(line) + 1)
            assert (r.start, r.end, r.doc_tokens) == (at, end, len(offsets))
            assert r.n_tokens == sum(at <= a < end for a, _ in offsets)
            at = end
    df = spark.createDataFrame([(1, "one two three", [(0, 3), (8, 13)]), (2, "one", None), (3, "one", [])], "doc_id long, text string, parts array<struct<start:long,end:long>>")
    got = {(r.doc_id, r.section): r.n_tokens for r in token_counts.attribute(df, vocabulary=BYTES, sections="parts").collect()}
    assert got == {(1, 0): 1, (1, 1): 0, (1, -1): 2, (2, -1): 1, (3, -1): 1}
