"""Packing, BPE and language ID against brute force, the library and held-out labels."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cutloom.llm import bpe, langid, packing, queries

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "a", "\n\n  b \t c", "<|endoftext|> x<|endoftext|>", "x" * 3000, "Ærøskøbing 中文 😀‍ é\x1c\x85", "it's  THE\r\nend "]


def docs(spark, texts, **more):
    rows = [(i, t, "extra", "own") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, _text string")


def test_automaton_equals_library():
    c, lib = bpe.codec(BYTE), Tokenizer.from_file(BYTE)
    random.seed(3)
    letters = ["a", "b", "th", "e", " ", " ", "\n", ".", "'s", "0", "12", "é", "中", "😀", "<|endoftext|>", "\t", "\x1c", "ing", "-" * 9]
    for text in ["".join(random.choices(letters, k=random.randint(0, 40))) for _ in range(1500)] + ["a" * 700, "ab" * 90, " " * 99]:
        ids = c.encode_all([text])[0][0].tolist()
        assert ids == lib.encode(text, add_special_tokens=False).ids
        assert c.decode(np.array(ids)) == lib.decode(ids, skip_special_tokens=False)


def test_automaton_accepts_only_what_bpe_makes():
    a = bpe.codec(BYTE).automaton
    for word in [b"hello", b" the", b"aaaaaaa", b"internationalisation", "naïveté".encode()]:
        ids = a.encode_word(word)
        assert a.decode(ids) == word
        assert all(a._arc(a.target[x], y) for x, y in zip(ids, ids[1:], strict=False))
        other = [a.of[bytes([b])] for b in word]
        if other != ids:
            assert not all(a._arc(a.target[x], y) for x, y in zip(other, other[1:], strict=False))


def test_encode_odd_rows(spark):
    lib = Tokenizer.from_file(BYTE)
    got = bpe.encode(docs(spark, ODD), BYTE, decoded=True).collect()
    assert [r.doc_id for r in got] == list(range(len(ODD)))
    for r, t in zip(got, ODD, strict=True):
        assert r.ids == lib.encode(t or "", add_special_tokens=False).ids
        assert r.decoded == (t or "")
    assert bpe.encode(docs(spark, []), BYTE).count() == 0
    back = bpe.decode(bpe.encode(docs(spark, ODD), BYTE), BYTE).collect()
    assert [r.decoded for r in back] == [t or "" for t in ODD]


def test_op5(spark, sf_dir):
    lib = Tokenizer.from_file(BYTE)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op5_bpe(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def packed_right(rows, texts, length=4096):
    lib = Tokenizer.from_file(WORD)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for d, t in texts.items():
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = total = 0
    for s in by_sequence.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
        total += at
        padding += 0 if at & (at - 1) == 0 else length - at
    return padding / max(1, total)


def test_op3(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert packed_right(queries.op3_packing(spark, sf_dir).collect(), texts) == 0


@pytest.mark.parametrize("parts", [1, 40])
def test_pack_odd_rows(spark, parts):
    texts = ODD + ["word " * 9000, "a b c " * 50] * 4
    df = packing.pack(docs(spark, texts).repartition(parts), WORD, open_windows=3)
    rows = df.withColumn("ids_crc32", F.crc32("ids")).collect()
    assert packed_right(rows, dict(enumerate(texts))) == 0
    assert packing.pack(docs(spark, []), WORD).count() == 0


def test_pack_null_ids_and_repeated_rows(spark):
    rows = [(None, "a b"), (None, "a b"), (3, "some words " * 3000), (3, "some words " * 3000), (4, None), (4, None)]
    df = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), WORD)
    got = df.collect()
    assert sum(r.start == 0 for r in got if r.doc_id is None) == 2 and sum(r.start == 0 for r in got if r.doc_id == 4) == 2
    assert sum(r.length for r in got if r.doc_id == 3) == 2 * next(r.doc_tokens for r in got if r.doc_id == 3)


def test_names_with_dots_and_repeated_rows(spark):
    rows = [(1, "the cat", "x"), (1, "the cat", "x"), (None, "the dog", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string")
    got = bpe.encode(df, BYTE, decoded=True).collect()
    assert [(r.doc_id, r.decoded, r["a.b"]) for r in got] == rows
    assert [r.decoded for r in bpe.decode(bpe.encode(df, BYTE), BYTE).collect()] == [r[1] for r in rows]
    profiles = langid.fit(df.withColumn("lang", F.lit("en")))
    assert [(r.doc_id, r.lang_pred, r["a.b"]) for r in langid.predict(df, profiles).collect()] == [(i, "en", x) for i, _, x in rows]


def test_langid_ties_go_to_the_first_name(spark):
    rows = [(i, "same words", k) for i in range(4) for k in ("b", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.predict(df, langid.fit(df)).collect()} == {"a"}


def test_letters_met_in_any_order_give_the_same_vectors():
    one, two = langid.Space(256, 3, 1), langid.Space(256, 3, 1)
    for p in range(0x4E00, 0x4E00 + 700):
        two.text(chr(p) * 3)
    assert np.array_equal(one.text("the cat"), two.text("the cat")) and two.text("中") is not None


def test_pack_cuts_few_documents(spark, sf_dir):
    rows = queries.op3_packing(spark, sf_dir).collect()
    assert len(rows) < 2 * len({r.doc_id for r in rows})


def test_op4_held_out_accuracy(spark, sf_dir):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op4_langid(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(lang)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
    held = [r for r in rows if r.held_out and r.lang_pred != "und"]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.95


def test_langid_odd_rows(spark):
    rows = [(i, f"der hund und die katze {i}", "de") for i in range(20)] + [(i + 50, f"the dog and the cat {i}", "en") for i in range(20)]
    train = spark.createDataFrame([*rows, (99, None, "en"), (100, "x", None)], "doc_id long, text string, lang string")
    p = langid.fit(train)
    assert p.languages == ("de", "en")
    texts = [None, "", "123 !?", "die katze", "the cat " * 50000]
    got = langid.predict(docs(spark, texts), p).collect()
    assert [r.lang_pred for r in got] == ["und", "und", "und", "de", "en"]
    assert [r.score > 0 for r in got] == [False, False, False, True, True]
    assert got[0].ids == "extra" and got[0]["_text"] == "own"
    nothing = langid.fit(train.limit(0))
    assert {r.lang_pred for r in langid.predict(docs(spark, texts), nothing).collect()} == {"und"}
    with pytest.raises(ValueError):
        langid.fit(train, most_languages=1)


def test_ngram_binding_is_positional():
    s = langid.Space(512, 3, 1)
    a, b = s.text("abc"), s.text("cba")
    assert abs(float(a @ a) - 1) < 1e-5 and float(a @ b) < 0.7
