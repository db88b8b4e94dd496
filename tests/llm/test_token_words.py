"""Token ids of odd texts against an untouched tokenizer, and with vocabularies of another kind."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from tessera.llm import queries, token_store

ODD = [
    "", " ", "plain words here", "a<|endoftext|>b", "<|startoftext|> x <|endoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "\x01", "a\x01b \x01 c", "x́ é ́lone", "日本 語。テスト", "it's I'LL don't 'tis",
    "tab\tnew\nline\x0bv\x0cf\r\n", "non\xa0breaking em\x85nel\x1cfs", "ÀÉß Straße ÿ ×÷", "123 4.5e-6 #tag @me", "﻿bom ퟿  \U0001f600", "İstanbul ǅ ﬁ", "￿ \x00nul",
]


def expected(lib, text):
    return lib.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("chunk", [token_store.CHUNK, 16, 1])
def test_odd_texts_equal_the_library(monkeypatch, chunk):
    monkeypatch.setattr(token_store, "CHUNK", chunk)
    lib, enc = Tokenizer.from_file(queries.WORD_VOCAB), token_store.WordEncoder(queries.WORD_VOCAB)
    assert enc.by_word
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choices("".join(ODD), k=rng.randrange(60))) for _ in range(300)] + [" ".join(ODD)]
    for some in (texts, texts[::-1], *([t] for t in ODD)):
        got = enc.encode([t.encode() for t in some])
        assert [np.frombuffer(x, enc.kind).tolist() for x in got] == [expected(lib, t) for t in some]
    bad = [b"a \xff b\xe2\x82 c", b"\xff", b"fine"]
    assert [np.frombuffer(x, enc.kind).tolist() for x in enc.encode(bad)] == [expected(lib, t.decode("utf-8", "replace")) for t in bad]


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_store, "CACHE_PIECES", 3)
    monkeypatch.setattr(token_store, "CHUNK", 64)
    lib, enc = Tokenizer.from_file(queries.WORD_VOCAB), token_store.WordEncoder(queries.WORD_VOCAB)
    for t, x in zip(ODD * 3, enc.encode([t.encode() for t in ODD * 3]), strict=True):
        assert np.frombuffer(x, enc.kind).tolist() == expected(lib, t)


def test_other_vocabularies_go_to_the_library(spark, tmp_path):
    letters = "abcdefghijklmnopqrstuvwxyz "
    lib = Tokenizer(models.BPE({c: i for i, c in enumerate(letters)} | {"ab": 70_000, "a b": 1000}, [("a", "b")]))
    lib.pre_tokenizer = pre_tokenizers.Punctuation()
    lib.save(str(tmp_path / "other.json"))
    enc = token_store.WordEncoder(str(tmp_path / "other.json"))
    assert not enc.by_word and enc.kind == np.dtype("<u4")
    texts = ["ab a b cab", "", " b  a", "ab"]
    assert [np.frombuffer(x, enc.kind).tolist() for x in enc.encode([t.encode() for t in texts])] == [expected(lib, t) for t in texts]
    # the width of an id is read from the file
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    blobs, d = token_store.write_tokens(df, str(tmp_path / "other.json"), 2)
    reader = token_store.BlobReader(bytes(blobs.orderBy("part").first().blob), d)
    assert np.frombuffer(reader.ids(0), reader.kind).tolist() == [*expected(lib, texts[0]), 2]
    assert sorted((r.doc_id, r.n_tokens) for r in token_store.read_tokens(blobs, d).collect()) == [(i, len(expected(lib, t)) + 1) for i, t in enumerate(texts)]


def test_dictionary_does_not_depend_on_row_order(spark):
    df = queries.table(spark, "/root/testdata/sf0.001", "documents")
    _, a = token_store.write_tokens(df, queries.WORD_VOCAB, 2)
    _, b = token_store.write_tokens(df.orderBy(df.n_chars.desc()).repartition(3), queries.WORD_VOCAB, 2)
    assert a == b and a
