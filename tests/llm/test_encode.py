import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqlume.llm import encode

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def both():
    import public_tokenizers

    judge = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    judge.encode_special_tokens = True
    return encode.Vocabulary(encode.default_vocabulary()), judge


def ids(judge, text):
    return judge.encode(text, add_special_tokens=False).ids


CASES = [
    "", " ", "\n\n  \n", "Hello world, it's me. We'll see <|endoftext|> there", "naïve café — déjà vu", "数学の本です。", "a" * 5000, "ab" * 3000, "\x00\x01", "²³Ⅳ½x", "é", "​﻿x", "😀👍🏽", "\x1c \x1d", " x",
    "  leading", "trailing  ", "\t\ttabs", "CamelCase_snake-case", "'s 'S 'll", "  x", "0123456789" * 50, "\r\n\r\n", "ᄀᄀᆨ", "퟿￿",
]


@pytest.mark.parametrize("text", CASES)
def test_equals_the_public_tokenizer(both, text):
    assert both[0].encode(text) == ids(both[1], text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(both, text):
    assert both[0].encode(text) == ids(both[1], text)


def test_mixed_pieces(both):
    rnd = random.Random(1)
    parts = ["a", "b", "the ", " ", "\n", "é", "̈", "中", "١", "²", "'s", "'ll", "  ", "\t", "ﬁ", "😀", "0", "!", "\xa0", "aaaa", "ing", "tion"]
    for _ in range(2000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30)))
        assert both[0].encode(text) == ids(both[1], text)


def test_round_trip(both):
    vocabulary = both[0]
    for text in CASES:
        raw = "".join(vocabulary.text[i] for i in vocabulary.encode(text)).encode("latin-1")
        assert raw.decode("utf-8", "replace") == text


def test_every_token_but_bytes_has_parts(both):
    assert len(both[0].ids) - len(both[0].parts) == 256


def test_rows(spark, both, monkeypatch):
    monkeypatch.setattr(encode, "CACHE_PIECES", 3)
    rows = [(1, "It is.", [7]), (2, None, []), (3, "", None), (None, "x", None), (1, "It is.", None), (4, "long " * 200_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>")
    got = encode.encode(df, encode.default_vocabulary()).collect()
    assert [(r.doc_id, r.ids[:5]) for r in got] == [(i, ids(both[1], t or "")[:5]) for i, t, _ in rows] and len(got[5].ids) == len(ids(both[1], rows[5][1]))
    assert encode.encode(df.where("false"), encode.default_vocabulary()).count() == 0


def test_tokens_longer_than_any_window(tmp_path):
    import base64

    tokens = [bytes([b]) for b in range(256)]
    half = b"a"
    while len(half) < 1024:  # aa, aaaa, ... up to 1,024 bytes
        half += half
        tokens.append(half)
    path = tmp_path / "long.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    vocabulary = encode.Vocabulary(str(path))
    ids = vocabulary.encode("a" * 1536)
    assert ids == [265, 264] and vocabulary.encode("a" * 1025) == [265, 97]
