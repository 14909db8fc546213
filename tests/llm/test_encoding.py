"""Token ids against the library that the vocabulary is published for."""

import base64

import pytest

from pagemill.llm import encoding as C

TEXTS = ["", " ", "a", "it's we'll 'S x'd", "naïve café  straße\n\n x\t y ", "شروط العقد ١٢٣", "👨‍👩‍👧 x​y　z\x1c\x1d q\x85w\xa0", "<|endoftext|> <|startoftext|>", "aaaa" * 400, "-----=====  ", "1234567 x12y", "\r\n \r\n", "don't’s ' s"]


def expected(texts):
    tiktoken, public = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return [own.encode_ordinary(t) for t in texts]


def test_pattern_is_the_published_one():
    assert C.PATTERN == pytest.importorskip("public_tokenizers").PATTERN


def test_ids(spark):
    docs = spark.createDataFrame([*enumerate(TEXTS), (100, None), (0, TEXTS[0])], "doc_id bigint, text string").selectExpr("*", "1 AS ids")
    got = {r.doc_id: list(r.ids) for r in C.encode(docs).collect()}
    assert got.pop(100) == [] and got == dict(enumerate(expected(TEXTS)))
