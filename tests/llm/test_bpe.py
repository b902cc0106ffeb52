import random

import public_tokenizers
import pytest
import tiktoken

from sightline.llm import bpe
from tests.llm import rows

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
CONTENT = bpe.vocabulary(PATH)


@pytest.fixture(scope="module")
def other():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.parse_ranks(CONTENT), special_tokens={})


def ids(encoder, texts):
    return [memoryview(x).cast("i").tolist() for x in encoder.encode_all(texts)]


def test_odd_texts(other, monkeypatch):
    pool = "a1 \n\t\x0b\x1c\x1f\x85\xa0 é²½Ⅷ٣中\U0001f600\U0001d400'sll_-   \n bcd"
    rng = random.Random(2)
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    texts += ["a" * 1000, "ab" * 5000, "é" * 300, " " * 1000 + "a", "=-" * 400, "\n", " ", "a\n", " a", "<|endoftext|>", *(r[1] or "" for r in rows.document_rows())]
    want = [other.encode_ordinary(t) for t in texts]
    encoder = bpe.Encoder(CONTENT, public_tokenizers.PATTERN)
    assert ids(encoder, texts) == want
    monkeypatch.setattr(bpe, "LONG_TEXT", 3)
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    assert ids(encoder, texts[:500]) == want[:500]


def test_another_pattern(other):
    encoder = bpe.Encoder(CONTENT, r"\s+|\S+")
    want = tiktoken.Encoding("own", pat_str=r"\s+|\S+", mergeable_ranks=bpe.parse_ranks(CONTENT), special_tokens={}).encode_ordinary("one two  three")
    assert ids(encoder, ["one two  three"]) == [want]


def test_rows_come_back(spark, other):
    df = bpe.decode(bpe.encode(rows.documents(spark, clash=True), PATH, public_tokenizers.PATTERN), PATH)
    got = df.collect()
    assert len(got) == len(rows.document_rows())
    for r in got:
        assert r.token_ids == other.encode_ordinary(r.text or "") and bytes(r.decoded).decode() == (r.text or "") and r.score == "score!"


def test_empty_table(spark):
    assert bpe.digests(rows.nothing(spark), PATH, public_tokenizers.PATTERN).count() == 0


def test_unknown_id_fails():
    with pytest.raises(ValueError):
        bpe.Decoder({0: b"a", 2: b"b"})(bpe.np.array([1]))
