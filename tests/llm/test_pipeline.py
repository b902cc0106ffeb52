"""All stages in a row over planted cases, and each of them over odd rows."""

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from sightline.llm import bpe
from tests.llm import rows

ITEMS = "item_id long, text string"


@pytest.fixture()
def folder(spark, tmp_path):
    passage = rows.prose(500, 15)
    data = [(i, rows.prose(i, 120), "en", "s", 0) for i in range(1, 13)]
    data += [(100, rows.prose(1, 120), "en", "s", 0), (101, rows.prose(2, 120).replace("house", "House"), "en", "s", 0)]  # exact and near copies
    data += [(200, f"{rows.prose(30, 60)} {passage} {rows.prose(31, 60)}", "en", "s", 0), (201, passage, None, None, None)]
    data += [(300, "Erred*** reed&&& ndsh$$$ " * 60, "en", "s", 0), (301, None, "en", "s", 0), (302, "", "en", "s", 0), (303, "123 !!", "en", "s", 0)]
    rows.documents(spark, clash=True, rows=data).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], ITEMS).write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), passage


def test_planted_cases(spark, folder):
    base, passage = folder
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, base).collect()}
    assert set(got) == {*range(1, 13), 200}
    assert passage[:-1] not in got[200].text and got[200].n_chars == len(got[200].text)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.parse_ranks(bpe.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))), special_tokens={})
    for r in got.values():
        assert r.token_ids == other.encode_ordinary(r.text)
        if r.doc_id < 100:
            assert r.text == rows.prose(r.doc_id, 120) and r.score == "score!"


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows(spark, folder, tmp_path, name, stage, empty):
    base, _ = folder
    df = rows.nothing(spark, True) if empty else rows.documents(spark, True)
    df.write.parquet(str(tmp_path / "odd"))
    docs = spark.read.parquet(str(tmp_path / "odd"))
    out = stage(spark, docs, base)
    if name != "bpe":
        assert out.columns == docs.columns
    got = out.collect()
    if empty:
        assert got == []
    else:
        ids = {r.doc_id for r in got}
        assert {1, 2} <= ids
        if name in ("language_id", "quality_rules"):
            assert not ids & {4, 5, 6, 10}
