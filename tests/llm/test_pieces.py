"""SentencePiece coding against the library on whole texts."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from visitframe.llm import pieces
from visitframe.llm.registry import piece_model_bytes

MODEL = pieces.PieceModel(piece_model_bytes())


def expected(text: str) -> list[int]:
    return MODEL.library.encode(text, add_bos=True, add_eos=True)


def check(texts: list[str]) -> None:
    for text, ids in zip(texts, pieces.encode_texts(MODEL, {}, texts), strict=True):
        got = np.frombuffer(ids, "<u4").astype(np.int64)
        assert got.tolist() == expected(text)
        assert MODEL.decode(got) == MODEL.library.decode(got.tolist())


def test_planted_texts():
    check(["", " ", "  a  b ", "▁▁x▁", "a b\tc\nd\r\n", "日本語のテキスト 𝔘𝔫𝔦 👩‍👩‍👧", "x" * 300, "\0\x01", "the " * 500, "é" * 50 + "ß", "<s></s><0x41>"])


@settings(max_examples=150, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" ▁\nabcthe<>")), max_size=60))
def test_any_text(text):
    check([text])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, len(MODEL.surface) - 1), max_size=40))
def test_decodes_any_ids(ids):
    assert MODEL.decode(np.array(ids, np.int64)) == MODEL.library.decode(ids)


def test_documents_and_defined_cases(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(None, None), (-1, ""), (-2, "a b"), (-2, "a b"), (-3, "word " * 30_000)], docs.schema)
    both = docs.union(odd)
    got = pieces.encode_and_decode(both, piece_model_bytes()).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in both.collect()}
    assert len(got) == docs.count() + 5
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert ids == expected(texts[r["doc_id"]]) and r["decoded"] == MODEL.library.decode(ids)


def test_clashing_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "x", "old", "old")], "doc_id long, text string, ids string, decoded string")
    got = pieces.encode_and_decode(docs, piece_model_bytes())
    assert sorted(got.columns) == ["decoded", "doc_id", "ids"] and got.first()["decoded"] == "x"
    assert pieces.encode_and_decode(docs.limit(0), piece_model_bytes()).count() == 0


def test_other_models_are_refused():
    with pytest.raises(Exception):
        pieces.PieceModel(b"no model")
