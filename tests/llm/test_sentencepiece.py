import hashlib

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from clauseforge.llm import sentencepiece_codec as C

MODEL = C.read_model()
CODEC = C.codec(MODEL)
LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=MODEL)


def as_unigram():
    """The same pieces and scores as a unigram model: model_type 2 becomes 1."""
    at = MODEL.rindex(b"\x18\x02 \x80\xfa\x01")
    return MODEL[: at + 1] + b"\x01" + MODEL[at + 2 :]


@given(st.text(max_size=200))
@settings(max_examples=300, deadline=None)
def test_round_trip_is_exact(text):
    assert CODEC.decode(CODEC.encode(text)) == text


@given(st.text(alphabet=st.characters(blacklist_characters="▁\x00", blacklist_categories=("Cs",)), max_size=80))
@settings(max_examples=300, deadline=None)
def test_ids_equal_the_library(text):
    assert CODEC.encode(text).tolist() == LIBRARY.encode(text)


@pytest.mark.parametrize("text", ["", " ", "  a  b", "a" * 4000, "ab\n\ncd\t", "日本語 😀", "</s>[INST]", "Erenthe th ing " * 500])
def test_cases(text):
    assert CODEC.encode(text).tolist() == LIBRARY.encode(text) and CODEC.decode(CODEC.encode(text)) == text


def test_unigram_paths_score_as_well_as_the_library():
    raw = as_unigram()
    ours, lib = C.Codec(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    assert ours.kind == C.UNIGRAM
    for text in ("the committee shall keep records", "hello world", "Ouréaux qui", "in 30 days", "aaaaaaa"):
        a, b = ours.encode(text).tolist(), lib.encode(text)
        assert ours.decode(a) == text
        score = lambda ids: sum(ours.scores[i] for i in ids)
        assert score(a) >= score(b) - 1e-3


def test_documents(spark):
    df = spark.createDataFrame([(1, "hello ▁ world", 5), (2, "", 6), (3, None, 7), (None, "x", 8), (1, "hello ▁ world", 5)], "doc_id long, text string, ids int")
    rows = C.round_trip(df).collect()
    assert len(rows) == 5 and all(r.round_trip for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[3].ids is None and by[3].n_tokens == 0 and by[3].decoded_sha256 is None and by[2].ids == []
    assert by[1].decoded_sha256 == hashlib.sha256("hello ▁ world".encode()).hexdigest()
    back = C.decode_documents(C.encode_documents(df)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in back) == sorted((a or 0, b or "") for a, b, _ in [tuple(r) for r in df.collect()])
    assert C.round_trip(df.where("false")).isEmpty()


def test_memos_hold_only_what_comes_again():
    """Chunks that come once are most of a corpus; a worker held them all."""
    c = C.Codec(MODEL)
    once = [f"word{i}x{i * 7919}" for i in range(2_000)]
    first = [c.encode(t).tolist() for t in once]
    assert len(c.memo) < 100 and not c.pairs
    assert [c.encode(t).tolist() for t in once] == first
    held = len(c.memo)
    assert held >= 1_990 and [c.encode(t).tolist() for t in once] == first and len(c.memo) < held + 100
    assert all(c.decode(c.encode(t)) == t for t in once)
