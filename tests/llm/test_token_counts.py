"""Counted pre-tokens against the library over whole texts."""

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm.token_counts import MODEL, Tokenizer, op11_token_counts, piece_counts, pre_tokens, slices, token_counts

PATH = public_tokenizers.path(MODEL)
SP = sentencepiece.SentencePieceProcessor(model_file=PATH)
ODD = ["", " ", "   ", "a ", " a", "a\nb", "\n", "\n\n\n x", "▁", "▁a", "a▁ b", " ▁ ", "<s>x</s><unk><0x0A>", "ﬁ Ａ　x", "é", "\x00a", "a\xa0b", "\t", "a  \n  b",
       "\U0001f600\U0001f600 x", "文字列だけの長い文", "x" * 5000, "ab " * 3000, " " * 40 + "x", "http://a.b/" + "c" * 100 + " end", "\r\n", "12345 67.8"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.read(PATH)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("sizes", [{"buffer": 1, "keep": 3, "few": 1}, {"buffer": 2_000, "keep": 50, "few": 2}, {}])
def test_odd_texts(spark, tokenizer, sizes):
    """Also with many small buffers, little in mind, and common pre-tokens spread."""
    docs = [(i, t, "x") for i, t in enumerate(ODD)] + [(None, None, None), (None, "null id", "x"), (5, "again a", ""), (6, "twice the same", ""), (6, "twice the same", "")]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_tokens string")  # a column of the input with the name of a result
    got = rows(token_counts(df, tokenizer, **sizes))
    assert got == sorted(((i, len((t or "").encode()), len(SP.encode(t or ""))) for i, t, _ in docs), key=repr)


def test_empty_table(spark, tokenizer):
    out = token_counts(spark.createDataFrame([], "doc_id long, text string"), tokenizer)
    assert out.collect() == [] and out.columns == ["doc_id", "n_bytes", "n_tokens"]


def test_whole_table(spark, sf):
    want = {r["doc_id"]: (len(r["text"].encode()), len(SP.encode(r["text"]))) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op11_token_counts(spark, sf).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in got} == want and len(got) == len(want)
    assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in got)


@settings(max_examples=500, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" ▁\n\tab.é文"), st.characters(codec="utf-8")), max_size=60))
def test_pieces_stay_inside_pre_tokens(text):
    for cut in (1, 7, 1 << 20):  # long texts are cut, short cuts stand for them
        assert sum(sum(piece_counts(SP, pre_tokens(p))) for p in (slices(text, cut) if text else ())) == len(SP.encode(text))


def test_many_documents_of_string_ids(spark, tokenizer):
    """More documents in one task than numbers of one buffer, every one with the same words and one of its own."""
    docs = spark.range(0, 150_000, 1, 2).selectExpr("concat('d', id) AS name", "concat('the very same ', id) AS body")
    got = {r["name"]: r["n_tokens"] for r in token_counts(docs, tokenizer, "name", "body").collect()}
    assert len(got) == 150_000 and all(got[f"d{i}"] == len(SP.encode(f"the very same {i}")) for i in range(0, 150_000, 997))


def test_a_model_that_changes_texts_is_refused(tokenizer):
    class Other(Tokenizer):
        def load(self):
            return Wrapped()

    class Wrapped:
        def get_piece_size(self):
            return 1

        def id_to_piece(self, i):
            return f"of▁the"

        is_byte = is_control = is_unknown = lambda self, i: False

    with pytest.raises(ValueError, match="reaches over"):
        Other(b"").check()
