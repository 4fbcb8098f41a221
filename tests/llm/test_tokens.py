import pytest

from crateforge.llm import tokens as t

TEXTS = ["Hello world, it's 3½ o'clock!!", "", None, "  two  spaces \n\n end ", "<|endoftext|> plain", "日本語 и русский ünïcödé 👩‍👩‍👧", "x" * 3000, "\u0085a b　c\x1cd", "don't DON'T we'll"]


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame([(i, x, "dup") for i, x in enumerate(TEXTS)] + [(0, TEXTS[0], "dup")], "doc_id bigint, text string, ids string")


def _want(text):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    return tok.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("hot", [20_000, 2])
def test_ids_equal_the_public_tokenizer(spark, docs, hot, monkeypatch):
    monkeypatch.setattr(t, "HOT_WORDS", hot)
    rows = t.token_ids(docs).collect()
    assert len(rows) == len(TEXTS)
    assert {r.doc_id: list(r.ids) for r in rows} == {i: _want(x) for i, x in enumerate(TEXTS)}
    counts = {r.doc_id: r.n_tokens for r in t.token_counts(docs).collect()}
    assert counts == {i: len(_want(x)) for i, x in enumerate(TEXTS) if x}


def test_round_trip_and_empty(spark, docs):
    back = {r.doc_id: r.text for r in t.decoded(t.token_ids(docs)).collect()}
    assert back == {i: x or "" for i, x in enumerate(TEXTS)}
    assert t.token_ids(docs.limit(0)).count() == 0
