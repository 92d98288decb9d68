import public_tokenizers
import pytest
import sentencepiece

from quern.llm.token_counts import budget_cut, count_at, counter, fitting_at, model_bytes, prefix_tables, token_counts

from .helpers import documents, more_docs, no_docs, odd_docs

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TRICKY = ["", " ", "a", "  a  b ", "\n", " \n x\n\ny ", "▁a ▁▁b", "<s>hi</s> <unk> <0x0A>", "ﬁ①😀\t x", "aaaaaaaaaaaaaaaa", "the\nthe The", "été é", "▁", "x" * 3000, "1234567890" * 20, "\x00a\x7f"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.mark.parametrize("make", ["tricky", "odd", "real", "more", "none"])
def test_counts_equal_the_library(spark, sf_dir, library, make):
    docs = {"odd": odd_docs, "none": no_docs, "more": more_docs, "tricky": lambda s: s.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")}.get(make, lambda s: documents(s, sf_dir))(spark)
    texts = sorted(((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()), key=repr)
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts(docs, MODEL).collect()), key=repr)
    want = [(i, len(t.encode()), n := len(library.encode(t)), n > 4096) for i, t in texts]
    assert got == sorted(want, key=repr)


def test_every_prefix(library):
    c = counter(model_bytes(MODEL))
    for t in [*TRICKY, "The quick  brown fox,\njumps over être déjà-vu 12345 times 😀!"]:
        if len(t) < 200:
            assert c.prefix_counts(t) == [len(library.encode(t[:i])) for i in range(len(t) + 1)], t


def test_budget(library):
    c = counter(model_bytes(MODEL))
    for t in ["The quick  brown fox,\njumps over être déjà-vu 12345 times 😀!", "unbelievable internationalization", "a b c d e f g"]:
        n = c.prefix_counts(t)
        for budget in range(max(n) + 2):
            want = max(i for i, k in enumerate(n) if k <= budget)
            assert c.fitting(t, budget) == want and budget_cut(t, budget, MODEL) == t[:want]


def test_prefix_tables_answer_without_the_text(spark, sf_dir, library):
    docs = documents(spark, sf_dir).limit(30)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in prefix_tables(docs, MODEL).collect():
        t = texts[r["doc_id"]]
        assert len(r["steps"]) == 2 * len(t)
        for points in {0, 1, len(t) // 3, len(t) // 2, len(t)}:
            assert count_at(r["steps"], points) == len(library.encode(t[:points]))
        for budget in (0, 7, 100):
            n = fitting_at(r["steps"], budget)
            assert n == counter(model_bytes(MODEL)).fitting(t, budget) and len(library.encode(t[:n])) <= budget


def test_units_are_looked_up_not_encoded_again(monkeypatch):
    c = counter(model_bytes(MODEL))
    text = "The quick brown fox jumps over internationalization, again and again"
    want = c.prefix_counts(text)
    c.count(text)
    monkeypatch.setattr(c, "extend", None)
    assert c.prefix_counts(text) == want and c.fitting(text, 5) == max(i for i, k in enumerate(want) if k <= 5)


def test_long_units_are_not_kept():
    c = counter(model_bytes(MODEL))
    n = c.count("x9" * 5000)
    assert n > 0 and all(len(k) <= 200 for kept in (c.led, c.bare) for k in [*kept, *kept.tables])
