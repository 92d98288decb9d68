import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quern.llm.alignment import align_tokenizers, often_from, units_of, vocabularies
from quern.llm.token_counts import model_bytes
from quern.llm.units import byte_letters

from .helpers import documents, more_docs, no_docs, odd_docs

A, B = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def brute(rows):
    """Both encodings by their libraries, token by token; links by comparing byte ranges."""
    ta, tb, letter = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_letters()
    ta.encode_special_tokens = True
    spelt_a = {i: bytes(letter.get(c, 0) for c in t) for t, i in ta.get_vocab().items()}
    parsed, linked = [], Counter()
    for doc_id, text in rows:
        a, b = (ta.encode(" " + text, add_special_tokens=False).ids, tb.encode(text)) if text else ([], [])
        ba = [spelt_a[i] for i in a]
        bb = [bytes([int(tb.id_to_piece(i)[3:5], 16)]) if tb.is_byte(i) else tb.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or not b"".join(ba) == b"".join(bb) == (" " + text).encode():
            a, b, ba, bb = [], [], [], []
        ranges = []
        for pieces in (ba, bb):
            at, out = 0, []
            for p in pieces:
                out.append((at, at + len(p)))
                at += len(p)
            ranges.append(out)
        links, j0 = [], 0
        for i, (s, e) in enumerate(ranges[0]):
            while ranges[1][j0][1] <= s:
                j0 += 1
            j = j0
            while j < len(b) and ranges[1][j][0] < e:
                links.append((a[i], b[j]))
                j += 1
        cuts = sorted({e for _, e in ranges[0]} & {e for _, e in ranges[1]})
        groups = [[[], []] for _ in cuts]
        for side, ids in enumerate((a, b)):
            k = 0
            for i, (_, e) in zip(ids, ranges[side]):
                while cuts[k] < e:
                    k += 1
                groups[k][side].append(i)
        said = ";".join("|".join(",".join(map(str, s)) for s in g) for g in groups)
        parsed.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(said.encode()).hexdigest() if a else ""))
        linked.update(set(links))
    best = [defaultdict(int), defaultdict(int)]
    for pair, n in linked.items():
        for side in (0, 1):
            best[side][pair[side]] = max(best[side][pair[side]], n)
    n_best = lambda links, s: sum(linked[p] == best[s][p[s]] for p in links)
    return Counter((d, na, nb, ng, len(ls), n_best(ls, 0), sum(linked[p] for p in ls), sha, n_best(ls, 1)) for d, na, nb, ng, ls, sha in parsed)


@pytest.mark.parametrize("make", ["odd", "real", "more", "none"])
@pytest.mark.parametrize("frequent", [200_000, 0, 300])
def test_equals_brute_force(spark, sf_dir, make, frequent):
    docs = {"odd": odd_docs, "none": no_docs, "more": more_docs}.get(make, lambda s: documents(s, sf_dir))(spark)
    if make == "more" and frequent == 0:
        pytest.skip("covered by the others")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert Counter(map(tuple, align_tokenizers(docs, A, B, frequent=frequent).collect())) == brute(rows)


def test_odd_texts(spark):
    rnd = random.Random(3)
    letters = "aab cdeé ñ'.,-1290 \n\t  　▁\x00\x01́中😀<|endoftext|>s"
    texts = ["".join(rnd.choices(letters, k=rnd.randint(0, 30))) for _ in range(400)]
    texts += ["a  b", " a", "a ", "a\n b", "a \nb", "<s> </s> <unk> <0x41>", "<|endoftext|>", "word" * 3000, "don't we'll", "a▁b", "﻿x", "ﬁ ①", "\r\n\r\n", "x\r y"]
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts)] + [(1, None), (1, "a  b"), (2**62 + 1, "big id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, align_tokenizers(docs, A, B).collect())) == brute(rows)


def test_ids_of_any_kind(spark):
    docs = spark.createDataFrame([("p-1", "some words"), (None, "some words")], "name string, body string")
    got = align_tokenizers(docs, A, B, id_col="name", text_col="body").collect()
    assert {r["doc_id"] for r in got} == {"p-1", None} and got[0][1:] == got[1][1:]


def test_units():
    assert units_of("a b.\nc") == ["a", "b.\nc"] and units_of("a  b c") == ["a  b c"] and units_of("a b ") == ["a b "]
    v = vocabularies(model_bytes(A).decode(), model_bytes(B))
    assert v.a.in_order and v.b.parts


def test_often(spark):
    counts = spark.createDataFrame([(n,) for n in [1] * 50 + [2] * 20 + [9] * 5 + [100]], "n long")
    for most in (0, 1, 6, 26, 76):
        least = often_from(counts, most)
        assert counts.where(counts.n > least).count() <= most
    assert counts.where(counts.n > often_from(counts, 6)).count() == 6
