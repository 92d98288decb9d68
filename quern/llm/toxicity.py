"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length, with exception phrases.

Folding undoes homoglyphs, digit substitutions, stretched letters and loose accents, word by word; letters of a language such as é stay. The lexicon
holds folded words and productive word starts with weights learnt from labelled documents; the automaton matches all of them at word
borders in one pass. Matches inside an exception phrase don't count; such phrases are learnt too (an entry with its neighbour,
common in clean documents), beside those that are given. A document's features are the summed weight of its different matches, the
weight of all matches by its length in words, and the number of different ones; logistic regression turns them into a score.

An entry counts if its share of the different words of toxic documents lies so far beyond chance that none of all entries that were tried
would be expected to. So the bar rises with the number of labels, and a few documents suffice for words that stand out.

Everything is learnt from a bounded sample of labelled rows (`SAMPLE` of each label, those with the smallest hashes; of near copies one).
The lexicon has as many entries as that sample supports.

Defined results: a null text is the empty text, which is scored like any text without matches; without labels of both
kinds the words of `PRIOR` have a fixed weight and the curve is fixed; rows that repeat get the same result; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from heapq import nsmallest
from itertools import accumulate

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .common import ship_package, text_or_empty, written

#: Labelled rows of either label from which is learnt, at most.
SAMPLE = 3000
#: Toxic documents of the sample that must have an entry, and how often one document counts for it at most.
SUPPORT, MOST = 3, 4
#: Nats beyond the logarithm of the number of entries tried, and how many times as frequent in toxic documents an entry must be.
BEYOND_CHANCE, RATIO = 2.0, 5.0
#: Clean documents that must have a phrase for it to be an exception, and how many times as many as toxic ones.
PHRASE_SUPPORT, PHRASE_RATIO = 3, 10.0
STARTS = range(3, 9)
THRESHOLD = 0.3
#: Words that a worker keeps folded, and the longest of them.
KEPT, KEPT_LETTERS = 100_000, 48
#: Entries counted in a worker before they are handed on.
COUNTED = 60_000
#: Smallest shingle hashes by which near copies in the sample are told, the share of them that tells, and leaders looked at for one hash.
SKETCH, ALIKE, LEADERS = 64, 0.5, 200

# Words that need not stand out among all entries, as they are expected to count. They weigh `PRIOR_WEIGHT` at least, unless the labels speak against them.
PRIOR = ("idiot", "moron", "stupid", "scum", "trash", "loser", "pathetic", "worthless", "disgusting", "imbecile", "filth", "vermin")
PRIOR_WEIGHT = 2.0
# Phrases in which such words are harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "white trash bag", "sore loser board", "class clown award", "clown fish", "circus clown", "stupid simple", "worthless stock", "pond scum", "soap scum")
# Look-alikes and digits that stand for letters.
LOOK_ALIKE = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "α": "a", "ο": "o", "ρ": "p", "ν": "v", "τ": "t", "ι": "i", "κ": "k", "ɡ": "g", "ı": "i"}
DIGIT = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}
CODED = re.compile(r"(?<=[^\W\d_])[013457@$!|8]+(?=[^\W\d_])|^[013457@$8](?=[^\W\d_])|(?<=[^\W\d_])[013457](?!\w)")


def fold(word: str) -> str:
    """Lower-case Latin letters of a word, with spaces for what separates."""
    low = word.lower()
    if not low.isascii():
        low = unicodedata.normalize("NFKC", low)
        low = "".join(LOOK_ALIKE.get(c, c) for c in low if not unicodedata.combining(c))
    if not low.isalpha():
        low = CODED.sub(lambda m: "".join(DIGIT[c] for c in m[0]), low)
        low = re.sub(r"[\W\d_]+", " ", low).strip()
    return re.sub(r"(.)\1{2,}", r"\1\1", low)


class Folded(dict):
    def __missing__(self, word: str) -> str:
        f = fold(word)
        if len(word) <= KEPT_LETTERS:
            if len(self) >= KEPT:
                self.clear()
            self[word] = f
        return f


FOLDED = Folded()


def folded(text: str) -> str:
    return f" {' '.join(filter(None, map(FOLDED.__getitem__, text.split())))} "


@dataclass
class Lexicon:
    """weights: entry -> weight; entries are " word " or " start". curve: bias and coefficients of the features."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: list[float] = field(default_factory=lambda: [-4.0, 1.1, 1.1, 0.6])
    automaton: object = None

    def matcher(self) -> ahocorasick.Automaton:
        if self.automaton is None:
            a = ahocorasick.Automaton()
            for w, x in self.weights.items():
                a.add_word(w, (len(w), x))
            for p in self.exceptions:
                a.add_word(f" {p} ", (len(p) + 2, None))
            if len(a):
                a.make_automaton()
            self.automaton = a
        return self.automaton

    def matches(self, t: str) -> dict[int, float]:
        """Weight by place of the words that match in a folded text; of entries that begin at a word the strongest counts."""
        a = self.matcher()
        found = [(end - v[0] + 1, end, v[1]) for end, v in a.iter(t)] if len(a) else []
        spared = sorted((s, e) for s, e, w in found if w is None)
        starts, ends = [s for s, _ in spared], list(accumulate((e for _, e in spared), max))
        out: dict[int, float] = {}
        for s, e, w in found:
            if w is not None and w > out.get(s, -math.inf):
                i = bisect_right(starts, s)
                if not i or ends[i - 1] < e:
                    out[s] = w
        return out

    def features(self, text: str) -> tuple[float, float, float]:
        """Of the words that match: summed weight of different ones, weight of all by the length of the text, number of different ones."""
        t = folded(text)
        at = self.matches(t)
        if not at:
            return 0.0, 0.0, 0.0
        words = {t[s + 1 : t.index(" ", s + 1)]: w for s, w in at.items()}
        return math.log1p(sum(words.values())), math.log1p(100 * sum(at.values()) / (20 + t.count(" "))), math.log1p(len(words))

    def score(self, text: str) -> float:
        z = self.curve[0] + sum(c * f for c, f in zip(self.curve[1:], self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"automaton": None}


def entries(text: str) -> tuple[dict[str, int], int]:
    """How many different words of a text each entry stands for (at most MOST), and how many there are."""
    words, out = set(folded(text).split()), Counter()
    for w in words:
        out[f" {w} "] = 1
        for k in STARTS:
            if len(w) > k:
                out[f" {w[:k]}"] += 1
    return {e: min(n, MOST) for e, n in out.items()}, len(words)


def training_rows(docs: DataFrame, labels: DataFrame, keep: Column, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic) of the sampled labelled rows. The sample's ids are bounded and broadcast, so no text is shuffled for it."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & keep)
    spot = F.xxhash64("doc_id", F.lit(6))
    picked = [known.where(F.col("toxic") == x).orderBy(spot, "doc_id").limit(sample) for x in (0, 1)]
    ids = F.broadcast(written(picked[0].unionByName(picked[1]).dropDuplicates(["doc_id"]), "sample"))
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(ids, "doc_id").select("text", "toxic").distinct()
    rows = written(rows.withColumn("spot", F.xxhash64("text")), "training")
    # near copies would make words of one document look like words of many; the sketches are bounded as the sample is
    sketches = rows.select("spot", "toxic", sketch("text").alias("sketch")).orderBy("toxic", "spot").collect()
    alone = [r["spot"] for x in (0, 1) for r in different([r for r in sketches if r["toxic"] == x])]
    kept = F.broadcast(docs.sparkSession.createDataFrame([(s,) for s in alone], "spot long"))
    return rows.join(kept, "spot", "left_semi").select("text", "toxic")


def least_shingles(text: str) -> list[int]:
    """The smallest hashes of five words in a row."""
    w = text.split()
    hashes = {xxhash.xxh64_intdigest(" ".join(w[i : i + 5])) - (1 << 63) for i in range(max(1, len(w) - 4))}
    return nsmallest(SKETCH, hashes)


def sketch(text: str) -> Column:
    @F.pandas_udf("array<long>")
    def least(texts: pd.Series) -> pd.Series:
        return pd.Series([least_shingles(t) for t in texts], dtype="object")

    return least(text)


def different(rows: list[Row]) -> list[Row]:
    """Rows whose texts are no near copies of one before, by their sketches."""
    out, index = [], defaultdict(list)
    for r in rows:
        hits = Counter(k for h in r["sketch"] if len(index[h]) <= LEADERS for k in index[h])
        size = len(r["sketch"])
        if any(n >= ALIKE * min(size, len(out[k]["sketch"])) for k, n in hits.items()):
            continue
        for h in r["sketch"]:
            index[h].append(len(out))
        out.append(r)
    return out


def entry_counts(rows: DataFrame) -> DataFrame:
    """Written table (entry, toxic, clean, support): different words of either label by entry, and toxic documents. The entry "" has all words."""

    def counted(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, int] = {}  # three sums in one number, 40 bits each

        def handed_on() -> pd.DataFrame:
            part = (1 << 40) - 1
            n = list(total.values())
            out = pd.DataFrame({"entry": pd.Series(list(total), dtype="object"), "toxic": [x & part for x in n], "clean": [x >> 40 & part for x in n], "support": [x >> 80 for x in n]})
            total.clear()
            return out

        for pdf in frames:
            for t, x in zip(pdf["text"], pdf["toxic"].tolist(), strict=True):
                found, n = entries(t)
                one = 1 | 1 << 80 if x else 1 << 40
                for e, k in found.items():
                    total[e] = total.get(e, 0) + k * (one & (1 << 80) - 1) + (one >> 80 << 80)
                total[""] = total.get("", 0) + n * (one & (1 << 80) - 1) + (one >> 80 << 80)
                if len(total) >= COUNTED:
                    yield handed_on()
        yield handed_on()

    sums = [F.sum(c).alias(c) for c in ("toxic", "clean", "support")]
    counts = rows.mapInPandas(counted, "entry string, toxic long, clean long, support long").groupBy("entry").agg(*sums)
    return written(counts.where((F.col("support") >= SUPPORT) | F.col("entry").isin("", *[f" {w} " for w in PRIOR])), "entries")


def chosen(counts: dict[str, tuple[int, int, int]], prior: Sequence[str] = PRIOR) -> dict[str, float]:
    """Weights of the entries that count. Of entries that stand for much the same words the one that says most stays."""
    n = counts.get("", (0, 0, 0))
    p = n[0] / max(1, n[0] + n[1])
    bar = math.log(max(1, sum(c[2] >= SUPPORT for c in counts.values()))) + BEYOND_CHANCE
    good = {}
    for e, (t, c, support) in counts.items():
        if e and t and support >= SUPPORT:
            nats = t * math.log(t / ((t + c) * p)) + (c * math.log(c / ((t + c) * (1 - p))) if c else 0.0)
            ratio = (t + 0.5) / n[0] / ((c + 0.5) / max(1, n[1]))
            if nats >= bar and ratio >= RATIO:
                good[e] = nats, math.log(ratio)
    weights: dict[str, float] = {}
    above: set[str] = set()  # all starts of entries that have been taken
    for e in sorted(good, key=lambda e: (-good[e][0], -len(e), e)):
        if e not in above and not any(e[: k + 1] in weights for k in STARTS if len(e) > k + 1):
            weights[e] = good[e][1]
            above.update(e[: k + 1] for k in STARTS)
    for w in prior:
        t, c, _ = counts.get(f" {w} ", (0, 0, 0))
        if t >= 2 * c and not any(f" {w} "[: k + 1] in weights for k in STARTS):
            weights[f" {w} "] = max(PRIOR_WEIGHT, weights.get(f" {w} ", 0.0))
    return weights


def phrases(lexicon: Lexicon, text: str) -> set[str]:
    """Each matching word with the word before it and with the word after it."""
    t = folded(text)
    out = set()
    for s in lexicon.matches(t):
        e = t.index(" ", s + 1)
        before, after = t.rfind(" ", 0, s), t.find(" ", e + 1)
        if before >= 0:
            out.add(t[before + 1 : e])
        if after >= 0:
            out.add(t[s + 1 : after])
    return out


def learnt_exceptions(rows: DataFrame, lexicon: Lexicon) -> tuple[str, ...]:
    """Phrases around entries that clean documents have and toxic ones don't."""

    def found(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            got = [(p, 1 - x, x) for t, x in zip(pdf["text"], pdf["toxic"], strict=True) for p in phrases(lexicon, t)]
            yield pd.DataFrame(got, columns=["phrase", "clean", "toxic"])

    sums = rows.mapInPandas(found, "phrase string, clean long, toxic long").groupBy("phrase").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    best = sums.where((F.col("clean") >= PHRASE_SUPPORT) & (F.col("clean") >= PHRASE_RATIO * F.col("toxic"))).select("phrase").collect()
    return tuple(sorted(r["phrase"] for r in best))


def learn(rows: DataFrame, prior: Sequence[str] = PRIOR, exceptions: Sequence[str] = EXCEPTIONS) -> Lexicon:
    """A lexicon and its curve from (text, toxic)."""
    kinds = {r["toxic"] for r in rows.groupBy("toxic").count().collect()}
    if kinds != {0, 1}:
        return Lexicon({f" {w} ": PRIOR_WEIGHT for w in prior}, tuple(exceptions))
    lexicon = Lexicon(chosen({r["entry"]: (r["toxic"], r["clean"], r["support"]) for r in entry_counts(rows).collect()}, prior), tuple(exceptions))
    lexicon = Lexicon(lexicon.weights, (*exceptions, *learnt_exceptions(rows, lexicon)))

    def features(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                yield pd.DataFrame([(*lexicon.features(t), int(x)) for t, x in zip(pdf["text"], pdf["toxic"], strict=True)], columns=["a", "b", "c", "toxic"])

    got = np.array(rows.mapInPandas(features, "a double, b double, c double, toxic int").collect(), float)
    got = got[np.lexsort(got.T)]  # sums don't depend on which task was first
    lexicon.curve = logistic(got[:, :3], got[:, 3])
    return lexicon


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> list[float]:
    """Ridge logistic regression by Newton steps; both labels weigh as in the sample, coefficients stay at 0 or above."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    free = np.ones(len(w), bool)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * len(y) * np.r_[0, w[1:]]
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(np.r_[1e-6, np.full(len(w) - 1, ridge * len(y))])
        step = np.zeros(len(w))
        step[free] = np.linalg.solve(h[np.ix_(free, free)], g[free])
        w = w - step
        below = (w < 0) & (np.arange(len(w)) > 0)
        w[below], free[below] = 0.0, False
        if np.abs(step).max() < 1e-9:
            break
    return w.tolist()


def held_out() -> Column:
    """Rows that nothing is learnt from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def scorer(lexicon: Lexicon, text: Column) -> Column:
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([lexicon.score(t) for t in texts], dtype="float64")

    return score(text)


def fitted(docs: DataFrame, labels: DataFrame, **options: Sequence[str]) -> Lexicon:
    """What is learnt from the rows that are not held out. options: `prior` and `exceptions` of `learn`."""
    ship_package(docs.sparkSession)
    return learn(training_rows(docs, labels, ~held_out()), **options)


def score_toxicity(docs: DataFrame, labels: DataFrame, **options: Sequence[str]) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    lexicon = fitted(docs, labels, **options)
    rows = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), scorer(lexicon, text_or_empty()).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
