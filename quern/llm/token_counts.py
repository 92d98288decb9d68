"""Exact token counts at every prefix by dynamic programming over a sentencepiece BPE vocabulary.

The encoding of a prefix ends in exactly one token, and the rest of it is the encoding of the prefix before that token.
So the count at a prefix is one (for bytes that stand for an unknown character: their number) more than the count at an
earlier prefix. Which token ends a prefix follows from pairs alone: a token may follow another if BPE, applied to both
joined, gives back just these two. Texts fall into units that no token spans (a unit starts at a space after
another character, at a line break, or after a letter that something else follows, as far as the vocabulary has no token across); of each
unit the counts at all its prefixes are kept (`Units.tables`), so that truncation and budget questions are looked up, not encoded
again. `prefix_tables` writes the counts at every prefix of whole texts, from which `count_at` and `fitting_at` answer without the text.

Defined results: a null text is the empty text, which has no tokens; strings of control tokens inside a text are plain
text, as in the library; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_package, text_or_empty

SPACE = "▁"
#: Units and token pairs that a worker keeps; they are dropped and found again beyond this.
KEPT, KEPT_PAIRS = 700_000, 400_000
#: Characters of the longest unit that is kept.
KEPT_LETTERS = 200
#: Characters of texts whose units are learnt together.
LEARNT = 4_000_000
#: Where a letter is followed by something else.
AFTER_LETTER = re.compile(r"(?<=[^\W\d_])(?=[\W\d_])")


class Units(dict):
    """Token count by unit, each unit being `lead` + key, and the counts at every prefix of units that split no further."""

    def __init__(self, counter: PrefixCounter, lead: str) -> None:
        self.counter, self.lead = counter, lead
        self.tables: dict[str, Sequence[int]] = {}

    def keep(self, key: str, counts: list[int]) -> None:
        if len(self.tables) >= KEPT:
            self.tables.clear()
        try:
            self.tables[key] = bytes(counts)
        except ValueError:  # more than a byte
            self.tables[key] = array("L", counts)

    def table(self, key: str) -> Sequence[int]:
        """Token counts at all prefixes of a unit, the last of which is the unit."""
        parts = AFTER_LETTER.split(key) if self.counter.splits_after_letter else [key]
        if len(parts) > 1:
            out = list(self.table(parts[0]))
            for p in parts[1:]:
                before = out[-1] if out else 0
                out += [before + n for n in self.counter.bare.table(p)]
            return out
        if (got := self.tables.get(key)) is None:
            got = self.counter.unit_counts(self.lead + key)
            if len(key) <= KEPT_LETTERS:
                self.keep(key, got)
        return got

    def __missing__(self, key: str) -> int:
        parts = AFTER_LETTER.split(key) if self.counter.splits_after_letter else ()
        if len(parts) > 1:
            n = self[parts[0]] + sum(map(self.counter.bare.__getitem__, parts[1:]))
        else:
            n = self.table(key)[-1] if self.lead + key else 0
        if len(key) <= KEPT_LETTERS:
            if len(self) >= KEPT:
                self.clear()
            self[key] = n
        return n


class PrefixCounter:
    def __init__(self, model: bytes) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(sp.get_piece_size())
        special = (sp.is_control, sp.is_unknown, sp.is_byte, sp.is_unused)
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in ids if not any(f(i) for f in special)}
        #: Lengths of tokens by their last three characters, longest first; shorter ones are always tried.
        by_end: dict[str, set[int]] = {}
        for t in self.score:
            if len(t) > 2:
                by_end.setdefault(t[-3:], {1, 2}).add(len(t))
        self.lengths = {e: tuple(sorted(n, reverse=True)) for e, n in by_end.items()}
        joined = [p for p in self.score if len(p) > 1]
        self.splits_at_space = not any(SPACE in p.lstrip(SPACE) for p in joined)
        self.line = not any("\n" in p for p in joined)
        self.splits_after_letter = not any(map(AFTER_LETTER.search, joined))
        self.pairs: dict[tuple[str, str], bool] = {}
        self.led, self.bare = Units(self, SPACE), Units(self, "")
        if not self.splits_at_space:
            raise ValueError("a vocabulary whose tokens span words")

    def merged(self, text: str) -> list[str]:
        """BPE by its definition: again and again the leftmost of the best merges."""
        parts, get, none = list(text), self.score.get, -np.inf
        ranks = [get(x + y, none) for x, y in zip(parts, parts[1:])]
        while ranks and (best := max(ranks)) != none:
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(ranks):
                ranks[i] = get(parts[i] + parts[i + 1], none)
        return parts

    def may_follow(self, a: str, b: str) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(a + b) == ([a, b] if a else [b])
        return known

    def extend(self, unit: str, last: list[str], count: list[int]) -> None:
        """Goes on from the prefix of `unit` that `last` and `count` (last token and token count by prefix) have reached."""
        score, pairs, lengths = self.score, self.pairs, self.lengths
        for i in range(len(count), len(unit) + 1):
            for n in lengths.get(unit[i - 3 : i], (2, 1)) if i > 2 else (i, 1):
                t = unit[i - n : i] if n <= i else ""
                if t in score or n == 1:
                    fits = pairs.get((last[i - n], t))
                    if fits or (fits is None and self.may_follow(last[i - n], t)):
                        break
            last.append(t)
            count.append(count[i - n] + (1 if t in score else len(t.encode("utf-8", "surrogatepass"))))

    def unit_counts(self, unit: str) -> list[int]:
        """Token counts of unit[:1], unit[:2], ... up to the whole unit."""
        count = [0]
        self.extend(unit, [""], count)
        return count[1:]

    def learn(self, texts: list[str]) -> None:
        """Counts the units of some texts in alphabetical order, where each unit goes on from the prefix that it shares with the one before."""
        led: set[str] = set()
        bare: set[str] = set()
        for t in texts:
            first, *rest = t.split("\n")
            led.update(first.split(" "))
            for part in rest:
                head, *words = part.split(" ")
                bare.add(head)
                led.update(words)
        for kept, keys in ((self.led, led), (self.bare, bare)):
            if len(kept) + len(keys) >= KEPT:
                kept.clear()
            new = keys - kept.keys()
            if self.splits_after_letter:
                new = {AFTER_LETTER.split(k, maxsplit=1)[0] for k in new} - kept.keys()
            last, count, before = [""], [0], ""
            for key in sorted(k for k in new if len(k) <= KEPT_LETTERS):
                unit, k = kept.lead + key, 0
                for x, y in zip(before, unit):
                    if x != y:
                        break
                    k += 1
                del last[k + 1 :], count[k + 1 :]
                self.extend(unit, last, count)
                kept[key], before = count[-1], unit
                kept.keep(key, count[1:])

    def units(self, text: str) -> Iterator[tuple[Units, str]]:
        """The units of a text in order; concatenated they are the text with its leading space sign."""
        whole = SPACE + text.replace(" ", SPACE)
        lines = re.split("(\n)", whole) if self.line else [whole]
        for part in lines:
            for u in re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", part):
                yield (self.led, u[1:]) if u[0] == SPACE else (self.bare, u)

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.line or "  " in text or text[0] == " " or SPACE in text:
            return sum(kept[u] for kept, u in self.units(text))
        led, bare = self.led.__getitem__, self.bare.__getitem__
        first, *rest = text.split("\n")
        n = sum(map(led, first.split(" "))) + len(rest) * self.bare["\n"]
        for part in rest:
            head, *words = part.split(" ")
            n += bare(head) + sum(map(led, words))
        return n

    def prefix_counts(self, text: str) -> list[int]:
        """Token counts of text[:0], text[:1], ... up to the whole text."""
        out, total = [0], 0
        for k, (kept, u) in enumerate(self.units(text) if text else ()):
            counts = [total + c for c in kept.table(u)]
            total = counts[-1]
            out += counts[1:] if k == 0 else counts  # the leading space sign is not of the text
        return out

    def fitting(self, text: str, budget: int) -> int:
        """Code points of the longest prefix of at most `budget` tokens."""
        best = at = total = 0
        for k, (kept, u) in enumerate(self.units(text) if text else ()):
            n, width = kept[u], len(u) + len(kept.lead) - (k == 0)
            if total > budget + width:  # later prefixes only have more: a token more undoes at most the tokens of a unit
                break
            if total + n <= budget:
                best = at + width
            elif total <= budget:
                counts = kept.table(u)[(1 if k == 0 else 0) :]
                best = max([best, *(at + j + 1 for j, c in enumerate(counts) if total + c <= budget)])
            total, at = total + n, at + width
        return best


@lru_cache(maxsize=4)
def counter(model: bytes) -> PrefixCounter:
    return PrefixCounter(model)


def model_bytes(model_file: str) -> bytes:
    with open(model_file, "rb") as f:
        return f.read()


def token_counts(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, limit_points) of every row.

    limit_points: code points of the longest prefix of at most `limit` tokens. The model is read on the driver and broadcast.
    """
    ship_package(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(model_bytes(model_file))

    @F.pandas_udf("struct<n_tokens:long,limit_points:long>")
    def counts(texts: pd.Series) -> pd.DataFrame:
        c, n, some, size = counter(model.value), [], [], 0
        for t in texts:
            some.append(t)
            size += len(t)
            if size >= LEARNT:
                c.learn(some)
                n += map(c.count, some)
                some, size = [], 0
        c.learn(some)
        n += map(c.count, some)
        fit = [len(t) if k <= limit else c.fitting(t, limit) for t, k in zip(texts, n, strict=True)]
        return pd.DataFrame({"n_tokens": np.array(n, np.int64), "limit_points": np.array(fit, np.int64)})

    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), counts(text).alias("c")).select(
        "doc_id", "n_bytes", "c.n_tokens", (F.col("c.n_tokens") > limit).alias("over_limit"), "c.limit_points"
    )


def budget_cut(text: str, budget: int, model_file: str) -> str:
    """The longest prefix of a text within a token budget."""
    return text[: counter(model_bytes(model_file)).fitting(text, budget)]


def prefix_tables(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, steps) of every row; steps: for each code point how the token count changes there, as 16-bit numbers."""
    ship_package(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(model_bytes(model_file))

    @F.pandas_udf("binary")
    def steps(texts: pd.Series) -> pd.Series:
        c = counter(model.value)
        return pd.Series([np.diff(np.array(c.prefix_counts(t), np.int64)).astype("<i2").tobytes() for t in texts], dtype="object")

    return docs.select(F.col(id_col).alias("doc_id"), steps(text_or_empty(text_col)).alias("steps"))


def count_at(steps: bytes, points: int) -> int:
    """Tokens of the first `points` code points of a text, from its steps."""
    return int(np.frombuffer(steps, "<i2")[:points].sum(dtype=np.int64))


def fitting_at(steps: bytes, budget: int) -> int:
    """Code points of the longest prefix of at most `budget` tokens, from the steps of a text."""
    fits = np.flatnonzero(np.cumsum(np.frombuffer(steps, "<i2"), dtype=np.int64) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0

