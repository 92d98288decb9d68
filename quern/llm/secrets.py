"""Secret scan: fixed formats, and credential-context values scored by what guessing them would cost.

The cost of a value is the least number of bits over all ways to cut it into words, dates, repeats, keyboard walks and
spans that have to be tried out by brute force, found by dynamic programming from left to right. A word costs the logarithm of
its rank; words are ranked by the vocabulary files of public tokenizers (`dictionary`, the most frequent come first in them), after
a few common passwords. Values that stand where a credential is named are reported where their cost is at least `MIN_BITS`, whatever
script they are in; a value ends with its quotes, or before a blank, a tag, or the next name and value (JSON, query strings, settings).
Where only blanks or "is" stand between name and value, runs of letters that look like an ordinary word cost at most
`WORD_BITS` unless letters and digits are mixed.

Defined results: a null text is the empty text; rows that repeat get the same result; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from itertools import accumulate, zip_longest

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_package, text_or_empty

KINDS = ("assign", "access", "hex", "value")
MIN_BITS = 48.0
CUT_BITS = 1.5
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
CUES = ("passw", "secret", "token", "apikey", "api_key", "api-key", "api key", "passphrase", "passcode", "pwd", "bearer", "credential", "private key", "private_key", "access_key", "auth")
#: A name of a credential and what leads to its value, up to the value or the quote that opens it.
CONTEXT = re.compile(
    r"""(?:passw(?:or)?d|passphrase|passcode|pwd|secret|token|api[_\x20-]?key|bearer|credentials?|private[_\x20]key|access_key|auth(?:orization)?)\\?["']?(?:\x20*(?::=|=>|[:=])\x20*|\x20+is\x20+|\x20+)(?=\S)""",
    re.I | re.A,
)
#: A value in quotes goes to the same quote; a quote behind a backslash is part of it, unless the one that opens it is behind one too.
QUOTED = {q: re.compile(rf"(?:[^{q}\\\n]|\\[^\n])*(?={q})") for q in "\"'`"} | {f"\\{q}": re.compile(rf"[^{q}\\\n]*(?=\\{q})") for q in "\"'"}
#: A value without quotes goes to a blank or a quote, to a tag, and to a sign after which the next name and its value stand.
BARE = re.compile(r"""(?:[^\s"'`,;&<]|'(?=\w)|<(?![/A-Za-z])|[,;&](?=\S)(?!\s*\\?["']?[\w.\[\]-]+\\?["']?\s*[:=]))+""")
#: What sets a value apart from its name, beyond blanks and words.
SEPARATOR = re.compile("[:=\"'`]")
#: Letter runs of a value, in any script; bits to pick an ordinary word; the most letters of one in ASCII, and beyond, where compounds are longer.
RUNS = re.compile(r"[^\W\d_]+")
WORD_BITS, WORD_LETTERS, LONG_LETTERS = 17.0, 20, 30
#: Lengths of the words of a dictionary, and the longest keyboard walk or repeat that is tried in all its parts.
LETTERS, PARTS = range(3, 21), 64

# Common passwords and placeholder words, most common first.
WORDS = (
    "password", "123456", "qwerty", "letmein", "welcome", "admin", "dragon", "monkey", "master", "login", "abc", "iloveyou", "sunshine",
    "princess", "football", "baseball", "shadow", "superman", "batman", "trustno", "hello", "freedom", "whatever", "secret", "hunter",
    "changeme", "change", "default", "example", "sample", "dummy", "test", "testing", "user", "root", "guest", "pass", "word", "token",
    "key", "api", "your", "my", "here", "the", "and", "placeholder", "insert", "replace", "none", "null", "true", "false", "undefined",
    "value", "string", "config", "env", "process", "settings", "summer", "winter", "spring", "autumn", "january", "february", "march",
    "april", "june", "july", "august", "september", "october", "november", "december", "monday", "tuesday", "wednesday", "thursday",
    "friday", "saturday", "sunday", "love", "star", "blue", "red", "green", "black", "white", "orange", "apple", "google", "computer",
    "internet", "system", "server", "database", "access", "private", "public", "data", "name", "home", "work", "office", "company",
)
# Rows of a keyboard.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz", "0123456789")

NEXT = {(a, b) for row in ROWS for a, b in zip(row, row[1:], strict=False)} | {(b, a) for row in ROWS for a, b in zip(row, row[1:], strict=False)}
PLAIN = str.maketrans("013457@$!", "oieastasi")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d", re.A)
DATE_LENGTHS = range(4, 11)


def dictionary(files: Sequence[str] = ()) -> dict[str, int]:
    """Rank by word: common passwords, then the words of tokenizer vocabularies in turn, the most frequent of each first.

    files: vocabularies with word ends (.json) or of byte ranks (.tiktoken), both of which list what is frequent first.
    """
    lists = []
    for f in files:
        with open(f, encoding="utf-8") as lines:
            if f.endswith(".json"):
                pieces = sorted((n, t.removesuffix("</w>")) for t, n in json.load(lines)["model"]["vocab"].items() if t.endswith("</w>"))
            else:
                pieces = sorted((int(n), base64.b64decode(t).decode("utf-8", "replace").strip().lower()) for t, n in map(str.split, lines))
        lists.append([w for _, w in pieces if len(w) in LETTERS and w.isalpha()])
    rank: dict[str, int] = {}
    for w in WORDS:
        rank.setdefault(w, len(rank) + 1)
    for k in range(max(map(len, lists), default=0)):
        for words in lists:
            if k < len(words):
                rank.setdefault(words[k], len(rank) + 1)
    return rank


def char_bits(value: str) -> float:
    """Bits of one character by brute force, from the kinds of characters in the value."""
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value):
        return 4.0
    pool = 26 * bool(re.search("[a-z]", value)) + 26 * bool(re.search("[A-Z]", value)) + 10 * bool(re.search("[0-9]", value)) + 33 * bool(re.search("[!-/:-@\\[-`{-~\x00-\x20]", value)) + 64 * (not value.isascii())
    return math.log2(max(pool, 10))


class Guesser:
    """Guess costs by a dictionary of ranked words."""

    #: Values whose costs are kept, and the longest of them.
    KEPT, KEPT_LENGTH = 10_000, 200

    def __init__(self, rank: dict[str, int]) -> None:
        self.rank = rank
        self.kept: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return {"rank": self.rank, "kept": {}}

    def word_bits(self, value: str, low: str, plain: str) -> float:
        """A word costs its rank, letters that stand out two bits more, capitals one."""
        cased = 0.0 if value == low else 1.0
        return min(CUT_BITS + math.log2(r + 1) + extra + cased if (r := self.rank.get(form)) else math.inf for form, extra in ((low, 0.0), (plain, 2.0)))

    def bits(self, value: str) -> float:
        """log2 of the guesses that the cheapest segmentation of a value needs."""
        got = self.kept.get(value)
        if got is None:
            got = self.cheapest(value)
            if len(value) <= self.KEPT_LENGTH:
                if len(self.kept) >= self.KEPT:
                    self.kept.clear()
                self.kept[value] = got
        return got

    def cheapest(self, value: str) -> float:
        n, one = len(value), char_bits(value)
        low = value.lower() if value.isascii() else "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
        plain = low.translate(PLAIN)
        best = [0.0] + [math.inf] * n
        walk = same = 1  # lengths of the keyboard walk and of the repeat that end here
        for j in range(1, n + 1):
            if j > 1:
                walk = walk + 1 if (low[j - 2], low[j - 1]) in NEXT else 1
                same = same + 1 if low[j - 1] == low[j - 2] else 1
            cost = best[j - 1] + one
            for k in LETTERS[: max(0, j - LETTERS.start + 1)]:
                i = j - k
                cost = min(cost, best[i] + self.word_bits(value[i:j], low[i:j], plain[i:j]))
            if low[j - 1].isdigit():
                for k in DATE_LENGTHS[: max(0, j - DATE_LENGTHS.start + 1)]:
                    if low[j - k].isdigit() and DATE.fullmatch(low, j - k, j):
                        cost = min(cost, best[j - k] + CUT_BITS + (7.0 if k == 4 else 15.5))
            for size, start in ((walk, 6.5), (same, one)):
                for k in {*range(3, min(size, PARTS) + 1), size} if size >= 3 else ():
                    cost = min(cost, best[j - k] + CUT_BITS + start + math.log2(k))
            for width in range(2, min(16, j // 2) + 1):  # a chunk that comes again right after itself
                if low[j - width : j] == low[j - 2 * width : j - width]:
                    cost = min(cost, best[j - width] + CUT_BITS + 1.0)
            best[j] = cost
        return best[n]

    def prose_bits(self, value: str) -> float:
        """`bits` of a value that nothing but blanks or "is" sets apart from its name: without both letters and digits it may
        be an ordinary word, and what is shaped like words costs no more than picking them."""
        if re.search("[0-9]", value) and re.search("[A-Za-z]", value):
            return self.named_bits(value)
        runs = RUNS.findall(value)
        words = [r for r in runs if word_like(r)]
        one = char_bits(value)
        picked = sum(min(WORD_BITS, len(r) * one) for r in words) + (sum(map(len, runs)) - sum(map(len, words))) * one
        return min(picked, self.named_bits(value))

    def named_bits(self, value: str) -> float:
        """`bits` of a value that is set apart from its name. The dictionary has few words beyond ASCII, so runs of other letters that
        are shaped like a word cost no more than picking one."""
        if value.isascii():
            return self.bits(value)
        words = [r for r in RUNS.findall(value) if not r.isascii() and word_like(r)]
        one = char_bits(value)
        return min(self.bits(value), sum(min(WORD_BITS, len(r) * one) for r in words) + (len(value) - sum(map(len, words))) * one)


def word_like(run: str) -> bool:
    """Small letters, capitals, or a capital and small letters. Vowels count where the script is known; scripts without capitals have no blanks between words either."""
    low = run.lower()
    if run[1:] not in (low[1:], run[1:].upper()):
        return False
    if not run.isascii():
        return low == run.upper() or len(run) <= LONG_LETTERS
    return len(run) <= WORD_LETTERS and 4 * sum(c in "aeiouy" for c in low) >= len(run) and not re.search("[^aeiouy]{5}", low)


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the fixed formats, leftmost and without overlap within a kind."""
    out = []
    low = text.lower()
    if any(c in low for c in ("passw", "secret", "token", "api")):
        out += [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    return out + [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text)]


def named_values(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whether more than blanks leads to it) of the values that credentials' names lead to.

    A value ends by the syntax that it stands in, and where the next name leads to a value of its own; so each character is looked at once.
    """
    cues = list(CONTEXT.finditer(text))
    for m, after in zip_longest(cues, cues[1:]):
        a, limit = m.end(), after.start() if after else len(text)
        apart = bool(SEPARATOR.search(text, m.start(), a)) or text[a] in "\"'`"
        opens = text[a : a + 2] if text[a : a + 2] in QUOTED else text[a]
        quoted = QUOTED[opens].match(text, a + len(opens), limit + len(opens)) if opens in QUOTED else None
        if quoted and quoted.end() <= limit:
            yield a + len(opens), quoted.end(), True
            continue
        a += len(opens) if opens in QUOTED else 0
        if bare := BARE.match(text, a, limit):
            b = a + len(text[a : bare.end()].rstrip(".,;:!?\"'`)]}>\\"))
            if b > a:
                yield a, b, apart


def value_spans(text: str, base: list[tuple[int, int, str, str]], min_bits: float, guesser: Guesser) -> list[tuple[int, int, str, str]]:
    """Values named as credentials whose guess cost is high, where no fixed format has been found."""
    low = text.lower()
    if not any(c in low for c in CUES):
        return []
    taken = sorted((a, b) for a, b, _, _ in base)
    starts, ends = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    out = []
    for a, b, apart in named_values(text):
        before = bisect_left(starts, b)
        if before and ends[before - 1] > a:
            continue
        value = text[a:b]
        if (guesser.named_bits if apart else guesser.prose_bits)(value) >= min_bits:
            out.append((a, b, "value", value))
    return out


def scan(text: str, guesser: Guesser, min_bits: float = MIN_BITS) -> tuple:
    base = base_spans(text)
    more = value_spans(text, base, min_bits, guesser)
    order = lambda s: (s[0], KINDS.index(s[2]))
    said = lambda spans: ",".join(f"{k}:{a}:{b}" for a, b, k, _ in sorted(spans, key=order))
    count = lambda kind: sum(s[2] == kind for s in base)
    bits = max((guesser.bits(s[3]) for s in base + more if s[2] in ("assign", "value")), default=0.0)
    return count("assign"), count("access"), count("hex"), hashlib.sha256(said(base).encode()).hexdigest(), said(base + more), len(more), bits


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bits: float = MIN_BITS, vocabularies: Sequence[str] = ()) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_value, max_bits) of every row.

    vocabularies: files of `dictionary`, read on the driver; what is broadcast is as large as they are.
    """
    fields = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_value", "max_bits"]
    ship_package(docs.sparkSession)
    guesser = docs.sparkSession.sparkContext.broadcast(Guesser(dictionary(vocabularies)))

    @F.pandas_udf("struct<n_assign:long,n_access:long,n_hex:long,base_sha256:string,spans:string,n_value:long,max_bits:double>")
    def found(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([scan(t, guesser.value, min_bits) for t in texts], columns=fields)

    return docs.select(F.col(id_col).alias("doc_id"), found(text_or_empty(text_col)).alias("s")).select("doc_id", "s.*")


def redacted(text: str, guesser: Guesser, mask: str = "[SECRET]", min_bits: float = MIN_BITS) -> str:
    """A text with all found spans masked."""
    base = base_spans(text)
    out, at = [], 0
    for a, b, _, _ in sorted(base + value_spans(text, base, min_bits, guesser)):
        if b > at:
            out += [text[at : max(a, at)], mask] if a >= at else []
            at = b
    return "".join(out) + text[at:]
