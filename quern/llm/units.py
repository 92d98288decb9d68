"""Token ids of many short pieces of text at once, for vocabularies that tokenizers keeps in JSON.

A unit is a piece of text that no token spans: what lies between white space. A batch of texts has far fewer different units than
units, so each is encoded once a batch. Units of settled characters (their class, lower case and composition are the same in all
releases of Unicode that a library may have) are merged by rank, all in one call; any other unit goes through the vocabulary's own
library. Both give the library's ids; tests hold them against each other.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator, Sequence

import numpy as np
import regex

#: Ends a piece of a unit in vocabularies with word ends, and parts units. Units that have them go through the library.
END, PART = "\x00", "\x01"
#: Characters that are not settled; where units are split at all white space, that isn't either.
UNSETTLED = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\xa0̀-\U0010ffff]")
UNSETTLED_WORD = re.compile("[\x00-\x20\x7f-\xa0İ̀-\U0010ffff]")
#: Characters of texts that are worked on together.
TOGETHER = 6_000_000


def by_size(texts: Sequence[str], most: int = TOGETHER) -> Iterator[slice]:
    """Slices of a batch of at most `most` characters each, or of one text."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most:
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def byte_letters() -> dict[str, int]:
    """The byte for which each letter of a byte-level vocabulary stands: printable ones for themselves, the others in order from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Units:
    """A byte-level BPE vocabulary in JSON, with or without word ends."""

    def __init__(self, model: str, special_as_text: bool = False) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share the machine already
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(model)
        self.library.encode_special_tokens = special_as_text
        said = json.loads(model)
        bpe, letter = said["model"], byte_letters()
        suffix = bpe.get("end_of_word_suffix") or ""
        names = {t["content"] for t in said["added_tokens"]}
        self.special = set() if special_as_text else names

        def spelt(token: str) -> bytes:
            ends = bool(suffix) and token.endswith(suffix)
            return bytes(letter[c] for c in (token.removesuffix(suffix) if ends else token)) + END.encode() * ends

        ranks = {spelt(t): i for t, i in bpe["vocab"].items() if t not in names}
        #: The bytes of each id; those of a word end are not among them.
        self.bytes = {i: b.removesuffix(END.encode()) if suffix else b for b, i in ranks.items()}
        made = [ranks.get(b"".join(map(spelt, m if isinstance(m, list) else m.split(" ")))) for m in bpe["merges"]]
        #: Merging by id is merging by rank only where ids follow the order of merges.
        self.in_order = None not in made and all(a < b for a, b in zip(made, made[1:]))
        self.lowers = self.pieces = None
        if suffix:
            self.lowers = any(n["type"] == "Lowercase" for n in said["normalizer"]["normalizers"])
            split = said["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
            self.pieces = regex.compile(split.replace(r"[^\s\p{L}\p{N}]", rf"[^\s\p{{L}}\p{{N}}{PART}]"))
            pattern = f"[^{END}{PART}]*{END}|{PART}"
        else:  # how byte-level vocabularies are split; PART is a piece of its own and ends white space like the end of a text
            pattern = rf"{PART}|'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^\s\p{{L}}\p{{N}}{PART}]+|\s+(?![^\s{PART}])|\s+"
        self.unsettled = UNSETTLED_WORD if suffix else UNSETTLED
        self.part = ranks[PART.encode()]
        self.ranked = tiktoken.Encoding("units", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def settled(self, unit: str) -> bool:
        return not self.unsettled.search(unit) and not any(s in unit for s in self.special)

    def by_rank(self, units: Sequence[str], lead: str) -> tuple[np.ndarray, np.ndarray]:
        """All units are settled."""
        text = lead + (PART + lead).join(units)
        if self.pieces is not None:
            text = self.pieces.sub(rf"\g<0>{END}", text.lower() if self.lowers else text)
        got = self.ranked.encode_to_numpy(text)
        ends = np.flatnonzero(got == self.part)
        return got[got != self.part].astype(np.int64), np.diff(np.concatenate([[-1], ends, [len(got)]])) - 1

    def encode(self, units: Sequence[str], lead: str = "") -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units, one after another, and how many each has. lead: what stands before each of them."""
        if not units:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ranked = np.array([self.in_order and self.settled(u) for u in units])
        if ranked.all():
            return self.by_rank(units, lead)
        others = [self.library.encode(lead + u, add_special_tokens=False).ids for u, r in zip(units, ranked) if not r]
        n = np.zeros(len(units), np.int64)
        n[~ranked] = [len(x) for x in others]
        ids = np.zeros(0, np.int64)
        if ranked.any():
            ids, n[ranked] = self.by_rank([u for u, r in zip(units, ranked) if r], lead)
        out, mine = np.zeros(n.sum(), np.int64), np.repeat(ranked, n)
        out[mine] = ids
        out[~mine] = [i for x in others for i in x]
        return out, n
