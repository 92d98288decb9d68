"""Personal data: overlapping candidates, boosted trees over format and context, calibrated selection; DataFrame operations only.

Fixed formats (email, ip, card, phone) are always reported. High-recall generators propose further spans, overlapping
as they come: windows over groups of digits, words with an at sign, spelt-out and spoken addresses, account numbers. Trees are boosted on
generated texts whose spans have known answers (`generated`): numbers of persons in many forms on one side, dates, prices, order
numbers, codes with wrong check digits and other look-alikes on the other, each with and without a cue word before it. None of
the answers is one of the fixed formats. The threshold is the lowest score at which `PRECISION` is held on the half of the generated
texts that no tree has seen. Of overlapping selected candidates the best score wins; what overlaps a fixed format adds nothing.

Positions come from the pieces between matches, so each text is scanned once for each pattern; running sums and extremes are taken in
two levels (`running`), so that time is linear in the number of matches. All patterns are linear in the text: runs
are possessive and entered only at their start or where the last match ended.

Defined results: a null text is the empty text; rows that repeat get the same result; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_or_empty, written

KINDS = ("email", "ip", "card", "phone", "other")
#: Generated texts that trees are boosted on; half of them are for the threshold.
GENERATED = 12_000
ROUNDS, DEPTH, RATE, RIDGE, LEAST_HESSIAN = 32, 4, 0.4, 1.0, 2.0
PRECISION = 0.98

LOCAL = "[A-Za-z0-9._%+-]"
# The formats of the contract. Possessive loops keep the Java matcher from recursing; nothing follows that could need a
# step back. `\G` lets a match begin right after the last one.
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Generators of further candidates.
#: Groups of digits, and what may stand between two of a number; a text without this many digits near each other has no number.
DIGITS, JOINT, SOME_NUMBER = "[0-9]++", r"^[().\x20/-]{1,3}$", r"[0-9](?:[().\x20/-]{0,3}[0-9]){6}"
#: Groups of the longest number; digits of the shortest and the longest.
GROUPS, LEAST_DIGITS, MOST_DIGITS = 5, 7, 19
AT_SIGN = r"(?<![^\s<>(),;:@])[^\s<>(),;:@]{1,64}+@[^\s<>(),;:@]{2,255}+"
SPELT = rf"(?<!{LOCAL}){LOCAL}++\x20?[\[({{]at[\])}}]\x20?[A-Za-z0-9-]++(?:\x20?(?:[\[({{]dot[\])}}]|\.)\x20?[A-Za-z0-9-]++)++"
SPOKEN = rf"(?i)(?<!{LOCAL})[A-Za-z0-9.+-]++(?:_[A-Za-z0-9.+-]++)*?(?:\x20at\x20|_AT_)[A-Za-z0-9-]++(?:(?:\x20dot\x20|_DOT_|\.)[A-Za-z0-9-]++)++"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
# What personal data and what other numbers are announced by.
LINK = r"(?:[^A-Za-z0-9]+(?:me|us|him|her|at|on|is|no|nr|number|under|to|via|my|our|the)){0,3}[^A-Za-z0-9]*$"
CUE = rf"(?i)\b(?:phones?|tel|telephone|call|mobile|cell|fax|text|e-?mail|mail|contact|reach|write|card|visa|iban|ssn|social security|account|acct|passport)\b{LINK}"
OTHER_CUE = rf"(?i)(?:\b(?:order|invoice|version|isbn|page|pages|pp|ref|item|sku|article|room|build|ticket|batch|lot|part|code|price|total|since|from|between|date|year|score|chapter|id)\b|[$\u20ac\u00a3#]){LINK}"
DATE = r"^(?:[0-9]{4}[-/. ][0-9]{1,2}[-/. ][0-9]{1,2}|[0-9]{1,2}[-/. ][0-9]{1,2}[-/. ][0-9]{4})(?![0-9])"

SPAN = "struct<start:int,stop:int,m:string,before:string,after:string>"
CONTEXT = 48
FEATURES = (
    "digits", "length", "letters", "at", "distinct", "luhn", "iban", "cue", "other_cue", "free_before", "free_after", "groups", "first", "last", "longest",
    "spaces", "dashes", "dots", "slashes", "brackets", "date", "book", "zero", "dotted_host", "thousands", "near_before", "near_after",
)
MOST = 32  # feature values above count as this
#: Elements over which a running value is taken at once.
PART = 128


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, zero: int, op: Callable[[Column, Column], Column]) -> Column:
    """For each element of an array of longs, `op` over all elements before it."""
    none = F.array().cast("array<bigint>")

    def scan(xs: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), none.alias("out"))
        return F.aggregate(xs, first, lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    start = F.lit(zero).cast("long")

    def joined_up(parts: Column) -> Column:
        before = scan(F.transform(parts, lambda q: F.aggregate(q, start, op)), start)
        return F.flatten(F.zip_with(parts, before, scan))

    def dealt(xs: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / PART).cast("int")), lambda k: F.slice(xs, k * PART + 1, F.lit(PART)))
        return F.when(F.size(xs) > 0, bound(parts, joined_up)).otherwise(none)

    return bound(values, dealt)


def located(text: Column, pattern: str, guard: Column) -> Column:
    """Matches of a pattern with their places in code points and the text around them."""
    none = F.array().cast("array<string>")
    found = F.when(guard, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)

    def spans(mp: Column) -> Column:
        """From matches, and pieces around them (one more)."""
        n = F.size(mp["m"])
        both = F.zip_with(mp["m"], F.slice(mp["p"], F.lit(1), n), lambda m, q: F.struct(m.alias("m"), q.alias("p")))
        ends = running(F.transform(both, lambda x: (F.char_length(x["p"]) + F.char_length(x["m"])).cast("long")), 0, lambda x, y: x + y)
        rows = F.zip_with(F.zip_with(both, ends, lambda x, e: F.struct(x["m"].alias("m"), x["p"].alias("p"), (e + F.char_length(x["p"])).cast("int").alias("at"))), F.slice(mp["p"], F.lit(2), n), lambda x, q: F.struct(x.alias("x"), q.alias("q")))
        return F.transform(rows, lambda r: F.struct(
            r["x"]["at"].alias("start"), (r["x"]["at"] + F.char_length(r["x"]["m"])).alias("stop"), r["x"]["m"].alias("m"),
            F.right(r["x"]["p"], F.lit(CONTEXT)).alias("before"), F.left(r["q"], F.lit(2)).alias("after"),
        ))

    # texts without a match are not split
    return bound(found, lambda m: F.when(F.size(m) > 0, bound(F.struct(m.alias("m"), F.split(text, pattern, -1).alias("p")), spans)).otherwise(F.array().cast(f"array<{SPAN}>")))


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a number is right."""
    total = F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, F.coalesce(c.try_cast("int"), F.lit(0))).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), F.coalesce(c.try_cast("int"), F.lit(0)) + 1))),
        F.lit(0), lambda a, x: a + x,
    )
    return total % 10 == 0


def quad(m: Column) -> Column:
    """Whether a string is four parts of digits up to 255."""
    return m.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])|0++)(?:\.(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])|0++)){3}$")


def base_formats(text: Column) -> dict[str, Column]:
    digit, at, plus = text.rlike("[0-9]"), F.contains(text, F.lit("@")), F.contains(text, F.lit("+"))
    n = lambda s: F.char_length(digits_of(s["m"]))
    return {
        "email": located(text, EMAIL, at),
        "ip": F.filter(located(text, IP, digit & text.rlike(r"[0-9]\.[0-9]")), lambda s: quad(s["m"])),
        "card": F.filter(located(text, CARD, digit & text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}")), lambda s: n(s).between(12, 19) & luhn(digits_of(s["m"]))),
        "phone": F.filter(located(text, PHONE, digit & plus), lambda s: n(s).between(9, 15)),
    }


def check97(m: Column) -> Column:
    """Whether an account number has the right check digits."""
    bare = F.upper(F.regexp_replace(m, "[^A-Za-z0-9]", ""))
    turned = F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4))
    value = lambda c: F.when(F.ascii(c) >= 65, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(F.pmod(acc * F.when(F.ascii(c) >= 65, 100).otherwise(10) + value(c), F.lit(97))))
    return bare.rlike("^[A-Z]{2}[0-9]{2}") & (rest == 1)


def features(s: Column) -> Column:
    m, d = s["m"], digits_of(s["m"])
    yes = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    count = lambda pattern: F.regexp_count(m, F.lit(pattern))
    groups = F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0))
    group = lambda k: F.coalesce(F.char_length(F.try_element_at(groups, F.lit(k))), F.lit(0))
    # in a list the cue stands before the first number
    lead = F.regexp_replace(s["before"], r"[0-9().\x20/,;+-]*[0-9][0-9().\x20/,;+-]*$", "")
    f = {
        "digits": F.char_length(d), "length": F.char_length(m), "letters": count("[A-Za-z]"), "at": yes(F.contains(m, F.lit("@"))) + 2 * yes(m.rlike(r"(?i)[\[({]at[\])}]")) + 4 * yes(m.rlike(r"(?i)(?:\x20|_)at(?:\x20|_)")) + 8 * yes(m.rlike(r"(?i)(?:\x20|_)dot(?:\x20|_)")),
        "distinct": F.size(F.array_distinct(F.split(d, ""))), "luhn": yes((F.char_length(d) >= 12) & luhn(d)), "iban": yes(check97(m)), "cue": yes(lead.rlike(CUE)), "other_cue": yes(lead.rlike(OTHER_CUE)),
        "free_before": yes(~s["before"].rlike("[A-Za-z0-9]$")), "free_after": yes(~s["after"].rlike("^[A-Za-z0-9]")), "groups": F.size(groups), "first": group(1), "last": group(-1),
        "longest": F.coalesce(F.array_max(F.transform(groups, lambda g: F.char_length(g))), F.lit(0)), "spaces": count(" "), "dashes": count("-"), "dots": count(r"\."), "slashes": count("/"), "brackets": count(r"[\[({]"), "date": yes(m.rlike(DATE)),
        "book": yes(m.rlike("^97[89]")), "zero": yes(m.rlike(r"^\(?0[1-9]")) + 2 * yes(m.startswith("00")), "dotted_host": yes(m.rlike(r"(?i)(?:\.|[\[({]dot[\])}])\x20?[A-Za-z]{2,}$")), "thousands": yes(m.rlike(r"^[0-9]{1,3}(?:[. ][0-9]{3})+$")),
        "near_before": yes(s["before"].rlike(r"[0-9][().\x20/-]{1,3}$")) + yes(s["before"].rlike(r"[0-9][()./-]{1,3}$")), "near_after": yes(s["after"].rlike(r"^[().\x20/-]{1,3}[0-9]")) + yes(s["after"].rlike(r"^[()./-]{1,3}[0-9]")),
    }
    return F.array(*[F.least(f[k], F.lit(MOST)).cast("int") for k in FEATURES])


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["stop"]) & (b["start"] < a["stop"])


def number_windows(text: Column, guard: Column) -> Column:
    """Every run of one to `GROUPS` groups of digits that could be a number, overlapping as they come, with the text around it.

    A list of numbers is one long run of groups, so where a number begins and ends is for the score to say.
    """
    none = F.array().cast("array<string>")
    span = "struct<start:int,stop:int,m:string,before:string,after:string>"
    found = F.when(guard, F.regexp_extract_all(text, F.lit(DIGITS), F.lit(0))).otherwise(none)

    def groups(mp: Column) -> Column:
        """(at, m, gap before it, gap after it) of each group."""
        n = F.size(mp["m"])
        both = F.zip_with(mp["m"], F.slice(mp["p"], F.lit(1), n), lambda m, q: F.struct(m.alias("m"), q.alias("gap")))
        ends = running(F.transform(both, lambda x: (F.char_length(x["gap"]) + F.char_length(x["m"])).cast("long")), 0, lambda x, y: x + y)
        rows = F.zip_with(both, ends, lambda x, e: F.struct((e + F.char_length(x["gap"])).cast("int").alias("at"), x["m"].alias("m"), x["gap"].alias("gap"), x["gap"].rlike(JOINT).alias("joint")))
        return F.zip_with(rows, F.slice(mp["p"], F.lit(2), n), lambda x, q: F.struct(x["at"].alias("at"), x["m"].alias("m"), x["gap"].alias("gap"), x["joint"].alias("joint"), q.alias("next")))

    def windows(gs: Column) -> Column:
        def of(g: Column, i: Column) -> Column:
            """Windows that begin at a group: (groups, digits) first, so that text is only put together for those that could be numbers."""
            near = F.slice(gs, i + 1, F.lit(GROUPS))
            sizes = F.aggregate(
                near, F.struct(F.lit(0).alias("n"), F.lit(0).alias("digits"), F.lit(True).alias("open"), F.array().cast("array<struct<n:int,digits:int>>").alias("out")),
                lambda acc, x: F.when(acc["open"] & ((acc["n"] == 0) | x["joint"]) & (acc["digits"] + F.char_length(x["m"]) <= MOST_DIGITS), F.struct(
                    (acc["n"] + 1).alias("n"), (acc["digits"] + F.char_length(x["m"])).alias("digits"), F.lit(True).alias("open"),
                    F.concat(acc["out"], F.array(F.struct((acc["n"] + 1).alias("n"), (acc["digits"] + F.char_length(x["m"])).alias("digits")))).alias("out"),
                )).otherwise(F.struct(acc["n"].alias("n"), acc["digits"].alias("digits"), F.lit(False).alias("open"), acc["out"].alias("out"))),
                lambda acc: F.filter(acc["out"], lambda w: w["digits"] >= LEAST_DIGITS),
            )
            lead = F.regexp_extract(g["gap"], r"(?:\+\(|\(\+|[(+])$", 0)
            back = F.transform(F.slice(gs, F.greatest(i - 4, F.lit(1)), F.least(i, F.lit(5))), lambda x: F.concat(x["gap"], x["m"]))
            context = F.concat(F.array_join(back, ""), F.substring(g["gap"], F.lit(1), F.char_length(g["gap"]) - F.char_length(lead)))

            def window(w: Column) -> Column:
                parts = F.slice(near, F.lit(1), w["n"])
                last, following = F.element_at(near, w["n"]), F.coalesce(F.try_element_at(gs, i + w["n"] + 1)["m"], F.lit(""))
                m = F.concat(lead, g["m"], F.array_join(F.transform(F.slice(parts, F.lit(2), w["n"] - 1), lambda x: F.concat(x["gap"], x["m"])), ""))
                return F.struct(
                    (g["at"] - F.char_length(lead)).cast("int").alias("start"), (last["at"] + F.char_length(last["m"])).cast("int").alias("stop"), m.alias("m"),
                    F.right(context, F.lit(CONTEXT)).alias("before"), F.left(F.concat(last["next"], following), F.lit(4)).alias("after"),
                ).cast(span)

            return F.when(F.size(sizes) > 0, F.transform(sizes, window)).otherwise(F.array().cast(f"array<{span}>"))

        every = F.flatten(F.transform(gs, of))
        return F.filter(every, lambda x: ~x["before"].rlike("[A-Za-z0-9]$") & ~x["after"].rlike("^[A-Za-z]"))

    return bound(found, lambda m: F.when(F.size(m) > 0, bound(F.struct(m.alias("m"), F.split(text, DIGITS, -1).alias("p")), lambda mp: bound(groups(mp), windows))).otherwise(F.array().cast(f"array<{SPAN}>")))


def proposed(text: Column) -> Column:
    """The spans of all generators, overlapping as they come."""
    at, digit = F.contains(text, F.lit("@")), text.rlike("[0-9]")
    spoken = text.rlike(r"(?i)(?:\x20at\x20|_AT_)[A-Za-z0-9-]++(?:\x20dot\x20|_DOT_|\.)")
    return F.concat(number_windows(text, digit & text.rlike(SOME_NUMBER)), located(text, AT_SIGN, at), located(text, SPELT, text.rlike(r"(?i)[\[({]at[\])}]")), located(text, SPOKEN, spoken), located(text, IBAN, digit))


def apart(base: Column, raw: Column) -> Column:
    """The spans of `raw` that overlap none of `base`, in order."""
    entry = f"struct<start:int,kind:int,s:{SPAN}>"
    as_base = F.transform(base, lambda b: F.struct(b["start"].alias("start"), F.lit(0).alias("kind"), F.struct(b["start"], b["stop"], F.lit(None).cast("string").alias("m"), F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("after")).alias("s")))
    as_raw = F.transform(raw, lambda r: F.struct(r["start"].alias("start"), F.lit(1).alias("kind"), r.alias("s")))
    every = F.array_sort(F.concat(as_base.cast(f"array<{entry}>"), as_raw.cast(f"array<{entry}>")))

    def sweep(xs: Column) -> Column:
        far = 1 << 40
        reach = running(F.transform(xs, lambda x: F.when(x["kind"] == 0, x["s"]["stop"]).otherwise(0).cast("long")), 0, lambda a, b: F.greatest(a, b))
        after = F.reverse(running(F.reverse(F.transform(xs, lambda x: F.when(x["kind"] == 0, x["start"].cast("long")).otherwise(F.lit(far)))), far, lambda a, b: F.least(a, b)))
        both = F.zip_with(F.zip_with(xs, reach, lambda x, r: F.struct(x.alias("x"), r.alias("r"))), after, lambda y, n: F.struct(y["x"].alias("x"), ((y["r"] <= y["x"]["start"]) & (n >= y["x"]["s"]["stop"])).alias("free")))
        return F.transform(F.filter(both, lambda y: (y["x"]["kind"] == 1) & y["free"]), lambda y: y["x"]["s"])

    return F.when(F.size(raw) > 0, bound(every, sweep)).otherwise(F.array().cast(f"array<{SPAN}>"))


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Written table: id, spans of each fixed format, further candidates with features; texts are scanned here only."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = rows.select("doc_id", *[c.alias(k) for k, c in base_formats(F.col("text")).items()], proposed(F.col("text")).alias("raw"))
    bases = {k: F.transform(k, lambda s: F.struct(s["start"], s["stop"])).alias(k) for k in KINDS[:4]}
    rows = rows.select("doc_id", *bases.values(), "raw")
    rows = rows.select("doc_id", *KINDS[:4], apart(F.concat(*[F.col(k) for k in KINDS[:4]]), F.col("raw")).alias("raw"))
    return written(rows.select("doc_id", *KINDS[:4], F.transform("raw", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), features(s).alias("f"))).alias("raw")), "pii")


# Words between and before generated spans.
FILLER = ("we", "met", "people", "there", "and", "some", "came", "later", "with", "green", "tables", "then", "they", "left", "it", "was", "quiet", "again", "near", "houses")
CUES = ("call", "phone:", "tel.", "mobile", "reach me at", "contact", "fax", "call us on", "my number is", "text")
MAIL_CUES = ("write to", "e-mail:", "mail", "contact", "reach us at")
ACCOUNT_CUES = ("iban", "account", "card no", "ssn", "passport", "IBAN:")
OTHER_CUES = ("order", "invoice", "version", "pages", "ref.", "item", "since", "from", "id", "build", "total", "room")
HOSTS = ("example", "mail", "posteo", "uni-town", "web")
ENDS = ("com", "org", "net", "de", "fr", "info")
NAMES = ("jo", "anna", "j.smith", "peter_k", "m-lee", "info", "sales", "maria.g")


def generated(spark: SparkSession, n: int = GENERATED) -> DataFrame:
    """(spot, text, start, stop, y): a text with a span each, and whether the span is personal."""
    number = lambda salt, digits: F.lpad(F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(10**digits)).cast("string"), digits, "0")
    pick = lambda salt, of: F.element_at(F.array(*map(F.lit, of)), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(of))) + 1).cast("int"))
    within = lambda salt, lo, hi, width: F.lpad((F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(hi - lo + 1)) + lo).cast("string"), width, "0")
    chance = lambda salt, percent: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(100)) < percent
    put = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    area, three, four, six, eight = put(within(1, 2, 9, 1), number(2, 2)), number(3, 3), number(4, 4), number(5, 6), number(6, 8)
    year, month, day = within(7, 1900, 2035, 4), within(8, 1, 12, 2), within(9, 1, 28, 2)
    bban, country = number(10, 18), pick(11, ("DE", "FR", "ES", "NL", "PL", "IT"))
    code = F.concat((F.ascii(country) - 55).cast("string"), (F.ascii(F.substring(country, 2, 1)) - 55).cast("string"))
    check = F.lpad((F.lit(98) - F.pmod(F.concat(bban, code, F.lit("00")).cast("decimal(38,0)"), F.lit(97).cast("decimal(38,0)")).cast("int")).cast("string"), 2, "0")
    wrong = F.lpad(F.pmod(check.cast("int") + 1 + F.pmod(F.xxhash64("id", F.lit(12)), F.lit(90)), F.lit(97)).cast("string"), 2, "0")
    fours = lambda x, sep: F.regexp_replace(x, r"(.{4})(?=.)", F.lit(f"$1{sep}"))
    body = put("4", number(13, 14))
    card = F.concat(body, F.element_at(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: k.cast("string")), lambda k: luhn(F.concat(body, k))), 1))
    no_card = F.concat(body, F.element_at(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: k.cast("string")), lambda k: ~luhn(F.concat(body, k))), 1))
    name, host, end = pick(14, NAMES), pick(15, HOSTS), pick(16, ENDS)
    phone, ordered = F.when(chance(20, 60), pick(21, CUES)).otherwise(F.lit("")), pick(23, OTHER_CUES)
    mail, account = (F.when(chance(24, 50), pick(25, of)).otherwise(F.lit("")) for of in (MAIL_CUES, ACCOUNT_CUES))
    other = F.when(chance(26, 40), pick(27, OTHER_CUES)).when(chance(28, 25), pick(29, CUES)).otherwise(F.lit(""))
    no_cue = F.when(chance(30, 50), pick(31, OTHER_CUES)).otherwise(F.lit(""))
    asked, asked_account, none = pick(32, CUES), pick(33, ACCOUNT_CUES), F.lit("")
    kinds: list[tuple[int, Column, Column]] = [
        (1, phone, put("(", area, ") ", three, "-", four)), (1, phone, put(area, "-", three, "-", four)), (1, phone, put(area, ".", three, ".", four)), (1, phone, put(area, " ", three, " ", four)),
        (1, phone, put("0", area, " ", six)), (1, phone, put("00", within(34, 30, 49, 2), " ", area, " ", six)), (1, phone, put("(0", area, ") ", three, " ", four)), (1, phone, put("0", area, "/", six)), (1, asked, put("0", area, eight)), (1, asked, put(area, six)), (1, asked, put(three, "-", four)),
        (1, mail, put(name, " [at] ", host, " [dot] ", end)), (1, mail, put(name, "(at)", host, ".", end)), (1, mail, put(name, " (at) ", host, "(dot)", end)), (1, mail, put(name, "{at}", host, ".", end)), (1, mail, put(name, "\u00fc@", host, "\u00e9.", end)),
        (1, account, put(country, check, bban)), (1, account, fours(put(country, check, bban), " ")), (1, asked_account, put(within(35, 100, 665, 3), "-", within(36, 10, 99, 2), "-", four)), (1, account, put(within(35, 100, 665, 3), "-", within(36, 10, 99, 2), "-", four)), (1, account, fours(card, ".")), (1, account, fours(card, "/")),
        (0, other, put(year, "-", month, "-", day)), (0, other, put(day, "/", month, "/", year)), (0, other, put(day, ".", month, ".", year)), (0, other, put(year, ".", month, ".", day)), (0, other, put(year, month, day)), (0, other, put(day, "-", month, "-", year)),
        (0, no_cue, number(37, 7)), (0, no_cue, number(38, 9)), (0, no_cue, number(39, 11)), (0, no_cue, number(40, 14)), (0, no_cue, eight), (0, other, no_card), (0, other, fours(no_card, " ")), (0, no_cue, fours(no_card, ".")),
        (0, other, put(year, "-", within(41, 1900, 2035, 4))), (0, other, put(three, "-", within(42, 100, 999, 3))), (0, other, put(within(43, 1, 999, 1), ".", three, ".", number(44, 3))), (0, other, put(within(43, 1, 999, 1), " ", three, " ", number(44, 3))),
        (0, other, put("978-", within(45, 0, 9, 1), "-", number(46, 2), "-", six, "-", within(47, 0, 9, 1))), (0, other, put("978", number(48, 10))), (0, other, put(within(49, 0, 89, 1), ".", four, " ", within(50, 0, 89, 1), ".", number(51, 4))), (0, other, put(within(52, 0, 9, 1), "-", within(53, 0, 9, 1), " ", within(54, 0, 9, 1), "-", within(55, 0, 9, 1), " ", within(56, 0, 9, 1), "-", within(57, 0, 9, 1))),
        (0, other, put(within(58, 1, 40, 1), ".", within(59, 0, 40, 1), ".", within(60, 0, 40, 1), "-", number(61, 3))), (0, no_cue, put(number(62, 4), "-", number(63, 4), "-", number(64, 4))), (0, no_cue, put(number(65, 2), "-", number(66, 5), "-", number(67, 3))),
        (0, account, put(country, wrong, bban)), (0, account, fours(put(country, wrong, bban), " ")), (0, no_cue, put(pick(68, ("AB", "XT", "QR", "SN", "PN")), number(69, 2), " ", four, " ", number(70, 4))),
        (0, ordered, put("(", area, ") ", three, "-", four)), (0, ordered, put(area, "-", three, "-", four)), (0, ordered, put(area, ".", three, ".", four)), (0, ordered, put("0", area, "/", six)), (0, ordered, put("0", area, " ", six)),
        (1, phone, put("0", within(80, 1, 9, 1), " ", four, " ", number(81, 4))), (1, phone, put("+", within(82, 30, 49, 2), " ", area, " ", three, " ", four, "/", number(83, 2))),
        (1, mail, put(name, " at ", host, " dot ", end)), (1, mail, put(name, "_AT_", host, ".", end)), (1, none, put(name, " at ", host, " dot ", end)),
        (0, none, put(pick(84, FILLER), " at ", pick(85, FILLER), ".", pick(86, ("Then", "But", "And", "So")))), (0, mail, put(pick(87, FILLER), " at ", host, ".", end)), (0, none, put(pick(88, FILLER), " at ", pick(89, FILLER), ".", pick(79, FILLER))),
        (0, none, put(pick(71, FILLER), " (at) ", pick(72, FILLER), ".", pick(73, ("Then", "But", "And", "So")))), (0, mail, put(pick(74, FILLER), "@", pick(75, FILLER))), (0, none, put(number(76, 2), "@", number(77, 2))), (0, none, put(pick(78, FILLER), "(at)", number(79, 1), ".", number(80, 2))),
    ]
    which = F.pmod(F.col("id"), F.lit(len(kinds))).cast("int") + 1
    at = lambda part: F.element_at(F.array(*part), which)
    words = lambda salt: F.concat_ws(" ", pick(salt, FILLER), pick(salt + 1, FILLER), pick(salt + 2, FILLER))
    rows = spark.range(n).select("id", at([F.lit(y) for y, _, _ in kinds]).alias("y"), at([c for _, c, _ in kinds]).alias("cue"), at([x for _, _, x in kinds]).alias("span"))
    # more than half stand in a list with another of their form, which comes before or after or both
    another = F.translate("span", "0123456789", "3456789012")
    side = F.pmod(F.xxhash64("id", F.lit(98)), F.lit(5))
    apart_by = F.element_at(F.array(*map(F.lit, (" ", " ", ", ", " / "))), (F.pmod(F.xxhash64("id", F.lit(97)), F.lit(4)) + 1).cast("int"))
    lead = F.concat(F.concat_ws(" ", words(90), F.when(F.col("cue") != "", F.col("cue"))), F.lit(" "), F.when(side.isin(0, 2), F.concat(another, apart_by)).otherwise(F.lit("")))
    rows = rows.withColumn("lead", lead)
    end = F.element_at(F.array(*map(F.lit, (" ", ". ", ", ", "; "))), (F.pmod(F.xxhash64("id", F.lit(99)), F.lit(4)) + 1).cast("int"))
    end = F.concat(F.when(side.isin(1, 2), F.concat(apart_by, another)).otherwise(F.lit("")), end)
    start = F.char_length("lead")
    return rows.select(F.xxhash64("id", F.lit(100)).alias("spot"), F.concat("lead", "span", end, words(95)).alias("text"), start.alias("start"), (start + F.char_length("span")).alias("stop"), "y")


def labelled(spark: SparkSession, n: int = GENERATED) -> DataFrame:
    """(half, f, y): the candidates in generated texts that meet the span, positive where they are a personal span whole.

    A candidate of the answer's kind that takes in a blank or a bracket more or less is left open.
    """
    # written, or every mention of a text would make it anew; and not `explode`, for which the optimizer would add a filter that finds the candidates again
    rows = written(generated(spark, n), "generated").withColumn("c", F.explode_outer(proposed(F.col("text"))))
    c, answer = F.col("c"), F.struct("start", "stop")
    inside = F.least(c["stop"], F.col("stop")) - F.greatest(c["start"], F.col("start"))
    whole = (inside * 10 >= 9 * (F.col("stop") - F.col("start"))) & (inside * 10 >= 9 * (c["stop"] - c["start"]))
    y = F.when((F.col("y") == 1) & whole, 1).when((F.col("y") == 1) & (inside * 10 >= 7 * (F.col("stop") - F.col("start"))), None).otherwise(0)
    return rows.where(overlaps(c, answer)).select((F.col("spot") % 2 == 0).alias("half"), features(c).alias("f"), y.alias("y")).where("y is not null")


@dataclass
class Split:
    """Below the cut or not; each side is a value or another split."""

    feature: int
    cut: int
    low: Split | float
    high: Split | float

    def column(self, f: Column) -> Column:
        side = lambda s: s.column(f) if isinstance(s, Split) else F.lit(float(s))
        return F.when(f[self.feature] < self.cut, side(self.low)).otherwise(side(self.high))

    def values(self, x: np.ndarray) -> np.ndarray:
        low, high = (s.values(x) if isinstance(s, Split) else np.full(len(x), s) for s in (self.low, self.high))
        return np.where(x[:, self.feature] < self.cut, low, high)


@dataclass
class Boosted:
    trees: list[Split]
    bias: float
    threshold: float

    def score(self, f: Column) -> Column:
        z = F.lit(self.bias)
        for t in self.trees:
            z = z + t.column(f) * RATE
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + RATE * sum((t.values(x) for t in self.trees), np.zeros(len(x))))))


def grown(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> Split | float:
    """The tree of the best gains over rows with gradients g and second derivatives h."""
    value = round(float(-g.sum() / (h.sum() + RIDGE)), 9)
    if not depth:
        return value
    gt, ht, best = g.sum(), h.sum(), (1e-6, -1, 0)
    for k in range(x.shape[1]):
        gl = np.cumsum(np.bincount(x[:, k], g, MOST + 1))[:-1]
        hl = np.cumsum(np.bincount(x[:, k], h, MOST + 1))[:-1]
        gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
        gain[(hl < LEAST_HESSIAN) | (ht - hl < LEAST_HESSIAN)] = 0
        cut = int(np.argmax(gain))
        if gain[cut] > best[0] + 1e-9:
            best = gain[cut], k, cut + 1
    _, k, cut = best
    if k < 0:
        return value
    low = x[:, k] < cut
    return Split(k, cut, grown(x[low], g[low], h[low], depth - 1), grown(x[~low], g[~low], h[~low], depth - 1))


def boost(sample: DataFrame) -> Boosted | None:
    """Trees from (half, f, y); what reaches the driver is bounded by the number of generated texts. None if one label is missing."""
    rows = sorted((bool(r["half"]), list(r["f"]), r["y"]) for r in sample.collect())
    train, test = ([(f, y) for half, f, y in rows if half == side] for side in (True, False))
    x, y = np.array([f for f, _ in train], np.int64).reshape(-1, len(FEATURES)), np.array([y for _, y in train], float)
    if not 0 < y.sum() < len(y):
        return None
    model = Boosted([], math.log(y.sum() / (len(y) - y.sum())), 2.0)
    for _ in range(ROUNDS):
        p = model.scores(x)
        tree = grown(x, p - y, p * (1 - p), DEPTH)
        if not isinstance(tree, Split):
            break
        model.trees.append(tree)
    scores = np.round(model.scores(np.array([f for f, _ in test], np.int64).reshape(-1, len(FEATURES))), 3)
    hits = total = 0
    for s in sorted(set(scores.tolist()), reverse=True):
        at = scores == s
        hits, total = hits + sum(t[1] for t, here in zip(test, at, strict=True) if here), total + int(at.sum())
        if s >= 0.5 and hits >= PRECISION * total:
            model.threshold = s - 0.0005
    return model


_MODELS: dict[int, Boosted | None] = {}


def trained(spark: SparkSession, n: int = GENERATED) -> Boosted | None:
    """The model from `n` generated texts. They are the same every time, so it is boosted once in a driver's life."""
    if n not in _MODELS:
        _MODELS[n] = boost(labelled(spark, n))
    return _MODELS[n]


def joined(spans: Column) -> Column:
    """kind:start:stop in order of start and kind, comma-joined. spans: array of (start, kind number, stop)."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def chosen(model: Boosted, raw: Column) -> Column:
    """Candidates at or above the threshold that don't overlap a better one. raw: in order of start."""
    entry = "struct<minus:double,start:int,stop:int>"
    none = F.array().cast(f"array<{entry}>")
    scored = F.transform(raw, lambda s: F.struct((-model.score(s["f"])).alias("minus"), s["start"].alias("start"), s["stop"].alias("stop")))
    good = F.filter(scored, lambda s: -s["minus"] >= model.threshold)

    def best(xs: Column) -> Column:
        return F.aggregate(F.array_sort(xs), none, lambda acc, s: F.when(F.exists(acc, lambda b: overlaps(b, s)), acc).otherwise(F.concat(acc, F.array(s))))

    def by_island(xs: Column) -> Column:
        """Only spans between two places that no span covers can overlap."""
        reach = running(F.transform(xs, lambda s: s["stop"].cast("long")), 0, lambda a, b: F.greatest(a, b))
        open_ = F.filter(F.transform(F.zip_with(xs, reach, lambda s, r: s["start"] >= r), lambda new, i: F.when(new, i + 1)), lambda i: i.isNotNull())
        closed = F.concat(F.slice(open_, F.lit(2), F.size(open_)), F.array(F.size(xs) + 1))
        return F.flatten(F.zip_with(open_, closed, lambda a, b: best(F.slice(xs, a, b - a))))

    return bound(good, lambda xs: F.when(F.size(xs) > 1, by_island(xs)).otherwise(xs))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_other) of every row."""
    rows = candidates(docs, id_col, text_col)
    model = trained(docs.sparkSession)
    span = lambda kind: lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["stop"].alias("stop"))
    base = F.concat(*[F.transform(k, span(i)) for i, k in enumerate(KINDS[:4])])
    rows = rows.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:4]], base.alias("base"), "raw")
    none = F.array().cast("array<struct<minus:double,start:int,stop:int>>")
    more = chosen(model, F.col("raw")) if model else none
    rows = rows.withColumn("more", F.when(F.size("raw") > 0, more).otherwise(none))
    return rows.select(
        "doc_id", *[f"n_{k}" for k in KINDS[:4]], F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat(F.col("base"), F.transform("more", span(4)))).alias("spans"), F.size("more").cast("long").alias("n_other"),
    )
