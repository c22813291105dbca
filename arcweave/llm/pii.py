"""Personal data: candidate spans, boosted trees over format and context, calibrated thresholds.

Only SQL expressions run over the documents.  Generators propose spans (start
and end in code points): four base kinds, whose fixed checks decide, and two
open kinds of high recall, `secret` (long tokens with a digit, values after
words such as password) and `id` (groups of digits).  Each open candidate gets
features of its format and of the text before it; gradient-boosted trees, as
nested CASE expressions, give its log-odds, and the kind's calibrated threshold
decides.  A candidate that lies wholly inside a base span is not repeated.

The trees are fitted once per driver process on a generated table of about a
thousand labelled candidates, whose features come from the same expressions.

Spans of a kind are the leftmost non-overlapping matches: the text is split at
them, and the running lengths of the pieces give the places.  Patterns are
possessive and begin at the edge of a run, running sums and maxima go by blocks,
and no expression looks up a place by walking the whole text: time is linear in
the text and its spans.

Null or empty text: no spans, the hash of no bytes.  Texts of any length are
read whole.  Repeated rows and ties get equal results; empty table: no rows.
Other columns are kept, whatever their names, by redact(), and not read by find().
"""

from __future__ import annotations

import json
import random
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.llm import gbt
from arcweave.llm.common import id_text

KINDS = ("email", "ip", "card", "phone", "secret", "id")
#: Each kind's pattern.  email: a run of local characters that begins where no such character is before it, or right after a match.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"(?i)(?<=[=:\"' ])(?<=(?:password|passwd|pwd|token|secret|api_key|apikey|key)[ ]?[=:][ ]?[\"']?)[^\s\"'=:]{6,}+|(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*+[0-9])[A-Za-z0-9_/+-]{16,}+",
    "id": r"(?<![A-Za-z0-9.,])(?:[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}+[A-Z0-9]{0,3}+|[0-9]{2,12}+(?![A-Za-z0-9])(?:[-/. ][0-9]{2,12}+(?![A-Za-z0-9])){0,4}+)(?![A-Za-z0-9])",
}
#: A cheap test that every text with a match passes.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]{2}|[0-9][ -][0-9]", "phone": r"\+[0-9]", "secret": r"[0-9]|[=:]", "id": r"[0-9]{2}"}
FEATURES = ("length", "digits", "upper", "lower", "other", "hex", "letters_mixed", "changes", "said_secret", "said_id", "assigned", "plus")
PRECISION = 0.98


def digits_of(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check sum of a string of digits is a multiple of ten."""

    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step) % 10 == 0


def passes(kind: str, hit: Column) -> Column:
    """The fixed check of a base kind."""
    if kind == "ip":
        parts = F.transform(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.lpad(p, 3, "0") <= "255"))
    if kind == "card":
        digits = digits_of(hit)
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits_of(hit)).between(9, 15)
    return F.lit(True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is evaluated once, however often the body names it, also within lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, merge: Callable[[Column, Column], Column], block: int = 128, levels: int = 2) -> Column:
    """Running results, from 0, of an associative function over an array of int.

    Accumulating an array copies it at each step, so this is done within blocks
    and over the blocks' results: linear in the array up to block ** 3 values.
    """
    ints = "array<int>"

    def short(array: Column) -> Column:
        start = F.struct(F.lit(0).alias("last"), F.array().cast(ints).alias("out"))

        def step(acc: Column, x: Column) -> Column:
            return let(merge(acc["last"], x), lambda y: F.struct(y.alias("last"), F.concat(acc["out"], F.array(y)).alias("out")))

        return F.aggregate(array, start, step, lambda acc: acc["out"])

    def long(array: Column, left: int) -> Column:
        if left == 1:
            return short(array)

        def cut(whole: Column) -> Column:
            return F.transform(F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / block).cast("int")), lambda i: short(F.slice(whole, i * block + 1, F.lit(block))))

        def joined(inner: Column) -> Column:
            totals = long(F.transform(inner, lambda b: F.element_at(b, -1)), left - 1)
            return let(totals, lambda t: F.flatten(F.transform(inner, lambda b, i: F.when(i == 0, b).otherwise(let(F.get(t, i - 1), lambda first: F.transform(b, lambda x: merge(first, x)))))))

        return let(array, lambda whole: F.when(F.size(whole) <= block, short(whole)).otherwise(let(cut(whole), joined)))

    return long(values, levels)


MATCH = "array<struct<start:int,end:int,hit:string,before:string>>"


def matches(text: Column, kind: str) -> Column:
    """array of (start, end, hit, before) of the kind's matches; before: up to 32 characters from the match before it to this one."""
    pattern = PATTERNS[kind]

    def placed(m: Column) -> Column:
        hits, pieces = m["hits"], m["pieces"]
        lengths = F.transform(hits, lambda h, i: F.length(F.get(pieces, i)) + F.length(h))

        def before(i: Column) -> Column:
            if kind in KINDS[:4]:
                return F.lit("")
            return F.right(F.concat(F.coalesce(F.right(F.get(hits, i - 1), F.lit(32)), F.lit("")), F.right(F.get(pieces, i), F.lit(32))), F.lit(32))

        return let(running(lengths, lambda a, b: a + b), lambda ends: F.transform(hits, lambda h, i: F.struct((F.get(ends, i) - F.length(h)).alias("start"), F.get(ends, i).alias("end"), h.alias("hit"), before(i).alias("before"))))

    found = let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("pieces")), lambda m: F.when(F.size(m["hits"]) > 0, placed(m)).otherwise(F.array().cast(MATCH)))
    return F.when(text.rlike(HINTS[kind]), found).otherwise(F.array().cast(MATCH))


def features(hit: Column, before: Column) -> list[Column]:
    """The features of a candidate and of the characters before it, in the order of FEATURES."""
    count = lambda p: F.length(F.regexp_replace(hit, p, "")).cast("double")
    flag = lambda c: c.cast("double")
    near = F.lower(before)
    n = F.length(hit).cast("double")
    return [
        n, count("[^0-9]") / n, count("[^A-Z]") / n, count("[^a-z]") / n, count("[A-Za-z0-9]") / n,
        flag(hit.rlike("^[0-9a-fA-F]+$")), flag(hit.rlike("[A-Z]") & hit.rlike("[a-z]")), F.length(F.regexp_replace(hit, "([0-9]+|[A-Z]+|[a-z]+)", "x")) / n,
        flag(near.rlike("(password|passwd|pwd|token|secret|key|auth)[^a-z]{0,5}$")), flag(near.rlike("(ssn|social security|iban|account|passport|tel|phone|call|fax|mobile|dob|born)[^0-9]{0,8}$")),
        flag(near.rlike("[=:] ?[\"']?$")), flag(near.rlike("[+(]$")),
    ]


def labelled(n: int = 150) -> list[dict]:
    """Generated candidates: kind, hit, before, y."""
    r = random.Random(7)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    hexes, digits, upper, lower = "0123456789abcdef", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = ("the order of", "and in", "le numéro", "see section", "since", "der Wert", "about", "version", "chapter")
    out = []
    for i in range(n):
        plain = r.choice(words) + " "
        secrets = [
            (pick(hexes, r.choice((18, 20, 24, 32, 40, 64))), f'{plain}{r.choice(("token", "secret", "api_key", "key"))} = "'), (pick(hexes, r.choice((16, 18, 20))), f"{plain}password="),
            ("AKIA" + pick(upper + digits, 16), plain), (pick(upper + lower + digits, r.choice((24, 32, 40))), plain), (pick(hexes, r.choice((32, 40, 64))), plain),
            (f"ghp_{pick(upper + lower + digits, 36)}", plain), (pick(lower + digits, r.randrange(8, 16)), f"{plain}password: "),
        ]
        harmless = [
            (f"{pick(lower, r.randrange(12, 24))}{r.randrange(1, 100)}", plain), (f"{pick(lower, 6)}-{pick(lower, 7)}-{r.randrange(1900, 2030)}", plain), (f"{pick(lower, 8)}_{pick(lower, 6)}_{r.randrange(10)}", plain),
            (pick(digits, r.randrange(16, 24)), plain), (f"{pick(lower, 9)}/{pick(lower, 8)}/{r.randrange(100)}", plain), (pick(lower, r.randrange(6, 14)), f"{plain}{r.choice(('key', 'token'))}: "),
        ]
        said = f"{plain}{r.choice(('SSN', 'IBAN', 'account', 'tel.', 'phone', 'call', 'passport'))}{r.choice((' ', ': ', ' no. '))}"
        ids = [(f"{pick(digits, 3)}-{pick(digits, 2)}-{pick(digits, 4)}", r.choice((plain, said))), (f"{pick(upper, 2)}{pick(digits, 2)} " + " ".join(pick(digits, 4) for _ in range(4)), r.choice((plain, said))), (f"{pick(digits, 3)}-{pick(digits, 3)}-{pick(digits, 4)}", said), (pick(digits, r.randrange(7, 13)), said), (f"{pick(digits, r.randrange(3, 6))}{r.choice('-/ ')}{pick(digits, r.randrange(6, 9))}", said)]
        other = [(f"{r.randrange(1900, 2030)}-{r.randrange(10, 99)}", plain), (f"{pick(digits, 2)}.{pick(digits, 2)}", plain), (f"{r.randrange(10, 32)}/{r.randrange(10, 13)}/{r.randrange(1900, 2030)}", plain), (f"{pick(digits, 3)} {pick(digits, 3)}", plain), (f"{pick(digits, 2)}.{pick(digits, 2)}.{pick(digits, 2)}", plain), (pick(digits, r.randrange(6, 13)), plain), (f"{pick(digits, r.randrange(2, 6))} {pick(digits, r.randrange(6, 9))}", plain)]
        for kind, y, found in (("secret", 1, secrets), ("secret", 0, harmless), ("id", 1, ids), ("id", 0, other)):
            out += [{"kind": kind, "hit": h, "before": b, "y": y} for h, b in found]
    return out


_FITTED: dict[str, tuple[gbt.Trees, float]] = {}


def fitted(spark: SparkSession) -> dict[str, tuple[gbt.Trees, float]]:
    """The trees and the threshold (as log-odds) of each open kind, fitted once per process.

    Every third candidate is held out: Platt's scaling on those gives
    probabilities, and the threshold is the lowest of 0.5 and above at which
    the held-out precision reaches PRECISION.
    """
    if not _FITTED:
        made = F.from_json(F.lit(json.dumps(labelled())), "array<struct<kind:string,hit:string,before:string,y:int>>")
        rows = spark.range(1).select(F.explode(made).alias("c")).select("c.kind", "c.y", F.array(*features(F.col("c.hit"), F.col("c.before"))).alias("x")).collect()
        for kind in ("secret", "id"):
            own = [r for r in rows if r.kind == kind]
            x, y = np.array([r.x for r in own], float), np.array([float(r.y) for r in own])
            held = np.arange(len(own)) % 3 == 2
            trees = gbt.fit(x[~held], y[~held], rounds=12, depth=3, rate=0.4, bins=32)
            margin = trees.margin(x[held])
            a, b = gbt.calibrated(margin, y[held])
            p = 1 / (1 + np.exp(-(a * margin + b)))
            limit = next((t for t in np.arange(0.5, 1, 0.02) if (y[held][p >= t].mean() if (p >= t).any() else 1) >= PRECISION), 0.99)
            _FITTED[kind] = trees, float((np.log(limit / (1 - limit)) - b) / a)
    return _FITTED


def spans(text: Column, spark: SparkSession) -> Column:
    """(base, spans): the base kinds' spans and all, each an array of (start, rank, end, kind) in order."""
    model = fitted(spark)
    shape = "array<struct<start:int,rank:int,end:int,kind:string>>"
    none = F.array().cast(shape)

    def plain(array: Column, rank: int) -> Column:
        return F.transform(array, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(KINDS[rank]).alias("kind")))

    def checked(array: Column, kind: str) -> Column:
        return F.filter(array, lambda x: passes(kind, x["hit"]))

    def accepted(array: Column, rank: int) -> Column:
        """Candidates of an open kind that the trees accept."""
        trees, limit = model[KINDS[rank]]
        return F.filter(array, lambda m: F.when(F.length(m["hit"]) >= 6, let(F.array(*features(m["hit"], m["before"])), lambda x: trees.sql_margin([x[i] for i in range(len(FEATURES))]) >= limit)).otherwise(False))

    def outside(base: Column, more: Column) -> Column:
        """Both in order, without those of more that lie wholly inside a base span: no base span that begins before ends later."""

        def judged(every: Column) -> Column:
            ends = running(F.transform(every, lambda s: F.when(s["rank"] < 4, s["end"]).otherwise(0)), F.greatest)
            return let(ends, lambda t: F.filter(every, lambda s, i: (s["rank"] < 4) | (F.get(t, i) < s["end"])))

        return F.when(F.size(more) == 0, base).otherwise(let(F.sort_array(F.concat(base, more)), judged))

    def based(m: Column) -> Column:
        parts = [plain(checked(m[k], k), i) for i, k in enumerate(KINDS[:4])]
        base = F.when(sum((F.size(m[k]) for k in KINDS[1:4]), F.size(m[KINDS[0]])) > 0, F.sort_array(F.concat(*parts)).cast(shape)).otherwise(none)
        more = F.concat(*(F.when(F.size(m[k]) > 0, plain(accepted(m[k], i), i).cast(shape)).otherwise(none) for i, k in enumerate(KINDS[4:], 4)))
        return let(F.struct(base.alias("base"), more.alias("more")), lambda b: F.struct(b["base"].alias("base"), outside(b["base"], b["more"]).alias("spans")))

    return let(F.struct(*(matches(text, k).alias(k) for k in KINDS)), based)


def digest(array: Column) -> Column:
    return F.concat_ws(",", F.transform(array, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, the count of each base kind, base_sha256, and all spans as kind:start:end of every document."""
    found = id_text(docs).select("doc_id", spans(F.col("text"), docs.sparkSession).alias("found")).select("doc_id", "found.base", "found.spans")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(digest(F.col("base")), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))


def replaced(text: Column, found: Column, block: int = 512) -> Column:
    """text with each span replaced by its kind in brackets; of spans that overlap, the first names all.

    The text is cut into blocks of characters first, as a substring far into a
    long string is found by walking there.
    """

    def part(blocks: Column, start: Column, end: Column) -> Column:
        """The characters from start to end (exclusive)."""
        first, last = F.floor(start / block).cast("int"), F.floor(end / block).cast("int")
        head = F.substring(F.coalesce(F.get(blocks, first), F.lit("")), start - first * block + 1, F.when(first == last, end - start).otherwise(block))
        tail = F.when(first < last, F.concat(F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substring(F.coalesce(F.get(blocks, last), F.lit("")), F.lit(1), end - last * block)))
        return F.when(start < end, F.concat(head, F.coalesce(tail, F.lit("")))).otherwise("")

    def joined(s: Column) -> Column:
        def gap(x: Column, i: Column) -> Column:
            past = F.coalesce(F.get(s["ends"], i - 1), F.lit(0))
            return F.when(x["start"] >= past, F.concat(part(s["blocks"], past, x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise("")

        return F.concat(F.array_join(F.transform(found, gap), ""), part(s["blocks"], F.element_at(s["ends"], -1), F.length(text)))

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    return let(F.struct(blocks.alias("blocks"), running(F.transform(found, lambda x: x["end"]), F.greatest).alias("ends")), joined)


def redact(docs: DataFrame) -> DataFrame:
    """docs, all columns kept, with each span of text replaced by its kind in brackets; a text without spans stays as it is."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce("text", F.lit("")).alias("whole"))
    found = rows.select("row", "whole", spans(F.col("whole"), docs.sparkSession)["spans"].alias("found"))
    clean = F.when(F.size("found") > 0, let(F.struct("whole", "found"), lambda s: replaced(s["whole"], s["found"]))).otherwise(F.col("row.text"))
    return found.select(*(clean.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
