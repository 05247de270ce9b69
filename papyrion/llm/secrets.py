"""Secret scanning with SQL functions only.

Base patterns give their leftmost non-overlapping matches. Splitting the text by a pattern
gives the gaps between its matches, and the running sum of gap and match lengths gives code
point positions, so spans need no Python. The entropy detector looks at candidate strings:
runs of one character class. A window slides over each candidate; the counts of its
characters change by one in and one out, and the sum of c*log2(c) follows from those two counts. A candidate whose best window exceeds the class threshold is reported unless an
allow-list pattern suppresses it.

Defined edge cases: a null text counts as empty; texts without match have empty span strings;
repeated rows are scanned each for itself; a candidate of any length takes time linear in it, and
spans of a text take n times the square root of n; extra columns, whatever their names, are ignored
by the scan and kept by ``redact``; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: kind, pattern, group that must be long enough, least length; fixed values of the scan.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: class, candidate pattern, alphabet, window, bits a character that the best window must reach.
CLASSES = (
    ("entropy_alnum", r"[A-Za-z0-9+/_=-]{20,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 20, 3.8),
    ("entropy_hex", r"[0-9A-Fa-f]{20,}", "0123456789abcdefABCDEF", 20, 3.0),
    ("entropy_digit", r"[0-9]{24,}", "0123456789", 20, 2.9),
)
#: A word of a path: letters of one case, humps of three letters or more, a short number.
_WORD = r"(?:[A-Z]?[a-z]++(?:[A-Z][a-z]{2,}+)*+[0-9]{0,2}+|[A-Z]++[0-9]{0,2}+|[0-9]{1,8}+)"
_PART = rf"(?:{_WORD}(?:[_-]++{_WORD})*+)?+"
#: Candidates that are no secrets: pure letters, identifiers of words, ruler lines, UUIDs, paths all of whose parts are words.
#: Possessive throughout: nothing here needs a second try, and the matcher keeps no stack for groups that repeat.
ALLOW = (
    r"^[A-Za-z]++$", r"^[a-z]++(?:[_/-][a-z]++)++$", r"^(.)\1++$",
    r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", rf"^(?:{_PART}/)++{_PART}$", r"(?i)(?:example|placeholder|changeme)",
)
#: Bits of a count, and counts in a word of packed counts.
BITS, PER_WORD = 5, 12


def let(value: Column, body) -> Column:
    """``body`` applied to ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, kind: str, start: Column, merge) -> Column:
    """Running results of ``merge`` over an array, each with its own element, in blocks of the square root of its length.

    An accumulator that grows element by element is copied at every step; within blocks that costs
    n times the square root of n in place of n squared.
    """
    none = F.array().cast(f"array<{kind}>")

    def inside(block, first):
        step = lambda out, x: F.concat(out, F.array(merge(F.coalesce(F.try_element_at(out, F.lit(-1)), first), x).cast(kind)))
        return F.aggregate(block, none, step)

    def blocks(size):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / size).cast("int")), lambda k: F.slice(values, k * size + 1, size))

    def joined(parts):
        ends = F.transform(parts, lambda p: F.element_at(p, -1))
        return let(
            F.concat(F.array(start.cast(kind)), inside(ends, start)),
            lambda before: F.flatten(F.transform(parts, lambda p, k: F.transform(p, lambda v: merge(F.get(before, k), v).cast(kind)))),
        )

    size = F.ceil(F.sqrt(F.size(values).cast("double"))).cast("int")
    return F.when(F.size(values) == 0, none).otherwise(let(size, lambda n: let(blocks(n), lambda b: let(F.transform(b, lambda p: inside(p, start)), joined))))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start,end,s>> of leftmost non-overlapping matches, code points, end exclusive."""
    empty = F.array().cast("array<struct<start:int,end:int,s:string>>")

    def spans(found):
        gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(found)), lambda g: F.length(g))
        length = F.zip_with(found, gaps, lambda m, g: F.length(m) + g)
        ends = running(length, "int", F.lit(0), lambda a, b: a + b)
        return F.zip_with(found, ends, lambda m, e: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("s")))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.coalesce(F.size(found), F.lit(0)) > 0, spans(found)).otherwise(empty))


def constant(values, kind: str) -> Column:
    """A constant array; the optimiser folds it into one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def window_entropy(s: Column, alphabet: str, window: int) -> Column:
    """The highest Shannon entropy, in bits a character, of any window of ``window`` characters of ``s``.

    State: the counts by character of the alphabet, packed twelve to a word, and the sum of
    c*log2(c); the character that enters and the one that leaves change one count each. The window
    starts full of a blank that has a count of its own. The time is linear in the length.
    """
    if window >= 1 << BITS:
        raise ValueError("a window holds less than 32 characters")
    bits, words, codes_ = float(math.log2(window)), len(alphabet) // PER_WORD + 1, range(len(alphabet) + 1)
    term = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    # what the sum gains when a count rises from c
    gain = constant([after - before for before, after in zip(term, term[1:])], "double")
    word, shift = constant([k // PER_WORD for k in codes_], "int"), constant([BITS * (k % PER_WORD) for k in codes_], "int")
    # one count of character k in word w, at k * words + w
    one = constant([(1 << (BITS * (k % PER_WORD))) * (k // PER_WORD == w) for k in codes_ for w in range(words)], "bigint")
    count = lambda n, code: F.call_function("shiftright", F.get(n, F.get(word, code)), F.get(shift, code)).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")

    def step(a, x):
        # x: the places of the characters that leave and enter; the least sum lags by one character
        left, new = count(a["n"], x["out"]), count(a["n"], x["in"])
        return F.struct(
            F.transform(a["n"], lambda v, w: v + F.get(one, x["in"] * words + w) - F.get(one, x["out"] * words + w)).alias("n"),
            (a["sum"] + F.when(x["in"] == x["out"], 0.0).otherwise(F.get(gain, new) - F.get(gain, left - 1))).alias("sum"),
            (a["at"] + 1).alias("at"),
            F.when(a["at"] >= window, F.least(a["least"], a["sum"])).otherwise(a["least"]).alias("least"),
        )

    def moves(codes):
        return F.arrays_zip(F.slice(F.concat(F.array_repeat(F.lit(0), window), codes), F.lit(1), F.size(codes)).alias("out"), codes.alias("in"))

    def best(a):
        least = F.when(a["at"] >= window, F.least(a["least"], a["sum"])).otherwise(a["least"])
        return F.lit(bits) - least / F.lit(float(window))

    blank = constant([window] + [0] * (words - 1), "bigint")
    start = F.struct(blank.alias("n"), F.lit(window * bits).alias("sum"), F.lit(0).alias("at"), F.lit(window * bits).alias("least"))
    codes = F.transform(F.split(s, ""), lambda c: F.position(c, F.lit(alphabet)))
    return let(codes, lambda k: F.aggregate(moves(k), start, step, best))


def detectors(text: Column, classes=CLASSES, allow=ALLOW) -> dict[str, Column]:
    """By kind, array<struct<kind,start,end,rank>> of what each base pattern and entropy class finds."""
    def at_least(pattern, group, least):
        return lambda m: F.length(F.regexp_extract(m["s"], pattern, group)) >= least

    def not_allowed(rule):
        return lambda m: ~m["s"].rlike(rule)

    def random_enough(alphabet, window, bits):
        return lambda m: window_entropy(m["s"], alphabet, window) >= bits

    def named(kind, rank):
        return lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), F.lit(rank).alias("rank"))

    out = {}
    for kind, pattern, group, least in BASE:
        found = matches(text, pattern)
        out[kind] = F.filter(found, at_least(pattern, group, least)) if group else found
    for kind, pattern, alphabet, window, bits in classes:
        found = matches(text, pattern)
        for rule in allow:
            found = F.filter(found, not_allowed(rule))
        out[kind] = F.filter(found, random_enough(alphabet, window, bits))
    return {kind: F.transform(found, named(kind, rank)) for rank, (kind, found) in enumerate(out.items())}


def scan(docs: DataFrame, classes=CLASSES, allow=ALLOW) -> DataFrame:
    """Spans of secrets in every text: doc_id, text, counts, base spans and all spans by start, then kind.

    Base spans are never suppressed; the allow-list concerns entropy candidates alone.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = detectors(F.col("text"), classes, allow)
    d = docs.select("doc_id", text.alias("text")).select("doc_id", "text", *[c.alias(k) for k, c in found.items()])
    base = [k for k, *_ in BASE]

    def ordered(names):
        by = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["rank"] - b["rank"])
        return F.array_sort(F.concat(*names), by)

    return d.select("doc_id", "text", *[F.size(k).cast("long").alias(f"n_{k}") for k in found], ordered(base).alias("base"), ordered(list(found)).alias("all"))


def joined(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string"))), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns of a scan."""
    return scanned.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"))


def redact(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """Documents with every found span replaced by ``mask``; other columns stay, n_chars follows the text.

    Overlapping spans are masked as one. A null text stays null.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = F.array_sort(F.transform(F.concat(*detectors(text).values()), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))))

    def masked(spans):
        ends = running(F.transform(spans, lambda m: m["end"]), "int", F.lit(0), F.greatest)

        def pieces(chars, reach):
            def piece(m, k):
                done = F.get(reach, k)
                return F.when(m["start"] >= done, F.concat(F.array_join(F.slice(chars, done + 1, m["start"] - done), ""), F.lit(mask))).otherwise("")

            rest = F.array_join(F.slice(chars, F.element_at(reach, -1) + 1, F.size(chars)), "")
            return F.concat(F.array_join(F.transform(spans, piece), ""), rest)

        return let(F.split(text, ""), lambda chars: let(F.concat(F.array(F.lit(0)), ends), lambda reach: pieces(chars, reach)))

    clean = let(found, lambda spans: F.when(F.size(spans) > 0, masked(spans)).otherwise(F.col("text").cast("string")))
    if "n_chars" not in docs.columns:
        return docs.withColumn("text", clean)
    # the text is masked once and measured in the same expression
    kind = docs.schema["n_chars"].dataType
    both = let(clean, lambda t: F.struct(t.alias("text"), F.length(t).cast(kind).alias("n_chars")))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), both.alias("new"))
    return rows.select(*[F.col(f"new.{c}" if c in ("text", "n_chars") else f"row.`{c}`").alias(c) for c in docs.columns])
