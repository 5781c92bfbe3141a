"""Secrets in texts by patterns and by sliding-window entropy, with DataFrame functions only.

Base kinds are patterns: ``assign``, ``access`` and ``hex``. The kind ``entropy`` adds strings that look random:
candidates are unbroken runs of key characters; each falls in a character class (hex digits, letters of both cases
with digits, letters of one case with digits, or letters that change their case often); the Shannon entropy of every window of ``WINDOW`` characters follows from symbol counts that change by
one character in and one out; the candidate is a secret if the largest entropy reaches the class's threshold. An
allow-list of patterns suppresses candidates, as does a base span that overlaps; base spans always stay.

Defined results: a null text is empty, and an empty text has no spans; positions are code points, ends exclusive;
repeated rows give repeated results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns and their least lengths.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
ASSIGN_LEAST = 8

KINDS = ("assign", "access", "hex", "entropy")
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
CANDIDATE = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{WINDOW},}}+"
#: Pattern of a class and the least entropy in bits of its secrets; the first class that fits holds.
CLASSES = (
    (r"^(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f]+$", 3.0),
    (r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z]).+$", 3.7),
    (r"^(?=(?:[^0-9]*+[0-9]){3})(?=(?:[^a-z]*+[a-z]){3})[0-9a-z]+$", 3.5),
    (r"^(?=(?:[^0-9]*+[0-9]){2})(?=(?:[^A-Z]*+[A-Z]){3})[0-9A-Z]+$", 3.4),
    (r"^(?![A-Za-z]*?[a-z]{7})(?=(?:[A-Z]*+[a-z]++[A-Z]){3})[A-Za-z]+$", 3.7),
)
ALLOW = (
    r"(?i)example|sample|placeholder|changeme|dummy|xxxx",
    r"(?i)abcdefgh|01234567|12345678",
    r"(.)\1{5}",
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"^/?(?:[a-z]++[/_-])++[a-z]++[0-9]*+$",
)
_SPAN = "array<struct<start:int,kind:int,stop:int>>"


def _found(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Spans of the leftmost non-overlapping matches whose ``group`` has ``least`` characters."""
    whole, value = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(whole.alias("whole"), value.alias("value"), F.split(text, pattern, -1).alias("gap"))
    none = F.array().cast(_SPAN)

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        stop = start + F.length(x["whole"])
        good = x["whole"].isNotNull() & (F.length(x["value"]) >= least)
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"))
        return F.struct(F.coalesce(stop, start).alias("at"), F.when(good, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    walked = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda s: s["spans"])
    return F.when(text.rlike(pattern), walked).otherwise(none)


def largest_entropy(text: Column) -> Column:
    """The largest Shannon entropy, in bits, of a window of WINDOW characters; symbols beyond SYMBOLS count as one."""
    weights = F.array(*[F.lit(k * math.log2(k) if k else 0.0) for k in range(WINDOW + 1)])
    code = F.transform(F.split(text, ""), lambda c: F.instr(F.lit(SYMBOLS), c))
    start = F.struct(F.array_repeat(F.lit(0), len(SYMBOLS) + 1).alias("n"), F.lit(0.0).alias("sum"), F.lit(float("inf")).alias("least"), F.lit(1).alias("seen"))
    leaving = F.slice(F.concat(F.array_repeat(F.lit(None).cast("int"), WINDOW), code), F.lit(1), F.size(code))
    moves = F.zip_with(code, leaving, lambda new, old: F.struct(new.alias("new"), old.alias("old")))

    def step(state: Column, x: Column) -> Column:
        n, new, old = state["n"], x["new"], x["old"]
        inn, out = F.get(n, new), F.coalesce(F.get(n, old), F.lit(0))
        turned = old.isNotNull() & (old == new)
        total = state["sum"] + F.get(weights, inn + 1) - F.get(weights, inn) + F.when(old.isNull(), 0.0).otherwise(F.get(weights, out - 1) - F.get(weights, out))
        total = F.when(turned, state["sum"]).otherwise(total)
        counts = F.when(turned, n).otherwise(F.transform(n, lambda c, j: c + (j == new).cast("int") - F.coalesce(j == old, F.lit(False)).cast("int")))
        least = F.when(state["seen"] >= WINDOW, F.least(state["least"], total)).otherwise(state["least"])
        return F.struct(counts.alias("n"), total.alias("sum"), least.alias("least"), (state["seen"] + 1).alias("seen"))

    return F.aggregate(moves, start, step, lambda s: F.lit(math.log2(WINDOW)) - s["least"] / WINDOW)


def _entropy(text: Column, base: Column, classes, allow) -> Column:
    spans = _found(text, CANDIDATE, 3)

    def random(x: Column) -> Column:
        word = F.substring(text, x["start"] + 1, x["stop"] - x["start"])
        threshold = None
        for pattern, bits in classes:
            threshold = F.when(word.rlike(pattern), bits) if threshold is None else threshold.when(word.rlike(pattern), bits)
        allowed = F.lit(False)
        for pattern in allow:
            allowed = allowed | word.rlike(pattern)
        clear = ~F.exists(base, lambda b: (b["start"] < x["stop"]) & (x["start"] < b["stop"]))
        return F.when(threshold.isNotNull() & ~allowed & clear, largest_entropy(word) >= threshold).otherwise(False)

    return F.filter(spans, random)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes=CLASSES, allow=ALLOW) -> DataFrame:
    """One row per input row: doc_id, text, base and spans, both arrays of (start, kind, stop) in order; kind indexes KINDS."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    df = df.select("*", F.array_sort(F.concat(_found(text, ASSIGN, 0, 1, ASSIGN_LEAST), _found(text, ACCESS, 1), _found(text, HEX, 2))).alias("base"))
    return df.select("*", F.array_sort(F.concat("base", _entropy(text, F.col("base"), classes, allow))).alias("spans"))


def digest(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each run of overlapping spans replaced by ``mark``."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(state: Column, x: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, F.greatest(x["start"] - state["at"], F.lit(0)))
        fresh = F.when(x["start"] >= state["at"], F.concat(state["out"], gap, F.lit(mark))).otherwise(state["out"])
        return F.struct(fresh.alias("out"), F.greatest(state["at"], x["stop"]).alias("at"))

    done = F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
