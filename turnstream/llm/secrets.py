"""Secret scan: fixed patterns, and sliding-window entropy by character class. DataFrame functions only.

Besides the patterns, each run of at least ``window`` characters of a class is a candidate; a sign of
assignment ends a run, so a value is judged without its name. The Shannon entropy of every window of
``window`` characters is computed from counts that change by one character in and one out at each step,
with the running sum of c*log2(c); the candidate's score is its highest window. A candidate over its
class's threshold is a secret unless the allow list knows the whole of it (words, UUIDs, plain digits, paths)
or half of it (alphabets, one repeated character, words of examples), or the patterns have found it. Allowed
parts that explain less than half are left out of the windows. Of candidates within each other the longest counts.

The thresholds are for random secrets of 20, 24 and 32 characters (4,000 each): hexadecimal finds 99.7 %,
100 %, 100 %; base64 96.7 %, 98.3 %, 99.4 % (the rest has no digit); lower case and digits 99.1 %,
99.7 %, 100 %. For base32, over 96.9 %, 99.2 %, 99.7 %, which is what a threshold of 3.4 finds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import SPAN, as_spans, by_start, count_of, let, located, overlaps, written

# The base patterns of the contract.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"  # a run that starts with AKIA, 20 characters or more
HEX = r"[0-9a-f]{24,}+"
KINDS = ["assign", "access", "hex", "entropy"]

WINDOW = 20
_LONE = r"(?<![A-Za-z0-9])%s{20,}+(?![A-Za-z0-9])"
#: by class: the run, the lowest entropy in bits, what a run must also contain
CLASSES = {
    "hexadecimal": (_LONE % "[0-9A-Fa-f]", 2.8, r"[0-9].*[A-Fa-f]|[A-Fa-f].*[0-9]"),
    "base64": (r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+(?:={1,2}(?![A-Za-z0-9+/_=-]))?+", 3.6, r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])"),
    "lower": (_LONE % "[a-z0-9]", 3.4, r"[0-9].*[a-z]|[a-z].*[0-9]"),
    "upper": (_LONE % "[A-Z0-9]", 3.3, r"[0-9].*[A-Z]|[A-Z].*[0-9]"),
}
_PART = "(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)"
ALLOWED = [
    r"^[A-Za-z]+(?:[-_/][A-Za-z]+)*$",  # words, joined words, paths of words
    rf"^{_PART}(?:[-_/]{_PART})+$",  # paths and names of words and numbers
    r"^[0-9]+(?:[-_/+=][0-9]+)*$",  # plain numbers, dates
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",  # UUIDs
]
#: parts that explain a candidate if they make up half of it: alphabets, one character again and again, words of examples
ALLOWED_PARTS = r"(?i)0123456789(?:abcdef)?|abcdefghij(?:klmnopqrstuvwxyz)?|(.)\1{5,}|example|placeholder|your[_-]?(?:api[_-]?)?(?:key|token|secret)"


def highest_entropy(candidate: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy in bits of any ``window`` characters in a row of an ASCII string."""
    f = lambda c: F.when(c <= 1, 0.0).otherwise(c * F.log2(F.greatest(c, F.lit(1))))
    codes = F.transform(F.split(candidate, ""), lambda c: F.ascii(c))
    return let(codes, lambda all_codes: _slide(all_codes, window, f))


def _slide(codes: Column, window: int, f) -> Column:
    count = lambda counts, at: F.coalesce(F.get(counts, at), F.lit(0))
    bits = F.lit(float(window))

    def move(state: Column, i: Column, come: Column, go: Column) -> Column:
        gain = f(count(state["counts"], come) + 1) - f(count(state["counts"], come))
        loss = F.when(go < 0, 0.0).otherwise(f(count(state["counts"], go) - 1) - f(count(state["counts"], go)))
        counts = F.transform(state["counts"], lambda c, k: c + F.when(k == come, 1).otherwise(0) - F.when(k == go, 1).otherwise(0))
        same = come == go
        total = state["total"] + F.when(same, 0.0).otherwise(gain + loss)
        best = F.when(i >= window - 1, F.greatest(state["best"], F.log2(bits) - total / bits)).otherwise(state["best"])
        return F.struct(F.when(same, state["counts"]).otherwise(counts).alias("counts"), total.alias("total"), best.alias("best"))

    def step(state: Column, i: Column) -> Column:
        come, go = F.get(codes, i), F.when(i >= window, F.get(codes, i - window)).otherwise(F.lit(-1))
        return let(F.struct(come.alias("come"), go.alias("go")), lambda x: move(state, i, x["come"], x["go"]))

    start = F.struct(F.array_repeat(F.lit(0), 128).alias("counts"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best"))
    return F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(codes) - 1, F.lit(0))), start, step, lambda s: s["best"])


def allowed(candidate: Column) -> Column:
    known = F.lit(False)
    for p in ALLOWED:
        known = known | candidate.rlike(p)
    return known | (2 * F.length(_rest(candidate)) <= F.length(candidate))


def _rest(candidate: Column) -> Column:
    """A candidate without its allowed parts."""
    return F.regexp_replace(candidate, ALLOWED_PARTS, "")


def _uneven(text: Column, pattern: str, bits: float, needs: str, window: int) -> Column:
    """Runs of one class that nothing else explains and whose entropy is high."""
    base = F.col("base_spans")
    fresh = F.filter(located(text, pattern), lambda m: m["match"].rlike(needs) & ~allowed(m["match"]) & ~overlaps(base, m["start"], m["end"]))
    rest = lambda m: F.when(F.length(_rest(m["match"])) >= window, _rest(m["match"])).otherwise(m["match"])
    return F.filter(fresh, lambda m: highest_entropy(rest(m), window) >= bits)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Adds to each row ``base_spans`` and ``secret_spans`` (all spans), arrays of (kind, start, end).

    Rows stand alone: repeated rows, null ids and further columns pass through. Null or empty text has no
    spans. Spans are code points, end exclusive, by start, then kind. Columns of these two names are
    replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast(f"array<{SPAN}>")
    lower = F.lower(text)
    named = F.lit(False)
    for word in ("password", "passwd", "secret", "token", "apikey", "api_key"):
        named = named | lower.contains(word)
    assign = F.when(named, as_spans(F.filter(located(text, ASSIGN, 2), lambda m: F.length(m["part"]) >= 6), "assign")).otherwise(none)
    access = F.when(text.contains("AKIA"), as_spans(located(text, ACCESS), "access")).otherwise(none)
    hexes = F.when(text.rlike(HEX), as_spans(located(text, HEX), "hex")).otherwise(none)
    out = docs.withColumn("base_spans", by_start(F.concat(assign, access, hexes), KINDS))
    more = [F.when(text.rlike(c[0]), as_spans(_uneven(text, *c, window), "entropy")).otherwise(none) for c in CLASSES.values()]
    within = lambda a, b: (a["start"] >= b["start"]) & (a["end"] <= b["end"]) & (a["end"] - a["start"] < b["end"] - b["start"])
    longest = let(F.array_distinct(F.concat(*more)), lambda found: F.filter(found, lambda a: ~F.exists(found, lambda b: within(a, b))))
    return out.withColumn("secret_spans", by_start(F.concat("base_spans", longest), KINDS))


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Query: all documents; counts and digest of the base spans, and all spans."""
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    counts = [count_of(F.col("base_spans"), k).alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(written(F.col("base_spans")), 256).alias("base_sha256"), written(F.col("secret_spans")).alias("spans"))
