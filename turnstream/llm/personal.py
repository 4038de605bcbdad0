"""Personal data: fixed patterns, and identifiers found through the contexts that known ones stand in.

DataFrame functions only. Bootstrapping: whole matches of the fixed patterns, runs of digits with spaces
and signs between them, and other tokens with a digit, an @ or an (at) are instances; the word before an
instance and the word behind it are its two lexical patterns (what another instance looks like, if that
is right beside it). Instances that the fixed patterns know are seeds. The pattern-instance graph, one edge
for each distinct pair with its count, is scored in turns: a pattern's score for a kind is the mean score of
its distinct instances, an instance's score the best of its patterns. Patterns with enough distinct seeds
and a high score name the unseen instances in their place that begin as the kind's shape allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import SPAN, as_spans, by_kind, count_of, let, located, written
from .store import materialise

# The base patterns of the contract, possessive where no match can need what was given back.
LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ["email", "ip", "card", "phone"]

#: stand for the first character of a base span (one a kind), and for its others; texts have \ufffd for them
MASKS, REST = "\ue000\ue001\ue002\ue003", "\ue004"
_AT = r"(?i:\(at\)|\[at\])"
_RUN = r"(?<!\S)[+(]*+[0-9](?:[\x20().\/-]*+[0-9]){6,18}\)?(?![^\s,.;])"
INSTANCE = rf"[{MASKS}]{REST}*+|{_RUN}|(?<!\S)(?:(?!{_AT})[^\s{MASKS}])++{_AT}[^\s{MASKS}]*+|(?<!\S)[^\s0-9@{MASKS}]*+[0-9@][^\s{MASKS}]*+"
#: the last word of what stands before an instance; lone signs between the two do not count
BEFORE = rf"(?<!\S)(\S++)(?:\s++[^\s\p{{L}}\p{{N}}{MASKS}]*+)?$"
#: the first word of what stands behind one
BEHIND = rf"^(?:[^\s\p{{L}}\p{{N}}{MASKS}]*+\s++)*+(\S++)(?!\S)"
ROUNDS = 3
LEAST_SEEDS = 5
LEAST_SCORE = 0.8
_END = r"(?=[,.;]*(?:\s|$))"
#: what an unseen instance of a kind must begin with, up to the end of a token
SHAPES = {
    "email": rf"^[^\s@]+(?:@|{_AT})[^\s@]*[^\s@,.;](?=[,.;]*$)",
    "ip": rf"^[0-9]{{1,3}}(?:[.:_-][0-9]{{1,3}}){{3}}{_END}",
    "card": rf"^[0-9](?:[\x20.-]*[0-9]){{12,18}}{_END}",
    "phone": rf"^[+(]*[0-9](?:[\x20().\/-]*[0-9]){{6,14}}\)?{_END}",
}


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """From the right, every second digit doubled; digits of the products summed; divisible by ten."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d: F.coalesce(d.try_cast("int"), F.lit(0)))
    summed = F.aggregate(F.transform(each, lambda d, i: F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)), F.lit(0), lambda a, d: a + d)
    return summed % 10 == 0


def _part_ok(part: Column) -> Column:
    n = F.regexp_replace(part, "^0+(?=.)", "")
    return (F.length(n) <= 3) & (n.try_cast("int") <= 255)


def base_spans(text: Column) -> Column:
    """Spans of the four fixed patterns, by kind, then start; matches that fail their check are dropped."""
    none = F.array().cast(f"array<{SPAN}>")
    dotted = r"[0-9]\.[0-9]"
    email = F.when(text.contains("@"), as_spans(located(text, EMAIL), "email")).otherwise(none)
    ip = F.when(text.rlike(dotted), as_spans(F.filter(located(text, IP), lambda m: F.forall(F.split(m["match"], r"\."), _part_ok)), "ip")).otherwise(none)
    card_ok = lambda m: F.length(_digits(m["match"])).between(13, 19) & luhn(_digits(m["match"]))
    card = F.when(text.rlike("[0-9]"), as_spans(F.filter(located(text, CARD), card_ok), "card")).otherwise(none)
    phone_ok = lambda m: F.length(_digits(m["match"])).between(9, 15)
    phone = F.when(text.rlike(r"\+[0-9]"), as_spans(F.filter(located(text, PHONE), phone_ok), "phone")).otherwise(none)
    return F.concat(email, ip, card, phone)


def masked(text: Column, spans: Column) -> Column:
    """The text at its length, each base span (overlapping ones as one) a mask of its kind and fillers."""
    plain = F.translate(text, MASKS + REST, "\ufffd" * 5)
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(F.lit(KINDS), s["kind"]).cast("int").alias("k"), s["end"].alias("end"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        fresh = F.concat(F.substring(plain, state["at"] + 1, s["start"] - state["at"]), F.substring(F.lit(MASKS), s["k"], F.lit(1)), F.repeat(F.lit(REST), s["end"] - s["start"] - 1))
        more = F.when(s["start"] >= state["at"], fresh).otherwise(F.repeat(F.lit(REST), s["end"] - state["at"]))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["out"], more).alias("out"))

    whole = F.aggregate(ordered, start, step, lambda s: F.concat(s["out"], F.substring(plain, s["at"] + 1, F.length(plain))))
    return F.when(F.size(spans) > 0, whole).otherwise(plain)


def _instances(hidden: Column) -> Column:
    """Places of a masked text's instances, and of each its patterns: "word _" before it and "_ word" behind it, lower-cased."""
    # an instance right beside another stands as its mask, or as its token with all digits alike
    alike = lambda token: F.regexp_replace(F.regexp_replace(token, REST, ""), "[0-9]", "0")
    last = lambda found, i: F.when(i > 0, alike(F.regexp_extract(F.get(found, i - 1)["match"], r"\S+$", 0))).otherwise("")
    following = lambda found, i: F.coalesce(alike(F.regexp_extract(F.get(found, i + 1)["match"], r"^\S+", 0)), F.lit(""))
    before = lambda found, m, i: F.lower(F.regexp_extract(F.concat(last(found, i), m["gap"]), BEFORE, 1))
    gap = lambda found, m, i: F.coalesce(F.get(found, i + 1)["gap"], F.substring(hidden, m["end"] + 1, F.length(hidden)))
    behind = lambda found, m, i: F.lower(F.regexp_extract(F.concat(gap(found, m, i), following(found, i)), BEHIND, 1))
    words = lambda found, m, i: F.filter(F.array(F.concat(before(found, m, i), F.lit(" _")), F.concat(F.lit("_ "), behind(found, m, i))), lambda p: F.length(p) > 2)
    each = lambda found: F.transform(found, lambda m, i: F.struct(words(found, m, i).alias("patterns"), m["match"].alias("match"), m["start"].alias("start"), m["end"].alias("end")))
    return let(located(hidden, INSTANCE), each)


def _contexts(rows: DataFrame) -> DataFrame:
    """One row for each instance, pattern of it, and kind it is a seed of (null: none): row key, place, token, pattern, kind."""
    each = rows.select("row_key", "base_spans", F.explode("instances").alias("m"))
    over = F.filter("base_spans", lambda s: (s["start"] < F.col("m.end")) & (s["end"] > F.col("m.start")))
    kinds = F.when(F.col("m.seed"), F.array_distinct(F.transform(over, lambda s: s["kind"])))
    alone = each.select("row_key", F.col("m.start").alias("start"), F.col("m.end").alias("end"), F.col("m.match").alias("token"), F.col("m.patterns").alias("patterns"), F.explode_outer(kinds).alias("kind"))
    return alone.withColumn("pattern", F.explode("patterns")).drop("patterns")


def score_patterns(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """edges: pattern, token, kind (null if unknown), one row each. Returns pattern, kind, score, seeds."""
    seeds = edges.filter("kind is not null").select("token", "kind").distinct().select("*", F.lit(1.0).alias("score"), F.lit(True).alias("seed"))
    pairs = edges.select("pattern", "token").distinct()
    size = pairs.groupBy("pattern").agg(F.count("*").alias("n"))
    known, patterns = seeds, None
    for _ in range(rounds):
        votes = pairs.join(known, "token").groupBy("pattern", "kind").agg(F.sum("score").alias("mass"), F.count_if("seed").alias("seeds"))
        patterns = votes.join(size, "pattern").select("pattern", "kind", (F.col("mass") / F.col("n")).alias("score"), "seeds").filter(F.col("seeds") > 0)
        patterns = materialise(patterns, "patterns")
        found = pairs.join(patterns.filter(F.col("score") >= LEAST_SCORE / 2), "pattern").groupBy("token", "kind").agg(F.max("score").alias("score")).withColumn("seed", F.lit(False))
        known = seeds.unionByName(found.join(seeds.select("token", "kind"), ["token", "kind"], "left_anti"))
    return patterns


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, least_seeds: int = LEAST_SEEDS, least_score: float = LEAST_SCORE) -> DataFrame:
    """Rows with ``base_spans`` and ``pii_spans`` (all spans) added, arrays of (kind, start, end).

    Every row stands for itself, repeated rows and null ids included; null or empty text has no spans.
    Spans are code points, end exclusive, by kind as listed, then start. Further columns of any name pass
    through; columns named base_spans or pii_spans are replaced. Very long texts are read whole.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("base_spans", "pii_spans")]
    own = docs.select(F.struct(*kept).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    none = F.array().cast("array<struct<patterns:array<string>,match:string,start:int,end:int>>")
    found = F.when(text.rlike(r"[0-9@]|(?i:[(\[]at[)\]])"), _instances(F.col("masked_text"))).otherwise(none)
    seed = lambda m: F.substring(m["match"], 1, 1).isin(*MASKS)
    token = lambda m: F.when(seed(m), F.substring(text, m["start"] + 1, m["end"] - m["start"])).otherwise(m["match"])
    named = lambda m: F.struct(m["patterns"].alias("patterns"), token(m).alias("match"), m["start"].alias("start"), m["end"].alias("end"), seed(m).alias("seed"))
    rows = own.withColumn("base_spans", base_spans(text)).withColumn("masked_text", masked(text, F.col("base_spans"))).withColumn("instances", F.transform(found, named)).select("row", "base_spans", "instances")
    rows = materialise(rows.withColumn("row_key", F.monotonically_increasing_id()), "personal")
    each = _contexts(rows.select("row_key", "base_spans", "instances"))
    edges = each.groupBy("pattern", "token", "kind").agg(F.count("*").alias("n"))
    good = score_patterns(materialise(edges, "edges"), rounds).filter((F.col("score") >= least_score) & (F.col("seeds") >= least_seeds))
    begins = F.lit("")
    for kind, shape in SHAPES.items():
        begins = F.when(F.col("g.kind") == kind, F.regexp_extract("e.token", shape, 0)).otherwise(begins)
    unseen = each.filter("kind is null").alias("e").join(good.alias("g"), F.col("e.pattern") == F.col("g.pattern"))
    unseen = unseen.select("e.row_key", "g.kind", "e.start", F.length(begins).alias("n")).filter("n > 0")
    new = unseen.select("row_key", F.struct("kind", "start", (F.col("start") + F.col("n")).alias("end")).alias("span"))
    new = materialise(new.groupBy("row_key").agg(F.collect_set("span").alias("more")), "unseen")
    spans = F.concat("base_spans", F.coalesce("more", F.array().cast(f"array<{SPAN}>")))
    return rows.drop("instances").join(new, "row_key", "left").select("row.*", "base_spans", by_kind(spans, KINDS).alias("pii_spans"))


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by [kind]; a span that starts within an earlier one is skipped."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        before = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        moved = F.struct((-s["back"]).alias("at"), F.concat(state["out"], before, F.lit("["), s["kind"], F.lit("]")).alias("out"))
        return F.when(s["start"] >= state["at"], moved).otherwise(state)

    rest = lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(ordered, start, step, rest)).otherwise(text)


def op8_personal_data(spark, sf_dir: str) -> DataFrame:
    """Query: all documents; counts and digest of the base spans, and all spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_personal_data(docs)
    counts = [count_of(F.col("base_spans"), k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(written(F.col("base_spans")), 256).alias("base_sha256"), written(F.col("pii_spans")).alias("spans"))
