"""Sentences by unsupervised boundary detection: abbreviations, collocations and sentence starters from corpus counts.

The published method of Kiss and Strunk (2006). What a full stop means is told by how often a word has one (abbreviations),
by pairs that go together over a full stop (collocations), by words that begin sentences more often than chance (starters),
and by whether the next word is seen in small or capital letters elsewhere (orthography). All are counts of the whole corpus
and log-likelihood ratios of them; Spark counts, and the model is tables that tokens are joined with.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstream.sources.shared import written

# fixed values of the published method
ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0
_LONGER = 0.99  # share of full stops of a sure abbreviation

_PIECE = r"\S+\s*"
_OPENING, _CLOSING, _MARKS = "[\"'(\\[{«“„‘]+", "[\"')\\]}»”’]+", "[,;:.?!\"')\\]}»”’]+"
_NUMBER = r"^[-+]?[0-9]+([.,:/-][0-9]+)*$"
NUMBER = "#number#"


@dataclass
class Model:
    """abbreviations: word. collocations: word, next. starters: word. orthography: word and what it was seen as."""

    abbreviations: DataFrame
    collocations: DataFrame
    starters: DataFrame
    orthography: DataFrame


def _bare(token: Column) -> Column:
    """Without opening and closing signs around it."""
    return F.regexp_replace(F.regexp_replace(token, "^" + _OPENING, ""), _CLOSING + "$", "")


def _word(token: Column) -> Column:
    """A token as a word to count: small letters, no signs around it, numbers alike. '' if nothing is left."""
    core = F.lower(F.regexp_replace(F.regexp_replace(token, "^" + _OPENING, ""), _MARKS + "$", ""))
    return F.when(core.rlike(_NUMBER), NUMBER).otherwise(core)


def _tokens(text: str) -> Column:
    return F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"\S+"), F.lit(0))


def _signed(token: Column) -> Column:
    """Whether a token has a sign at all that a sentence may end with; one without is neither stop, dots nor ending."""
    return token.contains(".") | token.contains("?") | token.contains("!") | token.contains("…")


def _kind(rows: DataFrame, token: str, of: str = "") -> DataFrame:
    """The columns word; stop, dots, ending, initial, letters of the token, each with ``of`` before its name."""
    rows = rows.withColumns({f"{of}bare": _bare(F.col(token)), f"{of}word": _word(F.col(token))})
    bare, word = F.col(f"{of}bare"), F.col(f"{of}word")
    rows = rows.withColumn(f"{of}dots", bare.rlike(r"\.\.+$") | bare.endswith("…"))
    stop = bare.endswith(".") & ~F.col(f"{of}dots")
    return rows.withColumns({f"{of}stop": stop, f"{of}ending": bare.rlike("[?!]$"), f"{of}initial": stop & word.rlike(r"^\p{L}$"), f"{of}letters": word.rlike(r"\p{L}")}).drop(f"{of}bare")


def _case(rows: DataFrame, token: str, of: str = "") -> DataFrame:
    """The columns upper and lower: how the token's first letter is written."""
    rows = rows.withColumn("first", F.substring(F.regexp_replace(F.col(token), "^" + _OPENING, ""), 1, 1))
    first = F.col("first")
    cased = F.upper(first) != F.lower(first)
    return rows.withColumns({f"{of}upper": F.coalesce((first == F.upper(first)) & cased, F.lit(False)), f"{of}lower": F.coalesce((first == F.lower(first)) & cased, F.lit(False))}).drop("first")


def counted(texts: DataFrame, text: str) -> DataFrame:
    """n, the times of each token behind each other one: first, and of both word, stop, dots, ending, initial and letters; upper, lower.

    What is in columns that begin with b_ is of the token before. Of those that can end nothing it is not told which they are,
    so that the table grows with words and with ends of sentences, and not with tokens. Equal texts are read once and count as often as they come.
    """
    rows = texts.groupBy(F.col(text).alias("text")).agg(F.count("*").alias("copies")).select("copies", _tokens("text").alias("tokens"))
    before = lambda i: F.get("tokens", i - 1)
    pairs = F.transform("tokens", lambda t, i: F.struct((i == 0).alias("first_token"), F.when(_signed(before(i)), before(i)).otherwise("").alias("before"), t.alias("token")))
    rows = rows.select("copies", F.explode(pairs).alias("t")).select("copies", "t.*").groupBy("first_token", "before", "token").agg(F.sum("copies").alias("n"))
    return _case(_kind(_kind(rows, "before", "b_"), "token"), "token").drop("before", "token")


def _log(x: Column) -> Column:
    return F.log(x)


def dunning(word: Column, stops: Column, both: Column, n: Column) -> Column:
    """The ratio for a word that has a full stop as often as all words have, against one that nearly always has it."""
    p = stops / n
    chance = both * _log(p) + (word - both) * _log(1.0 - p + 1e-8)
    sure = both * _log(F.lit(_LONGER)) + (word - both) * _log(F.lit(1.0 - _LONGER))
    return -2 * (chance - sure)


def together(a: Column, b: Column, both: Column, n: Column) -> Column:
    """The ratio for two events that meet by chance, against one that depends on the other."""
    part = lambda k, of, p: F.when(k > 0, k * _log(p)).otherwise(0.0) + F.when(of - k > 0, (of - k) * _log(1.0 - p)).otherwise(0.0)
    rest = F.when(n > a, (b - both) / (n - a)).otherwise(0.0)
    chance = part(both, a, b / n) + part(b - both, n - a, b / n)
    bound = part(both, a, both / a) + part(b - both, n - a, rest)
    return -2 * (chance - bound)


def train(texts: DataFrame, text: str = "text") -> Model:
    """The model of all texts. Null and empty texts have no tokens; without texts all tables are empty."""
    rows = written(counted(texts, text), "sentence-words")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("double")
    times = lambda c: F.col(c).cast("long") * F.col("n")
    sums = rows.agg(total("n").alias("n"), total(times("stop")).alias("stops"))
    words = rows.filter("letters").groupBy("word").agg(total("n").alias("times"), total(times("stop")).alias("with_stop"))
    inner = F.length("word") - F.length(F.regexp_replace("word", r"\.", ""))
    signs = (F.length("word") - inner).cast("double")
    without = F.col("times") - F.col("with_stop")
    score = dunning(F.col("times"), F.col("stops"), F.col("with_stop"), F.col("n")) * F.exp(-signs) * (inner + 1) * F.pow(signs, -without)
    abbreviations = words.filter("with_stop > 0").join(F.broadcast(sums), how="inner").filter(score >= ABBREVIATION).select("word")  # one row of sums
    abbreviations = written(abbreviations, "sentence-abbreviations")

    def ended(rows: DataFrame, of: str) -> DataFrame:
        """Rows with stops: abbreviated, and ends, of the token with ``of`` before its columns' names."""
        short = abbreviations.select(F.col("word").alias(f"{of}word"), F.lit(True).alias("abbreviated"))
        rows = rows.join(short, f"{of}word", "left").withColumn("abbreviated", F.col(f"{of}stop") & F.coalesce("abbreviated", F.lit(False)))
        return rows.withColumn("ends", F.col(f"{of}ending") | (F.col(f"{of}stop") & ~F.col("abbreviated")))

    marked = ended(rows.filter("b_stop"), "b_").unionByName(rows.filter("not b_stop").withColumns({"abbreviated": F.lit(False), "ends": F.col("b_ending")}))
    odd = (F.col("b_word") == NUMBER) | F.col("b_initial")
    n = F.col("all")
    sums = sums.withColumnRenamed("n", "all")

    count = rows.filter("word <> ''").groupBy("word").agg(total("n").alias("times"))
    behind = marked.filter(F.col("b_stop") & (F.col("abbreviated") | odd) & F.col("b_letters") | F.col("b_stop") & (F.col("b_word") == NUMBER)).filter("word <> ''")
    pairs = behind.groupBy(F.col("b_word").alias("word"), F.col("word").alias("next_word")).agg(total("n").alias("both"))
    pairs = pairs.join(count.withColumnRenamed("times", "a"), "word").join(count.select(F.col("word").alias("next_word"), F.col("times").alias("b")), "next_word").join(F.broadcast(sums))
    related = (together(F.col("a"), F.col("b"), F.col("both"), n) >= COLLOCATION) & (n / F.col("a") > F.col("b") / F.col("both")) & (F.col("both") > 1)
    collocations = pairs.filter(related).select("word", "next_word")

    begun = marked.filter(F.col("ends") & ~odd & F.col("word").rlike(r"^\p{L}+$"))
    breaks = ended(rows.filter("stop or ending"), "").filter("ends").agg(total("n").alias("breaks"))
    firsts = begun.groupBy("word").agg(total("n").alias("both")).join(count, "word").join(F.broadcast(sums)).join(F.broadcast(breaks))
    starts = (together(F.col("breaks"), F.col("times"), F.col("both"), n) >= STARTER) & (n / F.col("breaks") > F.col("times") / F.col("both"))
    starters = firsts.filter(starts).select("word")

    # how a word is written behind a sentence's end, inside of one, and where it is not known which
    unknown = (F.col("b_stop") & (F.col("abbreviated") | odd)) | F.col("b_dots")
    where = F.when(F.col("first_token"), "begin").when(unknown, "unknown").when(F.col("ends"), "begin").otherwise("middle")
    seen = marked.filter("word <> ''").withColumn("where", where)
    has = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    orthography = seen.groupBy("word").agg(has(F.col("lower")).alias("lower_seen"), has(F.col("upper")).alias("upper_seen"), has(F.col("upper") & (F.col("where") == "middle")).alias("upper_inside"), has(F.col("lower") & (F.col("where") == "begin")).alias("lower_first"))
    return Model(abbreviations, collocations, starters, orthography)


def breaks(texts: DataFrame, model: Model, text: str, keep: list[str]) -> DataFrame:
    """keep, place: the tokens that a sentence ends with."""
    yes = lambda df, name: df.withColumn(name, F.lit(True))
    # dealt however few files the texts come in
    rows = texts.select(*keep, F.col(text).alias("text_of_tokens")).repartition(*keep).select(*keep, _tokens("text_of_tokens").alias("tokens"))
    pairs = F.transform("tokens", lambda t, i: F.struct(i.alias("place"), t.alias("token"), F.get("tokens", i + 1).alias("next")))
    rows = rows.select(*keep, F.explode(F.filter(pairs, lambda p: _signed(p["token"]) & p["next"].isNotNull())).alias("t")).select(*keep, "t.*")
    rows = _kind(rows, "token").filter("stop or dots or ending").withColumn("next_word", _word(F.col("next")))
    rows = _case(rows, "next", "next_")
    rows = rows.join(yes(model.abbreviations, "abbreviated"), "word", "left").join(yes(model.collocations, "related"), ["word", "next_word"], "left")
    rows = rows.join(yes(model.starters, "starter").withColumnRenamed("word", "next_word"), "next_word", "left").join(model.orthography.withColumnRenamed("word", "next_word"), "next_word", "left")
    known = lambda c: F.coalesce(F.col(c), F.lit(False))
    begins = F.when(F.col("next_upper") & known("lower_seen") & ~known("upper_inside"), True).when(F.col("next_lower") & (known("upper_seen") | ~known("lower_first")), False)
    odd = (F.col("word") == NUMBER) | F.col("initial")
    short = F.col("dots") | (F.col("stop") & known("abbreviated") & ~F.col("initial"))
    end = (
        F.when(F.col("ending"), True)
        .when(F.col("stop") & known("related"), False)
        .when(short, F.coalesce(begins, F.lit(False)) | (F.col("next_upper") & known("starter")))
        .when(odd & F.coalesce(~begins, F.lit(False)), False)
        .when(F.col("initial") & begins.isNull() & F.col("next_upper") & ~known("lower_seen"), False)
        .otherwise(True)
    )
    return rows.filter(end).select(*keep, "place")


def split_sentences(texts: DataFrame, model: Model, text: str, keep: list[str]) -> DataFrame:
    """All rows with ``sentences``: slices of the text without the white space around them; none for null and blank texts.

    ``keep`` are the columns that tell rows apart; rows that are equal in them are taken as one text. A column
    ``sentences`` of the input is replaced.
    """
    at = breaks(texts, model, text, keep).groupBy(*keep).agg(F.sort_array(F.collect_set("place")).alias("sentence_ends"))
    at = at.select(*[F.col(k).alias(f"key_of_{i}") for i, k in enumerate(keep)], "sentence_ends")
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"key_of_{i}")) for i, k in enumerate(keep)])
    joined = texts.join(at, same, "left").select(*texts.columns, F.coalesce("sentence_ends", F.array().cast("array<int>")).alias("sentence_ends"))
    # columns of their own, as each sentence would find them anew inside of the lambda
    joined = joined.withColumn("sentence_pieces", F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(_PIECE), F.lit(0)))
    joined = joined.withColumn("sentence_ends", F.concat("sentence_ends", F.array(F.size("sentence_pieces") - 1)))
    last = lambda i: F.get("sentence_ends", i - 1)
    cut = F.transform("sentence_ends", lambda e, i: F.regexp_replace(F.array_join(F.slice("sentence_pieces", F.coalesce(last(i) + 2, F.lit(1)), e - F.coalesce(last(i), F.lit(-1))), ""), r"\s+$", ""))
    return joined.withColumn("sentences", F.when(F.size("sentence_pieces") > 0, cut).otherwise(F.array().cast("array<string>"))).drop("sentence_ends", "sentence_pieces")
