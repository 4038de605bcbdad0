"""Sentence boundaries: the model against a plain trainer, and texts with planted abbreviations."""

import collections
import math
import re
import time

from oracle import data

from turnstream.operators import sentences as s

OPEN, CLOSE, MARKS = "\"'([{«“„‘", "\"')]}»”’", ",;:.?!\"')]}»”’"


def word_of(token):
    core = token.lstrip(OPEN).rstrip(MARKS).lower()
    return s.NUMBER if re.fullmatch(r"[-+]?[0-9]+([.,:/-][0-9]+)*", core) else core


class Token:
    def __init__(self, token):
        bare = token.lstrip(OPEN).rstrip(CLOSE)
        self.word = word_of(token)
        self.dots = bool(re.search(r"\.\.+$", bare)) or bare.endswith("…")
        self.stop = bare.endswith(".") and not self.dots
        self.ending = bare.endswith(("?", "!"))
        self.initial = self.stop and len(self.word) == 1 and self.word.isalpha()
        first = token.lstrip(OPEN)[:1]
        self.upper = first.upper() != first.lower() and first == first.upper()
        self.lower = first.upper() != first.lower() and first == first.lower()
        self.odd = self.word == s.NUMBER or self.initial


def log_ratio(a, b, both, n):
    def part(k, of, p):
        return (k * math.log(p) if k > 0 else 0) + ((of - k) * math.log(1 - p) if of > k else 0)

    return -2 * (part(both, a, b / n) + part(b - both, n - a, b / n) - part(both, a, both / a) - part(b - both, n - a, (b - both) / (n - a) if n > a else 0))


def plain_model(texts):
    rows = [[Token(t) for t in (x or "").split()] for x in texts]
    every = [t for r in rows for t in r]
    n, stops = len(every), sum(t.stop for t in every)
    times = collections.Counter(t.word for t in every if t.word)
    dotted = collections.Counter(t.word for t in every if t.stop and re.search(r"[^\W\d_]", t.word))
    short = set()
    for w, k in dotted.items():
        inner = w.count(".")
        signs, rest = len(w) - inner, times[w] - k
        p = stops / n
        ratio = -2 * (k * math.log(p) + rest * math.log(1 - p + 1e-8) - k * math.log(0.99) - rest * math.log(0.01))
        if ratio * math.exp(-signs) * (inner + 1) * signs ** -float(rest) >= s.ABBREVIATION:
            short.add(w)
    ends = lambda t: t.ending or (t.stop and t.word not in short)
    pairs, firsts, seen = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for r in rows:
        if r and r[0].word:
            seen[r[0].word].add(("begin", r[0].upper, r[0].lower))
        for a, b in zip(r, r[1:]):
            if not b.word:
                continue
            if a.stop and (a.word in short or a.odd) and (a.word == s.NUMBER or re.search(r"[^\W\d_]", a.word)):
                pairs[a.word, b.word] += 1
            if ends(a) and not a.odd and re.fullmatch(r"[^\W\d_]+", b.word):
                firsts[b.word] += 1
            unknown = (a.stop and (a.word in short or a.odd)) or a.dots
            seen[b.word].add(("unknown" if unknown else "begin" if ends(a) else "middle", b.upper, b.lower))
    breaks = sum(map(ends, every))
    related = {(a, b) for (a, b), k in pairs.items() if k > 1 and log_ratio(times[a], times[b], k, n) >= s.COLLOCATION and n / times[a] > times[b] / k}
    starters = {w for w, k in firsts.items() if log_ratio(breaks, times[w], k, n) >= s.STARTER and n / breaks > times[w] / k}
    return short, related, starters, seen


def collected(model):
    rows = lambda df: {tuple(r) if len(r) > 1 else r[0] for r in df.collect()}
    return rows(model.abbreviations), rows(model.collocations), rows(model.starters)


PLANTED = [f"We met Dr. Miller near approx. {k} houses. The weather was fine, e.g. on Monday. Then Dr. Jones left! The rest stayed. On Monday all houses stayed fine and the rest left." for k in range(80)]


def test_model_equals_plain_trainer(spark):
    turns = [r.text for r in spark.read.parquet(data("sf0.001") + "/conversations.parquet").collect()]
    texts = turns + PLANTED + [None, "", "  ", "(No. 7) A. B. said: \"Yes.\" He left... Then? OK", "z.B. 12. Mai 3.5. x"]
    model = s.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    short, related, starters, seen = plain_model(texts)
    assert collected(model) == (short, related, starters)
    assert {"dr", "approx", "e.g"} <= short
    assert "houses" not in short
    wanted = {w: (any(x[2] for x in v), any(x[1] for x in v), any(x[0] == "middle" and x[1] for x in v), any(x[0] == "begin" and x[2] for x in v)) for w, v in seen.items()}
    assert {r.word: (r.lower_seen, r.upper_seen, r.upper_inside, r.lower_first) for r in model.orthography.collect()} == wanted


def test_abbreviations_do_not_cut(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*PLANTED, None, " ", "One. Two"])], "id long, text string")
    model = s.train(df)
    out = {r.id: r.sentences for r in s.split_sentences(df, model, "text", ["id"]).collect()}
    assert out[3] == ["We met Dr. Miller near approx. 3 houses.", "The weather was fine, e.g. on Monday.", "Then Dr. Jones left!", "The rest stayed.", "On Monday all houses stayed fine and the rest left."]
    assert out[80] == out[81] == []
    assert out[82] == ["One.", "Two"]


def test_sentences_keep_the_text(spark):
    """Sentences are slices in order that leave out white space only; a full stop of a common word ends one."""
    df = spark.read.parquet(data("sf0.001") + "/conversations.parquet").select("conv_id", "turn", "text")
    out = s.split_sentences(df, s.train(df), "text", ["conv_id", "turn"]).collect()
    assert len(out) == df.count()
    for r in out:
        assert "".join("".join(r.sentences).split()) == "".join((r.text or "").split())
        assert all(x == x.strip() and x in r.text for x in r.sentences)
    assert s.split_sentences(df.filter("false"), s.train(df.filter("false")), "text", ["conv_id", "turn"]).count() == 0


def test_long_texts_and_many_equal_ones(spark):
    """A text of 20,000 sentences is cut in time with its length; what is counted of texts does not grow with equal ones."""
    wanted = [f"We saw {i % 50} of them!" for i in range(20_000)]
    df = spark.createDataFrame([(1, " \n".join(wanted))], "id long, text string")
    model = s.train(df)
    began = time.monotonic()
    assert s.split_sentences(df, model, "text", ["id"]).first().sentences == wanted
    assert time.monotonic() - began < 60
    few = spark.createDataFrame([(t,) for t in PLANTED[:3]], "text string")
    many = few.crossJoin(spark.range(50)).select("text")
    once, often = ({tuple(v for k, v in r.asDict().items() if k != "n"): r.n for r in s.counted(x, "text").collect()} for x in (few, many))
    assert often == {k: 50 * n for k, n in once.items()}
