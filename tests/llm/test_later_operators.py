"""Later copies, tokenizer alignment and ranked search against brute force, and on hard inputs."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest
from oracle import data
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("public_tokenizers")
from turnstream.llm import previous_factors as pf  # noqa: E402
from turnstream.llm import ranked_search as rs  # noqa: E402
from turnstream.llm import tokenizer_alignment as ta  # noqa: E402

LONG = "x" * 30_000
HARD = [None, "", " \n\t", "a", "É\xa0x", "one two three four " * 9, LONG, LONG, "w " * 20_000, "same words here again and again " * 40, "same words here again and again " * 40, "日本語の文章です。" * 20, "z日本語の文章です。" * 20]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(data("sf0.001") + "/documents.parquet")


@pytest.fixture(scope="module")
def hard(spark):
    """Nulls, empty and long texts, repeated rows and ids, clashing columns."""
    rows = [(i, t, "q", 1, 1.0) for i, t in enumerate(HARD)] + [(3, "a", "q", 2, None), (3, HARD[9], None, None, None), (3, HARD[5], None, None, None), (None, HARD[5] + "!", "z", 3, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, spans string, score int, part double")


def rows_of(df) -> list[tuple]:
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# --- 11


def later_copies(rows: list[tuple], length: int) -> list[tuple]:
    key = lambda i: -(2**63) if i is None else i
    first: dict[bytes, int] = {}
    for i, t in rows:
        b = (t or "").encode()
        for s in {b[j : j + length] for j in range(len(b) - length + 1)}:
            first[s] = min(first.get(s, 2**63), key(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if first[b[j : j + length]] < key(i):
                gone[j : j + length] = b"\1" * length
        runs = sum(1 for j, g in enumerate(gone) if g and not (j and gone[j - 1]))
        out.append((key(i), len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def found_copies(df, **parameters) -> list[tuple]:
    out = pf.remove_later_copies(df, **parameters).select("doc_id", "n_bytes", "n_removed", F.size("removed").alias("n"), F.sha2("kept", 256).alias("h"))
    return sorted(map(tuple, out.collect()))


@pytest.mark.parametrize("which", ["docs", "hard"])
@pytest.mark.parametrize("most", [0, pf.MOST_OF_ANCHOR])
def test_later_copies(which, most, request):
    """As anchors' segments, and with all anchors dealt out by their strings."""
    df = request.getfixturevalue(which)
    assert found_copies(df, most=most) == later_copies(rows_of(df), pf.LENGTH)


def test_no_rows_no_copies(hard):
    assert found_copies(hard.filter("false")) == []


@pytest.mark.parametrize(("length", "gram"), [(8, 8), (20, 8), (30, 17), (70, 8)])
def test_lengths_and_anchors(spark, length, gram):
    """Short alphabets, in which nearly all anchors are shared, and strings that lie across slices of documents."""
    rng = random.Random(length)
    base = ["".join(rng.choice("ab") for _ in range(rng.randrange(300))) for _ in range(20)]
    texts = base + [a[: len(a) // 2] + b[len(b) // 2 :] for a in base[:6] for b in base[6:9]]
    rows = [(rng.randrange(40), t) for t in texts]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found_copies(df, length=length, gram=gram) == later_copies(rows, length)
    with pytest.raises(ValueError):
        pf.remove_later_copies(df, length=71, gram=8)


def test_anchors_are_dealt_evenly():
    """Anchors are the smallest hashes of their strings; no bucket may hold more than its share for that."""
    raw = np.random.default_rng(5).integers(97, 123, 400_000, dtype=np.uint8)
    key = pf.anchors(raw, np.array([0, len(raw)]))[3]
    held = np.bincount(pf._bucket(key, 48), minlength=48)
    assert len(held) == 48 and held.max() < 1.5 * held.mean() and held.min() > held.mean() / 1.5
    rows = pf._dealt(iter([pf.pa.RecordBatch.from_pydict({"doc_id": [1], "text": [raw.tobytes().decode()]})]), pf.LENGTH, pf.GRAM, 5, 48)
    dealt = [(r["bucket"], pf._unpacked(r["packed"])[0]) for batch in rows for r in batch.to_pylist()]
    assert len(dealt) == 48 and all((pf._bucket(k, 48) == b).all() for b, k in dealt)
    assert sorted(np.concatenate([k for _, k in dealt])) == sorted(key)


def test_copies_within_a_document_stay(spark):
    line = "this line comes again and again, over and over, in one document. "
    df = spark.createDataFrame([(1, line * 5), (2, "A " + line + "B"), (3, line * 2)], "doc_id long, text string")
    out = {r.doc_id: (bytes(r.kept).decode(), [tuple(x) for x in r.removed]) for r in pf.remove_later_copies(df).collect()}
    assert out[1] == (line * 5, [])
    assert out[2] == ("AB", [(1, 2 + len(line))])  # a line ends with a space, as the first one has before its second line
    assert out[3] == ("", [(0, 2 * len(line))])


@pytest.mark.parametrize("seed", range(5))
def test_previous_factors(seed):
    rng = np.random.default_rng(seed)
    length, texts = 6, [rng.integers(97, 99, rng.integers(6, 30)).astype(np.uint8) for _ in range(12)]
    begin = np.cumsum([0, *map(len, texts)])
    starts = np.concatenate([b + np.arange(len(t) - length + 1) for b, t in zip(begin, texts)])
    rank = np.concatenate([np.full(len(t) - length + 1, i // 2) for i, t in enumerate(texts)])
    raw = np.concatenate(texts)
    common = lambda a, b: next((k for k in range(length) if raw[a + k] != raw[b + k]), length)
    longest, source = pf.previous_factors(raw, starts, rank, length)
    wanted = [max((common(a, b) for b, q in zip(starts, rank) if q < r), default=0) for a, r in zip(starts, rank)]
    assert longest.tolist() == wanted
    for a, r, n, q in zip(starts, rank, longest, source):
        assert n == 0 or (q < r and any(common(a, b) == n for b, o in zip(starts, rank) if o == q))


# --- 12


A, B = tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model")
SIGNS = [None, "", " ", "  ", "a  b ", "\n a", "▁a b", "<s> a <|endoftext|> x", "a\x00b", "é  x", "x  y", "a　 b", "don't  \t go \u0085 x", "a b", "a b", "日本 語 한국", "a\x1c b\x1f c", "x  y  ", "  lead", "😀 👍🏽 é", "word " * 3000, "q" * 5000]


def aligned(texts: list) -> list[tuple]:
    """Whole texts, token by token."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_model, b_model, tokens = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), ta.Tokens(A, B)
    a_model.encode_special_tokens = True
    rows, count = [], collections.Counter()
    for t in texts:
        a, b = (a_model.encode(" " + t, add_special_tokens=False).ids, b_model.encode(t)) if t else ([], [])
        whole = [b"".join(side[i] for i in ids) == (" " + (t or "")).encode() for side, ids in ((tokens.bytes_a, a), (tokens.bytes_b, b))]
        if not all(whole):
            a, b = [], []
        ends = [np.cumsum([len(side[i]) for i in ids]).tolist() for side, ids in ((tokens.bytes_a, a), (tokens.bytes_b, b))]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = []
        for lo, hi in zip([0, *cuts], cuts):
            groups.append("|".join(",".join(str(i) for i, e in zip(ids, end) if lo < e <= hi) for ids, end in ((a, ends[0]), (b, ends[1]))))
        links, x, y = [], 0, 0
        while x < len(a):
            links.append((a[x], b[y]))
            p, q = ends[0][x], ends[1][y]
            x, y = x + (p <= q), y + (q <= p)
        count.update(set(links))
        rows.append((len(a), len(b), len(groups), links, ";".join(groups)))
    best: dict[int, int] = {}
    for (i, _), n in count.items():
        best[i] = max(best.get(i, 0), n)
    return sorted((na, nb, ng, len(ls), sum(count[p] == best[p[0]] for p in ls), sum(count[p] for p in ls), g) for na, nb, ng, ls, g in rows)


@pytest.mark.parametrize("which", ["docs", "signs"])
def test_alignment(spark, docs, which):
    df = docs if which == "docs" else spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(SIGNS)], "doc_id long, text string, groups string, slice int").repartition(3)
    out = ta.align(df, A, B).select("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups").collect()
    assert sorted(map(tuple, out)) == aligned([t for _, t in rows_of(df)])
    digests = ta.align(df, A, B, digest=True).select("doc_id", "groups").collect()
    assert {r.groups for r in digests} == {hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "" for r in out}
    assert ta.align(df.filter("false"), A, B).count() == 0


def test_store_of_words_is_bounded(monkeypatch):
    tokens = ta.Tokens(A, B)
    monkeypatch.setattr(ta, "CACHED_WORDS", 3)
    tokens.words(["a", "bb", "ccc", "dddd"])
    places = tokens.words(["bb", "zz"])
    assert len(tokens.place) == 2
    assert tokens.lists(0).take(places.tolist()).to_pylist() == [e.ids for e in tokens.a.encode_batch([" bb", " zz"], add_special_tokens=False)]


# --- 13


def ranked(rows: list[tuple], items: list[tuple], best: int) -> list[tuple]:
    held = [(i, collections.Counter(rs.terms_of(t))) for i, t in rows]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in held:
            m = 100 - 50 + (50 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(rs.terms_of(text)) if t in c)
            if score > 0:
                found.append((-score, i))
        out += [(item, k + 1, i, -s) for k, (s, i) in enumerate(sorted(found)[:best])]
    return sorted(out)


@pytest.mark.parametrize("shard", [1, 20_000, rs.SHARD])
@pytest.mark.parametrize("best", [1, 7, 50])
def test_ranks(spark, docs, shard, best):
    items = spark.read.parquet(data("sf0.001") + "/benchmark.parquet")
    out = rs.search(docs.repartition(3), items, best=best, shard=shard).collect()
    assert sorted(map(tuple, out)) == ranked(rows_of(docs), [(r.item_id, r.text) for r in items.collect()], best)


def test_hard_ranks(spark):
    """Ties, repeated rows, nulls, terms that all or no documents hold, and items without terms."""
    texts = ["alpha beta", "alpha beta", "Alpha  BETA gamma", None, "", "...", "É é É x", "alpha " * 2000, "beta"] + ["alpha gamma delta"] * 30
    rows = [(i, t, i, "y") for i, t in enumerate(texts)]
    items = [(1, "alpha"), (2, "ALPHA, gamma; delta beta"), (3, None), (4, "?!"), (5, "É"), (6, "nothing of this"), (7, "alpha alpha alpha")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int, item_id string").repartition(4)
    asked = spark.createDataFrame(items, "item_id long, text string")
    for best in (3, 50):
        out = rs.search(df, asked, best=best, shard=40).collect()
        assert sorted(map(tuple, out)) == ranked([(i, t) for i, t, *_ in rows], items, best)
    assert rs.search(df.filter("false"), asked).count() == 0
    assert rs.search(df, asked.filter("false")).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_search_in_a_shard(seed, monkeypatch):
    """The best of a shard, also those that a bound from elsewhere leaves, as scoring every document finds them."""
    monkeypatch.setattr(rs, "AT_ONCE", 1 + seed)
    rng = np.random.default_rng(seed)
    n, v = 200, 12
    times = rng.integers(0, 4, (n, v)) * (rng.random((n, v)) < 0.3)
    doc, term = np.nonzero(times)
    sizes = times.sum(axis=1)
    row = rs._shard_row(np.arange(n) * 3, [(sizes, doc, term, times[doc, term])])
    weights = rng.integers(0, 50, v)
    shard = rs.Shard(row, weights, n, int(sizes.sum()))
    spread = 50 + 50 * sizes * n // sizes.sum()
    impact = weights * ((10**9 * times) // np.maximum(1, 1000 * times + 20 * spread[:, None]))
    for terms in (np.arange(v), np.array([3]), rng.permutation(v)[:5]):
        score = impact[:, terms].sum(axis=1)
        order = [i for i in np.lexsort((np.arange(n), -score)).tolist() if score[i] > 0]
        docs, scores = shard.search(terms, 10)
        assert sorted(zip((-scores).tolist(), docs.tolist())) == [(-score[i], i) for i in order[:10]]
        least = int(score[order[4]])
        docs, scores = shard.search(terms, 10, least)
        got = sorted(zip((-scores).tolist(), docs.tolist()))
        assert [x for x in got if -x[0] >= least] == [(-score[i], i) for i in order[:10] if score[i] >= least]
