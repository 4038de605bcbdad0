"""Ranked lexical search with range maxima over posting lists.

Documents are indexed in shards: runs of whole documents of bounded bytes, by ascending id. A shard has a posting list for
each term, by document, with the term's share of the document's score (its impact), and over all lists a sparse table that
answers which posting of a range has the largest impact in two look-ups. For an item, an interval of documents cannot hold
a score above the sum of its terms' largest impacts within it. Intervals are taken by that bound, best first, and split at the
document of the largest impact, which is scored; what is left is cut once no bound reaches the k-th best score. Each shard
gives its best documents for each item, and Spark ranks them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .previous_factors import byte_slices
from .store import materialise
from .words import Words

BEST = 50
SHARD = 32_000_000  # bytes of texts in a shard
PIECE = 4_000_000  # bytes whose terms are found together
AT_ONCE = 64  # intervals split together
ITEMS_AT_ONCE, BYTES_AT_ONCE = 5_000, 4_000_000  # items of one pass over the index

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
#: bytes of terms, A-Z as a-z; all others are spaces
_SIGNS = np.array([b if b >= 128 or 48 <= b < 58 or 97 <= b < 123 else b + 32 if 65 <= b < 91 else 32 for b in range(256)], dtype=np.uint8)


def terms_of(text: str | None) -> list[str]:
    """Terms of a text with repeats: runs of ASCII letters and digits and of all signs beyond ASCII; only A-Z are lower-cased."""
    return TERM.findall((text or "").translate(_LOWER))


# --- the index


_INDEX = pa.schema([("ids", pa.binary()), ("sizes", pa.binary()), ("terms", pa.binary()), ("docs", pa.binary()), ("times", pa.binary()), ("n_docs", pa.int64()), ("n_terms", pa.int64()), ("held", pa.list_(pa.int32())), ("df", pa.list_(pa.int64()))])
_INDEX_DDL = "ids binary, sizes binary, terms binary, docs binary, times binary, n_docs long, n_terms long, held array<int>, df array<long>"


def _found(raw: np.ndarray, offsets: np.ndarray, vocabulary: pa.Array) -> tuple[np.ndarray, ...]:
    """(terms of each text with repeats; text, term, times of those of the vocabulary)."""
    words = Words(_SIGNS[raw], offsets)
    inside = words.raw != 32
    ends = np.cumsum(words.end - words.start)
    spelled = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(np.append(0, ends).astype(np.int64)), pa.py_buffer(words.raw[inside])])
    term = pc.index_in(spelled, value_set=vocabulary)
    known = np.flatnonzero(pc.is_valid(term).to_numpy(zero_copy_only=False))
    text = np.searchsorted(words.first, known, side="right") - 1
    pairs, times = np.unique(text * len(vocabulary) + pc.drop_null(term).to_numpy(zero_copy_only=False), return_counts=True)
    return np.diff(words.first), pairs // max(1, len(vocabulary)), pairs % max(1, len(vocabulary)), times


def _shard_row(ids: np.ndarray, found: list[tuple[np.ndarray, ...]]) -> dict:
    sizes, doc, term, times = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(ids, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    doc = rank[doc]
    by = np.lexsort((doc, term))
    term, doc, times = term[by], doc[by], times[by]
    held, df = np.unique(term, return_counts=True)
    return {"ids": ids[order].tobytes(), "sizes": sizes[order].astype(np.int64).tobytes(), "terms": term.astype(np.int32).tobytes(), "docs": doc.astype(np.int32).tobytes(), "times": times.astype(np.int32).tobytes(),
        "n_docs": int((sizes > 0).sum()), "n_terms": int(sizes.sum()), "held": held.tolist(), "df": df.tolist()}


def _indexed(batches: Iterator[pa.RecordBatch], vocabulary: pa.Array, shard: int) -> Iterator[pa.RecordBatch]:
    """A row for each shard."""
    ids: list[np.ndarray] = []
    found: list[tuple[np.ndarray, ...]] = []
    n_bytes = n_docs = 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([_shard_row(np.concatenate(ids), found)], schema=_INDEX)

    for batch in batches:
        for part, raw, offsets in byte_slices(batch, "text", min(PIECE, shard)):
            if found and n_bytes + len(raw) > shard:
                yield flush()
                ids, found, n_bytes, n_docs = [], [], 0, 0
            sizes, doc, term, times = _found(raw, offsets, vocabulary)
            ids.append(part.column(0).to_numpy(zero_copy_only=False))
            found.append((sizes, doc + n_docs, term, times))
            n_bytes, n_docs = n_bytes + len(raw), n_docs + part.num_rows
    if found:
        yield flush()


class Shard:
    """Posting lists of a shard with their impacts, and the place of the largest impact of every range of 2**k postings."""

    def __init__(self, row: dict, weights: np.ndarray, n_docs: int, n_terms: int):
        read = lambda c, kind: np.frombuffer(row[c], dtype=kind)
        self.ids, self.docs = read("ids", np.int64), read("docs", np.int32)
        term, times = read("terms", np.int32), read("times", np.int32).astype(np.int64)
        spread = 100 - 50 + (50 * read("sizes", np.int64) * n_docs) // max(1, n_terms)
        self.impact = weights[term] * ((1_000_000_000 * times) // (1000 * times + 20 * spread[self.docs]))
        self.key = term.astype(np.int64) * len(self.ids) + self.docs
        self.begin = np.searchsorted(term, np.arange(len(weights) + 1))
        level = np.arange(len(term), dtype=np.int32)
        self.largest = [level]
        longest, step = int(np.diff(self.begin).max(initial=0)), 1
        while 2 * step <= longest:
            left, right = level[: len(level) - step], level[step:]
            level = np.where(self.impact[right] > self.impact[left], right, left)
            self.largest.append(level)
            step *= 2
        sizes = [len(x) for x in self.largest]
        self.level_at = np.cumsum([0, *sizes[:-1]])
        self.largest = np.concatenate(self.largest)

    def _bound(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For intervals (rows) of posting ranges (columns): the sum of their largest impacts, and the document of the largest."""
        n = right - left
        some = n > 0
        level = np.where(some, np.frexp(np.maximum(n, 1).astype(np.float64))[1] - 1, 0)
        at = self.level_at[level]
        first = self.largest[at + np.where(some, left, 0)]
        second = self.largest[at + np.where(some, right - (1 << level), 0)]
        a, b = self.impact[first], self.impact[second]
        value = np.where(some, np.maximum(a, b), -1)
        top = value.argmax(axis=1)
        rows = np.arange(len(left))
        place = np.where(b > a, second, first)[rows, top]
        return np.where(some, value, 0).sum(axis=1), self.docs[place]

    def search(self, terms: np.ndarray, best: int, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Documents (numbers) and scores of the ``best`` highest scores above 0 that are ``least`` at least."""
        terms = terms[self.begin[terms + 1] > self.begin[terms]]
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(terms):
            return docs, scores
        base = terms.astype(np.int64) * len(self.ids)
        left, right = self.begin[terms][None, :], self.begin[terms + 1][None, :]
        bound, split = self._bound(left, right)
        least = max(1, least)
        while True:
            live = np.flatnonzero(bound >= least)
            if len(live) < len(bound):
                bound, split, left, right = bound[live], split[live], left[live], right[live]
            if not len(bound):
                return docs, scores
            take = np.argpartition(-bound, AT_ONCE)[:AT_ONCE] if len(bound) > AT_ONCE else np.arange(len(bound))
            rest = np.ones(len(bound), bool)
            rest[take] = False
            doc, l, r = split[take], left[take], right[take]
            place = np.clip(np.searchsorted(self.key, base + doc[:, None]), l, r)
            hit = (place < r) & (self.key[np.minimum(place, len(self.key) - 1)] == base + doc[:, None])
            score = np.where(hit, self.impact[np.minimum(place, len(self.key) - 1)], 0).sum(axis=1)
            docs, scores = np.concatenate([docs, doc]), np.concatenate([scores, score])
            if len(docs) > best:
                order = np.lexsort((docs, -scores))[:best]
                docs, scores = docs[order], scores[order]
            if len(docs) == best:
                least = max(least, int(scores.min()))
            new_left, new_right = np.concatenate([l, place + hit]), np.concatenate([place, r])
            new_bound, new_split = self._bound(new_left, new_right)
            fine = new_bound >= least
            bound, split = np.concatenate([bound[rest], new_bound[fine]]), np.concatenate([split[rest], new_split[fine]])
            left, right = np.concatenate([left[rest], new_left[fine]]), np.concatenate([right[rest], new_right[fine]])


# --- the operator


def _passes(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """Items with their terms, in parts of bounded number and bytes: what is sent out for one pass."""
    part, size = [], 0
    for r in items.select(id_col, text_col).toLocalIterator():  # a part at a time
        n = 4 * len(r[1] or "")
        if part and (len(part) == ITEMS_AT_ONCE or size + n > BYTES_AT_ONCE):
            yield part
            part, size = [], 0
        part.append((r[0], sorted(set(terms_of(r[1])))))
        size += n
    if part:
        yield part


_HIT = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", best: int = BEST, shard: int = SHARD) -> DataFrame:
    """item_id, rank, doc_id, score: the ``best`` rows with the highest scores above 0 of each item, equal scores by id.

    Scores are those of a term-frequency model with document lengths, in whole numbers: the sum over an item's terms, once
    each, of w * (10**9 * tf div (1000 * tf + 20 * m)). Null and empty texts have no terms: such rows are found by none and do
    not count among documents, such items find nothing. Equal rows are each ranked; items that share an id are ranked as one,
    in which a row comes once for each of them that finds it. Null ids count as -2**63. Very long texts are worked on
    whole, one to a piece. Other columns are not read. A table without rows gives none.

    Items go out in parts of bounded number and bytes, one pass over the documents each; what is indexed of the documents is
    the part's terms.
    """
    lowest = -(2**63)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(lowest)).alias("doc_id"), F.col(text_col).alias("text"))
    spark = docs.sparkSession
    found = rows.limit(0).selectExpr("doc_id as item_id", "doc_id", "0L as score")
    for part in _passes(items, item_col, item_text_col):
        words = sorted({t for _, terms in part for t in terms})
        vocabulary = spark.sparkContext.broadcast([t.encode() for t in words])

        def index(batches: Iterator[pa.RecordBatch], vocabulary=vocabulary) -> Iterator[pa.RecordBatch]:
            return _indexed(batches, pa.array(vocabulary.value, pa.large_binary()), shard)

        shards = materialise(rows.mapInArrow(index, _INDEX_DDL), "index")
        n_docs, n_terms = shards.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        counts = shards.select(F.explode(F.arrays_zip("held", "df")).alias("x")).groupBy("x.held").agg(F.sum("x.df").alias("df"))
        weights = np.zeros(len(words), dtype=np.int64)
        for r in counts.toLocalIterator():  # a row for each term of the part
            weights[r[0]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r[1] + 1)))
        number = {t: i for i, t in enumerate(words)}
        asked = spark.sparkContext.broadcast(([(lowest if i is None else i, np.array([number[t] for t in terms], dtype=np.int64)) for i, terms in part], weights, n_docs or 0, n_terms or 0))

        def answer(batches: Iterator[pa.RecordBatch], asked=asked) -> Iterator[pa.RecordBatch]:
            wanted, weights, n_docs, n_terms = asked.value
            reached: list[list[int]] = [[] for _ in wanted]  # best scores of this task's shards so far
            for row in (r for batch in batches for r in batch.to_pylist()):
                held = Shard(row, weights, n_docs, n_terms)
                hits = []
                for k, (item, terms) in enumerate(wanted):
                    doc, score = held.search(terms, best, reached[k][-1] if len(reached[k]) == best else 0)
                    reached[k] = sorted(reached[k] + score.tolist(), reverse=True)[:best]
                    hits.append((np.full(len(doc), item, np.int64), held.ids[doc], score))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*hits, strict=True)], schema=_HIT)

        found = found.unionByName(shards.select("ids", "sizes", "terms", "docs", "times").mapInArrow(lambda b, f=answer: f(b), "item_id long, doc_id long, score long"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))).filter(F.col("rank") <= best)
    return ranked.select("item_id", "rank", "doc_id", "score")


def op13_ranked_search(spark, sf_dir: str) -> DataFrame:
    """Query: all documents for each benchmark item."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return search(read("documents"), read("benchmark"))
