"""Benchmark passages in documents, within an edit distance in words.

Items and texts are sequences of lower-cased words. An item of n words is found where a passage is within
e = floor(share * n) word edits of it.

* Windows: e edits leave at least n-e item words in at most e+1 runs, so the longest run has at least
  ceil((n-e)/(e+1)) words: every such passage shares a gram of that many words with its item. The item's
  length laid around each shared gram gives the item-sized windows worth looking at: none is lost.
* Candidates: the CGK embedding walks over a window and repeats or leaves each word by a random bit that
  depends on the step and the word; two sequences a few edits apart fall into step again and embed with few
  differences. Each of several walks is sampled at SAMPLES sets of steps; a window and an item that agree on
  one set are candidates. The number of steps in a set and of walks is taken from the item's length and
  edits by ``plan``, for a recall of over 0.95 at e random edits (tests: 0.9 for 3 to 60 words, share to 0.4).
* Verification: the exact edit distance between the item and the best passage around the window.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Ranges, Words, mix, slices, string_bytes

SHARE = 0.2
SAMPLES = 10
ITEMS_AT_ONCE, BYTES_AT_ONCE = 20_000, 8_000_000  # of one pass over the documents; one longer item alone
HITS_AT_ONCE, WORDS_AT_ONCE = 1 << 20, 1 << 18


def gram_of(n: int, e: int) -> int:
    """Words of the longest run that e edits are sure to leave of n words."""
    return -(-(n - e) // (e + 1)) if n else 0


def plan(n: int, e: int) -> tuple[int, int]:
    """Steps in a sample, and walks, for items of n words and e edits."""
    part = e / max(n, 1)
    return (3, 12) if part <= 0.2 else (2, 16) if part <= 0.3 else (1, 12)


class _OfLength:
    """Items of the same number of words and edits: their keys by walk and sample."""

    def __init__(self, n: int, e: int, items: np.ndarray, words: np.ndarray):
        self.n = n
        self.places_of_sample, self.walks = plan(n, e)
        # sampled steps, from those that windows of n words usually reach
        self.places = np.random.default_rng(n).integers(0, max(1, 2 * n), size=(self.walks, SAMPLES, self.places_of_sample))
        key = self.keys(words).reshape(-1)
        order = np.argsort(key, kind="stable")
        self.key, self.item = key[order], np.repeat(items, self.tries)[order]

    @property
    def tries(self) -> int:
        return self.walks * SAMPLES

    def keys(self, x: np.ndarray) -> np.ndarray:
        """For windows of n words, one a row (0 outside the text), a key of each sample of each walk."""
        m, last = len(x), int(self.places.max()) + 1
        x = np.concatenate([x, np.zeros((m, 1), np.uint64)], axis=1).reshape(-1)
        out, start = np.empty((m, self.walks, SAMPLES), dtype=np.uint64), np.arange(m) * (self.n + 1)
        stop = start + self.n
        for walk in range(self.walks):
            seeds = mix(np.arange(last, dtype=np.uint64) + np.uint64(walk << 32), 77) | np.uint64(1)
            at, seen = start.copy(), np.empty((last, m), dtype=np.uint64)
            for step in range(last):
                word = x[at]
                seen[step] = word
                at = np.minimum(at + ((word * seeds[step]) >> np.uint64(63)).astype(np.int64), stop)
            k = np.broadcast_to((np.arange(SAMPLES) + walk * SAMPLES).astype(np.uint64), (m, SAMPLES))
            for p in range(self.places_of_sample):
                k = mix(k * np.uint64(0x9E3779B97F4A7C15) + seen[self.places[walk, :, p]].T)
            out[:, walk] = k
        return out.reshape(m, -1)

    def candidates(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of x, item) of the windows and items that agree on a sample."""
        rows, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        step = max(1, WORDS_AT_ONCE // (self.n + 1))
        for at in range(0, len(x), step):
            keys = self.keys(x[at : at + step]).reshape(-1)
            lo, hi = np.searchsorted(self.key, keys), np.searchsorted(self.key, keys, side="right")
            many = hi - lo
            rows.append(np.repeat(at + np.arange(len(keys)) // self.tries, many))
            items.append(self.item[np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())])
        found = np.unique(np.stack([np.concatenate(rows), np.concatenate(items)], axis=1), axis=0)
        return found[:, 0], found[:, 1]


class Items:
    """The items of one pass: their grams, and by length the keys of their embeddings."""

    def __init__(self, ids: list, texts: list[str], share: float = SHARE):
        raw, offsets = string_bytes(pa.array(texts, pa.large_string()))
        words = Words(raw, offsets)
        h = words.hashes(lower=True)
        self.ids = np.array(ids, dtype=np.int64)
        self.words = [h[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        self.n = np.diff(words.first)
        self.edits = np.floor(share * self.n + 1e-9).astype(int)
        ranges, rows = Ranges(h), []
        for first, n, e in zip(words.first, self.n.tolist(), self.edits.tolist(), strict=False):
            if size := gram_of(n, e):
                at = np.arange(n - size + 1)
                rows.append(np.stack([ranges(first + at, first + at + size), at.astype(np.uint64), np.full(len(at), n, np.uint64), np.full(len(at), size, np.uint64)]))
        # windows depend on the gram, its place and the length alone, whatever the item
        grams = np.unique(np.concatenate(rows, axis=1), axis=1) if rows else np.zeros((4, 0), np.uint64)
        self.gram, self.at, self.length, self.size = grams[0], *(g.astype(np.int64) for g in grams[1:])
        self.sizes = sorted(set(self.size.tolist()))
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[(self.gram & np.uint64(0xFFFFF)).astype(np.int64)] = True
        self.by_length = {}
        for n in np.unique(self.n[self.n > 0]).tolist():
            own = np.flatnonzero(self.n == n)
            self.by_length[n] = _OfLength(n, int(self.edits[own[0]]), own, np.stack([self.words[i] for i in own]))


def infix_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least word edits between the item and any passage of the text, with the passage's start and end."""
    n = len(text)
    row, began = np.zeros(n + 1, dtype=np.int64), np.arange(n + 1)
    place = np.arange(n + 1)
    for k, word in enumerate(item, 1):
        change, drop = row[:-1] + (text != word), row + 1
        best, source = drop.copy(), began.copy()
        take = change < best[1:]
        best[1:], source[1:] = np.where(take, change, best[1:]), np.where(take, began[:-1], source[1:])
        # insertions run along the row: the least of best[j] + (i - j)
        least = np.minimum.accumulate(best - place)
        from_ = np.maximum.accumulate(np.where(best - place == least, place, 0))
        row, began = least + place, source[from_]
    end = int(np.argmin(row))
    return int(row[end]), int(began[end]), end


def _windows(words: Words, h: np.ndarray, items: Items) -> np.ndarray:
    """Distinct (text, start, length) of item-sized windows around shared grams; starts may lie outside."""
    ranges, ends, found = Ranges(h), words.ends_of_text(), [np.zeros((0, 3), np.int64)]
    for size in items.sizes:
        at = np.arange(max(0, len(h) - size + 1))
        at = at[at + size <= ends[: len(at)]]
        grams = ranges(at, at + size)
        hit = items.maybe[(grams & np.uint64(0xFFFFF)).astype(np.int64)]
        at, grams = at[hit], grams[hit]
        lo, hi = np.searchsorted(items.gram, grams), np.searchsorted(items.gram, grams, side="right")
        # grams that many items begin with are taken in parts of bounded size
        cuts = np.unique(np.searchsorted(np.cumsum(hi - lo), np.arange(HITS_AT_ONCE, int((hi - lo).sum()) + 1, HITS_AT_ONCE)))
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)], strict=True):
            many = (hi - lo)[a:b]
            which = np.repeat(lo[a:b] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            here = np.repeat(at[a:b], many)
            fits = items.size[which] == size
            here, which = here[fits], which[fits]
            text = np.searchsorted(words.first, here, side="right") - 1
            found.append(np.unique(np.stack([text, here - items.at[which] - words.first[text], items.length[which]], axis=1), axis=0))
    return np.unique(np.concatenate(found), axis=0)


def _leaks(words: Words, items: Items) -> list[tuple[int, int, int, int, int]]:
    """(text, item, distance, first word, end word) of the passages found."""
    h = words.hashes(lower=True)
    windows = _windows(words, h, items)
    pairs = set()
    for n in np.unique(windows[:, 2]).tolist():
        of_n = windows[windows[:, 2] == n]
        step = max(1, WORDS_AT_ONCE // n)
        for k in range(0, len(of_n), step):
            part = of_n[k : k + step]
            first, end = words.first[part[:, 0], None], words.first[part[:, 0] + 1, None]
            place = first + part[:, 1:2] + np.arange(n)
            x = np.where((place >= first) & (place < end), h[np.clip(place, 0, len(h) - 1)], np.uint64(0))
            row, item = items.by_length[n].candidates(x)
            pairs.update(zip(part[row, 0].tolist(), item.tolist(), part[row, 1].tolist(), strict=True))
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for text, i, start in sorted(pairs):
        if best.get((text, i), (1,))[0] == 0:
            continue  # no better passage, and none further left
        e, n, first, end = int(items.edits[i]), int(items.n[i]), int(words.first[text]), int(words.first[text + 1])
        a, b = max(first, first + start - 2 * e), min(end, first + start + n + 2 * e)
        if np.isin(items.words[i], h[a:b]).sum() < n - e:
            continue  # more than e of its words are not there at all
        d, s, t = infix_distance(items.words[i], h[a:b])
        if d <= e and (d, a - first + s) < best.get((text, i), (e + 1, 0))[:2]:
            best[text, i] = d, a - first + s, a - first + t
    return [(text, int(items.ids[i]), *v) for (text, i), v in sorted(best.items())]


_READY: dict[tuple, Items] = {}


def _ready(sent: tuple, share: float) -> Items:
    """The pass's items, prepared once by each Python worker."""
    name, ids, texts = sent
    if (name, share) not in _READY:
        _READY.clear()
        _READY[name, share] = Items(ids, texts, share)
    return _READY[name, share]


LEAK = "doc_id long, item_id long, distance int, word_start int, word_end int"


def _passes(benchmark: DataFrame) -> Iterator[tuple]:
    """The benchmark in parts of at most ITEMS_AT_ONCE items and BYTES_AT_ONCE bytes: what is broadcast for one pass."""
    known = benchmark.select("item_id", "text").filter("text is not null and item_id is not null")
    ids, texts, size = [], [], 0
    for r in known.toLocalIterator():  # a part at a time
        n = 4 * len(r["text"])
        if ids and (len(ids) == ITEMS_AT_ONCE or size + n > BYTES_AT_ONCE):
            yield uuid.uuid4().hex, ids, texts
            ids, texts, size = [], [], 0
        ids.append(r["item_id"])
        texts.append(r["text"])
        size += n
    if ids:
        yield uuid.uuid4().hex, ids, texts


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE) -> DataFrame:
    """Per row and item found in it: doc_id, item_id, distance, word_start, word_end (best passage).

    Items are sent to the tasks in parts of bounded number and bytes; each such part is one pass over the
    documents, so no task ever holds more. Null and empty items match nothing, null and empty texts hold
    nothing. Rows stand alone: repeated rows are each reported, as are repeated items, a null id stays null.
    Of passages at the same distance the leftmost is reported. Other columns are not read. Very long texts
    are worked on whole, their windows in parts.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = rows.limit(0).selectExpr("doc_id", "0L as item_id", "0 as distance", "0 as word_start", "0 as word_end")

    for part in _passes(benchmark):
        items = docs.sparkSession.sparkContext.broadcast(part)

        def scan(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            ready = _ready(items.value, share)
            for batch in batches:
                for piece, words in slices(batch, "text"):
                    if leaks := _leaks(words, ready):
                        text, item, *rest = zip(*leaks, strict=True)
                        cols = [piece.column(0).take(pa.array(text)), pa.array(item, pa.int64()), *(pa.array(c, pa.int32()) for c in rest)]
                        yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in LEAK.split(", ")])

        found = found.unionByName(rows.mapInArrow(lambda b, f=scan: f(b), LEAK))
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", share: float = SHARE) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no passage of any item. One pass for each part of the items."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    for part in _passes(benchmark):
        items = docs.sparkSession.sparkContext.broadcast(part)

        def scan(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            ready = _ready(items.value, share)
            for batch in batches:
                for piece, words in slices(batch, text_col):
                    held = {text for text, *_ in _leaks(words, ready)}
                    yield piece.filter(pa.array([i not in held for i in range(piece.num_rows)]))

        docs = docs.mapInArrow(lambda b, f=scan: f(b), schema)
    return docs


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    """Query: all documents against the whole benchmark."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return find_leaks(read("documents").select("doc_id", "text"), read("benchmark"))
