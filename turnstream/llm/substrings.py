"""Long repeated passages: a De Bruijn graph of token k-mers, compacted, with source coordinates.

The graph is sampled. Of the k-mers in each window of ``window`` words the one with the smallest hash is the
window's edge (the leftmost of equal ones), so equal windows, wherever they are, have the same edge at the
same place. Consecutive windows with one edge form its path: the words from the first window's start to the
last window's end. A path is one row, however many windows it holds, and knows the edge that follows.

1. Edges that occur once cannot lie in a repeated window and go.
2. Paths are counted. An edge that has the same path wherever it occurs, is followed by the same edge
   wherever it occurs, and occurs as often as that one, has one way in and one way out: the two are
   contracted. Joins double the reach of each contracted path until all chains are whole (``compacted``),
   and only their first edges are looked up again: a long passage is one row a copy.
3. An edge with several different paths branches. Paths that occur again repeat in all their windows; around
   edges that have a path seen once, paths are opened into their windows, which are counted one by one.
4. Repeated paths and windows are joined back to their source coordinates and merged into spans of words.

Equal rows are found by 64-bit hashes and verified on their words: at its source coordinates each path and
each opened window also gives the BLAKE2b digest of its very words (``proof``), and only rows that agree on
both are the same passage.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialise
from .words import Ranges, Words, slices

WINDOW = 35
KMER = 10


def _leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values the index of its smallest, the leftmost of equal ones."""
    at = np.arange(len(values))
    least, have = values, 1
    while have < width:
        step = min(have, width - have)
        right = least[step:]
        take = right < least[:-step]
        at, least = np.where(take, at[step:], at[:-step]), np.where(take, right, least[:-step])
        have += step
    return at


class Digests:
    """Digests of ranges [i, j) of words: of the words themselves, a space between each two."""

    def __init__(self, words: Words):
        sizes = words.end - words.start
        self.at = np.concatenate([[0], np.cumsum(sizes + 1)])
        joined = np.full(int(self.at[-1]), 32, dtype=np.uint8)
        for k in range(0, len(sizes), 1 << 16):  # a part at a time, as the places of bytes take eight times their room
            n, start, at = sizes[k : k + (1 << 16)], words.start[k : k + (1 << 16)], self.at[:-1][k : k + (1 << 16)]
            byte = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            joined[np.repeat(at, n) + byte] = words.raw[np.repeat(start, n) + byte]
        self.joined = memoryview(joined)

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        joined = self.joined
        spans = zip(self.at[i].tolist(), (self.at[j] - 1).tolist(), strict=True)
        return np.frombuffer(b"".join([blake2b(joined[a:b], digest_size=8).digest() for a, b in spans]), dtype=np.int64)


def _paths(words: Words, window: int, k: int, whole_paths: bool = True) -> dict[str, np.ndarray]:
    """The paths of all texts in a slice: text number, first window, number of windows, edge; their hash and digest."""
    n, a = len(words), Ranges(words.hashes())
    none = np.zeros(0, np.int64)
    if n < window:
        return {x: none for x in ("text", "lo", "n", "edge", "path", "proof", "next")} | {"followed": none.astype(bool)}
    starts = np.arange(n - window + 1)
    ends = words.ends_of_text()[: len(starts)]
    kmers = np.arange(n - k + 1)
    edges = a(kmers, kmers + k)
    least = _leftmost_least(edges, window - k + 1)
    whole = starts + window <= ends  # not beyond its text
    text = np.searchsorted(words.first, starts, side="right") - 1
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | ~whole[:-1] | (text[1:] != text[:-1])
    first = np.flatnonzero(new & whole)
    # a path ends before the next one starts, or where windows stop being whole
    stop = np.flatnonzero(np.append(new[1:] | ~whole[1:], True) & whole)
    lo, hi = first, stop
    end = hi + window
    as_long = lambda x: x.view(np.int64)
    found = {"text": text[lo], "lo": lo - words.first[text[lo]], "n": hi - lo + 1, "edge": as_long(edges[least[lo]])}
    if not whole_paths:
        return found
    followed = np.zeros(len(lo), dtype=bool)
    followed[:-1] = (lo[1:] == hi[:-1] + 1) & (text[lo[1:]] == text[lo[:-1]])
    return found | {"path": as_long(a(lo, end)), "proof": Digests(words)(lo, end), "followed": followed, "next": np.roll(found["edge"], -1)}


_PATH_SCHEMA = pa.schema([("doc_id", pa.int64()), ("copy", pa.int64()), ("lo", pa.int32()), ("n", pa.int32()), ("edge", pa.int64()), ("path", pa.int64()), ("proof", pa.int64()), ("next", pa.int64())])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and text with a second key, so that equal ids with different texts stay apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("doc_id"), F.xxhash64(text).alias("copy"), text.alias("text"))


def _all_paths(rows: DataFrame, window: int, k: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in slices(batch, "text"):
                p = _paths(words, window, k)
                keys = [part.column(c).take(pa.array(p["text"])) for c in (0, 1)]
                rest = [pa.array(p[c].astype(np.int32)) for c in ("lo", "n")] + [pa.array(p[c]) for c in ("edge", "path", "proof")] + [pa.array(p["next"], mask=~p["followed"])]
                yield pa.RecordBatch.from_arrays(keys + rest, schema=_PATH_SCHEMA)

    return rows.mapInArrow(scan, "doc_id long, copy long, lo int, n int, edge long, path long, proof long, next long")


def _all_edges(rows: DataFrame, window: int, k: int) -> DataFrame:
    """Edge occurrences, counted within each batch before they are shuffled."""
    schema = pa.schema([("edge", pa.int64()), ("n", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_paths(words, window, k, whole_paths=False)["edge"] for _, words in slices(batch, "text")]
            edge, n = np.unique(np.concatenate(found or [np.zeros(0, np.int64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(edge), pa.array(n)], schema=schema)

    return rows.select("text").mapInArrow(scan, "edge long, n long")


def _opened(texts: DataFrame, paths: DataFrame, window: int) -> DataFrame:
    """The windows of the given paths, read again from their texts: doc_id, copy, at, hash, proof."""
    wanted = paths.groupBy("doc_id", "copy").agg(F.collect_set(F.struct("lo", "n")).alias("paths"))
    schema = pa.schema([("doc_id", pa.int64()), ("copy", pa.int64()), ("at", pa.int32()), ("hash", pa.int64()), ("proof", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in slices(batch, "text"):
                a, b = Ranges(words.hashes()), Digests(words)
                for i, spans in enumerate(part.column("paths").to_pylist()):
                    at = np.unique(np.concatenate([np.arange(s["lo"], s["lo"] + s["n"]) for s in spans]))
                    w = at + words.first[i]
                    keys = [pa.array(np.full(len(at), part.column(c)[i].as_py(), dtype=np.int64)) for c in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*keys, pa.array(at.astype(np.int32)), pa.array(a(w, w + window).view(np.int64)), pa.array(b(w, w + window))], schema=schema)

    joined = texts.join(wanted, ["doc_id", "copy"]).select("doc_id", "copy", "text", "paths")
    return joined.mapInArrow(scan, "doc_id long, copy long, at int, hash long, proof long")


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, k: int = KMER) -> DataFrame:
    """Ranges of windows whose words occur again: doc_id, copy (hash of the text), lo, n.

    Windows lo .. lo+n-1 of the text, counted in words, each occur elsewhere too, in another row or at
    another place of the same text. Rows with the same id and the same text are two rows.
    """
    rows = _keyed(docs, id_col, text_col)
    repeated = _all_edges(rows, window, k).groupBy("edge").agg(F.sum("n").alias("times")).filter("times > 1").select("edge")
    paths = materialise(_all_paths(rows, window, k).join(repeated, "edge"), "paths")
    follow = (F.count("*").alias("times"), F.min("n").alias("n"), F.min("next").alias("next"), F.max("next").alias("other"), F.count("next").alias("followed"))
    alike = materialise(paths.groupBy("edge", "path", "proof").agg(*follow), "alike")
    degree = alike.groupBy("edge").agg(F.count("*").alias("paths"), F.min("times").alias("least"))
    branching = degree.filter("paths > 1 and least = 1").select("edge")
    straight = alike.join(degree.filter("paths = 1 and least > 1").select("edge"), "edge").withColumn("next", F.when((F.col("next") == F.col("other")) & (F.col("followed") == F.col("times")), F.col("next")))
    several = alike.join(degree.filter("paths > 1").select("edge"), "edge").filter("times > 1").select("edge", "path", "proof", "n")
    spans = compacted(straight).unionByName(several)
    compact = paths.select("doc_id", "copy", "lo", "edge", "path", "proof").join(spans, ["edge", "path", "proof"]).select("doc_id", "copy", "lo", "n")
    windows = materialise(_opened(rows, paths.join(branching, "edge"), window), "windows")
    again = windows.groupBy("hash", "proof").agg(F.count("*").alias("times")).filter("times > 1").select("hash", "proof")
    open_ = windows.join(again, ["hash", "proof"]).select("doc_id", "copy", F.col("at").alias("lo"), F.lit(1).alias("n"))
    return materialise(compact.unionByName(open_), "repeated")


def compacted(straight: DataFrame) -> DataFrame:
    """First edges of the contracted chains: edge, path, proof, n (windows of the whole chain).

    straight: edge, path, proof, n, times, next (null where no single edge follows), one row an edge. An edge
    and its next one are contracted if they occur equally often: then all occurrences of either are next to
    one of the other. Each round doubles how far a row reaches; chains have an end, as texts have.
    """
    edges = materialise(straight.select("edge", "path", "proof", "n", "times", "next"), "straight")
    links = edges.select("edge", "next", "times").join(edges.select(F.col("edge").alias("next"), "times"), ["next", "times"]).select("edge", "next")
    links = materialise(links, "links")
    at = materialise(edges.select("edge", "n").join(links, "edge", "left"), "chains")
    while not at.filter("next is not null").isEmpty():
        step = at.select(F.col("edge").alias("next"), F.col("n").alias("more"), F.col("next").alias("further"))
        at = materialise(at.join(step, "next", "left").select("edge", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), F.col("further").alias("next")), "chains", instead_of=at)
    first = edges.join(links.select(F.col("next").alias("edge")), "edge", "left_anti").select("edge", "path", "proof")
    return first.join(at.select("edge", "n"), "edge").select("edge", "path", "proof", "n")


def spans_of_words(docs: DataFrame, ranges: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's text with its repeated ranges: doc_id, text, spans (array of (lo, n), null if none)."""
    by_text = ranges.groupBy("doc_id", "copy").agg(F.collect_set(F.struct("lo", "n")).alias("spans"))
    return _keyed(docs, id_col, text_col).join(by_text, ["doc_id", "copy"], "left").select("doc_id", "text", "spans")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, k: int = KMER) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_text (kept words joined by a space), removed (word spans).

    Every word that lies in a window of ``window`` words that occurs elsewhere is removed, at all its
    places; windows are judged on the input. Words keep their bytes. Null or empty text has no words; a
    text shorter than the window keeps all. Equal rows remove each other's words. A null id counts as
    -2**63. Other columns are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in slices(batch, "text"):
                out = []
                for i, spans in enumerate(part.column("spans").to_pylist()):
                    lo, hi = int(words.first[i]), int(words.first[i + 1])
                    n = hi - lo
                    if not spans:
                        out.append((n, 0, b" ".join(words.text(lo, hi)).decode(), []))
                        continue
                    change = np.zeros(n + 1, dtype=np.int32)
                    np.add.at(change, [s["lo"] for s in spans], 1)
                    np.add.at(change, [min(n, s["lo"] + s["n"] - 1 + window) for s in spans], -1)
                    gone = np.cumsum(change[:-1]) > 0
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                    kept = [words.raw[a:b].tobytes() for a, b in zip(words.start[lo:hi][~gone], words.end[lo:hi][~gone], strict=True)]
                    out.append((n, int(gone.sum()), b" ".join(kept).decode(), [{"start": int(s), "end": int(e)} for s, e in edges.reshape(-1, 2)]))
                cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], schema=schema)

    ranges = repeated_windows(docs, id_col, text_col, window, k)
    return spans_of_words(docs, ranges, window, id_col, text_col).mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<start:int,end:int>>")


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Query: all documents; words removed, and the digest of what is kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", digest(F.col("kept_text")).alias("kept_sha256"))
