"""Alignment of two tokenizers' ids over the bytes of each text, in Arrow tables.

Both tokenizers cover the bytes of space + text. A slice of texts is a few Arrow tables: ids are lists by word that are
flattened with their parents' indices; cumulative sums by document give each token's end; a full hash join on (document,
end) tells which ends both have; filling what one lacks from the next end gives, for each piece between two ends, the
token of either side over it: the links. ``Table.group_by`` counts a slice's links by document and by pair, and Spark merges
the slices' counts.

Words are encoded once for each slice. A text is cut before a space that follows neither a space nor another white space and
that something follows: the splitting rule of the first tokenizer cuts there, and no piece of the second has a space behind
another character, so neither has a token over such a place.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .previous_factors import byte_slices
from .store import materialise

SLICE = 3_000_000
CACHED_WORDS, CACHED_BYTES = 300_000, 32_000_000

_LOADED: dict[tuple[str, str], Tokens] = {}


def _byte_of_sign() -> dict[str, int]:
    """The signs that stand for bytes in entries of byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokens:
    """Both tokenizers with the bytes of each id, and a bounded store of encoded words."""

    def __init__(self, first: str, second: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel ones
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(first)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        sign = _byte_of_sign()
        entries = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.bytes_a = [bytes(sign.get(c, 63) for c in entry) for entry in entries]
        n = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(n)]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("a piece has a space behind another character: texts can't be cut at words")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size = tuple(pa.array([len(x) for x in side], pa.int64()) for side in (self.bytes_a, self.bytes_b))
        self.lengths = tuple(x.to_numpy() for x in self.size)
        #: an id in decimal with the sign that follows it: within a side, behind the first, behind the second
        self.shown = pa.array([f"{i}{end}" for end in ",|;" for i in range(max(len(entries), n))], pa.large_string())
        self.n_shown = max(len(entries), n)
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.n_bytes = 0
        self.flat = [np.zeros(0, np.int32), np.zeros(0, np.int32)]
        self.ends = [np.zeros(1, np.int64), np.zeros(1, np.int64)]
        self.whole = np.zeros(0, bool)

    def words(self, words: list[str]) -> np.ndarray:
        """The places of words in the store; new ones are encoded."""
        if len(self.place) > CACHED_WORDS or self.n_bytes > CACHED_BYTES:
            self._clear()
        new = [w for w in words if w not in self.place]
        if new:
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
            self.n_bytes += sum(map(len, new))
            ids = [e.ids for e in self.a.encode_batch_fast([" " + w for w in new], add_special_tokens=False)], self.b.encode(new, num_threads=1)
            spelled = [b" " + w.encode() for w in new]
            whole = np.ones(len(new), bool)
            for k, side in enumerate((self.bytes_a, self.bytes_b)):
                flat = list(chain.from_iterable(ids[k]))
                if b"".join([side[i] for i in flat]) != b"".join(spelled) or not self._as_long(k, flat, ids[k], spelled):
                    whole &= [b"".join([side[i] for i in x]) == w for x, w in zip(ids[k], spelled, strict=True)]
                self.flat[k] = np.concatenate([self.flat[k], np.array(flat, np.int32)])
                self.ends[k] = np.concatenate([self.ends[k], self.ends[k][-1] + np.cumsum(list(map(len, ids[k])), dtype=np.int64)])
            self.whole = np.concatenate([self.whole, whole])
        return np.array([self.place[w] for w in words], dtype=np.int64)

    def _as_long(self, side: int, flat: list[int], ids: list[list[int]], spelled: list[bytes]) -> bool:
        """Whether each word's ids have as many bytes as the word."""
        sums = np.concatenate([[0], np.cumsum(self.lengths[side][flat])])
        at = np.concatenate([[0], np.cumsum(list(map(len, ids)))])
        return np.array_equal(sums[at[1:]] - sums[at[:-1]], list(map(len, spelled)))

    def lists(self, side: int) -> pa.LargeListArray:
        return pa.LargeListArray.from_arrays(pa.array(self.ends[side]), pa.array(self.flat[side]))


def _loaded(first: str, second: str) -> Tokens:
    """The tokenizers, opened once by each Python worker."""
    if (first, second) not in _LOADED:
        _LOADED.clear()
        _LOADED[first, second] = Tokens(first, second)
    return _LOADED[first, second]


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.LargeStringArray, np.ndarray]:
    """Words of all texts in order, without the space before each, and for each the index of its text."""
    n = len(raw)
    space = raw == 0x20
    solid = ~np.isin(raw, [0x20, *range(0x09, 0x0E), 0x1C, 0x1D, 0x1E, 0x1F])
    # the last byte of a white space beyond ASCII: told by its first bytes, rather too often than too seldom
    back = lambda k: np.concatenate([np.zeros(k, np.uint8), raw[: n - k]])
    wide = (raw >= 0x80) & ((back(1) == 0xC2) | (np.isin(back(2), [0xE1, 0xE2, 0xE3]) & np.isin(back(1), [0x9A, 0x80, 0x81])))
    cut = np.zeros(n, bool)
    cut[1:] = space[1:] & (solid & ~wide)[:-1]
    cut[offsets[:-1][offsets[:-1] < n]] = False
    cut[offsets[1:][offsets[1:] > 0] - 1] = False
    filled = np.flatnonzero(np.diff(offsets))
    begin = offsets[filled]
    starts = np.zeros(n, bool)
    starts[begin] = True
    at = np.flatnonzero(cut | starts)  # a cut space belongs to no word
    kept = raw[~cut]
    words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(at - np.cumsum(cut[at]) + cut[at], len(kept)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(kept)))
    return words, np.searchsorted(offsets, at, side="right") - 1


def _tokens(lists: pa.LargeListArray, word: np.ndarray, text: np.ndarray, size: pa.Array, n: int) -> pa.Table:
    """text, end (byte offset within it), id of all tokens of one side."""
    by_word = lists.take(pa.array(word))
    ids, parent = pc.list_flatten(by_word), pc.list_parent_indices(by_word)
    of = pa.array(text).take(parent)
    total = pc.cumulative_sum(size.take(ids))
    many = np.bincount(of.to_numpy(), minlength=n)
    last = np.cumsum(many) - 1  # of each text
    sums = np.concatenate([[0], total.to_numpy()])
    before = sums[last + 1 - many]  # what the texts before have
    return pa.table({"text": of, "end": pc.subtract(total, pa.array(before).take(of)), "id": ids})


def _aligned(tokens: Tokens, word: np.ndarray, text: np.ndarray, n: int) -> tuple[pa.Table, pa.Table, pa.Table]:
    """Both sides' tokens, and one row for each piece between two ends: text, a and b (token numbers), shared (both end here)."""
    sides = [_tokens(tokens.lists(k), word, text, tokens.size[k], n) for k in (0, 1)]
    ends = [t.select(["text", "end"]).append_column(name, pa.array(np.arange(len(t)))) for t, name in zip(sides, "ab", strict=True)]
    met = ends[0].join(ends[1], ["text", "end"], join_type="full outer", use_threads=False)
    met = met.take(pc.sort_indices(met, sort_keys=[("text", "ascending"), ("end", "ascending")]))
    a, b = met["a"].combine_chunks(), met["b"].combine_chunks()
    shared = pc.and_(a.is_valid(), b.is_valid())
    return *sides, pa.table({"text": met["text"], "a": pc.fill_null_backward(a), "b": pc.fill_null_backward(b), "shared": shared})


def _written(tokens: Tokens, a: pa.Table, b: pa.Table, pieces: pa.Table) -> tuple[memoryview, np.ndarray]:
    """All groups as text, one sign behind each id, and where each text's begin."""
    shared = pieces["shared"].to_numpy()
    group = np.cumsum(shared) - shared  # of each piece
    g = [np.zeros(len(t), np.int64) for t in (a, b)]
    for k, name in enumerate("ab"):
        g[k][pieces[name].to_numpy()] = group
    n_groups = int(shared.sum())
    many = [np.bincount(x, minlength=n_groups) for x in g]
    upto = [np.cumsum(x) for x in many]
    place = [np.arange(len(a)) + (upto[1] - many[1])[g[0]], np.arange(len(b)) + upto[0][g[1]]]
    code = np.empty(len(a) + len(b), np.int64)
    for k, t in enumerate((a, b)):
        ends = np.zeros(len(t), bool)
        ends[upto[k] - 1] = True
        code[place[k]] = t["id"].to_numpy() + np.where(ends, (k + 1) * tokens.n_shown, 0)
    text = np.empty(len(code), np.int64)
    text[place[0]], text[place[1]] = a["text"].to_numpy(), b["text"].to_numpy()
    shown = tokens.shown.take(pa.array(code))
    offsets = np.frombuffer(shown.buffers()[1], np.int64)[: len(shown) + 1]
    return memoryview(shown.buffers()[2]) if len(shown) else memoryview(b""), offsets[np.searchsorted(text, np.arange(int(text[-1]) + 2 if len(text) else 1))]


_ROW = pa.schema(
    [("slice", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string()), ("pairs", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))]
    + [("place", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("docs", pa.int64())]
)
_DDL = "slice long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<int>, times array<int>, place int, a int, b int, docs long"


def _slice_rows(tokens: Tokens, number: int, ids: pa.Array, raw: np.ndarray, offsets: np.ndarray, digest: bool) -> Iterator[pa.RecordBatch]:
    """A row for each text, then one for each pair of ids that the slice links."""
    n = len(ids)
    words, text = words_of(raw, offsets)
    coded = words.dictionary_encode()
    place = tokens.words(coded.dictionary.to_pylist())
    word = place[coded.indices.to_numpy()]
    fine = np.ones(n, bool)
    fine[text[~tokens.whole[word]]] = False  # bytes of one side are not the text's
    word, text = word[fine[text]], text[fine[text]]
    a, b, pieces = _aligned(tokens, word, text, n)
    count = lambda t: np.bincount(t.to_numpy(), minlength=n)
    data, begin = _written(tokens, a, b, pieces)
    groups = []
    for i in range(n):
        own = data[begin[i] : begin[i + 1] - 1] if i + 1 < len(begin) and begin[i + 1] > begin[i] else None
        groups.append("" if own is None else sha256(own).hexdigest() if digest else bytes(own).decode())
    pair = pc.add(pc.shift_left(a["id"].take(pieces["a"]).cast(pa.int64()), 32), b["id"].take(pieces["b"]).cast(pa.int64())).combine_chunks()
    coded = pair.dictionary_encode()
    links = pa.table({"text": pieces["text"], "code": coded.indices})
    held = links.group_by(["text", "code"], use_threads=False).aggregate([([], "count_all")])
    held = held.take(pc.sort_indices(held, sort_keys=[("text", "ascending")]))
    docs = np.bincount(held["code"].to_numpy(), minlength=len(coded.dictionary))
    starts = np.searchsorted(held["text"].to_numpy(), np.arange(n + 1)).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(starts), held[c].combine_chunks().cast(pa.int32())) for c in ("code", "count_all")]
    groups_of = np.bincount(pieces["text"].to_numpy()[pieces["shared"].to_numpy()], minlength=n)
    own = {"slice": pa.array(np.full(n, number)), "doc_id": ids, "n_a": count(a["text"]), "n_b": count(b["text"]), "n_groups": groups_of, "n_links": count(pieces["text"]), "groups": pa.array(groups, pa.string()), "pairs": lists[0], "times": lists[1]}
    yield _batch(own, n)
    m = len(coded.dictionary)
    first = coded.dictionary.to_numpy() >> 32
    yield _batch({"slice": pa.array(np.full(m, number)), "place": pa.array(np.arange(m, dtype=np.int32)), "a": first.astype(np.int32), "b": (coded.dictionary.to_numpy() & 0xFFFFFFFF).astype(np.int32), "docs": docs}, m)


def _batch(columns: dict, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _ROW], schema=_ROW)


_COUNTED = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups", pa.string())])


def _counted(texts: pa.Table, pairs: pa.Table) -> pa.Table:
    """A slice's texts with the sums over their links of the pairs' counts."""
    count, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
    place = pairs["place"].to_numpy()
    count[place], best[place] = pairs["count"].to_numpy(), pairs["best"].to_numpy()
    held, times = texts["pairs"].combine_chunks(), texts["times"].combine_chunks()
    parent, code, n = pc.list_parent_indices(held).to_numpy(), pc.list_flatten(held).to_numpy(), pc.list_flatten(times).to_numpy().astype(np.int64)
    sums = []
    for of in (best, count):
        total = np.concatenate([[0], np.cumsum(of[code] * n)])
        many = np.bincount(parent, minlength=len(texts))
        end = np.cumsum(many)
        sums.append(pa.array(total[end] - total[end - many], pa.int64()))
    columns = {c: texts[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups")} | dict(zip(("n_best", "count_sum"), sums, strict=True))
    return pa.table([columns[f.name] for f in _COUNTED], schema=_COUNTED)


def align(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    first: a byte-level BPE file of the tokenizers library; second: a BPE model of sentencepiece with byte fallback that adds
    a space. ``groups``: a1,a2|b1;a3|b2,b3, the ids of the runs of tokens between ends that both have; with ``digest`` its
    SHA-256 in hexadecimal. A link is a pair of tokens whose bytes overlap. A pair of ids counts the rows that hold it linked;
    n_best counts the links whose pair counts most of its first id's pairs, ties included, count_sum sums the counts.
    Strings of special tokens within texts are plain text. Null and empty texts, and those whose bytes one side does not give
    back, have zeros and ''. Rows stand alone, repeated ones too; a null id stays null. Other columns are not read. A very
    long text is worked on whole, by itself. A table without rows gives none.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, number = _loaded(first, second), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part, raw, offsets in byte_slices(batch, "text", SLICE):
                yield from _slice_rows(tokens, number, part.column(0), raw, offsets, digest)
                number += 1

    found = materialise(rows.mapInArrow(scan, _DDL), "aligned")  # slices have their numbers from this one pass
    pairs = found.filter("place is not null").select("slice", "place", "a", "b", "docs")
    counts = pairs.groupBy("a", "b").agg(F.sum("docs").alias("count"))
    counts = counts.withColumn("best", (F.col("count") == F.max("count").over(Window.partitionBy("a"))).cast("long"))  # at most the second vocabulary to an id
    known = pairs.join(counts, ["a", "b"]).select(F.col("slice").alias("of_slice"), "place", "count", "best")
    texts = found.filter("place is null").select("slice", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times")
    ddl = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    return texts.groupBy("slice").cogroup(known.groupBy("of_slice")).applyInArrow(_counted, ddl)


def op12_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    """Query: all documents, byte-level BPE against pieces; the digest of the groups."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")
