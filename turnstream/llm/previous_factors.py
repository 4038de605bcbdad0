"""Later copies of byte strings: longest-previous-factor arrays over suffixes that Spark deals out.

A string of ``length`` bytes that also starts in a document with a smaller id is removed. Suffixes are not rows one
by one, which would be fifty times the input. Of the grams of ``gram`` bytes in each string the one with the smallest
hash is its anchor, so equal strings have equal anchors; consecutive strings with one anchor are a segment.

1. ``shared_anchors``: anchors that lie in two documents at least. Slices of texts send them packed, by ranges of their keys' lower halves; what
   several documents of a slice hold is known to be shared, is sent once as a mark, and passes by. So an anchor comes
   at most once from a slice, or once for each place in one document, however hot it is.
2. ``segments``: the bytes of shared anchors' segments, equal ones of a slice once, with their first document.
3. ``factored``: all segments of an anchor meet in one task, which sorts their suffixes, takes the longest common prefix of
   neighbours, and from the previous and next suffixes of smaller documents the longest previous factor of each suffix.
   Anchors with very many different segments are dealt out by the strings themselves instead.
4. Strings whose longest previous factor is as long as they are go, in all texts that hold the segment.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import let_go, materialise, remove
from .substrings import _keyed
from .words import joined, mix, string_bytes

LENGTH = 50
GRAM = 20
SLICE = 1_000_000  # bytes whose anchors are found together
BUCKET = 16_000_000  # bytes of text whose anchors are compared together
KNOWN_AT_ONCE = 100_000  # shared anchors in a row
MOST_OF_ANCHOR = 20_000  # segments of an anchor in one task
ROWS_AT_ONCE = 20_000  # segments sorted together, if they have different anchors


# --- anchors


def _eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; places beyond the end count as zero bytes."""
    n = len(raw)
    padded = np.zeros((n // 8 + 2) * 8 + 8, dtype=np.uint8)
    padded[:n] = raw
    out = np.empty((n // 8 + 1) * 8, dtype=np.uint64)
    for i in range(8):
        out[i::8] = padded[i : i + len(out)].view("<u8")
    return out[:n]


def _gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """For each place the hash of ``gram`` (8 at least) bytes from there on, by blocks of doubling size."""
    h, have = mix(_eights(raw)), 8
    while have < gram:
        step = min(have, gram - have)
        h = joined(h[:-step], h[step:]) if len(h) > step else h[:0]
        have += step
    return h[: max(0, len(raw) - gram + 1)]


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, first string, number of strings, hash of the anchor) of all segments of some texts, in order."""
    none = np.zeros(0, dtype=np.int64)
    h = _gram_hashes(raw, gram)
    n = len(raw) - length + 1
    if n < 1:
        return none, none, none, none
    low = np.uint64(0xFFFFFFFF)
    least, have, width = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1, length - gram + 1
    while have < width:  # the smallest of each run, the leftmost of equal ones
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    at = (least & low).astype(np.int64)[:n]
    change = np.zeros(len(raw) + 1, dtype=np.int32)  # starts from which a string reaches beyond its text
    np.add.at(change, np.maximum(offsets[:-1], offsets[1:] - length + 1), 1)
    np.add.at(change, offsets[1:], -1)
    whole = np.cumsum(change[:n]) == 0
    new = np.ones(n, dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | ~whole[:-1]
    begins = offsets[:-1][offsets[:-1] < n]
    new[begins] = True
    first = np.flatnonzero(new & whole)
    stops = np.append(new[1:] | ~whole[1:], True) & whole
    count = np.flatnonzero(stops) - first + 1
    text = np.searchsorted(offsets, first, side="right") - 1
    return text, first - offsets[text], count, h[at[first]].view(np.int64)


def byte_slices(batch: pa.RecordBatch, text: str, most: int = SLICE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """A batch in pieces of about ``most`` bytes of text (one long text is one piece), with their bytes and offsets."""
    raw, offsets = string_bytes(batch.column(batch.schema.get_field_index(text)))
    i = 0
    while i < batch.num_rows:
        j = min(batch.num_rows, max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1))
        yield batch.slice(i, j - i), raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


_DEALT = pa.schema([("bucket", pa.int64()), ("known", pa.bool_()), ("packed", pa.binary())])
_DEALT_DDL = "bucket long, known boolean, packed binary"


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of numbers, compressed: their first bytes together, then their second ones, and so on."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(np.stack(columns).astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpacked(x: bytes, columns: int = 3) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<i8").reshape(columns, -1)


def _turned(key: np.ndarray) -> np.ndarray:
    """Keys with their halves exchanged. Anchors have the smallest upper halves, which would crowd in the first ranges; lower halves are even."""
    key = key.view(np.uint64)
    return (key << np.uint64(32)) | (key >> np.uint64(32))


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of turned keys."""
    return (((_turned(key) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _dealt(batches: Iterator[pa.RecordBatch], length: int, gram: int, bits: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Anchors of each slice, packed by bucket, each at most once unless one document holds it more often.

    What several documents of the slice hold is known to be shared: a place of -1 tells its bucket, and the places
    themselves go to any bucket.
    """
    for number, (part, raw, offsets) in enumerate(x for batch in batches for x in byte_slices(batch, "text", 4 * SLICE)):
        found = []
        for a, b in _halves(offsets):  # arrays by byte stay small
            text, lo, n, key = anchors(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], length, gram)
            found.append((text + a, (lo << bits) | (n - 1), key))
        text, at, key = (np.concatenate(x) for x in zip(*found, strict=True))
        doc = part.column(0).to_numpy(zero_copy_only=False)[text]
        order = np.lexsort((doc, _turned(key)))
        at, key, doc = at[order], key[order], doc[order]
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        end = np.append(begin[1:], len(key))
        several = doc[begin] != doc[end - 1] if len(key) else np.zeros(0, bool)
        shared = np.repeat(several, end - begin)
        sent = ~shared
        sent[begin[several]] = True  # one of them as the mark
        keys, docs, places = key[sent], doc[sent], np.where(shared, -1, at)[sent]
        of = _bucket(keys, buckets)
        cuts = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
        rows = [(int(of[a]), False, _packed(keys[a:b], docs[a:b], places[a:b])) for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(of)][: len(cuts)], strict=True)]
        key, doc, at = key[shared], doc[shared], at[shared]
        for a in range(0, len(key), KNOWN_AT_ONCE):
            of = mix(np.array([number, len(raw), int(key[a])], dtype=np.int64).view(np.uint64)).sum() % np.uint64(buckets)
            rows.append((int(of), True, _packed(*(x[a : a + KNOWN_AT_ONCE] for x in (key, doc, at)))))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 3, _DEALT, strict=True)], schema=_DEALT)


def _halves(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about SLICE bytes each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, side="right")) - 1))
        yield i, j
        i = j


_SHARED = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("at", pa.int64())])


def _shared_of(key: np.ndarray, doc: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """A bucket's anchors that two documents hold, or that are marked."""
    order = np.argsort(key, kind="stable")
    key, doc, at = key[order], doc[order], at[order]
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    shared = (np.minimum.reduceat(doc, begin) < np.maximum.reduceat(doc, begin)) | (np.minimum.reduceat(at, begin) < 0)
    take = np.repeat(shared, np.diff(np.append(begin, len(key)))) & (at >= 0)
    return pa.RecordBatch.from_arrays([pa.array(doc[take]), pa.array(key[take]), pa.array(at[take])], schema=_SHARED)


def _of_several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of bucket: a bucket at a time."""
    now, held = None, []
    for row in _and_none(r for batch in batches for r in zip(*batch.columns, strict=True)):
        bucket, known, packed = (None, False, None) if row is None else (x.as_py() for x in row)
        if known:
            key, doc, at = _unpacked(packed)
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(key), pa.array(at)], schema=_SHARED)
            continue
        if held and bucket != now:
            yield _shared_of(*np.concatenate(held, axis=1))
            held = []
        if row is not None:
            now = bucket
            held.append(_unpacked(packed))


def _and_none(items: Iterator) -> Iterator:
    yield from items
    yield None


def shared_anchors(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """doc_id, key, at: anchors that also lie in another document; ``at`` is first string * 2**bits + strings - 1."""
    bits = (length - gram).bit_length()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 16 + size // BUCKET  # what a task holds at once stays the same
    dealt = rows.select("doc_id", "text").mapInArrow(lambda b: _dealt(b, length, gram, bits, buckets), _DEALT_DDL)
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_of_several, "doc_id long, key long, at long")


# --- segments


_SEGMENT = pa.schema([("key", pa.int64()), ("digest", pa.int64()), ("doc_id", pa.int64()), ("copy", pa.int64()), ("at", pa.int64()), ("first", pa.int64()), ("part", pa.binary())])


def _segments(batches: Iterator[pa.RecordBatch], length: int, bits: int) -> Iterator[pa.RecordBatch]:
    """All shared segments with the digest of their bytes. Of equal ones in a slice one has the bytes, and their first document."""
    for batch in batches:
        for part, raw, offsets in byte_slices(batch, "text", 2 * SLICE):
            held = part.column(part.schema.get_field_index("held"))
            many = np.diff(held.offsets.to_numpy())
            flat = held.flatten()
            key, at = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            text = np.repeat(np.arange(part.num_rows), many)
            lo, n = at >> bits, (at & ((1 << bits) - 1)) + 1
            whole = lo + n + length - 1 <= np.diff(offsets)[text]  # another text of the same id may be shorter
            key, at, text, lo, n = (x[whole] for x in (key, at, text, lo, n))
            begin = offsets[text] + lo
            view = memoryview(np.ascontiguousarray(raw))
            pieces = list(zip(begin.tolist(), (begin + n + length - 1).tolist(), strict=True))
            digest = np.frombuffer(b"".join([blake2b(view[a:b], digest_size=8).digest() for a, b in pieces]), dtype=np.int64)
            doc, copy = (part.column(i).to_numpy(zero_copy_only=False)[text] for i in (0, 1))
            order = np.lexsort((doc, digest, key))
            new = np.ones(len(order), dtype=bool)
            new[1:] = (key[order][1:] != key[order][:-1]) | (digest[order][1:] != digest[order][:-1])
            bears = np.zeros(len(order), dtype=bool)
            bears[order[new]] = True
            data = [bytes(view[a:b]) if x else None for (a, b), x in zip(pieces, bears.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(digest), pa.array(doc), pa.array(copy), pa.array(at), pa.array(doc, mask=~bears), pa.array(data, pa.binary())], schema=_SEGMENT)


def segments(rows: DataFrame, shared: DataFrame, length: int, gram: int) -> DataFrame:
    """key, digest, doc_id, copy, at, first, part: the shared segments of all texts."""
    bits = (length - gram).bit_length()
    held = shared.groupBy("doc_id").agg(F.collect_list(F.struct("key", "at")).alias("held"))
    joined_ = rows.join(held, "doc_id").select("doc_id", "copy", "text", "held")
    return joined_.mapInArrow(lambda b: _segments(b, length, bits), "key long, digest long, doc_id long, copy long, at long, first long, part binary")


# --- suffixes and their longest previous factors


def previous_factors(raw: np.ndarray, starts: np.ndarray, rank: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The longest previous factor of each suffix, up to ``length`` bytes, and the rank that has it (-1 if none).

    raw: bytes of texts; starts: where ``length`` bytes of one text begin; rank: the order of the start's text. The
    factor is the longest prefix that also begins, with ``length`` bytes of its text behind it, at a start of smaller rank.
    In suffix order the longest is shared with the nearest smaller rank before or behind: previous and next smaller
    values, found by jumping from each place over those already known to be no smaller.
    """
    bytes_ = raw[starts[:, None] + np.arange(length)]
    words = np.zeros((len(starts), -(-length // 8) * 8), dtype=np.uint8)
    words[:, :length] = bytes_
    order = np.lexsort((rank, *words.view(">u8").T[::-1]))
    bytes_, ranks, n = bytes_[order], rank[order], len(order)
    differ = bytes_[1:] != bytes_[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), length)  # of neighbours
    best, source = np.zeros(n, dtype=np.int64), np.full(n, -1, dtype=np.int64)
    for step in (-1, 1):
        to = np.arange(n) + step  # all places between hold ranks that are no smaller
        reach = np.concatenate([[0], common] if step < 0 else [common, [0]])  # what is shared with the place at ``to``
        going = np.flatnonzero((to >= 0) & (to < n))
        while len(going := going[(reach[going] > 0) & (to[going] >= 0) & (to[going] < n)]):
            going = going[ranks[to[going]] >= ranks[going]]
            over = to[going]
            reach[going], to[going] = np.minimum(reach[going], reach[over]), to[over]
        found = (reach > best) & (to >= 0) & (to < n)
        best[found], source[found] = reach[found], ranks[to[found]]
    out, of = np.empty_like(best), np.empty_like(source)
    out[order], of[order] = best, source
    return out, of


_FACTORED = pa.schema([("key", pa.int64()), ("digest", pa.int64()), ("first", pa.int64()), ("gone", pa.int64())])


def _factor(key: np.ndarray, digest: np.ndarray, first: np.ndarray, part: pa.Array, length: int) -> pa.RecordBatch:
    """Rows in order of key, digest and first: each different segment with its first document and its repeated strings as bits."""
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])
    key, digest, first, part = key[new], digest[new], first[new], part.filter(pa.array(new))
    gone = np.zeros(len(key), dtype=np.int64)
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    several = np.flatnonzero(np.repeat(np.diff(np.append(begin, len(key))) > 1, np.diff(np.append(begin, len(key)))))
    if len(several):
        chosen = part.take(pa.array(several)).cast(pa.large_binary())
        offsets = np.frombuffer(chosen.buffers()[1], dtype=np.int64)[chosen.offset : chosen.offset + len(chosen) + 1]
        raw = np.frombuffer(chosen.buffers()[2], dtype=np.uint8)
        strings = np.diff(offsets) - length + 1
        of = np.repeat(np.arange(len(several)), strings)
        place = np.arange(len(of)) - np.repeat(np.cumsum(strings) - strings, strings)
        longest, _ = previous_factors(raw, offsets[of] + place, np.unique(first[several], return_inverse=True)[1][of], length)
        np.bitwise_or.at(gone, several[of], np.where(longest >= length, np.int64(1) << place, 0))
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (key, digest, first, gone)], schema=_FACTORED)


def _factors(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of key: whole keys, about ROWS_AT_ONCE rows at a time."""
    left: list[pa.RecordBatch] = []
    for batch in _and_none(batches):
        if batch is not None:
            left.append(batch)
            if sum(b.num_rows for b in left) < ROWS_AT_ONCE:
                continue
        if not left:
            continue
        table = pa.Table.from_batches(left).combine_chunks()
        key = table["key"].to_numpy()
        cut = len(key) if batch is None else int(np.flatnonzero(np.append(True, key[1:] != key[:-1]))[-1]) if len(key) else 0
        left = table.slice(cut).combine_chunks().to_batches()
        if cut:
            now = table.slice(0, cut).combine_chunks()
            part = now["part"].chunk(0) if now["part"].num_chunks == 1 else pa.concat_arrays(now["part"].chunks)
            yield _factor(now["key"].to_numpy(), now["digest"].to_numpy(), now["first"].to_numpy(), part, length)


_STRING = pa.schema([("key", pa.int64()), ("digest", pa.int64()), ("first", pa.int64()), ("place", pa.int32()), ("string", pa.binary())])


def _strings(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 1000):
            some = batch.slice(a, 1000)
            parts = some.column(3).to_pylist()
            rows = [(i, j) for i, p in enumerate(parts) for j in range(len(p) - length + 1)]
            of = pa.array([i for i, _ in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([*(some.column(c).take(of) for c in range(3)), pa.array([j for _, j in rows], pa.int32()), pa.array([parts[i][j : j + length] for i, j in rows], pa.binary())], schema=_STRING)


def factored(found: DataFrame, length: int, most: int = MOST_OF_ANCHOR) -> DataFrame:
    """key, digest, first, gone: each different segment, its first document, and as bits which of its strings an earlier one holds.

    The segments of an anchor are one task's, unless there are more than ``most``: then each of their strings is
    counted by itself, with the smallest document that holds it.
    """
    bearers = found.filter("part is not null").select("key", "digest", "first", "part")
    hot = materialise(bearers.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("key"), "hot")
    schema = "key long, digest long, first long, gone long"
    factors = lambda df: df.repartition("key").sortWithinPartitions("key", "digest", "first").mapInArrow(lambda b: _factors(b, length), schema)
    if hot.isEmpty():
        return factors(bearers)
    strings = bearers.join(hot, "key").select("key", "digest", "first", "part").mapInArrow(lambda b: _strings(b, length), "key long, digest long, first long, place int, string binary")
    earliest = strings.groupBy("string").agg(F.min("first").alias("earliest"))
    own = strings.groupBy("key", "digest", "place", "string").agg(F.min("first").alias("first"))
    bit = F.when(F.col("earliest") < F.col("first"), F.expr("shiftleft(1L, place)")).otherwise(F.lit(0).cast("long"))
    counted = own.join(earliest, "string").groupBy("key", "digest").agg(F.min("first").alias("first"), F.bit_or(bit).alias("gone"))
    return factors(bearers.join(hot, "key", "left_anti")).unionByName(counted)


# --- the operator


_CUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _cut(batches: Iterator[pa.RecordBatch], length: int, bits: int) -> Iterator[pa.RecordBatch]:
    for part, raw, offsets in (x for batch in batches for x in byte_slices(batch, "text")):
        spans = part.column(2).to_pylist()
        out = []
        for i, found in enumerate(spans):
            text, n = raw[offsets[i] : offsets[i + 1]], int(offsets[i + 1] - offsets[i])
            if not found:
                out.append((n, 0, text.tobytes(), []))
                continue
            at, gone = (np.array([s[c] for s in found], dtype=np.int64) for c in ("at", "gone"))
            lo, strings = at >> bits, (at & ((1 << bits) - 1)) + 1
            place = np.arange(1 << bits)
            hit = (((gone[:, None] >> place) & 1) > 0) & (place < strings[:, None])
            starts = (lo[:, None] + place)[hit]
            change = np.zeros(n + 1, dtype=np.int32)
            np.add.at(change, starts, 1)
            np.add.at(change, starts + length, -1)
            removed = np.cumsum(change[:-1]) > 0
            edges = np.flatnonzero(np.diff(np.concatenate([[0], removed.view(np.int8), [0]]))).reshape(-1, 2)
            out.append((n, int(removed.sum()), text[~removed].tobytes(), [{"start": int(s), "end": int(e)} for s, e in edges]))
        cols = zip(*out, strict=True) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(cols, _CUT.types[1:], strict=True))], schema=_CUT)


def remove_later_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, most: int = MOST_OF_ANCHOR) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, kept (binary: the bytes that stay), removed (byte spans, end exclusive).

    Texts are UTF-8 bytes. Each byte goes that lies in a string of ``length`` bytes which also starts in a row of a smaller
    id; strings are judged on the input. Repetition within one row, or among rows of one id, removes nothing. Null and
    empty texts have no bytes; shorter texts than ``length`` stay whole. A null id counts as -2**63. Very long texts are
    worked on whole, one to a slice. Other columns are not read. A table without rows gives none.
    ``gram`` is at least 8, and ``length - gram`` at most 62.
    """
    if not (8 <= gram <= length and length - gram <= 62):
        raise ValueError("gram must be 8 at least, and length - gram 0 to 62")
    bits = (length - gram).bit_length()
    rows = _keyed(docs, id_col, text_col)
    shared = materialise(shared_anchors(rows, length, gram), "anchors")
    let_go(docs.sparkSession)
    found = materialise(segments(rows, shared, length, gram), "segments", codec="zstd")
    remove(shared)
    let_go(docs.sparkSession)
    verdicts = materialise(factored(found, length, most), "verdicts", codec="zstd")
    let_go(docs.sparkSession)
    held = found.select("key", "digest", "doc_id", "copy", "at").join(verdicts, ["key", "digest"])
    gone = F.when(F.col("doc_id") > F.col("first"), F.lit((1 << (length - gram + 1)) - 1)).otherwise(F.col("gone"))
    spans = held.select("doc_id", "copy", "at", gone.alias("gone")).filter("gone <> 0").groupBy("doc_id", "copy").agg(F.collect_list(F.struct("at", "gone")).alias("spans"))
    spans = materialise(spans, "spans")
    remove(found, verdicts)
    let_go(docs.sparkSession)
    return rows.join(spans, ["doc_id", "copy"], "left").select("doc_id", "text", "spans").mapInArrow(lambda b: _cut(b, length, bits), "doc_id long, n_bytes long, n_removed long, kept binary, removed array<struct<start:long,end:long>>")


def digest(kept: bytes) -> str:
    return sha256(kept).hexdigest()


def op11_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """Query: all documents; bytes and spans removed, and the digest of what is kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_later_copies(docs).select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
