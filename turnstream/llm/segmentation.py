"""SentencePiece encoding and decoding with the N best segmentations.

The pieces and their scores come from a SentencePiece model. A text is normalised as the model says
(white space to U+2581, one in front). Between two characters that are neighbours in no piece every
segmentation has a border, so the lattice falls into parts there, and each distinct part is solved once.

In a part the forward Viterbi pass gives for each place the best score of any way to it. Backward A-star
search starts at the end of the lattice and extends partial ways to the left; the forward score of the
place it has reached is the exact best rest, so complete ways come out in order of their scores, each
found without a detour. For the first way alone the search never has to go back, so many parts take its
steps together, in numpy. The forward pass also keeps what the second-best way loses: the N best ways of a
text can change only the N-1 parts that lose least, and these are searched for their N best ways, which are
merged into the N best sums.

A character that no piece covers is written as its UTF-8 bytes, at the score of an unknown. Of ways with
equal scores the one with the longer last piece comes first, of parts that lose the same the leftmost.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import string_bytes

SPACE = "\u2581"
BEST = 4
UNKNOWN_UNDER = 10.0  # below the lowest score of a piece, as the library does
SLICE_BYTES = 1_000_000  # texts that are worked on together; one longer text alone
TOGETHER, LONGEST_TOGETHER = 4096, 32  # parts, and characters of a part, of one numpy pass
KEPT_PARTS, KEPT_IDS, KEPT_WAYS = 400_000, 2_500_000, 40_000  # what a worker remembers: parts, their ids, N best ways
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOADED: dict = {}


def _hash(piece: str) -> int:
    h = 0
    for c in piece:
        h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return h


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices starts[k] .. starts[k] + sizes[k] - 1 of all k, behind each other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


class Pieces:
    """A model's pieces, the parts solved so far, and the N best segmentations of texts."""

    def __init__(self, path: str, best: int = BEST):
        import sentencepiece

        self.processor, self.best = sentencepiece.SentencePieceProcessor(model_file=path), best
        p = self.processor
        n = p.get_piece_size()
        plain = [i for i in range(n) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
        self.ids = {p.id_to_piece(i): i for i in plain}
        real = [p.get_score(i) for i in plain if p.get_score(i) > -1e8]
        self.lowest = min(real, default=0.0)
        self.unknown_score = self.lowest - UNKNOWN_UNDER
        # pieces that a model lists without a score of their own count as its lowest
        self.scores = {p.id_to_piece(i): max(p.get_score(i), self.lowest) for i in plain}
        self.begun = {q[:k] for q in self.ids for k in range(1, len(q) + 1)}
        self.longest = max(map(len, self.ids), default=1)
        hashed = sorted((_hash(q), q) for q in self.ids)
        self.hashes = np.array([h for h, _ in hashed], dtype=np.uint64)
        self.hash_scores = np.array([self.scores[q] for _, q in hashed])
        self.hash_ids = np.array([self.ids[q] for _, q in hashed])
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[(self.hashes >> np.uint64(44)).astype(np.int64)] = True
        pairs = {(ord(a), ord(b)) for q in self.ids for a, b in zip(q, q[1:], strict=False)}
        self.pairs = np.array(sorted(a << 21 | b for a, b in pairs), dtype=np.int64)
        self.low_pairs = np.zeros((1024, 1024), dtype=bool)
        for a, b in pairs:
            if a < 1024 and b < 1024:
                self.low_pairs[a, b] = True
        self.bytes = {int(p.id_to_piece(i)[3:5], 16): i for i in range(n) if p.is_byte(i)}
        self.unknown = p.unk_id()
        of_byte = {i: b for b, i in self.bytes.items()}
        raw = [bytes([of_byte[i]]) if i in of_byte else b"" if p.is_control(i) else p.id_to_piece(i).encode() for i in range(n)]
        self.raw = pa.array(raw, pa.binary())
        self._forget()

    def _forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.flat, self.offset = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.score, self.loss = np.zeros(0), np.zeros(0)
        self.ways: dict[str, list] = {}

    # --- one part

    def search(self, part: str, best: int) -> list[tuple[float, tuple[int, ...]]]:
        """The ``best`` highest-scoring segmentations of one part, best first.

        Open partial ways stand for disjoint sets of ways, each with at least the one whose exact score
        orders the agenda; so no more of them are kept than ways are still wanted.
        """
        scores, begun, n = self.scores, self.begun, len(part)
        forward = [0.0] + [float("-inf")] * n
        for i in range(n):
            here = forward[i]
            for j in range(i + 1, n + 1):
                piece = part[i:j]
                if piece not in begun:
                    break
                s = scores.get(piece)
                if s is not None and here + s > forward[j]:
                    forward[j] = here + s
            if part[i] not in scores:
                forward[i + 1] = max(forward[i + 1], here + self.unknown_score)
        out: list[tuple[float, tuple[int, ...]]] = []
        # minus the score of the best completion, place, number of the way, score so far, (its first piece, the rest)
        agenda, made = [(-forward[-1], n, 0, 0.0, None)], 0
        while agenda:
            _, j, _, score, way = agenda.pop(0)
            if j == 0:
                out.append((score, self._unrolled(way)))
                if len(out) == best:
                    break
                continue
            wanted = best - len(out)
            for i in range(max(0, j - self.longest), j):
                piece = part[i:j]
                s = scores.get(piece)
                if s is None:
                    if i < j - 1 or piece in scores:
                        continue
                    s = self.unknown_score
                full = -(forward[i] + s + score)
                if len(agenda) == wanted:
                    if full >= agenda[-1][0]:
                        continue
                    agenda.pop()
                made += 1
                insort(agenda, (full, i, made, s + score, (piece, way)))
        return out

    def _unrolled(self, way: tuple | None) -> tuple[int, ...]:
        out: list[int] = []
        while way is not None:
            piece, way = way
            if piece in self.ids:
                out.append(self.ids[piece])
            else:
                out += [self.bytes.get(b, self.unknown) for b in piece.encode()]
        return tuple(out)

    def _best_ways(self, part: str) -> list[tuple[float, tuple[int, ...]]]:
        found = self.ways.get(part)
        if found is None:
            found = self.search(part, self.best)
            if len(part) <= LONGEST_TOGETHER:
                if len(self.ways) >= KEPT_WAYS:
                    self.ways.clear()
                self.ways[part] = found
        return found

    # --- many parts

    def _solve(self, parts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The parts in the order of what follows: numbers of ids, all ids, scores of the best ways, losses of the second."""
        parts = sorted(parts, key=len)
        n_short = next((k for k in range(len(parts), 0, -1) if len(parts[k - 1]) <= LONGEST_TOGETHER), 0)
        names, out, single = [], [], parts[n_short:]
        for at in range(0, n_short, TOGETHER):
            some = parts[at : min(n_short, at + TOGETHER)]
            score, loss, ids = self._first_ways(some)
            plain = ~(ids == -1).any(axis=1)  # no character that no piece covers
            if not plain.all():
                single += [p for p, fits in zip(some, plain.tolist(), strict=True) if not fits]
                some = [p for p, fits in zip(some, plain.tolist(), strict=True) if fits]
                score, loss, ids = score[plain], loss[plain], ids[plain]
            names += some
            out.append(((ids >= 0).sum(axis=1), ids[ids >= 0], score, loss))
        for p in single:
            (score, ids), *others = self.search(p, 2)
            out.append(([len(ids)], ids, [score], [score - others[0][0] if others else np.inf]))
        names += single
        sizes, flat, score, loss = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4
        return names, sizes, flat.astype(np.int32), score, loss

    def _first_ways(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best scores, losses of the second-best ways, best ids (a row each; -1: an unknown character, -2: none).

        parts: by ascending length. Forward: the two best scores of each place of all parts together.
        Backward: from each end the piece with the best sum of its score and the forward score before it.
        """
        m, n = len(parts), len(parts[-1])
        length = np.array([len(p) for p in parts])
        codes = np.frombuffer("".join([p.ljust(n, "\0") for p in parts]).encode("utf-32-le"), dtype=np.uint32).reshape(m, n).T.astype(np.uint64)
        most = min(n, self.longest)
        # by size - 1, start and part
        scores, pieces = np.full((most, n, m), -np.inf), np.full((most, n, m), -1, dtype=np.int32)
        hashes = np.zeros((n, m), dtype=np.uint64)
        for size in range(1, most + 1):
            hashes = hashes[: n - size + 1] * _BASE + codes[size - 1 :] + np.uint64(1)
            i, r = np.nonzero(self.maybe[(hashes >> np.uint64(44)).astype(np.int64)])
            h = hashes[i, r]
            k = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = (self.hashes[k] == h) & (i + size <= length[r])
            scores[size - 1, i[hit], r[hit]], pieces[size - 1, i[hit], r[hit]] = self.hash_scores[k[hit]], self.hash_ids[k[hit]]
        scores[0][pieces[0] < 0] = self.unknown_score
        first, second = np.full((n + 1, m), -np.inf), np.full((n + 1, m), -np.inf)
        first[0] = 0
        for j in range(1, n + 1):
            at = int(np.searchsorted(length, j))  # shorter parts have ended
            a, b = first[j, at:], second[j, at:]
            for size in range(1, min(j, most) + 1):
                s, before = scores[size - 1, j - size, at:], j - size
                way = first[before, at:] + s
                b[:] = np.maximum(np.maximum(np.minimum(a, way), b), second[before, at:] + s)
                np.maximum(a, way, out=a)
        rows = np.arange(m)
        total, runner_up = first[length, rows], second[length, rows]
        place, steps = length.copy(), []
        sizes = np.arange(most, 0, -1)[:, None]  # of equal sums the longer piece
        while (place > 0).any():
            before = np.maximum(place - sizes, 0)
            sums = np.where(place >= sizes, first[before, rows] + scores[sizes - 1, before, rows], -np.inf)
            size = most - sums.argmax(0)
            steps.append(np.where(place > 0, pieces[size - 1, np.maximum(place - size, 0), rows], -2))
            place = np.maximum(place - size, 0)
        return total, total - runner_up, np.stack(steps[::-1], axis=1)

    def _cut(self, texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct parts of the normalised texts, for each part of the texts its number there, first part of each text."""
        whole = "".join(texts)
        codes = np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32)
        begins = np.ones(len(codes), dtype=bool)
        a, b = codes[:-1], codes[1:]
        low = (a < 1024) & (b < 1024)
        inside = self.low_pairs[np.where(low, a, 0), np.where(low, b, 0)] & low
        high = np.flatnonzero(~low)
        pair = a[high].astype(np.int64) << 21 | b[high]
        if len(self.pairs):
            inside[high] = self.pairs[np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)] == pair
        begins[1:] = ~inside
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        first = np.concatenate([[0], np.cumsum(sizes)])
        begins[first[:-1][sizes > 0]] = True
        starts = np.flatnonzero(begins)
        width = np.concatenate([[0], np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000))])
        data = pa.py_buffer(whole.encode())
        offsets = np.append(width[starts], width[-1]).astype(np.int64)
        coded = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), data).dictionary_encode()
        return coded.dictionary, coded.indices.to_numpy(), np.searchsorted(starts, first)

    def _rows_of(self, parts: list[str]) -> np.ndarray:
        """The rows of the parts in the remembered arrays; parts that are new are solved and added."""
        if len(self.rows) > KEPT_PARTS or len(self.flat) > KEPT_IDS:
            self._forget()
        new = [p for p in parts if p not in self.rows]
        new, sizes, flat, score, loss = self._solve(new)
        base = len(self.score)
        self.flat = np.concatenate([self.flat, flat])
        self.offset = np.concatenate([self.offset, self.offset[-1] + np.cumsum(sizes)])
        self.score, self.loss = np.concatenate([self.score, score]), np.concatenate([self.loss, loss])
        self.rows.update(zip(new, range(base, base + len(new)), strict=True))
        return np.fromiter(map(self.rows.__getitem__, parts), np.int64, len(parts))

    def n_best(self, text: str) -> list[tuple[float, list[int]]]:
        """The N best segmentations of a text: score and ids, best first."""
        n, scores, ways = self.n_best_of([text])
        return [(s, w) for s, w in zip(scores, ways.to_pylist(), strict=True)][: n[0]]

    def n_best_of(self, texts: list[str]) -> tuple[list[int], list[float], pa.ListArray]:
        """Of each text the number of ways, and of all ways of all texts, best first, scores and ids."""
        parts, index, first = self._cut([self.processor.normalize(t) if t else "" for t in texts])
        names = parts.to_pylist()
        rows = self._rows_of(names)
        own, loss = rows[index], self.loss[rows][index]
        totals = np.concatenate([[0.0], np.cumsum(self.score[own])])
        n, scores, sequences, extra, n_rows = [], [], [], [], len(self.score)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            opened = _least(loss[a:b], self.best - 1)
            ways = [self._best_ways(names[index[a + c]]) for c in opened]
            losses = sorted((w[0][0] - w[k][0], c, k) for c, w in enumerate(ways) for k in range(1, len(w)))
            plain = own[a:b]
            if opened:  # the search also gives these parts' best ids, so that no way comes twice
                plain = plain.copy()
                places = []
                for w in ways:
                    places.append(range(n_rows + len(extra), n_rows + len(extra) + len(w)))
                    extra += [ids for _, ids in w]
                plain[opened] = [p[0] for p in places]
            found = _least_sums(losses, self.best)
            total = float(self.score[own[a:b]].sum())
            for less, changed in found:
                way = plain
                if changed:
                    way = plain.copy()
                    for c, k in changed.items():
                        way[opened[c]] = places[c][k]
                scores.append(total - less)
                sequences.append(way)
            n.append(len(found))
        more = np.array([len(i) for i in extra], dtype=np.int64)
        flat = np.concatenate([self.flat, np.fromiter((i for e in extra for i in e), np.int32, int(more.sum()))])
        offset = np.concatenate([self.offset, self.offset[-1] + np.cumsum(more)])
        chain = np.concatenate(sequences) if sequences else np.zeros(0, np.int64)
        sizes = offset[chain + 1] - offset[chain]
        ids = flat[_runs(offset[chain], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum([len(s) for s in sequences], dtype=np.int64)])]
        return n, scores, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(pa.array([ids], pa.list_(pa.int32())))[0].as_py()

    def decode_all(self, ids: pa.ListArray) -> pa.Array:
        """The texts of id lists: pieces joined, bytes as UTF-8, U+2581 as a space, the one in front dropped."""
        joined = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, self.raw.take(ids.values)), b"")
        try:
            text = joined.cast(pa.string())
        except pa.ArrowInvalid:  # bytes that make no characters
            text = pa.array([b.decode("utf-8", errors="replace") for b in joined.to_pylist()], pa.string())
        text = pc.replace_substring(text, SPACE, " ")
        return pc.if_else(pc.starts_with(text, " "), pc.utf8_slice_codeunits(text, 1), text)


def _least(loss: np.ndarray, n: int) -> list[int]:
    """Places of the ``n`` smallest finite losses, of equal ones the leftmost, in ascending order."""
    if len(loss) > n:
        at = np.flatnonzero(loss <= np.partition(loss, n - 1)[n - 1]) if n > 0 else np.zeros(0, np.int64)
    else:
        at = np.arange(len(loss))
    at = at[np.argsort(loss[at], kind="stable")[:n]]
    return sorted(at[np.isfinite(loss[at])].tolist())


def _least_sums(losses: list[tuple[float, int, int]], best: int) -> list[tuple[float, dict[int, int]]]:
    """The ``best`` smallest sums of losses, at most one way of each part; losses ascend, each above none."""
    sums: list[tuple[float, dict[int, int]]] = [(0.0, {})]
    for loss, c, k in losses:
        if len(sums) == best and loss >= sums[-1][0]:
            break  # nothing later makes a smaller sum
        more = [(s + loss, way | {c: k}) for s, way in sums if c not in way]
        sums = heapq.nsmallest(best, [*sums, *more], key=lambda x: x[0])
    return sums


def _pieces(path: str, best: int) -> Pieces:
    key = f"{path}:{best}"
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Pieces(path, best)
    return _LOADED[key]


def _by_bytes(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about SLICE_BYTES of its last column, a text; one long text is one piece."""
    _, offsets = string_bytes(batch.columns[-1])
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def _schema(rows: DataFrame, more: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + [more])


ENCODED = ["ids", "n_ids", "best_ids", "best_scores", "round_trip", "decoded"]


def encode_best(docs: DataFrame, model_path: str, names: list[str], text_col: str = "text", best: int = BEST) -> DataFrame:
    """The named columns and, for each whole text, its N best segmentations.

    ids, n_ids: of the best way; best_ids, best_scores: of the N best ways, best first; decoded: the text
    of ids; round_trip: whether every one of the N ways decodes to the text. Null counts as empty, which has
    one way without ids, a score of 0, and decodes to itself. Fewer than ``best`` ways come where a text has
    fewer segmentations. Rows stand alone, repeated ones too; equal texts have equal results. Named columns
    that are called like a result are replaced by it.
    """
    names = [c for c in names if c not in ENCODED]
    rows = docs.select(*names, F.coalesce(F.col(text_col), F.lit("")).alias("piece_text"))
    out = "ids array<int>, n_ids int, best_ids array<array<int>>, best_scores array<double>, round_trip boolean, decoded string"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model_path, best)
        for batch in batches:
            for part in _by_bytes(batch):
                n, scores, ways = pieces.n_best_of(part.columns[-1].to_pylist())
                at = np.concatenate([[0], np.cumsum(n)])
                of_way = np.repeat(np.arange(len(n)), n)
                text = pieces.decode_all(ways)
                wrong = np.bincount(of_way, weights=~pc.equal(text, part.columns[-1].take(pa.array(of_way)).cast(pa.string())).to_numpy(zero_copy_only=False), minlength=len(n))
                offsets, first = pa.array(at.astype(np.int32)), ways.take(pa.array(at[:-1]))
                cols = [first, pc.list_value_length(first), pa.ListArray.from_arrays(offsets, ways), pa.ListArray.from_arrays(offsets, pa.array(scores, pa.float64())), pa.array(wrong == 0), text.take(pa.array(at[:-1]))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *cols], names=[*names, *ENCODED])

    return rows.mapInArrow(scan, _schema(rows, out))


def decode_ids(rows: DataFrame, model_path: str, names: list[str], ids_col: str = "ids") -> DataFrame:
    """The named columns and the text of each row's ids, ``decoded``; null ids give an empty text."""
    names = [c for c in names if c != "decoded"]
    chosen = rows.select(*names, F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("piece_ids"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model_path, BEST)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = pa.array(part.columns[-1].to_pylist(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pieces.decode_all(ids)], names=[*names, "decoded"])

    return chosen.mapInArrow(scan, _schema(chosen, "decoded string"))


def ids_crc32(ids: list[int]) -> int:
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Query: all documents encoded; number and digest of the best ids, hashes of the N best ways' ids, their scores, the round trip."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode_best(docs, public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"])
    digest = F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256")
    hashes = F.transform("best_ids", lambda way: F.xxhash64(way)).alias("best_hashes")
    return out.select("doc_id", "n_ids", digest, hashes, "best_scores", "round_trip")
