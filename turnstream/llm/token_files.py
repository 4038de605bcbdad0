"""Token-ID files: independent zstandard frames, a trailing seek table and checksums by frame.

One file holds the ids of a run of documents in ascending order of their ids:

* frames, each an independent zstandard frame of whole documents' ids (little-endian uint32);
* one skippable frame (magic 0x184D2A50) with the document index: for each document int64 doc_id,
  uint32 frame, uint32 first id within the frame, uint32 number of ids;
* one skippable frame (magic 0x184D2A5E) with the seek table in zstandard's public seekable format:
  for each frame its compressed size, its size and the low 32 bits of the XXH64 of its content.

A reader takes the two tables from the end of the file and decompresses only the frames of the
documents it is asked for; every zstandard tool can also decompress the file as a whole.
Tasks write files with pyarrow.fs, so that the folder can be on any store that pyarrow opens.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import materialise, new_path
from .words import string_bytes

INDEX_MAGIC, SEEK_MAGIC, SEEKABLE_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1  # fixed values of the public format
FRAME_IDS = 1 << 16
FILE_IDS = 1 << 26
CACHED_WORDS = 600_000
ENCODED_BYTES = 4_000_000
INDEX_TYPE = np.dtype([("doc_id", "<i8"), ("frame", "<u4"), ("at", "<u4"), ("n", "<u4")])
#: fixed value: the splitting rule that drops white space, parts letters from other signs and has no look-around
WORD_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: fixed values: ASCII signs but the apostrophe, which the rule has no letters with; Latin letters
SIGNS, LATIN = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+")
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level tokenizers show as themselves
_BYTE_SIGNS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}
_LOADED: dict = {}


def _opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


# --- the format


class TokenFileWriter:
    """Appends documents to one file; frames close at ``frame_ids`` ids."""

    def __init__(self, sink, frame_ids: int = FRAME_IDS, level: int = 3):
        self.sink, self.frame_ids = sink, frame_ids
        self.zip = zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int, int, int]] = []
        self.open: list[bytes] = []
        self.n_open = self.n_ids = 0

    def add(self, doc_id: int, ids: bytes) -> None:
        n = len(ids) // 4
        self.index.append((doc_id, len(self.frames), self.n_open, n))
        self.open.append(ids)
        self.n_open += n
        self.n_ids += n
        if self.n_open >= self.frame_ids:
            self._frame()

    def _frame(self) -> None:
        data = b"".join(self.open)
        packed = self.zip.compress(data)
        self.sink.write(packed)
        self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.open, self.n_open = [], 0

    def close(self) -> None:
        if self.n_open or (self.index and self.index[-1][1] == len(self.frames)):
            self._frame()
        index = np.array(self.index, dtype=INDEX_TYPE).tobytes()
        self.sink.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SEEK_MAGIC, len(table)) + table)


class TokenFileReader:
    """Reads the tables at the end of a file, then only the frames asked for."""

    def __init__(self, source):
        self.source, size = source, source.size()
        frames, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC or not flags & 0x80:
            raise ValueError("no seek table with checksums at the end of the file")
        head = size - 9 - 12 * frames - 8
        kind, length = struct.unpack("<II", self._at(head, 8))
        if kind != SEEK_MAGIC or length != 12 * frames + 9:
            raise ValueError("the seek table is damaged")
        self.frames = np.frombuffer(self._at(head + 8, 12 * frames), dtype="<u4").reshape(-1, 3)
        self.starts = np.concatenate([[0], np.cumsum(self.frames[:, 0], dtype=np.int64)])
        at = int(self.starts[-1])
        kind, length = struct.unpack("<II", self._at(at, 8))
        if kind != INDEX_MAGIC or length != head - at - 8:
            raise ValueError("the document index is damaged")
        self.index = np.frombuffer(self._at(at + 8, length), dtype=INDEX_TYPE)
        self.unzip = zstandard.ZstdDecompressor()

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def frame(self, k: int) -> bytes:
        size, length, check = (int(x) for x in self.frames[k])
        data = self.unzip.decompress(self._at(int(self.starts[k]), size), max_output_size=max(length, 1))
        if len(data) != length or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return data

    def documents(self, doc_ids: Iterable[int] | None = None) -> Iterator[tuple[int, bytes]]:
        """(doc_id, ids) in the file's order; each frame that holds one of the documents is read once."""
        rows = self.index if doc_ids is None else self.index[np.isin(self.index["doc_id"], list(doc_ids))]
        k, data = -1, b""
        for doc_id, frame, at, n in rows.tolist():
            if frame != k:
                k, data = frame, self.frame(frame)
            yield doc_id, data[4 * at : 4 * (at + n)]


# --- encoding


def _splits_into_words(file: dict) -> bool:
    """Whether a tokenizer's file has the steps that WordEncoder's short cuts hold for, and no others."""
    steps = lambda x, of: x[of] if x and x["type"] == "Sequence" else [x]
    normal = [(s or {}).get("type") for s in steps(file.get("normalizer"), "normalizers")]
    cut = steps(file.get("pre_tokenizer"), "pretokenizers")
    replaced = [s for s in steps(file.get("normalizer"), "normalizers") if (s or {}).get("type") == "Replace"]
    added = [a for a in file.get("added_tokens") or [] if any(c.isspace() for c in a["content"]) or a["content"][:1].isalpha() or a.get("single_word") or a.get("lstrip") or a.get("rstrip") or a.get("normalized")]
    model = file.get("model") or {}
    return (
        set(normal) <= {"NFC", "Replace", "Lowercase"}
        and "Lowercase" in normal
        and all(s["pattern"] == {"Regex": r"\s+"} and s["content"] == " " for s in replaced)
        and [(s or {}).get("type") for s in cut] == ["Split", "ByteLevel"]
        and (cut[0]["pattern"], cut[0]["behavior"], cut[0]["invert"]) == ({"Regex": WORD_RULE}, "Removed", True)
        and not cut[1]["add_prefix_space"]
        and not cut[1]["use_regex"]
        and not added
        and model.get("type") == "BPE"
        and not model.get("dropout")
        and not file.get("truncation")
        and not file.get("padding")
    )


class WordEncoder:
    """Encodes texts with a tokenizer that never joins across ASCII white space.

    Where its normaliser and its splitting rule treat white space as a border, a text's ids are those of its
    pieces between white space, in order; each distinct piece is encoded once and remembered. The rule also
    has a border between a letter and the signs behind it, and its normaliser lower-cases, so pieces of Latin
    letters that differ in these alone are encoded as one. Such letters are one word of the rule, so they go to the
    tokenizer's model as they are when normalised. All this is read from the file: with any other normaliser,
    rule or model, whole texts are encoded.
    """

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer, self.cached = Tokenizer.from_file(path), cached
        self.known: dict[bytes, bytes] = {}
        with open(path, encoding="utf-8") as f:
            self.by_words = _splits_into_words(json.load(f))

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_words:
            return [struct.pack(f"<{len(e)}I", *e.ids) for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
        pieces = [t.split() for t in texts]  # of bytes: at ASCII white space only
        known, new = self.known, set()
        for p in pieces:
            new.update(p)
        if len(known) + len(new) > 2 * self.cached:
            known.clear()
        self._learn(new.difference(known))
        return [b"".join(map(known.__getitem__, p)) for p in pieces]

    def _learn(self, new: set[bytes]) -> None:
        known, wanted, letters, made, other = self.known, set(), set(), [], []
        for p in new:
            core = p.rstrip(SIGNS)
            if core.isalpha():  # of bytes: ASCII letters
                made.append((p, core.lower(), p[len(core) :]))
            elif not core.isascii() and LATIN.fullmatch(word := core.decode()):
                other.append((p, word, p[len(core) :]))
            else:
                wanted.add(p)
        normal = self.tokenizer.normalizer.normalize_str(" ".join([word for _, word, _ in other])).split(" ") if other else []
        for (p, _, tail), word in zip(other, normal, strict=True):
            if LATIN.fullmatch(word):  # still: some capitals become a letter with a mark
                made.append((p, word.encode(), tail))
            else:
                wanted.add(p)
        for _, core, tail in made:
            letters.add(core)
            wanted.add(tail)
        known[b""] = b""
        tokenize = self.tokenizer.model.tokenize
        for core in letters.difference(known):
            ids = [t.id for t in tokenize(core.decode() if core.isascii() else core.decode("latin-1").translate(_BYTE_SIGNS))]
            known[core] = struct.pack(f"<{len(ids)}I", *ids)
        wanted = list(wanted.difference(known))
        encoded = self.tokenizer.encode_batch_fast([w.decode() for w in wanted], add_special_tokens=False)
        for w, e in zip(wanted, encoded, strict=True):
            known[w] = struct.pack(f"<{len(e)}I", *e.ids)
        for p, core, tail in made:
            known[p] = known[core] + known[tail] if tail else known[core]


def _encoder(path: str) -> WordEncoder:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks already fill the cores
    if path not in _LOADED:
        _LOADED[path] = WordEncoder(path)
    return _LOADED[path]


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 1, frame_ids: int = FRAME_IDS, file_ids: int = FILE_IDS) -> DataFrame:
    """Encodes all texts, writes them in ascending order of ``id_col`` and returns the list of files.

    Order: partitions are ranges of ids, rows are sorted within them, and a file's place is (partition,
    number within the partition). Equal ids are ordered by text; a null id is written as the smallest
    (-2**63), null text as empty. An empty table gives no files. A task that runs again writes files
    under new names; only names in the returned list count, so a lost executor leaves nothing wrong.
    Columns: part, piece, path, n_docs, n_ids, first_doc, last_doc.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, context = _encoder(tokenizer_path), TaskContext.get()
        fs, root = _opened(folder)
        fs.create_dir(root, recursive=True)
        end = b"" if end_id is None else struct.pack("<I", end_id)
        made, writer, sink = [], None, None

        def encoded(raw, offsets) -> Iterator[bytes]:
            i, n = 0, len(offsets) - 1
            while i < n:  # about ENCODED_BYTES at a time, one long text alone
                j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + ENCODED_BYTES, side="right")) - 1))
                at = offsets[i : j + 1].tolist()
                yield from encode([raw[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)])
                i = j

        def finish():
            writer.close()
            sink.close()
            made[-1] |= {"n_docs": len(writer.index), "n_ids": writer.n_ids, "first_doc": writer.index[0][0], "last_doc": writer.index[-1][0]}

        for batch in batches:
            raw, offsets = string_bytes(batch.column(1))
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded(raw, offsets), strict=True):
                if writer is None:
                    name = f"part-{context.partitionId():06d}-{len(made):04d}-{context.taskAttemptId()}.tok.zst"
                    sink = fs.open_output_stream(f"{root}/{name}", compression=None)
                    writer = TokenFileWriter(sink, frame_ids)
                    made.append({"part": context.partitionId(), "piece": len(made), "path": f"{folder}/{name}"})
                writer.add(doc_id, ids + end)
                if writer.n_ids >= file_ids:
                    finish()
                    writer = None
        if writer is not None:
            finish()
        yield pa.RecordBatch.from_pylist(made, schema=manifest)

    manifest = pa.schema([("part", pa.int32()), ("piece", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("first_doc", pa.int64()), ("last_doc", pa.int64())])
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    files = rows.mapInArrow(write, "part int, piece int, path string, n_docs long, n_ids long, first_doc long, last_doc long")
    return materialise(files, "token-files")


def with_starts(files: DataFrame) -> DataFrame:
    """Adds to the list of files the number of ids before each; one row a file, so one window holds it."""
    return files.withColumn("file_start", F.sum("n_ids").over(Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["file_start"])


def read_token_files(files: DataFrame, doc_ids: list[int] | None = None) -> DataFrame:
    """Documents from the listed files, checked by frame: doc_id, start, n_tokens, ids_crc32, ids.

    With ``doc_ids``, files without them are skipped by their ranges and of the others only the frames
    that hold them are decompressed.
    """
    wanted = None if doc_ids is None else set(doc_ids)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.to_pylist():
                fs, path = _opened(f["path"])
                with fs.open_input_file(path) as source:
                    reader = TokenFileReader(source)
                    at = np.cumsum(reader.index["n"], dtype=np.int64) - reader.index["n"] + f["file_start"]
                    starts = iter((at if wanted is None else at[np.isin(reader.index["doc_id"], list(wanted))]).tolist())
                    rows, size = [], 0
                    for doc_id, ids in reader.documents(wanted):
                        rows.append((doc_id, next(starts), len(ids) // 4, zlib.crc32(ids), ids))
                        size += len(ids)
                        if size >= 4_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    files = with_starts(files)
    if wanted is not None:
        files = files.filter(" or ".join(f"{int(i)} between first_doc and last_doc" for i in wanted) or "false")
    n = max(1, files.sparkSession.sparkContext.defaultParallelism)
    return files.repartition(n, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def op4_token_files(spark, sf_dir: str) -> DataFrame:
    """Query: all documents encoded, written and read back; digests of what the files hold."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = write_token_files(docs, new_path(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(files).drop("ids")
