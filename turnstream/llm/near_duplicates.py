"""Near-duplicates by word shingles: b-bit MinHash, a multi-index Hamming join, exact confirmation.

Signature: MinHash values of 16 bits each, dealt into chunks (``plan``). Candidates are the pairs of
signatures within RADIUS = 2 * chunks - 1 differing values: by pigeonhole such a pair has a chunk with at
most one differing value, and leaving out each value of each chunk in turn enumerates those errors, so the
pair meets under at least one key, for certain. The chunks are chosen by the bound so that a pair at that
very similarity is within the radius but for about 1 in 10**5 (values differ independently, with the
probability of one minus the similarity): 10 chunks of 5 for 85 %, 12 of 4 for 80 %, 16 of 3 for 70 %.

Candidates under a key give the edges of a spanning forest, not pairs. A key with more than ``BLOCK``
signatures is compared block against block, so no task holds it whole. Within the components of
candidates, links are confirmed on the full shingle sets: a component that fits one block at once, a
larger one first against its best-connected members, then the rest against all, in blocks. What leaves
any task is a forest again. Equal sets count as one node throughout.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .store import materialise
from .words import Ranges, Words, mix, slices

SHINGLE = 5
PERCENT = 85
SYMBOLS = 50
BLOCK = 512
GROUP_NODES, GROUP_SHINGLES = 256, 1_000_000
PIVOTS = 8
_SEEDS = mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64), 0xA0761D6478BD642F) | np.uint64(1)


def plan(percent: int) -> tuple[int, int]:
    """Chunks, and values in a chunk, for links of at least ``percent``."""
    if percent < 70:
        raise ValueError("links of less than 70 % are not guaranteed by any of the plans")
    return (10, 5) if percent >= 85 else (12, 4) if percent >= 80 else (16, 3)


def radius(percent: int) -> int:
    """Differing values of a signature within which pairs are sure to be candidates, and beyond which they are none."""
    return 2 * plan(percent)[0] - 1


# --- sets and signatures


def shingle_sets(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, behind each other, and where each text's begin.

    A text with fewer words than a shingle has its whole word sequence as the one element; a text
    without words has none.
    """
    ranges, n_texts = Ranges(words.hashes(lower=True)), len(words.first) - 1
    ends, counts = words.ends_of_text(), np.diff(words.first)
    starts = np.arange(len(words))
    whole = starts + size <= ends
    short = (counts > 0) & (counts < size)
    begin = np.concatenate([starts[whole], words.first[:-1][short]])
    end = np.concatenate([starts[whole] + size, words.first[1:][short]])
    text = np.searchsorted(words.first, begin, side="right") - 1
    h = ranges(begin, end) if len(begin) else np.zeros(0, np.uint64)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[new], text[new]
    return h, np.searchsorted(text, np.arange(n_texts + 1))


def signatures(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """MinHash values cut to 16 bits, one row a text; texts without elements get zeros."""
    full = np.flatnonzero(np.diff(at))
    out = np.zeros((len(at) - 1, SYMBOLS), dtype=np.uint16)
    if len(full):
        for k, seed in enumerate(_SEEDS):
            x = h * seed
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
            # the smallest value's own high bits are nearly always zero: its bits are mixed before they are cut
            out[full, k] = (mix(np.minimum.reduceat(x, at[full])) >> np.uint64(48)).astype(np.uint16)
    return out


def chunk_keys(sig: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """For each signature and each value of each chunk, a key of the chunk's other values."""
    chunks, width = plan(percent)
    n, values = len(sig), sig[:, : chunks * width].reshape(len(sig), chunks, width).astype(np.uint64)
    keys = np.empty((n, chunks, width), dtype=np.uint64)
    for leave in range(width):
        packed = np.zeros((n, chunks), dtype=np.uint64)
        for j in range(width):
            if j != leave:
                packed = (packed << np.uint64(16)) | values[:, :, j]
        keys[:, :, leave] = mix(mix(packed) + (np.arange(chunks, dtype=np.uint64) * np.uint64(width) + np.uint64(leave + 1)))
    return keys.reshape(n, chunks * width)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("doc_id"), F.xxhash64(text).alias("copy"), text.alias("text"))


def _signed(rows: DataFrame) -> DataFrame:
    names = ["doc_id", "copy", "n_shingles", "set_a", "set_b", "signature"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in slices(batch, "text"):
                h, at = shingle_sets(words)
                a, b = (np.concatenate([[np.uint64(0)], np.cumsum(mix(h, salt), dtype=np.uint64)]) for salt in (1, 2))
                n = np.diff(at)
                sig = signatures(h, at)
                cols = [part.column(0), part.column(1), pa.array(n.astype(np.int64)), *(pa.array((c[at[1:]] - c[at[:-1]]).view(np.int64)) for c in (a, b)), pa.array([s.tobytes() for s in sig], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return rows.mapInArrow(scan, "doc_id long, copy long, n_shingles long, set_a long, set_b long, signature binary")


# --- candidates


def _forest(near: np.ndarray) -> np.ndarray:
    """For each node of a symmetric adjacency matrix the smallest node that it reaches."""
    n = len(near)
    label = np.arange(n)
    while True:
        least = np.minimum(label, np.where(near, label[None, :], n).min(axis=1))
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _pairs_of_blocks(rows: DataFrame, key: str, blocks: str, block: str) -> DataFrame:
    """A copy of each row for every pair (low, high) of its key's blocks that it takes part in."""
    pairs = F.transform(F.sequence(F.lit(0), F.col(blocks) - 1), lambda o: F.struct(F.least(o, F.col(block)).alias("low"), F.greatest(o, F.col(block)).alias("high")))
    return rows.select("*", F.explode(pairs).alias("pair")).select("*", "pair.low", "pair.high").drop("pair")


def _candidate_edges(nodes: DataFrame, percent: int) -> DataFrame:
    """nodes: node, signature. Edges of a forest for each key's signatures within the radius of each other."""
    chunks, width = plan(percent)
    used, most = chunks * width, radius(percent)
    schema = pa.schema([("node", pa.int64()), ("key", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint16).reshape(-1, SYMBOLS)
            keys = chunk_keys(sig, percent)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), keys.shape[1])), pa.array(keys.reshape(-1).view(np.int64))], schema=schema)

    keyed = nodes.mapInArrow(scan, "node long, key long")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("members")).filter("n > 1")
    # keys with the same members say the same: one of them is enough
    shared = shared.groupBy("n", "members").agg(F.min("key").alias("key")).drop("members")
    met = keyed.join(shared, "key").join(nodes, "node")
    met = met.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = _pairs_of_blocks(met, "key", "blocks", "block").select("key", "low", "high", "block", "node", "signature")
    dealt = dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    edge = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(nodes_: np.ndarray, block: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(nodes_)
        nodes_, block, sig = nodes_[order], block[order], sig[order]
        n = len(nodes_)
        if n == 2:
            near = (sig[0, :used] != sig[1, :used]).sum() <= most
            return (nodes_[1:], nodes_[:1]) if near else (nodes_[:0], nodes_[:0])
        apart = np.zeros((n, n), dtype=np.uint8)
        for k in range(used):
            apart += sig[:, k, None] != sig[None, :, k]
        near = apart <= most
        if block.min() != block.max():
            near &= block[:, None] != block[None, :]
        label = _forest(near)
        tied = label != np.arange(n)
        return nodes_[tied], nodes_[label[tied]]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            cols = [rest.column(c).to_numpy() for c in (0, 1, 2)]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            if not len(change):
                continue
            yield from groups(rest.slice(0, int(change[-1])), np.concatenate([[0], change]))
            rest = rest.slice(int(change[-1]))
        if rest is not None and rest.num_rows:
            cols = [rest.column(c).to_numpy() for c in (0, 1, 2)]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            yield from groups(rest, np.concatenate([[0], change, [rest.num_rows]]))

    def groups(table: pa.Table, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        block, nodes_ = table.column("block").to_numpy(), table.column("node").to_numpy()
        sig = np.frombuffer(b"".join(table.column("signature").to_pylist()), dtype=np.uint16).reshape(-1, SYMBOLS)
        found = [compare(nodes_[i:j], block[i:j], sig[i:j]) for i, j in zip(at[:-1], at[1:], strict=True) if j - i > 1]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[s] for f in found])) for s in (0, 1)], schema=edge)

    return dealt.mapInArrow(kernel, "a long, b long").distinct()


# --- exact confirmation


def linked(sets: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """Symmetric matrix: 100 * intersection >= percent * union, for sets of distinct hashes."""
    n, sizes = len(sets), np.array([len(s) for s in sets], dtype=np.int64)
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes)
    column = (np.cumsum(counts > 1) - 1)[inverse]
    keep = counts[inverse] > 1
    order = np.argsort(column[keep], kind="stable")
    row, column = row[keep][order], column[keep][order]
    common = np.zeros((n, n), dtype=np.float64)
    width, total = 4096, int(column[-1]) + 1 if len(column) else 0
    for lo in range(0, total, width):
        i, j = np.searchsorted(column, [lo, lo + width])
        part = np.zeros((n, min(width, total - lo)), dtype=np.float32)
        part[row[i:j], column[i:j] - lo] = 1
        common += part @ part.T
    either = sizes[:, None] + sizes[None, :] - common
    return (100 * common >= percent * either) & (either > 0)


def _as_edges(pdf: pd.DataFrame, near: np.ndarray) -> pd.DataFrame:
    label = _forest(near)
    tied = label != np.arange(len(label))
    node = pdf["node"].to_numpy()
    return pd.DataFrame({"a": node[tied], "b": node[label[tied]]})


def _within(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    pdf = pdf.sort_values("node")
    return _as_edges(pdf, linked([np.frombuffer(b, np.uint64) for b in pdf["elements"]], percent))


def _across(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links of nodes of different sides only (side: pivots and others, or two blocks)."""
    pdf = pdf.sort_values("node")
    near = linked([np.frombuffer(b, np.uint64) for b in pdf["elements"]], percent)
    side = pdf["side"].to_numpy()
    return _as_edges(pdf, near & (side[:, None] != side[None, :]))


EDGE = "a long, b long"


def _elements(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The shingle sets of the wanted nodes, read again from their texts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in slices(batch, "text"):
                h, at = shingle_sets(words)
                sets = [h[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["node", "elements"])

    joined = rows.join(wanted, ["doc_id", "copy"]).select("node", "text").dropDuplicates(["node"])
    return joined.mapInArrow(scan, "node long, elements binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept.

    Texts are lower-cased in A-Z and cut at white space; sets of distinct five-word shingles; links at
    100 * intersection >= percent * union; component_id is the smallest id reachable over links. Equal sets
    are linked. Texts without words (null, empty, blank) are linked with nothing, not even each other.
    A null id counts as -2**63. Rows with equal ids are rows of their own; kept says that a row's id is
    its component's. Other columns are not read.
    """
    placed = _placed(docs, id_col, text_col, percent)
    least = placed.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = placed.join(least, "root", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def _placed(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """Per row: doc_id, copy (hash of the text), n_shingles, root (a number for each class, null without words)."""
    rows = _keyed(docs, id_col, text_col)
    signed = materialise(_signed(rows).withColumn("uid", F.monotonically_increasing_id()), "signed")
    same = ["n_shingles", "set_a", "set_b"]
    nodes = signed.filter("n_shingles > 0").groupBy(*same).agg(F.min("uid").alias("node"))
    nodes = materialise(nodes.join(signed.select(F.col("uid").alias("node"), "doc_id", "copy", "signature"), "node"), "nodes")
    edges = materialise(_candidate_edges(nodes.select("node", "signature"), percent), "candidates")
    sizes = nodes.select("node", "n_shingles", "doc_id", "copy")
    classes = components(confirmed(edges, sizes, lambda members: _elements(rows, members.select("node", "doc_id", "copy")), percent))
    root = nodes.join(classes, "node", "left").select(*same, F.coalesce("component", "node").alias("root"))
    return materialise(signed.join(root, same, "left").select("doc_id", "copy", "n_shingles", "root"), "placed")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, of each class only the one with the smallest id (then text hash).

    Rows without words are all kept. Of rows with the same id and text, one is kept. Columns of any names
    pass through. A null id counts as -2**63, null text as empty.
    """
    placed = _placed(docs, id_col, text_col, percent).filter("root is not null")
    least = placed.groupBy("root").agg(F.min("doc_id").alias("doc_id"))
    chosen = placed.join(least, ["root", "doc_id"]).groupBy("root", "doc_id").agg(F.min("copy").alias("copy"))
    chosen = materialise(chosen.select(F.col("doc_id").alias("kept_id"), F.col("copy").alias("kept_copy")), "kept")
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    wordless = ~text.rlike(r"[^\x20\x09-\x0D]")
    whole = docs.filter(~wordless).select(key.alias("kept_id"), F.xxhash64(text).alias("kept_copy"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    one = whole.join(chosen, ["kept_id", "kept_copy"], "left_semi").dropDuplicates(["kept_id", "kept_copy"])
    return one.select("row.*").unionByName(docs.filter(wordless))


def confirmed(edges: DataFrame, sizes: DataFrame, elements: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """Edges of a forest over confirmed links, for candidates' components of any size.

    edges: a, b, candidates that connect each pair that may be linked. sizes: node, n_shingles and what
    ``elements`` needs, which gives node, elements (ascending 64-bit hashes as bytes) for rows of sizes.
    """
    near = components(edges)
    meets = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("meets"))
    members = sizes.join(near, "node").join(meets, "node")
    size = members.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / GROUP_NODES), F.ceil(F.sum("n_shingles") / GROUP_SHINGLES)).cast("int").alias("blocks"))
    members = members.join(size, "component")
    # sets are dealt by node and by block only: what is dealt by component are numbers
    sets = materialise(elements(members), "sets")
    members = materialise(members.select("component", "node", "meets", "blocks", "n_shingles"), "members")
    small = members.filter("blocks = 1").select("component", "node").join(sets, "node").groupBy("component").applyInPandas(lambda pdf: _within(pdf, percent), EDGE)
    large = members.filter("blocks > 1").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # the best-connected members of each large component, against all of it, block by block
    pivots = _best(large)
    sides = large.select("component", "block", "node", F.lit(0).alias("side"))
    to_all = pivots.select("component", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "node", F.lit(1).alias("side"))
    star = sides.join(pivots.select("node"), "node", "left_anti").unionByName(to_all).join(sets, "node")
    starred = materialise(star.groupBy("component", "block").applyInPandas(lambda pdf: _across(pdf, percent), EDGE), "starred")
    # what the largest class so far left out, against all, block by block
    tied = large.select("component", "node", "n_shingles").join(components(starred).withColumnRenamed("component", "class"), "node", "left").withColumn("class", F.coalesce("class", "node"))
    counts = tied.groupBy("component", "class").agg(F.count("*").alias("n")).groupBy("component").agg(F.max(F.struct("n", "class"))["class"].alias("main"))
    tied = tied.join(counts, "component").withColumn("stray", F.col("class") != F.col("main"))
    apart = tied.groupBy("component").agg(*(F.greatest(F.ceil(F.count_if(c) / (GROUP_NODES // 2)), F.ceil(2 * F.sum(F.when(c, F.col("n_shingles")).otherwise(0)) / GROUP_SHINGLES)).cast("int").alias(n) for c, n in ((F.col("stray"), "strays"), (~F.col("stray"), "mains"))))
    dealt = tied.join(apart.filter("strays > 0"), "component").withColumn("block", F.when(F.col("stray"), F.pmod(F.xxhash64("node"), F.col("strays"))).otherwise(F.col("strays") + F.pmod(F.xxhash64("node"), F.col("mains"))).cast("int"))
    others = F.when(F.col("stray"), F.sequence(F.lit(0), F.col("strays") + F.col("mains") - 1)).otherwise(F.sequence(F.lit(0), F.col("strays") - 1))
    pairs = dealt.select("component", "node", "block", F.explode(others).alias("other")).select("component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node", F.col("block").alias("side"))
    crossed = pairs.join(sets, "node").groupBy("component", "low", "high").applyInPandas(lambda pdf: _blocks(pdf, percent), EDGE)
    return materialise(small.unionByName(starred).unionByName(crossed), "links")


def _blocks(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    return _within(pdf, percent) if pdf["side"].nunique() == 1 else _across(pdf, percent)


def _best(large: DataFrame) -> DataFrame:
    """PIVOTS members of each component: members are dealt into as many parts, of each the one that met most."""
    ranked = F.struct("meets", "node")
    top = large.groupBy("component", F.pmod(F.xxhash64("node"), F.lit(PIVOTS)).alias("part")).agg(F.max(ranked)["node"].alias("node"), F.max("blocks").alias("blocks"))
    return top.select("component", "node", "blocks")


def op5_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Query: all documents with the class that their confirmed links put them in."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), percent=PERCENT)
