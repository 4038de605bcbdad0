"""Document fingerprints by spot signatures.

An anchor is a common word; its spot is the anchor with the chain of the next ``CHAIN`` content words
(words that are no anchors) of the text. A fingerprint is the set of a text's distinct spots, written as
ascending 32-bit hashes in hexadecimal. Likeness is the Jaccard index of two sets. ``near_classes`` joins all
fingerprints by likeness; ``compare_with_next`` compares fixed neighbours.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .near_duplicates import confirmed
from .store import materialise
from .words import Words, mix, slices, string_bytes

CHAIN = 2
# Common words of four languages.
ANCHORS = """
the of and to in is it that was for on are with as be at by this from or an a have has not but what when who
der die das und ist von zu mit den dem ein eine einer für auf im nicht sich als auch an aus bei
le la les des du de un une et est en que qui dans pour sur pas par au plus ne se
el los las del una y es por con para su se lo como más o al
""".split()


def _anchor_hashes() -> np.ndarray:
    raw, offsets = string_bytes(pa.array(sorted(set(ANCHORS))))
    return np.sort(Words(raw, offsets).hashes(lower=True))


_ANCHOR_HASHES = _anchor_hashes()


def spot_sets(words: Words, chain: int = CHAIN) -> list[np.ndarray]:
    """For each text the ascending distinct spots. Words without any spot make one of all words."""
    h = words.hashes(lower=True)
    anchor = _ANCHOR_HASHES[np.minimum(np.searchsorted(_ANCHOR_HASHES, h), len(_ANCHOR_HASHES) - 1)] == h
    content = np.flatnonzero(~anchor)
    at = np.flatnonzero(anchor)
    ends = words.ends_of_text()
    first = np.searchsorted(content, at)
    fits = first + chain <= len(content)
    at, first = at[fits], first[fits]
    inside = content[first + chain - 1] < ends[at] if len(at) else np.zeros(0, bool)
    at, first = at[inside], first[inside]
    spot = h[at]
    for c in range(chain):
        spot = mix(spot * np.uint64(0x9E3779B97F4A7C15) + h[content[first + c]], c + 1)
    spot >>= np.uint64(32)
    cut = np.searchsorted(at, words.first)
    out = []
    for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
        lo, hi = words.first[i], words.first[i + 1]
        found = np.unique(spot[a:b])
        if not len(found) and hi > lo:
            found = np.array([mix(np.bitwise_xor.accumulate(mix(h[lo:hi] + np.arange(hi - lo, dtype=np.uint64)))[-1:])[0] >> np.uint64(32)], dtype=np.uint64)
        out.append(found)
    return out


def written(spots: np.ndarray) -> str:
    return spots.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard index of ascending sets; two empty sets are alike. Under ``least`` by their sizes alone: 0."""
    small, large = sorted((len(a), len(b)))
    if not large:
        return 1.0
    if small < least * large:
        return 0.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, fingerprint, n_spots. Null text counts as empty and has the empty fingerprint."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in slices(batch, "text"):
                sets = spot_sets(words)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([written(s) for s in sets], pa.string()), pa.array([len(s) for s in sets], pa.int32())], names=["doc_id", "fingerprint", "n_spots"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan, "doc_id long, fingerprint string, n_spots int")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_spots, class_id: the smallest doc_id reachable over links of fingerprints.

    Fingerprints with a likeness of at least ``percent`` are linked; equal ones are one. Sets are partitioned
    by length, in steps of the least likeness: a set is compared within its own part and with the next
    shorter one. Of a set of n spots, two linked sets share one of the first n - ceil(percent * n) + 1, rarest
    first, so these alone are keys. What meets under a key is tied to the key's first set, which gives
    candidates; their components are confirmed on full sets, in blocks, and no key's pairs are written out.
    Texts without words have the empty fingerprint and are linked with nothing. A null id stays null and
    counts as the smallest; rows with equal ids are rows of their own. Other columns are not read.
    """
    prints = materialise(fingerprints(docs, id_col, text_col), "prints")
    sets = prints.filter("n_spots > 0").select("fingerprint", "n_spots").distinct()
    nodes = materialise(sets.withColumn("node", F.monotonically_increasing_id()), "nodes")
    spots = F.transform(F.sequence(F.lit(0), F.col("n_spots") - 1), lambda i: F.conv(F.substring("fingerprint", i * 8 + 1, F.lit(8)), 16, 10).cast("long"))
    each = nodes.select("node", "n_spots", F.explode(spots).alias("spot"))
    times = each.groupBy("spot").agg(F.count("*").alias("times"))
    ranked = each.join(times, "spot").groupBy("node", "n_spots").agg(F.array_sort(F.collect_list(F.struct("times", "spot"))).alias("spots"))
    first = F.slice("spots", 1, (F.col("n_spots") - F.ceil(F.col("n_spots") * percent / 100) + 1).cast("int"))
    shared = ranked.select("node", "n_spots", F.explode(first).alias("s")).filter("s.times > 1").select("node", "n_spots", "s.spot")
    part = F.floor(F.log(F.col("n_spots").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9)
    keyed = shared.withColumn("part", part).select("node", "spot", F.explode(F.array(F.struct(F.col("part"), F.lit(True).alias("own")), F.struct((F.col("part") + 1).alias("part"), F.lit(False).alias("own")))).alias("k")).select("node", "spot", "k.part", "k.own")
    heads = keyed.groupBy("spot", "part").agg(F.min(F.when(F.col("own"), F.col("node"))).alias("head"), F.count("*").alias("n")).filter("head is not null and n > 1")
    edges = materialise(keyed.join(heads, ["spot", "part"]).filter("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct(), "candidates")

    def as_elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(bytes.fromhex(f), ">u4").astype(np.uint64).tobytes() for f in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["node", "elements"])

    sizes = nodes.select("node", F.col("n_spots").alias("n_shingles"), "fingerprint")
    links = confirmed(edges, sizes, lambda members: members.select("node", "fingerprint").mapInArrow(as_elements, "node long, elements binary"), percent)
    named = nodes.join(components(links), "node", "left").select("fingerprint", F.coalesce("component", "node").alias("root"))
    placed = materialise(prints.join(named, "fingerprint", "left").select("doc_id", "n_spots", "root"), "placed")
    least = placed.filter("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id"))["doc_id"].alias("class_id"), F.lit(True).alias("known"))
    return placed.join(least, "root", "left").select("doc_id", "n_spots", F.when(F.col("known"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))


# --- the query: a document, its edited text and the next document

_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in _OUT.split(", ")]


def _sets_of(texts: list[str]) -> list[np.ndarray]:
    out = []
    for _, words in slices(pa.record_batch({"text": pa.array(texts, pa.large_string())}), "text"):
        out += spot_sets(words)
    return out


def _compared(ids: list, texts: list[str], following: list[str]) -> list[tuple]:
    """Rows of the query for texts and the texts that follow them."""
    edited = []
    for text, after in zip(texts, following, strict=True):
        n = len(text) // 2
        edited.append(text[: len(text) - n] + after[:n])
    own, new, behind = _sets_of(texts), _sets_of(edited), _sets_of(following)
    return [
        (i, len(t), hashlib.sha256(e.encode()).hexdigest(), written(a), written(b), likeness(a, b), likeness(a, c))
        for i, t, e, a, b, c in zip(ids, texts, edited, own, new, behind, strict=True)
    ]


def _bucketed(rows: DataFrame, n: int) -> DataFrame:
    """Adds ``bucket``: a range of ids, ascending, about n of them; null ids are in bucket -1."""
    bounds = sorted(set(rows.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.1 / n))) if n > 1 else []
    if not bounds:
        return rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), -1).otherwise(0))
    cut = Bucketizer(splits=[float("-inf"), *bounds, float("inf")], inputCol="as_double", outputCol="in_range", handleInvalid="keep")
    found = cut.transform(rows.withColumn("as_double", F.col("doc_id").cast("double")))
    return found.withColumn("bucket", F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("in_range").cast("int"))).drop("as_double", "in_range")


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text, its edited text and the next one in descending order of ids, by their fingerprints.

    The edited text has its last floor(n/2) code points replaced by the first as many of the next text.
    Equal ids are ordered by text; null ids come last; null text counts as empty; a single row is its own
    next. Two texts without words are alike. Very long texts are compared whole. Other columns are not read. Rows are dealt by ranges of ids, and each range also gets a copy of the row that follows its last
    one: texts are shuffled once. What reaches the driver is one id for each range.
    """
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = _bucketed(rows, n)
    tops = {r["bucket"]: r["top"] for r in rows.groupBy("bucket").agg(F.max("doc_id").alias("top")).collect()}
    ring = sorted(tops, reverse=True)
    before = dict(zip(ring, [ring[-1:] and ring[-1], *ring[:-1]], strict=False))
    heads = rows.filter(F.col("doc_id").isin([t for t in tops.values() if t is not None]) | F.col("doc_id").isNull()).groupBy("bucket", "doc_id").agg(F.min("text").alias("text"))
    taker = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])[F.col("bucket")] if before else F.lit(0)
    copies = heads.select("doc_id", "text", taker.alias("bucket"), F.lit(True).alias("copy"))
    dealt = rows.withColumn("copy", F.lit(False)).unionByName(copies).repartitionByRange(n, "bucket")
    dealt = dealt.sortWithinPartitions("bucket", "copy", F.col("doc_id").desc_nulls_last(), "text").select("doc_id", "text", "bucket", "copy")
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    schema = pa.schema(list(zip(_NAMES, types, strict=True)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                ids, texts, following = [], [], []
                for i, text, bucket, copy in zip(*(c.slice(at, 500).to_pylist() for c in batch.columns), strict=True):
                    if last is not None and last[2] == bucket:
                        ids.append(last[0])
                        texts.append(last[1])
                        following.append(text)
                    last = None if copy else (i, text, bucket)
                if ids:
                    out = _compared(ids, texts, following)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], schema=schema)

    return dealt.mapInArrow(scan, _OUT)


def near_spot_classes(spark, sf_dir: str) -> DataFrame:
    """Query: the classes of near fingerprints of all documents."""
    return near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def op9_spot_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Query: all documents compared with their edited texts and their next documents."""
    return compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
