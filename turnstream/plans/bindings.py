"""How the test tables stand for frames, segments, turns, embeddings and requests.

Each binding is a DataFrame here and a DuckDB common table expression in ``CTE`` for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnstream.config import Cutting

CUTTING = Cutting(minimum_trigger_ms=1500, minimum_silent_ms=400, max_seconds=4)
FRAME = 3200
REJECT = 0.6
RECORDING = 50  # embeddings of a recording
UTTERANCE = 25  # frames of an utterance
TOKENS = 8


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def frames(spark: SparkSession, d: str) -> DataFrame:
    """stream_id, frame_no, is_speech, n_samples, value: events of a user in order of time."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(F.col("user_id").alias("stream_id"), (F.row_number().over(w) - 1).cast("long").alias("frame_no"), (F.col("value") > 30).alias("is_speech"), F.lit(FRAME).alias("n_samples"), "value")


def segments(spark: SparkSession, d: str) -> DataFrame:
    """conv_id, turn, role, t, s, e: turns of a conversation one after another, in centiseconds."""
    text = F.coalesce(F.regexp_replace("text", "\n", " "), F.lit(""))
    dur, gap = F.lit(100) + (F.length(text) * 6) % 700, (F.col("conv_id") * 7 + F.col("turn") * 13) % 50
    end = F.sum(dur + gap).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    return table(spark, d, "conversations").select("conv_id", "turn", "role", text.alias("t"), (end - dur).alias("s"), end.alias("e"))


def shifted(spark: SparkSession, d: str) -> DataFrame:
    """conv_id, pos, s, e, speaker: segments shifted and stretched, with the role as speaker."""
    t = F.col("turn")
    s = F.col("s") - 60 + (t * 37) % 120
    e = F.col("e") - 60 + (t * 53) % 120 - F.when(t % 3 == 0, 300).otherwise(0)
    speaker = F.when(F.col("role") == "user", "SPEAKER_00").when(F.col("role") == "assistant", "SPEAKER_01").otherwise("SPEAKER_02")
    return segments(spark, d).select("conv_id", t.alias("pos"), s.alias("s"), e.alias("e"), speaker.alias("speaker"))


def turns(spark: SparkSession, d: str) -> DataFrame:
    """The shifted segments as a diarizer's turns; every fifth is missing, so that some segments meet none."""
    return shifted(spark, d).filter(F.col("pos") % 5 != 4)


def chunk_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """rec, chunk_idx, n_samples, v, label: embeddings, fifty to a recording."""
    i = F.col("vec_id")
    return table(spark, d, "embeddings").select(F.floor(i / RECORDING).alias("rec"), (i % RECORDING).alias("chunk_idx"), (F.lit(4000) + (i * 997) % 20000).alias("n_samples"), F.col("embedding").cast("array<double>").alias("v"), "label")


def emissions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(utt, t, logp) and (utt, j, token_id): embeddings as scores of 25 frames, labels as eight tokens."""
    i = F.col("vec_id")
    rows = table(spark, d, "embeddings").select(F.floor(i / UTTERANCE).alias("utt"), (i % UTTERANCE).cast("int").alias("t"), F.col("embedding").cast("array<double>").alias("logp"), "label")
    return rows.select("utt", "t", "logp"), rows.filter(F.col("t") < TOKENS).select("utt", F.col("t").alias("j"), (F.col("label") + 1).cast("int").alias("token_id"))


CTE = {
    "frames": f"frames as (select user_id as stream_id, row_number() over (partition by user_id order by ts, event_id) - 1 as frame_no, value > 30 as is_speech, {FRAME} as n_samples, value from events)",
    "seg": """seg as (select conv_id, turn, role, t, e - dur as s, e from (select *, cast(sum(dur + gap) over (partition by conv_id order by turn rows unbounded preceding) as bigint) as e
 from (select conv_id, turn, role, coalesce(replace(text, chr(10), ' '), '') as t, 100 + (length(coalesce(text, '')) * 6) % 700 as dur, (conv_id * 7 + turn * 13) % 50 as gap from conversations)))""",
    "shifted": """shifted as (select conv_id, turn as pos, s - 60 + (turn * 37) % 120 as s, e - 60 + (turn * 53) % 120 - case when turn % 3 = 0 then 300 else 0 end as e,
 case role when 'user' then 'SPEAKER_00' when 'assistant' then 'SPEAKER_01' else 'SPEAKER_02' end as speaker from seg)""",
    "turns": "turns as (select * from shifted where pos % 5 <> 4)",
    "emb": f"emb as (select vec_id // {RECORDING} as rec, vec_id % {RECORDING} as chunk_idx, 4000 + (vec_id * 997) % 20000 as n_samples, embedding::double[] as v, label from embeddings)",
    "em": f"em as (select vec_id // {UTTERANCE} as utt, vec_id % {UTTERANCE} as t, embedding::double[] as e, label from embeddings)",
}


def with_(*names: str, recursive: bool = False) -> str:
    names = [n for x in names for n in (["shifted", x] if x == "turns" else [x])]
    return "with " + ("recursive " if recursive else "") + ",\n".join(CTE[n] for n in names)
