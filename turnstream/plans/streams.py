"""Queries that run as streams: tables replayed in time, with restarts between the batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstream.plans import bindings as b
from turnstream.plans.bindings import table
from turnstream.plans.registry import SQL, query
from turnstream.plans.requests import _TTL
from turnstream.streaming import live, quotas, replay, results

_WITHIN_MS = 700_000
_END = "2100-01-01"
_NOBODY = -1


def _requests(spark, d) -> tuple[DataFrame, DataFrame]:
    """Events as requests; their results come up to a thousand seconds later, some with an error, some never."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("client"), F.col("event_id").alias("item"), F.col("ts").cast("timestamp").alias("asked"), "event_type")
    done = F.timestamp_micros(F.unix_micros("asked") + (F.col("item") * 7919) % 1_000_000_000)
    came = rows.filter(F.col("item") % 13 != 5)
    error = F.when(F.col("item") % 11 == 3, "failed")
    return rows.drop("event_type"), came.select("client", "item", done.alias("done"), F.when(error.isNull(), F.col("event_type")).alias("text"), error.alias("error"))


@query(f"""with e as (select user_id, event_id, event_type, epoch_us(ts) as us, (event_id * 7919) % 1000000000 as wait, event_id % 13 <> 5 and (event_id * 7919) % 1000000000 <= {_WITHIN_MS} * 1000 as came, event_id % 11 = 3 as failed from events)
 select user_id, cast(row_number() over (partition by user_id order by us + case when came then wait else {_WITHIN_MS} * 1000 end, event_id) as bigint) as place, event_id,
 case when came and not failed then 'transcription' else 'error' end as type, case when came and not failed then event_type end as text, case when not came then '{results.NO_ANSWER}' when failed then 'failed' end as error from e""")
def q103_answers_in_order(spark, d):
    """Requests and results as two streams: joined within their watermarks, sent on in the order in which they are done."""
    asked, done = _requests(spark, d)
    far = lambda df, c: spark.range(1).select(*[F.lit(_NOBODY).cast(t).alias(n) if n in ("client", "item") else F.lit(_END).cast(t).alias(n) if n == c else F.lit(None).cast(t).alias(n) for n, t in df.dtypes])
    flow = lambda s: results.in_order(results.answered(s["asked"], s["done"], _WITHIN_MS))
    out = replay.replay({"asked": (asked, F.unix_micros("asked")), "done": (done, F.unix_micros("done"))}, flow, last={"asked": far(asked, "asked"), "done": far(done, "done")})
    return out.filter(F.col("client") != _NOBODY).select(F.col("client").alias("user_id"), "place", F.col("item").alias("event_id"), "type", "text", "error")


@query(SQL["q74_quota_with_expiry"])
def q104_quota_stream(spark, d):
    """The counters of q74 as a stream whose state runs out."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("client"), F.col("event_id").alias("item"), F.col("ts").cast("timestamp").alias("ts"), F.floor("value").alias("tokens"))
    flow = lambda s: quotas.metered(s["rows"].withWatermark("ts", "0 seconds").withColumn("us", F.unix_micros("ts")), 120, _TTL)
    out = replay.replay({"rows": (rows, F.unix_micros("ts"))}, flow)
    return out.select(F.col("client").alias("user_id"), F.col("item").alias("event_id"), "used", F.col("refused").cast("int").alias("refused"))


def live_frames(spark, d) -> DataFrame:
    """Frames with a score, a volume and a vector; the value stands for all three."""
    f = b.frames(spark, d)
    v = F.array(F.col("value") + 1, F.lit(100.0) - F.col("value"), F.lit(10.0))
    frames = f.select("stream_id", "frame_no", "is_speech", (F.col("value") / 100).alias("score"), (F.col("value") / 100).alias("volume"), F.col("n_samples").cast("long").alias("n_samples"), v.alias("v"), F.lit(False).alias("is_end"))
    end = f.groupBy("stream_id").agg((F.max("frame_no") + 1).alias("frame_no"))
    return frames.unionByName(end.select("stream_id", "frame_no", F.lit(False).alias("is_speech"), F.lit(0.0).alias("score"), F.lit(0.0).alias("volume"), F.lit(0).cast("long").alias("n_samples"), F.array().cast("array<double>").alias("v"), F.lit(True).alias("is_end")))


LIVE = {"least_score": 0.3, "least_volume": 0.32, "factor": 0.5, "similarity": 0.05, "speakers": 3}


@query()
def q105_live_session(spark, d):
    """Active tokens, silent chunks and transcribed ones with their speakers, from one processor."""
    rows = live_frames(spark, d)
    return replay.replay({"frames": (rows, F.col("frame_no"))}, lambda s: live.live_messages(s["frames"], b.CUTTING, b.REJECT, **LIVE))
