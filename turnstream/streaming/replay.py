"""Tables replayed as streams: batches of files in order of time, one run of the query for each from the same checkpoint."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstream.sources.shared import new_folder

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": ROCKS,
    "spark.sql.streaming.join.stateFormatVersion": "3",  # one store a partition instead of four
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",  # else each write reads first, for a metric
}


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Keyed state with timers needs RocksDB, and joins are faster with these settings; the session's own come back afterwards."""
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def cuts(df: DataFrame, micros: Column, batches: int) -> list[int]:
    """Times that cut the rows into ``batches`` of about the same size."""
    shares = [k / batches for k in range(1, batches)]
    return (df.agg(F.percentile_approx(micros, shares).alias("cut")).first()["cut"] or []) if shares else []


def replay(inputs: dict[str, tuple[DataFrame, Column]], flow: Callable[[dict[str, DataFrame]], DataFrame], batches: int = 3, last: dict[str, DataFrame] | None = None) -> DataFrame:
    """What ``flow`` makes of the inputs as streams, as a table.

    inputs: a table and its time in microseconds by name. All are cut at the same times; each cut is a restart: its files are
    added, and the query runs over all that is new from the checkpoint that the run before left, and ends. Rows of ``last``,
    far in the future, follow: they move the watermark past all others, so that nothing waits in the state. The result is
    read from a file sink, which holds each row once however often a run is repeated.
    """
    spark = next(iter(inputs.values()))[0].sparkSession
    folder = new_folder(spark, "streams")
    at = cuts(*next(iter(inputs.values())), batches)
    place = lambda micros: sum((micros > c).cast("int") for c in at) if at else F.lit(0)
    steps = [{name: df.filter(place(micros) == k) for name, (df, micros) in inputs.items()} for k in range(len(at) + 1)]
    with state_store(spark):
        for step in steps + ([last] if last else []):
            for name, df in step.items():
                df.write.mode("append").parquet(f"{folder}/in/{name}")
            streams = {name: spark.readStream.schema(df.schema).parquet(f"{folder}/in/{name}") for name, (df, _) in inputs.items()}
            out = flow(streams)
            out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")
