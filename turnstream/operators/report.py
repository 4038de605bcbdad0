"""Reports over requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstream.sources.shared import written


def cents(value: Column) -> Column:
    return F.floor(value * 100 + 0.5).cast("long")


def in_buckets(counted: DataFrame, keys: list[str], value: str, buckets: int) -> DataFrame:
    """Distinct values with ``bucket``: the number of their key's cuts below them. Cuts are approximate quantiles of the key's
    distinct values, so a bucket's share of them stays small however the values are spread. They are written once, as
    they are not sure to come out the same twice."""
    shares = [k / buckets for k in range(1, buckets)]
    cuts = counted.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(value, shares, 20 * buckets)).alias("cuts_of_key"))
    dealt = counted.join(written(cuts, "cuts"), keys)
    return dealt.withColumn("bucket", F.size(F.filter("cuts_of_key", lambda c: c < F.col(value)))).drop("cuts_of_key")


def order_statistics(df: DataFrame, keys: list[str], value: str, buckets: int = 400) -> DataFrame:
    """keys, n, least, most, total, p50, p90, p95, p99 of an integer column.

    A percentile q is the int(q*n)-th smallest value if there are at least 10, 20, 100 values for 0.90,
    0.95, 0.99, else the largest; p50 is the lower median. Equal values are counted first; the distinct ones
    of a key are dealt into about ``buckets`` ranges of equal numbers, and what is ordered in one task is a
    bucket: the buckets' sums, at most ``buckets`` rows a key, say how many values lie before it.
    """
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("times"))
    dealt = in_buckets(counted, keys, value, buckets)
    sums = dealt.groupBy(*keys, "bucket").agg(F.sum("times").alias("held"))
    w = Window.partitionBy(*keys)
    before = sums.select(*keys, "bucket", (F.sum("held").over(w.orderBy("bucket")) - F.col("held")).alias("before"), F.sum("held").over(w).alias("n"))
    run = dealt.join(before, [*keys, "bucket"]).withColumn("upto", F.col("before") + F.sum("times").over(Window.partitionBy(*keys, "bucket").orderBy(value)))

    def at(q: float, least: int) -> Column:
        place = F.when(F.col("n") >= least, F.greatest(F.floor(F.lit(q) * F.col("n")), F.lit(1))).otherwise(F.col("n"))
        return F.min(F.when(F.col("upto") >= place, F.col(value)))

    return run.groupBy(*keys).agg(F.max("n").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.sum(F.col(value) * F.col("times")).alias("total"),
        F.min(F.when(F.col("upto") * 2 >= F.col("n"), F.col(value))).alias("p50"), at(0.90, 10).alias("p90"), at(0.95, 20).alias("p95"), at(0.99, 100).alias("p99"))


def first_of(df: DataFrame, key: str, order: str, value: str, where: Column) -> DataFrame:
    """For each key the value of the first row that the condition holds for; null if none."""
    return df.groupBy(key).agg(F.min_by(F.when(where, F.col(value)), F.when(where, F.col(order))).alias(value))


def first_k(df: DataFrame, key: str, order: str, k: int) -> DataFrame:
    """The first k rows of each key."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col("rank") <= k)


def milli(value: Column) -> Column:
    """Thousandths, rounded half up: what reports show with three places."""
    return F.floor(value * 1000 + 0.5).cast("long")


def with_rates(statistics: DataFrame, n_all: Column, audio: Column) -> DataFrame:
    """Adds to order_statistics what a report shows besides: success, average, real-time factors, throughput.

    Values are in the unit of ``audio`` (the length of one request's audio), which a real-time factor divides
    by; the wall time is the longest request. All in thousandths.
    """
    n, wall, average = F.col("n").cast("double"), F.col("most").cast("double"), F.col("total").cast("double") / F.col("n")
    factors = {f"rtf_{c}": milli(F.col(c).cast("double") / audio) for c in ("least", "most", "p90", "p95", "p99")}
    rest = {"success_milli": milli(n / n_all), "avg_milli": milli(average), "rtf_avg": milli(average / audio), "per_wall": milli(n / wall), "audio_per_wall": milli(n * audio / wall)}
    return statistics.withColumns({**factors, **rest})


def elapsed_by(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, n, least, most, avg_milli: how long requests of each status took."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), milli(F.sum(value).cast("double") / F.count("*")).alias("avg_milli"))


def speed_up(df: DataFrame, key: str, base: str, value: str, audio: Column) -> DataFrame:
    """key, avg_milli, least, rtf_micro, speed_up_milli: a benchmark's methods (one row each) against ``base``."""
    own = df.groupBy(key).agg(F.avg(value).alias("a"), F.min(value).alias("least"))
    return own.withColumn("base", F.max(F.when(F.col(key) == base, F.col("a"))).over(Window.partitionBy(F.lit(0)))).select(key, milli(F.col("a")).alias("avg_milli"), "least", F.floor(F.col("a") / audio * 1_000_000 + 0.5).cast("long").alias("rtf_micro"), milli(F.col("base") / F.col("a")).alias("speed_up_milli"))
