"""Streaming counterparts: throughput per window, merge sink, micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.operators.windows import upsert


def throughput(events: DataFrame, ts: str = "ts", width: str = "3 seconds", late: str = "10 seconds") -> DataFrame:
    """(start, n, total) per tumbling window; works on batches and, with a watermark, on streams."""
    source = events.withWatermark(ts, late) if events.isStreaming else events
    return source.groupBy(F.window(ts, width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "n", "total")


def merge_into(target: str, key: list[str], seq: list[str], merged: list[str] | None = None):
    """A foreachBatch function that keeps the latest row of each key in a Parquet folder, two generations in turn."""

    def apply(batch: DataFrame, epoch: int) -> None:
        spark: SparkSession = batch.sparkSession
        old, new = f"{target}/gen={(epoch + 1) % 2}", f"{target}/gen={epoch % 2}"
        rows = batch
        if epoch:
            rows = spark.read.parquet(old).unionByName(batch)
        upsert(rows, key, seq, merged).write.mode("overwrite").parquet(new)

    return apply


def status_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def safe_batch(n_ok: int, step: int, margin: float = 0.8) -> int:
    """The suggested batch size below the largest that worked."""
    return int(n_ok * margin) // step * step


def micro_batches(df: DataFrame, work, schema, most: int) -> DataFrame:
    """Calls ``work`` on frames of at most ``most`` rows, as a model with a batch limit needs; works on batches and streams."""

    def run(frames):
        for frame in frames:
            for at in range(0, len(frame), most):
                yield work(frame.iloc[at : at + most])

    return df.mapInPandas(run, schema)


def answered(jobs: DataFrame, ids: list[str], payload: str, serve, answer: str, most: int) -> DataFrame:
    """Adds ``answer``: ``serve`` gets frames of at most ``most`` requests and gives an answer to each.

    Requests carry their ids (worker and sequence, say) through the service, so an answer belongs to
    its request whatever the batches are; no future or correlation table is kept anywhere.
    """
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    def run(batch):
        return batch[[*ids, payload]].assign(answer=serve(batch))

    schema = StructType([*(jobs.schema[c] for c in [*ids, payload]), StructField("answer", _parse_datatype_string(answer))])
    return micro_batches(jobs.select(*ids, payload), run, schema, most)


def progress_marks(jobs: DataFrame, by: str, order: list[str], every: int = 100, seconds: float = 30.0, tail: int = 100) -> DataFrame:
    """(by, marks): for each finished job of a queue, in order, whether progress is reported then (the rule of ``progress_due``)."""
    queue = jobs.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct(*order))), lambda x: F.unix_micros(x[order[0]].cast("timestamp"))).alias("at"))
    begin = F.struct(F.lit(0).alias("done"), F.get("at", F.lit(0)).alias("last"), F.array().cast("array<boolean>").alias("marks"))

    def step(acc, at):
        done = acc["done"] + 1
        due = (done % every == 0) | (at - acc["last"] >= int(seconds * 1_000_000)) | (F.size("at") - done < tail)
        return F.struct(done.alias("done"), F.when(due, at).otherwise(acc["last"]).alias("last"), F.concat(acc["marks"], F.array(due)).alias("marks"))

    return queue.select(by, F.aggregate("at", begin, step, lambda acc: acc["marks"]).alias("marks"))


def sweep_batches(work, sizes, warm_ups: int = 2, margin: float = 0.8) -> tuple[list[tuple[int, bool]], int]:
    """([(size, worked)], suggested size): tries rising sizes until one runs out of memory; each size runs ``warm_ups`` times first."""
    sizes = list(sizes)
    step = sizes[1] - sizes[0] if len(sizes) > 1 else sizes[0]
    tried = []
    for size in sizes:
        try:
            for _ in range(warm_ups + 1):
                work(size)
        except MemoryError:
            tried.append((size, False))
            break
        tried.append((size, True))
    return tried, safe_batch(max((size for size, ok in tried if ok), default=0), step, margin)


def guarded(jobs: DataFrame, arg: str, work) -> DataFrame:
    """Adds ``result`` and ``status``: a job that fails becomes a row that says so and stops no other."""
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    def run(frames):
        for frame in frames:
            result, status = [], []
            for value in frame[arg]:
                try:
                    result.append(float(work(value)))
                    status.append("ok")
                except Exception as error:  # whatever a job raises is its status
                    result.append(None)
                    status.append(f"error: {type(error).__name__}")
            yield frame.assign(result=result, status=status)

    return jobs.mapInPandas(run, StructType([*jobs.schema, StructField("result", DoubleType()), StructField("status", StringType())]))


def progress_due(done: int, total: int, since: float, every: int = 100, seconds: float = 30.0, tail: int = 100) -> bool:
    """Whether to report progress: at each ``every`` jobs, after ``seconds`` of silence, and for the last ``tail`` jobs."""
    return done % every == 0 or since >= seconds or total - done < tail
