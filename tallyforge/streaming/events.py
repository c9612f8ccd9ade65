"""Event files as streams: pages as they finish, loops as they grow, and extractions that come in late."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyforge.functions import fixed
from tallyforge.operators.runlog import upsert_extracts
from tallyforge.sources.readers import EVENTS_DDL

#: What a page's state keeps of its text: all that the loop check looks at, so state does not grow with the page.
TAIL = 1600
#: Pieces between two loop checks.
CHECK_EVERY = 24
#: Milliseconds without a piece after which a page is given up.
IDLE = 3_600_000


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENTS_DDL).json(path)


def document_progress(events: DataFrame) -> DataFrame:
    """Running sums of finished pages by job."""
    done = events.filter("event = 'page_done'")
    return done.groupBy("job").agg(
        F.count("*").alias("pages_done"),
        F.sum("new_tokens").alias("tokens"),
        F.max(F.coalesce("truncated", F.lit(False))).alias("truncated"),
        F.max(F.coalesce("looped", F.lit(False))).alias("looped"),
        F.round(F.sum("seconds"), 2).alias("seconds"),
    )


def _cycles(text: str, most: int, repeats: int) -> bool:
    return any(text.endswith(text[-u:] * repeats) and text[-u:].strip() for u in range(4, most + 1))


def looped(tail: str) -> bool:
    """looks_repetitive of a text of which ``tail`` is the end: it counts on, repeats a line, or is one block over and over."""
    long_lines = (line for line in tail[-2 * fixed.LOOP_TAIL :].splitlines() if len(line) >= fixed.COUNTER_MIN_LINE)
    if any(_cycles(re.sub(r"\d+", "#", line), fixed.COUNTER_MAX_UNIT, fixed.COUNTER_REPEATS) for line in long_lines):
        return True
    end = tail[-fixed.LOOP_TAIL :]
    if len(end) < fixed.LOOP_TAIL:
        return False
    kept = filter(None, map(str.strip, end.splitlines()))
    runs = ((line, sum(1 for _ in same)) for line, same in itertools.groupby(kept))
    return any(n >= fixed.LOOP_REPEATS and len(line) > 3 for line, n in runs) or _cycles(end, fixed.LOOP_TAIL // fixed.LOOP_REPEATS, fixed.LOOP_REPEATS)


def watch_pages(events: DataFrame, idle: int = IDLE) -> DataFrame:
    """(job, page, pieces, looped) after each batch: pieces of a page's text are joined in its state, of which only a tail is kept. A
    page's state goes when the page ends, or when nothing has come for ``idle`` milliseconds."""

    def watch(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pieces, tail, cycles = state.get if state.exists else (0, "", False)
        ended = state.hasTimedOut
        for frame in () if ended else frames:
            for kind, text in zip(frame["event"], frame["text"]):
                if kind == "token":
                    pieces, tail = pieces + 1, (tail + (text or ""))[-TAIL:]
                    cycles = cycles or (pieces % CHECK_EVERY == 0 and looped(tail))
                ended = ended or kind == "page_done"
        cycles = cycles or (ended and looped(tail))
        if ended:
            state.remove()
        else:
            state.update((pieces, tail, cycles))
            state.setTimeoutDuration(idle)
        yield pd.DataFrame({"job": [key[0]], "page": [key[1]], "pieces": [pieces], "looped": [cycles]})

    rows = events.filter("event in ('token', 'page_done')").select("job", "page", "event", "text")
    return rows.groupBy("job", "page").applyInPandasWithState(
        watch, "job string, page int, pieces long, looped boolean", "pieces long, tail string, looped boolean", "update", GroupStateTimeout.ProcessingTimeTimeout
    )


def windowed_counts(events: DataFrame, time: str = "ts", late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Events by hour and type, rows later than the watermark left out."""
    timed = events.withColumn(time, F.col(time).cast("timestamp"))
    return timed.withWatermark(time, late).groupBy(F.window(time, size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def snapshots(spark: SparkSession, path: str) -> list[int]:
    """Batches whose snapshot of the log is complete, in order."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(place):
        return []
    found = [status.getPath() for status in files.listStatus(place)]
    whole = [p.getName() for p in found if p.getName().startswith("batch=") and files.exists(p.suffix("/_SUCCESS"))]
    return sorted(int(name.removeprefix("batch=")) for name in whole)


def late_extracts(log_path: str, out_path: str):
    """For foreachBatch: the log as it is after the batch's extractions. Each batch starts from the newest snapshot of the batches before it, or from
    the log where there is none, and writes the next one beside it, so a batch that runs again gives the same. One writer at a time."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = [k for k in snapshots(spark, out_path) if k < batch_id]
        log = spark.read.parquet(f"{out_path}/batch={before[-1]}" if before else log_path)
        upsert_extracts(log, batch, F.lit(f"batch {batch_id}")).write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    return apply


def latest_log(spark: SparkSession, log_path: str, out_path: str) -> DataFrame:
    """The log after the last batch."""
    done = snapshots(spark, out_path)
    return spark.read.parquet(f"{out_path}/batch={done[-1]}" if done else log_path)
