"""Structured Streaming variants of the sequence operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from gaitloom.operators.model import log_likelihoods
from gaitloom.session import shared_folder

RUN_SCHEMA = "recording string, syllable int, first_frame bigint, last_frame bigint, n bigint"


def state_stream(spark: SparkSession, folder: str, max_files: int = 1) -> DataFrame:
    """Rows of a growing folder of result files: recording, frame, syllable, loaded_at."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


class _Ordered(StatefulProcessor):
    """Puts a recording's rows in order over micro-batches before they are used.

    Rows within ``late`` frames of the latest frame seen wait, the latest ``loaded_at`` of a frame
    counting, whichever batch brought it; older ones are final. What comes later still is left out.
    So the result does not depend on how rows fall into batches, as long as they come in time, and
    the state holds at most ``late`` rows. With ``idle`` (milliseconds) a recording that brings
    nothing for so long is closed: its waiting rows become final and what is open is emitted.
    """

    FIELDS: list[StructField] = []  # what the subclass keeps besides

    def __init__(self, value: str, value_type, late: int, idle: int | None) -> None:
        self.value, self.value_type, self.late, self.idle = value, value_type, late, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", StructType([StructField("done", LongType()), StructField("frames", ArrayType(LongType())), StructField("loaded", ArrayType(LongType())), StructField("values", ArrayType(self.value_type)), *self.FIELDS]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done, frames, loaded, values, *kept = self.held.get() if self.held.exists() else (-(2**40), [], [], [], *self.fresh())
        new = pd.concat(list(rows))  # one recording's part of a micro-batch
        batch = pd.DataFrame({"frame": np.r_[np.array(frames, np.int64), new["frame"].to_numpy(np.int64)], "loaded": np.r_[np.array(loaded, np.int64), new["loaded"].to_numpy(np.int64)], "v": pd.Series([*values, *new[self.value]], dtype=object)})
        batch = batch[batch["frame"] > done].sort_values(["frame", "loaded"], kind="stable").drop_duplicates("frame", keep="last")
        if len(batch):
            done = max(done, int(batch["frame"].iloc[-1]) - self.late)
        ready = batch[batch["frame"] <= done]
        wait = batch[batch["frame"] > done]
        out, kept = self.use(key[0], ready["frame"].to_numpy(), ready["v"].tolist(), kept)
        plain = [None if not isinstance(v, (list, np.ndarray, tuple)) and pd.isna(v) else self.plain(v) for v in wait["v"]]
        self.held.update((done, wait["frame"].tolist(), wait["loaded"].tolist(), plain, *kept))
        if self.idle:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, frames, _, values, *kept = self.held.get()
        first, kept = self.use(key[0], np.array(frames, np.int64), list(values), kept)
        last = self.finish(key[0], kept)
        self.held.clear()
        yield pd.concat([first, last]) if len(first) and len(last) else first if len(first) else last

    def close(self) -> None:
        pass


class _Runs(_Ordered):
    """Keeps one open run per recording; emits it when the label changes."""

    FIELDS = [StructField("syllable", IntegerType()), StructField("first", LongType()), StructField("last", LongType()), StructField("n", LongType())]
    COLUMNS = ["recording", "syllable", "first_frame", "last_frame", "n"]

    def fresh(self) -> list:
        return [None, None, None, None]

    def plain(self, v) -> int:
        return int(v)

    def use(self, recording: str, frames: np.ndarray, values: list, kept: list) -> tuple[pd.DataFrame, list]:
        there = np.array([v is not None and not pd.isna(v) for v in values], bool)
        s, f = np.array([int(v) for v in values if v is not None and not pd.isna(v)], np.int64), frames[there]
        if not len(s):
            return pd.DataFrame(columns=self.COLUMNS), kept
        start = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        end = np.r_[start[1:], len(s)]
        runs = [[recording, int(s[a]), int(f[a]), int(f[b - 1]), int(b - a)] for a, b in zip(start, end)]
        if kept[0] is not None:
            if kept[0] == runs[0][1]:
                runs[0][2], runs[0][4] = kept[1], kept[3] + runs[0][4]
            else:
                runs.insert(0, [recording, *kept])
        return pd.DataFrame(runs[:-1], columns=self.COLUMNS), runs[-1][1:]

    def finish(self, recording: str, kept: list) -> pd.DataFrame:
        return pd.DataFrame([] if kept[0] is None else [[recording, *kept]], columns=self.COLUMNS)


def _loaded() -> Column:
    return F.coalesce(F.unix_micros(F.col("loaded_at").cast("timestamp")), F.lit(-(2**62))).alias("loaded")


def _keyed(rows: DataFrame, processor: _Ordered, schema: str) -> DataFrame:
    mode = "ProcessingTime" if processor.idle else "None"
    return rows.groupBy("recording").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode=mode)


def stream_runs(stream: DataFrame, late: int = 1024, idle: int | None = None) -> DataFrame:
    """Closed runs of a stream of states: recording, syllable, first_frame, last_frame, n.

    ``stream``: recording, frame, syllable, loaded_at. Frames are final once ``late`` frames later
    ones have come (see :class:`_Ordered`); a recording's last run stays open until its label changes
    or, with ``idle`` milliseconds, nothing more comes. Null syllables are left out. ``idle`` is for
    queries that keep running: one over what is there now would wait for its timers without end.
    """
    rows = stream.where("recording is not null and frame is not null").select("recording", "frame", "syllable", _loaded())
    return _keyed(rows, _Runs("syllable", IntegerType(), late, idle), RUN_SCHEMA)


class _Filter(_Ordered):
    """Holds each recording's filtered state probabilities and last latent rows."""

    FIELDS = [StructField("prob", ArrayType(DoubleType())), StructField("past", ArrayType(ArrayType(DoubleType())))]
    COLUMNS = ["recording", "frame", "syllable", "probability"]

    def __init__(self, params, late: int, idle: int | None) -> None:
        super().__init__("x", ArrayType(DoubleType()), late, idle)
        self.p = params

    def fresh(self) -> list:
        return [[], []]

    def plain(self, v) -> list[float]:
        return [float(x) for x in v]

    def use(self, recording: str, frames: np.ndarray, values: list, kept: list) -> tuple[pd.DataFrame, list]:
        lags, n = self.p.hyper.lags, self.p.hyper.states
        there = [i for i, v in enumerate(values) if v is not None]
        past = [[float(q) for q in x] for x in kept[1]] + [self.plain(values[i]) for i in there]
        out, prob, first = [], np.array(kept[0]) if len(kept[0]) else None, len(kept[1])
        if len(past) > lags and there:
            ll = log_likelihoods(self.p, np.array(past))  # row j: the latent row lags + j
            for j in range(max(first - lags, 0), len(past) - lags):
                w = (np.full(n, 1 / n) if prob is None else prob @ self.p.pi) * np.exp(ll[j] - ll[j].max())
                prob = w / w.sum()
                out.append((recording, int(frames[there[j + lags - first]]), int(prob.argmax()), float(prob.max())))
        return pd.DataFrame(out, columns=self.COLUMNS), [[] if prob is None else prob.tolist(), past[-lags:]]

    def finish(self, recording: str, kept: list) -> pd.DataFrame:
        return pd.DataFrame(columns=self.COLUMNS)


def stream_filter(stream: DataFrame, params, late: int = 1024, idle: int | None = None) -> DataFrame:
    """Most probable state of every row given the rows so far, under fixed model parameters.

    ``stream``: recording, frame, x, loaded_at. Order, corrections and lateness are those of
    :func:`stream_runs`; rows without x are left out, and a recording's first ``lags`` rows have no state.
    """
    rows = stream.where("recording is not null and frame is not null").select("recording", "frame", "x", _loaded())
    return _keyed(rows, _Filter(params, late, idle), "recording string, frame bigint, syllable int, probability double")


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def with_state_store(spark: SparkSession, run):
    """``run()`` under the state store that keyed state needs; the session's setting is put back."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return run()
    finally:
        spark.conf.set(STATE_STORE, before) if before else spark.conf.unset(STATE_STORE)


def window_usage(stream: DataFrame, ts: str, label: str, width: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Events per label and tumbling or sliding window. A window is emitted, and its state dropped, once the watermark,
    ``late`` behind the latest event, has passed its end; rows later than that are left out."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return stream.withWatermark(ts, late).groupBy(w.alias("w"), label).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), label, "n")


def sessions(stream: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Bouts of activity per key that a pause of ``gap`` separates, emitted and forgotten once the watermark has passed their end."""
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_to_table(stream: DataFrame, checkpoint: str | None = None) -> DataFrame:
    """Append all input there is now to a parquet table in the shared folder and read it: nothing passes through the driver.

    A ``checkpoint`` folder makes later calls go on where the last one ended, into the same table.
    """
    spark = stream.sparkSession
    place = checkpoint or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    w = stream.writeStream.format("parquet").option("path", f"{place}/rows").option("checkpointLocation", f"{place}/progress").outputMode("append").trigger(availableNow=True)
    w.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/rows")
