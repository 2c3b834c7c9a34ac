"""Streaming forms: number and annotate turns as files arrive, keep running momentum of every session."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from parley.functions.text import segments
from parley.operators.prepare import load_volleys
from parley.sources.batches import write_batch
from parley.vocab import MOBILISING, PREPARATORY


class Numbering(StatefulProcessor):
    """Numbers a conversation's utterances as its turns arrive, in any order and any number of batches.

    State: the turn and the utterance number that come next, and turns that wait for an earlier one. Turns count from 0;
    one that was passed on already is a repeat and is dropped. A conversation that stays silent for ``silence_ms`` is over:
    what waits is passed on in order, gaps or not. Its two numbers are kept for ``keep_ms`` more, for late turns. Time is
    that of arrival: a batch's timers run when a later batch has come.
    """

    def __init__(self, silence_ms: int, keep_ms: int):
        self.silence_ms, self.keep_ms = silence_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "turn long, utt long, over boolean")
        self.waiting = handle.getMapState("waiting", "turn long", "speaker string, parts array<string>")

    def _pass_on(self, key, turns: list[tuple[int, str, list[str]]], turn: int, utt: int, over: bool) -> pd.DataFrame:
        rows = []
        for turn, speaker, parts in turns:  # noqa: B020 the last turn passed on
            rows += [(key[0], speaker, turn, utt + i, p) for i, p in enumerate(parts)]
            utt += len(parts)
        self.next.update((turn + 1 if turns else turn, utt, over))
        return pd.DataFrame(rows, columns=["conv_id", "speaker", "conv_vol_idx", "conv_utt_idx", "utt_text"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        turn, utt, _ = self.next.get() if self.next.exists() else (0, 0, False)
        fresh, came = {}, 0
        for f in rows:
            came = max(came, int(f["at_ms"].max()))
            for t, speaker, parts in zip(f["conv_vol_idx"], f["speaker"], f["parts"]):
                if t >= turn:
                    fresh.setdefault(int(t), (speaker, list(parts)))
        ready, at = [], turn
        while at in fresh or self.waiting.containsKey((at,)):
            if at in fresh:
                ready.append((at, *fresh.pop(at)))
            else:
                speaker, parts = self.waiting.getValue((at,))
                ready.append((at, speaker, list(parts)))
            if self.waiting.containsKey((at,)):
                self.waiting.removeKey((at,))
            at += 1
        for t, value in fresh.items():
            self.waiting.updateValue((t,), value)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(came + self.silence_ms)
        yield self._pass_on(key, ready, turn, utt, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        turn, utt, over = self.next.get()
        if over:
            self.next.clear()
            return
        self.handle.registerTimer(expiredTimerInfo.getExpiryTimeInMs() + self.keep_ms)
        left = sorted((k[0], v[0], list(v[1])) for k, v in self.waiting.iterator())
        self.waiting.clear()
        yield self._pass_on(key, left, turn, utt, True)

    def close(self) -> None:
        pass


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def numbered_utterances(turns: DataFrame, silence_ms: int = 3_600_000, keep_ms: int = 30 * 86_400_000) -> DataFrame:
    """``split_utterances`` of a stream of turns (conv_id, turn, role, text), however they are dealt to batches. Turns
    without a number are left out. Needs the RocksDB state store."""
    volleys = load_volleys(turns).filter("conv_id IS NOT NULL AND conv_vol_idx IS NOT NULL")
    now = F.current_timestamp()
    parts = volleys.select(now.alias("at"), F.unix_millis(now).alias("at_ms"), "conv_id", F.col("conv_vol_idx").cast("long").alias("conv_vol_idx"), "speaker", F.coalesce(segments(F.col("vol_text")), F.array().cast("array<string>")).alias("parts"))
    kind = turns.schema["conv_id"].dataType.simpleString()
    return parts.withWatermark("at", "0 seconds").groupBy("conv_id").transformWithStateInPandas(
        Numbering(silence_ms, keep_ms), outputStructType=f"conv_id {kind}, speaker string, conv_vol_idx long, conv_utt_idx long, utt_text string", outputMode="Append", timeMode="EventTime"
    )


def annotate_stream(
    spark: SparkSession, folder: str, shape, out: str, checkpoint: str, code: Callable[[DataFrame], DataFrame], files_at_once: int = 1000, silence_ms: int = 3_600_000
) -> StreamingQuery:
    """Segment, number and code turns as Parquet files arrive in a folder; ``read_batches`` reads the table at ``out``.

    A conversation may arrive in many files, in any order (``numbered_utterances``). Each micro-batch is a batch of the
    table, so one that runs again replaces itself.
    """
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKS_DB)  # a query keeps the setting that it was started with
    try:
        stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", files_at_once).parquet(folder)

        def batch(utterances: DataFrame, n: int) -> None:
            write_batch(code(utterances), out, f"stream-{n:09d}")

        write = numbered_utterances(stream, silence_ms).writeStream.foreachBatch(batch).outputMode("append")
        return write.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


def windowed_codes(stream: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of codes in event-time windows; rows later than the watermark are left out."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "code").agg(F.count("*").alias("n"))


class Momentum(StatefulProcessor):
    """Momentum of a session across batches: one number and the last place as state."""

    def __init__(self, alpha: float = 0.1):
        self.alpha = alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("momentum", "m double, started boolean")

    def step(self, before: float, code: str | None) -> float:
        if code is None:
            return before
        stem, sign = code[:-1], code[-1:]
        size = 2 * self.alpha if stem in MOBILISING else self.alpha if stem in PREPARATORY else 0.0
        if sign == "+" and size:
            return before + size
        if sign == "-" and size:
            return before - size
        return before * (1 - self.alpha)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("conv_utt_idx")
        m, started = self.state.get() if self.state.exists() else (0.0, False)
        out = []
        for i, code in zip(frame["conv_utt_idx"], frame["code"]):
            m = self.step(m, code) if started else 0.0
            started = True
            out.append((key[0], i, m))
        self.state.update((m, started))
        yield pd.DataFrame(out, columns=["conv_id", "conv_utt_idx", "momentum"])

    def close(self) -> None:
        pass


def stream_momentum(stream: DataFrame, alpha: float = 0.1) -> DataFrame:
    """conv_id, conv_utt_idx, momentum of a stream of (conv_id, conv_utt_idx, code); needs the RocksDB state store."""
    return stream.groupBy("conv_id").transformWithStateInPandas(
        Momentum(alpha), outputStructType="conv_id long, conv_utt_idx long, momentum double", outputMode="Append", timeMode="None"
    )
