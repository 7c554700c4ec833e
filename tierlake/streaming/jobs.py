"""Structured Streaming counterparts of the ticked, TTL and latch behaviour; drained with ``availableNow``."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tierlake.operators.orphans import key_counts
from tierlake.sources.formats import Refused, complete_folders, create_new, current_version, path_of, read_version, version_note, write_version


def event_stream(spark: SparkSession, path: str, schema: str, *, files_per_trigger: int = 8) -> DataFrame:
    """New event files as they arrive, a bounded number a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def once_each(stream: DataFrame, key: str, at: str, late: str = "7 days") -> DataFrame:
    """Deliveries that were repeated within ``late`` count once."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def tumbling_counts(stream: DataFrame, at: str, width: str, *keys: str, late: str = "1 hour") -> DataFrame:
    """Counts per key and window of event time."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), *keys).count().select("window.start", *keys, "count")


def sessions(stream: DataFrame, key: str, at: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Stretches of heartbeats without a pause of ``gap`` or more."""
    grouped = stream.withWatermark(at, late).groupBy(key, F.session_window(at, gap)).count()
    return grouped.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "count")


def latch(stream: DataFrame, key: str, value: str, low: float, stop: float) -> DataFrame:
    """(key, latched, seen): on when ``value`` falls below ``low``, off when it reaches ``stop``, else held; one boolean of state a key.

    Rows of a trigger are taken in the order of ``ts`` (ties in that of arrival): only the last one that switches counts,
    so frames are reduced as they come and a hot key is never gathered.
    """
    kind = stream.schema[key].dataType.simpleString()

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        on, seen = state.get if state.exists else (False, 0)
        newest = None
        for f in frames:
            seen += len(f)
            switching = f[(f[value] < low) | (f[value] >= stop)]
            if len(switching):
                last = switching[switching["ts"] == switching["ts"].max()].iloc[-1]
                if newest is None or last["ts"] >= newest:
                    newest, on = last["ts"], last[value] < low
        state.update((bool(on), int(seen)))
        yield pd.DataFrame({key: [k[0]], "latched": [bool(on)], "seen": [int(seen)]})

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, latched boolean, seen long", "latched boolean, seen long", "update", GroupStateTimeout.NoTimeout)


def _micros(t: pd.Timestamp) -> int:
    return t.value // 1000


def fresh_values(stream: DataFrame, key: str, value: str, at: str, ttl_seconds: int, late: str = "1 hour") -> DataFrame:
    """(key, value, at, expired): a cache whose entries expire ``ttl_seconds`` after the time of their newest row.

    A key's newest row is given when it comes; when the watermark passes its time and ``ttl_seconds``, the entry is given once
    more with ``expired`` true and its state is dropped. Rows of a trigger are reduced frame by frame.
    """
    kinds = ", ".join(f"`{c}` {stream.schema[c].dataType.simpleString()}" for c in (key, value))
    held = f"value {stream.schema[value].dataType.simpleString()}, at long"

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            v, t = state.get
            state.remove()
            yield pd.DataFrame({key: [k[0]], value: [v], at: [pd.Timestamp(t, unit="us")], "expired": [True]})
            return
        v, t = state.get if state.exists else (None, None)
        for f in frames:
            row = f[f[at] == f[at].max()].iloc[-1]
            if t is None or _micros(row[at]) >= t:
                v, t = row[value], _micros(row[at])
        state.update((v, t))
        until = t // 1000 + ttl_seconds * 1000
        state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]], value: [v], at: [pd.Timestamp(t, unit="us")], "expired": [False]})

    return stream.withWatermark(at, late).groupBy(key).applyInPandasWithState(step, f"{kinds}, `{at}` timestamp, expired boolean", held, "append", GroupStateTimeout.EventTimeTimeout)


def leases(stream: DataFrame, key: str, owner: str, action: str, at: str, seconds: int, late: str = "1 hour") -> DataFrame:
    """(key, owner, at, outcome, until): leases of a key by one owner at a time.

    ``action`` is ``take`` or ``release``. A take is ``granted`` if the key is free or its lease has run out, ``renewed`` if
    the owner has it already, else ``refused``; a release by its owner is ``released``, by another ``ignored``. A lease that
    nobody renewed is given as ``expired`` when the watermark passes its end, and its state is dropped. Rows of a key and
    trigger are taken in the order of ``at``, ties by owner and action; they must fit a task, which files_per_trigger bounds.
    """
    kinds = ", ".join(f"`{c}` {stream.schema[c].dataType.simpleString()}" for c in (key, owner))

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        holder, until = state.get if state.exists else (None, 0)
        if state.hasTimedOut:
            out.append((k[0], holder, pd.Timestamp(until, unit="us"), "expired", pd.Timestamp(until, unit="us")))
            state.remove()
        else:
            rows = pd.concat(list(frames)).sort_values([at, owner, action], kind="stable")
            for who, what, t in zip(rows[owner], rows[action], rows[at], strict=True):
                now, outcome = _micros(t), "ignored"
                if holder is not None and until <= now:
                    out.append((k[0], holder, pd.Timestamp(until, unit="us"), "expired", pd.Timestamp(until, unit="us")))
                    holder = None
                if what == "take":
                    outcome = "granted" if holder is None else "renewed" if holder == who else "refused"
                    if outcome != "refused":
                        holder, until = who, now + seconds * 1_000_000
                elif what == "release" and holder is not None and holder == who:
                    holder, until, outcome = None, now, "released"
                out.append((k[0], who, t, outcome, pd.Timestamp(until, unit="us")))
            if holder is None:
                if state.exists:
                    state.remove()
            else:
                state.update((holder, until))
                state.setTimeoutTimestamp(max(until // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, owner, at, "outcome", "until"])

    held = f"holder {stream.schema[owner].dataType.simpleString()}, until long"
    return stream.withWatermark(at, late).groupBy(key).applyInPandasWithState(step, f"{kinds}, `{at}` timestamp, outcome string, until timestamp", held, "append", GroupStateTimeout.EventTimeTimeout)


def single_tick(spark: SparkSession, root: str, job: Callable[[], None], *, stale_seconds: int = 7200) -> bool:
    """Run ``job`` unless another tick holds ``root``; True if the tick before was interrupted (its mark was left for ``stale_seconds``).

    The mark is a file that only one tick can create. A mark that is younger belongs to a tick at work, so this one is refused.
    """
    fs, mark = path_of(spark, f"{root}/RUNNING")
    interrupted = False
    if fs.exists(mark):
        age = time.time() - fs.getFileStatus(mark).getModificationTime() / 1000
        if age < stale_seconds:
            raise Refused(f"{root} is held by a tick of {age:.0f} s ago")
        interrupted = fs.delete(mark, False)
    if not create_new(spark, f"{root}/RUNNING"):
        raise Refused(f"{root} was taken by another tick")
    try:
        job()
    finally:
        fs.delete(mark, False)
    return interrupted


def drain(stream: DataFrame, out: str, checkpoint: str, *, mode: str = "append") -> None:
    """Process what is there and stop; the checkpoint makes the next tick go on from it."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def maintain_counts(deltas: DataFrame, root: str, checkpoint: str) -> None:
    """Keep signed reference and existence counts from a stream of changes; :func:`kept_counts` reads them.

    Counts add up, so a batch writes only its own counts, in a folder named by its id: a batch that is replayed writes the
    same folder again and counts once. When these folders are as large as the base, all are added up to a new version
    of it, which notes the last batch it holds; earlier batches are passed over from then on. So a row is rewritten
    a logarithmic number of times, not with every batch.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number <= _folded(spark, root):
            return
        key_counts(batch).write.mode("overwrite").parquet(f"{root}/batches/{number:012d}")
        base = dict(complete_folders(spark, f"{root}/base"))
        pending = sum(size for _, size in _pending(spark, root))
        current = current_version(spark, f"{root}/base")
        if pending >= (base.get(f"v{current:06d}", 0) if current else FIRST_FOLD):
            write_version(kept_counts(spark, root), f"{root}/base", str(number))

    deltas.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


#: Bytes of batches before the first base is written.
FIRST_FOLD = 64 << 20


def _folded(spark: SparkSession, root: str) -> int:
    """The last batch that the base holds, -1 if none."""
    return int(version_note(spark, f"{root}/base") or -1)


def _pending(spark: SparkSession, root: str) -> list[tuple[str, int]]:
    folded = _folded(spark, root)
    return [(n, size) for n, size in complete_folders(spark, f"{root}/batches") if int(n) > folded]


def kept_counts(spark: SparkSession, root: str) -> DataFrame:
    """The state of :func:`maintain_counts`: the base and the batches since."""
    parts = [spark.read.parquet(f"{root}/batches/{n}") for n, _ in _pending(spark, root)]
    if current_version(spark, f"{root}/base"):
        parts.append(read_version(spark, f"{root}/base"))
    if not parts:
        raise Refused(f"{root} holds no counts")
    state = parts[0]
    for p in parts[1:]:
        state = state.unionByName(p)
    return key_counts(state)
