"""Mail intake: sender rules, links, attachment gate, rate limit; as batch columns and as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from planquant.functions.text import sender_address

PER_HOUR, PER_DAY, MAX_MB = 20, 100, 25

# Links to shared files.
LINKS = (
    r"(?i)https?://(?:www\.)?dropbox\.com/\S+",
    r"(?i)https?://(?:www\.)?dl\.dropboxusercontent\.com/\S+",
    r"(?i)https?://drive\.google\.com/\S+",
    r"(?i)https?://docs\.google\.com/\S+",
    r"(?i)https?://wetransfer\.com/downloads/\S+",
    r"(?i)https?://we\.tl/\S+",
    r"(?i)https?://(?:www\.)?onedrive\.live\.com/\S+",
    r"(?i)https?://1drv\.ms/\S+",
)


def cloud_links(text: Column, patterns: tuple[str, ...] = LINKS) -> Column:
    """Distinct links to shared files, by kind, in order."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(0)) for p in patterns]))


def sender_allowed(header: Column, senders: list[str], domains: list[str]) -> Column:
    """Whether a sender is on the list: whole address, name@*, *@domain, or a domain."""
    a = sender_address(header)
    name, domain = F.substring_index(a, "@", 1), F.when(F.contains(a, F.lit("@")), F.substring_index(a, "@", -1)).otherwise("")
    low = [s.lower() for s in senders]
    whole = a.isin(*[s for s in low if "*" not in s], "") & (a != "")
    return whole | name.isin(*[s[:-2] for s in low if s.endswith("@*")], "\0") | domain.isin(*[s[2:] for s in low if s.startswith("*@")], *[d.lower() for d in domains], "\0")


def attachment_fault(content: Column, max_mb: int = MAX_MB) -> Column:
    """Why a file is refused: missing, too large or no PDF; null if it is fine."""
    return F.when(content.isNull(), "missing").when(F.octet_length(content) > max_mb * 1024 * 1024, "too large").when(F.substring(content, 1, 5) != F.lit("%PDF-").cast("binary"), "not a PDF")


def decision(allowed: Column, within_rate: Column, n_attachments: Column, n_links: Column, n_valid: Column) -> Column:
    """What happens to a message, in order of the checks."""
    return F.when(~allowed, "rejected_sender").when(~within_rate, "rate_limited").when((n_attachments == 0) & (n_links == 0), "no_attachment").when((n_attachments > 0) & (n_valid == 0), "invalid_attachment").otherwise("process")


def rate_limited(events: DataFrame, key: str, ts: str, order: list[str], per_hour: int = PER_HOUR, per_day: int = PER_DAY) -> DataFrame:
    """Events with allowed: fewer than `per_hour` allowed ones of the key within the hour before, and `per_day` within the
    day. Refused ones don't count, so this is a fold over time, not a window count. State is the last `per_day` allowed
    times; a key's events stream through it in order, in batches of rows that are never gathered."""
    columns = events.columns
    fields = ", ".join(f"`{n}` {t}" for n, t in events.dtypes)
    part = events.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp"))).repartition(key).sortWithinPartitions(key, "_us", *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from collections import deque

        at, taken = object(), deque()
        for pdf in batches:
            out = []
            for k, t in zip(pdf[key], pdf["_us"], strict=True):
                if k != at:
                    at, taken = k, deque()
                while taken and taken[0] <= t - 86_400_000_000:
                    taken.popleft()
                hour = sum(1 for x in reversed(taken) if x > t - 3_600_000_000) if len(taken) else 0
                ok = hour < per_hour and len(taken) < per_day
                if ok:
                    taken.append(t)
                out.append(ok)
            yield pdf[columns].assign(allowed=out)

    return part.mapInPandas(run, f"{fields}, allowed boolean")


HOUR, DAY = 3_600_000_000, 86_400_000_000


class _RateLimit(StatefulProcessor):
    """A sender's times (microseconds): those waiting for the watermark, and those allowed within a day."""

    def __init__(self, key: str, id_type: str, per_hour: int, per_day: int):
        self.key, self.id_type, self.per_hour, self.per_day = key, id_type, per_hour, per_day

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"us long, id {self.id_type}")
        self.taken = handle.getListState("taken", "us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        for pdf in rows:
            new = [(int(t.value // 1000), i) for t, i in zip(pd.to_datetime(pdf["ts"]), pdf["id"], strict=True)]
            self.waiting.appendList(new)
            for ms in {-(-us // 1000) for us, _ in new}:
                self.handle.registerTimer(ms)
        yield pd.DataFrame({self.key: pd.Series(dtype="object"), "ts": pd.Series(dtype="datetime64[us]"), "id": pd.Series(dtype="object"), "allowed": pd.Series(dtype="bool")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        at = expiredTimerInfo.getExpiryTimeInMs() * 1000
        held = sorted(self.waiting.get()) if self.waiting.exists() else []
        due, rest = [x for x in held if x[0] <= at], [x for x in held if x[0] > at]
        taken = [x[0] for x in self.taken.get()] if self.taken.exists() else []
        allowed = []
        for us, _ in due:
            taken = [x for x in taken if x > us - DAY]
            ok = sum(x > us - HOUR for x in taken) < self.per_hour and len(taken) < self.per_day
            taken += [us] if ok else []
            allowed.append(ok)
        for state, values in ((self.waiting, rest), (self.taken, [(x,) for x in taken])):
            state.put(values) if values else state.clear()
        if not due and not rest:
            self.taken.clear()  # the timer a day after the last mail
        elif due and not rest:
            self.handle.registerTimer(due[-1][0] // 1000 + DAY // 1000 + 1)
        yield pd.DataFrame({self.key: [key[0]] * len(due), "ts": pd.to_datetime([x[0] for x in due], unit="us"), "id": [x[1] for x in due], "allowed": pd.Series(allowed, dtype="bool")})

    def close(self) -> None:
        pass


def rate_limited_stream(events: DataFrame, key: str, ts: str, per_hour: int = PER_HOUR, per_day: int = PER_DAY, late: str = "10 minutes", id_col: str | None = None) -> DataFrame:
    """The same over a stream: (key, ts, id, allowed). Mails are held until the watermark (`late` behind the newest) has passed them and then decided in
    order of time, so the result is the batch's however they arrive; what comes later than that is dropped by the watermark.
    Equal times go by id. State is what waits and the allowed times of a day, and goes a day after a sender's last mail, all by event time.
    The session must use the RocksDB state store (`use_rocksdb`)."""
    given = events.select(F.col(key), F.col(ts).alias("ts"), (F.col(id_col) if id_col else F.lit(0)).alias("id")).withWatermark("ts", late)
    kinds = dict(given.dtypes)
    out = f"{key} {kinds[key]}, ts timestamp, id {kinds['id']}, allowed boolean"
    return given.groupBy(key).transformWithStateInPandas(_RateLimit(key, kinds["id"], per_hour, per_day), out, "append", "eventtime")


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that state with timers needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def message_stream(spark: SparkSession, path: str) -> DataFrame:
    """Messages as they arrive, one JSON object a line."""
    return spark.readStream.schema("message_id string, sender string, ts timestamp, body string, attachments array<struct<name:string,content:binary>>").json(path)


def poll(messages: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Handles new messages batch by batch; what was handled is remembered in the checkpoint."""
    w = messages.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return w.trigger(availableNow=True).start() if once else w.trigger(processingTime="60 seconds").start()


def tumbling_counts(events: DataFrame, ts: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per window and key, with a watermark: an extension for monitoring."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n"))
