"""Live conversation tracking: the stream form of `operators.conversations.conversation_build`."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from floodlens.operators.conversations import CONNECTION, connection_packets
from floodlens.session import ship_package

# The fields of a second, and how those of packets in the same one are combined.
_FIELDS = ["ts", "n", "starter", "syn", "fin", "rst"]
_RULES = {"n": "sum", "starter": "min", "syn": "max", "fin": "max", "rst": "max"}
BLOCK_S = 3600      # seconds of a connection that are one entry of the state
HELD_ROWS = 200_000  # rows of one connection that a task holds
_OPEN = "start bigint, last bigint, from_a int, packets bigint, fin int, rst int, ended int"
_OUTPUT = (
    "ts bigint, src string, sport int, dst string, dport int, second bigint, packets bigint, "
    "end_state string, last_ts bigint"
)


def combine_seconds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Packets per (connection, second) of each batch, ahead of the shuffle."""
    for rows in batches:
        yield rows.groupby([*CONNECTION, "ts"], as_index=False, dropna=False, sort=False).agg(
            n=("starter", "size"), starter=("starter", "min"), syn=("syn", "max"),
            fin=("fin", "max"), rst=("rst", "max"))


def merge_seconds(parts: list[pd.DataFrame]) -> pd.DataFrame:
    """One row per second, in order."""
    rows = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
    return rows.groupby("ts", as_index=False).agg(_RULES)[_FIELDS].astype(np.int64)


def _packed(rows: pd.DataFrame) -> bytes:
    return rows.to_numpy(np.int64).astype("<i8").tobytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pd.DataFrame(np.frombuffer(data, "<i8").astype(np.int64).reshape(-1, len(_FIELDS)),
                        columns=_FIELDS)


class ConversationTracker(StatefulProcessor):
    """Keeps the seconds of a connection that the watermark has not passed, and what is known of its
    open conversation.

    A second is complete once the watermark has passed it; it is then given out and added to the
    open conversation. That one is over when the watermark has passed its last packet by more
    than the gap, or when a later second begins another. The seconds of a block of time are one
    entry of the state, so it is read and written once for many of them.
    """

    def __init__(self, gap_s: int) -> None:
        self.gap_s = gap_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("seconds", "block bigint", "seconds binary")
        self.open = handle.getValueState("open", _OPEN)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        held, size = [], 0
        for batch in rows:
            held.append(batch[_FIELDS])
            size += len(batch)
            if size > HELD_ROWS:
                first = self._keep(merge_seconds(held), first)
                held, size = [], 0
        if size:
            first = self._keep(merge_seconds(held), first)
        if first is not None:
            self.handle.registerTimer(first * 1000 + 1)
        yield pd.DataFrame()

    def _keep(self, new: pd.DataFrame, first: int | None) -> int:
        """Add seconds to those that wait; the first one so far."""
        blocks = new["ts"].to_numpy() // BLOCK_S
        cuts = np.flatnonzero(np.diff(blocks)) + 1
        for low, high in zip([0, *cuts], [*cuts, len(new)]):
            block, rows = (int(blocks[low]),), new.iloc[low:high]
            old = self.waiting.getValue(block)
            if old is not None:
                rows = merge_seconds([_unpacked(old[0]), rows])
            self.waiting.updateValue(block, (_packed(rows),))
        least = int(new["ts"].iloc[0])
        return least if first is None else min(first, least)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        now = tuple(self.open.get()) if self.open.exists() else None
        later = None  # the first second that goes on waiting
        held, size = [], 0
        for block in sorted(int(k[0]) for k in self.waiting.keys()):
            if block * BLOCK_S * 1000 >= watermark:
                later = int(_unpacked(self.waiting.getValue((block,))[0])["ts"].iloc[0])
                break
            rows = _unpacked(self.waiting.getValue((block,))[0])
            passed = rows["ts"].to_numpy() * 1000 < watermark
            if passed.any():
                held.append(rows[passed])
                size += len(held[-1])
            if passed.all():
                self.waiting.removeKey((block,))
            else:
                if passed.any():
                    self.waiting.updateValue((block,), (_packed(rows[~passed]),))
                later = int(rows["ts"].to_numpy()[~passed][0])
                break
            if size > HELD_ROWS:
                found, now = self._conversations(key, pd.concat(held, ignore_index=True), now)
                yield found
                held, size = [], 0
        if held:
            found, now = self._conversations(key, pd.concat(held, ignore_index=True), now)
            yield found
        if now is not None and (now[1] + self.gap_s) * 1000 < watermark:
            yield self._named(key, [now], [self._header(now)])
            now = None
        if now is None:
            self.open.clear()
        else:
            self.open.update(now)
            self.handle.registerTimer((now[1] + self.gap_s) * 1000 + 1)
        if later is not None:
            self.handle.registerTimer(later * 1000 + 1)

    def close(self) -> None:
        pass

    def _conversations(self, key, rows: pd.DataFrame, now: tuple | None
                       ) -> tuple[pd.DataFrame, tuple]:
        """The rows of passed seconds and of the conversations that end before the last one, and
        the conversation that is then open. `now` is the open one before them."""
        ts, n, starter, syn, fin, rst = (rows[name].to_numpy() for name in _FIELDS)
        ended = (fin | rst) > 0
        before = np.append(ts[0] if now is None else now[1], ts[:-1])
        silent = ts - before > self.gap_s
        silent[0] |= now is None
        # The last mark up to each second: ended (1) or open (0).
        mark = np.where(ended, 1, np.where((syn > 0) | silent, 0, -1))
        at = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(ts)), -1))
        last = np.where(at >= 0, mark[at], 0 if now is None else now[6])
        was_ended = np.append(0 if now is None else now[6], last[:-1])
        begins = silent | ((syn > 0) & (was_ended > 0))
        found = [] if now is None else [now]
        cuts = np.flatnonzero(begins)
        edges = np.unique(np.concatenate([[0], cuts]))
        packets, fins, rsts = (np.add.reduceat(n, edges), np.maximum.reduceat(fin, edges),
                               np.maximum.reduceat(rst, edges))
        stops = np.append(edges[1:], len(ts)) - 1
        for i, (low, stop) in enumerate(zip(edges.tolist(), stops.tolist())):
            if not begins[low]:  # the open one goes on
                old = found.pop()
                found.append((old[0], int(ts[stop]), old[2], old[3] + int(packets[i]),
                              max(old[4], int(fins[i])), max(old[5], int(rsts[i])),
                              int(last[stop])))
            else:
                found.append((int(ts[low]), int(ts[stop]), int(starter[low] % 2 == 0),
                              int(packets[i]), int(fins[i]), int(rsts[i]), int(last[stop])))
        number = np.cumsum(begins) - 1 + (now is not None)
        seconds = self._named(key, found, None, number).assign(second=ts, packets=n)
        over = found[:-1]
        headers = self._named(key, over, [self._header(c) for c in over])
        both = [seconds, headers] if over else [seconds]
        return pd.concat(both, ignore_index=True), found[-1]

    def _named(self, key, found: list[tuple], headers: list[tuple] | None,
               number: np.ndarray | None = None) -> pd.DataFrame:
        """A row per conversation with its times and endpoints, or per item of `number`, which says
        whose it is."""
        if number is None:
            number = np.arange(len(found))
        src = np.array([c[2] for c in found], bool)[number]
        one, two = (key[0], key[1]), (key[2], key[3])
        state, end, packets = zip(*headers) if headers else (None, None, None)
        return pd.DataFrame({
            "ts": np.array([c[0] for c in found], np.int64)[number],
            "src": np.where(src, one[0], two[0]), "sport": np.where(src, one[1], two[1]),
            "dst": np.where(src, two[0], one[0]), "dport": np.where(src, two[1], one[1]),
            "second": pd.array([None] * len(number), "Int64"), "packets": packets,
            "end_state": state, "last_ts": pd.array(end or [None] * len(number), "Int64")})

    @staticmethod
    def _header(now: tuple) -> tuple:
        """End state, last second and packets of a conversation."""
        return "reset" if now[5] else "close" if now[4] else "timeout", now[1], now[3]


def stream_conversations(packet_stream: DataFrame, watermark: str = "10 minutes",
                         gap_s: int = 60) -> DataFrame:
    """Conversations of a packet stream, as far as the watermark has come.

    Rows with a `second` equal those of `conversation_times` over the same packets, for seconds the
    watermark has passed. Rows without one equal those of `conversation_build`, for conversations
    that are over. Packets later than the watermark are dropped. The session must keep state in
    RocksDB, as `build_session` sets it. Seconds are kept in blocks; a checkpoint that holds them
    one by one, as earlier versions wrote it, cannot be continued.
    """
    ship_package(packet_stream.sparkSession)
    # The driver-side planning worker does not see shipped packages: send the code itself.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    schema = (
        "a_ip string, a_port int, b_ip string, b_port int, ts bigint, n bigint, "
        "starter int, syn int, fin int, rst int"
    )
    seconds = connection_packets(packet_stream).mapInPandas(combine_seconds, schema)
    return (
        seconds.withColumn("event_time", F.timestamp_seconds("ts"))
        .withWatermark("event_time", watermark)
        .groupBy(*CONNECTION)
        .transformWithStateInPandas(
            statefulProcessor=ConversationTracker(gap_s),
            outputStructType=_OUTPUT, outputMode="Append", timeMode="EventTime")
    )
