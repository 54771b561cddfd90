"""Fold the events of a key in event-time order.

Keys are dealt over a fixed number of shards; a shard is one group of Spark's state, so the calls to the state store
grow with the shards and not with the rows or keys. The rows of a shard wait in chunks, sorted by time, in a map state
keyed by (first time, arrival) until the watermark has passed them and are then folded in (time, id) order. A chunk is
written once and removed once, one the watermark cuts is written again without what was folded; a timer at the time of
the earliest waiting row releases all that are due, so a batch that only adds rows reads none of the waiting ones. A
fold is a small function ``(rows sorted by key and time, starts, states) -> (output rows, new states)``: the rows of
key ``i`` are those from ``starts[i]`` to ``starts[i + 1]``, its state is one tuple or None. A state that ``expires``
gives a time for is removed by a timer once the watermark has passed that time.

Rows behind the watermark are left out by Spark, which counts them: ``late_rows`` adds them up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

Fold = Callable[[pd.DataFrame, list[int], list[tuple | None]], tuple[pd.DataFrame, list[tuple]]]
Expires = Callable[[tuple], int]

#: groups of keys; a shard's states are read and written together, so long streams of many keys want more.
#: It is part of the state: a query that goes on from its checkpoint must keep it
SHARDS = 512
#: rows of a chunk
CHUNK_ROWS = 4096


def _packed(batch: pa.RecordBatch) -> bytes:
    return batch.serialize().to_pybytes()


def _unpacked(data: bytes, schema: pa.Schema) -> pa.RecordBatch:
    return pa.ipc.read_record_batch(pa.py_buffer(bytes(data)), schema)


class OrderedFold(StatefulProcessor):
    """``buffer`` are the columns that wait (the first is the time in microseconds, the second the id, a long), then
    the ``keys``; ``states`` the keys and the columns of a state."""

    def __init__(self, fold: Fold, buffer: pa.Schema, states: pa.Schema, keys: list[str], expires: Expires | None):
        self._fold, self._buffer, self._states, self._keys, self._expires = fold, buffer, states, keys, expires

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waiting = handle.getMapState("waiting", "us long, arrival long", "rows binary")
        self._arrivals = handle.getValueState("arrivals", "chunks long")
        self._state = handle.getValueState("state", "states binary")

    def _keep(self, batch: pa.RecordBatch, arrival: int) -> int:
        """Store rows sorted by time; their first time."""
        first = batch.column(0)[0].as_py()
        self._waiting.updateValue((first, arrival), (_packed(batch),))
        return first

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        arrival = self._arrivals.get()[0] if self._arrivals.exists() else 0
        for frame in rows:
            frame = frame.sort_values(self._buffer.names[0], kind="stable")
            arrays = [pa.array(frame[f.name], type=f.type, from_pandas=True) for f in self._buffer]
            batch = pa.RecordBatch.from_arrays(arrays, schema=self._buffer)
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                low = self._keep(batch.slice(at, CHUNK_ROWS), arrival)
                arrival += 1
                first = low if first is None else min(first, low)
        if first is not None:
            self._arrivals.update((arrival,))
            self._handle.registerTimer(first // 1000 + 1)
        return iter(())

    def _due(self, until: int) -> tuple[list[pa.RecordBatch], int | None]:
        """Take the rows up to ``until`` out of the chunks, in order of arrival; the first time of those that wait on."""
        ready, later = [], None
        for place in sorted((tuple(p) for p in self._waiting.keys()), key=lambda p: p[1]):
            low = place[0]
            if low <= until:
                batch = _unpacked(self._waiting.getValue(place)[0], self._buffer)
                self._waiting.removeKey(place)
                n = int(np.searchsorted(batch.column(0).to_numpy(), until, side="right"))
                ready.append(batch.slice(0, n))
                if n == batch.num_rows:
                    continue
                low = self._keep(batch.slice(n), place[1])
            later = low if later is None else min(later, low)
        return ready, later

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        ready, later = self._due(watermark * 1000)
        if later is not None:
            self._handle.registerTimer(later // 1000 + 1)
        else:
            self._arrivals.clear()
        if not ready and self._expires is None:
            return
        states = {}
        if self._state.exists():
            columns = [c.to_pylist() for c in _unpacked(self._state.get()[0], self._states).columns]
            n = len(self._keys)
            states = dict(zip(zip(*columns[:n]), zip(*columns[n:])))
        if ready:
            rows = pa.Table.from_batches(ready).to_pandas(integer_object_nulls=True)
            rows["_key"] = rows.groupby(self._keys, dropna=False, sort=False).ngroup()
            rows = rows.sort_values(["_key", *self._buffer.names[:2]], kind="stable", ignore_index=True)
            starts = np.flatnonzero(np.diff(rows["_key"].to_numpy(), prepend=-1)).tolist()
            owners = list(zip(*[[None if pd.isna(v) else v for v in rows[k].iloc[starts]] for k in self._keys]))
            out, after = self._fold(rows.drop(columns="_key"), [*starts, len(rows)], [states.get(o) for o in owners])
            states.update(zip(owners, after))
            yield out
        if self._expires is not None:
            ends = {owner: self._expires(state) for owner, state in states.items()}
            states = {owner: state for owner, state in states.items() if ends[owner] > watermark}
            if states:
                self._handle.registerTimer(min(ends[owner] for owner in states))
        if states:
            columns = [*zip(*states.keys()), *zip(*states.values())]
            arrays = [pa.array(c, type=f.type) for c, f in zip(columns, self._states)]
            self._state.update((_packed(pa.RecordBatch.from_arrays(arrays, schema=self._states)),))
        else:
            self._state.clear()

    def close(self) -> None:
        pass


def fold_stream(
    stream: DataFrame, keys: list[str], fold: Fold, columns: list[str], state_schema: str, output: str,
    expires: Expires | None = None, shards: int = SHARDS,
) -> DataFrame:
    """``output`` columns and the ``keys``, by ``fold`` per key. ``stream`` already has its watermark. ``expires`` gives
    for a state the time in milliseconds from which on it is as good as none; without it states stay.

    Keys are of any type, null is a key like any other: they travel as text.
    """
    binary = {k for k in keys if isinstance(stream.schema[k].dataType, T.BinaryType)}
    as_text = {k: F.base64(k) if k in binary else F.col(k).cast("string") for k in keys}
    texts = [T.StructField(f"key_{i}", T.StringType()) for i in range(len(keys))]
    names = [t.name for t in texts]
    buffer = T.StructType([*[stream.schema[c] for c in columns], *texts])
    states = T.StructType([*texts, *T.StructType.fromDDL(state_schema)])
    folded = (
        stream.select("*", *[as_text[k].alias(n) for k, n in zip(keys, names)])
        .withColumn("shard", F.pmod(F.xxhash64(*names), F.lit(shards)).cast("int"))
        .groupBy("shard")
        .transformWithStateInPandas(
            statefulProcessor=OrderedFold(fold, to_arrow_schema(buffer), to_arrow_schema(states), names, expires),
            outputStructType=f"{output}, " + ", ".join(f"{n} string" for n in names),
            outputMode="Append",
            timeMode="EventTime",
        )
    )
    back = [(F.unbase64(n) if k in binary else F.col(n).cast(stream.schema[k].dataType)).alias(k) for k, n in zip(keys, names)]
    return folded.select(*[c for c in folded.columns if c not in names], *back)


def late_rows(query: StreamingQuery) -> int:
    """How many rows came behind the watermark, over the batches that the query's progress still shows."""
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)


def state_rows(query: StreamingQuery) -> int:
    """Rows of state the last batch left."""
    last = query.lastProgress
    return sum(s.numRowsTotal for s in last.stateOperators) if last else 0
