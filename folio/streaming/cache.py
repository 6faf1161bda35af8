"""A cache per key as a stateful stream: idle entries expire, and of too many the least recently used goes."""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CAPACITY = 3
TTL = 3600
#: Groups of keys: each has one state, so a micro-batch costs so many calls at most, whatever the number of keys.
GROUPS = 1024
#: Types of keys whose text tells them apart.
_PLAIN = ("bigint", "int", "smallint", "tinyint", "boolean", "date", "string")


def touch(held: OrderedDict[str, int], item: str, at: int, capacity: int, ttl: int) -> bool:
    """Use an item at a time: is it there, and not idle for longer than ttl? held: last uses, the oldest first."""
    while held and at - next(iter(held.values())) > ttl:
        held.popitem(last=False)
    hit = held.pop(item, None) is not None
    held[item] = at
    while len(held) > capacity:
        held.popitem(last=False)
    return hit


def accesses(events: DataFrame, capacity: int = CAPACITY, ttl: int = TTL, delay: str = "1 hour", key: str = "user_id", item: str = "event_type", ts: str = "ts", order: str = "event_id", groups: int = GROUPS) -> DataFrame:
    """(order, key, item, hit) of each event of a stream, against its key's cache.

    A key's cache is at most `capacity` items with the times of their last use; keys are dealt to `groups` by
    their hash, and a group's caches are one state. Events of a key are taken by (ts, order) within a micro-batch,
    and micro-batches as they come: a source brings a key's events in order, but for those of one batch. When
    the watermark has passed ttl after a key's last use, its cache goes with the group's next events; the group's
    state goes ttl after its last use. Null items are an item; rows of null key or time are left out."""
    kinds = dict(events.dtypes)
    name = F.col(key).cast("string") if kinds[key] in _PLAIN else F.to_json(F.struct(key))
    rows = events.where(F.col(ts).isNotNull() & F.col(key).isNotNull()).select(F.pmod(F.xxhash64(name), F.lit(groups)).alias("_group"), name.alias("_name"), F.col(order).alias("_order"), F.col(key).alias("_key"), F.coalesce(F.col(item).cast("string"), F.lit("")).alias("_item"), F.col(ts).cast("timestamp").alias("_ts"), F.col(item).isNull().alias("_none"))
    micros, millis = int(ttl * 1_000_000), int(ttl * 1000)

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        caches = {k: OrderedDict(held) for k, held in json.loads(state.get[0])} if state.exists else {}
        own = pd.concat(list(batches)).sort_values(["_ts", "_order"], kind="stable")
        times = own["_ts"].to_numpy("datetime64[us]").astype("int64").tolist()
        hits = [touch(caches.setdefault(k, OrderedDict()), ("0" if none else "1") + name, at, capacity, micros) for k, name, none, at in zip(own["_name"], own["_item"], own["_none"], times, strict=True)]
        watermark = state.getCurrentWatermarkMs()
        ends = {k: max(held.values(), default=0) // 1000 + millis for k, held in caches.items()}
        kept = [(k, list(held.items())) for k, held in caches.items() if ends[k] + 1 >= watermark]
        state.update((json.dumps(kept),))
        state.setTimeoutTimestamp(max(max(ends.values()), watermark) + 1)
        yield pd.DataFrame({order: own["_order"], key: own["_key"], item: own["_item"].where(~own["_none"], None), "hit": hits})

    return rows.withWatermark("_ts", delay).groupBy("_group").applyInPandasWithState(step, f"`{order}` {kinds[order]}, `{key}` {kinds[key]}, `{item}` string, hit boolean", "held string", "append", GroupStateTimeout.EventTimeTimeout)
