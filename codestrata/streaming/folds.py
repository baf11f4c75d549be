"""Folds over a key's events in order of time, as a stream with keyed state and timers.

Events wait in their key's state until the watermark has passed them, so that the fold sees them in
order of time and id however they arrive; those that come later than the watermark allows are left out, as
are repeats. Between events, and when the watermark moves on without any, the fold's own timers run.
The state of a key is what waits and what the fold remembers, and is dropped when both are empty. Some keys share a state of Spark's.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


class Fold:
    """What is done with one key's events. ``memory`` is a dictionary of plain values, empty at first."""

    schema: str                 # of the rows it makes, without the key

    def event(self, memory: dict, row: dict) -> list[tuple]:
        """Rows made by an event."""
        raise NotImplementedError

    def timers(self, memory: dict, until: int) -> list[tuple]:
        """Rows made by timers that are due before ``until``."""
        return []

    def next_timer(self, memory: dict) -> int | None:
        """When the next timer is due."""
        return None


def folded(stream: DataFrame, key: str, key_type: str, fold: Fold, delay: str, packs: int = 1) -> DataFrame:
    """The rows that ``fold`` makes of ``stream`` (``key``, event_id, us, ts and more), with the key.

    ``delay``: how late an event may come. Events with a null key are used for their time only. ``packs``: Spark
    calls Python once for each state in each batch, which takes longer than some dozens of events do, so keys are dealt
    to so many states; each key is still folded by itself.
    """
    names = [key, *[f.split()[0] for f in fold.schema.split(", ")]]

    def run(of: tuple[Any], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {k: (waiting, memory) for k, waiting, memory in json.loads(state.get[0])} if state.exists else {}
        if not state.hasTimedOut:
            for batch in batches:
                for row in map(json.loads, batch["_row"]):
                    k = row.pop(key)
                    if k is not None:
                        held.setdefault(k, ({}, {}))[0][str(row["event_id"])] = row
        passed = state.getCurrentWatermarkMs() * 1000
        out, left, due = [], [], []
        for k, (waiting, memory) in held.items():
            made = []
            for row in sorted(waiting.values(), key=lambda r: (r["us"], r["event_id"])):
                if row["us"] > passed:
                    break
                made += fold.timers(memory, row["us"])
                made += fold.event(memory, row)
                del waiting[str(row["event_id"])]
            made += fold.timers(memory, passed + 1)
            out += [(k, *r) for r in made]
            if waiting or memory:
                left.append((k, waiting, memory))
                due += [r["us"] for r in waiting.values()] + [t for t in [fold.next_timer(memory)] if t is not None]
        if left:
            state.update((json.dumps(left),))
            if due:
                state.setTimeoutTimestamp(max(min(due), passed) // 1000 + 1)
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=names, dtype=object)     # as objects, numbers beside nulls stay whole

    # an event goes as JSON, in which numbers beside nulls stay whole; null keys have a state of their own, which stays empty
    row = F.to_json(F.struct(*[c for c in stream.columns if c != "ts"]), {"ignoreNullFields": "false"})
    pack = F.when(F.col(key).isNotNull(), F.pmod(F.xxhash64(key), F.lit(packs)))
    kept = stream.withWatermark("ts", delay).select(pack.alias("_pack"), "ts", row.alias("_row"))
    return kept.groupBy("_pack").applyInPandasWithState(
        run, f"{key} {key_type}, {fold.schema}", "held string", "append", GroupStateTimeout.EventTimeTimeout)


class Progress(Fold):
    """Frames that a watcher of a scan gets.

    The first event opens a stream. An event whose signature differs from the one before makes a frame; one
    whose status is final closes the stream. A stream silent for ``beat`` gets a heartbeat, and one open for
    ``cap`` a timeout, which closes it too. The next event opens a new one. Times are in microseconds.
    """

    schema = "at long, kind string, status string, event_id long"

    def __init__(self, beat: int, cap: int, final: tuple[str, ...]) -> None:
        self.beat, self.cap, self.final = beat, cap, final

    def event(self, memory, row):
        sign, out = [row["status"], row["stage"]], []
        if memory.get("sign") != sign or "opened" not in memory:
            memory.setdefault("opened", row["us"])
            memory["sign"], memory["beat"] = sign, row["us"]
            out.append((row["us"], "frame", row["status"], row["event_id"]))
        if row["status"] in self.final:
            memory.clear()
        return out

    def timers(self, memory, until):
        out = []
        while memory and (due := self.next_timer(memory)) < until:
            ends = due == memory["opened"] + self.cap
            out.append((due, "timeout" if ends else "heartbeat", None, None))
            memory["beat"] = due
            if ends:
                memory.clear()
        return out

    def next_timer(self, memory):
        return min(memory["beat"] + self.beat, memory["opened"] + self.cap) if memory else None


class Cache(Fold):
    """Lookups of a cache whose entries live for ``ttl`` microseconds after they were fetched; a miss fetches."""

    schema = "event_id long, hit boolean"

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl

    def event(self, memory, row):
        hit = "at" in memory and row["us"] - memory["at"] < self.ttl
        if not hit:
            memory["at"] = row["us"]
        return [(row["event_id"], hit)]

    def timers(self, memory, until):
        if memory and self.next_timer(memory) < until:
            memory.clear()
        return []

    def next_timer(self, memory):
        return memory["at"] + self.ttl if memory else None
