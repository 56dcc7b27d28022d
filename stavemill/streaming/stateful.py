"""Keyed streaming state with the ``transformWithState`` interface on RocksDB: graders, holds, jobs, boards.

A batch reads and writes only what its own rows need: graders keep where a session stands, not its messages.
Processors with many small keys take rows, as a pandas frame for each key costs more than its work.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

KEEP_MS = 2 * 3600 * 1000  # event time after its start for which a session waits for messages
CHUNK = 64  # steps of one state entry
HOLD_KEEP_MS = 24 * 3600 * 1000  # event time after which a hold without a release is forgotten

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, which this interface needs."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def _value(state, default: tuple) -> tuple:
    """The state's value; a state without one gives the default."""
    found = state.get()
    return default if found is None else tuple(found)


# -- R3-R5 ---------------------------------------------------------------------------------------

_NAMES = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}


def _height(pitch: str) -> int:
    """MIDI number of a name with an optional sharp; unknown names are lowest."""
    name, octave = pitch[:-1], pitch[-1:]
    if not octave.isdigit() or name[:1] not in _NAMES or name[1:] not in ("", "#") or name in ("E#", "B#"):
        return -1
    return (int(octave) + 1) * 12 + _NAMES[name[:1]] + len(name[1:])


def _hand(measures: list | None) -> list[list]:
    """A hand's steps as [measure, beat, tones, highest tone]; equal tones count once."""
    steps = []
    for m, row in enumerate(measures or []):
        for step in row:
            tones = list(dict.fromkeys(step["pitches"]))
            steps.append([m, step["beat"], tones, max(tones, key=lambda p: (_height(p), p), default=None)])
    return steps


def plan_rows(mode: str, plan: str | None) -> tuple[dict[str, list], str]:
    """What a session will be asked, as named rows of steps, and its setting."""
    p = json.loads(plan) if plan else {}
    if mode == "performance":
        hands = {"r": _hand(p.get("t")), "l": _hand(p.get("b")) if p.get("both") else []}
        return hands, "midi" if p.get("midi") else "touch"
    return {"n": p.get("notes") or []}, p.get("mode") or ""


class Place:
    """Where a session stands. ``at`` and ``size`` are by row of the plan; ``held`` are the keys that are down
    (of a quiz: the tones that count so far)."""

    __slots__ = ("setting", "size", "at", "held", "right", "wrong", "done", "look")

    def __init__(self, setting: str, size: dict[str, int], at: dict[str, int], held: list[str], right: int,
                 wrong: int, done: bool, look) -> None:
        self.setting, self.size, self.at, self.held = setting, size, at, held
        self.right, self.wrong, self.done, self.look = right, wrong, done, look

    def due(self, row: str):
        """The row's next entry, if any is left."""
        return self.look(row, self.at[row]) if self.at[row] < self.size[row] else None

    def performance(self, kind: str, pitch: str) -> None:
        held = set(self.held)
        if kind == "off":
            self.held = sorted(held - {pitch})
        elif self.at != self.size:
            self.held = sorted(held | {pitch})
            due = {row: step for row in ("r", "l") if (step := self.due(row))}
            now = min(step[0] for step in due.values())  # a hand that is ahead by a measure waits
            open_ = {row: step for row, step in due.items() if step[0] == now}
            both = len(open_) == 2 and open_["r"][1] == open_["l"][1]
            rows = list(open_) if both else [row for row in open_ if pitch in open_[row][2]][:1]
            want = [tone for row in rows for tone in open_[row][2]]
            if pitch not in want:
                self.wrong += 1
            elif (pitch == open_[rows[0]][3] if self.setting == "touch" and not both and len(want) > 1
                  else set(want) <= set(self.held)):
                self.right += len(want)
                for row in rows:
                    self.at[row] += 1
        self.done = any(self.size.values()) and self.at == self.size

    def wait(self, kind: str, pitch: str) -> None:
        if kind == "on" and not self.done:
            hit = pitch == self.due("n")
            self.right, self.wrong, self.at["n"] = self.right + hit, self.wrong + (not hit), self.at["n"] + hit
        self.done = self.at == self.size

    def quiz(self, kind: str, pitch: str) -> None:
        if kind != "on" or self.done:
            return
        notes = [self.look("n", i) for i in range(self.size["n"])]  # a few notes
        chord = self.setting == "chord"
        place = len(self.held) if self.setting == "sequence" else 0
        if pitch in notes if chord else notes[place:place + 1] == [pitch]:
            self.right += 1
            self.held = self.held + [pitch]
            self.done = (set(notes) <= set(self.held) if chord
                         else len(self.held) >= (1 if self.setting == "note" else len(notes)))
        else:
            self.wrong += 1
            self.held = [] if chord else self.held


_FOLD = ("next bigint, seen bigint, late bigint, waiting bigint, right bigint, wrong bigint, done boolean, "
         "setting string, size string, at string, held string")
GRADED = "session_id bigint, seen bigint, correct bigint, wrong bigint, done boolean, late bigint"


class Grader(StatefulProcessor):
    """State of a session: its place (`fold`), its plan in chunks (`steps`, until it is done), and the messages that
    came before an earlier one (`waiting`), nothing else. A message whose place has passed is counted as late."""

    def __init__(self, mode: str) -> None:
        self.mode = mode

    def init(self, handle) -> None:
        self.handle = handle
        self.fold = handle.getValueState("fold", _FOLD)
        self.steps = handle.getMapState("steps", "row string, chunk bigint", "entries string")
        self.waiting = handle.getMapState("waiting", "seq bigint", "kind string, pitch string")

    def _look(self, chunks: dict[tuple, list]):
        """Steps of the plan; ``chunks`` are those at hand, others are fetched from the state."""
        def look(row: str, i: int):
            key = (row, i // CHUNK)
            if key not in chunks:
                chunks[key] = json.loads(self.steps.getValue(key)[0])
            return chunks[key][i % CHUNK]
        return look

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        batch = sorted(rows, key=lambda r: r.seq)
        nxt, seen, late, kept, right, wrong, done, setting, size, at, held = _value(
            self.fold, (-1, 0, 0, 0, 0, 0, False, "", "{}", "{}", "[]"))
        if seen == 0:
            self.handle.registerTimer(batch[0].started_ms + KEEP_MS)
        seen += len(batch)
        was_done, chunks, new = done, {}, False
        came: dict[int, tuple] = {}
        for r in batch:
            if r.kind == "start" and nxt < 0:
                nxt, new = r.seq + 1, True
                plan, setting = plan_rows(self.mode, r.plan)
                size, at = json.dumps({k: len(x) for k, x in plan.items()}), json.dumps(dict.fromkeys(plan, 0))
                chunks = {(k, i // CHUNK): x[i:i + CHUNK] for k, x in plan.items() for i in range(0, len(x), CHUNK)}
                done = self.mode == "wait" and at == size  # nothing to wait for
            elif r.seq in came or 0 <= r.seq < nxt:
                late += 1
            else:
                came[r.seq] = (r.kind, r.pitch)
        if nxt < 0:
            for seq, message in came.items():
                kept += not self.waiting.containsKey((seq,))
                self.waiting.updateValue((seq,), message)
        else:
            place = Place(setting, json.loads(size), json.loads(at), json.loads(held), right, wrong, done,
                          self._look(chunks))
            fold = getattr(place, self.mode)
            while True:
                if kept and self.waiting.containsKey((nxt,)):
                    fold(*self.waiting.getValue((nxt,)))
                    self.waiting.removeKey((nxt,))
                    kept -= 1
                    late += came.pop(nxt, None) is not None
                elif nxt in came:
                    fold(*came.pop(nxt))
                else:
                    break
                nxt += 1
            for seq, message in came.items():
                if seq > nxt:
                    if kept and self.waiting.containsKey((seq,)):
                        late += 1
                    else:
                        self.waiting.updateValue((seq,), message)
                        kept += 1
            right, wrong, done = place.right, place.wrong, place.done
            at, held = json.dumps(place.at), json.dumps(place.held)
            # A session that is done asks for no step any more.
            if new and not done:
                for chunk, entries in chunks.items():
                    self.steps.updateValue(chunk, (json.dumps(entries),))
            elif done and not new and not was_done:
                self.steps.clear()
        self.fold.update((nxt, seen, late, kept, right, wrong, done, setting, size, at, held))
        yield self._row(key, seen, right, wrong, done, late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """The session is over: what still waits is folded across the gaps, then its state goes."""
        nxt, seen, late, kept, right, wrong, done, setting, size, at, held = _value(self.fold, (-1,) + (0,) * 10)
        left = sorted((k[0], tuple(v)) for k, v in self.waiting.iterator()) if kept else []
        if nxt >= 0 and left:
            place = Place(setting, json.loads(size), json.loads(at), json.loads(held), right, wrong, done,
                          self._look({}))
            for seq, message in left:
                if seq >= nxt:
                    getattr(place, self.mode)(*message)
            right, wrong = place.right, place.wrong
        if nxt >= 0 and not done:
            self.steps.clear()
        if left:
            self.waiting.clear()
            done = place.done if nxt >= 0 else done
        self.fold.clear()
        if left:
            yield self._row(key, seen, right, wrong, done, late)

    def _row(self, key, seen, right, wrong, done, late) -> Row:
        return Row(session_id=key[0], seen=seen, correct=right, wrong=wrong, done=bool(done), late=late)

    def close(self) -> None:
        pass


def grades_stream(rows: DataFrame, mode: str) -> DataFrame:
    """R3-R5 over ``rows(session_id, seq, kind, pitch, plan, started_at)``: a session's totals so far, one row
    in every batch that brings messages of it (update mode). ``seq`` numbers a session's messages without a gap;
    a gap holds the fold back until the session ends."""
    rows = rows.withWatermark("started_at", f"{KEEP_MS} milliseconds").withColumn(
        "started_ms", F.unix_millis("started_at"))
    return rows.groupBy("session_id").transformWithState(Grader(mode), GRADED, "update", "EventTime")


# -- R2 ------------------------------------------------------------------------------------------

class Holds(StatefulProcessor):
    """State: since when a key is down. A hold whose release never comes leaves by an event-time timer; a time to
    live would count clock time, which a stream that reads stored messages runs through in no time."""

    def init(self, handle) -> None:
        self.handle = handle
        self.since = handle.getValueState("since", "ms bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = since = _value(self.since, (None,))[0]
        ended = []
        for r in sorted(rows, key=lambda r: r.seq):
            if r.kind == "on" and since is None:
                since = r.t_ms
            elif r.kind == "off" and since is not None:
                ended.append(Row(session_id=key[0], pitch=key[1], from_ms=since, to_ms=r.t_ms))
                since = None
        if since != before:
            if before is not None:
                self.handle.deleteTimer(before + HOLD_KEEP_MS)
            if since is None:
                self.since.clear()
            else:
                self.since.update((since,))
                self.handle.registerTimer(since + HOLD_KEEP_MS)
        yield from ended

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.since.clear()
        yield from ()

    def close(self) -> None:
        pass


def held_notes_stream(presses: DataFrame) -> DataFrame:
    """R2: every hold when it ends; open ones stay in the state for a day of event time."""
    rows = presses.withColumn("ts", F.timestamp_millis("t_ms")).withWatermark("ts", "1 hour")
    return rows.groupBy("session_id", "pitch").transformWithState(
        Holds(), "session_id bigint, pitch string, from_ms bigint, to_ms bigint", "append", "EventTime")


# -- R7 ------------------------------------------------------------------------------------------

class Jobs(StatefulProcessor):
    """State: a job's start, whether it has been reported, and its one timer: the limit while it is open, the
    end of its closed mark afterwards. Timers are in event time, which excludes a time to live in clock time."""

    def __init__(self, limit_ms: int, keep_ms: int) -> None:
        self.limit_ms, self.keep_ms = limit_ms, keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "closed boolean, start bigint, due bigint")

    def _keep(self, closed: bool, start: int, old: int | None, now: int) -> None:
        due = start + self.limit_ms
        if closed:
            due = max(due + self.keep_ms, now + 1)
        if due != old:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(due)
        self.job.update((closed, start, due))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        batch = sorted(rows, key=lambda r: (r.t_ms, r.event_id))
        closed, start, due = was = _value(self.job, (False, None, None))
        now, first = timerValues.getCurrentWatermarkInMs(), batch[0].t_ms
        start = first if start is None else min(start, first)
        report = []
        if not closed:
            end = next((r for r in batch if r.status in ("COMPLETED", "FAILED") and r.t_ms <= start + self.limit_ms),
                       None)
            if end is not None:
                report, closed = [Row(job_id=key[0], status=end.status, timed_out=False)], True
            elif now > start + self.limit_ms:  # rows came after the limit had passed
                report, closed = [Row(job_id=key[0], status="FAILED", timed_out=True)], True
        if (closed, start) != was[:2]:
            self._keep(closed, start, due, now)
        yield from report

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        closed, start, _ = _value(self.job, (True, 0, None))
        if closed:
            self.job.clear()
        else:
            self._keep(True, start, None, timerValues.getCurrentWatermarkInMs())
            yield Row(job_id=key[0], status="FAILED", timed_out=True)

    def close(self) -> None:
        pass


def job_tracker_stream(events: DataFrame, limit_ms: int, keep_ms: int) -> DataFrame:
    """R7 over ``events`` with ``ts``: a job is reported once, at its end or when its limit passes; its closed
    mark stays for ``keep_ms``, so that later rows do not open it again."""
    return events.withWatermark("ts", "1 minute").groupBy("job_id").transformWithState(
        Jobs(limit_ms, keep_ms), "job_id bigint, status string, timed_out boolean", "append", "EventTime")


# -- R8 ------------------------------------------------------------------------------------------

NAME_CHUNKS = 4096  # state entries among which the names of a part are dealt
PARTS = 16  # a song's names are dealt to so many keys, so that no song is one task
BOARD = ("song string, part int, place int, name string, nickname string, score double, entry_id bigint, "
         "created_us bigint")


class Board(StatefulProcessor):
    """State of a part of a song: the first entry of every name, by chunks of names, and the best ``k`` of these. A
    batch reads and writes each chunk that it touches once. Only when a name on the board turns out to have an
    earlier entry are the part's names read again."""

    def __init__(self, k: int) -> None:
        self.k = k

    def init(self, handle) -> None:
        self.firsts = handle.getMapState("firsts", "chunk int", "entries string")
        self.top = handle.getValueState("top", "rows string")

    @staticmethod
    def _age(entry: tuple) -> tuple:
        """Earlier first; entries without a time come before all others."""
        return entry[0] is not None, entry[0] or 0, entry[1]

    def _best(self, entries: dict[str, tuple]) -> dict[str, tuple]:
        ranked = sorted(entries.items(), key=lambda e: (-(e[1][2] or 0.0), self._age(e[1])))
        return dict(ranked[:self.k])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).astype({"created_us": "Int64"})
        came: dict[str, tuple] = {}
        for name, created, entry_id, score, nickname in zip(*(batch[c] for c in (
                "name", "created_us", "entry_id", "score", "nickname"))):
            entry = (None if pd.isna(created) else int(created), int(entry_id),
                     None if pd.isna(score) else float(score), nickname)
            if name not in came or self._age(entry) < self._age(came[name]):
                came[name] = entry
        before = {n: tuple(e) for n, e in json.loads(_value(self.top, ("{}",))[0]).items()}
        moved = False
        chunks: dict[int, list[str]] = {}
        for name in came:
            chunks.setdefault(zlib.crc32(name.encode()) % NAME_CHUNKS, []).append(name)
        for chunk, names in chunks.items():
            found = self.firsts.getValue((chunk,))
            known, changed = json.loads(found[0]) if found else {}, False
            for name in names:
                # Entries under the shared name have names of their own and are always first ones.
                if not name.startswith("#") and name in known and self._age(known[name]) <= self._age(came[name]):
                    del came[name]
                    continue
                known[name], changed = came[name], True
                moved |= name in before
            if changed:
                self.firsts.updateValue((chunk,), (json.dumps(known),))
        if moved:
            top = self._best({n: tuple(e) for _, found in self.firsts.iterator()
                              for n, e in json.loads(found[0]).items()})
        else:
            top = self._best(before | came)
        if top != before:
            self.top.update((json.dumps(top),))
            yield pd.DataFrame([(*key, i, n, e[3], e[2], e[1], e[0]) for i, (n, e) in enumerate(top.items())], columns=[
                "song", "part", "place", "name", "nickname", "score", "entry_id", "created_us"]).astype(
                {"created_us": "Int64"})

    def close(self) -> None:
        pass


def board_changes(entries: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of every part of a song that a batch has changed, whole (update mode)."""
    rows = entries.select("song", F.pmod(F.xxhash64("name"), F.lit(PARTS)).cast("int").alias("part"), "name",
                          F.unix_micros(F.col("created_at").cast("timestamp")).alias("created_us"), "entry_id",
                          F.col("score").cast("double").alias("score"), "nickname")
    return rows.groupBy("song", "part").transformWithStateInPandas(Board(k), BOARD, "update", "None")


def replaced_parts(board: DataFrame, changed: DataFrame) -> DataFrame:
    """The stored parts with the changed ones in place of their old rows."""
    return board.join(changed.select("song", "part").distinct(), ["song", "part"], "left_anti").unionByName(changed)


def board_top(board: DataFrame, k: int) -> DataFrame:
    """K1 over the stored parts: at most ``PARTS * k`` rows a song."""
    rank = F.row_number().over(Window.partitionBy("song").orderBy(
        F.coalesce("score", F.lit(0.0)).desc(), "created_us", "entry_id"))
    return board.withColumn("rank", rank).where(F.col("rank") <= k)
