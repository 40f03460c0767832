"""Clue state and context of conversations while their turns arrive (CV9)."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from recollect.functions import text as tx
from recollect.operators.conversation import RETRIEVING

class Ending(StatefulProcessor):
    """State of a conversation that is cleared once no turn of it has arrived for ``idle_ms``; never, if that is None."""

    def __init__(self, idle_ms: int | None = None) -> None:
        self._idle = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle

    def _postpone(self, timer_values: Any) -> None:
        if self._idle is not None:
            for timer in list(self._handle.listTimers()):
                self._handle.deleteTimer(timer)
            self._handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self._idle)

    def _kept(self) -> list[Any]:
        raise NotImplementedError

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        for state in self._kept():
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


def _time_mode(idle_ms: int | None) -> str:
    return "None" if idle_ms is None else "ProcessingTime"


STATE_OUT = "conv_id long, turn long, segment long, slot string, value string"


class ClueState(Ending):
    """Keeps the searches and the clues of one conversation by turn.

    A turn is answered from what was said up to it, however late it arrives: an older turn
    never replaces the value of a newer one, and a search counts from its own turn on. The state grows
    with the clues and searches of a conversation, not with its turns.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        # One entry for the conversation: every one read or written is a call to the state server, and all are read anyway.
        self._said = handle.getValueState("said", "searches array<long>, slots array<string>, turns array<long>, clues array<string>")

    def _kept(self) -> list[Any]:
        return [self._said]

    def handleInputRows(
        self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any
    ) -> Iterator[pd.DataFrame]:
        self._postpone(timer_values)
        held = self._said.get()
        searches = set(held[0]) if held else set()
        clues = dict(zip(zip(held[2], held[1]), held[3])) if held else {}
        before = len(searches), dict(clues)
        arrived: set[int] = set()
        for some in rows:
            for turn, intent, slot, value in zip(*(some[c].tolist() for c in ("turn", "intent", "slot", "value"))):
                arrived.add(turn)
                if intent == "search":
                    searches.add(turn)
                if slot is not None and not pd.isna(slot):
                    clues[turn, slot] = value
        if (len(searches), clues) != before:
            order = sorted(clues)
            self._said.update((sorted(searches), [s for _, s in order], [t for t, _ in order], [clues[c] for c in order]))
        opening = sorted(searches)
        said = [(turn, slot, clues[turn, slot]) for turn, slot in sorted(clues)]
        out, now, at, segment = [], {}, 0, 0
        for turn in sorted(arrived):
            while segment < len(opening) and opening[segment] <= turn:
                segment += 1
                now = {}
            opened = opening[segment - 1] if segment else None
            while at < len(said) and said[at][0] <= turn:
                if opened is None or said[at][0] >= opened:
                    now[said[at][1]] = said[at][2]
                at += 1
            out += [(key[0], turn, segment, slot, value) for slot, value in now.items()]
        if out:
            yield pd.DataFrame(out, columns=["conv_id", "turn", "segment", "slot", "value"])


def stream_context(clued_turns: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Clue state as of each arriving turn, from a stream of (conv_id, turn, intent, slot, value).

    A turn without clues is one row with a NULL slot. A turn that arrives late is answered as of
    itself; answers given before it are not taken back. A conversation without a turn for ``idle_ms`` is forgotten: what comes
    then starts anew. Needs the RocksDB state store.
    """
    return clued_turns.groupBy("conv_id").transformWithStateInPandas(
        statefulProcessor=ClueState(idle_ms),
        outputStructType=STATE_OUT,
        outputMode="append",
        timeMode=_time_mode(idle_ms),
    )


def clued(turns: DataFrame, clues: DataFrame) -> DataFrame:
    """The input layout of ``stream_context`` from labelled turns and their clues."""
    return turns.join(clues.select("conv_id", "turn", "slot", "value"), ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "intent", F.col("slot"), F.col("value")
    )


LIVE_OUT = "conv_id long, turn long, part string, name string, value string, change int"


class LiveContext(Ending):
    """Keeps what was said in one conversation by turn: searches, terms, clues, and which turns were answered.

    The answer of a turn is its context (all terms of its search so far, for turns that search) and its clue
    state. What arrives late changes the answers of turns after it: rows that no longer hold are
    taken back (change -1) and new ones given (change 1), so that the changes add up to what one
    batch of all turns would give. Turns before the earliest that arrived are not looked at.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        # One entry for each turn with all that was said in it: every entry read or written is a call to the state server.
        self._turns = handle.getMapState("turns", "turn long", "intent string, parts array<string>, names array<string>, said array<string>")

    def _kept(self) -> list[Any]:
        return [self._turns]

    def _answers(self, since: int, turns: dict[int, str | None], said: dict[int, list[tuple[str, str, str]]]) -> set[tuple[int, str, str, str]]:
        out: set[tuple[int, str, str, str]] = set()
        terms: set[str] = set()
        clues: dict[str, str] = {}
        for turn in sorted(turns):
            if turns[turn] == "search":
                terms, clues = set(), {}
            for part, name, value in said.get(turn, []):
                if part == "term":
                    terms.add(value)
                else:
                    clues[name] = value
            if turn >= since:
                if turns[turn] in RETRIEVING:
                    out |= {(turn, "term", "", t) for t in terms}
                out |= {(turn, "clue", slot, value) for slot, value in clues.items()}
        return out

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
        self._postpone(timer_values)
        turns: dict[int, str | None] = {}
        said: dict[int, list[tuple[str, str, str]]] = {}
        for (turn,), (intent, parts, names, values) in self._turns.iterator():
            turns[turn], said[turn] = intent, list(zip(parts, names, values))
        arrived = pd.concat(rows)
        since = int(arrived["turn"].min())
        before = self._answers(since, turns, said)
        known: dict[int, set[tuple[str, str, str]]] = {}
        for turn, intent, part, name, value in zip(arrived["turn"], arrived["intent"], arrived["part"], arrived["name"], arrived["value"]):
            turn = int(turn)
            turns[turn] = intent
            held = known.setdefault(turn, set(said.setdefault(turn, [])))
            if part is not None and not pd.isna(part) and (part, name, value) not in held:
                held.add((part, name, value))
                said[turn].append((part, name, value))
        for turn in known:
            self._turns.updateValue((turn,), (turns[turn], *[[entry[i] for entry in said[turn]] for i in range(3)]))
        after = self._answers(since, turns, said)
        changes = [(key[0], *row, -1) for row in sorted(before - after)] + [(key[0], *row, 1) for row in sorted(after - before)]
        yield pd.DataFrame(changes, columns=["conv_id", "turn", "part", "name", "value", "change"])


def stream_answers(said: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Changes (conv_id, turn, part, name, value, change) to the answers of user turns, from a stream of ``said_turns``.

    ``part`` is "term" or "clue"; ``settled`` adds the changes up. Needs the RocksDB state store. The state holds what was
    said in a conversation, each term of a turn once. A conversation without a turn for ``idle_ms`` is forgotten: its answers
    stand, and what comes then starts anew. With None nothing is forgotten.
    """
    return said.groupBy("conv_id").transformWithStateInPandas(
        statefulProcessor=LiveContext(idle_ms), outputStructType=LIVE_OUT, outputMode="append", timeMode=_time_mode(idle_ms)
    )


def said_turns(turns: DataFrame, clues: DataFrame) -> DataFrame:
    """The input layout of ``stream_answers`` from labelled user turns and their clues: (conv_id, turn, intent, part, name, value).

    A turn without terms or clues is one row with a NULL part. Only turns that search have terms.
    """
    own = ["conv_id", "turn", "intent"]
    terms = turns.filter(F.col("intent").isin(*RETRIEVING)).select(*own, F.explode(F.array_distinct(tx.tokens("text"))).alias("value"))
    found = turns.select(*own).join(clues.select("conv_id", "turn", "slot", "value"), ["conv_id", "turn"])
    none = F.lit(None).cast("string")
    return (
        terms.select(*own, F.lit("term").alias("part"), F.lit("").alias("name"), "value")
        .unionByName(found.select(*own, F.lit("clue").alias("part"), F.col("slot").alias("name"), "value"))
        .unionByName(turns.select(*own, none.alias("part"), none.alias("name"), none.alias("value")))
    )


def settled(changes: DataFrame) -> DataFrame:
    """The answers that hold after all changes."""
    sums = changes.groupBy("conv_id", "turn", "part", "name", "value").agg(F.sum("change").alias("held"))
    return sums.filter("held > 0").drop("held")
