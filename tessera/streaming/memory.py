"""Streams of messages and papers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: The summary so far and the turns that fall out, to a new summary.
Summariser = Callable[[str, list[str]], str]
OUT = "conv_id bigint, kept bigint, tokens bigint, summary string"
STATE = "turns array<string>, summary string"


def estimate(text: str) -> int:
    return max(1, len(text) // 4)


def tail(summary: str, turns: list[str], most: int = 600) -> str:
    """The end of a summary and the turns after it, a summariser that needs no model."""
    return " ".join(filter(None, [summary, *(t[:most] for t in turns)]))[-most:]


def fold(turns: list[str], summary: str, new: list[str], budget: int, summarise: Summariser = tail) -> tuple[list[str], str]:
    """The turns that fit once ``new`` have come, newest first; what falls out goes to ``summarise(summary, turns)``, and stays out if that fails: then its end is kept."""
    turns = [*turns, *new]
    used, keep = estimate(summary) if summary else 0, 0
    for t in reversed(turns):
        used += estimate(t)
        if keep and used > budget:
            break
        keep += 1
    out = turns[: len(turns) - keep]
    if out:
        try:
            summary = summarise(summary, out)
        except Exception:  # noqa: BLE001 - any model may fail
            summary = tail(summary, out)
    return turns[len(turns) - keep :], summary


def conversation_state(messages: DataFrame, budget: int = 1500, summarise: Summariser = tail) -> DataFrame:
    """A running memory for each conversation of a stream ``messages(conv_id, turn, role, text)``; ``summarise`` runs in the tasks."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        turns, summary = state.get if state.exists else ([], "")
        new = pd.concat(list(frames)).sort_values("turn")
        new = new[new.role.isin(["user", "assistant"])]
        turns, summary = fold(list(turns), summary, [f"{r.role}: {r.text}" for r in new.itertuples()], budget, summarise)
        state.update((turns, summary))
        yield pd.DataFrame({"conv_id": [key[0]], "kept": [len(turns)], "tokens": [sum(map(estimate, turns))], "summary": [summary]})

    return messages.groupBy("conv_id").applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
