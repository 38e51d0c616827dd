"""Calls of chat models that are kept apart in time, for each model by itself, as keyed state of a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.prompt import Chat

# Fixed value: seconds between two calls of a chat model.
LEAST_WAIT = 5.0
ANSWERS = "model string, prompt string, answer string, called_ms long"


class Throttle(StatefulProcessor):
    """Asks one prompt of a model at a time. Prompts that must wait are kept as state, and a timer wakes the model when its next call may be made.

    State and timers outlive a restart, so calls stay apart over it as well.
    """

    def __init__(self, chat: Chat, wait: float):
        self.chat, self.wait_ms = chat, int(wait * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "prompt string")
        self.next_ms = handle.getValueState("next", "at long")

    def _ask(self, key: tuple, now: int) -> Iterator[pd.DataFrame]:
        """Ask the prompt that has waited longest, if it may be asked now; see to it that the next one is."""
        if self.next_ms.exists() and self.next_ms.get()[0] > now:
            if not list(self.handle.listTimers()):
                self.handle.registerTimer(self.next_ms.get()[0])
            return
        queue = [row[0] for row in self.waiting.get()]
        if not queue:
            return
        self.next_ms.update((now + self.wait_ms,))
        if queue[1:]:
            self.waiting.put([(p,) for p in queue[1:]])
            self.handle.registerTimer(now + self.wait_ms)
        else:
            self.waiting.clear()
        yield pd.DataFrame({"model": [key[0]], "prompt": [queue[0]], "answer": [self.chat(queue[0])], "called_ms": [now]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            self.waiting.appendList([(p,) for p in frame["prompt"]])
        yield from self._ask(key, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._ask(key, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def throttled(prompts: DataFrame, chat: Chat, wait: float = LEAST_WAIT) -> DataFrame:
    """(model, prompt, answer, called_ms) of a stream (model, prompt): calls of one model at least ``wait`` seconds apart, made by the executors.

    The session needs the RocksDB provider of state stores. Prompts that are null are not asked.
    """
    rows = prompts.select("model", "prompt").filter("prompt is not null and model is not null")
    return rows.groupBy("model").transformWithStateInPandas(Throttle(chat, wait), ANSWERS, "Append", "ProcessingTime")
