"""Answer streams with state: messages in any order of arrival become ordered protocol events.

The state of a conversation lies in several variables: the fold's few numbers, the
messages that came before their turn, the ids that tools brought, the text so
far.  A message waits until all turns before it have come; a timer ends the wait,
and an answer that stays silent, so no state lives for ever.  Events are those of
``fold.answer_events``, whatever the order and the batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomgraph.functions import parse as P

OUT = "conv_id long, seq long, event string, body string"
#: Milliseconds without news after which what is missing is passed over and the answer ends.
IDLE_MS = 600_000
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_NAME = re.compile(r"\[([a-z0-9][a-z0-9-]*)\]")
_MESSAGE = "kind string, text string, reasoning string, cited array<int>, content string, sources array<string>, native boolean, last boolean"


class Answers(StatefulProcessor):
    """One conversation's fold."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # next turn, number of events, whether reasoning is open, text has begun, a tool was called, the answer is over, its last turn is known
        self.fold = handle.getValueState("fold", "next long, seq long, open boolean, said boolean, tools boolean, over boolean, last long")
        self.held = handle.getMapState("held", "turn long", _MESSAGE)
        self.brought = handle.getListState("brought", "id string, native boolean")
        self.spoken = handle.getListState("spoken", "text string")
        self.marks = handle.getMapState("marks", "kind string, name string", "there boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out: list[tuple] = []
        state = self._state()
        for frame in rows:
            for r in frame.itertuples(index=False):
                turn = int(r.turn)
                if state["over"] or turn < state["next"] or self.held.containsKey((turn,)):
                    continue  # told already, or sent twice
                listed = lambda v: None if v is None else list(v)
                text = lambda v: None if v is None or v != v else v
                self.held.updateValue((turn,), (text(r.kind), text(r.text), text(r.reasoning), [int(i) for i in listed(r.cited) or []], text(r.content), listed(r.sources) or [], bool(r.native), bool(r.last)))
                if r.last:
                    state["last"] = turn
        while not state["over"] and self.held.containsKey((state["next"],)):
            self._told(key[0], state, state["next"], out)
        self._ended(key[0], state, out)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + IDLE_MS)
        self._keep(state)
        yield pd.DataFrame(out, columns=["conv_id", "seq", "event", "body"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out: list[tuple] = []
        state = self._state()
        if not state["over"]:
            for turn in sorted(k[0] for k in self.held.keys()):  # gaps are passed over now
                if not state["over"]:
                    self._told(key[0], state, turn, out)
            state["last"] = state["next"] - 1
            self._ended(key[0], state, out)
        for variable in (self.fold, self.held, self.brought, self.spoken, self.marks):
            variable.clear()
        yield pd.DataFrame(out, columns=["conv_id", "seq", "event", "body"])

    def close(self) -> None:
        pass

    # -- the fold

    def _state(self) -> dict:
        names = ("next", "seq", "open", "said", "tools", "over", "last")
        return dict(zip(names, self.fold.get() if self.fold.exists() else (0, 0, False, False, False, False, None)))

    def _keep(self, state: dict) -> None:
        self.fold.update(tuple(state.values()))

    def _told(self, conv: int, state: dict, turn: int, out: list[tuple]) -> None:
        kind, text, reasoning, cited, content, sources, native, _ = self.held.getValue((turn,))
        self.held.removeKey((turn,))

        def say(event: str, body: str | None = None) -> None:
            state["seq"] += 1
            out.append((conv, state["seq"], event, body))

        text, reasoning = (text or "", reasoning or "") if kind == "ai" else ("", "")
        if text:
            known = list(dict.fromkeys(b[0] for b in self.brought.get()))
            for name in set(_NAME.findall(text)) & set(known):
                self.marks.updateValue(("named", name), (True,))
            for name in known:
                text = text.replace(f"[{name}]", "")
        if kind == "ai":
            for place in cited or []:
                self.marks.updateValue(("cited", str(place)), (True,))
        if kind == "tool":
            state["tools"] = True
            for name in sources or []:
                self.brought.appendValue((name, bool(native)))
        was, state["open"] = state["open"], reasoning != ""
        if state["open"]:
            if not was:
                say("reasoning-start")
            say("reasoning-delta", reasoning)
        elif was and kind != "error":
            say("reasoning-end")
        if text:
            if not state["said"]:
                say("text-start")
            say("text-delta", text)
            state["said"] = True
            self.spoken.appendValue((text,))
        if kind == "error":
            say("error", content)
            state["over"] = True
        state["next"] = turn + 1

    def _ended(self, conv: int, state: dict, out: list[tuple]) -> None:
        """The end events, once the last turn has been told and no error ended the answer."""
        if state["over"] or state["last"] is None or state["next"] <= state["last"]:
            return
        events: list[tuple[str, str | None]] = []
        if state["open"]:
            events.append(("reasoning-end", None))
        if state["said"]:
            events.append(("text-end", None))
        if state["tools"]:
            events.append(("data-sources", ",".join(self._shown())))
        events.append(("finish-step", None))
        for event, body in events:
            state["seq"] += 1
            out.append((conv, state["seq"], event, body))
        state["over"] = True

    def _shown(self) -> list[str]:
        """Cited sources: by place and by name where the model cites so, else those that are named or mentioned."""
        brought = list(self.brought.get())
        results = [b[0] for b in brought if b[1]]
        marks = [k for k in self.marks.keys()]
        named = sorted(k[1] for k in marks if k[0] == "named")
        if results:
            places = sorted(int(k[1]) for k in marks if k[0] == "cited")
            return list(dict.fromkeys([results[i] for i in places if 0 <= i < len(results)] + [n for n in named if n in results]))
        plain = re.sub(r"\[.*?\]", " ", "".join(t[0] for t in self.spoken.get()))
        return sorted({b[0] for b in brought if not b[1] and (b[0] in named or re.search(rf"(?i)\b{re.escape(b[0])}\b", plain))})


def streamed_answers(messages: DataFrame) -> DataFrame:
    """``fold.answer_events`` over a stream of messages (conv_id, turn, kind, content, sources, native, last).

    Turns count from 0; ``last`` marks an answer's last message, and where it
    never comes the answer ends when its timer does.  The session must keep state
    in a store that has several variables (``with_state_store`` sets it).
    """
    c = P.content(F.col("content"))
    rows = messages.select("conv_id", "turn", "kind", c.alias("_c"), "content", "sources", "native", F.coalesce("last", F.lit(False)).alias("last"))
    rows = rows.select("conv_id", "turn", "kind", F.col("_c.text").alias("text"), F.col("_c.reasoning").alias("reasoning"), F.col("_c.cited").alias("cited"), "content", "sources", "native", "last")
    return rows.groupBy("conv_id").transformWithStateInPandas(statefulProcessor=Answers(), outputStructType=OUT, outputMode="Append", timeMode="ProcessingTime")


def with_state_store(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
