"""Stateful run fold: live event streams to terminal run rows, same rules as the batch fold.

A state key holds a bucket of runs, by a hash of the run id: calls to the state store, timers and
the batches that leave a worker cost about a millisecond a key, so they are shared by its runs.
State per bucket, in typed variables:

* ``heads``: per run the next sequence number and what was seen so far, as parallel arrays, and the
  time of the bucket's timer; read and written once per batch that touches the bucket;
* ``parts``: the texts of the content events by run and number, appended, and read once for the
  answer;
* ``waiting``: events that arrived before their turn, by run and sequence number;
* one event-time timer at the earliest time limit of its runs, which also ends the life of a closed
  run's state.

Events are applied in ``seq`` order (0, 1, 2, ...); what one batch brings is put into the state
at its end or when ``HELD`` events are held, and a run that ends before never stores its texts. The
first terminal event or protocol error closes the run and emits its row; a run still open
``timeout`` after its first event fails with ``global_timeout``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from askgrid.operators.runs import (CANCELLED_CODE, DONE_FIELDS, INTERNAL_ERROR,
                                    PROTOCOL_ERROR)

# Fixed value: seconds a run may stay open.
RUN_TIMEOUT_SECONDS = 120
TIMEOUT_CODE = "global_timeout"
_TRACE = ("array<struct<stage:string,duration_ms:double,candidate_count:bigint,"
          "degradation_reason:string,decision:string>>")
OUTPUT = (
    "run_id bigint, conversation_id bigint, status string, answer string, "
    "source_chunk_ids array<string>, intent_route string, model_id string, "
    "finish_reason string, input_tokens bigint, output_tokens bigint, "
    f"trace {_TRACE}, error_code string, late_events bigint"
)
_COLUMNS = ["run_id", "conversation_id", "status", "answer", "source_chunk_ids", "intent_route",
            "model_id", "finish_reason", "input_tokens", "output_tokens", "trace", "error_code",
            "late_events"]
#: Events and texts of a bucket held before they go to the state.
HELD = 10_000
#: Runs are dealt into so many state keys; part of the stored state, so it stays as it is.
BUCKETS = 4_096
_KEPT = [f for f in DONE_FIELDS if f != "outcome"]
_EVENT = ["seq", "kind", "text", "source_ids", *DONE_FIELDS]
_WAITING = ("kind string, text string, source_ids array<string>, outcome string, "
            "intent_route string, model_id string, finish_reason string, input_tokens bigint, "
            f"output_tokens bigint, trace {_TRACE}")
_HEAD = {"next": "bigint", "conversation_id": "bigint", "deadline": "bigint", "closed": "boolean",
         "late": "bigint", "waiting": "bigint", "parts": "bigint", "guided": "boolean",
         "guidance": "string", "sources": "array<string>"}
_HEADS = "timer bigint, run_id array<bigint>, " + ", ".join(
    f"{name} array<{kind}>" for name, kind in _HEAD.items())
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass",
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _filled(text) -> bool:
    return bool(text and text.strip())


def _fits(end: dict, answer, sources) -> bool:
    """Same consistency rules as ``operators.runs.completion_is_valid``."""
    route, sources = end["intent_route"], sources or []
    answered = _filled(answer) and _filled(end["model_id"]) and _filled(end["finish_reason"])
    if end["outcome"] == "completed":
        right = (route == "knowledge_base" and sources) or (
            route == "system_direct" and not sources)
        return bool(answered and right)
    if end["outcome"] == "clarification":
        return answered and route == "clarification" and not sources
    empty = all(end[c] is None
                for c in ("model_id", "finish_reason", "input_tokens", "output_tokens"))
    return (end["outcome"] == "no_context" and route == "knowledge_base" and answer is None
            and not sources and empty)


def _row(key, head: dict, fields: dict) -> Row:
    full = {"run_id": key, "conversation_id": head["conversation_id"],
            "late_events": head["late"], **fields}
    return Row(**{c: full.get(c) for c in _COLUMNS})


class _Run:
    """A run while a batch is applied: its head, and what is not yet in the state."""

    __slots__ = ("id", "head", "texts", "early", "terminal", "begun")

    def __init__(self, run_id, head: dict):
        self.id, self.head = run_id, head
        self.texts: list[str] = []
        self.early: dict[int, Row] = {}  # events before their turn
        self.terminal: dict | None = None
        self.begun: int | None = None


class RunFold(StatefulProcessor):
    """A bucket of runs per key; see the module's description."""

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.heads = handle.getValueState("heads", _HEADS)
        self.parts = handle.getMapState("parts", "run_id bigint, n bigint", "texts array<string>")
        self.waiting = handle.getMapState("waiting", "run_id bigint, seq bigint", _WAITING)

    def _load(self) -> tuple[int | None, dict]:
        """The bucket's timer and the heads of its runs."""
        stored = self.heads.get()
        if stored is None:
            return None, {}
        timer, ids, *columns = stored
        return timer, {run: dict(zip(_HEAD, values)) for run, values in zip(ids, zip(*columns))}

    def _store(self, timer: int | None, heads: dict) -> None:
        """Write the heads; the timer stands at the earliest time limit."""
        due = min((h["deadline"] for h in heads.values()), default=None)
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        if not heads:
            self.heads.clear()
            return
        self.heads.update((due, list(heads),
                           *([h[name] for h in heads.values()] for name in _HEAD)))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        timer, heads = self._load()
        runs: dict[int, _Run] = {}
        held = 0
        for row in rows:
            run = runs.get(row.run_id)
            if run is None:
                if row.run_id not in heads:
                    heads[row.run_id] = {
                        **dict.fromkeys(_HEAD), "next": 0, "closed": False, "late": 0,
                        "waiting": 0, "parts": 0, "guided": False}
                run = runs[row.run_id] = _Run(row.run_id, heads[row.run_id])
            held += self._take(run, row)
            if held >= HELD:
                for some in runs.values():
                    if some.terminal is None:
                        self._append(some)
                        self._wait(some)
                held = 0
        ended = []
        for run in runs.values():
            self._limit(run)
            if run.terminal is None:
                self._append(run)
                self._wait(run)
                continue
            yield _row(run.id, {**run.head}, run.terminal)
            ended.append((run.id, {**run.head}))
            # What follows is only counted, until the timer ends the state.
            run.head.update(late=0, guidance=None, sources=None, parts=0, waiting=0)
        self._drop(ended)
        self._store(timer, heads)

    def _take(self, run: _Run, row: Row) -> int:
        """Apply an event of a run or put it aside; 1 if it is held."""
        head, seq = run.head, row.seq
        if head["closed"]:
            head["late"] += 1
            return 0
        run.begun = row.at if run.begun is None else min(run.begun, row.at)
        if head["conversation_id"] is None:
            head["conversation_id"] = row.conversation_id
        if seq < head["next"] or seq in run.early:
            head["late"] += 1  # a repeat
            return 0
        if seq > head["next"]:
            run.early[seq] = row
            return 1
        event = row
        while event is not None and run.terminal is None:
            run.terminal = self._apply(run, event)
            event = self._following(run)
        if run.terminal is None:
            return 1
        head["closed"] = True
        head["late"] += len(run.early) + head["waiting"] + (event is not None)
        run.texts.clear()
        run.early.clear()
        return 0

    def _limit(self, run: _Run) -> None:
        """The time limit is counted from the earliest event."""
        if run.begun is not None:
            deadline, known = run.begun + self.timeout_ms, run.head["deadline"]
            run.head["deadline"] = deadline if known is None else min(known, deadline)

    def _append(self, run: _Run) -> None:
        if run.texts:
            self.parts.updateValue((run.id, run.head["parts"]), (list(run.texts),))
            run.head["parts"] += 1
            run.texts.clear()

    def _wait(self, run: _Run) -> None:
        """Put events that came before their turn into the state."""
        known = run.head["waiting"] > 0
        for seq, row in run.early.items():
            if known and self.waiting.containsKey((run.id, seq)):
                run.head["late"] += 1
                continue
            self.waiting.updateValue((run.id, seq), tuple(row[c] for c in _EVENT[1:]))
            run.head["waiting"] += 1
        run.early.clear()

    def _following(self, run: _Run) -> Row | None:
        """The next event, if it came before its turn."""
        at = run.head["next"]
        if at in run.early:
            return run.early.pop(at)
        if not run.head["waiting"] or not self.waiting.containsKey((run.id, at)):
            return None
        event = Row(**dict(zip(_EVENT[1:], self.waiting.getValue((run.id, at)))))
        self.waiting.removeKey((run.id, at))
        run.head["waiting"] -= 1
        return event

    def _drop(self, ended: list[tuple[int, dict]]) -> None:
        """Remove the texts and waiting events of runs that are over."""
        for run, head in ended:
            for n in range(head["parts"]):
                self.parts.removeKey((run, n))
        gone = {run for run, head in ended if head["waiting"]}
        if gone:
            for at in [tuple(k) for k in self.waiting.keys() if k[0] in gone]:
                self.waiting.removeKey(at)

    def _apply(self, run: _Run, event: Row) -> dict | None:
        """Apply the event whose turn it is; the fields of a terminal row once decided."""
        head, texts, kind = run.head, run.texts, event.kind
        written = head["parts"] > 0 or bool(texts)
        head["next"] += 1
        if kind == "content":
            if head["guided"]:
                return {"status": "failed", "error_code": PROTOCOL_ERROR}
            texts.append(event.text or "")
        elif kind == "guidance":
            if head["guided"] or written:
                return {"status": "failed", "error_code": PROTOCOL_ERROR}
            head.update(guided=True, guidance=event.text)
        elif kind == "sources":
            head["sources"] = event.source_ids
        elif kind == "cancel":
            return {"status": "cancelled", "error_code": CANCELLED_CODE}
        elif kind == "error":
            code = (event.text or "").strip()
            usable = 1 <= len(code) <= 100
            return {"status": "failed", "error_code": code if usable else INTERNAL_ERROR}
        elif kind == "done":
            answer = head["guidance"]
            if written:
                stored = (t for n in range(head["parts"])
                          for t in self.parts.getValue((run.id, n))[0])
                answer = "".join([*stored, *texts])
            end = {c: event[c] for c in DONE_FIELDS}
            if not _fits(end, answer, head["sources"]):
                return {"status": "failed", "error_code": INTERNAL_ERROR}
            return {"status": end["outcome"], "answer": answer,
                    "source_chunk_ids": list(head["sources"] or []),
                    **{c: end[c] for c in _KEPT}}
        return None

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        timer, heads = self._load()
        now = timerValues.getCurrentWatermarkInMs()
        ended = [(run, head) for run, head in heads.items()
                 if head["deadline"] < now or head["deadline"] == timer]
        for run, head in ended:
            del heads[run]
            if not head["closed"]:
                yield _row(run, head, {"status": "failed", "error_code": TIMEOUT_CODE})
            elif head["late"]:
                yield _row(run, head, {"status": "late_events"})
        self._drop(ended)
        # The timer that fired is removed by the engine.
        self._store(None, heads)

    def close(self) -> None:
        pass


def use_state_store(spark: SparkSession) -> None:
    """Typed state lives in the embedded store on the workers' disks, not in their heaps."""
    spark.conf.set(*STATE_STORE)


def fold_runs_stream(events: DataFrame, delay: str = "30 seconds",
                     timeout_seconds: int = RUN_TIMEOUT_SECONDS) -> DataFrame:
    """Terminal run rows from a stream of run events with an event-time column ``ts``.

    Output columns as in ``OUTPUT``. ``late_events`` counts what came after the event that closed
    the run, and repeats of a sequence number; a row of status ``late_events`` reports those of
    later batches when the run's time limit has passed. Sets the session's state store (see
    ``use_state_store``), which a query started from it then uses.
    """
    use_state_store(events.sparkSession)
    columns = ["run_id", "conversation_id", *_EVENT, "ts"]
    return (
        events.select(F.pmod(F.xxhash64("run_id"), F.lit(BUCKETS)).alias("bucket"), *columns,
                      F.unix_millis("ts").alias("at"))
        .withWatermark("ts", delay)
        .groupBy("bucket")
        .transformWithState(RunFold(timeout_seconds * 1000), OUTPUT, "append", "eventTime")
    )
