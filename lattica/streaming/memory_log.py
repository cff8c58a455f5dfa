"""A log of memory operations, folded as a stream: tasks, code snippets with their traced elements, history."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lattica.operators.memory import HISTORY, STATUS

#: Events. Of ``elements`` the first is the element itself; ``up`` is the place in the array of what an element belongs to.
EVENTS = (
    "memory_id string, seq long, op string, id string, text string, status string, file_path string, start_line long, end_line long, is_traced boolean, "
    "elements array<struct<id: string, name: string, type: string, start_line: long, end_line: long, up: int>>, path array<string>, source_id string"
)
OUT = "memory_id string, seq long, kind string, id string, value string"
META = "tasks long, codes long, current string"
TASK = "text string, status string"
CODE = "file_path string, start_line long, end_line long, text string, is_traced boolean, summary string, elements string, needs string"
CODE_FIELDS = ("file_path", "start_line", "end_line", "text", "is_traced", "summary", "elements", "needs")
#: State that the processor keeps needs this store (fixed value).
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def element_id(file_path: str, name: str, kind: str, start: int | None, end: int | None) -> str:
    """The id of an element that came without one: a digest of its place, type and name."""
    return "elem_" + hashlib.md5(f"{file_path}:{start or 0}-{end or 0}:{kind}:{name}".encode()).hexdigest()[:16]


def flat(elements: list | None, file_path: str, lines: bool = True) -> list[dict]:
    """Elements with ids, each with the id of what it belongs to; the first has none."""
    out: list[dict] = []
    for e in elements or []:
        own = e["id"] or element_id(file_path, e["name"], e["type"], e["start_line"] if lines else 0, e["end_line"] if lines else 0)
        up = e["up"]
        out.append({"id": own, "name": e["name"], "type": e["type"], "parent": out[up]["id"] if lines and up is not None and 0 <= up < len(out) else None})
    return out


def placed(tree: list[dict], new: list[dict], path: list[str]) -> list[dict]:
    """A tree with an element and what it holds put at the end of a path of ids; unchanged if the path's root isn't there.

    A step that the element above it doesn't hold leads back to the root; below an element that holds none, steps are skipped.
    """
    parent = None
    if path:
        if not any(e["id"] == path[0] and e["parent"] is None for e in tree):
            return tree
        parent = path[0]
        for step in path[1:]:
            kids = [e["id"] for e in tree if e["parent"] == parent]
            if kids and step not in kids:
                parent = path[0]
                break
            parent = step if kids else parent
    held = {e["id"] for e in tree}
    return tree + [{**e, "parent": parent if k == 0 else e["parent"]} for k, e in enumerate(new) if e["id"] not in held]


class MemoryProcessor(StatefulProcessor):
    """One memory: counters and the current task as a value, tasks and snippets as maps, the last HISTORY entries as a list.

    An operation reads and writes the entries it names, so its cost doesn't grow with the memory. Ids are given from counters, whatever an
    event says; an add of a second current task fails and uses up its id. Operations that fail change nothing else. Events of a
    micro-batch are folded in the order of ``seq``; those of one memory are sorted in its task, so the source's files per
    trigger bound them. An event that is not after the last one folded counts as seen, so a repeated one does nothing.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.meta = handle.getValueState("meta", META + ", last long")
        self.tasks = handle.getMapState("tasks", "id string", TASK)
        self.codes = handle.getMapState("codes", "id string", CODE)
        self.history = handle.getListState("history", "seq long, text string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        n_tasks, n_codes, current, last = self.meta.get() if self.meta.exists() else (0, 0, None, -(2**62))
        for e in sorted(rows, key=lambda r: r["seq"]):
            if e["seq"] <= last:
                continue
            self.n_tasks, self.n_codes, self.current, last, self.changed = n_tasks, n_codes, current, e["seq"], []
            apply = getattr(self, f"on_{e['op']}", None)
            problem = apply(e) if apply else "unknown operation"
            n_tasks, n_codes, current = self.n_tasks, self.n_codes, self.current
            for kind, own, value in self.changed:
                yield Row(memory_id=key[0], seq=e["seq"], kind=kind, id=own, value=None if value is None else json.dumps(value, sort_keys=True))
            yield Row(memory_id=key[0], seq=e["seq"], kind="result", id=str(e["seq"]), value=json.dumps({"op": e["op"], "problem": problem}, sort_keys=True))
        self.meta.update((n_tasks, n_codes, current, last))

    def close(self) -> None:
        pass

    # --- history and tasks

    def on_history(self, e: Row) -> str | None:
        if not e["text"]:
            return "no text"
        held = [tuple(x) for x in self.history.get()] if self.history.exists() else []
        self.history.put([*held, (e["seq"], e["text"])][-HISTORY:])
        self.changed.append(("history", str(e["seq"]), {"text": e["text"]}))
        self.changed += [("history", str(seq), None) for seq, _ in held[: max(len(held) + 1 - HISTORY, 0)]]
        return None

    def _task(self, own: str, text: str, status: str) -> None:
        self.tasks.updateValue((own,), (text, status))
        self.changed.append(("task", own, {"text": text, "status": status}))
        self.current = own if status == "current" else None if self.current == own else self.current

    def on_add_task(self, e: Row) -> str | None:
        status = (e["status"] or "pending").lower()
        if not e["text"] or status not in STATUS:
            return "no text" if not e["text"] else "unknown status"
        self.n_tasks += 1
        if status == "current" and self.current is not None:
            return "another task is current"
        self._task(str(self.n_tasks), e["text"], status)
        return None

    def on_move_task(self, e: Row) -> str | None:
        status = (e["status"] or "").lower()
        if status not in STATUS or e["id"] is None or not self.tasks.containsKey((e["id"],)):
            return "unknown status" if status not in STATUS else "no such task"
        text, old = self.tasks.getValue((e["id"],))
        if old == status:
            return "in this status already"
        if status == "current" and self.current is not None:
            self._task(self.current, self.tasks.getValue((self.current,))[0], "pending")
        self._task(e["id"], text, status)
        return None

    def on_remove_task(self, e: Row) -> str | None:
        if e["id"] is None or not self.tasks.containsKey((e["id"],)):
            return "no such task"
        self.tasks.removeKey((e["id"],))
        self.current = None if self.current == e["id"] else self.current
        self.changed.append(("task", e["id"], None))
        return None

    # --- snippets

    def _snippet(self, e: Row) -> dict | None:
        if e["id"] is None or not self.codes.containsKey((e["id"],)):
            return None
        c = dict(zip(CODE_FIELDS, self.codes.getValue((e["id"],)), strict=True))
        return {**c, "elements": json.loads(c["elements"]), "needs": json.loads(c["needs"])}

    def _keep(self, own: str, c: dict) -> None:
        self.codes.updateValue((own,), tuple(json.dumps(c[f]) if f in ("elements", "needs") else c[f] for f in CODE_FIELDS))
        self.changed.append(("code", own, c))

    def on_add_code(self, e: Row) -> str | None:
        missing = [f for f in ("file_path", "start_line", "end_line", "text") if e[f] is None or e[f] == ""]
        if missing:
            return "missing: " + ", ".join(missing)
        self.n_codes += 1
        tree = placed([], flat(e["elements"], e["file_path"]), [])
        self._keep(str(self.n_codes), {**{f: e[f] for f in CODE_FIELDS[:4]}, "is_traced": bool(e["is_traced"]), "summary": None, "elements": tree, "needs": []})
        return None

    def on_remove_code(self, e: Row) -> str | None:
        if self._snippet(e) is None:
            return "no such snippet"
        self.codes.removeKey((e["id"],))
        self.changed.append(("code", e["id"], None))
        return None

    def on_set_traced(self, e: Row) -> str | None:
        c = self._snippet(e)
        if c is None:
            return "no such snippet"
        self._keep(e["id"], {**c, "is_traced": bool(e["is_traced"])})
        return None

    def on_set_summary(self, e: Row) -> str | None:
        c = self._snippet(e)
        if c is None or not e["text"]:
            return "no such snippet" if c is None else "no text"
        self._keep(e["id"], {**c, "summary": e["text"]})
        return None

    def on_add_needs_tracing(self, e: Row) -> str | None:
        c = self._snippet(e)
        if c is None or not e["elements"]:
            return "no such snippet" if c is None else "no elements"
        new = [{f: x[f] for f in ("id", "name", "type")} for x in flat(e["elements"], c["file_path"], lines=False)]
        self._keep(e["id"], {**c, "needs": c["needs"] + new})
        return None

    def on_move_to_traced(self, e: Row) -> str | None:
        """An element traced: it leaves what needs tracing (by ``source_id``, else by name and type) and goes to the end of ``path``."""
        c = self._snippet(e)
        if c is None or not e["elements"]:
            return "no such snippet" if c is None else "no elements"
        new = flat(e["elements"], c["file_path"])
        there = any(x["id"] == new[0]["id"] for x in c["elements"])
        same = lambda x: x["id"] == e["source_id"] if e["source_id"] else not there and (x["name"], x["type"]) == (new[0]["name"], new[0]["type"])
        tree = c["elements"] if there else placed(c["elements"], new, list(e["path"] or []))
        self._keep(e["id"], {**c, "needs": [x for x in c["needs"] if not same(x)], "elements": tree})
        return "there already" if there else None if len(tree) > len(c["elements"]) else "no such root"


def fold(events: DataFrame) -> DataFrame:
    """A stream of EVENTS as updates (memory_id, seq, kind, id, value): entries as JSON, null for removed ones, and a result for each event."""
    held = events.filter("memory_id IS NOT NULL AND seq IS NOT NULL")
    return held.groupBy("memory_id").transformWithState(MemoryProcessor(), OUT, "Update", "none")


def latest(updates: DataFrame) -> DataFrame:
    """(memory_id, kind, id, value): what a memory holds after all updates; (memory, kind, id) of equal keys meet map-side first."""
    last = updates.filter("kind <> 'result'").groupBy("memory_id", "kind", "id").agg(F.max_by(F.struct("value"), "seq").alias("u"))
    return last.select("memory_id", "kind", "id", "u.value").filter("value IS NOT NULL")


def run(events: DataFrame, path: str) -> DataFrame:
    """What there is of a stream, folded into a table of updates at ``path`` (its checkpoint beside it); run again, it goes on from there."""
    spark = events.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STORE)
    try:

        def write(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/updates/batch={number}")

        q = fold(events).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(OUT).parquet(f"{path}/updates")
