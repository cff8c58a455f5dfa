"""Line diffs, range re-basing, snippet relocation and search/replace edits. Sequential by nature: grouped or Arrow UDFs."""

from __future__ import annotations

import difflib
import re
from array import array
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.functions.text import best_window

#: Lines within this distance of a replacement count as part of it (fixed value).
ADJACENT = 3

#: Annotations of a file that meet its texts in one row, about (fixed value).
PACK = 1_000

_INT = T.IntegerType()
_RANGE = T.StructType([T.StructField(n, _INT) for n in ("old_start", "old_end", "new_start", "new_end")])
DIFF = T.StructType().add("mapping", T.MapType(_INT, _INT)).add("added", T.ArrayType(_INT)).add("removed", T.ArrayType(_INT)).add("replaced", T.ArrayType(_RANGE))


def _opcodes(old: str | None, new: str | None) -> list[tuple[str, int, int, int, int]]:
    """The steps from one text's lines to the other's; they cover both in order."""
    return difflib.SequenceMatcher(None, (old or "").splitlines(), (new or "").splitlines()).get_opcodes()


def line_diff(old: str | None, new: str | None) -> dict:
    """Old line -> new line (None: gone), added and removed lines, replaced ranges; lines count from 1."""
    mapping: dict[int, int | None] = {}
    added, removed, replaced = [], [], []
    for tag, i1, i2, j1, j2 in _opcodes(old, new):
        if tag == "equal":
            mapping |= {i1 + k + 1: j1 + k + 1 for k in range(i2 - i1)}
        elif tag == "insert":
            added += range(j1 + 1, j2 + 1)
        else:
            gone = range(i1 + 1, i2 + 1)
            mapping |= dict.fromkeys(gone)
            removed += gone
            if tag == "replace":
                replaced.append({"old_start": i1 + 1, "old_end": i2, "new_start": j1 + 1, "new_end": j2})
    return {"mapping": mapping, "added": added, "removed": removed, "replaced": replaced}


@F.arrow_udf(DIFF)
def diff(old: pa.Array, new: pa.Array) -> pa.Array:
    """``line_diff`` of two columns, one row at a time. A batch's results are flat integers, so a line costs a few bytes, however short it is."""
    mapped, added, removed, replaced = (array("i") for _ in range(4))
    ends = [(0, 0, 0, 0)]
    for a, b in zip(old, new, strict=True):
        for tag, i1, i2, j1, j2 in _opcodes(a.as_py(), b.as_py()):
            if tag == "equal":
                mapped.extend(range(j1 + 1, j2 + 1))
            elif tag == "insert":
                added.extend(range(j1 + 1, j2 + 1))
            else:
                mapped.extend(repeat(0, i2 - i1))
                removed.extend(range(i1 + 1, i2 + 1))
                if tag == "replace":
                    replaced.extend((i1 + 1, i2, j1 + 1, j2))
        ends.append((len(mapped), len(added), len(removed), len(replaced) // 4))
    at = np.array(ends, np.int32).T
    to, sides = np.asarray(mapped), np.asarray(replaced).reshape(-1, 4).T
    lines = np.arange(1, len(to) + 1, dtype=np.int32) - np.repeat(at[0, :-1], np.diff(at[0]))
    ranges = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(x)) for x in sides], list(_RANGE.names))
    mapping = pa.MapArray.from_arrays(at[0], pa.array(lines), pa.array(to, mask=to == 0))
    lists = (pa.ListArray.from_arrays(n, values) for n, values in zip(at[1:], (pa.array(np.asarray(added)), pa.array(np.asarray(removed)), ranges), strict=True))
    return pa.StructArray.from_arrays([mapping, *lists], list(DIFF.names))


def diff_summary(pairs: DataFrame, old: str, new: str) -> DataFrame:
    """Lines added, removed and modified over all pairs of texts."""
    d = pairs.select(diff(F.col(old), F.col(new)).alias("d"))
    spans = F.aggregate("d.replaced", F.lit(0), lambda s, r: s + r["old_end"] - r["old_start"] + 1)
    return d.agg(F.sum(F.size("d.added")).alias("lines_added"), F.sum(F.size("d.removed") - spans).alias("lines_removed"), F.sum(spans).alias("lines_modified"))


def _extended(start: int, end: int, mapping: dict, hit: list[dict], added: list[int]) -> tuple[int, int]:
    """New range of an annotation that replacements cross: theirs, the kept ends, and added lines close by."""
    low = min([r["new_start"] for r in hit] + ([mapping[start]] if mapping.get(start) is not None else []))
    high = max([r["new_end"] for r in hit] + ([mapping[end]] if mapping.get(end) is not None else []))
    for line in added:
        if low - ADJACENT <= line < low:
            low = line
        elif low <= line <= high + ADJACENT:
            high = max(high, line)
    return low, high


def rebase(start: int | None, end: int | None, d: dict) -> dict:
    """What becomes of an annotation on lines start..end: keep, shift, resplit, split or delete, and its new range."""
    if start is None or end is None:
        return {"action": "keep", "new_start": start, "new_end": end}
    mapping = d["mapping"]
    hit = [r for r in d["replaced"] if start <= r["old_end"] + ADJACENT and end >= r["old_start"] - ADJACENT]
    inside = False
    if hit:
        low, high = min(r["old_start"] for r in hit), max(r["old_end"] for r in hit)
        if low <= start and high >= end:
            return {"action": "split", "new_start": min(r["new_start"] for r in hit), "new_end": max(r["new_end"] for r in hit)}
        if low < start or high > end:
            low, high = _extended(start, end, mapping, hit, d["added"])
            return {"action": "split", "new_start": low, "new_end": high}
        inside = True
    kept = [new for line in range(start, end + 1) if (new := mapping.get(line)) is not None]
    if not kept:
        return {"action": "delete", "new_start": None, "new_end": None}
    action = "resplit" if inside else "keep" if (kept[0], kept[-1]) == (start, end) else "shift"
    return {"action": action, "new_start": kept[0], "new_end": kept[-1]}


def rebase_annotations(annotations: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, file_id, start_line, end_line, action, new_start, new_end) of annotations (id, file_id, start_line, end_line)
    through the change of their file (file_id, old, new).

    Annotations of a file are packed into lists of about PACK, and a list meets its file's texts in one row, which is diffed once; so
    texts are neither sorted nor held once for each annotation. A shifted range whose text changed is resplit.
    """

    @F.pandas_udf("array<struct<action:string,new_start:int,new_end:int>>")
    def run(starts: pd.Series, ends: pd.Series, old: pd.Series, new: pd.Series) -> pd.Series:
        def one(s: int | None, e: int | None, d: dict, was: list[str], now: list[str]) -> dict:
            r = rebase(s, e, d)
            if r["action"] == "shift" and "\n".join(was[s - 1 : e]).strip() != "\n".join(now[r["new_start"] - 1 : r["new_end"]]).strip():
                r["action"] = "resplit"
            return r

        def listed(ss: list, es: list, a: str | None, b: str | None) -> list[dict]:
            d, was, now = line_diff(a, b), (a or "").splitlines(), (b or "").splitlines()
            return [one(*(None if pd.isna(x) else int(x) for x in (s, e)), d, was, now) for s, e in zip(ss, es, strict=True)]

        return pd.Series([listed(*row) for row in zip(starts, ends, old, new, strict=True)])

    own = ["id", "start_line", "end_line"]
    # files of more than one list are fewer than the annotations by PACK times, so their numbers of lists are broadcast
    many = annotations.groupBy("file_id").agg(F.ceil(F.count("*") / PACK).alias("_n")).filter("_n > 1")
    packed = annotations.join(F.broadcast(many), "file_id", "left").groupBy("file_id", F.pmod(F.xxhash64(*own), F.coalesce("_n", F.lit(1))).alias("_p")).agg(F.collect_list(F.struct(*own)).alias("_a"))
    met = packed.join(texts, "file_id").select("file_id", "_a", run("_a.start_line", "_a.end_line", "old", "new").alias("_r"))
    each = met.select("file_id", F.explode(F.arrays_zip("_a", "_r")).alias("x"))
    return each.select("x._a.id", "file_id", "x._a.start_line", "x._a.end_line", "x._r.action", "x._r.new_start", "x._r.new_end")


def greedy_changes(old: str, new: str) -> list[dict]:
    """Changes by a scan with one line of lookahead: (kind, line), kind delete or insert, lines of the old or the new text.

    Where lines differ, a deletion is tried first, then an insertion; else the line is deleted and another one inserted.
    """
    a, b, i, j, out = old.split("\n"), new.split("\n"), 0, 0, []
    gone, come = (lambda: out.append({"kind": "delete", "line": i + 1})), (lambda: out.append({"kind": "insert", "line": j + 1}))
    while i < len(a) and j < len(b):
        if a[i] != b[j]:
            deleted, inserted = a[i + 1 : i + 2] == [b[j]], b[j + 1 : j + 2] == [a[i]]
            if deleted or not inserted:
                gone()
            if not deleted:
                come()
            i, j = i + (deleted or not inserted), j + (not deleted)
        else:
            i, j = i + 1, j + 1
    out += [{"kind": "delete", "line": k + 1} for k in range(i, len(a))]
    return out + [{"kind": "insert", "line": k + 1} for k in range(j, len(b))]


@F.pandas_udf(T.ArrayType(T.StructType().add("kind", T.StringType()).add("line", _INT)))
def line_changes(old: pd.Series, new: pd.Series) -> pd.Series:
    """``greedy_changes`` of two columns; null texts are empty."""
    return pd.Series([greedy_changes(a or "", b or "") for a, b in zip(old, new, strict=True)])


def relocate(snippet: str, start: int, end: int, current: str | None) -> dict:
    """Where a remembered snippet is now: keep, move, update or remove."""
    if current is None:
        return {"action": "remove", "start": None, "end": None}
    want = [re.sub(r"^\s*\d+ \| ?", "", x) for x in snippet.split("\n")]
    have = current.split("\n")
    if have[start - 1 : end] == want:
        return {"action": "keep", "start": start, "end": end}
    n, at = len(want), f"\n{current}\n".find("\n" + "\n".join(want) + "\n")
    if at >= 0:
        i = current[:at].count("\n") if at else 0
        return {"action": "move", "start": i + 1, "end": i + n}
    best = best_window([x.strip() for x in want], [x.strip() for x in have])
    if best is not None and best[0] >= 0.2:
        return {"action": "update", "start": best[1] + 1, "end": best[1] + n}
    return {"action": "remove", "start": None, "end": None}


@F.pandas_udf(T.StructType().add("action", T.StringType()).add("start", _INT).add("end", _INT))
def relocated(snippet: pd.Series, start: pd.Series, end: pd.Series, current: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([relocate(a, int(s), int(e), c) for a, s, e, c in zip(snippet, start, end, current, strict=True)])


_BLOCK = re.compile(r"<<<<<<< SEARCH\s*\n(?::start_line:\s*(\d+)\s*\n)?(?:-{3,}\s*\n)?(.*?)\n?=======\s*\n(.*?)\n?>>>>>>> REPLACE", re.S)


def parse_edits(text: str) -> list[dict]:
    """Search/replace blocks, those with later start lines first."""
    found = [{"start_line": int(a) if a else None, "search": s, "replace": r} for a, s, r in _BLOCK.findall(text.replace("\r\n", "\n"))]
    return sorted(found, key=lambda x: -(x["start_line"] or 0))


def apply_edit(content: str, search: str, replace: str, start_line: int | None = None, reach: int = 10) -> str | None:
    """Replace the first place that matches: near the hinted line, then exactly, then by white space, then by parts of lines."""
    have, want = content.split("\n"), search.split("\n")
    n = len(want)
    memo: dict[str, str] = {}
    squeeze = lambda x: memo.get(x) or memo.setdefault(x, re.sub(r"\s+", " ", x.strip()))
    tests = (lambda a, b: a == b, lambda a, b: squeeze(a) == squeeze(b), lambda a, b: bool(squeeze(b)) and squeeze(b) in squeeze(a))
    hint = (start_line or 1) - 1
    near = sorted(range(max(0, hint - reach), min(len(have) - n, hint + reach) + 1), key=lambda i: abs(i - hint)) if start_line else []
    for places in (near, range(len(have) - n + 1)):
        for same in tests:
            for i in places:
                if all(same(a, b) for a, b in zip(have[i : i + n], want, strict=True)):
                    return "\n".join([*have[:i], *replace.split("\n"), *have[i + n :]])
    return content.replace(search, replace, 1) if search and search in content else None


@F.pandas_udf(T.StringType())
def edited(content: pd.Series, edits: pd.Series) -> pd.Series:
    def run(text: str, spec: str) -> str | None:
        for e in parse_edits(spec):
            if text is not None:
                text = apply_edit(text, e["search"], e["replace"], e["start_line"])
        return text

    return pd.Series([run(a, b) for a, b in zip(content, edits, strict=True)])
