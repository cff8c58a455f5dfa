"""Operators on small fixtures: diffs, re-basing, extraction, imports, store, streams, delivery, memory."""

import datetime
import itertools
import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattica.functions import paths as P
from lattica.operators import changes, delivery, diffs, graph, intervals, maintenance, memory, neighbours, packing, retrieval, snippets, store
from lattica.sources import extract, files
from lattica.streaming import changelog, memory_log

PY = '''import os, sys as system
from pkg import helper
from . import sibling
__all__ = ["f"]
import importlib
mod = importlib.import_module("plug.in")
X, (Y, Z) = 1, (2, 3)
class Color(Enum):
    RED = 1
class A(Base):
    field: int = 3
    def m(self):
        def inner():
            return 1
        return inner
async def g(*args):
    if (n := len(args)) > 1:
        yield n
'''

TS = """import { a as b, c } from './mod';
import def from "lib";
import './side';
const fs = require('fs');
export const { x, y: z, ...rest } = obj;
let [p, , q = 1] = arr;
export default class Foo<T> extends Bar {
  private count = 0;
  static make(): Foo { return new Foo(); }
  async run(a: string) { if (a) { return 1; } }
}
interface Shape { area(): number; }
type Id = string | number;
const enum Level { Low, High }
function* gen(n) { yield n; }
const arrow = async (v) => v + 1; // class Hidden {}
"""


def test_python_blocks():
    out = extract.python_blocks(PY)
    names = lambda kind: [b["name"] for b in out if b["type"] == kind]
    assert names("import") == ["os, system", "helper", "sibling", "importlib", "plug.in"]
    assert names("export") == ["__all__"] and names("enum") == ["Color"] and names("class") == ["A"]
    assert {"X", "Y", "Z", "mod", "n", "field"} <= set(names("variable"))
    assert sorted(names("function")) == ["g", "inner", "m"]
    a = next(i for i, b in enumerate(out) if b["name"] == "A")
    assert out[a]["content"] == "" and {b["name"] for b in out if b["parent_ordinal"] == a} == {"m", "field"}


def test_large_functions_refer_to_nested_ones():
    body = "\n".join(f"    x{i} = {i}" for i in range(300))
    out = extract.python_blocks(f"def big():\n{body}\n    def small():\n        return 1\n    return small\n")
    big = next(i for i, b in enumerate(out) if b["name"] == "big")
    small = next(i for i, b in enumerate(out) if b["name"] == "small")
    assert out[small]["parent_ordinal"] == big and f"[BLOCK_REF:{small}]" in out[big]["content"] and "return 1" not in out[big]["content"]


def test_typescript_blocks():
    out = extract.typescript_blocks(TS)
    names = lambda kind: [b["name"] for b in out if b["type"] == kind]
    assert {"x", "z", "rest", "p", "q", "count"} <= set(names("variable")) and "Hidden" not in names("class")
    assert names("class") == ["Foo"] and names("interface") == ["Shape"] and names("enum") == ["Level"] and names("type") == ["Id"]
    assert {"gen", "arrow", "make", "run"} <= set(names("function"))
    assert "fs" in names("import") and len(names("import")) >= 4 and names("export")
    assert {b["name"] for b in out if b["parent_ordinal"] is not None} >= {"count", "make", "run"}


def test_extraction_and_imports(spark):
    rows = [
        (1, "/r/main.py", "python", "import pkg.util as u\nfrom pkg import helper\nfrom pkg.sub import deep\nimport os\n"), (2, "/r/pkg/util.py", "python", "from . import helper\nfrom .sub.deep import x\n"),
        (3, "/r/pkg/helper.py", "python", "from .. import main\n"), (4, "/r/pkg/sub/deep.py", "python", "def f(:\n"), (5, "/r/a.ts", "typescript", "import {x} from './lib';\nexport * from './b';\n"),
        (6, "/r/lib/index.ts", "typescript", "import y from '../b';"), (7, "/r/b.js", "javascript", "const a = require('./a');"), (8, "/r/x.txt", None, "import a"),
    ]
    df = spark.createDataFrame(rows, "id long, file_path string, language string, content string")
    got = {(r["source_id"], r["target_id"]) for r in extract.import_edges(df).collect()}
    assert got == {(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 1), (5, 6), (5, 7), (6, 7), (7, 5)}
    assert extract.extract_blocks(df).filter("file_id IN (4, 8)").count() == 0


def test_directory_scan(spark, tmp_path):
    for name, data in {"a.py": b"x = 1\n", "node_modules/b.js": b"no", "bin.dat": b"a\x00b", "sub/c.ts": "é".encode("latin-1"), "d.pyc": b"no", "sub/e.md": b""}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r["file_path"].rsplit(str(tmp_path), 1)[-1]: r for r in files.scan(spark, str(tmp_path)).collect()}
    assert set(got) == {"/a.py", "/sub/c.ts"} and got["/sub/c.ts"]["content"] == "é" and got["/a.py"]["language"] == "python"
    assert "content" not in files.scan(spark, str(tmp_path), hashes_only=True).columns


def test_extraction_files(spark, tmp_path):
    spec = {"metadata": {"total_files": 1}, "files": {"/a.py": {"id": 7, "language": "python", "content": "x", "content_hash": "h", "blocks": [{"type": "variable", "name": "x", "content": "x", "start_line": 1, "end_line": 1}], "relationships": []}}}
    for name in ("p_20240101.json", "p_extraction_20240301.json", "q_20250101.json"):
        (tmp_path / name).write_text(json.dumps(spec))
    assert files.latest_extraction(spark, str(tmp_path), "p").endswith("p_extraction_20240301.json")
    rows = files.read_extraction(spark, str(tmp_path / "p_20240101.json"))
    assert rows.first()["id"] == 7 and store.flatten_blocks(rows.select(F.col("id").alias("file_id"), "blocks")).first()["name"] == "x"


def test_nested_extraction(spark, tmp_path):
    """Children nest to any depth; a block's parent is found by its id."""
    deep = {"type": "function", "name": "n40", "content": "x", "start_line": 41, "end_line": 41, "id": 1}
    for k in reversed(range(40)):
        deep = {"type": "class", "name": f"n{k}", "content": "", "start_line": k + 1, "end_line": 41, "children": [deep, {"type": "variable", "name": f"v{k}", "content": "v", "start_line": k + 1, "end_line": k + 1}]}
    spec = {"metadata": {}, "files": {"/a.py": {"id": 7, "language": "python", "content": "x", "content_hash": "h", "blocks": [deep], "relationships": []}, "/b.py": {"id": 8, "language": "python", "content": "", "content_hash": "h", "blocks": [], "relationships": []}}}
    (tmp_path / "p_1.json").write_text(json.dumps(spec))
    tables = maintenance.load_extraction(spark, str(tmp_path / "p_1.json"), 3)
    by = {r["name"]: r for r in tables["code_blocks"].collect()}
    assert len(by) == 81 and by["n0"]["parent_block_id"] is None and by["n40"]["source_id"] == 1
    assert all(by[f"n{k + 1}"]["parent_block_id"] == by[f"v{k}"]["parent_block_id"] == by[f"n{k}"]["id"] for k in range(40))
    assert [by[n]["ordinal"] for n in ("n0", "n1", "n40", "v39", "v0")] == [1, 2, 41, 42, 81]
    assert tuple(maintenance.extraction_stats(tables).first()) == (2, 81, 80, 0)


def test_directory_to_search(spark, tmp_path):
    """Scan, blocks, paths, contexts, vectors and search join on the same ids."""
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg/shapes.py").write_text("import enum\nfrom pkg import area\n\nclass Shape(Base):\n    kind = 1\n\n    def perimeter(self, sides):\n        return sum(sides)\n")
    (tmp_path / "pkg/area.py").write_text("def square_area(side):\n    return side * side\n")
    tables = maintenance.index_directory(spark, str(tmp_path), 4)
    blocks = tables["code_blocks"].cache()
    names = {r["id"]: r["name"] for r in blocks.collect()}
    assert len(names) == blocks.count() and {"Shape", "perimeter", "kind", "square_area"} <= set(names.values())
    paths = {names[r["id"]]: r["path"] for r in graph.block_paths(blocks).collect()}
    assert paths["perimeter"] == "Shape" and paths["square_area"] == ""
    projects = spark.createDataFrame([(4, "p")], "id long, name string")
    parents = {r["name"]: r["parent"] and r["parent"]["name"] for r in graph.block_context(blocks, tables["files"], projects).collect()}
    assert parents["perimeter"] == parents["kind"] == "Shape" and parents["square_area"] is None
    vectors = maintenance.embed_blocks(blocks, tables["files"]).withColumn("vec_id", F.xxhash64("node_id", "chunk_index"))
    hits = maintenance.search_text(vectors, "def square_area(side): return side * side", k=3).collect()
    assert {int(r["node_id"].removeprefix("block_")) for r in hits} <= set(names) and hits[0]["project_id"] == 4
    assert tables["relationships"].count() == 1


def test_registered_extractors_reach_workers(spark):
    extract.register("toy", lambda text: [{"type": "variable", "name": w, "content": w, "start_line": 1, "end_line": 1, "start_col": 1, "end_col": 1, "parent_ordinal": None} for w in text.split()])
    try:
        df = spark.createDataFrame([(1, "toy", "a b c")], "id long, language string, content string")
        assert [r["name"] for r in extract.extract_blocks(df).orderBy("ordinal").collect()] == ["a", "b", "c"]
    finally:
        del extract.EXTRACTORS["toy"]


def test_paths_with_many_dots(spark):
    up = "/" + "/".join("abcdefghijkl") + "/" + "../" * 12 + "x"
    rows = [(up, "/x"), ("/a//b/./c", "/a/b/c"), ("a/../../b", "../b"), ("/../x", "/../x"), ("./a", "./a"), ("a/b/..", "a"), (None, None)]
    df = spark.createDataFrame(rows, "p string, want string")
    assert all(r["n"] == r["want"] for r in df.withColumn("n", P.normalise("p")).collect())
    files_ = [(1, "/r/a/b/c/d/e/f/g/h/i.ts", "typescript", "import x from '../../../../../../../../lib';"), (2, "/r/lib.ts", "typescript", "")]
    edges = extract.import_edges(spark.createDataFrame(files_, "id long, file_path string, language string, content string"))
    assert [(r["source_id"], r["target_id"]) for r in edges.collect()] == [(1, 2)]


def test_scan_lists(spark):
    names = {"a/x.PY": "python", "Dockerfile": "dockerfile", "x.h": "c", "x.php": "hack", "x.hh": "cpp", "go.mod": "gomod", "y.tsx": "typescript", ".gitignore": "gitignore", "q.zig": "zig", "x.unknown": None, "Makefile": "make", "x.m": "matlab"}
    df = spark.createDataFrame(list(names.items()), "p string, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", P.language("p")).collect())
    skipped = ["r/vendor/x.py", "r/lib/site-packages/x.py", "r/.myvenv3/x.py", "r/x.woff2", "r/$RECYCLE.BIN", "r/a.min.css", "r/env2/x.py"]
    kept = ["r/src/x.py", "r/environment.py", "r/x.envoy"]
    got = {r["p"] for r in spark.createDataFrame([(x,) for x in skipped + kept], "p string").filter(~P.ignored_below(F.col("p"), F.lit("r"))).collect()}
    assert got == set(kept)


def test_null_vectors_are_no_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.9, 0.0])], "vec_id long, embedding array<float>")
    assert sorted((r["query_id"], r["vec_id"]) for r in retrieval.nearest_many(df, df, k=5).collect()) == [(1, 1), (1, 3), (3, 1), (3, 3)]


@pytest.mark.parametrize("kind", ["clusters", "ties", "one"])
def test_nearest_of_many_is_exact(spark, kind, monkeypatch):
    """Equal to brute force, with rings left out, with blocks split, and when most vectors are copies."""
    monkeypatch.setattr(neighbours, "ROWS", 64)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 6)) * 40
    v = {"clusters": centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, 6)), "ties": np.where(rng.random((900, 1)) < 0.7, 1e6 + np.ones(6), 1e6 + rng.integers(0, 3, (900, 6))), "one": np.ones((3, 6))}[kind]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(9999, [1.0, 2.0]), (9998, None), (9997, [])], "vec_id long, embedding array<double>")
    index = neighbours.Index(df)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["distance"]) for r in index.search(df.filter("vec_id % 7 = 0"), 5).collect()}
    want = {}
    for i in range(0, len(v), 7):
        d = np.sqrt(((v[i] - v) ** 2).sum(1))
        want.update({(i, r + 1): (int(j), d[j]) for r, j in enumerate(np.lexsort((np.arange(len(v)), d))[:5])})
    assert got == want
    if kind == "clusters":
        q = df.filter("vec_id % 7 = 0").selectExpr("vec_id AS id", "embedding AS v", "double(10) AS top")
        met = index._wanted(q, 5, True).selectExpr("size(queries) AS n").agg(F.sum("n")).first()[0]
        assert met < 0.5 * 129 * index.blocks.count()


def test_no_neighbours_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    full = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert retrieval.nearest_many(df, full).count() == 0 == retrieval.nearest_many(full, df).count()


def test_web_results(spark):
    web = json.dumps({"web": {"results": [{"title": "t", "url": "u", "description": "d"}]}})
    image = json.dumps({"results": [{"title": "i", "source": "s", "properties": {"url": "v"}}]})
    out = files.search_results(spark.createDataFrame([(web,), (image,), (None,)], "json string")).orderBy("title").collect()
    assert [(r["title"], r["url"], r["description"]) for r in out] == [("i", "v", "s"), ("t", "u", "d")]
    assert files.html_text("<head><title>x</title></head><p>Hi <b>you</b></p><script>no</script><a href='u'>l</a>", True) == "Hi **you**\n[l](u)"


# --- diffs


LINES = st.lists(st.sampled_from("abcdef"), max_size=14)


@settings(max_examples=120, deadline=None)
@given(LINES, LINES)
def test_diff_maps_in_order(a, b):
    d = diffs.line_diff("\n".join(a), "\n".join(b))
    kept = [(o, n) for o, n in sorted(d["mapping"].items()) if n is not None]
    assert all(a[o - 1] == b[n - 1] for o, n in kept) and [n for _, n in kept] == sorted({n for _, n in kept})
    assert sorted(o for o, n in d["mapping"].items() if n is None) == sorted(d["removed"])


def test_rebase():
    old = "\n".join(f"line {i}" for i in range(1, 31))
    new_lines = old.split("\n")
    at = lambda edit, s, e: (lambda r: (r["action"], r["new_start"], r["new_end"]))(diffs.rebase(s, e, diffs.line_diff(old, "\n".join(edit(list(new_lines))))))
    assert at(lambda x: x, 5, 9) == ("keep", 5, 9)
    assert at(lambda x: ["new", *x], 5, 9) == ("shift", 6, 10)
    assert at(lambda x: x[:4] + x[9:], 5, 9) == ("delete", None, None)
    assert at(lambda x: x[:4] + ["p", "q"] + x[9:], 5, 9) == ("split", 5, 6)
    assert at(lambda x: x[:7] + ["p"] + x[10:], 5, 9) == ("split", 5, 8)
    assert at(lambda x: x[:9] + ["p"] + x[10:], 5, 18) == ("resplit", 5, 18)
    assert diffs.rebase(None, 4, diffs.line_diff(old, "x"))["action"] == "keep"


def test_edits(spark):
    spec = "<<<<<<< SEARCH\n:start_line: 2\nb\n=======\nB\n>>>>>>> REPLACE\n"
    assert diffs.parse_edits(spec) == [{"start_line": 2, "search": "b", "replace": "B"}]
    assert diffs.apply_edit("a\nb\nc\nb", "b", "B", 4) == "a\nb\nc\nB" and diffs.apply_edit("a\n  b   x\nc", "b x", "B") == "a\nB\nc" and diffs.apply_edit("a", "zz", "y") is None
    df = spark.createDataFrame([("a\nb\nc", spec)], "t string, e string")
    assert df.select(diffs.edited("t", "e")).first()[0] == "a\nB\nc"
    assert diffs.relocate("b\nc", 1, 2, "a\nb\nc")["action"] == "move" and diffs.relocate("b\nzz", 2, 3, "a\nb\nc") == {"action": "update", "start": 2, "end": 3} and diffs.relocate("q", 1, 1, "a")["action"] == "remove"
    assert diffs.greedy_changes("a\nb\nc", "a\nx\nb\nd") == [{"kind": "insert", "line": 2}, {"kind": "delete", "line": 3}, {"kind": "insert", "line": 4}]
    assert diffs.greedy_changes("a\nb\nc", "b\na\nc") == [{"kind": "delete", "line": 1}, {"kind": "insert", "line": 2}]
    assert diffs.greedy_changes("a\n", "a") == [{"kind": "delete", "line": 2}]


def test_shifted_ranges(spark):
    ranges = spark.createDataFrame([(1, 1, 10, 20), (1, 2, 2, 3)], "file_id long, id long, start_line long, end_line long")
    moved = spark.createDataFrame([(1, 5, "added"), (1, 15, "added"), (1, 16, "removed"), (1, 18, "added"), (2, 1, "added")], "file_id long, line long, kind string")
    assert {(r["id"], r["new_start"], r["new_end"]) for r in intervals.shift_ranges(ranges, moved).collect()} == {(1, 11, 22), (2, 2, 3)}


# --- changes, packing, delivery


def test_packing(spark):
    rng = random.Random(1)
    sizes = [rng.randint(1, 60) for _ in range(40)] + [500]
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate(sizes)], "k long, i long, n long")
    got = [r["batch"] for r in packing.packed(df, "k", ["i"], "n", 100).orderBy("i").collect()]
    want, used, b = [], 0, 0
    for n in sizes:
        if used and used + n > 100:
            used, b = 0, b + 1
        used += n
        want.append(b)
    assert got == want
    pages = delivery.by_count(df, 15, "i")
    assert delivery.page(pages, 2).count() == 11 and delivery.status(pages, "k", 1).first()["percent"] == 33.3


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(0, 8)), min_size=1, max_size=15))
def test_merged_ranges(spark, spans):
    df = spark.createDataFrame([(1, a, a + n) for a, n in spans], "k long, start_line long, end_line long")
    got = sorted((r["start_line"], r["end_line"]) for r in changes.merged_ranges(df, "k").collect())
    lines = sorted({x for a, n in spans for x in range(a, a + n + 1)})
    runs = [[x for _, x in g] for _, g in itertools.groupby(enumerate(lines), lambda t: t[1] - t[0])]
    assert got == [(r[0], r[-1]) for r in runs]


def test_checkpoint(spark):
    old = spark.createDataFrame([("a", "added", None, "1"), ("b", "modified", "0", "1"), ("c", "deleted", "0", None)], "file_path string, change_type string, old_code string, new_code string")
    new = spark.createDataFrame([("a", "deleted", "1", None), ("b", "modified", "1", "2"), ("c", "added", None, "9"), ("d", "added", None, "5")], old.schema)
    got = {r["file_path"]: (r["change_type"], r["old_code"], r["new_code"]) for r in changes.merge_checkpoint(old, new).collect()}
    assert got == {"a": ("deleted", None, None), "b": ("modified", "0", "2"), "c": ("modified", "0", "9"), "d": ("added", None, "5")}


def test_change_stream_is_the_batch_result(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    rng = random.Random(5)
    rows = [(rng.randrange(6), rng.choice(["added", "modified", "deleted"]), f"c{i}", t0 + datetime.timedelta(minutes=i), i) for i in range(60)]
    df = spark.createDataFrame(rows, "file_id long, op string, code string, ts timestamp, event_id long")
    for k in range(3):
        df.filter(F.col("event_id").between(20 * k, 20 * k + 19)).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    out = changelog.run_once(changelog.compact_stream(stream), "compacted", str(tmp_path / "cp"))
    last = {r["file_id"]: (r["change_type"], r["old_code"], r["new_code"]) for r in out.orderBy("n").collect()}
    assert last == {r["file_id"]: (r["change_type"], r["old_code"], r["new_code"]) for r in changes.compact(df).collect()}
    windows = changelog.run_once(changelog.windowed_counts(stream), "windows", str(tmp_path / "cp2"), "append")
    assert windows.count() == 0 or windows.agg(F.sum("n")).first()[0] <= 60


# --- store, graph, memory


def test_store(spark, tmp_path):
    s = store.ParquetStore(spark, str(tmp_path / "db"))
    s.create()
    row = spark.createDataFrame([(1, "p", "/p", "", False, None, None)], s.read("projects").schema)
    s.write("projects", store.upsert(s.read("projects"), row, ["name"]))
    s.write("projects", store.upsert(s.read("projects"), row.withColumn("id", F.lit(2).cast("long")), ["name"]))
    assert [r["id"] for r in s.read("projects").collect()] == [2]
    s.clear()
    assert s.read("projects").count() == 0
    v = spark.createDataFrame([([1.0, 2.0],)], "embedding array<float>")
    assert store.checked_vectors(v, 2).count() == 1
    with pytest.raises(Exception, match="elements"):
        store.checked_vectors(v, 3).collect()
    assert store.dumps({"a": {1}, "b": b"x"}) == '{"a": [1], "b": "x"}'


def test_upserts(spark):
    t = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 3)], "id long, v string, seq long")
    assert {r["v"] for r in store.keep_last(t, ["id"], "seq").collect()} == {"b", "c"} and {r["v"] for r in store.keep_first(t, ["id"], "seq").collect()} == {"a", "c"}
    new = spark.createDataFrame([(2, None), (1, "z")], "id long, v string")
    assert {(r["id"], r["v"]) for r in store.update(t, new, "id", ["v"]).collect()} == {(1, "z"), (2, "c")}
    assert store.insert_ignore(t, new.withColumn("seq", F.lit(9)), ["id"]).count() == 3


def test_nested_results(spark):
    j = json.dumps({"incoming_connections": {"HTTP/HTTPS": {"a.py": [{"snippet_lines": "3-9", "description": "d"}, {"snippet_lines": "4", "description": "e"}]}}})
    df = spark.createDataFrame([(j,)], "j string").select(F.from_json("j", "incoming_connections map<string,map<string,array<struct<snippet_lines:string,description:string>>>>").alias("r")).select("r.*")
    assert {(r["start_line"], r["end_line"], r["description"]) for r in store.connections_from_result(df, "incoming").collect()} == {(3, 9, "d"), (4, 4, "e")}


def test_import_cycles_end(spark):
    f = spark.createDataFrame([(i, f"f{i}") for i in range(4)], "id long, file_path string")
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3), (3, 3)], "source_id long, target_id long")
    got = {(r["anchor_id"], r["depth"], r["file_id"]) for r in graph.dependency_chain(e, f).collect()}
    assert {x for x in got if x[0] == 0} == {(0, 1, 1), (0, 2, 2), (0, 3, 3)} and not any(a == b for a, _, b in got)


def test_chunk_text():
    text = "\n".join(f"word{i} " * 10 for i in range(60))
    out = retrieval.chunk_text(text, 100, 20, "HEAD one")
    assert out[0]["text"].startswith("HEAD one\n\n") and out[0]["start_line"] == 1 and out[-1]["end_line"] == 60
    assert all(b["start_line"] == a["end_line"] + 1 for a, b in itertools.pairwise(out)) and all(c["token_count"] <= 101 for c in out)
    assert retrieval.chunk_text(" \n") == [] and retrieval.trim_tokens("a b c d", 2).split() == ["a", "b"] and retrieval.overlap_tail("a b c", 2) == "b c"


def test_grep(spark):
    df = spark.createDataFrame([(1, "a\nb HIT\nc\nd\ne\nf\ng hit\nh"), (2, "none")], "id long, t string")
    hits = retrieval.grep(df, "id", "t", "hit", before=1, after=1)
    assert [(r["line_no"], r["grp"]) for r in hits.orderBy("line_no").collect()] == [(1, 1), (2, 1), (3, 1), (6, 2), (7, 2), (8, 2)]
    assert retrieval.grouped_by_text(hits).first()["text"].count("\n--\n") == 1


def test_memory(spark):
    log = spark.createDataFrame(
        [(1, "add", "t1", "First  task", "pending"), (2, "add", "t2", "first task", "current"), (3, "move", "t1", None, "current"), (4, "add", "t3", "x", "pending"), (5, "remove", "t3", None, None)],
        "seq long, op string, id string, description string, status string",
    )
    t = memory.tasks(log)
    assert {(r["id"], r["status"]) for r in t.collect()} == {("t1", "current"), ("t2", "pending")}
    assert [r["id"] for r in memory.deduplicated(t).collect()] == ["t1"] and memory.problems(t).count() == 0
    snippets = spark.createDataFrame([("s1", "/a/b/c.py", 2, 3), ("s2", "/x/c.py", 1, 1)], "id string, file_path string, start_line int, end_line int")
    assert [r["id"] for r in memory.snippets_of(snippets, "b/c.py").collect()] == ["s1"]
    f = spark.createDataFrame([("/a/b/c.py", "l1\nl2\nl3")], "file_path string, content string")
    assert memory.with_code(snippets, f).filter("id = 's1'").first()["code"] == "   2 | l2\n   3 | l3"
    e = spark.createDataFrame([("r", None, "root", "f"), ("k", "r", "kid", "f")], "element_id string, parent_id string, name string, type string")
    assert [r["line"] for r in memory.rendered(memory.upsert_elements(e, e.limit(1))).orderBy("place").collect()][0] == "root"


def test_incremental_index(spark, tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    (root / "a.py").write_text("import b\nX = 1\n")
    (root / "b.py").write_text("import c\n")
    (root / "c.py").write_text("Y = 2\n")
    first = {k: spark.createDataFrame(v.collect(), v.schema) for k, v in maintenance.index_directory(spark, str(root)).items()}
    assert first["relationships"].count() == 2
    (root / "b.py").write_text("import a\n")
    (root / "c.py").unlink()
    (root / "d.py").write_text("import a, b\n")
    now = maintenance.index_directory(spark, str(root))
    tables, diff = maintenance.incremental_index(first, now["files"])
    got = lambda t, *c: sorted(tuple(r[x] for x in c) for r in t.collect())
    assert {r["file_path"].rsplit("/", 1)[-1]: r["change"] for r in diff.collect()} == {"a.py": "unchanged", "b.py": "changed", "c.py": "deleted", "d.py": "new"}
    for t, c in (("files", ("id", "content_hash")), ("code_blocks", ("file_id", "ordinal", "name")), ("relationships", ("source_id", "target_id"))):
        assert got(tables[t], *c) == got(now[t], *c)
    log = {r["file_path"].rsplit("/", 1)[-1]: r["change_type"] for r in maintenance.checkpoint_of(diff, first["files"], now["files"]).collect()}
    assert log == {"b.py": "modified", "c.py": "deleted", "d.py": "added"}


def test_connection_matches_are_those_of_brute_force(spark):
    rng = random.Random(3)
    tech = [None, "Unknown", "HTTP/HTTPS", "gRPC"]
    text = lambda n: " ".join(rng.choice("get post user order item cart list by id api v1 health".split()) for _ in range(n))
    out = [(k, rng.choice(tech), text(rng.randint(0, 5))) for k in range(40)] + [(2000, "gRPC", "POST /orders")]
    into = [(1000 + k, rng.choice(tech), text(rng.randint(0, 9))) for k in range(40)] + [(9000, "gRPC", "post, orders!")]
    df = lambda rows: spark.createDataFrame(rows, "id long, technology_name string, code_snippet string")
    want, first, real = {}, "HTTP/HTTPS", lambda t: None if t == "Unknown" else t
    for a, t, x in out:
        for b, u, y in into:
            xs, ys = ({w.strip(",!/") for w in z.lower().split()} for z in (x, y))
            if xs and len(xs & ys) / len(xs) >= 0.5 and (real(t) == real(u) or not real(t) or not real(u)):
                want[a, b] = (real(t) or real(u) or first, round(len(xs & ys) / len(xs), 6))
    got = {(r["sender_id"], r["receiver_id"]): (r["technology"], round(r["match_confidence"], 6)) for r in maintenance.content_matches(df(out), df(into)).collect()}
    assert got == want and (2000, 9000) in got
    assert maintenance.content_matches(df([(1, None, "a")]), df([(2, "Unknown", "a")])).count() == 0


def test_unknown_connections_meet_more_than_a_thousand_technologies(spark):
    out = spark.createDataFrame([(1, None)], "id long, technology_name string")
    into = spark.range(1_500).select(F.col("id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("technology_name"))
    assert maintenance.connection_matches(out, into, F.lit(1.0)).count() == 1_500


def test_search_scope_has_connections_and_all_importers(spark):
    f = spark.createDataFrame([(i, f"f{i}") for i in range(45)], "id long, file_path string")
    e = spark.createDataFrame([(i, 0) for i in range(1, 41)], "source_id long, target_id long")
    side = "id long, file_id long, technology_name string"
    out = spark.createDataFrame([(1, 42, "gRPC"), (2, 42, None), (3, 42, None), (4, 99, "gRPC")], side)
    into = spark.createDataFrame([(11, 43, "gRPC"), (12, 42, "WebSockets"), (13, 44, "gRPC"), (14, 44, "gRPC")], side)
    m = spark.createDataFrame([(7, 1, 11, 0.9), (8, 2, 12, 0.7), (9, 3, 13, 0.5), (10, 4, 14, 0.6)], "id long, sender_id long, receiver_id long, match_confidence double")
    got = graph.search_scope(e, f, out, into, m).collect()
    assert {r["file_id"] for r in got if (r["section"], r["anchor_id"]) == ("impact", 0)} == set(range(1, 41))
    ends = sorted((r["anchor_id"], r["file_id"], r["mapping_id"], r["impact_type"], r["technology"], r["file_path"]) for r in got if r["section"] == "connection_impacts")
    assert ends == [(42, 42, 8, "receives_from", "WebSockets", "f42"), (42, 43, 7, "sends_to", "gRPC", "f43"), (43, 42, 7, "receives_from", "gRPC", "f42"), (44, 99, 10, "receives_from", "gRPC", None)]


def test_block_paths_of_any_depth(spark):
    rows = [(i, i - 1 if i else None, f"b{i}") for i in range(101)] + [(200, 201, "x"), (201, 202, "y"), (202, 200, "z"), (203, 200, "in"), (300, 300, "self"), (400, 999, "lost")]
    got = {r["id"]: (r["ids"], r["path"]) for r in graph.block_paths(spark.createDataFrame(rows, "id long, parent_block_id long, name string")).collect()}
    assert all(got[i] == (list(range(i + 1)), " > ".join(f"b{k}" for k in range(i))) for i in range(101))
    assert got[200] == ([202, 201, 200], "z > y") and got[203][0] == [202, 201, 200, 203] and got[300] == ([300], "") and got[400] == ([400], "")
    tree = spark.createDataFrame([(f"{i:03}", f"{i - 1:03}" if i else None, f"e{i}", "f") for i in range(40)], "element_id string, parent_id string, name string, type string")
    assert [r["line"] for r in memory.rendered(tree).orderBy("place").collect()] == ["    " * i + f"e{i}" for i in range(40)]


def test_large_typescript_functions_refer_to_nested_ones():
    lines = "\n".join(f"    let v{i} = {i};" for i in range(300))
    inner = "    function small(a) { if (a) { return 'gone1'; } }\n    const arrow = async (x) => {\n      return () => { 'gone2'; };\n    };\n    run({ put(k) { return 'gone3'; } }, y => y + 1);\n    // function no() { }\n"
    for head, tail in (("function big(n) {", "}"), ("class C {\n  big(n) {", "  }\n}"), ("export const big = (n) => {", "};")):
        out = extract.typescript_blocks(f"{head}\n{lines}\n{inner}{tail}\nfunction after() {{ }}\n")
        big = next(i for i, b in enumerate(out) if b["name"] == "big" and b["type"] == "function")
        kids = {i: b for i, b in enumerate(out) if b["parent_ordinal"] == big}
        assert sorted(b["name"] for b in kids.values()) == ["anonymous", "anonymous", "arrow", "put", "small"]
        assert len([b for b in out if b["type"] == "function"]) == 7
        text = out[big]["content"]
        assert all((f"[BLOCK_REF:{i}]" in text) == (b["content"] != "y => y + 1") for i, b in kids.items()) and "gone" not in text
        assert "function small(a) {" in text and "y => y + 1" in text and "v299" in text and "".join(b["content"] for b in kids.values()).count("gone2") == 2
    assert [b["parent_ordinal"] for b in extract.typescript_blocks("function f() {\n  function g() { }\n}\n") if b["name"] == "g"] == [None]


def test_all_names_of_an_export():
    names = [f"n{i}" for i in range(20)]
    assert [b["name"] for b in extract.typescript_blocks(f"export {{ {', '.join(names)} }};\n") if b["type"] == "export"] == [", ".join(names)]


def test_memory_state_round_trip(spark, tmp_path):
    tables = {"tasks": spark.createDataFrame([(1, "a\nb", None), (2, None, True)], "id long, description string, done boolean"), "history": spark.createDataFrame([], "seq long, at timestamp")}
    memory.export_state(tables, str(tmp_path / "state"))
    back = memory.import_state(spark, str(tmp_path / "state"), ["tasks", "history"])
    assert all(back[n].schema == t.schema for n, t in tables.items())
    assert sorted(map(tuple, back["tasks"].collect())) == [(1, "a\nb", None), (2, None, True)] and back["history"].count() == 0


def test_fallback_tokens(spark):
    rows = spark.createDataFrame([(" one two\tone ",), ("",), (None,)], "t string").select(retrieval.fallback_tokens("t").alias("x")).collect()
    a = rows[0]["x"]
    assert len(a) == 3 and a[0] == a[2] != a[1] and all(0 <= x < 30_000 for x in a) and rows[1]["x"] == [] and rows[2]["x"] is None


def test_search_shows_chunks_of_long_blocks(spark):
    text = "\n".join(f"line {i}" for i in range(101, 181))  # lines 101 to 180 of the file
    vectors = spark.createDataFrame([("block_1", 1, 9, 0, 121, 123, [0.0]), ("block_2", 2, 9, 0, 5, 6, [1.0]), ("block_1", 3, 8, 0, 1, 2, [0.0])], "node_id string, vec_id long, project_id long, chunk_index long, chunk_start_line long, chunk_end_line long, embedding array<float>")
    blocks = spark.createDataFrame([(1, "big", text, 101, 180, 5, None), (2, "small", "one\ntwo", 5, 6, 5, 1)], "id long, name string, content string, start_line long, end_line long, file_id long, parent_block_id long")
    files_ = spark.createDataFrame([(5, "/a.py", "", 9)], "id long, file_path string, content string, project_id long")
    projects = spark.createDataFrame([(9, "p")], "id long, name string")
    out = {r["block_name"]: r for r in retrieval.semantic_search(vectors, blocks, files_, projects, [0.0], project_id=9).collect()}
    assert out["big"]["code"] == "line 121\nline 122\nline 123" and out["big"]["n_children"] == 1
    assert out["small"]["code"] == "one\ntwo" and out["small"]["parent_name"] == "big" and len(out) == 2


def test_block_tree(spark):
    rows = [(1, 1, None, 9), (2, 1, None, 3), (3, 1, 1, 12), (4, 1, 1, 10), (5, 1, 3, 13), (6, 1, 99, 1), (7, 1, 8, 1), (8, 1, 7, 1), (9, 2, None, 1), (10, 1, 1, 10)]
    blocks = spark.createDataFrame([(i, f, p, s, f"b{i}") for i, f, p, s in rows], "id long, file_id long, parent_block_id long, start_line long, name string")
    got = {r["id"]: (r["depth"], r["position"]) for r in graph.block_tree(blocks).collect()}
    assert got == {1: (1, 2), 2: (1, 1), 3: (2, 3), 4: (2, 1), 10: (2, 2), 5: (3, 1), 9: (1, 1)}
    assert graph.block_tree(blocks.limit(0)).count() == 0


def test_parent_project(spark):
    held = [(1, "/r/a/x.py"), (1, "/r/a/b/y.py"), (2, "/r/a/b/c/z.py"), (2, "/r/a/b/c/d/w.py"), (3, "loose.py"), (3, "/other.py")]
    files = spark.createDataFrame(held, "project_id long, file_path string")
    projects = spark.createDataFrame([(1, "outer"), (2, "inner"), (3, "rootless"), (4, "empty")], "id long, name string")
    wanted = {"/r/a": "outer", "/r/a/b": "outer", "/r/a/b/c": "inner", "/r/a/b/c/n": "inner", "/r/ab": None, "/r": None}
    paths = spark.createDataFrame([(p,) for p in wanted], "path string")
    assert {r["path"]: r["project"] for r in graph.parent_project(paths, files, projects).collect()} == wanted


def test_delivery_cursors(spark):
    shape = "session string, signature string, position long, total long, complete boolean"
    cursors = spark.createDataFrame([("done", "q", 2, 2, True), ("half", "q", 1, 2, False), ("grown", "q", 1, 2, False), ("other", "q", 1, 2, False), ("idle", "q", 2, 2, True)], shape)
    asked = spark.createDataFrame([("done", "q", 5), ("half", "q", 2), ("grown", "q", 3), ("other", "p", 1), ("new", "q", 1), ("none", "q", 0)], "session string, signature string, total long")
    opened = delivery.register(cursors, asked)
    rows = lambda df: {r["session"]: tuple(r)[1:] for r in df.collect()}
    assert rows(opened) == {
        "done": ("q", 0, 2, False), "half": ("q", 1, 2, False), "grown": ("q", 0, 3, False), "other": ("p", 0, 1, False),
        "idle": ("q", 2, 2, True), "new": ("q", 0, 1, False), "none": ("q", 0, 0, False),
    }
    assert rows(delivery.advance(opened)) == {
        "done": ("q", 0, 1, 2, False), "half": ("q", 1, 2, 2, True), "grown": ("q", 0, 1, 3, False), "other": ("p", 0, 1, 1, True),
        "idle": ("q", None, 2, 2, True), "new": ("q", 0, 1, 1, True), "none": ("q", None, 0, 0, False),
    }
    assert set(rows(delivery.clear(opened, asked))) == {"idle"}


def test_search_requests_and_pages(spark):
    assert files.search_params("  ") is None
    got = files.search_params(" a b ", count=50, offset=-1, period="week", result_filter=["web", "news"], search_lang="en", goggles_id=None, spellcheck=False)
    wanted = {"q": "a b", "count": "20", "offset": "0", "safesearch": "moderate", "tf": "pw", "result_filter": "web,news", "search_lang": "en", "spellcheck": "0"}
    assert got == wanted | {"country": "US", "units": "metric", "extra_snippets": "0"}
    ranks = spark.range(45).select(F.col("id").alias("rank"))
    at = lambda **k: sorted(r["rank"] for r in files.results_page(ranks, **k).collect())
    assert (at(), at(count=99, offset=2), at(count=0), at(offset=5)) == (list(range(10)), list(range(40, 45)), [0], [])


def test_stamps(spark):
    rows = store.stamped(spark.range(3), "at", "2024-01-02 03:04:05")
    assert {str(r["at"]) for r in rows.collect()} == {"2024-01-02 03:04:05"}
    assert store.stamped(spark.range(50), "at").select("at").distinct().count() == 1


def test_pages_of_a_whole_table(spark):
    df = spark.range(1000, numPartitions=7).select(F.floor(F.col("id") * 37 % 1000 / 2).alias("i"), F.col("id").alias("j"))
    rows = sorted((r["i"], r["j"], r["page"], r["pages"]) for r in delivery.by_count(df, 30, "i", "j").collect())
    assert [r[2] for r in rows] == [k // 30 for k in range(1000)] and {r[3] for r in rows} == {34}
    assert delivery.by_count(df.limit(0), 30, "i").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_packing_is_that_of_brute_force(spark, seed):
    rnd = random.Random(seed)
    rows = [(rnd.choice(["a", "b", None]), i, rnd.choice([0, 1, 5, 30, 99, None])) for i in range(200)]
    wanted = []
    for key in ("a", "b", None):
        batch = used = 0
        for k, i, n in rows:
            if k == key:
                batch, used = (batch + 1, n or 0) if used and used + (n or 0) > 50 else (batch, used + (n or 0))
                wanted.append((str(k), i, n, batch))
    got = packing.packed(spark.createDataFrame(rows, "k string, i long, n long"), "k", ["i"], "n", 50)
    assert sorted((str(r["k"]), r["i"], r["n"], r["batch"]) for r in got.collect()) == sorted(wanted, key=lambda r: r[:2])


def test_null_digests(spark):
    old = spark.createDataFrame([("a", None), ("b", None), ("c", "x")], "file_path string, content_hash string")
    new = spark.createDataFrame([("a", None), ("b", "y"), ("c", None)], "file_path string, content_hash string")
    assert {r["file_path"]: r["change"] for r in changes.snapshot_changes(new, old).collect()} == {"a": "unchanged", "b": "changed", "c": "changed"}


def folded(rows, limit):
    """Batches of (key, size, more) in order, row by row."""
    out, last = [], object()
    for k, n, more in rows:
        if k != last:
            batch = used = 0
            last = k
        if used and used + more > limit:
            batch, used = batch + 1, n
        else:
            used += more
        out.append(batch)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.sampled_from([0, 0, 1, 2, 7, 30]), st.floats(0, 1)), max_size=40), st.integers(1, 12), st.integers(1, 9))
def test_blocks_composed_are_the_fold(rows, limit, block):
    rows = sorted((k, n, int(n * share)) for k, n, share in rows)
    opens = [i == 0 or rows[i][0] != rows[i - 1][0] for i in range(len(rows))]
    rows = [(k, n, n if o else m) for (k, n, m), o in zip(rows, opens)]
    parts = []
    for i in range(0, len(rows), block):
        cut = rows[i : i + block]
        parts.append(packing.Successors.of(np.array([r[1] for r in cut]), np.array([r[2] for r in cut]), np.array(opens[i : i + block]), limit))
    used = batch = 0
    got = []
    for p in parts:
        got += p.batches(used, batch).tolist()
        to, begun, anew = p.table()
        used, batch = int(to[used]), int(begun[used]) + (0 if anew[used] else batch)
    assert got == folded(rows, limit)
    if len(parts) > 1:
        whole = packing.composed([p.table() for p in parts])
        assert int(whole[0][0]) == used and int(whole[1][0]) == batch


def test_packing_of_one_hot_key_in_many_blocks(spark):
    rnd = random.Random(8)
    rows = [("hot", i, rnd.choice([0, 1, 3, 20, 90, 400])) for i in range(100_000)] + [("b", 0, 500), ("c", 0, 0), ("c", 1, 7)]
    df = spark.createDataFrame(rows, "k string, i long, n long").repartition(6)
    got = sorted((r["k"], r["i"], r["batch"]) for r in packing.packed(df, "k", ["i"], "n", 300, block=1000).collect())
    rows.sort()
    assert [b for *_, b in got] == folded([(k, n, n) for k, _, n in rows], 300)


def test_packing_with_overlap_across_partitions(spark):
    rnd = random.Random(9)
    spans = sorted((p, f, a, a + rnd.choice([0, 3, 40, 300]), i) for i, (p, f, a) in enumerate((rnd.choice([1, 1, 1, 2]), rnd.choice([5, 5, 5, 6]), rnd.randint(1, 900)) for _ in range(3000)))
    rows, end, file = [], 0, None
    for p, f, a, b, _ in spans:
        end = end if (p, f) == file else 0
        rows.append((p, b - a + 1, b - a + 1 - max(0, min(b, end) - a + 1)))
        file, end = (p, f), max(b, end)
    df = spark.createDataFrame([(p, i, f, a, b) for p, f, a, b, i in spans], "project_id long, id long, file_id long, start_line long, end_line long").repartition(5)
    got = sorted((r["project_id"], r["file_id"], r["start_line"], r["end_line"], r["id"], r["batch"]) for r in packing.packed_with_overlap(df, 500, block=200).collect())
    assert [r[-1] for r in got] == folded(rows, 500)


# --- walks, paths, ranges and windows of lines


def brute_ways(edges, names, depth, limit):
    out = {}
    for a in names:
        level, rows = [((a,), names[a])], []
        for d in range(1, depth + 1):
            level = [((*way, t), f"{path} -> {names[t]}") for way, path in level for s, t in edges if s == way[-1] and t in names and t not in way]
            rows += sorted((d, names[way[-1]], path, way[-1]) for way, path in level)
        out[a] = rows[:limit]
    return out


def test_chains_are_pruned_without_loss(spark):
    rnd = random.Random(2)
    names = {i: f"/f{i * 37 % 101:03}" for i in range(14)}
    edges = {(rnd.randrange(14), rnd.randrange(15)) for _ in range(70)} | {(i, 0) for i in range(14)} | {(0, i) for i in range(14)}
    e = spark.createDataFrame(sorted(edges), "source_id long, target_id long")
    f = spark.createDataFrame(sorted(names.items()), "id long, file_path string")
    want = brute_ways(edges, names, 4, 7)
    got = {}
    for r in graph.dependency_chain(e, f, depth=4, limit=7).collect():
        got.setdefault(r["anchor_id"], []).append((r["depth"], r["file_path"], r["path"], r["file_id"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}
    near = {}
    for a in names:
        seen, front = {a: 0}, {a}
        for d in (1, 2, 3):
            front = {t for s, t in edges if s in front and t in names} - set(seen)
            seen |= dict.fromkeys(front, d)
        near |= {(a, t): d for t, d in seen.items() if d}
    assert {(r["anchor_id"], r["file_id"]): r["depth"] for r in graph.reachable(e, f, 3).collect()} == near


def test_a_hub_makes_one_row_for_each_pair(spark):
    n = 400
    edges = [(i, 0) for i in range(1, n)] + [(0, i) for i in range(1, n)]
    e = spark.createDataFrame(edges, "source_id long, target_id long")
    f = spark.createDataFrame([(i, f"/{i:04}") for i in range(n)], "id long, file_path string")
    assert graph.reachable(e, f, 2).count() == n * (n - 1)
    chain = graph.dependency_chain(e, f, depth=5)
    assert chain.count() == 25 * n and chain.filter("anchor_id = 7").agg(F.max("depth")).first()[0] == 2


def test_equal_base_names_meet_only_their_suffixes(spark):
    files_ = spark.createDataFrame([(i, f"/src/d{i}/e/index.ts") for i in range(2000)] + [(5000, "index.ts"), (5001, "//odd/index.ts")], "id long, file_path string")
    paths = ["d7/e/index.ts", "/src/d9/e/index.ts", "index.ts", "/index.ts", "7/e/index.ts", "odd/index.ts", "none/index.ts"]
    wanted = spark.createDataFrame([(p,) for p in paths] * 2, "path string")
    got = {r["path"]: r["file_id"] for r in graph.resolve_paths(wanted, files_).collect()}
    assert got == {"d7/e/index.ts": 7, "/src/d9/e/index.ts": 9, "index.ts": 5000, "/index.ts": 5001, "7/e/index.ts": None, "odd/index.ts": 5001, "none/index.ts": None}
    index = graph.suffixes(files_, "file_path", spark.createDataFrame([(3,)], "n int"))
    assert index.filter("suffix = 'd7/e/index.ts'").count() == 1 and index.count() == 2000


def test_windows_of_files(spark):
    f = spark.createDataFrame([(1, "/a/x.py", "1\n2\n3\n4"), (2, "/a/y.py", "")], "id long, file_path string, content string")
    ends = "id long, file_id long, start_line int, end_line int"
    out, inc = spark.createDataFrame([(1, 1, 1, 2)], ends), spark.createDataFrame([(1, 1, 4, 4), (2, 2, None, None)], ends)
    maps = spark.createDataFrame([(10, 1, 1), (11, 1, 2)], "id long, sender_id long, receiver_id long")
    asked = [("x.py", 2, 3), ("x.py", 9, None), ("x.py", 3, 1), ("x.py", None, None), ("a/y.py", 1, 5), ("z.py", 1, 1), ("/a/x.py", -3, 2)]
    got = graph.file_windows(spark.createDataFrame(asked, "path string, start_line int, end_line int"), f, out, inc, maps).collect()
    assert {(r["path"], r["start_line"], r["end_line"]): (r["content"], r["mappings"]) for r in got} == {
        ("x.py", 2, 3): ("2\n3", [10, 11]), ("x.py", 9, 4): ("4", []), ("x.py", 3, 1): ("3", []), ("x.py", None, None): ("1\n2\n3\n4", [10, 11]), ("a/y.py", 1, 5): ("", [11]), ("/a/x.py", -3, 2): ("1\n2", [10, 11]),
    }


def test_unmapped_connections_of_both_directions(spark):
    rows = [("incoming", 1, 7, 8), ("incoming", 2, 7, 9), ("incoming", 3, 7, None), ("outgoing", 4, 7, 8), ("outgoing", 5, 8, 7), ("incoming", 6, 5, 5), ("outgoing", 7, 5, 5)]
    c = spark.createDataFrame(rows, "direction string, id long, file_id long, other_file_id long")
    m = spark.createDataFrame([(8, 7), (5, 5), (None, 7)], "sender_file long, receiver_file long")
    assert sorted(r["id"] for r in graph.unmapped(c, m).collect()) == [2, 3, 4, 7]


@pytest.mark.parametrize("seed", range(3))
def test_range_joins_are_those_of_brute_force(spark, seed):
    rnd = random.Random(seed)
    span = lambda: (a := rnd.choice([0, 1, rnd.randrange(500), rnd.randrange(100_000)]), a + rnd.choice([-1, 0, 3, 64, 5000]))
    left, right = ([(rnd.randrange(2), i, *span()) for i in range(80)] for _ in range(2))
    points = [(rnd.randrange(3), rnd.choice([rnd.randrange(600), rnd.randrange(110_000)])) for _ in range(300)] + [(0, None)]
    a = spark.createDataFrame(left + [(0, 900, None, 5)], "file_id long, id long, start_line long, end_line long")
    b = spark.createDataFrame(right, "file_id long, rid long, r_start long, r_end long")
    got = sorted((r["id"], r["rid"]) for r in intervals.overlapping(a, b).select("id", "rid").collect())
    assert got == sorted((x[1], y[1]) for x in left for y in right if x[0] == y[0] and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3])
    outside = intervals.lines_outside(spark.createDataFrame(points, "file_id long, line long"), a).collect()
    assert sorted(map(repr, map(tuple, outside))) == sorted(repr(p) for p in points if p[1] is None or not any(f == p[0] and s <= p[1] <= e for f, _, s, e in left))
    moves = [(rnd.randrange(2), rnd.randrange(3000), rnd.choice(["insert", "delete", "modified"])) for _ in range(300)]
    moved = intervals.shift_ranges(a.filter("id < 900"), spark.createDataFrame(moves, "file_id long, line long, kind string")).collect()
    by = {"insert": 1, "delete": -1, "modified": 0}
    want = {(i, s + sum(by[k] for g, x, k in moves if g == f and x < s), e + sum(by[k] for g, x, k in moves if g == f and x <= e)) for f, i, s, e in left}
    assert {(r["id"], r["new_start"], r["new_end"]) for r in moved} == want


def test_one_file_with_many_ranges_and_lines(spark):
    n = 100_000
    ranges = spark.range(n).select(F.lit(1).alias("file_id"), (F.col("id") * 3).alias("start_line"), (F.col("id") * 3 + F.when(F.col("id") == 5, 200_000).otherwise(1)).alias("end_line"))
    lines = spark.range(3 * n).select(F.lit(1).alias("file_id"), F.col("id").alias("line"))
    assert intervals.lines_outside(lines, ranges).count() == sum(1 for x in range(3 * n) if x % 3 == 2 and not 15 <= x <= 200_015)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc "), max_size=8), st.lists(st.sampled_from("abcd "), max_size=40))
def test_votes_find_the_best_window(want, have):
    from lattica.functions.text import best_window

    n = len(want)
    scores = [sum(a == b for a, b in zip(want, have[i : i + n])) / n for i in range(len(have) - n + 1)] if n else []
    assert best_window(want, have) == ((max(scores), scores.index(max(scores))) if scores else None)


def test_votes_are_quick_on_long_files():
    import time

    from lattica.functions.text import best_window

    rnd = random.Random(1)
    have = [rnd.choice(["", "}", f"line {i}"]) for i in range(100_000)]
    want = [x if i % 5 else "changed" for i, x in enumerate(have[70_000:71_000])]
    began = time.perf_counter()
    best = best_window(want, have)
    assert best[1] == 70_000 and best[0] >= 0.8 and time.perf_counter() - began < 3
    assert diffs.relocate("\n".join(want), 1, 1000, "\n".join(have))["start"] == 70_001


# --- snippets, commits, traced elements


def brute_ingest(memory, rows):
    held = [[i, p, a, b] for i, p, a, b in memory]
    out = []
    for seq, p, a, b in rows:
        if None in (p, a, b) or a > b:
            continue
        hit = next((x for x in held if x[1] == p and not (b < x[2] or a > x[3])), None)
        if hit is None:
            held.append([-seq, p, a, b])
            out.append((seq, "add", -seq))
        elif hit[2:] == [a, b]:
            out.append((seq, "skip", hit[0]))
        else:
            hit[2], hit[3] = min(hit[2], a), max(hit[3], b)
            out.append((seq, "expand", hit[0]))
    ends = {x[0]: (x[2], x[3]) for x in held}
    return [(*x, *ends[x[2]]) for x in out]


@pytest.mark.parametrize("seed", range(4))
def test_snippets_are_taken_in_like_a_fold(spark, seed):
    rnd = random.Random(seed)
    span = lambda: (a := rnd.randrange(1, 120), a + rnd.choice([-1, 0, 2, 9, 40] if rnd.random() < 0.9 else [300]))
    path = lambda: rnd.choice(["a.py", "a.py", "a.py", "b.py"])
    memory = [(i, path(), *s) for i in range(1, 25) if (s := span())[0] <= s[1]]
    rows = [(i, path(), *span()) for i in range(1, 150)] + [(990, None, 1, 2), (991, "a.py", None, 2), (992, "a.py", 3, None)]
    m = spark.createDataFrame(memory, "id long, file_path string, start_line long, end_line long")
    r = spark.createDataFrame(rows, "seq long, file_path string, start_line long, end_line long").repartition(5)
    got = sorted((x["seq"], x["action"], x["snippet"], x["snippet_start"], x["snippet_end"]) for x in snippets.ingested(m, r).collect())
    assert got == brute_ingest(memory, rows)


def test_ranges_of_a_long_file_take_n_log_n():
    import time

    rnd = random.Random(3)
    spans = [(a, a + rnd.randrange(40)) for a in (rnd.randrange(1, 2_000_000) for _ in range(60_000))]
    began = time.perf_counter()
    ranges = snippets.Ranges()
    for a, b in spans:
        ranges.add(a, b)
    assert time.perf_counter() - began < 10 and len(ranges.spans) > 10_000


def test_memory_takes_in_and_refreshes_snippets(spark):
    text = "\n".join(f"l{i}" for i in range(1, 31))
    f = spark.createDataFrame([("a.py", text), ("b.py", "x\ny")], "file_path string, content string")
    memory = spark.createDataFrame([(4, "a.py", 3, 5, "old", "?")], "id long, file_path string, start_line long, end_line long, description string, code string")
    rows = spark.createDataFrame([(1, "a.py", 5, 7, "grows"), (2, "b.py", 1, 2, "new"), (3, "a.py", 20, 21, None), (4, "a.py", 12, 12, "more")], "seq long, file_path string, start_line long, end_line long, description string")
    got = {r["id"]: (r["file_path"], r["start_line"], r["end_line"], r["description"], r["code"]) for r in snippets.ingest(memory, rows, f).collect()}
    assert {k: v[:4] for k, v in got.items()} == {4: ("a.py", 3, 7, "old"), 5: ("b.py", 1, 2, "new"), 6: ("a.py", 12, 12, "more")}
    assert got[5][4].split("\n")[0].endswith("| x") and len(got[4][4].split("\n")) == 5
    after = spark.createDataFrame([("a.py", "new\n" + text)], "file_path string, content string")
    told = {r["id"]: (r["start_line"], r["end_line"], r["action"]) for r in snippets.refreshed(snippets.ingest(memory, rows, f), after, spark.createDataFrame([("a.py",), ("b.py",)], "file_path string")).collect()}
    assert told == {4: (4, 8, "move"), 6: (13, 13, "move"), 5: (1, 2, "remove")}


def test_tables_change_as_one_or_not_at_all(spark, tmp_path, monkeypatch):
    s = store.ParquetStore(spark, str(tmp_path / "db"))
    s.create()
    a = spark.createDataFrame([(1, "x")], "id long, name string")
    bad = a.withColumn("name", F.raise_error(F.lit("lost")))
    s.commit({"p": a, "q": a})
    with pytest.raises(Exception):
        s.commit({"p": a.unionAll(a), "q": bad})  # the second write fails
    assert s.read("p").count() == 1 and s.read("q").count() == 1
    monkeypatch.setattr(s, "_publish", lambda m: (_ for _ in ()).throw(RuntimeError("lost before the rename")))
    with pytest.raises(RuntimeError):
        s.commit({"p": a.unionAll(a), "q": a.unionAll(a)})
    monkeypatch.undo()
    assert s.read("p").count() == 1 and s.commit({"p": a.unionAll(a)}) == 3
    assert s.read("p").count() == 2 and s.read("p", 2).count() == 1
    with pytest.raises(RuntimeError):
        s._publish({"number": 3, "tables": {}, "batches": {}})  # another writer was faster
    assert s.read("p").count() == 2 and s.read("files").count() == 0


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    s = store.ParquetStore(spark, str(tmp_path / "db"))
    rows = spark.createDataFrame([(1,), (2,)], "id long")
    assert [s.commit({"t": rows}, "log", 0), s.commit({"t": rows.unionAll(rows)}, "log", 0), s.commit({"t": rows.unionAll(rows)}, "log", 1)] == [1, 1, 2]
    src = str(tmp_path / "src")
    rows.write.parquet(src)
    add = lambda tables, batch: {"t": tables["t"].unionByName(batch)}
    for checkpoint in ("a", "b"):  # a lost checkpoint repeats batch 0
        s.follow(spark.readStream.schema("id long").parquet(src), "feed", add, ["t"], str(tmp_path / checkpoint))
    assert s.read("t").count() == 6 and s.manifest()["batches"] == {"log": 1, "feed": 0}


@pytest.mark.parametrize("seed", range(2))
def test_ways_are_put_into_the_tree(spark, seed):
    rnd = random.Random(seed)
    tree = [(1, None, "root", "f"), (2, 1, "a", "f"), (10, 2, "b", "v")]
    ways = [[(rnd.choice(["root", "top"]), "f")] + [(rnd.choice("abc"), rnd.choice("fv")) for _ in range(rnd.randrange(4))] for _ in range(30)] + [[], [("root", "f"), (None, "f"), ("x", "f")]]
    got = memory.insert_paths(
        spark.createDataFrame(tree, "element_id long, parent_id long, name string, type string"),
        spark.createDataFrame([(i, w) for i, w in enumerate(ways)], "path_id long, path array<struct<name:string,type:string>>"),
    ).collect()
    ids = [r["element_id"] for r in got]
    assert len(set(ids)) == len(ids) and {tuple(r) for r in got} >= set(tree)
    by = {r["element_id"]: r for r in got}
    way = lambda i: [] if i is None else [*way(by[i]["parent_id"]), (by[i]["name"], by[i]["type"])]
    found = sorted(tuple(way(i)) for i in by)
    want = {tuple(w[: k + 1]) for w in ways for k in range(len(w)) if all(x[0] for x in w[: k + 1])} | {tuple(w) for w in ([("root", "f")], [("root", "f"), ("a", "f")], [("root", "f"), ("a", "f"), ("b", "v")])}
    assert found == sorted(want)


def test_siblings_stand_in_the_order_of_numbers(spark):
    e = spark.createDataFrame([("1", None, "root"), ("10", "1", "ten"), ("2", "1", "two"), ("s9", "2", "nine"), ("s11", "2", "eleven")], "element_id string, parent_id string, name string")
    assert [r["line"].strip() for r in memory.rendered(e).orderBy("place").collect()] == ["root", "two", "nine", "eleven", "ten"]


def test_increments_of_projects_with_equal_paths(spark, tmp_path):
    for p in ("one", "two"):
        (tmp_path / p).mkdir()
        (tmp_path / p / "m.py").write_text(f"def {p}():\n    return 1\n")
    index = lambda: [maintenance.index_directory(spark, str(tmp_path / p), i) for i, p in ((1, "one"), (2, "two"))]
    both = lambda t: {k: t[0][k].unionByName(t[1][k]) for k in t[0]}
    rel = lambda t: {**t, "files": t["files"].withColumn("file_path", F.lit("m.py")).withColumn("id", F.col("project_id"))}
    first = rel(both(index()))
    now = first["files"].withColumn("content", F.when(F.col("project_id") == 2, F.lit("def changed():\n    return 2\n")).otherwise(F.col("content"))).withColumn("content_hash", F.sha2("content", 256))
    tables, diff = maintenance.incremental_index({**first, "code_blocks": first["code_blocks"].limit(0), "relationships": first["relationships"].limit(0)}, now)
    assert {(r["project_id"], r["change"]) for r in diff.collect()} == {(1, "unchanged"), (2, "changed")}
    assert tables["files"].count() == 2 and {r["name"] for r in tables["code_blocks"].collect()} == {"changed"}


def test_scope_of_a_wanted_path(spark):
    f = spark.createDataFrame([(1, "/r/a.py"), (2, "/r/b.py"), (3, "/r/c.py")], "id long, file_path string")
    e = spark.createDataFrame([(1, 2), (2, 3)], "source_id long, target_id long")
    side = spark.createDataFrame([], "id long, file_id long, technology_name string")
    maps = spark.createDataFrame([], "id long, sender_id long, receiver_id long, match_confidence double")
    got = graph.scope_of_paths(spark.createDataFrame([("b.py",), ("none.py",)], "path string"), e, f, side, side, maps, depth=3).collect()
    assert sorted((r["path"], r["section"], r["file_path"]) for r in got) == [("b.py", "dependency_chain", "/r/c.py"), ("b.py", "impact", "/r/a.py"), ("b.py", "importers", "/r/a.py"), ("b.py", "imports", "/r/c.py")]


def test_an_increment_is_one_commit(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.py").write_text("def one():\n    return 1\n")
    s = store.ParquetStore(spark, str(tmp_path / "db"))
    s.commit(maintenance.index_directory(spark, str(tmp_path / "p"), 1))
    (tmp_path / "p" / "a.py").write_text("def two():\n    return 2\n")
    assert maintenance.apply_increment(s, maintenance.index_directory(spark, str(tmp_path / "p"), 1)["files"]) == 2
    assert [r["name"] for r in s.read("code_blocks").collect()] == ["two"] and s.read("files").count() == 1
    assert [r["name"] for r in s.read("code_blocks", 1).collect()] == ["one"]


TS_HARD = r"""const brace = /[{]/g;
const nested = `${b ? `{` : '' }` , tail = `a ${ {x: 1}.x } } {`;
let a = 1, b = 2, c: Map<string, number> = new Map<string, number>(), d = a < b, e = [1, { f: 2 }];
const { p: { q, r = 1 }, ...s } = make<A, B>(1), last = a / b / 2;
const half = total / 2; const text = "import x from 'not'"; // import y from './no'
const say = <div>don't {half} </div>;
const chain = items
  .map(x => x + 1)
  .filter(Boolean)
const obj = {
  k: 1,
}
@Component({ selector: 'app', f: (x) => { return 1; } })
export class Box<T> extends Base {
  @Input() name: string = 'n';
  @Input({ alias: 'w' })
  width = 3
  #secret = 1;
  private readonly list: { id: number }[] = [];
  ['computed'] = 2;
  onClick = (e) => { this.#secret++; };
  static { init(); }
  constructor(private http: Http) { super(); }
  @HostListener('click', ['$event'])
  handle(e = { a: 1 }): { ok: boolean } { return { ok: /}/.test(e) }; }
  get size() { return 1 }
  abstract area(): number;
  async *walk<U>(x: U): AsyncGenerator<U> { yield x }
  end
}
function after() { return `}`; }
var regexAfterReturn = function () { return /"/.test(x); }, z = 1;
"""


def test_typescript_lexer():
    """Braces and quotes in regexes, templates and tags are no code; every declarator and member is told."""
    out = extract.typescript_blocks(TS_HARD)
    names = lambda kind, top=True: [b["name"] for b in out if b["type"] == kind and (b["parent_ordinal"] is None) == top]
    assert names("variable") == ["brace", "nested", "tail", "a", "b", "c", "d", "e", "q", "r", "s", "last", "half", "text", "say", "chain", "obj", "regexAfterReturn", "z"]
    assert names("variable", False) == ["name", "width", "#secret", "list", "['computed']", "end"]
    assert names("function", False) == ["onClick", "constructor", "handle", "size", "area", "walk"] and names("function") == ["after"]
    assert names("class") == ["Box"] and names("import") == []
    by = {b["name"]: b["content"] for b in out}
    assert by["chain"].endswith(".filter(Boolean)") and by["obj"].endswith("}") and by["a"] == by["e"] and by["s"].endswith("/ 2;")
    assert by["handle"].startswith("handle(e") and by["handle"].endswith("}; }") and by["width"] == "@Input({ alias: 'w' })\n  width = 3"
    assert extract.typescript_imports(TS_HARD) == []


def test_typescript_import_forms():
    text = "import a, { b as c } from './m'\nexport { d }\nimport type { E } from \"e\"\nimport './side';\nconst { f, g } = require('fs');\nh = await import('./dyn')\nexport * from './all';\ns = `${require('t')}`; // import z from 'no'\n"
    got = [(i["module"], i["symbols"], i["level"]) for i in extract.typescript_imports(text)]
    assert got == [("./m", ["a", "b", "c"], 1), ("e", ["E"], 0), ("./side", [], 1), ("fs", ["f", "g"], 0), ("./dyn", ["h"], 1), ("./all", [], 1), ("t", [], 0)]
    assert extract.typescript_imports(text)[3]["content"].startswith("const { f, g } = require('fs'")


def test_typescript_time_is_linear():
    """Twice the text, about twice the time; long comments, unions and runs of blanks included."""
    import time

    unit = "export class K {\n  a = 1;\n  m(x) { if (x) { return `${x}`; } }\n}\nconst v = [1, 2]\nexport /* " + "c" * 300 + " */ type U =\n  | 'x'\n  | 'y';\n"
    took = []
    for n in (500, 2000):
        at = time.process_time()
        assert len(extract.typescript_blocks(unit * n)) >= 4 * n
        extract.typescript_imports(unit * n)
        took.append(time.process_time() - at)
    assert took[1] < 10 * max(took[0], 0.05)
    extract.typescript_imports("export /*" + " " * 300_000 + "*/ = require('x')")


def brute_memory(events):
    """The memory of an ordered log, folded with plain dictionaries and nested trees."""
    tasks, codes, history, n, m = {}, {}, [], 0, 0
    for e in events:
        op, status, c = e["op"], (e["status"] or "").lower(), codes.get(e["id"])
        current = [t for t in tasks if tasks[t]["status"] == "current"]
        if op == "history" and e["text"]:
            history = (history + [(e["seq"], e["text"])])[-30:]
        elif op == "add_task" and e["text"] and (status or "pending") in memory.STATUS:
            n += 1
            if not (status == "current" and current):
                tasks[str(n)] = {"text": e["text"], "status": status or "pending"}
        elif op == "move_task" and e["id"] in tasks and status in memory.STATUS:
            if status == "current" and current:
                tasks[current[0]]["status"] = "pending"
            tasks[e["id"]]["status"] = status
        elif op == "remove_task":
            tasks.pop(e["id"], None)
        elif op == "add_code" and e["file_path"] and e["text"] and None not in (e["start_line"], e["end_line"]):
            m += 1
            codes[str(m)] = {"file_path": e["file_path"], "start_line": e["start_line"], "end_line": e["end_line"], "text": e["text"], "is_traced": bool(e["is_traced"]), "summary": None, "needs": [], "elements": [{"id": x["id"], "name": x["name"], "type": x["type"], "parent": None} for x in e["elements"] or []]}
        elif op == "remove_code":
            codes.pop(e["id"], None)
        elif c and op == "set_traced":
            c["is_traced"] = bool(e["is_traced"])
        elif c and op == "set_summary" and e["text"]:
            c["summary"] = e["text"]
        elif c and op == "add_needs_tracing" and e["elements"]:
            c["needs"] = c["needs"] + [{"id": x["id"], "name": x["name"], "type": x["type"]} for x in e["elements"]]
        elif c and op == "move_to_traced" and e["elements"]:
            x = e["elements"][0]
            there = [y["id"] for y in c["elements"]]
            if x["id"] in there:
                c["needs"] = [y for y in c["needs"] if not (e["source_id"] and y["id"] == e["source_id"])]
                continue
            c["needs"] = [y for y in c["needs"] if not (y["id"] == e["source_id"] if e["source_id"] else (y["name"], y["type"]) == (x["name"], x["type"]))]
            path = e["path"] or []
            roots = [y["id"] for y in c["elements"] if y["parent"] is None]
            if path and path[0] not in roots:
                continue
            at = path[0] if path else None
            for step in path[1:]:
                kids = [y["id"] for y in c["elements"] if y["parent"] == at]
                if kids and step in kids:
                    at = step
                elif kids:
                    at = path[0]
                    break
            c["elements"] = c["elements"] + [{"id": x["id"], "name": x["name"], "type": x["type"], "parent": at}]
    return {("task", k): v for k, v in tasks.items()} | {("code", k): v for k, v in codes.items()} | {("history", str(s)): {"text": t} for s, t in history}


def test_memory_log_as_a_stream(spark, tmp_path):
    """The stream's memories equal a plain fold of random logs, over several triggers, with a part of the log sent twice."""
    rng = random.Random(8)
    ops = ["history", "add_task", "move_task", "remove_task", "add_code", "add_code", "remove_code", "set_traced", "set_summary", "add_needs_tracing", "move_to_traced", "move_to_traced", "move_to_traced", "nonsense"]
    pick = lambda *xs: rng.choice(xs)
    log = []
    for seq in range(1500):
        op = rng.choice(ops)
        elements = [{"id": f"x{rng.randint(0, 9)}", "name": pick("f", "g"), "type": pick("function", "class"), "start_line": 1, "end_line": 2, "up": None}] if rng.random() < 0.9 else None
        top = 4 if "code" not in op and "task" in op else 6
        log.append({
            "memory_id": pick("a", "a", "b"), "seq": seq, "op": op, "id": pick(None, *map(str, range(1, top * 6))), "text": pick("t", "u", "", None, "v"), "status": pick("pending", "CURRENT", "completed", None, "odd"),
            "file_path": pick("p.py", "q.ts", None, "r"), "start_line": pick(1, 5, None, 2), "end_line": pick(6, 7), "is_traced": pick(True, False, None), "elements": elements,
            "path": pick(None, [], ["x1"], ["x1", "x2"], ["x3", "x4", "x5"], ["x2"], ["x5", "x6"]), "source_id": pick(None, "x1", "x7"),
        })
    df = spark.createDataFrame(log, memory_log.EVENTS).coalesce(1)
    source, at = str(tmp_path / "log"), str(tmp_path / "out")
    df.filter("seq < 500").write.mode("append").parquet(source)
    stream = spark.readStream.schema(memory_log.EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
    memory_log.run(stream, at)
    df.filter("seq >= 500 AND seq < 900").write.mode("append").parquet(source)
    df.filter("seq >= 400 AND seq < 900").write.mode("append").parquet(source)
    df.filter("seq >= 900").write.mode("append").parquet(source)
    out = memory_log.run(stream, at)
    got = {(r["memory_id"], r["kind"], r["id"]): json.loads(r["value"]) for r in memory_log.latest(out).collect()}
    want = {(m, *k): v for m in "ab" for k, v in brute_memory([e for e in log if e["memory_id"] == m]).items()}
    assert got == want and sum(len(v.get("elements", [])) for v in want.values()) > 20
    assert out.filter("kind = 'result'").count() == len(log)


def test_elements_get_ids_and_keep_their_trees():
    e = lambda name, up=None, own=None: {"id": own, "name": name, "type": "f", "start_line": 1, "end_line": 2, "up": up}
    tree = memory_log.placed([], memory_log.flat([e("a"), e("b", 0), e("c", 1)], "p"), [])
    assert [x["name"] for x in tree] == ["a", "b", "c"] and [x["parent"] for x in tree] == [None, tree[0]["id"], tree[1]["id"]] and len({x["id"] for x in tree}) == 3
    new = memory_log.flat([e("d", None, "d"), e("b", 0)], "p")
    assert [x["parent"] for x in memory_log.placed(tree, new, [tree[0]["id"], "odd"])] == [None, tree[0]["id"], tree[1]["id"], tree[0]["id"]]
    assert memory_log.placed(tree, new, ["no root"]) == tree


def test_files_without_an_extractor_are_embedded_whole(spark):
    rows = [(1, 7, "a/x.md", "markdown", "one\ntwo"), (2, 7, "a/y.py", "python", "x = 1"), (3, 8, "a/z", None, "z"), (4, 8, "a/e", None, " \n"), (5, 8, "a/n.md", "markdown", None)]
    out = maintenance.embed_files(spark.createDataFrame(rows, "id long, project_id long, file_path string, language string, content string")).collect()
    assert [(r["node_id"], r["chunk_index"], r["chunk_start_line"], r["chunk_end_line"]) for r in sorted(out, key=lambda r: r["node_id"])] == [("file_1", 0, 1, 2), ("file_3", 0, 1, 1)]


def test_names_corrected_to_one_keep_all_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "c")], "id long, technology_name string")
    got = maintenance.with_corrected_technologies(df, {"a": "c", "b": "c", "Unknown": "d"})
    assert sorted(map(tuple, got.collect())) == [(1, "c"), (2, "c"), (3, "d"), (4, "c")]
    assert maintenance.with_corrected_technologies(df, {}).exceptAll(df).count() == 0
    assert sorted(r[0] for r in maintenance.unmatched_technologies(df, ["a", "Unknown"]).collect()) == ["b", "c"]


def test_extraction_export_has_a_header(spark, tmp_path):
    files_ = spark.createDataFrame([(1, "a.py"), (2, "b.py")], "id long, file_path string")
    blocks = spark.createDataFrame([(11, 1, "g"), (10, 1, "f")], "id long, file_id long, name string")
    maintenance.export_extraction(files_, blocks, str(tmp_path / "x"), "7")
    head = spark.read.json(str(tmp_path / "x/metadata")).first()
    assert (head["total_files"], head["extractor_version"]) == (2, "7") and head["export_timestamp"]
    assert {r["id"]: [b["name"] for b in r["blocks"] or []] for r in spark.read.json(str(tmp_path / "x/files")).collect()} == {1: ["f", "g"], 2: []}


def test_content_matches_of_every_cell_are_those_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(maintenance.overlap, "BLOCK", 16)
    rng, tech = random.Random(5), [None, "Unknown", "HTTP/HTTPS", "gRPC"]
    text = lambda n: " ".join(f"w{int(rng.paretovariate(0.5)) % 90}" for _ in range(n))
    out = [(k, rng.choice(tech), None if k % 50 == 9 else text(rng.randint(0, 9))) for k in range(150)]
    into = [(1000 + k, rng.choice(tech), text(rng.randint(0, 30))) for k in range(150)]
    df = lambda rows: spark.createDataFrame(rows, "id long, technology_name string, code_snippet string")
    real = lambda t: None if t == "Unknown" else t
    want = {}
    for a, t, x in out:
        for b, u, y in into:
            xs, ys = set((x or "").split()), set(y.split())
            if xs and len(xs & ys) / len(xs) >= 0.5 and (real(t) == real(u) or not real(t) or not real(u)):
                want[a, b] = (real(t) or real(u) or "HTTP/HTTPS", len(xs & ys) / len(xs))
    matches = maintenance.content_matches(df(out), df(into))
    rows = matches.collect()
    assert {(r["sender_id"], r["receiver_id"]): (r["technology"], r["match_confidence"]) for r in rows} == want and len(rows) == len(want) > 100
    # no pair is shuffled or met twice: the cells are the last step that moves rows
    plan = matches._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [sender_id" not in plan


def test_external_connections_are_those_of_the_sql_in_cells(spark, monkeypatch):
    from lattica.plans.named import NAMED
    from lattica.plans.views import Store

    monkeypatch.setattr(graph, "CELL_ROWS", 7)
    files = spark.createDataFrame([(k, k % 2, f"/f{k}", "py") for k in range(6)] + [(3, 9, "/again", "ts")], "id long, project_id long, file_path string, language string")
    side = lambda rows: spark.createDataFrame([(i, f, t, d) for i, (f, t, d) in rows], "id long, file_id long, technology_name string, description string")
    into = side([(k, (0, "a", f"in{k}")) for k in range(40)] + [(50, (1, None, None)), (51, (3, "b", "x")), (None, (0, None, None)), (None, (4, "n", "n")), (52, (None, "a", "y")), (53, (99, "a", "z"))])
    out = side([(k, (0, "c" if k % 2 else None, f"out{k}")) for k in range(30)] + [(60, (1, "d", "out")), (61, (2, "e", "alone")), (62, (3, None, None)), (None, (5, "n", "n"))])
    columns = ["project_id", "file_path", "language", "technology", "description", "direction", "incoming_id", "outgoing_id"]
    rows = lambda df: sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    got = graph.external_connections(files, into, out)
    assert rows(got) == rows(Store(spark, "").sql(NAMED["j11_external_connections"], files=files, incoming_connections=into, outgoing_connections=out))
    # the one hot file is dealt over tasks, instead of being one task's product
    assert got.filter("file_path = '/f0'").select(F.spark_partition_id()).distinct().count() > 2


def test_external_connections_of_a_file_are_written_with_each_text_about_once(spark, tmp_path):
    import random
    import string

    from lattica.plans.named import NAMED
    from lattica.plans.views import Store

    rng = random.Random(5)
    text = lambda: "".join(rng.choices(string.ascii_letters + string.digits, k=4_000))
    files = spark.createDataFrame([(k, 0, f"/f{k}", "py") for k in range(2)], "id long, project_id long, file_path string, language string")
    side = lambda rows: spark.createDataFrame(rows, "id long, file_id long, technology_name string, description string")
    into = side([(k, 0, "a", text()) for k in range(300)] + [(k, 1, "a", None) for k in range(500, 700)])
    out = side([(k, 0, "b", "short") for k in range(1_000, 1_200)] + [(k, 1, None, text()) for k in range(1_200, 1_500)])
    path = str(tmp_path / "made")
    graph.external_connections(files, into, out).write.parquet(path)
    made, want = spark.read.parquet(path), Store(spark, "").sql(NAMED["j11_external_connections"], files=files, incoming_connections=into, outgoing_connections=out)
    of = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64(*want.columns).cast("decimal(38,0)"))).first()
    assert of(made) == of(want) and of(made)[0] == 120_000
    # texts are 2.4 MB; rows hold them 200 times
    assert sum(f.stat().st_size for f in (tmp_path / "made").glob("*.parquet")) < 2 * 2_400_000


def test_documents_are_chunked_and_embedded_in_one_pass_in_small_batches(spark, monkeypatch):
    import xxhash

    monkeypatch.setattr(retrieval, "CHUNK_ROWS", 3)
    texts = ["one line", None, " \n", "\n".join(f"Word{i} line {i % 3}" for i in range(300)), "a\nb\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = []
    for k, t in enumerate(texts):
        for c in retrieval.chunk_text(t):
            v, words = [0.0] * 64, c["text"].lower().split()
            for h in map(xxhash.xxh3_64_intdigest, words):
                v[h % 64] += 1.0 if h >> 63 else -1.0
            want.append((f"file_{k}", c["start_line"], c["end_line"], c["token_count"], [round(x / len(words), 5) for x in v]))
    out = retrieval.embed_documents(docs, "doc_id", "text")
    assert sorted((r["node_id"], r["start_line"], r["end_line"], r["token_count"], [round(x, 5) for x in r["embedding"]]) for r in out.collect()) == sorted(want) and len(want) > 4
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan


def test_python_steps_get_batches_of_bounded_size(spark, tmp_path):
    from lattica.plans.views import Store

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    spark.range(5000).selectExpr("id AS doc_id", "repeat('x', 100) AS text").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    sizes = F.pandas_udf(lambda x: x * 0 + len(x), "long")
    assert Store(spark, str(tmp_path))["documents"].select(sizes("doc_id").alias("n")).agg(F.max("n")).first()[0] <= 1024


def test_annotations_of_a_file_meet_its_texts_in_lists(spark, monkeypatch):
    monkeypatch.setattr(diffs, "PACK", 4)
    old = "\n".join(f"line {i}" for i in range(40))
    texts = spark.createDataFrame([(1, old, "new\n" + old.replace("line 9\n", "")), (2, None, None), (3, "a\nb", "a\nc")], "file_id long, old string, new string")
    rows = [(k, 1, k % 30 + 1, k % 30 + 4) for k in range(60)] + [(100, 2, 1, 2), (101, 3, None, 2), (102, 9, 1, 1), (None, 3, 1, 2)]
    out = diffs.rebase_annotations(spark.createDataFrame(rows, "id long, file_id long, start_line long, end_line long"), texts)
    got = {r["id"]: (r["action"], r["new_start"], r["new_end"]) for r in out.collect()}
    d = diffs.line_diff(old, "new\n" + old.replace("line 9\n", ""))
    for k, _, s, e in rows[:60]:
        want = diffs.rebase(s, e, d)
        assert got[k][1:] == (want["new_start"], want["new_end"]) and got[k][0] in (want["action"], "resplit")
    assert got[100] == ("delete", None, None) and got[101] == ("keep", None, 2) and 102 not in got and None in got and len(got) == 63
    assert " Sort [file_id" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_blocks_without_a_parent_are_dealt_over_tasks(spark):
    rows = [(k, None if k < 400 else k % 400, f"b{k}", "function") for k in range(500)] + [(900, 901, "lost", "class"), (902, 902, "self", "class")]
    blocks = spark.createDataFrame(rows, "id long, parent_block_id long, name string, type string")
    parents = blocks.select(F.col("id").alias("pid"), F.col("name").alias("parent_name"))
    for k, v in {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}.items():
        spark.conf.set(k, v)
    try:
        out = graph.with_parent(blocks, parents)
        got = {r["id"]: r["parent_name"] for r in out.collect()}
        largest = max(r["count"] for r in out.filter("parent_block_id IS NULL").groupBy(F.spark_partition_id().alias("p")).count().collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {k: (None if up is None or up == 901 else f"b{up}" if up < 900 else "self") for k, up, _, _ in rows}
    assert largest < 200


def test_paths_alike_stay_dealt_over_tasks(spark):
    paths = spark.range(4000).select(F.concat(F.lit("/r/p"), (F.col("id") % 3).cast("string"), F.lit("/f"), F.col("id").cast("string")).alias("path")).coalesce(1)
    projects = spark.createDataFrame([("/r/p1/", "one"), ("/r", "all")], "path string, name string")
    out = graph.longest_prefix(paths, projects)
    assert {tuple(r) for r in out.groupBy("project").count().collect()} == {("one", 1333), ("all", 2667)}
    assert out.select(F.spark_partition_id()).distinct().count() == 4
    files = spark.createDataFrame([(1, "/a/b"), (1, "/a/b/c/d"), (1, "/a/b/e"), (2, "x"), (2, "y/z"), (3, "/q/r/s"), (4, None)], "project_id long, file_path string")
    assert {r["project_id"]: r["directory"] for r in graph.common_path(files, "project_id").collect()} == {1: "/a", 2: "", 3: "/q/r", 4: None}


def test_block_paths_carry_columns_and_end_at_cycles(spark):
    rows = [(1, None, "a"), (2, 1, "b"), (3, 2, None), (4, 3, "d"), (5, 5, "self"), (6, 7, "x"), (7, 6, "y"), (8, 99, "lost")]
    blocks = spark.createDataFrame([(*r, f"t{r[0]}") for r in rows], "id long, parent_block_id long, name string, type string")
    got = {r["id"]: (r["ids"], r["path"], r["type"]) for r in graph.block_paths(blocks, "type").collect()}
    assert got[4] == ([1, 2, 3, 4], "a > b", "t4") and got[3] == ([1, 2, 3], "a > b", "t3") and got[5] == ([5], "", "t5")
    assert got[6][0] == [7, 6] and got[7][0] == [6, 7] and got[8] == ([8], "", "t8") and got[1] == ([1], "", "t1")


def test_pages_are_parsed_once_for_text_and_markdown_in_batches_of_bounded_bytes(spark, tmp_path):
    from lattica.plans.queries import QUERIES
    from lattica.plans.views import ARROW_BYTES, Store

    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(256 << 20))
    pages = ["<h1>A</h1><p>b <b>c</b> <a href='u'>d</a><script>x</script>", None, "", "<li>one</li>&amp;<a>two</a></a>", "<p>" + "y " * 60_000]
    spark.createDataFrame([(k, pages[k % len(pages)]) for k in range(1000)], "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    out = QUERIES["f39_page_text"](spark, str(tmp_path))
    got = {r["page_id"]: (r["text"], r["markdown_chars"]) for r in out.collect()}
    marked = lambda h: None if h is None else len(files.html_text(h, True))
    want = [(files.html_text(h), marked(h)) for h in pages]
    assert got == {k: want[k % len(pages)] for k in range(1000)} and want[0] == ("A\nb c d", len("# A\nb **c** [d](u)"))
    # one call of one function; a Python worker holds no more than the bytes of a batch and a page
    calls = [x for x in out._jdf.queryExecution().executedPlan().toString().split("\n") if "ArrowEvalPython" in x]
    assert len(calls) == 1 and "page_forms(" in calls[0] and "page_text(" not in calls[0]
    held = F.pandas_udf(lambda h: h.notna() * int(h.dropna().str.len().sum()), "long")
    assert 0 < Store(spark, str(tmp_path))["pages"].select(held("html").alias("n")).agg(F.max("n")).first()[0] <= ARROW_BYTES + 120_003


def test_diffs_of_a_batch_cost_few_bytes_a_line(spark):
    import tracemalloc

    import pyarrow as pa

    texts = ["\n".join(f"{k}.{i}" for i in range(1000)) for k in range(60)] + [None, ""]
    edits = [t and "\n".join(["0"] + [x + "!" if i % 7 == 3 else x for i, x in enumerate(t.split("\n")) if i % 11]) for t in texts]
    pairs = [pa.array(texts), pa.array(edits)]
    tracemalloc.start()
    out = diffs.diff.func(*pairs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # results of 60,000 lines and the lines of one text; as dicts they were over 100 bytes a line
    assert peak < 40 * 60_000
    rows = spark.createDataFrame(list(zip(range(len(texts)), texts, edits, strict=True)), "id int, old string, new string")
    got = {r["id"]: r["d"].asDict(True) for r in rows.select("id", diffs.diff("old", "new").alias("d")).collect()}
    assert got == {k: diffs.line_diff(a, b) for k, (a, b) in enumerate(zip(texts, edits, strict=True))} and len(out) == len(texts)


def test_block_vectors_keep_the_types_of_lines(spark):
    blocks = spark.createDataFrame([(1, "function", "f", "a\nb", 10, 7), (2, "class", "g", " ", 1, 7), (3, "class", "h", "c", 5, 8)], "id long, type string, name string, content string, start_line int, file_id long")
    source = spark.createDataFrame([(7, "/a.py", "python", 1), (8, "/b.py", None, 2)], "id long, file_path string, language string, project_id int")
    out = maintenance.embed_blocks(blocks, source)
    assert [t for _, t in out.dtypes] == ["string", "int", "int", "int", "int", "array<float>"]
    assert sorted(r[:5] for r in out.collect()) == [("block_1", 1, 0, 10, 11), ("block_3", 2, 0, 5, 5)]
    longs = maintenance.embed_blocks(blocks.withColumn("start_line", F.col("start_line").cast("long")), source)
    assert dict(longs.dtypes)["chunk_start_line"] == "bigint" and longs.count() == 2
