"""Column functions against plain Python."""

import hashlib
import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattica.functions import ignore
from lattica.functions import paths as P
from lattica.functions import text as X
from lattica.operators import maintenance


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def numbered(n):
    return "\n".join(f"l{i}" for i in range(n))


def brute_chunks(n, size=600, threshold=700):
    if n <= threshold:
        return [(1, n)]
    k = -(-n // size)
    if 0 < n % size < 50 and k > 1:
        k -= 1
        sizes = [n // k + (i < n % k) for i in range(k)]
    else:
        sizes = [min(size, n - a) for a in range(0, n, size)]
    out, at = [], 1
    for s in sizes:
        out.append((at, at + s - 1))
        at += s
    return out


def test_line_chunks(spark):
    sizes = [1, 50, 699, 700, 701, 1199, 1200, 1201, 1249, 1250, 1830, 2401]
    df = spark.createDataFrame([(n, numbered(n)) for n in sizes], "n int, t string")
    for r in df.select("n", X.chunk_lines("t").alias("c")).collect():
        assert [(c["start_line"], c["end_line"]) for c in r["c"]] == brute_chunks(r["n"])
        assert "\n".join(c["content"] for c in r["c"]) == numbered(r["n"])
    empty = spark.createDataFrame([("",), (None,)], "t string").select(X.chunk_lines("t").alias("c")).collect()
    assert all(len(r["c"]) == 1 and r["c"][0]["total_lines"] == 0 for r in empty)


def test_lines_and_slices(spark):
    t = "a\nb\nc\n"
    assert one(spark, X.lines("t"), t=t) == ["a", "b", "c", ""]
    assert one(spark, X.split_lines("t"), t="a\r\nb\x0bc\n") == ["a", "b", "c"] == "a\r\nb\x0bc\n".splitlines()
    assert one(spark, X.line_slice("t", F.lit(2), F.lit(9)), t=t) == "b\nc\n"
    assert one(spark, X.line_slice("t", F.lit(12), F.lit(13), first=11), t=t) == "b\nc"
    assert one(spark, X.number_lines("t", 9), t="x\ny") == "   9 | x\n  10 | y"
    assert one(spark, X.strip_numbers("t"), t="   9 | x\n  10 | y") == "x\ny"
    assert one(spark, X.line_range(F.lit("3"), F.lit("x"))) is None and one(spark, X.line_range(F.lit(3), F.lit(5)))["end"] == 5
    assert [one(spark, X.snippet_lines(F.lit(s))) for s in ("3-5", "7", "x-1", "5-3")] == [[3, 4, 5], [7], [], []]
    assert [(w["start"], w["end"]) for w in one(spark, X.line_windows(F.lit(4001)))] == [(1, 2000), (2001, 4000), (4001, 4001)]


def test_find_and_similar(spark):
    hay, needle = ["a", "b", "c", "a", "b", "d"], ["a", "b", "d"]
    df = spark.createDataFrame([(hay, needle, ["a", "zz", "d"], ["q", "q", "q"])], "h array<string>, n array<string>, m array<string>, z array<string>")
    r = df.select(X.find_lines(F.col("n"), F.col("h")).alias("f"), X.similar_lines(F.col("m"), F.col("h")).alias("s"), X.similar_lines(F.col("z"), F.col("h")).alias("z")).first()
    assert tuple(r["f"]) == (4, 6) and (r["s"]["start"], r["s"]["end"]) == (4, 6) and r["z"] is None


def test_names(spark):
    assert one(spark, X.pascal_case(F.lit("my node-type_x"))) == "MyNodeTypeX"
    assert one(spark, X.upper_snake(F.lit("callsFunction now"))) == "CALLS_FUNCTION_NOW"
    assert [one(spark, X.confidence(F.lit(s))) for s in ("HIGH", "low", "?")] == [0.9, 0.5, 0.5]
    assert one(spark, X.version_order(F.lit("1.10.0"), F.lit("1.9.9"))) == 1
    key = "a.py:1-9:file:x"
    assert one(spark, X.element_id(F.lit("a.py"), F.lit(1), F.lit(9), F.lit("file"), F.lit("x"))) == "elem_" + hashlib.md5(key.encode()).hexdigest()[:6]


def test_paths(spark):
    assert one(spark, P.file_id(F.lit("/a/b.py"))) == zlib.crc32(b"/a/b.py")
    assert one(spark, P.path_suffixes(F.lit("/pkg/sub/__init__.py"))) == ["pkg.sub", "sub"]
    assert one(spark, P.ancestors(F.lit("a/b/c.py"))) == ["a/", "a/b/"]
    assert one(spark, P.normalise(F.lit("/a//b/./c/../d"))) == "/a/b/d"
    assert one(spark, P.relative_to(F.lit("/a/b/c"), F.lit("/a"))) == "b/c"
    assert [one(spark, P.language(F.lit(p))) for p in ("x/Dockerfile", "A.PY", "b.unknown")] == ["dockerfile", "python", None]
    assert one(spark, P.ignored_file(F.lit("a/b.min.js"))) and one(spark, P.ignored_dir(F.lit("a/node_modules/b.js"))) and not one(spark, P.ignored_dir(F.lit("a/node_modules")))
    assert one(spark, P.is_text(F.lit(bytearray(b"ab\x10\x0fcd")))) and not one(spark, P.is_text(F.lit(bytearray(b"ab\x00"))))
    assert one(spark, P.decode(F.lit(bytearray("é".encode())))) == "é" == one(spark, P.decode(F.lit(bytearray("é".encode("latin-1")))))
    assert one(spark, P.valid_url(F.lit("https://x.org/a"))) and not one(spark, P.valid_url(F.lit("x.org")))


def brute_signature(path):
    vowels = sum(c in "aeiou" for c in path.lower())
    cons = sum(c.isalpha() and c not in "aeiou" for c in path.lower())
    ratio = vowels * 100 // cons if cons else 0
    shape = next((n for top, n in ((25, "compact"), (50, "balanced"), (75, "flowing"), (150, "verbose")) if ratio < top), "unique")
    return P.SIZES[min(len(path) // 10, 5)] + P.DEPTHS[min(path.count("/"), 5)] + shape + f"v{sum(map(ord, path)) % 99 + 1}"


def test_signature(spark):
    rng = random.Random(2)
    paths = ["/" + "/".join("".join(rng.choice("abcdeiouxyz_1") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 8))) for _ in range(60)]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r[0] for r in df.select(P.path_signature("p")).collect()] == [brute_signature(p) for p in paths]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 4000), st.integers(1, 700), st.integers(1, 900))
def test_chunks_cover_the_lines(n, size, threshold):
    spans = brute_chunks(n, size, threshold)
    assert [x for a, b in spans for x in range(a, b + 1)] == list(range(1, n + 1))


RULES = ["# no", "", "*.log", "!keep.log", "/top", "deep/", "docs/**/x.md", "a/b", "**/gen", "out/**", "!out/kept", "t?.[!a]b", "\\#odd", "sp\\ ", "[x", "tmp/", "!tmp/saved"]
CASES = {
    "a/x.log": True, "keep.log": False, "q/keep.log": False, "top": True, "top/a": True, "b/top/a": False, "x/deep/y": True, "x/deep": False, "docs/x.md": True, "docs/a/b/x.md": True,
    "z/docs/x.md": False, "a/b": True, "z/a/b": False, "gen/c": True, "q/r/gen": True, "out": False, "out/p": True, "out/kept": False, "out/p/kept": True, "t1.cb": True, "t1.ab": False,
    "t/.cb": False, "#odd": True, "sp ": True, "sp": False, "[x": True, "tmp/saved": True, "ok.py": False, "a\nb.log": True,
}


def test_ignore_rules(spark):
    """The last rule that matches decides, and nothing below an ignored folder comes back."""
    df = spark.createDataFrame([(p,) for p in [*CASES, None]], "p string").withColumn("i", ignore.ignored("p", RULES))
    assert {r["p"]: r["i"] for r in df.collect()} == {**CASES, None: None}
    assert {r[0] for r in df.select(ignore.ignored("p", [])).collect()} == {False, None}


def test_ignore_files_of_a_tree(spark):
    """An inner file has the last word for what is below it; its rules start at its folder."""
    rows = [(".gitignore", "*.log\nbuild/\n"), ("a/.gitignore", "!keep.log\r\n/only\n"), ("e/.gitignore", ""), ("n/.gitignore", None)]
    kept = ["a/keep.log", "a/b/keep.log", "a/b/only", "only", "c.py", "e/f", "n/f", None]
    gone = ["keep.log", "x/keep.log", "a/only", "a/only/x", "build/c", "a/build/keep.log", "a/z.log"]
    files = spark.createDataFrame(rows + [(p, "") for p in kept + gone], "file_path string, content string")
    rules = ignore.rules_of(files)
    assert {r[0] for r in ignore.without_ignored(files, rules).collect()} == {*kept, *(r[0] for r in rows)}
    tree = maintenance.workspace_tree(files.filter("file_path IS NOT NULL"), rules=rules)
    assert {(r["folder"], r["files"]) for r in tree.collect()} == {("a/", 4), ("a/b/", 2), ("e/", 2), ("n/", 2)}
    assert ignore.without_ignored(files, rules.limit(0)).count() == files.count()
