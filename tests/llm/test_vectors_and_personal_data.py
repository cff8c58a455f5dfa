"""Centroid clustering, personal data and whitening against brute force."""

import hashlib
import itertools
import random
import re
from fractions import Fraction

import numpy as np
import pytest

pytest.importorskip("lattica.llm")

import duckdb  # noqa: E402

from lattica.llm import centroids, personal_data, whitening  # noqa: E402
from lattica.llm.queries import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id bigint, embedding array<float>, x string, cluster string"


def vectors(n, width, seed, spread=1.0):
    draw = np.random.default_rng(seed)
    return (draw.normal(size=(n, width)) * spread).astype(np.float32).tolist()


def brute_clusters(rows, k, rounds, scale=64, width=64):
    kept = [(i, [int(np.floor(scale * float(np.float32(e)))) for e in v]) for i, v in rows if v is not None and len(v) == width and all(e is not None and np.isfinite(e) for e in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    at = [v for _, v in start]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for r in range(rounds + 1):
        own = [min(range(len(at)), key=lambda c: (far(v, at[c]), c)) for _, v in kept]
        if r < rounds:
            groups = [[v for (_, v), c in zip(kept, own) if c == j] for j in range(len(at))]
            at = [[sum(x) // len(g) for x in zip(*g)] if g else a for g, a in zip(groups, at)]
    return [(i, c, far(v, at[c])) for (i, v), c in zip(kept, own)], at


def test_clusters_equal_brute_force_with_ties_and_odd_rows(spark):
    values = vectors(300, 64, 1, 0.2) + [[0.5] * 64] * 40 + [[float(i % 3)] * 64 for i in range(60)]
    rows = [(i % 350, v, "x", "y") for i, v in enumerate(values)]
    rows += [(900, None, None, None), (901, [1.0] * 63, "", ""), (902, [float("nan")] + [0.0] * 63, "", ""), (903, [None] + [0.0] * 63, "", ""), (904, [float("inf")] * 64, "", ""), (905, [3e7] * 64, "", ""), (906, [], "", "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = centroids.centroid_clusters(df, k=16, rounds=3).collect()
    want, at = brute_clusters([(i, v) for i, v, *_ in rows if i != 905], 16, 3)
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in got) == sorted(want)
    for r in got:
        assert r["cluster_inertia"] == sum(d for _, c, d in want if c == r["cluster"]) and r["inertia"] == sum(d for *_, d in want)
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, at[r["cluster"]])).encode()).hexdigest()


def test_bounds_spare_scans_and_never_change_a_result():
    draw = np.random.default_rng(3)
    heads = draw.integers(-200, 200, (8, 16))
    x = (heads[draw.integers(0, 8, 4000)] + draw.integers(-20, 20, (4000, 16))).astype(np.int64)
    at, drift = x[:8].copy(), np.zeros(8)
    cluster, upper, lower = np.full(4000, -1, np.int32), np.full(4000, np.inf), np.full(4000, -np.inf)
    scans = []
    for _ in range(6):
        scans.append(int(centroids.settle(x, cluster, upper, lower, at, drift).sum()))
        exact = centroids.distances(x, at)
        assert (cluster == exact.argmin(axis=1)).all()
        assert (upper >= np.sqrt(exact[np.arange(4000), cluster])).all()
        moved = np.array([x[cluster == c].sum(axis=0) // max(1, (cluster == c).sum()) if (cluster == c).any() else at[c] for c in range(8)])
        at, drift = moved, np.sqrt(((moved - at) ** 2).sum(axis=1).astype(float))
    assert scans[0] == 4000 and scans[-1] < 400  # settled vectors aren't scanned


@pytest.mark.parametrize("rows", [[], [(1, None, "", "")], [(None, [0.25] * 64, "", "")], [(7, [0.25] * 64, "", ""), (7, [0.25] * 64, "", "")]])
def test_clusters_of_small_tables(spark, rows):
    got = centroids.centroid_clusters(spark.createDataFrame(rows, SCHEMA)).collect()
    kept = [r for r in rows if r[1]]
    assert [(r["vec_id"], r["cluster"], r["distance"], r["inertia"]) for r in got] == [(r[0], 0, 0, 0) for r in kept]


def test_limbs_and_gram_are_exact():
    draw = random.Random(5)
    for bits in (10, 39, 61):
        y = np.array([[draw.randrange(-(1 << bits), 1 << bits) for _ in range(5)] for _ in range(9000)], np.int64)
        count = -(-(bits + 1) // whitening.LIMB)
        parts = whitening.limbs(y[:50], count)
        assert (sum(p.astype(np.int64).astype(object) << whitening.LIMB * a for a, p in enumerate(parts)) == y[:50]).all()
        big = y.astype(object)
        assert (whitening.gram(iter([y[:4000], y[4000:]]), 5, count) == big.T @ big).all()
    wide = np.array([[1 << 80, -(1 << 79) + 3]], object)
    assert (whitening.gram(iter([wide]), 2, 5) == wide.T @ wide).all()


def brute_covariance(values):
    x = [[int(np.floor(1024 * float(np.float32(e)))) + 100_000 for e in v] for v in values]
    n, s = len(x), [sum(c) for c in zip(*x)]
    y = [[n * a - b for a, b in zip(v, s)] for v in x]
    return n, y, np.array([[float(Fraction(sum(r[i] * r[j] for r in y), n**3)) for j in range(len(s))] for i in range(len(s))])


def test_whitening_equals_brute_force(spark):
    values = (np.array(vectors(200, 12, 2)) * np.linspace(0.2, 4, 12)).tolist()
    rows = [(i, v, "x", "y") for i, v in enumerate(values)] + [(0, values[0], "", "")]
    odd = [(500, None, "", ""), (501, [float("nan")] * 12, "", ""), (502, [None] * 12, "", ""), (503, [1.0] * 5, "", ""), (504, [], "", "")]
    got = whitening.whitening(spark.createDataFrame(rows + odd, SCHEMA).repartition(4)).collect()
    n, y, v = brute_covariance([r[1] for r in rows])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    assert len(got) == 8 * len(rows) and {r["n"] for r in got} == {n}
    table = {}
    for r in got:
        table.setdefault(r["vec_id"], {})[r["component"]] = r
        assert abs(r["explained"] - e[r["component"] - 1] / np.trace(v)) < 1e-9 and r["identity_error"] < 1e-9
    for i, row in enumerate(y[:-1]):
        assert {r["deviation"] for r in table[i].values()} == {sum(a * a for a in row)}
        for c in range(8):
            assert abs(abs(table[i][c + 1]["whitened"]) - abs(np.array(row, float) / n @ u[:, c] / np.sqrt(e[c]))) < 1e-9
    all_ = np.array([[table[i][c]["whitened"] for c in range(1, 9)] for i in [*range(200), 0]])
    assert np.abs(all_.T @ all_ / n - np.eye(8)).max() < 1e-9


def test_whitening_of_small_tables(spark):
    assert whitening.whitening(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whitening.whitening(spark.createDataFrame([(1, None, "", "")], SCHEMA)).collect() == []
    same = whitening.whitening(spark.createDataFrame([(None, [0.5, 1.0], "", "")] * 3, SCHEMA)).collect()
    assert len(same) == 6 and all(r["whitened"] is None and r["explained"] == 0 and r["deviation"] == 0 and r["identity_error"] is None for r in same)
    line = whitening.whitening(spark.createDataFrame([(i, [float(i), float(2 * i)], "", "") for i in range(5)], SCHEMA)).collect()
    assert {r["component"]: r["whitened"] is None for r in line} == {1: False, 2: True}


def test_whitening_of_large_entries(spark):
    """Centred values beyond a long: big integers all the way, deviations that fit no long are null."""
    values = [[float(2**39 + 3 * i), -float(2**39) * i] for i in range(6)]
    got = whitening.whitening(spark.createDataFrame([(i, v, "", "") for i, v in enumerate(values)], "vec_id bigint, embedding array<double>, x string, cluster string")).collect()
    assert len(got) == 12 and all(r["deviation"] is None for r in got)
    assert all(r["whitened"] is not None for r in got if r["component"] == 1)


def test_op13_and_op11_on_whole_tables(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").fetchall()
    n, y, _ = brute_covariance([v for _, v in rows])
    want = {(i, c, n, sum(a * a for a in row)) for (i, _), row in zip(rows, y) for c in range(1, 9)}
    got = QUERIES["op13_embedding_whitening"](spark, SF).collect()
    assert {(r["vec_id"], r["component"], r["n"], r["deviation"]) for r in got} == want and len(got) == len(want)
    assert max(r["identity_error"] for r in got) < 1e-4
    clusters, at = brute_clusters(rows, 16, 3)
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in QUERIES["op11_centroid_clusters"](spark, SF).collect()) == sorted(clusters)


PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(text):
    out = []
    for k, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            doubled = sum(int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d)))) for i, d in enumerate(reversed(digits)))
            if (True, all(int(p) <= 255 for p in m.group().split(".")) if k == 1 else True, 12 <= len(digits) <= 19 and doubled % 10 == 0, 9 <= len(digits) <= 15)[k]:
                out.append((k, *m.span()))
    return sorted(out, key=lambda s: (s[1], s[0]))


def test_base_spans_equal_the_plain_patterns():
    draw = random.Random(9)
    for alphabet in ("0123456789 -", "a@.-+ 1", "12. ", "+12 ().-x", "a1@.+-() \né١"):
        for _ in range(3000):
            text = "".join(draw.choice(alphabet) for _ in range(draw.randrange(60)))
            assert personal_data.base_spans(text) == brute_spans(text), text
    assert personal_data.base_spans(None) == personal_data.base_spans("") == []


def test_messages_give_exact_marginals_without_loops_and_close_ones_with():
    draw = np.random.default_rng(4)
    for edges, near in (([(0, 1), (1, 2), (1, 3)], 1e-3), ([(0, 1), (1, 2), (0, 2)], 0.08)):
        node, edge = draw.normal(size=(4, 5)), draw.normal(size=(2, 5, 5)) * 0.5
        kinds = np.array([0, 1, 0])
        g = personal_data.Graph(4, np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), np.ones((4, 5), bool), np.array(edges), kinds)
        p, _ = personal_data.beliefs(g, node, edge)
        want = np.zeros((4, 5))
        for y in itertools.product(range(5), repeat=4):
            w = np.exp(sum(node[i, y[i]] for i in range(4)) + sum(edge[k][y[a], y[b]] for (a, b), k in zip(edges, kinds)))
            for i in range(4):
                want[i, y[i]] += w
        assert np.abs(p - want / want.sum(axis=1, keepdims=True)).max() < near


@pytest.fixture(scope="module")
def field(spark):
    return personal_data.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def spans_of(spark, field, *texts):
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], "doc_id bigint, text string, spans string, n_ip int")
    return {r["doc_id"]: r for r in personal_data.personal_data(df, field).collect()}


def test_repeats_far_apart_are_found(spark, field):
    filler = " und der " * 3000
    card = "4539578763621486"
    assert personal_data.luhn(card)
    far = "x " + card + filler + "4539.5787.6362.1486 ende"
    phone = "ruf +1 (017) 555-7713 an" + filler + "oder (017)555-7713 bitte"
    out = spans_of(spark, field, far, phone, "4539.5787.6362.1486 ende")
    assert out[0]["n_card"] == 1 and out[0]["spans"].count("card:") == 2
    assert out[1]["n_phone"] == 1 and out[1]["spans"].count("phone:") == 2
    start = far.index("4539.5787")
    assert f"card:{start}:{start + 19}" in out[0]["spans"]
    assert out[0]["score"] > out[2]["score"]  # the repeat speaks for it, nothing but its form does in the other text


def test_personal_data_of_odd_tables(spark, field):
    schema = "doc_id bigint, text string, spans string, n_ip int"
    empty = hashlib.sha256(b"").hexdigest()
    rows = [(None, None, "", 1), (1, "", "", 1), (1, "", "", 1), (2, "mail a.b@c.de", None, None), (2, "mail a.b@c.de", None, None)]
    out = personal_data.personal_data(spark.createDataFrame(rows, schema), field).collect()
    assert len(out) == 5 and sum(r["base_sha256"] == empty for r in out) == 3
    assert [r["spans"] for r in out if r["doc_id"] == 2] == ["email:5:13"] * 2
    assert personal_data.personal_data(spark.createDataFrame([], schema)).collect() == []
    assert [r["n_added"] for r in personal_data.personal_data(spark.createDataFrame(rows, schema)).collect()] == [0] * 5


def test_very_long_texts_take_linear_time(spark, field):
    import time

    texts = ["7" * 5_000_000, "a" * 5_000_000 + "@b.de", "1 " * 500_000, "+1" * 500_000, "12.34." * 300_000, "a@" * 500_000]
    began = time.perf_counter()
    for t in texts:
        personal_data.base_spans(t)
        personal_data.tokens(t)
    assert time.perf_counter() - began < 60
    out = spans_of(spark, field, "7" * 5_000_000, "a" * 5_000_000 + "@b.de")
    assert out[1]["n_email"] == 1


def test_op12_on_the_whole_table(spark):
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    got = {r["doc_id"]: r for r in QUERIES["op12_personal_data"](spark, SF).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        base = brute_spans(t or "")
        assert [got[i][f"n_{k}"] for k in personal_data.KINDS] == [sum(s[0] == j for s in base) for j in range(4)]
        assert got[i]["base_sha256"] == hashlib.sha256(personal_data.shown(base).encode()).hexdigest()
        assert set(filter(None, personal_data.shown(base).split(","))) <= set(got[i]["spans"].split(","))
