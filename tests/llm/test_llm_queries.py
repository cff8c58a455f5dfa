"""The registered queries of lattica.llm on whole tables: their SQL in DuckDB, or a brute-force version."""

import hashlib
import zlib

import pytest

pytest.importorskip("lattica.llm")

import duckdb  # noqa: E402
import public_tokenizers  # noqa: E402

from lattica.llm.queries import ORACLES, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def texts(con):
    return dict(con.sql("SELECT doc_id, text FROM documents").fetchall())


def rounded(rows):
    return sorted(([round(x, 9) if isinstance(x, float) else x for x in r] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, con, name):
    got = QUERIES[name](spark, SF)
    want = con.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert rounded(tuple(r) for r in got.select(*columns).collect()) == rounded(want.select(*columns).fetchall())


def test_op3(spark, texts):
    import tiktoken

    ranks = dict(__import__("lattica.llm.byte_bpe", fromlist=["x"]).load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = QUERIES["op3_byte_bpe"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(texts)
    for r in out:
        ids = lib.encode_ordinary(texts[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()


def test_op4(spark, texts):
    import re

    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    out = QUERIES["op4_license_fuzzy"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(texts)
    for r in out:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in texts[r["doc_id"]] or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = sorted((k, label) for p, label in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(places), ",".join(sorted({x for _, x in places})))
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_op5(spark, texts):
    out = QUERIES["op5_toxicity_crf"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(texts)
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_op6(spark, texts):
    from tests.llm.test_operators import brute_join

    ids = sorted(texts)
    want = {ids[k]: (ids[c], n, m) for k, (c, n, m) in brute_join([texts[i] for i in ids]).items()}
    assert {r["doc_id"]: (r["class_id"], r["n_links"], r["n_copies"]) for r in QUERIES["op6_jaccard_join"](spark, SF).collect()} == want


def test_op8(spark, texts):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in QUERIES["op8_token_counts"](spark, SF).collect():
        text = texts[r["doc_id"]] or ""
        n = len(lib.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 2048)


def test_pipeline_is_registered(spark, texts):
    out = QUERIES["pipeline"](spark, SF).collect()
    assert {r["doc_id"] for r in out} <= set(texts) and all(len(r["tokens"]) == 4 * r["n_tokens"] for r in out)
