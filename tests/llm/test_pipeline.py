"""corpus_pipeline: each stage against its operator by brute force, and odd tables through all of them."""

import hashlib

import pytest

pytest.importorskip("lattica.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

import numpy as np  # noqa: E402
import public_tokenizers  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from lattica.llm import byte_bpe, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    import tiktoken

    from tests.llm.test_operators import brute_join, words

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "ngram_jaccard", "decontamination", "byte_bpe"]

    mild = stages["toxicity"](spark, docs, SF)
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert mild.columns == COLUMNS and {r["doc_id"] for r in mild.select("doc_id").collect()} == {i for i, s in scores.items() if s < 0.5}

    before = {r["doc_id"]: r["text"] for r in mild.collect()}
    short = stages["line_dedup"](spark, mild, SF)
    after = {r["doc_id"]: r for r in short.collect()}
    seen = set()
    for i in sorted(before):
        ls, gone = before[i].split("\n"), set()
        for k in range(len(ls) - 2):
            w = tuple(ls[k : k + 3])
            if any(words(x) for x in w):
                gone |= {k, k + 1, k + 2} if w in seen else set()
                seen.add(w)
        want = "\n".join(x for k, x in enumerate(ls) if k not in gone)
        assert after[i]["text"] == want and after[i]["n_chars"] == len(want)
    assert short.columns == COLUMNS

    ids = sorted(after)
    classes = brute_join([after[i]["text"] for i in ids])
    single = stages["ngram_jaccard"](spark, short, SF)
    assert sorted(r["doc_id"] for r in single.collect()) == [i for k, i in enumerate(ids) if classes[k][0] == k] and single.columns == COLUMNS

    clean = stages["decontamination"](spark, single, SF)
    assert clean.columns == COLUMNS and clean.count() <= single.count()
    assert stages["decontamination"](spark, clean, SF).count() == clean.count()

    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    out = stages["byte_bpe"](spark, clean, SF).collect()
    assert len(out) == len(texts)
    assert all(np.frombuffer(bytes(r["tokens"]), "<u4").tolist() == lib.encode_ordinary(texts[r["doc_id"]]) for r in out)
    assert all(r["n_tokens"] == len(lib.encode_ordinary(texts[r["doc_id"]])) and r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in out)


def test_odd_tables(spark, tmp_path):
    rows = [(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "one word", None, None, 8), (None, "a b c d e f", None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table, data, schema in (("documents", docs, None), ("labels", [], "doc_id long, quality int, toxic int"), ("benchmark", [(1, None), (None, "x y z")], "item_id long, text string")):
        (data if schema is None else spark.createDataFrame(data, schema)).write.parquet(str(tmp_path / f"{table}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r["doc_id"] or -1) for r in out.collect()) == [-1, -1, 1, 2, 2, 3]
    docs.filter(F.lit(False)).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_and_odd_column_names(spark, tmp_path):
    names = ["score", "spans", "_id", "_text", "_n_lines", "_rest", "_l", "gone", "gone_id", "found_id", "key", "a.b", "c`d", "root"]
    texts = ["a b c d e f g\nh i j\nk l m", "a b c d e f g\nh i j\nk l m", None, "", "other words here and there " * 3]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *[f"x{i}"] * len(names)) for i, t in enumerate(texts)], ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *(f"`{n.replace('`', '``')}` string" for n in names)]))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "other words here and there " * 3)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == before.columns
        assert all(r["a.b"] == r["score"] == r["_n_lines"] == f"x{r['doc_id']}" for r in docs.collect())
    assert sorted(r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()) == [0, 1, 2, 3]
