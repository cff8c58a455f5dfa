"""The operators of lattica.llm against brute force, the tokenizers' libraries and held-out labels, on small tables."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("lattica.llm")

import public_tokenizers  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from lattica.llm import byte_bpe, decontamination, jaccard_join, license_scan, line_dedup, quality_rules, substring_dedup, token_counts, toxicity, warc  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, score string, spans string, h string"
WORDS = [f"w{i}" for i in range(400)]
CLEAN = " ".join(a + b for a in ("Bre", "sto", "plin", "wa", "ger") for b in ("nd", "lt", "rk", "ms", "th", "ck"))
ODD = [None, "", " \n\t", "one", "a b c d e", "Ünï çødé 漢字 🙂 words here", "<|endoftext|> x", "x\r\ny\x0bz\x1cq", "tab\tsep  double"]


def frame(spark, texts, ids=None):
    rows = [(i if ids is None else ids[k], t, None, "s", None, "clash", "clash", None, None) for k, (i, t) in enumerate(enumerate(texts))]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    out = list(ODD)
    base = [prose(rng, n) for n in (60, 90, 150, 220, 400)]
    out += base
    for b in base:
        w = b.split()
        w[len(w) // 2] = "changed"
        out += [b, " ".join(w), b + "\n" + prose(rng, 20), "\n".join(b[i : i + 40] for i in range(0, len(b), 40))]
    out += [prose(rng, 30) + " " + base[3] + " " + prose(rng, 70), "loop " * 300, "word\n" * 50, "=" * 700]
    return out


# --- 1


def test_warc_round_trip(spark):
    big = "<p>" + "x" * 200 + "</p>"
    tricky = "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc" + "y" * 120
    rows = [(5, "http://www.B.com/x?Q=1", big), (2, "http://b.com/x", big), (9, None, None), (7, " bad url \n", "short"), (3, "", "short"), (None, "http://a.org/", big), (11, "https://a.org:8080/é", tricky), (2, "http://b.com/x", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = warc.capture_histories(pages).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r["page_id"], []).append(r)
    assert {r["record_type"] for r in by[2]} == {"response"} and len(by[2]) == 2
    assert by[5][0]["record_type"] == "revisit" and by[5][0]["refers_to"] == 2 and by[None][0]["refers_to"] == 2
    for i, _, html in rows:
        raw = (html or "").encode()
        assert all(r["payload_bytes"] == len(raw) and r["payload_digest"] == hashlib.sha256(raw).hexdigest() for r in by[i])
    assert by[3][0]["record_type"] == by[7][0]["record_type"] == "response"
    keys = [(r["urlkey"], r["stamp"]) for r in out]
    assert keys == sorted(keys)
    assert warc.capture_histories(pages.limit(0)).count() == 0


def test_loser_tree_merges():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted((f"k{rng.randrange(9)}", rng.randrange(50), r, i) for i in range(rng.randrange(0, 30))) for r in range(k)]
        merged = [v for _, v in warc.LoserTree([(e[:2], e) for e in run] for run in runs)]
        assert merged == sorted(itertools.chain(*runs), key=lambda e: (e[:2], e[2], e[3]))
    with pytest.raises(ValueError, match="sorted"):
        list(warc.LoserTree([[((2,), 0), ((1,), 0)]]))


def test_capture_histories_are_in_global_order(spark, tmp_path):
    """One URL, a third of the ids null, many ranges; and every record can be fetched by its place."""
    rng = random.Random(12)
    rows = [(None if i % 3 == 0 else i, f"http://h.org/{rng.randrange(3)}", "z" * rng.randrange(300)) for i in range(400)]
    out = warc.capture_histories(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "warc")).collect()
    keys = [(r["urlkey"], r["stamp"], r["page_id"] is None, r["page_id"] or 0, r["archive"], r["offset"]) for r in out]
    assert keys == sorted(keys) and len(out) == 400
    for r in out[::7]:
        with open(tmp_path / "warc" / r["archive"], "rb") as f:
            f.seek(r["offset"])
            record = f.read(r["length"])
        ((_, length, fields, _),) = warc.parse_warc(record)
        assert length == r["length"] and fields["warc-type"] == r["record_type"] and fields["warc-payload-digest"].endswith(r["payload_digest"])


# --- 2


def brute_quality(text):
    w = words(text)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    seen = {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    covered = {p for i, g in enumerate(grams) if seen[g] > 1 for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, texts):
    df = frame(spark, [*texts, "#| " * 40, "AB! " * 3 + " ".join(WORDS[:30]), CLEAN])
    out = {r["doc_id"]: r for r in quality_rules.quality_rules(df).collect()}
    for r in df.collect():
        got = out[r["doc_id"]]
        assert (got["n_words"], got["word_chars"], got["n_symbols"], got["n_dup_lines"], got["n_repeat_words"]) == brute_quality(r["text"]), r["text"]
        assert got["base_failed"] == (got["n_words"] < 20 or 100 * got["n_repeat_words"] > 30 * got["n_words"])
        assert not (got["base_failed"] and got["kept"])
    assert [i for i, r in out.items() if r["kept"]] == [max(out)]
    assert quality_rules.quality_rules(df.limit(0)).count() == 0


def test_rules_are_ordered_by_rejection_per_cost(spark):
    rng = random.Random(22)
    good = [prose(rng, 60) for _ in range(30)]
    base = quality_rules.base_columns(frame(spark, [*good, *(x.upper() for x in good[:10]), *(x + " #" * 20 for x in good[10:15]), None, "short"]))
    rules = (quality_rules.Rule("costly", "length(regexp_replace(repeat(_text, 400), '[^\\\\p{Lu}]', '')) > 400 * 40"), quality_rules.Rule("never", "false"), quality_rules.Rule("cheap", "n_symbols > 10"))
    order = quality_rules.order_rules(base, rules)
    assert [r.name for r, *_ in order] == ["cheap", "costly", "never"] and order[1][2] > order[0][2]
    assert abs(order[0][1] - 5 / 45) < 1e-9 and abs(order[1][1] - 10 / 40) < 1e-9 and order[2][1] == 0


def test_cascade_counts_what_reaches_a_rule():
    # rule 1 rejects what rule 0 rejects and no more: behind it, it is worth nothing
    assert quality_rules.cascade([((True, True, False), 5), ((True, False, False), 1), ((False, False, True), 2), ((False, False, False), 2)], [1.0, 1.0, 1.0]) == [(0, 0.6), (2, 0.5), (1, 0.0)]


# --- 3, 8


def hard_texts(texts):
    rng = random.Random(8)
    pool = "aA bB'sΣςσİKK \x1c\x85é½٣漢字🙂\n\t<|x0 1"
    return [*texts, *("".join(rng.choice(pool) for _ in range(80)) for _ in range(150)), "ab" * 400, "é" * 300, " " * 500]


def test_byte_bpe_is_tiktoken(spark, texts):
    import tiktoken

    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = frame(spark, hard_texts(texts))
    tokens = byte_bpe.encode(df, ranks, public_tokenizers.PATTERN, block_chars=5_000)
    got = {r["_id"]: r["tokens"] for r in tokens.collect()}
    digests = {r["_id"]: r for r in byte_bpe.token_digests(tokens, ranks).collect()}
    assert {r["_id"]: r for r in byte_bpe.encode(df, ranks, public_tokenizers.PATTERN, digests=True, tokens=False).collect()} == digests
    assert {r["_id"]: r["tokens"] for r in byte_bpe.encode(df, ranks, public_tokenizers.PATTERN, digests=True).collect()} == got
    decoded = {r["_id"]: bytes(r["bytes"]) for r in byte_bpe.decode(tokens, ranks).collect()}
    assert decoded == {r["doc_id"]: (r["text"] or "").encode() for r in df.collect()}
    for r in df.collect():
        text = r["text"] or ""
        want = lib.encode_ordinary(text)
        assert np.frombuffer(bytes(got[r["doc_id"]]), "<u4").tolist() == want, text[:80]
        assert digests[r["doc_id"]]["n_tokens"] == len(want)
        assert digests[r["doc_id"]]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert byte_bpe.encode(df.limit(0), ranks, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_is_the_same_by_fold_and_by_heap(spark, texts, monkeypatch):
    """Words fold or go through the heap by their length: all one way and all the other give the same ids."""
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    df = frame(spark, [*hard_texts(texts)[-160:], "ab" * 150, "x" * 200])
    got = []
    for limit in (2, 8, 10_000):
        monkeypatch.setattr(byte_bpe, "FOLD_BYTES", limit)
        got.append({r["_id"]: r["tokens"] for r in byte_bpe.encode(df, ranks, public_tokenizers.PATTERN).collect()})
    assert got[0] == got[1] == got[2]


def test_ids_beyond_65535(spark):
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 70_000, b"abc": 70_001}
    out = byte_bpe.encode(frame(spark, ["abc ab"]), ranks, public_tokenizers.PATTERN).first()["tokens"]
    assert np.frombuffer(bytes(out), "<u4").tolist() == [70_001, 32, 70_000]
    with pytest.raises(ValueError, match="ids must lie"):
        byte_bpe.rank_map(spark, {**ranks, b"xy": byte_bpe.MOST_IDS})


def test_perfect_hash_finds_every_key():
    table = {k * 7919 % 1_000_003: k for k in range(5_000)}
    shifts, keys, values = byte_bpe.perfect_hash(table)
    at = lambda k: (k + shifts[k % len(shifts)]) % len(keys)
    assert all(keys[at(k)] == k and values[at(k)] == v for k, v in table.items())


def test_token_counts_are_the_library_s(spark, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    df = frame(spark, hard_texts(texts))
    out = {r["doc_id"]: r for r in token_counts.token_counts(df, path).collect()}
    for r in df.collect():
        text = r["text"] or ""
        n = len(lib.encode(text, add_special_tokens=False).ids)
        assert (out[r["doc_id"]]["n_tokens"], out[r["doc_id"]]["n_bytes"], out[r["doc_id"]]["over_limit"]) == (n, len(text.encode()), n > 2048)


# --- 4


def test_license_scan(spark):
    texts = [
        None, "", "Released under the MIT License.", "RELEASED UNDER THE MIT-LICENSE, under the mit license", "Relesed undr the MIT Licence.", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0",
        "this work is licensed under the GNU General Publik License, version 3", "all rights reserved", "underthe mit license", "nothing of the kind in here", "Kelvin under the mit license",
    ]
    df = frame(spark, texts)
    out = {r["doc_id"]: r for r in license_scan.license_scan(df).collect()}
    for i, t in enumerate(texts):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(k, label) for p, label in license_scan.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.decode().split()]
        r = out[i]
        assert r["n_words"] == len(w) and r["n_base"] == len(places), t
        assert r["first_word"] == min((k for k, _ in places), default=None) and r["last_word"] == max((k for k, _ in places), default=None)
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert out[4]["labels"] == "mit" and 0 < out[4]["score"] < 1 and out[7]["labels"] == "gpl" and out[10]["labels"] == ""
    assert out[4]["spans"][0]["first_word"] == 0 and out[4]["spans"][0]["edits"] == 3
    assert license_scan.license_scan(df.limit(0)).count() == 0


def fewest_edits(notice, text):
    """Least edits between the notice and any part of the text (Sellers)."""
    row = list(range(len(notice) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, x in enumerate(notice):
            new.append(min(row[i] + (x != c), row[i + 1] + 1, new[i] + 1))
        row, best = new, min(best, new[-1])
    return best


def edited(rng, notice, told, n):
    """The notice with n edits outside the words that tell it from others."""
    kept = [(m.start(), m.end()) for t in told for m in re.finditer(rb"(?<![a-z0-9])" + t + rb"(?![a-z0-9])", notice)]
    free = [k for k in range(len(notice)) if all(k < a - 1 or k > b for a, b in kept)]
    out = [notice[k : k + 1] for k in range(len(notice))]
    for k in rng.sample(free, n):
        out[k] = rng.choice((b"", b"q", out[k] + b"q"))
    return b"".join(out)


def test_fuzzy_matches_are_brute_force():
    rng = random.Random(4)
    scanner = license_scan.Scanner()
    for (notice, label, k), (_, _, told) in zip(scanner.notices, license_scan.NOTICES, strict=True):
        for n in range(k + 2):
            for _ in range(6):
                x = edited(rng, notice, told, n)
                text = b"zzz " + x + b" yyy"
                got = {scanner.notices[i][1] for *_, i, _ in scanner.spans(text)}
                if n <= k:
                    assert label in got, (text, got)
                for a, b, i, cost in scanner.spans(text):
                    pattern, _, most = scanner.notices[i]
                    assert cost <= most and fewest_edits(pattern, text[a:b]) <= cost and fewest_edits(pattern, text) <= cost
    for _ in range(40):  # a notice that no part of the text is near to isn't found
        text = b" ".join(rng.choice((b"under", b"the", b"license", b"licensed", b"public", b"gnu", b"general", b"mit", b"apache", b"version", b"2")) for _ in range(30))
        got = {i for *_, i, _ in scanner.spans(text)}
        assert all(fewest_edits(scanner.notices[i][0], text) <= scanner.notices[i][2] for i in got)


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("released under the BSD license", "bsd"), ("released under the ISC license", "isc"), ("released under the MPL license", "mpl"), ("released under the XYZ license", ""),
        ("under the terms of the GNU Affero General Public License", "agpl"), ("under the terms of the GNU Lesser General Public License", "lgpl"), ("under the terms of the GNU General Public License", "gpl"),
        ("Licensed under CC BY-ND 4.0", "cc-by-nd"), ("Licensed under CC BY-NC-SA 4.0", "cc-by-nc-sa"), ("Licensed under CC BY 4.0", "cc-by"),
        ("Licensed under the Apache License, Version 1.1", "apache-1.1"), ("Licensed under the Apache License, Version 2.0", "apache-2"), ("you must submit license forms released under the admit license", ""),
    ],
)
def test_confusable_notices(text, labels):
    scanner = license_scan.Scanner()
    assert ",".join(sorted({scanner.notices[i][1] for *_, i, _ in scanner.spans(license_scan.normalise(text))})) == labels


def test_license_scan_is_linear():
    import time

    scanner, took = license_scan.Scanner(), []
    for n in (500, 2_000):
        norm = license_scan.normalise("Released under the MIT licence. " * n)
        began = time.perf_counter()
        assert len(scanner.spans(norm)) == n
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0]


# --- 5


def test_marginals_are_brute_force():
    rng = np.random.default_rng(2)
    e, move = rng.normal(size=(1, 6)) * 2, rng.normal(size=(2, 2))
    p, pairs = toxicity.marginals(e, np.ones((1, 6), bool), move, pairs=True)
    total, one, two = 0.0, np.zeros(6), np.zeros((2, 2))
    for y in itertools.product((0, 1), repeat=6):
        s = np.exp(sum(e[0, t] * y[t] for t in range(6)) + sum(move[a, b] for a, b in itertools.pairwise(y)))
        total += s
        one += s * np.array(y)
        for a, b in itertools.pairwise(y):
            two[a, b] += s
    assert np.allclose(p[0], one / total) and np.allclose(pairs, two / total)


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(d, labels)
    held = labels.filter(F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    rows = toxicity.score(d, model).join(held, "doc_id").join(d.select("doc_id", "text"), "doc_id").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    right = sum((r["score"] >= 0.5) == bool(r["toxic"]) for r in rows) / len(rows)
    toxic = [r for r in rows if r["toxic"]]
    assert right > 0.97 and sum(r["score"] >= 0.5 for r in toxic) / len(toxic) > 0.85
    assert sum(r["score"] >= 0.5 for r in rows if not r["toxic"]) / (len(rows) - len(toxic)) < 0.01
    for r in toxic[:20]:
        assert all(r["text"][s["start"] : s["end"]].strip() for s in r["spans"])


def test_toxicity_of_odd_tables(spark):
    df = frame(spark, ODD)
    model = toxicity.fit(df, spark.createDataFrame([], "doc_id long, toxic int"))
    out = toxicity.score(df, model).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] < 0.5 for r in out)


# --- 6


def shingle_set(text, k=5):
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute_join(texts):
    sets = [shingle_set(t) for t in texts]
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links, reps = [set() for _ in texts], {}
    for i, s in enumerate(sets):
        reps.setdefault(s, i)
    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if a and b and len(a & b) >= 0.8 * len(a | b):
            x, y = sorted((root(i), root(j)))
            up[y] = x
            if a != b:
                links[i].add(reps[b])
                links[j].add(reps[a])
    return {i: (root(i), len(links[i]), sets.count(sets[i]) if sets[i] else 1) for i in range(len(texts))}


@pytest.mark.parametrize(("block", "bucket"), [(512, 16_384), (5, 3)])
def test_jaccard_join(spark, block, bucket):
    rng = random.Random(6)
    texts = list(ODD)
    for _ in range(6):
        base = prose(rng, rng.randint(40, 300)).split()
        for _ in range(rng.randint(1, 12)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 45))):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            texts.append(" ".join(w))
    texts += [texts[-1], texts[-1]]
    out = {r["doc_id"]: (r["class_id"], r["n_links"], r["n_copies"]) for r in jaccard_join.jaccard_join(frame(spark, texts), block=block, bucket=bucket).collect()}
    assert out == brute_join(texts)


def test_jaccard_join_of_odd_tables(spark):
    t = " ".join(WORDS[:40])
    df = frame(spark, [t, t, None, t], ids=[4, 4, None, 2])
    assert sorted((r["doc_id"] or -1, r["class_id"] or -1) for r in jaccard_join.jaccard_join(df).collect()) == [(-1, -1), (2, 2), (4, 2), (4, 2)]
    assert jaccard_join.jaccard_join(df.limit(0)).count() == 0


def test_rows_that_share_an_id_keep_their_links(spark):
    rng = random.Random(16)
    for _ in range(2):
        one, two = prose(rng, 120), prose(rng, 120)
        df = frame(spark, [one, two, one + " tail", two + " tail"], ids=[1, 1, 2, 3])
        got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join.jaccard_join(df).collect())
        assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]


def test_boilerplate_makes_no_large_group(spark, monkeypatch):
    rng = random.Random(26)
    page = prose(rng, 60)
    df = frame(spark, [page + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(50)) for _ in range(400)])
    seen = []
    true = jaccard_join.connected_components
    monkeypatch.setattr(jaccard_join, "connected_components", lambda e, name: seen.append(e.count()) or true(e, name))
    out = jaccard_join.jaccard_join(df).collect()
    assert all(r["n_links"] == 0 and r["class_id"] == r["doc_id"] for r in out) and seen[0] < 40


def test_jaccard_join_recall_on_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    ids = sorted(texts)
    by_shingle, sets = {}, [shingle_set(texts[i]) for i in ids]
    for k, s in enumerate(sets):
        for x in s:
            by_shingle.setdefault(x, []).append(k)
    met = {p for group in by_shingle.values() if len(group) < 400 for p in itertools.combinations(group, 2)}
    up = list(range(len(ids)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in met:
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            x, y = sorted((root(i), root(j)))
            up[y] = x
    out = {r["doc_id"]: r["class_id"] for r in jaccard_join.jaccard_join(df).collect()}
    assert out == {ids[k]: ids[root(k)] for k in range(len(ids))}


def test_pruning_keeps_near_pairs():
    assert all(m < 0.8 * n for n, m in jaccard_join.least_matches(0.8, jaccard_join.TOLERANCE))
    assert len(jaccard_join.least_matches(0.8, jaccard_join.TOLERANCE)) == jaccard_join.HASHES // jaccard_join.STEP


# --- 7


@pytest.mark.parametrize("limit", [None, 0])
def test_decontamination(spark, monkeypatch, limit):
    if limit is not None:  # nothing is broadcast by its size
        monkeypatch.setattr(decontamination, "BROADCAST_ROWS", limit)
        monkeypatch.setattr(decontamination, "BROADCAST_BYTES", limit)
    rng = random.Random(7)
    items = [prose(rng, n) for n in (16, 25, 40, 59, 5, 3)] + [None, ""]
    texts = list(ODD)
    for it in filter(None, items):
        w = it.split()
        w[len(w) // 2] = w[len(w) // 2].upper() + "!"
        cut = w[: int(len(w) * 0.95)]
        texts += [prose(rng, 500) + "\n" + " ".join(w) + "\n" + prose(rng, 900), " ".join(cut), " ".join(w[: len(w) // 2]), it]
    df = frame(spark, texts)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): round(r["containment"], 9) for r in decontamination.contaminated(df, bench).collect()}
    norm = lambda t: [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
    sets = lambda t, k=5: {tuple(w[i : i + k]) for w in [norm(t)] if len(w) >= k for i in range(len(w) - k + 1)}
    want = {}
    for i, t in enumerate(texts):
        for j, it in enumerate(items):
            k = min(5, len(norm(it)))
            q = sets(it, k) if k else set()
            if q and len(q & sets(t, k)) >= 0.8 * len(q) - 1e-9:
                want[i, j] = round(len(q & sets(t, k)) / len(q), 9)
    assert got == want and len(want) > 12
    assert decontamination.contaminated(df, bench.limit(0)).count() == 0 and decontamination.contaminated(df.limit(0), bench).count() == 0


# --- 9


def brute_substrings(ids, texts, n=50):
    first = {}
    for i, t in sorted((i, t) for i, t in zip(ids, texts, strict=True) if i is not None and t):
        w = words(t)
        for p in range(len(w) - n + 1):
            first.setdefault(tuple(w[p : p + n]), i)
    out = []
    for i, t in zip(ids, texts, strict=True):
        w = words(t)
        gone = {q for p in range(len(w) - n + 1) if i is not None and first[tuple(w[p : p + n])] < i for q in range(p, p + n)}
        out.append((-1 if i is None else i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [16, 2])
def test_substring_dedup(spark, texts, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT_DOCS", hot)
    rng = random.Random(9)
    shared = prose(rng, 70)
    more = [*texts, *(prose(rng, rng.randint(0, 40)) + " " + " ".join(shared.split()[a : a + rng.randint(45, 60)]) + " " + prose(rng, 30) for a in range(0, 20, 3)), shared * 2]
    ids = list(range(len(more)))
    rng.shuffle(ids)
    ids[3] = None
    df = frame(spark, more, ids)
    out = substring_dedup.kept_digest(substring_dedup.substring_dedup(df)).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out) == brute_substrings(ids, more)
    assert substring_dedup.substring_dedup(df.limit(0)).count() == 0


def test_cover_is_a_difference_cover():
    assert substring_dedup.long_matches_share_an_anchor()


# --- 10


def test_line_dedup(spark):
    a, b = "alpha\nbeta\ngamma\ndelta\nepsilon", "zeta\neta\ntheta"
    texts = [a, "start\nbeta\ngamma\ndelta\nend", b, b + "\n" + b, None, "", "\n\n\n\n", "x\n\n\ny\n\n\ny", "beta\ngamma", a]
    df = frame(spark, texts)
    seen, want = set(), []
    for t in texts:
        ls = (t or "").split("\n") if t is not None else []
        gone = set()
        for i in range(len(ls) - 2):
            w = tuple(ls[i : i + 3])
            if any(words(x) for x in w):
                gone |= {i, i + 1, i + 2} if w in seen else set()
                seen.add(w)
        want.append((len(ls), len(gone), None if t is None else "\n".join(x for i, x in enumerate(ls) if i not in gone)))
    out = line_dedup.line_dedup(df).orderBy("doc_id").collect()
    assert line_dedup.line_dedup(df, counts=None).columns == df.columns
    assert [(r["_n_lines"], r["_n_removed"], r["text"]) for r in out] == want
    assert line_dedup.line_dedup(df.limit(0)).count() == 0
