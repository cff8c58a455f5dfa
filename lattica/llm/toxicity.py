"""Toxic spans from a linear-chain conditional random field, and document scores from its marginals."""

from __future__ import annotations

import itertools
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import give_back, map_arrow, pairs_of, quoted

#: Labelled rows to train on, and characters of one of them, at most (documented bounds; scoring has none).
TRAIN_ROWS, TRAIN_CHARS = 4_000, 20_000

#: A chain is a run of so many words of a line at most.
CHAIN = 64

#: A word of a toxic document is labelled toxic if one of its features is in so many toxic documents of the
#: sample at least, and so much likelier there than in clean ones (log of the ratio of smoothed shares).
SUPPORT, LOG_RATIO = 5, 4.0

#: Features below this count of documents are left out of the model.
LEAST = 4

#: Words of which a worker remembers the emission before it starts anew.
MEMO = 100_000
_STRIP = ".,;:!?\"'()[]{}|*#$%&<>-_/\\"


def features(word: str) -> list[str]:
    """The word without case and outer punctuation, and its beginnings."""
    w = word.lower().strip(_STRIP)
    return [] if not w else ["w=" + w, *(f"{n}={w[:n]}" for n in (4, 5, 6) if len(w) > n)]


@dataclass
class Crf:
    """Two states. ``weights``: what a feature adds to the toxic state; ``move``: log transitions [from, to]."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -3.0
    move: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    top: np.ndarray = field(default_factory=lambda: np.array([-6.0, 1.0, 0.0]))

    def emission(self, word: str) -> float:
        get = self.weights.get
        return self.bias + sum(get(f, 0.0) for f in features(word))


#: Characters of a line read at a time, and words tagged at a time: they bound a worker's memory, not the text.
PIECE, WORDS_AT_ONCE = 1_000_000, 100_000


def line_words(text: str | None) -> Iterator[list[str]]:
    """Words of each line; those of an overlong line come in runs of CHAIN."""
    at, size = 0, len(text or "")
    while at < size:
        end = text.find("\n", at)
        end = size if end < 0 else end
        if end - at <= PIECE:
            yield text[at:end].split()
        else:
            found = (m.group() for m in re.compile(r"\S+").finditer(text, at, end))
            while run := list(itertools.islice(found, CHAIN)):
                yield run
        at = end + 1


def chain_lengths(n: int) -> list[int]:
    """A line of n words as chains of CHAIN words at most."""
    return [CHAIN] * (n // CHAIN) + ([n % CHAIN] if n % CHAIN else [])


def padded(values: np.ndarray, lengths: np.ndarray, fill: float) -> tuple[np.ndarray, np.ndarray]:
    """(chains x longest matrix, mask) of a flat array."""
    mask = np.arange(lengths.max(initial=0))[None, :] < lengths[:, None]
    out = np.full(mask.shape, fill)
    out[mask] = values
    return out, mask


def marginals(emission: np.ndarray, mask: np.ndarray, move: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """P(toxic) of each word by forward-backward over all chains at once; pairs: also the expected transitions, and log Z.

    Two states need one odds ratio a direction, so nothing under- or overflows.
    """
    a = np.exp(move)
    e = np.exp(np.clip(emission, -30, 30))
    n, size = e.shape
    fore, back = np.ones((n, size)), np.ones((n, size))
    for t in range(size):
        r = fore[:, t - 1] if t else None
        fore[:, t] = e[:, t] if t == 0 else e[:, t] * (r * a[1, 1] + a[0, 1]) / (r * a[1, 0] + a[0, 0])
    for t in range(size - 2, -1, -1):
        s = e[:, t + 1] * back[:, t + 1]
        step = (a[1, 1] * s + a[1, 0]) / (a[0, 1] * s + a[0, 0])
        back[:, t] = np.where(mask[:, t + 1], step, 1.0)
    odds = fore * back
    p = np.where(mask, odds / (1 + odds), 0.0)
    if not pairs:
        return p, None
    expected = np.zeros((2, 2))
    for t in range(1, size):
        live = mask[:, t]
        r, s = fore[live, t - 1], e[live, t] * back[live, t]
        w = np.stack([a[0, 0] * np.ones_like(r), a[0, 1] * s, r * a[1, 0], r * a[1, 1] * s])
        expected += (w / w.sum(axis=0)).sum(axis=1).reshape(2, 2)
    return p, expected


class Sample:
    """Texts as numbers: distinct words with their features, and word numbers and chain lengths by document."""

    def __init__(self, texts: Iterable[str | None]) -> None:
        known: dict[str, int] = {}
        self.docs: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        for text in texts:
            flat, lengths = array("i"), []
            for line in line_words(text):
                flat.extend(known.setdefault(w, len(known)) for w in line)
                lengths += chain_lengths(len(line))
            self.docs.append(np.array(flat, np.int32))
            self.lengths.append(np.array(lengths, np.int64))
        self.words = list(known)
        index: dict[str, int] = {}
        flat, starts = array("i"), [0]
        for w in self.words:
            flat.extend(index.setdefault(f, len(index)) for f in features(w))
            starts.append(len(flat))
        self.features, self.flat, self.starts = list(index), np.array(flat, np.int32), np.array(starts)

    def of_words(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in ``words``, features): all features of some words."""
        n = np.diff(self.starts)[words]
        at = np.repeat(np.arange(len(words)), n)
        shift = np.repeat(self.starts[words] - np.cumsum(n) + n, n)
        return at, self.flat[shift + np.arange(len(shift))]

    def counts(self, toxic: np.ndarray) -> np.ndarray:
        """Documents by label and feature."""
        out = np.zeros((2, len(self.features)), np.int64)
        for words, t in zip(self.docs, toxic.tolist(), strict=True):
            out[t, np.unique(self.of_words(np.unique(words))[1])] += 1
        return out


def marking(counts: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Which features mark a toxic word."""
    n = [int((toxic == k).sum()) for k in (0, 1)]
    ratio = np.log((counts[1] + 0.5) / (n[1] + 1)) - np.log((counts[0] + 0.5) / (n[0] + 1))
    return (counts[1] >= SUPPORT) & (ratio >= LOG_RATIO)


def train(texts: Iterable[str | None], toxic: Iterable[int], rounds: int = 60, rate: float = 0.3, ridge: float = 1e-4) -> Crf:
    """Maximum likelihood by Adam on chains: those with a labelled word, and as many others. Then the document layer."""
    model, truth = Crf(), np.array(toxic, int)
    if not len(truth) or truth.min() == truth.max():
        return model
    sample = Sample(texts)
    counts = sample.counts(truth)
    column = np.where(counts.sum(axis=0) >= LEAST, 0, -1)
    column[column == 0] = np.arange((column == 0).sum())
    size = int(column.max(initial=-1)) + 1
    place, what = sample.of_words(np.arange(len(sample.words)))
    marked = np.zeros(len(sample.words), bool)
    marked[place[marking(counts, truth)[what]]] = True

    labelled, other = [], []
    for words, lengths, t in zip(sample.docs, sample.lengths, truth.tolist(), strict=True):
        for c in np.split(words, np.cumsum(lengths)[:-1]) if len(lengths) else ():
            (labelled if t and marked[c].any() else other).append((c, t))
    rng = np.random.default_rng(5)
    keep = rng.permutation(len(other))[: 2 * len(labelled) + 500]
    used = labelled + [other[k] for k in keep]
    del labelled, other
    lengths = np.array([len(c) for c, _ in used])
    rows = np.concatenate([c for c, _ in used]) if used else np.empty(0, np.int32)
    y = (marked[rows] & np.repeat([bool(t) for _, t in used], lengths)).astype(float)
    at, what = sample.of_words(rows)
    live = column[what] >= 0
    at, what = at[live], column[what[live]]
    gold, mask = padded(y, lengths, 0.0)
    seen = np.zeros((2, 2))
    for t in range(1, gold.shape[1]):
        both = mask[:, t]
        np.add.at(seen, (gold[both, t - 1].astype(int), gold[both, t].astype(int)), 1)
    x = np.zeros(size + 5)
    x[size] = model.bias
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, rounds + 1):
        w, bias, move = x[:size], x[size], x[size + 1 :].reshape(2, 2)
        flat = bias + np.bincount(at, w[what], len(rows))
        emission, _ = padded(flat, lengths, 0.0)
        p, expected = marginals(emission, mask, move, pairs=True)
        gap = y - p[mask]
        g = np.concatenate([np.bincount(what, gap[at], size), [gap.sum()], (seen - expected).ravel()]) / max(1, len(rows)) - ridge * x / 10
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-10)
    model.weights = {sample.features[f]: float(x[i]) for f, i in enumerate(column.tolist()) if i >= 0 and abs(x[i]) > 1e-3}
    model.bias, model.move = float(x[size]), x[size + 1 :].reshape(2, 2)
    emission = np.array([model.emission(w) for w in sample.words])
    facts = [facts_of(chain_marginals(model, emission[words], lengths)) for words, lengths in zip(sample.docs, sample.lengths, strict=True)]
    model.top = logistic(np.stack(facts), truth)
    return model


def chain_marginals(model: Crf, emission: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """P(toxic) of each word of some chains, WORDS_AT_ONCE at a time."""
    ends, out = np.cumsum(lengths), []
    a = 0
    while a < len(lengths):
        begin = int(ends[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(ends, begin + WORDS_AT_ONCE)))
        stop = int(ends[min(b, len(lengths)) - 1])
        own, mask = padded(emission[begin:stop], lengths[a:b], 0.0)
        out.append(marginals(own, mask, model.move)[0][mask])
        a = b
    return np.concatenate(out) if out else np.zeros(0)


class Emissions(dict):
    """Memo from a word to its emission."""

    def __init__(self, model: Crf) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = self.model.emission(word)
        return value


def word_marginals(model: Crf, texts: list[str | None], memo: Emissions | None = None) -> Iterator[np.ndarray]:
    """P(toxic) of each word of each text. Short texts are tagged together, long ones in pieces."""
    memo = Emissions(model) if memo is None else memo
    flat, lengths, sizes = array("d"), [], []

    def flush() -> Iterator[np.ndarray]:
        p = chain_marginals(model, np.array(flat), np.array(lengths, np.int64))
        yield from np.split(p, np.cumsum(sizes)[:-1])

    for text in texts:
        before = len(flat)
        for line in line_words(text):
            flat.extend(map(memo.__getitem__, line))
            lengths += chain_lengths(len(line))
        sizes.append(len(flat) - before)
        if len(flat) >= WORDS_AT_ONCE:
            yield from flush()
            flat, lengths, sizes = array("d"), [], []
    if sizes:
        yield from flush()


def facts_of(p: np.ndarray) -> np.ndarray:
    """What the document layer sees of the marginals: a constant, the largest log odds, and words likelier toxic than not."""
    top = float(p.max(initial=0.0))
    return np.array([1.0, np.log((top + 1e-4) / (1 - top + 1e-4)), np.log1p(p[p > 0.5].sum())])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Ridge-regularised logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score_of(model: Crf, p: np.ndarray) -> float:
    return float(1 / (1 + np.exp(-np.clip(facts_of(p) @ model.top, -30, 30))))


def spans_of(text: str | None, p: np.ndarray) -> list[dict]:
    """Character ranges of runs of words of a line with a marginal of 0.5 at least."""
    out: list[dict] = []
    hits = np.flatnonzero(p >= 0.5)
    if not len(hits):
        return out
    live, last, end = set(hits.tolist()), -2, 0
    for k, m in enumerate(re.finditer(r"\S+", text)):
        if k in live:
            if k == last + 1 and "\n" not in text[end : m.start()]:
                out[-1]["end"] = m.end()
            else:
                out.append({"start": m.start(), "end": m.end()})
            last, end = k, m.end()
        if k >= hits[-1]:
            break
    return out


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Crf:
    """Train on a bounded sample of labelled rows outside the held-out fifth (crc32 of the id as text, modulo 5, is 0).

    The rows with the smallest hashes of their ids are taken, so the sample doesn't hang on partitions;
    of rows sharing an id the smallest text counts, of their labels the largest.
    Ids, languages and sources are no features. Without both labels the model scores every text low.
    """
    own = labels.select(F.col(quoted("doc_id")).cast("long").alias("_id"), F.col(quoted(label_col)).cast("int").alias("_y")).filter("_id IS NOT NULL AND _y IS NOT NULL")
    own = own.groupBy("_id").agg((F.max("_y") > 0).cast("int").alias("_y"))
    taken = own.filter(F.crc32(F.col("_id").cast("string")) % 5 != 0).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    texts = pairs_of(docs, id_col, text_col).filter(F.length("_text") <= chars)
    found = texts.join(F.broadcast(taken), "_id").groupBy("_id", "_y").agg(F.min("_text").alias("_text")).toArrow().sort_by("_id")
    # texts become word numbers one at a time: no list of all of them on the driver
    model = train((x.as_py() for x in found["_text"]), found["_y"].to_pylist())
    del found
    give_back()
    return model


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def toxic_score(text: Column, model: Crf) -> Column:
    """The score as a column. Only the text goes to Python, and only a number comes back."""
    memo = Emissions(model)

    @F.arrow_udf("double")
    def tag(texts: pa.Array) -> pa.Array:
        return pa.array([score_of(model, p) for p in word_marginals(model, texts.to_pylist(), memo)], pa.float64())

    return tag(text)


def score(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, spans) for each row; no shuffle.

    Whole texts are tagged, however long, a hundred thousand words at a time. ``spans`` are the
    offending characters [start, end). A null or wordless text has the score of no evidence and no
    spans; rows repeat as they come, equal texts have equal scores; null ids stay null; other
    columns are ignored; an empty table gives an empty table.
    """
    memo = Emissions(model)

    def tag(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        scores, spans = [], []
        for text, p in zip(texts, word_marginals(model, texts, memo), strict=True):
            scores.append(score_of(model, p))
            spans.append(spans_of(text, p))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, _SPANS)], names=["_id", "score", "spans"])

    out = map_arrow(pairs_of(docs, id_col, text_col), tag, "_id long, score double, spans array<struct<start:long,end:long>>")
    return out.withColumnRenamed("_id", id_col)
