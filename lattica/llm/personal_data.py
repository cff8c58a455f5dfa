"""Personal data by patterns and a skip-chain conditional random field.

Base spans come from four patterns, each found in time linear in the text. The field then labels the tokens that hold a
digit or an @: neighbours share a chain potential, and tokens of one document that are equal or similar, however far apart,
share a skip potential. Loopy message passing over these graphs (sum-product, damped, all documents of a batch at once) makes
what is written like an entity elsewhere in the document an entity, too. The field is learned from base spans of a bounded
sample; a share of its nodes is learned without the features that the patterns test, so that context and repeats carry weight.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import map_arrow, pairs_of

KINDS = ("email", "ip", "card", "phone")

#: Labels of a token: none, then one for each kind.
LABELS = len(KINDS) + 1

#: Texts and tokens that the field is learned from at most; rounds and rate of learning, and its weight decay.
TRAIN_TEXTS, TRAIN_TOKENS, TRAIN_ROUNDS, RATE, DECAY = 4_000, 40_000, 120, 0.1, 1e-3

#: Share of nodes that are learned without the patterns' own tests.
BLIND = 0.3

#: Message passing ends when no message moves by more than NEAR, after MESSAGES rounds at the latest; damping of messages.
MESSAGES, NEAR, DAMPED = 30, 1e-4, 0.3

#: Slots of hashed features.
SLOTS = 1 << 12

#: Probability from which a span of the field is told.
SURE = 0.5

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NUMBERS = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_PART = re.compile(r"[0-9]+")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_DIALLED = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[^\s]*")
_NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Each @ once: the local part is all that may stand before it, back to the last match."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        done = found.end() if found else at + 1
        if found:
            out.append((start, done))
        at = text.find("@", done)
    return out


def _addresses(text: str) -> list[tuple[int, int]]:
    """Runs of dotted numbers, taken four at a time."""
    out = []
    for run in _NUMBERS.finditer(text):
        if run.group().count(".") >= 3:
            parts = list(_PART.finditer(text, run.start(), run.end()))
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                if all(len(x := p.group().lstrip("0")) <= 3 and int(x or 0) <= 255 for p in four):
                    out.append((four[0].start(), four[3].end()))
    return out


def _cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _DIGITS.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def _phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _DIALLED.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]


def base_spans(text: str | None) -> list[Span]:
    """(kind, start, end) of the patterns' matches that pass their tests, by start, then kind."""
    if not text:
        return []
    out = [(0, *x) for x in _emails(text)] if "@" in text else []
    if _PART.search(text):
        out += [(1, *x) for x in _addresses(text)] + [(2, *x) for x in _cards(text)] + [(3, *x) for x in _phones(text)]
    return sorted(out, key=lambda s: (s[1], s[0]))


def shown(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


@dataclass
class Token:
    """A token with a digit or an @, without the punctuation around it; ``joined``: only white space parts it from the one before."""

    start: int
    end: int
    core: str
    before: str
    joined: bool


def tokens(text: str) -> list[Token]:
    out: list[Token] = []
    done = 0
    mark = _MARK.search(text)
    while mark:
        start = mark.start()
        while start > done and not text[start - 1].isspace():
            start -= 1
        end = _TOKEN.match(text, mark.start()).end()
        word = text[start:end]
        low, high = 0, len(word)
        while low < high and not (word[low].isalnum() or word[low] in "+(@"):
            low += 1
        while high > low and not (word[high - 1].isalnum() or word[high - 1] == ")"):
            high -= 1
        gap = text[done:start] if out and start - done <= 3 else "x"
        before = text[max(0, start - 32) : start].rstrip().rsplit(None, 1)
        out.append(Token(start + low, start + high, word[low:high], before[-1].lower() if before else "", bool(out) and not gap.strip() and out[-1].end == done))
        done = end
        mark = _MARK.search(text, end)
    return out


_SHAPES = tuple(re.compile(p) for p in (r"[^@]+@[^@]+", r"[0-9]{1,3}(?:\.[0-9]{1,3})+", r"[0-9]+(?:[.-][0-9]+)*", r"\+?\(?[0-9]+\)?(?:[.()-]*[0-9]+)*\)?"))


def allowed(core: str) -> list[bool]:
    """Kinds that a token's letters permit."""
    return [bool(s.fullmatch(core)) for s in _SHAPES]


def features(t: Token) -> list[tuple[int, str]]:
    """(level, name) of what a token shows: 0 around it, 1 its form, 2 what the patterns test."""
    digits = _NOT_DIGIT.sub("", t.core)
    n = len(digits)
    shape = re.sub(r"[0-9]+", "9", re.sub(r"[^\W\d_]+", "a", t.core[:64]))
    around = ["bias", f"before={t.before}", f"joined={t.joined}"]
    form = [f"shape={shape[:24]}", f"digits={min(n, 20)}", f"first={t.core[:1] if not t.core[:1].isalnum() else 'w'}", f"dots={min(t.core.count('.'), 4)}"]
    tested = [f"luhn={12 <= n <= 19 and luhn(digits)}", f"octets={bool(_addresses(t.core))}", f"mail={bool(_emails(t.core))}", f"plus={t.core.startswith('+')}"]
    return [(level, name) for level, names in enumerate((around, form, tested)) for name in names]


def slots(t: Token) -> tuple[list[int], list[int]]:
    """(slots, levels) of a token's features."""
    found = features(t)
    return [xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) % SLOTS for _, x in found], [level for level, _ in found]


def similar(found: list[Token]) -> list[tuple[int, int]]:
    """Pairs of tokens of a document that share a skip potential: equal letters and digits whatever stands between, or seven and
    more digits of which at most one differs. Tokens of a key are linked one after the other, so links are linear in tokens."""
    last: dict[tuple, int] = {}
    out = set()
    for i, t in enumerate(found):
        core = re.sub(r"[\W_]+", "", t.core.lower())
        keys: list[tuple] = [("all", core)] if len(core) >= 4 else []
        digits = _NOT_DIGIT.sub("", core)
        if len(digits) >= 7 and len(digits) == len(core):
            half = len(digits) // 2
            keys += [("tail", digits[-7:]), ("low", len(digits), digits[:half]), ("high", len(digits), digits[half:])]
        for key in keys:
            j = last.get(key)
            if j is not None and (key[0] in ("all", "tail") or sum(a != b for a, b in zip(digits, _NOT_DIGIT.sub("", found[j].core), strict=False)) <= 1):
                out.add((j, i))
            last[key] = i
    return sorted(out)


@dataclass
class Graph:
    """Nodes of some documents: their features (node, slot, level), permitted labels, edges (a, b) and their type: 0 chain, 1 skip."""

    nodes: int
    rows: np.ndarray
    slots: np.ndarray
    levels: np.ndarray
    permitted: np.ndarray
    edges: np.ndarray
    kinds: np.ndarray


def graph(documents: list[list[Token]]) -> Graph:
    rows, cols, levels, permitted, edges, kinds, n = [], [], [], [], [], [], 0
    for found in documents:
        for i, t in enumerate(found):
            own, level = slots(t)
            rows += [n + i] * len(own)
            cols += own
            levels += level
            permitted.append([True, *allowed(t.core)])
            if t.joined:
                edges.append((n + i - 1, n + i))
                kinds.append(0)
        links = similar(found)
        edges += [(n + a, n + b) for a, b in links]
        kinds += [1] * len(links)
        n += len(found)
    as_ints = lambda x: np.array(x, np.int64)
    return Graph(n, as_ints(rows), as_ints(cols), as_ints(levels), np.array(permitted, bool).reshape(n, LABELS), as_ints(edges).reshape(-1, 2), as_ints(kinds))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def unary(g: Graph, weights: np.ndarray, keep: np.ndarray | None = None) -> np.ndarray:
    """Log potentials of nodes; ``keep`` tells which of the feature entries count."""
    rows, cols = (g.rows, g.slots) if keep is None else (g.rows[keep], g.slots[keep])
    out = np.zeros((g.nodes, LABELS))
    for label in range(LABELS):
        out[:, label] = np.bincount(rows, weights[cols, label], minlength=g.nodes)
    return np.where(g.permitted, out, -1e4)


def beliefs(g: Graph, node: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node marginals, edge marginals) by loopy sum-product over log potentials ``node`` (nodes x labels) and ``edge`` (types
    x labels x labels). Exact where the graph has no loop."""
    e = len(g.edges)
    a, b = g.edges[:, 0], g.edges[:, 1]
    source, target = np.concatenate([a, b]), np.concatenate([b, a])
    theta = np.concatenate([edge[g.kinds], edge[g.kinds].transpose(0, 2, 1)]) if e else np.zeros((0, LABELS, LABELS))
    back = np.concatenate([np.arange(e, 2 * e), np.arange(e)])
    message = np.zeros((2 * e, LABELS))

    def gathered() -> np.ndarray:
        return node + np.stack([np.bincount(target, message[:, k], minlength=g.nodes) for k in range(LABELS)], axis=1) if e else node

    for _ in range(MESSAGES if e else 0):
        out = _log_sum((gathered()[source] - message[back])[:, :, None] + theta, 1)
        out -= _log_sum(out, 1)[:, None]
        moved = np.abs(np.exp(out) - np.exp(message)).max()
        message = (1 - DAMPED) * out + DAMPED * message
        if moved < NEAR:
            break
    all_ = gathered()
    p = np.exp(all_ - _log_sum(all_, 1)[:, None])
    if not e:
        return p, np.zeros((0, LABELS, LABELS))
    joint = (all_[a] - message[back[:e]])[:, :, None] + theta[:e] + (all_[b] - message[:e])[:, None, :]
    joint -= joint.max(axis=(1, 2), keepdims=True)
    joint = np.exp(joint)
    return p, joint / joint.sum(axis=(1, 2), keepdims=True)


@dataclass(frozen=True)
class Field:
    """Learned weights: of feature slots (slots x labels) and of edge types (2 x labels x labels)."""

    weights: np.ndarray
    edge: np.ndarray


def base_labels(found: list[Token], spans: list[Span]) -> list[int]:
    """Label of each token: the kind of the base span that covers its first digit or @ most, else none."""
    out, i = [], 0
    for t in found:
        while i < len(spans) and spans[i][2] <= t.start:
            i += 1
        out.append(next((k + 1 for k, a, b in spans[i : i + 4] if a < t.end and b > t.start and allowed(t.core)[k]), 0))
    return out


def learn(documents: list[list[Token]], labels: list[list[int]], seed: int = 7) -> Field:
    """Weights by gradient steps (per-weight rates) on the likelihood, its expectations from message passing.

    Each document is learned from as it is, and once more followed by an echo: its tokens again, of which only what is around
    them is seen, as if they were written in some other form. So the skip potentials learn what a repeat is worth.
    """
    echo = np.array([e for d in documents for e in [False] * len(d)] + [e for d in documents for e in [False] * len(d) + [True] * len(d)], bool)
    g = graph([*documents, *([*d, *d] for d in documents)])
    weights, edge = np.zeros((SLOTS, LABELS)), np.zeros((2, LABELS, LABELS))
    edge[1] = np.eye(LABELS)
    if not g.nodes:
        return Field(weights, edge)
    y = np.array([x for one in labels for x in one] + [x for one in labels for x in [*one, *one]])
    y = np.where(g.permitted[np.arange(g.nodes), y], y, 0)
    true = np.eye(LABELS)[y]
    draw = np.random.default_rng(seed)
    sums = [np.full(weights.shape, 1e-8), np.full(edge.shape, 1e-8)]
    true_edges = true[g.edges[:, 0]][:, :, None] * true[g.edges[:, 1]][:, None, :]
    for _ in range(TRAIN_ROUNDS):
        shown_ = np.where(echo, 0, np.where(draw.random(g.nodes) < BLIND, 1, 2))
        keep = g.levels <= shown_[g.rows]
        p, joint = beliefs(g, unary(g, weights, keep), edge)
        step = np.stack([np.bincount(g.slots[keep], (true - p)[g.rows[keep], k], minlength=SLOTS) for k in range(LABELS)], axis=1) - DECAY * weights
        steps = np.stack([(true_edges - joint)[g.kinds == k].sum(axis=0) for k in (0, 1)])
        steps[1] = np.eye(LABELS) * (steps[1] + steps[1].T) / 2  # equal labels attract or repel, nothing else
        for parameter, gradient, total in ((weights, step, sums[0]), (edge, steps - DECAY * edge, sums[1])):
            total += gradient**2
            parameter += RATE * gradient / np.sqrt(total)
    edge[1] = np.maximum(edge[1], 0.0)
    return Field(weights, edge)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """The field of a sample of at most TRAIN_TEXTS texts with a digit or an @, drawn by a hash of their ids, and of their first
    TRAIN_TOKENS tokens by whole texts. The labels are base spans, so nothing else is read. Without any such text nothing is added to base."""
    marked = pairs_of(docs, id_col, text_col).filter(F.col("_text").rlike("[0-9@]")).select(F.xxhash64("_id", F.lit(12)).alias("h"), "_id", "_text")
    n = marked.count()
    if n > 2 * TRAIN_TEXTS:  # so that few texts beyond the sample are moved
        marked = marked.filter(F.col("h") < -(1 << 63) + (1 << 64) * 3 * TRAIN_TEXTS // (2 * n))
    drawn = marked.orderBy("h", "_id").limit(TRAIN_TEXTS)
    found = map_arrow(drawn.select("h", "_text").repartition(8), _sampled, "h bigint, tokens string").orderBy("h", "tokens").toPandas()
    documents, labels, n = [], [], 0
    for line in found["tokens"]:
        rows = [x.split("\x1f") for x in line.split("\x1e")]
        n += len(rows)
        if documents and n > TRAIN_TOKENS:
            break
        documents.append([Token(int(a), int(b), core, before, joined == "1") for a, b, core, before, joined, _ in rows])
        labels.append([int(r[5]) for r in rows])
    return learn(documents, labels)


def _sampled(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Tokens of sampled texts with their base labels, as lines; a text with more than a tenth of TRAIN_TOKENS isn't learned from."""
    out = []
    for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        found = tokens(text)
        if found and len(found) <= TRAIN_TOKENS // 10:
            clean = lambda x: re.sub("[\x1e\x1f]", " ", x[:256])
            out.append((h, "\x1e".join("\x1f".join((str(t.start), str(t.end), clean(t.core), clean(t.before), "1" if t.joined else "0", str(y))) for t, y in zip(found, base_labels(found, base_spans(text)), strict=True))))
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], names=["h", "tokens"])


def whole(kind: int, text: str) -> bool:
    """Whether an added span is all of an entity of its kind: enough digits, four numbers, or an address at a host."""
    n = len(_NOT_DIGIT.sub("", text))
    return (0 < text.find("@") < len(text) - 1, len(_PART.findall(text)) == 4, 12 <= n <= 19, 7 <= n <= 15)[kind]


def added(text: str, found: list[Token], p: np.ndarray, base: list[Span]) -> list[tuple[Span, float]]:
    """Spans of the field with their probability: neighbours of one kind joined, those that touch a base span left out."""
    out: list[tuple[Span, float]] = []
    best = p.argmax(axis=1) if len(p) else []
    i = b = 0
    while i < len(found):
        k, j = int(best[i]), i + 1
        while k and j < len(found) and best[j] == k and found[j].joined:
            j += 1
        if k:
            sure = float(p[i:j, k].mean())
            start, end = found[i].start, found[j - 1].end
            while b < len(base) and base[b][2] <= start:
                b += 1
            if sure >= SURE and whole(k - 1, text[start:end]) and not any(x[1] < end and x[2] > start for x in base[b : b + 4]):
                out.append(((k - 1, start, end), sure))
        i = j
    return out


def personal_data(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, score), a row for each row of ``docs``.

    Spans are kind:start:end in code points, end exclusive, by start, then kind as in KINDS; counts and digest are of base spans
    only; score is the largest probability of an added span, or 0. A null text is empty, ids may be null or repeated, other
    columns don't matter. Texts of any length are taken whole. Without a field (see ``fit``) one is learned from ``docs``.
    """
    field = field or fit(docs, id_col, text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        base = [base_spans(t) for t in texts]
        found = [tokens(t) if t else [] for t in texts]
        g = graph(found)
        p = beliefs(g, unary(g, field.weights), field.edge)[0] if g.nodes else np.zeros((0, LABELS))
        rows, n = [], 0
        for text, spans, own in zip(texts, base, found, strict=True):
            more = added(text or "", own, p[n : n + len(own)], spans)
            n += len(own)
            kinds = [s[0] for s in spans]
            rows.append((*(kinds.count(k) for k in range(len(KINDS))), shown(spans), shown(sorted([*spans, *(s for s, _ in more)], key=lambda s: (s[1], s[0]))), len(more), max((x for _, x in more), default=0.0)))
        digests = [hashlib.sha256(r[4].encode()).hexdigest() for r in rows]
        columns = [batch.column(0), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(4)), pa.array(digests), pa.array([r[5] for r in rows]), pa.array([r[6] for r in rows], pa.int64()), pa.array([r[7] for r in rows], pa.float64())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "score"])

    schema = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint, score double"
    return map_arrow(pairs_of(docs, id_col, text_col), run, schema)
