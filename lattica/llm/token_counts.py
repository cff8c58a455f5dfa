"""Token counts by heap-and-linked-list byte-pair merging, with no identifiers emitted."""

from __future__ import annotations

import heapq
import json
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lattica.llm.common import map_arrow, pairs_of

#: White space as the tokenizer's own regex engine has it.
_WS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Words of which a worker remembers the count before it starts anew.
MEMO = 500_000


def byte_alphabet() -> list[str]:
    """The printable character for each byte of a byte-level vocabulary (a public rule)."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


def count_symbols(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left once no adjacent pair has a rank: initial symbols minus merges.

    Adjacent pairs wait in a heap by (rank, position); symbols form a doubly linked list.
    A popped pair counts only if both sides still are what they were when it was pushed.
    """
    n = len(symbols)
    if n < 2:
        return n
    text, left, right = list(symbols), list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i]
        if text[i] != a or j < 0 or text[j] != b:
            continue
        text[i], text[j] = a + b, ""
        merges += 1
        k = right[i] = right[j]
        if k >= 0:
            left[k] = i
            if (r := ranks.get((text[i], text[k]))) is not None:
                heapq.heappush(heap, (r, i, text[i], text[k]))
        h = left[i]
        if h >= 0 and (r := ranks.get((text[h], text[i]))) is not None:
            heapq.heappush(heap, (r, h, text[h], text[i]))
    return n - merges


class WordCounter:
    """Counts the tokens of whole texts for a word-end byte-level vocabulary file (.json)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.ranks = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.alphabet = byte_alphabet()
        specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.specials = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.first = [s[0:2] for s in specials]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace("\\s", _WS)
        self.words = regex.compile(pattern)
        self.blank = regex.compile(f"[{_WS}]+")
        self.memo: dict[str, int] = {}

    def word(self, word: str) -> int:
        symbols = [self.alphabet[b] for b in word.encode()]
        symbols[-1] += self.end
        return count_symbols(symbols, self.ranks)

    def plain(self, text: str) -> int:
        text = unicodedata.normalize("NFC", text)
        text = self.blank.sub(" ", text) if not text.isascii() else text
        # one character at a time: a final capital sigma has no special form here
        text = text.lower() if "Σ" not in text else "σ".join(x.lower() for x in text.split("Σ"))
        memo, total = self.memo, 0
        for w in self.words.findall(text):
            n = memo.get(w)
            if n is None:
                if len(memo) >= MEMO:
                    memo.clear()
                n = self.word(w)
                if len(w) < 64:
                    memo[w] = n
            total += n
        return total

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        if self.specials is None or not any(x in text for x in self.first):
            return self.plain(text)
        total, at = 0, 0
        for m in self.specials.finditer(text):
            total += self.plain(text[at : m.start()]) + 1
            at = m.end()
        return total + self.plain(text[at:])


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row; no shuffle.

    A null text counts as empty (0 bytes, 0 tokens). Rows repeat as they come; a null id
    stays null; an empty table gives an empty table; other columns are ignored.
    Very long texts are counted whole: a word's merges cost n log n.
    """
    state: list[WordCounter] = []

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not state:
            state.append(WordCounter(vocabulary))
        texts = batch.column(1).to_pylist()
        tokens = [state[0].text(t) for t in texts]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
            names=["_id", "n_bytes", "n_tokens", "over_limit"],
        )

    out = map_arrow(pairs_of(docs, id_col, text_col), count, "_id long, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("_id", id_col)
