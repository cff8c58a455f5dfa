"""Fuzzy search for short licence notices: exact seeds first, bounded-error matching after."""

from __future__ import annotations

import bisect
from collections.abc import Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lattica.llm.common import map_arrow, pairs_of

# Phrases whose exact places are counted, and their labels.
BASE = {
    b"under the mit license": "mit",
    b"apache license version 2": "apache-2",
    b"cc by nc": "cc-by-nc",
}

# Short notices for the fuzzy search, the labels they add, and the words that tell them from
# similar notices: those must stand in a match unchanged and together, edits may touch only the rest.
NOTICES = (
    (b"released under the mit license", "mit", (b"mit",)),
    (b"released under the bsd license", "bsd", (b"bsd",)),
    (b"released under the isc license", "isc", (b"isc",)),
    (b"released under the mpl license", "mpl", (b"mpl",)),
    (b"permission is hereby granted free of charge to any person obtaining a copy", "mit", (b"hereby granted",)),
    (b"licensed under the apache license version 2", "apache-2", (b"apache", b"2")),
    (b"licensed under the apache license version 1 1", "apache-1.1", (b"apache", b"1 1")),
    (b"licensed under cc by 4 0", "cc-by", (b"cc by 4",)),
    (b"licensed under cc by nc 4 0", "cc-by-nc", (b"cc by nc 4",)),
    (b"licensed under cc by sa 4 0", "cc-by-sa", (b"cc by sa 4",)),
    (b"licensed under cc by nd 4 0", "cc-by-nd", (b"cc by nd 4",)),
    (b"licensed under cc by nc sa 4 0", "cc-by-nc-sa", (b"cc by nc sa 4",)),
    (b"licensed under cc by nc nd 4 0", "cc-by-nc-nd", (b"cc by nc nd 4",)),
    (b"licensed under the gnu general public license version", "gpl", (b"gnu general",)),
    (b"under the terms of the gnu general public license", "gpl", (b"gnu general",)),
    (b"under the terms of the gnu lesser general public license", "lgpl", (b"gnu lesser general",)),
    (b"licensed under the gnu lesser general public license version", "lgpl", (b"gnu lesser general",)),
    (b"under the terms of the gnu affero general public license", "agpl", (b"gnu affero general",)),
    (b"licensed under the gnu affero general public license version", "agpl", (b"gnu affero general",)),
    (b"redistribution and use in source and binary forms with or without modification", "bsd", (b"source", b"binary")),
    (b"this source code form is subject to the terms of the mozilla public license", "mpl", (b"mozilla",)),
    (b"this is free and unencumbered software released into the public domain", "unlicense", (b"unencumbered",)),
    (b"all rights reserved", "all-rights-reserved", (b"reserved",)),
)

#: One edit for so many bytes of a notice, rounded down, and one at least from SHORT bytes on.
BYTES_PER_EDIT, SHORT = 10, 16

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def edits(notice: bytes) -> int:
    return max(len(notice) // BYTES_PER_EDIT, int(len(notice) >= SHORT))


def pigeonholes(notice: bytes, k: int) -> list[tuple[int, bytes]]:
    """k + 1 pieces with their offsets: a match with k edits at most has one of them unchanged."""
    n, parts = len(notice), k + 1
    cuts = [n * i // parts for i in range(parts + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    """Seeds of all notices in one automaton; a bounded-error pattern for each notice."""

    def __init__(self, notices: Iterable[tuple[bytes, str, tuple[bytes, ...]]] = NOTICES) -> None:
        self.notices = [(x, label, edits(x)) for x, label, _ in notices]
        self.told = [[b" " + words + b" " for words in told] for _, _, told in notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, (x, _, k) in enumerate(self.notices):
            for offset, piece in pigeonholes(x, k):
                seeds.setdefault(piece.decode(), []).append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in seeds.items():
            self.automaton.add_word(piece, (len(piece), uses))
        self.automaton.make_automaton()
        self.patterns = [regex.compile(b"(?e)(?:" + regex.escape(x, literal_spaces=True) + b"){e<=%d}" % k) for x, _, k in self.notices]

    def spans(self, norm: bytes) -> list[tuple[int, int, int, int]]:
        """(start, end, notice, edits) of verified matches in normalised bytes; of overlapping ones the closest, then the longest.

        A seed at its offset fixes where its notice may stand, give or take the edits, so a window little longer
        than the notice is verified; seeds of a place that was verified already are passed over.
        """
        found: list[tuple[int, int, int, int]] = []
        tried: dict[int, tuple[int, bool]] = {}
        # latin-1 keeps one character a byte, so offsets are byte offsets
        for end, (size, uses) in self.automaton.iter(norm.decode("latin-1")):
            for i, offset in uses:
                notice, _, k = self.notices[i]
                start = end + 1 - size - offset
                last, hit = tried.get(i, (-1 - k, False))
                if start == last or (hit and abs(start - last) <= k):
                    continue
                a, b = max(0, start - k), start + len(notice) + k
                # most seeds are common words: the telling words are looked for before the costly pattern
                m = self.patterns[i].search(norm, a, b) if self._told(norm, a, b, i) else None
                ok = m is not None and self._told(norm, m.start(), m.end(), i)
                tried[i] = (start, ok)
                if ok:
                    found.append((m.start(), m.end(), i, sum(m.fuzzy_counts)))
        kept: list[tuple[int, int, int, int]] = []
        for x in sorted(set(found), key=lambda x: (x[3], x[0] - x[1], x)):
            at = bisect.bisect(kept, x)
            if (at == 0 or kept[at - 1][1] <= x[0]) and (at == len(kept) or x[1] <= kept[at][0]):
                kept.insert(at, x)
        return kept

    def _told(self, norm: bytes, start: int, end: int, i: int) -> bool:
        """Whether the words that tell the notice from others stand in a range as whole words."""
        a = norm.rfind(b" ", 0, start) + 1
        b = norm.find(b" ", end)
        whole = b" " + norm[a : len(norm) if b < 0 else b] + b" "
        return all(words in whole for words in self.told[i])


def normalise(text: str | None) -> bytes:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z in lower case, joined by one space."""
    return b" ".join(text.encode("utf-8", "surrogatepass").translate(_TABLE).split()) if text else b""


def base_places(norm: bytes, phrases: dict[bytes, str]) -> list[tuple[int, int, str]]:
    """(byte offset, length, label) of every place where a phrase's words stand consecutively."""
    padded, out = b" " + norm + b" ", []
    for phrase, label in phrases.items():
        at = padded.find(needle := b" " + phrase + b" ")
        while at >= 0:
            out.append((at, len(phrase), label))
            at = padded.find(needle, at + 1)
    return sorted(out)


_SCHEMA = (
    "_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<first_word:long,last_word:long,label:string,edits:int>>"
)
_SPAN = pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("label", pa.string()), ("edits", pa.int32())]))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[bytes, str] | None = None, notices: Iterable[tuple[bytes, str, tuple[bytes, ...]]] = NOTICES) -> DataFrame:
    """One row for each document: exact phrase places, fuzzy labels, score and verified spans; no shuffle.

    ``score`` is 1 for an exact phrase, else 1 - edits / bytes of the best fuzzy match, else 0.
    A null or empty text has 0 words, no labels ('' strings), score 0 and null places. Whole texts are
    scanned, however long, in time linear in their length and matches. Rows repeat as they come; exact places all
    count, of overlapping fuzzy matches the one with fewest edits, then the longest, then the first; null ids
    stay null; other columns are ignored; an empty table gives an empty table.
    """
    phrases, notices = phrases or BASE, tuple(notices)
    state: list[Scanner] = []

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not state:
            state.append(Scanner(notices))
        scanner, rows = state[0], []
        for text in batch.column(1).to_pylist():
            norm = normalise(text)
            base, found = base_places(norm, phrases), scanner.spans(norm)
            n_words = norm.count(b" ") + 1 if norm else 0
            base_labels = {label for *_, label in base}
            labels, spans, score, starts = set(base_labels), [], 1.0 if base else 0.0, []
            if base or found:
                blanks = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
                word_at = lambda at, blanks=blanks: int(np.searchsorted(blanks, at))
                starts = [word_at(at) for at, *_ in base]
                for a, b, i, cost in found:
                    notice, label, _ = scanner.notices[i]
                    labels.add(label)
                    first = word_at(a + (norm[a : a + 1] == b" "))
                    spans.append({"first_word": first, "last_word": first + norm[a:b].strip().count(b" "), "label": label, "edits": cost})
                    score = max(score, 1 - cost / len(notice))
            rows.append((n_words, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, spans))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), _SPAN]
        arrays = [pa.array(list(x), kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return map_arrow(pairs_of(docs, id_col, text_col), scan, _SCHEMA).withColumnRenamed("_id", id_col)
