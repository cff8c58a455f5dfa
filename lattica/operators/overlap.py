"""Pairs of word sets by the share of one that the other holds: exact counts in cells of two blocks, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rows of a block at most, and cells from which blocks are made as large (a cell is a task's unit of work).
BLOCK, CELLS = 32_768, 48
#: A strip of senders: rows, counts held at once, and postings met at once.
STRIP_ROWS, STRIP_COUNTS, STRIP_POSTINGS = 512, 1 << 22, 1 << 22

FOUND = "sender_id long, receiver_id long, technology string, match_confidence double"


def grid(n_a: int, n_b: int) -> tuple[int, int]:
    """Numbers of blocks of both sides, in cells of like sides: about CELLS of them, more where blocks would be above BLOCK rows."""
    side = min(BLOCK, max(1, int((n_a * n_b / CELLS) ** 0.5)))
    return max(1, -(-n_a // side)), max(1, -(-n_b // side))


def least_counts(n: np.ndarray, least: float) -> np.ndarray:
    """The smallest count c of at least 1 with c / n >= least, for each n."""
    c = np.maximum(1, np.floor(least * n).astype(np.int64) - 1)
    while (low := c / n < least).any():
        c[low] += 1
    return c


class Sets:
    """Word sets in one array of codes with the start of each."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray) -> None:
        self.codes, self.sizes, self.starts = codes, sizes, np.concatenate([[0], np.cumsum(sizes)])

    def __len__(self) -> int:
        return len(self.sizes)

    def places(self, rows: np.ndarray) -> np.ndarray:
        return runs(self.starts[rows], self.sizes[rows])

    def take(self, rows: np.ndarray) -> Sets:
        return Sets(self.codes[self.places(rows)], self.sizes[rows])

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.sizes)


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def matched(a: Sets, b: Sets, need: np.ndarray, n_codes: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of a, rows of b, words shared) of the pairs that share ``need`` words or more, strip by strip of a.

    Words that many pairs share are columns of two matrices, multiplied in float32 (counts are far below 2**24);
    the others are met through their postings.
    """
    in_a, in_b = np.bincount(a.codes, minlength=n_codes), np.bincount(b.codes, minlength=n_codes)
    dense = in_a * in_b * 64 > len(a) * len(b)
    column = np.cumsum(dense) - 1
    n_dense = int(dense.sum())

    def matrix(s: Sets) -> np.ndarray:
        out, held = np.zeros((len(s), n_dense), np.float32), dense[s.codes]
        out[s.owners()[held], column[s.codes[held]]] = 1
        return out

    right = matrix(b).T
    order = np.argsort(b.codes, kind="stable")
    postings, first = b.owners()[order], np.concatenate([[0], np.cumsum(in_b)])
    meets = np.where(dense, 0, in_b)
    work = np.concatenate([[0], np.cumsum(np.bincount(a.owners(), meets[a.codes], len(a)).astype(np.int64))])
    rows, at = max(1, min(STRIP_ROWS, STRIP_COUNTS // len(b))), 0
    while at < len(a):
        end = max(at + 1, min(at + rows, len(a), int(np.searchsorted(work, work[at] + STRIP_POSTINGS, "right")) - 1))
        strip = a.take(np.arange(at, end))
        counts = matrix(strip) @ right
        if work[end] > work[at]:
            n = meets[strip.codes]
            flat = np.repeat(strip.owners() * len(b), n) + postings[runs(first[strip.codes], n)]
            counts += np.bincount(flat, minlength=counts.size).reshape(counts.shape)
        i, j = np.nonzero(counts >= need[at:end, None].astype(np.float32))
        if len(i):
            yield at + i, j, counts[i, j]
        at = end


def matches_of_cell(table: pa.Table, least: float) -> Iterator[pa.RecordBatch]:
    """Rows of FOUND for the senders (sent) and receivers of a cell (id, t, words) whose technologies agree; null agrees with every other."""
    names = table["t"].combine_chunks().dictionary_encode()
    t, ids = names.indices.fill_null(-1).to_numpy(zero_copy_only=False), table["id"].combine_chunks()
    lists, sent = table["words"].combine_chunks(), table["sent"].to_numpy()
    flat, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64)
    mine = np.repeat(sent, sizes)
    known = np.intersect1d(flat[mine], flat[~mine])  # words of one side alone are shared by no pair
    codes = np.searchsorted(known, flat)
    held = codes < len(known)
    held[held] = known[codes[held]] == flat[held]
    owner = np.repeat(np.arange(len(sizes)), sizes)[held]
    every = Sets(codes[held], np.bincount(owner, minlength=len(sizes)))
    need = np.zeros(len(sizes), np.int64)
    need[sent] = least_counts(sizes[sent], least)
    able = sent & (every.sizes >= need)
    for group in np.unique(t[able]).tolist():
        a, b = np.flatnonzero(able & (t == group)), np.flatnonzero(~sent & ((t == group) | (t == -1) | (group == -1)))
        if not len(b):
            continue
        for i, j, n in matched(every.take(a), every.take(b), need[a], len(known)):
            i, j = a[i], b[j]
            agreed = np.where(t[i] >= 0, t[i], t[j])
            technology = names.dictionary.take(pa.array(agreed, mask=agreed < 0))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)), ids.take(pa.array(j)), technology, pa.array(n.astype(np.float64) / sizes[i])], ["sender_id", "receiver_id", "technology", "match_confidence"])
