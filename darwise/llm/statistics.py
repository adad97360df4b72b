"""Figures of a text that quality rules and classifiers look at, for a slice of rows at a time."""

import numpy as np

from darwise.llm.text import SPACE, Slice, rows_of, run_hashes, sequence_hashes

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
CONTINUES = (np.arange(256) & 0xC0) == 0x80  # not the first byte of a character
UPPER, DIGIT, MARK = (np.zeros(256, bool) for _ in range(3))
UPPER[65:91], DIGIT[48:58] = True, True
MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
NEWLINE = np.zeros(256, bool)
NEWLINE[10] = True
REPEAT_WINDOW = 5


def per_row(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums over the rows' bytes."""
    return np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[off[1:]] - np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[off[:-1]]


def counted(row: np.ndarray, rows: int, weights=None) -> np.ndarray:
    return np.bincount(row, weights=weights, minlength=rows)


def groups(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item: how many items of its row have its key, and whether an earlier one has."""
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    order = np.lexsort((key, row))
    r, k = row[order], key[order]
    heads = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (k[1:] != k[:-1])]))
    sizes = np.diff(np.append(heads, len(row)))
    n, later = np.empty(len(row), np.int64), np.ones(len(row), bool)
    n[order] = np.repeat(sizes, sizes)
    later[order[heads]] = False  # lexsort is stable
    return n, later


def statistics(part: Slice) -> dict[str, np.ndarray]:
    """One number per row and figure; see the comments."""
    data, off, rows = part.data, part.off, len(part.off) - 1
    starts, ends, first = part.words()
    row, n_words = rows_of(first), np.diff(first)
    hashes = run_hashes(data, starts, ends)
    gap, char = SPACE[data], ~CONTINUES[data]
    out = {
        "n_words": n_words,
        "n_chars": per_row(char, off),
        "word_chars": per_row(char & ~gap, off),  # characters in words
        "n_symbols": per_row(SYMBOL[data], off),
        "n_upper": per_row(UPPER[data], off),
        "n_digits": per_row(DIGIT[data], off),
        "n_marks": per_row(MARK[data], off),
    }
    # Lines: from one \n (or the row's start) to the next; those with a word count.
    cuts = np.union1d(off[:-1][off[:-1] < off[1:]], np.flatnonzero(NEWLINE[data]) + 1)
    cuts = cuts[cuts < len(data)] if len(data) else cuts[:0]
    to = np.append(cuts[1:], len(data)) if len(cuts) else cuts
    to = to - (NEWLINE[data[to - 1]] if len(cuts) else 0)
    if len(starts) and len(cuts):
        word_line = np.searchsorted(cuts, starts, side="right") - 1
        held = np.unique(word_line)
    else:
        held = np.zeros(0, np.int64)
    line_row = np.searchsorted(off, cuts[held], side="right") - 1
    _, later = groups(line_row, run_hashes(data, cuts[held], np.maximum(to[held], cuts[held])))
    out["n_lines"] = counted(line_row, rows)
    out["n_dup_lines"] = counted(line_row[later], rows)
    # Words in windows that the text has twice or more.
    left = np.repeat(first[1:], n_words) - np.arange(len(starts))
    at = np.flatnonzero(left >= REPEAT_WINDOW)
    again = np.zeros(len(starts) + 1, np.int64)
    if len(at):
        n, _ = groups(row[at], sequence_hashes(hashes, REPEAT_WINDOW)[at])
        twice = at[n > 1]
        again[twice] += 1
        again[twice + REPEAT_WINDOW] -= 1
    out["n_repeat_words"] = counted(row[np.cumsum(again)[:-1] > 0], rows)
    n, later = groups(row, hashes)
    out["n_distinct_words"] = n_words - counted(row[later], rows)
    # How uneven the words are: sum of squared counts.
    out["same_pairs"] = counted(row, rows, weights=n.astype(float)) if len(row) else np.zeros(rows)
    length = counted(row, rows, weights=(np.concatenate([[0], np.cumsum(char)])[ends] - np.concatenate([[0], np.cumsum(char)])[starts]).astype(float) ** 2) if len(row) else np.zeros(rows)
    out["square_chars"] = length  # of word lengths
    return out
