"""Shingle sets and their fast similarity sketches, for batches of texts.

A word is a 64-bit hash, a shingle a linear combination of its words' hashes and a
set the sorted distinct combinations; two different shingles of a pair of texts get
one value with a probability of 2**-64.
"""

from __future__ import annotations

import numpy as np
import xxhash

WORDS_AT_ONCE = 1 << 19     # words that a task hashes together; a longer text is a batch of its own
FILL = np.uint64(0xFFFFFFFFFFFFFFFF)
ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on all input bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return (text or "").encode().lower().split()


def shingle_sets(texts, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts): the distinct shingles of text i, sorted, are hashes[starts[i]:starts[i + 1]].

    A text of fewer words than a shingle is one shingle, a text without words none.
    """
    words, counts = [], []
    for text in texts:
        found = words_of(text)
        words += found
        counts.append(len(found))
    n = np.array(counts, np.int64)
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter(map(digest, words), np.uint64, len(words))
    del words
    first = np.concatenate([[0], np.cumsum(n)])
    # a position starts a shingle if enough words follow in its text, or if it is the first of a short one
    total = len(hashes)
    text_at = np.repeat(np.arange(len(n)), n)
    left = first[1:][text_at] - np.arange(total)
    short = (n < shingle)[text_at]
    starts = np.flatnonzero((left >= shingle) | (short & (left == n[text_at])))
    sums = np.minimum(n, shingle)[text_at[starts]].astype(np.uint64) * ODD
    for k in range(shingle):
        factor = mixed(np.array([k + 1], np.uint64) * ODD) | np.uint64(1)
        inside = left[starts] > k
        at = np.minimum(starts + k, max(total - 1, 0))
        sums = sums + np.where(inside, hashes[at] * factor, np.uint64(0))
    values, owner = mixed(sums), text_at[starts]
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[keep], owner[keep]
    return values, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(n)))]).astype(np.int64)


def set_digests(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """128 bits per set as two columns of longs: sums of two hashes over its members, zero for the empty set."""
    out = []
    for salt in (1, 2):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(values ^ mixed(np.array([salt], np.uint64) * ODD)))])
        out.append(sums[starts[1:]] - sums[starts[:-1]])
    return np.stack(out, axis=1).view(np.int64)


def sketch(values: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Fast similarity sketches: ``size`` coordinates per set, all filled unless the set is empty.

    Round i throws every member into one bin with a hash of its own; a bin keeps the
    smallest value of the first round that reached it. After ``size`` rounds, round
    size + j looks at bin j alone and throws all members into it, so that no bin
    stays empty. Two sets agree in a coordinate with their Jaccard similarity as
    probability, with the concentration of independent draws. Only sets with an
    empty bin take part in the next round: a set much larger than ``size`` needs one
    or two.
    """
    n_sets = len(starts) - 1
    out = np.full(n_sets * size, FILL)
    lengths = np.diff(starts)
    open_sets = np.flatnonzero(lengths > 0)
    for i in range(size):
        if not len(open_sets):
            break
        members, owner = _members(values, starts, open_sets)
        thrown = mixed(members + mixed(np.array([i + 1], np.uint64) * ODD))
        bins = (thrown & np.uint64(0xFFFF)).astype(np.int64) * size >> 16
        at = owner * size + bins
        free = out[at] == FILL
        np.minimum.at(out, at[free], np.minimum(mixed(thrown[free]), FILL - np.uint64(1)))
        filled = (out.reshape(n_sets, size)[open_sets] != FILL).all(axis=1)
        open_sets = open_sets[~filled]
    if len(open_sets):
        rows, cols = np.nonzero(out.reshape(n_sets, size)[open_sets] == FILL)
        for j in np.unique(cols):
            some = open_sets[rows[cols == j]]
            members, owner = _members(values, starts, some)
            thrown = mixed(mixed(members + mixed(np.array([size + j + 1], np.uint64) * ODD)))
            np.minimum.at(out, owner * size + j, np.minimum(thrown, FILL - np.uint64(1)))
    return out.reshape(n_sets, size)


def _members(values: np.ndarray, starts: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The members of some sets, each with the number of its set."""
    lengths = starts[some + 1] - starts[some]
    owner = np.repeat(some, lengths)
    shift = np.repeat(starts[some] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    return values[np.arange(lengths.sum()) + shift], owner


def band_keys(sketches: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` coordinates, as longs; the band's number is part of the key."""
    n, size = sketches.shape
    bands = size // rows
    parts = sketches[:, :bands * rows].reshape(n, bands, rows)
    keys = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=np.uint64) * ODD), (n, bands)).copy()
    for k in range(rows):
        keys = mixed(keys * ODD + parts[:, :, k])
    return keys.view(np.int64)


def batches_by_words(lengths, limit: int = WORDS_AT_ONCE):
    """Runs (from, to) of texts with about ``limit`` words together, guessed from their lengths in bytes."""
    at, size = 0, 0
    for i, length in enumerate(lengths):
        words = (length or 0) // 5
        if i > at and size + words > limit:
            yield at, i
            at, size = i, 0
        size += words
    if at < len(lengths):
        yield at, len(lengths)
