"""Counts over whole texts that the quality operators share."""

from __future__ import annotations

import numpy as np

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Byte classes: lower, upper, digit, symbol but bar, bar, exclamation mark, other ASCII, beyond ASCII, white space.
CLASSES = 9
_CLASS = np.full(256, 6, "u1")
for _c, _b in ((0, b"abcdefghijklmnopqrstuvwxyz"), (1, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (2, b"0123456789"), (3, b"#*$%&<>"), (4, b"|"), (5, b"!"), (7, bytes(range(128, 256))), (8, SPACES.encode())):
    _CLASS[np.frombuffer(_b, "u1")] = _c


def repeat_words(words: list, window: int = 5) -> int:
    """Words in windows of ``window`` words that occur twice or more, first included."""
    n = len(words)
    if n <= window:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    size = len(number)
    if size == n:
        return 0
    ids = np.fromiter(map(number.__getitem__, words), "i8", n)
    key = ids
    for k in range(1, window):
        m = n - k
        if int(key.max()) >= (1 << 62) // size:
            _, key = np.unique(key, return_inverse=True)
        key = key[:m] * size + ids[k : k + m]
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(counts[inverse] > 1)
    if not len(twice):
        return 0
    edge = np.zeros(n + 1, "i8")
    edge[twice] += 1
    np.subtract.at(edge, twice + window, 1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    raw = text.encode()
    words = raw.split()
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    dup, seen = 0, set()
    for line in raw.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    return len(words), chars, symbols, dup, repeat_words(words)


def lines_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every line of every text, and where each text's lines start.

    A line's features follow from its bytes' classes, its words, and whether it
    repeats an earlier line of its text.
    """
    joined = b"\n".join(texts) + b"\n"
    data = np.frombuffer(joined, "u1")
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    n_lines = np.array([t.count(b"\n") + 1 for t in texts])
    first = np.concatenate([[0], np.cumsum(n_lines)])
    kind = _CLASS[data]
    counts = np.empty((len(starts), CLASSES))
    for c in range(CLASSES):
        counts[:, c] = np.add.reduceat((kind == c).view("i1"), starts, dtype="i4")
    counts[:, 8] -= 1  # the line's end
    space = kind == 8
    begins = ~space & np.concatenate([[True], space[:-1]])
    words = np.add.reduceat(begins.view("i1"), starts, dtype="i4").astype(float)
    repeated = np.zeros(len(starts))
    for k, t in enumerate(texts):
        if n_lines[k] > 1:
            seen: set[bytes] = set()
            for i, line in enumerate(t.split(b"\n")):
                if line in seen and line.strip():
                    repeated[first[k] + i] = 1
                seen.add(line)
    solid = counts[:, :8].sum(axis=1)
    share = counts[:, :8] / np.maximum(solid, 1)[:, None]
    features = np.column_stack([np.ones(len(starts)), np.log1p(solid) / 5, np.sqrt(share), np.minimum(solid / np.maximum(words, 1) / 10, 3), repeated, solid == 0, np.log1p(words) / 5])
    return np.column_stack([features, solid]), first


#: Columns of ``lines_of`` that are features; the last one is the line's size.
LINE_FEATURES = 14


def document_statistics(text: str) -> list[float]:
    """Transformed statistics of a whole text, for the quality classifier."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * STATISTICS
    counts = np.bincount(_CLASS[np.frombuffer(raw, "u1")], minlength=CLASSES)[:CLASSES].astype(float)
    solid = counts[:8].sum()
    lines = raw.split(b"\n")
    filled = [x for x in lines if x.strip()]
    lengths = np.fromiter(map(len, words), "i8", n)
    share = lambda x, of: float(np.log(x / of + 0.003))
    different = len(set(words))
    return [
        float(np.log(n)),
        float(lengths.mean()),
        float(np.log1p(lengths.std())),
        share(counts[1], solid),
        share(counts[2], solid),
        share(counts[3], solid),
        share(counts[4], n),
        share(counts[5], n),
        share(counts[6], solid),
        share(counts[7], solid),
        share(repeat_words(words), n),
        float(different / n**0.8),
        share(len(filled) - len(set(filled)), max(len(filled), 1)),
        float(np.log(n / max(len(filled), 1))),
        share(sum(map(bytes.isupper, words)), n),
        share(sum(a == b for a, b in zip(words, words[1:], strict=False)), n),
    ]


STATISTICS = 16
