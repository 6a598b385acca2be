"""Deep-shallow sorting of byte strings.

Multikey quicksort orders strings by eight bytes at a time down to a shallow
depth. Groups that are still equal there have long common prefixes; a blind trie
(a Patricia trie that looks at branching bytes only) orders each of them.
"""

from __future__ import annotations

SHALLOW = 16
WORD = 8


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


class BlindTrie:
    """Patricia trie over strings; a node is ``[depth, {byte: child}]``, a leaf a
    list of the indices of equal strings. A string that ends has byte -1."""

    def __init__(self, strings: list[bytes]):
        self.strings, self.top = strings, None

    def insert(self, i: int) -> None:
        s = self.strings[i]
        if self.top is None:
            self.top = (None, [i])
            return
        node = self.top
        while node[0] is not None:  # blindly to some leaf
            depth, children = node
            node = children.get(s[depth] if depth < len(s) else -1) or next(iter(children.values()))
        other = self.strings[node[1][0]]
        if other == s:
            node[1].append(i)
            return
        at = common_prefix(s, other)
        parent, key, node = None, None, self.top
        while node[0] is not None and node[0] < at:
            parent, key = node, s[node[0]] if node[0] < len(s) else -1
            node = node[1][key]
        byte = s[at] if at < len(s) else -1
        if node[0] == at:
            node[1][byte] = (None, [i])
            return
        split = (at, {byte: (None, [i]), other[at] if at < len(other) else -1: node})
        if parent is None:
            self.top = split
        else:
            parent[1][key] = split

    def ordered(self) -> list[int]:
        out: list[int] = []
        todo = [self.top] if self.top else []
        while todo:
            depth, below = todo.pop()
            if depth is None:
                out += below
            else:
                todo += [below[k] for k in sorted(below, reverse=True)]
        return out


def _word(s: bytes, depth: int) -> bytes:
    return s[depth : depth + WORD]


def deep_shallow(strings: list[bytes], skip: int = 0, shallow: int = SHALLOW) -> list[int]:
    """Indices of ``strings`` in byte order, equal ones in their order of index.
    All strings share their first ``skip`` bytes."""
    out: list[int] = []
    todo: list[tuple[list[int], int]] = [(list(range(len(strings))), skip)]
    while todo:
        own, depth = todo.pop()
        if len(own) < 2:
            out += own
        elif depth >= skip + shallow:
            trie = BlindTrie(strings)
            for i in own:
                trie.insert(i)
            out += trie.ordered()
        else:
            words = [_word(strings[i], depth) for i in own]
            pivot = sorted((words[0], words[len(words) // 2], words[-1]))[1]
            less = [i for i, w in zip(own, words, strict=True) if w < pivot]
            same = [i for i, w in zip(own, words, strict=True) if w == pivot]
            more = [i for i, w in zip(own, words, strict=True) if w > pivot]
            todo.append((more, depth))
            # Strings that end within the word are equal: the trie keeps them together.
            todo.append((same, depth + WORD if len(pivot) == WORD else skip + shallow))
            todo.append((less, depth))
    return out


def lcp_array(strings: list[bytes], order: list[int]) -> list[int]:
    """Common prefix of each string with the one before it; 0 for the first."""
    return [0] + [common_prefix(strings[a], strings[b]) for a, b in zip(order, order[1:], strict=False)]
