"""Sorting byte strings deep-shallow, and finding repeats around shared anchors.

The shallow phase is a multikey quicksort over 8-byte super-characters, a fixed number of them; all open segments of all groups are
split in three at a time. Strings that still tie share a long prefix; each such group is ordered by a blind trie, which stores only the positions where strings part, so
a string is compared in full once, with one leaf.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 2  # super-characters


def shared_prefix(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    return n if a == b else n - ((int.from_bytes(a) ^ int.from_bytes(b)).bit_length() + 7) // 8


class BlindTrie:
    """A Patricia trie over byte strings: [depth, {next byte or -1 at a string's end: child}], leaves are lists of numbers."""

    def __init__(self, strings: list[bytes]):
        self.strings, self.root = strings, None

    def insert(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = ("leaf", [i])
            return
        node = self.root
        while node[0] != "leaf":  # blind: only branching bytes are looked at
            node = node[1].get(s[node[0]] if node[0] < len(s) else -1) or next(iter(node[1].values()))
        other = self.strings[node[1][0]]
        depth = shared_prefix(s, other)
        if depth == len(s) == len(other):
            node[1].append(i)
            return
        mine = s[depth] if depth < len(s) else -1
        above, edge, node = None, None, self.root
        while node[0] != "leaf" and node[0] < depth:
            above, edge = node, s[node[0]]
            node = node[1][edge]
        if node[0] == depth:
            node[1][mine] = ("leaf", [i])
            return
        split = (depth, {mine: ("leaf", [i]), (other[depth] if depth < len(other) else -1): node})
        if above is None:
            self.root = split
        else:
            above[1][edge] = split

    def ordered(self) -> tuple[list[int], list[int]]:
        """Numbers in string order, and each one's common prefix with the one before it (the first: -1)."""
        order: list[int] = []
        shared: list[int] = []
        stack = [(self.root, -1)]
        while stack:
            node, depth = stack.pop()
            if node[0] == "leaf":
                order += node[1]
                shared += [depth, *[len(self.strings[node[1][0]])] * (len(node[1]) - 1)]
            else:
                keys = sorted(node[1], reverse=True)
                stack += [(node[1][k], node[0]) for k in keys[:-1]]
                stack.append((node[1][keys[-1]], depth))
        return order, shared


def multikey_quicksort(keys: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of the rows of ``keys`` (strings x super-characters) within each group, groups in rising order.

    A segment holds strings of one group that agree in the super-characters before its depth. Each round splits every open
    segment at the median of three of its super-characters into less, equal and greater; equal ones go on one deeper.
    """
    order = np.argsort(group, kind="stable")
    g = group[order]
    start = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(g)))
    depth = np.zeros(len(start), np.int64)
    while True:
        open_ = (size > 1) & (depth < keys.shape[1])
        start, size, depth = start[open_], size[open_], depth[open_]
        if not len(start):
            return order
        of = np.repeat(np.arange(len(start)), size)
        at = np.arange(len(of)) + np.repeat(start - (np.cumsum(size) - size), size)
        v = keys[order[at], depth[of]]
        three = np.sort(np.stack([keys[order[start + k], depth] for k in (0 * size, size // 2, size - 1)]), axis=0)
        pivot = three[1][of]
        side = 3 * of + (v >= pivot) + (v > pivot)
        order[at] = order[at][np.argsort(side, kind="stable")]
        n = np.bincount(side, minlength=3 * len(start)).reshape(-1, 3)
        begin = start[:, None] + np.cumsum(n, axis=1) - n
        start, size, depth = begin.ravel(), n.ravel(), (depth[:, None] + np.array([0, 1, 0])).ravel()


def deep_shallow(strings: list[bytes], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts strings within each group: (order, common prefix with the string before, -1 at the start of a group).

    Groups come in rising order of their number.
    """
    n, width = len(strings), SHALLOW * 8
    lengths = np.fromiter(map(len, strings), np.int64, n)
    raw = np.frombuffer(b"".join(s[:width].ljust(width, b"\0") for s in strings), ">u8").reshape(n, SHALLOW).astype(np.uint64)
    # a string that ends within the shallow depth sorts before one that goes on with zeros
    short = np.minimum(lengths, width)
    order = multikey_quicksort(np.column_stack((raw, short.astype(np.uint64))), group)
    g, r, m = group[order], raw[order], short[order]
    shared = np.full(n, -1, np.int64)
    if n > 1:
        x = r[1:] ^ r[:-1]
        same = np.full(n - 1, width, np.int64)
        for k in range(SHALLOW - 1, -1, -1):
            part = x[:, k]
            zeros = np.zeros(n - 1, np.int64)
            for b in range(8):
                zeros += (part >> np.uint64(8 * (7 - b))) == 0
            same = np.where(part == 0, same, k * 8 + zeros)
        same = np.minimum(same, np.minimum(m[1:], m[:-1]))
        shared[1:] = np.where(g[1:] == g[:-1], same, -1)
    tied = np.zeros(n + 1, bool)
    tied[1:n] = (shared[1:] == width) & (m[1:] == width) & (m[:-1] == width)
    starts = np.flatnonzero(~tied[:-1] & tied[1:])
    for s in starts.tolist():
        e = s + 1
        while tied[e]:
            e += 1
        if e - s == 2:
            a, b = order[s], order[s + 1]
            x, y = strings[a], strings[b]
            if x > y:
                order[s], order[s + 1] = b, a
            shared[s + 1] = shared_prefix(x, y)
            continue
        trie = BlindTrie(strings)
        for i in order[s:e].tolist():
            trie.insert(i)
        o, c = trie.ordered()
        order[s:e] = o
        shared[s + 1 : e] = c[1:]
    return order, shared


def repeated_starts(contexts: list[bytes], anchor: np.ndarray, low: np.ndarray, count: np.ndarray, group: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Which strings of ``length`` bytes around each anchor occur more than once in its group.

    Context i has its anchor at ``anchor[i]``; it holds the strings that start x bytes before the anchor for x
    from ``low[i]`` to ``anchor[i]``. Items of a group agree in the ``gram`` bytes from the anchor on. An item
    stands for ``count[i]`` occurrences. Returns a matrix over (item, x).

    Two strings that start x bytes before their anchors are equal if they agree in x bytes to the left and length - x to
    the right of it. Both sides are sorted once; then, for every x, the classes of equal left and right sides
    are runs of the two orders, and a pair of classes that two items share is a repeat.
    """
    n, top = len(contexts), int(anchor.max(initial=0))
    out = np.zeros((n, top + 1), bool)
    at = anchor.tolist()
    r_order, r_shared = deep_shallow([c[a + gram :] for c, a in zip(contexts, at)], group)
    l_order, l_shared = deep_shallow([c[:a][::-1] for c, a in zip(contexts, at)], group)
    r_class, l_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for x in range(top + 1):
        on = np.flatnonzero((low <= x) & (x <= anchor))
        if not len(on):
            continue
        r_class[r_order] = np.cumsum(r_shared < length - gram - x)
        l_class[l_order] = np.cumsum(l_shared < x)
        key = r_class[on] * (n + 1) + l_class[on]
        by = np.argsort(key, kind="stable")
        k = key[by]
        new = np.append(True, k[1:] != k[:-1])
        total = np.add.reduceat(count[on][by], np.flatnonzero(new))
        out[on[by], x] = (total > 1)[np.cumsum(new) - 1]
    return out
