"""Deep-shallow sorting of suffixes, up to a depth that counts as equal.

Rounds of multikey sorting with eight bytes as a symbol order suffixes down to a
shallow depth: sort a group by its symbol, go on with the groups of equal ones. As
in multikey quicksort, no symbol of a suffix is read twice; but all groups of a round
are sorted by symbol in one call of numpy, not split in three around pivots.
What is still tied has a long common prefix, and a blind trie orders it: its
nodes hold only the place of a branching and the bytes there, so a suffix is led
to one leaf, compared with that alone, and put in where the two part.
"""

from __future__ import annotations

import numpy as np

_SYMBOL = 8


class BlindTrie:
    """Distinct strings of one length. Nodes are ``[place, {byte: child}]``,
    leaves are strings."""

    def __init__(self) -> None:
        self.root: list | bytes | None = None

    def add(self, text: bytes) -> None:
        if self.root is None:
            self.root = text
            return
        node = self.root
        while isinstance(node, list):
            # A byte no child has: any leaf below tells where the text parts.
            node = node[1].get(text[node[0]]) or next(iter(node[1].values()))
        if node == text:
            return
        at = next(i for i, (a, b) in enumerate(zip(node, text)) if a != b)
        other, parent, node = node[at], None, self.root
        while isinstance(node, list) and node[0] < at:
            parent, node = node, node[1][text[node[0]]]
        if isinstance(node, list) and node[0] == at:
            node[1][text[at]] = text
            return
        branch = [at, {other: node, text[at]: text}]
        if parent is None:
            self.root = branch
        else:
            parent[1][text[parent[0]]] = branch

    def in_order(self) -> list[bytes]:
        found, todo = [], [self.root] if self.root is not None else []
        while todo:
            node = todo.pop()
            if isinstance(node, list):
                todo.extend(child for _, child in sorted(node[1].items(), reverse=True))
            else:
                found.append(node)
        return found


def symbols(buffer: bytes) -> np.ndarray:
    """The eight bytes at every place as a number that sorts like them."""
    return np.ndarray((len(buffer) - _SYMBOL + 1,), ">u8", buffer, strides=(1,))


def sort_suffixes(
    buffer: bytes, starts: np.ndarray, group: np.ndarray, depth: int, shallow: int = 16
) -> tuple[np.ndarray, np.ndarray]:
    """``order, equal``: the order of suffixes ``starts`` of ``buffer`` within
    each ``group`` by their first ``depth`` bytes, and for every place in that
    order the number of its class of suffixes equal so far down.

    ``buffer`` must go on for eight bytes behind the last suffix.
    """
    words = symbols(buffer)
    order = np.argsort(group, kind="stable")
    cls = np.concatenate([[0], np.cumsum(np.diff(group[order]) != 0)])
    for at in range(0, min(shallow, depth), _SYMBOL):
        if not len(order):
            break
        size = np.bincount(cls)
        tied = np.flatnonzero(size[cls] > 1)
        if not len(tied):
            break
        symbol = words[starts[order[tied]] + at].astype(np.uint64)
        if depth - at < _SYMBOL:
            symbol >>= np.uint64(8 * (_SYMBOL - (depth - at)))
        inner = np.lexsort((symbol, cls[tied]))
        order[tied] = order[tied][inner]
        symbol = symbol[inner]
        step = np.zeros(len(order), dtype=bool)
        step[tied[1:]] = (symbol[1:] != symbol[:-1]) & (cls[tied[1:]] == cls[tied[:-1]])
        step[1:] |= cls[1:] != cls[:-1]
        cls = np.cumsum(step)
    if depth > shallow and len(order):
        _order_deep(buffer, words, starts, order, cls, depth, shallow)
        cls = np.concatenate([[0], np.cumsum(np.diff(cls) != 0)])
    return order, cls


def _order_deep(buffer, words, starts, order, cls, depth, shallow) -> None:
    """Order the groups tied at ``shallow`` in place, and split their classes."""
    first = np.flatnonzero(np.concatenate([[True], np.diff(cls) != 0]))
    ends = np.append(first[1:], len(order))
    head = np.repeat(first, ends - first)
    # A trie of one leaf: all members equal the first one down to the depth.
    same = np.ones(len(order), dtype=bool)
    for at in range(shallow, depth, _SYMBOL):
        at = min(at, depth - _SYMBOL)
        place = starts[order] + at
        same &= words[place] == words[place[head]]
    split = np.flatnonzero(~np.logical_and.reduceat(same, first))
    cls *= 2 * len(order)  # room for the classes of a group between two groups
    for lo, hi in zip(first[split].tolist(), ends[split].tolist()):
        trie, members = BlindTrie(), {}
        for i in order[lo:hi].tolist():
            tail = buffer[starts[i] + shallow : starts[i] + depth]
            if tail not in members:
                trie.add(tail)
                members[tail] = []
            members[tail].append(i)
        at = lo
        for n, tail in enumerate(trie.in_order()):
            own = members[tail]
            order[at : at + len(own)] = own
            cls[at : at + len(own)] += n
            at += len(own)
