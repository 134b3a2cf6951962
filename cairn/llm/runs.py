"""Sorted runs, cut into blocks, and their merge by a tournament.

A run is a sequence of entries (key, ...) in the order of their keys. It is stored as blocks, so a merge holds about a block of each
run, however long the runs are. A merge reads blocks in the order of their first keys, whatever run they are of: a block is needed
only when its first key is reached, so one iterator feeds any number of runs.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

#: Entries of a run that is sorted in a task's memory, and of a block.
RUN, BLOCK = 1 << 16, 1 << 12


class Tournament:
    """A tree whose leaves are runs and whose every node holds the leaf with the least head below it. Runs may come and go."""

    def __init__(self):
        self.size = 1
        self.heads: list[tuple | None] = [None]
        self.queues: list[deque] = [deque()]
        self.winner = [0, 0]
        self.leaf: dict = {}
        self.owner: list = [None]
        self.free = [0]

    def add(self, run, entries: Iterable[tuple]) -> None:
        """Another block of a run; its keys are behind those that came before."""
        leaf = self.leaf.get(run)
        if leaf is None:
            if not self.free:
                self._grow()
            leaf = self.leaf[run] = self.free.pop()
            self.owner[leaf] = run
        self.queues[leaf].append(iter(entries))
        if self.heads[leaf] is None:
            self._advance(leaf)

    def least(self) -> tuple | None:
        return self.heads[self.winner[1]] if self.size > 1 else self.heads[0]

    def pop(self) -> tuple:
        leaf = self.winner[1] if self.size > 1 else 0
        head = self.heads[leaf]
        self._advance(leaf)
        return head

    def rest(self) -> Iterator[tuple]:
        """What is left, run by run."""
        for head, queue in zip(self.heads, self.queues, strict=True):
            if head is not None:
                yield head
            for entries in queue:
                yield from entries

    def _advance(self, leaf: int) -> None:
        queue, head = self.queues[leaf], None
        while queue and head is None:
            head = next(queue[0], None)
            if head is None:
                queue.popleft()
        self.heads[leaf] = head
        if head is None:
            del self.leaf[self.owner[leaf]]
            self.free.append(leaf)
        node = (self.size + leaf) >> 1
        while node:
            self._play(node)
            node >>= 1

    def _play(self, node: int) -> None:
        left, right = (self.winner[c] if c < self.size else c - self.size for c in (2 * node, 2 * node + 1))
        a, b = self.heads[left], self.heads[right]
        self.winner[node] = right if a is None or (b is not None and b[0] < a[0]) else left

    def _grow(self) -> None:
        self.free += range(self.size, 2 * self.size)
        self.heads += [None] * self.size
        self.owner += [None] * self.size
        self.queues += [deque() for _ in range(self.size)]
        self.size *= 2
        self.winner = [0] * self.size
        for node in range(self.size - 1, 0, -1):
            self._play(node)


def merge(blocks: Iterable[tuple[object, list[tuple]]], tree: Tournament | None = None) -> Iterator[tuple]:
    """The entries of all runs in the order of their keys. blocks: (run, entries), none empty, in the order of their first keys."""
    tree = Tournament() if tree is None else tree
    for run, entries in blocks:
        first = entries[0][0]
        try:
            while (head := tree.least()) is not None and head[0] < first:
                yield tree.pop()
        finally:  # also where the merge is closed before its end: the block is then among the rest of the tree
            tree.add(run, entries)
    while tree.least() is not None:
        yield tree.pop()
