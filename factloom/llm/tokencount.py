"""Token counts by a linear longest-match automaton.

Greedy longest-match-first splitting of a word takes the longest vocabulary piece at its front, again and again. The
automaton is a trie of the pieces. A node from which the next byte has no edge fails over: the pieces that greedy
matching would take of the node's string are popped and the walk goes on at the node of what is left. Only the number
of popped pieces is kept, computed ahead for every node, so a word's length in pieces comes from one walk in which
every byte is read once and no piece is built.

The distinct words of a slice of texts walk in lock-step, a byte position at a time, in numpy; those over LONG bytes,
for which lock-step would take a round of calls a byte, walk one by one over plain lists.

Defined cases: a null or empty text has no words and no tokens; a byte that no piece can start with counts one
(unknown) piece; words are the matches of the given pattern; repeated rows count each; an empty table gives no rows;
input columns named like an output column are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

from factloom.llm.common import map_arrow, without

#: Words that each of a worker's two generations remembers.
REMEMBERED = 300_000
#: Bytes from which a word walks by itself.
LONG = 64


class Automaton:
    """The trie of `pieces` with failure links (`fail`) and the number of pieces popped on failure (`pops`)."""

    def __init__(self, pieces: Iterable[bytes]):
        import numpy as np

        self.children: list[dict[int, int]] = [{}]
        ends, depth, parent, byte = {0: False}, [0], [0], [0]
        for piece in {*pieces, *(bytes([b]) for b in range(256))} - {b""}:
            at = 0
            for b in piece:
                to = self.children[at].get(b)
                if to is None:
                    to = len(self.children)
                    self.children[at][b] = to
                    self.children.append({})
                    depth.append(depth[at] + 1)
                    parent.append(at)
                    byte.append(b)
                at = to
            ends[at] = True
        n = len(self.children)
        self.fail, self.pops = np.zeros(n, np.int32), np.zeros(n, np.int64)
        for node in sorted(range(1, n), key=depth.__getitem__):
            if ends.get(node):
                self.fail[node], self.pops[node] = 0, 1  # the whole string is a piece
                continue
            up, b = parent[node], byte[node]
            popped, at = self.pops[up], self.fail[up]
            while b not in self.children[at]:  # ends at the root: every byte is a piece
                popped, at = popped + self.pops[at], self.fail[at]
            self.fail[node], self.pops[node] = self.children[at][b], popped
        self.plain = self.fail.tolist(), self.pops.tolist()
        edges = sorted((at << 8 | b, to) for at, kids in enumerate(self.children) for b, to in kids.items())
        self.keys = np.array([k for k, _ in edges], np.int64)
        self.to = np.array([t for _, t in edges], np.int32)
        self.root = self.to[np.searchsorted(self.keys, np.arange(256))]

    def step(self, nodes, given):
        """Where each of `nodes` gets by its byte, and the pieces popped on the way."""
        import numpy as np

        now, popped, left = nodes.copy(), np.zeros(len(nodes), np.int64), np.arange(len(nodes))
        while len(left):
            keys = now[left].astype(np.int64) << 8 | given[left]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            found = self.keys[at] == keys
            now[left[found]] = self.to[at[found]]
            left = left[~found]
            popped[left] += self.pops[now[left]]
            now[left] = self.fail[now[left]]
        return now, popped

    def length(self, word: bytes) -> int:
        """The number of greedy pieces of one word."""
        children, (fail, pops) = self.children, self.plain
        node = count = 0
        for b in word:
            to = children[node].get(b)
            while to is None:  # ends at the root: every byte is a piece
                count += pops[node]
                node = fail[node]
                to = children[node].get(b)
            node = to
        while node:
            count += pops[node]
            node = fail[node]
        return count

    def lengths(self, words: list[bytes]):
        """The number of greedy pieces of each word."""
        import numpy as np

        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-sizes, kind="stable")
        flat = np.frombuffer(b"".join(words), np.uint8)
        begins = (np.cumsum(sizes) - sizes)[order]
        falling, counts = -sizes[order], np.zeros(len(words), np.int64)
        nodes = np.zeros(len(words), np.int32)
        for pos in range(int(sizes.max(initial=0))):
            live = int(np.searchsorted(falling, -pos, side="left"))  # words longer than `pos`
            nodes[:live], popped = self.step(nodes[:live], flat[begins[:live] + pos])
            counts[:live] += popped
        left = np.flatnonzero(nodes)
        while len(left):
            counts[left] += self.pops[nodes[left]]
            nodes[left] = self.fail[nodes[left]]
            left = left[nodes[left] != 0]
        out = np.zeros(len(words), np.int64)
        out[order] = counts
        return out


class Counter:
    """A worker's automaton, pattern and the words it remembers."""

    def __init__(self, content: bytes, pattern: str):
        import regex

        from factloom.llm.bpe import read_ranks

        self.automaton, self.find = Automaton(read_ranks(content)), regex.compile(pattern).findall
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def count(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """Words and tokens of each text."""
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        split = [self.find(t) if t else [] for t in texts]
        new = []
        for w in set().union(*split) - self.known.keys():
            old = self.older.get(w)
            if old is None:
                new.append(w)
            else:
                self.known[w] = old
        coded = {w: w.encode() for w in new}
        short = [w for w, b in coded.items() if len(b) <= LONG]
        self.known.update(zip(short, self.automaton.lengths([coded[w] for w in short]).tolist(), strict=True))
        self.known.update((w, self.automaton.length(b)) for w, b in coded.items() if len(b) > LONG)
        get = self.known.__getitem__
        return [(len(w), sum(map(get, w))) for w in split]


_counters: dict[str, Counter] = {}


def counter(content: bytes, pattern: str) -> Counter:
    """This worker's counter for a vocabulary: built once and kept between tasks."""
    key = hashlib.sha256(content + pattern.encode()).hexdigest()
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(content, pattern)
    return _counters[key]


def count_tokens(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """`df` with n_words and n_tokens, the greedy longest-match length in pieces of a rank file. No shuffle."""
    from factloom.llm.bpe import vocabulary

    content = vocabulary(path)
    df = without(df, "n_words", "n_tokens")
    names = df.columns

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = counter(content, pattern).count(batch.column(names.index(text)).to_pylist())
        made = [pa.array([n for n, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())]
        return pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*names, "n_words", "n_tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return map_arrow(df, each, f"{schema}, n_words bigint, n_tokens bigint", text)
