"""Token counts of greedy longest-match word pieces, without building the pieces.

The vocabulary is a trie with failure links. Where a word's next character has no
child, the tokens that the longest match pops are already counted on the node,
and the link leads to the node of what is left, so the automaton reads every
character once. Distinct words run side by side, one character a step.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from assetloom.llm.common import texts

#: Words whose counts a worker remembers.
CACHED = 600_000
_SLICE = 4 << 20


class Automaton:
    """Counts the pieces of words.

    ``pieces`` is the vocabulary; ``mark`` stands before every word and begins the pieces that
    begin words. At each place the longest piece that matches is taken. A character where none
    matches counts as so many pieces as it has bytes in UTF-8 (the mark alone as none).
    """

    def __init__(self, pieces: Sequence[str], mark: str):
        known = {p for p in pieces if p}
        alphabet = sorted(set("".join(known)) | set(mark))
        children: list[dict[int, int]] = [{}]
        code = {c: i for i, c in enumerate(alphabet)}
        cost = [0]  # of the whole string of a node as one piece, 0 if it is none
        for piece in [*sorted(known), *alphabet]:  # every character is a node, so that the root can always go on
            node = 0
            for c in piece:
                if code[c] not in children[node]:
                    children[node][code[c]] = len(children)
                    children.append({})
                    cost.append(0)
                node = children[node][code[c]]
            if piece in known:
                cost[node] = 1
        self.whole = cost
        self.popped, self.link = [0] * len(children), [-1] * len(children)
        self.width = len(alphabet)
        fallback = [0 if c == mark else len(c.encode()) for c in alphabet]
        level = [(0, c, n) for c, n in children[0].items()]
        while level:
            below = []
            for above, c, node in level:
                if cost[node]:
                    self.popped[node], self.link[node] = 1, 0
                elif not above:
                    self.popped[node], self.link[node] = fallback[c], 0
                else:
                    popped, at = self.popped[above], self.link[above]
                    while c not in children[at]:
                        popped, at = popped + self.popped[at], self.link[at]
                    self.popped[node], self.link[node] = popped, children[at][c]
                below += [(node, d, n) for d, n in children[node].items()]
            level = below
        flush = [0] * len(children)  # pieces of the string of a node
        depth_order = np.argsort(self._depths(children), kind="stable").tolist()
        for node in depth_order[1:]:
            flush[node] = self.popped[node] + flush[self.link[node]]
        edges = sorted((node * self.width + c, n) for node, own in enumerate(children) for c, n in own.items())
        self.keys, self.targets = np.array([e[0] for e in edges], np.int64), np.array([e[1] for e in edges], np.int64)
        self.popped, self.link, self.flush = (np.array(x, np.int64) for x in (self.popped, self.link, flush))
        self.codes = np.full(0x110000, -1, np.int32)
        self.codes[[ord(c) for c in alphabet]] = range(self.width)
        self.start = children[0][code[mark]] if mark else 0

    @staticmethod
    def _depths(children: list[dict[int, int]]) -> list[int]:
        depth = [0] * len(children)
        for node, own in enumerate(children):  # a child has a larger number than its parent
            for n in own.values():
                depth[n] = depth[node] + 1
        return depth

    def count(self, words: Sequence[str]) -> np.ndarray:
        """The number of pieces of each word."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-sizes, kind="stable")
        text = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        begin, sizes = (np.cumsum(sizes) - sizes)[order], sizes[order]
        state, total = np.full(len(words), self.start), np.zeros(len(words), np.int64)
        for t in range(int(sizes[0]) if len(sizes) else 0):
            n = int(np.searchsorted(-sizes, -t, "left"))  # words longer than t
            points = text[begin[:n] + t]
            code = self.codes[points]
            strange = np.flatnonzero(code < 0)
            if len(strange):
                total[strange] += self.flush[state[strange]] + 1 + (points[strange] >= 0x80) + (points[strange] >= 0x800) + (points[strange] >= 0x10000)
                state[strange] = 0
            todo = np.flatnonzero(code >= 0)
            while len(todo):
                key = state[todo] * self.width + code[todo]
                place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                found = self.keys[place] == key
                state[todo[found]] = self.targets[place[found]]
                todo = todo[~found]
                total[todo] += self.popped[state[todo]]
                state[todo] = self.link[state[todo]]
        total += self.flush[state]
        out = np.empty(len(words), np.int64)
        out[order] = total
        return out


class WordCounter:
    """Counts of words, remembered; beyond ``CACHED`` only those of the last call stay."""

    def __init__(self, automaton: Automaton):
        self.automaton, self.known = automaton, {}

    def count(self, words: list[str]) -> np.ndarray:
        missing = [w for w in words if w not in self.known]
        if missing:
            self.known.update(zip(missing, self.automaton.count(missing).tolist()))
        found = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if len(self.known) > CACHED:
            self.known = dict(zip(words, found.tolist()))
        return found


_counters: dict[int, WordCounter] = {}


def count_tokens(docs: DataFrame, pieces: Sequence[str], mark: str = "▁") -> DataFrame:
    """``doc_id, n_words, n_tokens`` of every row's whole text.

    Words lie between ASCII white space; each is counted as ``Automaton`` says. Null and empty
    texts have none. Repeated rows and null ids count like any others; other columns are left
    out. The automaton is built once from the vocabulary and shared, a few megabytes.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(pieces, mark))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        counter = _counters.get(id(automaton))
        if counter is None:
            _counters.clear()
            counter = _counters[id(automaton)] = WordCounter(automaton)
        for batch in batches:
            found = texts(batch.column("text"))
            sizes = np.cumsum([0, *map(len, found)])
            at = 0
            while at < len(found):
                end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + _SLICE, "right")) - 1)
                split = pc.ascii_split_whitespace(pa.array(found[at:end], pa.large_string()))
                parts = split.values.dictionary_encode()
                words = parts.dictionary.to_numpy(zero_copy_only=False).tolist()
                real = np.fromiter(map(bool, words), np.int64, len(words))
                tokens = counter.count(words) * real
                index, ends = parts.indices.to_numpy(), split.offsets.to_numpy()
                totals = [np.concatenate([[0], np.cumsum(x[index])])[ends] for x in (real, tokens)]
                columns = [batch.column("doc_id")[at:end], *[pa.array(np.diff(x), pa.int64()) for x in totals]]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_tokens"])
                at = end

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long")
