"""Best-fit packing of tokenised documents into sequences of a fixed number of tokens.

Only the lengths of the pieces decide a packing, so the whole corpus is packed
exactly best-fit decreasing from the number of pieces of each length, at most
``limit`` rows whatever the corpus size. A segment tree over the remaining
capacities finds the tightest class of open sequences in logarithmic time, and
all pieces of one length that go to that class are placed at once. The plan is a
short list of runs ``(length, first rank, first sequence, pieces a sequence, offset)``;
every piece then finds its place by its rank among the pieces of its length.
Ranks are counted per salt of a length, so one length that holds a third of all
pieces is spread over many tasks.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetloom.llm.bpe import ChunkCache, Merger, _parts
from assetloom.llm.common import texts
from assetloom.session import cut

#: The pattern that finds the words of a lower-cased text; a fixed value of the vocabulary's tokenizer.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters of texts that go to the library: beyond Latin letters, or separators that only Python counts as white space.
_UNUSUAL = re.compile("[^\x00-\x1b\x20-\u024f]")
#: Pieces of one length that are ranked in one group.
GROUP_ROWS = 50_000


class WordTokenizer:
    """Ids of texts for a vocabulary of words with end marks, as the library gives them with no special tokens added."""

    def __init__(self, path: str):
        self.merger, self.path, self.library = Merger(path), path, None
        with open(path, encoding="utf-8") as f:
            special = [t["content"] for t in json.load(f)["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special)) if special else r"(?!)")
        self.pattern = regex.compile(WORD_PATTERN)
        self.cache = ChunkCache(self._encode_chunks, {})

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        places: dict[str, int] = {}
        use, ends = [], [0]
        for chunk in chunks:
            if chunk.isalpha():
                use.append(places.setdefault(chunk, len(places)))
            else:
                stem = chunk[:-1]
                found = [stem, chunk[-1]] if chunk[-1:] in (".", ",") and stem.isalpha() else self.pattern.findall(chunk)
                use += [places.setdefault(w, len(places)) for w in found]
            ends.append(len(use))
        if not places:
            return [b""] * len(chunks)
        ids, offsets = self.merger.encode([w.encode() for w in places])
        cuts, all_ids = (4 * offsets).tolist(), ids.tobytes()
        words = [all_ids[a:b] for a, b in zip(cuts, cuts[1:])]
        return [words[use[a]] if b == a + 1 else b"".join([words[i] for i in use[a:b]]) for a, b in zip(ends, ends[1:])]

    def _whole(self, text: str) -> bytes:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32).tobytes()

    def encode(self, documents: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers.

        Latin texts are lower-cased and cut at white space, and their distinct parts are
        looked up; texts with other characters or special tokens go to the library whole.
        """
        whole = {i: self._whole(t) for i, t in enumerate(documents) if _UNUSUAL.search(t) or self.special.search(t)}
        split = pc.ascii_split_whitespace(pa.array(["" if i in whole else t.lower() for i, t in enumerate(documents)], pa.large_string()))
        parts = split.values.dictionary_encode()
        found = self.cache.look_up(parts.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids = np.frombuffer(b"".join(found), np.int32)
        part = parts.indices.to_numpy()
        own, starts = sizes[part], (np.cumsum(sizes) - sizes)[part]
        ends = np.concatenate([[0], np.cumsum(own)])
        tokens = ids[np.repeat(starts - ends[:-1], own) + np.arange(ends[-1])].tobytes()
        cuts = (4 * ends[split.offsets.to_numpy()]).tolist()
        return [whole[i] if i in whole else tokens[a:b] for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]


@lru_cache(4)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def token_pieces(docs: DataFrame, path: str, limit: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """The pieces of every whole document: ``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids``.

    A document is its ids and then ``end_id``, so an empty or null text is one
    piece of one token. Documents longer than ``limit`` are cut into pieces of
    ``limit`` tokens, the last one shorter. Repeated rows and null ids give pieces
    like any others; other columns are left out.
    """
    end = np.int32(end_id).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch in batches:
            found, doc_ids = texts(batch.column("text")), batch.column("doc_id")
            for lo, hi in _parts([len(t) for t in found], 8 << 20):
                rows, piece, start, length, crc, ids = [], [], [], [], [], []
                for row, encoded in enumerate(own.encode(found[lo:hi]), lo):
                    encoded += end
                    for k, at in enumerate(range(0, len(encoded), 4 * limit)):
                        part = encoded[at : at + 4 * limit]
                        rows.append(row)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(np.frombuffer(part, np.int32))
                columns = [doc_ids.take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


class Capacities:
    """A segment tree over remaining capacities; a leaf holds the ranges of open sequences with that capacity."""

    def __init__(self, limit: int):
        self.leaves = 1 << limit.bit_length()
        self.some = bytearray(2 * self.leaves)
        self.open: list[deque[tuple[int, int]]] = [deque() for _ in range(limit + 1)]

    def add(self, capacity: int, first: int, count: int) -> None:
        if count and capacity:
            self.open[capacity].append((first, count))
            at = capacity + self.leaves
            while at and not self.some[at]:
                self.some[at] = 1
                at >>= 1

    def take(self, capacity: int) -> tuple[int, int]:
        found = self.open[capacity].popleft()
        if not self.open[capacity]:
            at = capacity + self.leaves
            self.some[at] = 0
            while at > 1 and not (self.some[at] or self.some[at ^ 1]):
                at >>= 1
                self.some[at] = 0
        return found

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least ``least`` that an open sequence has."""
        at = least + self.leaves
        if self.some[at]:
            return least
        while at > 1:
            if not at & 1 and self.some[at ^ 1]:
                at ^= 1
                while at < self.leaves:
                    at = 2 * at if self.some[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def plan(counts: dict[int, int], limit: int) -> np.ndarray:
    """Best-fit decreasing for so many pieces of each length.

    Rows ``(length, first rank, first sequence, pieces a sequence, offset)`` in order
    of length and rank: a piece of rank ``r`` goes ``(r - first rank) // pieces``
    sequences after the first one, behind the pieces of its length before it there.
    """
    tree, runs, used = Capacities(limit), [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, first, count = limit, used, -(-left // (limit // length))
                used += count
            else:
                first, count = tree.take(capacity)
            each = capacity // length
            full = min(count, left // each)
            placed = full * each
            runs.append((length, rank, first, each, limit - capacity))
            tree.add(capacity - each * length, first, full)
            rest = 0
            if full < count and placed < left:
                rest = left - placed
                tree.add(capacity - rest * length, first + full, 1)
                tree.add(capacity, first + full + 1, count - full - 1)
            else:
                tree.add(capacity, first + full, count - full)
            rank, left = rank + placed + rest, left - placed - rest
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, limit: int) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``, packed into sequences of at most ``limit`` tokens.

    Needs a ``length`` of 1 to ``limit`` in every row; all columns are kept, and
    rows that repeat each get a place of their own. An empty table gives no rows.
    The rows are written once, so that every step sees the same ones.
    """
    spark, names = pieces.sparkSession, pieces.columns
    salted = cut(pieces.withColumn("_salt", F.xxhash64(*[c for c in names if c != "ids"])), "pieces")
    counts = {int(r["length"]): int(r["n"]) for r in salted.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(not 1 <= n <= limit for n in counts):
        raise ValueError(f"piece lengths must lie between 1 and {limit}")
    groups = max(1, -(-max(counts.values(), default=0) // GROUP_ROWS))
    salted = salted.withColumn("_group", F.pmod("_salt", F.lit(groups)))
    sizes = salted.groupBy("length", "_group").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("length", "_group").orderBy("_salt", *[c for c in names if c not in ("length", "ids")])
    ranked = (
        salted.join(starts, ["length", "_group"])
        .withColumn("_rank", F.col("_first") + F.row_number().over(inside) - 1)
        .select(*names, "_rank")
    )
    runs = spark.sparkContext.broadcast(plan(counts, limit))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = runs.value
        keys = table[:, 0] << 44 | table[:, 1] if len(table) else np.zeros(0, np.int64)
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            row = table[np.searchsorted(keys, length.astype(np.int64) << 44 | rank, "right") - 1]
            step = rank - row[:, 1]
            sequence, offset = row[:, 2] + step // row[:, 3], row[:, 4] + step % row[:, 3] * length
            own = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [*names, "sequence_id", "offset"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields]
    return ranked.mapInArrow(place, ", ".join([*kinds, "sequence_id long", "offset long"]))
