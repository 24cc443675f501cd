"""Which tokens of two tokenizers end together, counted over the corpus and scored per document.

A document's tokens are byte ranges of the same text. Where ranges of both tokenizers end
at one byte, the two tokens are linked, and these bytes cut the text into groups.

Counts are kept in an inverted index. Every task numbers the documents of a chunk, and each
linked pair of ids gets, per chunk, bitmaps of these numbers: plane ``k`` holds the documents
in which the pair's number of links has bit ``k`` set. A bitmap is compressed, as a list of
numbers or as bits, whichever is shorter. The planes' union holds the pair's documents, and
their sizes times their powers of two add up to its links. Chunks share no document, so
their bitmaps merge by adding sizes, before the shuffle and after it: what is shuffled is
one row per pair and chunk, never one per link. The counts then go back along the postings,
and a chunk's task adds them up on its documents.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetloom.llm.bpe import BYTE_LEVEL_PATTERN, byte_characters
from assetloom.llm.common import row_slices, texts, utf8
from assetloom.session import cut

#: Links and documents after which a chunk ends (with the slice or document that reaches them).
CHUNK_LINKS = 2_000_000
CHUNK_DOCS = 1 << 16
#: Beyond Latin letters, versions of Unicode may class a character differently; such texts go to the file's own library.
_UNUSUAL = re.compile("[^\x00-ɏ]")


class ByteLevel:
    """Ids of a byte-level vocabulary in JSON form; strings of special tokens are plain text."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        vocab, special = whole["model"]["vocab"], {t["content"] for t in whole["added_tokens"]}
        byte = {c: b for b, c in enumerate(byte_characters())}
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in special}
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in whole["model"]["merges"]]
        assert all(a < b for a, b in zip(made, made[1:])), "ids must rise with the merges"
        self.fast = tiktoken.Encoding("plain", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        self.library.no_padding()
        self.bytes_of = [b""] * (1 + max(ranks.values()))
        for token, i in ranks.items():
            self.bytes_of[i] = token

    def encode(self, spaced: list[str]) -> list[list[int]]:
        return [
            self.library.encode(t, add_special_tokens=False).ids if _UNUSUAL.search(t) else self.fast.encode_ordinary(t) for t in spaced
        ]


class Pieces:
    """Ids of a sentencepiece model, which puts the space before the text itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.bytes_of = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.bytes_of.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())

    def encode(self, spaced: list[str]) -> list[list[int]]:
        return self.model.encode([t[1:] for t in spaced], num_threads=1)


class Side(NamedTuple):
    encoder: ByteLevel | Pieces
    sizes: np.ndarray  # bytes of each id
    inner: list[bytes]  # each id in decimal and the mark that follows it
    last: list[bytes]


@lru_cache(4)
def side(kind: type, path: str, end: str) -> Side:
    encoder = kind(path)
    numbers = range(len(encoder.bytes_of))
    inner, last = [f"{i},".encode() for i in numbers], [f"{i}{end}".encode() for i in numbers]
    return Side(encoder, np.fromiter(map(len, encoder.bytes_of), np.int64), inner, last)


def tokens(own: Side, spaced: list[str], wanted: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids in one array, the number of each text, and whether their bytes are those of the text."""
    ids = own.encoder.encode(spaced)
    counts = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.concatenate([np.array(i, np.int32) for i in ids]) if ids else np.zeros(0, np.int32)
    find = own.encoder.bytes_of.__getitem__
    same = np.array([b"".join(map(find, i)) == w for i, w in zip(ids, wanted)], bool)
    return flat, counts, same


class Aligned(NamedTuple):
    """The documents of a slice: their numbers of tokens and groups, their groups as text, and all links."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    groups: list[bytes]
    a: np.ndarray
    b: np.ndarray
    doc: np.ndarray


def align(documents: list[str], one: Side, two: Side) -> Aligned:
    """Tokens, groups and links of texts. Every token has a byte at least, so a byte ends at most one token of a side."""
    use = [k for k, t in enumerate(documents) if t]
    spaced = [" " + documents[k] for k in use]
    wanted = [t.encode() for t in spaced]
    a, count_a, same_a = tokens(one, spaced, wanted)
    b, count_b, same_b = tokens(two, spaced, wanted)
    good = same_a & same_b
    a, b = a[np.repeat(good, count_a)], b[np.repeat(good, count_b)]
    use, count_a, count_b = np.array(use, np.int64)[good], count_a[good], count_b[good]
    end_a, end_b = np.cumsum(one.sizes[a]), np.cumsum(two.sizes[b])
    place = np.searchsorted(end_b, end_a)
    last_a = end_b[np.minimum(place, max(0, len(b) - 1))] == end_a if len(b) else np.zeros(0, bool)
    last_b = np.zeros(len(b), bool)
    last_b[place[last_a]] = True
    # A group is written as its tokens of one side and then those of the other.
    before_a, before_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    through_a = np.concatenate([[0], np.flatnonzero(last_a) + 1])
    through_b = np.concatenate([[0], np.flatnonzero(last_b) + 1])
    names = one.inner + one.last + two.inner + two.last
    code = np.empty(len(a) + len(b), np.int64)
    code[np.arange(len(a)) + through_b[before_a]] = a + len(one.inner) * last_a
    code[np.arange(len(b)) + through_a[before_b + 1]] = b + 2 * len(one.inner) + len(two.inner) * last_b
    ends = np.cumsum(count_a + count_b)
    find = names.__getitem__
    written = [b""] * len(documents)
    for k, lo, hi in zip(use.tolist(), (ends - count_a - count_b).tolist(), ends.tolist()):
        written[k] = b"".join(map(find, code[lo:hi].tolist()))[:-1]
    doc_a = np.repeat(use, count_a)
    whole = lambda counts: np.bincount(use, counts, len(documents)).astype(np.int64)
    linked = doc_a[last_a]
    return Aligned(whole(count_a), whole(count_b), np.bincount(linked, minlength=len(documents)), written, a[last_a], b[place[last_a]], linked)


def planes(pair: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, list[list[bytes]]]:
    """The distinct pairs of links, ascending, and their compressed bitmaps by bit of the number of links.

    A bitmap begins with ``b"n"`` and holds 16-bit numbers, or with ``b"b"`` and holds bits.
    """
    both, times = np.unique(pair * docs + doc, return_counts=True)
    pair, doc = both // docs, both % docs
    starts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
    run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(pair))))
    found: list[list[bytes]] = [[] for _ in starts]
    for k in range(int(times.max(initial=0)).bit_length()):
        chosen = (times >> k) & 1 == 1
        part = doc[chosen].astype("<u2")
        ends = np.cumsum(np.bincount(run[chosen], minlength=len(starts))).tolist()
        data, at = part.tobytes(), 0
        for own, end in zip(found, ends):
            if end == at:
                own.append(b"")
            elif 2 * (end - at) <= docs // 8 + 1:
                own.append(b"n" + data[2 * at : 2 * end])
            else:
                bits = np.zeros(docs, bool)
                bits[part[at:end]] = True
                own.append(b"b" + np.packbits(bits, bitorder="little").tobytes())
            at = end
    return pair[starts], found


def members(bitmap: bytes) -> np.ndarray:
    """The numbers in a compressed bitmap, ascending."""
    if bitmap[:1] == b"b":
        return np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8, offset=1), bitorder="little"))
    return np.frombuffer(bitmap, "<u2", offset=1).astype(np.int64) if bitmap else np.zeros(0, np.int64)


def popcount(bitmap: bytes) -> int:
    if bitmap[:1] == b"b":
        return int.from_bytes(bitmap[1:], "little").bit_count()
    return len(bitmap) // 2


def union(bitmaps: list[bytes]) -> bytes:
    """The compressed bitmap of all numbers that one of the bitmaps holds."""
    held = [m for m in bitmaps if m]
    if len(held) == 1:
        return held[0]
    if all(m[:1] == b"n" for m in held):
        return b"n" + np.unique(np.concatenate([members(m) for m in held])).astype("<u2").tobytes()
    bits = 0
    for m in held:
        if m[:1] == b"b":
            bits |= int.from_bytes(m[1:], "little")
        else:
            row = np.zeros(CHUNK_DOCS, bool)
            row[members(m)] = True
            bits |= int.from_bytes(np.packbits(row, bitorder="little").tobytes(), "little")
    return b"b" + bits.to_bytes((bits.bit_length() + 7) // 8, "little")


def index(docs: DataFrame, path_a: str, path_b: str, keep_groups: bool) -> DataFrame:
    """Document rows (``a`` is null) and posting rows (``doc`` is null) of all chunks."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = (
        f"chunk long, doc int, doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, groups string, "
        "a int, b int, planes array<binary>"
    )
    names = [f.split(" ")[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = side(ByteLevel, path_a, "|"), side(Pieces, path_b, ";")
        base, chunk, size = TaskContext.get().partitionId() << 32, 0, 0
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def empty(n: int, types: str) -> list[pa.Array]:
            kinds = {"i": pa.int32(), "l": pa.int64(), "s": pa.string(), "p": pa.list_(pa.binary())}
            return [pa.nulls(n, kinds[t]) for t in types]

        def postings(doc_kind: pa.DataType) -> Iterator[pa.RecordBatch]:
            pair, found = planes(np.concatenate([p for p, _ in held]), np.concatenate([d for _, d in held]), max(1, size))
            for at in range(0, len(pair), 20_000):
                own, n = pair[at : at + 20_000], len(pair[at : at + 20_000])
                ids = [pa.array((own // len(two.sizes)).astype(np.int32)), pa.array((own % len(two.sizes)).astype(np.int32))]
                columns = [pa.array(np.full(n, base + chunk)), *empty(n, "i"), pa.nulls(n, doc_kind), *empty(n, "lllss"), *ids]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found[at : at + 20_000], pa.list_(pa.binary()))], names)

        doc_kind = pa.int64()
        for batch in batches:
            doc_kind = batch.schema.field("doc_id").type
            _, offsets = utf8(batch.column("text"))
            for lo, hi in ((x, min(x + 4_096, b)) for a, b in row_slices(offsets) for x in range(a, b, 4_096)):
                part = batch.slice(lo, hi - lo)
                got = align(texts(part.column("text")), one, two)
                if held and size + len(part) > CHUNK_DOCS:
                    yield from postings(doc_kind)
                    chunk, size, held = chunk + 1, 0, []
                held.append((got.a.astype(np.int64) * len(two.sizes) + got.b, got.doc + size))
                digests = [hashlib.sha256(g).hexdigest() if g else "" for g in got.groups]
                written = pa.array([g.decode() for g in got.groups]) if keep_groups else pa.nulls(len(part), pa.string())
                columns = [
                    pa.array(np.full(len(part), base + chunk)), pa.array(np.arange(size, size + len(part), dtype=np.int32)), part.column("doc_id"),
                    pa.array(got.n_a), pa.array(got.n_b), pa.array(got.n_groups), pa.array(digests, pa.string()), written, *empty(len(part), "iip"),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)
                size += len(part)
                if sum(len(p) for p, _ in held) >= CHUNK_LINKS:
                    yield from postings(doc_kind)
                    chunk, size, held = chunk + 1, 0, []
        if held:
            yield from postings(doc_kind)

    return docs.select("doc_id", "text").mapInArrow(run, fields)


def pair_counts(postings: DataFrame) -> DataFrame:
    """``a, b, n_docs, n_links, best``: documents and links of every linked pair of ids over all chunks.

    ``best`` says that no other pair with this ``b`` has more links.
    """

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("planes").to_pylist()
            links = [sum(popcount(m) << k for k, m in enumerate(p)) for p in held]
            documents = [popcount(union(p)) for p in held]
            columns = [batch.column("a"), batch.column("b"), pa.array(documents, pa.int64()), pa.array(links, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "n_docs", "n_links"])

    sized = postings.select("a", "b", "planes").mapInArrow(sizes, "a int, b int, n_docs long, n_links long")
    summed = cut(sized.groupBy("a", "b").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links")), "pairs")
    most = summed.groupBy("b").agg(F.max("n_links").alias("most"))
    return summed.join(most, "b").select("a", "b", "n_docs", "n_links", (F.col("n_links") == F.col("most")).alias("best"))


def _scores(postings: DataFrame, pairs: DataFrame) -> DataFrame:
    """``chunk, doc, n_best, count_sum`` of every document with links."""
    names = ["chunk", "doc", "n_best", "count_sum"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best, total = None, None, None

        def done() -> pa.RecordBatch:
            place = np.flatnonzero(total)  # a linked document's sum is at least one
            columns = [np.full(len(place), now), place.astype(np.int32), best[place], total[place]]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

        for batch in batches:
            chunk = batch.column("chunk").to_numpy()
            count, wins = batch.column("n_links").to_numpy(), batch.column("best").to_numpy(zero_copy_only=False)
            turns = [0, *(np.flatnonzero(chunk[1:] != chunk[:-1]) + 1).tolist(), len(chunk)]
            for lo, hi in zip(turns, turns[1:]):
                if lo < hi and int(chunk[lo]) != now:
                    if now is not None:
                        yield done()
                    now, best, total = int(chunk[lo]), np.zeros(CHUNK_DOCS, np.int64), np.zeros(CHUNK_DOCS, np.int64)
                held = batch.column("planes").slice(lo, hi - lo).to_pylist()
                for k in range(max(map(len, held), default=0)):
                    rows = [(i, members(p[k])) for i, p in enumerate(held, lo) if len(p) > k and p[k]]
                    if not rows:  # every number of links here lacks this bit
                        continue
                    own = np.repeat(np.array([i for i, _ in rows], np.int64), [len(m) for _, m in rows])
                    doc = np.concatenate([m for _, m in rows])
                    np.add.at(total, doc, count[own] << k)
                    np.add.at(best, doc[wins[own]], 1 << k)
        if now is not None:
            yield done()

    scored = postings.select("chunk", "a", "b", "planes").join(pairs.select("a", "b", "n_links", "best"), ["a", "b"])
    dealt = scored.select("chunk", "planes", "n_links", "best").repartition("chunk").sortWithinPartitions("chunk")
    return dealt.mapInArrow(add, "chunk long, doc int, n_best long, count_sum long")


class Alignment(NamedTuple):
    documents: DataFrame
    pairs: DataFrame


def align_documents(docs: DataFrame, path_a: str, path_b: str, keep_groups: bool = False) -> Alignment:
    """Aligns every row's whole text under a byte-level vocabulary (a) and a sentencepiece model (b).

    Reads ``doc_id`` and ``text`` only. ``documents`` has one row per row of ``docs``: ``doc_id, n_a,
    n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` and ``groups`` (``a1,a2|b1;a3|b2,b3``,
    null unless ``keep_groups``). The text is encoded with a space before it and no special tokens.
    Null and empty texts, and texts whose tokens' bytes are not the text, have no tokens: zeros and
    the empty digest. ``n_best`` counts the links whose pair has the most links of its b id, ties
    included; ``count_sum`` adds the links of the pair over the document's links. Repeated rows
    count like any others. ``pairs`` holds the counts of ``pair_counts``. An empty table gives no rows.
    """
    rows = cut(index(docs, path_a, path_b, keep_groups), "alignment")
    postings = rows.where("a IS NOT NULL").select("chunk", "a", "b", "planes")
    pairs = cut(pair_counts(postings), "pairs")
    known = rows.where("doc IS NOT NULL").select("chunk", "doc", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "groups")
    # Every common end has one token of each side, so a group has one link.
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    documents = known.join(_scores(postings, pairs), ["chunk", "doc"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256", "groups"
    )
    return Alignment(documents, pairs)
