"""Byte-pair encoding and decoding with a given vocabulary, as numpy merge rounds over many words at once.

A text is cut into chunks at spaces where the tokenizer's own pattern also cuts,
so equal chunks are encoded once per worker and looked up afterwards. The chunks
that a batch has and the worker does not know are encoded together: the symbols
of all their words lie in one flat array, every round finds the rank of each
adjacent pair by binary search over the sorted pair keys, and each word merges
its lowest-ranked pair. Tasks keep at most ``CACHED`` chunks, so memory is
bounded whatever the corpus holds.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from assetloom.llm.common import texts

#: Chunks that a worker remembers.
CACHED = 600_000
#: The pattern that splits a text before the merges; a fixed value of byte-level vocabularies.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Beyond Latin letters, versions of Unicode may class a character differently, so the library splits such chunks itself.
_UNUSUAL = re.compile("[^\x00-ɏ]")
_NONE = np.iinfo(np.int32).max


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies (a fixed rule)."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return [chr(b) if b in printable else chr(256 + others.index(b)) for b in range(256)]


class Merger:
    """Merges the bytes of words by the ranks of a vocabulary file in JSON form."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.size = max(self.vocab.values()) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, made = (np.array([self.vocab[f(p)] for p in pairs], np.int64) for f in (lambda p: p[0], lambda p: p[1], "".join))
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.kind = np.uint32 if self.size < 1 << 16 else np.uint64  # of symbols and of keys, which are below size ** 2
        self.keys, self.ranks, self.made = keys[order].astype(self.kind), order.astype(np.int32), made[order].astype(self.kind)
        chars = byte_characters()
        self.inner = np.array([self.vocab[c] for c in chars], self.kind)
        self.final = np.array([self.vocab[c + self.suffix] for c in chars], self.kind)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in one array and the offset of each word; no word may be empty."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[data]
        symbols[ends - 1] = self.final[data[ends - 1]]
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        done_ids, done_words = [], []
        rank, made = self._ranks(symbols, word, np.arange(len(symbols)))
        while len(symbols):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(symbols)))
            lowest = np.repeat(best, sizes)
            ended = lowest == _NONE
            if ended.any():
                done_ids.append(symbols[ended])
                done_words.append(word[ended])
            hit = (rank == lowest) & ~ended
            if (hit[1:] & hit[:-1]).any():  # of overlapping equal pairs the first, third, ... merge
                at = np.arange(len(hit))
                begin = hit & ~np.concatenate([[False], hit[:-1]])
                hit &= (at - np.maximum.accumulate(np.where(begin, at, 0))) % 2 == 0
            symbols = np.where(hit, made, symbols)
            stay = ~ended
            stay[1:] &= ~hit[:-1]
            merged = hit[stay]
            symbols, word, rank, made = symbols[stay], word[stay], rank[stay], made[stay]
            changed = np.flatnonzero(merged | np.append(merged[1:], False))
            rank[changed], made[changed] = self._ranks(symbols, word, changed)
        if not done_ids:
            return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
        word = np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        offsets = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(words)))])
        return np.concatenate(done_ids)[order].astype(np.int32), offsets

    def _ranks(self, symbols: np.ndarray, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of the pairs that begin at these places; the largest rank where there is none."""
        after = np.minimum(at + 1, len(symbols) - 1)
        key = symbols[at] * self.kind(self.size) + symbols[after]
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = (self.keys[place] == key) & (word[at] == word[after]) & (after > at)
        return np.where(found, self.ranks[place], _NONE), self.made[place]


class ChunkCache:
    """Ids of chunks as bytes; beyond ``CACHED`` only those of the last call stay, so that memory stays bounded."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], fixed: dict[str, bytes]):
        self.encode, self.fixed, self.known = encode, fixed, dict(fixed)

    def look_up(self, chunks: list[str]) -> list[bytes]:
        """The unknown chunks of the list are encoded in one call."""
        missing = list({c for c in chunks if c not in self.known})
        if missing:
            self.known.update(zip(missing, self.encode(missing)))
        found = list(map(self.known.__getitem__, chunks))
        if len(self.known) > CACHED:
            self.known = self.fixed | {c: self.known[c] for c in set(chunks)}
        return found


class ByteLevelCodec:
    """Encodes and decodes as the library does with the same file, no special tokens added."""

    def __init__(self, path: str):
        self.merger = Merger(path)
        with open(path, encoding="utf-8") as f:
            self.special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        self.path, self.library = path, None
        self.pattern = regex.compile(BYTE_LEVEL_PATTERN)
        self.between = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.unsafe = re.compile(r"\s \s")
        self.cache = ChunkCache(self._encode_chunks, {t: np.int32(i).tobytes() for t, i in self.special.items()})
        bytes_of = {c: bytes([b]) for b, c in enumerate(byte_characters())}
        self.bytes_of = [b""] * max(self.merger.size, 1 + max(self.special.values(), default=0))
        for token, i in [*self.merger.vocab.items(), *self.special.items()]:
            self.bytes_of[i] = b"".join(bytes_of[c] for c in token) if all(c in bytes_of for c in token) else token.encode()

    def words(self, text: str) -> list[str]:
        """The words of a text that merge on their own."""
        if text[1:].isalpha() and text[0] == " " and text.isascii():
            return [text]
        if _UNUSUAL.search(text) is None:
            return self.pattern.findall(text)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def chunks(self, text: str) -> list[str]:
        """Parts of a text whose words are those of the text: cut before single spaces."""
        if not text:
            return []
        if self.unsafe.search(text) or text[-1].isspace() or text[0].isspace():
            return self.words(text)
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        places: dict[str, int] = {}
        use, ends = [], [0]
        for chunk in chunks:
            use += [places.setdefault(w, len(places)) for w in self.words(chunk)]
            ends.append(len(use))
        if not places:
            return [b""] * len(chunks)
        ids, offsets = self.merger.encode([w.encode() for w in places])
        cut, whole = (4 * offsets).tolist(), ids.tobytes()
        words = [whole[a:b] for a, b in zip(cut, cut[1:])]
        return [words[use[a]] if b == a + 1 else b"".join([words[i] for i in use[a:b]]) for a, b in zip(ends, ends[1:])]

    def encode(self, documents: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        chunks, ends = [], [0]
        for text in documents:
            if self.between is not None and self.between.search(text):
                for part in self.between.split(text):
                    chunks += [part] if part in self.special else self.chunks(part)
            else:
                chunks += self.chunks(text)
            ends.append(len(chunks))
        found = self.cache.look_up(chunks)
        return [b"".join(found[a:b]) for a, b in zip(ends, ends[1:])]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(4)
def codec(path: str) -> ByteLevelCodec:
    return ByteLevelCodec(path)


def encode_documents(docs: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """``doc_id`` and ``ids`` (array of int) of every row's whole text; null text is empty.

    ``path`` names a byte-level vocabulary in JSON form. The ids are those of the
    library with special tokens recognised in the text but none added. With
    ``decoded`` a column ``text`` holds what the ids decode to. One row per
    row, repeated rows and null ids included; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            found, doc_ids = texts(batch.column("text")), batch.column("doc_id")
            for lo, hi in _parts([len(t) for t in found]):
                encoded = own.encode(found[lo:hi])
                ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in encoded])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(encoded), np.int32)))
                columns = [doc_ids[lo:hi], ids]
                if decoded:
                    columns.append(pa.array([own.decode(np.frombuffer(x, np.int32).tolist()) for x in encoded], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "text"][: len(columns)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>" + ", text string" * decoded)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``ids`` and ``text``, the decoded ids with special tokens kept; null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            ids = batch.column("ids")
            decoded = [own.decode(x.values.to_numpy(zero_copy_only=False).tolist() if x.is_valid else []) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array(decoded, pa.string())], ["doc_id", "ids", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, text string")


def _parts(sizes: list[int], most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``most`` characters, or one row."""
    at, held = 0, 0
    for i, n in enumerate(sizes):
        if held + n > most and i > at:
            yield at, i
            at, held = i, 0
        held += n
    if at < len(sizes):
        yield at, len(sizes)
