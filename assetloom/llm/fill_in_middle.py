"""Fill-in-the-middle samples: documents cut at code points, their parts moved, and the text rebuilt from them.

Texts stay UTF-8 bytes. Of a slice of documents only the exceptions are recorded: the place
of every multibyte character, counted in code points and in bytes, and the running sum of
its excess bytes. A code point between two exceptions lies a constant number of bytes
further on, so ASCII spans need no table: a cut in code points becomes a cut in bytes by
one binary search over the exceptions and one addition, and a length in bytes becomes code
points the same way back. All cuts of a slice are converted together, and its parts are
joined as bytes without decoding a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetloom.llm.common import row_slices, utf8

#: The marks before the prefix, the suffix and the middle. None is a part of another's ends, so a mark
#: never arises where a part meets a mark; texts that hold one are left plain.
MARKS = ("<P>", "<S>", "<M>")
FORMS = ("plain", "psm", "spm")


class Exceptions:
    """The multibyte characters of rows of UTF-8 text that lie behind one another."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.offsets = offsets
        self.byte = np.flatnonzero(data >= 0xC0)  # first bytes of the multibyte characters
        lead = data[self.byte]
        self.excess = np.concatenate([[0], np.cumsum(1 + (lead >= 0xE0) + (lead >= 0xF0), dtype=np.int64)])
        self.point = self.byte - self.excess[:-1]  # their places in code points
        self.first = self.points(offsets)

    def points(self, at: np.ndarray) -> np.ndarray:
        """Code points before places in bytes; the places must be first bytes of characters or ends of rows."""
        return at - self.excess[np.searchsorted(self.byte, at)]

    def bytes(self, at: np.ndarray) -> np.ndarray:
        """Bytes before places in code points."""
        return at + self.excess[np.searchsorted(self.point, at)]

    def lengths(self) -> np.ndarray:
        """Code points of each row."""
        return np.diff(self.first)


def seeds(doc_id: Column, seed: int = 1) -> list[Column]:
    """Four numbers below 2**32 from a document's id: the first 8-digit groups of the SHA-256 of ``seed:id``; a null id is written as nothing."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def cut_and_move(column: pa.Array, h: list[np.ndarray], plain_percent: int, spm_percent: int) -> tuple[np.ndarray, ...]:
    """For the texts of a column: code points, form number, code points of prefix and middle, and the bytes of the output."""
    data, offsets = utf8(column)
    held, whole = Exceptions(data, offsets), data.tobytes()
    n = held.lengths()
    one, two = h[0] % (n + 1), h[1] % (n + 1)
    low, high = np.minimum(one, two), np.maximum(one, two)
    form = np.where(h[3] % 100 < spm_percent, 2, 1)
    form[(n == 0) | (h[2] % 100 >= 100 - plain_percent)] = 0
    marks = [m.encode() for m in MARKS]
    for mark in marks:  # a mark is ASCII, so it may be sought in bytes; one across two rows is told by its end
        at = whole.find(mark)
        while at >= 0:
            row = int(np.searchsorted(offsets, at, "right")) - 1
            if at + len(mark) <= offsets[row + 1]:
                form[row] = 0
                at = whole.find(mark, int(offsets[row + 1]))
            else:
                at = whole.find(mark, at + 1)
    ends = [offsets[:-1], held.bytes(held.first[:-1] + low), held.bytes(held.first[:-1] + high), offsets[1:]]
    out = []
    for kind, a, b, c, d in zip(form.tolist(), *(e.tolist() for e in ends)):
        if kind == 0:
            out.append(whole[a:d])
        elif kind == 1:
            out.append(b"".join((marks[0], whole[a:b], marks[1], whole[c:d], marks[2], whole[b:c])))
        else:
            out.append(b"".join((marks[1], whole[c:d], marks[0], whole[a:b], marks[2], whole[b:c])))
    return n, form, low, high - low, out


def transform(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every row of ``docs``.

    Reads ``doc_id`` and ``text`` only; null text is empty. A text of ``n`` code points is cut
    after ``h1 % (n + 1)`` and ``h2 % (n + 1)`` of them, the smaller cut first, with the numbers of
    ``seeds``; a document's cuts depend on its id and length alone. ``form`` is ``plain`` for an empty
    text, one that holds a mark, or if ``h3 % 100`` is among the last ``plain_percent``; then the output
    is the text and the two lengths are null. Otherwise it is ``spm`` (``<S>`` suffix ``<P>`` prefix
    ``<M>`` middle) if ``h4 % 100 < spm_percent``, else ``psm`` (``<P>`` prefix ``<S>`` suffix ``<M>``
    middle). Repeated rows give equal rows, and an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = utf8(batch.column("text"))
            for lo, hi in row_slices(offsets, 4 << 20):
                part = batch.slice(lo, hi - lo)
                h = [part.column(f"h{k}").to_numpy() for k in (1, 2, 3, 4)]
                n, form, prefix, middle, out = cut_and_move(part.column("text"), h, plain_percent, spm_percent)
                plain = form == 0
                columns = [
                    part.column("doc_id"), pa.array(n, pa.int64()), pa.array([FORMS[f] for f in form.tolist()]),
                    pa.array(prefix, pa.int64(), mask=plain), pa.array(middle, pa.int64(), mask=plain), pa.array(out, pa.binary()).cast(pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    return docs.select("doc_id", "text", *seeds(F.col("doc_id"), seed)).mapInArrow(run, schema)


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made from, by the places of its marks; null if either is null.

    The parts hold no mark, so the first place of each mark is its own.
    """
    p, s, m = MARKS
    after = lambda mark: F.substring_index(output, mark, -1)
    between = lambda mark, end: F.substring_index(F.substring_index(output, end, 1), mark, -1)
    psm = F.concat(between(p, s), after(m), between(s, m))
    spm = F.concat(between(p, m), after(m), between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).when(form == "plain", output)


def restore(samples: DataFrame) -> DataFrame:
    """``samples`` with ``text``, rebuilt from ``form`` and ``output`` alone; null for an unknown form or a null output."""
    return samples.withColumn("text", restored(F.col("form"), F.col("output")))
