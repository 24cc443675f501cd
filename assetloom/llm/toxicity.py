"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels belong to documents, so tokens are labelled through them: every word and
word prefix gets a weight of evidence (the log of how much more often toxic
documents hold it, less its standard error), and in a toxic document the tokens with
strong evidence are toxic, all others clean. The field has two states; its features are
the level of a token's evidence and the neighbours' states. Forward-backward gives each
token's chance of being toxic; a document's score comes from the sum of their squares
through a logistic curve fitted to the document labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetloom.llm.common import row_slices, utf8, words
from assetloom.session import cut

#: Labelled documents of each class that training reads, chosen by a hash of the id (about as many, or all if fewer).
TRAIN_ROWS = 8_000
#: Of these, documents of each class whose tokens the field is fitted to.
FIELD_ROWS = 600
#: Toxic documents that must hold a word or prefix before it counts as evidence, and the least evidence kept.
SUPPORT = 4
LEAST = 1.5
#: Evidence from which a token of a toxic document is labelled toxic.
STRONG = 3.0
#: Lengths of word prefixes in bytes.
PREFIXES = (4, 5, 6)
#: Upper ends of the levels of evidence.
LEVELS = np.array([LEAST, 2.0, 2.5, STRONG, 3.5, 4.0, 4.5, 5.0, 5.5, 6.0, 7.0, 8.0])
#: Tokens of one chain; longer documents go on in a further chain.
CHAIN = 128
FIT_STEPS = 25

_GAP = np.array([not (chr(b).isalnum() or b >= 0x80) if b < 0x80 else False for b in range(256)])


@dataclass
class Tokens:
    """The tokens of some documents, in order."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    keys: np.ndarray  # kinds x tokens: hashes of the word and its prefixes, 0 for none


def tokenise(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    blocks = list(words(data, offsets, _GAP, PREFIXES))
    if not blocks:
        none = np.zeros(0, np.int64)
        return Tokens(none, none, none, np.zeros((1 + len(PREFIXES), 0), np.uint64))
    start = np.concatenate([b[0] for b in blocks])
    keys = np.stack([np.concatenate([b[2] for b in blocks]), *[np.concatenate([b[3][k] for b in blocks]) for k in range(len(PREFIXES))]])
    return Tokens(np.searchsorted(offsets, start, "right") - 1, start, np.concatenate([b[1] for b in blocks]), keys)


@dataclass
class Chain:
    """Potentials of the two states (0 clean, 1 toxic)."""

    first: np.ndarray  # states
    step: np.ndarray  # states x states
    emit: np.ndarray  # levels x states

    def marginals(self, level: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each token's chance of being toxic, and for pairs of neighbours the expected steps (states x states).

        ``level`` holds the tokens of all chains, ``begins`` where each chain begins. Chains run side by side, longest first.
        """
        sizes = np.diff(np.append(begins, len(level)))
        order = np.argsort(-sizes, kind="stable")
        begins, sizes = begins[order], sizes[order]
        running = np.searchsorted(-sizes, -np.arange(sizes[0]) if len(sizes) else [], "left")  # chains longer than t
        emit, step = np.exp(self.emit - self.emit.max(1, keepdims=True)), np.exp(self.step - self.step.max())
        forward = np.empty((len(level), 2))
        state = np.tile(np.exp(self.first - self.first.max()), (len(begins), 1))
        for t, n in enumerate(running):
            at = begins[:n] + t
            state = (state[:n] @ step if t else state[:n]) * emit[level[at]]
            state /= state.sum(1, keepdims=True)
            forward[at] = state
        toxic, pairs = np.empty(len(level)), np.zeros((2, 2))
        back = np.ones((len(begins), 2))
        for t in range(len(running) - 1, -1, -1):
            n = running[t]
            at = begins[:n] + t
            if t + 1 < len(running):
                m = running[t + 1]
                ahead = emit[level[at[:m] + 1]] * back[:m]
                joint = forward[at[:m], :, None] * step * ahead[:, None, :]
                pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
                ahead = ahead @ step.T
                back[:m] = ahead / ahead.sum(1, keepdims=True)
            both = forward[at] * back[:n]
            toxic[at] = both[:, 1] / both.sum(1)
        return toxic, pairs


@dataclass
class Model:
    keys: np.ndarray  # sorted hashes of words and prefixes
    evidence: np.ndarray
    chain: Chain
    curve: tuple[float, float]

    def weights(self, tokens: Tokens) -> np.ndarray:
        """The strongest evidence of each token, 0 for none."""
        best = np.zeros(tokens.keys.shape[1])
        if len(self.keys):
            for kind in tokens.keys:
                place = np.minimum(np.searchsorted(self.keys, kind), len(self.keys) - 1)
                best = np.maximum(best, np.where(self.keys[place] == kind, self.evidence[place], 0))
        return best

    def mark(self, tokens: Tokens, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Each token's chance of being toxic and each document's score."""
        toxic, _ = self.chain.marginals(levels(self.weights(tokens)), chains(tokens.row))
        return toxic, self.score(hits(tokens.row, toxic, rows))

    def score(self, expected: np.ndarray) -> np.ndarray:
        slope, shift = self.curve
        return 1 / (1 + np.exp(-np.clip(slope * np.log(expected + 1e-4) + shift, -50, 50)))


def levels(weight: np.ndarray) -> np.ndarray:
    return np.searchsorted(LEVELS, weight, "right")


def chains(row: np.ndarray) -> np.ndarray:
    """Where chains begin: at each document and every ``CHAIN`` tokens in it."""
    if not len(row):
        return np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    sizes = np.diff(np.append(starts, len(row)))
    return np.flatnonzero((np.arange(len(row)) - np.repeat(starts, sizes)) % CHAIN == 0)


def hits(row: np.ndarray, toxic: np.ndarray, rows: int) -> np.ndarray:
    """About the number of toxic tokens of each document: chances are squared, so that faint ones do not add up in long texts."""
    return np.bincount(row, toxic**2, rows) if len(row) else np.zeros(rows)


def fit_chain(level: np.ndarray, label: np.ndarray, begins: np.ndarray) -> Chain:
    """Potentials that maximise the likelihood of labelled chains, by gradient steps from the counted frequencies."""
    many = len(LEVELS) + 1
    emitted = np.zeros((many, 2))
    np.add.at(emitted, (level, label), 1)
    inner = np.ones(len(level), bool)
    inner[begins] = False
    at = np.flatnonzero(inner)
    stepped = np.zeros((2, 2))
    np.add.at(stepped, (label[at - 1], label[at]), 1)
    begun = np.bincount(label[begins], minlength=2).astype(float)
    frequency = lambda n: np.log((n + 0.5) / (n + 0.5).sum(-1, keepdims=True))
    chain = Chain(frequency(begun), frequency(stepped), frequency(emitted.T).T)
    total, momentum, square = max(1, len(level)), [0.0] * 3, [0.0] * 3
    for i in range(1, FIT_STEPS + 1 if len(level) else 1):
        toxic, pairs = chain.marginals(level, begins)
        expected = np.stack([np.bincount(level, 1 - toxic, many), np.bincount(level, toxic, many)], 1)
        begin = np.array([(1 - toxic[begins]).sum(), toxic[begins].sum()])
        parts = [(begun - begin) / len(begins), (stepped - pairs) / total, (emitted - expected) / np.maximum(1, emitted.sum(1, keepdims=True))]
        for k, (name, slope) in enumerate(zip(("first", "step", "emit"), parts)):
            momentum[k], square[k] = 0.9 * momentum[k] + 0.1 * slope, 0.99 * square[k] + 0.01 * slope**2
            change = momentum[k] / (1 - 0.9**i) / (np.sqrt(square[k] / (1 - 0.99**i)) + 1e-6)
            setattr(chain, name, getattr(chain, name) + 0.05 * change)
    return chain


def fit_curve(expected: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve, by Newton's method with a small ridge."""
    x = np.stack([np.log(expected + 1e-4), np.ones(len(expected))], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        change = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2), x.T @ (label - p) - 1e-2 * w)
        w += np.clip(change, -5, 5)
    return float(w[0]), float(w[1])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, field_rows: int = FIELD_ROWS) -> Model:
    """A model from ``docs`` (``doc_id, text``) and ``labels`` (``doc_id, toxic``); labels other than 0 and 1 are left out.

    Reads about ``rows`` whole documents a class, chosen by a hash of the id, so the chosen
    ids may be sent to all tasks; of labels that disagree on a document the larger counts. The
    driver gets the evidence (bounded by these documents) and, of about ``field_rows``
    documents a class, the evidence of their tokens. Without documents of both classes
    every score is 0, or 1 if there are only toxic ones.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def part(most: int) -> F.Column:
        return place < F.when(F.col("toxic") == 1, min(1.0, most / sizes.get(1, 1))).otherwise(min(1.0, most / sizes.get(0, 1)))

    chosen = docs.select("doc_id", "text").join(F.broadcast(known.where(part(rows))), "doc_id")
    sample = cut(chosen.withColumn("copy", F.xxhash64("text")).dropDuplicates(["copy", "toxic"]), "labelled")  # copies are no further evidence
    read = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    none = np.zeros(0, np.int64)
    model = Model(np.zeros(0, np.uint64), np.zeros(0), fit_chain(none, none, none), (0.0, 50.0 if 1 in read else -50.0))
    if len(read) < 2:
        return model

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column("toxic").to_numpy().astype(bool)
            data, offsets = utf8(batch.column("text"))
            for lo, hi in row_slices(offsets):
                own = tokenise(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                seen = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
                for row, (a, b) in enumerate(zip(*_bounds(own.row, hi - lo)), lo):
                    keys = np.unique(own.keys[:, a:b])
                    seen[int(toxic[row])].append(keys[keys != 0])
                for label, keys in enumerate(map(np.concatenate, seen)):
                    found, n = np.unique(keys, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found.view(np.int64)), pa.array(n * label, pa.int64()), pa.array(n * (1 - label), pa.int64())], ["key", "toxic", "clean"]
                    )

    doubt = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    odds = F.log((F.col("toxic") + 0.5) / F.lit(read[1] + 1.0)) - F.log((F.col("clean") + 0.5) / F.lit(read[0] + 1.0))
    found = (
        sample.select("toxic", "text").mapInArrow(count, "key long, toxic long, clean long")
        .groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where(F.col("toxic") >= SUPPORT).withColumn("evidence", odds - doubt).where(F.col("evidence") >= LEAST)
        .select("key", "evidence").collect()
    )
    keys = np.array([r["key"] for r in found], np.int64).view(np.uint64)
    order = np.argsort(keys)
    model.keys, model.evidence = keys[order], np.array([r["evidence"] for r in found])[order]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for lo, hi in row_slices(offsets):
                own = tokenise(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                level = levels(shared.value.weights(own)).astype(np.uint8)
                rows_of = [level[a:b].tobytes() for a, b in zip(*_bounds(own.row, hi - lo))]
                yield pa.RecordBatch.from_arrays([batch.column("toxic")[lo:hi], pa.array(rows_of, pa.binary())], ["toxic", "level"])

    field = sample.where(part(field_rows)).select("toxic", "text").mapInArrow(weigh, "toxic int, level binary").collect()
    level = np.frombuffer(b"".join(r["level"] for r in field), np.uint8).astype(np.int64)
    row = np.repeat(np.arange(len(field)), [len(r["level"]) for r in field])
    toxic = np.array([r["toxic"] for r in field], np.int64)
    strong = int(np.searchsorted(LEVELS, STRONG, "right"))
    model.chain = fit_chain(level, (level >= strong) * toxic[row] if len(row) else level, chains(row))
    chance, _ = model.chain.marginals(level, chains(row))
    slope, shift = fit_curve(hits(row, chance, len(field)), toxic)
    prior = np.log(sizes[1] / sizes[0]) - np.log((toxic.sum() + 0.5) / ((1 - toxic).sum() + 0.5))  # the field's classes are not as frequent as all labels
    model.curve = (slope, shift + float(prior))
    return model


def _bounds(row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(row, np.arange(rows + 1))
    return at[:-1], at[1:]


def _marked(model: Model, column: pa.Array) -> Iterator[tuple]:
    """Slices of the rows with scores, tokens, chances, and the character of each byte and of each row's first byte."""
    data, offsets = utf8(column)
    for lo, hi in row_slices(offsets):
        part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        own = tokenise(part, at)
        toxic, score = model.mark(own, hi - lo)
        place = np.cumsum((part & 0xC0) != 0x80) - 1  # of each byte, in characters
        base = place[np.minimum(at[:-1], len(part) - 1)] if len(part) else np.zeros(hi - lo, np.int64)
        yield lo, hi, score, own, toxic, place, base


def score_documents(docs: DataFrame, model: Model, with_spans: bool = True) -> DataFrame:
    """``doc_id, score`` and ``spans`` for every row's whole text.

    ``score`` is the chance that the text is labelled toxic. ``spans`` lists its toxic
    tokens as ``(start, end, chance)`` in characters, neighbours merged. Null and empty
    texts get the score of a text without toxic tokens, and no spans. Repeated rows and
    null ids count like any others; other columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("chance", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, score, own, toxic, place, base in _marked(shared.value, batch.column("text")):
                columns = [batch.column("doc_id")[lo:hi], pa.array(score, pa.float64())]
                if with_spans:
                    columns.append(pa.array(_spans(own, toxic, place, base), span))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "spans"][: len(columns)])

    schema = f"doc_id {kind}, score double" + ", spans array<struct<start:int,end:int,chance:double>>" * with_spans
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _spans(own: Tokens, toxic: np.ndarray, place: np.ndarray, base: np.ndarray) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in base]
    before = -2
    for i in np.flatnonzero(toxic >= 0.5).tolist():
        row = int(own.row[i])
        a, b, chance = int(place[own.start[i]] - base[row]), int(place[own.end[i] - 1] - base[row]) + 1, float(toxic[i])
        if i == before + 1 and out[row]:
            out[row][-1] |= {"end": b, "chance": max(chance, out[row][-1]["chance"])}
        else:
            out[row].append({"start": a, "end": b, "chance": chance})
        before = i
    return out


def keep_clean(docs: DataFrame, model: Model, below: float) -> DataFrame:
    """The rows of ``docs`` whose text scores below the bound, all columns kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 500) for b in batches for at in range(0, len(b), 500)):
            score = np.concatenate([np.zeros(0), *[x[2] for x in _marked(shared.value, batch.column("text"))]])
            yield batch.filter(pa.array(score < below))

    return docs.mapInArrow(run, docs.schema)
