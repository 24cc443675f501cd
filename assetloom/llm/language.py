"""Language identification as inference in a mixture of languages.

Training counts hashed character trigrams of labelled documents per language.
A document is then explained as a mixture: its trigrams come from language ``k``
with the unknown proportion ``w_k``. Languages join the set one by one; each
time expectation-maximisation finds the proportions, and a language stays only
if it raises the log-likelihood by more than a penalty. The log-likelihood is
concave in the proportions, so the gradient at a set's optimum bounds what a
language can add, and one whose bound lies below the penalty is not tried at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetloom.llm.common import texts

#: Buckets of hashed trigrams.
BUCKETS = 1 << 15
#: Documents a language that training reads, chosen by a hash of the id (about as many, or all if fewer).
TRAIN_ROWS = 4_000
#: Added to every count.
SMOOTHING = 0.5
#: A further language must add so many times the logarithm of the number of trigrams; neighbours overlap, hence over 1/2.
PENALTY = 3.0
STEPS = 60
UNKNOWN = "und"
_PIECE = 1 << 20


@lru_cache(1)
def _letters() -> np.ndarray:
    """For every code point itself if it is a letter, else 0."""
    codes = np.zeros(0x110000, np.uint32)
    codes[[i for i in range(0x110000) if chr(i).isalpha()]] = 1
    return codes * np.arange(0x110000, dtype=np.uint32)


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's trigrams and their counts; none without a letter.

    Letters count in lower case, every run of other characters is one boundary,
    also at both ends, and no trigram has the boundary in its middle.
    """
    counts, tail = np.zeros(BUCKETS, np.int64), np.zeros(1, np.uint32)
    for at in range(0, len(text), _PIECE):
        piece = text[at : at + _PIECE].lower().encode("utf-32-le", "surrogatepass")
        codes = np.concatenate([tail, _letters()[np.frombuffer(piece, np.uint32)], np.zeros(int(at + _PIECE >= len(text)), np.uint32)])
        keep = codes != 0
        keep[0] = True
        keep[1:] |= codes[:-1] != 0
        if len(tail) == 2:
            keep[:2] = True
        codes = codes[keep]
        middle = np.flatnonzero(codes[1:-1]) + 1
        key = (codes[middle - 1].astype(np.uint64) << np.uint64(42)) | (codes[middle].astype(np.uint64) << np.uint64(21)) | codes[middle + 1]
        key *= np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
        bucket = (key * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(49)
        if len(text) <= _PIECE:
            found, n = np.unique(bucket, return_counts=True) if len(bucket) < 500 else _counted(bucket)
            return found.astype(np.int64), n
        counts += np.bincount(bucket.astype(np.int64), minlength=BUCKETS)
        tail = codes[-2:]
    found = np.flatnonzero(counts)
    return found, counts[found]


def _counted(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = np.bincount(bucket.astype(np.int64), minlength=BUCKETS)
    found = np.flatnonzero(counts)
    return found, counts[found]


@dataclass
class Model:
    languages: list[str]
    chance: np.ndarray  # languages x buckets

    def shares(self, documents: list[str]) -> np.ndarray:
        """The proportion of every language in every text; all 0 for a text without letters."""
        out = np.zeros((len(documents), len(self.languages)))
        if not self.languages:
            return out
        found = [trigrams(t) for t in documents]
        own = [i for i, (f, _) in enumerate(found) if len(f)]
        if own:
            sizes = np.array([len(found[i][0]) for i in own])
            bucket, n = np.concatenate([found[i][0] for i in own]), np.concatenate([found[i][1] for i in own])
            out[own] = mixtures(self.chance[:, bucket].astype(float), n.astype(float), np.concatenate([[0], np.cumsum(sizes)]))
        return out


def mixtures(chance: np.ndarray, n: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The proportions of documents whose features have these chances (languages x features) and counts.

    ``offsets`` says where each document's features begin; every document has some.
    """
    rows, many = len(offsets) - 1, len(chance)
    starts = offsets[:-1]
    single = np.stack([np.add.reduceat(n * np.log(p), starts) for p in chance], 1)
    weight = np.zeros((rows, many))
    weight[np.arange(rows), single.argmax(1)] = 1
    likelihood = single.max(1)
    penalty = PENALTY * np.log(np.maximum(np.add.reduceat(n, starts), 2))
    open_rows = np.arange(rows)
    while len(open_rows):
        keep, p, m, begin = _part(chance, n, offsets, open_rows)
        mixed = np.einsum("kf,fk->f", p, weight[open_rows][keep])
        gain = np.stack([np.add.reduceat(m * (q / mixed - 1), begin) for q in p], 1)  # the most a language can add
        gain[weight[open_rows] > 0] = 0
        best, chosen = likelihood[open_rows].copy(), np.full(len(open_rows), -1)
        better = weight[open_rows].copy()
        for k in range(many):
            tried = np.flatnonzero(gain[:, k] > penalty[open_rows])
            if len(tried):
                start = weight[open_rows[tried]] * 0.8
                start[:, k] = 0.2
                w, value = _em(*_part(p, m, np.append(begin, len(m)), tried), start)
                improved = value > best[tried]
                best[tried[improved]], better[tried[improved]], chosen[tried[improved]] = value[improved], w[improved], k
        grown = np.flatnonzero((chosen >= 0) & (best - likelihood[open_rows] > penalty[open_rows]))
        weight[open_rows[grown]], likelihood[open_rows[grown]] = better[grown], best[grown]
        open_rows = open_rows[grown]
    return weight


def _part(chance: np.ndarray, n: np.ndarray, offsets: np.ndarray, rows: np.ndarray):
    """The features of some documents: the document of each, chances, counts and where each document begins."""
    sizes = offsets[rows + 1] - offsets[rows]
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    at = np.arange(sizes.sum()) + np.repeat(offsets[rows] - begin, sizes)
    return np.repeat(np.arange(len(rows)), sizes), chance[:, at], n[at], begin


def _em(row: np.ndarray, chance: np.ndarray, n: np.ndarray, begin: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihoods after expectation-maximisation from these proportions."""
    total = np.add.reduceat(n, begin)
    for _ in range(STEPS):
        joint = chance * weight[row].T
        part = joint * (n / joint.sum(0))
        fresh = np.stack([np.add.reduceat(q, begin) for q in part], 1) / total[:, None]
        moved = np.abs(fresh - weight).max()
        weight = fresh
        if moved < 1e-4:
            break
    return weight, np.add.reduceat(n * np.log((chance * weight[row].T).sum(0)), begin)


def train(labelled: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model of the languages in the columns ``doc_id, text, lang``; null languages are left out.

    Reads about ``rows`` whole documents a language (all, if it has fewer), chosen
    by a hash of the id. What comes to the driver are the counts: languages times
    ``BUCKETS`` rows at most. An empty table gives a model without languages.
    """
    labelled = labelled.select("doc_id", "text", "lang").where("lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((0, BUCKETS)))
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, rows / n)))])
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, np.ndarray] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), texts(batch.column("text"))):
                bucket, n = trigrams(text)
                if lang not in seen:
                    seen[lang] = np.zeros(BUCKETS, np.int64)
                seen[lang][bucket] += n
            for lang, n in seen.items():
                found = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found, pa.int64()), pa.array(n[found], pa.int64())], ["lang", "bucket", "n"])

    counts = (
        labelled.where(chance < share[F.col("lang")]).select("lang", "text")
        .mapInArrow(count, "lang string, bucket long, n long")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    )
    found = pd.DataFrame(counts.collect(), columns=["lang", "bucket", "n"])
    languages = sorted(found["lang"].unique())
    table = np.full((len(languages), BUCKETS), SMOOTHING)
    for k, lang in enumerate(languages):
        own = found[found["lang"] == lang]
        table[k, own["bucket"].to_numpy(np.int64)] += own["n"].to_numpy(float)
    return Model(languages, (table / table.sum(1, keepdims=True)).astype(np.float32))


def _answers(model: Model, found: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    parts, most = [], max(20, 600 // max(1, len(model.languages)))
    for at in range(0, len(found), most):
        parts.append(model.shares(found[at : at + most]))
    share = np.concatenate(parts) if parts else np.zeros((0, len(model.languages)))
    score = share.max(1) if model.languages else np.zeros(len(found))
    lang = [model.languages[k] if s > 0 else UNKNOWN for k, s in zip(share.argmax(1), score)] if model.languages else [UNKNOWN] * len(found)
    return lang, score, share


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score, shares`` for every row's whole text.

    ``shares`` maps each language of the text to its proportion, ``lang_pred`` is the
    largest (of equal ones the first by name) and ``score`` its proportion. A text that
    is null or has no letter, or a model without languages, gives ``und``, 0 and an
    empty map. Repeated rows and null ids count like any others; other columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            lang, score, share = _answers(own, texts(batch.column("text")))
            maps = [[(own.languages[k], float(row[k])) for k in np.flatnonzero(row > 0)] for row in share]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(maps, pa.map_(pa.string(), pa.float64()))],
                ["doc_id", "lang_pred", "score", "shares"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, shares map<string,double>")


def keep_identified(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of ``docs`` whose text has a known language of at least this proportion, all columns kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 500) for b in batches for at in range(0, len(b), 500)):
            lang, score, _ = _answers(shared.value, texts(batch.column("text")))
            yield batch.filter(pa.array([x != UNKNOWN and s >= least for x, s in zip(lang, score)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
