"""Near-duplicate documents by one-permutation MinHash, with links confirmed on whole texts.

A document's n-grams are hashed once. The upper half of a hash chooses one of ``BINS`` bins and
the smallest hash in a bin is its value. An empty bin borrows the value of a full one, found by
the bin's own fixed series of random bins, the same for all documents (optimal densification), so each
bin agrees in two documents with a probability of their Jaccard similarity. ``ROWS`` bins make a
band; documents with an equal band share a bucket.

Buckets are not expanded into pairs. Every bucket draws one member as the centre of a star, and
the others are compared to it, so a bucket sends one pair a member. The centre has then met all
members and leaves the bucket; buckets whose members are one component are done, so most
buckets, of few members or of copies, end there. Members of larger buckets that are still apart
meet in blocks inside of tasks: ``LIKELIEST`` times each names its likeliest partner only, then all
pairs of different components that may be linked by their sizes and parity bits are compared. No
bucket is capped, and every pair in one bucket is either compared, ruled out by a bound, or in one
component already.

The one thing left to chance is the banding: two documents at a similarity of 0.8 share no bucket
with a probability of 5e-9, more similar ones with less (``miss``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetloom.llm.common import mix
from assetloom.llm.jaccard import BITS, merged, parity_bits, shingle_sets, verified
from assetloom.session import cut, discard

#: Bins of a band, and bands.
ROWS, BANDS = 5, 48
BINS = ROWS * BANDS
#: Random bins an empty bin tries before it takes the next full one.
PROBES = 64
#: Stars that every bucket draws before its members meet in blocks, and rounds in which they name their likeliest partners only first.
STARS = 1
LIKELIEST = 1
#: Members of a bucket on either side of a block.
BLOCK_ROWS = 2_000
_U = np.uint64
_PROBE = np.random.default_rng(20250131).integers(0, BINS, (PROBES, BINS))


def miss(similarity: float) -> float:
    """The chance that two documents of this similarity share no bucket."""
    return (1 - similarity**ROWS) ** BANDS


def bins(sets: list[np.ndarray]) -> np.ndarray:
    """The densified signature of each ascending, non-empty set of hashes: sets x bins."""
    values = np.zeros((len(sets), BINS), _U)
    full = np.zeros((len(sets), BINS), bool)
    for row, grams in enumerate(sets):
        place = ((grams >> _U(32)) * _U(BINS)) >> _U(32)  # ascending, as the hashes are
        starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        values[row, place[starts]] = grams[starts]
        full[row, place[starts]] = True
    rows, empty = np.nonzero(~full)
    for step in range(PROBES):
        donor = _PROBE[step, empty]
        found = full[rows, donor]
        values[rows[found], empty[found]] = values[rows[found], donor[found]]
        rows, empty = rows[~found], empty[~found]
        if not len(rows):
            return values
    for row in np.unique(rows).tolist():
        own, places = empty[rows == row], np.flatnonzero(full[row])
        values[row, own] = values[row, places[np.searchsorted(places, own) % len(places)]]
    return values


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """The hashed bands of each set: sets x bands."""
    parts = bins(sets).reshape(len(sets), BANDS, ROWS)
    keys = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=_U)), (len(sets), BANDS))
    for k in range(ROWS):
        keys = mix(keys * _U(0xC2B2AE3D27D4EB4F) + parts[:, :, k])
    return keys


def name(grams: np.ndarray) -> bytes:
    """A 128-bit name of a set of hashes."""
    sums = [mix(grams ^ _U(c)).sum(dtype=_U) + _U(len(grams)) for c in (0x2545F4914F6CDD1D, 0x9E3779B97F4A7C15)]
    return np.array(sums, _U).tobytes()


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """``row, doc_id, n_shingles, name, bits, keys`` of every row; the last three null for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in (b.slice(at, 500) for b in batches for at in range(0, len(b), 500)):
            sets = list(shingle_sets(batch.column("text"), n))
            some = [g for g in sets if len(g)]
            keys = iter(band_keys(some).view(np.int64) if some else ())
            rows = [(name(g), parity_bits(g), next(keys)) if len(g) else (None, None, None) for g in sets]
            columns = [
                pa.array(np.arange(row, row + len(batch))), batch.column("doc_id"), pa.array([len(g) for g in sets], pa.int64()),
                *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.binary(), pa.binary(), pa.list_(pa.int64())))),
            ]
            row += len(batch)
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_shingles", "name", "bits", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"row long, doc_id {kind}, n_shingles long, name binary, bits binary, keys array<long>")


def _texts(docs: DataFrame, sets: DataFrame, n: int) -> DataFrame:
    """``set_id, text``: the whole text of one document of each of the sets ``set_id, name, rep``."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [name(g) if len(g) else None for g in shingle_sets(batch.column("text"), n)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column("text")], ["name", "text"])

    sets = cut(sets, "wanted")  # written first, so that the plan knows its size before any text is shuffled
    own = docs.select("doc_id", "text").join(sets.select("rep"), docs["doc_id"].eqNullSafe(sets["rep"]), "left_semi").select("text")
    found = own.mapInArrow(named, "name binary, text string").join(sets.select("set_id", "name"), "name")
    return found.groupBy("set_id").agg(F.min("text").alias("text"))


def mixed(left: DataFrame) -> DataFrame:
    """The members ``key, set_id, label`` of buckets that hold more than one component."""
    several = left.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    return left.join(several, "key")


def _relabelled(left: DataFrame, labels: DataFrame) -> DataFrame:
    fresh = labels.withColumnRenamed("node", "set_id")
    return cut(mixed(left.select("key", "set_id").join(fresh, "set_id").select("key", "set_id", "label")), "members")


def _blocks(left: DataFrame, sets: DataFrame, percent: int, likeliest: bool) -> DataFrame:
    """Pairs ``a, b`` of members that share a bucket, have other labels and may be linked by their sizes and parity bits.

    A bucket's members are cut into chunks and every two chunks meet in a block, so no task holds a
    whole bucket. With ``likeliest`` a member names at most one partner in a block; otherwise
    a block returns all such pairs whose smallest shared bucket is this one.
    """
    own = left.groupBy("set_id").agg(F.collect_list("key").alias("keys"))  # at most BANDS
    chunks = left.groupBy("key").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("chunks"))
    rows = (
        left.join(chunks, "key").withColumn("chunk", F.pmod(F.xxhash64("set_id"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .join(own, "set_id").join(sets.select("set_id", "n_shingles", "bits"), "set_id")
        .select("key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "set_id", "label", "n_shingles", "bits", "keys")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []
        for batch in batches:
            place = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")], 1)
            turns = [0, *(np.flatnonzero(np.any(place[1:] != place[:-1], 1)) + 1).tolist(), len(place)]
            found = []
            for lo, hi in zip(turns, turns[1:]):
                if lo < hi and tuple(place[lo]) != block:
                    found += _near(held, block, percent, likeliest)
                    block, held = tuple(place[lo]), []
                held.append(batch.slice(lo, hi - lo))
            yield _pairs(found)
        yield _pairs(_near(held, block, percent, likeliest))

    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(compare, "a long, b long").distinct()


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def _near(held: list[pa.RecordBatch], block: tuple[int, int, int] | None, percent: int, likeliest: bool) -> list[tuple[int, int]]:
    """The pairs of a block's rows, the larger id first."""
    if not held:
        return []
    rows = pa.Table.from_batches(held)
    key, i, j = block
    chunk, ids, label, size = (rows.column(c).to_numpy() for c in ("chunk", "set_id", "label", "n_shingles"))
    bits = np.frombuffer(b"".join(rows.column("bits").to_pylist()), _U).reshape(-1, BITS // 64)
    keys = rows.column("keys").to_pylist()
    found = []
    for x in np.flatnonzero(chunk == i).tolist():
        rest = np.flatnonzero((label != label[x]) & ((chunk == j) if i < j else (ids > ids[x])))
        rest = rest[100 * np.minimum(size[rest], size[x]) >= percent * np.maximum(size[rest], size[x])]
        apart = np.bitwise_count(bits[rest] ^ bits[x]).sum(1, dtype=np.int64)
        possible = apart * (100 + percent) <= (100 - percent) * (size[rest] + size[x])
        rest, apart = rest[possible], apart[possible]
        if likeliest and len(rest):
            rest = rest[[int(np.argmin(apart / (size[rest] + size[x])))]]
        for y in rest.tolist():
            if likeliest or min(set(keys[x]).intersection(keys[y])) == key:
                found.append((int(max(ids[x], ids[y])), int(min(ids[x], ids[y]))))
    return found


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Reads ``doc_id`` and ``text`` only. Words lie between ASCII white space, with A-Z in lower
    case. A row's set holds its distinct n-grams of ``n`` words, or with fewer words the whole
    sequence; two rows are linked if their sets' Jaccard similarity is at least ``percent`` / 100,
    which is checked on the sets of their whole texts. ``component_id`` is the smallest id reachable
    by links, and a row is ``kept`` if that is its own id, so rows that repeat this id are all kept.
    A row without words has an empty set and is its own component. Null ids are larger than any
    other; a component of null ids has a null id and is kept. An empty table gives no rows. N-grams are
    compared by 64-bit hashes, equal sets are found by 128 bits. Below a similarity of 0.8
    the bands find fewer links (``miss``).
    """
    signed = cut(signatures(docs, n), "signatures")
    rows = signed.select("doc_id", "n_shingles", "name")
    named = signed.where("n_shingles > 0").groupBy("name").agg(F.min("row").alias("set_id"), F.min("doc_id").alias("rep"))
    named = cut(named, "names")
    first = signed.drop("doc_id", "name").join(named.select("set_id"), F.col("row") == F.col("set_id")).drop("row")
    sets = cut(first, "sets")
    sent = sets.select("set_id", F.explode("keys").alias("key"))
    several = sent.groupBy("key").agg(F.min("set_id").alias("low"), F.max("set_id").alias("high")).where("low <> high").select("key")
    # By a merge at every size: a list of keys small enough to be sent around is the exception here.
    shared = cut(sent.join(several.hint("merge"), "key").withColumn("label", F.col("set_id")), "members")
    left = shared
    known = sets.select("set_id", "n_shingles", "bits")
    labels = cut(shared.select(F.col("set_id").alias("node"), F.col("set_id").alias("label")).distinct(), "labels")
    whole = cut(_texts(docs, named.join(labels.select(F.col("node").alias("set_id")), "set_id"), n), "texts")
    for turn in range(STARS):
        centre = left.groupBy("key").agg(F.min_by(F.struct("set_id", "label"), F.xxhash64("set_id", F.lit(turn))).alias("centre"))
        stars = left.join(centre, "key")
        edges = stars.where("label <> centre.label").select(F.col("set_id").alias("a"), F.col("centre.set_id").alias("b")).distinct()
        labels = merged(labels, verified(edges, known, whole, n, percent))
        before, left = left, _relabelled(stars.where("set_id <> centre.set_id"), labels)
        discard(before)
    for likeliest in [True] * LIKELIEST + [False]:
        if left.isEmpty():
            break
        links = verified(cut(_blocks(left, known, percent, likeliest), "blocks"), known, whole, n, percent)
        labels = merged(labels, links)
        if likeliest:
            before, left = left, _relabelled(left, labels)
            discard(before)
    found = named.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left")
    found = cut(found.select("name", "rep", F.coalesce("label", "set_id").alias("label")), "components")
    smallest = found.groupBy("label").agg(F.min("rep").alias("component"))
    of_set = found.join(smallest, "label").select("name", "component")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return rows.join(of_set, "name", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )
