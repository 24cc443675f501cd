"""Near-duplicate documents: an exact join on the Jaccard similarity of word n-grams.

A document's sketch is an array of words; each of its n-grams is XORed into the
word that its hash selects. An n-gram in both documents cancels out, so the
number of differing words is at most the symmetric difference of the two sets,
and a link of at least ``percent`` bounds that difference by the sizes. Documents
are joined within overlapping size bands, and by the pigeonhole principle two
linked ones agree in one of the words that each sends: with ``d`` differences
allowed, the ``d + 1`` words that hold most n-grams. A second sketch of parity
bits rejects candidates by their Hamming distance, the rest are verified on the
n-grams of their whole texts.

Equal sets are one member from the start. Members that agree in a word are first
compared to pivots of their words, so that a large group of copies takes a few
comparisons a member; words whose members have become one component drop out.
After some rounds with other pivots, all pairs that are still in different
components and agree in a word are held against each other by their parity bits,
in blocks inside of tasks, and those that may be linked are verified, so no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetloom.llm.common import mix, release, row_slices, utf8, word_hashes
from assetloom.session import cut, discard

#: Pivots that a member is compared to in each of the first rounds.
PIVOTS = (1, 4, 4)
#: Members of a word on either side of a block.
BLOCK_ROWS = 2_000
#: Smallest keys of a member that tell at which key a pair is returned.
OWN_KEYS = 16
#: Members that are compared to one pivot in one group.
GROUP_ROWS = 256
#: Parity bits of the second sketch.
BITS = 1024
_U = np.uint64


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its word n-grams; a shorter text is one n-gram, one without words none."""
    data, offsets = utf8(column)
    for lo, hi in row_slices(offsets):
        words, first = word_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        grams = np.zeros(max(0, len(words) - n + 1), _U)
        for k in range(n):
            grams = grams * _U(0xC2B2AE3D27D4EB4F) + words[k : k + len(grams)]
        grams = mix(grams)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= n:
                yield np.unique(grams[a : b - n + 1])
            elif b > a:
                value = np.array([b - a], _U)
                for k in range(a, b):
                    value = value * _U(0xC2B2AE3D27D4EB4F) + words[k]
                yield mix(value ^ _U(0x51ED270B9F8F2E11))
            else:
                yield np.zeros(0, _U)


def differences(size: int, percent: int) -> int:
    """The largest symmetric difference of a set of this size and one linked with it."""
    return (100 - percent) * size // percent


@lru_cache(64)
def bands(percent: int, size: int) -> list[tuple[int, int]]:
    """Number and sketch words of each band that a set of this size belongs to.

    Band ``k`` begins at ``low`` and reaches to the largest partner of the last set before the next band,
    so a pair shares the band in which its smaller set begins.
    """
    found, k, low = [], 0, 1
    while low <= size:
        after = max(low + 1, -(-3 * low // 2))
        top = (after - 1) * 100 // percent
        if size <= top:
            most = differences(top, percent) + 1
            found.append((k, most + most // 8))
        k, low = k + 1, after
    return found


def sketch_keys(grams: np.ndarray, percent: int) -> np.ndarray:
    """The sketch words that a set sends, each hashed with its band, place and number of n-grams."""
    size, keys = len(grams), []
    wanted = differences(size, percent) + 1
    for band, parts in bands(percent, size):
        part = ((grams >> _U(32)) * _U(parts)) >> _U(32)  # ascending, as the n-grams are
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        value, place = np.bitwise_xor.reduceat(grams, starts), part[starts]
        held = np.diff(np.append(starts, size)).astype(_U)
        if len(starts) > wanted:
            chosen = np.argsort(-held.astype(np.int64), kind="stable")[:wanted]
            value, place, held = value[chosen], place[chosen], held[chosen]
        elif len(starts) < wanted:  # empty words come last in the order, but must count where the others do not suffice
            empty = np.setdiff1d(np.arange(parts, dtype=_U), place)[: wanted - len(starts)]
            none = np.zeros(len(empty), _U)
            value, place, held = np.concatenate([value, none]), np.concatenate([place, empty]), np.concatenate([held, none])
        keys.append(mix(value ^ mix(place * _U(0x9E3779B97F4A7C15) + held * _U(0xD6E8FEB86659FD93) + _U(band + 1))))
    return np.concatenate(keys)


def parity_bits(grams: np.ndarray) -> bytes:
    return np.packbits((np.bincount((grams & _U(BITS - 1)).astype(np.int64), minlength=BITS) & 1).astype(bool)).tobytes()


def set_id(grams: np.ndarray) -> int:
    """A 64-bit name of the set."""
    return int(mix(np.array([mix(grams ^ _U(0x2545F4914F6CDD1D)).sum(dtype=_U) + _U(len(grams))])).view(np.int64)[0])


def signatures(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """``doc_id, n_shingles, set_id, bits, keys`` of every row; the last three null for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
        for batch in (b.slice(at, 500) for b in batches for at in range(0, len(b), 500)):
            rows = [
                (len(g), set_id(g), parity_bits(g), sketch_keys(g, percent).view(np.int64)) if len(g) else (0, None, None, None)
                for g in shingle_sets(batch.column("text"), n)
            ]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_shingles", "set_id", "bits", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, set_id long, bits binary, keys array<long>")


def connected(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of the links ``a, b``: the smallest node that it is connected with.

    Labels spread along links and then jump to the label of the label until nothing
    changes; each step is written, and only the number of changes comes to the driver.
    """
    both = cut(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        )
        spread = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("before"))
        target = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        fresh = cut(spread.join(target, "label").select("node", F.least("label", "far").alias("label"), "before"), "labels")
        changed = fresh.where("label <> before").limit(1).count()
        labels = fresh.select("node", "label")
        if not changed:
            return labels


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``node, label`` after components that a link ``a, b`` joins have become one."""
    own = labels.withColumnRenamed("node", "a").withColumnRenamed("label", "x")
    other = labels.withColumnRenamed("node", "b").withColumnRenamed("label", "y")
    across = cut(links.join(own, "a").join(other, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")), "links")
    if across.isEmpty():
        return labels
    top = connected(across).select(F.col("node").alias("label"), F.col("label").alias("top"))
    return cut(labels.join(top, "label", "left").select("node", F.coalesce("top", "label").alias("label")), "labels")


def _texts(docs: DataFrame, sets: DataFrame, n: int) -> DataFrame:
    """``set_id, text``: the whole text of one document of each of the sets ``set_id, rep``."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [set_id(g) if len(g) else None for g in shingle_sets(batch.column("text"), n)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), batch.column("text")], ["set_id", "text"])

    wanted = docs["doc_id"].eqNullSafe(sets["rep"])
    own = docs.select("doc_id", "text").join(sets.select("rep").distinct(), wanted, "left_semi").select("text")
    named = own.mapInArrow(name, "set_id long, text string")
    return named.join(sets.select("set_id"), "set_id", "left_semi").groupBy("set_id").agg(F.min("text").alias("text"))


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members ``key, set_id, label`` of keys that more than one component sends."""
    joined = members.select("key", "set_id").join(labels.withColumnRenamed("node", "set_id"), "set_id")
    several = joined.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    return cut(joined.join(several, "key"), "members")


def _across(left: DataFrame, sets: DataFrame, percent: int, likeliest: bool = False) -> DataFrame:
    """The pairs ``a, b`` of members ``key, set_id, label`` that agree in a key, have other labels and may be linked by size and parity bits.

    The members of a key are cut into chunks and every two chunks meet in a block, so no task
    holds a whole key. A pair is returned at the smallest key that it shares, or, if that is
    none of the first ``OWN_KEYS`` of both, at every key, and then made distinct. With
    ``likeliest`` a member names at most the one partner of a block whose parity bits are nearest.
    """
    place = F.row_number().over(Window.partitionBy("set_id").orderBy("key"))
    own = left.withColumn("place", place).where(F.col("place") <= OWN_KEYS).groupBy("set_id").agg(F.sort_array(F.collect_list("key")).alias("keys"))
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
            turns = np.flatnonzero(np.any(place[1:] != place[:-1], 1)) + 1
            found = []
            for a, b in zip([0, *turns.tolist()], [*turns.tolist(), len(place)]):
                if tuple(place[a]) != block:
                    found += _near(held, block, percent, likeliest)
                    block, held = tuple(place[a]), []
                held.append(batch.slice(a, b - a))
            yield _pairs(found)
        yield _pairs(_near(held, block, percent, likeliest))

    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(compare, "a long, b long").distinct()


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def _near(held: list[pa.RecordBatch], block: tuple[int, int, int] | None, percent: int, likeliest: bool) -> list[tuple[int, int]]:
    """The possible pairs of a block's rows."""
    if not held:
        return []
    rows = pa.Table.from_batches(held)
    key, i, j = block
    chunk, ids, label, size = (rows.column(c).to_numpy() for c in ("chunk", "set_id", "label", "n_shingles"))
    bits = np.frombuffer(b"".join(rows.column("bits").to_pylist()), np.uint64).reshape(-1, BITS // 64)
    keys = rows.column("keys").to_pylist()
    found = []
    for x in np.flatnonzero(chunk == i).tolist():
        rest = np.flatnonzero((label != label[x]) & ((chunk == j) if i < j else (ids > ids[x])))
        rest = rest[(100 * np.minimum(size[rest], size[x]) >= percent * np.maximum(size[rest], size[x]))]
        apart = np.bitwise_count(bits[rest] ^ bits[x]).sum(1, dtype=np.int64)
        possible = apart * (100 + percent) <= (100 - percent) * (size[rest] + size[x])
        rest, apart = rest[possible], apart[possible]
        if likeliest and len(rest):
            rest = rest[[int(np.argmin(apart / (size[rest] + size[x])))]]
        for y in rest.tolist():
            if likeliest or min(set(keys[x]).intersection(keys[y]), default=key) == key:
                found.append((int(max(ids[x], ids[y])), int(min(ids[x], ids[y]))))
    return found


def verified(pairs: DataFrame, sets: DataFrame, whole: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of the pairs ``a, b`` that are linked. The members of a pivot ``b`` are spread over groups; each gets its text once."""

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size_a, size_b = batch.column("size_a").to_numpy(), batch.column("size_b").to_numpy()
            bits = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BITS // 8) for c in ("bits_a", "bits_b")]
            apart = np.bitwise_count(bits[0] ^ bits[1]).sum(1, dtype=np.int64)
            smaller, larger = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
            keep = (100 * smaller >= percent * larger) & (apart * (100 + percent) <= (100 - percent) * (size_a + size_b))
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, grams = None, np.zeros(0, _U)
        for batch in batches:
            found = []
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            for x, y, own in zip(a, b, shingle_sets(batch.column("text"), n)):
                if x is None:
                    pivot, grams = y, own
                    continue
                assert y == pivot
                place = np.minimum(np.searchsorted(grams, own), max(0, len(grams) - 1))
                common = int((grams[place] == own).sum())
                if 100 * common >= percent * (len(own) + len(grams) - common):
                    found.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    def known(c: str) -> DataFrame:
        return sets.select(F.col("set_id").alias(c), F.col("n_shingles").alias(f"size_{c}"), F.col("bits").alias(f"bits_{c}"))

    near = cut(pairs.join(known("a"), "a").join(known("b"), "b").mapInArrow(possible, "a long, b long"), "candidates")
    groups = near.groupBy("b").agg(F.ceil(F.count("*") / GROUP_ROWS).cast("long").alias("groups"))
    spread = near.join(groups, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("groups")).alias("salt"))
    members = spread.join(whole.withColumnRenamed("set_id", "a"), "a").select("a", "b", "salt", "text")
    pivots = groups.join(whole.withColumnRenamed("set_id", "b"), "b").select(
        F.lit(None).cast("long").alias("a"), "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("salt"), "text"
    )
    dealt = members.union(pivots).repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("a").asc_nulls_first())
    return cut(dealt.select("a", "b", "text").mapInArrow(compare, "a long, b long"), "links")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``.

    Reads ``doc_id`` and ``text`` only. Words lie between ASCII white space, with A-Z
    in lower case. A row's set holds its distinct n-grams of ``n`` words, or with fewer
    words the whole sequence; two rows are linked if their sets' Jaccard similarity is at
    least ``percent`` / 100. ``component_id`` is the smallest id reachable by links. A row
    without words has an empty set and is its own component. Null ids are larger than
    any other. An empty table gives no rows. N-grams are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    signed = cut(signatures(docs, n, percent), "signatures")
    rows = cut(signed.select("doc_id", "n_shingles", "set_id"), "rows")
    sets = signed.where("n_shingles > 0").groupBy("set_id").agg(
        F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n_shingles"), F.max("bits").alias("bits")
    )
    sets = cut(sets, "sets")
    sent = signed.where("n_shingles > 0").select("set_id", F.explode("keys").alias("key"))
    shared = sent.groupBy("key").agg(F.min("set_id").alias("low"), F.max("set_id").alias("high")).where("low <> high").select("key")
    shared = cut(shared, "shared")
    release(spark)
    members = cut(sent.join(shared, "key").select("key", "set_id").distinct(), "members")
    discard(signed)
    release(spark)
    whole = cut(_texts(docs, sets.join(members.select("set_id").distinct(), "set_id").select("set_id", "rep"), n), "texts")
    release(spark)
    labels = cut(members.select(F.col("set_id").alias("node"), F.col("set_id").alias("label")).distinct(), "labels")
    left = members.withColumn("label", F.col("set_id"))
    for turn, most in enumerate(PIVOTS):
        pivot = left.groupBy("key").agg(F.min_by(F.struct("set_id", "label"), F.xxhash64("set_id", F.lit(turn))).alias("pivot"))
        pairs = (
            left.join(pivot, "key").where("label <> pivot.label").groupBy(F.col("set_id").alias("a"))
            .agg(F.slice(F.sort_array(F.collect_set("pivot.set_id")), 1, most).alias("some")).select("a", F.explode("some").alias("b"))
        )
        labels = merged(labels, verified(pairs, sets, whole, n, percent))
        left = _mixed(members, labels)
        if left.isEmpty():
            break
    else:
        # Most members that are still apart find their component by one partner; only then all pairs are held against each other.
        labels = merged(labels, verified(cut(_across(left, sets, percent, True), "likeliest"), sets, whole, n, percent))
        left = _mixed(left, labels)
        labels = merged(labels, verified(cut(_across(left, sets, percent), "across"), sets, whole, n, percent))
    named = sets.select("set_id", "rep").join(labels.withColumnRenamed("node", "set_id"), "set_id", "left")
    named = cut(named.select("set_id", "rep", F.coalesce("label", "set_id").alias("label")), "components")
    smallest = named.groupBy("label").agg(F.min("rep").alias("component"))
    of_set = named.join(smallest, "label").select("set_id", "component")
    return (
        rows.join(of_set, "set_id", "left")
        .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
    )
