"""Near-duplicate lines of a corpus: an exact join of token sets with prefix, length and positional filters.

Everything is DataFrame expressions. The tokens of a line are packed into longs
that hold how frequent a token's hash bucket is in the whole corpus and the
token's hash, so sorting them puts the rarest first in the same order everywhere.
Two sets with a Jaccard similarity of at least ``percent`` / 100 share a token among
the first few of each; such candidates pass if their sizes and the token's places
allow the overlap and if their signatures are near enough, and are verified on the whole
lines. A signature tells of each class of tokens whether the line has an odd number of them,
so two differ in no more bits than the sets do in tokens. Equal sets are one entry from the
start, so a line that stands in very many documents is compared once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetloom.llm.common import release
from assetloom.session import cut, discard

#: Hash buckets whose frequencies are counted; this many numbers come to the driver.
BUCKETS = 1 << 16
SPACE = r"[\x20\x09-\x0D]+"
_HASH = (1 << 48) - 1


def _words(text: F.Column) -> F.Column:
    """Lower-case words; a text with no white space but spaces needs no pattern to be split."""
    lower = F.lower(text)
    return F.array_remove(F.when(text.rlike(r"[\x09-\x0D]"), F.split(lower, SPACE)).otherwise(F.split(lower, " ")), "")


def _ranks(docs: DataFrame) -> F.Column:
    """An array with the rank (below 2**14) of every bucket by the frequency of its tokens in all rows."""
    counts = (
        docs.select(F.explode(_words(F.replace("text", F.lit("\n"), F.lit(" ")))).alias("word"))
        .groupBy(F.xxhash64("word").bitwiseAND(F.lit(BUCKETS - 1)).alias("bucket")).agg(F.count("*").alias("n")).collect()
    )
    size = {r["bucket"]: r["n"] for r in counts}
    sizes = sorted(set(size.values()))
    rank = {n: (i + 1) * (1 << 14) // (len(sizes) + 1) for i, n in enumerate(sizes)}
    return F.split(F.lit(",".join(str(rank[size[b]]) if b in size else "0" for b in range(BUCKETS))), ",").cast("array<bigint>")


def _tokens(line: F.Column, ranks: F.Column) -> F.Column:
    """The distinct tokens of a line as sorted longs, rarest first."""

    def packed(value: F.Column) -> F.Column:
        rank = F.get(ranks, value.bitwiseAND(F.lit(BUCKETS - 1)).cast("int"))
        return F.shiftleft(rank, 48).bitwiseOR(value.bitwiseAND(F.lit(_HASH)))

    return F.sort_array(F.transform(F.array_distinct(F.transform(_words(line), lambda word: F.xxhash64(word).bitwiseAND(F.lit(_HASH)))), packed))


def _signature(tokens: str) -> F.Column:
    """A long whose bit i tells whether an odd number of the tokens have a hash of i modulo 64."""
    return F.expr(f"aggregate({tokens}, 0L, (bits, token) -> bits ^ shiftleft(1L, int(token & 63)))")


#: Longs of a wide signature, as many as values of the two bits that deal the tokens to them.
WIDE = 4


def _wide_signature(tokens: str) -> F.Column:
    """A signature of ``WIDE`` longs; the sum of their differences bounds the sets' difference."""
    return F.array(*(_signature(f"filter({tokens}, token -> (shiftright(token, 6) & {WIDE - 1}) = {i})") for i in range(WIDE)))


def _apart(one: F.Column, other: F.Column) -> F.Column:
    """The least number of tokens that only one of two sets has."""
    return F.bit_count(one.bitwiseXOR(other))


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("row"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def similar_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``doc_id, row, line_no`` of every line that an earlier one matches; ``row`` is a hash of the whole text.

    Lines lie between line feeds and are ordered by ``doc_id`` and place; lines at the same
    place (rows that repeat an id) are none of them earlier. The tokens of a line are its
    distinct lower-case words between ASCII white space. Two lines match if the Jaccard
    similarity of their tokens is at least ``percent`` / 100. Lines without words match none.
    Rows with a null id come last in the order, null texts have no lines. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text").where("text IS NOT NULL")
    ranks = _ranks(docs)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line_no")
    tokens = _lines(docs).withColumn("tokens", _tokens(F.col("line"), ranks))
    n = F.size("tokens")
    first_tokens = (n - F.expr(f"({percent} * size(tokens) + 99) DIV 100") + 1).cast("int")
    tokens = tokens.select(
        "doc_id", "row", "line_no", F.xxhash64("tokens").alias("set"), n.alias("n"), _signature("tokens").alias("bits"),
        F.slice("tokens", 1, first_tokens).alias("prefix"),
    )
    # Conditions on what the tokens give stand behind a cut: in front of it, Spark would make the tokens once more for them.
    tokens = cut(tokens, "tokens")
    lines = cut(tokens.where("n > 0").select("doc_id", "row", "line_no", "set"), "lines")
    sets = tokens.where("n > 0").groupBy("set").agg(F.min(F.struct(place.alias("place"), "row", "n", "bits", "prefix")).alias("spot"))
    spots = cut(sets.select("set", F.col("spot.place").alias("first"), "spot.row", "spot.n", "spot.bits", "spot.prefix"), "spots")
    discard(tokens)
    sets = cut(spots.select("set", "first", "row"), "sets")
    release(spark)
    prefix = spots.select("set", "n", "bits", F.posexplode("prefix").alias("at", "token"))
    left, right = (
        prefix.select("token", F.col("set").alias(s), F.col("n").alias(f"n_{s}"), F.col("at").alias(f"at_{s}"), F.col("bits").alias(f"bits_{s}"))
        for s in ("a", "b")
    )
    both = F.col("n_a") + F.col("n_b")
    shared = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))  # the most common tokens, this one being the first
    candidates = (
        left.join(right, "token").where("a < b")
        .where((100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & ((100 + percent) * shared >= percent * both))
        .where((100 + percent) * _apart(F.col("bits_a"), F.col("bits_b")) <= (100 - percent) * both)
        .select("a", "b").distinct()
    )
    candidates = cut(candidates, "candidates")
    discard(spots)
    wanted = candidates.select(F.col("a").alias("set")).union(candidates.select("b")).distinct()
    spots = sets.join(wanted, "set").select("set", "first", F.col("row").alias("of_row"), F.col("first.doc_id").alias("owner"), F.col("first.line_no").alias("at"))
    spots = cut(spots, "spots")
    release(spark)  # Spark holds the files of a step until the next one has run, so small steps come before the large ones
    whole = (
        _lines(docs).join(spots, F.col("doc_id").eqNullSafe(F.col("owner")) & (F.col("row") == F.col("of_row")) & (F.col("line_no") == F.col("at")))
        .select("set", "first", _tokens(F.col("line"), ranks).alias("tokens"))
        .select("set", "first", "tokens", F.xxhash64("tokens").alias("found"), _wide_signature("tokens").alias("bits"))
    )
    whole = cut(whole, "whole").where("found = set")
    # A set goes if any earlier one is similar, so the earliest candidate is tried first; only sets that stay try all others.
    sides = cut(whole.groupBy("set").agg(F.first(F.struct("first", F.size("tokens").alias("n"), "bits")).alias("of")), "sides")
    release(spark)
    placed = candidates.join(sides.select(F.col("set").alias("a"), F.col("of").alias("of_a")), "a")
    placed = placed.join(sides.select(F.col("set").alias("b"), F.col("of").alias("of_b")), "b").where("of_a.first <> of_b.first")
    apart = sum((_apart(F.col("of_a.bits")[i], F.col("of_b.bits")[i]) for i in range(WIDE)), F.lit(0))
    sooner = F.col("of_a.first") < F.col("of_b.first")
    placed = placed.where((100 + percent) * apart <= (100 - percent) * (F.col("of_a.n") + F.col("of_b.n"))).select(
        F.when(sooner, F.col("b")).otherwise(F.col("a")).alias("set"), F.when(sooner, F.col("a")).otherwise(F.col("b")).alias("before"),
        F.least("of_a.first", "of_b.first").alias("first"),
    )
    placed = cut(placed, "placed")
    whole = whole.groupBy("set").agg(F.first("tokens").alias("tokens"))
    own, earlier = (whole.select(F.col("set").alias(c), F.col("tokens").alias(f"{c}_tokens")) for c in ("set", "before"))
    common = F.size(F.array_intersect("set_tokens", "before_tokens"))
    similar = (100 + percent) * common >= percent * (F.size("set_tokens") + F.size("before_tokens"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        return pairs.join(own, "set").join(earlier, "before").where(similar).select("set").distinct()

    soonest = cut(placed.groupBy("set").agg(F.min_by("before", "first").alias("before")), "soonest")
    release(spark)
    gone = cut(confirmed(soonest), "later")
    release(spark)
    rest = placed.select("set", "before").join(gone, "set", "left_anti").join(soonest, ["set", "before"], "left_anti")
    pairs = gone.union(confirmed(rest))
    gone = cut(pairs, "later")
    firsts = sets.select("set", "first").join(gone.withColumn("gone", F.lit(True)), "set", "left")
    judged = lines.select("doc_id", "row", "line_no", "set").join(firsts, "set")
    return judged.where(F.coalesce("gone", F.lit(False)) | (place > F.col("first"))).select("doc_id", "row", "line_no").distinct()


def _of_row() -> F.Column:
    """The join of documents with what is known of their rows, by ``owner`` and ``row``."""
    return F.col("doc_id").eqNullSafe(F.col("owner")) & (F.xxhash64("text") == F.col("row"))


def drop_similar_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``doc_id, n_lines, n_removed, text`` of every row: the text without the lines that an earlier one matches.

    Rules as in ``similar_lines``. A null text has no lines and stays null.
    """
    removed = similar_lines(docs, percent).groupBy(F.col("doc_id").alias("owner"), "row").agg(F.collect_set("line_no").alias("removed"))
    every = F.split("text", "\n", -1)
    kept = F.filter(every, lambda line, at: ~F.array_contains(F.coalesce("removed", F.array().cast("array<int>")), at))
    return docs.select("doc_id", "text").join(removed, _of_row(), "left").select(
        "doc_id", F.coalesce(F.size(every), F.lit(0)).alias("n_lines"), F.coalesce(F.size("removed"), F.lit(0)).alias("n_removed"),
        F.array_join(kept, "\n").alias("text"),
    )
