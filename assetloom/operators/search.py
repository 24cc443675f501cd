"""Exact best-k similarity search between two tables of texts.

Targets are cut into shards of bounded size, in the order of a tree that splits texts
by how often they hold a character class, so that texts of a shard have similar
characters. A directory keeps per shard the length range, the most occurrences of
each character class, and the position and date ranges. Each query first visits the
shard where its own text would stand (its likely best neighbours), then the
shards of the highest score bounds, a few more in each round, as long as a
bound still reaches its k-th best so far. Inside a shard the same bound is applied
pair by pair before the exact score.

Nothing is lost: a shard or pair is skipped only when its bound proves that it
cannot enter the best k. No pair table is built: a visit returns at most k
rows per query. Queries per shard are cut into chunks, so a popular shard is
many small groups, and equal texts are scored once per group.
"""

from __future__ import annotations

import bisect
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetloom.functions.similarity import CLASSES, SCORERS, Texts, Windows, codes_of, lcs_slices, overlap_matrix, score_bound, window_bounds
from assetloom.functions.values import DAY_MICROS
from assetloom.operators.ranking import dense_ids
from assetloom.session import cut

EXACT = 1000.0  # ranks above every score
NEVER = int(np.iinfo(np.int64).max)
SHARD_ROWS = (256, 16_384)
#: Best windows are sought against many targets at once, so their shards are no smaller (where there are as many).
WINDOW_ROWS = 1_024
CHUNK_ROWS = (256, 8_192)
#: Queries of so many ids in a row go to one chunk: numbered by their texts, they begin alike and are scored together.
NEIGHBOURS = 256
GROUP_CHARS = 256_000_000
MATRIX_CELLS = 2_000_000
#: Bounds held at once while the best windows are sought, and targets of a query that are scored one by one before the rest.
BOUND_CELLS = 1 << 18
SEEDS = 4
#: Shards by descending bound that a query may visit up to the first, second, ... round after its home; the last round visits the rest.
ROUND_ENDS = (4, 24)
#: With up to this many shards one round after the home visits them all.
FEW_SHARDS = 16
#: Targets (chosen by a hash) whose character counts shape the tree, and the least of them in a leaf.
TREE_SAMPLE = 131_072
LEAF_SAMPLE = 8
HIT_SCHEMA = "qid BIGINT, tid BIGINT, tpos BIGINT, score DOUBLE, gap BIGINT"

# Optional columns and the value that makes each of them inert.
QUERY_DEFAULTS = {"q_key": None, "q_at": 0, "q_min": 0, "q_score": math.inf, "q_gap": 0, "q_pos": -1}
TARGET_DEFAULTS = {"t_key": None, "t_at": 0, "t_cut": NEVER}


@dataclass(frozen=True)
class Rule:
    """What counts as a match.

    ``keyed`` queries also accept targets with an equal key, at any score and
    ahead of all others; ``rounded`` compares scores at two decimals.
    """

    floor: float
    inclusive: bool = False
    scorer: str = "ratio"
    rounded: bool = False
    keyed: bool = False

    def clears(self, score):
        return score >= self.floor if self.inclusive else score > self.floor


@dataclass(frozen=True)
class Index:
    """Targets cut into shards, and the directory that says what each shard can hold."""

    shards: DataFrame
    directory: object
    rule: Rule
    tree: object = None


@dataclass(frozen=True)
class Tree:
    """Splits by occurrences of a character class: from ``cut`` on a text goes to ``right``, else to ``left``; leaves have no class."""

    cls: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaf: np.ndarray  # numbers of the leaves from left to right

    def leaves(self, counts: np.ndarray) -> np.ndarray:
        node = np.zeros(len(counts), np.int64)
        while True:
            inner = np.flatnonzero(self.cls[node] >= 0)
            if not len(inner):
                return self.leaf[node]
            at = node[inner]
            node[inner] = np.where(counts[inner, self.cls[at]] >= self.cut[at], self.right[at], self.left[at])


def grow_tree(counts: np.ndarray, most: int) -> Tree:
    """Split the sample at the middle of its most varying class until a part has at most ``most`` texts or all alike."""
    cls, cut_at, left, right, leaf = [], [], [], [], []
    leaves = 0

    def grow(rows: np.ndarray) -> int:
        nonlocal leaves
        node = len(cls)
        for column in (cls, cut_at, left, right, leaf):
            column.append(-1)
        spread = counts[rows].var(axis=0) if len(rows) > most else np.zeros(1)
        if spread.max() == 0:
            leaf[node], leaves = leaves, leaves + 1
            return node
        c = int(spread.argmax())
        values = np.sort(counts[rows, c])
        steps = np.flatnonzero(np.diff(values)) + 1
        value = values[steps[np.abs(steps - len(rows) // 2).argmin()]]
        above = counts[rows, c] >= value
        cls[node], cut_at[node] = c, value
        left[node] = grow(rows[~above])
        right[node] = grow(rows[above])
        return node

    grow(np.arange(len(counts)))
    return Tree(*(np.array(column, np.int64) for column in (cls, cut_at, left, right, leaf)))


def _with_leaves(df: DataFrame, text: str, tree) -> DataFrame:
    """``df`` with ``leaf``, the leaf of the broadcast tree that its texts belong to."""

    def run(batches):
        for part in batches:
            yield part.assign(leaf=tree.value.leaves(Texts(part[text].tolist()).class_counts()))

    return df.mapInPandas(run, _fields(df) + ", leaf bigint")


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _sampled_tree(targets: DataFrame, rows: int, n: int) -> Tree:
    """The tree whose leaves hold about ``rows`` of the ``n`` targets each."""

    def counted(batches):
        for part in batches:
            yield pd.DataFrame({"counts": list(Texts(part["ttext"].tolist()).class_counts())})

    chosen = targets if n <= TREE_SAMPLE else targets.where(F.pmod(F.xxhash64("tpos"), F.lit(n)) < TREE_SAMPLE)  # about as many
    sample = chosen.select("ttext").mapInPandas(counted, "counts array<int>").toPandas()["counts"]
    sampled = np.stack(sample.tolist()).astype(np.int32) if len(sample) else np.zeros((1, CLASSES), np.int32)
    return grow_tree(sampled, max(rows * len(sampled) // n, LEAF_SAMPLE if n > TREE_SAMPLE else 1))


def build_index(targets: DataFrame, rule: Rule, least_rows: int = 1) -> Index | None:
    """Shard ``targets`` (``tid, tpos, ttext``, and ``t_key, t_at`` for keyed rules); None without targets.

    A shard holds at least ``least_rows`` targets, as the best-k of a keyed rule needs.
    """
    spark = targets.sparkSession
    targets = _with_defaults(targets, ["tid", "tpos", "ttext"], TARGET_DEFAULTS)
    targets = cut(targets, "targets")
    size = targets.agg(F.count("*").alias("n"), F.max(F.length("ttext")).alias("chars")).first()
    if not size.n:
        return None
    rows = _group_rows(size.n, 4 * spark.sparkContext.defaultParallelism, SHARD_ROWS, size.chars)
    rows = max(rows, min(max(least_rows, WINDOW_ROWS if rule.scorer == "partial" else 1), SHARD_ROWS[1]))
    tree, order = None, [F.col("t_key"), F.col("t_at")]
    if not rule.keyed:
        tree = spark.sparkContext.broadcast(_sampled_tree(targets, rows, size.n))
        targets, order = _with_leaves(targets, "ttext", tree), [F.col("leaf"), F.col("ttext")]
    numbered = cut(dense_ids(targets, [*order, F.col("tpos")], "_no", unique=True), "shards")
    shards = numbered.withColumn("shard", F.floor((F.col("_no") - 1) / rows).cast("int")).drop("_no")
    return Index(shards, spark.sparkContext.broadcast(_directory(shards)), rule, tree)


def nearest(
    queries: DataFrame, targets: DataFrame | Index | None, rule: Rule, k: int | None = 1, closed: DataFrame | None = None
) -> DataFrame:
    """The best ``k`` targets of each query: ``(qid, tid, tpos, score, gap)``.

    ``queries`` has ``qid, qtext`` and ``targets`` has ``tid, tpos, ttext``;
    ids and positions are unique. Order: equal keys first, then score from
    high to low, then ``gap`` (whole days from ``t_at`` to ``q_at``), then
    ``tpos``. Targets with ``t_at > q_at`` are no match, nor are those that
    ``closed`` gives a ``t_cut`` below ``q_min``, nor those at or before the
    place ``(q_score, q_gap, q_pos)`` in the order. With ``k=None`` each query brings
    its own ``want`` and the hits come back uncut: every hit up to its
    ``want``-th is there, and possibly later ones.
    """
    if k is not None:
        queries = queries.withColumn("want", F.lit(k).cast("bigint"))
    spark = queries.sparkSession
    queries = _with_defaults(queries, ["qid", "qtext", "want"], QUERY_DEFAULTS)
    queries = cut(queries.repartition(spark.sparkContext.defaultParallelism, F.floor(F.col("qid") / NEIGHBOURS)), "queries")
    asked = queries.agg(F.count("*").alias("n"), F.max(F.length("qtext")).alias("chars")).first()
    index = build_index(targets, rule, k or 1) if asked.n and isinstance(targets, DataFrame) else targets
    if not asked.n or index is None:
        return spark.createDataFrame([], HIT_SCHEMA)
    directory, shards, tree = index.directory, index.shards, index.tree
    if closed is not None:
        shards = shards.drop("t_cut").join(closed.select("tid", "t_cut"), "tid", "left")
        shards = shards.withColumn("t_cut", F.coalesce("t_cut", F.lit(NEVER)))
    chunk = _group_rows(asked.n, 2 * spark.sparkContext.defaultParallelism, CHUNK_ROWS, asked.chars)

    open_ended = {"least": F.lit(-1.0), "least_gap": F.lit(NEVER), "least_pos": F.lit(NEVER)}
    routed_schema = _fields(queries.withColumns(open_ended)) + ", shard int"

    def routes(asked: DataFrame, ranks: tuple[int, int] | None) -> DataFrame:
        return asked.mapInPandas(lambda it: _routes(it, directory.value, rule, tree, ranks), routed_schema)

    hits = cut(_visit(cut(routes(queries.withColumns(open_ended), None), "routes"), shards, rule, chunk), "hits")
    ends = ROUND_ENDS if len(directory.value) > FEW_SHARDS else ()
    if len(directory.value) == 1:  # the home is all there is
        return hits if k is None else _best(hits, k)
    for begin, end in zip((0, *ends), (*ends, len(directory.value))):
        # Visits may find more than wanted; the last place that counts is the want-th.
        if k == 1:
            bar = _best(hits, 1)
        else:
            place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "gap", "tpos"))
            bar = hits.withColumn("_place", place).join(queries.select("qid", "want"), "qid").where(F.col("_place") == F.col("want"))
        bar = bar.select("qid", F.col("score").alias("least"), F.col("gap").alias("least_gap"), F.col("tpos").alias("least_pos"))
        bounded = queries.join(bar, "qid", "left").withColumns({c: F.coalesce(c, v) for c, v in open_ended.items()})
        away = cut(routes(bounded, (begin, end)), "routes")
        if not away.isEmpty():
            found = _visit(away, shards, rule, chunk)
            hits = hits.unionByName(found if end == len(directory.value) else cut(found, "hits"))
    return hits if k is None else _best(hits, k)


def _with_defaults(df: DataFrame, base: list[str], defaults: dict) -> DataFrame:
    types = {"q_key": "string", "t_key": "string", "q_score": "double"}
    extra = [
        F.coalesce(F.col(c), F.lit(v)).cast(types.get(c, "bigint")).alias(c)
        if c in df.columns
        else F.lit(v).cast(types.get(c, "bigint")).alias(c)
        for c, v in defaults.items()
    ]
    longs = {"qid", "tid", "tpos", "want"}
    return df.select(*[F.col(c).cast("bigint").alias(c) if c in longs else F.col(c) for c in base], *extra)


def _group_rows(n: int, groups: int, limits: tuple[int, int], chars: int) -> int:
    fair = min(max(-(-n // groups), limits[0]), limits[1])
    return max(1, min(fair, GROUP_CHARS // max(chars or 1, 1)))


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = F.struct(-F.col("score"), F.col("gap"), F.col("tpos"))
    if k == 1:
        best = hits.groupBy("qid").agg(F.min_by(F.struct("tid", "tpos", "score", "gap"), order).alias("b"))
        return best.select("qid", "b.*")
    place = F.row_number().over(Window.partitionBy("qid").orderBy(order))
    return hits.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


# --- directory -----------------------------------------------------------------------------------

_DIRECTORY_SCHEMA = (
    "shard INT, min_len INT, max_len INT, counts ARRAY<INT>, first_text STRING, first_leaf BIGINT, first_key STRING, last_key STRING, "
    "first_at BIGINT, min_at BIGINT, max_at BIGINT, min_pos BIGINT"
)


def _shard_entry(t: pd.DataFrame) -> pd.DataFrame:
    texts = Texts(codes_of(t["ttext"])[1])
    keyed = t["t_key"].notna().any()
    first = t.sort_values(["leaf", "ttext"] if "leaf" in t else ["t_key", "t_at"]).iloc[0]
    return pd.DataFrame(
        {
            "shard": [t["shard"].iloc[0]],
            "min_len": [texts.lengths.min()],
            "max_len": [texts.lengths.max()],
            "counts": [texts.class_counts().max(axis=0)],
            "first_text": [first["ttext"]],
            "first_leaf": [first.get("leaf", 0)],
            "first_key": [first["t_key"]],
            "last_key": [t["t_key"].max() if keyed else None],
            "first_at": [first["t_at"]],
            "min_at": [t["t_at"].min()],
            "max_at": [t["t_at"].max()],
            "min_pos": [t["tpos"].min()],
        }
    )


def _directory(shards: DataFrame) -> pd.DataFrame:
    """One row per shard of up to 16,384 targets, in shard order."""
    entries = shards.groupBy("shard").applyInPandas(_shard_entry, _DIRECTORY_SCHEMA)
    return pd.DataFrame([r.asDict() for r in entries.collect()]).sort_values("shard", ignore_index=True)


# --- routing -------------------------------------------------------------------------------------


def _home_shards(q: pd.DataFrame, d: pd.DataFrame, rule: Rule, tree) -> np.ndarray:
    """For each query the shards that it visits first (three columns, which may repeat a shard)."""
    if not rule.keyed:
        starts = list(zip(d["first_leaf"].tolist(), d["first_text"].tolist()))
        texts = q["qtext"].tolist()
        leaves = tree.value.leaves(Texts(texts).class_counts()).tolist()
        spot = np.array([bisect.bisect_right(starts, place) - 1 for place in zip(leaves, texts)], np.int64)
        return np.repeat(np.maximum(spot, 0)[:, None], 3, axis=1)
    starts = list(zip(d["first_key"], d["first_at"]))
    last_keys = d["last_key"].tolist()
    out = np.zeros((len(q), 3), dtype=np.int64)
    for i, (key, at) in enumerate(zip(q["q_key"], q["q_at"])):
        # The latest targets of this key up to this date end in ``home``; where many share a date, the
        # first of them stand at the beginning of the key.
        home = max(bisect.bisect_right(starts, (key, at)) - 1, 0)
        before = home - 1 if home > 0 and last_keys[home - 1] == key else home
        out[i] = before, home, min(bisect.bisect_left(last_keys, key), home)
    return out


def _routes(batches, d: pd.DataFrame, rule: Rule, tree, ranks: tuple[int, int] | None):
    """Queries with the shards to visit: their homes (without ``ranks``), or those of these ranks by descending bound that may still count."""
    counts = np.stack(d["counts"].to_numpy()).astype(np.int32)
    min_len, max_len = d["min_len"].to_numpy(np.int64), d["max_len"].to_numpy(np.int64)
    min_at, max_at = d["min_at"].to_numpy(np.int64), d["max_at"].to_numpy(np.int64)
    min_pos = d["min_pos"].to_numpy(np.int64)[None, :]
    shard_ids = np.arange(len(d))
    first_keys, last_keys = d["first_key"].tolist(), d["last_key"].tolist()
    for q in batches:
        homes = _home_shards(q, d, rule, tree)
        if ranks is None:
            pairs = np.unique(np.stack([np.repeat(np.arange(len(q)), 3), homes.ravel()], 1), axis=0)
            yield q.iloc[pairs[:, 0]].assign(shard=pairs[:, 1].astype(np.int32))
            continue
        step = max(1, MATRIX_CELLS // len(d))
        for at in range(0, len(q), step):
            part, home = q.iloc[at : at + step], homes[at : at + step]
            code, unique = codes_of(part["qtext"])
            texts = Texts(unique)
            bound = score_bound(
                rule.scorer, overlap_matrix(texts.class_counts(), counts), texts.lengths[:, None], min_len[None, :], max_len[None, :]
            )
            bound = (np.round(bound, 2) if rule.rounded else bound)[code]
            q_at = part["q_at"].to_numpy(np.int64)[:, None]
            gap = np.zeros((1, 1), np.int64)
            if rule.keyed:
                first = np.array([bisect.bisect_left(last_keys, key) for key in part["q_key"]])[:, None]
                last = np.array([bisect.bisect_right(first_keys, key) for key in part["q_key"]])[:, None]
                bound = np.where((shard_ids >= first) & (shard_ids < last), EXACT, bound)
                gap = np.where(max_at[None, :] <= q_at, (q_at - max_at[None, :]) // DAY_MICROS, 0)
            least, least_gap, least_pos = (part[c].to_numpy()[:, None] for c in ("least", "least_gap", "least_pos"))
            sooner = (gap < least_gap) | ((gap == least_gap) & (min_pos < least_pos))
            go = rule.clears(bound) & ((bound > least) | ((bound == least) & sooner)) & (min_at[None, :] <= q_at)
            np.put_along_axis(go, home, False, axis=1)
            if ranks != (0, len(d)):
                order = np.argsort(-bound, axis=1, kind="stable")
                rank = np.empty_like(order)
                np.put_along_axis(rank, order, np.arange(len(d))[None, :], axis=1)
                go &= (rank >= ranks[0]) & (rank < ranks[1])
            rows, shard = np.nonzero(go)
            yield part.iloc[rows].assign(shard=shard.astype(np.int32))


# --- visiting ------------------------------------------------------------------------------------


def _visit(routed: DataFrame, shards: DataFrame, rule: Rule, chunk: int) -> DataFrame:
    """Score routed queries against their shards in groups of bounded size on both sides."""
    spark = routed.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if chunk == CHUNK_ROWS[1]:  # many groups, which smaller partitions spread more evenly
        partitions = max(partitions, 4 * spark.sparkContext.defaultParallelism)
    parts = routed.groupBy("shard").agg(F.ceil(F.count("*") / chunk).cast("int").alias("parts"))
    left = (
        routed.join(parts, "shard")
        .withColumn("part", F.pmod(F.xxhash64(F.floor(F.col("qid") / NEIGHBOURS)), F.col("parts")).cast("int"))
        .drop("parts")
        .repartition(partitions, "shard", "part")
    )
    right = (
        shards.join(parts, "shard")
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .drop("parts")
        .repartition(partitions, "shard", "part")
    )
    return (
        left.groupBy("shard", "part")
        .cogroup(right.groupBy("shard", "part"))
        .applyInPandas(lambda q, t: score_group(q, t, rule), HIT_SCHEMA)
    )


def score_group(q: pd.DataFrame, t: pd.DataFrame, rule: Rule) -> pd.DataFrame:
    """The best ``want`` targets of each query within one group."""
    empty = pd.DataFrame({"qid": [], "tid": [], "tpos": [], "score": [], "gap": []}).astype(
        {"qid": "int64", "tid": "int64", "tpos": "int64", "score": "float64", "gap": "int64"}
    )
    if q.empty or t.empty:
        return empty
    t_code, t_unique = codes_of(t["ttext"])
    q_code, q_unique = codes_of(q["qtext"])
    t_texts, q_texts = Texts(t_unique), Texts(q_unique)
    t_counts, q_counts = t_texts.class_counts(), q_texts.class_counts()
    order = np.argsort(q_code, kind="stable")
    q, q_code = q.iloc[order], q_code[order]
    least = np.maximum(q["least"].to_numpy(), rule.floor)
    lowest = np.full(len(q_unique), np.inf)
    np.minimum.at(lowest, q_code, least)
    first_row = np.searchsorted(q_code, np.arange(len(q_unique) + 1))

    key_codes, _ = codes_of([*q["q_key"], *t["t_key"]])
    t_side = {
        "code": t_code,
        "key": key_codes[len(q) :],
        "pos": t["tpos"].to_numpy(np.int64),
        "at": t["t_at"].to_numpy(np.int64),
        "cut": t["t_cut"].to_numpy(np.int64),
    }
    q_side = {"key": key_codes[: len(q)], "least": q["least"].to_numpy(), "want": q["want"].to_numpy(np.int64)}
    q_side |= {c: q[c].to_numpy() for c in ("q_at", "q_min", "q_score", "q_gap", "q_pos")}
    # Without per-row conditions, every target of a text is open to its queries and scores can raise the bar.
    open_targets = not rule.keyed and np.isinf(q_side["q_score"]).all() and (t_side["cut"] == NEVER).all()
    wanted = int(q_side["want"].max())
    # Of one date, equal scores go by position alone: what only ties with a known hit before it is not scored.
    first_pos = np.full(len(t_unique), NEVER)
    np.minimum.at(first_pos, t_code, t_side["pos"])
    lowest_pos = np.full(len(q_unique), NEVER)
    by_place = open_targets and wanted == 1 and len(np.unique(t_side["at"])) == 1
    if by_place:
        alone = (np.diff(first_row) == 1) & (least[first_row[:-1]] > rule.floor)
        lowest_pos[alone] = q["least_pos"].to_numpy(np.int64)[first_row[:-1]][alone]

    if by_place and rule.scorer == "partial" and not rule.rounded and t_side["at"][0] <= q_side["q_at"].min():
        by_pos = np.lexsort((t_side["pos"], t_code))
        firsts = np.sort(by_pos[np.searchsorted(t_code[by_pos], np.arange(len(t_unique)))])  # of equal texts the first place
        firsts = firsts[np.argsort(t_side["pos"][firsts], kind="stable")]
        best, at = _best_windows(q_texts, t_texts.chosen(t_code[firsts]), t_side["pos"][firsts], lowest, lowest_pos)
        row = np.flatnonzero((at[q_code] >= 0) & rule.clears(best[q_code]) & (best[q_code] >= q_side["least"]))
        target, score = firsts[at[q_code[row]]], best[q_code[row]]
        return _hits(q, t, row, target, score, (q_side["q_at"][row] - t_side["at"][target]) // DAY_MICROS)

    found = []
    step = max(1, MATRIX_CELLS // len(t_unique))
    for at in range(0, len(q_unique), step):
        block = np.arange(at, min(at + step, len(q_unique)))
        scores = _block_scores(
            q_texts, t_texts, q_counts, t_counts, block, lowest[block], rule, wanted if open_targets else 0,
            (lowest_pos[block], first_pos if by_place else None),
        )
        row_step = max(1, MATRIX_CELLS // len(t))
        for lo in range(first_row[block[0]], first_row[block[-1] + 1], row_step):
            rows = np.arange(lo, min(lo + row_step, first_row[block[-1] + 1]))
            found.append(_pick(rows, scores[q_code[rows] - at], q_side, t_side, rule))
    return _hits(q, t, *(np.concatenate(x) for x in zip(*found)))


def _hits(q, t, row, target, score, gap) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "qid": q["qid"].to_numpy(np.int64)[row],
            "tid": t["tid"].to_numpy(np.int64)[target],
            "tpos": t["tpos"].to_numpy(np.int64)[target],
            "score": score,
            "gap": gap,
        }
    )


def _best_windows(q_texts: Texts, t_texts: Texts, pos: np.ndarray, least: np.ndarray, least_pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per query the best-window score of its best target, and which one; -1 where none reaches ``least``.

    Targets come by position; of equal scores the first one counts, and of those equal to ``least`` only one before ``least_pos``.
    """
    windows = Windows(t_texts)
    best, at = least.copy(), np.full(q_texts.n, -1)
    # A very long name makes the blocks smaller, as its characters are a row of a matrix.
    step = max(1, min(BOUND_CELLS // t_texts.n, (BOUND_CELLS << 6) // max(1, int(q_texts.lengths.max()))))
    for begin in range(0, q_texts.n, step):
        ids = np.arange(begin, min(begin + step, q_texts.n))
        windows.ask(q_texts, ids)
        bar, bar_pos, chosen = best[ids], least_pos[ids], at[ids]

        def score(rows, cols):
            """Score those of these pairs that may still win; gives the rows that had any."""
            bound = windows.bound(rows, cols)
            go = (bound > bar[rows]) | ((bound == bar[rows]) & (pos[cols] < bar_pos[rows]))
            rows, cols = rows[go], cols[go]
            got = windows.scores(rows, cols, bar[rows])
            windows.most[rows, cols] = windows.ends[rows, cols] = 0
            order = np.lexsort((cols, -got, rows))
            order = order[np.diff(rows[order], prepend=-1) != 0]
            first, col, value = rows[order], cols[order], got[order]
            ahead = (value > bar[first]) | ((value == bar[first]) & (pos[col] < bar_pos[first]))
            first, col = first[ahead], col[ahead]
            bar[first], bar_pos[first], chosen[first] = value[ahead], pos[col], col
            return rows

        # The most promising target is scored first; what it reaches is the bar for the others.
        live = np.arange(len(ids))
        for _ in range(SEEDS):
            live = score(live, windows.most[live].argmax(axis=1))
        score(*windows.reaching(bar))
        best[ids], at[ids] = bar, chosen
    return best, at


def _block_scores(q_texts, t_texts, q_counts, t_counts, block, least, rule, wanted, places) -> np.ndarray:
    """Scores of a block of query texts against all target texts; -1 where the bound rules the pair out.

    ``places`` are the positions behind which a tie with ``least`` is no hit, and those of the targets if ties go by them.
    """
    overlap = overlap_matrix(q_counts[block], t_counts)
    partial = rule.scorer == "partial"
    if partial:
        whole, ends = window_bounds(overlap, q_texts, block, q_counts[block], t_texts)
        bound = np.maximum(whole, ends)
    else:
        bound = score_bound(rule.scorer, overlap, q_texts.lengths[block][:, None], t_texts.lengths, t_texts.lengths)
    bound = np.round(bound, 2) if rule.rounded else bound
    scores = np.full(bound.shape, -1.0)
    least_pos, pos = places

    def fill(rows, cols):
        got = SCORERS[rule.scorer](q_texts, t_texts, block[rows], cols)
        scores[rows, cols] = np.round(got, 2) if rule.rounded else got

    def reaches(value, bar, bar_pos):
        return value >= bar if pos is None else (value > bar) | ((value == bar) & (pos[None, :] < bar_pos))

    possible = reaches(bound, least[:, None], least_pos[:, None])
    seeds = min(wanted + 15, bound.shape[1]) if wanted else 0
    bar, bar_pos = least, least_pos
    if seeds and bound.shape[1] > 2 * seeds:
        # Score the most promising targets first: the k-th of them is the bar for the others.
        hope = -bound if pos is None else 1e-6 * np.argsort(np.argsort(pos)) / len(pos) - bound
        top = np.argpartition(hope, seeds - 1, axis=1)[:, :seeds]
        rows = np.repeat(np.arange(len(block)), seeds)
        fill(rows, top.ravel())
        found = np.take_along_axis(scores, top, axis=1)
        if pos is None:
            bar = -np.sort(-found, axis=1)[:, wanted - 1]
        else:
            best = np.lexsort((pos[top], -found), axis=1)[:, :1]
            bar = np.take_along_axis(found, best, axis=1)[:, 0]
            bar_pos = pos[np.take_along_axis(top, best, axis=1)[:, 0]]
        possible &= reaches(bound, bar[:, None], bar_pos[:, None]) & (scores < 0)
    rows, cols = np.nonzero(possible)
    if partial and len(rows):
        # One pass over a whole target says what its windows can hold, for a fraction of the cost of all windows.
        size = q_texts.lengths[block[rows]]
        lcs = lcs_slices(q_texts, block[rows], t_texts.codes, t_texts.starts[cols], t_texts.lengths[cols])
        short = np.minimum(size, t_texts.lengths[cols])
        shorter = np.minimum(ends[rows, cols], np.where(short > 0, 200.0 * lcs / np.maximum(short + lcs, 1), 100.0))
        value = np.maximum(np.minimum(whole[rows, cols], 100.0 * lcs / np.maximum(size, 1)), shorter)
        value = np.round(value, 2) if rule.rounded else value
        go = value >= bar[rows] if pos is None else (value > bar[rows]) | ((value == bar[rows]) & (pos[cols] < bar_pos[rows]))
        rows, cols = rows[go], cols[go]
    fill(rows, cols)
    return scores


def _pick(rows, scores, q, t, rule):
    """The best ``want`` targets per row under the row's own conditions."""
    s = scores[:, t["code"]]
    s = np.where(rule.clears(s), s, -1.0)
    if rule.keyed:
        same = q["key"][rows][:, None] == t["key"][None, :]
        s = np.where(same, EXACT, s)
    q_at = q["q_at"][rows][:, None].astype(np.int64)
    ok = (t["at"][None, :] <= q_at) & (t["cut"][None, :] >= q["q_min"][rows][:, None])
    cursor = q["q_score"][rows][:, None]
    if np.isfinite(cursor).any():
        gap, last_gap = (q_at - t["at"][None, :]) // DAY_MICROS, q["q_gap"][rows][:, None]
        behind = (gap > last_gap) | ((gap == last_gap) & (t["pos"][None, :] > q["q_pos"][rows][:, None]))
        ok &= (s < cursor) | ((s == cursor) & behind)
    s = np.where(ok & (s >= q["least"][rows][:, None]), s, -1.0)
    want = np.minimum(q["want"][rows], s.shape[1])
    if want.max() == 1:
        bar = s.max(axis=1)
    else:
        bar = -np.take_along_axis(np.sort(-s, axis=1), want[:, None] - 1, axis=1)[:, 0]
    r, c = np.nonzero((s >= bar[:, None]) & (s >= 0))
    score = s[r, c]
    gap = (q_at[r, 0] - t["at"][c]) // DAY_MICROS
    order = np.lexsort((t["pos"][c], gap, -score, r))
    r, c, score, gap = r[order], c[order], score[order], gap[order]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    keep = place < want[r]
    return rows[r[keep]], c[keep], score[keep], gap[keep]
