"""Saved assignments: replay, event log, remaining stock, summaries, display."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetloom.functions.values import date_text
from assetloom.operators.ranking import dense_ids, running_before
from assetloom.session import cut


def current_assignments(events: DataFrame) -> DataFrame:
    """The last event of each asset; a last event without a purchase means unassigned.

    Events are ``(asset_id, purchase_id or null, ts)`` plus an optional
    ``event_id`` that orders events at the same time.
    """
    tie = ["event_id"] if "event_id" in events.columns else []
    last = F.max_by(F.struct("purchase_id"), F.struct("ts", *tie)).alias("last")
    return (
        events.groupBy("asset_id")
        .agg(last)
        .select("asset_id", F.col("last.purchase_id").alias("purchase_id"))
        .where(F.col("purchase_id").isNotNull())
    )


def assign_with_stock(events: DataFrame, purchases: DataFrame) -> DataFrame:
    """The log replayed with refusals: ``(event_id, asset_id, purchase_id, ts, taken)``, unassigning events left out.

    An asset gives its purchase back at its next event that names another one or none.
    An event that names a purchase without free stock is refused, and the asset is left
    with nothing; naming the purchase one already holds changes nothing. Purchases that
    are not in the table, and stock that is null or below one, refuse all. Event ids are unique.

    What an asset holds between two events depends on no other purchase, so each purchase is
    replayed alone, in one pass that remembers its present holders. A purchase with more than
    ``REPLAY_ROWS`` rows is cut into stretches first. A run (the events of an asset that name one
    purchase in a row) holds from the first event at which no more runs are open than there is
    stock; an event is refused while so many runs are known to hold. Both are running sums
    over the log, and what they decide narrows them again. What is left lies in stretches at
    whose beginning all holders are known; each is replayed alone.
    """
    log = cut(_run_log(events, purchases), "log")
    hot = log.groupBy("purchase_id").count().where(F.col("count") > REPLAY_ROWS).select("purchase_id")
    if hot.isEmpty():
        return _replayed(_whole(log))
    hot = cut(hot, "hot")
    calm, log = log.join(hot, "purchase_id", "left_anti"), _numbered(log.join(hot, "purchase_id", "left_semi"))
    settled = [_replayed(_whole(calm))]
    for _ in range(BOUND_ROUNDS):
        log = _bounded(log)
        open_ones = log.where(UNDECIDED).select("purchase_id").distinct()
        settled.append(log.join(open_ones, "purchase_id", "left_anti").where("event_id IS NOT NULL").withColumn("taken", F.expr(TAKEN)))
        log = cut(log.join(open_ones, "purchase_id", "left_semi"), "contended")
        if log.isEmpty():
            break
    else:
        stretches = contended_stretches(log)
        calm = stretches.where("event_id IS NOT NULL AND NOT in_stretch").withColumn("taken", F.expr(TAKEN))
        settled += [calm, _replayed(stretches.where("in_stretch"))]
    columns = ["event_id", "asset_id", "purchase_id", "ts", "taken"]
    return reduce(DataFrame.unionByName, [part.select(*columns) for part in settled])


#: Rows of the log that one replay takes; purchases with more are cut into stretches, with the same results.
REPLAY_ROWS = 200_000
#: Times that the bounds of a contended log are narrowed before its stretches are replayed.
BOUND_ROUNDS = 4
#: An event of the run log of which the bounds do not tell whether its asset holds the purchase after it, and whether it does.
UNDECIDED = "(event_id IS NOT NULL AND NOT refused AND (hold IS NULL OR pos < hold))"
TAKEN = "coalesce(pos >= hold, false)"


def _run_log(events: DataFrame, purchases: DataFrame) -> DataFrame:
    """``purchase_id, ts, at_id, run, event_id, asset_id, stock``: a row per event, and one without ``event_id`` where a run ends.

    Runs are numbered through all assets. If an asset has more than ``REPLAY_ROWS`` events, neighbours
    are found by dense numbers, so that it is no single group.
    """
    named = events.select("asset_id", "purchase_id", "ts", "event_id")
    hot = not named.groupBy("asset_id").count().where(F.col("count") > REPLAY_ROWS).isEmpty()
    changed = lambda before, asset: ~(before.eqNullSafe(F.col("purchase_id")) & asset)
    if hot:
        order = [F.col("asset_id").asc_nulls_first(), F.col("ts"), F.col("event_id")]
        numbered = cut(dense_ids(named, order, "no", unique=True), "events")
        before = numbered.select((F.col("no") + 1).alias("no"), F.col("asset_id").alias("_asset"), F.col("purchase_id").alias("_purchase"))
        same = F.coalesce(F.col("_asset").eqNullSafe(F.col("asset_id")), F.lit(False)) & (F.col("no") > 1)
        marked = numbered.join(before, "no", "left").withColumn("begins", changed(F.col("_purchase"), same).cast("int")).drop("_asset", "_purchase")
        marked = running_before(marked, [], "no", F.col("begins"), "run", numbered.count())
        marked = cut(marked.withColumn("run", F.col("run") + F.col("begins")), "runs")
        begun = marked.where("begins = 1")
        after = begun.select((F.col("run") - 1).alias("run"), F.col("asset_id").alias("_asset"), F.struct("ts", "event_id").alias("end"))
        ends = begun.join(after, "run").where(F.col("_asset").eqNullSafe(F.col("asset_id")))
        number = F.col("run")
    else:
        whose = Window.partitionBy("asset_id").orderBy("ts", "event_id")
        first = F.row_number().over(whose) > 1
        begins = changed(F.lag("purchase_id").over(whose), first).cast("int")
        marked = named.withColumn("begins", begins).withColumn("run", F.sum("begins").over(whose))
        next_one = Window.partitionBy("asset_id").orderBy("run")
        begun = marked.where("begins = 1").withColumn("end", F.lead(F.struct("ts", "event_id")).over(next_one))
        ends = begun.where("end IS NOT NULL")
        number = F.concat_ws(":", "asset_id", "run")  # the last part is a number, so the text is unique
    kinds = {f.name: f.dataType for f in named.schema.fields}
    tried = marked.select("purchase_id", "ts", F.col("event_id").alias("at_id"), number.alias("run"), "event_id", "asset_id")
    ended = ends.select(
        "purchase_id", F.col("end.ts").alias("ts"), F.col("end.event_id").alias("at_id"), number.alias("run"),
        F.lit(None).cast(kinds["event_id"]).alias("event_id"), F.lit(None).cast(kinds["asset_id"]).alias("asset_id"),
    )
    stock = purchases.select("purchase_id", F.col("count").cast("long").alias("stock"))
    log = tried.unionByName(ended).where("purchase_id IS NOT NULL")
    return log.join(stock, "purchase_id", "left").withColumn("stock", F.coalesce("stock", F.lit(0)))


def _whole(log: DataFrame) -> DataFrame:
    """Every purchase as one stretch, of whose events nothing is known."""
    none = F.lit(None).cast("bigint")
    return log.withColumns({"stretch": F.lit(0).cast("bigint"), "pos": F.lit(0).cast("bigint"), "hold": none, "free": F.col("stock")})


def _numbered(log: DataFrame) -> DataFrame:
    """The log with ``pos``, its place; ``first``, the run's first event that is not known to be refused; and ``hold``, the first from which it is known to hold."""
    numbered = dense_ids(log, [F.col("purchase_id"), F.col("ts"), F.col("at_id")], "pos", unique=True)
    numbered = cut(numbered.withColumn("refused", F.lit(False)), "log")
    first = numbered.where("event_id IS NOT NULL").groupBy("run").agg(F.min("pos").alias("first"))
    return cut(numbered.join(first, "run").withColumn("hold", F.lit(None).cast("bigint")), "log")


def _change(at: str) -> Column:
    """+1 where a run's ``at`` is, -1 where a run that has one ends."""
    return F.expr(f"CASE WHEN event_id IS NULL THEN IF({at} IS NULL, 0, -1) WHEN pos = {at} THEN 1 ELSE 0 END")


def _rows(log: DataFrame) -> int:
    return log.agg(F.max("pos")).first()[0] or 0


def _bounded(log: DataFrame) -> DataFrame:
    """The log with ``hold``, ``refused`` and ``first`` as far as the present bounds tell."""
    rows = _rows(log)
    counted = running_before(log, ["purchase_id"], "pos", _change("first"), "most", rows)
    counted = running_before(counted, ["purchase_id"], "pos", _change("hold"), "least", rows)
    holds = F.expr(f"{UNDECIDED} AND most + int(pos = first) <= stock")
    refused = F.expr(f"refused OR ({UNDECIDED} AND least >= stock)")
    judged = cut(counted.withColumns({"holds": holds, "refused": refused}).drop("most", "least", "first"), "judged")
    per_run = judged.where("event_id IS NOT NULL").groupBy("run").agg(
        F.min(F.when(F.col("holds"), F.col("pos"))).alias("held"), F.min(F.when(~F.col("refused"), F.col("pos"))).alias("first")
    )
    return judged.join(per_run, "run").withColumn("hold", F.least("hold", "held")).drop("held", "holds")


def contended_stretches(log: DataFrame) -> DataFrame:
    """The log with ``in_stretch``, ``stretch`` and, on the first row of each stretch, ``free`` stock.

    A run is uncertain from its first event that may hold to the one that surely does, or to its end. A
    stretch is where uncertain runs overlap; at its beginning every run is known to hold or not to.
    """
    rows = _rows(log)
    uncertain = "(first IS NOT NULL AND NOT first <=> hold)"
    change = F.expr(
        f"CASE WHEN NOT {uncertain} THEN 0 WHEN pos = first THEN 1 WHEN pos = hold OR (event_id IS NULL AND hold IS NULL) THEN -1 ELSE 0 END"
    )
    covered = running_before(log.withColumn("change", change), ["purchase_id"], "pos", F.col("change"), "cover", rows)
    covered = running_before(covered, ["purchase_id"], "pos", _change("hold"), "least", rows)
    begins = F.expr("cover = 0 AND change = 1")
    counted = running_before(covered.withColumn("begins", begins), ["purchase_id"], "pos", F.expr("int(begins)"), "stretch", rows)
    return counted.withColumns({
        "in_stretch": F.expr("cover > 0 OR change = 1"), "stretch": F.expr("stretch + int(begins)"),
        "free": F.expr("CASE WHEN begins THEN stock - least END"),
    }).drop("change", "cover", "least", "begins")


def _replayed(rows: DataFrame) -> DataFrame:
    """The events of the stretches with ``taken``, each stretch replayed from its known holders, in one pass."""
    names = ["event_id", "asset_id", "purchase_id", "ts", "taken"]

    def replay(batches):
        stretch, start, free, held = None, 0, 0, set()
        for batch in batches:
            column = [batch.column(c).to_pylist() for c in ("purchase_id", "stretch", "pos", "run", "hold", "free")]
            event, taken = batch.column("event_id").is_valid().to_pylist(), []
            for purchase, number, pos, run, hold, fresh, named in zip(*column, event):
                if (purchase, number) != stretch:
                    stretch, start, free, held = (purchase, number), pos, fresh, set()
                before = hold is not None and hold < start
                if not named:  # the run ends; it gives back what it took here or held before
                    if before or run in held:
                        held.discard(run)
                        free += 1
                    continue
                if not before and run not in held and (free > 0 or pos == hold):
                    free -= 1
                    held.add(run)
                taken.append(before or run in held)
            own = batch.filter(batch.column("event_id").is_valid())
            yield pa.RecordBatch.from_arrays([*(own.column(c) for c in names[:4]), pa.array(taken, pa.bool_())], names)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in names[:4]) + ", taken boolean"
    dealt = rows.select("purchase_id", "stretch", "pos", "run", "hold", "free", "event_id", "asset_id", "ts", "at_id")
    return dealt.repartition("purchase_id", "stretch").sortWithinPartitions("purchase_id", "stretch", "ts", "at_id").mapInArrow(replay, schema)


def remaining_stock(purchases: DataFrame, assignments: DataFrame) -> DataFrame:
    """``remaining_count`` = count less the assignments of each purchase; it may go below zero."""
    used = assignments.groupBy("purchase_id").agg(F.count("*").alias("_used"))
    left = F.col("count") - F.coalesce("_used", F.lit(0))
    return purchases.drop("remaining_count").join(used, "purchase_id", "left").withColumn("remaining_count", left).drop("_used")


def over_allocated(stock: DataFrame) -> DataFrame:
    return stock.where(F.col("remaining_count") < 0)


def replay(assets: DataFrame, purchases: DataFrame, assignments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Assets with their saved purchase, and purchases with their remaining stock."""
    saved = assignments.select("asset_id", F.col("purchase_id").alias("purchase_assignment"))
    assigned = assets.drop("purchase_assignment").join(saved, "asset_id", "left")
    return assigned, remaining_stock(purchases, assignments)


def assignment_summary(assets: DataFrame, assignments: DataFrame) -> DataFrame:
    """One row: all assets, saved assignments, and the difference."""
    counts = assets.select(F.lit(1).alias("a"), F.lit(0).alias("s")).unionByName(
        assignments.select(F.lit(0).alias("a"), F.lit(1).alias("s"))
    )
    total, assigned = F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("s"), F.lit(0))
    return counts.agg(
        total.alias("total_assets"), assigned.alias("assigned"), (total - assigned).alias("remaining")
    )


def assignment_list(assets: DataFrame, stock: DataFrame, assignments: DataFrame) -> DataFrame:
    """The assignments whose asset and purchase both exist, all columns as text."""
    shown = assignments.join(assets.select("asset_id", F.col("name").alias("asset_name")), "asset_id").join(
        stock.select("purchase_id", "date", "vendor", "item", "remaining_count"), "purchase_id"
    )
    return shown.select(
        F.col("asset_id").cast("string").alias("asset_id"),
        F.col("asset_name").cast("string").alias("asset_name"),
        F.col("purchase_id").cast("string").alias("purchase_id"),
        F.coalesce(date_text(F.col("date")), F.lit("")).alias("purchase_date"),
        F.col("vendor").cast("string").alias("vendor"),
        F.col("item").cast("string").alias("item"),
        F.col("remaining_count").cast("string").alias("remaining_count"),
    )


def dangling_assignments(assets: DataFrame, purchases: DataFrame, assignments: DataFrame) -> DataFrame:
    """Assignments that name an asset or a purchase which is not there."""
    no_asset = assignments.join(assets, "asset_id", "left_anti")
    no_purchase = assignments.join(purchases, "purchase_id", "left_anti").select(*assignments.columns)
    return no_asset.unionByName(no_purchase).distinct()


def merge_maps(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Union of two key-value tables; the new value wins."""
    kept = old.join(new, key, "left_anti").select(key, value)
    return kept.unionByName(new.select(key, value))
