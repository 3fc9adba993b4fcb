"""Mixing sources to target weights by cube-method balanced sampling.

A document of a source with target T and size S is taken e = T/S times on average: floor(e)
times for sure and once more with probability e - floor(e). The cube method's flight phase
moves the fractional probabilities of a block of documents along directions of the null space
of the constraints (words and number of documents), until fewer undecided documents are left
than constraints + 1; what blocks leave undecided flies again in larger and larger blocks.

The landing decides the last two of a source, the constraint on the number of documents given up,
and closes what that leaves between the words taken and the target: some decided documents of
every size (the ladder: about RUNGS of each power of two, drawn by hash) stand by, and from the
largest to the smallest, each that brings the total nearer to its target changes sides, then up to three at once.

Blocks are cut by a hash of doc_id, so that a source with a third of all rows spreads over many
tasks. Draws come from hashes of the doc_ids: reruns agree. Sources stay in tables: their order,
targets and counts are computed there, and only sums come to the driver.

Null texts have size 0; a source of size 0 has target 0 and its documents are taken 0 times.
A null source is a source (the last). Rows that repeat a doc_id are one unit: they are taken
equally often. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.shared import LOWEST, Steps, release_shuffles, text_or_empty

#: Documents in a block of the flight phase.
BLOCK = 2000
#: Documents of each power of two in size that stand by for the landing, on average.
RUNGS = 12
#: Up to so many documents of a source are landed by weighing all choices.
FEW = 12
#: Up to so many sources their table is broadcast; beyond, it is joined by exchange.
FEW_SOURCES = 20_000
_INDEX_BITS = 33


def with_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): size is the number of words."""
    words = F.regexp_count(text_or_empty(), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words.alias("size"))


def with_targets(sources: DataFrame, steps: Steps, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sources (source, s) with source_index, in code point order, null last, and target; a table.

    The targets share `share` of all sizes by weight; those above most * s stop there, and the rest
    is shared anew until none is above: a round is one sum over the table of sources.
    """
    # Parts of a sorted table have consecutive rows: a row's index is that in its part, after all rows of earlier parts.
    ordered = steps.table(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("row", F.monotonically_increasing_id()))
    part, after = F.shiftright("row", _INDEX_BITS), 0
    begins = []
    for p, n in sorted((r["p"], r["n"]) for r in ordered.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()):  # a row for each part
        begins += [F.lit(p), F.lit(after)]
        after += n
    if not begins:
        return ordered.select("source", "s", F.lit(0).cast("long").alias("source_index"), F.lit(0.0).alias("target"))
    index = F.element_at(F.create_map(*begins), part) + F.col("row").bitwiseAND((1 << _INDEX_BITS) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_index") % len(weights) + 1).cast("int"))
    table = steps.table(ordered.select("source", "s", index.cast("long").alias("source_index")).withColumn("w", weight))
    total = table.agg(F.sum("s").alias("s")).first()["s"]
    each, stopped = 0.0, -1
    while True:
        above = F.lit(each) * F.col("w") > F.lit(most) * F.col("s")
        sums = table.agg(F.sum(F.when(above, F.col("s"))).alias("s"), F.sum(F.when(~above, F.col("w"))).alias("w"), F.count_if(above).alias("n")).first()
        if sums["n"] == stopped or not sums["w"]:
            break
        stopped, each = sums["n"], (share * total - most * (sums["s"] or 0)) / sums["w"]
    return table.select("source", "s", "source_index", F.least(F.lit(each) * F.col("w"), F.lit(most) * F.col("s")).alias("target"))


def flight(p: np.ndarray, sizes: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Inclusion probabilities after the flight phase: at most 2 stay between 0 and 1 (two constraints)."""
    out, weight, draw = p.tolist(), sizes.tolist(), draws.tolist()
    active: list[int] = []
    for i in range(len(out)):
        if not 0 < out[i] < 1:
            continue
        active.append(i)
        if len(active) < 3:
            continue
        a, b, c = active
        # The direction that keeps the number of documents and of words.
        u = (float(weight[b] - weight[c]), float(weight[c] - weight[a]), float(weight[a] - weight[b]))
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up, down = float("inf"), float("inf")
        for k, v in zip(active, u):
            if v > 0:
                up, down = min(up, (1 - out[k]) / v), min(down, out[k] / v)
            elif v < 0:
                up, down = min(up, -out[k] / v), min(down, (out[k] - 1) / v)
        step = up if draw[c] < down / (up + down) else -down
        for k, v in zip(active, u):
            x = out[k] + step * v
            out[k] = 0.0 if x < 1e-9 else 1.0 if x > 1 - 1e-9 else x
        active = [k for k in active if 0 < out[k] < 1]
    # A step along (1, -1, 0) can leave three; their sizes are equal, so they fly once more by pairs.
    while len(active) > 2:
        a, b = active[:2]
        step = min(1 - out[a], out[b]) if draw[b] < 0.5 else -min(out[a], 1 - out[b])
        out[a], out[b] = out[a] + step, out[b] - step
        for k in (a, b):
            out[k] = 0.0 if out[k] < 1e-9 else 1.0 if out[k] > 1 - 1e-9 else out[k]
        active = [k for k in active if 0 < out[k] < 1]
    return np.asarray(out)


def _sorted(frame: pd.DataFrame) -> pd.DataFrame:
    return frame.sort_values(["size", "doc_id"], ascending=[False, True], kind="stable")


def _fly(frame: pd.DataFrame) -> pd.DataFrame:
    frame = _sorted(frame)[["doc_id", "source_index", "size", "p", "draw", "due", "rung"]]
    return frame.assign(p=flight(frame["p"].to_numpy(), frame["size"].to_numpy(), frame["draw"].to_numpy()))


def landing(p: np.ndarray, sizes: np.ndarray, missing: float) -> np.ndarray:
    """p, in descending order of sizes, without fractions.

    `missing`: the words still due, were the undecided not taken. Undecided documents are taken where
    that brings the rest nearer to 0; then decided ones change sides where it does.
    """
    p = p.copy()
    if len(p) <= FEW:  # so few that all choices can be weighed: the nearest one
        missing += float((np.floor(p) * sizes).sum())
        choices = (np.arange(1 << len(p))[:, None] >> np.arange(len(p))) & 1
        return choices[np.argmin(np.abs(missing - choices @ sizes))].astype(float)
    undecided = (p > 0) & (p < 1)
    for i in np.flatnonzero(undecided):
        p[i] = float(missing >= sizes[i] / 2 and sizes[i] > 0)
        missing -= p[i] * sizes[i]
    while True:
        before = abs(missing)
        for i in range(len(p)):
            change = (1 - 2 * p[i]) * sizes[i]
            if sizes[i] and abs(missing - change) < abs(missing):
                p[i], missing = 1 - p[i], missing - change
        # Three at once: for each pair (or one and none), the one that comes nearest with it.
        change = np.append((1 - 2 * p) * sizes, 0.0)
        order = np.argsort(change, kind="stable")
        first, second = np.triu_indices(len(change), 1)
        at = np.searchsorted(change[order], missing - change[first] - change[second])
        third = order[np.stack((np.maximum(at - 1, 0), np.minimum(at, len(p))), axis=1)]
        left = np.abs(missing - (change[first] + change[second])[:, None] - change[third])
        left[(third == first[:, None]) | (third == second[:, None])] = np.inf
        best = np.unravel_index(int(np.argmin(left)), left.shape)
        if left[best] < abs(missing):
            for k in {int(first[best[0]]), int(second[best[0]]), int(third[best])} - {len(p)}:
                p[k], missing = 1 - p[k], missing - change[k]
        if abs(missing) > before - 0.5:
            break
    return p


def _land(frame: pd.DataFrame) -> pd.DataFrame:
    frame = _sorted(frame)
    p, sizes = frame["p"].to_numpy(), frame["size"].to_numpy()
    return frame[["doc_id"]].assign(more=landing(p, sizes, float(frame["missing"].iloc[0])).astype(np.int32))


_SCHEMA = "doc_id long, source_index long, size long, p double, draw double, due double, rung boolean"


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(doc_id, source, size, source_size, target, times), one row per row of docs; a table."""
    spark = docs.sparkSession
    steps = Steps(spark)
    sized = steps.table(with_sizes(docs))
    # A unit is a doc_id. Its source is that of its smallest row, and its size counts there.
    units = sized.groupBy("doc_id").agg(F.sum("size").alias("size"), F.min_by("source", F.struct("size", "source")).alias("source"))
    units = steps.table(units.withColumn("class", F.length(F.bin("size"))))
    table = with_targets(sized.groupBy("source").agg(F.sum("size").alias("s")), steps, weights, share, most)
    held = units.groupBy("source", "class").agg(F.count("*").alias("n"), F.sum("size").alias("u"))
    held = held.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("class", "n"))).alias("classes"), F.sum("u").alias("unit_size")).withColumnRenamed("source", "x")
    e = F.when(F.col("s") > 0, F.col("target") / F.col("s")).otherwise(0.0)
    table = steps.table(table.join(held, F.col("source").eqNullSafe(F.col("x")), "left").drop("x").withColumns({"e": e, "due": e * F.coalesce("unit_size", F.lit(0))}))
    small = F.broadcast if table.count() <= FEW_SOURCES else lambda df: df
    key = F.coalesce(F.col("doc_id"), F.lit(LOWEST))
    drawn = lambda seed: F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    dealt = units.join(small(table.withColumnRenamed("source", "x")), F.col("source").eqNullSafe(F.col("x")))
    base, p = F.floor("e").cast("int"), F.col("e") - F.floor("e")
    rung = (p > 0) & (F.col("size") > 0) & (drawn(73) * F.element_at("classes", F.col("class")) < RUNGS)
    units = steps.table(dealt.select("doc_id", "source_index", "size", base.alias("base"), p.alias("p"), drawn(71).alias("draw"), "due", rung.alias("rung")))
    state = units.filter((F.col("p") > 0) & (F.col("p") < 1)).drop("base")
    decided, level, more = [], 0, True
    while more:
        counts = steps.table(state.groupBy("source_index").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
        more = not counts.filter("blocks > 1").isEmpty()
        few = F.broadcast if small is F.broadcast else lambda df: df
        block = F.pmod(F.xxhash64("doc_id", F.lit(level)), F.col("blocks")).cast("int").alias("block")
        flown = state.join(few(counts), "source_index").select(state["*"], block)
        flown = steps.table(flown.groupBy("source_index", "block").applyInPandas(_fly, _SCHEMA))
        open_ = (F.col("p") > 0) & (F.col("p") < 1)
        decided.append(flown.filter(~open_))
        state = flown.filter(open_)
        level += 1
    flown = state
    for d in decided:
        flown = flown.unionByName(d)
    # Words due beyond those of the sure takes and of the flown documents that are decided.
    sure = units.groupBy("source_index").agg(F.sum(F.col("base") * F.col("size")).alias("sure"))
    taken = flown.groupBy("source_index").agg(F.sum(F.when(F.col("p") >= 1, F.col("size")).otherwise(0)).alias("won"), F.first("due").alias("due"))
    missing = taken.join(sure, "source_index").select("source_index", (F.col("due") - F.col("sure") - F.col("won")).alias("missing"))
    last = flown.filter(F.col("rung") | ((F.col("p") > 0) & (F.col("p") < 1))).select("doc_id", "source_index", "size", "p").join(missing, "source_index")
    landed = last.groupBy("source_index").applyInPandas(_land, "doc_id long, more int").withColumnRenamed("doc_id", "x")
    flown = flown.select("doc_id", F.col("p").cast("int").alias("flown")).join(landed, F.col("doc_id").eqNullSafe(F.col("x")), "left")
    extra = flown.select(F.col("doc_id").alias("x"), F.coalesce("more", "flown").alias("more"))
    times = units.select("doc_id", "base").join(extra, F.col("doc_id").eqNullSafe(F.col("x")), "left")
    times = times.select(F.col("doc_id").alias("unit"), (F.col("base") + F.coalesce("more", F.lit(0))).cast("int").alias("times"))
    out = sized.join(times, F.col("doc_id").eqNullSafe(F.col("unit"))).drop("unit")
    out = out.join(small(table.select(F.col("source").alias("x"), F.col("s").alias("source_size"), "target")), F.col("source").eqNullSafe(F.col("x")))
    out = steps.result(out.select("doc_id", "source", "size", "source_size", "target", "times"))
    release_shuffles(spark)
    return out


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    times = mix(docs, **options).select(F.col("doc_id").alias("unit"), "times").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("key"))
    joined = rows.join(times, F.col("key").eqNullSafe(F.col("unit")))
    return joined.select("row", F.explode(F.array_repeat(F.lit(0), F.col("times")))).select("row.*")
