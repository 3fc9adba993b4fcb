"""N-gram Jaccard self-join by a MinHash LSH forest, verified exactly.

Every text has a label of `deepest` minima in each of `trees` trees. The labels of a tree, sorted,
are a prefix trie: a node is a run of labels with the same first minima, and neighbours in the order
tell how deep a text still has company. The join starts at the whole labels: texts that share one
in some tree are candidates, and these are compared exactly. The similarities found tell what a
prefix length misses: a pair of similarity s meets within d minima with probability
1 - (1 - s^d)^trees. While that is below the target recall for a band of similarities that has
pairs, or could hide too many pairs in the bands where none was found, the matched prefixes are
shortened to the greatest length that is not, and the pairs that meet there for the first time are
compared. They are never shorter than `shallowest` gives, at which a pair at the threshold itself
meets with the target recall.

Candidates are gathered in blocks of bounded size and compared exactly, as sets of shingles; no
pair leaves a block, only numbers of links, a spanning forest, and numbers of pairs by similarity.

Documents with the same words are one text (a class of copies); links between different texts are
all kept. A document's n_links counts its copies and all documents of linked texts; class_id is
the least doc_id that can be reached over links.

Null texts count as empty; documents without words have no links and are their own class. Texts
of 1 to 4 words are one shingle. A null doc_id takes part as the lowest and comes back as null;
rows that repeat a doc_id are separate documents with one class. An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from math import comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.kernels import U64, Words, minhash, mix
from wardlight.llm.shared import LOWEST, Steps, chunks, keyed, release_shuffles, runs, text_or_empty

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.998
TREES, DEEPEST = 12, 8
#: Texts that are compared with one another in one task at once.
BLOCK = 512
#: Parts into which the texts of a node that several blocks share are dealt.
SALTS = 16
#: Bands of similarity in which pairs are counted.
BANDS = 100


def reach(similarity: float, depth: int, trees: int) -> float:
    """The chance that a pair of that similarity shares its first `depth` minima in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def shallowest(threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, deepest: int = DEEPEST) -> int:
    """The longest prefix at which even a pair at the threshold meets with the wanted probability."""
    return next((d for d in range(deepest, 1, -1) if reach(threshold, d, trees) >= recall), 1)


def reaches(depth: int, pairs: dict[int, int], threshold: float, recall: float, trees: int) -> bool:
    """Whether prefixes of that length reach the recall, by the numbers of pairs found in each band of similarity.

    In a band without a found pair there are, with 95 % confidence, no more than log(0.05) / log(1 - p) pairs.
    """
    least = {b: max(threshold, b / BANDS) for b in range(int(threshold * BANDS), BANDS)}
    chance = {b: reach(s, depth, trees) for b, s in least.items()}
    if any(chance[b] < recall for b in least if pairs.get(b)):
        return False
    hidden = sum(log(0.05) / log(1 - p) for b, p in chance.items() if not pairs.get(b) and 0 < p < 1)
    return hidden <= (1 - recall) * sum(pairs.values())


def shortened(depth: int, pairs: dict[int, int], threshold: float, recall: float, trees: int, least: int) -> int | None:
    """The prefix length to go on with, or None where the present one is enough."""
    if depth <= least or reaches(depth, pairs, threshold, recall, trees):
        return None
    return next((d for d in range(depth - 1, least, -1) if reaches(d, pairs, threshold, recall, trees)), least)


def _text_key(words: Words, d: int) -> bytes:
    return hashlib.blake2b(words.hashes[words.first[d] : words.first[d + 1]].tobytes(), digest_size=16).digest()


def _describe(permutations: int, shingle: int):
    def run(batches):
        for rows in chunks(batches):
            words = Words([r[2] for r in rows])
            marks = minhash(*words.shingles(shingle), len(rows), permutations)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([_text_key(words, d) if words.counts[d] else None for d in range(len(rows))], pa.binary()),
                    pa.array([m.tobytes() for m in marks.astype("<u2")], pa.binary()),
                ],
                ["doc_id", "th", "text_key", "marks"],
            )

    return run


def _walk(deepest: int, least: int):
    """Over (tree, rep, label) in order: how deep each text has company, and its node (the first text of the run) at each depth from `least` on."""
    levels = np.arange(least, deepest + 1)

    def rows_of(tree, rep, label, up, down, nodes):
        depth = np.maximum(up, down)
        some = np.flatnonzero(depth >= least)
        flat = pa.array(nodes[some].ravel(), pa.int64())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * len(levels)), flat)
        columns = [pa.array(rep[some], pa.int64()), pa.array(tree[some], pa.int32()), pa.array(depth[some].astype(np.int32)), pa.array(up[some].astype(np.int32)), lists]
        return pa.RecordBatch.from_arrays(columns, ["rep", "tree", "depth", "up", "nodes"])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, rep = batch.column("tree").to_numpy(), batch.column("rep").to_numpy()
            label = np.frombuffer(b"".join(batch.column("label").to_pylist()), "<u2").reshape(len(rep), deepest)
            if held:
                tree, rep, label = (np.concatenate((h, x)) for h, x in zip(held, (tree, rep, label)))
            same = (label[1:] == label[:-1]) & (tree[1:] == tree[:-1])[:, None]
            common = np.logical_and.accumulate(same, axis=1).sum(axis=1)
            up = np.concatenate(([held[4] if held else 0], common))
            starts = up[:, None] < levels
            starts[0] = True
            place = np.maximum.accumulate(np.where(starts, np.arange(len(rep))[:, None], 0), axis=0)
            nodes = rep[place]
            if held:
                nodes = np.where(place == 0, held[3], nodes)
            yield rows_of(tree[:-1], rep[:-1], label[:-1], up[:-1], common, nodes[:-1])
            held = (tree[-1:], rep[-1:], label[-1:], nodes[-1], up[-1])
        if held:
            tree, rep, label, nodes, up = held
            yield rows_of(tree, rep, label, np.array([up]), np.array([0]), nodes[None, :])

    return run


def forest(texts: DataFrame, trees: int, deepest: int, least: int) -> DataFrame:
    """(rep, tree, depth, up, nodes) of the texts (rep, marks) that share at least their first `least` minima with another one in that tree.

    depth: the most minima shared; up: those shared with the text before, in the order of labels.
    """
    width = 2 * deepest
    label = F.expr(f"substring(marks, tree * {width} + 1, {width})").alias("label")
    labels = texts.select("rep", "marks", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).select("tree", "rep", label)
    dealt = labels.repartition("tree", F.substring("label", 1, 2 * least)).sortWithinPartitions("tree", "label", "rep")
    return dealt.mapInArrow(_walk(deepest, least), "rep long, tree int, depth int, up int, nodes array<long>")


def _shingle_sets(shingle: int):
    """Rows of blocks and the text of a representative: its sorted distinct shingles, for each block pair."""

    def run(batches):
        for rows in chunks(batches):
            words = Words([r[3] for r in rows])
            hashes, owner = words.shingles(shingle)
            first = np.searchsorted(owner, np.arange(len(rows) + 1))
            out = [(r[0], r[1], r[2], r[4], r[5], np.unique(hashes[first[d] : first[d + 1]]).tobytes()) for d, r in enumerate(rows)]
            types = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["rep", "copies", "block", "marks", "pairs", "shingles"])

    return run


def _hash_labels(values: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each text and tree."""
    out = np.zeros(values.shape[:2], U64)
    for j in range(values.shape[2]):
        out = mix(out * U64(0xC2B2AE3D27D4EB4F) + values[:, :, j] + U64(1))
    return out


def least_agreement(threshold: float, permutations: int, miss: float = 1e-6) -> int:
    """The most equal minima that a pair at the threshold falls short of with probability `miss` at most."""
    below, k = 0.0, 0
    while (below := below + comb(permutations, k) * threshold**k * (1 - threshold) ** (permutations - k)) <= miss:
        k += 1
    return k


def _candidates(marks: np.ndarray, block: np.ndarray, depth: int, done: int | None, agreement: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j that share a prefix of `depth` minima in some tree, none of `done`, and enough minima in all.

    marks: text, tree, minimum. Within the block, or across when there are two.
    """
    n, trees, deepest = marks.shape
    meet = np.zeros((n, n), bool)
    prefixes = _hash_labels(marks[:, :, :depth])
    for t in range(trees):
        order = np.argsort(prefixes[:, t], kind="stable")
        begins = runs(prefixes[order, t])
        for a, z in zip(begins, np.append(begins[1:], n)):
            if z - a > 1:
                meet[np.ix_(order[a:z], order[a:z])] = True
    if block.min() != block.max():
        meet &= block[:, None] != block
    i, j = np.nonzero(np.triu(meet, 1))
    keep = np.zeros(len(i), bool)
    for k in range(0, len(i), 1 << 15):
        same = marks[i[k : k + (1 << 15)]] == marks[j[k : k + (1 << 15)]]
        keep[k : k + (1 << 15)] = np.count_nonzero(same, axis=(1, 2)) >= agreement
        if done is not None:
            keep[k : k + (1 << 15)] &= ~same[:, :, :done].all(axis=2).any(axis=1)
    return i[keep], j[keep]


def _marks(table: pa.Table, trees: int) -> np.ndarray:
    return np.frombuffer(b"".join(table["marks"].to_pylist()), "<u2").reshape(table.num_rows, trees, -1)


def _screen(trees: int, depth: int, done: int | None, agreement: int):
    """Texts of a block pair that have a candidate to be compared with."""

    def run(table: pa.Table) -> pa.Table:
        stays = np.unique(np.concatenate(_candidates(_marks(table, trees), table["block"].to_numpy(), depth, done, agreement)))
        return table.select(["rep", "block", "pair"]).take(pa.array(stays))

    return run


def _common(shingles: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sets, by bit sets over the shingles that at least two of the sets hold."""
    used = np.unique(np.concatenate((i, j)))
    place = np.zeros(len(shingles), np.int64)
    place[used] = np.arange(len(used))
    values = np.concatenate([shingles[k] for k in used])
    owner = np.repeat(np.arange(len(used)), [len(shingles[k]) for k in used])
    _, where, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[where]
    out = np.zeros(len(i), np.int64)
    column, owner = number[where[keep]], owner[keep]
    width = 1 << 15
    for at in range(0, int(shared.sum()), width):
        some = (column >= at) & (column < at + width)
        bits = np.zeros((len(used), min(width, int(shared.sum()) - at)), bool)
        bits[owner[some], column[some] - at] = True
        packed = np.packbits(bits, axis=1)
        packed = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)
        step = max(1, (8 << 20) // (8 * packed.shape[1]))
        for k in range(0, len(i), step):
            out[k : k + step] += np.bitwise_count(packed[place[i[k : k + step]]] & packed[place[j[k : k + step]]]).sum(axis=1, dtype=np.int64)
    return out


_FOUND = "rep long, links long, root long, band int, pairs long"


def _verify(threshold: float, trees: int, depth: int, done: int | None, agreement: int):
    """Of a block pair: links and least reachable text of each text (rep, links, root), and numbers of linked pairs by similarity (band, pairs)."""

    def run(table: pa.Table) -> pa.Table:
        reps, copies, block = (table[c].to_numpy() for c in ("rep", "copies", "block"))
        n = len(reps)
        i, j = _candidates(_marks(table, trees), block, depth, done, agreement)
        likeness = np.zeros(0)
        if len(i):
            shingles = [np.frombuffer(b, np.uint64) for b in table["shingles"].to_pylist()]
            common = _common(shingles, i, j)
            sizes = np.asarray([len(s) for s in shingles])
            likeness = common / (sizes[i] + sizes[j] - common)
            near = likeness >= threshold
            i, j, likeness = i[near], j[near], likeness[near]
        links = np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)
        root = reps.copy()
        while len(i):
            least = np.minimum(root[i], root[j])
            if (least == root[i]).all() and (least == root[j]).all():
                break
            np.minimum.at(root, i, least)
            np.minimum.at(root, j, least)
        hit = links > 0
        # Equal sets of shingles in different texts count in the last band.
        band, pairs = np.unique(np.minimum(likeness * BANDS, BANDS - 1).astype(np.int64), return_counts=True)
        none = [None] * len(band)
        return pa.table(
            {
                "rep": pa.array([*reps[hit].tolist(), *none], pa.int64()),
                "links": pa.array([*links[hit].astype(np.int64).tolist(), *none], pa.int64()),
                "root": pa.array([*root[hit].tolist(), *none], pa.int64()),
                "band": pa.array([None] * int(hit.sum()) + band.tolist(), pa.int32()),
                "pairs": pa.array([None] * int(hit.sum()) + pairs.tolist(), pa.int64()),
            }
        )

    return run


def connected(edges: DataFrame, steps: Steps) -> DataFrame:
    """(node, class_id): the least node of each component of edges (a, b), a >= b; nodes without edges are left out."""
    both = steps.table(edges.filter("a <> b").select("a", "b").distinct())
    both = both.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(both.select(F.col("b").alias("node"), F.col("a").alias("other")))
    state = steps.table(both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")))
    while True:
        heard = both.join(state.select(F.col("node").alias("other"), F.col("label").alias("l")), "other").groupBy("node").agg(F.min("l").alias("l"))
        jump = state.select(F.col("node").alias("label"), F.col("label").alias("up"))
        step = state.join(jump, "label", "left").join(heard, "node", "left")
        new = steps.table(step.select("node", F.least("label", "up", "l").alias("label"), (F.least("label", "up", "l") < F.col("label")).alias("moved")))
        state = new.select("node", "label")
        if new.filter("moved").isEmpty():
            return state.withColumnRenamed("label", "class_id")


def _placed(member: DataFrame, steps: Steps) -> DataFrame:
    """(rep, block, pair): the block of each text of member (rep, tree, node), and the pairs of blocks in which it shares a node; a table.

    Texts that meet are put into the same block where they can be; what is too large for one is cut by hash.
    """
    near = steps.table(member.groupBy("rep").agg(F.min("node").alias("label")))
    blocks = max(1, -(-near.count() // BLOCK))
    big = near.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).alias("parts")).filter("parts > 1")
    part = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("rep"), F.col("parts"))).otherwise(0)
    near = near.join(big, "label", "left").select("rep", F.pmod(F.xxhash64("label", part), F.lit(blocks)).cast("int").alias("block"))
    near = steps.table(near)
    held = steps.table(member.join(near, "rep").select("rep", "tree", "node", "block"))
    spread = held.groupBy("tree", "node").agg(F.collect_set("block").alias("others")).filter(F.size("others") > 1)
    # Salted: a node may hold a third of all texts.
    spread = spread.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = held.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")).join(spread, ["tree", "node", "salt"]).groupBy("rep", "block").agg(F.array_distinct(F.flatten(F.collect_set("others"))).alias("others"))
    met = met.select("rep", "block", F.explode(F.array_remove("others", F.col("block"))).alias("other"))
    both = near.withColumn("other", F.col("block")).unionByName(met)
    return steps.table(both.select("rep", "block", (F.least("block", "other").cast("long") * (1 << 31) + F.greatest("block", "other")).alias("pair")))


def linked_texts(trie: DataFrame, texts: DataFrame, rows: DataFrame, repeats: bool, steps: Steps, threshold: float, trees: int, deepest: int, least: int, depth: int, done: int | None, shingle: int) -> DataFrame:
    """_FOUND rows of the pairs of texts that share `depth` minima in some tree, and `done` in none; a table."""
    spark = steps.spark
    member = trie.filter(F.col("depth") >= depth).select("rep", "tree", F.get("nodes", F.lit(depth - least)).alias("node"))
    placed = _placed(member, steps)
    agreement = least_agreement(threshold, trees * deepest)
    screened = placed.join(texts.select("rep", "marks"), "rep").groupBy("pair").applyInArrow(_screen(trees, depth, done, agreement), "rep long, block int, pair long")
    screened = steps.table(screened).groupBy("rep").agg(F.first("block").alias("block"), F.collect_list("pair").alias("pairs"))
    release_shuffles(spark)
    chosen = steps.table(texts.join(screened, "rep").select("rep", "first", "copies", "block", "marks", "pairs"))
    release_shuffles(spark)
    source = chosen.join(rows.select(F.struct("doc_id", "th").alias("first"), "text"), "first").select("rep", "copies", "block", "text", "marks", "pairs")
    if repeats:
        source = source.dropDuplicates(["rep"])
    sets = source.mapInArrow(_shingle_sets(shingle), "rep long, copies long, block int, marks binary, pairs array<long>, shingles binary")
    found = sets.withColumn("pair", F.explode("pairs")).drop("pairs").groupBy("pair").applyInArrow(_verify(threshold, trees, depth, done, agreement), _FOUND)
    found = steps.table(found)
    release_shuffles(spark)
    return found


def linked_documents(docs: DataFrame, threshold: float, recall: float = RECALL, trees: int = TREES, deepest: int = DEEPEST, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, th, class_id, n_links, first), one row per row of docs; first: the (doc_id, th) that stands for the class. A table."""
    spark = docs.sparkSession
    steps = Steps(spark)
    rows = keyed(docs)
    described = steps.table(rows.mapInArrow(_describe(trees * deepest, shingle), "doc_id long, th long, text_key binary, marks binary"))
    repeats = _repeats(described)
    texts = described.filter("text_key is not null").groupBy("text_key").agg(F.min(F.struct("doc_id", "th")).alias("first"), F.count("*").alias("copies"), F.first("marks").alias("marks"))
    texts = steps.table(texts.withColumn("rep", F.xxhash64("text_key")))
    least = shallowest(threshold, recall, trees, deepest)
    trie = steps.table(forest(texts, trees, deepest, least))
    release_shuffles(spark)
    depth, done, found, pairs = deepest, None, None, {}
    while depth is not None:
        new = linked_texts(trie, texts, rows, repeats, steps, threshold, trees, deepest, least, depth, done, shingle)
        found = new if found is None else found.unionByName(new)
        for r in new.filter("band is not null").groupBy("band").agg(F.sum("pairs").alias("n")).collect():  # a row for each band
            pairs[r["band"]] = pairs.get(r["band"], 0) + r["n"]
        depth, done = shortened(depth, pairs, threshold, recall, trees, least), depth
    found = found.filter("rep is not null")
    classes = connected(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), steps)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = texts.select("text_key", "rep", "copies", "first").join(links, "rep", "left").join(classes.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("text_key", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("class_id", "rep").alias("class"), "first")
    leasts = known.groupBy("class").agg(F.min("first").alias("least"))
    known = known.drop("first").join(leasts, "class")
    out = described.select("doc_id", "th", "text_key").join(known, "text_key", "left")
    out = out.withColumn("first", F.coalesce("least", F.struct("doc_id", "th")))
    return steps.result(out.select("doc_id", "th", F.col("first.doc_id").alias("class_id"), F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"), "first"))


def _repeats(described: DataFrame) -> bool:
    return not described.groupBy("doc_id").count().filter("count > 1").isEmpty()


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, deepest: int = DEEPEST) -> DataFrame:
    """(doc_id, class_id, n_links), one row per row of docs."""
    null_id = lambda c: F.when(F.col(c) != LOWEST, F.col(c)).alias(c)
    return linked_documents(docs, threshold, recall, trees, deepest).select(null_id("doc_id"), null_id("class_id"), "n_links")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, that of the least doc_id (and one of its rows, where they repeat), with all its columns."""
    found = linked_documents(docs, threshold)
    keep = found.filter(F.col("first") == F.struct("doc_id", "th")).select(F.col("first").alias("kept")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("doc_id"), F.xxhash64(text_or_empty()).alias("th")).alias("key"))
    rows = rows.join(keep, F.col("key") == F.col("kept"), "left_semi")
    if _repeats(found):
        rows = rows.dropDuplicates(["key"])
    return rows.select("row.*")
