"""Interpolated modified Kneser-Ney language model of order 2 or 3: counted in Spark, stored as sorted
hash arrays in the shared folder, memory-mapped by workers for scoring.

Tokens are words, lower-cased in A-Z, and one end token for each text; the context of a text's
first token is its start. Three passes over the texts: words are counted; pairs of words are
counted, by buckets of the context's hash (contexts with a large share of all tokens are spread
by the pair's hash, and their statistics added up afterwards); texts are scored. Counts of counts
give the discounts. All counts cover all training texts; nothing is pruned. Every word whose count
is 1 has one follower and one predecessor, so it needs no entry beyond its count.

At order 3 triples of words take the place of pairs, dealt by the word in the middle, so that a bucket
sees all predecessors of a pair and all followers of a context of two words. They are counted in
passes over shares of the buckets, as the shuffle of one pass is gone before the next. A pair's count
is then that of its different predecessors; pairs at a text's start have none and keep their own
count, and a text's first token is judged by its pair alone.

Null texts count as empty: the end token alone. A null doc_id hashes as empty text. Rows that
repeat a doc_id are scored and counted one by one. With an empty training set every token is
unknown and the model is uniform over one token. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.llm.exchange import WIRE, Prefix, by_bucket, squeeze, unsqueeze, wire
from wardlight.llm.kernels import U64, Words, mix
from wardlight.llm.shards import Table, counts_column, write_shard
from wardlight.llm.shared import chunks, delete_table, materialize, n_buckets_bits, release_shuffles, shared_folder, text_or_empty, write_table

#: Text that a map task combines before counts are sent.
COMBINE = 8 << 20
#: Bytes of training text for which there is a shard.
SHARD_TEXT = 8 << 20
#: Bytes of text that are scored at once: a token takes some 200 bytes of arrays.
SCORED = 4 << 20
#: Leading bits of the hash that stand for a word.
WORD_BITS = 56
END, START = U64(0xA24BAED4963EE407), U64(0x9FB21C651E98DF25)
WORDS, STATS, HEAVY, FOLLOWED, WIDE = 10, 11, 12, 13, 14
#: Passes in which the triples are counted.
PASSES = 8
#: At order 3 a context is spread over the buckets with one part in SHARE of a bucket's tokens.
SHARE = 2


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % folds == fold, F.lit(False))


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(contexts, tokens, first): hashes of each token and of the one before it; first token of each text."""
    words = Words(texts, lower=True)
    first = words.first[:-1] + np.arange(len(texts))
    n = len(words.hashes) + len(texts)
    tokens, contexts = np.empty(n, U64), np.empty(n, U64)
    ends = np.append(first[1:], n) - 1
    tokens[ends] = END
    inner = np.ones(n, bool)
    inner[ends] = False
    tokens[inner] = words.hashes
    contexts[1:] = tokens[:-1]
    contexts[first] = START
    return contexts, tokens, first


def _pair(contexts: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return mix(contexts * U64(0xC2B2AE3D27D4EB4F) + tokens)


def _counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys))) if counts is None else np.add.reduceat(counts[order], first) if len(first) else np.zeros(0, np.int64)


def _send_counts(prefix: Prefix, kind: int, keys: np.ndarray, counts: np.ndarray) -> list[tuple]:
    short = prefix.key(keys)
    return [(b, kind, 0, prefix.pack(short[part]), squeeze(counts[part])) for b, part in by_bucket(prefix.bucket(short))]


def _received_counts(prefix: Prefix, bucket: int, rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Merged (64-bit key, count) of a bucket's rows; the bits that did not travel are 0."""
    if not rows:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    keys, counts = _counted(np.concatenate([prefix.unpack(r["a"]) for r in rows]), np.concatenate([unsqueeze(r["b"]) for r in rows]))
    return (keys | (U64(bucket) << U64(prefix.low))) << U64(64 - prefix.bits - prefix.low), counts


def _clear(prefix: Prefix, hashes: np.ndarray) -> np.ndarray:
    """Hashes without the bits that do not travel."""
    drop = U64(64 - prefix.bits - prefix.low)
    return (hashes >> drop) << drop


def _word_counts(bits: int):
    prefix = Prefix(bits, WORD_BITS)

    def run(batches):
        for rows in chunks(batches, COMBINE):
            _, tokens, _ = _tokens([r[0] for r in rows])
            yield wire(_send_counts(prefix, WORDS, *_counted(tokens)))

    return run


def _word_shard(bits: int, folder: str, largest: int):
    prefix = Prefix(bits, WORD_BITS)

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys, counts = _received_counts(prefix, rows[0]["bucket"], rows)
        write_shard(f"{folder}/words-{rows[0]['bucket']}", {"keys": keys, **counts_column("count", counts)})
        large = np.argsort(-counts, kind="stable")[:largest]
        return pa.Table.from_batches(
            [wire([(0, STATS, 0, np.asarray([counts.sum(), len(counts)], "<i8").tobytes(), keys[large].tobytes(), counts[large].astype("<i8").tobytes())])]
        )

    return run


def _pair_counts(bits: int, folder: str, heavy: np.ndarray):
    prefix = Prefix(bits, WORD_BITS)

    def run(batches):
        table = Table(folder, "words", bits)
        for rows in chunks(batches, COMBINE):
            contexts, tokens, _ = _tokens([r[0] for r in rows])
            contexts, tokens = _clear(prefix, contexts), _clear(prefix, tokens)
            order = np.lexsort((tokens, contexts))
            contexts, tokens = contexts[order], tokens[order]
            first = np.flatnonzero(np.concatenate(([True], (contexts[1:] != contexts[:-1]) | (tokens[1:] != tokens[:-1]))))
            counts = np.diff(np.append(first, len(contexts)))
            contexts, tokens = contexts[first], tokens[first]
            distinct, where = np.unique(tokens, return_inverse=True)
            once = table.get(distinct, "count")[0][where] == 1  # such a token has one predecessor: no need to count it
            spread = np.isin(contexts, heavy)
            bucket = prefix.bucket(prefix.key(np.where(spread, _pair(contexts, tokens), contexts)))
            out = []
            for b, part in by_bucket(bucket):
                part = part[np.argsort(once[part], kind="stable")]  # the tokens to count first, contexts in order in both halves
                c = contexts[part]
                begin = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
                head = np.asarray([np.count_nonzero(~once[part])], "<i8").tobytes() + c[begin].tobytes()
                out.append((b, 0, 0, head, squeeze(np.diff(np.append(begin, len(c)))), prefix_bytes(tokens[part], prefix), squeeze(counts[part])))
            yield wire(out)

    return run


def prefix_bytes(hashes: np.ndarray, prefix: Prefix) -> bytes:
    """The leading bytes of the hashes."""
    n = -(-(prefix.bits + prefix.low) // 8)
    return np.ascontiguousarray(hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :n]).tobytes()


def from_prefix_bytes(blob: bytes, prefix: Prefix) -> np.ndarray:
    n = -(-(prefix.bits + prefix.low) // 8)
    out = np.zeros((len(blob) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(blob, np.uint8).reshape(-1, n)
    return out.view(">u8").ravel().astype(U64)


def _pair_shard(bits: int, folder: str, heavy: np.ndarray):
    prefix = Prefix(bits, WORD_BITS)

    def run(table: pa.Table) -> pa.Table:
        contexts, tokens, counts, several = [], [], [], []
        bucket = table["bucket"][0].as_py()
        for r in table.to_pylist():
            own = np.frombuffer(r["a"], U64, offset=8)
            contexts.append(np.repeat(own, unsqueeze(r["b"])))
            tokens.append(from_prefix_bytes(r["c"], prefix))
            counts.append(unsqueeze(r["d"]))
            flag = np.zeros(len(counts[-1]), bool)
            flag[: int.from_bytes(r["a"][:8], "little")] = True
            several.append(flag)
        contexts, tokens, counts, several = map(np.concatenate, (contexts, tokens, counts, several))
        keys = _pair(contexts, tokens)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        counts = np.add.reduceat(counts[order], first)
        pick = order[first]
        contexts, tokens, several, keys = contexts[pick], tokens[pick], several[pick], keys[first]
        write_shard(f"{folder}/pairs-{bucket}", {"keys": keys, **counts_column("count", counts)})
        # Followers of each context by count 1, 2, 3 and more.
        own, where = np.unique(contexts, return_inverse=True)
        n = [np.bincount(where[counts == 1], minlength=len(own)), np.bincount(where[counts == 2], minlength=len(own)), np.bincount(where[counts >= 3], minlength=len(own))]
        big = np.isin(own, heavy)
        more = ~big & ((n[0] != 1) | (n[1] + n[2] > 0))
        write_shard(f"{folder}/contexts-{bucket}", {"keys": own[more], **counts_column("n1", n[0][more]), **counts_column("n2", n[1][more]), **counts_column("n3", n[2][more])})
        out = _send_counts(prefix, FOLLOWED, *_counted(tokens[several]))
        of_counts = np.bincount(np.minimum(counts, 5), minlength=6)[1:5].astype("<i8")
        out.append((bucket, STATS, 0, of_counts.tobytes(), np.asarray([len(counts), np.count_nonzero(~several)], "<i8").tobytes()))
        out.append((bucket, HEAVY, 0, own[big].tobytes(), np.stack([x[big] for x in n]).astype("<i8").tobytes()))
        return pa.Table.from_batches([wire(out)])

    return run


def _joined(*blobs: bytes) -> bytes:
    return b"".join(len(b).to_bytes(8, "little") + b for b in blobs)


def _split(blob: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(blob):
        n = int.from_bytes(blob[at : at + 8], "little")
        out.append(blob[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def _before(contexts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The word before each context; START where the context is a text's start."""
    out = np.empty_like(contexts)
    out[1:] = contexts[:-1]
    out[first] = contexts[first]
    return out


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where rows of sorted columns differ from the row before."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _sorted_triples(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """(u, v, w, count) of the distinct triples of numbers below n, by v, w and u."""
    size = n.bit_length()
    if 3 * size <= 64:
        key = np.sort((v.astype(U64) << U64(2 * size)) | (w.astype(U64) << U64(size)) | u.astype(U64))
        begin = _changes(key)
        rest, mask = key[begin], U64((1 << size) - 1)
        u, v, w = rest & mask, rest >> U64(2 * size), (rest >> U64(size)) & mask
        u, v, w = (x.astype(np.int64) for x in (u, v, w))
    else:
        order = np.lexsort((u, w, v))
        u, v, w = u[order], v[order], w[order]
        begin = _changes(v, w, u)
        u, v, w = u[begin], v[begin], w[begin]
    return u, v, w, np.diff(np.append(begin, len(order if 3 * size > 64 else key)))


def _triple_counts(bits: int, folder: str, heavy: np.ndarray, turns: int):
    """Combined triples; a row's kind is the turn in which its bucket is counted."""
    prefix = Prefix(bits, WORD_BITS)
    start = _clear(prefix, np.array([START]))

    def run(batches):
        table = Table(folder, "words", bits)
        for rows in chunks(batches, COMBINE):
            _, w, first = _tokens([r[0] for r in rows])
            distinct, w = np.unique(np.concatenate((start, _clear(prefix, w))), return_inverse=True)
            at_start, w = w[0], w[1:]
            v = np.append(at_start, w[:-1])
            v[first] = at_start
            u, v, w, counts = _sorted_triples(_before(v, first), v, w, len(distinct))
            once = table.get(distinct, "count")[0] == 1  # such a token has one predecessor: no need to count it
            pair = _changes(v, w)
            of_pair = distinct[v[pair]]
            bucket = prefix.bucket(prefix.key(np.where(np.isin(distinct, heavy)[v[pair]], _pair(of_pair, distinct[w[pair]]), of_pair)))
            bucket = np.repeat(bucket, np.diff(np.append(pair, len(v))))
            for turn in range(turns):
                own, out = np.flatnonzero(bucket % turns == turn), []
                for b, part in by_bucket(bucket[own]):
                    part = own[part]
                    pv, pw = v[part], w[part]
                    pair = _changes(pv, pw)
                    context = _changes(pv[pair])
                    out.append(
                        (
                            b,
                            turn,
                            0,
                            _joined(prefix_bytes(distinct[pv[pair[context]]], prefix), squeeze(np.diff(np.append(context, len(pair))))),
                            _joined(prefix_bytes(distinct[pw[pair]], prefix), squeeze(np.diff(np.append(pair, len(part)))), np.packbits(once[pw[pair]]).tobytes()),
                            prefix_bytes(distinct[u[part]], prefix),
                            squeeze(counts[part]),
                        )
                    )
                yield wire(out)

    return run


def _by_count(where: np.ndarray, counts: np.ndarray, n: int) -> list[np.ndarray]:
    """Sum of counts, and how many are 1, 2, 3 and more, of each of n groups."""
    total = np.zeros(n, np.int64)
    np.add.at(total, where, counts)
    return [total, *(np.bincount(where[x], minlength=n) for x in (counts == 1, counts == 2, counts >= 3))]


def _contexts_columns(keys: np.ndarray, stats: list[np.ndarray]) -> dict[str, np.ndarray]:
    """Statistics of contexts in order of their keys, but of those with one follower that counts 1."""
    more = np.flatnonzero(stats[0] > 1)
    more = more[np.argsort(keys[more], kind="stable")]
    out = {"keys": keys[more]}
    for name, x in zip(("total", "n1", "n2", "n3"), stats):
        out |= counts_column(name, x[more])
    return out


def _triple_shard(bits: int, folder: str, heavy: np.ndarray):
    prefix = Prefix(bits, WORD_BITS)
    start = _clear(prefix, np.array([START]))[0]
    wide = Prefix(bits)

    def run(table: pa.Table) -> pa.Table:
        bucket, parts = table["bucket"][0].as_py(), []
        for r in table.to_pylist():
            (v, pairs), (w, triples, once) = _split(r["a"]), _split(r["b"])
            w, triples = from_prefix_bytes(w, prefix), unsqueeze(triples)
            several = np.unpackbits(np.frombuffer(once, np.uint8), count=len(w)) == 0
            v = np.repeat(from_prefix_bytes(v, prefix), unsqueeze(pairs))
            parts.append((*(np.repeat(x, triples) for x in (v, w, several)), from_prefix_bytes(r["c"], prefix), unsqueeze(r["d"])))
        v, w, several, u, counts = map(np.concatenate, zip(*parts))
        del parts
        order = np.lexsort((u, w, v))
        v, w, u, several, counts = v[order], w[order], u[order], several[order], counts[order]
        begin = _changes(v, w, u)
        counts = np.add.reduceat(counts, begin)
        v, w, u, several = v[begin], w[begin], u[begin], several[begin]
        # Pairs count by their different predecessors, those at a start as they are.
        pair = _changes(v, w)
        adjusted = np.diff(np.append(pair, len(v)))
        pv, pw, several = v[pair], w[pair], several[pair]
        adjusted = np.where(pv == start, np.add.reduceat(counts, pair), adjusted)
        keys = _pair(pv, pw)
        order = np.argsort(keys)
        write_shard(f"{folder}/pairs-{bucket}", {"keys": keys[order], **counts_column("count", adjusted[order])})
        own, where = np.unique(pv, return_inverse=True)
        n = _by_count(where, adjusted, len(own))
        big = np.isin(own, heavy)
        write_shard(f"{folder}/contexts-{bucket}", _contexts_columns(own[~big], [x[~big] for x in n]))
        # Triples and their contexts; a text's first token has none.
        inner = v != start
        v, w, u, counts = v[inner], w[inner], u[inner], counts[inner]
        two = _pair(u, v)
        keys = _pair(two, w)
        order = np.argsort(keys)
        write_shard(f"{folder}/triples-{bucket}", {"keys": keys[order], **counts_column("count", counts[order])})
        spread = np.isin(v, heavy)
        for_all, where = np.unique(two[~spread], return_inverse=True)
        write_shard(f"{folder}/before-{bucket}", _contexts_columns(for_all, _by_count(where, counts[~spread], len(for_all))))
        out = _send_counts(prefix, FOLLOWED, *_counted(pw[several]))
        shared, where = np.unique(two[spread], return_inverse=True)
        of_shared = _by_count(where, counts[spread], len(shared))
        for b, part in by_bucket(wide.bucket(wide.key(shared))):
            out.append((b, WIDE, 0, shared[part].tobytes(), _joined(*(squeeze(x[part]) for x in of_shared))))
        four = lambda c: np.bincount(np.minimum(c, 5), minlength=6)[1:5]
        out.append((bucket, STATS, 0, np.concatenate((four(adjusted), four(counts))).astype("<i8").tobytes(), np.asarray([len(adjusted), np.count_nonzero(~several), adjusted.sum()], "<i8").tobytes()))
        out.append((bucket, HEAVY, 0, own[big].tobytes(), np.stack([x[big] for x in n]).astype("<i8").tobytes()))
        return pa.Table.from_batches([wire(out)])

    return run


def _wide_shard(bits: int, folder: str):
    """The shard of words' predecessors, and that of contexts of two words whose second is spread over buckets."""
    followed = _followed_shard(bits, folder)

    def run(table: pa.Table) -> pa.Table:
        is_wide = table["kind"].to_numpy() == WIDE
        rows = table.filter(pa.array(is_wide)).to_pylist()
        if rows:
            # an empty row keeps the bucket's number where nothing else is left
            nothing = wire([(table["bucket"][0].as_py(), FOLLOWED, 0, b"", squeeze(np.zeros(0, np.int64)))])
            rest = pa.concat_tables([table.filter(pa.array(~is_wide)), pa.Table.from_batches([nothing]).cast(table.schema)])
            keys = np.concatenate([np.frombuffer(r["a"], U64) for r in rows])
            stats = [np.concatenate([unsqueeze(x) for x in column]) for column in zip(*(_split(r["b"]) for r in rows))]
            own, where = np.unique(keys, return_inverse=True)
            sums = [np.zeros(len(own), np.int64) for _ in stats]
            for total, x in zip(sums, stats):
                np.add.at(total, where, x)
            write_shard(f"{folder}/wide-{table['bucket'][0].as_py()}", _contexts_columns(own, sums))
        return followed(rest if rows else table)

    return run


def _followed_shard(bits: int, folder: str):
    prefix = Prefix(bits, WORD_BITS)

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        bucket = rows[0]["bucket"]
        keys, counts = _received_counts(prefix, bucket, [r for r in rows if r["kind"] == FOLLOWED])
        write_shard(f"{folder}/followed-{bucket}", {"keys": keys, **counts_column("count", counts)})
        of_counts = np.bincount(np.minimum(counts, 5), minlength=6)[1:5].astype("<i8")
        out = [(0, FOLLOWED, 0, of_counts.tobytes(), np.asarray([len(counts)], "<i8").tobytes())]
        out += [(0, r["kind"], 0, r["a"], r["b"]) for r in rows if r["kind"] != FOLLOWED]
        return pa.Table.from_batches([wire(out)])

    return run


def discounts(n: np.ndarray) -> np.ndarray:
    """D1, D2, D3+ from the numbers of types seen 1, 2, 3 and 4 times; 0.5, 1, 1.5 where these are too few to tell."""
    default = np.array([0.5, 1.0, 1.5])
    if (n[:4] <= 0).any():
        return default
    y = n[0] / (n[0] + 2 * n[1])
    d = np.array([k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)])
    return np.where((d > 0) & (d <= [1, 2, 3]), d, default)


@dataclass
class Model:
    """The statistics that fit anywhere, and the folder of the arrays."""

    folder: str
    bits: int
    tokens: int
    types: int
    starts: int
    #: Distinct pairs; words by 1, 2, 3 and more predecessors.
    pairs: int
    followed: np.ndarray
    #: Discounts of pair counts and of predecessor counts.
    d: np.ndarray
    f: np.ndarray
    heavy: np.ndarray
    heavy_counts: np.ndarray
    order: int = 2
    #: Discounts of triple counts.
    t: np.ndarray | None = None


def train(docs: DataFrame, order: int = 2) -> Model:
    """A model of all rows of docs (a column text), of order 2 or 3."""
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    spark = docs.sparkSession
    texts = docs.select(text_or_empty().alias("text"))
    bits, folder = n_buckets_bits(texts, SHARD_TEXT), shared_folder(spark)
    counted = texts.mapInArrow(_word_counts(bits), WIRE).groupBy("bucket").applyInArrow(_word_shard(bits, folder, 64), WIRE)
    rows = materialize(counted.select("a", "b", "c")).collect()  # a row for each bucket
    tokens, types = (sum(int(np.frombuffer(r["a"], "<i8")[i]) for r in rows) for i in (0, 1))
    keys = np.concatenate([np.frombuffer(r["b"], U64) for r in rows] or [np.zeros(0, U64)])
    counts = np.concatenate([np.frombuffer(r["c"], "<i8") for r in rows] or [np.zeros(0, np.int64)])
    # At most 16 (order 3: SHARE) contexts for each bucket can have that share of all tokens.
    share = (16 if order == 2 else SHARE) << bits
    heavy = np.sort(np.append(keys[counts > tokens / share], _clear(Prefix(bits, WORD_BITS), np.array([START]))))
    release_shuffles(spark)
    if order == 2:
        paired = texts.mapInArrow(_pair_counts(bits, folder, heavy), WIRE).groupBy("bucket").applyInArrow(_pair_shard(bits, folder, heavy), WIRE)
        rows = materialize(paired.groupBy("bucket").applyInArrow(_followed_shard(bits, folder), WIRE).select("kind", "a", "b"))
    else:
        parts, sent = [], shared_folder(spark)
        write_table(texts.mapInArrow(_triple_counts(bits, folder, heavy, PASSES), WIRE), sent, "kind")
        for turn in range(PASSES):
            own = spark.read.schema(WIRE).parquet(sent).filter(F.col("kind") == turn)
            parts.append(materialize(own.groupBy("bucket").applyInArrow(_triple_shard(bits, folder, heavy), WIRE)))
            delete_table(spark, f"{sent}/kind={turn}")
        delete_table(spark, sent)
        rows = materialize(reduce(DataFrame.union, parts).groupBy("bucket").applyInArrow(_wide_shard(bits, folder), WIRE).select("kind", "a", "b"))
    stats = [(np.frombuffer(r["a"], "<i8"), np.frombuffer(r["b"], "<i8")) for r in rows.filter(F.col("kind") == STATS).collect()]
    followed = [(np.frombuffer(r["a"], "<i8"), np.frombuffer(r["b"], "<i8")) for r in rows.filter(F.col("kind") == FOLLOWED).collect()]
    n_stats = 3 if order == 2 else 4
    heavy_counts = np.zeros((n_stats, len(heavy)), np.int64)
    for r in rows.filter(F.col("kind") == HEAVY).toLocalIterator():
        own = np.frombuffer(r["a"], U64)
        heavy_counts[:, np.searchsorted(heavy, own)] += np.frombuffer(r["b"], "<i8").reshape(n_stats, -1)
    release_shuffles(spark)
    zero = np.zeros(4, np.int64)
    of_followed = sum((a for a, _ in followed), zero)
    once = sum(int(b[1]) for _, b in stats)
    of_followed = of_followed + np.array([once, 0, 0, 0])
    types_followed = sum(int(b[0]) for _, b in followed) + once
    by_predecessors = np.append(of_followed[:2], types_followed - of_followed[:2].sum())
    of_pairs, pairs = sum((a[:4] for a, _ in stats), zero), sum(int(b[0]) for _, b in stats)
    of_triples = sum((a[4:] for a, _ in stats), zero) if order == 3 else zero
    return Model(folder, bits, tokens, types, texts.count(), pairs, by_predecessors, discounts(of_pairs), discounts(of_followed), heavy, heavy_counts, order, discounts(of_triples))


def _cut(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.maximum(counts - np.concatenate(([0.0], d))[np.minimum(counts, 3)], 0)


def _found(table: Table, home: np.ndarray, keys: np.ndarray, *values: str) -> list[np.ndarray]:
    """The named values of keys, each in the shard of its home; 0 where a key is missing."""
    out = [np.zeros(len(keys), np.int64) for _ in values]
    for b, part in by_bucket(home):
        shard = table.shard(b)
        if shard and len(shard["keys"]):
            part = part[np.argsort(keys[part])]
            own = keys[part]
            at = np.minimum(np.searchsorted(shard["keys"], own), len(shard["keys"]) - 1)
            hit = shard["keys"][at] == own
            for o, v in zip(out, values):
                c = np.where(hit, shard[v][at], 0).astype(np.int64)
                full = c == 255
                c[full] = shard[f"{v}+"][np.searchsorted(shard[f"{v}@"], at[full])]
                o[part] = c
    return out


def _scorer(model: Model):
    prefix = Prefix(model.bits, WORD_BITS)
    wide_prefix = Prefix(model.bits)
    start_key = _clear(prefix, np.array([START]))[0]

    def run(batches):
        words, pairs, contexts_table, followed = (Table(model.folder, n, model.bits) for n in ("words", "pairs", "contexts", "followed"))
        # The base distribution of continuations gets what their discounts free.
        base = (model.f * model.followed).sum() / max(1, model.pairs) / (model.types + 1) if model.pairs else 1.0 / (model.types + 1)
        triples, narrow, wide = (Table(model.folder, n, model.bits) for n in ("triples", "before", "wide"))
        for rows in chunks(batches, SCORED if model.order == 2 else SCORED // 2):
            contexts, tokens, first = _tokens([r[2] for r in rows])
            contexts, tokens = _clear(prefix, contexts), _clear(prefix, tokens)
            distinct, where = np.unique(np.concatenate(([start_key], tokens)), return_inverse=True)
            at_start, w = where[0], where[1:]
            u = np.append(at_start, w[:-1])
            u[first] = at_start
            seen = words.get(distinct, "count")[0]
            n1, n2, n3 = contexts_table.get(distinct, "n1", "n2", "n3")
            after = followed.get(distinct, "count")[0]
            once = seen == 1
            n1[once], after[once] = 1, 1
            # A context whose single follower was seen once has no entry either.
            absent = (n1 + n2 + n3 == 0) & (seen > 0)
            n1[absent] = 1
            place = np.minimum(np.searchsorted(model.heavy, distinct), len(model.heavy) - 1)
            big = model.heavy[place] == distinct
            n1[big], n2[big], n3[big] = model.heavy_counts[-3:, place[big]]
            if model.order == 2:
                total = seen.copy()
            else:
                total = contexts_table.get(distinct, "total")[0]
                total[(n1 + n2 + n3 == 1) & (n1 == 1) & ~big] = 1
                total[big] = model.heavy_counts[0, place[big]]
            total[distinct == start_key] = model.starts
            keys = _pair(contexts, tokens)
            spread = big[u]
            home = prefix.bucket(prefix.key(np.where(spread, keys, contexts)))
            count = _found(pairs, home, keys, "count")[0]
            lower = _cut(after, model.f) / max(1, model.pairs) + base
            free = np.divide(model.d[0] * n1 + model.d[1] * n2 + model.d[2] * n3, total, out=np.ones(len(total)), where=total > 0)
            p = np.divide(_cut(count, model.d), total[u], out=np.zeros(len(count)), where=total[u] > 0) + free[u] * lower[w]
            if model.order == 3:
                two = _pair(_before(contexts, first), contexts)
                t = _found(triples, home, _pair(two, tokens), "count")[0]
                at_home = prefix.bucket(prefix.key(contexts))
                stats = [np.where(spread, a, b) for a, b in zip(*(_found(x, h, two, "total", "n1", "n2", "n3") for x, h in ((wide, wide_prefix.bucket(wide_prefix.key(two))), (narrow, at_home))))]
                known = np.append(0, count[:-1]) > 0  # the context of two words was the pair before
                once = known & (stats[0] == 0)  # without an entry: met once
                total, n1, n2, n3 = stats
                total[once], n1[once] = 1, 1
                total[first] = 0  # a text's first token has no context of two words
                upper = np.divide(_cut(t, model.t), total, out=np.zeros(len(t)), where=total > 0)
                p = upper + p * np.divide(model.t[0] * n1 + model.t[1] * n2 + model.t[2] * n3, total, out=np.ones(len(t)), where=total > 0)
            c = seen[w]
            plain = np.log10((c + 1) / (model.tokens + 1 * (model.types + 1)))
            add = lambda x: np.add.reduceat(x, first)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.bool_()),
                    pa.array(add(np.ones(len(tokens), np.int64))),
                    pa.array(add((c > 0).astype(np.int64))),
                    pa.array(np.full(len(rows), model.tokens)),
                    pa.array(add(plain)),
                    pa.array(add(np.log10(p))),
                ],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, held_out, numbers of tokens and known tokens, and log10 probabilities by the unigram base and the model."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), text_or_empty().alias("text"))
    scored = rows.mapInArrow(_scorer(model), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def train_and_score(docs: DataFrame, order: int = 2) -> DataFrame:
    training = docs.filter(~held_out(F.col("doc_id")))
    model = train(training, order)
    return score(docs, model)
