"""Line dedup: lines within a small edit distance of an earlier line are removed (segment-partition edit join).

A line is what stands between line ends, without white space at both ends. Lines under `least` code
points are compared for equality alone, those under `shortest` not at all. Earlier means in a document of smaller
doc_id, or above in the same document; lines are judged on the input.

A line within distance t of another of length l contains one of the latter's t+1 segments, near its
place. Every distinct line of a chunk sends the hashes of its own segments and of the substrings
that can match segments of lines up to t shorter (multi-match-aware selection). Buckets of hashes
find lines that share one and ask for their texts, one for each distinct line; these are compared
by banded bit-parallel edit distance, from the earliest line on. Equal lines meet by their hash.

Null texts count as empty; a null doc_id is the lowest and comes back as null. Rows that repeat a
doc_id count as equally early: neither loses lines to the other. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlight.llm.exchange import ANSWER, CHUNK_DOCS, ENTRIES, INTERVALS, WIRE, Prefix, apply_to_documents, by_bucket, chunk_documents, chunk_number, pack_documents, squeeze, unpack_documents, unsqueeze, wire
from wardlight.llm.kernels import U64, mix, prefix_sums, range_hashes
from wardlight.llm.shared import LOWEST, chunks, keyed, materialize, n_buckets_bits, release_shuffles, runs, small_batches, text_or_empty

DISTANCE = 2
MIN_CHARS = 20
#: The `shortest` of the registered query and the pipeline: every line that is not empty.
EXACT_CHARS = 1
#: Bytes of text that become arrays of code points at once.
CHARS = 2 << 20
SEGMENTS, TEXT = 30, 31
_ASKED = "doc_id long, th long, starts binary, ends binary, asks binary"
_space = np.zeros(256, bool)
_space[[32, *range(9, 14)]] = True


def code_points(texts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"\n".join(texts).decode().encode("utf-32-le"), np.uint32)


def line_spans(text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the lines that count, without white space at both ends."""
    blank = np.ones(len(text) + 2, bool)
    blank[1:-1] = (text < 256) & _space[np.minimum(text, 255)]
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = edges[::2], edges[1::2]
    breaks = np.flatnonzero(text == 10)
    line = np.searchsorted(breaks, starts)
    first = runs(line)
    last = np.append(first[1:], len(line)) - 1
    a, z = (starts[first], ends[last]) if len(line) else (starts, ends)
    long_enough = z - a >= least
    return a[long_enough], z[long_enough]


def _segment(length: np.ndarray, i: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of segment i of lines of that length: even parts, the longer ones last."""
    size, longer = length // parts, length % parts
    short = parts - longer
    return i * size + np.maximum(0, i - short), size + (i >= short)


def segment_keys(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, key, own): hashes of each line's own segments (own, which probe equal lengths too) and of the substrings to probe."""
    parts, length = distance + 1, ends - starts
    lines, keys, own = [], [], []
    number = np.arange(len(starts))
    for shorter in range(distance + 1):
        indexed = length - shorter
        for i in range(parts):
            at, size = _segment(indexed, i, parts)
            for move in range(-distance, distance + 1):
                # Errors before the segment at most i, after it at most distance - i.
                if abs(move) > i or abs(move - shorter) > distance - i:
                    continue
                a = at + move
                some = number[(a >= 0) & (a + size <= length) & (size > 0) & (indexed > 0)]
                hashes = range_hashes(sums, starts[some] + a[some], starts[some] + a[some] + size[some])
                lines.append(some)
                keys.append(mix(hashes + (indexed[some] * parts + i).astype(U64) * U64(0xC2B2AE3D27D4EB4F)))
                own.append(np.full(len(some), move == 0 and shorter == 0))
    return np.concatenate(lines), np.concatenate(keys), np.concatenate(own)


def _entries(distance: int, least: int, shortest: int, bits: int):
    prefix = Prefix(bits)

    def run(batches):
        for k, rows in enumerate(chunks(batches, CHARS)):
            rows.sort(key=lambda r: r[0])
            ids = np.asarray([r[0] for r in rows], np.int64)
            text = code_points([r[2] for r in rows])
            starts, ends = line_spans(text, shortest)
            sizes = np.asarray([len(r[2].decode()) + 1 for r in rows])
            owner = np.searchsorted(np.cumsum(sizes), starts, "right")
            value = (text.astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15)
            value ^= value >> U64(29)
            sums = prefix_sums(value * U64(0xBF58476D1CE4E5B9))
            hashes = range_hashes(sums, starts, ends)
            order = np.argsort(hashes, kind="stable")
            same = np.concatenate(([False], hashes[order][1:] == hashes[order][:-1])) if len(order) else np.zeros(0, bool)
            group = np.maximum.accumulate(np.where(same, 0, np.arange(len(order)))) if len(order) else order
            who = owner[order]
            lost = same & ((ids[who] > ids[who[group]]) | (np.concatenate(([False], who[1:] == who[:-1])) if len(who) else same))
            gone = np.sort(order[lost])
            chunk = chunk_number(k)
            first = np.searchsorted(owner, np.arange(len(rows)))
            out = [chunk_documents(chunk, bits, ids, [r[1] for r in rows], first, gone, gone + 1)]
            sent = np.sort(order[~lost])
            key = prefix.key(hashes[sent])
            for bucket, part in by_bucket(prefix.bucket(key)):
                line = sent[part]
                out.append((bucket, ENTRIES, chunk, prefix.pack(key[part]), None, squeeze(np.diff(line, prepend=0)), pack_documents(ids, owner[line])))
            distinct = np.sort(order[~same])
            distinct = distinct[(ends - starts)[distinct] >= least]
            line, key, own = segment_keys(sums, starts[distinct], ends[distinct], distance)
            by_line = np.argsort(line, kind="stable")
            line, key, own = distinct[line[by_line]], prefix.key(key[by_line]), own[by_line]
            tags = ((hashes[line] >> U64(32)).astype(np.uint32) & np.uint32(0xFFFFFFFE)) | own
            for bucket, part in by_bucket(prefix.bucket(key)):
                out.append((bucket, SEGMENTS, chunk, prefix.pack(key[part]), tags[part].astype("<u4").tobytes(), squeeze(np.diff(line[part], prepend=0)), pack_documents(ids, owner[line[part]])))
            yield wire(out)

    return run


def _unpack(prefix: Prefix, rows: list[dict]) -> tuple[np.ndarray, ...]:
    keys = [prefix.unpack(r["a"]) for r in rows]
    row = np.repeat(np.arange(len(rows)), [len(k) for k in keys])
    return np.concatenate(keys), row, np.concatenate([np.cumsum(unsqueeze(r["c"])) for r in rows]), np.concatenate([unpack_documents(r["d"]) for r in rows])


def _by_row(kind: int, rows: list[dict], row: np.ndarray, blob) -> list[tuple]:
    order = np.argsort(row, kind="stable")
    return [(0, kind, rows[row[part[0]]]["chunk"], blob(part)) for part in np.split(order, np.flatnonzero(np.diff(row[order])) + 1) if len(part)]


def _meet(bits: int):
    prefix = Prefix(bits)

    def run(table: pa.Table) -> pa.Table:
        kinds = table["kind"].to_numpy()
        out = [table.filter(pa.array(kinds == CHUNK_DOCS)).combine_chunks()]
        rows = table.filter(pa.array(kinds == ENTRIES)).to_pylist()
        if rows:
            key, row, line, ids = _unpack(prefix, rows)
            order = np.lexsort((ids, key))
            key, row, line, ids = key[order], row[order], line[order], ids[order]
            first = runs(key)
            least = np.repeat(ids[first], np.diff(np.append(first, len(key))))
            lost = np.flatnonzero(ids > least)
            answers = _by_row(ANSWER, rows, row[lost], lambda part: line[lost[part]].astype("<i8").tobytes())
            out.append(pa.Table.from_batches([wire(answers)]))
        rows = table.filter(pa.array(kinds == SEGMENTS)).to_pylist()
        if rows:
            key, row, line, ids = _unpack(prefix, rows)
            tags = np.concatenate([np.frombuffer(r["b"], "<u4") for r in rows])
            order = np.lexsort((line, ids, tags >> 1, key))
            key, row, line, ids, tags = key[order], row[order], line[order], ids[order], tags[order]
            first = runs(key)
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (tags[1:] >> 1 != tags[:-1] >> 1)))
            sizes = np.diff(np.append(first, len(key)))
            several = (np.add.reduceat(new.astype(np.int64), first) > 1) & (np.bitwise_or.reduceat(tags & 1, first) > 0)
            at = np.flatnonzero(new & np.repeat(several, sizes))
            asks = _by_row(TEXT, rows, row[at], lambda part: np.stack((line[at[part]], key[at[part]].astype(np.int64))).astype("<i8").tobytes())
            out.append(pa.Table.from_batches([wire(asks)]))
        return pa.concat_tables([t.cast(out[0].schema) for t in out])

    return run


def _to_documents(table: pa.Table) -> pa.Table:
    """Of one chunk: for each document the lines lost so far, and the lines whose text is asked for."""
    rows = table.to_pylist()
    docs = next(r for r in rows if r["kind"] == CHUNK_DOCS)
    ids, ths, first = (np.frombuffer(docs[x], "<i8") for x in "abc")
    own = np.frombuffer(docs["d"], "<i8").reshape(2, -1)[0]
    lost = np.unique(np.concatenate([own] + [np.frombuffer(r["a"], "<i8") for r in rows if r["kind"] == ANSWER]))
    asks = np.concatenate([np.frombuffer(r["a"], "<i8").reshape(2, -1) for r in rows if r["kind"] == TEXT] or [np.zeros((2, 0), np.int64)], axis=1)
    asks = asks[:, np.argsort(asks[0], kind="stable")]
    # Documents without lines share their first number with the next one; the last of them has the lines.
    cut, asked_cut = (np.append(np.searchsorted(x, first), len(x)) for x in (lost, asks[0]))
    out = []
    for d in np.flatnonzero((np.diff(cut) > 0) | (np.diff(asked_cut) > 0)):
        a = lost[cut[d] : cut[d + 1]] - first[d]
        some = asks[:, asked_cut[d] : asked_cut[d + 1]].copy()
        some[0] -= first[d]
        out.append((int(ids[d]), int(ths[d]), a.astype("<i8").tobytes(), (a + 1).astype("<i8").tobytes(), some.tobytes() if some.size else None))
    types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, types)], ["doc_id", "th", "starts", "ends", "asks"])


def _send_texts(shortest: int, bits: int):
    def run(batches):
        for rows in chunks(batches):
            found, texts = [], []
            for doc_id, th, text, asks in rows:
                points = code_points([text])
                starts, ends = line_spans(points, shortest)
                for line, key in np.frombuffer(asks, "<i8").reshape(2, -1).T.tolist():
                    found.append((doc_id, th, line, key, ends[line] - starts[line]))
                    texts.append(points[starts[line] : ends[line]].astype("<u4").tobytes())
            meta = np.asarray(found, np.int64).reshape(-1, 5)
            out = []
            for bucket, part in by_bucket((mix(meta[:, 3].astype(U64)) >> U64(64 - bits)).astype(np.uint32)):
                out.append((bucket, TEXT, 0, np.ascontiguousarray(meta[part].T).astype("<i8").tobytes(), b"".join(texts[i] for i in part)))
            yield wire(out)

    return run


def within_distance(text: np.ndarray, a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray, distance: int) -> np.ndarray:
    """For pairs of spans of `text` (starts and sizes; sizes over `distance`), whether their edit distance is at most that.

    All pairs advance together, a column at a time. The column's 2 * distance + 1 cells about the
    diagonal are differences in the top bits of a word (Hyyrö's banded form of Myers' method).
    """
    near = np.abs(a_size - b_size) <= distance
    n = len(a)
    pad = np.concatenate((text, np.zeros(distance + 1, text.dtype)))
    one, top = U64(1), U64(63)
    plus = np.full(n, ~U64(0) << (top - U64(distance)), U64)
    minus = np.zeros(n, U64)
    score = np.full(n, distance, np.int64)
    row_mask = np.full(n, one << U64(62), U64)
    live = np.flatnonzero(near)
    for i in range(int(b_size[live].max()) if len(live) else 0):
        live = live[(i < b_size[live])]
        if i % 4 == 0:  # on the diagonal a score only grows, and the last row can win back the rest alone
            live = live[score[live] <= 2 * distance + np.maximum(0, b_size[live] - a_size[live])]
        if not len(live):
            break
        letter = pad[b[live] + i]
        match = np.zeros(len(live), U64)
        for d in range(-distance, distance + 1):
            at = i + d
            hit = (at >= 0) & (at < a_size[live]) & (pad[np.maximum(a[live] + at, 0).clip(max=len(pad) - 1)] == letter)
            match |= hit.astype(U64) << U64(63 - distance + d)
        vp, vn = plus[live], minus[live]
        zero = (((match & vp) + vp) ^ vp) | match | vn
        hp = vn | ~(zero | vp)
        hn = zero & vp
        diagonal = i < a_size[live] - distance
        mask = row_mask[live]
        score[live] += np.where(diagonal, (zero >> top) == 0, ((hp & mask) > 0).astype(np.int64) - ((hn & mask) > 0))
        row_mask[live] = np.where(diagonal, mask, mask >> one)
        plus[live] = hn | ~((zero >> one) | hp)
        minus[live] = (zero >> one) & hp
    return near & (score <= distance)


def letter_counts(text: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How often each line has letters of each of 32 classes; an edit changes two of them by one at most."""
    line = np.repeat(np.arange(len(size)), size)
    return np.bincount(line * 32 + (text & 31), minlength=32 * len(size)).reshape(-1, 32).astype(np.int32)


def _verify(distance: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        doc_id, th, line, key, size = np.concatenate([np.frombuffer(r["a"], "<i8").reshape(5, -1) for r in rows], axis=1)
        text = np.frombuffer(b"".join(r["b"] for r in rows), "<u4")
        start = np.cumsum(size) - size
        letters = letter_counts(text, size)
        order = np.lexsort((line, doc_id, key))
        first = runs(key[order])
        sizes = np.diff(np.append(first, len(order)))
        lost = np.zeros(len(order), bool)
        turn = 0
        while len(first):
            # The next earliest line of every group against the later ones that are still there.
            first, sizes = first[sizes > turn + 1], sizes[sizes > turn + 1]
            if not len(first):
                break
            pivot = np.repeat(order[first + turn], sizes - turn - 1)
            steps = np.arange(len(pivot)) - np.repeat(np.cumsum(sizes - turn - 1) - (sizes - turn - 1), sizes - turn - 1)
            other = order[np.repeat(first + turn + 1, sizes - turn - 1) + steps]
            open_ = ~lost[other] & ((doc_id[pivot] != doc_id[other]) | (th[pivot] == th[other]))
            pivot, other = pivot[open_], other[open_]
            for k in range(0, len(pivot), 1 << 14):
                p, o = pivot[k : k + (1 << 14)], other[k : k + (1 << 14)]
                alike = np.abs(letters[p] - letters[o]).sum(axis=1) <= 2 * distance
                p, o = p[alike], o[alike]
                near = within_distance(text, start[p], size[p], start[o], size[o], distance)
                lost[o[near]] = True
            turn += 1
        at = np.flatnonzero(lost)
        found = sorted({(int(doc_id[k]), int(th[k]), int(line[k])) for k in at})
        blob = lambda k: np.int64(k).tobytes()
        out = [(d, t, blob(k), blob(k + 1)) for d, t, k in found]
        types = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, types)], ["doc_id", "th", "starts", "ends"])

    return run


def _shortest(least: int, shortest: int | None) -> int:
    return least if shortest is None else max(1, min(shortest, least))


def repeated_lines(docs: DataFrame, distance: int = DISTANCE, least: int = MIN_CHARS, shortest: int | None = None) -> DataFrame:
    """(doc_id, th, starts, ends): numbers (among the lines that count) of the lines of keyed documents to remove; a table."""
    if least <= 2 * distance:
        raise ValueError("lines must be longer than twice the distance")
    shortest = _shortest(least, shortest)
    spark = docs.sparkSession
    bits = n_buckets_bits(docs)
    met = docs.mapInArrow(_entries(distance, least, shortest, bits), WIRE).groupBy("bucket").applyInArrow(_meet(bits), WIRE)
    first = materialize(met.groupBy("chunk").applyInArrow(_to_documents, _ASKED))
    release_shuffles(spark)
    asked = first.filter("asks is not null").select("doc_id", "th", "asks")
    texts = docs.select("doc_id", "th", "text").join(asked.hint("merge"), ["doc_id", "th"]).select("doc_id", "th", "text", "asks")
    second = materialize(texts.mapInArrow(_send_texts(shortest, bits), WIRE).groupBy("bucket").applyInArrow(_verify(distance), INTERVALS))
    release_shuffles(spark)
    return first.drop("asks").unionByName(second)


def _without(text: bytes, starts: np.ndarray, ends: np.ndarray, shortest: int) -> tuple[str, int, int]:
    """(text without the lines, number of lines with a word, number removed)."""
    gone = {k for a, z in zip(starts.tolist(), ends.tolist()) for k in range(a, z)}
    kept, number, lines = [], 0, 0
    for line in text.decode().split("\n"):
        bare = line.strip(" \t\n\x0b\x0c\r")
        lines += bool(bare)
        if len(bare) >= shortest:
            number += 1
            if number - 1 in gone:
                continue
        kept.append(line)
    return "\n".join(kept), lines, len(gone)


def dedup_digests(docs: DataFrame, distance: int = DISTANCE, least: int = MIN_CHARS, shortest: int | None = None) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256) of every row; n_lines counts lines with a word."""

    def rewrite(doc_id, text, starts, ends, rest):
        kept, lines, removed = _without(text, starts, ends, _shortest(least, shortest))
        return doc_id, lines, removed, hashlib.sha256(kept.encode()).hexdigest()

    rows = keyed(docs)
    return apply_to_documents(rows, repeated_lines(rows, distance, least, shortest), rewrite, "doc_id long, n_lines long, n_removed long, kept_sha256 string")


def dedup_lines(docs: DataFrame, distance: int = DISTANCE, least: int = MIN_CHARS, shortest: int | None = None) -> DataFrame:
    """docs without repeated lines, same columns (n_chars anew); documents that lose all their words go."""

    def rewrite(doc_id, text, starts, ends, rest):
        kept, _, removed = _without(text, starts, ends, _shortest(least, shortest))
        return kept, removed, rest

    small_batches(docs.sparkSession)
    name = lambda c: F.col("`" + c.replace("`", "``") + "`")
    rest = F.struct(*[name(c) for c in docs.columns if c != "text"])
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("doc_id"), F.xxhash64(text_or_empty()).alias("th"), text_or_empty().alias("text"), rest.alias("rest"))
    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("removed", T.LongType()), T.StructField("rest", rows.schema["rest"].dataType)])
    out = apply_to_documents(rows, repeated_lines(rows.drop("rest"), distance, least, shortest), rewrite, schema)
    out = out.filter((F.col("removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[new[c].alias(c) if c in new else F.col("rest")[c].alias(c) for c in docs.columns])
