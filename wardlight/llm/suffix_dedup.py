"""Suffix-array dedup: bytes covered by a long string that also starts elsewhere are removed.

Two strings of 400 bytes that are equal have the same least 200-byte hash at the same place (their
anchor), so only stretches that share an anchor can hold a repeat. Map tasks find the anchors and,
for each, the run of window starts it answers for; buckets of anchor hashes find runs whose whole
content repeats, and ask for the texts of those that may repeat in part. These are joined into one
string for each bucket, whose suffixes are sorted to the wanted depth, and breadth-first backward
extension on its Burrows-Wheeler transform derives the common prefixes of neighbours by increasing
value, stopping at the minimum length: what is then still open is a repeat.

An anchor with more than HOT different runs would put a hot group into one string; its runs go as
hashes of their windows instead, which spread evenly and are counted (the exact way for the rest).

Null texts count as empty; a null doc_id takes part and comes back as null; texts shorter than the
minimum lose nothing; repeated rows are copies of one another. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.exchange import ANSWER, CHUNK_DOCS, ENTRIES, INTERVALS, WIRE, Prefix, apply_to_documents, by_bucket, chunk_documents, chunk_number, squeeze, unsqueeze, wire
from wardlight.llm.kernels import BYTE_VALUES, U64, mix, prefix_sums, range_hashes
from wardlight.llm.shared import chunks, keyed, materialize, merge_intervals, n_buckets_bits, release_shuffles

LENGTH = 400
#: Different runs of one anchor whose texts are joined in one bucket at most.
HOT = 256
#: Bytes that become arrays at once; longer documents are taken in overlapping parts.
PART = 1 << 20
_PLACE = 22
TEXT, WINDOWS = 20, 21
_ASKED = "doc_id long, th long, starts binary, ends binary, asks binary"


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """out[i] = min(values[i : i + width]), by minima from both ends of blocks of that width."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchor_runs(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(start, end, anchor offset, anchor hash, content hash) of the runs of window starts with the same anchor."""
    gram = length // 2
    buffer = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.asarray([len(t) for t in texts])
    ends = np.cumsum(sizes)
    valid = np.zeros(len(buffer), bool)
    for z, n in zip(ends, sizes):
        if n >= length:
            valid[z - n : z - length + 1] = True
    at = np.flatnonzero(valid)
    if not len(at):
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + tuple(np.zeros(0, U64) for _ in range(2))
    sums = prefix_sums(BYTE_VALUES[buffer])
    place = np.arange(len(buffer) - gram + 1)
    grams = range_hashes(sums, place, place + gram)
    ordered = ((grams >> U64(_PLACE)) << U64(_PLACE)) | place.astype(U64)
    anchor = (sliding_minimum(ordered, length - gram + 1)[at] & U64((1 << _PLACE) - 1)).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1))))
    last = np.append(new[1:], len(at)) - 1
    start, end, anchor = at[new], at[last] + 1, anchor[new]
    content = mix(range_hashes(sums, start, end + length - 1) + (anchor - start).astype(U64))
    # Anchors are least hashes: mixed, they spread over all buckets.
    return start, end, anchor - start, mix(grams[anchor]), content


def _parts(rows: list[tuple], length: int):
    """Lists of (document, offset, bytes) of at most PART bytes; every window lies in one part."""
    out, size = [], 0
    for d, r in enumerate(rows):
        for a in range(0, max(1, len(r[2]) - length + 1), PART):
            text = r[2][a : a + PART + length - 1]
            if out and size + len(text) > PART:
                yield out
                out, size = [], 0
            out.append((d, a, text))
            size += len(text)
    if out:
        yield out


def _entries(length: int, bits: int):
    prefix = Prefix(bits)

    def run(batches):
        for k, rows in enumerate(chunks(batches)):
            base = np.zeros(len(rows) + 1, np.int64)
            np.cumsum([len(r[2]) for r in rows], out=base[1:])
            found = []
            for part in _parts(rows, length):
                start, end, *others = anchor_runs([p[2] for p in part], length)
                edge = np.cumsum([0] + [len(p[2]) for p in part])
                own = np.searchsorted(edge, start, "right") - 1
                shift = (base[[p[0] for p in part]] + [p[1] for p in part] - edge[:-1])[own]
                found.append((start + shift, end + shift, *others))
            start, end, offset, anchor, content = map(np.concatenate, zip(*found))
            key = prefix.key(anchor)
            order = np.lexsort((start, content, key))
            same = np.concatenate(([False], (key[order][1:] == key[order][:-1]) & (content[order][1:] == content[order][:-1])))
            same = same[: len(order)]
            repeated = order[same | np.append(same[1:], False)[: len(order)]]
            chunk = chunk_number(k)
            inside = np.searchsorted(base, start[repeated], "right") - 1
            a, z = merge_intervals(start[repeated] + inside, end[repeated] + length - 1 + inside)  # a gap keeps neighbouring documents apart
            inside = np.searchsorted(base + np.arange(len(base)), a, "right") - 1
            out = [chunk_documents(chunk, bits, [r[0] for r in rows], [r[1] for r in rows], base[:-1], a - inside, z - inside)]
            sent = np.sort(order[~same])
            for bucket, part in by_bucket(prefix.bucket(key[sent])):
                part = sent[part]
                tail = np.ascontiguousarray(content[part].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
                out.append((bucket, ENTRIES, chunk, prefix.pack(key[part]), tail, squeeze(np.diff(start[part], prepend=0)), squeeze(np.concatenate((offset[part], end[part] - start[part])))))
            yield wire(out)

    return run


def _compare(length: int, bits: int):
    prefix = Prefix(bits)

    def run(table: pa.Table) -> pa.Table:
        kinds = table["kind"].to_numpy()
        out = [table.filter(pa.array(kinds == CHUNK_DOCS)).combine_chunks()]
        rows = table.filter(pa.array(kinds == ENTRIES)).to_pylist()
        if rows:
            key = [prefix.unpack(r["a"]) for r in rows]
            row = np.repeat(np.arange(len(rows)), [len(k) for k in key])
            key = np.concatenate(key)
            content = np.zeros((len(key), 8), np.uint8)
            content[:, :6] = np.frombuffer(b"".join(r["b"] for r in rows), np.uint8).reshape(-1, 6)
            content = content.view("<u8").ravel()
            start = np.concatenate([np.cumsum(unsqueeze(r["c"])) for r in rows])
            both = [unsqueeze(r["d"]).reshape(2, -1) for r in rows]
            offset, count = (np.concatenate([b[i] for b in both]) for i in (0, 1))
            order = np.lexsort((content, key))
            key, content, row, start, offset, count = (x[order] for x in (key, content, row, start, offset, count))
            new_key = np.concatenate(([True], key[1:] != key[:-1]))
            new = new_key | np.concatenate(([True], content[1:] != content[:-1]))
            alone = new & np.append(new[1:], True)
            kinds_of_key = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_key))[np.cumsum(new_key) - 1]
            ask = new & (kinds_of_key > 1)
            hot = kinds_of_key > HOT
            answers = []
            for kind, some in ((ANSWER, ~alone), (TEXT, ask & ~hot), (WINDOWS, ask & hot)):
                at = np.flatnonzero(some)
                at = at[np.argsort(row[at], kind="stable")]
                for part in np.split(at, np.flatnonzero(np.diff(row[at])) + 1):
                    if len(part):
                        blob = np.stack((start[part], count[part], offset[part], key[part].astype(np.int64))).astype("<i8").tobytes()
                        answers.append((0, kind, rows[row[part[0]]]["chunk"], blob))
            out.append(pa.Table.from_batches([wire(answers)]))
        return pa.concat_tables([t.cast(out[0].schema) for t in out])

    return run


def _to_documents(length: int):
    """Of one chunk: for each document the intervals found so far, and the runs whose text is asked for."""

    def merge(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        docs = next(r for r in rows if r["kind"] == CHUNK_DOCS)
        ids, ths, first = (np.frombuffer(docs[x], "<i8") for x in "abc")
        own = np.frombuffer(docs["d"], "<i8").reshape(2, -1)
        blobs = lambda kind: np.concatenate([np.frombuffer(r["a"], "<i8").reshape(4, -1) for r in rows if r["kind"] == kind] or [np.zeros((4, 0), np.int64)], axis=1)
        known, text, windows = (blobs(k) for k in (ANSWER, TEXT, WINDOWS))
        starts = np.concatenate((own[0], known[0]))
        ends = np.concatenate((own[1], known[0] + known[1] + length - 1))
        who = np.searchsorted(first, starts, "right") - 1
        asks = np.concatenate((np.vstack((text, np.zeros(text.shape[1], np.int64))), np.vstack((windows, np.ones(windows.shape[1], np.int64)))), axis=1)
        asked = np.searchsorted(first, asks[0], "right") - 1
        out = []
        order, asked_order = np.argsort(who, kind="stable"), np.argsort(asked, kind="stable")
        cut, asked_cut = (np.searchsorted(x, np.arange(len(ids) + 1)) for x in (who[order], asked[asked_order]))
        for d in np.flatnonzero((np.diff(cut) > 0) | (np.diff(asked_cut) > 0)):
            mine = order[cut[d] : cut[d + 1]]
            a, z = merge_intervals(starts[mine] - first[d], ends[mine] - first[d])
            some = asks[:, asked_order[asked_cut[d] : asked_cut[d + 1]]].copy()
            some[0] -= first[d]
            out.append((int(ids[d]), int(ths[d]), a.astype("<i8").tobytes(), z.astype("<i8").tobytes(), some.tobytes() if some.size else None))
        types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, types)], ["doc_id", "th", "starts", "ends", "asks"])

    return merge


def _send_texts(length: int, bits: int):
    """Contents of asked runs to the buckets of their anchors, or hashes of their windows to the buckets of these."""
    prefix = Prefix(bits)

    def run(batches):
        for rows in chunks(batches):
            runs, texts, keys, places = [], [], [], []
            for doc_id, th, text, asks in rows:
                for start, count, offset, key, hot in np.frombuffer(asks, "<i8").reshape(5, -1).T.tolist():
                    content = text[start : start + count + length - 1]
                    if hot:
                        at = np.arange(count)
                        keys.append(range_hashes(prefix_sums(BYTE_VALUES[np.frombuffer(content, np.uint8)]), at, at + length))
                        places.append(np.stack((np.full(count, doc_id), np.full(count, th), at + start)))
                    else:
                        runs.append((doc_id, th, start, count, key))
                        texts.append(content)
            out = []
            if runs:
                table = np.asarray(runs, np.int64)
                for bucket, part in by_bucket((mix(table[:, 4].astype(U64)) >> U64(64 - bits)).astype(np.uint32)):
                    out.append((bucket, TEXT, 0, np.ascontiguousarray(table[part, :4].T).astype("<i8").tobytes(), b"".join(texts[i] for i in part)))
            if keys:
                key, place = prefix.key(np.concatenate(keys)), np.concatenate(places, axis=1)
                for bucket, part in by_bucket(prefix.bucket(key)):
                    out.append((bucket, WINDOWS, 0, place[:, part].astype("<i8").tobytes(), prefix.pack(key[part])))
            yield wire(out)

    return run


def sort_suffixes(text: np.ndarray, depth: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(suffix array, its inverse, ranks by prefixes of some length from `seed` on, that length).

    Suffixes are ordered by their first `depth` symbols or more, doubling from 7; symbols are below 512.
    """
    n = len(text)
    padded = np.concatenate((text, np.zeros(7, text.dtype))).astype(U64)
    key = np.zeros(n, U64)
    for k in range(7):
        key = (key << U64(9)) | padded[k : k + n]
    reach, seeded, level = 7, None, 0
    while True:
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], key[order][1:] != key[order][:-1])))
        if seeded is None and reach >= seed:
            seeded, level = rank, reach
        if reach >= depth:
            break
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - reach)] = rank[reach:] + 1
        key = (rank.astype(U64) << U64(32)) | ahead.astype(U64)
        reach *= 2
    inverse = np.empty(n, np.int64)
    inverse[order] = np.arange(n)
    return order, inverse, seeded, level


def open_prefixes(text: np.ndarray, length: int, seed: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, open): open[i] if suffixes i-1 and i in order share `length` symbols or more.

    Symbol 0 ends a content; what is said of suffixes that reach one within `length` symbols means
    nothing. Intervals of equal prefixes (of `seed` symbols or somewhat more) are extended to the
    left, character by character of the Burrows-Wheeler transform; an interval whose right end still
    has no value gets the present one and is extended in the next round. Rounds stop below `length`.
    """
    order, inverse, ranks, level = sort_suffixes(text, length, min(seed, length))
    n = len(text)
    closed = np.ones(n + 1, bool)
    if level > length:
        level = 0
        closed[1:n] = False
    else:
        closed[1:n] = ranks[order][1:] != ranks[order][:-1]
    left = np.flatnonzero(closed[:n])
    right = np.append(left[1:], n) - 1
    before = order - 1
    while level < length and len(left):
        sizes = right - left + 1
        owner = np.repeat(np.arange(len(left)), sizes)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + left[owner]
        previous = before[inside]
        owner, previous = owner[previous >= 0], previous[previous >= 0]
        if not len(previous):
            break
        to = inverse[previous]
        tag = owner * 512 + text[previous]
        by = np.argsort(to, kind="stable")
        to, tag = to[by], tag[by]
        first = np.flatnonzero(np.concatenate(([True], (tag[1:] != tag[:-1]) | (to[1:] != to[:-1] + 1))))
        left, right = to[first], to[np.append(first[1:], len(to)) - 1]
        fresh = ~closed[right + 1]
        left, right = left[fresh], right[fresh]
        closed[right + 1] = True
        level += 1
    return order, ~closed[:n]


def _expand(length: int, bits: int):
    prefix = Prefix(bits)

    def run(table: pa.Table) -> pa.Table:
        found = []
        rows = [r for r in table.to_pylist() if r["kind"] == TEXT]
        if rows:
            doc_id, th, start, count = np.concatenate([np.frombuffer(r["a"], "<i8").reshape(4, -1) for r in rows], axis=1)
            texts = np.frombuffer(b"".join(r["b"] for r in rows), np.uint8)
            sizes = count + length - 1
            begin = np.cumsum(sizes) - sizes
            # Bytes count from 1; a zero follows each content.
            spot = np.arange(len(texts)) + np.repeat(np.arange(len(sizes)), sizes)
            joined = np.zeros(len(texts) + len(sizes), np.uint16)
            joined[spot] = texts.astype(np.uint16) + 1
            begin = begin + np.arange(len(sizes))
            owner = np.full(len(joined), -1, np.int64)
            at = np.concatenate([np.arange(b, b + c) for b, c in zip(begin, count)])
            owner[at] = np.repeat(np.arange(len(count)), count)
            order, open_ = open_prefixes(joined, length)
            group = np.cumsum(~open_) - 1
            real = owner[order] >= 0
            often = np.bincount(group[real], minlength=group[-1] + 1) > 1
            hit = order[real & often[group]]
            who = owner[hit]
            found.append(np.stack((doc_id[who], th[who], start[who] + hit - begin[who])))
        rows = [r for r in table.to_pylist() if r["kind"] == WINDOWS]
        if rows:
            place = np.concatenate([np.frombuffer(r["a"], "<i8").reshape(3, -1) for r in rows], axis=1)
            key = np.concatenate([prefix.unpack(r["b"]) for r in rows])
            order = np.argsort(key, kind="stable")
            same = key[order][1:] == key[order][:-1]
            found.append(place[:, order[np.append(same, False) | np.concatenate(([False], same))]])
        doc_id, th, start = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
        order = np.lexsort((start, th, doc_id))
        doc_id, th, start = doc_id[order], th[order], start[order]
        out = []
        for part in np.split(np.arange(len(order)), np.flatnonzero((np.diff(doc_id) != 0) | (np.diff(th) != 0)) + 1):
            if len(part):
                a, z = merge_intervals(start[part], start[part] + length)
                out.append((int(doc_id[part[0]]), int(th[part[0]]), a.astype("<i8").tobytes(), z.astype("<i8").tobytes()))
        types = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, types)], ["doc_id", "th", "starts", "ends"])

    return run


def repeated_intervals(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, th, starts, ends): byte intervals of keyed documents that repeat elsewhere; a table."""
    spark = docs.sparkSession
    bits = n_buckets_bits(docs)
    compared = docs.mapInArrow(_entries(length, bits), WIRE).groupBy("bucket").applyInArrow(_compare(length, bits), WIRE)
    first = materialize(compared.groupBy("chunk").applyInArrow(_to_documents(length), _ASKED))
    release_shuffles(spark)
    asked = first.filter("asks is not null").select("doc_id", "th", "asks")
    texts = docs.join(asked.hint("merge"), ["doc_id", "th"]).select("doc_id", "th", "text", "asks")
    second = materialize(texts.mapInArrow(_send_texts(length, bits), WIRE).groupBy("bucket").applyInArrow(_expand(length, bits), INTERVALS))
    release_shuffles(spark)
    return first.drop("asks").unionByName(second)


def _digest(doc_id, text: bytes, starts: np.ndarray, ends: np.ndarray, rest) -> tuple:
    edges = [0, *np.stack((starts, ends), axis=1).ravel().tolist(), len(text)]
    kept = b"".join(text[a:z] for a, z in zip(edges[::2], edges[1::2]))
    return doc_id, len(text), len(text) - len(kept), len(starts), hashlib.sha256(kept).hexdigest()


def removal_digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    rows = keyed(docs)
    return apply_to_documents(rows, repeated_intervals(rows, length), _digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, kept, starts, ends): the bytes left, and the removed byte intervals."""

    def rewrite(doc_id, text, starts, ends, rest):
        edges = [0, *np.stack((starts, ends), axis=1).ravel().tolist(), len(text)]
        return doc_id, b"".join(text[a:z] for a, z in zip(edges[::2], edges[1::2])), starts.tolist(), ends.tolist()

    rows = keyed(docs)
    return apply_to_documents(rows, repeated_intervals(rows, length), rewrite, "doc_id long, kept binary, starts array<long>, ends array<long>")
