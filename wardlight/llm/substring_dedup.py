"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

A window is removed when the same words also start earlier: in a document of smaller doc_id, or
before in the same document. Windows are judged on the input; removed windows merge into maximal
intervals. Hashes have 56 bits below the bucket prefix, so that with 2^b buckets two different
windows share a hash once in 2^(56+b) pairs.

Null texts count as empty; a null doc_id is the lowest and comes back as null. Texts shorter than
a window lose nothing. Rows that repeat a doc_id count as equally early: neither loses words to
the other. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wardlight.llm.exchange import ANSWER, CHUNK_DOCS, ENTRIES, INTERVALS, WIRE, Prefix, apply_to_documents, by_bucket, chunk_documents, chunk_number, pack_documents, squeeze, to_intervals, unpack_documents, unsqueeze, wire
from wardlight.llm.kernels import Words
from wardlight.llm.shared import chunks, keyed, materialize, merge_intervals, n_buckets_bits, release_shuffles

WINDOW = 20


def _entries(window: int, bits: int):
    prefix = Prefix(bits)

    def run(batches):
        for k, rows in enumerate(chunks(batches)):
            rows.sort(key=lambda r: r[0])
            ids = np.asarray([r[0] for r in rows], np.int64)
            words = Words([r[2] for r in rows])
            hashes, starts = words.windows(window)
            keys = prefix.key(hashes)
            owner = words.document[starts]
            order = np.argsort(keys, kind="stable")
            same = np.concatenate(([False], keys[order][1:] == keys[order][:-1]))
            group = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
            who = owner[order]
            lost = same & ((ids[who] > ids[who[group]]) | np.concatenate(([False], who[1:] == who[:-1])))
            at = np.sort(starts[order[lost]])
            inside = words.document[at]
            a, z = merge_intervals(at + inside, at + window + inside)  # a gap keeps neighbouring documents apart
            inside = np.searchsorted(words.first[:-1] + np.arange(len(rows)), a, "right") - 1
            chunk = chunk_number(k)
            out = [chunk_documents(chunk, bits, ids, [r[1] for r in rows], words.first[:-1], a - inside, z - inside)]
            sent = np.sort(order[~lost])
            for bucket, part in by_bucket(prefix.bucket(keys[sent])):
                part = sent[part]
                out.append((bucket, ENTRIES, chunk, prefix.pack(keys[part]), squeeze(np.diff(starts[part], prepend=0)), pack_documents(ids, owner[part])))
            yield wire(out)

    return run


def _count(bits: int):
    prefix = Prefix(bits)

    def run(table: pa.Table) -> pa.Table:
        kinds = table["kind"].to_numpy()
        out = [table.filter(pa.array(kinds == CHUNK_DOCS)).combine_chunks()]
        rows = table.filter(pa.array(kinds == ENTRIES)).to_pylist()
        if rows:
            keys = [prefix.unpack(r["a"]) for r in rows]
            row = np.repeat(np.arange(len(rows)), [len(k) for k in keys])
            keys = np.concatenate(keys)
            order = np.argsort(keys, kind="stable")
            sorted_keys = keys[order]
            same = sorted_keys[1:] == sorted_keys[:-1]
            order = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
            if len(order):
                ids = np.concatenate([unpack_documents(r["c"]) for r in rows])[order]
                starts = np.concatenate([np.cumsum(unsqueeze(r["b"])) for r in rows])[order]
                first = np.flatnonzero(np.concatenate(([True], keys[order][1:] != keys[order][:-1])))
                least = np.repeat(np.minimum.reduceat(ids, first), np.diff(np.append(first, len(ids))))
                lost = ids > least
                row, starts = row[order][lost], starts[lost]
                by_row = np.argsort(row, kind="stable")
                answers = []
                for part in np.split(by_row, np.flatnonzero(np.diff(row[by_row])) + 1):
                    if len(part):
                        answers.append((0, ANSWER, rows[row[part[0]]]["chunk"], starts[part].astype("<u4").tobytes()))
                out.append(pa.Table.from_batches([wire(answers)]))
        return pa.concat_tables([t.cast(out[0].schema) for t in out])

    return run


def repeated_intervals(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, th, starts, ends): word intervals of keyed documents that repeat earlier text."""
    bits = n_buckets_bits(docs)
    sent = docs.mapInArrow(_entries(window, bits), WIRE)
    answered = sent.groupBy("bucket").applyInArrow(_count(bits), WIRE)
    return answered.groupBy("chunk").applyInArrow(to_intervals(window), INTERVALS)


def _digest(doc_id, text: bytes, starts: np.ndarray, ends: np.ndarray, rest) -> tuple:
    words = text.split()  # bytes.split() parts at space and 0x09 to 0x0D alone
    keep = np.ones(len(words), bool)
    for a, z in zip(starts, ends):
        keep[a:z] = False
    kept = b" ".join(compress(words, keep) if len(starts) else words)
    return doc_id, len(words), int(len(words) - keep.sum()), hashlib.sha256(kept).hexdigest(), len(starts)


def _rewritten(doc_id, text: bytes, starts: np.ndarray, ends: np.ndarray, rest) -> tuple:
    words = text.split()
    keep = np.ones(len(words), bool)
    for a, z in zip(starts, ends):
        keep[a:z] = False
    return doc_id, b" ".join(compress(words, keep)).decode(), list(map(int, starts)), list(map(int, ends))


def _found(docs: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    rows = keyed(docs)
    intervals = materialize(repeated_intervals(rows, window))
    release_shuffles(docs.sparkSession)
    return rows, intervals


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text, starts, ends): kept words joined by blanks, and the removed word intervals."""
    return apply_to_documents(*_found(docs, window), _rewritten, "doc_id long, text string, starts array<long>, ends array<long>")


def removal_digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, n_spans) of every row."""
    return apply_to_documents(*_found(docs, window), _digest, "doc_id long, n_words long, n_removed long, kept_sha256 string, n_spans long")
