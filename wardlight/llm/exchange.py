"""The traffic of the repeat finders: hash entries of chunks to buckets, findings back to chunks, intervals to documents.

A map task turns a chunk of documents into sorted hash entries, drops what repeats inside the
chunk (so a key that a third of all rows share reaches a bucket once per chunk), and deals the
rest to buckets of equal hash prefix. A bucket finds what repeats across chunks and answers each
chunk; the chunk's answers become intervals of its documents; those meet the texts in one
exchange by document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.kernels import U64, mix
from wardlight.llm.shared import LOWEST, merge_intervals, text_bytes

#: Rows between map, buckets and chunks; what the blobs hold depends on kind and operator.
WIRE = "bucket int, kind int, chunk long, a binary, b binary, c binary, d binary"
_WIRE = ("bucket", "kind", "chunk", "a", "b", "c", "d")
_WIRE_TYPES = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
INTERVALS = "doc_id long, th long, starts binary, ends binary"
ENTRIES, CHUNK_DOCS, ANSWER = 0, 1, 2


def wire(rows: list[tuple]) -> pa.RecordBatch:
    rows = [r + (None,) * (len(_WIRE) - len(r)) for r in rows]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(_WIRE), _WIRE_TYPES)], _WIRE)


def chunk_number(k: int) -> int:
    """The same for each attempt of a task."""
    return (TaskContext.get().partitionId() << 32) | k


def squeeze(values: np.ndarray) -> bytes:
    """Non-negative integers in the smallest type that holds them, its width first."""
    kind = np.min_scalar_type(int(values.max()) if len(values) else 0)
    return bytes([kind.itemsize]) + values.astype(kind).tobytes()


def unsqueeze(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, f"<u{blob[0]}", offset=1).astype(np.int64)


class Prefix:
    """Keys of 56 bits below the bucket's own bits, or what `total` leading bits of a hash leave if that is fewer."""

    def __init__(self, bits: int, total: int = 64):
        self.bits = bits
        self.low = min(56, total - bits)
        self.bytes = (self.low + 7) // 8

    def key(self, hashes: np.ndarray) -> np.ndarray:
        return hashes >> U64(64 - self.bits - self.low)

    def bucket(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> U64(self.low)).astype(np.uint16 if self.bits <= 16 else np.uint32)

    def pack(self, keys: np.ndarray) -> bytes:
        return np.ascontiguousarray((keys & U64((1 << self.low) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : self.bytes]).tobytes()

    def unpack(self, blob: bytes) -> np.ndarray:
        out = np.zeros((len(blob) // self.bytes, 8), np.uint8)
        out[:, : self.bytes] = np.frombuffer(blob, np.uint8).reshape(-1, self.bytes)
        return out.view("<u8").ravel()


def by_bucket(buckets: np.ndarray):
    """(bucket, indexes in their given order) of each bucket."""
    order = np.argsort(buckets, kind="stable")
    cuts = np.flatnonzero(np.diff(buckets[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(buckets[part[0]]), part


def pack_documents(ids: np.ndarray, owner: np.ndarray) -> bytes:
    """Document ids of entries that stand in document order, as runs."""
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    counts = np.diff(np.append(first, len(owner)))
    steps = np.diff(ids[owner[first]], prepend=np.int64(0))
    head = squeeze(counts)
    return len(head).to_bytes(4, "little") + head + steps.tobytes()


def unpack_documents(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:4], "little")
    return np.repeat(np.cumsum(np.frombuffer(blob, "<i8", offset=4 + n)), unsqueeze(blob[4 : 4 + n]))


def chunk_documents(chunk: int, bits: int, ids, ths, first: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple:
    """The row that tells a chunk's documents and what it already found inside itself."""
    own = np.concatenate((starts, ends)).astype("<i8").tobytes()
    bucket = int(mix(np.array([chunk + 1], U64))[0] >> U64(64 - bits))
    return (bucket, CHUNK_DOCS, chunk, np.asarray(ids, "<i8").tobytes(), np.asarray(ths, "<i8").tobytes(), np.asarray(first, "<i8").tobytes(), own)


def to_intervals(length: int):
    """Of one chunk: its documents' removal intervals, from what it found itself and the window starts that buckets answered."""

    def merge(table: pa.Table) -> pa.Table:
        kinds = table["kind"].to_numpy()
        docs = table.slice(int(np.flatnonzero(kinds == CHUNK_DOCS)[0]), 1).to_pylist()[0]
        ids, ths, first = (np.frombuffer(docs[x], "<i8") for x in "abc")
        own = np.frombuffer(docs["d"], "<i8")
        starts, ends = [own[: len(own) // 2]], [own[len(own) // 2 :]]
        for blob in table.filter(pa.array(kinds == ANSWER))["a"].to_pylist():
            at = np.frombuffer(blob, "<u4").astype(np.int64)
            starts.append(at)
            ends.append(at + length)
        starts, ends = np.concatenate(starts), np.concatenate(ends)
        who = np.searchsorted(first, starts, "right") - 1
        starts, ends = merge_intervals(starts + who, ends + who)  # a gap keeps neighbouring documents apart
        who = np.searchsorted(first + np.arange(len(first)), starts, "right") - 1
        rows = []
        for part in np.split(np.arange(len(who)), np.flatnonzero(np.diff(who)) + 1):
            if len(part):
                d = who[part[0]]
                base = first[d] + d
                rows.append((int(ids[d]), int(ths[d]), (starts[part] - base).astype("<i8").tobytes(), (ends[part] - base).astype("<i8").tobytes()))
        columns = zip(*rows) if rows else [[]] * 4
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["doc_id", "th", "starts", "ends"])

    return merge


def apply_to_documents(docs: DataFrame, intervals: DataFrame, rewrite, schema: str) -> DataFrame:
    """rewrite(doc_id, text, starts, ends, rest) of every row of docs, which meet their intervals in one exchange.

    docs: doc_id, th, text and perhaps rest; intervals: INTERVALS rows. schema names what rewrite returns as a tuple.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rest = "rest" in docs.columns
    columns = ["doc_id", "th", "kind", "text", "starts", "ends"] + ["rest"] * rest
    texts = docs.withColumns({"kind": F.lit(1), "starts": F.lit(None).cast("binary"), "ends": F.lit(None).cast("binary")})
    found = intervals.withColumns({"kind": F.lit(0), "text": F.lit(None).cast("string")})
    if rest:
        found = found.withColumn("rest", F.lit(None).cast(docs.schema["rest"].dataType))
    met = texts.select(columns).unionByName(found.select(columns)).repartition(n, "doc_id", "th").sortWithinPartitions("doc_id", "th", "kind")
    import pyspark.sql.types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    out_type = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(out_type)

    def run(batches):
        key, starts, ends = None, [], []
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            ids, ths, kinds = (batch.column(c).to_numpy() for c in ("doc_id", "th", "kind"))
            a, z = batch.column("starts"), batch.column("ends")
            rests = batch.column("rest") if rest else None
            out, size = [], 0
            for i in range(len(ids)):
                if key != (ids[i], ths[i]):
                    key, starts, ends = (ids[i], ths[i]), [], []
                if kinds[i] == 0:
                    starts.append(np.frombuffer(a[i].as_py(), "<i8"))
                    ends.append(np.frombuffer(z[i].as_py(), "<i8"))
                    continue
                spans = merge_intervals(np.concatenate(starts), np.concatenate(ends)) if starts else (np.zeros(0, np.int64),) * 2
                out.append(rewrite(None if ids[i] == LOWEST else int(ids[i]), texts[i], *spans, rests[i].as_py() if rest else None))
                size += len(texts[i])
                if size > 16 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return met.mapInArrow(run, out_type)
