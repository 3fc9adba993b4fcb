"""MinHash document fingerprints: universal hash permutations over word shingles, vectorised in numpy.

A fingerprint is the low byte of each of 128 minima, in hexadecimal; likeness corrects the share
of equal bytes for chance. Signature bands are joined in Spark and their pairs verified by exact
Jaccard similarity (near_duplicates).

Null texts count as empty; texts of 1 to 4 words are one shingle, texts without words have none,
an all-ones fingerprint, and likeness 0 to any text with words. A null doc_id comes first in the
order of documents and comes back as null; rows that repeat a doc_id are ordered by text. The only
row of a table is its own next document. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm import ngram_join
from wardlight.llm.kernels import Words, minhash
from wardlight.llm.shared import LOWEST, chunks, text_or_empty

SHINGLE = 5
PERMUTATIONS = 128
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def signatures(texts: list[bytes], permutations: int = PERMUTATIONS, shingle: int = SHINGLE) -> np.ndarray:
    return minhash(*Words(texts).shingles(shingle), len(texts), permutations)


def _likeness(a: np.ndarray, b: np.ndarray, empty_a: np.ndarray, empty_b: np.ndarray) -> np.ndarray:
    share = (a == b).mean(axis=1)
    out = np.clip((share - 1 / 256) / (1 - 1 / 256), 0, 1)
    return np.where(empty_a != empty_b, 0.0, out)


def in_order(docs: DataFrame) -> DataFrame:
    """(bucket, look, key, text): key ranges in buckets, each followed by the first rows of the next range (look 1)."""
    spark = docs.sparkSession
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("key"), text_or_empty().alias("text"))
    cuts = rows.agg(F.percentile_approx("key", [i / n for i in range(n)]).alias("c"), F.min("key").alias("m")).first()
    rough = np.unique(np.asarray([*(cuts["c"] or []), *([] if cuts["m"] is None else [cuts["m"]])], np.int64))

    @F.pandas_udf("int")
    def nearest(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(rough, key.to_numpy(), "right").astype(np.int32))

    # As many numbers as buckets: each range's least key.
    starts = np.sort(np.asarray([r[0] for r in rows.groupBy(nearest("key")).agg(F.min("key").alias("m")).select("m").collect()], np.int64))

    @F.pandas_udf("array<int>")
    def deal(key: pd.Series) -> pd.Series:
        at = np.searchsorted(starts, key.to_numpy(), "right") - 1
        first = starts[at] == key.to_numpy()
        return pd.Series([[2 * b] + [2 * ((b - 1) % len(starts)) + 1] * f for b, f in zip(at.tolist(), first.tolist())])

    dealt = rows.withColumn("place", F.explode(deal("key")))
    dealt = dealt.select((F.col("place") / 2).cast("int").alias("bucket"), F.pmod("place", F.lit(2)).alias("look"), "key", "text")
    return dealt.repartition(max(1, n // 4), "bucket").sortWithinPartitions("bucket", "look", "key", "text")


def _fingerprint(batches):
    held = []
    for rows in chunks(batches, 4 << 20):
        rows = held + rows
        held = [rows[-1]]
        pairs = [i for i in range(len(rows) - 1) if rows[i][0] == rows[i + 1][0] and not rows[i][1]]
        if not pairs:
            continue
        plain = [r[3] for r in rows]
        edited, sizes = [], []
        for i in pairs:
            text = plain[i].decode()
            half = len(text) // 2
            edited.append((text[: len(text) - half] + plain[i + 1].decode()[:half]).encode())
            sizes.append(len(text))
        marks = signatures(plain + edited)
        empty = (marks == 0xFFFFFFFF).all(axis=1)
        low = marks.astype(np.uint8)
        own, after, changed = np.asarray(pairs), np.asarray(pairs) + 1, np.arange(len(pairs)) + len(plain)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([None if rows[i][2] == LOWEST else rows[i][2] for i in pairs], pa.int64()),
                pa.array(sizes, pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in edited]),
                pa.array([low[i].tobytes().hex() for i in own]),
                pa.array([low[i].tobytes().hex() for i in changed]),
                pa.array(_likeness(low[own], low[changed], empty[own], empty[changed])),
                pa.array(_likeness(low[own], low[after], empty[own], empty[after])),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row: fingerprints of its text and of the text whose second half gives way to the next document's beginning."""
    return in_order(docs).mapInArrow(_fingerprint, _SCHEMA)


def near_duplicates(docs: DataFrame, threshold: float = 0.8, bands: int = 32) -> DataFrame:
    """(doc_id, class_id, n_links): bands of the signatures are joined in Spark, pairs verified by exact Jaccard.

    The bands are whole: a pair at the threshold shares one of 32 with probability 1 - 5e-8.
    """
    return ngram_join.near_duplicates(docs, threshold, trees=bands, deepest=PERMUTATIONS // bands)
