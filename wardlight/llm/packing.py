"""Best-fit packing of tokenised documents with certified bounds.

Documents are tokenised once, cut only when longer than a sequence, and packed by best-fit
decreasing within hash partitions. A dual-feasible-function lower bound tells whether a
partition could use fewer bins. A certified partition is final but for a bin less than half full;
of the others, the emptiest bins, whose room would hold twice what the bound saves, give their
documents back. What is given back is dealt anew into fewer partitions and packed again, until one
partition is left.

Null texts are empty documents: the end token alone. Rows that repeat a doc_id are packed one
by one (pieces are told apart by a number). An empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.shared import chunks, materialize, text_or_empty

LENGTH = 1024
END_ID = 2
#: Words whose ids a worker remembers; when full, the memory starts anew.
REMEMBERED = 400_000
#: Pieces that a partition holds on average.
PARTITION = 20_000

# Where a single blank between two other characters can part a text without changing its tokens.
_between = re.compile(r"(?<=\S) (?=\S)")
_beside = re.compile(r"\s\s|^\s|\s$")
_separators = re.compile("[\x1c-\x1f]")


# Fixed value: how byte-level tokenizers part a text before merging.
_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Up to here all versions of Unicode agree on what is a letter.
_SETTLED = "\u04ff"


def _merger(path: str):
    """The same vocabulary as byte ranks for tiktoken, which merges short words faster; None for other kinds of tokenizer."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, parts = spec["model"], spec["pre_tokenizer"] or {}
    if model["type"] != "BPE" or model.get("dropout") or spec["normalizer"] or (parts.get("type"), parts.get("add_prefix_space"), parts.get("use_regex")) != ("ByteLevel", False, True):
        return None
    made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if any(a >= b for a, b in zip(made, made[1:])):  # ranks must be in the order of the merges
        return None
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(plain))}
    special = {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    try:
        import tiktoken
    except ImportError:
        return None
    return tiktoken.Encoding("words", pat_str=_PARTS, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Token ids of whole texts as little-endian 32-bit bytes; words met before come from memory."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merger = _merger(path)

    def _ids(self, text: str) -> bytes:
        if self.merger and (text.isascii() or text and max(text) <= _SETTLED):
            return array("I", self.merger.encode_ordinary(text)).tobytes()
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if _separators.search(text) or any(s in text for s in self.special):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = _between.split(text) if _beside.search(text) else text.split(" ")
        known = self.known
        out = list(map(known.get, words))
        out[0] = self._ids(words[0])
        for i, ids in enumerate(out):
            if ids is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                out[i] = known[words[i]] = self._ids(" " + words[i])
        return b"".join(out)


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """(doc_id, th, piece, start, length, ids_crc32): each document's ids and the end id, cut from the end into pieces of `length`."""

    def cut(batches):
        encoder = Encoder(tokenizer)
        for rows in chunks(batches):
            out = []
            for doc_id, copy, text in rows:
                ids = encoder.encode(text.decode()) + END_ID.to_bytes(4, "little")
                n = len(ids) // 4
                first = n % length or length
                starts = [0, *range(first, n, length)]
                for k, (a, z) in enumerate(zip(starts, [*starts[1:], n])):
                    out.append((doc_id, copy, k, a, z - a, zlib.crc32(ids[4 * a : 4 * z])))
            names = ("doc_id", "copy", "piece", "start", "length", "ids_crc32")
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("copy"), text_or_empty().alias("text"))
    return rows.mapInArrow(cut, "doc_id long, copy long, piece int, start long, length long, ids_crc32 long")


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each length, and what each bin has left."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    rooms: dict[int, list[int]] = {}
    levels: list[int] = []
    left: list[int] = []
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        k = bisect_left(levels, n)
        if k < len(levels):
            room = levels[k]
            b = rooms[room].pop()
            if not rooms[room]:
                del rooms[room], levels[k]
        else:
            room, b = capacity, len(left)
            left.append(capacity)
        bins[i], offsets[i] = b, capacity - room
        room -= n
        left[b] = room
        if room:
            if room not in rooms:
                rooms[room] = []
                insort(levels, room)
            rooms[room].append(b)
    return bins, offsets, left


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best of the dual-feasible bounds: items above capacity - k count as whole bins, items below k as nothing."""
    count = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1]
    total = np.arange(capacity + 1) * count
    number, amount = np.cumsum(count), np.cumsum(total)
    best = -(-int(amount[-1]) // capacity)
    for k in range(1, capacity // 2 + 1):
        large = int(number[-1] - number[capacity - k])
        middle = int(amount[capacity - k] - amount[k - 1])
        best = max(best, large + -(-middle // capacity))
    for k in range(2, 101):  # f(x) = floor((k+1) x) / k, x where (k+1) x is whole
        scaled = (k + 1) * np.arange(capacity + 1)
        worth = np.where(scaled % capacity == 0, k * np.arange(capacity + 1), (scaled // capacity) * capacity)
        best = max(best, -(-int((worth * count).sum()) // (k * capacity)))
    return best


_PACKED = "doc_id long, copy long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, final boolean, gap int"


def given_back(left: np.ndarray, gap: int, capacity: int) -> np.ndarray:
    """Which bins, by what they have left, are packed again; gap: bins beyond the lower bound."""
    if gap <= 0:
        return left > capacity // 2
    order = np.argsort(-left, kind="stable")
    room = np.cumsum(left[order])
    out = np.zeros(len(left), bool)
    out[order[: int(np.searchsorted(room, 2 * (gap + 1) * capacity)) + 1]] = True
    return out & (left > 0)


def _filler(length: int, turn: int, last: bool):
    """Packs one partition; marks as final what need not be packed again."""

    def fill(table: pa.Table) -> pa.Table:
        order = np.lexsort((table["piece"].to_numpy(), table["copy"].to_numpy()))
        table = table.take(order)
        lengths = table["length"].to_numpy().astype(np.int64)
        bins, offsets, left = best_fit_decreasing(lengths, length)
        gap = len(left) - lower_bound(lengths, length)
        final = np.ones(len(bins), bool) if last else ~given_back(np.asarray(left), gap, length)[bins]
        part = int(table["part"][0].as_py())
        ids = ((np.int64(turn) << 56) | (np.int64(part) << 32)) + bins
        table = table.drop_columns(["part"])
        for name, values in (("sequence_id", ids), ("offset", offsets), ("final", final), ("gap", np.full(len(bins), gap, np.int32))):
            table = table.append_column(name, pa.array(values))
        return table

    return fill


def pack(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """rows of pieces() with sequence_id and offset."""
    state, done, turn = materialize(rows), [], 0
    parts = max(1, -(-state.count() // PARTITION))
    while True:
        dealt = state.withColumn("part", F.pmod(F.xxhash64("copy", "piece", F.lit(turn)), F.lit(parts)).cast("int"))
        packed = materialize(dealt.groupBy("part").applyInArrow(_filler(length, turn, parts == 1), _PACKED))
        done.append(packed.filter("final"))
        state = packed.filter("not final").select("doc_id", "copy", "piece", "start", "length", "ids_crc32")
        n = 0 if parts == 1 else state.count()
        if not n:
            break
        parts, turn = max(1, min(parts // 2, -(-n // PARTITION))), turn + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop("final", "copy")


def packed_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    return pack(pieces(docs, tokenizer, length), length)
