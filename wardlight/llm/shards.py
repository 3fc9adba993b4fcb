"""Sorted hash arrays in the shared folder, memory-mapped by workers.

A shard is one file: named arrays behind a small header. Files appear whole (written under another
name, then renamed), so attempts of a task may repeat. Where the shared folder is no mounted file
system, a worker copies a shard to a nameless local file once and maps that.
"""

from __future__ import annotations

import json
import mmap
import os
import tempfile
from urllib.parse import urlsplit

import numpy as np
from pyspark import TaskContext

#: Shards of a table that a worker keeps mapped. Each is a mapping of its own; a process may have some 65,000 of them.
OPEN_SHARDS = 4096
#: The same where a mapping takes a local copy.
COPIED_SHARDS = 512


def local_path(uri: str) -> str | None:
    parts = urlsplit(uri)
    return parts.path if parts.scheme in ("", "file") else None


def write_shard(uri: str, arrays: dict[str, np.ndarray]) -> None:
    head = json.dumps([[k, v.dtype.str, len(v)] for k, v in arrays.items()]).encode()
    head += b" " * (-(len(head) + 8) % 8)
    blob = [len(head).to_bytes(8, "little"), head]
    for v in arrays.values():
        blob += [v.tobytes(), bytes(-v.nbytes % 8)]
    context = TaskContext.get()
    tag = f"{uri}.{context.taskAttemptId() if context else 0}"
    path = local_path(uri)
    if path:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(local_path(tag), "wb") as out:
            out.writelines(blob)
        os.replace(local_path(tag), path)
        return
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(tag)
    system.create_dir(at.rpartition("/")[0], recursive=True)
    with system.open_output_stream(at) as out:
        for b in blob:
            out.write(b)
    system.move(at, fs.FileSystem.from_uri(uri)[1])


def map_shard(uri: str) -> dict[str, np.ndarray]:
    path = local_path(uri)
    if path:
        if not os.path.exists(path):
            return {}
        file = open(path, "rb")
    else:
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(uri)
        if system.get_file_info(at).type == fs.FileType.NotFound:
            return {}
        file = tempfile.TemporaryFile()
        with system.open_input_stream(at) as source:
            while block := source.read(1 << 22):
                file.write(block)
        file.flush()
    with file:
        view = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
    n = int.from_bytes(view[:8], "little")
    out, at = {}, 8 + n
    for name, kind, count in json.loads(view[8 : 8 + n]):
        out[name] = np.frombuffer(view, kind, count, at)
        at += out[name].nbytes + -out[name].nbytes % 8
    return out


class Table:
    """A table of sorted keys in shards by the top bits of the key."""

    def __init__(self, folder: str, name: str, bits: int):
        self.folder, self.name, self.bits, self.open = folder, name, bits, {}
        self.most = OPEN_SHARDS if local_path(folder) else COPIED_SHARDS

    def shard(self, bucket: int) -> dict[str, np.ndarray]:
        """Shards are asked for in order, again and again: the first ones stay, as the latest ones would all be gone by their next turn."""
        shard = self.open.get(bucket)
        if shard is None:
            shard = map_shard(f"{self.folder}/{self.name}-{bucket}")
            if len(self.open) < self.most:
                self.open[bucket] = shard
        return shard

    def get(self, keys: np.ndarray, *values: str) -> list[np.ndarray]:
        """For sorted distinct keys: the named values, 0 where a key is missing. Counts over 254 stand in a list of their own."""
        out = [np.zeros(len(keys), np.int64) for _ in values]
        cuts = np.searchsorted(keys >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64)) if len(keys) else []
        for bucket in np.flatnonzero(np.diff(cuts)) if len(keys) else ():
            part = slice(cuts[bucket], cuts[bucket + 1])
            shard = self.shard(int(bucket))
            if not shard or not len(shard["keys"]):
                continue
            at = np.minimum(np.searchsorted(shard["keys"], keys[part]), len(shard["keys"]) - 1)
            hit = shard["keys"][at] == keys[part]
            for o, v in zip(out, values):
                found = np.where(hit, shard[v][at], 0).astype(np.int64)
                if f"{v}+" in shard:
                    full = found == 255
                    found[full] = shard[f"{v}+"][np.searchsorted(shard[f"{v}@"], at[full])]
                o[part] = found
        return out


def counts_column(name: str, counts: np.ndarray) -> dict[str, np.ndarray]:
    """Counts as bytes; those over 254 in a list with their places."""
    large = np.flatnonzero(counts > 254)
    return {name: np.minimum(counts, 255).astype(np.uint8), f"{name}@": large.astype(np.int64), f"{name}+": counts[large].astype(np.int64)}
