"""Token ids in binary shards with a minimal perfect hash index.

A shard is a pair of files in a folder that all executors share:
  <name>.ids   the raw ids of its documents, one after the other, little-endian, 2 or 4 bytes each, nothing else;
  <name>.mph   the index: an npz with the levels of a minimal perfect hash function over the shard's doc_ids,
               and for each slot a fingerprint (32 bits of another hash of the key), the first row and the number
               of rows with that key; for each row its doc_id and its offset in the ids.
Keyed access hashes the key (a few levels at most), compares the fingerprint, and reads one run of ids: constant time,
whatever the shard's size. Shards hold ascending ranges of doc_id, so that the manifest (one row for each shard: path,
ids before it, least and greatest key) tells the shard of a key.

The function has levels as of Limasset et al. (2017): each level is a bit array; a key that meets no other at its
position is placed there, the others go on to the next level; a key's slot is the rank of its bit.

Documents are dealt by ranges of doc_id and sorted in their shard; a worker streams ids to the file slice by slice.
A task that runs again writes new files: the manifest names those of the attempt that counted, and the others are deleted.

Null texts are empty: only the end id. Long texts are encoded whole. Rows with the same doc_id stand side by side, in the order of their texts, and
the key leads to all of them. Rows without doc_id stand first and have no key. An empty table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import io
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import new_path
from .kernels import arrow_rows, lean, mix, slices
from .pieces import byte_level


@dataclass(frozen=True)
class Config:
    tokenizer: str
    end_id: int = 2
    shards: int | None = None  # None: as many as the session's shuffle partitions, fewer where these are small
    gamma: float = 1.5


class Mph:
    """Minimal perfect hash function over distinct 64-bit keys."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.base = np.concatenate([[0], np.cumsum(sizes)])
        self.rank = np.concatenate([[0], np.cumsum(bits)])

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys ^ mix(np.uint64(level + 1) * np.full(1, 0x9E3779B97F4A7C15, np.uint64))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 1.5) -> Mph:
        keys, sizes, bits = keys.view(np.uint64), [], []
        while len(keys):
            size = max(8, int(gamma * len(keys)))
            at = cls._at(keys, len(sizes), size)
            once = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(once)
            keys = keys[~once[at]]
        return cls(np.array(sizes, np.int64), np.concatenate([*bits, np.zeros(0, bool)]))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for some keys that were not there (of the others the fingerprint tells)."""
        keys = keys.view(np.uint64)
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = self.base[level] + self._at(keys[left], level, int(size))
            hit = self.bits[at]
            out[left[hit]] = self.rank[at[hit]]
            left = left[~hit]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(mix(keys.view(np.uint64)) + np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class Shard:
    """Keyed access to one shard."""

    def __init__(self, path: str):
        system, at = _filesystem(path)
        with system.open_input_file(at + ".mph") as f:
            index = np.load(io.BytesIO(f.read()))
        self.mph = Mph(index["sizes"], np.unpackbits(index["bits"], count=int(index["n_bits"])).astype(bool))
        self.prints, self.first, self.count = index["prints"], index["first"], index["count"]
        self.doc_ids, self.keyless, self.offsets = index["doc_ids"], int(index["keyless"]), index["offsets"]
        self.dtype = np.dtype(str(index["dtype"]))
        self.file = system.open_input_file(at + ".ids")

    def rows(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and number of rows of each key; 0 rows for a key that is not there."""
        if not len(self.prints):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        slot = self.mph.slots(keys)
        ok = (slot >= 0) & (self.prints[slot] == fingerprints(keys))
        return np.where(ok, self.first[slot], 0), np.where(ok, self.count[slot], 0)

    def read(self, row: int, n: int = 1) -> np.ndarray:
        a, b = int(self.offsets[row]), int(self.offsets[row + n])
        self.file.seek(a * self.dtype.itemsize)
        return np.frombuffer(self.file.read((b - a) * self.dtype.itemsize), self.dtype)

    def close(self) -> None:
        self.file.close()


def write(docs: DataFrame, cfg: Config, path: str | None = None) -> list[tuple]:
    """Writes the shards; (path, ids before it, rows, ids, least key, greatest key) of each, in the order of doc_id."""
    spark = docs.sparkSession
    path = path or new_path(spark, "ids")
    schema = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("rows", pa.int64()), ("ids", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])

    def run(batches):
        from pyspark import TaskContext

        encoder = byte_level(cfg.tokenizer)
        shard = TaskContext.get().partitionId()
        name = f"{path}/{shard:06d}-{uuid.uuid4().hex}"
        system, at, out = None, None, None
        doc_ids, missing, lens = [], [], []
        for batch in batches:
            for rows, _, _ in slices(batch):
                if out is None:
                    system, at = _filesystem(name)
                    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
                    out = system.open_output_stream(at + ".ids")
                ids, off = encoder.encode([t or "" for t in rows.column("text").to_pylist()])
                full = np.insert(ids, off[1:], cfg.end_id)
                out.write(full.astype(full.dtype.newbyteorder("<")).tobytes())
                lens.append(np.diff(off) + 1)
                missing.append(np.asarray(rows.column("doc_id").is_null()))
                doc_ids.append(rows.column("doc_id").fill_null(0).to_numpy())
        if out is None:
            return
        out.close()
        keys, lens = np.concatenate(doc_ids), np.concatenate(lens)
        keyless = int(np.concatenate(missing).sum())
        own, first, count = np.unique(keys[keyless:], return_index=True, return_counts=True)
        mph = Mph.build(own, cfg.gamma)
        slot = mph.slots(own)
        index = {"prints": np.zeros(len(own), np.uint32), "first": np.zeros(len(own), np.int64), "count": np.zeros(len(own), np.int64)}
        for k, v in (("prints", fingerprints(own)), ("first", first + keyless), ("count", count)):
            index[k][slot] = v
        buffer = io.BytesIO()
        np.savez(buffer, sizes=mph.sizes, bits=np.packbits(mph.bits), n_bits=len(mph.bits), doc_ids=keys, keyless=keyless, offsets=np.concatenate([[0], np.cumsum(lens)]), dtype=np.dtype(encoder.dtype).newbyteorder("<").str, **index)
        with system.open_output_stream(at + ".mph") as f:
            f.write(buffer.getvalue())
        yield arrow_rows(schema, [pa.array([v], t) for v, t in zip((shard, name, len(keys), int(lens.sum()), int(own[0]) if len(own) else None, int(own[-1]) if len(own) else None), schema.types)])

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = (dealt.repartitionByRange(cfg.shards, "doc_id") if cfg.shards else dealt.repartitionByRange("doc_id")).sortWithinPartitions("doc_id", "text")
    made = sorted(tuple(r) for r in dealt.mapInArrow(lean(run), "shard int, path string, rows long, ids long, low long, high long").collect())
    out, before = [], 0
    for _, name, rows, ids, low, high in made:
        out.append((name, before, rows, ids, low, high))
        before += ids
    _tidy(path, {m[0] for m in out})
    return out


def _tidy(path: str, named: set[str]) -> None:
    """Deletes the files of attempts that don't count."""
    from pyarrow import fs

    system, at = _filesystem(path)
    if system.get_file_info(at).type == fs.FileType.Directory:
        known = {n.rsplit("/", 1)[1] for n in named}
        for f in system.get_file_info(fs.FileSelector(at)):
            if f.base_name.rsplit(".", 1)[0] not in known:
                system.delete_file(f.path)


def documents_of(spark, manifest: list[tuple]) -> DataFrame:
    """Each document from the files, found by its key: doc_id, start, n_tokens, ids_crc32, then shard."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("shard", pa.string())])

    def run(batches):
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = Shard(path)
                keys = shard.doc_ids
                first, count = shard.rows(keys)
                # rows of one key follow each other; rows without key are read by their place
                step = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
                group = np.flatnonzero(step)
                row = first + np.arange(len(keys)) - group[np.cumsum(step) - 1] if len(keys) else first
                row[: shard.keyless] = np.arange(shard.keyless)
                if shard.keyless < len(keys) and shard.keyless and keys[shard.keyless] == keys[shard.keyless - 1]:
                    same = np.flatnonzero(keys == keys[shard.keyless])
                    same = same[same >= shard.keyless]
                    row[same] = first[same] + np.arange(len(same))
                if (count[shard.keyless :] == 0).any():
                    raise ValueError(f"a key is missing in {path}")
                crc = np.array([zlib.crc32(shard.read(int(r)).astype("<u4").tobytes()) for r in row], np.int64)
                ids = pa.array(keys, mask=np.arange(len(keys)) < shard.keyless)
                yield arrow_rows(schema, [ids, before + shard.offsets[row], np.diff(shard.offsets)[row], crc, pa.array([path] * len(keys))])
                shard.close()

    rows = spark.createDataFrame([m[:2] for m in manifest], "path string, before long")
    return rows.repartition(max(1, len(manifest))).mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids_crc32 long, shard string")
