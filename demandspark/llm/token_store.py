"""Token-id output: raw id payloads with a minimal perfect hash index from document keys to offsets.

A shard is three files: ``.ids`` (every id as a little-endian unsigned integer of 16 bits, or of 32 where a shard has
larger ids; the index tells which; documents one after another),
``.keys`` (the keys in the same order, for whole reads) and ``.idx``, the index. The index places n keys in n slots:
level by level, each key is hashed to a bit of a table about twice as large as the keys left, bits hit once are set and
their keys placed, the others go to the next level. The slot of a key is the number of set bits before its own. Each
slot holds a fingerprint, which tells keys that were never stored, and the offset and length of the document's ids. An
access reads the index once and then touches one slot and one range of the payload.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from demandspark.llm.common import slices
from demandspark.llm.shingles import U64, mix
from demandspark.llm.tokenization import encode_column
from demandspark.llm.wordwise import WORDWISE_BYTES

# A shard is closed once its ids reach this size at 32 bits.
SHARD_BYTES = 32 << 20
SHARDS_A_TASK = 4
MAX_LEVELS = 64
NO_KEY = -(1 << 63)  # stands for a null doc_id


@dataclass
class Index:
    """A minimal perfect hash with fingerprints, offsets and lengths by slot."""

    sizes: np.ndarray  # bits of each level
    bits: np.ndarray  # all levels, one byte a bit
    before: np.ndarray  # set bits before each bit
    fingerprints: np.ndarray
    offsets: np.ndarray
    lengths: np.ndarray
    width: int = 4  # bytes of an id in the payload

    def ids(self, payload: bytes, slot: int) -> np.ndarray:
        """The ids of a slot out of the whole payload."""
        return np.frombuffer(payload, f"<u{self.width}", int(self.lengths[slot]), self.width * int(self.offsets[slot]))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each hashed key, or -1 where it isn't stored."""
        slot = np.full(len(keys), -1, dtype=np.int64)
        left, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = base + _place(keys[left], level, int(size))
            hit = self.bits[at] == 1
            slot[left[hit]] = self.before[at[hit]]
            left = left[~hit]
            base += int(size)
        known = slot >= 0
        known[known] = self.fingerprints[slot[known]] == _fingerprint(keys[known])
        return np.where(known, slot, -1)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(
            out, sizes=self.sizes, bits=np.packbits(self.bits), fingerprints=self.fingerprints,
            offsets=self.offsets, lengths=self.lengths, width=self.width,
        )
        return out.getvalue()

    @staticmethod
    def load(data: bytes) -> Index:
        with np.load(io.BytesIO(data)) as f:
            bits = np.unpackbits(f["bits"])[: int(f["sizes"].sum())]
            return Index(f["sizes"], bits, _before(bits), f["fingerprints"], f["offsets"], f["lengths"], int(f["width"]))


def _before(bits: np.ndarray) -> np.ndarray:
    return np.cumsum(bits, dtype=np.int64) - bits


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(keys + U64(level + 1) * U64(0x9E3779B97F4A7C15)) % U64(size)).astype(np.int64)


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(keys ^ U64(0xC2B2AE3D27D4EB4F)) >> U64(32)).astype(np.uint32)


def hashed_keys(doc_ids: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    """Hash of (doc_id, which of the rows with that doc_id)."""
    with np.errstate(over="ignore"):
        return mix(mix(doc_ids.astype(np.int64).view(U64)) + occurrence.astype(U64) * U64(0xD6E8FEB86659FD93))


def build_index(keys: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> Index:
    """The index of distinct hashed keys."""
    sizes, tables = [], []
    left = np.arange(len(keys))
    levels = np.full(len(keys), -1, dtype=np.int64)
    for level in range(MAX_LEVELS):
        if not len(left):
            break
        size = max(8, 2 * len(left))
        at = _place(keys[left], level, size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        tables.append(alone.astype(np.uint8))
        levels[left[alone[at]]] = level
        left = left[~alone[at]]
    if len(left):
        raise ValueError("two keys of a shard hash alike")
    bits = np.concatenate(tables) if tables else np.empty(0, np.uint8)
    index = Index(np.array(sizes, np.int64), bits, _before(bits), np.empty(0, np.uint32), np.empty(0), np.empty(0))
    base, slot = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), np.empty(len(keys), np.int64)
    for level, size in enumerate(sizes):
        own = np.flatnonzero(levels == level)
        slot[own] = index.before[base[level] + _place(keys[own], level, size)]
    order = np.argsort(slot)
    index.fingerprints, index.offsets, index.lengths = _fingerprint(keys)[order], offsets[order], lengths[order]
    return index


def _occurrences(doc_ids: np.ndarray) -> np.ndarray:
    """Of sorted ids, which of its repetitions each is."""
    position = np.arange(len(doc_ids))
    new = np.concatenate([[True], doc_ids[1:] != doc_ids[:-1]])[: len(doc_ids)]
    return position - np.maximum.accumulate(np.where(new, position, 0))


def _put(folder: str, name: str, data: bytes) -> None:
    """Write a file so that it appears whole: a repeated or lost task leaves no half file under the name."""
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    part = f"{root}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, f"{root}/{name}")


def _get(folder: str, name: str) -> bytes:
    fs, root = pafs.FileSystem.from_uri(folder)
    with fs.open_input_file(f"{root}/{name}") as f:
        return f.read()


def as_uri(path: str) -> str:
    return path if "://" in path else "file://" + path.removeprefix("file:")


def write_store(documents: DataFrame, folder: str, tokenizer: str, end_id: int | None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode all texts, write them in ascending doc_id order as shards, and return the table of the shards.

    Columns: task, shard, first_id, last_id, n_docs, n_ids; written as Parquet in ``folder`` too. Documents are
    range-partitioned by doc_id and each task writes its shards as it goes, holding one at a time. ``end_id`` ends every
    document. A null text is empty; null doc_ids come first; rows that repeat a doc_id follow each other. Other columns
    are ignored. An empty table gives no shards.
    """
    folder = as_uri(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        keys: list[int] = []
        lengths: list[int] = []
        payload: list[np.ndarray] = []
        held, shard = 0, 0

        def close() -> pa.RecordBatch:
            ids = np.array(keys, np.int64)
            length = np.array(lengths, np.int64)
            offset = np.cumsum(length) - length
            name = f"{task:06d}-{shard:06d}"
            index = build_index(hashed_keys(ids, _occurrences(ids)), offset, length)
            every = np.concatenate(payload)
            index.width = 2 if every.max(initial=0) < 1 << 16 else 4
            _put(folder, f"{name}.ids", every.astype(f"<u{index.width}").tobytes())
            _put(folder, f"{name}.keys", ids.astype("<i8").tobytes())
            _put(folder, f"{name}.idx", index.dump())
            row = [[task], [shard], [int(ids[0])], [int(ids[-1])], [len(ids)], [int(length.sum())]]
            for held_list in (keys, lengths, payload):
                held_list.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in row], ["task", "shard", "first_id", "last_id", "n_docs", "n_ids"])

        for batch in chain.from_iterable(slices(b, WORDWISE_BYTES) for b in batches):
            doc_ids = batch["doc_id"].to_pylist()
            for doc_id, own in zip(doc_ids, encode_column(tokenizer, batch["text"]), strict=True):
                ids = own if end_id is None else np.append(own, np.uint32(end_id))
                keys.append(NO_KEY if doc_id is None else doc_id)
                lengths.append(len(ids))
                payload.append(ids)
                held += ids.nbytes
                if held >= shard_bytes:
                    yield close()
                    held, shard = 0, shard + 1
        if keys:
            yield close()

    ordered = documents.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, "task long, shard long, first_id long, last_id long, n_docs long, n_ids long").write.parquet(f"{folder}/manifest")
    return documents.sparkSession.read.parquet(f"{folder}/manifest")


def read_store(shards: DataFrame, folder: str) -> DataFrame:
    """All documents of a store, from its files: doc_id, start (ids of all documents before it), ids (binary, 32 bits each).

    Every key goes through the index, as a keyed access does. Only the shard table, a row for tens of megabytes of ids,
    is numbered as a whole.
    """
    folder = as_uri(folder)
    before = F.sum("n_ids").over(Window.orderBy("task", "shard").rowsBetween(Window.unboundedPreceding, -1))
    numbered = shards.select("task", "shard", F.coalesce(before, F.lit(0)).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task, shard, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name = f"{task:06d}-{shard:06d}"
                payload, index = _get(folder, f"{name}.ids"), Index.load(_get(folder, f"{name}.idx"))
                keys = np.frombuffer(_get(folder, f"{name}.keys"), "<i8")
                slot = index.slots(hashed_keys(keys, _occurrences(keys)))
                if (slot < 0).any():
                    raise ValueError(f"shard {name} lacks the index entry of a document")
                for at in range(0, len(keys), 1000):
                    own = slot[at : at + 1000]
                    ids = [index.ids(payload, s).astype("<u4").tobytes() for s in own.tolist()]
                    doc_ids = [None if k == NO_KEY else k for k in keys[at : at + 1000].tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start + index.offsets[own], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "ids"])

    # The rows are small but what they name is not: a fixed number of tasks keeps Spark from merging them by their size.
    tasks = -(-max(1, shards.count()) // SHARDS_A_TASK)
    spread = numbered.repartition(tasks, "task", "shard")
    return spread.mapInArrow(run, "doc_id long, start long, ids binary")


def lookup(shards: DataFrame, folder: str, doc_ids: list[int]) -> dict[int, np.ndarray]:
    """Keyed access to a few documents: the ids of the first row of each doc_id that the store holds.

    The shard table leads a key to the shards whose range holds it, the index to its slot and range of the payload.
    """
    folder = as_uri(folder)
    found: dict[int, np.ndarray] = {}
    near = F.lit(False)
    for doc_id in doc_ids:
        near |= F.lit(doc_id).between(F.col("first_id"), F.col("last_id"))
    rows = shards.filter(near).select("task", "shard").orderBy("task", "shard").collect()  # a few shards for each key
    for task, shard in rows:
        name = f"{task:06d}-{shard:06d}"
        index = Index.load(_get(folder, f"{name}.idx"))
        keys = np.array([d for d in doc_ids if d not in found], np.int64)
        for key, slot in zip(keys.tolist(), index.slots(hashed_keys(keys, np.zeros(len(keys), np.int64))).tolist(), strict=True):
            if slot >= 0:
                fs, root = pafs.FileSystem.from_uri(folder)
                with fs.open_input_file(f"{root}/{name}.ids") as f:
                    f.seek(index.width * int(index.offsets[slot]))
                    found[key] = np.frombuffer(f.read(index.width * int(index.lengths[slot])), f"<u{index.width}").astype("<u4")
    return found


def ids_crc32(stored: DataFrame) -> DataFrame:
    """Adds n_tokens and the unsigned CRC-32 of the raw ids."""
    return stored.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long")).withColumn("ids_crc32", F.crc32("ids"))
