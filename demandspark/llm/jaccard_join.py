"""N-gram Jaccard join: documents whose sets of word shingles overlap by a given share, and the groups they form.

Method: size-banded tiles with hashed bitmap signatures. Bit counts bound the overlap of two sets from above; only pairs
whose bound reaches the threshold are compared by an exact intersection of their sorted arrays.

1. *Tiles.* Sizes fall into bands. Two linked sets whose smaller one lies in a band differ in at most H shingles, so if
   the hash space is cut into more than H parts, they agree in one. Every non-empty part gives one signature of (band,
   part, content); a tile is the group of sets with one signature. A set is placed in its own band and, where a smaller
   partner could lie there, in the band below. Parts that are empty carry no signature; a few parts more than needed
   make up for them, and the rare sets with more empty parts than that carry signatures of their empty parts too, so no
   link is lost.
2. *Signatures that repeat.* Rows (signature, document) are range-partitioned by both columns: a signature that a third of
   all documents carry is split over many tasks. Rows of signatures seen once are dropped, and each row that stays is
   told the least document of its signature in the same pass; only the two signatures at a task's ends need more.
3. *Stars.* Each member of a tile is compared with the least member. The links found join most members.
4. *Open tiles.* Tiles whose other members are still in different components are compared pair by pair by bit counts, in
   blocks of bounded size. Components that may link by these form clusters, and within a cluster the pairs that may link
   are compared exactly, again in blocks. Pairs within a component are skipped here, because they cannot change it.
5. *All links.* Every link lies within a component. Once the components are whole, all pairs of different sets of a
   component are compared exactly, in blocks: products of incidence matrices over the shingles that the sets share. They
   give each document's number of links, or the links themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandspark.llm.common import Scratch, bound_batches, components, map_batches, materialize, slices, text_bytes
from demandspark.llm.shingles import U64, mix, shingle_sets

BAND_RATIO = 1.35
# Members of a block of an open tile, with their bitmaps; members of a block of a cluster, and bytes of their arrays.
TILE_MEMBERS = 1024
BLOCK_MEMBERS = 512
BLOCK_ARRAY_BYTES = 8 << 20
# Shingles of a slice of an incidence matrix, bits of a slice of bitmaps, and pairs bounded at once.
SLICE_SHINGLES = 4096
SLICE_BITS = 4096
PAIRS_AT_ONCE = 1 << 18
# A set of n shingles is mapped to the next power of two of 2n bits.
BITS_PER_SHINGLE = 2


class Bands:
    """Bands of set sizes for one threshold, each with the number of parts its tiles need."""

    def __init__(self, percent: int):
        self.percent = percent
        self.low = [1]
        self.parts: list[tuple[int, int]] = []

    def _grow(self) -> None:
        low = self.low[-1]
        high = max(low + 1, math.floor(low * BAND_RATIO))
        largest = high - 1
        partner = largest * 100 // self.percent
        differ = (largest + partner) * (100 - self.percent) // (100 + self.percent)
        spare = 0
        if differ:
            for _ in range(8):  # spare parts and empty parts depend on each other
                parts = differ + 1 + spare
                empty = parts * math.exp(-low / parts)
                spare = math.ceil(empty + 4 * math.sqrt(empty))
        self.parts.append((differ + 1 + spare, spare))
        self.low.append(high)

    def of(self, n: int) -> list[int]:
        """The band of size ``n`` and the lower bands that hold smaller partners of it."""
        while self.low[-1] <= n:
            self._grow()
        smallest = -(-n * self.percent // 100)
        top = int(np.searchsorted(self.low, n, side="right")) - 1
        found = [top]
        while found[-1] > 0 and self.low[found[-1]] > smallest:
            found.append(found[-1] - 1)
        return found


def signatures(hashes: np.ndarray, bands: Bands) -> np.ndarray:
    """Signatures of one sorted set of shingle hashes, in all its bands."""
    found = []
    with np.errstate(over="ignore"):
        content = mix(hashes ^ U64(0xA5A5A5A5A5A5A5A5))
        for band in bands.of(len(hashes)):
            parts, spare = bands.parts[band]
            part = ((hashes >> U64(32)) * U64(parts)) >> U64(32)
            starts = np.flatnonzero(np.diff(part, prepend=U64(parts)))
            salt = part[starts] * U64(0x9E3779B97F4A7C15) + U64(band + 1) * U64(0xD6E8FEB86659FD93)
            found.append(mix(np.add.reduceat(content, starts) + mix(salt)))
            if parts - len(starts) > spare:
                empty = np.setdiff1d(np.arange(parts, dtype=U64), part[starts])
                found.append(mix(mix(empty * U64(0x9E3779B97F4A7C15) + U64(band + 1)) + U64(0xE7037ED1A0B428DB)))
    return np.concatenate(found)


def bitmap(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bytes of the bitmap with a bit set for each hash."""
    flags = np.zeros(bits, dtype=np.uint8)
    flags[(hashes & U64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(flags)


def bitmap_bits(n: int) -> int:
    return max(64, 1 << (BITS_PER_SHINGLE * n - 1).bit_length())


def fold(bits: np.ndarray, length: int) -> np.ndarray:
    """The bitmap of the same set at a smaller power of two of bytes."""
    while len(bits) > length:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def overlap_bound(n: int, m: int, a: np.ndarray, b: np.ndarray) -> int:
    """An upper bound of the overlap: each bit set on one side only is an element the other lacks."""
    length = min(len(a), len(b))
    a, b = fold(a, length), fold(b, length)
    only_a = int(np.bitwise_count(a & ~b).sum())
    only_b = int(np.bitwise_count(b & ~a).sum())
    return min(n - only_a, m - only_b)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int(np.count_nonzero(b[at] == a))


def reaches(common: int, n: int, m: int, percent: int) -> bool:
    return 100 * common >= percent * (n + m - common)


def _describe(documents: DataFrame, words: int, percent: int) -> DataFrame:
    """Per document: set size, two sums that identify the set, and its signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in chain.from_iterable(map(slices, batches)):
            size, key_a, key_b, found = [], [], [], []
            for hashes in shingle_sets(text_bytes(batch["text"]), words):
                size.append(len(hashes))
                with np.errstate(over="ignore"):
                    key_a.append(hashes.sum(dtype=U64).astype(np.int64))
                    key_b.append(mix(hashes ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64).astype(np.int64))
                found.append(signatures(hashes, bands).view(np.int64) if len(hashes) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array(size, pa.int64()),
                    pa.array(key_a, pa.int64()),
                    pa.array(key_b, pa.int64()),
                    pa.ListArray.from_arrays(
                        pa.array(np.cumsum([0, *map(len, found)]), pa.int32()),
                        pa.array(np.concatenate(found) if found else np.empty(0, np.int64)),
                    ),
                ],
                ["doc_id", "n_shingles", "key_a", "key_b", "signatures"],
            )

    return bound_batches(documents).select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_shingles long, key_a long, key_b long, signatures array<long>"
    )


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows (signature, doc_id), the distinct ones whose signature occurs again, with the least document of each.

    A task's first and last signature may go on in the task before or after: their rows are kept whatever their number,
    and a row without doc_id tells the least document that this task has seen of each of the two.
    """
    names = ["signature", "doc_id", "least"]
    first, held = None, None  # the task's first signature; its last row so far, with the least of its signature and whether that repeats

    def rows(*columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    for batch in batches:
        sig, doc = (batch[i].to_numpy(zero_copy_only=False) for i in (0, 1))
        if not len(sig):
            continue
        if held is None:
            first = sig[0]
            yield rows([first], [None], [doc[0]])
        else:
            sig, doc = np.append(held[0], sig), np.append(held[1], doc)
        fresh = np.append(True, (sig[1:] != sig[:-1]) | (doc[1:] != doc[:-1]))
        sig, doc = sig[fresh], doc[fresh]
        starts = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
        counts = np.diff(np.append(starts, len(sig)))
        least, several = doc[starts], (counts > 1) | (sig[starts] == first)
        if held is not None:
            least[0], several[0] = held[2], several[0] or held[3]
        group = np.repeat(np.arange(len(starts)), counts)
        keep = several[group]
        keep[-1] = False  # told once the next row is seen
        yield rows(sig[keep], doc[keep], least[group][keep])
        held = sig[-1:], doc[-1:], least[-1], several[-1]
    if held is not None:
        yield rows([held[0][0]] * 2, [held[1][0], None], [held[2]] * 2)


def _sorted_sets(documents: DataFrame, words: int) -> DataFrame:
    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = list(shingle_sets(text_bytes(batch["text"]), words))
        return pa.RecordBatch.from_arrays(
            [
                batch["doc_id"],
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([bitmap(s, bitmap_bits(len(s))).tobytes() for s in sets], pa.binary()),
                pa.array([s.tobytes() for s in sets], pa.binary()),
            ],
            ["doc_id", "n", "bits", "hashes"],
        )

    return map_batches(documents, per_batch, "doc_id long, n long, bits binary, hashes binary")


def _both_sides(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    for side in ("u", "v"):
        own = sets.select(F.col("doc_id").alias(side), F.col("n").alias(f"n_{side}"), F.col(column).alias(f"{column}_{side}"))
        pairs = pairs.join(own, side)
    return pairs


def _filter_pairs(pairs: DataFrame, column: str, percent: int) -> DataFrame:
    """Pairs that may link by their bit counts (``bits``), or do by their sorted arrays (``hashes``)."""

    def holds(n: int, m: int, a: bytes, b: bytes) -> bool:
        if column == "bits":
            common = overlap_bound(n, m, np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8))
        else:
            common = overlap(np.frombuffer(a, U64), np.frombuffer(b, U64))
        return reaches(common, n, m, percent)

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = zip(*(batch[c].to_pylist() for c in ("n_u", "n_v", f"{column}_u", f"{column}_v")), strict=True)
        keep = pa.array([holds(*row) for row in rows], pa.bool_())
        return batch.select(["u", "v"]).filter(keep)

    return map_batches(pairs, per_batch, "u long, v long")


class _Joined:
    """Union-find over the component ids of one group of rows."""

    def __init__(self, ids: Iterable[int]):
        self.parent = {c: c for c in ids}

    def root(self, c: int) -> int:
        while self.parent[c] != c:
            self.parent[c] = self.parent[self.parent[c]]
            c = self.parent[c]
        return c

    def join(self, a: int, b: int) -> None:
        self.parent[max(a, b)] = min(a, b)


def _common_bits(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each pair of bitmaps of two lists, how many bits are set in both; bits are unpacked in slices."""
    both = np.zeros((len(left), len(right)), dtype=np.float32)
    for at in range(0, left.shape[1], SLICE_BITS // 8):
        a, b = (np.unpackbits(maps[:, at : at + SLICE_BITS // 8], axis=1).astype(np.float32) for maps in (left, right))
        both += a @ b.T
    return both


def _may_link(maps: np.ndarray, size: np.ndarray, group: pd.DataFrame, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of a pair of blocks, in different components, whose bit counts let them reach the threshold."""
    block, component = group["block"].to_numpy(), group["component"].to_numpy()
    left, right = int(group["i"].iloc[0]), int(group["j"].iloc[0])
    rows, cols = np.flatnonzero(block == left), np.flatnonzero(block == right)
    count = np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
    step = max(1, PAIRS_AT_ONCE // max(1, len(cols)))
    for at in range(0, len(rows), step):
        r = rows[at : at + step]
        both = _common_bits(maps[r], maps[cols])
        bound = np.minimum(size[r][:, None] - (count[r][:, None] - both), size[cols] - (count[cols] - both))
        may = (100 * bound >= percent * (size[r][:, None] + size[cols] - bound)) & (component[r][:, None] != component[cols])
        if left == right:
            may &= r[:, None] < cols
        for x, y in np.argwhere(may):
            yield int(r[x]), int(cols[y])


def _tile_bounds(percent: int):
    def bounds(group: pd.DataFrame) -> pd.DataFrame:
        """Components that the bit counts of a tile's pairs let link, as edges that span them."""
        maps = [np.frombuffer(b, np.uint8) for b in group["bits"]]
        width = min(map(len, maps))
        maps = np.stack([fold(m, width) for m in maps])
        component = group["component"].tolist()
        joined, found = _Joined(component), []
        for a, b in _may_link(maps, group["n"].to_numpy(), group, percent):
            ra, rb = joined.root(component[a]), joined.root(component[b])
            if ra != rb:
                joined.join(ra, rb)
                found.append((component[a], component[b]))
        return pd.DataFrame({"u": [a for a, _ in found], "v": [b for _, b in found]}, dtype="int64")

    return bounds


def _block_links(percent: int):
    def links(group: pd.DataFrame) -> pd.DataFrame:
        """Links of a pair of blocks that join members of different components; found components are joined at once."""
        sets = [np.frombuffer(h, U64) for h in group["hashes"]]
        size = group["n"].to_numpy()
        bits = max(1 << 10, bitmap_bits(4 * int(np.median(size))))
        maps = np.stack([bitmap(s, bits) for s in sets])
        component = group["component"].tolist()
        joined, found = _Joined(component), []
        for a, b in _may_link(maps, size, group, percent):
            ra, rb = joined.root(component[a]), joined.root(component[b])
            if ra != rb and reaches(overlap(sets[a], sets[b]), int(size[a]), int(size[b]), percent):
                joined.join(ra, rb)
                found.append((a, b))
        ids = group["doc_id"].to_numpy()
        return pd.DataFrame({"u": [ids[a] for a, _ in found], "v": [ids[b] for _, b in found]}, dtype="int64")

    return links


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets at the places ``left`` with those at ``right``."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1  # a shingle of one set alone is in no intersection of two
    row, column = row[shared[column]], (np.cumsum(shared) - 1)[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(left), len(right)), dtype=np.int64)
    columns = int(shared.sum())
    for at in range(0, columns, SLICE_SHINGLES):
        own = slice(*np.searchsorted(column, [at, at + SLICE_SHINGLES]))
        flags = np.zeros((len(sets), min(SLICE_SHINGLES, columns - at)), dtype=np.float32)
        flags[row[own], column[own] - at] = 1
        total += (flags[left] @ flags[right].T).astype(np.int64)
    return total


def _all_links(group: pd.DataFrame, percent: int) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """The members of a pair of blocks, each once, and the places of both sides of all their links."""
    group = group.drop_duplicates("doc_id", ignore_index=True)
    block, size = group["block"].to_numpy(), group["n"].to_numpy()
    left, right = (np.flatnonzero(block == group[side].iloc[0]) for side in ("i", "j"))
    common = _common([np.frombuffer(h, U64) for h in group["hashes"]], left, right)
    linked = 100 * common >= percent * (size[left][:, None] + size[right] - common)
    if group["i"].iloc[0] == group["j"].iloc[0]:
        linked = np.triu(linked, 1)
    x, y = np.nonzero(linked)
    return group, left[x], right[y]


def _listed_links(percent: int):
    def links(group: pd.DataFrame) -> pd.DataFrame:
        group, a, b = _all_links(group, percent)
        ids = group["doc_id"].to_numpy()
        return pd.DataFrame({"u": np.minimum(ids[a], ids[b]), "v": np.maximum(ids[a], ids[b])}, dtype="int64")

    return links


def _counted_links(percent: int):
    def counts(group: pd.DataFrame) -> pd.DataFrame:
        """For each set, the documents that the sets of this pair of blocks link it with."""
        group, a, b = _all_links(group, percent)
        copies = group["copies"].to_numpy()
        found = np.zeros(len(group), dtype=np.int64)
        np.add.at(found, a, copies[b])
        np.add.at(found, b, copies[a])
        return pd.DataFrame({"set_id": group["doc_id"], "linked": found})

    return counts


def _in_blocks(members: DataFrame, key: str, blocks: Column) -> DataFrame:
    """Rows of each group of ``key`` dealt into blocks, once for each pair of blocks (i, j) that they take part in."""
    counted = members.groupBy(key).agg(F.greatest(blocks, F.lit(1)).cast("long").alias("blocks"))
    dealt = members.join(counted, key).withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))


def _cluster_blocks() -> Column:
    return F.greatest(F.ceil(F.count("*") / BLOCK_MEMBERS), F.ceil(F.sum(F.col("n") * 8) / BLOCK_ARRAY_BYTES))


def _open_links(tiles: DataFrame, members: DataFrame, joined: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links between different components within the ``tiles`` that still hold several beside the member compared first."""
    labels = members.join(joined.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    labels = labels.select("doc_id", F.coalesce("component_id", "doc_id").alias("component"))
    labelled = tiles.select("signature", "doc_id").join(labels, "doc_id")
    spread = labelled.groupBy("signature").agg(
        F.min("component").alias("a"), F.max("component").alias("b"),
        F.count("*").alias("members"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("content"),
    ).filter("a <> b")
    # Of tiles with the very same members one is enough.
    one = spread.groupBy("members", "content").agg(F.min("signature").alias("signature")).select("signature")
    opened = scratch.write(labelled.join(one, "signature", "left_semi"), "open-tiles")
    mapped = opened.join(sets.select("doc_id", "n", "bits"), "doc_id")
    tile_blocks = _in_blocks(mapped, "signature", F.ceil(F.count("*") / TILE_MEMBERS))
    near = tile_blocks.groupBy("signature", "i", "j").applyInPandas(_tile_bounds(percent), "u long, v long")
    # Components that may link form clusters; in these every set is carried once, not once a tile.
    cluster = components(near).withColumnRenamed("id", "component").withColumnRenamed("component_id", "cluster")
    members = opened.select("doc_id", "component").distinct().join(cluster, "component")
    members = scratch.write(members.join(sets.select("doc_id", "n", "hashes"), "doc_id"), "open-members")
    dealt = _in_blocks(members, "cluster", _cluster_blocks())
    return dealt.groupBy("cluster", "i", "j").applyInPandas(_block_links(percent), "u long, v long")


def _join(documents: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The set of each document (doc_id, n_shingles, set_id), the components of linked sets (id, component_id), sorted arrays."""
    scratch = Scratch(documents.sparkSession)
    described = scratch.write(_describe(documents, words, percent), "described")
    sets = described.filter("n_shingles > 0").groupBy("key_a", "key_b").agg(F.min("doc_id").alias("set_id"))
    of_set = materialize(
        described.select("doc_id", "n_shingles", "key_a", "key_b").join(sets, ["key_a", "key_b"], "left")
        .select("doc_id", "n_shingles", F.coalesce("set_id", "doc_id").alias("set_id")).distinct(),
        "sets",
    )
    rows = described.filter("doc_id is not null").select(F.explode("signatures").alias("signature"), "doc_id")
    ordered = rows.repartitionByRange("signature", "doc_id").sortWithinPartitions("signature", "doc_id")
    tiles = scratch.write(ordered.mapInArrow(_repeated, "signature long, doc_id long, least long"), "tiles")
    scratch.drop("described")
    # Two rows a task at most, for signatures that several tasks hold.
    split = tiles.filter("doc_id is null").groupBy("signature").agg(F.min("least").alias("over"))
    tiles = tiles.filter("doc_id is not null").join(F.broadcast(split), "signature", "left")
    tiles = tiles.select("signature", "doc_id", F.coalesce("over", "least").alias("least")).filter("doc_id <> least")
    # Documents with the very same set are one member, the least of them; that of a tile is such a one.
    members = of_set.filter("doc_id = set_id").select("doc_id")
    pairs = tiles.select(F.col("doc_id").alias("u"), F.col("least").alias("v")).distinct()
    pairs = scratch.write(pairs.join(members.withColumnRenamed("doc_id", "u"), "u", "left_semi").select("u", "v"), "tile-pairs")
    needed = pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct()
    # Their number has no bound, so this join is a merge at every size.
    texts = documents.select(F.col("doc_id").cast("long"), "text").join(needed.hint("merge"), "doc_id", "left_semi")
    arrays = materialize(_sorted_sets(texts, words), "sorted-sets")
    scratch.drop()  # the shuffled texts

    pairs = _filter_pairs(_both_sides(pairs, arrays, "bits"), "bits", percent)
    links = materialize(_filter_pairs(_both_sides(pairs, arrays, "hashes"), "hashes", percent), "links")
    joined = components(links)
    scratch.drop("tile-pairs")
    more = materialize(_open_links(tiles, members, joined, arrays, percent, scratch), "links")
    scratch.drop("tiles", "open-tiles", "open-members")
    return of_set, components(links.unionByName(more)), arrays


def _groups(of_set: DataFrame, joined: DataFrame) -> DataFrame:
    return of_set.join(joined.withColumnRenamed("id", "set_id"), "set_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "set_id").alias("component_id"), "set_id"
    )


def _component_blocks(joined: DataFrame, arrays: DataFrame) -> DataFrame:
    """The sets of each component in pairs of blocks."""
    members = joined.select(F.col("id").alias("doc_id"), "component_id").join(arrays.select("doc_id", "n", "hashes"), "doc_id")
    return _in_blocks(members, "component_id", _cluster_blocks())


def jaccard_groups(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, set_id.

    Two documents link when the Jaccard similarity of their sets of ``words``-word shingles is at least ``percent`` %.
    ``component_id`` is the least doc_id reachable by links, ``set_id`` the least doc_id with the very same set.
    ``documents`` needs ``doc_id`` and ``text``; other columns are ignored. A null text, or one without words, has an empty
    set and links with nothing. Repeated rows of one doc_id count once. A row without doc_id gets the group of documents
    with its very set, if any, and joins no other. An empty table gives an empty result.
    """
    of_set, joined, _ = _join(documents, words, percent)
    return _groups(of_set, joined)


def jaccard_counts(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of :func:`jaccard_groups` with n_links: with how many other documents the document links.

    Documents with the very same set link with each other. A row without doc_id links with the documents that have its
    set and those that link with it; where no document with an id has its set, ``n_links`` is null.
    """
    of_set, joined, arrays = _join(documents, words, percent)
    full = of_set.filter("n_shingles > 0 and doc_id is not null")
    copies = materialize(full.groupBy("set_id").agg(F.count("*").alias("copies")), "copies")
    blocks = _component_blocks(joined, arrays).join(copies.withColumnRenamed("set_id", "doc_id"), "doc_id")
    counted = blocks.groupBy("component_id", "i", "j").applyInPandas(_counted_links(percent), "set_id long, linked long")
    linked = counted.groupBy("set_id").agg(F.sum("linked").alias("linked"))
    others = F.col("copies") - F.col("doc_id").isNotNull().cast("long") + F.coalesce("linked", F.lit(0))
    n_links = F.when(F.col("n_shingles") == 0, F.lit(0)).otherwise(others).cast("long").alias("n_links")
    rows = _groups(of_set, joined).join(copies.join(linked, "set_id", "left"), "set_id", "left")
    return rows.select("doc_id", "n_shingles", "component_id", "set_id", n_links)


def jaccard_links(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """All links between different sets: one row (u, v) per pair of linked set_ids, u < v.

    Two documents link if they have one set_id or if their set_ids are listed. A large component of close texts has as
    many rows as it has pairs.
    """
    _, joined, arrays = _join(documents, words, percent)
    return _component_blocks(joined, arrays).groupBy("component_id", "i", "j").applyInPandas(_listed_links(percent), "u long, v long")
