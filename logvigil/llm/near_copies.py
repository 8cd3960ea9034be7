"""Near copies by wide SimHash fingerprints and fuzzy Golay keys: texts whose word shingles are alike to 0.8 or more.

A 64-bit fingerprint cannot tell a similarity of 0.8 from one of 0.6, and its three bits of tolerance find next to
nothing below 0.98. So the fingerprint of a text's distinct five-word shingles has 512 bits here:

1. Bits of two texts differ with a chance of ``acos(c) / pi``, where ``c`` is ``2 s / (1 + s)`` for shingle sets
   of like size and similarity ``s``: 78 of 512 at 0.8, with a standard deviation of eight bits.
2. ``segments`` runs of 23 bits are decoded to the Golay codewords near them, about six for each. A key is such a
   codeword with ``extra`` further bits and the class of the number of shingles: sizes of texts that similar differ
   by a quarter at most, and classes overlap by as much. At 0.8 two texts share a key of one segment with a chance
   of 0.44, one of six with 0.97; at 0.9 with more than 0.999.
3. Fingerprints that share a key are compared bit by bit. A bucket gives the edges of its minimum spanning forest
   up to two deviations above the expected number, not its pairs; a bucket above ``block`` rows is dealt out as
   pairs of blocks. Edges of two deviations below are links; the others are links if the shingle sets of the two
   whole texts say so. The shortest edges are those most likely to hold, so that checking them loses few links.

Equal fingerprints are merged first, so copies cost nothing. Each ``extra`` bit halves the buckets; a corpus many
times larger takes more of them, and more ``segments`` to find as much.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, log, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from logvigil.llm.common import checkpointed, components, partitions, texts
from logvigil.llm.simhash import fuzzy_keys

WORDS = 8
FP = [f"f{i}" for i in range(WORDS)]
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SUM = 255  # as many bits as a byte can count
_SMALL = 128  # buckets below are looked at together for links; most have none


def _mixed(codes: np.ndarray) -> np.ndarray:
    codes = (codes ^ codes >> np.uint64(32)) * _MIX
    return codes ^ codes >> np.uint64(29)


class Codes(dict):
    """Hashes of words, each computed once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 19:  # bounds the memory of a task
            self.clear()
        code = self[word] = xxhash.xxh64_intdigest(word)
        return code


_CODES = Codes()


def shingles(text: str, k: int) -> np.ndarray:
    """Distinct 64-bit hashes of the runs of k words; of the whole sequence where it is shorter."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    codes = np.fromiter(map(_CODES.__getitem__, words), np.uint64, len(words))
    if not words:
        return codes
    k = min(k, len(codes))
    rolled = np.zeros(len(codes) - k + 1, np.uint64)
    for i in range(k):
        rolled = _mixed(rolled + codes[i : i + len(rolled)])
    rolled.sort()
    return rolled[np.concatenate(([True], rolled[1:] != rolled[:-1]))]


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """``WORDS`` unsigned 64-bit integers: a bit is set if it is in over half of the hashes, mixed anew for each integer."""
    out = np.zeros(WORDS, np.uint64)
    padding = np.zeros(-len(hashes) % _SUM, np.uint64)
    for i, salt in enumerate(np.arange(WORDS, dtype=np.uint64) * _MIX if len(hashes) else ()):
        row = np.concatenate((_mixed(hashes + salt), padding))
        counts = np.zeros(64, np.int64)
        for at in range(0, len(row), _SUM * 256):
            bits = np.unpackbits(row[at : at + _SUM * 256].view(np.uint8), bitorder="little").reshape(-1, _SUM, 64)
            counts += bits.sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0]
    return out


def wide_fingerprints(docs: DataFrame, id: str, text: str, k: int) -> DataFrame:
    """``doc_id, n, f0 ...``: number of distinct shingles and the fingerprint, for each document with an id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, prints = [], np.zeros((batch.num_rows, WORDS), np.uint64)
            for i, value in enumerate(batch.column(1).to_pylist()):
                found = shingles(value, k)
                sizes.append(len(found))
                prints[i] = wide_fingerprint(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *map(pa.array, prints.view(np.int64).T)], names=["doc_id", "n", *FP])

    rows = texts(docs, id, text).filter("doc_id IS NOT NULL").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return rows.mapInArrow(run, f"doc_id long, n long, {', '.join(f + ' long' for f in FP)}")


def limits(similarity: float) -> tuple[int, int]:
    """Differing bits: up to the first two texts are surely as similar, above the second surely not (two standard deviations)."""
    chance, bits = acos(2 * similarity / (1 + similarity)) / pi, 64 * WORDS
    spread = sqrt(bits * chance * (1 - chance))
    return int(bits * chance - 2 * spread), int(bits * chance + 2 * spread)


def size_classes(sizes: np.ndarray, similarity: float, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(row, class): two sizes with a ratio of at least ``similarity`` have a class in common."""
    scale = np.log(np.maximum(sizes, 1)) / -log(similarity)
    own = (scale // width).astype(np.int64)
    also = np.flatnonzero(scale - own * width <= 1 + 1e-9)
    return np.concatenate((np.arange(len(sizes)), also)), np.concatenate((own + 1, own[also]))


def keys_of(sizes: np.ndarray, prints: np.ndarray, similarity: float, segments: int, extra: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every key of each fingerprint (rows of ``WORDS`` unsigned integers)."""
    if segments * (23 + extra) > 64 * WORDS:
        raise ValueError("the segments do not fit in the fingerprint")
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8), axis=1, bitorder="little")
    member, kind = size_classes(sizes, similarity)
    order = np.argsort(member, kind="stable")
    member, kind = member[order], kind[order]
    first, many = np.searchsorted(member, np.arange(len(sizes))), np.bincount(member, minlength=len(sizes))
    rows, keys = [], []
    for i in range(segments):
        at = i * (23 + extra)
        segment = bits[:, at : at + 23].astype(np.int64) @ (1 << np.arange(23))
        more = bits[:, at + 23 : at + 23 + extra].astype(np.int64) @ (1 << np.arange(extra))
        row, code = fuzzy_keys(segment)
        code = (np.int64(i) << 16 + extra | more[row]) << 12 | code
        again = np.repeat(np.arange(len(row)), many[row])  # once for each class of the row
        step = np.arange(len(again)) - np.repeat(np.cumsum(many[row]) - many[row], many[row])
        rows.append(row[again])
        keys.append(code[again] | kind[first[row[again]] + step] << 12 + extra)
    return np.concatenate(rows), np.concatenate(keys)


def linked(keys: np.ndarray, prints: np.ndarray, limit: int) -> np.ndarray:
    """Which rows, sorted by key, have a row of the same key behind them with ``limit`` or fewer differing bits."""
    out = np.zeros(len(keys), bool)
    for step in range(1, min(len(keys), _SMALL)):
        same = np.flatnonzero(keys[step:] == keys[:-step])
        if not len(same):
            break
        out[same[np.bitwise_count(prints[same] ^ prints[same + step]).sum(axis=1) <= limit]] = True
    return out


def forest(prints: np.ndarray, limit: int) -> list[tuple[int, int, int]]:
    """(row number, row number, differing bits): the minimum spanning forest of all links of ``limit`` or fewer bits."""
    left, edges = np.arange(len(prints)), []
    while len(left) > 1:
        node, left = left[0], left[1:]
        least, by = np.full(len(left), limit + 1), np.full(len(left), node)
        while len(left):
            bits = np.bitwise_count(prints[left] ^ prints[node]).sum(axis=1, dtype=np.int64)
            by[bits < least] = node
            np.minimum(least, bits, out=least)
            at = int(least.argmin())
            if least[at] > limit:
                break
            node = left[at]
            edges.append((by[at], node, least[at]))
            left, least, by = (np.delete(x, at) for x in (left, least, by))
    return edges


def links(prints: DataFrame, similarity: float, segments: int, extra: int, block: int) -> DataFrame:
    """Edges ``a, b`` with their ``bits`` between documents of different fingerprints, up to the second of the limits."""
    limit = limits(similarity)[1]
    both = ["key long", "block int", "a long", "b long", "bits int", *(f + " long" for f in FP)]
    names = [x.split()[0] for x in both]

    def matrix(batch) -> np.ndarray:
        return np.stack([batch.column(f).to_numpy() for f in FP], axis=1).view(np.uint64)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                rows, keys = keys_of(part.column("n").to_numpy(), matrix(part), similarity, segments, extra)
                dealt = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(keys), dealt.column("doc_id"), *(dealt.column(f) for f in FP)], names=["key", "doc_id", *FP])

    def edges_of(ids: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = np.array(forest(prints, limit), np.int64).reshape(-1, 3)
        a, b = ids[found[:, 0]], ids[found[:, 1]]
        return np.minimum(a, b), np.maximum(a, b), found[:, 2].astype(np.int32)

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Edges of each bucket (block -1); the rows of a bucket above ``block``, numbered, for the next step."""
        key, ids, prints, given = None, [], [], 0
        done: list[tuple[np.ndarray, ...]] = []

        def rows_out() -> pa.RecordBatch:
            mine, theirs = np.concatenate(ids), np.concatenate(prints).view(np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(mine), key)), pa.array(np.full(len(mine), given, np.int32)), pa.array(mine), pa.nulls(len(mine), pa.int64()), pa.nulls(len(mine), pa.int32()), *map(pa.array, theirs.T)], names=names)

        def edges_out() -> Iterator[pa.RecordBatch]:
            if done:
                a, b, bits = (np.concatenate(x) for x in zip(*done))
                none = pa.nulls(len(a), pa.int64())
                yield pa.RecordBatch.from_arrays([none, pa.array(np.full(len(a), -1, np.int32)), pa.array(a), pa.array(b), pa.array(bits), *[none] * WORDS], names=names)
                done.clear()

        for batch in batches:
            keys, mine, theirs = batch.column("key").to_numpy(), batch.column("doc_id").to_numpy(), matrix(batch)
            cuts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)])) if len(keys) else np.zeros(1, np.int64)
            sizes = np.diff(cuts)
            # The first and the last bucket may go on in other batches.
            chosen = (np.add.reduceat(linked(keys, theirs, limit), cuts[:-1]) > 0) | (sizes >= _SMALL) if len(keys) else np.zeros(0, bool)
            chosen[:1] = chosen[-1:] = True
            for g in np.flatnonzero(chosen):
                a, b = cuts[g], cuts[g + 1]
                if keys[a] != key:
                    if given:
                        yield rows_out()
                    elif sum(map(len, ids)) > 1:
                        done.append(edges_of(np.concatenate(ids), np.concatenate(prints)))
                    key, ids, prints, given = keys[a], [], [], 0
                for at in range(a, b, block):
                    if ids and sum(map(len, ids)) + min(b - at, block) > block:
                        yield rows_out()
                        ids, prints, given = [], [], given + 1
                    ids.append(mine[at : min(b, at + block)].copy())
                    prints.append(theirs[at : min(b, at + block)].copy())
            yield from edges_out()
        if given:
            yield rows_out()
        elif sum(map(len, ids)) > 1:
            done.append(edges_of(np.concatenate(ids), np.concatenate(prints)))
        yield from edges_out()

    def pairs_of_blocks(rows):
        import pandas as pd

        rows = rows.drop_duplicates("id")
        a, b, bits = edges_of(rows["id"].to_numpy(), np.ascontiguousarray(rows[FP].to_numpy()).view(np.uint64))
        return pd.DataFrame({"a": a, "b": b, "bits": bits})

    count = partitions(prints.sparkSession)
    keys = prints.mapInArrow(keyed, f"key long, doc_id long, {', '.join(f + ' long' for f in FP)}")
    found = checkpointed(keys.repartition(count, "key").sortWithinPartitions("key").mapInArrow(verified, ", ".join(both)))
    edges, large = found.filter("block < 0").select("a", "b", "bits"), found.filter("block >= 0")
    if not large.isEmpty():
        last = large.groupBy("key").agg(F.max("block").alias("last"))
        dealt = large.join(last, "key").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
        dealt = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.col("a").alias("id"), *FP)
        edges = edges.union(dealt.groupBy("key", "i", "j").applyInPandas(pairs_of_blocks, "a long, b long, bits int"))
    return edges.distinct()


def compared(edges: DataFrame, docs: DataFrame, id: str, text: str, k: int, similarity: float) -> DataFrame:
    """The edges ``a, b`` whose whole texts have the similarity: shared shingles over all shingles of both."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            keep = []
            for a, mine, theirs in zip(*(batch.column(c).to_pylist() for c in ("a", "mine", "theirs"))):
                if (a, mine) != last:
                    last, held = (a, mine), shingles(mine, k)
                other = shingles(theirs, k)
                both = len(np.intersect1d(held, other, assume_unique=True))
                keep.append(both >= similarity * (len(held) + len(other) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    rows = texts(docs, id, text).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    side = lambda key, name: rows.select(F.col("doc_id").alias(key), F.col("text").alias(name))
    return edges.join(side("b", "theirs"), "b").join(side("a", "mine"), "a").select("a", "b", "mine", "theirs").mapInArrow(run, "a long, b long")


def similar_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = 5, similarity: float = 0.8,
                   segments: int = 6, extra: int = 2, block: int = 4096) -> DataFrame:
    """``doc_id, component_id`` per document with an id: the smallest id reachable over links.

    Words are bytes between ASCII white space with A-Z lower-cased. Null texts are empty; texts without words are
    one group. Ids are integers; rows without one take no part, and rows that repeat one are the same document.
    An empty table gives an empty result.
    """
    prints = checkpointed(wide_fingerprints(docs, id, text, k))
    # Equal fingerprints with other sizes are other texts (one repeats itself), but as alike as can be.
    distinct = checkpointed(prints.groupBy(*FP).agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n")))
    edges, sure = checkpointed(links(distinct, similarity, segments, extra, block)), limits(similarity)[0]
    doubtful = compared(edges.filter(F.col("bits") > sure).select("a", "b"), docs, id, text, k, similarity)
    roots = components(edges.filter(F.col("bits") <= sure).select("a", "b").union(doubtful))
    named = distinct.join(roots, distinct["doc_id"] == roots["node"], "left").select(*FP, F.coalesce("root", "doc_id").alias("component_id"))
    return prints.join(named, FP).select("doc_id", "component_id")


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents with one of each group: the smallest id stays, with the columns it came with.

    Rows that repeat an id and its text are one document; of rows that repeat an id with other texts all stay where
    the id does. Rows without an id stay: nothing names them.
    """
    groups = similar_groups(docs, id, text, **options)
    stay = groups.filter("doc_id = component_id").select(F.col("doc_id").alias("_stay")).distinct()
    named = docs.join(stay, F.col(id) == F.col("_stay"), "left_semi").withColumn("_text", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    return named.dropDuplicates([id, "_text"]).drop("_text").union(docs.filter(F.col(id).isNull()))
