"""SimHash near-dedup with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. The binary Golay code of length 23 is
perfect: every 23-bit word lies within distance 3 of exactly one codeword. The *fuzzy keys* of a segment
are the codewords to which it and its 23 one-bit neighbours decode, one or six of them. Two segments at
distance two or less have a common neighbour and so share a fuzzy key.

Three differing bits fall on the segments (a, b, c) in few ways, and one of these keys is always shared:

====================  =========================================  ============
errors                key                                        bits
====================  =========================================  ============
b = c = 0             B and C themselves                         41
a = 0, b at most 2    A itself, fuzzy B                          35
b = 0, a at most 2    B itself, fuzzy A                          35
c = 0, a at most 2    C itself, fuzzy A                          30
a = b = c = 1         fuzzy A, one half of B, one half of C      33 or 32
====================  =========================================  ============

That is 17 or 38 keys for most fingerprints. Fingerprints that share a key are verified bit by bit.
Only distinct fingerprints are keyed, so copies cost nothing, and a bucket gives the edges of a spanning
forest, not its pairs. A bucket of more than ``block`` fingerprints is dealt out as pairs of blocks.

Words are bytes between ASCII white space of the text with A-Z lower-cased. Null texts are empty; texts
without words have fingerprint zero and are linked like any other. Long texts are hashed in pieces.
Null ids form no representative of their own (the smallest id of a component skips them). Repeated rows
get a row each. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from logvigil.llm.common import checkpointed, components, partitions, texts, whole_groups

GOLAY = 0b110001110101  # generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
_PIECE = 1 << 16


def fingerprint(text: str, k: int = 3) -> int:
    """SimHash of the k-word shingles of a text, as an unsigned integer."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= k:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)  # more than half of one hash's bits: itself
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1].tolist()
    ends = ends[k - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), _PIECE):
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts[at : at + _PIECE], ends[at : at + _PIECE])], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = 3) -> DataFrame:
    """``doc_id, fp`` (a signed long with the fingerprint's bits), one row per document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t, k) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["doc_id", "fp"])

    source = texts(docs, id, text)
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fp long")


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits, and the error pattern that belongs to a syndrome."""
    def syndrome(word: np.ndarray) -> np.ndarray:
        for bit in range(22, 10, -1):
            word = np.where(word >> bit & 1, word ^ (GOLAY << (bit - 11)), word)
        return word

    bits = 1 << np.arange(23)
    patterns = [np.zeros(1, np.int64), bits, np.array([bits[i] | bits[j] for i in range(23) for j in range(i)]),
                np.array([bits[i] | bits[j] | bits[k] for i in range(23) for j in range(i) for k in range(j)])]
    patterns = np.concatenate(patterns).astype(np.int64)
    error = np.zeros(1 << 11, np.int64)
    error[syndrome(patterns)] = patterns
    return syndrome(np.arange(1 << 12)), syndrome(np.arange(1 << 11) << 12), error


def codeword_index(word: np.ndarray) -> np.ndarray:
    """Number of the codeword nearest to each 23-bit word: its upper twelve bits identify it."""
    low, high, error = _tables()
    return (word ^ error[low[word & 0xFFF] ^ high[word >> 12]]) >> 11


def fuzzy_keys(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, codeword index) of every distinct fuzzy key of each segment."""
    flips = np.concatenate(([0], 1 << np.arange(23)))
    found = np.sort(codeword_index(segment[:, None] ^ flips[None, :]), axis=1)
    new = np.ones(found.shape, bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    return np.nonzero(new)[0], found[new]


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, 64-bit key) of every key of each unsigned fingerprint; the top bits name the kind of key."""
    fps = fps.astype(np.uint64)
    a = (fps >> np.uint64(41)).astype(np.int64)
    b = (fps >> np.uint64(18) & np.uint64(0x7FFFFF)).astype(np.int64)
    c = (fps & np.uint64(0x3FFFF)).astype(np.int64)
    every = np.arange(len(fps))
    (in_a, fuzzy_a), (in_b, fuzzy_b) = fuzzy_keys(a), fuzzy_keys(b)
    rows = [every, in_b, in_a, in_a]
    keys = [b << 18 | c, a[in_b] << 12 | fuzzy_b, b[in_a] << 12 | fuzzy_a, c[in_a] << 12 | fuzzy_a]
    for half_b in (b >> 12, 1 << 12 | b & 0xFFF):
        for half_c in (c >> 9, 1 << 9 | c & 0x1FF):
            rows.append(in_a)
            keys.append((half_b[in_a] << 10 | half_c[in_a]) << 12 | fuzzy_a)
    kinds = [0, 1, 2, 3, 4, 5, 6, 7]
    return np.concatenate(rows), np.concatenate([key | kind << 56 for key, kind in zip(keys, kinds)])


def forest(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Edges that join everything linked at ``bits`` or fewer among distinct fingerprints."""
    left, edges = fps, []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            node = queue.pop()
            near = np.bitwise_count(left ^ node) <= bits
            if near.any():
                edges += [(node, other) for other in left[near]]
                queue += list(left[near])
                left = left[~near]
    return edges


def links(fps: DataFrame, bits: int = 3, block: int = 8192) -> DataFrame:
    """Edges ``a, b`` between distinct fingerprints (column ``fp``) that join all at 3 or fewer differing bits."""
    if bits > 3:
        raise ValueError("the keys find up to three differing bits")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.column(0).slice(at, 4096).to_numpy(zero_copy_only=False)
                rows, keys = keys_of(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], names=["key", "fp"])

    def out(a: np.ndarray, b: np.ndarray, block_no: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.full(len(a), block_no, np.int32))], names=["a", "b", "block"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Edges of each bucket; the rows of a bucket above ``block``, with a block number, for the next step."""
        held_key, held, given = None, [], 0

        def close() -> pa.RecordBatch | None:
            mine = np.concatenate(held) if held else np.empty(0, np.int64)
            if given:
                return out(np.full(len(mine), held_key), mine, given - 1)
            found = forest(mine, bits)
            return out(*np.array(found, np.int64).reshape(-1, 2).T, -1) if found else None

        for batch in batches:
            keys, fps_ = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            cuts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
            sizes = np.diff(cuts)
            inner = np.arange(1, len(sizes) - 1)
            twos = cuts[inner[sizes[inner] == 2]]
            twos = twos[np.bitwise_count(fps_[twos] ^ fps_[twos + 1]) <= bits]
            if len(twos):
                yield out(fps_[twos], fps_[twos + 1], -1)
            for g in [0, *inner[sizes[inner] > 2].tolist(), *([len(sizes) - 1] if len(sizes) > 1 else [])]:
                a, b = cuts[g], cuts[g + 1]
                if keys[a] != held_key:
                    if held and (done := close()):
                        yield done
                    held_key, held, given = keys[a], [], 0
                for at in range(a, b, block):
                    held.append(fps_[at : min(b, at + block)].copy())
                    if sum(map(len, held)) > block:
                        given += 1
                        yield out(np.full(sum(map(len, held)), held_key), np.concatenate(held), given - 1)
                        held = []
        if held and (done := close()):
            yield done

    def pairs_of_blocks(rows):
        import pandas as pd

        found = forest(np.unique(rows["b"].to_numpy()), bits)
        return pd.DataFrame(np.array(found, np.int64).reshape(-1, 2), columns=["a", "b"])

    count = partitions(fps.sparkSession)
    keys = fps.select("fp").mapInArrow(keyed, "key long, fp long")
    found = checkpointed(
        keys.repartition(count, "key").sortWithinPartitions("key").mapInArrow(verified, "a long, b long, block int")
    )
    edges, large = found.filter("block < 0").select("a", "b"), found.filter("block >= 0")
    if not large.isEmpty():
        last = large.groupBy("a").agg(F.max("block").alias("last"))
        dealt = large.join(last, "a").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
        dealt = dealt.select("a", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "b")
        edges = edges.union(dealt.groupBy("a", "i", "j").applyInPandas(pairs_of_blocks, "a long, b long"))
    return edges.distinct()


def near_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = 3, bits: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` per document: the smallest id reachable over links."""
    prints = checkpointed(fingerprints(docs, id, text, k))
    distinct = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct, bits))
    members = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = members.groupBy("root").agg(F.min("least").alias("component_id"))
    class_of = members.join(named, "root").select("fp", "component_id")
    return prints.join(class_of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = 3, bits: int = 3) -> DataFrame:
    """The documents with one of each group: the smallest id stays, with the columns it came with.

    Rows that repeat an id and its text are one document; of rows that repeat an id with other texts all stay where
    the id does. Rows without an id stay: nothing names them.
    """
    stay = near_groups(docs.filter(F.col(id).isNotNull()), id, text, k, bits).filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_stay")).distinct()
    named = docs.join(stay, F.col(id) == F.col("_stay"), "left_semi").withColumn("_text", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    return named.dropDuplicates([id, "_text"]).drop("_text").union(docs.filter(F.col(id).isNull()))
