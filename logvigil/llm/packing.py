"""Lexical retrieval packing: BM25 neighbours fill the window of a seed document.

1. Documents are tokenized once; ids go to the shared folder as 16-bit integers.
2. Document frequencies of the terms (token ids) are summed over all documents: one figure per entry of
   the vocabulary, which bounds what the driver holds and sends to tasks.
3. Documents are sorted by two min-hashes of their rarest terms, so that lexical neighbours lie close
   together however many shards there are, and range-partitioned. A byte-pair vocabulary numbers its merges
   by falling frequency, so the terms of the highest ids stand for the rarest and are known at once. A task cuts what it reads into shards
   of about ``shard_tokens`` tokens, in order. A shard is one inverted index with BM25 weights of the whole
   corpus's frequencies; it is packed by itself, and is all that a task holds.
4. Windows of a document that it fills alone are cut first. Then the rest of the next unused document is
   the seed; its highest-weighted terms are looked up, and the best unused documents fill the window. The
   last of them is cut where the window is full, and what is left of it is the next seed.

So every window of a shard is full but its last. A document longer than a shard is a shard's content like
any other; its windows are slices, not copies. Copies and repeated rows have one key and fill as many shards
as they need, so no group of them is one task's or held whole.

Null texts are empty; an empty text has the end id only. Documents that share no term are packed in id
order. A null id is kept and sorted first. Rows that repeat are packed each. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from logvigil.llm.common import texts, written
from logvigil.llm.vocab import ByteEncoder, Encoder, encoder_for

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder | ByteEncoder:
    return encoder_for(path)


_HASH = np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_HASH = (((_HASH ^ (_HASH >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(1)).astype(np.int64)
_TOKENS = ["doc_id", "n_tokens", "ids", "near", "next", "df"]


def tokenized(docs: DataFrame, path: str, end: int, id: str = "doc_id", text: str = "text", batch: int = 256, rarest: int = 6) -> DataFrame:
    """``doc_id, n_tokens, ids`` (16-bit little-endian, with the end id), the two smallest hashes of the ``rarest``
    terms in ``near`` and ``next``, and per task one row of document frequencies in ``df``."""
    closing = np.array([end], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        seen = np.zeros(1 << 16, np.int64)
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                ids = [x + closing for x in model.encode(part.column(1).to_pylist())]
                near = np.full((len(ids), 2), -1, np.int64)
                for i, x in enumerate(ids):
                    terms = np.sort(np.frombuffer(x, "<u2"), kind="stable")
                    terms = terms[np.concatenate(([True], terms[1:] != terms[:-1]))]
                    seen[terms] += 1
                    least = np.sort(_HASH[terms[-rarest:]])[:2]
                    near[i, : len(least)] = least
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary()),
                     pa.array(near[:, 0]), pa.array(near[:, 1]), pa.nulls(len(ids), pa.list_(pa.int64()))], names=_TOKENS)
        if seen.any():
            nothing = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*nothing, pa.array([seen.tolist()], pa.list_(pa.int64()))], names=_TOKENS)

    source = texts(docs, id, text).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return source.mapInArrow(run, "doc_id long, n_tokens long, ids binary, near long, next long, df array<long>")


def frequencies(tokens: DataFrame) -> np.ndarray:
    """Documents that hold each token id: at most 65,536 figures."""
    rows = tokens.filter("df IS NOT NULL").select(F.posexplode("df").alias("term", "n")).filter("n > 0").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(1 << 16, np.int64)
    for term, n in rows:
        out[term] = n
    return out


def _slices(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, count) of the shard, by document."""
    doc, term, count = [], [], []
    for i, x in enumerate(ids):
        ordered = np.sort(x, kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        term.append(ordered[starts])
        count.append(np.diff(np.append(starts, len(ordered))))
        doc.append(np.full(len(starts), i, np.int32))
    return np.concatenate(doc), np.concatenate(term), np.concatenate(count)


class Index:
    """BM25 inverted index of one shard."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean: float, k1: float = 1.2, b: float = 0.75):
        self.n = len(ids)
        lengths = np.array([len(x) for x in ids], np.float64)
        doc, term, count = _slices(ids)
        weight = idf[term] * count * (k1 + 1) / (count + k1 * (1 - b + b * lengths[doc] / mean))
        self.by_doc = np.searchsorted(doc, np.arange(self.n + 1))
        self.terms, self.weights = term, weight
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.first = np.searchsorted(term[order], np.arange((1 << 16) + 1))

    def scores(self, seed: int, terms: int) -> np.ndarray:
        """BM25 of every document of the shard for the seed's ``terms`` highest-weighted terms."""
        a, b = self.by_doc[seed], self.by_doc[seed + 1]
        mine = self.terms[a:b]
        if len(mine) > terms:
            mine = mine[np.argpartition(-self.weights[a:b], terms)[:terms]]
        spans = [slice(self.first[t], self.first[t + 1]) for t in mine.tolist()]
        docs = np.concatenate([self.doc[s] for s in spans])
        return np.bincount(docs, np.concatenate([self.weight[s] for s in spans]), self.n)


def pack(ids: list[np.ndarray], idf: np.ndarray, mean: float, window: int, terms: int, begin: list[int] | None = None) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece of a shard; ``begin``: where each document starts.

    Only the last sequence may be short, and its pieces are the ends of their documents."""
    out, sequence = [], 0
    start = list(begin or [0] * len(ids))
    size = [len(x) for x in ids]
    for i, n in enumerate(size):
        for at in range(start[i], n - window + 1, window):
            out.append((i, at, window, sequence, 0))
            sequence += 1
            start[i] = at + window
    unused = np.array([start[i] < size[i] for i in range(len(ids))], bool)
    index = Index(ids, idf, mean)
    seed, cursor = -1, 0
    while True:
        if seed < 0:
            while cursor < len(ids) and not unused[cursor]:
                cursor += 1
            if cursor == len(ids):
                return out
            seed = cursor
        room, offset, current, ranked = window, 0, seed, None
        while True:
            take = min(room, size[current] - start[current])
            out.append((current, start[current], take, sequence, offset))
            start[current] += take
            room, offset = room - take, offset + take
            unused[current] = start[current] < size[current]
            if not room:
                break
            if ranked is None:
                scores = np.where(unused, index.scores(seed, terms), -1.0)
                best = min(len(scores), 16)
                ranked = np.argpartition(-scores, best - 1)[:best]
                ranked = [int(i) for i in ranked[np.argsort(-scores[ranked], kind="stable")] if scores[i] > 0]
            while ranked and not unused[ranked[0]]:
                ranked.pop(0)
            if ranked:
                current = ranked.pop(0)
            else:  # sixteen small neighbours are used up, or nothing shares a term
                scores = np.where(unused, index.scores(seed, terms), -1.0)
                if scores.max(initial=-1.0) < 0:
                    return out
                current = int(np.argmax(scores))
        sequence += 1
        seed = current if unused[current] else -1


def packed(docs: DataFrame, path: str, end: int = 0, window: int = 1024, id: str = "doc_id", text: str = "text",
           shard_tokens: int = 1_500_000, terms: int = 24) -> DataFrame:
    """Pieces of all documents: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    ``sequence_id`` is the task's number times 2**32 plus the window's number in the task.
    """
    tokens = written(tokenized(docs, path, end, id, text), "tokens")
    rows = tokens.filter("ids IS NOT NULL")
    total, count = rows.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.count(F.lit(1))).first()
    df = frequencies(tokens)
    idf = np.log1p((count - df + 0.5) / (df + 0.5)).clip(1e-6).astype(np.float32)
    mean, shards = max(1.0, total / max(1, count)), max(1, -(-total // shard_tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, held, size = TaskContext.get().partitionId() << 32, [], 0

        def shard(last: bool) -> Iterator[pa.RecordBatch]:
            """Pack what is held; a short last window is left to the task's next shard."""
            nonlocal base, held, size
            ids = [np.frombuffer(x, "<u2") for _, x, _ in held]
            pieces = pack(ids, idf, mean, window, terms, [start for _, _, start in held])
            final = max(p[3] for p in pieces)
            short = [p for p in pieces if p[3] == final]
            if last or sum(p[2] for p in short) == window:
                short = []
            else:
                pieces = [p for p in pieces if p[3] != final]
            out = [(held[i][0], at, n, zlib.crc32(ids[i][at : at + n].astype("<u4")), len(ids[i]), base + sequence, offset)
                   for i, at, n, sequence, offset in pieces]
            base += final + (not short)
            held, size = [(held[i][0], held[i][1], at) for i, at, _, _, _ in short], sum(p[2] for p in short)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=[c.split()[0] for c in PIECES.split(", ")])

        for rows in batches:
            for doc, x in zip(rows.column("doc_id").to_pylist(), rows.column("ids").to_pylist()):
                held.append((doc, x, 0))
                size += len(x) // 2
                if size >= shard_tokens:
                    yield from shard(False)
        if held:
            yield from shard(True)

    keys = ["near", "next", "doc_id", "n_tokens"]
    dealt = rows.repartitionByRange(shards, *keys).sortWithinPartitions(*keys).select("doc_id", "ids")
    return dealt.mapInArrow(run, PIECES)


def concatenated(pieces: DataFrame, tokens: DataFrame) -> DataFrame:
    """Sequences as arrays of ids: the pieces' slices in order of their offset."""
    def cut(a: pd.Series, start: pd.Series, length: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(x, "<u2")[s : s + n].astype(np.int64) for x, s, n in zip(a, start, length)])

    slices = F.pandas_udf(cut, "array<long>")
    joined = pieces.join(tokens.filter("ids IS NOT NULL").select("doc_id", "ids"), "doc_id")
    rows = joined.select("sequence_id", "offset", slices("ids", "start", "length").alias("part"))
    ordered = F.array_sort(F.collect_list(F.struct("offset", "part")))
    return rows.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda p: p["part"])).alias("ids"))
