"""Trie of shared conversation prefixes, with count-min screening of prefix digests.

Every turn becomes 16 bytes of SHA-256 over its role and text and a word count; texts travel no further. A prefix's
key is the sum of one strong hash for each of its turns (digest and depth), 2 x 64 bits, so keys are running sums and
a conversation may be cut anywhere: rows are range-partitioned on conversation and order, each task sums its own
piece, and what a piece needs from the pieces before it is one row for each piece (the only thing the driver sees).
A conversation with a third of all turns is so dealt to many tasks.

Screening. Each task counts the prefixes of its piece in a count-min sketch of two rows (one cell row for each half of
the key); the merged sketch, two bit maps of cells counted at least twice, is broadcast (``cells`` bounds it: 16 MB
at most by default). A prefix with a cell counted once is proven a singleton, and with it all longer prefixes of its
conversation: this tail is emitted where it stands, without a shuffle. Only the possibly shared prefixes above are
grouped exactly by their keys. A full sketch proves less and shuffles more; the result is the same.

Sums over subtrees need no walk. A conversation *owns* the nodes of which it is the smallest member, always the end of
its path; let ``q`` be the words before its first own node. A node's saved words, over its subtree, are the sum over
its members but the owner of ``q`` less the words before the node: each further member is spared what lies between the
node and the place where it leaves its elders. A node's leaves are its members that own a childless node. Both are one
grouping of the possibly shared rows. Hot keys (the root has all conversations) are combined before the shuffle; the
parent of very many children is looked up by a broadcast of such parents, of which there are at most ``hot``.

Equality rests on 128 bits of SHA-256 and of the prefix key; members of a node with another last turn or another
parent raise an error, so a collision cannot pass unseen.

Defined cases: a null role or text is empty; null turns come first; equal turns are ordered by role, then by digest of
role and text, and repeated rows count as turns of their own; rows without a conversation id belong to none and are
left out; a negative id's leader is rounded towards zero; an empty table gives an empty result (no conversation, no
root); other columns are ignored; texts of any length are hashed whole in the JVM.
"""

from __future__ import annotations

import hashlib
from ast import literal_eval
from collections.abc import Callable, Iterable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from logvigil.llm.common import partitions, ship, written
from logvigil.operators.pieces import sorted_pieces

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MODULUS = 1 << 64
_BLOCK = 1 << 16  # cells of the sketch that are merged together


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# Running values within runs of equal conversation ids


class State(NamedTuple):
    """The last conversation so far: its rows, key sums, words, and whether its tail has begun."""

    conv: int | None = None
    rows: int = 0
    first: int = 0
    second: int = 0
    words: int = 0
    tail: int = 0


def _running(values: np.ndarray, start: np.ndarray, head: np.ndarray, carried: int) -> np.ndarray:
    """Inclusive sums within runs; the first run goes on from ``carried`` unless it starts here."""
    total = np.cumsum(values, dtype=values.dtype)
    before = np.where(head > 0, total[head - 1], values.dtype.type(0))
    sums = total - before
    if not start[0]:
        sums[head == 0] += values.dtype.type(carried)
    return sums


class Rows(NamedTuple):
    conv: np.ndarray
    depth: np.ndarray
    keys: tuple[np.ndarray, np.ndarray]
    parents: tuple[np.ndarray, np.ndarray]
    digest: np.ndarray
    words: np.ndarray
    before: np.ndarray
    top: np.ndarray
    tail: np.ndarray
    end: np.ndarray


def _scan(batches: Iterable[pa.RecordBatch], state: State, after: int | None = None,
          proven: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[pa.RecordBatch, Rows, State]]:
    """Prefixes of a piece of (conv_id, digest, words) rows in order; ``after``: first conversation of the next piece."""
    held = None
    for batch in chain(batches, [None]):
        if batch is not None and not batch.num_rows:
            continue
        if held is not None:
            following = after if batch is None else batch.column("conv_id")[0].as_py()
            rows, state = _prefixes(held, state, following, proven)
            yield held, rows, state
        held = batch


def _prefixes(batch: pa.RecordBatch, state: State, following: int | None, proven) -> tuple[Rows, State]:
    conv = batch.column("conv_id").to_numpy()
    n = len(conv)
    start = np.r_[conv[0] != state.conv if state.conv is not None else True, conv[1:] != conv[:-1]]
    at = np.arange(n)
    head = np.maximum.accumulate(np.where(start, at, 0))
    depth = at - head
    if not start[0]:
        depth[head == 0] += state.rows
    halves = np.frombuffer(b"".join(batch.column("digest").to_pylist()), "<u8").reshape(n, 2)
    words = batch.column("words").to_numpy()
    turn = depth > 0  # the row of depth 0 is the root
    level = depth.astype(np.uint64) * _GOLDEN
    own = [np.where(turn, _mix(halves[:, side] + _mix(level + np.uint64(side))), np.uint64(0)) for side in (0, 1)]
    keys = tuple(_running(own[side], start, head, (state.first, state.second)[side]) for side in (0, 1))
    upto = _running(words, start, head, state.words)
    single = proven(*keys) if proven else np.zeros(n, bool)
    tails = _running(single.astype(np.int64), start, head, state.tail)
    end = np.r_[start[1:], following is None or following != conv[-1]]
    rows = Rows(conv, depth, keys, (keys[0] - own[0], keys[1] - own[1]), halves[:, 0], words, upto - words,
                (tails > 0) & (tails - single == 0), tails > 0, end)
    return rows, State(int(conv[-1]), int(depth[-1]) + 1, int(keys[0][-1]), int(keys[1][-1]), int(upto[-1]), int(tails[-1]))


class Pieces:
    """Rows sorted by conversation and order over many partitions, and what each partition starts with.

    One row for each partition reaches the driver. The depths of a piece depend on the rows before it, its keys on the
    depths, its tails on the keys: each is known after one more ``carry``.
    """

    def __init__(self, df: DataFrame, order: list[str]):
        ship(df.sparkSession)
        self.rows = sorted_pieces(df, ["conv_id"], order)
        self.begin: dict[int, tuple[State, int | None]] = {}  # by piece: its start, and the next piece's first conversation
        self.n = 0

    def scan(self, emit: Callable[[Iterator[tuple[pa.RecordBatch, Rows, State]], int], Iterator[pa.RecordBatch]], schema: str, proven=None) -> DataFrame:
        begin = dict(self.begin)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            batches = (b for b in batches if b.num_rows)
            batch = next(batches, None)
            if batch is not None:
                piece = batch.column("chunk")[0].as_py()
                yield from emit(_scan(chain([batch], batches), *begin.get(piece, (State(), None)), proven), piece)

        return self.rows.mapInArrow(run, schema)

    def carry(self, proven=None) -> None:
        known = dict(self.begin)

        def last(scanned, piece):
            first, size = None, 0
            for _, rows, state in scanned:
                first = int(rows.conv[0]) if first is None else first
                size += len(rows.conv)
            yield pa.RecordBatch.from_pydict({"piece": [piece], "first": [first], "size": [size], "state": [repr(tuple(state))]})

        pieces = sorted(map(tuple, self.scan(last, "piece long, first long, size long, state string", proven).collect()))
        before, self.n, self.begin = State(), 0, {}
        for (piece, first, size, state), following in zip(pieces, [*(p[1] for p in pieces[1:]), None]):
            goes_on = first == before.conv
            self.begin[piece] = (before if goes_on else State(), following)
            state = State(*literal_eval(state))
            if goes_on and state.conv == first:  # all of one conversation: replace what the piece started with
                began = known.get(piece, (State(), None))[0]
                sums = [now - then + real for now, then, real in zip(state[1:], began[1:], before[1:])]
                state = State(first, sums[0], sums[1] % _MODULUS, sums[2] % _MODULUS, *sums[3:])
            before, self.n = state, self.n + size


# Turns


def digested(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turn, role, digest, words`` of every row that has a conversation id."""
    who, what = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    framed = F.concat(F.length(who).cast("string"), F.lit(":"), who, what)
    return turns.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("bigint").alias("conv_id"), F.col(turn).alias("turn"), who.alias("role"),
        F.substring(F.unhex(F.sha2(framed, 256)), 1, 16).alias("digest"),
        F.regexp_count(what, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words"),
    )


def numbered(turns: DataFrame) -> DataFrame:
    """``conv_id, n, digest, words``: turns numbered from 0 within their conversation."""
    pieces = Pieces(turns, ["turn", "role", "digest"])
    pieces.carry()

    def rows(scanned, piece):
        for batch, found, _ in scanned:
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(found.depth), batch.column("digest"), batch.column("words")], names=["conv_id", "n", "digest", "words"])

    return written(pieces.scan(rows, "conv_id long, n long, digest binary, words long"), "turns")


def with_roots(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """``conv_id, part, n, digest, words`` with a row for the root of every conversation in front of its turns."""
    nothing = F.unhex(F.lit("00" * 16))
    roots = ids.select("conv_id", F.lit(-1).alias("part"), F.lit(0).cast("bigint").alias("n"), nothing.alias("digest"), F.lit(0).cast("bigint").alias("words"))
    return roots.unionByName(turns)


def led(turns: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Numbered turns, where the first h turns of conversation c give way to those of its leader ``c - c % group``
    (h: crc32 of the id in decimal, modulo ``most``). The leader's first turns are copied at most ``group`` times."""
    h = F.crc32(F.col("conv_id").cast("string")) % most
    ids = turns.filter("n = 0").select("conv_id")
    heads = turns.filter((F.col("conv_id") % group == 0) & (F.col("n") < most - 1))
    heads = heads.select(F.col("conv_id").alias("leader"), "n", "digest", "words")
    taken = ids.withColumn("leader", F.col("conv_id") - F.col("conv_id") % group).join(heads, "leader").filter(F.col("n") < h)
    own = turns.filter(F.col("n") >= h)
    columns = ["conv_id", "part", "n", "digest", "words"]
    both = taken.withColumn("part", F.lit(0)).select(columns).union(own.withColumn("part", F.lit(1)).select(columns))
    return with_roots(both, ids)


# Screening


def _cells(rows: int, most: int) -> int:
    """Cells of a sketch row: a power of two above eight times the rows, at most ``most``."""
    return max(_BLOCK, min(1 << (8 * max(rows, 1)).bit_length(), most))


def screen(pieces: Pieces, most: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The count-min sketch of all prefixes; the function tells which of them it proves to be counted once."""
    spark, cells = pieces.rows.sparkSession, _cells(pieces.n, most)
    mask, blocks = np.uint64(cells - 1), cells // _BLOCK

    def count(scanned, piece):
        held: list[tuple[np.ndarray, np.ndarray]] = [], []
        for _, rows, _ in scanned:
            for side in (0, 1):
                held[side].append(rows.keys[side] & mask)
        for side in (0, 1):
            places, times = np.unique(np.concatenate(held[side]), return_counts=True)
            bounds = np.searchsorted(places, np.arange(blocks + 1, dtype=np.uint64) * np.uint64(_BLOCK))
            there = np.flatnonzero(np.diff(bounds))
            parts = [slice(bounds[b], bounds[b + 1]) for b in there]
            yield pa.RecordBatch.from_pydict({
                "block": pa.array(there + side * blocks, pa.int64()),
                "places": [(places[p] & np.uint64(_BLOCK - 1)).astype("<u2").tobytes() for p in parts],
                "twice": [np.packbits(times[p] > 1).tobytes() for p in parts]})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: dict[int, np.ndarray] = {}
        twice: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, places, more in zip(*(c.to_pylist() for c in batch.columns)):
                places = np.frombuffer(places, "<u2")
                if block not in once:
                    once[block], twice[block] = np.zeros(_BLOCK, bool), np.zeros(_BLOCK, bool)
                twice[block][places] |= once[block][places] | np.unpackbits(np.frombuffer(more, np.uint8), count=len(places)).astype(bool)
                once[block][places] = True
        for block, cells_ in twice.items():
            yield pa.RecordBatch.from_pydict({"block": [block], "bits": [np.packbits(cells_).tobytes()]})

    found = pieces.scan(count, "block long, places binary, twice binary").repartition(partitions(spark), "block").mapInArrow(merge, "block long, bits binary")
    bits = np.zeros((2 * blocks, _BLOCK // 8), np.uint8)
    for block, packed in found.toLocalIterator():
        bits[block] = np.frombuffer(packed, np.uint8)
    sketch = spark.sparkContext.broadcast(bits.reshape(2, -1))

    def proven(*keys: np.ndarray) -> np.ndarray:
        more = np.ones(len(keys[0]), bool)
        for side in (0, 1):
            cell = keys[side] & mask
            more &= (sketch.value[side][(cell >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (cell & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
        return ~more

    return proven


_PREFIX = ("conv_id long, depth long, k1 long, k2 long, p1 long, p2 long, digest long, words long, before long, "
           "is_top boolean, is_tail boolean, is_end boolean")
_PREFIX_NAMES = [field.split()[0] for field in _PREFIX.split(", ")]


def prefixes(sequences: DataFrame, order: list[str], most: int) -> tuple[DataFrame, int]:
    """Every conversation's prefixes, marked as a proven tail or possibly shared, and their number."""
    pieces = Pieces(sequences, order)
    pieces.carry()
    pieces.carry()
    proven = screen(pieces, most)
    pieces.carry(proven)

    def rows(scanned, piece):
        for _, r, _ in scanned:
            columns = [r.conv, r.depth, *(k.view(np.int64) for k in (*r.keys, *r.parents, np.ascontiguousarray(r.digest))), r.words, r.before, r.top, r.tail, r.end]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=_PREFIX_NAMES)

    return written(pieces.scan(rows, _PREFIX, proven), "prefixes"), pieces.n


# Exact grouping of what may be shared

_KEY = ["k1", "k2"]
_NOTHING = hashlib.sha256(b"").hexdigest()


def _same(name: str) -> Column:
    """The one value of a column in a group; an error if there are two."""
    differ = F.raise_error(F.lit(f"two prefixes share a key but differ in {name}"))
    return F.when(F.min(name) == F.max(name), F.min(name)).otherwise(differ.cast("bigint")).alias(name)


def _ends(shared: DataFrame, count: int) -> DataFrame:
    """SHA-256 over the decimal ids of the members that end at a node, in order, comma-joined.

    Ids are sorted over all tasks, joined there to rows of a few thousand, and one task feeds a node's rows to the hash
    in order, holding one at a time: the digest of a list is sequential, the list is never held.
    """
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                k1, k2, ids = (c.to_numpy() for c in batch.columns)
                cuts = np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1
                starts = np.r_[0, cuts]
                texts = [",".join(map(str, part.tolist())) for part in np.split(ids, cuts)]
                yield pa.RecordBatch.from_arrays([pa.array(k1[starts]), pa.array(k2[starts]), pa.array(ids[starts]), pa.array(texts)], names=[*_KEY, "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out = []
            for k1, k2, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if (k1, k2) != now:
                    if now is not None:
                        out.append((*now, state.hexdigest()))
                    now, state = (k1, k2), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[*_KEY, "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_pydict({"k1": [now[0]], "k2": [now[1]], "ends_sha256": [state.hexdigest()]})

    ids = shared.filter("is_end").select(*_KEY, "conv_id")
    parts = ids.repartitionByRange(count, *_KEY, "conv_id").sortWithinPartitions(*_KEY, "conv_id").mapInArrow(join, "k1 long, k2 long, first long, ids string")
    return parts.repartition(count, *_KEY).sortWithinPartitions(*_KEY, "first").mapInArrow(digest, "k1 long, k2 long, ends_sha256 string")


def trie(sequences: DataFrame, order: list[str], cells: int = 1 << 26, hot: int = 50_000, block: int = 4096) -> DataFrame:
    """Nodes of the trie over ``sequences``: ``conv_id, digest, words`` and the columns of ``order``, the root's row first.

    ``cells``: bound of each row of the sketch. ``hot``: most parents that are broadcast. ``block``: depths of one
    conversation that are looked up by one key.
    """
    spark = sequences.sparkSession
    rows, total = prefixes(sequences, order, cells)
    shared, tops = rows.filter("NOT is_tail"), rows.filter("is_top")
    nodes = shared.groupBy(*_KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), *map(_same, ("depth", "p1", "p2", "digest", "words", "before")))
    nodes = written(nodes.drop("digest", "words"), "nodes")
    below = nodes.filter("depth > 0").select("p1", "p2").union(tops.filter("depth > 0").select("p1", "p2"))
    below = below.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = written(nodes.join(below, _KEY, "left").fillna(0, ["n_children"]), "nodes")

    # A row for each conversation: words before its first own node, and whether it owns a childless one.
    none = F.lit(None).cast("bigint")
    own = nodes.groupBy("conv_id").agg(F.min_by("before", "depth").alias("q"), F.max((F.col("n_children") == 0).cast("bigint")).alias("leaf"))
    convs = (
        own.select("conv_id", "q", none.alias("q_tail"), none.alias("q_all"), "leaf", none.alias("deep"))
        .union(tops.select("conv_id", none, F.col("before"), none, F.lit(1).cast("bigint"), none))
        .union(rows.filter("is_end").select("conv_id", none, none, F.col("before") + F.col("words"), none, none))
        .union(shared.select("conv_id", none, none, none, none, F.col("depth")))
        .groupBy("conv_id").agg(F.coalesce(F.max("q"), F.max("q_tail"), F.max("q_all")).alias("q"), F.coalesce(F.max("leaf"), F.lit(0)).alias("leaf"), F.max("deep").alias("deep"))
        .filter("deep IS NOT NULL")
        .withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"deep div {block}"))))
    )
    sums = shared.select(*_KEY, "conv_id", F.expr(f"depth div {block}").alias("part")).join(convs, ["conv_id", "part"])
    sums = sums.groupBy(*_KEY).agg(F.sum("q").alias("q"), F.min_by("q", "conv_id").alias("q_own"), F.sum("leaf").alias("n_leaves"))

    whole = nodes.join(sums, _KEY).join(_ends(shared, partitions(spark)), _KEY, "left").select(
        "conv_id", "depth", "p1", "p2", "n_convs", "n_children", "n_leaves",
        (F.col("q") - F.col("q_own") - (F.col("n_convs") - 1) * F.col("before")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(_NOTHING)).alias("ends_sha256"))

    # Tails: everything but the top's parent is known where they stand.
    alone = [
        F.lit(1).cast("bigint").alias("n_convs"), F.when(F.col("is_end"), 0).otherwise(1).cast("bigint").alias("n_children"),
        F.lit(1).cast("bigint").alias("n_leaves"), F.lit(0).cast("bigint").alias("saved_tokens"),
        F.when(F.col("is_end"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(_NOTHING)).alias("ends_sha256"),
    ]
    tails = rows.filter("is_tail AND NOT is_top").select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), *alone)
    wanted = whole.unionByName(tops.select("conv_id", "depth", "p1", "p2", *alone))

    # Parents: those of very many nodes are few, and broadcast; the others are joined by key.
    limit = max(1000, total // hot)
    names = [F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id")]
    busy, calm = (F.broadcast(nodes.filter(f"n_children > {limit}").select(names)), nodes.filter(f"n_children BETWEEN 1 AND {limit}").select(names))
    columns = ["conv_id", "depth", "parent_conv_id", *(c for c in whole.columns if c not in ("conv_id", "depth", "p1", "p2"))]
    inner = wanted.filter("depth > 0")
    return (
        inner.join(busy, ["p1", "p2"]).select(columns)
        .union(inner.join(busy, ["p1", "p2"], "left_anti").join(calm, ["p1", "p2"]).select(columns))
        .union(wanted.filter("depth = 0").withColumn("parent_conv_id", none).select(columns))
        .union(tails.select(columns))
    )


def conversation_trie(turns: DataFrame, lead: bool = False, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                      cells: int = 1 << 26) -> DataFrame:
    """Nodes over the conversations as they are, or with ``lead`` as ``led`` rebuilds them.

    A node is told by its smallest member and its depth: its last turn is number ``depth - 1`` of that conversation.
    """
    ordered = numbered(digested(turns, conv, turn, role, text))
    if lead:
        sequences = led(ordered)
    else:
        sequences = with_roots(ordered.select("conv_id", F.lit(1).alias("part"), "n", "digest", "words"), ordered.filter("n = 0").select("conv_id"))
    return trie(sequences, ["part", "n"], cells)
