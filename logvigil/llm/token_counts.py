"""Token counts of whole texts by a compiled finite-state transducer.

A byte-pair segmentation can be read from left to right. Let t(i) be the last token of the segmentation
of a text's first i characters. The segmentation of the first i+1 characters ends with the one
vocabulary entry t for which t(i+1-len(t)) and t, put together, segment into just these two; and it has
one token more than that of the first i+1-len(t) characters. What has to be remembered is therefore
finite: the tokens that may still grow (nodes of the vocabulary's trie), the last token before each,
and by how much the counts there differ from the present one. These are the states; a transition over a
byte carries the change of the count. States are compiled when a text first reaches them and are then
table look-ups; the table is dropped between batches when it has grown too large, which costs time only.

A batch of texts is one buffer cut into chunks of equal length that run side by side, a byte at a time.
A chunk cannot know the state in which it is entered, but a space behind a visible character leads to
the same state from everywhere. From its first such place on, a chunk's state map is constant and gives
its exit state at once. The maps are then composed from left to right: a chunk's head is run from its
predecessor's exit state, in parallel for all chunks whose predecessor is known. Prefix sums of the
changes give each text's count.

Needs a model with the identity normaliser, escaped spaces and byte fallback, which is checked. Null
texts are empty and have no tokens. Rows that repeat are counted each; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logvigil.llm.common import texts

SPACE, START, DEAD, ROOT = "▁", 0xFF, 0, 1


class Vocabulary:
    """Pieces with scores, their trie, and the segmentation of short strings."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as source:
            model.ParseFromString(source.read())
        spec, kinds = model.normalizer_spec, proto.ModelProto.SentencePiece
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or not model.trainer_spec.byte_fallback or model.trainer_spec.model_type != proto.TrainerSpec.BPE:
            raise ValueError("only BPE models with the identity normaliser and byte fallback are compiled")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("models with user-defined or unused pieces are not compiled")
        self.prefix = spec.add_dummy_prefix
        self.score = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
        self.pieces = list(self.score)
        self.adjacent = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        if any(pair[1] == SPACE and pair[0] != SPACE for pair in self.adjacent):
            raise ValueError("pieces with a space behind a visible character are not compiled")
        self.children: list[dict[str, int]] = [{}]
        self.token = [-1]
        for number, piece in enumerate(self.pieces):
            node = 0
            for c in piece:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.token)
                    self.children.append({})
                    self.token.append(-1)
                node = self.children[node][c]
            self.token[node] = number
        self.pairs: dict[tuple[int, int], bool] = {}

    def segment(self, text: str) -> list[str]:
        """Merge the best-scored neighbours (leftmost of equals) until none is in the vocabulary."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def follows(self, before: int, token: int) -> bool:
        """Whether the two segment into just these two; before -1: whether the token is its own segmentation."""
        if (known := self.pairs.get((before, token))) is None:
            parts = [self.pieces[token]] if before < 0 else [self.pieces[before], self.pieces[token]]
            known = self.pairs[before, token] = self.segment("".join(parts)) == parts
        return known


class Transducer:
    """States are numbered; ``table`` has 256 entries for each, 0 where not compiled yet.

    An entry is the next state times 256, plus the change of the count plus 128. The table is laid out once for
    ``most`` states and what one batch may add; memory is only taken for rows that are written.
    """

    def __init__(self, vocabulary: Vocabulary, most: int = 160_000):
        self.v, self.most = vocabulary, most
        self.reset()

    def reset(self) -> None:
        self.table = np.zeros(2 * self.most * 256, np.int32)
        #: A state: (open entries, last token, bytes of an unfinished character).
        self.states: list = [None, ((), -1, b"")]
        self.numbers = {self.states[1]: ROOT}
        self.table[:256] = DEAD << 8 | 128

    def number(self, state: tuple) -> int:
        n = self.numbers.get(state)
        if n is None:
            n = self.numbers[state] = len(self.states)
            self.states.append(state)
            if n * 256 >= len(self.table):
                self.table = np.concatenate([self.table, np.zeros(len(self.table), np.int32)])
        return n

    def compile(self, entry: int) -> None:
        """Fill one transition."""
        state, byte = entry >> 8, entry & 0xFF
        open_, last, held = self.states[state]
        gain, after = 0, None
        if byte == START:
            after = ((), -1, b"")
        else:
            held += bytes([byte])
            size = 1 if held[0] < 0x80 else 2 if held[0] < 0xE0 else 3 if held[0] < 0xF0 else 4
            if len(held) < size:
                after = (open_, last, held)
            else:
                gain, after = self.step(open_, last, held.decode("utf-8", "surrogatepass"), size)
        self.table[entry] = self.number(after) << 8 | gain + 128

    def step(self, open_: tuple, last: int, char: str, size: int) -> tuple[int, tuple]:
        v, char = self.v, SPACE if char == " " else char
        first = v.children[0].get(char)
        if first is None:  # not in the vocabulary: a token for each byte, and nothing joins over it
            return size, ((), -1, b"")
        before = last if last >= 0 and v.pieces[last][-1] + char in v.adjacent else -1
        children, tokens, pairs, follows = v.children, v.token, v.pairs, v.follows
        going, ends = [], []
        for node, t, d in (*open_, (0, before, 0)):
            node = children[node].get(char)
            if node is None:
                continue
            token = tokens[node]
            if token >= 0:
                whole, pair = pairs.get((-1, token)), pairs.get((t, token))
                if (follows(-1, token) if whole is None else whole) and (follows(t, token) if pair is None else pair):
                    ends.append((token, d))
            if children[node]:
                going.append((node, t, d))
        if len(ends) != 1:
            raise ValueError(f"the vocabulary has no unique segmentation: {len(ends)} ends")
        token, d = ends[0]
        gain = d + 1
        return gain, (tuple([(node, t, x - gain) for node, t, x in going]), token, b"")

    def advance(self, states: np.ndarray, bytes_: np.ndarray, gains: np.ndarray) -> np.ndarray:
        entries = (states << 8) | bytes_
        found = self.table[entries]
        if not found.all():
            for entry in np.unique(entries[found == 0]).tolist():
                self.compile(entry)
            found = self.table[entries]
        gains[:] = (found & 0xFF) - 128
        return found >> 8

    def changes(self, buffer: np.ndarray, chunk: int = 512) -> np.ndarray:
        """Change of the count at every byte of a buffer that begins with START."""
        lanes = -(-len(buffer) // chunk)
        padded = np.full(lanes * chunk, START, np.uint8)
        padded[: len(buffer)] = buffer
        before = np.concatenate(([0x20], padded[:-1]))
        certain = (padded == START) | ((padded == 0x20) & (before != 0x20) & (before != 0x81))
        certain = certain.reshape(lanes, chunk)
        heads = np.where(certain.any(axis=1), certain.argmax(axis=1), chunk)
        rows = np.ascontiguousarray(padded.reshape(lanes, chunk).T).astype(np.int32)
        gains = np.zeros((chunk, lanes), np.int8)
        states = np.zeros(lanes, np.int32)
        starting = np.argsort(heads, kind="stable")
        bounds = np.searchsorted(heads[starting], np.arange(chunk + 1))
        for k in range(chunk):
            states[starting[bounds[k] : bounds[k + 1]]] = ROOT
            states = self.advance(states, rows[k], gains[k])
        exits = states
        open_ = np.flatnonzero(heads > 0)
        while len(open_):
            ready = open_[exits[open_ - 1] != DEAD]
            ready = ready[np.argsort(-heads[ready], kind="stable")]
            states, lengths = exits[ready - 1].copy(), heads[ready]
            for k in range(int(lengths[0])):
                n = int(np.searchsorted(-lengths, -k, side="left"))  # heads longer than k
                now = np.empty(n, np.int8)
                states[:n] = self.advance(states[:n], rows[k, ready[:n]], now)
                gains[k, ready[:n]] = now
            whole = lengths == chunk
            exits[ready[whole]] = states[whole]
            open_ = np.setdiff1d(open_, ready, assume_unique=True)
        return gains.T.reshape(-1)[: len(buffer)]

    def counts(self, encoded: list[bytes]) -> list[int]:
        if len(self.states) > self.most:
            self.reset()
        lead = bytes([START]) + b" " * self.v.prefix
        sizes = np.array([len(x) + len(lead) if x else 0 for x in encoded], np.int64)
        buffer = np.frombuffer(b"".join(lead + x for x in encoded if x), np.uint8)
        if not len(buffer):
            return [0] * len(encoded)
        sums = np.concatenate(([0], np.cumsum(self.changes(buffer), dtype=np.int64)))
        ends = np.cumsum(sizes)
        return (sums[ends] - sums[ends - sizes]).tolist()


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(Vocabulary(path))


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, id: str = "doc_id", text: str = "text", batch_bytes: int = 1 << 21) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` per document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            encoded = [t.encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            counts, group, size = [], [], 0
            for x in encoded:
                group.append(x)
                size += len(x)
                if size >= batch_bytes:
                    counts += machine.counts(group)
                    group, size = [], 0
            counts += machine.counts(group)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in encoded], pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = texts(docs, id, text)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
