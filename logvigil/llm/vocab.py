"""Token ids of whole texts from a ``tokenizers`` file: ``ByteEncoder``, ``WordEncoder``, or a memo of white-space separated chunks.

The two byte-pair vocabularies split a text into words before they merge, and no word crosses the
boundary between a visible character and the white space after it. A text is therefore the
concatenation of its chunks, and a chunk that was seen before need not be encoded again. New chunks
of a batch go through the library in one call, behind a separator whose token cannot come from a chunk.
Texts with white space other than space, tab, line feed or carriage return are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from itertools import chain, filterfalse

import numpy as np

#: Characters Python calls white space and a vocabulary's own pattern may or may not.
_OTHER_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
_UNEVEN = re.compile(r"[ \n]{2}|[\t\r]|^[ \n]|[ \n]$")
_CHUNK = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")


def _words(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """``encode(texts)`` gives one bytes object of little-endian unsigned 16-bit ids per text.

    ``keep`` bounds the memo (entries); chunks beyond it are encoded again in each batch they occur in.
    """

    def __init__(self, path: str, keep: int = 600_000):
        self.model = _words(path)
        if self.model.get_vocab_size() > 1 << 16:
            raise ValueError("16-bit ids need a vocabulary of at most 65,536 entries")
        self.keep, self.memo = keep, {}
        self.drops_space = not self._plain("\n")
        self.specials = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.mark, self.mark_id = self._separator()

    def _plain(self, text: str) -> list[int]:
        return self.model.encode(text, add_special_tokens=False).ids

    def _separator(self) -> tuple[str, int]:
        """A line feed where it has a token; else the first symbol with a token of its own."""
        for mark in "\n" if not self.drops_space else "†§¶•®":
            if len(ids := self._plain(mark)) == 1:
                return (mark if mark == "\n" else f" {mark} "), ids[0]
        raise ValueError("no separator has a token of its own")

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype="<u2").tobytes()

    def _literal(self, key: str) -> str:
        """Keys that start with a visible character stand behind one space, unless spaces are dropped."""
        return key if self.drops_space or key[0].isspace() else " " + key

    def _learn(self, keys: set[str]) -> dict[str, bytes]:
        mark = self.mark.strip(" ")
        if self.drops_space:
            odd = {k for k in keys if mark in k}
        else:
            odd = {k for k in keys if k[0].isspace() and (k[0] != "\n" or len(k) == 1 or k[1].isspace())}
        odd |= {k for k in keys if "<" in k and any(s in k for s in self.specials)}
        own = {k: self._pack(self._plain(self._literal(k))) for k in odd}
        even = [k for k in keys if k not in own]
        if not even:
            return own
        if self.drops_space:
            # Some hundred chunks a text, by the call that keeps no offsets: half the time of one long text.
            some = [self.mark.join(["", *even[at : at + 500]]) for at in range(0, len(even), 500)]
            ids = np.array([i for part in self.model.encode_batch_fast(some, add_special_tokens=False) for i in part.ids], dtype="<u2")
        else:
            ids = np.array(self._plain("".join(k if k[0] == "\n" else "\n " + k for k in even)), dtype="<u2")
        cuts = np.flatnonzero(ids == self.mark_id)
        if len(cuts) != len(even):  # some chunk's own ids hold the separator's
            own.update((k, self._pack(self._plain(self._literal(k)))) for k in even)
            return own
        data, ends = ids.tobytes(), [*(2 * cuts[1:]).tolist(), 2 * len(ids)]
        for k, a, b in zip(even, (2 * cuts).tolist(), ends):
            own[k] = data[a if k[0] == "\n" else a + 2 : b]
        return own

    def _look_up(self, lists: list[list[str]]) -> list[bytes]:
        new = set(filterfalse(self.memo.__contains__, chain.from_iterable(lists)))
        memo = self.memo
        if new:
            learnt = self._learn(new)
            if len(memo) + len(learnt) <= self.keep:
                memo.update(learnt)
            else:
                memo = _Both(memo, learnt)
        get = memo.__getitem__
        return [b"".join(map(get, chunks)) for chunks in lists]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        lists, at, first = [], [], []
        for i, text in enumerate(texts):
            if not text:
                out[i] = b""
            elif _OTHER_SPACE.search(text):
                out[i] = self._pack(self._plain(text))
            elif self.drops_space:
                lists.append(text.split())
                at.append(i)
                first.append(0)
            else:
                if _UNEVEN.search(text):
                    spaced = text if text[0].isspace() else "\n" + text
                    chunks = _CHUNK.findall(spaced)
                    chunks = [c[1:] if c[0] == " " and len(c) > 1 and not c[1].isspace() else c for c in chunks]
                    first.append(0 if spaced is text else 2)
                else:
                    chunks = ("\n" + text.replace("\n", " \n")).split(" ")
                    first.append(2)
                lists.append(chunks)
                at.append(i)
        for i, skip, ids in zip(at, first, self._look_up(lists)):
            out[i] = ids[skip:]
        return out


class _Both:
    """Two memos read as one."""

    def __init__(self, old: dict, new: dict):
        self.old, self.new = old, new

    def __getitem__(self, key: str) -> bytes:
        found = self.old.get(key)
        return self.new[key] if found is None else found


# Fixed value: how a byte-level vocabulary splits a text into words before it merges.
_BYTE_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The visible character that stands for each byte in a byte-level vocabulary."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteEncoder:
    """``Encoder`` for a byte-level vocabulary whose merges make the tokens in order of their ids.

    The merges are those of the file, applied by ``tiktoken``, which is several times faster than the
    ``tokenizers`` library and needs no memo. Texts that hold a special token's string go through the
    library. ``fits`` tells whether a file is of this kind.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if all(c in letters for c in token)}
        self.model = _words(path)
        self.specials = [t.content for t in self.model.get_added_tokens_decoder().values()]
        for special in self.specials:
            ranks.pop(special.encode(), None)
        self.plain = tiktoken.Encoding("file", pat_str=_BYTE_WORDS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @staticmethod
    def fits(path: str) -> bool:
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model, before = content["model"], content.get("pre_tokenizer") or {}
        simple = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if model["type"] != "BPE" or not simple or content.get("normalizer") or len(model["vocab"]) > 1 << 16:
            return False
        if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            return False
        made = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        return None not in made and all(a < b for a, b in zip(made, made[1:]))

    def _ids(self, text: str) -> list[int]:
        if any(s in text for s in self.specials):
            return self.model.encode(text, add_special_tokens=False).ids
        return self.plain(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        rows = [array("H", self._ids(text)) for text in texts]
        if sys.byteorder == "big":
            for row in rows:
                row.byteswap()
        return [row.tobytes() for row in rows]


# How the file that ``WordEncoder`` takes normalises and splits a text.
_LOWERED = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
_LATIN = "a-zA-ZÀ-ÖØ-öø-ÿ"
#: Characters for which lower case, NFC and classes are known here and in the library alike; others, and what may be a special token, are left to it.
_FOREIGN = re.compile(rf"[^\t\n\r\x20-\x7e{_LATIN}‘’“”–—…]|<\|")
#: The pieces of ``_SPLIT`` that are not letters.
_MARKS = re.compile(rf"[^{_LATIN}\s](?:(?<=')(?:s|t|re|ve|m|ll|d)|(?<![0-9])[^{_LATIN}\s0-9]*)?")


class WordEncoder(Encoder):
    """``Encoder`` for a byte-level vocabulary of lower-case words with an end-of-word suffix.

    A word is given to ``tiktoken`` with a space behind it, which stands for the suffix: the last byte and the space merge before all
    else, then the file's merges apply in their order. Texts with other than common Latin characters are encoded as by ``Encoder``.
    ``fits`` tells whether a file is of this kind.
    """

    def __init__(self, path: str, keep: int = 600_000):
        import tiktoken

        super().__init__(path, keep)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        letters, end, vocab = _byte_letters(), model["end_of_word_suffix"], model["vocab"]
        made = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        tokens = [*(c + end for c, byte in letters.items() if byte != 32), *letters, *made]
        spelt = lambda t: bytes(letters[c] for c in t.removesuffix(end)) + b" " * t.endswith(end)
        ranks = {spelt(t): i for i, t in enumerate(tokens)}
        if len(ranks) != len(tokens):
            raise ValueError("two merges make the same token")
        self.ids = np.array([vocab[t] for t in tokens], "<u2")
        self.words = tiktoken.Encoding("file", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={"\0": len(tokens)}).encode_to_numpy

    @staticmethod
    def fits(path: str) -> bool:
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model = content["model"]
        simple = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        if model["type"] != "BPE" or not simple or not model.get("end_of_word_suffix") or len(model["vocab"]) > 1 << 16:
            return False
        if content.get("normalizer") != _LOWERED or content.get("pre_tokenizer") != _SPLIT or content.get("post_processor"):
            return False
        made = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        return len(set(made)) == len(made) and all(t in model["vocab"] for t in made)

    def encode(self, texts: list[str]) -> list[bytes]:
        foreign = [i for i, text in enumerate(texts) if _FOREIGN.search(text)]
        known = dict(zip(foreign, super().encode([texts[i] for i in foreign])))
        return [known[i] if i in known else self._latin(text) for i, text in enumerate(texts)]

    def _latin(self, text: str) -> bytes:
        spaced = text.lower().replace("\n", " ").replace("\t", " ").replace("\r", " ") + " "
        return self.ids[self.words(_MARKS.sub(r" \g<0> ", spaced))].tobytes()


def encoder_for(path: str) -> Encoder | ByteEncoder:
    return next((kind for kind in (ByteEncoder, WordEncoder) if kind.fits(path)), Encoder)(path)
