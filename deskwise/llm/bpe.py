"""Byte-level BPE inside tasks: whole texts to token ids, with the ids of frequent pieces kept.

Where the tokenizer's file names the byte-level splitting rule, that rule is applied by a regular expression to texts of
plain Latin characters, and the tokenizer's ids of each piece are remembered. Any other text, and every text of a
tokenizer that splits or normalizes otherwise, goes to the tokenizer whole. Both ways give the tokenizer's ids.
"""

from __future__ import annotations

import json
import re

import numpy as np

#: Latin letters among the characters of the quick way, ASCII and Latin-1.
_L = "A-Za-zÀ-ÖØ-öø-ÿ"
_QUICK = frozenset(map(chr, [9, 10, 13, *range(32, 127), *(c for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))]))
_PIECE = re.compile(rf" ?[{_L}]++| ?[0-9]++|'(?:s|t|re|ve|m|ll|d)| ?[^\s0-9{_L}]++|\s+(?!\S)|\s+")
#: Longer pieces aren't kept.
_LONGEST = 48


class Encoder:
    """``ids(text)`` gives the text's ids as little-endian unsigned 32-bit integers.

    One per Python worker, tokenizer file and ``most``; it keeps the ids of the first ``most`` pieces.
    """

    _open: dict[tuple[str, int], Encoder] = {}

    def __init__(self, path: str, most: int = 100_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.known = Tokenizer.from_file(path), most, {}
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        rule = told.get("pre_tokenizer") or {}
        byte_level = rule.get("type") == "ByteLevel" and rule.get("use_regex", True) and not rule.get("add_prefix_space", True)
        own = [t["content"] for t in told.get("added_tokens", [])]
        self.quick = byte_level and not told.get("normalizer") and told["model"]["type"] == "BPE" and all("<|" in t for t in own)

    @classmethod
    def of(cls, path: str, most: int = 100_000) -> Encoder:
        if (path, most) not in cls._open:
            cls._open[path, most] = cls(path, most)
        return cls._open[path, most]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _new(self, pieces: set[str]) -> dict[str, bytes]:
        """The ids of pieces; words that follow a space are encoded as one text."""
        words = [p for p in pieces if p[0] == " " and p[1:].isalpha()]
        found = {p: self._whole(p) for p in pieces.difference(words)}
        if words:
            got = self.tokenizer.encode("".join(words), add_special_tokens=False)
            ids, ends = np.array(got.ids, "<u4").tobytes(), np.flatnonzero(np.diff(np.array(got.word_ids))) + 1
            cuts = [0, *(4 * ends).tolist(), len(ids)]
            found |= {p: ids[a:b] for p, a, b in zip(words, cuts[:-1], cuts[1:], strict=True)}
        return found

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.quick or not _QUICK.issuperset(text) or "<|" in text:
            return self._whole(text)
        pieces = _PIECE.findall(text)
        out = list(map(self.known.get, pieces))
        if None in out:
            new = self._new({p for p, ids in zip(pieces, out, strict=True) if ids is None})
            out = [new[p] if ids is None else ids for p, ids in zip(pieces, out, strict=True)]
            if len(self.known) < self.most:
                self.known.update((p, ids) for p, ids in new.items() if len(p) <= _LONGEST)
        return b"".join(out)
