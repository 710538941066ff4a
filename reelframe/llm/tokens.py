"""Token ids of a public byte-level BPE vocabulary, word by word with a bounded cache."""

from __future__ import annotations

import json
import re
import struct

import numpy as np

# letters, digits and the rest as the vocabulary's own pattern has them, for texts of Latin characters only
LATIN = re.compile("[\t\n\r -~ -±´-¸º»¿-ɏ]*")
LETTERS = "a-zA-ZªµºÀ-ÖØ-öø-ɏ"
QUICK = re.compile(rf" ?[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+")
# fixed value: the vocabulary's pattern
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_names() -> dict[str, int]:
    """Characters by which vocabulary files name the 256 bytes: printable ones by themselves, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class WordIds(dict):
    """Word -> its ids as little-endian unsigned 32-bit numbers. Holds at most `room` words; a full table starts anew."""

    def __init__(self, vocabulary: str, room: int = 250_000):
        import regex
        import tiktoken

        names = byte_names()
        spec = json.loads(vocabulary)
        added = {x["content"]: x["id"] for x in spec.get("added_tokens") or ()}
        # ids of this vocabulary follow the order of its merges, so they are the ranks
        ranks = {bytes(names[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in added}
        self.ranks, self.many = ranks, None
        # words are cut here, so the encoder's own pattern takes all of one
        self.ids = tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.full, self.room = regex.compile(PATTERN), room
        self.added = {w: struct.pack("<I", i) for w, i in added.items()}
        self.marks = re.compile("(" + "|".join(re.escape(w) for w in sorted(added, key=len, reverse=True)) + ")") if added else None

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.room:
            self.clear()
        ids = self.ids(word)
        self[word] = out = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def of_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words (UTF-8, without spaces), a space before each, in one call; and at which of these ids each word starts."""
        if self.many is None:
            import tiktoken

            self.many = tiktoken.Encoding("many", pat_str=" [^ ]+", mergeable_ranks=self.ranks, special_tokens={}).encode_to_numpy
            self.spaced = np.zeros(max(self.ranks.values()) + 1, bool)
            self.spaced[[i for piece, i in self.ranks.items() if piece.startswith(b" ")]] = True
        ids = self.many(b"".join(b" " + w for w in words).decode("utf-8"))
        return ids, np.flatnonzero(self.spaced.take(ids))  # a word's one space is at its start

    def plain(self, text: str) -> bytes:
        words = QUICK.findall(text) if LATIN.fullmatch(text) else self.full.findall(text)
        return b"".join(map(self.__getitem__, words))

    def encode(self, text: str) -> bytes:
        """Ids of a text; a string of an added token is that token, and what stands around it is cut into words by itself."""
        if self.marks is None or not self.marks.search(text):
            return self.plain(text)
        return b"".join(self.added[part] if part in self.added else self.plain(part) for part in self.marks.split(text))


_held: dict[str, WordIds] = {}


def word_ids(vocabulary: str) -> WordIds:
    """One table per Python worker and vocabulary text."""
    key = f"{len(vocabulary)}:{hash(vocabulary)}"
    if key not in _held:
        _held.clear()
        _held[key] = WordIds(vocabulary)
    return _held[key]
