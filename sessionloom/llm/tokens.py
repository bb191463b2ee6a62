"""Token ids of whole texts by the tokenizers library.

Both tokenizers split at white space, never across it, so a text's ids are those of
its pieces (white space and the word after it) in a row.  Each worker encodes a piece
once and keeps its ids, within a bound.  New pieces are encoded many at a time in one
text and told apart by their offsets.
"""

from __future__ import annotations

import os
import re
from operator import itemgetter

import numpy as np

#: White space of Unicode, as the tokenizers' patterns have it.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Encoded pieces that a worker keeps: the first ones it meets, so all frequent ones.
CACHED = 600_000
_TEXT_BATCH = 2_000_000
_JOINED = 256


_word = re.compile(f"[^{_SPACE}]+").findall
#: Python takes these four for white space, the tokenizers don't.
_SEPARATORS = re.compile("[\x1c-\x1f]").search


def _words(text: str) -> list[str]:
    return _word(text) if _SEPARATORS(text) else text.split()


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, spaces: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaces = spaces
        self.split = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+").findall if spaces else _words
        self.is_space = frozenset(c for c in map(chr, range(0x3001)) if re.match(f"[{_SPACE}]", c)).__contains__
        self.cache: dict[str, bytes] = {}
        self.sizes: np.ndarray | None = None

    def encode(self, texts: list[str | None]):
        """Yield the ids of each text (null: none)."""
        held, size = [], 0
        for text in texts:
            held.append(self.split(text or ""))
            size += len(text or "")
            if size > _TEXT_BATCH:
                yield from self._flush(held)
                held, size = [], 0
        yield from self._flush(held)

    def _flush(self, held):
        cache = self.cache
        new = list(set().union(*held).difference(cache))
        kept = max(0, CACHED - len(cache))
        self._add(new)
        get = cache.__getitem__
        for pieces in held:
            yield b"".join(map(get, pieces))
        for x in new[kept:]:
            del cache[x]

    def _add(self, new: list[str]):
        if not self.spaces:
            # Letters beyond ASCII may be changed before they are looked up.
            self._add_groups([x for x in new if not x.isascii()], False)
            self._add_groups([x for x in new if x.isascii()], True)
            return
        # A piece that begins with white space and ends with a word can follow another one.
        space = self.is_space
        alone = [x for x in new if not space(x[0]) or space(x[-1])]
        for at in range(0, len(alone), 10_000):
            part = alone[at : at + 10_000]
            for x, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.cache[x] = np.array(e.ids, "<u4").tobytes()
        self._add_groups([x for x in new if space(x[0]) and not space(x[-1])], True)

    def _add_groups(self, rest: list[str], adds_up: bool):
        groups = [rest[at : at + _JOINED] for at in range(0, len(rest), _JOINED)]
        for at in range(0, len(groups), 64):
            part = groups[at : at + 64]
            texts = [("" if self.spaces else " ").join(g) for g in part]
            if adds_up and self._add_by_size(part, texts):
                continue
            for group, e in zip(part, self.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4").tobytes()
                starts = np.fromiter(map(itemgetter(0), e.offsets), np.int64, len(ids) // 4)
                sizes = np.fromiter(map(len, group), np.int64, len(group)) + (not self.spaces)
                cuts = [*(4 * np.searchsorted(starts, np.cumsum(sizes)[:-1])).tolist(), len(ids)]
                a = 0
                for x, b in zip(group, cuts, strict=True):
                    self.cache[x] = ids[a:b]
                    a = b

    def _add_by_size(self, groups: list[list[str]], texts: list[str]) -> bool:
        """Where every token stands for as many bytes as its name has letters (but for the mark
        of a word's end), pieces are told apart without asking for offsets.  False, and
        nothing added, where that doesn't add up."""
        if self.sizes is None:
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
            self.sizes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
            for name, i in vocabulary.items():
                self.sizes[i] = len(name if self.spaces else name.removesuffix("</w>"))
            for i, token in self.tokenizer.get_added_tokens_decoder().items():
                self.sizes[i] = len(token.content.encode())
        found = []
        for group, e in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends, cuts = np.cumsum(self.sizes[ids]), np.cumsum(np.fromiter((len(x.encode()) for x in group), np.int64, len(group)))
            at = np.searchsorted(ends, cuts)
            if not len(ends) or at[-1] >= len(ends) or (ends[at] != cuts).any():
                return False
            found.append((ids.tobytes(), (4 * at + 4).tolist()))
        for group, (ids, cuts) in zip(groups, found, strict=True):
            a = 0
            for x, b in zip(group, cuts, strict=True):
                self.cache[x] = ids[a:b]
                a = b
        return True


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, spaces: bool) -> Encoder:
    """The worker's encoder for a tokenizer file; ``spaces``: white space is part of tokens."""
    if (path, spaces) not in _encoders:
        _encoders[path, spaces] = Encoder(path, spaces)
    return _encoders[path, spaces]
