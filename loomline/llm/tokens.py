"""Token ids of whole texts by the tokenizers library, with each distinct part encoded once.

Byte-level BPE splits a text into parts before it merges. Where a text holds only characters and white
space that the split's rule is sure for, Arrow makes that split for a group of texts and numbers the
distinct parts, the library's BPE model encodes parts that aren't in a bounded cache, and NumPy lays
their ids out in the order of the texts. All other texts go to the library's ``encode``: those with
white space other than spaces and newlines, with runs of it that the split looks ahead for, with the
string of an added token, or with characters outside the scripts named below.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Letters of Latin, Cyrillic and Han; with ASCII digits the only letters and numbers of a text that Arrow splits.
_LETTERS = r"A-Za-z\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}\x{400}-\x{481}\x{48A}-\x{52F}\x{4E00}-\x{9FA5}"
#: Signs: no letter, number or space.
_SIGNS = r"!-/:-@\[-`{-~\x{A1}-\x{A9}\x{AB}-\x{B1}\x{B4}\x{B6}-\x{B8}\x{BB}\x{BF}\x{D7}\x{F7}\x{2010}-\x{2027}\x{2030}-\x{205E}\x{20AC}"
_SPLIT = rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[0-9]+| ?[{_SIGNS}]+|\n"
_ODD = rf"^ | $|  | \n|\n\n\n|\n\n |\n$|[^{_LETTERS}{_SIGNS}0-9 \n]"
_MARK = "\x00"  # no text that is split here holds it
_CUT = re.compile(r"(?<=\S) (?=\S)")  # always starts a new part
GROUP_BYTES = 4 << 20


def _byte_letters() -> dict[int, int]:
    """Byte-level BPE's alphabet: printable Latin-1 bytes stand for themselves, the others count up from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: b if b in own else next(others) for b in range(256)}


_BYTES = _byte_letters()


class _Recent(dict):
    """A cache that keeps at least its last ``most`` entries, and at most twice as many."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, most: int = 500_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]  # found in a text before it is split
        self.odd = "|".join([_ODD, *map(re.escape, added)])
        self.model = self.library.model
        self.parts = _Recent(self._part, most)

    def forget(self) -> None:
        self.parts.clear()
        self.parts.old = {}

    def whole(self, text: str) -> bytes:
        """By the library alone; a very long text in pieces, cut where a new part starts."""
        cuts, at = [0], GROUP_BYTES // 4
        while m := _CUT.search(text, at):
            cuts.append(m.start())
            at = m.start() + GROUP_BYTES // 4
        pieces = (text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)]))
        return b"".join(np.array(self.library.encode(p, add_special_tokens=False).ids, dtype="<u4").tobytes() for p in pieces)

    def _part(self, part: str) -> bytes:
        letters = part.replace(" ", "Ġ") if part.isascii() and part != "\n" else part.encode().decode("latin1").translate(_BYTES)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of the whole text, 4 bytes each."""
        return self.encode_all(pa.array([text], pa.string()))[0]

    def encode_all(self, texts: pa.StringArray) -> list[bytes]:
        """Ids of each text (none null), 4 bytes each; takes groups of texts of bounded bytes."""
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        out: list[bytes] = []
        while len(out) < len(texts):
            at = len(out)
            end = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + GROUP_BYTES, side="right"))
            if end > at:
                out += self._group(texts.slice(at, end - at))
            else:  # longer than a group
                text = texts[at].as_py()
                cuts = [0, *(m.start() for m in _CUT.finditer(text))][:: GROUP_BYTES // 32]
                out.append(b"".join(self._group(pa.array([text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])], pa.string()), True)))
        return out

    def _group(self, texts: pa.StringArray, pieces: bool = False) -> list[bytes]:
        odd = pc.match_substring_regex(texts, self.odd if not pieces else self.odd.removeprefix("^ |"))
        if not pc.any(odd).as_py():
            return list(self._split(texts))
        split = self._split(texts.filter(pc.invert(odd)))
        return [self.whole(t.as_py()) if o else next(split) for t, o in zip(texts, odd.to_pylist())]

    def _split(self, texts: pa.StringArray) -> Iterator[bytes]:
        parts = pc.split_pattern(pc.replace_substring_regex(texts, _SPLIT, rf"\0{_MARK}"), _MARK)  # and an empty one last
        coded = parts.flatten().dictionary_encode()
        own = [self.parts[p] if p else b"" for p in coded.dictionary.to_pylist()]
        codes = coded.indices.to_numpy(zero_copy_only=False)
        size = np.fromiter(map(len, own), np.int32, len(own)) // 4
        start = np.cumsum(size, dtype=np.int32) - size
        n = size[codes]
        upto = np.concatenate([[0], np.cumsum(n, dtype=np.int32)])
        # The id at place j of the output stands at start[code] + (j - first place of its part).
        ids = np.frombuffer(b"".join(own), "<u4")[np.repeat(start[codes] - upto[:-1], n) + np.arange(upto[-1], dtype=np.int32)]
        ends = parts.offsets.to_numpy()
        ends = upto[ends - ends[0]] if len(ends) else ends
        yield from (ids[a:b].tobytes() for a, b in zip(ends, ends[1:]))


_kept: dict[str, Encoder] = {}


@contextmanager
def encoder(path: str, keep: bool = True) -> Iterator[Encoder]:
    """One encoder for a worker process. Its cache outlives a task if ``keep``; else a task that ends drops
    the cached stretches, so an idle worker holds no memory that other stages of a longer job need."""
    if path not in _kept:
        _kept[path] = Encoder(path)
    try:
        yield _kept[path]
    finally:
        if not keep:
            _kept[path].forget()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
