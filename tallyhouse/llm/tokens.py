"""Token ids by public tokenizers, exact and with a cache of white-space separated pieces."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Cached pieces of one Python worker; the cache starts anew when full.
CACHE = 500_000
#: Bytes of text whose pieces are looked up together; a longer text is looked up alone.
TOGETHER = 8 << 20
_LOADED: dict[str, PieceCache] = {}
#: Latin letters that are their own composed form and have simple lower-case forms, then ASCII marks.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-/:-@\\[-`{-~]{0,8})")
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Byte-level vocabularies write a byte as the character of its number if that can be seen, else as one from 256 on.
_BYTE_LETTERS = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in _SHOWN)}


class PieceCache(dict):
    """Little-endian unsigned 32-bit ids of a piece without white space.

    The word tokenizer drops white space and no token crosses it: its pattern has no white space, it looks at no
    context, its normalizers act on single characters or compose a character with marks that follow it. So the ids of a
    text are those of its pieces between ASCII white space, one after the other. Special strings hold no white space
    either, and have their own ids wherever they stand.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.marks: dict[str, bytes] = {"": b""}
        self.words: dict[str, bytes] = {}

    def __missing__(self, piece: bytes) -> bytes:
        if len(self) >= CACHE:
            self.clear()
            self.words.clear()
        text = piece.decode()
        plain = _PLAIN.fullmatch(text)
        if plain:
            # One run of letters, one of marks: what normalizers and pattern make of it is known, so the model is asked.
            letters, marks = plain.groups()
            letters = letters.lower()
            value = self.words.get(letters)
            if value is None:
                word = letters if letters.isascii() else letters.encode().decode("latin-1").translate(_BYTE_LETTERS)
                value = self.words[letters] = array("I", [t.id for t in self.model.tokenize(word)]).tobytes()
            if marks:
                tail = self.marks.get(marks)
                if tail is None:
                    tail = self.marks[marks] = self._encoded(marks)
                value += tail
        else:
            value = self._encoded(text)
        self[piece] = value
        return value

    def _encoded(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def ids(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text of a column, null as empty."""
        texts = texts.fill_null("")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            before = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + TOGETHER, side="right")))
            yield from self._together(texts.slice(at, stop - at))
            at = stop

    def _together(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Each distinct piece is looked up once, then ids are gathered by the pieces' numbers."""
        # The separator is a run of the six ASCII white-space bytes.
        pieces = pc.ascii_split_whitespace(texts)
        bounds = pieces.offsets.to_numpy()
        coded = pieces.flatten().dictionary_encode()
        known = [self[p] for p in coded.dictionary.cast(pa.binary()).to_pylist()]
        sizes = np.fromiter(map(len, known), dtype=np.int64, count=len(known)) // 4
        flat = np.frombuffer(b"".join(known), dtype="<u4")
        starts = np.cumsum(sizes) - sizes
        number = coded.indices.to_numpy()
        many = sizes[number]
        stops = np.concatenate(([0], np.cumsum(many)))
        ids = flat[np.repeat(starts[number] - stops[:-1], many) + np.arange(stops[-1])]
        bounds = stops[bounds - bounds[0]]
        yield from (ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()))


def word_tokens(path: str) -> PieceCache:
    """The cache of this Python worker for one vocabulary file."""
    if path not in _LOADED:
        _LOADED[path] = PieceCache(path)
    return _LOADED[path]


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
