"""Byte-level BPE ids of whole texts through the ``tokenizers`` library, with a bounded memo.

The library's tokenizer is used as its file gives it: added tokens in a text are found as its own
call finds them. A text whose white space is single blanks and line breaks between other
characters is encoded piece by piece: a blank always starts a pre-token, a line break is one, so
the ids of the pieces, put together, are the ids of the text. Pieces repeat, so each is encoded
once per worker; a piece of letters is one pre-token, so the library's model alone answers it.
Any other text goes to the library whole. Of many texts, Arrow finds the distinct pieces first and
puts their ids together, so that Python sees each piece once a batch.
"""

from __future__ import annotations

import os
from string import digits, punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
#: Pieces a worker remembers before it starts afresh, none longer than the second number of
#: characters: together they bound the memo's bytes, not the results.
MEMO_ENTRIES = 600_000
LONGEST_KEPT = 48
#: UTF-8 bytes of text whose pieces are looked up together (more for one longer text).
BATCH_BYTES = 1 << 24
#: Below this character letters are the same in all versions of Unicode that are in use.
_SETTLED = "ɐ"


def _shown() -> dict[int, str]:
    """How byte-level vocabularies write characters below ``_SETTLED``: a visible character for
    each byte, printable Latin-1 for itself, the others from U+0100 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    byte = [chr(b if b in plain else next(others)) for b in range(256)]
    return {c: "".join(byte[b] for b in chr(c).encode()) for c in range(ord(_SETTLED))}


class _Whole(Exception):
    """The text must be encoded whole."""


class _Memo(dict):
    """Piece -> ids as little-endian 32-bit bytes, where the piece stands after ``lead``."""

    def __init__(self, enc: BpeEncoder, lead: str):
        super().__init__()
        self.enc, self.lead = enc, lead

    def __missing__(self, piece: str) -> bytes:
        ids = self._ids(piece)
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[piece] = ids
        return ids

    def _ids(self, piece: str) -> bytes:
        enc = self.enc
        if piece.isalpha() and (piece.isascii() or max(piece) < _SETTLED):
            return enc.word(self.lead + piece)
        if piece.split() != [piece]:  # empty, or holds other white space
            raise _Whole
        if piece[-1] in enc.marks and piece[-2:-1].isascii() and piece[-2:-1].isalnum():
            return self[piece[:-1]] + enc.marks[piece[-1]]  # a sign after a letter or digit starts a pre-token
        return enc.whole(self.lead + piece)


class _AgedMemo(_Memo):
    """Two halves: when the younger is full it takes the older's place, so that what is in use stays."""

    def __init__(self, enc: BpeEncoder, lead: str):
        super().__init__(enc, lead)
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self._ids(piece)
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= MEMO_ENTRIES // 2:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def _ids(self, piece: str) -> bytes:
        if self.lead and piece.isascii() and piece.isalpha():
            return self.enc.shown_word(self.enc.blank + piece)
        return super()._ids(piece)


class BpeEncoder:
    """Whole text -> ids as bytes (unsigned 32-bit, little-endian)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.shown = self.tokenizer.model, _shown()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.newline, self.marks = self.whole("\n"), {m: self.whole(m) for m in ".,;:!?"}
        raw = np.arange(self.tokenizer.get_vocab_size(), dtype="<u4").tobytes()
        self.raw = [raw[k : k + 4] for k in range(0, len(raw), 4)]
        self.first, self.inner = _Memo(self, ""), _Memo(self, " ")
        #: The same of words without the signs after them, for many texts at once.
        self.starts, self.words, self.blank = _AgedMemo(self, ""), _AgedMemo(self, " "), self.shown[ord(" ")]

    def whole(self, text: str) -> bytes:
        """The library's own call."""
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, pretoken: str) -> bytes:
        return self.shown_word(pretoken.translate(self.shown))

    def shown_word(self, shown: str) -> bytes:
        return b"".join([self.raw[t.id] for t in self.model.tokenize(shown)])

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(a in text for a in self.added):
            return self.whole(text)
        first, inner, lines = self.first, self.inner.__getitem__, []
        try:
            for line in text.split("\n"):
                pieces = line.split(" ")
                pieces[0] = first[pieces[0]]
                pieces[1:] = map(inner, pieces[1:])
                lines.append(b"".join(pieces))
        except _Whole:
            return self.whole(text)
        return self.newline.join(lines)

    def _line(self, memo: _Memo, piece: str) -> bytes:
        """A run of signs after a letter or digit, up to the piece's end, is a pre-token: words are
        remembered without it."""
        word = piece.rstrip(punctuation)
        if word and word != piece and word[-1] < _SETTLED and (word[-1].isalpha() or word[-1] in digits):
            return memo[word] + self.starts[piece[len(word) :]]
        return memo[piece]

    def _lines(self, memo: _Memo, piece: str) -> bytes | None:
        """A piece between blanks, line breaks included; None if its text must be encoded whole."""
        try:
            if "\n" not in piece:
                return self._line(memo, piece)
            head, *rest = piece.split("\n")
            return self.newline.join([self._line(memo, head), *[self._line(self.starts, r) for r in rest]])
        except _Whole:
            return None

    def _together(self, texts: pa.Array) -> list[bytes]:
        lists = pc.split_pattern(texts, " ")
        at, pieces = np.asarray(lists.offsets), lists.values.dictionary_encode()
        distinct = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = list(map(self.words.get, distinct))
        for k, ids in enumerate(known):
            if ids is None:
                known[k] = self._lines(self.words, distinct[k])
        firsts, index = lists.values.take(pa.array(at[:-1])).to_pylist(), np.array(pieces.indices)
        index[at[:-1]] = np.arange(len(known), len(known) + len(texts))
        known += [self._lines(self.starts, p) for p in firsts]
        ids = pa.array(known, pa.large_binary()).take(pa.array(index))
        whole = np.logical_or.reduceat(np.asarray(ids.is_null()), at[:-1])
        for a in self.added:
            if " " in a or pc.any(pc.match_substring(pieces.dictionary, a)).as_py():
                whole |= np.asarray(pc.match_substring(texts, a))
        ends = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1)[at].tolist()
        raw = memoryview(ids.buffers()[2] or b"")
        return [self.whole(texts[k].as_py()) if w else bytes(raw[a:b]) for k, (w, a, b) in enumerate(zip(whole.tolist(), ends, ends[1:]))]

    def many(self, texts: pa.Array):
        """``ids`` of each text of a string array, in order."""
        texts = texts.fill_null("")
        sizes = np.cumsum(np.asarray(pc.binary_length(texts)).astype(np.int64)) // BATCH_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(texts)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                yield from self._together(texts.slice(a, b - a))


def encoder(name: str = VOCABULARY) -> BpeEncoder:
    """The worker's encoder of a vocabulary file (a name in ``public_tokenizers`` or a path)."""
    from vellumine.llm.common import one_model

    def load() -> BpeEncoder:
        if os.path.sep in name:
            return BpeEncoder(name)
        import public_tokenizers

        return BpeEncoder(public_tokenizers.path(name))

    return one_model(("bpe", name), load)
