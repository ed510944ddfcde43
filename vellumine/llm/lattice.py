"""Segmentation lattices of words over a fixed public piece vocabulary.

The vocabulary's word mark stands only at the start of a piece, so no piece crosses into the
next word and a text's lattice is the chain of its words' lattices. Further, two neighbouring
characters that stand together in no piece part the lattice there; trailing characters of a
word that part it are handled apart, so that the memo's keys repeat more.

``Lattice.edges`` enumerates all pieces of many words by one Aho-Corasick pass; what runs over
the edges (best path, forward sums) proceeds position by position over all words at once.
"""

from __future__ import annotations

import os

import numpy as np

MARK = "▁"
VOCABULARY = "piece_bpe_32k.model"
_GAP = "\n"


class Lattice:
    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.pieces = [sp.id_to_piece(i) for i in ids]
        self.scores = np.array([sp.get_score(i) for i in ids], np.float64)
        self.automaton = ahocorasick.Automaton()
        self.pairs: set[str] = set()
        for k, piece in enumerate(self.pieces):
            if MARK in piece.lstrip(MARK):
                raise ValueError("a piece of the vocabulary crosses words")
            self.automaton.add_word(piece, (len(piece) << 20) | k)
            self.pairs.update(piece[i : i + 2] for i in range(len(piece) - 1))
        self.automaton.make_automaton()
        self.singles = {p for p in self.pieces if len(p) == 1}
        #: As in the unigram tokenizer: ten below the lowest score.
        self.unknown_score = float(self.scores.min()) - 10.0

    def parts(self, word: str) -> list[str]:
        """Pieces of the word whose lattices stand apart: line breaks, which no piece holds, and
        trailing characters that stand in no piece together with what is before them."""
        out = []
        for k, run in enumerate(word.split(_GAP)):
            if k:
                out.append(_GAP)
            while len(run) > 1 and run[-2:] not in self.pairs:
                out.append(run[-1])
                run = run[:-1]
            if run:
                out.append(run)
        return out

    def edges(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """All edges of the words' lattices: (word, start, end, piece), piece -1 for a character
        that no piece covers alone; ordered by end, then word, then start."""
        joined = _GAP.join(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        begins = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        flat = np.array([v for pair in self.automaton.iter(joined) for v in pair], np.int64).reshape(-1, 2)
        end, size, piece = flat[:, 0] + 1, flat[:, 1] >> 20, flat[:, 1] & 0xFFFFF
        chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        alone = np.ones(len(chars), bool)
        alone[end[size == 1] - 1] = False
        if len(words) > 1:
            alone[begins[1:] - 1] = False
        lone = np.flatnonzero(alone)
        end = np.concatenate([end, lone + 1])
        start = np.concatenate([end[: len(size)] - size, lone])
        piece = np.concatenate([piece, np.full(len(lone), -1)])
        word = np.searchsorted(begins, start, "right") - 1
        start, end = start - begins[word], end - begins[word]
        order = np.lexsort((start, word, end))
        self._chars, self._begins = chars, begins
        return word[order], start[order], end[order], piece[order]

    def byte_length(self, word: np.ndarray, start: np.ndarray) -> np.ndarray:
        """UTF-8 bytes of the character that begins there, for the words of the last ``edges``."""
        c = self._chars[self._begins[word] + start]
        return 1 + (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000)


class Trie:
    """The same edges for many words at once: all characters step through the vocabulary's trie
    together, one character deeper at a time. Rows of its table are the nodes with children, its
    columns the characters that occur below the first."""

    def __init__(self, pieces: list[str]):
        children: list[dict[str, int]] = [{}, {}]  # node 0 is the dead end, node 1 the root
        piece = [-1, -1]
        for k, p in enumerate(pieces):
            at = 1
            for c in p:
                if c not in children[at]:
                    children[at][c] = len(children)
                    children.append({})
                    piece.append(-1)
                at = children[at][c]
            piece[at] = k
        self.piece, self.row = np.array(piece), np.zeros(len(piece), np.int32)
        self.first, self.column = np.zeros(0x110000, np.int32), np.zeros(0x110000, np.int32)
        for c, node in children[1].items():
            self.first[ord(c)] = node
        inner = [k for k in range(2, len(children)) if children[k]]
        below = sorted({c for k in inner for c in children[k]})
        self.row[inner] = np.arange(1, len(inner) + 1)
        self.column[[ord(c) for c in below]] = np.arange(1, len(below) + 1)
        self.table = np.zeros((len(inner) + 1, len(below) + 1), np.int32)
        for r, k in enumerate(inner, 1):
            for c, node in children[k].items():
                self.table[r, self.column[ord(c)]] = node

    def edges(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """As ``Lattice.edges``; at most 65,536 words of at most 65,535 characters."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        begins = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        chars = np.frombuffer((_GAP.join(words) + _GAP).encode("utf-32-le"), np.uint32)
        lone = np.ones(len(chars), bool)
        lone[begins + sizes] = False
        column, node = self.column[chars], self.first[chars]
        start = np.flatnonzero(node)
        node = node[start]
        found, size = [], 1
        while len(start):
            hit = self.piece[node] >= 0
            found.append((start[hit], np.full(int(hit.sum()), size), self.piece[node[hit]]))
            row = self.row[node]
            go = np.flatnonzero(row)
            start, node = start[go], self.table[row[go], column[start[go] + size]]
            start, node = start[node > 0], node[node > 0]
            size += 1
        if found:
            lone[found[0][0]] = False
        bare = np.flatnonzero(lone)
        found = [*found[::-1], (bare, np.ones(len(bare), np.int64), np.full(len(bare), -1))]
        start, size, piece = (np.concatenate(x) for x in zip(*found))
        word = np.repeat(np.arange(len(words)), sizes + 1)[start]
        start = start - begins[word]
        end = start + size
        order = np.argsort(word.astype(np.uint16), kind="stable")  # 16 bits are sorted by radix
        order = order[np.argsort(end[order].astype(np.uint16), kind="stable")]
        return word[order], start[order], end[order], piece[order]


def by_end(end: np.ndarray):
    """Slices of edges with the same end, ascending."""
    if len(end):
        cuts = np.flatnonzero(np.diff(end)) + 1
        for a, b in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(end)]])):
            yield int(end[a]), slice(int(a), int(b))


_lattices: dict[str, Lattice] = {}


def lattice(name: str = VOCABULARY) -> Lattice:
    if name not in _lattices:
        if os.path.sep in name:
            path = name
        else:
            import public_tokenizers

            path = public_tokenizers.path(name)
        _lattices[name] = Lattice(path)
    return _lattices[name]


_tries: dict[str, Trie] = {}


def trie(name: str = VOCABULARY) -> Trie:
    if name not in _tries:
        _tries[name] = Trie(lattice(name).pieces)
    return _tries[name]
