"""Token counts: count-only Viterbi over a unigram reading of a fixed vocabulary.

Aho-Corasick enumerates the vocabulary's pieces in a word; dynamic programming carries, for
each end, the best score and the number of pieces on the best path. Of paths of equal score
the one whose last piece is longest stays, and a character that no piece covers costs ten less
than the lowest score and counts its UTF-8 bytes (byte fallback): the rules of the unigram
model of the ``tokenizers`` library. The vocabulary's scores are whole numbers, so sums are
exact and words can be counted apart and remembered.

A text is normalised as the vocabulary expects: a blank before it unless it is empty, and each
blank becomes the word mark. Null and empty texts have 0 tokens. Repeated rows, ties and null
ids are counted row by row; other columns pass through untouched.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vellumine.llm.common import one_model
from vellumine.llm.lattice import MARK, VOCABULARY, Lattice, by_end, lattice

#: Words a worker remembers before it starts afresh; bounds memory only.
MEMO_WORDS = 400_000


def count_words(lat: Lattice, words: list[str]) -> np.ndarray:
    """Pieces on the best path of each word (not empty, without line breaks)."""
    word, start, end, piece = lat.edges(words)
    lone = piece < 0
    gain = np.where(lone, lat.unknown_score, lat.scores[np.maximum(piece, 0)])
    step = np.ones(len(piece), np.int64)
    step[lone] = lat.byte_length(word[lone], start[lone])
    offset = np.concatenate([[0], np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words)))])
    best, count = np.full(offset[-1], -np.inf), np.zeros(offset[-1], np.int64)
    best[offset[:-1]] = 0.0
    source, target = offset[word] + start, offset[word] + end
    for _, s in by_end(end):
        score, at = best[source[s]] + gain[s], target[s]
        heads = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        top = np.maximum.reduceat(score, heads)
        # Starts ascend within a target, so the first equal one is the longest piece.
        group = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(at))))
        hits = np.flatnonzero(score == top[group])
        first = hits[np.concatenate([[True], group[hits][1:] != group[hits][:-1]])]
        best[at[heads]] = top
        count[at[heads]] = count[source[s][first]] + step[s][first]
    return count[offset[1:] - 1]


_RUNS = re.compile(" +[^ ]*")


def words_of(text: str) -> list[str]:
    """The words whose lattices are a text's: each blank that does not follow a blank begins one;
    it is left out, further blanks stay at the word's start."""
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [run[1:] for run in _RUNS.findall(" " + text)]


class TokenCounter:
    def __init__(self, lat: Lattice):
        self.lat = lat
        self.words: dict[str, int] = {}
        self.cores: dict[str, int] = {"\n": 1}

    def learn(self, texts: list[str]) -> None:
        """Count the words of the texts that the memo lacks."""
        if len(self.words) >= MEMO_WORDS:
            self.words.clear()
        if len(self.cores) >= MEMO_WORDS:
            self.cores = {"\n": 1}
        seen: set[str] = set()
        for text in texts:
            if text:
                seen.update(words_of(text))
        split = {}
        for w in seen:
            if w not in self.words:
                split[w] = self.lat.parts(MARK + w.replace(" ", MARK))
        new = list({p for parts in split.values() for p in parts if p not in self.cores})
        for lo in range(0, len(new), 50_000):
            chunk = new[lo : lo + 50_000]
            self.cores.update(zip(chunk, count_words(self.lat, chunk).tolist(), strict=True))
        for w, parts in split.items():
            self.words[w] = sum([self.cores[p] for p in parts])

    def count(self, texts: list[str | None]) -> list[int]:
        out: list[int] = []
        for lo in range(0, len(texts), 1000):
            part = [t or "" for t in texts[lo : lo + 1000]]
            self.learn(part)
            get = self.words.__getitem__
            out += [sum(map(get, words_of(t))) if t else 0 for t in part]
        return out


def token_counts(df: DataFrame, text: str = "text", out: str = "n_tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` with a column ``out`` (long): tokens of its whole text. A column of that name is
    replaced. One pass, no shuffle; the text is not returned when ``df`` lacks it otherwise."""
    kept = [f for f in df.schema.fields if f.name.lower() != out.lower()]
    schema = T.StructType([*kept, T.StructField(out, T.LongType())])

    def run(batches):
        counter = one_model(("counts", vocabulary), lambda: TokenCounter(lattice(vocabulary)))
        for batch in batches:
            counts = counter.count(batch.column(batch.schema.get_field_index(text)).to_pylist())
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)
