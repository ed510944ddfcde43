"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary. The probability
of a word is the sum, over all its segmentations into pieces, of the product of the pieces'
probabilities: a forward pass over the word's lattice. A text's score for a language is the sum
of its words' logarithms, and the answer's score is its posterior under equal priors.

Fitting is expectation maximisation over the same lattices (forward and backward passes) on at
most about ``FIT_ROWS`` labelled rows a language, drawn by a hash of the id: the one bounded
sample here; all words of those rows count, split as in scoring. Scoring covers every whole text; words repeat, so each worker remembers them.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumine.llm.common import one_model
from vellumine.llm.lattice import MARK, VOCABULARY, by_end, lattice, trie

#: Labelled rows a language to fit on, in expectation.
FIT_ROWS = 400
ROUNDS = 3
UNDECIDED = "und"
#: A text of more words has the weight of so many in its score: words of a text are not independent
#: evidence, and a long text of none of the languages would else be sure of one by chance.
EVIDENCE_WORDS = 2.0
#: Words a worker remembers before it starts afresh; bounds memory only.
MEMO_WORDS = 300_000
#: Words beyond this length go through the automaton, whose positions are not bound to 16 bits.
LONGEST = 65_535
#: In fitting, words beyond the first length are cut where no piece spans two characters (which is
#: exact) and run in batches of their own, and batches close at the second number of characters.
CUT_CHARS = 64
BATCH_CHARS = 1 << 17
#: Words whose lattices are run together in scoring, and texts looked up together.
BATCH_WORDS = 8_192
BATCH_TEXTS = 250
#: What ``str.split`` splits at, for Spark.
SPACES = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
#: Pseudo-count of every piece in every language, and the probability of a bare character.
PRIOR = 0.01
BARE = 1e-7


def _places(words: list[str]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words)))])


def forward(words: list[str], prob: np.ndarray, vocabulary: str = VOCABULARY, inner: bool = False):
    """Log probability of each word in each language (words x languages); ``prob`` is pieces x
    languages with a last row for bare characters. ``inner`` gives the lattice's parts as well.
    Forward values are rescaled per position by a power that keeps long words in range."""
    long = any(len(w) > LONGEST for w in words) or len(words) > 1 << 16
    word, start, end, piece = (lattice if long else trie)(vocabulary).edges(words)
    place = _places(words)
    alpha, scale = np.zeros((place[-1], prob.shape[1])), np.zeros(place[-1])
    alpha[place[:-1]] = 1.0
    source, target = place[word] + start, place[word] + end
    for _, s in by_end(end):
        src, at = source[s], target[s]
        heads = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        base = np.maximum.reduceat(scale[src], heads)
        group = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(at))))
        part = alpha[src] * prob[piece[s]] * np.exp(scale[src] - base[group])[:, None]
        total = np.add.reduceat(part, heads, axis=0)
        peak = total.max(axis=1)
        alpha[at[heads]] = total / peak[:, None]
        scale[at[heads]] = base + np.log(peak)
    last = place[1:] - 1
    logs = np.log(np.maximum(alpha[last], 1e-300)) + scale[last][:, None]
    return (logs, alpha, scale, source, target, piece, end) if inner else logs


def _cut(word: str, pairs: set[str]) -> list[str]:
    """The parts of a word whose lattices stand apart."""
    at = [0, *(k for k in range(1, len(word)) if word[k - 1 : k + 1] not in pairs), len(word)]
    return [word[a:b] for a, b in zip(at, at[1:])]


def _batches(words: list[str], counts: np.ndarray, pairs: set[str]) -> list[tuple[list[str], np.ndarray]]:
    """Words and counts in batches of bounded size, long words cut and apart from the others."""
    short = [(w, n) for w, n in zip(words, counts.tolist()) if len(w) <= CUT_CHARS]
    parts: dict[str, float] = {}
    for w, n in zip(words, counts.tolist()):
        if len(w) > CUT_CHARS:
            for part in _cut(w, pairs):
                parts[part] = parts.get(part, 0) + n
    out = []
    for rows in (short, sorted(parts.items(), key=lambda r: len(r[0]))):
        lo, size = 0, 0
        for k, (w, _) in enumerate(rows):
            if k > lo and (size + len(w) > BATCH_CHARS or k - lo == 50_000):
                out.append(rows[lo:k])
                lo, size = k, 0
            size += len(w)
        if rows:
            out.append(rows[lo:])
    return [([w for w, _ in rows], np.array([n for _, n in rows], float)) for rows in out]


def fit(words: list[str], counts: np.ndarray, rounds: int = ROUNDS, vocabulary: str = VOCABULARY) -> np.ndarray:
    """Piece probabilities (with the bare character last) of one language's word counts."""
    n = len(lattice(vocabulary).pieces)
    prob = np.append(np.full(n, 1.0 / n), BARE)
    batches = _batches(words, counts, lattice(vocabulary).pairs)
    for _ in range(rounds if words else 0):
        expected = np.full(n, PRIOR)
        for part, weight in batches:
            logs, alpha, scale, source, target, piece, end = forward(part, prob[:, None], vocabulary, True)
            place = _places(part)
            a = np.log(np.maximum(alpha[:, 0], 1e-300)) + scale
            beta = np.full(place[-1], -np.inf)
            beta[place[1:] - 1] = 0.0
            lp = np.log(prob)[piece]
            for _, s in reversed(list(by_end(end))):  # all edges out of a place end later
                np.logaddexp.at(beta, source[s], lp[s] + beta[target[s]])
            word = np.searchsorted(place, source, "right") - 1
            share = np.exp(a[source] + lp + beta[target] - logs[word, 0]) * weight[word]
            known = piece >= 0
            expected += np.bincount(piece[known], share[known], n)
        prob = np.append(expected / expected.sum(), BARE)
    return prob


def labelled_sample(df: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """About ``rows`` rows of each label, the same at every run: those whose id hash is small."""
    usable = df.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = [(r["lang"], r["count"]) for r in usable.groupBy("lang").count().collect()]  # a row a language
    if not sizes:
        return usable.limit(0)
    hashed = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("lang")), F.lit(1 << 30)) / float(1 << 30)
    share = F.lit(0.0)
    for lang, n in sizes:
        share = F.when(F.col("lang") == lang, float(rows) / n).otherwise(share)
    return usable.filter(hashed < share)


def train(df: DataFrame, rows: int = FIT_ROWS, rounds: int = ROUNDS, vocabulary: str = VOCABULARY) -> tuple[list[str], np.ndarray]:
    """(languages, pieces x languages). Each language is fitted in a task of its own on word
    counts; what comes to the driver is one vector of the vocabulary's size a language."""

    words = labelled_sample(df, rows).select("lang", F.explode(F.split("text", SPACES)).alias("word")).filter("word <> ''")
    counts = words.groupBy("lang", "word").count()

    def run(table: pa.Table) -> pa.Table:
        marked = [MARK + w for w in table.column("word").to_pylist()]
        prob = fit(marked, np.array(table.column("count").to_pylist()), rounds, vocabulary)
        raw = io.BytesIO()
        np.save(raw, prob.astype(np.float64))
        return pa.table({"lang": pa.array([table.column("lang")[0].as_py()]), "model": pa.array([raw.getvalue()], pa.binary())})

    models = sorted(counts.groupBy("lang").applyInArrow(run, "lang string, model binary").collect())
    if not models:
        return [], np.zeros((0, 0))
    return [m["lang"] for m in models], np.stack([np.load(io.BytesIO(m["model"])) for m in models], axis=1)


class Scorer:
    def __init__(self, languages: list[str], prob: np.ndarray, vocabulary: str):
        self.languages, self.prob, self.vocabulary = languages, prob, vocabulary
        self._reset()

    def _reset(self) -> None:
        self.row: dict[str, int] = {}
        self.logs = np.zeros((MEMO_WORDS, len(self.languages)))

    def learn(self, texts: list[str]) -> None:
        """Score the texts' words that are not remembered yet. The table is laid out once; only one
        batch of texts with more new words than that has a larger one for its time."""
        seen: set[str] = set()
        for t in texts:
            seen.update(t.split())
        new = [w for w in seen if w not in self.row]
        if len(self.row) + len(new) > MEMO_WORDS:
            self._reset()
            new = list(seen)
            if len(new) > MEMO_WORDS:
                self.logs = np.zeros((len(new), len(self.languages)))
        for lo in range(0, len(new), BATCH_WORDS):
            chunk = new[lo : lo + BATCH_WORDS]
            at = len(self.row)
            self.logs[at : at + len(chunk)] = forward([MARK + w for w in chunk], self.prob, self.vocabulary)
            self.row.update(zip(chunk, range(at, at + len(chunk))))

    def answer(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        labels, scores = [], []
        for lo in range(0, len(texts), BATCH_TEXTS):
            part = [t or "" for t in texts[lo : lo + BATCH_TEXTS]]
            if self.languages:
                self.learn(part)
            get = self.row.__getitem__
            for t in part:
                words = t.split()
                if not self.languages or not any(map(str.isalpha, t)):
                    labels.append(UNDECIDED)
                    scores.append(0.0)
                    continue
                total = self.logs[list(map(get, words))].sum(axis=0)
                k = int(total.argmax())
                labels.append(self.languages[k])
                scores.append(float(1.0 / np.exp((total - total[k]) / max(1.0, len(words) / EVIDENCE_WORDS)).sum()))
        return labels, scores


def predict(df: DataFrame, languages: list[str], prob: np.ndarray, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` with ``lang_pred`` and ``score`` (columns of those names are replaced). ``und`` with
    score 0 if the text is null, empty or without a letter, or if nothing could be learned.
    One pass without a shuffle; ties go to the first language in order. The model, of fixed size
    a language, travels with the tasks as a broadcast."""
    kept = [f for f in df.schema.fields if f.name.lower() not in ("lang_pred", "score")]
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    sent = df.sparkSession.sparkContext.broadcast((languages, prob))

    def run(batches):
        import hashlib

        names, table = sent.value
        key = hashlib.sha1(repr(names).encode() + table.tobytes()).hexdigest()
        scorer = one_model(("languages", key), lambda: Scorer(names, table, vocabulary))
        for batch in batches:
            labels, scores = scorer.answer(batch.column(batch.schema.get_field_index(text)).to_pylist())
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)
