"""Language identification by unigrams with the segmentation summed out.

Each language has a probability for every piece of a fixed public vocabulary.  A word's
likelihood is the sum over all ways to cut it into pieces, computed by a forward pass over
its letters; a text's log-likelihood adds up those of its words.  The probabilities are
fitted by expectation maximisation: the expected number of uses of each piece, over all
segmentations of the training words, by forward and backward passes inside tasks.

Fitting takes a bounded sample: about ``MAX_FIT_DOCS`` documents, chosen by a hash of their
text; prediction reads every whole text.  What reaches the driver has languages times
vocabulary numbers.

Rows: a null text or one without a letter is ``und`` with score 0.  Ties go to the language
first in the alphabet.  With no training row every text with a letter is ``und`` too.
Repeated rows are predicted alike; an empty table gives an empty result.  The columns of the
result replace input columns of the same name; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, release

UNKNOWN = "und"
MAX_FIT_DOCS = 20_000
ROUNDS = 3
SMOOTHING = 0.05
_UNKNOWN_LETTER = 1e-7
_LETTERS = regex.compile(r"\p{L}+")
#: Longer runs of letters are scored in stretches of this many.
LONGEST = 4096
_FIT_LONGEST = 48
_CHUNK_CHARS = 4_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def load_pieces(path: str) -> list[str]:
    """Lower-case pieces of letters in the vocabulary, with or without the mark of a word start."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)))
    return sorted({p for p in pieces if p == p.lower() and (p.replace("▁", "a", 1).isalpha())})


class Pieces:
    """Vocabulary lookup by the hash of a piece's letters, for whole arrays at once."""

    def __init__(self, pieces: list[str]):
        self.size, self.longest = len(pieces), max(map(len, pieces))
        hashes = np.zeros(self.size, np.uint64)
        for k, piece in enumerate(pieces):
            value = 0
            for letter in piece:
                value = value * int(_BASE) + ord(letter) & (1 << 64) - 1
            hashes[k] = value
        self.hashes = np.append(hashes, np.uint64(0))
        self.tables, left = [], np.arange(self.size)
        while len(left):
            table = np.full(1 << 18, self.size, np.int32)
            slots = self._slots(hashes[left], len(self.tables))
            table[slots] = left
            self.tables.append(table)
            left = left[table[slots] != left]

    @staticmethod
    def _slots(hashes: np.ndarray, k: int) -> np.ndarray:
        return ((hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * k) >> np.uint64(46)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Index of each piece; ``size`` if there is none."""
        out = np.full(len(hashes), self.size, np.int32)
        for k, table in enumerate(self.tables):
            at = table[self._slots(hashes, k)]
            hit = self.hashes[at] == hashes
            out[hit] = at[hit]
        return out


def _letters(words: list[str], length: int) -> np.ndarray:
    """One row of code points per word: the mark of a word start, the letters, zeros."""
    out = np.zeros((len(words), length + 1), np.uint64)
    out[:, 0] = 0x2581
    out[:, 1:] = np.array(words, f"<U{length}").view(np.uint32).reshape(len(words), length)
    return out


def _by_length(words: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Indexes of words of about the same length, at most ``most`` together, ascending."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    edges = np.searchsorted(lengths[order], [9, 13, 17, 25, 49, 129, 513])
    for part in np.split(order, edges):
        yield from np.split(part, range(most, len(part), most)) if len(part) else ()


def word_scores(words: np.ndarray, pieces: Pieces, probability: np.ndarray) -> np.ndarray:
    """Log-likelihood of each word in each language, summed over all segmentations.

    ``probability`` has a row per piece, a row of zeros and the row of an unknown letter.
    """
    out = np.zeros((len(words), probability.shape[1]))
    for part in _by_length(words, 20_000):
        chosen = [words[k] for k in part]
        total = np.array([len(w) + 1 for w in chosen])
        letters = _letters(chosen, int(total[-1]) - 1)
        alpha = {0: np.ones((len(part), probability.shape[1]))}
        hashes: dict[int, np.ndarray] = {}
        scale, done = np.zeros((len(part), probability.shape[1])), 0
        for end in range(1, int(total[-1]) + 1):
            hashes[end - 1] = np.zeros(len(part) - done, np.uint64)
            hashes.pop(end - 1 - pieces.longest, None)
            alpha.pop(end - 1 - pieces.longest, None)
            acc = np.zeros((len(part) - done, probability.shape[1]))
            for start, h in hashes.items():
                h *= _BASE
                h += letters[done:, end - 1]
                at = pieces.find(h)
                if start == end - 1:
                    at[at == pieces.size] = pieces.size + 1
                acc += alpha[start] * probability[at]
            if end % 16 == 0:
                scale[done:] += np.log(acc)
                for start in alpha:
                    alpha[start] = alpha[start] / acc
                acc = np.ones_like(acc)
            alpha[end] = acc
            over = int(np.searchsorted(total, end, "right"))
            if over > done:  # the words that end here
                out[part[done:over]] = np.log(acc[:over - done]) + scale[done:over]
                hashes = {k: v[over - done:] for k, v in hashes.items()}
                alpha = {k: v[over - done:] for k, v in alpha.items()}
                done = over
    return out


def expected_uses(words: np.ndarray, counts: np.ndarray, pieces: Pieces, probability: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over all segmentations of the words, one language."""
    uses = np.zeros(pieces.size + 2)
    for part in _by_length(words, 4_000):
        chosen = [words[k] for k in part]
        total = np.array([len(w) + 1 for w in chosen])
        longest = int(total[-1])
        letters = _letters(chosen, longest - 1)
        spans: dict[tuple[int, int], np.ndarray] = {}
        for start in range(longest):
            h = np.zeros(len(part), np.uint64)
            for end in range(start + 1, min(longest, start + pieces.longest) + 1):
                h = h * _BASE + letters[:, end - 1]
                at = pieces.find(h)
                if end == start + 1:
                    at[at == pieces.size] = pieces.size + 1
                at[end > total] = pieces.size
                if (at != pieces.size).any():
                    spans[start, end] = at
        alpha, beta = np.zeros((2, longest + 1, len(part)))
        alpha[0] = 1
        beta[total, np.arange(len(part))] = 1
        ordered = sorted(spans)
        for start, end in sorted(spans, key=lambda s: s[1]):
            alpha[end] += alpha[start] * probability[spans[start, end]]
        for start, end in reversed(ordered):
            beta[start] += beta[end] * probability[spans[start, end]]
        weight = counts[part] / beta[0]
        for (start, end), at in spans.items():
            uses += np.bincount(at, alpha[start] * probability[at] * beta[end] * weight, minlength=len(uses))
    uses[pieces.size] = 0
    return uses


def held_out(id_col: str) -> Column:
    """Rows that no label is learned from; a null id is none of them."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def words_of(text: str) -> list[str]:
    found = _LETTERS.findall(text.lower())
    if any(len(w) > LONGEST for w in found):
        found = [w[k:k + LONGEST] for w in found for k in range(0, len(w), LONGEST)]
    return found


def _word_counts(rows: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            words = frame["text"].map(words_of).explode()
            pairs = pd.DataFrame({"lang": frame["lang"].loc[words.index].to_numpy(), "word": words.to_numpy()}).dropna()
            yield pairs.groupby(["lang", "word"], as_index=False).size().rename(columns={"size": "n"})

    counted = rows.select("lang", "text").mapInPandas(run, "lang string, word string, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n")).filter(F.length("word") <= _FIT_LONGEST)


def fit(rows: DataFrame, vocabulary: list[str], max_docs: int = MAX_FIT_DOCS, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages and their piece probabilities, learned from (text, lang), sampled by ``id`` too if there is one."""
    usable = rows.filter("text is not null and lang is not null")
    share = max_docs / max(1, usable.count())
    if share < 1:
        usable = usable.filter(F.pmod(F.xxhash64(*[c for c in ("id", "text") if c in usable.columns]), F.lit(1 << 30)) < int(share * (1 << 30)))
    counts = cut_lineage(_word_counts(usable))
    languages = [r.lang for r in counts.select("lang").distinct().orderBy("lang").collect()]
    size = len(vocabulary)
    model = np.full((size + 2, len(languages)), 1.0 / size)

    def set_fixed(model: np.ndarray) -> np.ndarray:
        model[size], model[size + 1] = 0, _UNKNOWN_LETTER
        return model

    model = set_fixed(model)
    for _ in range(rounds if languages else 0):
        def run(frames: Iterator[pd.DataFrame], model=model) -> Iterator[pd.DataFrame]:
            pieces = Pieces(vocabulary)
            for frame in frames:
                for lang, own in frame.groupby("lang"):
                    uses = expected_uses(own["word"].to_numpy(), own["n"].to_numpy(float), pieces, model[:, languages.index(lang)])
                    at = np.flatnonzero(uses[:size])
                    yield pd.DataFrame({"lang": languages.index(lang), "piece": at, "uses": uses[at]})

        # rounded, so that the order of the tasks does not show in the sums
        uses = counts.mapInPandas(run, "lang int, piece int, uses double").groupBy("lang", "piece").agg(
            F.sum(F.round(F.col("uses") * 65536).cast("long")).alias("uses")).toPandas()
        new = np.full((size + 2, len(languages)), SMOOTHING)
        new[uses["piece"], uses["lang"]] += uses["uses"] / 65536
        model = set_fixed(new / new[:size].sum(axis=0))
    release(counts)
    return languages, model


def predict(docs: DataFrame, languages: list[str], model: np.ndarray, vocabulary: list[str], text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the posterior of that language."""
    model = model.astype(np.float64)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double")
    place = kept.index(text_col)

    def classify(texts: list[str], pieces: Pieces) -> tuple[list[str], list[float]]:
        words = [words_of(t) for t in texts]
        sizes = np.array([len(w) for w in words])
        flat = np.array([x for w in words for x in w], object)
        codes, unique = pd.factorize(flat)
        by_word = word_scores(unique, pieces, model)
        total = np.zeros((len(texts), len(languages)))
        some = np.flatnonzero(sizes)
        if len(some):
            total[some] = np.add.reduceat(by_word[codes], (np.cumsum(sizes) - sizes)[some])
        best = total.argmax(axis=1)
        posterior = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return [languages[b] if n else UNKNOWN for b, n in zip(best, sizes)], np.where(sizes > 0, posterior, 0.0).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(vocabulary)
        for batch in batches:
            names, scores, texts, size = [], [], [], 0
            for k, text in enumerate(batch.column(place)):
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size > _CHUNK_CHARS or k == batch.num_rows - 1:
                    a, b = classify(texts, pieces) if languages else ([UNKNOWN] * len(texts), [0.0] * len(texts))
                    names, scores, texts, size = names + a, scores + b, [], 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*kept, "lang_pred", "score"])

    return docs.select(*kept).mapInArrow(run, schema)


def identify(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_FIT_DOCS) -> DataFrame:
    """Learn from the rows of ``docs`` that are not held out, then predict all of them."""
    vocabulary = load_pieces(vocabulary_path)
    train = docs.filter(F.col(id_col).isNotNull() & ~held_out(id_col)).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    languages, model = fit(train, vocabulary, max_docs)
    return predict(docs, languages, model, vocabulary, text_col)
