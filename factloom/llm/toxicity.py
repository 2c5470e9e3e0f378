"""Toxicity by class-conditional Kneser-Ney models.

Words are hashed byte runs, lower-cased. For each class c an interpolated
Kneser-Ney bigram model backs off from (previous word, word) to the word and
from there, for words the class has rarely or never seen, to the word's stem
(its first characters). The weights with which contexts fall back, and the
choice of the word within its stem, are shared by the classes, so they cancel
from the comparison; the backoff counts of bigrams and stems are shared as
well, so that a rare expression says no more than its word and stem do.

A text's evidence is the difference of its two log-likelihoods, normalised by
the words of the span that is compared: the whole text, and the span of each of
``WINDOWS`` words that speaks most for the toxic class, which a long text cannot
dilute. Logistic weights for
these and the log of the number of words (chance maxima grow with it), fitted
on labelled rows that the models have not seen and corrected to the share of
toxic rows among all labels, turn them into a probability.

The models are fitted on a bounded sample of labelled rows: at most
``SAMPLE_ROWS`` ids and as many different texts of each class, in order of a
hash, and of these as many whole texts as ``SAMPLE_BYTES`` hold. A text counts
once, however many copies it has. Words and bigrams are counted in Spark; the
driver receives the tables of counts, which that bound limits too, and no text.
All texts are then scored whole.

Defined results: null or empty text, and text without words, has both means 0;
without any labelled row of one class every score is the share of the other
(0.0 if there are no labels at all), and so it is if no text of one class is
found; ids may be of any type; a doc_id labelled twice counts as toxic if
any of its labels does, and a text under both classes likewise; all texts of a
labelled id are labelled; labels that are null are skipped; repeated rows are
scored each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, byte_view, checkpoint, map_arrow, map_texts, mix, prefix_hash, range_hash, spans, string_array, words

#: Bounds on the labelled rows, and on the bytes of their texts, of each class that are fitted on.
SAMPLE_ROWS = 4500
SAMPLE_BYTES = 4 << 20
#: Kneser-Ney discount.
DISCOUNT = 0.75
#: Pseudo-counts with which the shared model enters a class's stem level.
SHARED = 20.0
#: Backoff counts of a bigram, shared by the classes.
BACKOFF = 10.0
WINDOWS = (1, 3, 12)
STEM_BYTES = 5
THRESHOLD = 0.3

#: Word bytes: letters, digits, apostrophe, and all bytes of non-ASCII characters.
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 39]] = True
WORD[128:] = True

_U = np.uint64


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words, hashes of their stems, and their document numbers."""
    parts = [_tokens(texts.slice(i, j - i), i) for i, j in spans(byte_view(texts)[1])] or [_tokens(texts, 0)]
    return tuple(map(np.concatenate, zip(*parts)))


def _tokens(texts: pa.Array, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = byte_view(texts)
    data = LOWER[data]
    # Upper-case letters of the Latin-1 block are C3 80 to C3 9E in UTF-8.
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    up = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
    data[up] += 0x20
    start, end, doc = words(data, offsets, WORD)
    p = prefix_hash(data)
    return range_hash(p, start, end), range_hash(p, start, np.minimum(end, start + STEM_BYTES)), doc + first


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _U(3) + b)


def _previous(word: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The word before each, or a start mark."""
    prev = np.ones_like(word)
    if len(word):
        prev[1:] = np.where(doc[1:] == doc[:-1], word[:-1], _U(1))
    return prev


def _counts(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    i = np.minimum(np.searchsorted(table, keys), max(len(table) - 1, 0))
    return np.where(table[i] == keys, i, -1) if len(table) else np.full(len(keys), -1)


_PAIR_SCHEMA = "pair bigint, prev bigint, word bigint, stem bigint, n0 bigint, n1 bigint"


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bigrams of (text, class) rows, each chunk's counted by class."""
    for b in batches:
        texts, classes = string_array(b.column(0)), np.asarray(b.column(1))
        for i, j in spans(byte_view(texts)[1]):
            word, stem, doc = tokens(texts.slice(i, j - i))
            prev, cls = _previous(word, doc), classes[i:j][doc]
            pair, at, of = np.unique(_pair(prev, word), return_index=True, return_inverse=True)
            n = [np.bincount(of[cls == c], minlength=len(pair)) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (pair.view(np.int64), *(k[at].view(np.int64) for k in (prev, word, stem)), *n)], names=[f.split()[0] for f in _PAIR_SCHEMA.split(", ")])


def _table(df: DataFrame, key: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """The rows of a bounded table of counts: its keys in order, and its other columns."""
    t = df.toArrow()
    keys = np.asarray(t.column(key)).view(np.uint64)
    order = np.argsort(keys, kind="stable")
    return keys[order], [np.asarray(t.column(c))[order] for c in t.column_names if c != key]


class KneserNeyPair:
    """Two class models with common tables of words, stems and bigrams, from rows (text, class)."""

    def __init__(self, rows: DataFrame):
        counted = map_arrow(rows, _count_pairs, _PAIR_SCHEMA).groupBy("pair")
        pairs = checkpoint(counted.agg(*[F.min(c).alias(c) for c in ("prev", "word", "stem")], F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
        self._fit_words(pairs)
        self._fit_pairs(pairs)

    def _fit_words(self, pairs: DataFrame) -> None:
        # Word level: Kneser-Ney continuation counts, distinct words before each word.
        seen = pairs.groupBy("word").agg(F.min("stem").alias("stem"), F.count_if(F.col("n0") > 0).alias("c0"), F.count_if(F.col("n1") > 0).alias("c1"))
        self.words, (stem, *cont) = _table(seen, "word")
        cont = np.stack(cont).astype(np.float64)
        n = np.maximum(cont.sum(1, keepdims=True), 1)
        # Stem level: word types of the class by stem, smoothed by both classes' types.
        types = (cont > 0).astype(np.float64)
        self.stems, of_word = np.unique(stem.view(np.uint64), return_inverse=True)
        by_stem = np.stack([np.bincount(of_word, t, len(self.stems)) for t in types])
        pooled = np.bincount(of_word, minlength=len(self.stems)) + 1.0
        pooled /= pooled.sum() + 1.0
        n_stem = np.maximum(by_stem.sum(1, keepdims=True), 1)
        shared = DISCOUNT * (by_stem > 0).sum(1, keepdims=True) / n_stem
        p_stem = np.maximum(by_stem - DISCOUNT, 0) / n_stem + np.maximum(shared, SHARED / n_stem) * pooled
        back = DISCOUNT * types.sum(1, keepdims=True) / n
        in_stem = 1.0 / np.maximum(np.bincount(of_word, minlength=len(self.stems)), 1)  # shared choice within a stem
        p_word = np.maximum(cont - DISCOUNT, 0) / n + back * (p_stem * in_stem)[:, of_word]
        # Words that neither class saw: the weights of falling back are shared, so only the stem speaks.
        self.stem_llr = np.log(p_stem[1] / p_stem[0]).astype(np.float32)
        self.word_llr = np.log(p_word[1] / p_word[0]).astype(np.float32)

    def _fit_pairs(self, pairs: DataFrame) -> None:
        # A bigram's backoff counts are shared: both classes together get BACKOFF of them, dealt as
        # context and word lead one to expect, so that a rare bigram says what its word says.
        heads = pairs.groupBy("prev").agg(F.sum("n0").alias("h0"), F.sum("n1").alias("h1"))
        prevs, got = _table(heads, "prev")
        total = np.stack([h.sum() for h in got]).astype(np.float64)
        head_llr = np.log(got[1] + SHARED * total[1] / total.sum()) - np.log(got[0] + SHARED * total[0] / total.sum())
        shared = pairs.sparkSession.sparkContext.broadcast((self.words, self.word_llr, prevs, head_llr))

        def ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words_, word_llr, prevs, head_llr = shared.value
            for b in batches:
                prev, word = (np.asarray(b.column(k)).view(np.uint64) for k in (1, 2))
                n0, n1 = (np.maximum(np.asarray(b.column(k)) - DISCOUNT, 0) for k in (3, 4))
                head = head_llr[np.searchsorted(prevs, prev)]
                share = 1 / (1 + np.exp(-head - word_llr[np.searchsorted(words_, word)]))
                ratio = np.log((n1 + BACKOFF * share) / (n0 + BACKOFF * (1 - share))) - head
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ratio.astype(np.float32))], names=["pair", "ratio"])

        self.pairs, (self.pair_llr,) = _table(map_arrow(pairs.select("pair", "prev", "word", "n0", "n1"), ratios, "pair bigint, ratio float"), "pair")
        shared.unpersist()

    def llr(self, word: np.ndarray, stem: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Log-likelihood ratio of each word, from the longest level that knows it."""
        i = _counts(stem, self.stems)
        out = np.where(i >= 0, self.stem_llr[i] if len(self.stems) else 0.0, 0.0).astype(np.float64)
        i = _counts(word, self.words)
        if len(self.words):
            np.copyto(out, self.word_llr[i], where=i >= 0)
        i = _counts(_pair(_previous(word, doc), word), self.pairs)
        if len(self.pairs):
            np.copyto(out, self.pair_llr[i], where=i >= 0)
        return out

    def features(self, texts: pa.Array) -> np.ndarray:
        """A row for each text: mean ratio of all words, greatest mean of a window of each width, log of the words."""
        word, stem, doc = tokens(texts)
        s = self.llr(word, stem, doc)
        out = np.zeros((len(texts), len(WINDOWS) + 2))
        n = np.bincount(doc, minlength=len(texts))
        out[:, 0] = np.bincount(doc, s, len(texts)) / np.maximum(n, 1)
        if len(s):
            total = np.concatenate(([0.0], np.cumsum(s)))
            ends = np.cumsum(n)[doc]
            i = np.arange(len(s))
            present = np.flatnonzero(n)
            for k, width in enumerate(WINDOWS):  # a shorter text is normalised by the width all the same
                mean = (total[np.minimum(i + width, ends)] - total[i]) / width
                out[present, 1 + k] = np.maximum.reduceat(mean, (np.cumsum(n) - n)[present])
            out[:, -1] = np.log1p(n)
        return out


class ToxicityModel:
    """A Kneser-Ney pair, broadcast once for calibration and scoring, and its calibration."""

    def __init__(self, share: float, pair: Broadcast[KneserNeyPair] | None = None, weights: np.ndarray | None = None):
        """share: of toxic rows among all labelled ones, the score where there is no pair."""
        self.pair, self.weights, self.prior = pair, weights, share

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.pair is None:
            return np.full(len(texts), self.prior)
        z = np.column_stack([self.pair.value.features(texts), np.ones(len(texts))]) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Newton's method; classes weigh as they occur."""
    scale = np.append(np.maximum(x.std(0), 1e-9), 1.0)
    x = np.column_stack([x, np.ones(len(x))]) / scale
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-8:
            break
    return w / scale


def _sample(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(text, toxic, held) of the bounded sample; held rows calibrate."""
    h = F.xxhash64("l_id", F.lit("toxicity"))
    picked = [known.where(F.col("l_toxic") == c).orderBy(h, "l_id").limit(SAMPLE_ROWS) for c in (0, 1)]
    # The ids are broadcast: at most twice SAMPLE_ROWS.
    rows = docs.where("d_text is not null").join(F.broadcast(picked[0].unionByName(picked[1])), F.col("d_id") == F.col("l_id"))
    rows = checkpoint(rows.groupBy(F.sha2("d_text", 256).alias("sha")).agg(F.max("l_toxic").alias("toxic"), F.max("d_text").alias("text")))
    sized = rows.select("sha", "toxic", F.octet_length("text").cast("long").alias("bytes"))
    first = [sized.where(F.col("toxic") == c).orderBy("sha").limit(SAMPLE_ROWS) for c in (0, 1)]
    in_order = Window.partitionBy("toxic").orderBy("sha").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A text longer than a sixteenth of the bound would crowd out too many others.
    fit = first[0].unionByName(first[1]).where(F.col("bytes") <= SAMPLE_BYTES // 16).withColumn("total", F.sum("bytes").over(in_order)).where(F.col("total") <= SAMPLE_BYTES)
    chosen = fit.select(F.col("sha").alias("c_sha"))
    return checkpoint(rows.join(F.broadcast(chosen), F.col("sha") == F.col("c_sha"), "left_semi").select("text", "toxic", (F.crc32("sha") % 4 == 3).alias("held")))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Fit on a sample of the labelled documents that ``SAMPLE_ROWS`` and ``SAMPLE_BYTES`` bound."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("l_id")).agg(F.max(F.when(F.col(label_col) != 0, 1).otherwise(0)).alias("l_toxic"))
    counts = dict(known.groupBy("l_toxic").count().collect())
    share = counts.get(1, 0) / max(sum(counts.values()), 1)
    if len(counts) < 2:
        return ToxicityModel(share)
    sample = _sample(docs.select(F.col(id_col).alias("d_id"), F.col(text_col).alias("d_text")), known)
    kinds = {(r[0], r[1]) for r in sample.select("toxic", "held").distinct().collect()}
    if len({toxic for toxic, _ in kinds}) < 2:
        return ToxicityModel(share)
    # Where either part lacks a class, all rows both fit and calibrate.
    apart = len(kinds) == 4
    pair = KneserNeyPair(sample.where(~F.col("held") if apart else F.lit(True)).select("text", F.col("toxic").cast("long")))
    shared = docs.sparkSession.sparkContext.broadcast(pair)
    del pair

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = string_array(b.column(0))
            for i, j in spans(byte_view(texts)[1]):
                f = shared.value.features(texts.slice(i, j - i))
                yield pa.RecordBatch.from_arrays([b.column(1).slice(i, j - i), pa.array(list(f), pa.list_(pa.float64()))], names=["toxic", "f"])

    # A row of a few numbers for each calibrating text.
    held = map_arrow(sample.where(F.col("held") if apart else F.lit(True)).select("text", "toxic"), features, "toxic int, f array<double>").collect()
    held.sort()
    x, y = np.array([r[1] for r in held]), np.array([r[0] for r in held])
    weights = _logistic(x, y)
    drawn = y.mean()
    weights[-1] += np.log(share / (1 - share)) - np.log(drawn / (1 - drawn))
    return ToxicityModel(share, shared, weights)


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep: list[str], text_col: str = "text", name: str = "score") -> DataFrame:
    """``keep`` columns of ``docs`` and the score, 0 to 1, of each whole text."""

    def kernel(texts: pa.Array) -> list[pa.Array]:
        return [pa.array(model.score(texts))]

    return map_texts(docs, text_col, kernel, f"{name} double", keep)


__all__ = ["THRESHOLD", "ToxicityModel", "fit_toxicity", "score_toxicity", "spans"]
