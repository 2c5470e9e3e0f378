"""Language identification by cross-parsing entropy.

For each language a suffix automaton of its labelled text recognises every
substring of that text. A document is parsed greedily into longest matches
against each automaton; the language that needs the fewest phrases for a
character wins. Automata are built on a bounded sample of whole labelled texts,
about ``SAMPLE_CHARS`` characters of each language, taken in order of a hash;
all texts are then parsed whole.

Every character of the samples has a symbol of its own, small and capital
letters one for both, whatever the number of scripts; a character that a
language's sample lacks ends the phrase in that language, and the next phrase,
which it begins, goes on with the match after it. For speed the automata's
steps stand in one open-addressed table, whose size follows the samples and not
the alphabet, and texts are cut into strips of ``STRIP`` characters that advance
in step; the phrases are those of a parse from the text's beginning.

Defined results: a null text, or one without a letter, is ``und`` with score
0.0; so is every text if nothing was learned; if languages tie, the smaller
code wins; repeated rows are each predicted; an empty table gives an empty
result; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_texts

#: Bounds on the sample of each language: texts are taken, whole, until they have so many characters, from so many
#: documents. Longer texts come after all others, the shortest first, and never take a sample above twice its bound.
SAMPLE_CHARS = 120_000
SAMPLE_DOCS = 400
SAMPLE_LONGEST = 1_000
#: Characters of the strips that are parsed in step; results do not depend on it.
STRIP = 512
#: Steepness with which phrases a character become a score.
STEEPNESS = 60.0

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class SuffixAutomaton:
    """Of a sequence of symbols: ``next[state]`` maps a symbol to a state; 0 is the root."""

    def __init__(self, symbols: list[int]):
        self.next: list[dict[int, int]] = [{}]
        length, link, last = [0], [-1], 0
        for s in symbols:
            cur = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and s not in self.next[p]:
                self.next[p][s] = cur
                p = link[p]
            if p >= 0:
                q = self.next[p][s]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(s) == q:
                        self.next[p][s] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur


class StepTable:
    """From (state, symbol) to the next state, by open addressing with linear probes; steps may be missing."""

    def __init__(self, keys: np.ndarray, targets: np.ndarray):
        bits = max(4, (3 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.targets = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        at, left = self._home(keys), np.arange(len(keys))
        while len(left):
            free = np.flatnonzero(self.keys[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[at[put]], self.targets[at[put]] = keys[left[put]], targets[left[put]]
            rest = np.ones(len(left), bool)
            rest[put] = False
            at, left = (at[rest] + 1) & self.mask, left[rest]

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _GOLDEN) >> self.shift).view(np.int64)

    def step(self, keys: np.ndarray) -> np.ndarray:
        """The next state for each key, -1 where there is none."""
        at = self._home(keys)
        held = self.keys.take(at)
        to = np.where(held == keys, self.targets.take(at), np.int32(-1))
        left = np.flatnonzero((held != keys) & (held >= 0))
        at = at[left]
        while len(left):
            at = (at + 1) & self.mask
            held = self.keys.take(at)
            found = held == keys[left]
            to[left[found]] = self.targets.take(at[found])
            stay = ~found & (held >= 0)
            at, left = at[stay], left[stay]
        return to


class LanguageModel:
    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        seen = np.unique(np.concatenate([codepoints(t) for t in samples.values()] + [np.zeros(0, np.uint32)])).tolist()
        fold = lambda v: ord(chr(v).lower()) if len(chr(v).lower()) == 1 else v
        #: The symbol of each character; 0 is every character that no sample has.
        self.symbol = np.zeros(0x110000, np.int32)
        for k, v in enumerate(sorted({fold(v) for v in seen}), 1):
            self.symbol[v] = k
            up = chr(v).upper()  # capital letters stand for their small ones
            if len(up) == 1 and fold(ord(up)) == v:
                self.symbol[ord(up)] = k
        for v in seen:
            self.symbol[v] = self.symbol[fold(v)]
        self.width = int(self.symbol.max()) + 1
        keys, targets, self.roots, base = [], [], [], 0
        #: By language and symbol, the state after a phrase's first character; the root where the language lacks it.
        self.first = np.zeros((len(self.langs), self.width), np.int32)
        for j, lang in enumerate(self.langs):
            automaton = SuffixAutomaton(self.symbol[codepoints(samples[lang])].tolist()).next
            for state, out in enumerate(automaton):
                for s, to in out.items():
                    keys.append((base + state) * self.width + s)
                    targets.append(base + to)
            self.first[j] = base
            for s, to in automaton[0].items():
                self.first[j, s] = base + to
            self.roots.append(base)
            base += len(automaton)
        self.table = StepTable(np.array(keys, np.int64), np.array(targets, np.int32))

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases by text and language, and the texts' lengths in characters.

        All strips are parsed in step as if a phrase began with each. Then each
        strip's last phrase is followed on into the strips after it until it ends
        where one of theirs does; from there on both parses are the same.
        """
        n = np.array([len(t) for t in texts], np.int64)
        sym = self.symbol[codepoints("".join(texts))]
        ends = np.cumsum(n)
        strips = -(-n // STRIP)
        owner = np.repeat(np.arange(len(texts)), strips)
        first = np.cumsum(strips) - strips
        start = (ends - n)[owner] + (np.arange(len(owner)) - first[owner]) * STRIP
        stop = np.minimum(start + STRIP, ends[owner])
        cut, state = self._parse_strips(sym, start, stop)
        extra, met = self._follow(sym, cut, state, stop, ends[owner])
        count = np.ones((len(self.langs), len(texts)))
        for j in range(len(self.langs)):
            before = np.concatenate([[0], np.cumsum(cut[j], dtype=np.int64)])
            text, strip, at = np.flatnonzero(strips), first[strips > 0], start[first[strips > 0]]
            while len(text):  # from the strip whose parse holds from ``at`` on to the one that its last phrase meets
                count[j, text] += before[stop[strip]] - before[at] + extra[j, strip]
                to = met[j, strip]
                more = to < ends[text]
                text, to = text[more], to[more]
                strip, at = first[text] + (to - (ends - n)[text]) // STRIP, to + 1
        return count, n

    def _advance(self, lang: np.ndarray, state: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States after symbols ``s``, and where a missing step ended the phrase: the next one begins with the symbol."""
        to = self.table.step(state.astype(np.int64) * self.width + s)
        missing = to < 0
        return np.where(missing, self.first[lang, s], to), missing

    def _parse_strips(self, sym: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By language: where phrases end, each strip parsed by itself, and the state at each strip's end."""
        langs = np.arange(len(self.langs))
        order = np.argsort(start - stop, kind="stable")
        at, size = start[order], (stop - start)[order]
        alive = np.searchsorted(-size, -np.arange(STRIP), "left")  # strips longer than each step
        cut = np.zeros((len(langs), len(sym)), bool)
        state = np.repeat(np.array(self.roots, np.int32)[:, None], len(at), 1)
        for i in range(int(size[0]) if len(size) else 0):
            m = alive[i]
            s = np.tile(sym[at[:m] + i], len(langs))
            to, missing = self._advance(np.repeat(langs, m), state[:, :m].ravel(), s)
            state[:, :m] = to.reshape(-1, m)
            cut[:, at[:m] + i] = missing.reshape(-1, m)
        out = np.empty_like(state)
        out[:, order] = state
        return cut, out

    def _follow(self, sym: np.ndarray, cut: np.ndarray, state: np.ndarray, stop: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By language and strip: phrases that end behind it before both parses meet, and the place where they do (the text's end if nowhere)."""
        extra, met = np.zeros(state.shape, np.int64), np.repeat(end[None, :], len(state), 0)
        lang, strip = np.nonzero(np.repeat((stop < end)[None, :], len(state), 0))
        at, now = stop[strip], state[lang, strip]
        while len(at):
            now, missing = self._advance(lang, now, sym[at])
            extra[lang[missing], strip[missing]] += 1
            same = missing & cut[lang, at]
            met[lang[same], strip[same]] = at[same]
            at = at + 1
            on = ~same & (at < end[strip])
            lang, strip, at, now = lang[on], strip[on], at[on], now[on]
        return extra, met

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        lang, score = ["und"] * len(texts), np.zeros(len(texts))
        # Most texts show a letter at once; the rest are searched to the end.
        todo = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if self.langs else []
        if todo:
            count, n = self.phrases([texts[i] for i in todo])
            rate = count / n
            best = rate.argmin(0)
            w = np.exp(STEEPNESS * (rate.min(0) - rate))
            score[todo] = 1 / w.sum(0)
            for i, b in zip(todo, best):
                lang[i] = self.langs[b]
        return lang, score


def fit_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Automata of a bounded sample of the labelled texts in ``docs``, each taken whole.

    Only hashes and lengths are ranked, at most ``SAMPLE_DOCS`` for each
    language; a second scan brings the texts that were chosen, and these alone,
    to the driver.
    """
    # The hash covers the text, so rows that share an id or have none are drawn by themselves.
    keyed = docs.select(F.col(lang_col).alias("lang"), F.xxhash64(id_col, text_col, F.lit("language")).alias("h"), F.col(text_col).alias("t")).where("lang is not null and t is not null and trim(t) != ''")
    rows = keyed.select("lang", "h", F.length("t").alias("n"))
    rows = rows.select("lang", "h", "n", F.when(F.col("n") > SAMPLE_LONGEST, F.col("n")).otherwise(0).alias("late"))
    # A first cut inside each partition keeps a common language from meeting in one task.
    part = rows.groupBy("lang", F.pmod("h", F.lit(SAMPLE_DOCS)).alias("slot")).agg(F.min(F.struct("late", "h", "n")).alias("x")).select("lang", "x.*")
    by_rank = Window.partitionBy("lang").orderBy("late", "h")
    before = F.coalesce(F.sum("n").over(by_rank.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = part.withColumn("before", before).where(F.col("before") < SAMPLE_CHARS).where((F.col("late") == 0) | (F.col("before") == 0) | (F.col("before") + F.col("n") <= 2 * SAMPLE_CHARS))
    picked = chosen.select(F.col("lang").alias("c_lang"), F.col("h").alias("c_h"), "late")
    # At most SAMPLE_DOCS rows for each language, of which the automata hold far more.
    drawn = keyed.join(F.broadcast(picked), (F.col("lang") == F.col("c_lang")) & (F.col("h") == F.col("c_h"))).groupBy("lang", "late", "h").agg(F.min("t").alias("t"))
    samples: dict[str, list[str]] = {}
    for lang, t in drawn.orderBy("lang", "late", "h").select("lang", "t").toLocalIterator():
        samples.setdefault(lang, []).append(t)
    return LanguageModel({k: "\n".join(v) for k, v in samples.items()})


def predict_language(docs: DataFrame, model: LanguageModel, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns of ``docs``, lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(texts: pa.Array) -> list[pa.Array]:
        lang, score = shared.value.predict(texts.to_pylist())
        return [pa.array(lang, pa.string()), pa.array(score)]

    return map_texts(docs, text_col, kernel, "lang_pred string, score double", keep)
