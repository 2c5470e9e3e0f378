"""Suffix-array deduplication by a depth-limited radix sort.

Suffixes are ordered only through their first ``DEPTH`` bytes, most significant
digit first, and a pass orders only what the pass before left tied; suffixes
whose group has one member are done. Groups that are equal through the last
digit are exactly the repeated windows, and every member but a group's first
(by doc_id, then start) is marked; the bytes that marked windows cover go.

Digits are chosen so that few records move:

1. The first digit of a window is the least hash among its 32-byte grams. Equal
   windows have equal digits, and neighbouring windows mostly share theirs, so
   a *run* of about 36 windows travels as one record.
2. The second digit is the 128-bit digest of a run's bytes: windows of equal
   runs are repeated as a whole, and only the first run of a group stays in play.
3. What is then left beside other runs of its first digit (about one run in
   25) is ordered by the text's own bytes, 8 a digit and most significant first,
   through the whole depth; each pass orders only the windows still tied.

Before each shuffle a task keeps only the first of its own equal runs or
windows, so a string that a third of all documents contain arrives at most once
from each chunk of input. A first digit that more than a thousandth of the runs
of a sample of documents have is dealt out by run from the beginning, and its
windows, like those of digits with more than ``HOT`` different runs, are dealt
out by the 128-bit digest of their bytes, which then stands for the later
digits. The sample steers where records go; the result does not depend on it.

Defined results: null and empty texts, and texts under 100 bytes, lose nothing;
repeated and null ids are told apart by text (ordered by id, null last, then
text), and rows equal in id and text get equal results; an empty table gives an
empty result; other columns are kept or ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_view, fresh, map_arrow, spans, string_array
from .packing import CELL_SCHEMA, by_part, cells, deal, gather, pack, part_of, parts_of
from .suffix_kernel import DEPTH, first_of, radix_groups, runs, window_digits

#: Runs of one first digit up to which they are compared in one place.
HOT = 512
#: One document in so many is sampled for frequent first digits, and the share of its runs that makes one frequent.
SAMPLED = 100
FREQUENT = 1000

_RUN = [np.uint64, np.uint64, np.uint64, np.int64, np.int32, np.int32, np.uint8]
_SPAN = [np.int64, np.int32, np.int32]
_WINDOW = [np.uint64, np.uint64, np.uint64, np.int64, np.int32]
_SPAN_SCHEMA = "key bigint, lo int, n int, digit bigint, hot int"


def _joined(doc: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of windows, sorted; those that touch become one."""
    if not len(doc):
        return doc, lo, n
    order = np.lexsort((lo, doc))
    doc, lo, n = doc[order], lo[order], n[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (lo[1:] != lo[:-1] + n[:-1])
    at = np.flatnonzero(new)
    return doc[at], lo[at], np.add.reduceat(n, at).astype(np.int32)


def _span_batch(doc: np.ndarray, lo: np.ndarray, n: np.ndarray, digit: np.ndarray | None = None, hot: np.ndarray | None = None) -> pa.RecordBatch:
    none = pa.nulls(len(doc), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(doc, pa.int64()), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32)), none if digit is None else pa.array(digit.view(np.int64)), none.cast(pa.int32()) if hot is None else pa.array(hot.astype(np.int32))],
        names=["key", "lo", "n", "digit", "hot"],
    )


def _again(perm: np.ndarray, head: np.ndarray, doc: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """All but the first of each group. Equal records at one place are one row read twice, and none of them is later."""
    tie = np.zeros(len(perm), bool)
    tie[1:] = ~head[1:] & (doc[perm][1:] == doc[perm][:-1]) & (lo[perm][1:] == lo[perm][:-1])
    return perm[~head & ~tie]


def _each_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, tuple[np.ndarray, ...]]]:
    """Keys and runs of each chunk of (key, text) rows that has any."""
    for b in batches:
        keys, (data, offsets) = np.asarray(b.column(0)), byte_view(string_array(b.column(1)))
        for i, j in spans(offsets):
            got = runs(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            if len(got[0]):
                yield keys[i:j], got


def _sampled(texts: DataFrame) -> tuple[np.ndarray, int]:
    """First digits, at most ``FREQUENT``, that so large a share of the sampled runs has; and about how many bytes all texts have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = len(byte_view(string_array(b.column(1)))[0])
            total = pa.RecordBatch.from_pydict({"digit": pa.array([None], pa.int64()), "n": pa.array([0], pa.int64()), "size": pa.array([size], pa.int64())})
            yield total
            for _, (_, _, _, digit, *_) in _each_chunk([b]):
                d, n = np.unique(digit, return_counts=True)
                none = np.zeros(len(d), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(d.view(np.int64)), pa.array(n), pa.array(none)], names=["digit", "n", "size"])
                yield pa.RecordBatch.from_pydict({"digit": pa.array([None], pa.int64()), "n": pa.array([len(digit)], pa.int64()), "size": pa.array([0], pa.int64())})

    counts = map_arrow(texts.where(F.pmod(F.xxhash64("key"), F.lit(SAMPLED)) == 0), run, "digit bigint, n bigint, size bigint")
    # The row without a digit counts all runs, so it comes first.
    rows = counts.groupBy("digit").agg(F.sum("n").alias("n"), F.sum("size").alias("size")).orderBy(F.desc("n"), F.col("digit").asc_nulls_first()).limit(FREQUENT + 1).collect()
    whole = next((r for r in rows if r.digit is None), None)
    often = [r.digit for r in rows if r.digit is not None and r.n >= max(2, whole.n / FREQUENT)]
    return np.sort(np.array(often, np.int64).view(np.uint64)), (whole.size if whole else 0) * SAMPLED


def _first_pass(parts: int, frequent: np.ndarray):
    """Texts to runs, dealt by first digit, or by run where that digit is frequent. A chunk's repeated runs are marked at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, (owner, lo, n, digit, whole, whole2, inner) in _each_chunk(batches):
            doc = keys[owner]
            perm, head = first_of((digit, whole, whole2), (doc, lo))
            first, again = perm[head], _again(perm, head, doc, lo)
            spread = np.isin(digit[first], frequent)
            rows = []
            for kind, f in ((0, first[~spread]), (2, first[spread])):
                by = digit[f] if kind == 0 else whole[f]
                rows += [(p, kind, c) for p, c in deal(part_of(by, parts), parts, digit[f], whole[f], whole2[f], doc[f], lo[f].astype(np.int32), n[f].astype(np.int32), inner[f].astype(np.uint8))]
            spans_ = _joined(doc[again], lo[again].astype(np.int32), n[again].astype(np.int32))
            rows += [(p, 1, c) for p, c in deal(spans_[0] % parts, parts, *spans_)]
            yield cells(rows)

    return run


def _second_pass(held: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
    """Runs of a part: repeats of a whole run are marked, runs left beside others of their digit stay in play."""
    yield _span_batch(*gather(held.get(1, []), _SPAN))
    for kind in (0, 2):
        digit, whole, whole2, doc, lo, n, inner = gather(held.get(kind, []), _RUN)
        perm, head = first_of((digit, whole, whole2), (doc, lo))
        again = _again(perm, head, doc, lo)
        yield _span_batch(*_joined(doc[again], lo[again], n[again]))
        left = perm[head]
        if kind == 2:  # other runs of a frequent digit are elsewhere
            yield _span_batch(doc[left], lo[left], n[left], digit[left], np.ones(len(left), np.int32))
            continue
        d = digit[left]
        begin = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]])) if len(d) else np.zeros(0, np.int64)
        size = np.diff(np.append(begin, len(d)))
        size = np.repeat(size, size)
        stay = (size > 1) | (inner[left] > 0)
        left, size = left[stay], size[stay]
        yield _span_batch(doc[left], lo[left], n[left], digit[left], (size > HOT).astype(np.int32))


def _third_pass(parts: int):
    """Windows still in play, with their bytes: dealt by first digit, or by window where that digit is hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, texts, plays = np.asarray(b.column(0)), string_array(b.column(1)), b.column(b.num_columns - 1)
            data, offsets = byte_view(texts)
            of_text = np.append(np.frombuffer(plays.buffers()[1], np.int32)[plays.offset : plays.offset + len(plays) + 1], 0)[:-1].astype(np.int64)
            flat = plays.values
            lo, n = np.asarray(flat.field("lo")), np.asarray(flat.field("n"))
            digit, hot = np.asarray(flat.field("digit")).view(np.uint64), np.asarray(flat.field("hot"))
            for i, j in spans(offsets):
                pick = slice(of_text[i], of_text[j])
                owner = np.repeat(np.arange(i, j), np.diff(of_text[i : j + 1]))
                rows = []
                piece, base = data[offsets[i] : offsets[j]], offsets[i]
                h = hot[pick] > 0
                # Cold digits: the runs' bytes.
                o, a, m, g = owner[~h], lo[pick][~h], n[pick][~h], digit[pick][~h]
                part = part_of(g, parts)
                order = np.argsort(part, kind="stable")
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(part[order])) + 1, [len(order)]]) if len(order) else []
                for x, y in zip(cuts[:-1], cuts[1:]):
                    k = order[x:y]
                    from_ = offsets[o[k]] + a[k] - base
                    size = m[k].astype(np.int64) + DEPTH - 1
                    before = np.cumsum(size) - size
                    raw = piece[np.repeat(from_ - before, size) + np.arange(int(size.sum()))].tobytes()
                    head = pack(g[k], keys[o[k]], a[k].astype(np.int32), m[k].astype(np.int32))
                    rows.append((int(part[k[0]]), 2, len(head).to_bytes(8, "little") + head + raw))
                # Hot digits: windows, the first of equal ones in this chunk.
                o, a, m, g = owner[h], lo[pick][h], n[pick][h].astype(np.int64), digit[pick][h]
                if len(o):
                    w_lo = np.repeat(a - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
                    w_own, w_digit = np.repeat(o, m), np.repeat(g, m)
                    last, last2 = window_digits(piece, offsets[w_own] + w_lo - base)
                    doc = keys[w_own]
                    perm, head_ = first_of((w_digit, last, last2), (doc, w_lo))
                    f, r = perm[head_], _again(perm, head_, doc, w_lo)
                    rows += [(p, 0, c) for p, c in deal(part_of(last[f], parts), parts, w_digit[f], last[f], last2[f], doc[f], w_lo[f].astype(np.int32))]
                    s = _joined(doc[r], w_lo[r].astype(np.int32), np.ones(len(r), np.int32))
                    rows += [(p, 1, c) for p, c in deal(s[0] % parts, parts, *s)]
                if rows:
                    yield cells(rows)

    return run


def _last_pass(held: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
    """Groups that agree through the whole depth: all but the first are marked."""
    yield _span_batch(*gather(held.get(1, []), _SPAN))
    digit, last, last2, doc, lo = gather(held.get(0, []), _WINDOW)
    perm, head = first_of((digit, last, last2), (doc, lo))
    r = _again(perm, head, doc, lo)
    yield _span_batch(*_joined(doc[r], lo[r], np.ones(len(r), np.int32)))
    got, raws, begun = [], [], 0
    for cell in held.get(2, []):
        size = int.from_bytes(cell[:8], "little")
        (g, d, a, m) = gather([cell[8 : 8 + size]], [np.uint64, np.int64, np.int32, np.int32])
        raws.append(np.frombuffer(cell, np.uint8, offset=8 + size))
        length = m.astype(np.int64) + DEPTH - 1
        at, m = np.cumsum(length) - length, m.astype(np.int64)
        step = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
        got.append((np.repeat(g, m), np.repeat(d, m), (np.repeat(a, m) + step).astype(np.int32), begun + np.repeat(at, m) + step))
        begun += len(raws[-1])
    if got:
        digit, doc, lo, start = map(np.concatenate, zip(*got))
        tied, group = radix_groups(np.concatenate(raws), start, digit)
        doc, lo = doc[tied], lo[tied]
        perm, head = first_of((group,), (doc, lo))
        r = _again(perm, head, doc, lo)
        yield _span_batch(*_joined(doc[r], lo[r], np.ones(len(r), np.int32)))


def _keyed(docs: DataFrame, id_col: str, text_col: str, key: str) -> DataFrame:
    """Add a bigint that orders documents: the id itself, or a rank where ids repeat or are null."""
    ids = docs.select(F.col(id_col).cast("long").alias("i"))
    if ids.groupBy("i").count().where("i is null or count > 1").isEmpty():
        return docs.withColumn(key, F.col(id_col).cast("long"))
    spark = docs.sparkSession
    distinct = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(text_col, F.lit("")).alias("t")).distinct().orderBy(F.col("i").asc_nulls_last(), "t")
    ranked = distinct.select("i", F.sha2("t", 256).alias("s")).rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], x[1]))
    r_id, r_text, digest = (fresh(x, docs.columns) for x in ("ranked_id", "ranked_text", "text_digest"))
    rank = spark.createDataFrame(ranked, T.StructType([T.StructField(r_id, T.LongType()), T.StructField(r_text, T.StringType()), T.StructField(key, T.LongType())]))
    out = docs.withColumn(digest, F.sha2(F.coalesce(text_col, F.lit("")), 256)).join(rank, F.col(id_col).cast("long").eqNullSafe(F.col(r_id)) & (F.col(digest) == F.col(r_text)))
    return out.drop(r_id, r_text, digest)


def repeated_spans(docs: DataFrame, key: str, text: str, carry: list[str]) -> tuple[DataFrame, DataFrame]:
    """(key, spans of marked windows) for texts that have any, and the table of texts.

    ``carry`` columns travel with the texts, which cross the network once: both
    joins on the key read the same exchange.
    """
    base = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]).where("key is not null")
    frequent, size = _sampled(base.select("key", "text"))
    parts = parts_of(docs, size)
    second = by_part(map_arrow(base.select("key", "text"), _first_pass(parts, frequent), CELL_SCHEMA), parts, _second_pass, _SPAN_SCHEMA)
    play = second.where("digit is not null").groupBy("key").agg(F.collect_list(F.struct("lo", "n", "digit", "hot")).alias("play"))
    third = map_arrow(base.join(play.withColumnRenamed("key", "p_key"), F.col("key") == F.col("p_key")).drop("p_key"), _third_pass(parts), CELL_SCHEMA)
    last = by_part(third, parts, _last_pass, _SPAN_SCHEMA)
    marked = second.where("digit is null").select("key", "lo", "n").unionAll(last.select("key", "lo", "n"))
    return marked.groupBy(F.col("key").alias("m_key")).agg(F.collect_list(F.struct("lo", "n")).alias("marks")), base


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, texts: bool = False) -> DataFrame:
    """n_bytes, n_removed, n_spans and kept_sha256 of each text, after the columns ``carry`` (by default the id).

    With ``texts`` also the kept text itself, without bytes of characters that a removed span cuts.
    """
    carry = [id_col] if carry is None else carry
    key = fresh("doc_key", docs.columns)
    marks, base = repeated_spans(_keyed(docs, id_col, text_col, key), key, text_col, carry)
    rows = base.join(marks, F.col("key") == F.col("m_key"), "left").drop("m_key", "key")
    inner = [f"c{i}" for i in range(len(carry))]
    fields = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept string" * texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, m in zip(b.column(0), b.column(b.num_columns - 1)):
                raw = (t.as_py() or "").encode()
                if not m.is_valid:
                    out.append((len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), raw.decode()))
                    continue
                flat = m.values
                lo, n = np.asarray(flat.field("lo")), np.asarray(flat.field("n"))
                depth = np.zeros(len(raw) + 1, np.int32)
                np.add.at(depth, lo, 1)
                np.add.at(depth, lo + n + DEPTH - 1, -1)
                gone = np.cumsum(depth)[:-1] > 0
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((len(raw), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
            cols = list(zip(*out)) if out else [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()][: 4 + texts]
            yield pa.RecordBatch.from_arrays([b.column(1 + k) for k in range(len(inner))] + [pa.array(c, k) for c, k in zip(cols, kinds)], names=inner + [f.split()[0] for f in fields.split(", ")])

    schema = ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in inner), fields])
    out = map_arrow(rows, run, schema)
    return out.select(*[F.col(c).alias(k) for c, k in zip(inner, carry)], *[f.split()[0] for f in fields.split(", ")])
