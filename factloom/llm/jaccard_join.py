"""N-gram Jaccard join by vertical partitioning.

A document's set is its distinct 5-word shingles, as 64-bit hashes; documents
with equal sets are one class. All shingles stand in one global order, rare
before frequent (a count sketch over all documents tells which), then by hash,
and that order is cut into fragments.

1. *First shingles.* Two linked classes x, y share at least ``least(min(n))``
   of their first ``n - ceil(3n/4) + least(n)`` shingles. Each fragment counts
   its part of that overlap by itself for all pairs of classes in its small
   groups (a shingle's classes, up to ``ALL_PAIRS``); the parts are summed for
   each pair. Classes of large groups are only listed.
2. A link that the sums of small groups cannot show has ``least`` first
   shingles in large groups on both sides; such classes are *dense*. In each
   group and size band the dense classes meet one *hub*, the one whose shingles
   are the most frequent, so a group of m classes gives m pairs.
3. The sets of the classes involved are written once, cut into ``FRAGMENTS``
   of the order by hash. For each pair every fragment counts its part of the
   whole overlap by itself; the parts are summed for each pair, which decides
   the links, and these are joined to components.
4. A dense class z that is not linked to a hub and not in its component is
   *open*. For any class y and any hub h,
   ``|z & y| <= |z & h| + |(z - h) & y|``, so a y that is linked to z holds
   enough of the shingles of z outside h. One hub is enough to ask for all y;
   the one that leaves the fewest shingles outside is taken, and the rarest of
   these find the pairs that are left to count. Shingles outside h that many
   hold are not expanded but granted to the bound. Where the bound then asks for nothing, z
   is asked about each of its hubs; under a hub that asks for nothing either, it
   also meets the classes of that hub whose own overlap with it is large enough.

No link between different components is missed, and no group emits all its
pairs.

Defined results: null, empty and blank texts have the empty set, link to nothing and are their own
component; 1 to 4 words form one shingle, the whole sequence; rows that repeat
a doc_id are each compared by themselves and each give a row; a null id is
skipped in the search for a component's smallest id, so it is null only where
all ids of its component are; an empty table gives an empty result; other
columns are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, SPACE, byte_view, checkpoint, join_hot, map_arrow, mix, prefix_hash, range_hash, spans, string_array, words
from .packing import CELL_SCHEMA, by_part, cells, deal, gather, pack, parts_of, unpack

#: Words of a shingle.
SHINGLE = 5
#: Similarity threshold as a fraction.
NUM, DEN = 3, 4
#: Classes that share a first shingle up to which all their pairs are counted.
ALL_PAIRS = 4
#: Fragments of the order in which whole overlaps are counted, as a power of two.
FRAGMENTS = 4
#: Dense classes that share a shingle outside a hub up to which it is expanded.
EXPANDED = 64
#: Counters of the frequency sketch, and bits of the filters that thin out later scans. Both are fixed in size;
#: they only steer the order and save work, so the result does not depend on them.
SKETCH = 1 << 20
FILTER = 1 << 23
_SLICES = 16
#: Bytes of a word and the blank behind it, about; it only tells how many parts to make.
WORD_BYTES = 7

_U = np.uint64


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, end to end, and the bounds of each text's."""
    data, offsets = byte_view(texts)
    data = LOWER[data]
    start, end, doc = words(data, offsets, ~SPACE)
    w = range_hash(prefix_hash(data), start, end)
    n = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(n) - n
    odd = [_U(2 * k * 0x51ED270B + 0x2545F4914F6CDD1D) | _U(1) for k in range(SHINGLE)]
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, (n > 0).astype(np.int64))
    out, bounds = [], np.zeros(len(texts) + 1, np.int64)
    if len(w):
        pad = np.concatenate([w, np.zeros(SHINGLE, np.uint64)])
        h = np.zeros(len(w), np.uint64)
        for k in range(SHINGLE):
            h += mix(pad[k : k + len(w)] * odd[k])
        h = mix(h)
    for i in range(len(texts)):
        a = first[i]
        if n[i] >= SHINGLE:
            s = np.unique(h[a : a + count[i]])
        elif n[i]:
            s = np.array([n[i]], np.uint64)
            for k in range(n[i]):
                s = mix(s ^ (w[a + k : a + k + 1] * odd[k]))
        else:
            s = np.zeros(0, np.uint64)
        out.append(s)
        bounds[i + 1] = bounds[i] + len(s)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), bounds


def signatures(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set, signed; equal sets have equal digests."""
    total = np.concatenate([[_U(0)], np.cumsum(mix(sets ^ _U(0xA0761D6478BD642F)))])
    return mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64)


def _each_chunk(batches: Iterator[pa.RecordBatch], column: int):
    """(batch, first row, sets, bounds, digests) of each chunk of texts."""
    for b in batches:
        texts = string_array(b.column(column))
        for i, j in spans(byte_view(texts)[1]):
            sets, bounds = shingle_sets(texts.slice(i, j - i))
            yield b, i, sets, bounds, signatures(sets, bounds)


def _once(digest: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Texts of a chunk with a set, one for each digest."""
    first = np.unique(digest, return_index=True)[1]
    return np.sort(first[np.diff(bounds)[first] > 0])


def _collect_slices(partial: DataFrame, merge: np.ufunc, dtype: type, size: int) -> np.ndarray:
    """Merge the arrays that tasks emit, by slices in parallel; ``size`` is fixed, so the driver's share is."""

    def reduce(held: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
        for k, got in held.items():
            total = unpack(got[0], [dtype])[0]
            for c in got[1:]:
                total = merge(total, unpack(c, [dtype])[0])
            yield cells([(k, k, pack(total))])

    out = np.zeros(size, dtype)
    step = size // _SLICES
    for r in by_part(partial, _SLICES, reduce, CELL_SCHEMA).toArrow().to_pylist():
        out[r["part"] * step : (r["part"] + 1) * step] = unpack(r["cell"], [dtype])[0]
    return out


def _sliced(whole: np.ndarray) -> pa.RecordBatch:
    step = len(whole) // _SLICES
    return cells([(k, k, pack(whole[k * step : (k + 1) * step])) for k in range(_SLICES)])


def frequency_sketch(texts: DataFrame) -> np.ndarray:
    """How many documents have a shingle of each hash cell, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.uint32)
        for _, _, sets, _, _ in _each_chunk(batches, 0):
            total += np.bincount((sets % _U(SKETCH)).astype(np.int64), minlength=SKETCH).astype(np.uint32)
        yield _sliced(total)

    return _collect_slices(map_arrow(texts, run, CELL_SCHEMA), np.add, np.uint32, SKETCH)


def member_filter(rows: DataFrame, columns: list[str]) -> np.ndarray:
    """A bit filter of the longs in the columns: all of them pass it, few others do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER, bool)
        for b in batches:
            for c in b.columns:
                bits[_bit(np.asarray(c).view(np.uint64))] = True
        yield _sliced(np.packbits(bits))

    return np.unpackbits(_collect_slices(map_arrow(rows.select(*columns), run, CELL_SCHEMA), np.bitwise_or, np.uint8, FILTER // 8)).astype(bool)


def _bit(x: np.ndarray) -> np.ndarray:
    return (mix(x) % _U(FILTER)).astype(np.int64)


def _ordered(sets: np.ndarray, sketch: np.ndarray, base: float) -> np.ndarray:
    """Places in the global order: frequency level above, hash below."""
    level = np.log2(np.maximum(sketch[(sets % _U(SKETCH)).astype(np.int64)] / base, 1)).astype(np.uint64)
    return (np.minimum(level, _U(31)) << _U(59)) | (sets >> _U(5))


def least_shared(n):
    """First shingles that linked classes share at least, by the smaller's size."""
    return 1 + n // 4


def prefix_length(n: int) -> int:
    return n - -(-n * NUM // DEN) + least_shared(n)


def _size_step(n: np.ndarray) -> np.ndarray:
    """Sizes in steps of four percent, in a byte; linked classes are at most ``_NEAR`` steps apart."""
    return np.minimum(np.log(n) / np.log(1.04), 255).astype(np.uint8)


_NEAR = 8


def _context(texts: DataFrame, sketch: np.ndarray):
    return texts.sparkSession.sparkContext.broadcast((sketch, 4.0 * max(float(sketch.mean()), 2.0)))


def _first_shingles(texts: DataFrame, shared, parts: int) -> DataFrame:
    """Cells of (place, class), dealt by place: each class's first shingles, once for each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, base = shared.value
        for _, _, sets, bounds, digest in _each_chunk(batches, 0):
            place = _ordered(sets, sketch, base)
            pick = _once(digest, bounds)
            got = [np.sort(place[bounds[i] : bounds[i + 1]])[: prefix_length(int(bounds[i + 1] - bounds[i]))] for i in pick]
            if got:
                # 48 bits of a place are enough to bring classes together; whole sets are compared later.
                tok = np.concatenate(got) >> _U(16)
                size = [len(g) for g in got]
                sig, step = np.repeat(digest[pick], size), np.repeat(_size_step(np.diff(bounds)[pick]), size)
                yield cells([(p, 0, c) for p, c in deal(((mix(tok) >> _U(33)) % _U(parts)).astype(np.int64), parts, tok, sig, step)])

    return map_arrow(texts, run, CELL_SCHEMA)


def _groups(tok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begin = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]])) if len(tok) else np.zeros(0, np.int64)
    return begin, np.diff(np.append(begin, len(tok)))


_PAIRS, _LARGE = [np.int64, np.int64, np.int32], [np.int64, np.uint64]


def _candidates(held: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
    """A fragment's partial counts of pairs in small groups (cells of kind 0), and the members of large ones (kind 1)."""
    tok, sig, step = gather(held[0], [np.uint64, np.int64, np.uint8])
    order = np.argsort(tok, kind="stable")
    tok, sig, step = tok[order], sig[order], step[order]
    same = np.zeros(len(tok) + 1, bool)
    same[1:-1] = tok[1:] == tok[:-1]
    keep = same[1:] | same[:-1]
    tok, sig, step = tok[keep], sig[keep], step[keep].astype(np.int64)
    order = np.lexsort((sig, tok))
    tok, sig, step = tok[order], sig[order], step[order]
    new = np.ones(len(tok), bool)
    new[1:] = (tok[1:] != tok[:-1]) | (sig[1:] != sig[:-1])
    tok, sig, step = tok[new], sig[new], step[new]
    begin, size = _groups(tok)
    small = (size > 1) & (size <= ALL_PAIRS)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(1, ALL_PAIRS):  # pairs at distance d of every small group
        at, m = begin[small & (size > d)], size[small & (size > d)] - d
        i = np.repeat(at - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
        i = i[np.abs(step[i] - step[i + d]) <= _NEAR]
        a.append(sig[i])
        b.append(sig[i + d])
    a, b = np.concatenate(a), np.concatenate(b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    head = np.ones(len(a), bool)
    head[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(head)
    big = np.repeat(size, size) > ALL_PAIRS
    yield cells([(0, 0, pack(a[at], b[at], np.diff(np.append(at, len(a))).astype(np.int32))), (0, 1, pack(sig[big], tok[big]))])


def _unpacked(found: DataFrame, kind: int, dtypes: list, schema: str) -> DataFrame:
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in b.column(0):
                cols = unpack(c.as_py(), dtypes)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64) if x.dtype == np.uint64 else x) for x in cols], names=names)

    return map_arrow(found.where(F.col("kind") == kind).select("cell"), run, schema)


def _cuts(s: np.ndarray) -> np.ndarray:
    """Where the fragments of a sorted set begin, and its end."""
    edges = np.arange(1, FRAGMENTS, dtype=np.uint64) << _U(64 - (FRAGMENTS - 1).bit_length())
    return np.concatenate([[0], np.searchsorted(s, edges), [len(s)]])


def _sets(texts: DataFrame, wanted: DataFrame, columns: list[str]) -> DataFrame:
    """(sig, part, set): the sets of the wanted classes, a row for each fragment that holds any of it."""
    shared = texts.sparkSession.sparkContext.broadcast(np.packbits(member_filter(wanted, columns)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = np.unpackbits(shared.value).astype(bool)
        for _, _, sets, bounds, digest in _each_chunk(batches, 0):
            pick = _once(digest, bounds)
            rows = []
            for i in pick[passes[_bit(digest[pick].view(np.uint64))]].tolist():
                s = sets[bounds[i] : bounds[i + 1]]
                at = _cuts(s)
                rows += [(digest[i], k, s[x:y].tobytes()) for k, (x, y) in enumerate(zip(at[:-1], at[1:])) if y > x]
            sig, part, cell = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(sig, pa.int64()), pa.array(part, pa.int32()), pa.array(cell, pa.binary())], names=["sig", "part", "set"])

    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # All parts of a set in one partition: neither join below has to move the sets.
    return map_arrow(texts, run, "sig bigint, part int, set binary").repartition(n, "sig").dropDuplicates(["sig", "part"])


def _needed(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of ``sets`` whose class stands in pairs(a, b), and few others: only these are worth moving to a join of few pairs."""
    shared = sets.sparkSession.sparkContext.broadcast(np.packbits(member_filter(pairs, ["a", "b"])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = np.unpackbits(shared.value).astype(bool)
        for b in batches:
            yield b.filter(pa.array(passes[_bit(np.asarray(b.column(0)).view(np.uint64))]))

    return map_arrow(sets, run, "sig bigint, part int, set binary")


def _side_by_side(sets: DataFrame, pairs: DataFrame, how: str = "inner") -> DataFrame:
    """The columns of pairs(a, b, ...) with sa and sb, their sets' parts in one fragment, a row for each of a's fragments."""
    left = sets.select(F.col("sig").alias("ka"), F.col("part").alias("pa"), F.col("set").alias("sa"))
    right = sets.select(F.col("sig").alias("kb"), F.col("part").alias("pb"), F.col("set").alias("sb"))
    # Joined by class alone, as the sets lie; the difference keeps equal parts without being a key.
    on = (F.col("b") == F.col("kb")) & (F.col("pa") - F.col("pb") == 0)
    return pairs.join(left, F.col("a") == F.col("ka")).join(right, on, how).select(*pairs.columns, "sa", "sb")


def count_overlaps(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Add inter and link to the distinct pairs(a, b, na, nb, ...) that share a fragment; other pairs go, they share nothing."""
    cols = pairs.columns

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros(b.num_rows, np.int64)
            for k, (x, y) in enumerate(zip(b.column(len(cols)), b.column(len(cols) + 1))):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                out[k] = np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(cols))), pa.array(out)], names=[*cols, "part_inter"])

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema] + ["part_inter bigint"])
    parts = map_arrow(_side_by_side(sets, pairs), overlap, schema)
    counted = parts.groupBy("a", "b").agg(*[F.max(c).alias(c) for c in cols if c not in ("a", "b")], F.sum("part_inter").alias("inter"))
    return counted.withColumn("link", F.col("inter") * DEN >= (F.col("na") + F.col("nb") - F.col("inter")) * NUM)


def _outside(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, tok) for the shingles of a outside b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [np.setdiff1d(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer() if y.is_valid else b"", np.uint64), assume_unique=True) for x, y in zip(b.column(2), b.column(3))]
            n = [len(g) for g in got]
            ids = [pa.array(np.repeat(np.asarray(b.column(c)), n)) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(np.concatenate([np.zeros(0, np.uint64), *got]).view(np.int64))], names=["a", "b", "tok"])

    return map_arrow(_side_by_side(sets, pairs.select("a", "b"), "left"), run, "a bigint, b bigint, tok bigint")


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes in links(a, b), by large-star and small-star steps; root is the least node."""
    edges = checkpoint(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    ends = lambda df, *pairs: df.select(F.explode(F.array(*[F.struct(F.col(x).alias("u"), F.col(y).alias("v")) for x, y in pairs])).alias("e")).select("e.u", "e.v")
    while True:
        # Large star: a node's larger neighbours join its least; u is the larger end of every edge.
        least = ends(edges, ("u", "v"), ("v", "u")).groupBy(F.col("u").alias("mu")).agg(F.least(F.min("v"), F.col("mu")).alias("m"))
        large = checkpoint(edges.join(least, F.col("v") == F.col("mu")).select("u", F.col("m").alias("v")).where("u != v").distinct())
        # Small star: a node and its smaller neighbours join the least of them.
        low = large.groupBy(F.col("u").alias("mu")).agg(F.min("v").alias("m"))
        edges = checkpoint(ends(large.join(low, F.col("u") == F.col("mu")), ("v", "m"), ("u", "m")).where("u != v").distinct())
        # Done when no root has a root of its own and no node has two.
        node = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up")))).alias("e"))
        if node.groupBy("e.x").agg(F.sum("e.up").alias("ups"), F.min("e.up").alias("lowest")).where("ups > 1 or ups = 1 and lowest = 0").isEmpty():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``."""
    texts = docs.select(F.col(text_col).alias("t"))
    sketch = frequency_sketch(texts)
    shared = _context(texts, sketch)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, _ = shared.value
        for b, i, sets, bounds, digest in _each_chunk(batches, 1):
            n = np.diff(bounds)
            total = np.concatenate([[0.0], np.cumsum(np.log2(sketch[(sets % _U(SKETCH)).astype(np.int64)]))])
            mean = (total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(n)), pa.array(n), pa.array(digest, mask=n == 0), pa.array((mean * 1000).astype(np.int32))], names=["id", "n", "sig", "usual"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = checkpoint(map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), digests, f"id {kind}, n bigint, sig bigint, usual int"))
    classes = checkpoint(rows.where("sig is not null").groupBy("sig").agg(F.min("n").alias("n"), F.min("usual").alias("usual"), F.min("id").alias("least"), F.count("*").alias("rows")))
    least = lambda n: 1 + F.floor(n / 4)
    fit = "na * 4 >= nb * 3 and nb * 4 >= na * 3"

    parts = parts_of(docs, WORD_BYTES * (rows.agg(F.sum("n")).first()[0] or 0))
    found = checkpoint(by_part(_first_shingles(texts, shared, parts), parts, _candidates, CELL_SCHEMA))
    large = _unpacked(found, 1, _LARGE, "sig bigint, tok bigint")
    in_large = large.groupBy(F.col("sig").alias("l_sig")).agg(F.count("*").alias("large"))
    info = checkpoint(classes.join(in_large, F.col("sig") == F.col("l_sig"), "left").select("sig", "n", "usual", F.coalesce("large", F.lit(0)).alias("large")))
    of = lambda c: (info.select(F.col("sig").alias(f"s_{c}"), F.col("n").alias(f"n{c}"), F.col("large").alias(f"l{c}")), F.col(c) == F.col(f"s_{c}"))
    # Pairs of small groups whose partial counts can still reach the least; most cannot, which one side's numbers show.
    small = _unpacked(found, 0, _PAIRS, "a bigint, b bigint, n int").groupBy("a", "b").agg(F.sum("n").alias("shared"))
    small = small.join(*of("a")).where(F.col("shared") + F.col("la") >= least(F.ceil(F.col("na") * NUM / DEN))).drop("s_a")
    small = small.join(*of("b")).where(fit).where(F.col("shared") + F.least("la", "lb") >= least(F.least("na", "nb")))
    # Written by themselves, as other steps below: a plan runs all stages that wait for nothing at once, and the driver holds them all.
    small = checkpoint(small.select("a", "b", "na", "nb", F.lit(False).alias("star"), F.lit(None).cast("bigint").alias("low")))

    dense = checkpoint(info.where((F.col("large") > 0) & (F.col("large") >= least(F.ceil(F.col("n") * NUM / DEN)))).select("sig", "n", "usual"))
    members = checkpoint(large.join(dense.withColumnRenamed("sig", "d"), F.col("sig") == F.col("d")).select("tok", "sig", "n", "usual", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(4 / 3 + 1e-9))).cast("int").alias("band")))
    hubs = members.groupBy("tok", "band").agg(F.max(F.struct("usual", F.xxhash64("sig"), F.struct("sig", "n").alias("hub"))).alias("x")).select(F.col("tok").alias("h_tok"), F.col("band").alias("h_band"), F.col("x.hub.sig").alias("hub"), F.col("x.hub.n").alias("nh"))
    lows = members.groupBy(F.col("tok").alias("w_tok")).agg(F.min("n").alias("low"))
    # Linked classes lie in one band or in neighbouring ones, so both meet the hub of either's band.
    near = hubs.join(lows, F.col("h_tok") == F.col("w_tok")).select("h_tok", "hub", "nh", "low", F.explode(F.array(*[F.col("h_band") + d for d in (-1, 0, 1)])).alias("for_band"))
    stars = members.join(near, (F.col("tok") == F.col("h_tok")) & (F.col("band") == F.col("for_band"))).where("sig != hub").groupBy(F.col("sig").alias("a"), F.col("hub").alias("b")).agg(F.max("n").alias("na"), F.max("nh").alias("nb"), F.min("low").alias("low"))
    stars = checkpoint(stars.select("a", "b", "na", "nb", F.lit(True).alias("star"), "low"))
    pairs = small.unionByName(stars)
    pairs = checkpoint(pairs.groupBy("a", "b").agg(F.max("na").alias("na"), F.max("nb").alias("nb"), F.max("star").alias("star"), F.min("low").alias("low")))
    del small, stars  # their files go
    sets = checkpoint(_sets(texts, pairs, ["a", "b"]))
    judged = checkpoint(count_overlaps(sets, pairs))
    links = judged.where("link").select("a", "b")
    roots = checkpoint(connected_components(links))

    # Dense classes that are neither linked to a hub nor in its component are open.
    root = lambda c, out: (roots.select(F.col("node").alias(f"n_{c}"), F.col("root").alias(out)), F.col(c) == F.col(f"n_{c}"), "left")
    apart = lambda df, x, y: df.join(*root(x, "rx")).join(*root(y, "ry")).where(f"coalesce(rx, {x}) != coalesce(ry, {y})").drop("rx", "ry", f"n_{x}", f"n_{y}")
    open_ = checkpoint(apart(judged.where("star and not link"), "a", "b"))
    if not open_.isEmpty():
        more = checkpoint(_left_over(sets, open_, dense, judged))
        more = checkpoint(apart(more, "a", "b").join(judged.select(F.col("a").alias("ja"), F.col("b").alias("jb")), (F.col("a") == F.col("ja")) & (F.col("b") == F.col("jb")), "left_anti"))
        again = checkpoint(count_overlaps(_needed(sets, more), more).where("link").select("a", "b"))
        if not again.isEmpty():
            # The new links join components, few of many: their roots alone are searched once more.
            ends = again.join(*root("a", "ra")).join(*root("b", "rb")).select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
            higher = checkpoint(connected_components(ends).select(F.col("node").alias("h_node"), F.col("root").alias("h_root")))
            known = roots.unionAll(ends.select("a", "a")).unionAll(ends.select("b", "b")).distinct()
            roots = checkpoint(known.join(higher, F.col("root") == F.col("h_node"), "left").select("node", F.coalesce("h_root", "root").alias("root")).distinct())
    # Classes to components, then rows to classes: a class of copies or a component may hold a third of all rows.
    rooted = checkpoint(classes.join(roots, F.col("sig") == F.col("node"), "left").select("sig", F.coalesce("root", "sig").alias("root"), "least", "rows"))
    whole = rooted.groupBy(F.col("root").alias("g")).agg(F.min("least").alias("component"), F.count("*").alias("classes"))
    named = join_hot(rooted, whole, "root", "g", "classes", rooted.count()).select(F.col("sig").alias("of_sig"), "component", "rows")
    out = join_hot(rows, named, "sig", "of_sig", "rows", rows.count())
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def _left_over(sets: DataFrame, open_: DataFrame, dense: DataFrame, judged: DataFrame) -> DataFrame:
    """Pairs (a, b, na, nb) that open classes can still link: see step 4 of the module."""
    # A linked class has three quarters of the size at least, and the least size of the class's groups.
    least = open_.groupBy(F.col("a").alias("w_a")).agg(F.greatest(F.min("low"), F.min(F.ceil(F.col("na") * NUM / DEN))).alias("least"))
    asks = F.ceil((F.col("na") + F.col("least")) * NUM / (NUM + DEN)) - F.col("inter") >= 1
    of_class = Window.partitionBy("a")
    # The best hub leaves something to ask for and little outside; where none asks for anything, each hub is needed.
    rows = open_.drop("low").join(least, F.col("a") == F.col("w_a")).select("a", "b", "na", "inter", F.col("least").alias("low"), asks.alias("asks"))
    rows = rows.withColumn("place", F.row_number().over(of_class.orderBy(F.desc("asks"), F.desc("inter"), "b"))).withColumn("any", F.max("asks").over(of_class))
    rows = checkpoint(rows.where("place = 1 or not any").select("a", "b", "na", "inter", "low"))
    z, found = _asked(sets, rows, dense)
    # Shingles that were granted may have left nothing to ask for after all.
    again = z.groupBy(F.col("a").alias("g_a")).agg(F.max("least_need").alias("most")).where("most < 1")
    rest = open_.join(again, F.col("a") == F.col("g_a"), "left_semi").join(z.select(F.col("a").alias("z_a"), F.col("hub").alias("z_hub")), (F.col("a") == F.col("z_a")) & (F.col("b") == F.col("z_hub")), "left_anti")
    rest = checkpoint(rest.drop("low").join(least, F.col("a") == F.col("w_a")).select("a", "b", "na", "inter", F.col("least").alias("low")))
    if not rest.isEmpty():
        more, extra = _asked(sets, rest, dense)
        z, found = z.unionAll(more), found.unionAll(extra)
    done = z.where("least_need >= 1").select(F.col("a").alias("da")).distinct()
    wide = z.join(done, F.col("a") == F.col("da"), "left_anti").select("a", F.col("hub").alias("wh"), "na", F.col("inter").alias("own"), "granted")
    others = judged.where("star").select(F.col("a").alias("y"), F.col("b").alias("yh"), F.col("na").alias("ny"), F.col("inter").alias("theirs"))
    enough = (F.least("own", "theirs") + F.col("granted")) * (NUM + DEN) >= (F.col("na") + F.col("ny")) * NUM
    met = wide.join(others, (F.col("wh") == F.col("yh")) & (F.col("a") != F.col("y")) & enough).select("a", F.col("y").alias("b"), "na", F.col("ny").alias("nb"))
    return found.unionAll(met).where("na * 4 >= nb * 3 and nb * 4 >= na * 3").distinct()


def _asked(sets: DataFrame, open_: DataFrame, dense: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Open classes and a hub each, with the shingles granted and the least that any y must share outside the hub; and the pairs that these find."""
    outside = checkpoint(_outside(_needed(sets, open_), open_).withColumnRenamed("b", "hub"))
    # The shingles of dense classes that some open class has outside its hub; every dense class with a star has its set.
    passes = sets.sparkSession.sparkContext.broadcast(np.packbits(member_filter(outside, ["tok"])))

    def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_tok = np.unpackbits(passes.value).astype(bool)
        for b in batches:
            got = [(s := np.frombuffer(v.as_buffer(), np.uint64))[of_tok[_bit(s)]] for v in b.column(2)]
            n = [len(g) for g in got]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(b.column(0)), n)), pa.array(np.concatenate([np.zeros(0, np.uint64), *got]).view(np.int64)), pa.array(np.repeat(np.asarray(b.column(1)), n))], names=["y", "y_tok", "ny"])

    of_dense = sets.join(dense.select(F.col("sig").alias("d"), F.col("n").alias("ny")), F.col("sig") == F.col("d")).select("sig", "ny", "set")
    held = checkpoint(map_arrow(of_dense, holders, "y bigint, y_tok bigint, ny bigint"))
    common = held.groupBy(F.col("y_tok").alias("g_tok")).agg(F.count("*").alias("holders"))
    known = checkpoint(outside.join(common, F.col("tok") == F.col("g_tok"), "left").select("a", "hub", "tok", F.coalesce("holders", F.lit(0)).alias("holders")))
    granted = known.groupBy(F.col("a").alias("ga"), F.col("hub").alias("gh")).agg(F.count_if(F.col("holders") > EXPANDED).alias("granted"))
    z = open_.join(granted, (F.col("a") == F.col("ga")) & (F.col("b") == F.col("gh")), "left").select("a", F.col("b").alias("hub"), "na", "low", "inter", F.coalesce("granted", F.lit(0)).alias("granted"))
    need = lambda n: F.ceil((F.col("na") + n) * NUM / (NUM + DEN)) - F.col("inter") - F.col("granted")
    z = checkpoint(z.withColumn("least_need", need(F.col("low"))))
    # Of the m shingles that others hold, a linked class holds least_need at least, so one of any m - least_need + 1:
    # the rarest find it. Where it need hold none, all m find those that do.
    cold = known.where((F.col("holders") > 1) & (F.col("holders") <= EXPANDED)).select(F.col("a").alias("ka"), F.col("hub").alias("kh"), "tok", "holders")
    of_class = Window.partitionBy("ka", "kh")
    ranked = cold.join(z, (F.col("ka") == F.col("a")) & (F.col("kh") == F.col("hub"))).withColumn("at", F.row_number().over(of_class.orderBy("holders", "tok"))).withColumn("m", F.count("*").over(of_class))
    rare = ranked.where(F.col("at") <= F.col("m") - F.greatest("least_need", F.lit(1)) + 1).select("a", "na", "inter", "granted", "tok", (F.col("m") - F.col("at") + 1).alias("behind"))
    # A larger partner must hold more of them, so it shows itself among still rarer ones.
    fits = (F.col("a") != F.col("y")) & (F.col("na") * 4 >= F.col("ny") * 3) & (F.col("ny") * 4 >= F.col("na") * 3) & (F.col("behind") >= need(F.col("ny")))
    found = rare.join(held, (F.col("tok") == F.col("y_tok")) & fits).select("a", F.col("y").alias("b"), "na", F.col("ny").alias("nb")).distinct()
    return z, checkpoint(found)


__all__ = ["connected_components", "count_overlaps", "jaccard_components", "shingle_sets"]
