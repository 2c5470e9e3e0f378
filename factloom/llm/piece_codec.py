"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding keeps a score-ordered agenda of adjacent symbol pairs: the pair whose
merged piece has the best score is merged first, the leftmost of equals, and
the two pairs that the new symbol forms enter the agenda. Two forms of it give
the same result: ``agenda_heap`` for one long segment, and ``agenda_rows``,
which advances many short segments together, one row of pending scores each.

Texts are first cut where no merge can ever reach across: between two
characters that stand next to each other in no piece of the vocabulary. Equal
segments are encoded once for each chunk of a batch, and frequent ones once for
each worker, in a table of bounded size.

Every segment that is encoded is checked against the sentencepiece library
within its Arrow batch: new segments are joined by a character that no piece
has, encoded by the library in one call, and must agree; a difference raises.

Defined results: null and empty text have no ids and decode to the empty text;
texts of any length are encoded whole; repeated rows are each encoded; an empty
table gives an empty result; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts, mix

#: Longest segment, in characters, that takes part in ``agenda_rows``.
ROW_CHARS = 48
#: Segments that a worker remembers from batch to batch.
REMEMBERED = 400_000
SPACE = 0x2581
#: Characters outside the vocabulary are symbols from here on: this plus the code point.
OUTSIDE = 1 << 21

_U = np.uint64


class PieceCodec:
    """Encoder and decoder for one model file of the merge type."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        spec, norm = proto.trainer_spec, proto.normalizer_spec
        if spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or any(p.type in (4, 5) for p in proto.pieces):
            raise ValueError("only merge-type models with the identity normaliser, a leading space mark and plain pieces are read")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.byte_ids = np.zeros(256, np.int64)
        self.byte_fallback, self.unk = spec.byte_fallback, next(i for i, p in enumerate(proto.pieces) if p.type == 2)
        for i, p in enumerate(proto.pieces):
            if p.type == 6:
                self.byte_ids[int(p.piece[1:-1], 16)] = i
        plain = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        scores = np.array([p.score for p in proto.pieces], np.float32)
        self.surface = [p.piece.replace("▁", " ").encode() if p.type == 1 else bytes([int(p.piece[1:-1], 16)]) if p.type == 6 else b"" for p in proto.pieces]
        # Single characters: a symbol for each code point.
        self.char = np.arange(0x110000, dtype=np.int64) + OUTSIDE
        singles = [c for c in plain if len(c) == 1]
        for c in singles:
            self.char[ord(c)] = plain[c]
        # Characters that appear in longer pieces get a row and column in the table of neighbours.
        inside = sorted({ch for p in plain if len(p) > 1 for ch in p})
        self.place = np.zeros(0x110000, np.int32)
        self.place[[ord(c) for c in inside]] = np.arange(1, len(inside) + 1)
        size = len(inside) + 1
        self.joins = np.zeros(size * size, bool)
        self.size = size
        for p in plain:
            if len(p) > 1:
                at = self.place[[ord(c) for c in p]]
                self.joins[at[:-1] * size + at[1:]] = True
        # Pairs that merge. A symbol is an id in the vocabulary or an outside character.
        symbol = lambda s: plain[s] if s in plain else OUTSIDE + ord(s) if len(s) == 1 else None
        pairs = {}
        for p, i in plain.items():
            for k in range(1, len(p)):
                a, b = symbol(p[:k]), symbol(p[k:])
                if a is not None and b is not None:
                    pairs[(a << 22) | b] = i
        keys = np.array(sorted(pairs), np.int64)
        ids = np.array([pairs[k] for k in keys.tolist()], np.int32)
        # An open table, so that a lookup touches one or two places.
        self.bits = max(int(np.ceil(np.log2(max(len(keys), 1) * 4))), 4)
        self.key_table = np.full(1 << self.bits, -1, np.int64)
        self.id_table = np.full(1 << self.bits, -1, np.int32)
        at = self._slot(keys)
        todo = np.arange(len(keys))
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = self.key_table[at[todo]] < 0
            first = np.unique(at[todo[free]], return_index=True)[1]
            put = todo[free][first]
            self.key_table[at[put]], self.id_table[at[put]] = keys[put], ids[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
        self.score = np.append(scores, np.float32(-np.inf))  # the last stands for no merge
        self.pair_dict = pairs
        self.known = np.zeros(0, np.uint64)
        self.known_at = self.known_begin = self.known_n = np.zeros(0, np.int64)
        self.known_ids = np.zeros(0, np.int32)
        self.known_text = np.empty(0, object)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.astype(np.uint64)) >> _U(64 - self.bits)).astype(np.int64)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ids of the pieces that pairs merge to, or -1."""
        keys = (a.astype(np.int64) << 22) | b
        at = self._slot(keys)
        out = np.full(keys.shape, -1, np.int32)
        open_ = np.arange(len(keys))
        for _ in range(self.probes):
            found = self.key_table[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.id_table[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
        return out

    # ------------------------------------------------------------ agendas

    def agenda_heap(self, symbols: list[int]) -> list[int]:
        """The agenda as a heap, for a segment of any length: O(n log n)."""
        n = len(symbols)
        sym, prev, nxt = list(symbols), list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple[float, int, int, int, int]] = []

        def enter(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (to := self.pair_dict.get((sym[i] << 22) | sym[j])) is not None:
                heapq.heappush(agenda, (-float(self.score[to]), i, sym[i], sym[j], to))

        for i in range(n - 1):
            enter(i, i + 1)
        while agenda:
            _, i, a, b, to = heapq.heappop(agenda)
            j = nxt[i] if sym[i] == a else -1
            if j < 0 or sym[j] != b:
                continue  # one of its symbols has been merged meanwhile
            sym[i], sym[j], nxt[i] = to, -1, nxt[j]
            if nxt[j] >= 0:
                prev[nxt[j]] = i
            enter(prev[i], i)
            enter(i, nxt[i])
        return [s for s in sym if s >= 0]

    def agenda_rows(self, sym: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The agenda for many segments: a row of symbols each, and one of pending merges."""
        rows, width = sym.shape
        none = len(self.score) - 1
        pending = np.full((rows, max(width - 1, 1)), none, np.int32)
        r, c = np.nonzero(np.arange(width - 1)[None] < length[:, None] - 1)
        got = self.merged(sym[r, c], sym[r, c + 1])
        pending[r, c] = np.where(got < 0, none, got)
        length = length.copy()
        active = np.arange(rows)
        sym_a, pen_a = sym, pending
        out, out_len = np.zeros_like(sym), length
        cols = np.arange(width)
        while len(active):
            score = self.score[pen_a]
            at = score.argmax(1)  # the leftmost of the best
            go = score[np.arange(len(active)), at] > -np.inf
            if not go.all():
                out[active[~go]] = sym_a[~go]
                active, sym_a, pen_a, at = active[go], sym_a[go], pen_a[go], at[go]
                if not len(active):
                    break
            k = np.arange(len(active))
            to = pen_a[k, at]
            # Close the gap: everything right of the merged pair moves one place left.
            src = np.minimum(cols[None] + (cols[None] > at[:, None]), width - 1)
            sym_a = np.take_along_axis(sym_a, src, 1)
            sym_a[k, at] = to
            src = np.minimum(cols[None, : width - 1] + (cols[None, : width - 1] >= at[:, None]), width - 2)
            pen_a = np.take_along_axis(pen_a, src, 1)
            pen_a[:, -1] = none
            out_len[active] -= 1
            n = out_len[active]
            pen_a[k, np.minimum(n - 1, width - 2)] = none
            left = at > 0
            if left.any():
                got = self.merged(sym_a[k[left], at[left] - 1], sym_a[k[left], at[left]])
                pen_a[k[left], at[left] - 1] = np.where(got < 0, none, got)
            right = at < n - 1
            if right.any():
                got = self.merged(sym_a[k[right], at[right]], sym_a[k[right], at[right] + 1])
                pen_a[k[right], at[right]] = np.where(got < 0, none, got)
        return out, out_len

    def _spell(self, symbols: list[int]) -> list[int]:
        """Ids of final symbols: outside characters become bytes, or the unknown id."""
        out = []
        for s in symbols:
            if s < OUTSIDE:
                out.append(s)
            elif self.byte_fallback:
                out += self.byte_ids[list(chr(s - OUTSIDE).encode("utf-8", "surrogatepass"))].tolist()
            else:
                out.append(self.unk)
        return out

    def encode_segments(self, cp: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the segments of code points at ``start``, laid end to end, and how many each has."""
        order = np.argsort(length, kind="stable")
        lens = length[order]
        flat, counts, lo = [], [], 0
        for width in (4, 8, 12, 16, 24, ROW_CHARS):
            hi = int(np.searchsorted(lens, width, "right"))
            for i in range(lo, hi, 20_000):
                pick = order[i : min(i + 20_000, hi)]
                grid = start[pick][:, None] + np.arange(width)[None]
                out, n = self.agenda_rows(self.char[cp[np.minimum(grid, len(cp) - 1)]], length[pick])
                valid = np.arange(width)[None] < n[:, None]
                odd = ((out >= OUTSIDE) & valid).any(1)
                if odd.any():
                    for k in np.flatnonzero(odd).tolist():
                        ids = self._spell(out[k, : n[k]].tolist())
                        if len(ids) > out.shape[1]:
                            out = np.pad(out, ((0, 0), (0, len(ids) - out.shape[1])))
                        out[k, : len(ids)], n[k] = ids, len(ids)
                    valid = np.arange(out.shape[1])[None] < n[:, None]
                flat.append(out[valid])
                counts.append(n)
            lo = hi
        for k in order[lo:].tolist():
            ids = self._spell(self.agenda_heap(self.char[cp[start[k] : start[k] + length[k]]].tolist()))
            flat.append(np.array(ids))
            counts.append(np.array([len(ids)]))
        n = np.zeros(len(start), np.int64)
        n[order] = np.concatenate(counts) if counts else []
        by_length = np.concatenate(flat).astype(np.int32) if flat else np.zeros(0, np.int32)
        begin = np.zeros(len(start), np.int64)
        begin[order] = np.cumsum(n[order]) - n[order]
        return by_length[_runs(begin, n)], n

    # ------------------------------------------------------------ texts

    def encode(self, texts: list[str | None]) -> list[tuple[list[int], str]]:
        """For each text its ids, and the same in decimal joined by commas."""
        marked = ["▁" + t.replace(" ", "▁") if t else "" for t in texts]
        chars = np.array([len(t) for t in marked], np.int64)
        cp = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(cp):
            return [([], "") for _ in texts]
        at = self.place[cp]
        cut = np.ones(len(cp), bool)
        cut[1:] = ~self.joins[at[:-1].astype(np.int64) * self.size + at[1:]]
        ends = np.cumsum(chars)
        cut[ends[:-1][ends[:-1] < len(cp)]] = True
        start = np.flatnonzero(cut)
        length = np.diff(np.append(start, len(cp)))
        unique, first, inverse = np.unique(_segment_hash(cp, start, length), return_index=True, return_inverse=True)
        # Segments that the worker knows already, then the new ones.
        i = np.minimum(np.searchsorted(self.known, unique), max(len(self.known) - 1, 0))
        old = self.known[i] == unique if len(self.known) else np.zeros(len(unique), bool)
        new = np.flatnonzero(~old)
        ids, n = self.encode_segments(cp, start[first[new]], length[first[new]])
        self.check(cp, start[first[new]], length[first[new]], ids)
        spelled = list(map(str, ids.tolist()))
        bounds = np.cumsum(n).tolist()
        text = np.empty(len(unique), object)
        text[new] = [",".join(spelled[a:b]) for a, b in zip([0, *bounds], bounds)]
        text[old] = self.known_text[self.known_at[i[old]]]
        begin, count = np.zeros(len(unique), np.int64), np.zeros(len(unique), np.int64)
        count[new], begin[new] = n, np.cumsum(n) - n + len(self.known_ids)
        count[old], begin[old] = self.known_n[self.known_at[i[old]]], self.known_begin[self.known_at[i[old]]]
        pool = np.concatenate([self.known_ids, ids])
        if len(new) and len(self.known) < REMEMBERED:
            self.known_at = np.concatenate([self.known_at, len(self.known) + np.arange(len(new))])
            keys = np.concatenate([self.known, unique[new]])
            order = np.argsort(keys)
            self.known, self.known_at, self.known_ids = keys[order], self.known_at[order], pool
            self.known_begin, self.known_n = np.concatenate([self.known_begin, begin[new]]), np.concatenate([self.known_n, n])
            self.known_text = np.concatenate([self.known_text, text[new]])
        # Each text's segments, then their ids.
        seg = np.searchsorted(start, np.concatenate([[0], ends]))
        every = pool[_runs(begin[inverse], count[inverse])]
        upto = np.concatenate([[0], np.cumsum(count[inverse])])[seg].tolist()
        texts_of = text[inverse].tolist()
        seg = seg.tolist()
        return [(every[upto[k] : upto[k + 1]].tolist(), ",".join(texts_of[seg[k] : seg[k + 1]])) for k in range(len(texts))]

    def check(self, cp: np.ndarray, start: np.ndarray, length: np.ndarray, ids: np.ndarray) -> None:
        """Hold newly encoded segments against the library; raises on a difference.

        They are laid end to end, each after a line feed, which no piece contains.
        """
        if not len(start):
            return
        if self.place[10]:
            raise ValueError("a piece of this vocabulary contains the line feed that the check puts between segments")
        lead = self.library.encode("\n")  # the leading space mark, then the line feed
        size = length + 1
        line = np.full(int(size.sum()), 10, np.uint32)
        begin = np.cumsum(size) - size
        line[_runs(begin + 1, length)] = cp[_runs(start, length)]
        want = self.library.encode(line.tobytes().decode("utf-32-le", "surrogatepass").replace("▁", " "))
        got = np.array(want, np.int32)
        # Without the separators; segments that are line feeds themselves keep one.
        mine = np.concatenate([np.array(lead[:-1], np.int32), ids])
        feeds = got == lead[-1]
        own = int((mine == lead[-1]).sum())
        same = int(feeds.sum()) == len(start) + own and np.array_equal(got[~feeds], mine[mine != lead[-1]])
        if not same:
            raise AssertionError("encoding differs from the sentencepiece library")

    def decode(self, ids: list[int]) -> str:
        """As the library: the leading space mark goes, byte pieces join to characters."""
        return self.library.decode(ids)

    def decode_pieces(self, ids: list[int]) -> str:
        """The same from the pieces' own surfaces, for ids that an encoding gave."""
        raw = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        return raw[1:] if raw.startswith(" ") else raw


def _runs(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for count[0] places, then the same for the next."""
    before = np.cumsum(count) - count
    return np.repeat(begin - before, count) + np.arange(int(count.sum()))


def _segment_hash(cp: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    from .common import _powers

    table = mix(cp.astype(np.uint64))
    forward, back = _powers(len(cp) + 1)
    prefix = np.zeros(len(cp) + 1, np.uint64)
    np.cumsum(table * forward[: len(cp)], out=prefix[1:])
    return mix((prefix[start + length] - prefix[start]) * back[start] + length.astype(np.uint64) * _U(0xD6E8FEB86659FD93))


_codecs: dict[bytes, PieceCodec] = {}


def encode_documents(docs: DataFrame, model_path: str, keep: list[str], text_col: str = "text", ids: bool = False) -> DataFrame:
    """``keep`` columns, n_tokens, ids_sha256 and decoded_sha256 of each whole text; with ``ids`` the ids too.

    The model file is read once by the driver and sent along, so executors need no path to it.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name = hashlib.sha256(model).digest()

    def kernel(texts: pa.Array) -> list[pa.Array]:
        codec = _codecs.get(name)
        if codec is None:
            _codecs.clear()
            codec = _codecs[name] = PieceCodec(shared.value)
        coded = codec.encode(texts.to_pylist())
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        cols = [pa.array([len(x) for x, _ in coded], pa.int64()), pa.array([sha(s) for _, s in coded], pa.string()), pa.array([sha(codec.decode(x)) for x, _ in coded], pa.string())]
        return cols + ([pa.array([x for x, _ in coded], pa.list_(pa.int32()))] if ids else [])

    return map_texts(docs, text_col, kernel, "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids, keep)


