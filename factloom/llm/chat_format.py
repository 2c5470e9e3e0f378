"""Chat formatting: roles of transcript lines by a hidden Markov model, then canonical turns.

Hidden states are the roles. A row of a transcript is a text of one or more
lines. A line may show a speaker marker at its head (``User:``,
``<|assistant|>``, ``### Human``); the row may have a label, which is a weaker
sign: both may be wrong, and the model weighs them against the features of the
row's lines (length class, whether it asks) and the steps between roles. The
role changes freely from row to row, as counted, and inside a row rarely but
at a marker.
Features and steps are counted over all rows whose label, or first line, names
a role, with additive smoothing; Viterbi then finds the best roles of each
transcript's lines.

A transcript may be of any length. Each row's lines are first reduced to a
max-plus matrix (best score from each entry role to each exit role), the rows of
a block of turn numbers to one matrix, and the few matrices of a transcript are
chained, which fixes the roles at every block's ends. Each block, and in it each
row, is then traced back by itself.

Neighbouring lines of a row with one role are a part. A part is rendered as its
share of the canonical transcript: a role mark where the role changes, the lines
without their markers, an end mark where the turn ends. The parts in order are
the transcript. A body cannot forge a mark: every ``<`` with backslashes and a
bar behind it gets one backslash more, which ``unescape`` takes away again.

Defined results: a null or empty text is an empty line; rows with a null
transcript or turn number stand alone as transcripts of one row; equal turn
numbers are ordered by a hash of label and text, and equal rows give parts of
their own; roles that tie go to the first of ``ROLES``; an empty table gives an
empty result; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import checkpoint, map_arrow

ROLES = ("system", "user", "assistant")
#: Labels that name a role.
ALIASES = {
    "system": ("system", "sys", "instruction", "instructions", "context"),
    "user": ("user", "human", "question", "q", "customer", "client", "prompter", "me"),
    "assistant": ("assistant", "ai", "bot", "answer", "a", "model", "gpt", "agent", "response"),
}
#: Turn numbers of one block.
BLOCK = 128
#: Added to every count.
SMOOTHING = 0.5
#: Shares of markers and of labels that are taken to be wrong.
MARKER_NOISE = 0.02
LABEL_NOISE = 0.1
#: Chances that the role changes from one line of a row to the next, by whether that shows a marker.
CHANGE = (0.02, 0.5)

_ROLE_OF = {name: k for k, role in enumerate(ROLES) for name in ALIASES[role]}
_HEAD = re.compile(r"^\s*(?:<\|(?:im_start\|>)?\s*([A-Za-z]+)\s*(?:\|>)?|#{1,4}\s*([A-Za-z]+)\s*:?(?=\s|$)|\[?([A-Za-z]+)\]?\s*:)\s*")
_MARK = re.compile(r"<(\\*)\|")
_N = range(len(ROLES))

#: A line: its marker's role (or None), its feature and its body.
Line = tuple[int | None, int, str]


def escape(body: str) -> str:
    return _MARK.sub(r"<\1\\|", body)


def unescape(body: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", body)


def role_of_label(label: Column) -> Column:
    """The role that a speaker label names, else null."""
    low = F.lower(F.trim(label))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for role, names in ALIASES.items():
        out = out.when(low.isin(*names), role)
    return out


def parse_lines(text: str | None) -> list[Line]:
    """The lines of a row: marker, feature (length class and whether it asks) and body without its marker."""
    out = []
    for line in (text or "").split("\n"):
        m = _HEAD.match(line)
        role = _ROLE_OF.get(next(g for g in m.groups() if g).lower()) if m else None
        body = line if role is None else line[m.end() :]
        n = len(body)
        out.append((role, (0 if n < 80 else 1 if n < 400 else 2 if n < 1600 else 3) * 2 + ("?" in body), body))
    return out


class RoleModel:
    """Log probabilities of starts, steps between rows and between lines, line features, markers and labels."""

    def __init__(self, features: dict[tuple[str, int], float], steps: dict[tuple[str, str], int], starts: dict[str, int]):
        self.start = self._log([starts.get(r, 0) for r in ROLES])
        self.step = [self._log([steps.get((r, t), 0) for t in ROLES]) for r in ROLES]
        self.line = [self._log([features.get((r, k), 0) for k in range(8)]) for r in ROLES]
        self.inside = [[[math.log(1 - c if a == b else c / (len(ROLES) - 1)) for b in _N] for a in _N] for c in CHANGE]

    @staticmethod
    def _log(counts: list[float]) -> list[float]:
        total = sum(counts) + SMOOTHING * len(counts)
        return [math.log((c + SMOOTHING) / total) for c in counts]

    @staticmethod
    def _says(role: int | None, s: int, noise: float) -> float:
        return 0.0 if role is None else math.log(1 - noise) if role == s else math.log(noise / (len(ROLES) - 1))

    def emissions(self, lines: list[Line], label: str | None) -> list[tuple[list[float], int]]:
        """Scores of each line of a row by role, and whether it shows a marker.

        The lines' features together weigh as one; the label speaks for the first line.
        """
        named = None if label is None else ROLES.index(label)
        out = [[self.line[s][f] / len(lines) + self._says(m, s, MARKER_NOISE) for s in _N] for m, f, _ in lines]
        out[0] = [e + self._says(named, s, LABEL_NOISE) for s, e in enumerate(out[0])]
        return [(e, int(m is not None)) for e, (m, _, _) in zip(out, lines)]

    def _lines(self, emissions: list[tuple[list[float], int]]) -> tuple[list[list[list[float]]], list[list[list[float]]]]:
        """The lines as matrices, and the steps between them."""
        return [[[e[a] if a == b else -math.inf for b in _N] for a in _N] for e, _ in emissions], [self.inside[marked] for _, marked in emissions[1:]]

    def row_matrix(self, emissions: list[tuple[list[float], int]]) -> list[list[float]]:
        """Best score from each role of a row's first line to each of its last, emissions included."""
        return self._product(*self._lines(emissions))

    def block_matrix(self, rows: list[list[list[float]]]) -> list[list[float]]:
        """The same for the rows of a block, given their matrices."""
        return self._product(rows, [self.step] * (len(rows) - 1))

    @staticmethod
    def _product(matrices: list[list[list[float]]], steps: list[list[list[float]]]) -> list[list[float]]:
        m = matrices[0]
        for x, step in zip(matrices[1:], steps):
            into = [[max(m[a][s] + step[s][b] for s in _N) for b in _N] for a in _N]
            m = [[max(into[a][s] + x[s][b] for s in _N) for b in _N] for a in _N]
        return m

    def chain(self, matrices: list[list[list[float]]]) -> list[tuple[int, int]]:
        """Entry and exit roles of each block on the best path through all."""
        return self._path(matrices, [self.step] * (len(matrices) - 1), self.start, [0.0] * len(ROLES))

    def trace_rows(self, matrices: list[list[list[float]]], first: int, last: int) -> list[tuple[int, int]]:
        """Entry and exit roles of a block's rows between fixed roles at its ends."""
        return self._path(matrices, [self.step] * (len(matrices) - 1), [0.0 if s == first else -math.inf for s in _N], [0.0 if s == last else -math.inf for s in _N])

    def trace_lines(self, emissions: list[tuple[list[float], int]], first: int, last: int) -> list[int]:
        """Roles of a row's lines between fixed roles at its ends."""
        return [a for a, _ in self._path(*self._lines(emissions), [0.0 if s == first else -math.inf for s in _N], [0.0 if s == last else -math.inf for s in _N])]

    @staticmethod
    def _path(matrices: list[list[list[float]]], steps: list[list[list[float]]], start: list[float], end: list[float]) -> list[tuple[int, int]]:
        """Viterbi over (entry, exit) roles of each matrix; the first of equal roles wins."""
        into, entries, backs, best = list(start), [], [], []
        for k, m in enumerate(matrices):
            if k:
                found = [max((best[s] + steps[k - 1][s][a], -s) for s in _N) for a in _N]
                into = [x for x, _ in found]
                backs.append([-s for _, s in found])
            total = [[into[a] + m[a][b] for b in _N] for a in _N]
            entries.append([max(_N, key=lambda a: (total[a][b], -a)) for b in _N])
            best = [max(total[a][b] for a in _N) for b in _N]
        out = max(_N, key=lambda b: (best[b] + end[b], -b))
        path = []
        for k in range(len(matrices) - 1, -1, -1):
            entry = entries[k][out]
            path.append((entry, out))
            if k:
                out = backs[k - 1][entry]
        return path[::-1]


def _rows(chats: DataFrame, conv: str, turn: str, label: str, text: str) -> DataFrame:
    rows = chats.select(
        F.col(conv).alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        role_of_label(F.col(label)).alias("label"),
        F.col(text).alias("body"),
        (F.col(conv).isNull() | F.col(turn).isNull()).alias("alone"),
    )
    return rows.select("*", F.xxhash64("label", "body").alias("h"), F.floor(F.col("turn") / BLOCK).cast("long").alias("block"))


def fit_roles(rows: DataFrame) -> RoleModel:
    """Count features, steps and starts over all rows whose first line or label names a role."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, int], float] = {}
        for b in batches:
            for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                lines = parse_lines(text)
                for _, f, _ in lines:
                    counts[label, f] = counts.get((label, f), 0.0) + 1 / len(lines)
        yield pa.RecordBatch.from_pydict({"label": pa.array([k[0] for k in counts], pa.string()), "f": pa.array([k[1] for k in counts], pa.int32()), "n": pa.array(list(counts.values()), pa.float64())})

    head = F.regexp_extract("body", r"^\s*(?:<\|(?:im_start\|>)?|#{1,4}|\[)?\s*([A-Za-z]+)\]?\s*(?:\|>|:)", 1)
    known = rows.select("conv", "turn", "alone", "body", F.coalesce(role_of_label(head), "label").alias("label")).where("label is not null")
    found = {(r[0], r[1]): r[2] for r in map_arrow(known.select("label", "body"), features, "label string, f int, n double").groupBy("label", "f").agg(F.sum("n")).collect()}
    # One role for each turn number: ties must not multiply in the join.
    a = known.where("not alone").groupBy("conv", F.col("turn").alias("t")).agg(F.min("label").alias("label"))
    b = a.select(F.col("conv").alias("c2"), (F.col("t") - 1).alias("t2"), F.col("label").alias("l2"))
    steps = {(r[0], r[1]): r[2] for r in a.join(b, (F.col("conv") == F.col("c2")) & (F.col("t") == F.col("t2"))).groupBy("label", "l2").count().collect()}
    starts = dict(a.groupBy("conv").agg(F.min_by("label", "t").alias("m")).groupBy("m").count().collect())
    return RoleModel(found, steps, starts)


def _by_key(df: DataFrame, each: Callable[[list[dict]], list[tuple]], schema: str, keys: list[str], order: list[str]) -> DataFrame:
    """Run ``each`` on the rows of every key in order; a key's rows may span Arrow batches."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(arrow.names, r)) for r in out], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []
        for b in batches:
            for row in b.to_pylist():
                key = tuple(row[k] for k in keys)
                if key != now and held:
                    out += each(held)
                    held = []
                now = key
                held.append(row)
            if len(out) > 2000:
                yield batch(out)
                out = []
        if held:
            out += each(held)
        yield batch(out)

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_arrow(df.repartition(n, *keys).sortWithinPartitions(*keys, *order), run, schema)


def _parts(model: RoleModel, row: dict, entry: int, exit_: int, before: int, after: int) -> list[tuple]:
    """(conv, turn, part, role, opens, closes, body) of a row's parts."""
    lines = parse_lines(row["body"])
    path = model.trace_lines(model.emissions(lines, row["label"]), entry, exit_)
    edges = [k for k in range(len(path)) if not k or path[k] != path[k - 1]] + [len(path)]
    out = []
    for k, (x, y) in enumerate(zip(edges[:-1], edges[1:])):
        opens = path[x] != before if not x else True
        closes = path[x] != after if y == len(path) else True
        out.append((row["conv"], row["turn"], k, ROLES[path[x]], opens, closes, escape("\n".join(b for _, _, b in lines[x:y]))))
    return out


def format_chats(chats: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", label_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, part, role, opens, closes and rendered for each part of each row."""
    kind = chats.schema[conv_col].dataType.simpleString()
    rows = _rows(chats, conv_col, turn_col, label_col, text_col)
    shared = chats.sparkSession.sparkContext.broadcast(fit_roles(rows))
    # Rows that stand alone are decided by themselves, in no group.
    together, alone = rows.where("not alone"), rows.where("alone")
    row_matrix = lambda r: shared.value.row_matrix(shared.value.emissions(parse_lines(r["body"]), r["label"]))
    square = lambda m: [m[i * len(ROLES) : (i + 1) * len(ROLES)] for i in _N]

    def matrix(held: list[dict]) -> list[tuple]:
        m = shared.value.block_matrix([row_matrix(r) for r in held])
        return [(held[0]["conv"], held[0]["block"], [x for line in m for x in line])]

    blocks = _by_key(together.select("conv", "block", "turn", "h", "label", "body"), matrix, f"conv {kind}, block bigint, m array<double>", ["conv", "block"], ["turn", "h"])

    def chained(held: list[dict]) -> list[tuple]:
        ends = shared.value.chain([square(r["m"]) for r in held])
        before, after = [-1, *(e[1] for e in ends[:-1])], [*(e[0] for e in ends[1:]), -1]
        return [(r["conv"], r["block"], *e, p, a) for r, e, p, a in zip(held, ends, before, after)]

    ends = checkpoint(_by_key(blocks, chained, f"e_conv {kind}, e_block bigint, first int, last int, before int, after int", ["conv"], ["block"]))
    joined = together.join(ends, (F.col("conv") == F.col("e_conv")) & (F.col("block") == F.col("e_block"))).drop("e_conv", "e_block", "alone")

    def parts(held: list[dict]) -> list[tuple]:
        m = shared.value
        path = m.trace_rows([row_matrix(r) for r in held], held[0]["first"], held[0]["last"])
        before, after = [held[0]["before"], *(e[1] for e in path[:-1])], [*(e[0] for e in path[1:]), held[0]["after"]]
        return [x for r, e, p, a in zip(held, path, before, after) for x in _parts(m, r, *e, p, a)]

    schema = f"conv {kind}, turn bigint, part int, role string, opens boolean, closes boolean, body string"
    out = _by_key(joined, parts, schema, ["conv", "block"], ["turn", "h"])
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            got = [x for r in b.to_pylist() for x in _parts(m, r, *m.chain([row_matrix(r)])[0], -1, -1)]
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, x)) for x in got], schema=arrow)

    out = out.unionAll(map_arrow(alone.select("conv", "turn", "label", "body"), single, schema))
    rendered = F.concat(F.when(F.col("opens"), F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"))).otherwise(""), F.col("body"), F.when(F.col("closes"), F.lit("\n<|end|>\n")).otherwise("\n"))
    return out.select(F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), "part", "role", "opens", "closes", rendered.alias("rendered"))
