"""Chat formatting: roles of transcript lines by a hidden Markov model, then canonical turns.

A transcript is a sequence of lines. The hidden state of a line is a role and
whether the line opens a turn or goes on with it. What is seen of a line is one
symbol made of its speaker marker, if any, the line before, its length and its
end. Transition and symbol probabilities are counts over labelled transcripts,
added up by Spark; the tables have a row per state and symbol, however many
lines there are.

Viterbi runs over chunks of lines. A chunk is first reduced to a matrix: the
best score from each state before it to each state at its end. The matrices of
a transcript, one small row per chunk, are folded to find the state at every
chunk's border, and between known borders each chunk is decoded alone. A
transcript of any length is spread over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tabsmith.llm.common import c
from tabsmith.session import materialise

ROLES = ("user", "assistant", "system", "other")
#: State 2 * role opens a turn, 2 * role + 1 goes on with it.
STATES = 2 * len(ROLES)
#: The words that mark a speaker at the start of a line, by role.
MARKERS = {
    "user": ("user", "human", "q", "customer", "me"),
    "assistant": ("assistant", "bot", "a", "ai", "agent"),
    "system": ("system", "instructions", "context"),
}
MARK = r"^\s*(?:#+\s*)?(?:\*\*|<\|?|\[)?([A-Za-z]+)(?:\*\*|\|?>|\])?\s*:\s*"
#: Marker kinds (none, one of MARKERS, an unknown one), the line before (none, blank, text), lengths, ends.
KINDS, BEFORE, LENGTHS, ENDS = 5, 3, 4, 3
SYMBOLS = KINDS * BEFORE * LENGTHS * ENDS
CHUNK = 2048


def marker(line: Column) -> Column:
    """0 for no marker, 1 to 3 for the roles of MARKERS, 4 for a name that is none of them."""
    word = F.lower(F.regexp_extract(line, MARK, 1))
    out = F.when(word == "", 0).otherwise(4)
    for k, names in enumerate(MARKERS.values(), 1):
        out = F.when(word.isin(*names), k).otherwise(out)
    return out


def symbols(lines: DataFrame) -> DataFrame:
    """Add `symbol` to (conv, chunk, n, line, prev)."""
    bare = F.trim("line")
    before = F.when(F.col("prev").isNull(), 0).when(F.trim("prev") == "", 1).otherwise(2)
    size = F.length(F.regexp_replace(bare, MARK, ""))
    length = F.when(size == 0, 0).when(size < 60, 1).when(size < 240, 2).otherwise(3)
    end = F.when(bare.endswith("?"), 1).when(bare.rlike("[.!]$"), 2).otherwise(0)
    code = ((marker(F.col("line")) * BEFORE + before) * LENGTHS + length) * ENDS + end
    return lines.withColumn("symbol", code.cast("int"))


def transcripts(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", unmarked: int = 4) -> DataFrame:
    """(conv, n, line, prev, state): the turns of conversations as plain transcripts.

    The lines of a conversation are those of its turns by turn number, then by
    role and text. A turn's first line gets a speaker marker in a spelling that
    the conversation's hash picks; one turn in `unmarked`, by hash, gets none,
    so that its role has to be found. `state` is the true one. A null text is
    an empty line, a null or unknown role counts as `other`, a null turn comes
    first, null conversations are one conversation. Repeated turns are turns
    of their own.
    """
    rows = turns.select(
        F.coalesce(c(conv_col).cast("string"), F.lit("")).alias("conv"), c(turn_col).alias("turn"),
        F.lower(F.coalesce(c(role_col), F.lit("other"))).alias("said"), F.coalesce(c(text_col), F.lit("")).alias("text"),
    )
    role = F.lit(ROLES.index("other"))
    for k, name in enumerate(ROLES):
        role = F.when(F.col("said") == name, k).otherwise(role)
    rows = rows.withColumn("role", role).withColumn("h", F.md5(F.concat_ws("\u0001", "conv", "turn", "said", "text").cast("binary")))
    style = F.pmod(F.xxhash64("conv"), F.lit(3)).cast("int")
    names = F.lit([[*m[:3]] for m in (*MARKERS.values(), ("narrator", "note", "narrator"))])
    name = F.get(F.get(names, F.col("role")), style)
    mark = F.when(style == 0, F.concat(F.initcap(name), F.lit(": "))).when(style == 1, F.concat(F.lit("### "), F.initcap(name), F.lit(": "))).otherwise(F.concat(F.lit("["), name, F.lit("]: ")))
    mark = F.when(F.pmod(F.xxhash64("h"), F.lit(unmarked)) == 0, "").otherwise(mark)
    lines = rows.select("conv", "turn", "h", "role", F.posexplode(F.split(F.concat(mark, F.col("text")), "\n")).alias("k", "line"))
    lines = lines.withColumn("state", 2 * F.col("role") + F.when(F.col("k") == 0, 0).otherwise(1))
    return numbered(lines, ["turn", "h", "k"])


def numbered(lines: DataFrame, order: list[str], per_part: int = 1 << 16) -> DataFrame:
    """(conv, n, line, prev, state) from lines with an order; long conversations are numbered in ranges."""
    keys = [F.col("conv"), *[F.col(x).asc_nulls_first() for x in order]]
    ranged = lines.repartitionByRange(*keys).withColumn("part", F.spark_partition_id())
    ranged = materialise(ranged, "transcript-lines")
    inside = W.partitionBy("part", "conv").orderBy(*keys[1:])
    local = ranged.withColumn("i", F.row_number().over(inside) - 1).withColumn("prev", F.lag("line").over(inside))
    ends = ranged.groupBy("conv", "part").agg(F.count("*").alias("k"), F.max_by("line", F.struct(*[F.col(x).isNotNull() if j % 2 else F.col(x) for x in order for j in (1, 0)])).alias("tail"))
    earlier = W.partitionBy("conv").orderBy("part")
    ends = ends.select(
        "conv", "part", F.coalesce(F.sum("k").over(earlier.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"),
        F.lag("tail").over(earlier).alias("tail"),
    )
    both = local.join(ends, ["conv", "part"])
    prev = F.when(F.col("i") == 0, F.col("tail")).otherwise(F.col("prev"))
    return both.select("conv", (F.col("base") + F.col("i")).alias("n"), "line", prev.alias("prev"), "state")


class RoleModel:
    """Log-probabilities of starts, transitions and symbols."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = (np.log(x / x.sum(-1, keepdims=True)) for x in (start, move, emit))

    def steps(self, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first line's scores and the emission scores of all lines."""
        return self.start, self.emit[:, seen].T

    def matrix(self, seen: np.ndarray, opening: bool) -> np.ndarray:
        """Best score from each state before the chunk to each state at its end."""
        enter = np.tile(self.start, (STATES, 1)) if opening else self.move
        best = enter + self.emit[:, seen[0]]
        for s in seen[1:]:
            best = (best[:, :, None] + self.move[None]).max(1) + self.emit[:, s]
        return best

    def decode(self, seen: np.ndarray, before: int | None, last: int | None) -> list[int]:
        """The best states of a chunk between the state before it and its last state."""
        best = (self.start if before is None else self.move[before]) + self.emit[:, seen[0]]
        back = []
        for s in seen[1:]:
            options = best[:, None] + self.move
            back.append(options.argmax(0))
            best = options.max(0) + self.emit[:, s]
        path = [int(best.argmax()) if last is None else last]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]


def train(lines: DataFrame) -> RoleModel:
    """Count starts, transitions and symbols of (conv, n, symbol, state); one of each is added."""
    inside = W.partitionBy("conv", F.floor(F.col("n") / CHUNK)).orderBy("n")
    pairs = lines.withColumn("last", F.lag("state").over(inside))
    # A chunk's first line has no line before it in its window; such pairs are left out, but for the first of all.
    start, move, emit = np.ones(STATES), np.ones((STATES, STATES)), np.ones((STATES, SYMBOLS))
    counted = pairs.groupBy("last", "state", "symbol", (F.col("n") == 0).alias("first")).agg(F.count("*").alias("k")).collect()
    for r in counted:
        emit[r["state"], r["symbol"]] += r["k"]
        if r["first"]:
            start[r["state"]] += r["k"]
        elif r["last"] is not None:
            move[r["last"], r["state"]] += r["k"]
    return RoleModel(start, move, emit)


def find_roles(lines: DataFrame, model: RoleModel, chunk: int = CHUNK) -> DataFrame:
    """(conv, n, line, found): the most likely state of every line of (conv, n, line, symbol)."""
    chunks = lines.withColumn("chunk", F.floor(F.col("n") / chunk)).groupBy("conv", "chunk").agg(
        F.sort_array(F.collect_list(F.struct("n", "symbol", "line"))).alias("rows")
    )
    chunks = materialise(chunks, "transcript-chunks")

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [model.matrix(np.array(s), k == 0).ravel().tolist() for s, k in zip(b.column("seen").to_pylist(), b.column("chunk").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("chunk"), pa.array(out, pa.list_(pa.float64()))], names=["conv", "chunk", "matrix"])

    def folded(group: pa.Table) -> pa.Table:
        group = group.sort_by("chunk")
        score, back = np.zeros(STATES), []
        for m in group.column("matrix").to_pylist():
            options = score[:, None] + np.array(m).reshape(STATES, STATES)
            back.append(options.argmax(0))
            score = options.max(0)
        states = [int(score.argmax())]
        for b in reversed(back):
            states.append(int(b[states[-1]]))
        states.reverse()
        before = [None, *states[1:-1]]
        return pa.table({"conv": group.column("conv"), "chunk": group.column("chunk"), "before": pa.array(before, pa.int32()), "last": pa.array(states[1:], pa.int32())})

    # Only transcripts of several chunks have borders to find.
    several = chunks.groupBy("conv").agg(F.max("chunk").alias("m")).filter("m > 0").select("conv")
    long = chunks.join(several, "conv", "left_semi").select("conv", "chunk", F.col("rows.symbol").alias("seen"))
    matrices = long.mapInArrow(reduced, "conv string, chunk long, matrix array<double>")
    borders = matrices.groupBy("conv").applyInArrow(folded, "conv string, chunk long, before int, last int")

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = [model.decode(np.array(s), x, y) for s, x, y in zip(*(b.column(i).to_pylist() for i in ("seen", "before", "last")))]
            yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("rows"), pa.array(paths, pa.list_(pa.int32()))], names=["conv", "rows", "found"])

    ready = chunks.join(borders, ["conv", "chunk"], "left").select("conv", "rows", F.col("rows.symbol").alias("seen"), "before", "last")
    schema = "conv string, rows array<struct<n:long,symbol:int,line:string>>, found array<int>"
    done = ready.mapInArrow(decoded, schema)
    zipped = done.select("conv", F.explode(F.arrays_zip("rows", "found")).alias("z"))
    return zipped.select("conv", F.col("z.rows.n").alias("n"), F.col("z.rows.line").alias("line"), F.col("z.found").alias("found"))


def render(lines: DataFrame) -> DataFrame:
    """(conv, turn, role, n_lines, text, rendered): one row per turn of (conv, n, line, found).

    A line that opens a turn, changes the role or is a transcript's first starts
    a turn; its marker is taken off. The canonical form is
    `<|role|>`, a line break, the text, a line break and `<|end|>`.
    """
    lines = materialise(lines.withColumn("block", F.floor(F.col("n") / CHUNK)), "transcript-states")
    inside = W.partitionBy("conv", "block").orderBy("n")
    edge = lines.groupBy("conv", "block").agg(F.max_by("found", "n").alias("tail"))
    edge = edge.select("conv", (F.col("block") + 1).alias("block"), "tail")
    both = lines.withColumn("last", F.lag("found").over(inside)).join(edge, ["conv", "block"], "left")
    last = F.coalesce("last", "tail")
    opens = last.isNull() | (F.col("found") % 2 == 0) | (F.floor(last / 2) != F.floor(F.col("found") / 2))
    both = materialise(both.select("conv", "block", "n", "line", "found", opens.cast("long").alias("opens")), "transcript-opens")
    totals = both.groupBy("conv", "block").agg(F.sum("opens").alias("k"))
    earlier = W.partitionBy("conv").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    base = totals.select("conv", "block", F.coalesce(F.sum("k").over(earlier), F.lit(0)).alias("base"))
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    turns = both.withColumn("inner", F.sum("opens").over(upto)).join(base, ["conv", "block"])
    turns = turns.withColumn("turn", F.col("base") + F.col("inner") - 1)
    bare = F.when(F.col("opens") == 1, F.regexp_replace("line", MARK, "")).otherwise(F.col("line"))
    out = turns.groupBy("conv", "turn").agg(
        F.min_by("found", "n").alias("state"), F.count("*").alias("n_lines"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", bare.alias("line")))), lambda x: x["line"]), "\n").alias("text"),
    )
    role = F.get(F.lit(list(ROLES)), F.floor(F.col("state") / 2).cast("int"))
    rendered = F.concat(F.lit("<|"), role, F.lit("|>\n"), F.col("text"), F.lit("\n<|end|>"))
    return out.select("conv", "turn", role.alias("role"), "n_lines", "text", rendered.alias("rendered"))


def training_fold(conv: str = "conv") -> Column:
    """Four fifths of the conversations, by the CRC-32 of their id."""
    return F.crc32(F.col(conv).cast("binary")) % 5 != 0


def format_conversations(turns: DataFrame, **columns) -> DataFrame:
    """Conversations written as transcripts, parsed again and rendered: see `transcripts` and `render`.

    The model learns from the training fold only. An empty table gives no rows.
    """
    lines = materialise(symbols(transcripts(turns, **columns)), "transcripts")
    model = train(lines.filter(training_fold()))
    return render(find_roles(lines.select("conv", "n", "line", "symbol"), model))
