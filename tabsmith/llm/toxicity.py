"""Toxic passages by maximum-scoring segments over token log-odds.

Tokens are words and their pieces: the character n-grams of a word with a mark
at both its ends, since the evidence may be a stem that takes ever other
endings. A token's rate in a text is the share of the text's different words
that hold it, so a word counts once however often it is repeated. A token's
score is the log-ratio of its mean rates in toxic and in clean texts under a
Dirichlet prior of one text at the common rate; its z-value, from the rates'
spread between texts, says whether that is more than chance. A word takes the
token with the highest score, and the rates are then taken again from the words
that each token really speaks for. Tokens with evidence for the toxic class
form the lexicon, every other word costs the same small amount, so the expected
score of clean text is negative. Nothing depends on the language.

A linear scan then finds all disjoint maximal segments of a text, the
positive runs that no extension or cut improves. As in sequence alignment, the
best segment of a clean text follows an extreme-value law: a segment of score s
in n words is expected K * n * exp(-lambda * s) times by chance. The document's
evidence is the sum of -log(expected count) over its significant segments, and
a logistic curve fitted on the training documents turns that into a score.
"""

from __future__ import annotations

import bisect
import itertools
import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabsmith.llm.common import c, slices, text_of
from tabsmith.session import materialise

#: The most labelled documents that the model is fitted on, and the most tokens of its lexicon.
TRAIN_DOCS, LEXICON = 20_000, 20_000
#: Pieces of a word have so many characters, its end marks among them; longer words are no tokens themselves.
SHORTEST, LONGEST, WORD = 4, 8, 40
#: A text counts as having at least so many different words, and a rate as at most this.
LEAST_WORDS, MOST_RATE = 20, 0.05
#: The least z-value and score of a token, the least texts that it comes from, and the highest score.
LEAST_Z, LEAST_SCORE, LEAST_TEXTS, MOST_SCORE = 4.0, 1.0, 4, 8.0
#: What a word without a token costs.
COST = 0.02
#: A segment is significant when it is expected at most so often in a clean text of its length.
SIGNIFICANT = 0.1
#: Rates are summed as whole numbers of this part, so that sums do not depend on their order.
UNIT = 1_000_000

TOKEN = re.compile(r"[^\W\d_]+")
END = "^"


@dataclass
class ToxicModel:
    """What training leaves: token scores, the cost of other words, the extreme-value law and the curve."""

    scores: dict[str, float]
    cost: float
    lam: float
    k: float
    slope: float
    offset: float

    def dumps(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False, sort_keys=True)


def tokens(text: str) -> list[str]:
    """The words of a text in lower case."""
    return TOKEN.findall(text.lower())


class Finder:
    """The best token of every word of a text, by one automaton over its words."""

    def __init__(self, scores: dict[str, float]):
        import ahocorasick

        self.scores = scores
        self.find = ahocorasick.Automaton()
        for t in scores:
            self.find.add_word(t, t)
        self.find.make_automaton()

    def words(self, words: list[str]) -> dict[int, list[str]]:
        """Position to the tokens found there, in rising order of position."""
        out: dict[int, list[str]] = {}
        if not self.scores or not words:
            return out
        starts = None
        for end, t in self.find.iter(END + END.join(words) + END):
            if starts is None:
                starts = list(itertools.accumulate((len(w) + 1 for w in words), initial=0))
            # A token that ends in the mark behind a word ends where the next word starts.
            out.setdefault(bisect.bisect_right(starts, end - 1 if t[-1] == END else end) - 1, []).append(t)
        return out

    def hits(self, words: list[str]) -> list[tuple[int, float]]:
        """(position, score) of words with a token; a word that comes again adds nothing."""
        seen, out = set(), []
        for i, found in sorted(self.words(words).items()):
            if words[i] not in seen:
                seen.add(words[i])
                out.append((i, max(self.scores[t] for t in found)))
        return out

    def best(self, found: list[str]) -> str:
        """The token that speaks for a word: the highest score, then the longest."""
        return min(found, key=lambda t: (-self.scores[t], -len(t), t))


def segments(hits: list[tuple[int, float]], cost: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word, score) of a text.

    `hits` are the positions and scores of lexicon words in rising order; each
    word between them costs `cost`. Candidates are kept with the running sums
    before and after them; a new one swallows earlier ones as long as that
    raises its score. Each candidate knows the nearest one that starts lower, so
    the scan is linear.
    """
    held: list[tuple[int, int, float, float, int]] = []  # first, last, sum before, sum after, nearest lower one
    total, at = 0.0, 0
    for pos, score in hits:
        total -= cost * (pos - at)
        at = pos + 1
        first, left, right = pos, total, total + score
        total = right
        while True:
            # The nearest earlier candidate that starts lower; what lies between is no part of a maximal segment.
            j = len(held) - 1
            while j >= 0 and held[j][2] >= left:
                j = held[j][4]
            if j < 0 or held[j][3] >= right:
                held.append((first, pos, left, right, j))
                break
            first, left = held[j][0], held[j][2]
            del held[j:]
    return [(a, b, right - left) for a, b, left, right, _ in held]


def _evidence(words: list[str], model: ToxicModel, finder: Finder) -> tuple[float, list[tuple[int, int, float]]]:
    """Evidence of a text and its significant segments."""
    found = segments(finder.hits(words), model.cost)
    out, passages = 0.0, []
    for first, last, score in found:
        expected = math.log(model.k * max(len(words), 1)) - model.lam * score
        if expected <= math.log(SIGNIFICANT):
            out -= expected
            passages.append((first, last, score))
    return out, passages


def _sample(labelled: DataFrame, most: int) -> DataFrame:
    """About `most` rows at most, by hash: the same ones on a rerun and on any partitioning."""
    n = labelled.count()
    if n <= most:
        return labelled
    return labelled.filter(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) < int((1 << 30) * most / n))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicModel:
    """Fit the model on the labelled documents given; keep held-out rows out of `labels`.

    At most about TRAIN_DOCS documents are used, picked by hash; equal texts
    count once and are toxic where one of them is. Null labels and ids are left
    out, a null text is an empty one. The lexicon is bounded by LEXICON tokens,
    so the model can travel with the tasks. Without toxic or clean rows the
    lexicon is empty and every score is the share of toxic rows.
    """
    marks = labels.filter(c(label_col).isNotNull()).groupBy(c(id_col).alias("id")).agg(F.max(c(label_col).cast("int")).alias("toxic"))
    texts = docs.select(c(id_col).alias("id"), text_of(text_col).alias("text"))
    sample = _sample(marks.withColumn("text", F.lit("")), TRAIN_DOCS).drop("text")
    # The sample is bounded by TRAIN_DOCS ids, so it can go to every task.
    rows = texts.join(F.broadcast(sample), "id").groupBy("text").agg((F.max("toxic") > 0).alias("toxic"))
    rows = materialise(rows, "toxic-train")
    totals = rows.agg(F.count("*"), F.sum(F.col("toxic").cast("int"))).first()
    n, toxic = int(totals[0]), int(totals[1] or 0)
    base = (toxic + 1) / (n + 2)
    flat = ToxicModel({}, COST, 1.0, 1.0, 1.0, math.log(base / (1 - base)))
    if not toxic or toxic == n:
        return flat
    scores = dict.fromkeys(_candidates(rows, toxic, n - toxic), 0.0)
    # All candidates side by side; then each word to its best one, twice, since that changes the rates.
    for alone in (False, True, True):
        scores = _scores(rows, scores, toxic, n - toxic, alone)
    if not scores:
        return flat
    chance, words = _clean_hits(rows, scores)
    lam = _decay(scores, chance, COST)
    # K so that clean words start as many segments as were seen, one more for safety.
    k = (sum(chance.values()) * (words + 1) + 1) / (words + 1)
    model = ToxicModel(scores, COST, lam, k, 1.0, 0.0)
    model.slope, model.offset = _curve(rows, model)
    return model


def _pieces(word: Column) -> Column:
    """The tokens of a word: itself between its marks, and the n-grams of that."""
    marked = F.concat(F.lit(END), word, F.lit(END))

    def grams(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(marked) - n + 1)
        return F.when(F.length(marked) >= n, F.transform(starts, lambda i: F.substring(marked, i, F.lit(n))))

    kinds = [grams(n) for n in range(SHORTEST, LONGEST + 1)]
    return F.array_distinct(F.concat(F.array(marked), *[F.coalesce(k, F.array().cast("array<string>")) for k in kinds]))


def _candidates(rows: DataFrame, toxic: int, clean: int) -> list[str]:
    """Tokens that stand out when words are taken as independent of each other, at most LEXICON of them.

    Rates are sums over words, so a table of words gives them: its rows are
    cut into pieces and counted by Spark.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[str, list[int]] = {}
        for b in slices(batches):
            for text, mark in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                words = set(tokens(text))
                rate, at = UNIT // max(len(words), LEAST_WORDS), 0 if mark else 3
                for w in words:
                    if len(w) <= WORD:
                        row = table.get(w)
                        if row is None:
                            row = table[w] = [0] * 6
                        row[at] += 1
                        row[at + 1] += rate
                        row[at + 2] += rate * rate
            if len(table) > 300_000:
                yield flush(table)
        yield flush(table)

    def flush(table: dict[str, list[int]]) -> pa.RecordBatch:
        columns = [pa.array([r[i] for r in table.values()], pa.int64()) for i in range(6)]
        batch = pa.RecordBatch.from_arrays([pa.array(list(table), pa.string()), *columns], names=["word", *sums])
        table.clear()
        return batch

    sums = ["t", "ts", "tv", "c", "cs", "cv"]
    words = rows.mapInArrow(count, "word string, " + ", ".join(f"{x} long" for x in sums))
    words = materialise(words.groupBy("word").agg(*[F.sum(x).alias(x) for x in sums]), "toxic-words")
    per = words.select(F.explode(_pieces(F.col("word"))).alias("token"), *sums).groupBy("token").agg(*[F.sum(x).alias(x) for x in sums])
    share = (F.col("ts") + F.col("cs")) / F.lit(float(toxic + clean))
    score = F.log(((F.col("ts") + share) / (toxic + 1)) / ((F.col("cs") + share) / (clean + 1)))
    spread = F.sqrt(F.col("tv") / float(toxic) ** 2 + F.col("cv") / float(clean) ** 2)
    z = (F.col("ts") / float(toxic) - F.col("cs") / float(clean)) / spread
    found = per.filter(F.col("t") >= LEAST_TEXTS).select("token", score.alias("score"), z.alias("z"))
    found = found.filter((F.col("z") >= LEAST_Z) & (F.col("score") >= LEAST_SCORE)).orderBy(F.col("z").desc(), "token").limit(LEXICON)
    return sorted(r["token"] for r in found.collect())


def _scores(rows: DataFrame, known: dict[str, float], toxic: int, clean: int, alone: bool) -> dict[str, float]:
    """Scores of the known tokens that keep enough evidence text by text.

    With `alone` a word speaks for its best token only, else for all that it
    holds. A task adds up its own texts, so it sends a row per token.
    """
    if not known:
        return {}
    names = ["t", "ts", "tv", "c", "cs", "cv"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, table = Finder(known), {}
        for b in slices(batches):
            for text, mark in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                words = list(dict.fromkeys(tokens(text)))
                mine = Counter()
                for found in finder.words(words).values():
                    mine.update([finder.best(found)] if alone else set(found))
                at = 0 if mark else 3
                for t, n in mine.items():
                    rate = min(n * UNIT // max(len(words), LEAST_WORDS), int(MOST_RATE * UNIT))
                    row = table.setdefault(t, [0] * 6)
                    row[at] += 1
                    row[at + 1] += rate
                    row[at + 2] += rate * rate
        columns = [pa.array([r[i] for r in table.values()], pa.int64()) for i in range(6)]
        yield pa.RecordBatch.from_arrays([pa.array(list(table), pa.string()), *columns], names=["token", *names])

    found = rows.mapInArrow(count, "token string, " + ", ".join(f"{x} long" for x in names))
    found = found.groupBy("token").agg(*[F.sum(x).alias(x) for x in names]).collect()
    out = {}
    for r in sorted(found, key=lambda r: r["token"]):
        value, z = evidence_of(*[r[x] for x in names], toxic, clean)
        if r["t"] >= LEAST_TEXTS and z >= LEAST_Z and value >= LEAST_SCORE:
            out[r["token"]] = min(value, MOST_SCORE)
    return out


def evidence_of(t: int, ts: int, tv: int, c_: int, cs: int, cv: int, toxic: int, clean: int) -> tuple[float, float]:
    """(score, z) from the sums of rates and of their squares over toxic and clean texts."""
    share = (ts + cs) / (toxic + clean)
    score = math.log(((ts + share) / (toxic + 1)) / ((cs + share) / (clean + 1)))
    spread = (tv / toxic - (ts / toxic) ** 2) / toxic + (cv / clean - (cs / clean) ** 2) / clean
    return score, (ts / toxic - cs / clean) / math.sqrt(max(spread, 1.0))


def _clean_hits(rows: DataFrame, scores: dict[str, float]) -> tuple[dict[str, float], int]:
    """How often a word of clean text takes each token, as a share of its words, and the number of these."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, table, total = Finder(scores), Counter(), 0
        for b in slices(batches):
            for text in b.column("text").to_pylist():
                words = tokens(text)
                total += len(words)
                seen = set()
                for i, found in finder.words(words).items():
                    if words[i] not in seen:
                        seen.add(words[i])
                        table[finder.best(found)] += 1
        table[""] = total
        yield pa.RecordBatch.from_arrays([pa.array(list(table), pa.string()), pa.array(list(table.values()), pa.int64())], names=["token", "n"])

    found = rows.filter("not toxic").mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    counts = {r["token"]: r["n"] for r in found}
    words = counts.pop("", 0)
    # Tokens that clean texts lack count as half a hit.
    return {t: max(counts.get(t, 0), 0.5) / (words + 1) for t in scores}, words


def _decay(scores: dict[str, float], chance: dict[str, float], cost: float) -> float:
    """The positive root of E[exp(lambda * score)] = 1 over the words of clean text."""
    s, p = np.array([scores[w] for w in scores]), np.array([chance[w] for w in scores])
    rest = 1 - p.sum()
    excess = lambda x: float((p * np.exp(np.minimum(x * s, 700))).sum() + rest * math.exp(-x * cost) - 1)
    low, high = 1e-6, 1.0
    while excess(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return max(high, 0.05)


def _curve(rows: DataFrame, model: ToxicModel) -> tuple[float, float]:
    """Slope and offset of the logistic curve, from counts per rounded evidence."""
    scored = rows.select("text", F.col("toxic").cast("long").alias("toxic")).mapInArrow(_scorer(model, True), "toxic long, x double")
    table = scored.groupBy(F.round(F.least("x", F.lit(60.0)), 1).alias("x")).agg(F.count("*").alias("n"), F.sum("toxic").alias("k")).collect()
    x = np.array([r["x"] for r in table])
    n, k = (np.array([float(r[i]) for r in table]) for i in ("n", "k"))
    a = np.stack([x, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        # A little shrinkage keeps the slope finite where evidence parts the classes.
        step = np.linalg.solve(a.T @ (a * (n * p * (1 - p))[:, None]) + np.diag([0.1, 1e-3]), a.T @ (k - n * p) - np.array([0.1 * w[0], 1e-3 * w[1]]))
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(w[0]), 1e-3), float(w[1])


def _scorer(model: ToxicModel, training: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(model.scores)
        for b in slices(batches):
            found = [_evidence(tokens(t), model, finder) for t in b.column("text").to_pylist()]
            x = [e for e, _ in found]
            if training:
                yield pa.RecordBatch.from_arrays([b.column("toxic").cast(pa.int64()), pa.array(x, pa.float64())], names=["toxic", "x"])
                continue
            score = [1 / (1 + math.exp(-max(-700.0, min(700.0, model.slope * e + model.offset)))) for e in x]
            passages = [[{"first": a, "last": z, "score": s} for a, z, s in p] for _, p in found]
            kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(score, pa.float64()), pa.array(passages, kind)], names=["id", "score", "passages"]
            )

    return run


def score(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, passages) of every row, by one scan of its whole text.

    `passages` lists the significant segments by first and last word (counted
    from 0) and score. Null and empty texts have no words and get the score of
    no evidence. Only the text is an input of the score. Ids are carried along,
    null and repeated ones too. An empty table gives no rows.
    """
    rows = docs.select(c(id_col).alias("id"), text_of(text_col).alias("text"))
    id_type = rows.schema["id"].dataType
    passage = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("score", T.DoubleType())]))
    schema = T.StructType([T.StructField("id", id_type), T.StructField("score", T.DoubleType()), T.StructField("passages", passage)])
    out = rows.mapInArrow(_scorer(model), schema)
    return out.select(F.col("id").alias("doc_id"), "score", "passages")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that training never sees: a fifth of the ids by their CRC-32."""
    return F.coalesce(F.crc32(c(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def drop_toxic(docs: DataFrame, model: ToxicModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of `docs` whose text scores below the threshold; all columns stay.

    A null or empty text has no evidence, so it stays unless most labelled
    texts are toxic. Null and repeated ids and further columns are carried
    along; an empty table stays empty.
    """
    names = docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(model.scores)
        for b in slices(batches):
            texts = b.column(names.index(text_col)).to_pylist()
            scores = (model.slope * _evidence(tokens(t or ""), model, finder)[0] + model.offset for t in texts)
            mark = math.log(threshold / (1 - threshold))
            yield b.filter(pa.array([s < mark for s in scores], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
