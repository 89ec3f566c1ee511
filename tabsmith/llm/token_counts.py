"""Token counts of whole texts by a two-tier lookup, without a shuffle.

A merge-type SentencePiece model joins nothing across a blank that follows
another character, nor across a line break, so the number of tokens of a text
is the sum over its pre-tokens: the stretches that begin with a blank or a line
break. `PieceModel` checks the model for this when it is loaded.

First tier: a table of the pre-tokens that are frequent in a bounded sample of
texts, with their numbers of tokens, is broadcast and looked up for a whole
batch of texts at once. It decides speed only. Second tier: what it lacks is
looked up in the worker's own cache and else encoded by the library, all
missing pre-tokens of a batch in one call. Pre-tokens never leave their task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from tabsmith.llm.common import c, slices, text_of
from tabsmith.llm.pieces import BLANK, PieceModel

#: The sample that the table of frequent pre-tokens comes from: its texts, the longest one, the table's size.
SAMPLE_DOCS, SAMPLE_CHARS, FREQUENT = 1000, 8000, 1 << 17
#: Longest pre-token that a cache keeps, and the most of one generation.
LONGEST, GENERATION = 64, 300_000

_counters: dict[str, TokenCounter] = {}


class TokenCounter:
    """Numbers of tokens of texts, by pre-token."""

    def __init__(self, path: str, facts: tuple[bool, int]):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        #: Whether a line break parts what stands around it; tokens of a blank with nothing behind it.
        self.breaks, self.blank = facts
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    @classmethod
    def of(cls, path: str, facts: tuple[bool, int]) -> TokenCounter:
        """The worker's own counter, with the caches it has filled so far."""
        if path not in _counters:
            _counters[path] = cls(path, facts)
        return _counters[path]

    def split(self, texts: list[str]) -> tuple[np.ndarray, pa.Array]:
        """Bounds of each text's pre-tokens, and all of them without their first blank.

        The first one of a text is what stands before its first blank and so
        always empty. One that begins with a line break stands for that break
        and what follows it. Another empty one is a blank with nothing behind
        it. Of a run of blanks the first one parts; the others stay, as plain
        spaces, at the head of what follows.
        """
        lines = pa.array(self.library.normalize(texts), pa.large_string())
        if pc.any(pc.match_substring(lines, BLANK * 2)).as_py():
            lines = pc.replace_substring(pc.replace_substring(lines, BLANK * 2, BLANK + " "), " " + BLANK, "  ")
        if self.breaks:
            lines = pc.replace_substring(lines, "\n", BLANK + "\n")
        parts = pc.split_pattern(lines, BLANK)
        return parts.offsets.to_numpy(), parts.values

    def encoded(self, parts: list[str]) -> list[int]:
        """Numbers of tokens of pre-tokens, by the library, which puts their first blank back."""
        found = [len(ids) for ids in self.library.encode(parts, num_threads=1)]
        return [self.blank if not p else n - self.blank if p[0] == "\n" and self.breaks else n for p, n in zip(parts, found)]

    def missing(self, parts: list[str]) -> list[int]:
        """The same through the cache; what was not asked for during a whole generation is forgotten."""
        young, old = self.young, self.old
        open_parts = [p for p in parts if p not in young]
        rest = []
        for p in open_parts:
            if p in old:
                young[p] = old[p]
            else:
                rest.append(p)
        fresh = dict(zip(rest, self.encoded(rest))) if rest else {}
        out = [young[p] if p in young else fresh[p] for p in parts]
        young.update((p, n) for p, n in fresh.items() if len(p) <= LONGEST)
        if len(young) > GENERATION:
            self.young, self.old = {}, young
        return out

    def count(self, texts: list[str], keys: pa.Array, sizes: np.ndarray) -> np.ndarray:
        """Tokens of whole texts; `keys` and `sizes` are the frequent pre-tokens and their numbers."""
        bounds, parts = self.split(texts)
        place = pc.index_in(parts, value_set=keys)
        unknown = pc.is_null(place)
        # The last slot takes what the table lacks.
        numbers = np.append(sizes, 0)[pc.fill_null(place, len(sizes)).to_numpy()]
        if pc.any(unknown).as_py():
            coded = parts.filter(unknown).dictionary_encode()
            tokens = np.array(self.missing(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), np.int64)
            numbers[unknown.to_numpy(zero_copy_only=False)] = tokens[coded.indices.to_numpy()]
        numbers[bounds[:-1]] = 0
        sums = np.concatenate([[0], np.cumsum(numbers)])
        return sums[bounds[1:]] - sums[bounds[:-1]]


def cut_facts(path: str) -> tuple[bool, int]:
    """What `TokenCounter` has to know of a model, after all checks of `PieceModel`; raises where texts cannot be cut."""
    model = PieceModel.of(path)
    probe = "a\u00a0\u2460\ufb01\uff21\u1e9b\u0323"
    if model.library.normalize(probe) != BLANK + probe:
        raise ValueError("the model rewrites characters or puts no blank before a text")
    return bool(model.breaks), len(model.word(BLANK))


def frequent_parts(rows: DataFrame, counter: TokenCounter) -> tuple[list[str], list[int]]:
    """The most frequent pre-tokens of the sample and their numbers of tokens.

    The sample is up to `SAMPLE_DOCS` texts of up to `SAMPLE_CHARS` characters,
    picked by hash; about as many leave the tasks. At most `FREQUENT`
    pre-tokens of up to `LONGEST` characters are kept, which bounds what is
    broadcast.
    """
    key, share = F.xxhash64("doc_id", "text"), max(1, rows.count() // SAMPLE_DOCS)
    picked = rows.filter((F.length("text") <= SAMPLE_CHARS) & (F.pmod(key, F.lit(share)) == 0))
    texts = picked.select("text").orderBy(key, "text").limit(SAMPLE_DOCS)
    found = Counter(counter.split([r["text"] for r in texts.collect()])[1].to_pylist())
    kept = sorted((p for p in found if len(p) <= LONGEST), key=lambda p: (-found[p], p))[:FREQUENT]
    return kept, counter.encoded(kept)


def token_counts(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text, begin and end ids not counted.

    Special strings inside a text are ordinary text, as the library takes them.
    A null text is an empty one: no bytes, no tokens. Ids are carried along,
    null and repeated ones too; an empty table gives no rows; other columns are
    not read. One map without a shuffle; a worker holds a slice of texts, the
    table and two generations of its cache.
    """
    rows = docs.select(c(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    facts = cut_facts(model)
    shared = docs.sparkSession.sparkContext.broadcast(frequent_parts(rows, TokenCounter.of(model, facts)))
    schema = T.StructType([rows.schema["doc_id"], *[T.StructField(n, T.LongType()) for n in ("n_bytes", "n_tokens")], T.StructField("over_limit", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter.of(model, facts)
        words, numbers = shared.value
        keys, sizes = pa.array(words, pa.large_string()), np.array(numbers, np.int64)
        for b in slices(batches, 1000):
            tokens = counter.count(b.column("text").to_pylist(), keys, sizes)
            made = [b.column("doc_id"), b.column("n_bytes"), pa.array(tokens), pa.array(tokens > limit)]
            yield pa.RecordBatch.from_arrays(made, names=schema.names)

    sized = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    return sized.mapInArrow(run, schema)
