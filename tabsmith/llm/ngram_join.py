"""Jaccard join of documents over word n-grams, with rare-first prefix filtering.

1. Equal texts become one class; its shingles are distinct 56-bit hashes.
2. Packs of about a thousand classes send each distinct hash once, with its
   count in the pack, to the hash's range. There the counts add up to document
   frequencies, and every pack gets back its hashes that several documents
   share. A hot shingle is one entry per pack, never one per document.
3. In the common order (frequency, hash) the shingles that no other document
   has come first. Two documents of Jaccard t share a shingle within the first
   n - ceil(t * n) + 1 of each, so only the shared shingles in that prefix are
   joined; a document with enough shingles of its own takes no part at all.
4. Where documents meet, one of each component there is compared with one hub,
   for a few rounds. Components that form need no more pairs inside; documents
   of different components that still meet are then compared with each other.
   Length and positional filters hold in the joins, a suffix filter and the
   exact count in the comparison, once per pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from tabsmith.llm.common import c, text_of
from tabsmith.llm.components import stars
from tabsmith.session import materialise

N = 5
BITS = 56
#: Classes of a pack, and shingles of a range of hashes, about.
PACK_BITS, RANGE_SHINGLES = 10, 2_000_000

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _FACTORS[0]
    h = (h ^ (h >> np.uint64(29))) * _FACTORS[1]
    return (h ^ (h >> np.uint64(32))) & np.uint64((1 << BITS) - 1)


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text.

    Words are what ASCII white space separates, A-Z in lower case. A text of
    fewer than N words has its whole sequence as the only shingle, a text
    without words has none.
    """
    words = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    ends = np.cumsum(lengths)
    flat = np.empty(int(ends[-1]) if len(ends) else 0, dtype=object)
    flat[:] = list(chain.from_iterable(words))
    w = pd.util.hash_array(flat, categorize=False).astype(np.uint64) if len(flat) else np.zeros(0, np.uint64)
    rolled = np.zeros(max(len(w) - N + 1, 0), np.uint64)
    for k in range(N):
        rolled += w[k : len(w) - N + 1 + k] * _FACTORS[k] if len(rolled) else rolled
    rolled = _mix(rolled)
    out = []
    for n, end in zip(lengths.tolist(), ends.tolist()):
        if n >= N:
            out.append(np.unique(rolled[end - n : end - N + 1]))
        elif n:
            whole = (w[end - n : end] * _FACTORS[:n]).sum(dtype=np.uint64, keepdims=True)
            out.append(_mix(whole + np.array([n], np.uint64) * _FACTORS[4]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def prefix_length(n: np.ndarray | int, percent: int):
    """How many of n ordered shingles must hold a common one."""
    return n - (percent * n + 99) // 100 + 1


def _packed(hashes: np.ndarray) -> bytes:
    """Sorted hashes as compressed differences, byte by byte."""
    return zstandard.compress(np.diff(hashes, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def _numbers(values: np.ndarray) -> bytes:
    return zstandard.compress(values.astype("<u4").tobytes(), 1)


def _read_numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), "<u4").astype(np.int64)


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of equal keys."""
    cuts = np.flatnonzero(np.diff(keys)) + 1
    yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)])


def _send(range_bits: int):
    """Per pack and range of hashes: the distinct hashes and in how many of the pack's texts each is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packs, texts = b.column("pack").to_numpy(), b.column("text")
            rows: list[tuple] = []
            for lo, hi in _runs(packs) if len(packs) else ():
                sets = shingle_sets(texts.slice(lo, hi - lo).to_pylist())
                hashes, counts = np.unique(np.concatenate(sets), return_counts=True)
                at = (hashes >> np.uint64(BITS - range_bits)).astype(np.int64)
                for i, j in _runs(at) if len(at) else ():
                    rows.append((int(at[i]), int(packs[lo]), _packed(hashes[i:j]), _numbers(counts[i:j])))
            if rows:
                part, pack, held, n = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(pack, pa.int64()), pa.array(held, pa.binary()), pa.array(n, pa.binary())], names=["part", "pack", "hashes", "counts"])

    return run


def _shared(group: pa.Table) -> pa.Table:
    """Of one range: per pack the hashes that several texts have, with their document frequency."""
    held = [_unpacked(x) for x in group.column("hashes").to_pylist()]
    counts = np.concatenate([_read_numbers(x) for x in group.column("counts").to_pylist()])
    packs = np.repeat(group.column("pack").to_numpy(), [len(x) for x in held])
    hashes = np.concatenate(held)
    order = np.argsort(hashes, kind="stable")
    hashes, packs = hashes[order], packs[order]
    first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
    sums = np.add.reduceat(counts[order], first)
    frequency = np.repeat(sums, np.diff(np.r_[first, len(hashes)]))
    several = frequency > 1
    hashes, packs, frequency = hashes[several], packs[several], frequency[several]
    order = np.argsort(packs, kind="stable")
    hashes, packs, frequency = hashes[order], packs[order], frequency[order]
    rows = [(int(packs[i]), _packed(hashes[i:j]), _numbers(frequency[i:j])) for i, j in (_runs(packs) if len(packs) else ())]
    pack, held, n = zip(*rows) if rows else ((), (), ())
    return pa.table({"pack": pa.array(pack, pa.int64()), "hashes": pa.array(held, pa.binary()), "counts": pa.array(n, pa.binary())})


def _ordered(percent: int):
    """Per text of a pack: its shared hashes, rarest first, where its prefix reaches them."""

    def run(texts: pa.Table, shared: pa.Table) -> pa.Table:
        known = np.concatenate([np.zeros(0, np.uint64), *(_unpacked(x) for x in shared.column("hashes").to_pylist())])
        frequency = np.concatenate([np.zeros(0, np.int64), *(_read_numbers(x) for x in shared.column("counts").to_pylist())])
        order = np.argsort(known)
        known, frequency = known[order], frequency[order]
        sizes, own, held = [], [], []
        for h in shingle_sets(texts.column("text").to_pylist()):
            at = np.searchsorted(known, h)
            at[at == len(known)] = 0
            mine = known[at] == h if len(known) else np.zeros(len(h), bool)
            rest = len(h) - int(mine.sum())
            sizes.append(len(h))
            own.append(rest)
            if rest < len(h) and rest < prefix_length(len(h), percent):
                order = np.lexsort((h[mine], frequency[at[mine]]))
                held.append(h[mine][order].astype("<u8").tobytes())
            else:
                held.append(None)
        return pa.table({"node": texts.column("node").cast(pa.int64()), "n": pa.array(sizes, pa.int64()), "own": pa.array(own, pa.int64()), "shared": pa.array(held, pa.binary())})

    return run


def _prefixes(percent: int):
    """(hash, node, n, pos): the shared hashes in the prefix of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, own = b.column("n").to_numpy(), b.column("own").to_numpy()
            k = prefix_length(n, percent) - own
            held = [np.frombuffer(x, "<u8")[:m] for x, m in zip(b.column("shared").to_pylist(), k.tolist())]
            k = np.array([len(x) for x in held], dtype=np.int64)
            pos = np.concatenate([np.zeros(0, np.int64), *(o + np.arange(m) for o, m in zip(own.tolist(), k.tolist()))])
            hashes = np.concatenate([np.zeros(0, "<u8"), *held]).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes), pa.array(np.repeat(b.column("node").to_numpy(), k)), pa.array(np.repeat(n, k)), pa.array(pos)],
                names=["hash", "node", "n", "pos"],
            )

    return run


def _similar(a: np.ndarray, b: np.ndarray, n: int, m: int, percent: int) -> bool:
    """Whether two texts of n and m shingles, with sorted shared ones a and b, reach the percentage."""
    need = -(-percent * (n + m) // (100 + percent))

    def most(x: np.ndarray, y: np.ndarray, depth: int) -> int:
        if not depth or len(x) < 2 or not len(y):
            return min(len(x), len(y))
        i = len(x) // 2
        j = int(np.searchsorted(y, x[i]))
        return most(x[:i], y[:j], depth - 1) + most(x[i:], y[j:], depth - 1)

    return most(a, b, 2) >= need and len(np.intersect1d(a, b, assume_unique=True)) >= need


def _compare(percent: int):
    """Rows sorted by hub, the hub itself first: the pairs (hub, node) that are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_set, hub_n = None, np.zeros(0, np.uint64), 0
        for b in batches:
            out = []
            for u, node, n, raw in zip(*(b.column(x).to_pylist() for x in ("hub", "node", "n", "shared"))):
                held = np.sort(np.frombuffer(raw, "<u8"))
                if u == node:
                    hub, hub_set, hub_n = u, held, n
                elif u == hub and _similar(hub_set, held, hub_n, n, percent):
                    out.append((u, node))
            u, v = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (hub, node) that are similar; each hub's set is sent once per slice of its pairs."""
    # A hub with very many pairs is cut into slices of about a thousand.
    many = pairs.groupBy("hub").agg(F.count("*").alias("k")).withColumn("slices", F.ceil(F.col("k") / 1000).cast("int"))
    hubs = many.select("hub", F.col("hub").alias("node"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    sliced = pairs.join(many, "hub").select("hub", "node", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int").alias("slice"))
    rows = sliced.unionByName(hubs).join(sets.select("node", "n", "shared"), "node")
    rows = rows.repartition("hub", "slice").sortWithinPartitions("hub", "slice", F.col("node") != F.col("hub"))
    return materialise(rows.select("hub", "node", "n", "shared").mapInArrow(_compare(percent), "u long, v long"), "ngram-links")


def _rooted(nodes: DataFrame, star: DataFrame | None) -> DataFrame:
    """The rows with the component that each text is in so far; one that points at no other is its own."""
    if star is None:
        return nodes.withColumn("root", F.col("node"))
    roots = star.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _open(placed: DataFrame) -> DataFrame:
    """The hashes at which several components meet."""
    return placed.groupBy("hash").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a < b").select("hash")


def _untested(pairs: DataFrame, tested: DataFrame | None) -> DataFrame:
    if tested is None:
        return pairs
    both = tested.union(tested.select(F.col("node").alias("hub"), F.col("hub").alias("node")))
    return pairs.join(both, ["hub", "node"], "left_anti")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, key); `key` names the text."""
    rows = docs.select(c(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return rows.withColumn("key", F.md5(F.col("text").cast("binary")))


def _classes(rows: DataFrame, percent: int, rounds: int = 2) -> DataFrame:
    """(root, node, n, key, least_id), one row per text: its component's root, its shingles and its smallest id."""
    reps = rows.groupBy("key").agg(F.first("text").alias("text"), F.min("doc_id").alias("least_id"))
    reps = reps.withColumn("node", F.monotonically_increasing_id()).withColumn("chars", F.length("text"))
    reps = materialise(reps, "ngram-texts")
    packed = reps.withColumn("pack", F.shiftright("node", PACK_BITS))
    chars = reps.agg(F.sum("chars")).first()[0] or 0
    range_bits = max(1, int(np.ceil(np.log2(max(chars / 6 / RANGE_SHINGLES, 2)))))
    sent = packed.select("pack", "text").mapInArrow(_send(range_bits), "part long, pack long, hashes binary, counts binary")
    shared = sent.groupBy("part").applyInArrow(_shared, "pack long, hashes binary, counts binary")
    texts = packed.select("pack", "node", "text").groupBy("pack")
    sets = texts.cogroup(shared.groupBy("pack")).applyInArrow(_ordered(percent), "node long, n long, own long, shared binary")
    sets = materialise(sets, "ngram-sets")
    joined = sets.filter("shared is not null")
    entries = materialise(joined.mapInArrow(_prefixes(percent), "hash long, node long, n long, pos long"), "ngram-prefixes")

    def passes(a: str, b: str | Column):
        """Length and positional filter of two entries of one hash."""
        n, i = F.col(f"{a}.n"), F.col(f"{a}.pos")
        m, j = (F.col(f"{b}.n"), F.col(f"{b}.pos")) if isinstance(b, str) else (b["n"], b["pos"])
        most = F.least(n - i, m - j)
        return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * most >= percent * (n + m))

    star, tested = None, None
    for turn in range(rounds):
        # Per hash members of the largest component, one for each of up to 32 slots, meet one of each other
        # component there: first one of them, the same for as many hashes as can be, then eight, always
        # others. Entries early enough in their order to pass with an equal come first.
        placed = _rooted(entries, star)
        placed = materialise(placed, "ngram-placed") if turn else placed
        seed = [F.col("hash"), F.lit(turn)] if turn else []
        slot = F.pmod(F.xxhash64("node", *seed), F.lit(32)).cast("int") if turn else F.lit(0)
        late = (100 + percent) * (F.col("n") - F.col("pos")) < 2 * percent * F.col("n")
        one = F.min(F.struct(late.alias("late"), F.xxhash64("node", *seed).alias("h"), "node", "n", "pos")).alias("e")
        groups = placed.withColumn("slot", slot).groupBy("hash", "slot", "root").agg(one, F.count("*").alias("k"))
        groups = materialise(groups.join(_open(placed), "hash", "left_semi"), "ngram-groups")
        largest = groups.groupBy("hash", "root").agg(F.sum("k").alias("k")).groupBy("hash").agg(F.max(F.struct("k", "root"))["root"].alias("most"))
        hubs = groups.join(largest, "hash").filter("root = most").groupBy("hash", "most").agg(F.sort_array(F.collect_list(F.struct("slot", "e"))).alias("hubs"))
        tries = F.sequence(F.lit(0), F.least(F.lit(7 if turn else 0), F.size("hubs") - 1))
        chosen = F.transform(tries, lambda j: F.get("hubs", F.pmod(F.col("slot") + j, F.size("hubs")))["e"])
        met = groups.join(hubs, "hash").filter("root != most").withColumn("s", F.explode(F.filter(chosen, lambda x: passes("e", x))))
        pairs = met.select(F.col("s.node").alias("hub"), F.col("e.node").alias("node"))
        pairs = materialise(_untested(pairs, tested).distinct(), "ngram-pairs")
        found = _verify(pairs, joined, percent)
        tested = pairs if tested is None else tested.union(pairs)
        star = stars(found if star is None else star.union(found))
    # What is left: documents of different components that meet in a prefix.
    placed = materialise(_rooted(entries, star), "ngram-placed")
    left = placed.join(_open(placed), "hash", "left_semi")
    cross = left.alias("e").join(left.alias("f"), (F.col("e.hash") == F.col("f.hash")) & (F.col("e.root") < F.col("f.root")))
    cross = cross.filter(passes("e", "f")).groupBy(F.col("e.node").alias("hub"), F.col("f.node").alias("node")).agg(
        F.count("*").alias("common"), F.min(F.least(F.col("e.n") - F.col("e.pos"), F.col("f.n") - F.col("f.pos"))).alias("after"),
        F.first("e.n").alias("n"), F.first("f.n").alias("m"),
    )
    # All common shingles but those of the prefixes come after the last of these.
    most = F.col("common") + F.col("after") - 1
    cross = cross.filter((100 + percent) * most >= percent * (F.col("n") + F.col("m"))).select("hub", "node")
    cross = materialise(_untested(cross, tested), "ngram-cross")
    more = _verify(cross, joined, percent)
    if more.limit(1).count():
        star = stars(star.union(more))
    whole = sets.select("node", "n").join(reps.select("node", "key", "least_id"), "node")
    return materialise(_rooted(whole, star), "ngram-classes")


def ngram_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, rounds: int = 2
) -> DataFrame:
    """(doc_id, key, n_shingles, component_id), one row per row of `docs`.

    Documents link when 100 times their common shingles is at least `percent`
    times all shingles of both. `component_id` is the smallest id that links
    reach, itself included; null ids count only where nothing else is
    reached. Texts without words have no shingles and link with nothing, not
    even with each other; null texts are empty ones. `key` names the text.
    Repeated rows and rows that share an id keep a row each; with equal texts
    they are linked like other copies. An empty table gives no rows.
    """
    rows = _keyed(docs, id_col, text_col)
    whole = _classes(rows, percent, rounds)
    least = whole.groupBy("root").agg(F.min("least_id").alias("component_id"))
    whole = whole.join(least, "root").select("key", F.col("n").alias("n_shingles"), "component_id")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "key").join(whole, "key").select("doc_id", "key", "n_shingles", own.alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """The rows of `docs` with one document of each component: that of the smallest id.

    Rows without words stay. Null ids come last; of several texts with the
    smallest id the one with the smallest hash stays, of repeated rows one.
    Components that share an id, or have none, keep a document each. All
    columns stay.
    """
    names = docs.columns
    found = _classes(_keyed(docs, id_col, text_col), percent).filter("n > 0")
    first = F.min(F.struct(F.col("least_id").isNull(), "least_id", "key")).alias("first")
    best = found.groupBy("root").agg(first).select("first.least_id", "first.key")
    held = docs.select(
        F.struct(*[c(x) for x in names]).alias("_row"), c(id_col).alias("_id"), F.md5(text_of(text_col).cast("binary")).alias("_key"),
        (F.trim(F.regexp_replace(text_of(text_col), "[\\x09-\\x0D]", " ")) != "").alias("_words"),
    )
    kept = held.filter("_words").join(
        best, F.col("_id").eqNullSafe(F.col("least_id")) & (F.col("_key") == F.col("key"))
    ).groupBy("_id", "_key").agg(F.first("_row").alias("_row"))
    rows = kept.select("_row").unionByName(held.filter("not _words").select("_row"))
    return rows.select(*[F.col("_row").getField(x).alias(x) for x in names])
