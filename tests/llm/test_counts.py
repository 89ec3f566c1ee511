"""Token counts, centroid clustering and the dataset manifest against plain Python."""

import hashlib
import math
import random
import zlib

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tabsmith.llm import centroids, manifest, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


# --- token counts ---------------------------------------------------------------

def odd_texts(n):
    rnd = random.Random(3)
    bits = list(" \n\ta▁bé中\r ﬁ") + ["  ", "the ", "\n\n", "<s>", "</s>", "<unk>", "<0x0A>", " hello", "   ", "\x00"]
    return ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 20))) for _ in range(n)]


def test_counts_equal_the_library(texts):
    lines = [*odd_texts(3000), None, "", " ", "\n", "word " * 30_000, "x" * 100_000, "中" * 5000, "a\n" * 4000]
    docs = texts(list(enumerate(lines)))
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    found = {r["doc_id"]: r for r in token_counts.token_counts(docs, MODEL).collect()}
    assert len(found) == len(lines)
    for i, t in enumerate(lines):
        n = len(lib.encode(t or ""))
        assert tuple(found[i]) == (i, len((t or "").encode()), n, n > 4096), repr(t)[:80]


def test_counts_do_not_depend_on_the_table(texts, monkeypatch):
    docs = texts(list(enumerate(odd_texts(300))))
    whole = sorted(map(tuple, token_counts.token_counts(docs, MODEL, limit=3).collect()))
    monkeypatch.setattr(token_counts, "FREQUENT", 0)
    assert sorted(map(tuple, token_counts.token_counts(docs, MODEL, limit=3).collect())) == whole


def test_a_small_cache_forgets_and_stays_right(monkeypatch):
    monkeypatch.setattr(token_counts, "GENERATION", 5)
    counter = token_counts.TokenCounter(MODEL, token_counts.cut_facts(MODEL))
    words = [f"w{i % 17}x" for i in range(200)]
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for low in range(0, 200, 7):
        part = list(dict.fromkeys(words[low : low + 7]))
        assert counter.missing(part) == [len(lib.encode(w)) for w in part]
        assert len(counter.young) <= 5 + 7 and len(counter.old) <= 5 + 7


def test_counts_of_null_and_repeated_ids_and_of_nothing(texts):
    docs = texts([(None, "a b"), (None, "a b"), (4, "a b"), (4, None)])
    got = sorted(((r["doc_id"] or 0, r["n_tokens"]) for r in token_counts.token_counts(docs, MODEL).collect()))
    assert got == [(0, 2), (0, 2), (4, 0), (4, 2)]
    assert token_counts.token_counts(texts([(1, "a")]).limit(0), MODEL).collect() == []


# --- centroids ------------------------------------------------------------------

def lloyd(vectors, k, rounds, seed):
    """All pairs, in Python integers."""
    ok = []
    for i, v in vectors:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            ok.append((i, [math.floor(256 * x) for x in v]))
    key = lambda row: (H(f"{seed}:{'' if row[0] is None else row[0]}"), row[1])
    points = [x for _, x in sorted(ok, key=key)[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, p)), j) for j, p in enumerate(points))
    for _ in range(rounds):
        held = {}
        for _, x in ok:
            held.setdefault(near(x)[1], []).append(x)
        points = [[sum(col) // len(held[j]) for col in zip(*held[j])] if j in held else p for j, p in enumerate(points)]
    done = [(i, *reversed(near(x))) for i, x in ok]
    whole, out = sum(d for _, _, d in done), []
    for i, j, d in done:
        out.append((i, j, d, sum(e for _, m, e in done if m == j), whole, H(",".join(map(str, points[j])))))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def vectors():
    rnd = random.Random(8)
    rows = [(i, [rnd.gauss(0, 0.2) + (i % 3) for _ in range(64)]) for i in range(120)]
    rows += [(200 + i, rows[5][1]) for i in range(40)] + [(7, rows[9][1]), (None, rows[3][1]), (None, rows[4][1])]
    rows += [(300 + i, [float((i * j) % 2) for j in range(64)]) for i in range(20)]  # ties
    rows += [(400, None), (401, [1.0] * 63), (402, [None] + [0.0] * 63), (403, [math.nan] * 64), (404, [math.inf] + [0.0] * 63), (405, [0.0] * 64)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, cluster int, x int")


@pytest.mark.parametrize("k, rounds", [(40, 5), (3, 2), (1, 1), (500, 1)])
def test_clusters_equal_all_pairs(spark, vectors, k, rounds):
    df = frame(spark, vectors).repartition(5)
    plain = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = sorted((tuple(r) for r in centroids.clustered_vectors(df, k, rounds).collect()), key=str)
    assert got == lloyd(plain, k, rounds, 2)


def test_zero_favours_the_smaller_number():
    import numpy as np

    pairs = centroids.Bisectors([[0, 0], [2, 0], [0, 0], [2, 2]])
    assert pairs.nearest(np.array([[1, 0], [0, 0], [1, 1], [2, 1], [-5, 9]])).tolist() == [0, 0, 0, 1, 3]


def test_the_largest_components_stay_exact():
    import numpy as np

    big = centroids.LARGEST
    points = [[big] * 64, [-big] * 64, [big] * 63 + [big - 1]]
    x = np.array([[-big] * 64, [big] * 63 + [big - 1], [big] * 64], np.int64)
    pairs = centroids.Bisectors(points)
    assert pairs.nearest(x).tolist() == [1, 2, 0] and pairs.distance(x, np.array([0, 0, 1])).tolist() == [64 * (2 * big) ** 2, 1, 64 * (2 * big) ** 2]


def test_no_vectors_and_too_large_ones(spark, vectors):
    assert centroids.clustered_vectors(frame(spark, vectors).limit(0)).collect() == []
    assert centroids.clustered_vectors(frame(spark, [(1, None), (2, [1.0])])).collect() == []
    with pytest.raises(Exception, match="beyond"):
        centroids.clustered_vectors(frame(spark, [(1, [1e30] * 64)])).collect()


# --- manifest -------------------------------------------------------------------

def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves):
    """Root of a list of digests and the path of each place."""
    paths, places, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        for i, p in enumerate(places):
            run = nodes[p // 8 * 8 : p // 8 * 8 + 8]
            paths[i].append(("".join(run[: p % 8]), "".join(run[p % 8 + 1 :])))
            places[i] = p // 8
        nodes = [H(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
    return nodes[0], paths


def proofs(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) in plain Python."""
    per = {}
    for doc_id, text, lang, source, n in rows:
        leaf = lambda t: H(*map(field, (doc_id, source, lang, n, t)))
        lower = text
        if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0:
            lower = "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in text)
        per.setdefault(lang, []).append((doc_id is None, doc_id or 0, leaf(text), doc_id, leaf(lower)))
    langs = sorted(per, key=lambda g: (g is not None, (g or "").encode()))
    trees = [tree([r[2] for r in sorted(per[g])]) for g in langs]
    root, tops = tree([t[0] for t in trees])
    out = []
    for g, (subroot, paths), top in zip(langs, trees, tops):
        for (_, _, leaf, doc_id, seen), path in zip(sorted(per[g]), paths):
            whole, h = path + top, seen
            for before, after in whole:
                h = H(before, h, after)
            out.append((doc_id, leaf, subroot, root, H(*[a + b for a, b in whole]), h, h == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [{"en": 70}, {"en": 1}, {None: 1, "": 9, "de": 8, "fr": 65, "é": 64, "z": 2}, {f"l{i:02d}": i % 4 + 1 for i in range(70)}])
def test_proofs_equal_plain_trees(spark, make, sizes):
    rows = []
    for lang, n in sizes.items():
        first = len(rows)
        rows += [(3 * (first + k), f"Text {k} é\nMore" if k % 5 else None, lang, None if k % 7 == 0 else "src", k) for k in range(n)]
    got = sorted((tuple(r) for r in manifest.tampered_proofs(make(rows).repartition(4)).collect()), key=str)
    assert got == proofs(rows)
    assert any(not r[-1] for r in got) == (len(rows) > 1)


def test_proofs_with_nulls_copies_and_clashing_names(spark):
    rows = [(None, "A", "en", "s", 1)] * 30 + [(5, "Same", "en", "s", 1)] * 100 + [(i, None, None, None, None) for i in range(9)]
    rows += [(5, "Other", "en", "s", 1), (None, "B", "en", None, None), (3, "x" * 100_000 + "Q", "en", "s", 2)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, g string, rank int, n int, leaf string, digest int, pos int, height int"
    docs = spark.createDataFrame([(*r, "a", 1, 2, "b", 3, 4, 5) for r in rows], kinds)
    got = sorted((tuple(r) for r in manifest.tampered_proofs(docs).collect()), key=str)
    assert got == proofs(rows)


def test_no_rows_have_no_root(make):
    assert manifest.tampered_proofs(make([(1, "a", "en", "s", 1)]).limit(0)).collect() == []


def test_single_requests_descend_and_unknown_ones_give_nothing(spark, make, tmp_path):
    rows = [(i, f"T{i}", "de" if i % 3 else "en", "s", 1) for i in range(100)]
    store = manifest.write_manifest(make(rows), str(tmp_path / "m"), manifest.row_digest([F.col("doc_id"), F.col("text")]), F.col("lang"), [F.col("doc_id")])
    asked = spark.createDataFrame([("=en", 0, "a"), ("=en", 33, "b"), ("=en", 34, "c"), ("=de", 65, "d"), ("=de", 65, "e"), ("=de", 4096, "f"), ("=fr", 0, "g")], "g string, rank long, tag string")
    got = {r["tag"]: r for r in manifest.prove(store, asked).withColumn("root", manifest.fold(F.col("digest"), F.col("path"))).collect()}
    assert set(got) == {"a", "b", "d", "e"}
    assert {r["root"] for r in got.values()} == {store.root}
    assert got["b"]["digest"] == H(field(99), field("T99"))


def test_every_record_hashes_to_its_digest(make, tmp_path):
    rows = [(i, "t", "en", "s", 1) for i in range(80)]
    store = manifest.write_manifest(make(rows), str(tmp_path / "m"), manifest.row_digest([F.col("doc_id")]), F.col("lang"), [F.col("doc_id")])
    for height, n in ((1, 10), (2, 2), (3, 1)):
        records = store.records("group", height)
        assert records.count() == n
        assert records.filter(F.sha2(F.array_join("children", ""), 256) != F.col("digest")).count() == 0
