"""Components, near vectors and the n-gram join against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from tabsmith.llm import ngram_join
from tabsmith.llm.components import components
from tabsmith.llm.embeddings import near_vectors, table_plan


def roots(edges, nodes):
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 90)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(110)]
    df = spark.createDataFrame([*edges, (5, 5), (None, 3), *edges[:9]], "u long, v long")
    got = {r["node"]: r["root"] for r in components(df).collect()}
    real = [e for e in edges if e[0] != e[1]]
    assert got == roots(real, {n for e in real for n in e})
    assert components(df.limit(0)).count() == 0


def stages_run(spark, run):
    """How many stages the jobs of a call had that were not skipped."""
    context, group = spark.sparkContext, f"stages-{random.random()}"
    context.setJobGroup(group, "counted")
    try:
        run()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    infos = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in set(tracker.getJobInfo(j).stageIds)]
    return sum(i is not None and i.numCompletedTasks > 0 for i in infos)


def test_components_take_few_stages(spark):
    """A round over many partitions costs its stages; the last round only confirmed the one before."""
    edges = [(100 * s, 100 * s + i) for s in range(20) for i in range(1, 50)] + [(100 * s + 7, 100 * s + 109) for s in range(0, 20, 2)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {}
    count = stages_run(spark, lambda: got.update({r["node"]: r["root"] for r in components(df).collect()}))
    assert got == roots(edges, {n for e in edges for n in e})
    assert count <= 26, count


def test_ngram_join_takes_few_stages(spark, texts):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    body = [t for _ in range(6) for t in family(rng, words, 10, 3)]
    docs = texts(list(enumerate(body)))
    got = []
    count = stages_run(spark, lambda: got.extend(ngram_join.ngram_components(docs).collect()))
    assert sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got], key=str) == brute_join(list(enumerate(body)))
    assert count <= 110, count


def brute_vectors(rows):
    usable = [(k, i, x, y) for k, (i, x, y) in enumerate(rows) if x and y is not None and None not in x and np.isfinite(x).all() and np.any(x)]
    links = {k: set() for k in range(len(rows))}
    for a, _, x, p in usable:
        for b, _, y, q in usable:
            if a < b and p == q and len(x) == len(y):
                u, v = np.array(x, float), np.array(y, float)
                if u @ v / np.sqrt((u @ u) * (v @ v)) >= 0.98:
                    links[a].add(b)
                    links[b].add(a)
    of = roots([(a, b) for a in links for b in links[a]], list(links))
    out = []
    for k, (i, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in links if of[j] == of[k] and rows[j][0] is not None]
        out.append((i, len(links[k]), min(ids) if ids else None))
    return sorted(out, key=str)


def test_tables_follow_the_bits():
    plans = [table_plan(n, 0.98) for n in (0, 1024, 1025, 5000, 10**7, 10**12)]
    assert plans[:2] == [(25, 16)] * 2 and [b for _, b in plans] == [16, 16, 17, 19, 30, 30]
    meet = 1 - np.arccos(0.98) / np.pi
    assert all((1 - meet**bits) ** tables <= 1 / 30_000 for tables, bits in plans) and table_plan(5, 1.0) == (1, 16)


def test_near_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(240):
        base = rng.normal(size=16) if i % 4 == 0 else base + rng.normal(size=16) * 0.03
        rows.append((i, [float(np.float32(v)) for v in base], int(i % 40 // 20)))
    rows += [(300, rows[0][1], 0), (300, rows[0][1], 0), (301, [0.0] * 16, 0), (302, None, 0), (303, [1.0, None], 0), (304, [float("nan")] * 16, 0)]
    rows += [(305, rows[0][1], None), (306, [float("inf")] * 16, 1), (307, [], 1), (308, [1.0, 2.0], 1), (309, [2.0, 4.0], 1), (None, rows[40][1], rows[40][2])]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "vec_id long, embedding array<float>, label int, node string, n int")
    for block in (1024, 16):
        got = near_vectors(df, block=block).collect()
        assert sorted([(r["vec_id"], r["n_links"], r["component_id"]) for r in got], key=str) == brute_vectors(rows)
        assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got)
    assert near_vectors(df.limit(0)).count() == 0


def shingles(text):
    words = "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in text or "").replace("\n", " ").replace("\t", " ").split(" ")
    words = [w for w in words if w]
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_join(pairs):
    sets = [shingles(t) for _, t in pairs]
    edges = []
    for a in range(len(pairs)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                edges.append((b, a))
    of = roots(edges, range(len(pairs)))
    out = []
    for k, (i, _) in enumerate(pairs):
        ids = [pairs[j][0] for j in range(len(pairs)) if of[j] == of[k] and pairs[j][0] is not None]
        out.append((i, len(sets[k]), i if not sets[k] else min(ids) if ids else None))
    return sorted(out, key=str)


def family(rng, words, copies, changes):
    base = [rng.choice(words) for _ in range(60)]
    for _ in range(copies):
        t = list(base)
        for _ in range(rng.randint(0, changes)):
            t[rng.randrange(len(t))] = rng.choice(words)
        yield " ".join(t)


@pytest.mark.parametrize("changes", [2, 5])
def test_ngram_join_against_brute_force(texts, changes):
    rng = random.Random(changes)
    words = [f"w{i}" for i in range(400)]
    body = [t for _ in range(8) for t in family(rng, words, 14, changes)]
    passage = " ".join(rng.choice(words) for _ in range(30))
    body += [f"{passage} {t}" for t in body[::9]] + [" ".join(rng.choice(words) for _ in range(50)) for _ in range(30)]
    pairs = list(enumerate(body)) + [(500, None), (501, ""), (502, ""), (503, "One two"), (504, "one\ttwo"), (505, "one  two three four FIVE"), (506, "one two three four five")]
    pairs += [(507, body[0]), (507, body[0]), (None, body[20]), (508, " \n ")]
    docs = texts(pairs)
    got = ngram_join.ngram_components(docs).collect()
    assert sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got], key=str) == brute_join(pairs)
    alone = ngram_join.ngram_components(docs, rounds=1).collect()
    assert sorted(map(str, alone)) == sorted(map(str, got))


def test_one_document_of_each_group_stays(texts):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    body = list(family(rng, words, 10, 2)) + [" ".join(rng.choice(words) for _ in range(50)) for _ in range(5)]
    docs = texts([*enumerate(body), (0, body[0]), (20, None), (21, "")])
    out = ngram_join.keep_one(docs)
    got = sorted(r["doc_id"] for r in out.collect())
    groups = {r[2] for r in brute_join(list(enumerate(body)))}
    assert out.columns == docs.columns and got == sorted([*groups, 20, 21])
    assert ngram_join.keep_one(texts([])).count() == 0


def test_groups_that_share_an_id_or_have_none_keep_one_each(texts):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    a, b, d, e, f = (" ".join(rng.choice(words) for _ in range(50)) for _ in range(5))
    near = e + " more"
    pairs = [(None, a), (None, b), (None, a), (7, d), (7, e), (None, near), (9, f), (None, f)]
    got = Counter((r["doc_id"], r["text"]) for r in ngram_join.keep_one(texts(pairs)).collect())
    assert got == Counter([(None, a), (None, b), (7, d), (7, e), (9, f)])


def test_filters_never_lose_a_pair():
    rng = np.random.default_rng(5)
    for _ in range(300):
        a = np.unique(rng.integers(0, 90, 60)).astype(np.uint64)
        b = np.unique(np.r_[a[rng.random(len(a)) < 0.9], rng.integers(0, 90, 8).astype(np.uint64)])
        common = len(np.intersect1d(a, b))
        true = 100 * common >= 75 * (len(a) + len(b) - common)
        assert ngram_join._similar(a, b, len(a), len(b), 75) == true
