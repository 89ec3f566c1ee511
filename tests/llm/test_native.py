"""Mixing, fingerprints, sharding and line templates."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabsmith.llm import merkle, mixing, sharding, templates

ODD = [(3, "one two three"), (1, None), (2, ""), (2, ""), (None, "four five"), (None, None), (5, "a b " * 5000), (4, " \t\n ")]


# --- mixing -----------------------------------------------------------------------------

def test_mix_comes_near_its_targets(texts):
    docs = texts([(i, "w " * (1 + i % 7)) for i in range(600)], source=lambda n: None if n % 10 == 9 else f"s{n % 4}")
    rows = mixing.plan(docs).collect()
    total = sum(r["size"] for r in rows)
    per = {}
    for r in rows:
        s = per.setdefault(r["source"], [0, 0, r["target"]])
        s[0] += r["size"]
        s[1] += r["size"] * len(r["positions"])
        assert len(r["positions"]) <= 2 and r["positions"] == sorted(r["positions"])
        assert all(0 <= p <= 1 for p in r["positions"])
    assert abs(sum(s[2] for s in per.values()) - 1.5 * total) < 1e-6
    for size, taken, target in per.values():
        assert abs(taken - target) <= 3.5 and target <= 2 * size
    # The excess of sources at their limit is shared by weight: the others have one common level.
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(per, key=lambda s: (s is None, s or "")))}
    levels = {round(per[s][2] / weight[s], 6) for s in per if per[s][2] < 2 * per[s][0] - 1e-9}
    assert len(levels) <= 1


def test_positions_follow_the_schedule(texts):
    docs = texts([(i, "w") for i in range(4000)], source=lambda n: "a" if n % 2 else "b")
    rising = (((0.0, 0.0), (1.0, 2.0)), ((0.0, 2.0), (1.0, 0.0)))
    rows = mixing.plan(docs, schedules=rising, budget=1.0).collect()
    early = {s: sum(p < 0.5 for r in rows if r["source"] == s for p in r["positions"]) / 2000 for s in "ab"}
    assert abs(early["a"] - 0.25) < 0.01 and abs(early["b"] - 0.75) < 0.01


def test_time_inverts_the_demand(spark):
    schedule = ((0.0, 1.0), (0.25, 3.0), (0.5, 0.0), (1.0, 4.0))

    def demand(t):
        out = 0.0
        for (a, u), (b, v) in zip(schedule, schedule[1:]):
            x = min(max(t, a), b)
            w = u + (v - u) * (x - a) / (b - a)
            out += (x - a) * (u + w) / 2
        return out / mixing.weight_of(schedule)

    shares = [i / 50 for i in range(51)]
    got = spark.createDataFrame([(s,) for s in shares], "s double").select("s", mixing.time_of(schedule, F.col("s")).alias("t")).collect()
    assert all(abs(demand(r["t"]) - r["s"]) < 1e-9 for r in got)


def test_mix_of_odd_rows(texts):
    docs = texts(ODD)
    rows = mixing.plan(docs).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in ODD)
    assert all(not r["positions"] for r in rows if r["size"] == 0)
    out = mixing.arrange(docs)
    assert out.columns == docs.columns and out.count() == sum(len(r["positions"]) for r in rows)
    again = mixing.plan(docs.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    assert mixing.plan(texts([])).count() == 0 and mixing.arrange(texts([])).count() == 0
    with pytest.raises(ValueError):
        mixing.plan(docs, schedules=(((0.0, -1.0), (1.0, 2.0)),))


def test_arranged_rows_are_in_order_of_position(texts):
    docs = texts([(i, f"w{i} x") for i in range(50)])
    places = {r["doc_id"]: r["positions"] for r in mixing.plan(docs).collect()}
    got = [r["doc_id"] for r in mixing.arrange(docs).collect()]
    want = sorted((p, i) for i, ps in places.items() for p in ps)
    assert sorted(got) == sorted(i for _, i in want)
    assert [round(p, 9) for p, _ in want] == [round(p, 9) for p in sorted(p for i in set(got) for p in places[i])]


# --- fingerprints --------------------------------------------------------------------------

def edited(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1] or ""
        t = t or ""
        cut = len(t) // 4
        yield i, t, t[: len(t) - cut] + nxt[:cut], nxt


def test_fingerprints_against_python(texts):
    pairs = [(i, f"Line {i}, first. Ünd more; text {i % 3}!\nsecond line, of {i % 5}\n\nend {'x' * (i % 4)}") for i in range(40)] + [(50, None), (51, ""), (None, "tail, of. all")]
    got = {r["doc_id"]: r for r in merkle.fingerprints(texts(pairs), per_range=7).collect()}
    roots = {}
    for i, t, e, nxt in edited(pairs):
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        roots.setdefault(t, set()).add(r["fingerprint"])
        roots.setdefault(e, set()).add(r["edited_fingerprint"])
        assert (r["near_edited"] == 1.0) >= (t == e) and (r["near_next"] == 1.0) >= (t == nxt)
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(v) == 1 for v in roots.values()) and len({x for v in roots.values() for x in v}) == len(roots)


def test_fingerprints_of_odd_rows(texts):
    got = merkle.fingerprints(texts(ODD)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in ODD)
    assert merkle.fingerprints(texts([])).count() == 0
    one = merkle.fingerprints(texts([(1, "abcdefgh")])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()
    nulls = merkle.fingerprints(texts([(None, "abcd"), (None, "efgh")])).collect()
    assert len(nulls) == 2


def test_edits_are_located(spark):
    a = "\n".join(f"paragraph {i}" for i in range(200))
    b = a.replace("paragraph 17\n", "another line\n").replace("paragraph 150\n", "")
    rows = spark.createDataFrame([(1, a, b), (2, a, a), (3, None, "x")], "id int, a string, b string")
    got = {(r["id"], r["paragraph"]) for r in merkle.locate_edits(rows, "id", "a", "b").collect()}
    assert got == {(1, 17), (1, 150), (3, 0)}


# --- sharding ---------------------------------------------------------------------------------

def test_shards_are_even_and_keep_copies_together(texts):
    docs = texts([(i, f"text of group {i // 3} " * (1 + i // 3 % 9)) for i in range(1500)])
    rows = sharding.shard(docs).collect()
    weight, slots, where = Counter(), {}, {}
    for r in rows:
        weight[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        where.setdefault(r["doc_id"] // 3, set()).add(r["shard"])
    assert len(weight) == 8 and max(weight.values()) < 1.05 * min(weight.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sum(len(s) > 1 for s in where.values()) < 0.05 * len(where)


def test_propagation_brings_neighbours_together(spark):
    rows = [(r, f"g{r // 4}", 10, r % 2, f"{r // 4:04x}") for r in range(400)]
    nodes = spark.createDataFrame(rows, "row long, group string, size long, shard int, key string")
    cut = lambda df: df.groupBy("group").agg(F.countDistinct("shard").alias("n")).filter("n > 1").count()
    assert cut(nodes) == 100
    done = nodes
    for _ in range(3):
        step = sharding._round(done, 2, 1.05, 400)
        done = step if step is not None else done
    assert cut(done) < 10
    sizes = sharding._sizes(done, 2)
    assert done.count() == 400 and max(sizes) <= 1.1 * min(sizes)


def test_a_group_larger_than_a_shard_is_split(texts):
    docs = texts([(i, "the same text" if i % 3 == 0 else f"other text {i:04d}") for i in range(900)])
    weight = Counter()
    for r in sharding.shard(docs).collect():
        weight[r["shard"]] += r["size"]
    assert max(weight.values()) < 1.1 * min(weight.values())


def test_shards_of_odd_rows(texts):
    rows = sharding.shard(texts(ODD)).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in ODD)
    assert all(0 <= r["shard"] < 8 and r["grown_shard"] is None and r["law"] == "bytes" for r in rows)
    assert {r["size"] for r in rows if r["doc_id"] == 1} == {1}
    assert sharding.shard(texts([])).count() == 0


# --- line templates -----------------------------------------------------------------------------

def kept(docs, **options):
    return {r["doc_id"]: r["text"] for r in templates.drop_lines(docs, **options).collect()}


def test_recurring_lines_stay_in_the_first_text_only(texts):
    shared = "this line stands in many of the texts"
    got = kept(texts([(i, f"{chr(97 + i) * 9} are its own words here\n{shared}\nend {chr(97 + i) * 7}") for i in range(5)]))
    assert shared in got[0] and all(shared not in got[i] for i in range(1, 5))
    assert got[3] == f"{'d' * 9} are its own words here\nend {'d' * 7}"


def test_variable_fields_share_a_template(texts):
    line = "the server {} answered the call of user {} in {} ms"
    pairs = [(i, f"alpha {'abcdefgh'[i] * 9}\n" + line.format(i, "abcdefgh"[i] * 3, i * 7)) for i in range(8)]
    got = kept(texts(pairs))
    assert all("answered" not in got[i] for i in range(1, 8)) and "answered" in got[0]


def test_every_template_of_a_leaf_is_found(texts):
    lines = [
        "2024-01-01 10:00:0{} INFO user {} logged in from the office",
        "2024-01-01 10:00:0{} INFO disk {} is nearly full on node",
        "2024-01-01 10:00:0{} INFO backup of {} took longer than usual",
        "2024-01-01 10:00:0{} INFO cache for {} was emptied by hand",
        "2024-01-01 10:00:0{} INFO job named {} ended without any error",
    ]
    got = kept(texts([(i, "\n".join([f"{x * 9} alone", *[t.format(i, x * 4) for t in lines]])) for i, x in enumerate("abcd")]))
    assert all(got[i].count("INFO") == (0 if i else 5) for i in range(4))


def one_after_another(lines, likeness=0.75):
    """{line: seed} of one leaf, by one seed after another; `lines` has the number of texts of each."""
    left, out = sorted(lines, key=lambda x: (lines[x], x), reverse=True), {}
    while left:
        seed = left[0].split(" ")
        near = [x for x in left if sum(a == b for a, b in zip(seed, x.split(" "))) / len(seed) >= likeness]
        out |= dict.fromkeys(near, left[0])
        left = [x for x in left if x not in out]
    return out


def test_templates_against_plain_python(spark):
    rng = random.Random(7)
    leaves = {}
    for leaf, (tokens, some) in enumerate([(5, 4), (7, 3), (10, 3), (12, 2), (16, 3), (17, 2), (30, 2), (4, 5), (3, 1), (9, 40)]):
        lines = leaves[leaf] = {}
        for _ in range(80):
            line = " ".join(["x", "y", "z", *[rng.choice("abcdefghij"[:some]) if some < 40 else str(rng.random()) for _ in range(tokens - 3)]])
            lines[line] = rng.randint(1, 3)
    rows = [(leaf, k, n, x, len(x.split(" "))) for leaf, lines in leaves.items() for k, (x, n) in enumerate(lines.items())]
    kinds = spark.createDataFrame(rows, "leaf long, kind long, texts long, line string, tokens int")
    name = {(r[0], r[1]): r[3] for r in rows}
    got = {(r["leaf"], name[r["leaf"], r["kind"]]): name[r["leaf"], r["template"]] for r in templates._named(kinds, 3, 0.75).collect()}
    assert got == {(leaf, x): seed for leaf, lines in leaves.items() for x, seed in one_after_another(lines).items()}


def test_copies_are_one_text_and_short_lines_need_many(texts):
    copy = "a whole text of its own with many words\nand a second line of the same text"
    got = kept(texts([(1, copy), (2, copy), (3, "so it is\nunlike anything else in here, this text"), (4, "so it is\nsomething quite apart from all of the rest")]))
    assert got[1] == got[2] == copy and got[3].startswith("so it is") and got[4].startswith("so it is")
    many = kept(texts([(i, f"so it is\n{'abcdefghijklmnop'[i] * 8} alone") for i in range(12)]))
    assert sum(t.startswith("so it is") for t in many.values()) == 1


def test_long_lines_without_blanks_count_as_lines(texts):
    chinese, tabs = "这是一行没有空格的很长的文字" * 4, "\t".join(f"field{x}" for x in "abcdefgh")
    own = lambda i: f"{'abcdefghijklmnop'[i] * 9} has words of its own"
    got = kept(texts([(i, f"{own(i)}\n{chinese}\n{tabs}\nLes.") for i in range(3)]))
    assert chinese in got[0] and tabs in got[0]
    assert got[1] == f"{own(1)}\nLes." and got[2] == f"{own(2)}\nLes."
    many = kept(texts([(i, f"{own(i)}\nLes.") for i in range(11)]))
    assert sum(t.endswith("Les.") for t in many.values()) == 1


def test_the_sql_of_whole_documents_agrees(spark, texts):
    """Five templates in a leaf, short lines, long lines without blanks, copies."""
    import duckdb

    from tabsmith.llm.queries import TEMPLATE_SQL

    rng = random.Random(12)
    words = ["user", "disk", "cache", "node", "job", "of", "was", "is", "in", "the"]
    pairs = []
    for i in range(60):
        lines = [f"2024-01-0{i % 9} INFO {rng.choice('ab')} " + " ".join(rng.choice(words) for _ in range(rng.choice([2, 5, 9]))) for _ in range(6)]
        lines += rng.choices(["Les.", "so it is", "这是一行没有空格的很长的文字" * 4, "", "  12 34  ", "x" * 50], k=3)
        pairs.append((i, "\n".join(lines)))
    pairs += [(100 + i, pairs[i][1]) for i in range(4)]
    docs = texts(pairs)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas())
    want = sorted(con.execute(TEMPLATE_SQL).fetchall())
    rows = templates.drop_lines(docs.select("doc_id", "text"), counts=("n_lines", "n_dropped"))
    got = sorted(tuple(r) for r in rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect())
    assert got == want and sum(r[2] for r in got) > 50


def test_line_rows_of_odd_documents(texts, make):
    docs = texts([*ODD, (8, "a line that is repeated\n" * 3000), (9, "a line that is repeated\nb")])
    out = templates.drop_lines(docs, counts=("n_lines", "n_dropped"))
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    rows = {(r["doc_id"], r["text"]): r for r in out.collect()}
    assert rows[1, None]["n_lines"] == 0 and rows[2, ""]["n_lines"] == 1
    assert rows[9, "b"]["n_dropped"] == 1 and sum(r["n_dropped"] for r in rows.values()) == 1
    assert templates.drop_lines(texts([])).count() == 0
    with pytest.raises(ValueError):
        templates.drop_lines(docs, counts=("text", "n"))
