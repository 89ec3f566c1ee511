"""The paths taken on large data, forced on small data, against plain results."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import tabsmith.operators.neighbours as nb
import tabsmith.operators.ordered as od
from tabsmith.operators.features import label_encode
from tabsmith.operators.impute import bfill, ffill, impute_rolling, interpolate_linear
from tabsmith.operators.quantiles import exact_quantiles
from tabsmith.operators.scores import auc

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]


@pytest.mark.parametrize("kind", ["normal", "ties", "hot", "skewed"])
def test_bracketed_quantiles(spark, kind):
    rng = np.random.default_rng(7)
    values = {
        "normal": rng.normal(size=20_000),
        "ties": rng.integers(0, 50, 20_000).astype(float),
        "hot": np.where(rng.random(20_000) < 0.4, 3.0, rng.normal(size=20_000)),
        "skewed": np.exp(rng.normal(size=20_000) * 5),
    }[kind]
    df = spark.createDataFrame(pd.DataFrame({"v": values, "w": -values}))
    got = exact_quantiles(df, ["v", "w"], PROBS, limit=300, accuracy=200)
    np.testing.assert_allclose(got["v"], np.quantile(values, PROBS), rtol=1e-12)
    np.testing.assert_allclose(got["w"], np.quantile(-values, PROBS), rtol=1e-12)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "a double, b double")
    assert exact_quantiles(df, ["a", "b"], [0.5]) == {"a": [None], "b": [1.5]}


def hot_panel(rows=3000, seed=3):
    """Three series; one holds most rows, and a third of the values are missing."""
    rng = np.random.default_rng(seed)
    series = np.where(rng.random(rows) < 0.7, "hot", np.where(rng.random(rows) < 0.5, "b", "c"))
    ts = rng.permutation(rows * 3)[:rows]
    value = np.where(rng.random(rows) < 0.33, np.nan, rng.normal(size=rows))
    pdf = pd.DataFrame({"series": series, "ts": ts, "value": value}).sort_values(["series", "ts"]).reset_index(drop=True)
    return pdf


def panel_frame(spark, pdf):
    rows = [(s, int(t), None if v != v else float(v)) for s, t, v in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, "series string, ts bigint, value double").repartition(5)


FILLS = {
    "ffill": (lambda d, c: ffill(d, ["value"], "ts", ["series"], chunk_rows=c), lambda s: s.ffill().fillna(0)),
    "bfill": (lambda d, c: bfill(d, ["value"], "ts", ["series"], chunk_rows=c), lambda s: s.bfill().fillna(0)),
    "limit": (lambda d, c: ffill(d, ["value"], "ts", ["series"], limit=2, chunk_rows=c), lambda s: s.ffill(limit=2).fillna(0)),
    "linear": (
        lambda d, c: interpolate_linear(d, ["value"], "ts", ["series"], chunk_rows=c),
        lambda s: s.interpolate(limit_direction="both").fillna(0),
    ),
    "rolling": (
        lambda d, c: impute_rolling(d, ["value"], "ts", ["series"], 4, chunk_rows=c),
        lambda s: s.fillna(s.rolling(4, min_periods=1).mean()).fillna(0),
    ),
}


@pytest.mark.parametrize("name", sorted(FILLS))
@pytest.mark.parametrize("chunk", [None, 200])
def test_series_fills(spark, name, chunk):
    run, plain = FILLS[name]
    pdf = hot_panel()
    got = run(panel_frame(spark, pdf), chunk).toPandas().sort_values(["series", "ts"])
    want = pdf.groupby("series")["value"].transform(plain)
    np.testing.assert_allclose(got["value"].to_numpy(), want.to_numpy(), rtol=1e-9, atol=1e-12)


def test_chunked_windows_hold_no_hot_series(spark):
    pdf = hot_panel()
    df, several = od.with_chunks(panel_frame(spark, pdf), "ts", 300)
    assert several
    assert df.groupBy("series", od.CHUNK).count().agg(F.max("count")).first()[0] <= 300


def test_positions_and_totals(spark):
    pdf = hot_panel()
    df = panel_frame(spark, pdf).fillna({"value": 0.0})
    got = od.with_position(df, ["series"], "ts", 250).toPandas().sort_values(["series", "ts"])
    assert (got[od.POS].to_numpy() == pdf.groupby("series").cumcount().to_numpy()).all()
    total = od.running_total(df, ["series"], "ts", "value", "total", 250).toPandas().sort_values(["series", "ts"])
    np.testing.assert_allclose(total["total"], pdf.fillna(0).groupby("series")["value"].cumsum(), atol=1e-9)


def test_null_series_key(spark):
    df = spark.createDataFrame([(None, i, float(i)) for i in range(50)] + [("a", i, 1.0) for i in range(50)], "s string, t int, v double")
    got = od.with_position(df, ["s"], "t", 20)
    assert got.filter(f"{od.POS} != t").count() == 0 and got.count() == 100


def test_label_codes_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(od, "CHUNK_ROWS", 20)
    words = [f"w{i:03d}" for i in range(200)] + ["w007"] * 100 + [None] * 5
    df = spark.createDataFrame([(w,) for w in words], "w string").repartition(4)
    got = label_encode(df.withColumn("c", F.col("w")), ["c"]).collect()
    order = {v: i for i, v in enumerate(sorted({w or "missing" for w in words}))}
    assert all(r["c"] == order[r["w"] or "missing"] for r in got) and len(got) == len(words)


def test_auc_with_hot_score(spark):
    rng = np.random.default_rng(1)
    score = np.where(rng.random(2000) < 0.4, 0.5, rng.random(2000))
    label = (rng.random(2000) < 0.3 + 0.4 * score).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"y": label, "s": score}))
    pos, neg = score[label == 1], score[label == 0]
    want = (pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean()
    for chunk in (None, 50):
        assert abs(auc(df, F.col("y") == 1, "s", chunk_rows=chunk).first()["AUC"] - want) < 1e-9


def knn_plain(data, k):
    """Nan-Euclidean neighbours by comparing all pairs."""
    out = data.copy()
    d = data.shape[1]
    for i, row in enumerate(data):
        for j in np.where(np.isnan(row))[0]:
            pool = []
            for other in data:
                both = ~np.isnan(row) & ~np.isnan(other)
                if np.isnan(other[j]) or not both.any():
                    continue
                dist = np.sqrt(np.sum((row[both] - other[both]) ** 2) * d / both.sum())
                pool.append((round(dist, 9), tuple(np.where(np.isnan(other), -np.inf, other)), other[j]))
            pool.sort()
            out[i, j] = np.mean([p[2] for p in pool[:k]]) if pool else np.nanmean(data[:, j])
    return out


@pytest.mark.parametrize("cell_rows,block", [(5, 4096), (40, 16), (1000, 4096)])
def test_neighbours_equal_all_pairs(spark, monkeypatch, cell_rows, block):
    monkeypatch.setattr(nb, "DONOR_BLOCK", block)
    monkeypatch.setattr(nb, "RECEIVER_BLOCK", block)
    rng = np.random.default_rng(11)
    data = np.round(rng.normal(size=(180, 3)) * [1, 5, 20], 3)
    data[rng.random(data.shape) < 0.15] = np.nan
    data[:40] = data[0]  # a group of copies
    data[50] = np.nan
    frame = pd.DataFrame(data, columns=["a b", "c", "d"])
    records = [tuple(None if v != v else float(v) for v in r) for r in data]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(records)], "id int, `a b` double, c double, d double")
    got = nb.impute_knn(df, list(frame.columns), 5, cell_rows=cell_rows).orderBy("id").toPandas()
    np.testing.assert_allclose(got[list(frame.columns)].to_numpy(), knn_plain(data, 5), rtol=1e-9)


@pytest.mark.parametrize("d", [2, 60, 300])
@pytest.mark.parametrize("gaps", [False, True])
def test_nearest_of_any_width(spark, d, gaps):
    """Grid values make ties; the search must take the same donors as all pairs do."""
    rng = np.random.default_rng(d)
    n, m, k = 300, 60, 4
    pool = rng.integers(0, 4, (n, d)).astype(float)
    pool[:, d // 2 :] *= rng.random((n, d - d // 2)) < 0.2  # mostly zero, as one-hot slots are
    pool[:20] = pool[0]
    asked = pool[rng.integers(0, n, m)] + (rng.random((m, d)) < 0.1)
    if gaps:
        pool[rng.random(pool.shape) < 0.2] = np.nan
        asked[rng.random(asked.shape) < 0.2] = np.nan
    value = rng.normal(size=n)
    value[5:20] = value[4]
    plain = lambda r: [None if v != v else float(v) for v in r]
    donors = spark.createDataFrame([(plain(r), [[float(v)], [1.0, 0.0] if i % 2 else None]) for i, (r, v) in enumerate(zip(pool, value))], "x array<double>, choices array<array<double>>")
    receivers = spark.createDataFrame([(plain(r), [0, 1] if i % 3 else [0]) for i, r in enumerate(asked)], "x array<double>, wanted array<int>")
    want = {}
    for i, r in enumerate(asked):
        both = ~np.isnan(pool) & ~np.isnan(r)
        square = np.cumsum(np.where(both, np.nan_to_num(pool) - np.nan_to_num(r), 0.0) ** 2, axis=1)[:, -1]
        dist = np.sqrt(square * d / np.maximum(both.sum(axis=1), 1))
        for g in [0, 1] if i % 3 else [0]:
            able = [j for j in range(n) if both[j].any() and (g == 0 or j % 2)]
            best = sorted(able, key=lambda j: (dist[j], tuple(np.where(np.isnan(pool[j]), -np.inf, pool[j])), value[j] if g == 0 else 0))[:k]
            want[tuple(plain(r)), g] = np.mean([value[j] for j in best]) if g == 0 else float(len(best) > 0)
    for cell_rows in (20, 1000):
        got = {(tuple(r["x"]), r["g"]): r["means"] for r in nb.nearest_means(receivers, donors, k, cell_rows).collect()}
        assert set(got) == {key for key in want if any(v is not None for v in key[0])}
        for key, means in got.items():
            assert abs(means[0] - want[key]) < 1e-12


def test_a_receiver_looks_into_a_cell_once_and_into_few(spark, monkeypatch):
    rng = np.random.default_rng(7)
    n, m = 900, 300
    where = rng.permutation(n + m).astype(float)
    plain = lambda p: [float(p), float(int(p) % 5), float(int(p) % 3 == 0)]
    donors = spark.createDataFrame([(plain(p), [[p]]) for p in where[:n].tolist()], "x array<double>, choices array<array<double>>")
    receivers = spark.createDataFrame([(plain(p), [0]) for p in where[n:].tolist()], "x array<double>, wanted array<int>")
    visits, search = [], nb._search
    monkeypatch.setattr(nb, "_search", lambda v, *rest: visits.extend((r["id"], r["cell"]) for r in v.collect()) or search(v, *rest))
    got = {tuple(r["x"]): r["means"][0] for r in nb.nearest_means(receivers, donors, 3, 20).collect()}
    assert len(visits) == len(set(visits)) and len(visits) < 3 * m
    pool = np.array([plain(p) for p in where[:n]])
    for p in where[n:]:
        dist = np.sqrt(((pool - plain(p)) ** 2).sum(axis=1))
        best = sorted(range(n), key=lambda j: (dist[j], tuple(pool[j])))[:3]
        assert abs(got[tuple(plain(p))] - np.mean(where[best])) < 1e-9


@pytest.mark.parametrize("gaps", [False, True])
@pytest.mark.parametrize("bound", [np.inf, 9.0])
def test_leaves_and_boxes_take_what_all_pairs_take(gaps, bound):
    rng = np.random.default_rng(5)
    y = np.column_stack([rng.permutation(1500) + 5e6, rng.integers(0, 50, 1500), rng.integers(0, 2, (1500, 6))]).astype(float)
    x = np.column_stack([rng.permutation(1500)[:400] + 5e6, rng.integers(0, 50, 400), rng.integers(0, 2, (400, 6))]).astype(float)
    y[:300] = y[0]
    if gaps:
        x[rng.random(x.shape) < 0.1], y[rng.random(y.shape) < 0.1] = np.nan, np.nan
        x[0] = np.nan
    weight, rank, far = rng.integers(1, 3, 1500), rng.permutation(1500), np.where(np.arange(400) % 2, bound, np.inf)
    for one, other in zip(nb._nearest_leaves(x, y, weight, rank, 5, far), nb._nearest(x, y, weight, rank, 5, far)):
        assert one.tolist() == other.tolist()
    tree = nb.BoxTree(y, 100)
    boxes = nb.Boxes.of(tree.place(y), y, tree.cells)
    up, count = boxes.above(tree), []
    pairs = up.pairs
    up.pairs = lambda a, b: count.append(len(a)) or pairs(a, b)
    near = {(i, c) for rows, cells in nb._within(x, np.full(400, 9.0), tree, up) for i, c in zip(rows.tolist(), cells.tolist())}
    assert near == set(zip(*(a.tolist() for a in np.nonzero(boxes.least(x) <= 81.0 * nb.SLACK))))
    assert gaps or sum(count) < 400 * tree.cells / 2


def test_equal_receivers_with_other_groups(spark):
    donors = spark.createDataFrame([([float(i)], [[float(i)], [2.0 * i]]) for i in range(40)], "x array<double>, choices array<array<double>>")
    receivers = spark.createDataFrame([([7.2], [0]), ([7.2], [0, 1])], "x array<double>, wanted array<int>")
    got = sorted((r["g"], r["means"][0]) for r in nb.nearest_means(receivers, donors, 2, 10).collect())
    assert got == [(0, 7.5), (1, 15.0)]


def test_no_donors_and_hopeless_rows(spark):
    rows = spark.createDataFrame([([1.0, None], [0]), ([None, None], [0]), ([2.0, 1.0], [])], "x array<double>, wanted array<int>")
    none = spark.createDataFrame([], "x array<double>, choices array<array<double>>")
    assert nb.nearest_means(rows, none, 3).collect() == []
    apart = spark.createDataFrame([([None, 5.0], [[1.0]])], "x array<double>, choices array<array<double>>")
    assert nb.nearest_means(rows, apart, 3).collect() == []


def test_impute_a_wide_table(spark):
    rng = np.random.default_rng(2)
    data = np.round(rng.normal(size=(60, 130)), 2)
    data[rng.random(data.shape) < 0.02] = np.nan
    names = [f"c{i}" for i in range(130)]
    df = spark.createDataFrame([(i, *[None if v != v else float(v) for v in r]) for i, r in enumerate(data)], "id int, " + ", ".join(f"{c} double" for c in names))
    got = nb.impute_knn(df, names, 5).orderBy("id").toPandas()
    np.testing.assert_allclose(got[names].to_numpy(), knn_plain(data, 5), rtol=1e-9)


def test_quantiles_have_the_same_bits_at_any_limit(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(float(v),) for v in rng.normal(size=3001)], "v double")
    probs = [i / 37 for i in range(1, 37)]
    assert exact_quantiles(df, ["v"], probs, limit=100) == exact_quantiles(df, ["v"], probs)


@pytest.mark.parametrize("chunk_rows", [None, 10])
def test_rows_without_an_order_key_come_first(spark, chunk_rows):
    from tabsmith.operators.ordered import POS, with_position

    rows = [(None, "x"), (None, "y"), *[(i, str(i)) for i in range(40)]]
    got = with_position(spark.createDataFrame(rows, "ts int, v string"), [], "ts", chunk_rows).collect()
    assert sorted(r[POS] for r in got if r["ts"] is None) == [0, 1]
    assert {r["ts"]: r[POS] for r in got if r["ts"] is not None} == {i: i + 2 for i in range(40)}
    plain = with_position(spark.createDataFrame(rows, "ts int, v string"), [], "ts").collect()
    assert {r["v"]: r[POS] for r in got} == {r["v"]: r[POS] for r in plain}
