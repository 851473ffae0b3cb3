"""Forests grown together against a recursive tree, with one task a tree and with many."""
import numpy as np
import pandas as pd
import pytest

from tabulon.operators import forest as FO


def data(n=400, d=4, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, (n, d)).astype(np.uint8)
    y = ((x[:, 0] > 5) ^ (x[:, 2] > 7) | (rng.random(n) < 0.1)).astype(np.uint8)
    return x, y


def recursive(x, y, w, depth=None, level=0, min_leaf=1, min_split=2):
    """Share of label 1 in each row's leaf of a greedy Gini tree over all features."""
    out = np.full(len(x), (w * y).sum() / w.sum())
    if len(set(y)) < 2 or w.sum() < min_split or level == depth:
        return out
    best, cut = -1.0, None
    for f in range(x.shape[1]):
        for v in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= v
            a, b = w[left].sum(), w[~left].sum()
            if a < min_leaf or b < min_leaf:
                continue
            ay, by = (w * y)[left].sum(), (w * y)[~left].sum()
            s = (ay**2 + (a - ay)**2) / a + (by**2 + (b - by)**2) / b
            if s > best + 1e-12:
                best, cut = s, (f, v)
    if cut is None:
        return out
    left = x[:, cut[0]] <= cut[1]
    for side in (left, ~left):
        out[side] = recursive(x[side], y[side], w[side], depth, level + 1, min_leaf, min_split)
    return out


def leaves(tree, x):
    return tree["value"][FO._walk((tree["feature"], tree["cut"], tree["child"]), x)]


@pytest.mark.parametrize("depth,min_leaf,min_split", [(None, 1, 2), (3, 1, 2), (None, 10, 2), (None, 1, 60)])
def test_subtree_against_recursion(monkeypatch, depth, min_leaf, min_split):
    x, y = data()
    w = np.random.default_rng(1).integers(1, 4, len(x)).astype(np.uint8)
    # features in their own order, so that ties fall alike
    monkeypatch.setattr(FO, "_order", lambda path, d: np.tile(np.arange(d), (len(path), 1)))
    spec = FO.ForestSpec(depth=depth, min_leaf=min_leaf, min_split=min_split, max_features=None)
    got = leaves(FO.grow_subtree(x, y, w, np.uint64(5), 0, spec), x)
    assert np.allclose(got, recursive(x, y, w.astype(float), depth, 0, min_leaf, min_split), atol=1e-6)


def test_random_thresholds_and_features_differ_by_tree_and_fit_the_rows():
    x, y = data()
    x, at = np.unique(x, axis=0, return_index=True)
    y, w = y[at], np.ones(len(x), np.uint8)
    trees = [FO.grow_subtree(x, y, w, FO._root(FO.ForestSpec(extra=True), t), 0, FO.ForestSpec(extra=True, bootstrap=False)) for t in range(4)]
    assert all(np.array_equal(leaves(t, x) > 0.5, y == 1) for t in trees)   # different rows: leaves are pure
    assert len({t["cut"].tobytes() for t in trees}) == 4


def test_bootstrap_weights():
    w = FO._weights(FO.ForestSpec(), 0, np.arange(200_000))
    assert abs(w.mean() - 1) < 0.01 and abs((w == 0).mean() - np.exp(-1)) < 0.01
    assert not np.array_equal(w, FO._weights(FO.ForestSpec(), 1, np.arange(200_000)))


@pytest.fixture(scope="module")
def rows(spark):
    x, y = data(1200)
    pdf = pd.DataFrame(x.astype(float), columns=[f"c{i}" for i in range(4)]).assign(y=y.astype(int), key=np.arange(len(x)), fold=np.arange(len(x)) % 3)
    df = spark.createDataFrame(pdf)
    edges = FO.feature_edges(df, [f"c{i}" for i in range(4)])
    return FO.binned_rows(df, [f"c{i}" for i in range(4)], edges, "y", "key", "fold")


SPECS = [FO.ForestSpec(trees=3, without_fold=0), FO.ForestSpec(trees=2, extra=True, bootstrap=False, depth=6),
         FO.ForestSpec(trees=2, max_features=None, min_leaf=3, without_fold=2)]


def test_same_forest_whatever_a_task_may_hold(spark, rows):
    """Whole trees in a task, and tops grown by shared passes with subtrees below, score every row alike."""
    x = np.stack([np.frombuffer(bytes(r["x"]), np.uint8) for r in rows.collect()])
    scores = []
    for local in (100_000, 150):
        trees = FO.grow_forests(rows, SPECS, 4, local).collect()
        assert sorted((t["fit"], t["tree"]) for t in trees) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (2, 0), (2, 1)]
        scores.append({(t["fit"], t["tree"]): (FO._decoded(t)[4][FO._walk(FO._decoded(t)[1:], x)], t["gain"]) for t in trees})
    for k in scores[0]:
        assert np.allclose(scores[0][k][0], scores[1][k][0], atol=1e-6)
        assert np.allclose(scores[0][k][1], scores[1][k][1])


def test_held_out_rows_and_importance(spark, rows, monkeypatch):
    trees = FO.grow_forests(rows, SPECS, 4)
    monkeypatch.setattr(FO, "MODEL_BYTES", max(len(t["feature"]) + len(t["cut"]) + len(t["child"]) + len(t["value"]) for t in trees.collect()))
    got = FO.held_out_sums(rows, trees.where("fit <> 1"), SPECS, 4).collect()
    assert {(r["fit"], r["key"] % 3) for r in got} == {(0, 0), (2, 2)} and len(got) == 800
    assert np.mean([(r["p"] > 0.5) == (r["y"] == 1) for r in got]) > 0.8
    imp = {(r["fit"], r["feature"]): r["importance"] for r in FO.importances(trees, list("abcd")).collect()}
    for fit in range(3):
        mine = [imp[fit, f] for f in "abcd"]
        assert sum(mine) == pytest.approx(1.0) and min(mine[0], mine[2]) > max(mine[1], mine[3])


def test_model_saved_and_loaded(spark, tmp_path):
    from pyspark.ml.feature import VectorAssembler
    x, y = data(300)
    pdf = pd.DataFrame(x.astype(float), columns=list("abcd")).assign(label=y.astype(float), row_key=np.arange(len(x)))
    df = VectorAssembler(inputCols=list("abcd"), outputCol="features").transform(spark.createDataFrame(pdf))
    model = FO.Forest(FO.ForestSpec(trees=4)).fit(df)
    model.write().save(str(tmp_path / "m"))
    again = FO.ForestModel.load(str(tmp_path / "m"))
    a, b = (sorted((r["row_key"], r["prediction"], tuple(r["probability"])) for r in m.transform(df).collect()) for m in (model, again))
    assert a == b and np.mean([p == y[k] for k, p, _ in a]) > 0.9
    assert sum(model.featureImportances.toArray()) == pytest.approx(1.0)


def test_recursive_elimination_drops_noise_first(spark):
    from tabulon.operators import select as SEL
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 5))
    pdf = pd.DataFrame(x, columns=list("abcde")).assign(y=((x[:, 1] > 0) ^ (x[:, 3] > 0.3)).astype(int), row_key=np.arange(500))
    df = spark.createDataFrame(pd.concat([pdf, pdf.head(20)]))   # some rows twice
    got = {r["feature"]: (r["score"], r["selected"]) for r in SEL.recursive_elimination(df, list("abcde"), "y", min_features=2, trees=8).collect()}
    assert got["b"] == got["d"] == (1.0, True)
    assert sorted(got[c][0] for c in "ace") in ([3.0, 4.0, 5.0], [1.0, 4.0, 5.0], [1.0, 1.0, 5.0], [1.0, 1.0, 1.0])
    forest = {r["feature"]: r["score"] for r in SEL.forest_importance(df, list("abcde"), "y", trees=8).collect()}
    assert min(forest["b"], forest["d"]) > max(forest[c] for c in "ace")


def test_forests_of_one_seed_draw_once_a_tree(monkeypatch):
    """folds and points of a search share the draws of a tree, and each sees the rows it is grown on."""
    rng = np.random.default_rng(4)
    keys, fold, y, cell = rng.integers(0, 1 << 40, 500), rng.integers(0, 3, 500), rng.integers(0, 2, 500), rng.integers(0, 40, 500)
    drawn, plain = [], FO._weights
    monkeypatch.setattr(FO, "_weights", lambda spec, tree, keys: drawn.append(tree) or plain(spec, tree, keys))
    draws = FO._Draws(keys, fold, y, cell, 40)
    specs = [FO.ForestSpec(trees=2, depth=d, without_fold=k, bootstrap=b) for b in (True, False) for d in (3, 9) for k in (0, 1, 2, None)]
    for tree in range(2):
        for spec in specs:
            w = plain(spec, tree, keys) * (1.0 if spec.without_fold is None else fold != spec.without_fold)
            got = draws.sums(spec, tree)
            np.testing.assert_array_equal(got[0], np.bincount(cell, w, 40))
            np.testing.assert_array_equal(got[1], np.bincount(cell, w * y, 40))
    assert len(drawn) == 2 + 1   # two bootstrapped trees, and the trees that have all rows


def test_draws_from_leading_bits_are_poisson():
    keys = np.arange(1_000_000)
    spec = FO.ForestSpec()
    plain = np.searchsorted(FO._POISSON, FO._unit(FO._mix(keys.astype(np.uint64) ^ FO._root(spec, 7))), side="right")
    np.testing.assert_array_equal(FO._weights(spec, 7, keys), plain)
