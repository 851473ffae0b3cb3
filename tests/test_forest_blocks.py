"""Packed rows, shared draws and scores of held-out cells against the plain form."""
import numpy as np
import pandas as pd
import pytest

from tabulon.operators import forest as FO

COLS = [f"c{i}" for i in range(4)]


@pytest.fixture(scope="module")
def df(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 6, (3000, 4)).astype(float)
    y = ((x[:, 0] > 2) ^ (x[:, 2] > 3) | (rng.random(3000) < 0.1)).astype(int)
    x[rng.random(x.shape) < 0.02] = np.nan
    return spark.createDataFrame(pd.DataFrame(x, columns=COLS).assign(y=y, key=rng.integers(0, 1 << 40, 3000), fold=np.arange(3000) % 3)).repartition(5)


@pytest.fixture(scope="module")
def both(df):
    edges = FO.feature_edges(df, COLS)
    return [f(df, COLS, edges, "y", "key", "fold") for f in (FO.binned_rows, FO.packed_rows)]


SPECS = [FO.ForestSpec(trees=4, without_fold=k) for k in range(3)] + [FO.ForestSpec(trees=3, extra=True, bootstrap=False, without_fold=1), FO.ForestSpec(trees=5, depth=4, features=(2, 0))]


def test_packed_rows_hold_every_row_and_each_cell_once(both):
    """the table that forests read has 8 bytes a row, its cells stand once."""
    plain, packed = both
    rows = [(r["key"], r["fold"], r["y"], bytes(r["x"])) for r in plain.collect()]
    got = packed.collect()
    out, cells = [], []
    for r in got:
        (b,) = FO._blocks([FO._records([FO._Block(r["block"], *_parts(r))])], 4)
        cells += [bytes(c) for c in b.x]
        fold, y, cell = (np.repeat(v, b.size) for v in (b.fold, b.y, b.cell))
        out += [(int(k), int(f), int(v), bytes(b.x[c])) for k, f, v, c in zip(b.keys, fold, y, cell, strict=True)]
    assert sorted(out) == sorted(rows) and len(cells) == len(set(cells)) == len({r[3] for r in rows})
    assert sum(sum(len(v) for v in r.asDict().values() if isinstance(v, (bytes, bytearray))) for r in got) < 14 * len(rows) + 4 * len(cells)


def _parts(r):
    x = np.frombuffer(bytes(r["x"]), np.uint8).reshape(-1, 4)
    groups = FO._whole(bytes(r["groups"]), len(x)).astype(np.int64)
    n = int(groups.sum())
    return (x, np.repeat(np.arange(len(x)), groups), *(FO._whole(bytes(r[c]), n) for c in ("fold", "y", "size")), np.frombuffer(bytes(r["keys"]), np.int64))


def test_same_trees_from_both_forms_and_in_parts(both):
    """F3, F4, F8: draws that forests share are brought together once, the trees stay what they are."""
    found = []
    for rows, local in ((both[0], 10_000), (both[1], 10_000), (both[1], 100)):
        trees = FO.grow_forests(rows, SPECS, 4, local).collect()
        assert len(trees) == sum(s.trees for s in SPECS)
        found.append({(t["fit"], t["tree"]): (len(t["feature"]), np.round(t["gain"], 6).tolist()) for t in trees})
    assert found[0] == found[1] == found[2]
    gains = {(t["fit"], t["tree"]): (len(t["feature"]), np.round(t["gain"], 6).tolist()) for t in FO.grow_forests(both[1], SPECS, 4, kept=()).collect()}
    assert all(gains[k] == (0, v[1]) for k, v in found[0].items())


def test_held_out_rows_moved_as_cells(both, monkeypatch):
    """F2, F6, F8: scores of held-out cells give the accuracy and the probabilities of the rows, one by one."""
    trees = FO.grow_forests(both[1], SPECS, 4)
    decoded = [(t["fit"], FO._decoded(t)) for t in trees.collect()]
    want = {}
    for r in both[0].collect():
        x = np.frombuffer(bytes(r["x"]), np.uint8)[None]
        for fit, s in enumerate(SPECS):
            if r["fold"] == s.without_fold:
                p = np.mean([t[4][FO._walk(t[1:], s.columns(x))][0] for f, t in decoded if f == fit])
                want[fit, r["key"]] = (p, r["y"])
    accuracy = {f: np.mean([(p > 0.5) == y for (fit, _), (p, y) in want.items() if fit == f]) for f in range(4)}
    for local in (10_000, 100):
        _, scores = FO.grow_and_score(both[1], SPECS, 4, local_rows=local)
        got = {(r["fit"], r["key"]): (r["p"], r["y"]) for r in FO.held_out_rows(both[1], scores, SPECS, 4).collect()}
        assert got.keys() == want.keys() and all(got[k][0] == pytest.approx(want[k][0], abs=1e-6) and got[k][1] == want[k][1] for k in want)
        assert FO.held_out_accuracy(both[1], scores, SPECS, 4) == pytest.approx(accuracy)


def test_a_seventh_of_the_bytes_move_for_a_draw(both, monkeypatch):
    """a cell's bins do not travel with every tree."""
    narrow = [len(FO._narrow(np.full(1000, v))) for v in (127, 128, 40_000)]
    assert narrow == [1000, 2000, 4000] and FO._whole(FO._narrow(np.array([-1, 300])), 2).tolist() == [-1, 300]


def test_sums_beyond_a_double_keep_both_weights():
    """Weights are added up in one number where that is exact, else apart."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 9, (400, 3)).astype(np.uint8)
    for scale in (1, 1 << 24, 1 << 40):
        w = rng.integers(1, 9, 400).astype(float) * scale
        hit = np.floor(w * rng.random(400))
        pair = FO._Pair(w, hit, 3)
        code = np.sort(rng.integers(0, 50, 400))
        met, got = pair.bincount(code, pair.parts, 1, 50)
        a, b = pair.apart(got)
        assert np.array_equal(a, np.bincount(code, w, 50)[met]) and np.array_equal(b, np.bincount(code, hit, 50)[met])
        for extra in (False, True):
            tree = FO.grow_cells(x, w, hit, np.uint64(1), 0, FO.ForestSpec(depth=3, extra=extra))
            assert len(tree["feature"]) > 3 and 0 <= tree["value"].min() <= tree["value"].max() <= 1
