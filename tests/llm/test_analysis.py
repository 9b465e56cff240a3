"""Exact top-k, whitening and the filter audit against brute force, and odd rows."""

import itertools
import math
import random

import numpy as np
import pytest

from codequarry.llm import audit, threshold, whiten

VECTORS = "vec_id bigint, embedding array<double>, label int, x string, entry string"


def vectors(spark, rows):
    """Vectors with columns whose names clash with those of operators."""
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 0, "x", "e") for i, v in rows], VECTORS)


# ---- exact top-k -----------------------------------------------------------------------------


def best_rows(rows, k, every):
    """(query_id, rank, vec_id, score) by comparing every two rows."""
    held = []
    for i, v in rows:
        if v is not None and all(c is not None and math.isfinite(c) for c in v):
            x = [math.floor(256 * c) for c in v]
            if sum(c * c for c in x) < threshold.LARGEST:
                held.append((i, x))
    out = []
    for n, (q, x) in enumerate(held):
        if q is not None and q % every == 0:
            scores = [(-sum(a * b for a, b in zip(x, y)), i is None, i or 0, i) for m, (i, y) in enumerate(held) if m != n and len(x) == len(y)]
            out += [(q, rank + 1, i, -score) for rank, (score, _, _, i) in enumerate(sorted(scores, key=lambda s: s[:3])[:k])]
    return sorted(out, key=repr)


def found_rows(df):
    return sorted((tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect()), key=repr)


@pytest.mark.parametrize("slices", [1, 2, 3])
def test_top_rows(spark, monkeypatch, slices):
    monkeypatch.setattr(threshold, "VECTORS", 70)
    monkeypatch.setattr(threshold, "QUERIES", 9)
    dice = np.random.default_rng(slices)
    rows = [(i, dice.standard_normal(10).round(2)) for i in range(400)]
    rows += [(400 + i, rows[i % 3][1]) for i in range(60)]  # copies, of queries too
    rows += [(500 + i, dice.integers(0, 2, 10)) for i in range(60)]  # ties
    assert found_rows(threshold.top_rows(vectors(spark, rows), 5, 20, slices)) == best_rows(rows, 5, 20)


def test_top_rows_odd(spark):
    rows = [
        (0, [1, 2]), (0, [1, 2]), (0, [2, 1]), (50, [0, 0]), (51, [-1, -1]), (None, [3, 3]), (None, [3, 3]), (52, [math.nan, 1]), (100, [None, 1]),
        (150, None), (200, []), (201, []), (250, [1e200, 0]), (53, [math.inf, 1]), (300, [1, 2, 3]), (54, [5e6, 5e6]), (55, [4e6, 1]), (400, [-4e6, 1]), (450, [4e6, 0]), (350, [-7, 0.001]),
    ]
    assert found_rows(threshold.top_rows(vectors(spark, rows), 5, 50)) == best_rows(rows, 5, 50)
    assert found_rows(threshold.top_rows(vectors(spark, rows), 1, 50)) == best_rows(rows, 1, 50)
    assert found_rows(threshold.top_rows(vectors(spark, []))) == []
    assert found_rows(threshold.top_rows(vectors(spark, [(1, [1.0]), (2, [2.0])]))) == []


def test_few_entries_pass_the_cutoff(spark):
    """The cutoff is what saves work: of clustered vectors a small share leaves its list."""
    dice = np.random.default_rng(5)
    centres = dice.standard_normal((40, 16))
    rows = [(i, centres[i % 40] + 0.1 * dice.standard_normal(16)) for i in range(2000)]
    told, meet = [], threshold._meet

    def counted(*args):
        told.append(meet(*args))
        return told[-1]

    threshold._meet = counted
    try:
        assert found_rows(threshold.top_rows(vectors(spark, rows))) == best_rows(rows, 5, 50)
    finally:
        threshold._meet = meet
    assert told[1].count() < 0.1 * 40 * 2000 * threshold.SLICES


# ---- whitening -------------------------------------------------------------------------------


def test_above_counts_eigenvalues():
    dice = np.random.default_rng(1)
    for size in (1, 2, 3, 8, 30):
        for _ in range(6):
            a = dice.standard_normal((size, size))
            a = a + a.T
            values = np.linalg.eigvalsh(a)
            for shift in (*(values + 1e-6), *(values - 1e-6), 0.0):
                assert whiten.above(a, shift) == (values > shift).sum()
    assert whiten.above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1
    assert whiten.above(np.zeros((3, 3)), 0.0) == 0


@pytest.mark.parametrize(
    "matrix",
    [
        np.eye(5) * 3, np.diag([3.0, 3, 2, 2, 2, 0, 0]), np.ones((6, 6)), np.diag([1, 1 + 1e-14, 1 - 1e-14, 0.5]), np.diag(10.0 ** np.arange(0, -12, -1)),
        np.cov(np.random.default_rng(2).standard_normal((300, 40)).T), np.cov(np.random.default_rng(3).standard_normal((5, 12)).T),
    ],
)
def test_leading(matrix):
    values, axes = whiten.leading(matrix, 16)
    want = np.linalg.eigvalsh(matrix)[::-1]
    rank = np.linalg.matrix_rank(matrix, hermitian=True)
    assert len(values) == min(16, rank)
    assert np.abs(values - want[: len(values)]).max() < 1e-12 * want[0]
    assert np.abs(axes.T @ axes - np.eye(len(values))).max() < 1e-12
    assert np.abs(matrix @ axes - axes * values).max() < 1e-12 * want[0]
    assert (np.diff(values) <= 1e-13 * want[0]).all()


def test_whitened(spark):
    dice = np.random.default_rng(4)
    held = (dice.standard_normal((500, 20)) * np.linspace(1, 0.1, 20) + dice.standard_normal(20)).tolist()
    rows = [*enumerate(held), *((600 + i, held[i % 4]) for i in range(90))]
    got = whiten.whitened(vectors(spark, rows), 16).toPandas()
    x = np.floor(64 * np.array(held)) + 1_000_000
    x = np.unique(x, axis=0)
    covariance = np.cov(x.T, bias=True)
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:16], axes[:, ::-1][:, :16]
    assert len(got) == 590 * 16 and set(got["n"]) == {len(x)}
    assert got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-10
    all_x = np.floor(64 * np.array([v for _, v in rows])).astype(int) + 1_000_000
    sums = [sum(int(v) for v in column) for column in x.T.astype(int)]
    w = got.pivot(index="vec_id", columns="component", values="whitened").loc[[i for i, _ in rows]].to_numpy()
    want = (all_x - x.mean(axis=0)) @ axes / np.sqrt(values)
    sign = np.sign((w * want).sum(axis=0))
    assert np.abs(w - want * sign).max() < 1e-8
    deviation = got[got["component"] == 1].set_index("vec_id")["deviation"]
    assert [int(deviation[i]) for i, _ in rows] == [sum((len(x) * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in all_x]
    explained = got[got["vec_id"] == 0].sort_values("component")["explained"].to_numpy()
    assert np.abs(explained / (values / np.trace(covariance)) - 1).max() < 1e-10


def test_whitened_odd(spark):
    odd = [(1, None), (2, []), (3, [math.nan, 1]), (4, [None, 1]), (5, [math.inf, 0]), (6, [1, 2, 3]), (7, [1e300, 0])]
    assert whiten.whitened(vectors(spark, [])).count() == 0
    assert whiten.whitened(vectors(spark, odd[:5])).count() == 0
    assert whiten.whitened(vectors(spark, [(8, [1, 2]), (9, [1, 2])])).count() == 0  # one distinct vector
    got = whiten.whitened(vectors(spark, [*odd, (None, [1, 2]), (8, [3, 2]), (8, [3, 2]), (9, [1e13, 2])])).collect()
    assert sorted((str(r["vec_id"]), r["component"]) for r in got) == [("8", 1), ("8", 1), ("9", 1), ("None", 1)]
    assert {r["n"] for r in got} == {3}
    assert [r["deviation"] for r in got] == [None] * 4  # beyond a long


# ---- filter audit ----------------------------------------------------------------------------


def test_merges():
    dice = random.Random(2)
    for _ in range(200):
        lists = [sorted(dice.sample(range(120), dice.randrange(60))) for _ in range(dice.randrange(6))]
        assert audit.union(lists) == sorted({i for ids in lists for i in ids})
        a, b = (sorted(dice.sample(range(120), dice.randrange(60))) for _ in range(2))
        assert audit.difference(a, b) == sorted(set(a) - set(b))
    assert audit.union([list(range(1000)), list(range(500, 1500))]) == list(range(1500))


def audited(docs, labels):
    """The audit by applying every order of the filters to every document."""
    fails = []
    for i, text, lang in docs:
        t = text or ""
        words = t.encode().split()
        fails.append({
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs),
        })
    marks = [tuple(any(j == i and row[at] == 1 for j, *row in labels) if i is not None else False for at in (0, 1)) for i, _, _ in docs]
    out = {}
    for part in {lang or "" for _, _, lang in docs}:
        rows = [(f, *m) for f, m, d in zip(fails, marks, docs) if (d[2] or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order):
                gone, stays = [r for r in left if r[0][f]], [r for r in left if not r[0][f]]
                shapley[f] += len(gone)
                redundant = sum(r[0][f] for r in rows) - len(gone)
                unique = sum(r[0][f] and sum(r[0].values()) == 1 for r in rows)
                out[part, "".join(order), step + 1] = [len(stays), len(gone), redundant, unique, sum(r[1] for r in gone), sum(r[2] for r in gone)]
                left = stays
        for key, row in out.items():
            if key[0] == part:
                row.append(shapley[key[1][key[2] - 1]])
    return out


def audit_of(spark, docs, labels):
    docs = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id bigint, text string, lang string, fails string, n int")
    labels = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = audit.audit(docs, labels).collect()
    found = {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in got}
    assert len(found) == len(got)
    return found


def test_audit(spark, monkeypatch):
    monkeypatch.setattr(audit, "RANGE_BITS", 3)
    dice = random.Random(3)
    docs = []
    for i in range(220):
        text = " ".join(dice.choice(["Alpha", "beta", "GAMMA", "é", "x#"]) + str(dice.randrange(dice.choice([20, 4000]))) for _ in range(dice.randrange(60, 180)))
        docs.append((i, dice.choice([text.lower(), text, text.replace("#", "")]), dice.choice(["en", "en", "de", None, ""])))
    docs += [(300 + i, docs[i % 7][1], "fr") for i in range(40)]  # copies
    labels = [(i, dice.choice([0, 1, None]), dice.choice([0, 1])) for i in range(0, 320, 2)] + [(4, 1, 1), (None, 1, 1)]
    assert audit_of(spark, docs, labels) == audited(docs, labels)


def test_audit_odd(spark):
    long = "Word " * 300_000
    docs = [
        (None, "a", None), (None, "a", "en"), (1, None, "en"), (2, "", "en"), (2, "", "en"), (3, long, "de"), (4, long, "de"), (5, "\x0b\x1c  ", "xx"),
        (7, "É" * 50 + " A", "é"),
    ]
    labels = [(1, 1, 0), (1, 0, 1), (2, None, None), (9, 1, 1)]
    assert audit_of(spark, docs, labels) == audited(docs, labels)
    assert audit_of(spark, [], labels) == {}
    assert set(r[4] for r in audit_of(spark, docs, []).values()) == {0}
