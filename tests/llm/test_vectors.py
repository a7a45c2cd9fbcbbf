"""Vector codes and the prefix forest against brute force, on ordinary and odd vectors."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int, code string, uid long, v int, first string"


def brute_codes(rows, parts=4, entries=256, rounds=4):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    x = np.floor(1024 * np.array([r[1] for r in kept], np.float32).astype(np.float64)).astype(np.int64).reshape(len(kept), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()

    def assign():
        far = ((x[:, :, None, :] - books[None]) ** 2).sum(-1)
        return far.argmin(2), far.min(2)

    for _ in range(rounds):
        code, _far = assign()
        for p in range(parts):
            for e in range(books.shape[1]):
                mine = x[code[:, p] == e, p]
                if len(mine):
                    books[p, e] = [int(s) // len(mine) for s in mine.sum(0)]
    code, far = assign()
    error, labels = far.sum(1), {}
    for r, e in zip(kept, error, strict=True):
        labels[r[2]] = labels.get(r[2], 0) + int(e)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return [(r[0], "".join(f"{c:02x}" for c in code[i]), int(error[i]), labels[r[2]], digest) for i, r in enumerate(kept)]


def make(n, width, seed=3, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((7, width))
    x = (centres[rng.integers(0, 7, n)] * 0.6 + rng.standard_normal((n, width))).astype(np.float32)
    x[n - copies :] = x[0]
    rows = [(i * 5 - 300, x[i].tolist(), None if i % 11 == 0 else i % 4, "x", 1, 2, "y") for i in range(n)]
    odd = [None, [], [float("nan")] * width, [float("inf")] + [0.5] * (width - 1), [None] + [0.5] * (width - 1)]
    return rows, [(10**6 + 20 * i, v, 1, "x", 1, 2, "y") for i, v in enumerate(odd)]


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


@pytest.mark.parametrize("n, width, copies", [(700, 16, 200), (40, 8, 0), (300, 4, 150)])
def test_codes(spark, n, width, copies):
    from gristmill.llm.vector_codes import vector_codes

    rows, odd = make(n, width, copies=copies)
    odd = [r for r in odd if r[1] != []]
    tied = [(rows[3][0], rows[3][1], 2, "x", 1, 2, "y"), (None, rows[4][1], None, "x", 1, 2, "y"), (2**62, [0.0] * width, 3, "x", 1, 2, "y")]
    got = [tuple(r) for r in vector_codes(frame(spark, rows + odd + tied)).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()]
    assert sorted(got, key=repr) == sorted(brute_codes(rows + tied), key=repr)


def test_codes_of_odd_tables(spark):
    from gristmill.llm.vector_codes import vector_codes

    assert vector_codes(frame(spark, [])).count() == 0
    assert vector_codes(frame(spark, [(1, None, 1, "x", 1, 2, "y")])).count() == 0
    assert [r["code"] for r in vector_codes(frame(spark, [(1, [], 1, "x", 1, 2, "y")])).collect()] == ["00000000"]
    for bad in ([[0.5] * 6], [[0.5] * 4, [0.5] * 8], [[1e30] * 4]):
        with pytest.raises(ValueError):
            vector_codes(frame(spark, [(i, v, 1, "x", 1, 2, "y") for i, v in enumerate(bad)]))


def test_cells_bound_distances():
    from gristmill.llm.vector_codes import Cells

    rng = np.random.default_rng(1)
    entries, parts = rng.integers(-900, 900, (256, 6)), rng.integers(-1200, 1200, (300, 6))
    entries[7] = entries[3]
    far = ((parts[:, None] - entries) ** 2).sum(-1)
    cells = Cells(entries)
    lower, upper = cells.bounds(parts)
    assert (lower <= far).all() and (far <= upper).all()
    assert (lower <= upper.min(1)[:, None]).mean() < 0.5  # most entries are ruled out by their cells
    near, best = cells.nearest(parts)
    assert (near == far.argmin(1)).all() and (best == far.min(1)).all()


def brute_nearest(rows, n=20):
    rows = {(r[0], tuple(np.float32(r[1]).tolist())) for r in rows if r[0] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])}
    out = {}
    for q, v in rows:
        if q % 20 == 0:
            near = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in rows if i != q)
            out.setdefault(q, near[:n])
    return out


def answers(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert all([x[0] for x in sorted(v)] == list(range(1, len(v) + 1)) for v in out.values())
    return {q: [x[1:] for x in sorted(v)] for q, v in out.items()}


@pytest.mark.parametrize("n, width, copies, block", [(900, 24, 300, 64), (500, 8, 0, 4096)])
def test_forest(spark, n, width, copies, block):
    from gristmill.llm.prefix_forest import nearest

    rows, odd = make(n, width, copies=copies)
    extra = [(8 * 10**6, [0.0] * width, 1, "x", 1, 2, "y"), (None, rows[4][1], 1, "x", 1, 2, "y"), rows[60], rows[60], (9 * 10**6, rows[60][1][:-2], 1, "x", 1, 2, "y")]
    got = answers(nearest(frame(spark, rows + odd + extra), F.col("vec_id") % 20 == 0, block=block))
    true = brute_nearest(rows + extra)
    assert got.keys() == true.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for _, i in true[q]}) for q in true)
    assert hits >= 0.9 * sum(map(len, true.values()))
    for near in got.values():
        assert len(near) == 20 and near == sorted(near, key=lambda x: (-x[1], x[0]))
    vectors = {r[0]: np.float32(r[1]).astype(float) for r in rows}
    for q in list(true)[:40]:
        if q in vectors:
            assert all(abs(s - vectors[q] @ vectors[i]) < 1e-9 for i, s in got[q] if i in vectors)


def test_forest_is_exact_below_its_roots(spark):
    """Few rows: prefixes never hold enough, so every candidate is compared; ties go to smaller ids."""
    from gristmill.llm.prefix_forest import nearest

    rows = [(i, [float(i % 3 == 0), float(i % 3 == 1), float(i % 3 == 2)], 1, "x", 1, 2, "y") for i in range(50)]
    got = answers(nearest(frame(spark, rows), F.col("vec_id") % 20 == 0))
    assert got == {q: [(i, -s) for s, i in near] for q, near in brute_nearest(rows).items()}
    few = answers(nearest(frame(spark, rows[:5]), F.col("vec_id") % 20 == 0))
    assert few == {0: [(3, 1.0), (1, 0.0), (2, 0.0), (4, 0.0)]}
    assert nearest(frame(spark, rows[1:9]), F.col("vec_id") % 20 == 0).count() == 0
    assert nearest(frame(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    assert nearest(frame(spark, rows[:1]), F.col("vec_id") % 20 == 0).count() == 0


def test_forest_descends_where_vectors_are_dense(spark):
    """A tight cluster of a third of all rows: its queries stay below long prefixes, others ascend."""
    from gristmill.llm.prefix_forest import nearest

    rng = np.random.default_rng(5)
    x = rng.standard_normal((1500, 16))
    x[:500] = x[0] + rng.standard_normal((500, 16)) * 0.02
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.astype(np.float32).tolist(), 1, "x", 1, 2, "y") for i, v in enumerate(x)]
    got, true = answers(nearest(frame(spark, rows), F.col("vec_id") % 20 == 0, block=128, want=2000)), brute_nearest(rows)
    dense = [q for q in true if q < 500]
    assert sum(len({i for i, _ in got[q]} & {i for _, i in true[q]}) for q in dense) >= 0.9 * 20 * len(dense)
    assert all(i < 500 for q in dense for i, _ in got[q])
