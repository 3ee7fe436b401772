import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle.llm import inverted_multi_index, multi_index_hash

SCHEMA = "vec_id long, embedding array<float>, label int, rep long, q boolean, blk int, shard int, cell long, e string, n long"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 0, 1, False, 2, 3, 4, "e", 5) for i, v in vectors], SCHEMA)


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(7)
    centres = r.normal(size=(12, 16))
    x = [(3 * i, (centres[i % 12] + r.normal(size=16) * (0.05 if i % 3 else 1.0)).astype(np.float32).tolist()) for i in range(420)]
    x += [(5000 + i, x[40][1]) for i in range(30)]
    odd = [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] + [1.0] * 15), (9003, [float("inf")] * 16), (9004, [1.0, 2.0]), (9005, [None] + [1.0] * 15), (9006, [])]
    return x, odd


def test_near_duplicates_equal_brute_force(spark, vectors):
    x, odd = vectors
    got = {r.vec_id: r for r in inverted_multi_index.near_duplicates(table(spark, x + odd + [(None, x[0][1])])).collect()}
    assert set(got) == {i for i, _ in x + odd}
    m = np.array([v for _, v in x], float)
    ids = [i for i, _ in x]
    m /= np.linalg.norm(m, axis=1)[:, None]
    near = m @ m.T >= 0.9
    up = {i: i for i in ids}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in zip(*np.nonzero(near), strict=True):
        p, q = root(ids[a]), root(ids[b])
        up[max(p, q)] = min(p, q)
    found = sum(got[i].n_links for i in ids)
    assert found >= 0.98 * (near.sum() - len(ids)) and all(got[i].n_links <= near[k].sum() - 1 for k, i in enumerate(ids))
    assert sum(got[i].component_id == root(i) for i in ids) >= 0.99 * len(ids)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert all((got[i].n_links, got[i].component_id) == (0, i) for i, _ in odd)


def test_visits_follow_the_sum_of_distances():
    r = np.random.default_rng(3)
    x = r.normal(size=(300, 10))
    grid = inverted_multi_index.Grid(x, 6)
    d = [((x[:, None, : grid.half] - grid.books[0]) ** 2).sum(2), ((x[:, None, grid.half :] - grid.books[1]) ** 2).sum(2)]
    sums = (d[0][:, :, None] + d[1][:, None, :]).reshape(300, -1)
    for n in (1, 5, 36):
        got = np.take_along_axis(sums, grid.visits(x, n), axis=1)
        assert np.allclose(got, np.sort(sums, axis=1)[:, :n])


def test_nearest_has_recall_and_order(spark, vectors):
    x, odd = vectors
    got = multi_index_hash.nearest(table(spark, x + odd), F.col("vec_id") % 20 == 0, 20).collect()
    m, ids = np.array([v for _, v in x], float), np.array([i for i, _ in x])
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    assert set(by) == {int(i) for i in ids if i % 20 == 0}
    for q, rows in by.items():
        k = int(np.flatnonzero(ids == q)[0])
        s = (m * m[k]).sum(1)
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        rows.sort()
        assert [r for r, _, _ in rows] == list(range(1, 21))
        assert [(-sc, i) for _, i, sc in rows] == sorted((-sc, i) for _, i, sc in rows)
        assert all(abs(sc - s[np.flatnonzero(ids == i)[0]]) < 1e-9 for _, i, sc in rows)
        hits += len({i for _, i, _ in rows} & set(ids[order].tolist()))
    assert hits >= 0.9 * 20 * len(by)


def test_few_vectors_and_none(spark):
    few = table(spark, [(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [1.0, 0.0]), (20, [0.0, 1.0])])
    got = multi_index_hash.nearest(few, F.col("vec_id") % 20 == 0, 20).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(0, 1, 2), (0, 2, 1), (0, 3, 20), (20, 1, 1), (20, 2, 0), (20, 3, 2)]
    none = table(spark, [])
    assert multi_index_hash.nearest(none, F.lit(True), 20).count() == 0
    assert inverted_multi_index.near_duplicates(none).count() == 0
    assert inverted_multi_index.near_duplicates(table(spark, [(4, None), (5, [0.0, 0.0])])).count() == 2
    assert sorted((r.vec_id, r.component_id) for r in inverted_multi_index.near_duplicates(few).collect()) == [(0, 0), (1, 0), (2, 0), (20, 20)]


def test_probing_alone_finds_all_codes_within_the_radius():
    r = np.random.default_rng(2)
    codes = r.integers(0, 1 << 16, (400, multi_index_hash.TABLES)).astype("<u2")
    flip = r.random((60, multi_index_hash.BITS)) < r.random((60, 1)) * 0.35
    queries = codes[:60] ^ np.packbits(flip, axis=1, bitorder="little").view("<u2")
    for radius in (0, 3, 9, 30, 52):
        for high_bits in (0, 3):
            low_bits, got = 16 - high_bits, [set() for _ in queries]
            gathered = 0
            for j, far in enumerate(multi_index_hash.radii(radius)):
                near = multi_index_hash.masks(16, far)
                for start in range(0, 1 << 16, 1 << low_bits):
                    rows = np.flatnonzero(codes[:, j] >> low_bits == start >> low_bits)
                    buckets = multi_index_hash.Buckets(codes[rows, j], start, low_bits)
                    for k, q in enumerate(queries):
                        gathered += len(buckets.probe(int(q[j]), near))
                        got[k] |= set(rows[multi_index_hash.within(buckets, codes[rows], q, j, near, radius)].tolist())
            want = [set(np.flatnonzero(multi_index_hash.distances(codes, q[None]) <= radius).tolist()) for q in queries]
            assert got == want
            assert radius > 9 or gathered < 0.2 * 400 * 60 * multi_index_hash.TABLES


def test_nearest_with_ranges_blocks_and_few_lists(spark, vectors, monkeypatch):
    x, _ = vectors
    whole = multi_index_hash.nearest(table(spark, x), F.col("vec_id") % 20 == 0, 20).collect()
    for name, value in (("MEMBERS", 40), ("QUERIES", 8), ("LISTS", 64)):
        monkeypatch.setattr(multi_index_hash, name, value)
    again = multi_index_hash.nearest(table(spark, x), F.col("vec_id") % 20 == 0, 20).collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in whole}


def test_repeated_ids_and_other_widths(spark):
    r = np.random.default_rng(8)
    x = [(i, r.normal(size=8).round(3).tolist()) for i in range(60)]
    more = [x[0], x[0], (7, x[7][1]), (101, [1.0, 2.0, 3.0]), (120, [1.0, 2.0, 3.0]), (140, [3.0]), (141, [-2.0]), (142, [6.0]), (160, None), (180, [0.0])]
    got = multi_index_hash.nearest(table(spark, x + more), F.col("vec_id") % 20 == 0, 20).collect()
    by = {}
    for row in got:
        by.setdefault(row.query_id, []).append((row.rank, row.vec_id))
    assert set(by) == {0, 20, 40, 120, 140}
    for q in (0, 20, 40):
        assert sorted(k for k, _ in by[q]) == list(range(1, 21)) and len({i for _, i in by[q]}) == 20
    assert by[120] == [(1, 101)] and sorted(by[140]) == [(1, 142), (2, 141)]
    near = sorted((row.vec_id, row.n_links, row.component_id) for row in inverted_multi_index.near_duplicates(table(spark, x + more)).collect())
    assert [v for v in near if v[0] == 0] == [(0, 2, 0)] * 3 and [v for v in near if v[0] == 7] == [(7, 1, 7)] * 2
    assert near[-7:] == [(101, 1, 101), (120, 1, 101), (140, 1, 140), (141, 0, 141), (142, 1, 140), (160, 0, 160), (180, 0, 180)]
    # One id with two texts' vectors: each is linked with what is like it.
    both = table(spark, [(3, [1.0, 0.0]), (3, [0.0, 1.0]), (9, [0.0, 2.0]), (12, [2.0, 0.01])])
    assert sorted((v.vec_id, v.n_links, v.component_id) for v in inverted_multi_index.near_duplicates(both).collect()) == [(3, 1, 3), (3, 1, 3), (9, 1, 3), (12, 1, 3)]
