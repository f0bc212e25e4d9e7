"""Change points, exact search and vector codes against brute-force versions."""

import datetime
import hashlib
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyweave.llm import changepoints, queries, topk, veccodes

# -- change points


def all_cuts(values, least, penalty):
    """The best of all segmentations: least cost, fewest segments, earliest starts from the last backwards."""

    def cost(a, b):
        n, s, q = b - a, sum(values[a:b]), sum(v * v for v in values[a:b])
        return n * math.floor(1000 * math.log(1 + (n * q - s * s) // (n * n)))

    n = len(values)
    found = []
    for k in range(n // least or 1):
        for starts in itertools.combinations(range(1, n), k):
            edges = [0, *starts, n]
            if k and min(b - a for a, b in zip(edges, edges[1:])) < least:
                continue
            found.append((sum(cost(a, b) for a, b in zip(edges, edges[1:])) + penalty * k, k, edges[-2::-1]))
    best = min(found)
    return best[0], best[2][::-1]


def test_segments_against_all_segmentations(monkeypatch):
    monkeypatch.setattr(changepoints, "CELLS", 40)  # several groups of end days
    rng = np.random.default_rng(0)
    for _ in range(150):
        n, least = int(rng.integers(1, 15)), int(rng.integers(2, 8))
        values = [int(v) for v in rng.choice([-3, 0, 1, 5, 50], n)]
        for scale in (1, 10**13):  # beyond what 64 bits hold exactly
            for penalty in (0, 500, 20_000):
                own = [v * scale for v in values]
                assert changepoints.segmented(own, least, penalty) == all_cuts(own, least, penalty)


def test_ties_go_to_few_segments_and_early_starts():
    assert changepoints.segmented([5] * 30, 7, 0) == (0, [0])
    # one flat level after another: every cut between them costs the same, the last segment starts as early as it can
    values = [0] * 10 + [1000] * 10
    assert changepoints.segmented(values, 7, 100) == all_cuts(values, 7, 100)


def test_change_points_of_rows(spark):
    day = lambda d: datetime.datetime(1969, 12, 1) + datetime.timedelta(days=d, hours=5)
    rng = np.random.default_rng(1)
    rows = [(int(v), day(int(d)), int(q), 1) for v, d, q in zip(rng.choice([1, 2, 3], 600), rng.integers(0, 60, 600), rng.integers(0, 40, 600))]
    rows += [(1, day(30 + d), 500, 1) for d in range(20)] * 2  # repeated rows count
    rows += [(None, day(d), 7, 1) for d in range(3)] + [(4, day(3), 9, 1), (5, None, 9, 1), (6, day(1), None, 1), (7, day(0), -4, 1), (7, day(40), 10**12, 1)]
    frame = spark.createDataFrame(rows, "vendor long, `at` timestamp_ntz, n long, day int")
    got = changepoints.change_points(frame, "vendor", "at", "n").collect()
    assert set(changepoints.change_points(frame, "vendor", "at", "n").columns) == {"vendor", "segment_no", "first_day", "n_days", "total", "spread", "cost", "n_segments", "best_cost"}
    sums = {}
    for v, at, n, _ in rows:
        if at is not None and n is not None:
            own = sums.setdefault(v, {})
            d = (at.date() - datetime.date(1970, 1, 1)).days
            own[d] = own.get(d, 0) + n
    assert {r["vendor"] for r in got} == set(sums)
    for v, own in sums.items():
        first, last = min(own), max(own)
        series = [own.get(d, 0) for d in range(first, last + 1)]
        best, starts = changepoints.segmented(series, 7, 20_000)  # tested above
        mine = sorted((r for r in got if r["vendor"] == v), key=lambda r: r["segment_no"])
        assert [r["first_day"] - first for r in mine] == starts and [r["segment_no"] for r in mine] == list(range(1, len(starts) + 1))
        assert {(r["n_segments"], r["best_cost"]) for r in mine} == {(len(starts), best)}
        for r, a, b in zip(mine, starts, [*starts[1:], len(series)]):
            n, s, q = b - a, sum(series[a:b]), sum(x * x for x in series[a:b])
            spread = 1 + (n * q - s * s) // (n * n)
            assert (r["n_days"], r["total"], r["spread"], r["cost"]) == (n, s, spread if spread < 2**63 else None, n * math.floor(1000 * math.log(spread)))
        assert sum(r["cost"] for r in mine) + 20_000 * (len(mine) - 1) == best
    assert changepoints.change_points(frame.where("false"), "vendor", "at", "n").collect() == []


def test_a_long_series():
    rng = np.random.default_rng(2)
    values = [int(v) for v in np.concatenate([rng.integers(0, 5, 900), rng.integers(0, 5000, 900)])]
    best, starts = changepoints.segmented(values, 7, 20_000)
    assert starts[0] == 0 and min(abs(s - 900) for s in starts) <= 2 and best > 0


# -- exact top-k

VECTORS = "vec_id long, vector array<float>, rank int, low string"


def nearest_by_force(rows, queries_, k, scale=256):
    whole = {}
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            own = [math.floor(scale * x) for x in np.array(v, dtype=np.float32).astype(float)]
            whole[i] = min(whole.get(i, own), own)
    out = []
    for q in queries_:
        if q in whole:
            listed = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(listed[:k])]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize(("blocks", "bits"), [((131_072, 2_048), 10), ((23, 7), 2), ((50, 50), 1)])
def test_search_against_brute_force(spark, monkeypatch, blocks, bits):
    monkeypatch.setattr(topk, "BLOCK", blocks[0])
    monkeypatch.setattr(topk, "LEAST", blocks[1])
    monkeypatch.setattr(topk, "BITS", bits)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.1, 6)], 1, "x") for i in range(90)]
    rows += [(200 + i, rows[0][1], 1, "x") for i in range(40)]  # one vector many times, ties everywhere
    rows += [(300, None, 1, "x"), (301, [], 1, "x"), (302, [None] * 6, 1, "x"), (303, [float("nan")] * 6, 1, "x"), (304, [0.0] * 6, 1, "x"), (305, [float("inf")] + [0.0] * 5, 1, "x"), (None, rows[1][1], 1, "x"), (306, [0.1, 0.2], 1, "x"), (307, [0.2, -0.2], 1, "x"), (308, [3.0], 1, "x")]
    rows += [rows[5], rows[5], (7, rows[8][1], 1, "x"), (7, rows[9][1], 1, "x")]
    frame = spark.createDataFrame(rows, VECTORS)
    asked = [*range(0, 12), 205, 239, 300, 303, 304, 306, 308]
    wanted = frame.where(F.col("vec_id").isin(asked)).withColumnRenamed("vec_id", "query_id")
    for k in (1, 5, 33):
        assert found(topk.nearest_exact(frame, wanted, k=k)) == nearest_by_force(rows, asked, k)


def test_search_edges(spark):
    one = spark.createDataFrame([(1, [0.5, -0.5], 1, "x"), (1, [0.5, -0.5], 1, "x")], VECTORS)
    ask = one.withColumnRenamed("vec_id", "query_id")
    assert found(topk.nearest_exact(one, ask)) == []  # nothing but the query's own
    assert found(topk.nearest_exact(one.where("false"), ask)) == []
    assert found(topk.nearest_exact(one, ask.where("false"))) == []
    two = one.unionByName(spark.createDataFrame([(2, [0.25, 0.001], 1, "x"), (3, [-9.0, 4.0], 1, "x")], VECTORS))
    assert found(topk.nearest_exact(two, ask)) == [(1, 1, 2, 128 * 64), (1, 2, 3, 128 * -2304 - 128 * 1024)]
    large = spark.createDataFrame([(1, [3e6, 1.0], 1, "x"), (2, [2.5e6, -3.0], 1, "x")], VECTORS)  # past whole doubles
    assert found(topk.nearest_exact(large, large.withColumnRenamed("vec_id", "query_id")))[0] == (1, 1, 2, 768_000_000 * 640_000_000 - 256 * 768)
    with pytest.raises(ValueError):
        huge = spark.createDataFrame([(1, [3e30], 1, "x"), (2, [2e30], 1, "x")], VECTORS)
        topk.nearest_exact(huge, huge.withColumnRenamed("vec_id", "query_id"))


# -- vector codes


def codes_by_force(rows, parts=4, entries=256, rounds=4, scale=1024):
    """Plain Lloyd: every part against every entry."""
    x = np.array([[math.floor(scale * c) for c in np.array(v, dtype=np.float32).astype(float)] for _, v, _ in rows], dtype=np.int64)
    order = sorted(range(len(rows)), key=lambda r: (rows[r][0] is None, rows[r][0] or 0, x[r].tolist()))[:entries]
    x = x.reshape(len(rows), parts, -1)
    books = x[order].transpose(1, 0, 2).copy()
    nearest = lambda p: ((x[:, p, None, :] - books[p][None]) ** 2).sum(-1)
    for _ in range(rounds):
        for p in range(parts):
            own = nearest(p).argmin(axis=1)
            for e in range(len(books[p])):
                if (own == e).any():
                    books[p, e] = x[own == e, p].sum(axis=0) // (own == e).sum()
    far = np.stack([nearest(p) for p in range(parts)], axis=1)
    code, error = far.argmin(axis=2), far.min(axis=2).sum(axis=1)
    label = {}
    for r, e in zip(rows, error):
        label[r[2]] = label.get(r[2], 0) + int(e)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return sorted((str(r[0]), "".join(f"{c:02x}" for c in own), int(e), label[r[2]], digest) for r, own, e in zip(rows, code, error))


def coded(df):
    return sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect())


def test_filtering_gives_what_comparing_all_gives():
    """Ties too: few whole values, repeated points, repeated entries."""
    rng = np.random.default_rng(4)
    for n, width, entries, spread in ((1, 3, 1, 5), (400, 1, 9, 3), (900, 2, 40, 4), (1500, 3, 25, 60), (700, 8, 64, 1000)):
        points, books = rng.integers(-spread, spread + 1, (n, width)), rng.integers(-spread, spread + 1, (entries, width))
        tree = veccodes.Tree.of(points, leaf=5)
        again = veccodes.Tree.unpacked(tree.packed(), width)
        far = ((points[:, None] - books[None]) ** 2).sum(-1)
        code, error = again.codes(books)
        assert (code == far.argmin(axis=1)).all() and (error == far.min(axis=1)).all()
        total, count = again.sums(books)
        assert (count == np.bincount(code, minlength=entries)).all()
        assert (total == np.stack([points[code == e].sum(axis=0) for e in range(entries)])).all()


def test_whole_subtrees_are_assigned_at_once():
    """Two far clusters: a node of each goes to its entry without a look at its points."""
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.integers(0, 50, (500, 3)), rng.integers(10_000, 10_050, (500, 3))])
    tree = veccodes.Tree.of(points)
    nodes = list(tree.nearest(np.array([[25, 25, 25], [10_025, 10_025, 10_025], [500_000, 0, 0]])))
    assert len(nodes) == 2 and sorted(int(e[0]) for _, e in nodes) == [0, 1] and all(len(e) == 1 for _, e in nodes)


def test_codes_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(veccodes, "CHUNK", 64)
    rng = np.random.default_rng(6)
    rows = [(int(i), [float(v) for v in rng.normal(0, 0.1, 8)], None if i % 7 == 0 else int(i % 3)) for i in rng.permutation(500)]
    rows += [rows[0], rows[0], (3, rows[9][1], 1), (None, rows[4][1], None), (None, rows[5][1], 2)] + [(1000 + i, rows[11][1], 0) for i in range(60)]
    bad = [(2000, None, 1), (2001, [], 1), (2002, [None] * 8, 1), (2003, [float("nan")] * 8, 1), (2004, [float("-inf")] * 8, 1), (2005, [0.5] * 4, 1)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in [*rows, *bad]], "vec_id long, vector array<float>, label int, code string, part int")
    for partitions in (1, 5):
        assert coded(veccodes.compressed(frame.repartition(partitions))) == codes_by_force(rows)
    assert coded(veccodes.compressed(frame, entries=16, rounds=2, parts=2)) == [(a, code[1::2], *rest) for a, code, *rest in codes_by_force(rows, 2, 16, 2)]


def test_code_edges(spark):
    schema = "vec_id long, vector array<float>, label int"
    few = [(2, [0.1, 0.2, -0.3, 0.4], None), (1, [0.1, 0.2, -0.3, 0.4], None), (3, [0.0, -0.0, 0.5, 0.25], 1)]
    assert coded(veccodes.compressed(spark.createDataFrame(few, schema))) == codes_by_force(few)
    assert coded(veccodes.compressed(spark.createDataFrame([], schema))) == []
    assert coded(veccodes.compressed(spark.createDataFrame([(1, None, 1), (2, [float("nan")], 1)], schema))) == []
    with pytest.raises(ValueError):
        veccodes.compressed(spark.createDataFrame([(1, [0.1, 0.2, 0.3], 1)], schema))
    with pytest.raises(ValueError):
        veccodes.compressed(spark.createDataFrame([(1, [1e30, 0.2, 0.3, 0.4], 1)], schema))


def test_queries_read_whole_tables(spark, small):
    n = spark.read.parquet(f"{small}/embeddings.parquet").count()
    assert queries.op13_filtering_lloyd(spark, small).count() == n
    assert queries.op12_exact_top_k(spark, small).groupBy("query_id").count().where("count <> 5").isEmpty()
