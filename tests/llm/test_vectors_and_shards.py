"""Vector codes, whitening and sharding against brute force, with nulls, ties, repeats, huge values and empty tables."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from airlake.llm import sharding, vector_codes, whitening

VECTORS = "vec_id long, embedding array<{}>, label int, part int, entry int, at int, s int, n long, w long, row long"


def table(spark, rows, kind="double"):
    """rows: (vec_id, vector, label); columns with the operators' own names are added."""
    return spark.createDataFrame([(*r, *[7] * 7) for r in rows], VECTORS.format(kind)).repartition(3)


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def ints(v, width):
    return [math.floor(1024 * max(-(2.0**52), min(2.0**52, x))) for x in v] + [0] * (width - len(v))


def brute_codes(rows, rounds=4):
    kept = [r for r in rows if good(r[1])]
    width = -(-max((len(r[1]) for r in kept), default=0) // 4) * 4
    m = width // 4
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    parts = [[ints(r[1], width)[p * m : p * m + m] for p in range(4)] for r in kept]
    books = [[x[p] for x in parts[:256]] for p in range(4)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(4):
            members = defaultdict(list)
            for x in parts:
                members[near(p, x[p])[1]].append(x[p])
            books[p] = [[sum(c) // len(c) for c in zip(*members[k])] if k in members else e for k, e in enumerate(books[p])]
    out, by_label = [], defaultdict(list)
    for (i, _, label), x in zip(kept, parts):
        best = [near(p, x[p]) for p in range(4)]
        error = sum(b[0] for b in best)
        by_label[label].append(error)
        out.append([i, "".join(f"{b[1]:02x}" for b in best), error, label])
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    for row in out:
        total = sum(by_label[row[3]])
        row[3] = total if total < 2**63 and max(by_label[row[3]]) < 2**63 else None
        row[2] = row[2] if row[2] < 2**63 else None
    return sorted(map(repr, ([*r, digest] for r in out)))


def some_vectors(seed, n, width, scale=1.0):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, scale) for _ in range(width)], rng.choice([0, 1, None])) for i in range(n)]
    rows += [(5, rows[5][1], 0), (5, rows[6][1], 1), (None, rows[7][1], None), (n, None, 1), (n + 1, [math.nan] * width, 1), (n + 2, [None] * width, 1), (n + 3, [math.inf] * width, 0), (n + 4, [0.0] * width, 2)]
    return rows


@pytest.mark.parametrize("n,width,scale", [(330, 8, 0.02), (60, 6, 1.0), (12, 20, 1e9), (12, 8, 1e300)])
def test_codes_equal_brute_force(spark, n, width, scale):
    rows = some_vectors(n, n, width, scale)
    rows.append((n + 5, rows[0][1][:3], 1))  # shorter: ends in zeros
    got = vector_codes.compress_vectors(table(spark, rows)).collect()
    assert sorted(repr(list(r)) for r in got) == brute_codes(rows)


def test_equal_entries_go_to_the_lower_index(spark):
    rows = [(i, [float(i % 3)] * 4, 0) for i in range(300)]
    got = {r["vec_id"]: r for r in vector_codes.compress_vectors(table(spark, rows, "float")).collect()}
    assert {got[i]["code"] for i in range(300)} == {"00000000", "01010101", "02020202"} and got[299]["code"] == "02020202" and got[0]["label_error"] == 0


def test_vector_operators_on_empty_tables(spark):
    for rows in ([], [(1, None, 0), (2, [math.nan], 1)], [(1, [], 0)]):
        codes = vector_codes.compress_vectors(table(spark, rows)).collect()
        assert [tuple(r)[:4] for r in codes] == ([(1, "00000000", 0, 0)] if rows and rows[0][1] == [] else [])
        white = whitening.whiten(table(spark, rows))
        assert white.count() == 0 and white.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


@pytest.mark.parametrize("width", [1, 2, 3, 16, 33])
def test_transform_keeps_distances_and_sequency(width):
    order = vector_codes.sequency_order(width)
    size = len(order)
    basis = vector_codes.transform(np.eye(size, dtype=np.int64), order).T
    assert [(b[1:] != b[:-1]).sum() for b in basis] == list(range(size))
    rng = np.random.default_rng(width)
    for top in (5, 3000, 2**40, 2**61):
        entries = rng.integers(-top, top, (30, width))
        entries[9] = entries[4]
        parts = np.r_[rng.integers(-top, top, (40, width)), entries]
        index, scaled = vector_codes.nearest(vector_codes.transform(parts, order), vector_codes.transform(entries, order))
        for x, k, d in zip(parts.tolist(), index, scaled):
            apart = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in entries.tolist()]
            assert (apart.index(min(apart)), min(apart) * size) == (k, int(d))


@pytest.mark.parametrize("name", ["random", "equal values", "clusters", "rank one", "zero", "large"])
def test_components_of_symmetric_matrices(name):
    rng = np.random.default_rng(4)
    turn, _ = np.linalg.qr(rng.standard_normal((24, 24)))
    spectrum = np.r_[[5, 5, 5, 5 - 1e-9, 5 - 1e-12, 2, 2, 1], rng.random(16)]
    x = rng.standard_normal((50, 24)) * rng.random(24) * 100
    a = {
        "random": x.T @ x, "equal values": np.diag(np.r_[np.full(6, 3.0), np.arange(10.0)]), "clusters": (turn * spectrum) @ turn.T,
        "rank one": np.outer(x[0], x[0]), "zero": np.zeros((3, 3)), "large": np.array([[2.0, 1.0], [1.0, 2.0]]) * 1e30,
    }[name]
    a = (a + a.T) / 2
    k, scale = min(8, len(a)), np.abs(a).max() or 1.0
    values, axes = whitening.leading_components(a, k)
    assert np.abs(values - np.linalg.eigvalsh(a)[::-1][:k]).max() < 1e-12 * scale
    assert np.abs(axes @ axes.T - np.eye(k)).max() < 1e-12 and np.abs(a @ axes.T - axes.T * values).max() < 1e-12 * scale


@pytest.mark.parametrize("n,width,scale", [(90, 12, 0.3), (40, 3, 2.0), (30, 10, 1e12)])
def test_whitening_equals_numpy(spark, n, width, scale):
    rows = some_vectors(n, n, width, scale)
    rows.append((n + 5, rows[0][1][:2], 1))
    kept = [r for r in rows if good(r[1])]
    x = [[v + 100_000 for v in ints(r[1], width)] for r in kept]
    count, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((count * v - s) ** 2 for v, s in zip(row, sums)) for row in x]
    d = np.array([[(count * v - s) / count for v, s in zip(row, sums)] for row in x])
    covariance = d.T @ d / count
    values, axes = np.linalg.eigh(covariance)
    k = min(8, width)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    want = d @ axes / np.sqrt(values)
    got = whitening.whiten(table(spark, rows)).collect()
    assert len(got) == k * len(kept) and {r["n"] for r in got} == {len(kept)} and Counter(r["vec_id"] for r in got)[5] == 3 * k
    by = defaultdict(dict)
    for r in got:
        by[r["component"]].setdefault(r["vec_id"], []).append(r)
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / np.trace(covariance), rel=1e-9) and 0 <= r["identity_error"] < 1e-9
    at = {r[0]: j for j, r in enumerate(kept) if r[0] != 5}
    for c in range(k):
        mine = np.array([by[c + 1][i][0]["whitened"] for i in at])
        theirs = want[list(at.values()), c]
        assert np.abs(mine * np.sign(mine @ theirs) - theirs).max() < 1e-7
    for i, j in at.items():
        assert by[1][i][0]["deviation"] == (deviation[j] if deviation[j] < 2**63 else None)


def test_whitening_without_variance(spark):
    one = whitening.whiten(table(spark, [(1, [0.5, 2.0], 0)])).collect()
    assert [tuple(r) for r in one] == [(1, 1, 1, 0, None, 0.0, 0.0), (1, 2, 1, 0, None, 0.0, 0.0)]
    line = whitening.whiten(table(spark, [(i, [float(i), 2.0 * i, 0.0], 0) for i in range(9)])).collect()
    assert all((r["whitened"] is None) == (r["component"] > 1) and r["identity_error"] < 1e-9 for r in line)


def brute_tree(rows, shards):
    """rows: (doc_id, text, lang, source), in table order; shard of each row."""
    size = [len((r[1] or "").encode()) + 1 for r in rows]

    def codes(column):
        names = [r[column] for r in rows if r[column] is not None]
        low, high = (min(names).encode(), max(names).encode()) if names else (b"", b"")
        shared = next((i for i, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))
        return [-1 if r[column] is None else int.from_bytes(r[column].encode()[shared : shared + 7].ljust(7, b"\0"), "big") for r in rows]

    dims = list(zip(codes(3), codes(2), size, [-1 if r[0] is None else r[0] for r in rows]))
    extent = lambda ids, d: max(dims[i][d] for i in ids) - min(dims[i][d] for i in ids)
    whole = [max(1, extent(range(len(rows)), d)) for d in range(4)]
    out = {}

    def split(ids, first, k):
        if k == 1 or not ids:
            out.update(dict.fromkeys(ids, first))
            return
        shares = [extent(ids, d) / whole[d] for d in range(4)]
        axis = shares.index(max(shares))
        ids = sorted(ids, key=lambda i: (dims[i][axis], -(2**63) if rows[i][0] is None else rows[i][0], i))
        total, run, left = sum(size[i] for i in ids), 0, []
        for i in ids:
            if (2 * run + size[i]) * k < 2 * total * (k // 2):
                left.append(i)
            run += size[i]
        split(left, first, k // 2)
        split(ids[len(left) :], first + k // 2, k - k // 2)

    split(list(range(len(rows))), 0, shards)
    return out


def shard_rows(seed, n):
    rng = random.Random(seed)
    texts = ["copy of a text " * 5, None, "", "é漢字😀", "w" * 9000]
    return [
        (rng.choice([i, i, 7, None]), rng.choice([*texts, "".join(rng.choice("ab ") for _ in range(rng.randint(1, 400)))]), rng.choice(["en", "de", None]), rng.choice(["host/a", "host/a", "host/b", "host/zz", None]))
        for i in range(n)
    ]


@pytest.mark.parametrize("n,shards", [(300, 8), (150, 5), (40, 1), (3, 8), (0, 8)])
def test_shards_equal_brute_force(spark, n, shards):
    rows = shard_rows(n, n)
    docs = spark.createDataFrame([(*r, "x", 1, 2, 3, 4) for r in rows], "doc_id long, text string, lang string, source string, node string, row int, size int, slot int, shard int").coalesce(1)
    got = sharding.kd_shards(docs, shards).collect()
    where = brute_tree(rows, shards) if rows else {}
    facts = lambda i, t: (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    want = Counter((*facts(r[0], r[1]), where[k]) for k, r in enumerate(rows))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"]) for r in got) == want
    for s in {r["shard"] for r in got}:
        members = sorted((r for r in got if r["shard"] == s), key=lambda r: r["slot"])
        assert [r["slot"] for r in members] == list(range(len(members)))
        assert [r["doc_id"] or -1 for r in members] == sorted(r["doc_id"] or -1 for r in members)


def test_hot_rows_are_cut_evenly(spark):
    """A third of all rows share one source, and a third of these are one row over and over."""
    rows = [(1, "same text", "en", "hot")] * 400 + [(k, f"text {k:05}", "en", "hot") for k in range(800)] + [(1000 + k, f"text {k:05}", "de", f"s{k % 9}") for k in range(2400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(6)
    for shards, target in ((8, None), (1, 5000)):
        sizes = Counter()
        for r in sharding.kd_shards(docs, shards, target_bytes=target).collect():
            sizes[r["shard"]] += r["size"]
        assert len(sizes) == (8 if target is None else -(-sum(sizes.values()) // 5000)) and max(sizes.values()) - min(sizes.values()) <= 3 * 11


def test_shards_by_numbers_and_missing_dimensions(spark):
    docs = spark.createDataFrame([(k, "t" * 9, v) for k, v in enumerate([None, math.nan, -2.5, 0.0, 1e300, -1e300, 3.0, 4.0])], "doc_id long, text string, score double")
    got = {r["doc_id"]: r["shard"] for r in sharding.kd_shards(docs, 2, ("score",)).collect()}
    assert {k for k, s in got.items() if s == 0} == {5, 2, 0, 1}
    constant = sharding.kd_shards(docs.withColumn("c", F.lit(None).cast("string")), 4, ("c",)).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in constant) == [2, 2, 2, 2]
