import itertools
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from fixtures_llm import CLASH, WORD, docs, rows
from skein.llm import common, filter_audit, sharding, whitening

ROW = common.ROW


def got(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


# ---- 11 -----------------------------------------------------------------------
def brute_jump(key, shards):
    """The published loop, one key at a time."""
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_equals_the_published_loop():
    r = random.Random(4)
    keys = [0, 1, -1, (1 << 63) - 1, -(1 << 63), *[r.getrandbits(63) for _ in range(500)]]
    for n in (1, 2, 24, 25, 1000):
        out = sharding.jump(np.array(keys, np.int64).view(np.uint64), n)
        assert out.tolist() == [brute_jump(k, n) for k in keys]
    with pytest.raises(ValueError):
        sharding.jump(np.zeros(1, np.uint64), 0)


def test_sharding_brute(spark):
    data = rows()
    a = sharding.assign(docs(spark, clash=True), 7)
    want, slots = [], {}
    for d in data:
        t = (d[1] or "").encode()
        want.append((brute_jump(d[0] or 0, 7), -1 if d[0] is None else d[0], len(t) + 8, zlib.crc32(t), d[0], brute_jump(d[0] or 0, 8)))
    out = []
    for shard, _, size, crc, i, grown in sorted(want, key=lambda w: w[:4]):
        slots[shard] = slots.get(shard, -1) + 1
        out.append((i, size, crc, shard, slots[shard], grown))
    assert got(a, f"{ROW}.doc_id", "size", "text_crc32", "shard", "slot", "grown_shard") == sorted(out, key=repr)
    assert all(g in (s, 7) for *_, s, _, g in out) and any(g == 7 for *_, g in out)
    assert {r["grown_shard"] for r in sharding.moves(a).collect()} == {7}
    assert a.select(f"{ROW}.*").columns[5:] == CLASH
    assert sharding.assign(docs(spark, data=[]), 7).count() == 0


def test_sharding_keeps_groups_of_a_text_key(spark):
    d = docs(spark).withColumn("digest", F.md5(F.coalesce("text", F.lit(""))))
    a = sharding.assign(d, 5, key="digest")
    assert a.groupBy("key").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0
    shards = a.groupBy("shard").agg(F.min("slot"), F.max("slot"), F.count("*"), F.countDistinct("slot")).collect()
    assert len(shards) > 1 and all(r[1] == 0 and r[2] + 1 == r[3] == r[4] for r in shards)


def test_sharding_one_key_for_most_rows(spark):
    """Repeated rows are numbered over several partitions, each slot once."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        data = [(5, "same", "en", "s", 1)] * 4000 + [(i, f"t{i}", "en", "s", 1) for i in range(500)]
        a = common.store(sharding.assign(docs(spark, data=data), 3), "test-shards")
        hot = a.where("key = 5")
        assert hot.select("slot").distinct().count() == hot.count()
        n = a.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m")).collect()
        assert all(r["n"] == r["d"] == r["m"] + 1 for r in n)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_shards_are_written_whole(spark):
    path = common.scratch_path(spark, "test-shards")
    sharding.write(docs(spark), path, 4, file_rows=10)
    back = spark.read.parquet(path)
    assert got(back, "doc_id", "text") == got(docs(spark), "doc_id", "text")
    a = sharding.assign(docs(spark), 4)
    assert got(back, "__shard", "__slot", "doc_id") == got(a, "shard", "slot", f"{ROW}.doc_id")


# ---- 12 -----------------------------------------------------------------------
def brute_audit(data, labels):
    text = {}
    for i, t, *_ in data:
        if i is not None:
            text[t or ""] = min(text.get(t or "", i), i)
    kinds = []
    for i, t, lang, *_ in data:
        t = t or ""
        w = WORD.findall(t)
        fails = {x for x, bad in zip("ABCDE", (
            len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
            any(c in "#$%&*|" for c in t), i is not None and text[t] < i)) if bad}
        said = [x for x in labels if x[0] == i and i is not None]
        kinds.append((lang or "", fails, any(x[1] == 1 for x in said), any(x[2] == 1 for x in said)))
    out, worth = {}, {}
    for part in {k[0] for k in kinds}:
        for order in itertools.permutations("ABCDE"):
            left = [k for k in kinds if k[0] == part]
            every = left
            for s, f in enumerate(order):
                gone = [k for k in left if f in k[1]]
                left = [k for k in left if f not in k[1]]
                worth[part, f] = worth.get((part, f), 0) + len(gone)
                out[part, "".join(order), s + 1] = (
                    len(left), len(gone), sum(f in k[1] for k in every) - len(gone), sum(k[1] == {f} for k in every),
                    sum(k[2] for k in gone), sum(k[3] for k in gone))
    return sorted((*k, *v, worth[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def test_audit_brute(spark):
    r = random.Random(8)
    data = rows()
    data += [(1000 + i, " ".join(r.choice("ABCDEabcdefghijkl") * r.randrange(1, 4) for _ in range(r.randrange(60, 160)))
              + r.choice(["", " #", " |"]), r.choice(["en", "de", None, ""]), "s", 1) for i in range(40)]
    data += [(r.randrange(2000), d[1], *d[2:]) for d in data[-20:]]
    data += [(3000, "long " * 40000 + "É" * 9, "en", "s", 1)]
    labels = [(d[0], r.choice([0, 1, None]), r.choice([0, 1])) for d in data if r.random() < .6] + [(None, 1, 1), (0, 1, 0), (0, 0, 1)]
    lab = spark.createDataFrame([(*x, "extra") for x in labels], "doc_id bigint, quality int, toxic int, fails string")
    out = filter_audit.audit(docs(spark, clash=True, data=data), lab)
    assert sorted(tuple(x) for x in out.collect()) == brute_audit(data, labels)
    assert filter_audit.audit(docs(spark, data=[]), lab).count() == 0
    none = filter_audit.audit(docs(spark), lab.limit(0))
    assert none.agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)


def test_removal_steps_are_the_min_plus_product():
    r = np.random.RandomState(0)
    masks = np.where(r.rand(9, 4) < .5, 0.0, np.inf)
    pos = np.argsort(np.array(list(itertools.permutations(range(4)))), axis=1)
    want = [[min(masks[i, f] + pos[o, f] for f in range(4)) for o in range(len(pos))] for i in range(9)]
    assert np.array_equal(filter_audit.removal_steps(masks, pos), np.array(want))


# ---- 13 -----------------------------------------------------------------------
DDL = "vec_id bigint, embedding array<float>, x string, c string, label int"


def vectors(seed=3, n=80, d=20):
    r = np.random.RandomState(seed)
    base = r.randn(n, d) @ np.diag(np.linspace(2, .05, d)) + 5 * r.randn(d)
    data = [(i, [float(np.float32(x)) for x in v], "x", "c", 1) for i, v in enumerate(base)]
    data += [(900 + i, data[-1 + min(8, n)][1], "x", "c", 1) for i in range(200)] + [data[0]]        # copies, a repeated row
    odd = [None, [], [None] * d, [math.nan] + [0.0] * (d - 1), [math.inf] + [0.0] * (d - 1), [1.0] * (d + 1),
           [float(np.float32(1e30))] + [0.0] * (d - 1)]
    return data, data + [(2000 + i, v, None, None, None) for i, v in enumerate(odd)] + [(None, data[3][1], None, None, None)]


def test_whitening_brute(spark):
    good, data = vectors()
    good = good + [data[-1]]
    df = spark.createDataFrame(data, DDL)
    out = whitening.whiten(df, carry=df.columns).select(f"{ROW}.*", "component", "n", "deviation", "whitened", "explained", "identity_error")
    assert out.columns[:5] == df.columns
    out = out.collect()
    x = np.floor(np.array([g[1] for g in good]) * 64).astype(np.int64) + 1000000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    y = np.array([[float(Fraction(int(v) * n - int(t), n)) for v, t in zip(row, s)] for row in x])
    c = np.unique(y, axis=0)
    values, parts = np.linalg.eigh(c.T @ c / n)
    values, parts = values[::-1][:16], parts[:, ::-1][:, :16]
    z = y @ parts / np.sqrt(values)
    share = values / np.trace(c.T @ c / n)
    assert len(out) == 16 * len(good) and {r["n"] for r in out} == {n}
    assert all(r["identity_error"] < 1e-10 for r in out)
    want = {}
    for g, row, v in zip(good, x, z):
        want[g[0]] = (sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)), v)
    sign = {}
    for r in out:
        d, v = want[r["vec_id"]]
        k = r["component"] - 1
        assert r["deviation"] == d and abs(r["explained"] / share[k] - 1) < 1e-9
        assert abs(abs(r["whitened"]) - abs(v[k])) < 1e-7
        if abs(v[k]) > 1e-6:
            assert sign.setdefault(k, np.sign(r["whitened"] * v[k])) == np.sign(r["whitened"] * v[k])


def test_whitening_of_little(spark):
    good, data = vectors(n=4, d=6)
    ranks = whitening.whiten(spark.createDataFrame(good, DDL))
    assert {r[0] for r in ranks.select("component").collect()} == {1, 2, 3}        # four points span three dimensions
    same = spark.createDataFrame([g for g in good if g[0] >= 900], DDL)
    assert whitening.whiten(same).count() == 0
    assert whitening.whiten(same.limit(0)).count() == 0
    assert whitening.whiten(same.limit(0)).columns == ranks.columns


def test_deviation_is_exact_beyond_doubles():
    c = whitening.Centre(3, [10, 1 << 60, 7])
    x = np.array([[3, 1 << 50, 2], [1 << 20, 5, 1]])
    exact = [sum((3 * int(v) - s) ** 2 for v, s in zip(row, [10, 1 << 60, 7])) for row in x]
    assert c.deviation(x) == [e if e < 1 << 63 else None for e in exact]
    c = whitening.Centre(5, [10, 12])
    assert c.deviation(np.array([[2, 3], [0, 9]])) == [0 + 9, 100 + 33 ** 2]


def test_jacobi_finds_small_eigenvalues():
    r = np.random.RandomState(2)
    q, _ = np.linalg.qr(r.randn(30, 30))
    want = np.logspace(0, -9, 30)
    values, parts = whitening.jacobi(whitening.pivoted_cholesky(q @ np.diag(want) @ q.T))
    assert np.allclose(values, want, rtol=1e-5) and np.allclose(parts.T @ parts, np.eye(30), atol=1e-12)
    for m in (1, 2, 5, 8):
        seen = sorted((a, b) for p, q in whitening.pairings(m) for a, b in zip(p.tolist(), q.tolist()))
        assert seen == sorted(itertools.combinations(range(m), 2))
