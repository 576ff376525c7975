"""Large regions of the Jaccard join: bitmaps before texts, and no merging of
regions that have only a few points in common."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein.llm import common, jaccard

ROWS = "region bigint, x bigint, n bigint, weight bigint"


def test_maps_tell_a_least_difference():
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 63, 3000).astype(np.uint64)
    sets = [np.unique(r.choice(base, k)) for k in (1, 5, 40, 300, 310, 1500, 2900)]
    maps = jaccard.Maps(pa.array([jaccard.bitmap(s, 80) for s in sets], pa.binary()))
    i, j = (a.ravel() for a in np.indices((len(sets), len(sets))))
    got, far = maps.differ(i, j), [len(np.setxor1d(sets[a], sets[b])) for a, b in zip(i, j)]
    assert all(g <= f for g, f in zip(got, far)) and all(got[i == j] == 0)
    whole = maps.folded(1)[:, 0]
    assert all(int(a ^ b).bit_count() <= g for a, b, g in zip(whole[i], whole[j], got))


def test_families_merge_only_regions_of_the_same_points(spark):
    rows = [(1, x, 9, 1) for x in range(1, 9)] + [(2, x, 9, 1) for x in range(1, 10)]     # a family
    rows += [(3, x, 9, 1) for x in [20, *range(30, 38)]] + [(4, x, 9, 1) for x in [20, *range(40, 48)]]
    rows += [(5, x, 9, 1) for x in [37, *range(50, 58)]]
    got = jaccard.families(spark.createDataFrame(rows, ROWS)).groupBy("region").agg(
        F.sort_array(F.collect_list("x")).alias("x"), F.max("m").alias("m")).collect()
    assert sorted((r["x"], r["m"]) for r in got) == sorted([
        (list(range(1, 10)), 9), ([20, *range(30, 38)], 9), ([20, *range(40, 48)], 9), ([37, *range(50, 58)], 9)])


def test_unlike_points_of_a_large_region_need_no_texts(spark, monkeypatch):
    """All texts share a long word, and nothing else; two are alike."""
    asked = []

    def counted(self, pairs, real=jaccard.Links.overlaps):
        asked.append(pairs.count())
        return real(self, pairs)
    monkeypatch.setattr(jaccard.Links, "overlaps", counted)
    r, long = random.Random(1), "w" * 70
    data = [(i, " ".join([long] + ["%08x" % r.getrandbits(32) for _ in range(40)])) for i in range(60)]
    data.append((60, data[7][1] + " end"))
    got = jaccard.components(spark.createDataFrame(data, "doc_id bigint, text string"), 1, 90, small=4)
    assert {x["doc_id"]: x["component_id"] for x in got.collect()} == {i: 7 if i == 60 else i for i in range(61)}
    assert sum(asked) < 10


@pytest.mark.parametrize("chunk", [5, 4096])
def test_voronoi_keeps_similar_points_together(spark, monkeypatch, chunk):
    """Each similar pair without a pivot shares a cell; those with one are linked."""
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    r = random.Random(2)
    centre = [r.getrandbits(63) for _ in range(100)]
    sets = {x: np.array(sorted(set(centre[r.randrange(14):] + [r.getrandbits(63) for _ in range(r.randrange(9))])), np.uint64)
            for x in range(40)}
    heads = spark.createDataFrame([(x, len(s), bytearray(jaccard.bitmap(s, 80))) for x, s in sets.items()],
                                  "x bigint, n bigint, bits binary")
    members = spark.createDataFrame([(1, x, len(s), 1, len(sets)) for x, s in sets.items()], ROWS + ", m bigint")
    common.prepare(spark)

    class Kept(jaccard.Links):
        def settle(self, pairs):
            self.pairs = {tuple(p) for p in pairs.collect()}
    links = Kept(None, 1, 80)
    cells = {}
    for c in jaccard.voronoi(members, heads, links, 80).collect():
        cells.setdefault(c["region"], set()).add(c["x"])
    for x in sets:
        for y in range(x):
            inter = len(np.intersect1d(sets[x], sets[y]))
            if 100 * inter >= 80 * (len(sets[x]) + len(sets[y]) - inter):
                assert (x, y) in links.pairs or (y, x) in links.pairs or any({x, y} <= c for c in cells.values())
