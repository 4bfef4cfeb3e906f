import numpy as np
import pytest
from pyspark.sql import functions as F

from galleryspark.operators import contours as T, raster as R


def pages(spark, *masks):
    rows = [(i, int(y), int(x), bool(v)) for i, mask in enumerate(masks) for (y, x), v in np.ndenumerate(np.asarray(mask))]
    return spark.createDataFrame(rows, "image_id bigint, y int, x int, fg boolean")


def square(size, outer, inner=None):
    page = np.zeros((size, size), bool)
    page[outer[0] : outer[1], outer[0] : outer[1]] = True
    if inner:
        page[inner[0] : inner[1], inner[0] : inner[1]] = False
    return page


def brute_depths(mask):
    """node -> depth, by flooding pieces from the outside of a padded page: each border crossed is one outline."""
    page = np.pad(mask, 1)
    name, depth, starts = {}, {}, {}

    def flood(start):
        ink, stack, seen = page[start], [start], {start}
        around = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (ink or not (a and b))]
        while stack:
            y, x = stack.pop()
            for a, b in around:
                p = (y + a, x + b)
                if 0 <= p[0] < page.shape[0] and 0 <= p[1] < page.shape[1] and p not in seen and page[p] == ink:
                    seen.add(p)
                    stack.append(p)
        return seen

    for p in np.ndindex(page.shape):
        if p not in name:
            for q in flood(p):
                name[q] = p
    links = {}
    for (y, x), n in name.items():
        for q in ((y + 1, x), (y, x + 1)):
            if q in name and name[q] != n:
                links.setdefault(n, set()).add(name[q])
                links.setdefault(name[q], set()).add(n)
    depth, front = {(0, 0): -1}, [(0, 0)]
    while front:
        n = front.pop()
        for m in links.get(n, ()):
            if m not in depth:
                depth[m] = depth[n] + 1
                front.append(m)
    return {(y - 1) * R.ROW_STRIDE + x - 1: d for (y, x), d in depth.items() if (y, x) != (0, 0)}


def test_areas_and_depths_known_by_hand(spark):
    dotted = square(11, (1, 10), (2, 9))
    dotted[5, 5] = True
    nested = square(11, (0, 11), (1, 10)) | square(11, (2, 9), (3, 8)) | square(11, (5, 6))
    df = pages(spark, square(7, (1, 6)), square(5, (1, 4), (2, 3)), dotted, np.zeros((3, 3)), nested, np.ones((4, 4)))
    tree = T.contour_tree(df, tile=4)
    got = {}
    for r in tree.orderBy("image_id", "depth").collect():
        got.setdefault(r.image_id, []).append((r.ink, r.depth, r.area, r.parent is None))
    assert got == {
        0: [(True, 0, 16.0, True)],
        1: [(True, 0, 4.0, True), (False, 1, 2.0, False)],  # the inner outline is a diamond
        2: [(True, 0, 64.0, True), (False, 1, 62.0, False), (True, 2, 0.0, False)],
        4: [(True, 0, 100.0, True), (False, 1, 98.0, False), (True, 2, 36.0, False), (False, 3, 34.0, False), (True, 4, 0.0, False)],
        5: [(True, 0, 9.0, True)],
    }
    stats = {r.image_id: r for r in T.contour_stats(tree, df).collect()}
    assert (stats[3].n_contours, stats[3].max_depth, stats[3].mean_contour_area, stats[3].std_contour_area) == (0, 0, 0.0, 0.0)
    assert stats[4].max_depth == 4 and stats[4].n_contours == 5
    assert stats[4].mean_contour_area == pytest.approx(67.0)  # the dot has no area and does not count
    assert stats[4].std_contour_area == pytest.approx(np.std([100, 98, 36, 34]))


def test_random_pages_against_flooding_and_any_tile(spark):
    rng = np.random.default_rng(1)
    masks = [rng.random((h, w)) < share for h, w, share in ((9, 14, 0.4), (13, 8, 0.6), (12, 12, 0.75), (1, 9, 0.5))]
    df = pages(spark, *masks)
    small = T.contour_tree(df, tile=5).collect()
    large = T.contour_tree(df, tile=64).collect()
    assert sorted(map(str, small)) == sorted(map(str, large))
    for i, mask in enumerate(masks):
        assert {r.node: r.depth for r in small if r.image_id == i} == brute_depths(mask)
    # Outermost outlines are the ink that fills hold: nothing inside is larger than what is around it.
    area = {(r.image_id, r.node): r.area for r in small}
    assert all(r.area <= area[r.image_id, r.parent] for r in small if r.parent is not None)


def test_empty_table(spark):
    assert T.contour_tree(pages(spark, np.zeros((2, 2))).where(F.lit(False))).count() == 0


def test_complexity_counts_the_depth(spark):
    df = pages(spark, square(5, (1, 4), (2, 3)))
    depth = T.contour_stats(T.contour_tree(df), df).select("image_id", F.col("max_depth").alias("depth"))
    row = R.topology_features(df.where("fg"), depth).first()
    assert (row.beta_0, row.beta_1, row.complexity) == (1, 1, 4)
