import numpy as np
import pytest
from pyspark.sql import functions as F

from galleryspark.operators import embedding as N, ordering, raster as R
from galleryspark.plans import fixtures


def pixels(spark, *pages):
    rows = [(i, int(y), int(x), int(v)) for i, page in enumerate(pages) for (y, x), v in np.ndenumerate(np.asarray(page))]
    return spark.createDataFrame(rows, "image_id bigint, y int, x int, v int")


def ink(spark, *pages):
    rows = [(i, int(y), int(x)) for i, page in enumerate(pages) for y, x in zip(*np.nonzero(np.asarray(page)))]
    return spark.createDataFrame(rows, "image_id bigint, y int, x int")


def brute_labels(mask, connectivity):
    root = {}
    for start in zip(*np.nonzero(mask)):
        if start in root:
            continue
        stack = [start]
        while stack:
            y, x = p = stack.pop()
            if p in root or not (0 <= y < mask.shape[0] and 0 <= x < mask.shape[1]) or not mask[p]:
                continue
            root[p] = start[0] * R.ROW_STRIDE + start[1]
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    if connectivity == 8 or abs(dy) + abs(dx) == 1:
                        stack.append((y + dy, x + dx))
    return root


SPIRAL = np.array([[1] * 11, [0] * 10 + [1], [1] * 9 + [0, 1], [1] + [0] * 7 + [1, 0, 1], [1, 0] + [1] * 5 + [0, 1, 0, 1], [1, 0, 1, 0, 0, 0, 0, 0, 1, 0, 1], [1, 0, 1] + [1] * 6 + [0, 1], [1] + [0] * 9 + [1], [1] * 11])
RING = np.array([[1, 1, 1], [1, 0, 1], [1, 1, 1]])


@pytest.mark.parametrize("connectivity", [4, 8])
@pytest.mark.parametrize("tile", [256, 4, 3])
def test_labels_match_flood_fill(spark, connectivity, tile):
    noise = np.random.default_rng(2).random((17, 19)) < 0.5
    pages = [noise, SPIRAL.astype(bool), np.eye(9, dtype=bool), np.zeros((2, 2), dtype=bool)]
    got = R.label_components(ink(spark, *pages), connectivity, tile).collect()
    for i, page in enumerate(pages):
        assert {(r.y, r.x): r.root for r in got if r.image_id == i} == brute_labels(page, connectivity)


def test_diagonal_pixels(spark):
    two = ink(spark, [[1, 0], [0, 1]])
    assert R.component_stats(R.label_components(two, 8)).count() == 1
    assert R.component_stats(R.label_components(two, 4)).count() == 2


def test_holes(spark):
    open_ring = RING.copy()
    open_ring[0, 1] = 0
    labelled = R.label_components(ink(spark, RING, open_ring, np.ones((3, 3))))
    contour = {r.image_id: r.n_holes for r in R.count_holes(labelled).collect()}
    assert contour == {0: 1, 1: 0, 2: 0}
    crop = {r.image_id: r.n_holes for r in R.count_holes(labelled, "crop").collect()}
    assert crop == {0: 2, 1: 2, 2: 1}  # the unpadded form counts a full crop as holed
    features = R.topology_features(ink(spark, RING)).first()
    assert (features.beta_0, features.beta_1, features.euler, features.complexity) == (1, 1, 0, 3)


def test_otsu_edges(spark):
    white, black, half = np.full((4, 4), 255), np.zeros((4, 4)), np.array([[0, 0], [200, 200]])
    df = pixels(spark, white, black, half)
    assert {r.image_id: r.threshold for r in R.otsu(df).collect()} == {0: 0, 1: 0, 2: 0}
    fg = {r.image_id for r in R.binarize(df).where("fg").collect()}
    assert fg == {1, 2}
    status = R.quality_status(spark.range(4).select(F.col("id").alias("image_id")), df)
    assert {r.image_id: r.status for r in status.collect()} == {0: "blank", 1: "blank", 2: "ok", 3: "corrupted"}


def test_minority_polarity(spark):
    page = np.full((10, 10), 20)
    page[0, :3] = 240
    df = pixels(spark, page, 255 - page)
    for i, want in ((0, 3), (1, 3)):
        assert R.binarize(df, "minority").where(F.col("fg") & (F.col("image_id") == i)).count() == want


def test_small_component_inside_an_outline(spark):
    page = np.zeros((9, 16), dtype=int)
    page[1:8, 1:8] = 1
    page[2:7, 2:7] = 0
    page[4, 4] = 1  # inside the ring
    page[1:8, 10] = page[7, 10:15] = 1  # an open angle
    page[2, 13] = 1  # inside the angle's box, not inside an outline
    labelled = R.label_components(ink(spark, page))
    key = lambda y, x: y * R.ROW_STRIDE + x
    assigned = R.assign_small_to_large(labelled, 2, remove_largest=False)
    assert [(r.small, r.large) for r in assigned.collect()] == [(key(4, 4), key(1, 1))]
    merged = R.merge_small(labelled, assigned).groupBy("root").count().collect()
    assert {r.root: r["count"] for r in merged} == {key(1, 1): 25, key(1, 10): 11, key(2, 13): 1}


def test_topology_mask_whitens_outside(spark):
    page = np.full((6, 8), 250)
    page[1:4, 1:4] = 10
    page[2, 2] = 250
    page[5, 7] = 10
    out = {(r.y, r.x): r.v for r in R.topology_mask(pixels(spark, page)).collect()}
    assert out[1, 1] == 10 and out[2, 2] == 250 and out[5, 7] == 255


def test_corner_regions_and_erase(spark):
    page = np.full((20, 20), 255)
    page[:2, :2] = 0
    boxes = R.corner_regions(R.binarize(pixels(spark, page)))
    assert [tuple(r)[1:] for r in boxes.collect()] == [(0, 0, 2, 2)]
    assert R.erase_regions(pixels(spark, page), boxes).where("v = 0").count() == 0


def test_pruning_keeps_holes_and_removes_nothing_connected(spark):
    page = np.zeros((12, 12), dtype=int)
    page[2:10, 2:10] = 1
    page[5:7, 5:7] = 0
    page[5, 10:12] = 1  # a spur, grown back because it touches the body
    labelled = R.label_components(ink(spark, page))
    after = R.prune_preserving_topology(labelled)
    report = R.prune_report(labelled, after).first()
    assert report.topology_preserved and report.holes_before == 1 and report.area_after == report.area_before
    assert report.pruning_steps >= 1


def test_pruning_rounds_match_brute_force(spark):
    rng = np.random.default_rng(9)
    pages = [rng.random((14, 15)) < share for share in (0.4, 0.6, 0.8, 0.95)] + [np.ones((1, 1)), np.ones((1, 7)), np.ones((6, 6)), np.eye(5)]
    labelled = R.label_components(ink(spark, *pages))
    got = {(r.image_id, r.root): r.steps for r in R.pruning_steps(labelled).collect()}
    pieces = {}
    for r in labelled.collect():
        pieces.setdefault((r.image_id, r.root), set()).add((r.y, r.x))
    assert got.keys() == pieces.keys()
    for key, cells in pieces.items():
        ys, xs = sorted({y for y, _ in cells}), sorted({x for _, x in cells})
        box = [(y, x) for y in range(ys[0], ys[-1] + 1) for x in range(xs[0], xs[-1] + 1)]

        def fits(k):
            return any(
                all((y, x) in cells for y, x in box if -(k // 2) <= y - cy < k - k // 2 and -(k // 2) <= x - cx < k - k // 2) for cy, cx in box
            )

        want = 0
        while want < 3 and fits(want + 2):
            want += 1
        assert got[key] == want


def test_high_frequency_share(spark):
    rng = np.random.default_rng(5)
    pages = [rng.integers(0, 255, (8, 16)), rng.integers(0, 255, (9, 7))]
    got = {r.image_id: r.high_freq_energy for r in R.high_freq_ratio(pixels(spark, *pages)).collect()}
    for i, page in enumerate(pages):
        m = np.abs(np.fft.fftshift(np.fft.fft2(page / 255.0)))
        h, w = page.shape
        y, x = np.mgrid[:h, :w]
        far = (y - h // 2) ** 2 + (x - w // 2) ** 2 > (min(h, w) // 8) ** 2
        assert got[i] == pytest.approx((m * far).sum() / m.sum(), abs=1e-9)


def test_embedding_of_damaged_and_mixed_sizes(spark):
    images = spark.createDataFrame([(1, 2, 2, [1, 2, 3, 4]), (2, 1, 3, [9, 9, 9]), (3, 2, 2, None), (4, 2, 2, [1])], "image_id bigint, h int, w int, px array<int>")
    out = {r.image_id: np.array(r.embedding) for r in N.embed(images, N.cosine_projection(5)).collect()}
    assert len(out) == 4
    assert np.linalg.norm(out[1]) == pytest.approx(1) and np.linalg.norm(out[2]) == pytest.approx(1)
    assert not out[3].any() and not out[4].any()


def test_page_without_components_is_one_component(spark):
    blank = pixels(spark, np.full((5, 6), 255))
    row = N.page_components(blank).first()
    # A page of one gray value has no valid minority; the dark side is empty.
    assert (row.component_index, row.w, row.h, row.area) == (0, 6, 5, 30)


def test_windows_of_many_pixels_are_dealt_out_by_bands(spark, monkeypatch):
    """More pixels than a task takes: dealt out by bands of rows, and windows across two bands count once."""
    dealt, by_key = [], R.by_key
    monkeypatch.setattr(R, "by_key", lambda df, *keys, n: (dealt.append(n), by_key(df, *keys, n=n))[1])
    monkeypatch.setattr(ordering, "TASK_ROWS", 20)
    page = np.random.default_rng(2).random((140, 11)) < 0.6
    df = spark.createDataFrame([(5, int(y), int(x)) for y, x in zip(*np.nonzero(page))], "image_id long, y int, x int")
    whole = np.pad(page.astype(int), 1)
    quad = whole[:-1, :-1] + 2 * whole[:-1, 1:] + 4 * whole[1:, :-1] + 8 * whole[1:, 1:]
    ones = sum((quad >> bit) & 1 for bit in range(4))
    want = (int((ones == 1).sum()), int((ones == 3).sum()), int(np.isin(quad, (6, 9)).sum()))
    for n in (0, int(page.sum())):
        row = R._quad_counts(df, ["image_id"], False, n).first()
        assert (row.q1, row.q3, row.qd) == want
    features = R.topology_features(df).first()
    assert dealt == [0, int(page.sum()), int(page.sum())]
    assert features.beta_1 == max(0, df.transform(R.label_components).select("root").distinct().count() - (want[0] - want[1] - 2 * want[2]) // 4)


def test_pages_of_rings_are_dealt_out(spark, monkeypatch, tmp_path):
    """The suppliers of one file become pages in many tasks, and the pages stay the same."""
    spark.createDataFrame([(i, i % 5) for i in range(40)], "s_suppkey long, s_nationkey int").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    plain = fixtures.rings(spark, str(tmp_path))
    rows = sorted(plain.collect())
    monkeypatch.setattr(ordering, "TASK_ROWS", 500)
    dealt = fixtures.rings(spark, str(tmp_path))
    assert dealt.rdd.getNumPartitions() >= 24 > plain.rdd.getNumPartitions()
    assert len(rows) == 40 * 289 and sorted(dealt.collect()) == rows
