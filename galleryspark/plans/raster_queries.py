"""Queries over the long raster table."""

from __future__ import annotations

from pyspark.sql import functions as F

from galleryspark.functions.geometry import NORM_MEAN, NORM_STD, normalize_intensity
from galleryspark.operators import contours as T, raster as R
from galleryspark.plans.fixtures import mosaic, ras, rings, rounded, sql
from galleryspark.plans.raster_sql import ENERGY, HOLES, LABELLED, SOBEL, SPECTRUM, STATS, STATUS, THRESHOLDS, components, hist_entropy, quads
from galleryspark.session import cut_lineage


def _labelled(spark, sf, connectivity=8):
    return R.label_components(R.binarize(ras(spark, sf)).where("fg"), connectivity)


def _stored(spark, sf):
    """Labels that several later steps read: computed once and stored."""
    return cut_lineage(_labelled(spark, sf))


def _stored_pages(spark, sf):
    return cut_lineage(R.label_components(R.binarize(mosaic(spark, sf)).where("fg")))


def b13_normalize_intensity(spark, sf):
    df = ras(spark, sf).select("image_id", "y", "x", normalize_intensity(F.col("v")).alias("z"), normalize_intensity(F.col("v"), invert=True).alias("z_inverted"))
    return rounded(df, "z", "z_inverted")


def h1_gray_histogram(spark, sf):
    return R.gray_histogram(ras(spark, sf))


def h1_global_histogram(spark, sf):
    return R.global_histogram(ras(spark, sf))


def h2_intensity_summary(spark, sf):
    return rounded(R.intensity_summary(ras(spark, sf)), "mean_pixel", "std_pixel", "pct_dark_0_31", "pct_midtone_32_223", "pct_bright_224_255")


def h3_otsu(spark, sf):
    return R.otsu(ras(spark, sf))


def h3_binarize(spark, sf):
    dark = R.binarize(ras(spark, sf)).where("fg").groupBy("image_id").agg(F.count(F.lit(1)).alias("dark"))
    minority = R.binarize(ras(spark, sf), "minority").where("fg").groupBy("image_id").agg(F.count(F.lit(1)).alias("minority"))
    fixed = R.binarize(ras(spark, sf), "minority", 100).where("fg").groupBy("image_id").agg(F.count(F.lit(1)).alias("fixed"))
    return dark.join(minority, "image_id").join(fixed, "image_id")


def h4_label_components(spark, sf):
    return _labelled(spark, sf)


def h4_label_components_4(spark, sf):
    return _labelled(spark, sf, 4)


def h4_label_tiles(spark, sf):
    """Pages cut into 7x7 tiles, so that most components cross tile borders."""
    return R.label_components(R.binarize(mosaic(spark, sf)).where("fg"), tile=7)


def h5_component_stats(spark, sf):
    return R.component_stats(_labelled(spark, sf))


def h6_count_holes(spark, sf):
    labelled = _stored(spark, sf)
    crop = R.count_holes(labelled, "crop").withColumnRenamed("n_holes", "crop_holes")
    return R.count_holes(labelled).join(crop, ["image_id", "root"])


def h7_topology_features(spark, sf):
    return R.topology_features(cut_lineage(R.binarize(ras(spark, sf)).where("fg")))


def _outlines(spark, sf):
    """Nested rings and the outlines on them."""
    pages = cut_lineage(rings(spark, sf).withColumn("fg", F.col("v") == 0))
    return pages, cut_lineage(T.contour_tree(pages))


def h7_contour_tree(spark, sf):
    tree = _outlines(spark, sf)[1]
    return rounded(tree, "area")


def h7_topology_nested(spark, sf):
    """Topology of the nested rings with the depth of their outlines, and number and area of the outlines."""
    pages, tree = _outlines(spark, sf)
    stats = T.contour_stats(tree, pages)
    features = R.topology_features(pages.where("fg"), stats.select("image_id", F.col("max_depth").alias("depth")))
    return rounded(features.join(stats, "image_id"), "mean_contour_area", "std_contour_area")


def h8_logo_regions(spark, sf):
    pixels = ras(spark, sf)
    mask = R.mask_region(R.page_sizes(pixels), [0.1, 0.2, 0.6, 1.2]).withColumn("strategy", F.lit("mask"))
    corners = R.corner_regions(R.binarize(pixels), 0.25).withColumn("strategy", F.lit("corners"))
    return mask.unionByName(corners)


def h10_erase_regions(spark, sf):
    pixels = ras(spark, sf)
    return R.erase_regions(pixels, R.corner_regions(R.binarize(pixels), 0.25))


def h15_topology_mask(spark, sf):
    return R.topology_mask(ras(spark, sf))


def h16_assign_by_outline(spark, sf):
    return R.assign_small_to_large(_stored_pages(spark, sf), 5, remove_largest=False)


def h16_fill_outlines(spark, sf):
    return R.fill_outlines(_labelled(spark, sf)).groupBy("image_id", "root").agg(F.count(F.lit(1)).alias("filled"))


def h17_merge_small(spark, sf):
    labelled = _stored_pages(spark, sf)
    merged = R.merge_small(labelled, R.assign_small_to_large(labelled, 5, remove_largest=False))
    return merged.groupBy("image_id", "root").agg(F.count(F.lit(1)).alias("pixels"))


def h18_prune_preserving_topology(spark, sf):
    return R.prune_preserving_topology(_stored(spark, sf))


def h19_prune_report(spark, sf):
    before = _stored(spark, sf)
    return rounded(R.prune_report(before, cut_lineage(R.prune_preserving_topology(before))), "area_reduction")


def h19_preserved_rate(spark, sf):
    before = _stored(spark, sf)
    report = R.prune_report(before, cut_lineage(R.prune_preserving_topology(before)))
    return rounded(R.preserved_rate(report), "preserved_rate", "mean_reduction", "mean_steps")


def h24_image_entropy(spark, sf):
    return rounded(R.image_entropy(ras(spark, sf)), "entropy")


def h25_sparsity(spark, sf):
    return rounded(R.sparsity(ras(spark, sf)), "sparsity")


def h25_quality_status(spark, sf):
    """Every seventh image is unreadable and every eleventh blank."""
    pixels = ras(spark, sf)
    seen = pixels.where("image_id % 7 <> 0").withColumn("v", F.when(F.col("image_id") % 11 == 0, F.lit(255)).otherwise(F.col("v")))
    return R.quality_status(pixels.select("image_id").distinct(), seen)


def h26_edge_density(spark, sf):
    return rounded(R.edge_density(ras(spark, sf)), "edge_density")


def h27_high_freq_ratio(spark, sf):
    return rounded(R.high_freq_ratio(ras(spark, sf)), "high_freq_energy")


def h28_normalization_stats(spark, sf):
    plain = R.normalization_stats(ras(spark, sf)).withColumn("inverted", F.lit(False))
    flipped = R.normalization_stats(ras(spark, sf), True).withColumn("inverted", F.lit(True))
    return rounded(plain.unionByName(flipped), "mean", "std")


QUERIES = {
    "b13_normalize_intensity": b13_normalize_intensity,
    "h1_gray_histogram": h1_gray_histogram,
    "h1_global_histogram": h1_global_histogram,
    "h2_intensity_summary": h2_intensity_summary,
    "h3_otsu": h3_otsu,
    "h3_binarize": h3_binarize,
    "h4_label_components": h4_label_components,
    "h4_label_components_4": h4_label_components_4,
    "h4_label_tiles": h4_label_tiles,
    "h5_component_stats": h5_component_stats,
    "h6_count_holes": h6_count_holes,
    "h7_topology_features": h7_topology_features,
    "h7_contour_tree": h7_contour_tree,
    "h7_topology_nested": h7_topology_nested,
    "h8_logo_regions": h8_logo_regions,
    "h10_erase_regions": h10_erase_regions,
    "h15_topology_mask": h15_topology_mask,
    "h16_assign_by_outline": h16_assign_by_outline,
    "h16_fill_outlines": h16_fill_outlines,
    "h17_merge_small": h17_merge_small,
    "h18_prune_preserving_topology": h18_prune_preserving_topology,
    "h19_prune_report": h19_prune_report,
    "h19_preserved_rate": h19_preserved_rate,
    "h24_image_entropy": h24_image_entropy,
    "h25_sparsity": h25_sparsity,
    "h25_quality_status": h25_quality_status,
    "h26_edge_density": h26_edge_density,
    "h27_high_freq_ratio": h27_high_freq_ratio,
    "h28_normalization_stats": h28_normalization_stats,
}

_SIZES = "sizes as (select image_id, max(y) + 1 as ph, max(x) + 1 as pw from ras group by image_id)"
_CORNERS = f"""{_SIZES}, cut as (select image_id, pw, ph, floor(pw * 0.25) as cw, floor(ph * 0.25) as ch from sizes),
 cand as (select image_id, 0 as x1, 0 as y1, cw as x2, ch as y2 from cut union all select image_id, pw - cw, 0, pw, ch from cut
 union all select image_id, 0, ph - ch, cw, ph from cut union all select image_id, pw - cw, ph - ch, pw, ph from cut),
 corners as (select image_id, cast(x1 as int) as x1, cast(y1 as int) as y1, cast(x2 as int) as x2, cast(y2 as int) as y2 from cand join bin using (image_id)
 where x >= x1 and x < x2 and y >= y1 and y < y2 group by all having avg(cast(fg as int)) > 0.3)"""
_MOMENTS = """mom as (select image_id, count(*)::double as n, sum(v)::double as s, sum(v * v)::double as ss,
 sum(cast(v < 32 as int)) as dark, sum(cast(v >= 224 as int)) as bright from ras group by image_id)"""
_STD = "sqrt(greatest(ss * n - s * s, 0) / (n * n))"
_FILL = """box as (select image_id, root, min(y) as y0, max(y) as y1, min(x) as x0, max(x) as x1 from comp group by 1, 2),
 cell as (select image_id, root as owner, unnest(range(y0 - 1, y1 + 2)) as y, x0, x1, y0 from box),
 cells as (select image_id, owner, y, y0, x0, unnest(range(x0 - 1, x1 + 2)) as x from cell),
 free as (select image_id, owner, y0, x0, cast(y + 1 as int) as y, cast(x + 1 as int) as x from cells c where not exists (
 select 1 from comp p where p.image_id = c.image_id and p.root = c.owner and p.y = c.y and p.x = c.x)),
 """ + components("region", "free", 4, "image_id, owner") + """,
 filled as (select image_id, root, y, x from comp union all select r.image_id, r.owner, r.y - 1, r.x - 1 from region r join box b on r.image_id = b.image_id
 and r.owner = b.root where r.root <> b.y0::bigint * 1048576 + b.x0)"""
_ASSIGN = """ord as (select *, row_number() over (partition by image_id order by bbox_area desc, label) as r from stats),
 cover as (select s.image_id, s.root as small, l.root as large, l.r, s.pixel_area, count(*) as n from ord s join ord l on s.image_id = l.image_id and l.r <= 5 and s.r > 5
 and l.x <= s.x and l.y <= s.y and l.x + l.w >= s.x + s.w and l.y + l.h >= s.y + s.h
 join comp p on p.image_id = s.image_id and p.root = s.root join filled f on f.image_id = p.image_id and f.root = l.root and f.y = p.y and f.x = p.x group by all),
 assigned as (select image_id, small, arg_min(large, r) as large from cover where n = pixel_area group by 1, 2)"""

# A component is one 8-connected piece, so growing back any non-empty opening gives the whole piece: a round is
# kept as long as some k x k window, cut at the crop border, is full.
_PRUNED = """tight as (select image_id, root, min(y) as y0, max(y) as y1, min(x) as x0, max(x) as x1 from comp group by 1, 2),
 spot as (select *, unnest(range(x0, x1 + 1)) as cx from (select *, unnest(range(y0, y1 + 1)) as cy from tight)),
 win as (select image_id, root, cy, cx, k, greatest(y0, cy - k // 2) as ya, least(y1, cy - k // 2 + k - 1) as yb,
 greatest(x0, cx - k // 2) as xa, least(x1, cx - k // 2 + k - 1) as xb from spot, (values (2), (3), (4)) t(k)),
 full_win as (select w.image_id, w.root, k, cy, cx, (yb - ya + 1) * (xb - xa + 1) as cells, count(p.y) as filled from win w left join comp p
 on p.image_id = w.image_id and p.root = w.root and p.y between ya and yb and p.x between xa and xb group by all),
 fits as (select image_id, root, bool_or(k = 2 and cells = filled) as f2, bool_or(k = 3 and cells = filled) as f3, bool_or(k = 4 and cells = filled) as f4 from full_win group by 1, 2),
 pruned as (select image_id, root, case when not f2 then 0 when not f3 then 1 when not f4 then 2 else 3 end as steps from fits)"""

_REPORT = "after as (select image_id, root, y, x from comp join pruned using (image_id, root)), " + quads("quad_after", "after", "image_id, root") + """,
 left_over as (select image_id, root, count(*) as area_after from after group by 1, 2),
 report as (select s.image_id, s.root, pixel_area as area_before, area_after, n_holes as holes_before,
 cast(greatest(0, 1 - floor((a.q1 - a.q3 - 2 * a.qd) / 4.0)) as int) as holes_after, steps as pruning_steps,
 round((1 - area_after::double / pixel_area) * 100, 6) as area_reduction,
 n_holes = cast(greatest(0, 1 - floor((a.q1 - a.q3 - 2 * a.qd) / 4.0)) as int) as topology_preserved
 from stats s join holes h using (image_id, root) join pruned p using (image_id, root) join left_over l using (image_id, root) join quad_after a using (image_id, root))"""

_TREE = components("comp", "fgpx", 8) + ", " + components("bgcomp", "bgpx", 4) + """,
 piece as (select image_id, y, x, root as node, true as ink from comp union all select image_id, y, x, root, false from bgcomp),
 node as (select image_id, node, ink from piece group by all having ink or (min(y) > 0 and min(x) > 0 and max(y) < 16 and max(x) < 16)),
 tree as (select n.*, m.node as parent from node n left join piece p on p.image_id = n.image_id and p.y = n.node // 1048576 and p.x = n.node % 1048576 - 1
  left join node m on m.image_id = p.image_id and m.node = p.node),
 win as (select image_id, y - dy as qy, x - dx as qx, node, ink from piece, (values (0, 0), (0, 1), (1, 0), (1, 1)) o(dy, dx)),
 dark as (select *, sum(ink::int) over w as d, count(*) over w as n from win window w as (partition by image_id, qy, qx)),
 own as (select image_id, node, sum(case when ink then case d when 4 then 0.25 when 3 then 0.5 / 3 else 0 end
  else case d when 0 then 0.25 when 1 then 1 / 3.0 else 0.5 end end) as area from dark where n = 4 group by 1, 2),
 up as (select image_id, node, node as anc, parent as nxt, 0 as d from tree union all
  select u.image_id, u.node, t.node, t.parent, u.d + 1 from up u join tree t on t.image_id = u.image_id and t.node = u.nxt),
 depths as (select image_id, node, max(d) as depth from up group by 1, 2),
 areas as (select u.image_id, u.anc as node, sum(coalesce(area, 0)) as area from up u left join own o on o.image_id = u.image_id and o.node = u.node group by 1, 2),
 outline as (select t.image_id, node, ink, parent, depth, round(area, 6) as area from tree t join depths using (image_id, node) join areas using (image_id, node))"""
_RINGS = "fgpx as (select image_id, y, x from rings where v = 0), bgpx as (select image_id, y, x from rings where v > 0), "

ORACLE = {
    "b13_normalize_intensity": sql("ras")
    + f"select image_id, y, x, round((v / 255.0::double - {NORM_MEAN}) / {NORM_STD}, 6) as z, round((1 - v / 255.0::double - {NORM_MEAN}) / {NORM_STD}, 6) as z_inverted from ras",
    "h1_gray_histogram": sql("ras") + "select image_id, v, count(*) as n from ras group by 1, 2",
    "h1_global_histogram": sql("ras") + "select v, count(*) as n from ras group by 1",
    "h2_intensity_summary": sql("ras", more=_MOMENTS)
    + f"""select count(*) as images, round(avg(s / n), 6) as mean_pixel, round(avg({_STD}), 6) as std_pixel, round(sum(dark) / sum(n), 4) as pct_dark_0_31,
 round(1 - sum(dark) / sum(n) - sum(bright) / sum(n), 4) as pct_midtone_32_223, round(sum(bright) / sum(n), 4) as pct_bright_224_255 from mom""",
    "h3_otsu": sql("ras", more=THRESHOLDS) + "select image_id, threshold from otsu",
    "h3_binarize": sql("ras", more=THRESHOLDS + """, c as (select image_id, count(*) as n, count(*) filter (fg) as d, count(*) filter (v <= 100) as d2 from bin group by 1),
 m as (select image_id, d, case when n - d > 0 and n - d < n * 0.95 and (not (d > 0 and d < n * 0.95) or n - d < d) then n - d else d end as minority,
 case when n - d2 > 0 and n - d2 < n * 0.95 and (not (d2 > 0 and d2 < n * 0.95) or n - d2 < d2) then n - d2 else d2 end as fixed from c)""")
    + "select image_id, d as dark, minority, fixed from m where d > 0 and minority > 0 and fixed > 0",
    "h4_label_components": sql("ras", more=LABELLED, recursive=True) + "select image_id, y, x, root from comp",
    "h4_label_components_4": sql("ras", more=THRESHOLDS + ", fgpx as (select image_id, y, x from bin where fg), " + components("comp", "fgpx", 4), recursive=True)
    + "select image_id, y, x, root from comp",
    "h4_label_tiles": sql("mosaic", more=LABELLED, recursive=True) + "select image_id, y, x, root from comp",
    "h5_component_stats": sql("ras", more=f"{LABELLED}, {STATS}", recursive=True) + "select * from stats",
    "h6_count_holes": sql("ras", more=f"""{LABELLED}, {HOLES}, box as (select image_id, root, min(y) as y0, max(y) as y1, min(x) as x0, max(x) as x1 from comp group by 1, 2),
 inner_bits as (select q.* from quad_bits q join box b using (image_id, root) where qy between y0 and y1 - 1 and qx between x0 and x1 - 1),
 crop as (select b.image_id, b.root, coalesce(sum(cast(bits in (1, 2, 4, 8) as int)) - sum(cast(bits in (7, 11, 13, 14) as int)) - 2 * sum(cast(bits in (6, 9) as int)), 0) as e
 from box b left join inner_bits i using (image_id, root) group by 1, 2)""", recursive=True)
    + "select image_id, root, n_holes, cast(greatest(0, 1 - floor(e / 4.0)) as int) as crop_holes from holes join crop using (image_id, root)",
    "h7_topology_features": sql("ras", more=LABELLED + ", " + components("comp4", "fgpx", 4) + ", " + quads("page", "fgpx", "image_id") + """,
 t as (select image_id, (select count(distinct root) from comp4 c where c.image_id = p.image_id) as b0,
 cast(greatest(0, (select count(distinct root) from comp c where c.image_id = p.image_id) - floor((q1 - q3 - 2 * qd) / 4.0)) as bigint) as b1 from page p)""", recursive=True)
    + "select image_id, b0 as beta_0, b1 as beta_1, b0 - b1 as euler, b0 + 2 * b1 as complexity from t",
    "h7_contour_tree": sql("rings", more=_RINGS + _TREE, recursive=True) + "select * from outline",
    "h7_topology_nested": sql("rings", more=_RINGS + _TREE + ", " + components("comp4", "fgpx", 4) + ", " + quads("page", "fgpx", "image_id") + """,
 o as (select image_id, count(*) as n_contours, max(depth) as max_depth, round(coalesce(avg(area) filter (where area > 0), 0), 6) as mean_contour_area,
 round(coalesce(stddev_pop(area) filter (where area > 0), 0), 6) as std_contour_area from outline group by 1),
 f as (select image_id, count(distinct root) as b0 from comp4 group by 1), e as (select image_id, count(distinct root) as b8 from comp group by 1),
 t as (select image_id, b0, cast(greatest(0, b8 - floor((q1 - q3 - 2 * qd) / 4.0)) as bigint) as b1 from f join e using (image_id) join page using (image_id))""", recursive=True)
    + "select image_id, b0 as beta_0, b1 as beta_1, b0 - b1 as euler, b0 + 2 * b1 + max_depth as complexity, o.* exclude (image_id) from t join o using (image_id)",
    "h8_logo_regions": sql("ras", more=f"{THRESHOLDS}, {_CORNERS}")
    + """select image_id, cast(floor(pw * 0.1) as int) as x1, cast(floor(ph * 0.2) as int) as y1, cast(floor(pw * 0.6) as int) as x2, cast(least(ph, floor(ph * 1.2)) as int) as y2,
 'mask' as strategy from sizes union all select image_id, x1, y1, x2, y2, 'corners' from corners""",
    "h10_erase_regions": sql("ras", more=f"{THRESHOLDS}, {_CORNERS}")
    + """select image_id, y, x, case when exists (select 1 from corners c where c.image_id = r.image_id and x >= x1 and x < x2 and y >= y1 and y < y2) then 255 else v end as v from ras r""",
    "h15_topology_mask": sql("ras", more=f"{LABELLED}, {STATS}, {HOLES}, holed as (select s.* from stats s join holes h using (image_id, root) where n_holes > 0)", recursive=True)
    + """select image_id, y, x, case when not exists (select 1 from holed h where h.image_id = r.image_id) or exists (
 select 1 from holed h where h.image_id = r.image_id and r.x >= h.x and r.x < h.x + h.w and r.y >= h.y and r.y < h.y + h.h) then v else 255 end as v from ras r""",
    "h16_assign_by_outline": sql("mosaic", more=f"{LABELLED}, {STATS}, {_FILL}, {_ASSIGN}", recursive=True) + "select image_id, small, large from assigned",
    "h16_fill_outlines": sql("ras", more=f"{LABELLED}, {_FILL}", recursive=True) + "select image_id, root, count(*) as filled from filled group by 1, 2",
    "h17_merge_small": sql("mosaic", more=f"{LABELLED}, {STATS}, {_FILL}, {_ASSIGN}", recursive=True)
    + """select p.image_id, coalesce(a.large, p.root) as root, count(*) as pixels from comp p left join assigned a on a.image_id = p.image_id and a.small = p.root group by 1, 2""",
    "h18_prune_preserving_topology": sql("ras", more=f"{LABELLED}, {_PRUNED}", recursive=True)
    + "select image_id, root, y, x, steps from comp join pruned using (image_id, root)",
    "h19_prune_report": sql("ras", more=f"{LABELLED}, {STATS}, {HOLES}, {_PRUNED}, {_REPORT}", recursive=True) + "select * from report",
    "h19_preserved_rate": sql("ras", more=f"{LABELLED}, {STATS}, {HOLES}, {_PRUNED}, {_REPORT}", recursive=True)
    + """select count(*) as components, round(avg(cast(topology_preserved as int)), 6) as preserved_rate, round(avg(area_reduction), 6) as mean_reduction,
 round(avg(pruning_steps), 6) as mean_steps from report""",
    "h24_image_entropy": sql("ras", more=hist_entropy("e")) + "select image_id, round(entropy, 6) as entropy from e",
    "h25_sparsity": sql("ras") + "select image_id, round(avg(case when v / 255.0::double > 0.95 then 1.0 else 0.0 end), 6) as sparsity from ras group by image_id",
    "h25_quality_status": sql("ras") + STATUS,
    "h26_edge_density": sql("ras", more=SOBEL)
    + "select image_id, round(avg(case when sqrt(gx * gx + gy * gy + 1e-6) > 0.1 then 1.0 else 0.0 end), 6) as edge_density from grad group by image_id",
    "h27_high_freq_ratio": sql("ras", more=SPECTRUM) + ENERGY,
    "h28_normalization_stats": sql("ras", more=_MOMENTS)
    + f"""select false as inverted, round(avg(s / n / 255), 6) as mean, round(avg({_STD} / 255), 6) as std from mom
 union all select true, round(avg(1 - s / n / 255), 6), round(avg({_STD} / 255), 6) from mom""",
}
