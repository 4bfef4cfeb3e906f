"""Queries over component tables and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from galleryspark.functions import geometry as G
from galleryspark.operators import components as C, profile as P, raster as R
from galleryspark.operators.inventory import with_path_columns
from galleryspark.operators.ordering import hash_rank, sample_n
from galleryspark.plans.fixtures import cmp, emb, files, ras, rounded, sql
from galleryspark.session import cut_lineage
from galleryspark.plans.raster_queries import h25_quality_status
from galleryspark.plans.raster_sql import ENERGY, LABELLED, SPECTRUM, STATUS, hist_entropy

STATS = ("mean", "std", "min", "p25", "p50", "p75", "max")


def b9_component_ids(spark, sf):
    """Ids by area order within the parent image: index 0 is the largest."""
    ranked = C.large_and_small(cmp(spark, sf), 5, remove_largest=False)
    index = (F.col("place") - 1).cast("string")
    parent = F.concat(F.lit("I"), F.col("image_id").cast("string"))
    return ranked.select("image_id", "label", F.concat(parent, F.lit("_roi_"), index).alias("id"), F.concat(F.lit("roi_"), index).alias("component_type"))


def b10_aspect_ratio(spark, sf):
    df = cmp(spark, sf).withColumn("aspect_ratio", G.aspect_ratio(F.col("w"), F.col("h")))
    kept = df.where(G.out_of_range(F.col("aspect_ratio"), 0.2, 5.0))
    return rounded(kept.select("image_id", "label", "aspect_ratio"), "aspect_ratio")


def h9_drop_logo_components(spark, sf):
    """One logo box per page, in its upper middle."""
    df = cmp(spark, sf)
    boxes = R.mask_region(df.select("image_id", "page_w", "page_h").distinct(), [0.3, 0.1, 0.7, 0.4])
    return C.drop_logo_components(df, boxes).select("image_id", "label")


def h11_prune_simple(spark, sf):
    return C.prune_simple(cmp(spark, sf), 400).select("image_id", "label", "pixel_area")


def h12_select_components(spark, sf):
    return C.select_components(cmp(spark, sf), 3, 0.08, 200).select("image_id", "label", "w", "h")


def h12_large_and_small(spark, sf):
    return C.large_and_small(cmp(spark, sf), 2).select("image_id", "label", "place", "size_class")


def h13_pad_bbox(spark, sf):
    return C.pad_bbox(cmp(spark, sf), 5).select("image_id", "label", "px1", "py1", "px2", "py2")


def h14_order_by_topology(spark, sf):
    return C.order_by_topology(cmp(spark, sf)).select("image_id", "label", "place")


def h16_assign_by_box(spark, sf):
    return C.assign_by_box(cmp(spark, sf), 2)


def h20_fill_ratio_profile(spark, sf):
    out = C.fill_ratio_profile(cmp(spark, sf)).select("is_complex", "n", F.col("std_samp").alias("std"), "mean", "min", "p25", "p50", "p75", "max")
    return rounded(out, *STATS)


def h20_hole_frequency(spark, sf):
    return rounded(C.hole_frequency(cmp(spark, sf)), "share")


def h21_component_count_stats(spark, sf):
    out = C.component_count_stats(cmp(spark, sf)).select("n", "mean", F.col("std_pop").alias("std"), "min", "p25", "p50", "p75", "max", "recommended_top_n")
    return rounded(out, *STATS)


def h22_letterbox_plan(spark, sf):
    df = cmp(spark, sf)
    plan, older = G.letterbox_plan(F.col("w"), F.col("h"), 512), G.letterbox_plan(F.col("w"), F.col("h"), 300, True)
    return df.select("image_id", "label", plan.alias("p"), older.alias("o")).select(
        "image_id", "label", "p.nw", "p.nh", "p.dx", "p.dy", F.col("o.nw").alias("nw2"), F.col("o.nh").alias("nh2")
    )


def h23_bbox_overlaps(spark, sf):
    return C.bbox_overlaps(cmp(spark, sf), 8)


def i1_class_balance(spark, sf):
    return P.class_balance(with_path_columns(files(spark, sf), "/workspace/data"), "class_name")


def _measures():
    return {"width": F.col("w"), "height": F.col("h"), "aspect_ratio": G.aspect_ratio(F.col("w"), F.col("h"))}


def i2_size_stats(spark, sf):
    return rounded(P.size_stats(cmp(spark, sf), _measures()), *STATS)


def i3_describe(spark, sf):
    return rounded(P.describe(cmp(spark, sf), _measures(), ["class"]), *STATS)


def image_profile(spark, sf):
    """One row per raster: size, entropy, sparsity, texture, component count and status."""
    pixels = ras(spark, sf)
    counts = R.component_stats(R.label_components(R.binarize(pixels).where("fg"))).groupBy("image_id").agg(F.count(F.lit(1)).alias("cc_count"))
    sizes = R.page_sizes(pixels).withColumn("aspect_ratio", G.aspect_ratio(F.col("page_w"), F.col("page_h"), 0.0))
    return (
        sizes.join(R.image_entropy(pixels), "image_id").join(R.sparsity(pixels), "image_id").join(R.edge_density(pixels), "image_id")
        .join(counts, "image_id", "left").fillna(0, ["cc_count"])
    )


def i4_tag_outliers(spark, sf):
    # Cut to 9 places, so that a value and a threshold made from it compare alike on both engines.
    df = cut_lineage(image_profile(spark, sf)).withColumn("entropy", F.round("entropy", 9)).withColumn("sparsity", F.round("sparsity", 9))
    return P.tag_outliers(df).select("image_id", F.array_join("tags", ",").alias("tags"))


def i4_tag_outliers_ok(spark, sf):
    """All rules on the readable images that are not blank, with the high-frequency share."""
    profile = image_profile(spark, sf).join(R.high_freq_ratio(ras(spark, sf)), "image_id").join(h25_quality_status(spark, sf), "image_id")
    nine = {c: F.round(c, 9) for c in ("entropy", "sparsity")}
    df = cut_lineage(profile.withColumns(nine).withColumn("high_freq_energy", F.round("high_freq_energy", 6)))
    return P.tag_outliers(df, status="status").select("image_id", F.array_join("tags", ",").alias("tags"))


def i5_isolation_scores(spark, sf):
    return rounded(P.isolation_scores(emb(spark, sf)), "score")


def i6_project_2d(spark, sf):
    return rounded(P.project_2d(emb(spark, sf), sample=None), "px", "py")


def i7_sample_n(spark, sf):
    return sample_n(emb(spark, sf), 200, 42, F.col("vec_id")).select("vec_id")


def i7_hash_rank(spark, sf):
    """Place of every vector in the sampling order of its label."""
    return hash_rank(emb(spark, sf).select("vec_id", "label"), 42, F.col("vec_id"), ["label"], total="n")


def i8_histogram(spark, sf):
    return P.histogram(cmp(spark, sf), G.aspect_ratio(F.col("w"), F.col("h")), 40)


def i8_value_counts(spark, sf):
    return P.value_counts(cmp(spark, sf), F.col("n_holes"))


QUERIES = {
    "b9_component_ids": b9_component_ids,
    "b10_aspect_ratio": b10_aspect_ratio,
    "h9_drop_logo_components": h9_drop_logo_components,
    "h11_prune_simple": h11_prune_simple,
    "h12_select_components": h12_select_components,
    "h12_large_and_small": h12_large_and_small,
    "h13_pad_bbox": h13_pad_bbox,
    "h14_order_by_topology": h14_order_by_topology,
    "h16_assign_by_box": h16_assign_by_box,
    "h20_fill_ratio_profile": h20_fill_ratio_profile,
    "h20_hole_frequency": h20_hole_frequency,
    "h21_component_count_stats": h21_component_count_stats,
    "h22_letterbox_plan": h22_letterbox_plan,
    "h23_bbox_overlaps": h23_bbox_overlaps,
    "i1_class_balance": i1_class_balance,
    "i2_size_stats": i2_size_stats,
    "i3_describe": i3_describe,
    "i4_tag_outliers": i4_tag_outliers,
    "i4_tag_outliers_ok": i4_tag_outliers_ok,
    "i5_isolation_scores": i5_isolation_scores,
    "i6_project_2d": i6_project_2d,
    "i7_sample_n": i7_sample_n,
    "i7_hash_rank": i7_hash_rank,
    "i8_histogram": i8_histogram,
    "i8_value_counts": i8_value_counts,
}

_PLACED = "placed as (select *, row_number() over (partition by image_id order by w::bigint * h desc, label) as r from cmp)"


def _describe(std):
    return f"""count(*) as n, round(avg(v), 6) as mean, round({std}(v), 6) as std, round(min(v), 6) as min, round(quantile_cont(v, 0.25), 6) as p25,
 round(quantile_cont(v, 0.5), 6) as p50, round(quantile_cont(v, 0.75), 6) as p75, round(max(v), 6) as max"""


_LONG = """long as (select class, 'width' as metric, w::double as v from cmp union all select class, 'height', h::double from cmp
 union all select class, 'aspect_ratio', case when h > 0 then w / h::double else 1 end from cmp)"""

def _forest_sql(trees=100, levels=8):
    """The forest level by level: nodes of the sample (``l``), their cuts (``c``), then the way of every vector (``p``)."""
    depth = lambda n: (
        f"case when {n} > 2 then 2 * (ln({n} - 1) + 0.5772156649015329) - 2 * ({n} - 1) / {n}::double when {n} = 2 then 1.0::double else 0.0::double end"
    )
    digits = lambda first: f"cast('0x' || substr(md5(concat('42:', tree, ':', node)), {first}, 13) as bigint)"
    parts = [f"""v as materialized (select vec_id, embedding::double[] as e from embeddings),
 ring as materialized (select e, row_number() over (order by md5(concat('42:', vec_id)), vec_id) - 1 as place from v qualify place < {trees * 256}),
 size as materialized (select count(*) as n, least(256, count(*)) as per, cast(ceil(log2(greatest(2, least(256, count(*))))) as int) as deepest from ring),
 l0 as materialized (select t as tree, 1 as node, e from range(0, {trees}) a(t), range(0, 256) b(j), size, ring where j < per and place = (t * 256 + j) % n),
 p0 as materialized (select vec_id, t as tree, 1 as node from v, range(0, {trees}) a(t))"""]
    for k in range(levels + 1):
        parts.append(f"n{k} as materialized (select tree, node, count(*) as n from l{k} group by tree, node)")
        parts.append(f"""c{k} as materialized (select tree, node, f as feature, low + {digits(14)} / 4503599627370496.0::double * (high - low) as cut from (
 select tree, node, f, min(x) as low, max(x) as high, max(width) as width from (select tree, node, len(e) as width, unnest(e) as x, unnest(range(0, len(e))) as f from l{k}) group by tree, node, f)
 where high > low and {k} < (select deepest from size)
 qualify row_number() over (partition by tree, node order by (f - {digits(1)} % width + width) % width) = 1)""")
        parts.append(f"""t{k} as materialized (select p.vec_id, {k} + {depth('m.n')} as length
 from p{k} p left join n{k} m on p.tree = m.tree and p.node = m.node where not exists (select 1 from c{k} c where c.tree = p.tree and c.node = p.node))""")
        if k < levels:
            parts.append(f"l{k + 1} as materialized (select l.tree, 2 * l.node + cast(e[feature + 1] >= cut as int) as node, e from l{k} l join c{k} c on l.tree = c.tree and l.node = c.node)")
            parts.append(f"""p{k + 1} as materialized (select p.vec_id, p.tree, 2 * p.node + cast(e[feature + 1] >= cut as int) as node
 from p{k} p join c{k} c on p.tree = c.tree and p.node = c.node join v on v.vec_id = p.vec_id)""")
    lengths = " union all ".join(f"select * from t{k}" for k in range(levels + 1))
    parts.append(f"""scored as materialized (select vec_id as id, round(pow(2.0, -sum(length) / {trees} / (select {depth('per')} from size)), 12) as score
 from ({lengths}) group by vec_id)""")
    return sql(more=",\n".join(parts)) + "select id, round(score, 6) as score, score > (select quantile_cont(score, 0.95) from scored) as is_outlier from scored"


def _projection_sql(squarings=26):
    """Leading axes by powers of the covariance: each squaring doubles the power, so the strongest axis is left."""
    parts = ["""x as materialized (select vec_id, unnest(embedding)::double as x, unnest(range(0, len(embedding))) as i from embeddings),
 centred as materialized (select vec_id, i, x - avg(x) over (partition by i) as x from x),
 c1 as materialized (select a.i, b.i as j, sum(a.x * b.x) / (select count(*) - 1 from embeddings) as s from centred a join centred b on a.vec_id = b.vec_id group by a.i, b.i)"""]
    for axis in (1, 2):
        last = f"c{axis}"
        for k in range(squarings):
            name = f"m{axis}_{k}"
            parts.append(f"""{name} as materialized (select i, j, s / sum(s) filter (i = j) over () as s from (
 select a.i, b.j, sum(a.s * b.s) as s from {last} a join {last} b on a.j = b.i group by a.i, b.j))""")
            last = name
        parts.append(f"""r{axis} as materialized (select i, s / sqrt(sum(s * s) over ()) as u from {last} where j = (select i from {last} where i = j order by s desc, i limit 1)),
 a{axis} as materialized (select i, u * (select sign(u) from r{axis} order by round(abs(u), 9) desc, i limit 1) as u from r{axis})""")
        if axis == 1:
            parts.append("""c2 as materialized (select c1.i, c1.j, c1.s - (select sum(p.u * c.s * q.u) from c1 c join a1 p on p.i = c.i join a1 q on q.i = c.j) * p.u * q.u as s
 from c1 join a1 p on p.i = c1.i join a1 q on q.i = c1.j)""")
    return sql(more=",\n".join(parts)) + """select vec_id, round(sum(x * a1.u), 6) as px, round(sum(x * a2.u), 6) as py
 from x join a1 on a1.i = x.i join a2 on a2.i = x.i group by vec_id"""


ORACLE = {
    "i5_isolation_scores": _forest_sql(),
    "i6_project_2d": _projection_sql(),
    "b9_component_ids": sql("cmp", more=_PLACED)
    + "select image_id, label, concat('I', image_id, '_roi_', r - 1) as id, concat('roi_', r - 1) as component_type from placed",
    "b10_aspect_ratio": sql("cmp") + "select image_id, label, round(w / h::double, 6) as aspect_ratio from cmp where w / h::double < 0.2 or w / h::double > 5.0",
    "h9_drop_logo_components": sql("cmp")
    + """select image_id, label from cmp where not (x + w / 2.0 between floor(page_w * 0.3::double) and floor(page_w * 0.7::double)
 and y + h / 2.0 between floor(page_h * 0.1::double) and floor(page_h * 0.4::double))""",
    "h11_prune_simple": sql("cmp") + "select image_id, label, pixel_area from cmp where n_holes > 0 or pixel_area >= 400",
    "h12_select_components": sql("cmp", more="""kept as (select *, row_number() over (partition by image_id order by w::bigint * h desc, label) as r from cmp
 where w * h / (page_w * page_h)::double <= 0.08 and w * h >= 200)""") + "select image_id, label, w, h from kept where r <= 3",
    "h12_large_and_small": sql("cmp", more=_PLACED)
    + "select image_id, label, r - 1 as place, case when r - 1 <= 2 then 'large' else 'small' end as size_class from placed where r > 1",
    "h13_pad_bbox": sql("cmp")
    + """select * from (select image_id, label, greatest(0, x - 5) as px1, greatest(0, y - 5) as py1, least(page_w, x + w + 5) as px2, least(page_h, y + h + 5) as py2 from cmp)
 where px2 - px1 >= 2 and py2 - py1 >= 2""",
    "h14_order_by_topology": sql("cmp")
    + "select image_id, label, row_number() over (partition by image_id order by n_holes desc, pixel_area desc, label) as place from cmp",
    "h16_assign_by_box": sql("cmp", more=_PLACED)
    + """select s.image_id, s.label, arg_min(l.label, l.r) as large_label from placed s join placed l on s.image_id = l.image_id and l.r between 2 and 3 and s.r > 3
 and l.x <= s.x and l.y <= s.y and l.x + l.w >= s.x + s.w and l.y + l.h >= s.y + s.h group by 1, 2""",
    "h20_fill_ratio_profile": sql("cmp") + f"select is_complex, {_describe('stddev_samp')} from (select is_complex, pixel_area / greatest(w * h, 1)::double as v from cmp) group by 1",
    "h20_hole_frequency": sql("cmp") + "select n_holes, count(*) as n, round(count(*) / (sum(count(*)) over ())::double, 6) as share from cmp group by 1",
    "h21_component_count_stats": sql("cmp")
    + f"select {_describe('stddev_pop')}, cast(floor(quantile_cont(v, 0.75)) as int) as recommended_top_n from (select count(*)::double as v from cmp group by image_id)",
    "h22_letterbox_plan": sql("cmp", more="""f as (select image_id, label, w, h, cast(floor(w * (512.0::double / greatest(w, h))) as int) as nw,
 cast(floor(h * (512.0::double / greatest(w, h))) as int) as nh from cmp)""")
    + """select image_id, label, nw, nh, cast(floor((512 - nw) / 2.0) as int) as dx, cast(floor((512 - nh) / 2.0) as int) as dy,
 case when w = h then 300 else cast(floor(w * (300.0::double / greatest(w, h))) as int) end as nw2,
 case when w = h then 300 else cast(floor(h * (300.0::double / greatest(w, h))) as int) end as nh2 from f""",
    "h23_bbox_overlaps": sql("cmp")
    + """select a.image_id, a.label as a, b.label as b from cmp a join cmp b on a.image_id = b.image_id and a.label < b.label
 and not (a.x + a.w + 8 <= b.x or b.x + b.w + 8 <= a.x or a.y + a.h + 8 <= b.y or b.y + b.h + 8 <= a.y)""",
    "i1_class_balance": sql("files")
    + """select class as class_name, count(*) as count, round(count(*) / (sum(count(*)) over ())::double, 4) as pct, (sum(count(*)) over ())::bigint as total,
 count(*) over () as num_classes, round(max(count(*)) over () / (greatest(min(count(*)) over (), 1))::double, 2) as imbalance_ratio from files group by class""",
    "i2_size_stats": sql("cmp", more=_LONG) + f"select metric, {_describe('stddev_pop')} from long group by metric",
    "i3_describe": sql("cmp", more=_LONG) + f"select class, metric, {_describe('stddev_samp')} from long group by class, metric",
    "i4_tag_outliers": sql("ras", more=f"""{LABELLED}, {hist_entropy('entropies')},
 counts as (select image_id, count(distinct root) as cc_count from comp group by image_id),
 prof as (select s.image_id, 1.0::double as aspect_ratio, round(entropy, 9) as entropy, round(sparsity, 9) as sparsity, coalesce(cc_count, 0)::double as cc_count
 from (select image_id, avg(case when v / 255.0::double > 0.95 then 1.0 else 0.0 end) as sparsity from ras group by image_id) s
 join entropies using (image_id) left join counts using (image_id)),
 lim as (select quantile_cont(aspect_ratio, 0.995) as ah, quantile_cont(aspect_ratio, 0.005) as al, quantile_cont(entropy, 0.01) as e,
 quantile_cont(sparsity, 0.99) as s, quantile_cont(cc_count, 0.995) as c from prof)""", recursive=True)
    + """select image_id, concat_ws(',', case when aspect_ratio > ah or aspect_ratio < al then 'extreme_aspect_ratio' end, case when entropy < e then 'low_entropy' end,
 case when sparsity > s then 'high_sparsity' end, case when cc_count > c then 'high_cc_count' end) as tags from prof, lim""",
    "i4_tag_outliers_ok": sql("ras", more=f"""{LABELLED}, {hist_entropy('entropies')},
counts as (select image_id, count(distinct root) as cc_count from comp group by image_id),
states as ({STATUS}), energies as (with {SPECTRUM} {ENERGY}),
prof as (select s.image_id, 1.0::double as ar, round(entropy, 9) as entropy, round(sparsity, 9) as sparsity, high_freq_energy as hf, coalesce(cc_count, 0)::double as cc
from (select image_id, avg(case when v / 255.0::double > 0.95 then 1.0 else 0.0 end) as sparsity from ras group by image_id) s
join entropies using (image_id) join energies using (image_id) join states using (image_id) left join counts using (image_id) where status = 'ok'),
lim as (select quantile_cont(ar, 0.995) as ah, quantile_cont(ar, 0.005) as al, quantile_cont(entropy, 0.01) as e,
quantile_cont(sparsity, 0.99) as s, quantile_cont(hf, 0.995) as f, quantile_cont(cc, 0.995) as c from prof)""", recursive=True)
    + """select image_id, concat_ws(',', case when ar > ah or ar < al then 'extreme_aspect_ratio' end, case when entropy < e then 'low_entropy' end,
case when sparsity > s then 'high_sparsity' end, case when hf > f then 'high_freq_energy' end, case when cc > c then 'high_cc_count' end) as tags from prof, lim""",
    "i7_sample_n": "select vec_id from embeddings order by md5(concat('42:', cast(vec_id as varchar))), vec_id limit 200",
    "i7_hash_rank": """select vec_id, label, row_number() over (partition by label order by md5(concat('42:', cast(vec_id as varchar))), vec_id) as rn,
 count(*) over (partition by label) as n from embeddings""",
    "i8_histogram": sql("cmp", more="""a as (select case when h > 0 then w / h::double else 1 end as v from cmp), e as (select min(v) as lo, max(v) as hi from a)""")
    + "select cast(least(floor((v - lo) / ((hi - lo) / 40)), 39) as int) as bin, count(*) as n from a, e group by 1",
    "i8_value_counts": sql("cmp") + "select n_holes as value, count(*) as n from cmp group by 1",
}
