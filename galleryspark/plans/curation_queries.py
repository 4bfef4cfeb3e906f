"""Queries over dataset curation."""

from __future__ import annotations

from pyspark.sql import functions as F

from galleryspark.functions import text as T
from galleryspark.operators import curation as C
from galleryspark.operators.ordering import sample_n
from galleryspark.plans.fixtures import cmp, files, gal, sql

ROOT = "/workspace/data"
N_SEEDS, N_DISTRACTORS = 50, 100


def _key():
    return F.concat(F.col("image_id").cast("string"), F.lit("-"), F.col("label").cast("string"))


def _split_columns(df):
    return df.select("class", "image_id", "label", "split")


def g1_stratified_split(spark, sf):
    return _split_columns(C.stratified_split(cmp(spark, sf), "class", "image_id", 0.8, 42))


def g2_bernoulli_split(spark, sf):
    """Strata of about one group: the class is the group number modulo a number near the group count."""
    df = cmp(spark, sf).withColumn("class", F.concat("class", F.lit("-"), F.floor(F.col("image_id") / 4).cast("string")))
    return _split_columns(C.stratified_split(df, "class", "image_id", 0.3, 7, "bernoulli"))


def g3_component_split(spark, sf):
    return _split_columns(C.component_split(cmp(spark, sf), "class", _key(), 0.8, 42))


def g4_flat_split(spark, sf):
    return C.flat_split(files(spark, sf).select("path", "doc_id"), F.col("path"), 0.7, 42)


def g5_detect_layout(spark, sf):
    """The layout seen from the data root, from above it and from each class directory's parent."""
    f = files(spark, sf)
    at = lambda root: C.detect_layout(f, root).withColumn("root", F.lit(root))
    return at(ROOT).unionByName(at("/workspace")).unionByName(at("/workspace/data/src1/large_components"))


def g6_repeated_splits(spark, sf):
    return C.repeated_splits(cmp(spark, sf), "class", "image_id", 5)


def g7_class_index(spark, sf):
    f = files(spark, sf)
    # One row per class: Spark broadcasts it when its measured size allows.
    return f.join(C.class_index(f, "class"), "class").select("doc_id", "class", "class_index")


def g8_leakage(spark, sf):
    """Leaking groups of the component split, and of the group split (none)."""
    df = cmp(spark, sf)
    leaks = C.leakage(C.component_split(df, "class", _key()), "image_id").withColumn("variant", F.lit("component"))
    none = C.leakage(C.stratified_split(df, "class", "image_id"), "image_id").withColumn("variant", F.lit("group"))
    return leaks.unionByName(none)


def _pools(spark, sf):
    g = gal(spark, sf).select("path", "category", "pool", "id")
    return g.where("pool = 'Da'"), g.where("pool = 'Db'")


def curated(spark, sf):
    da, db = _pools(spark, sf)
    seeds = C.sample_seeds(da, N_SEEDS)
    truth = C.select_ground_truth(seeds, da)
    used = seeds.select("path").unionByName(truth.select(F.col("member").alias("path")))
    distractors = C.sample_distractors(da.unionByName(db), used, N_DISTRACTORS, 43)
    return da, db, seeds, truth, distractors


def g9_sample_seeds(spark, sf):
    return C.sample_seeds(_pools(spark, sf)[0], N_SEEDS).select("path")


def g10_select_ground_truth(spark, sf):
    """Ground truth of every labelled item as seed."""
    da, _ = _pools(spark, sf)
    return C.select_ground_truth(da, da)


def g11_sample_distractors(spark, sf):
    return curated(spark, sf)[4]


def g12_validation_sets(spark, sf):
    return C.build_validation_sets(*curated(spark, sf))


def g12_set_sizes(spark, sf):
    return C.set_sizes(C.build_validation_sets(*curated(spark, sf)))


def g13_validation_groups(spark, sf):
    _, _, seeds, truth, distractors = curated(spark, sf)
    return C.label_validation_groups(seeds, truth, distractors)


def g14_train_test(spark, sf):
    sets = C.build_validation_sets(*curated(spark, sf)).where("part <> 'V'")
    return C.assign_split(sets, 0.8, 42, F.col("path"), ["part"], "zero")


def g15_count_for_mode(spark, sf):
    f = files(spark, sf)
    instance = F.concat(F.lit(ROOT + "/"), T.class_under(F.col("path"), ROOT))
    count = lambda mode: C.count_for_mode(f, instance, mode).withColumn("mode", F.lit(mode))
    return count("instance").unionByName(count("component")).unionByName(count("both"))


def g16_expand_to_components(spark, sf):
    """Complex components only, so that some images have none."""
    df = cmp(spark, sf)
    parts = df.where("is_complex").withColumn("component", _key())
    return C.expand_to_components(df.select("image_id").distinct(), parts, "image_id", "component")


def g17_apply_review(spark, sf):
    """A review that keeps, for every seed, the members whose path ends in an even digit, and new distractors."""
    da, db, seeds, truth, distractors = curated(spark, sf)
    reviewed = truth.where(F.col("member").rlike("[02468]\\.png$"))
    fresh = sample_n(distractors, 40, 5, F.col("path"))
    return C.apply_review(da, db, seeds, reviewed, fresh)


QUERIES = {
    "g1_stratified_split": g1_stratified_split,
    "g2_bernoulli_split": g2_bernoulli_split,
    "g3_component_split": g3_component_split,
    "g4_flat_split": g4_flat_split,
    "g5_detect_layout": g5_detect_layout,
    "g6_repeated_splits": g6_repeated_splits,
    "g7_class_index": g7_class_index,
    "g8_leakage": g8_leakage,
    "g9_sample_seeds": g9_sample_seeds,
    "g10_select_ground_truth": g10_select_ground_truth,
    "g11_sample_distractors": g11_sample_distractors,
    "g12_validation_sets": g12_validation_sets,
    "g12_set_sizes": g12_set_sizes,
    "g13_validation_groups": g13_validation_groups,
    "g14_train_test": g14_train_test,
    "g15_count_for_mode": g15_count_for_mode,
    "g16_expand_to_components": g16_expand_to_components,
    "g17_apply_review": g17_apply_review,
}


def _groups(ratio, seed, train, strata="class", source="cmp"):
    return f"""g as (select {strata} as class, image_id, row_number() over (partition by {strata} order by md5(concat('{seed}:', cast(image_id as varchar))), image_id) as r,
 count(*) over (partition by {strata}) as n from (select distinct class, image_id from {source})),
 s as (select class, image_id, case when r <= {train.format(cut=f'floor(n * {ratio})')} then 'train' else 'test' end as split from g)"""


_ONE = "greatest(1, {cut})"
_KEYED = """k as (select *, concat(cast(image_id as varchar), '-', cast(label as varchar)) as key from cmp),
 c as (select class, image_id, label, case when row_number() over (partition by class order by md5(concat('42:', key)), key)
 <= floor(count(*) over (partition by class) * 0.8::double) then 'train' else 'test' end as split from k)"""
_FINE = "fine as (select image_id, label, concat(class, '-', cast(cast(floor(image_id / 4) as bigint) as varchar)) as class from cmp)"
_BERNOULLI = "case when {cut} = 0 then cast(cast('0x' || substr(md5(concat('7:', class)), 1, 8) as bigint) / 4294967296.0 < 0.3::double as int) else {cut} end"
CURATED_SQL = f"""da as (select path, category from gal where pool = 'Da'), db as (select path from gal where pool = 'Db'),
 seeds as (select path from da order by md5(concat('42:', path)), path limit {N_SEEDS}),
 ring as (select category, path, row_number() over (partition by category order by md5(concat('42:', path)), path) as place,
 count(*) over (partition by category) as n from da),
 every_truth as (select a.path as seed, b.path as member from ring a join ring b on a.category = b.category and a.path <> b.path
 and (b.place - a.place + a.n) % a.n between 1 and 15),
 truth as (select * from every_truth where seed in (select path from seeds)),
 used as (select path from seeds union select member from truth),
 distractors as (select path from gal where path not in (select path from used) order by md5(concat('43:', path)), path limit {N_DISTRACTORS}),
 v as (select path from used union select path from distractors),
 sets as (select 'V' as part, path from v union all select 'T_small', path from da where path not in (select path from v)
 union all select 'T_large', path from gal where path not in (select path from v))"""
_INSTANCE = "concat('/workspace/data/', split_part(path, '/', 4))"

ORACLE = {
    "g1_stratified_split": sql("cmp", more=_groups("0.8::double", 42, _ONE))
    + "select class, image_id, label, split from cmp join s using (class, image_id)",
    "g2_bernoulli_split": sql("cmp", more=_FINE + ", " + _groups("0.3::double", 7, _BERNOULLI, source="fine"))
    + "select class, image_id, label, split from fine join s using (class, image_id)",
    "g3_component_split": sql("cmp", more=_KEYED) + "select class, image_id, label, split from c",
    "g4_flat_split": sql("files")
    + """select path, doc_id, case when row_number() over (order by md5(concat('42:', path)), path) <= greatest(1, floor(count(*) over () * 0.7::double))
 then 'train' else 'test' end as split from files""",
    "g5_detect_layout": sql("files", more="""roots(root) as (values ('/workspace/data'), ('/workspace'), ('/workspace/data/src1/large_components')),
 d as (select root, lower(path) like '%.png' as png, len(string_split(case when starts_with(path, root || '/') then substr(path, length(root) + 2) else path end, '/')) as depth
 from files, roots)""")
    + """select case when bool_or(depth = 2) then 'flat' when bool_or(depth = 3) then 'classes' else 'loose' end as layout,
 case when bool_or(depth = 2 and png) then 'flat' else 'nested' end as nested, root from d group by root""",
    "g6_repeated_splits": sql("cmp", more="""runs as (select i, concat('Run_', lpad(cast(i + 1 as varchar), 2, '0'), '_Seed_', cast(42 + i as varchar)) as run from range(0, 5) t(i)),
 g as (select run, class, image_id, count(*) as c, i from cmp, runs group by all),
 r as (select *, row_number() over (partition by run, class order by md5(concat(cast(42 + i as varchar), ':', cast(image_id as varchar))), image_id) as r,
 count(*) over (partition by run, class) as n from g)""")
    + """select run, case when r <= greatest(1, floor(n * 0.8::double)) then 'train' else 'test' end as split, sum(c)::bigint as rows, count(*) as groups from r group by 1, 2""",
    "g7_class_index": sql("files") + "select doc_id, class, cast(dense_rank() over (order by class) - 1 as int) as class_index from files",
    "g8_leakage": sql("cmp", more=_KEYED) + "select image_id, 'component' as variant from c group by image_id having count(distinct split) > 1",
    "g9_sample_seeds": sql("gal", more=CURATED_SQL) + "select path from seeds",
    "g10_select_ground_truth": sql("gal", more=CURATED_SQL) + "select seed, member from every_truth",
    "g11_sample_distractors": sql("gal", more=CURATED_SQL) + "select path from distractors",
    "g12_validation_sets": sql("gal", more=CURATED_SQL) + "select part, path from sets",
    "g12_set_sizes": sql("gal", more=CURATED_SQL) + "select part, count(*) as size from sets group by part",
    "g13_validation_groups": sql("gal", more=CURATED_SQL + """, numbered as (select path, cast(row_number() over (order by md5(concat('42:', path)), path) - 1 as int) as label from seeds)""")
    + """select label, path as member, concat('group_', lpad(cast(label as varchar), 3, '0')) as group_name from numbered
 union all select label, member, concat('group_', lpad(cast(label as varchar), 3, '0')) from truth join numbered on path = seed
 union all select -1, path, concat('distractor_', lpad(cast(row_number() over (order by md5(concat('42:', path)), path) - 1 as varchar), 4, '0')) from distractors""",
    "g14_train_test": sql("gal", more=CURATED_SQL)
    + """select part, path, case when row_number() over (partition by part order by md5(concat('42:', path)), path)
 <= floor(count(*) over (partition by part) * 0.8::double) then 'train' else 'test' end as split from sets where part <> 'V'""",
    "g15_count_for_mode": sql("files", more=f"p as (select {_INSTANCE} as instance, lower(path) like '%.png' as png, contains(path, '/large_components/') as large from files)")
    + """select instance, count(*) filter (png and not large) as files, 'instance' as mode from p group by instance
 union all select instance, count(*) filter (png and large), 'component' from p group by instance
 union all select instance, count(*) filter (png), 'both' from p group by instance""",
    "g16_expand_to_components": sql("cmp")
    + """select i.image_id, coalesce(cast(c.image_id as varchar) || '-' || cast(label as varchar), cast(i.image_id as varchar)) as item
 from (select distinct image_id from cmp) i left join (select * from cmp where is_complex) c on i.image_id = c.image_id""",
    "g17_apply_review": sql("gal", more=CURATED_SQL + """, fresh as (select path from distractors order by md5(concat('5:', path)), path limit 40),
 v2 as (select path from seeds union select member from truth where regexp_matches(member, '[02468]\\.png$') union select path from fresh)""")
    + """select 'V' as part, path from v2 union all select 'T_small', path from da where path not in (select path from v2)
 union all select 'T_large', path from gal where path not in (select path from v2)""",
}
