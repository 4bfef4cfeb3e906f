"""Work tables derived from the given tables: one Spark plan and one SQL text each.

``sql(...)`` builds the WITH prefix that gives an oracle query the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from galleryspark.operators.ordering import bucketed_rank, by_key


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def gal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gal_rows(emb(spark, sf_dir))


def gal_rows(vectors: DataFrame) -> DataFrame:
    """Gallery records: five components per document, two pools."""
    parent = F.concat(F.lit("D"), F.lpad(F.floor(F.col("vec_id") / 5).cast("bigint").cast("string"), 5, "0"))
    kind = F.concat(F.lit("roi_"), (F.col("vec_id") % 5).cast("string"))
    category = F.concat(F.lit("class_"), F.col("label").cast("string"))
    return vectors.select(
        "vec_id",
        "embedding",
        "label",
        F.concat(parent, F.lit("_"), kind).alias("id"),
        kind.alias("component_type"),
        parent.alias("parent_pdf_id"),
        category.alias("category"),
        F.concat(F.lit("/workspace/data/"), category, F.lit("/v"), F.lpad(F.col("vec_id").cast("string"), 6, "0"), F.lit(".png")).alias("path"),
        F.when(F.col("vec_id") % 2 == 0, "Da").otherwise("Db").alias("pool"),
    )


GAL = """gal as (select vec_id, embedding, label,
 concat('D', lpad(cast(cast(floor(vec_id/5) as bigint) as varchar),5,'0'),'_roi_',cast(vec_id%5 as varchar)) as id,
 concat('roi_',cast(vec_id%5 as varchar)) as component_type,
 concat('D', lpad(cast(cast(floor(vec_id/5) as bigint) as varchar),5,'0')) as parent_pdf_id,
 concat('class_',cast(label as varchar)) as category,
 concat('/workspace/data/class_',cast(label as varchar),'/v',lpad(cast(vec_id as varchar),6,'0'),'.png') as path,
 case when vec_id%2=0 then 'Da' else 'Db' end as pool from embeddings)"""


def cmp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per component on a 640x480 page."""
    lineitem, orders = by_key(table(spark, sf_dir, "lineitem"), "l_orderkey"), table(spark, sf_dir, "orders")
    lineitem.createOrReplaceTempView("gs_lineitem")
    orders.createOrReplaceTempView("gs_orders")
    return spark.sql(_CMP_SELECT.replace("lineitem", "gs_lineitem").replace("orders", "gs_orders"))


_CMP_SELECT = """select l_orderkey as image_id, cast(row_number() over (partition by l_orderkey order by l_linenumber,l_partkey,l_suppkey,l_quantity,l_extendedprice,l_discount,l_tax) as int) as label, o_orderpriority as class,
 cast(l_partkey%400 as int) as x, cast(l_suppkey%300 as int) as y,
 cast(1+l_quantity*4 as int) as w, cast(1+l_partkey%180 as int) as h, 640 as page_w, 480 as page_h,
 cast(l_partkey%4 as int) as n_holes, (l_partkey%4)>0 as is_complex,
 cast(greatest(1, floor(cast(1+l_quantity*4 as int)*cast(1+l_partkey%180 as int)*((l_orderkey%20)+1)/40)) as bigint) as pixel_area
 from lineitem join orders on l_orderkey=o_orderkey"""
CMP = f"cmp as ({_CMP_SELECT})"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File inventory with artifact names, spaces, upper-case suffixes and non-image files."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    docs.createOrReplaceTempView("gs_documents")
    return spark.sql(_FILES_SELECT.replace("documents", "gs_documents").replace("varchar", "string"))


_FILES_SELECT = """select doc_id, source as class, 1+doc_id%3 as n_pages, n_chars as length,
 concat('/workspace/data/',source,'/',
  case doc_id%6 when 0 then concat('P',lpad(cast(doc_id as varchar),6,'0'),'_merged.png')
   when 1 then concat('P',lpad(cast(doc_id as varchar),6,'0'),'_random_07.png')
   when 2 then concat('P',lpad(cast(doc_id as varchar),6,'0'),'_random_33.png')
   when 3 then concat('large_components/P',lpad(cast(doc_id as varchar),6,'0'),'_large_L3_area77_pad2.png')
   when 4 then concat(cast(doc_id as varchar),'B40-',upper(lang),'-000-',cast(n_chars as varchar),'.PNG')
   else concat(upper(lang),'3 CHH',cast(doc_id as varchar),'.pdf') end) as path from documents"""
FILES = f"files as ({_FILES_SELECT})"


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training log of six runs, two rows per epoch. A run is a sixth of the table, so its row
    numbers are counted hour by hour."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value", (F.col("user_id") % 6).alias("run_no"))
    hour = F.floor(F.unix_timestamp("ts") / 3600)
    return bucketed_rank(events, ["run_no"], hour, [F.col("ts"), F.col("event_id")]).select(
        F.col("event_id").alias("arrival"),
        "ts",
        F.concat(
            F.lit("Run_"), F.lpad((F.col("run_no") + 1).cast("string"), 2, "0"), F.lit("_Seed_"), (F.col("run_no") + 42).cast("string")
        ).alias("run"),
        (F.floor((F.col("rn") - 1) / 2) + 1).cast("bigint").alias("epoch"),
        "rn",
        (-F.col("value") / 500).alias("train_loss"),
        ((F.col("value") - 250) / 500).alias("val_loss"),
        (F.col("value") / 5000).alias("train_z_std"),
        F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"),
        F.when(F.col("rn") % 4 == 1, "start").when(F.col("rn") % 4 == 2, "pause").when(F.col("rn") % 4 == 3, "resume").otherwise("stop").alias("timer_event"),
        F.floor((F.col("rn") - 1) / 4).cast("bigint").alias("timer_id"),
    )


LOG = """log as (select event_id as arrival, ts, concat('Run_',lpad(cast(user_id%6+1 as varchar),2,'0'),'_Seed_',cast(42+user_id%6 as varchar)) as run,
 cast(floor((rn-1)/2) as bigint)+1 as epoch, rn, -value/500 as train_loss, (value-250)/500 as val_loss, value/5000 as train_z_std,
 case when event_type='error' then 'failed' else 'success' end as status,
 case rn%4 when 1 then 'start' when 2 then 'pause' when 3 then 'resume' else 'stop' end as timer_event, cast(floor((rn-1)/4) as bigint) as timer_id
 from (select *, row_number() over (partition by user_id%6 order by ts,event_id) as rn from events))"""


def tta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten rows per item: one anchor and three strategies with three views."""
    place = F.col("vec_id") % 10
    return emb(spark, sf_dir).select(
        F.floor(F.col("vec_id") / 10).cast("bigint").alias("item"),
        "vec_id",
        "embedding",
        (place == 0).alias("is_anchor"),
        F.when(place != 0, F.concat(F.lit("s"), (F.floor((place - 1) / 3).cast("bigint") + 1).cast("string"))).alias("strategy"),
        F.when(place != 0, (place - 1) % 3).alias("view_idx"),
    )


TTA = """tta as (select cast(floor(vec_id/10) as bigint) as item, vec_id, embedding, (vec_id%10)=0 as is_anchor,
 case when vec_id%10=0 then null else concat('s',cast(cast(floor((vec_id%10-1)/3) as bigint)+1 as varchar)) end as strategy,
 case when vec_id%10=0 then null else (vec_id%10-1)%3 end as view_idx from embeddings)"""


def stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch-processing log with failures and skipped (0 s) rows."""
    doc = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit("/in/"), F.col("source"), F.lit("/"), doc.cast("string"), F.lit(".png")).alias("path"),
        (doc % 7 != 0).alias("ok"),
        F.when(doc % 5 == 0, F.lit(0.0)).otherwise(F.col("n_chars").cast("double") / 1000).alias("duration_sec"),
        F.when(doc % 7 == 0, F.lit("ValueError: unreadable")).alias("error"),
    )


STAGE = """stage as (select doc_id, concat('/in/',source,'/',cast(doc_id as varchar),'.png') as path, doc_id%7<>0 as ok,
 case when doc_id%5=0 then cast(0 as double) else cast(n_chars as double)/1000 end as duration_sec,
 case when doc_id%7=0 then 'ValueError: unreadable' end as error from documents)"""


def ras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8x8 gray rasters, one per vector, in long form (image_id, y, x, v)."""
    gray = F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.col("e").cast("double") + 0.5) * 255)))
    return (
        emb(spark, sf_dir)
        .select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("pos", "e"))
        .select(
            "image_id",
            F.floor(F.col("pos") / 8).cast("int").alias("y"),
            (F.col("pos") % 8).cast("int").alias("x"),
            gray.cast("int").alias("v"),
        )
    )


RAS = """ras as (select vec_id as image_id, cast(floor((i-1)/8) as int) as y, cast((i-1) % 8 as int) as x,
 cast(least(255, greatest(0, floor((cast(embedding[i] as double) + 0.5) * 255))) as int) as v
 from embeddings, range(1, 65) r(i))"""

def mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24x24 pages, each made of nine of the small rasters: larger components that enclose others."""
    place = F.col("image_id") % 9
    return ras(spark, sf_dir).select(
        F.floor(F.col("image_id") / 9).cast("bigint").alias("image_id"),
        (F.col("y") + 8 * F.floor(place / 3)).cast("int").alias("y"),
        (F.col("x") + 8 * (place % 3)).cast("int").alias("x"),
        "v",
    )


# Takes the name of the small rasters, so that the texts made for them work on the pages.
MOSAIC = f"""{RAS.replace('ras as', 'small as')},
 ras as (select cast(floor(image_id / 9) as bigint) as image_id, cast(y + 8 * floor((image_id % 9) / 3) as int) as y, cast(x + 8 * (image_id % 3) as int) as x, v from small)"""


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """17x17 pages of square rings, one per supplier; on every third nation's a line from the centre up has its colour turned."""
    y, x, key, nation = F.col("y"), F.col("x"), F.col("s_suppkey").cast("bigint"), F.col("s_nationkey").cast("bigint")
    axis = lambda: F.explode(F.sequence(F.lit(0), F.lit(16)))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    # Dealt out before a row becomes 289: the table may be one file, read by one task.
    pages = by_key(suppliers, "s_suppkey", n=17 * 17 * suppliers.count()).withColumn("y", axis()).withColumn("x", axis())
    ring = F.greatest(F.abs(y - 8), F.abs(x - 8))
    drawn = F.expr("shiftright((cast(s_suppkey as bigint) * 37 + cast(s_nationkey as bigint) * 11) % 512, _ring) % 2 = 1")
    turned = (nation % 3 == 0) & (x == 8) & (y < 8)
    return pages.withColumn("_ring", ring).select(key.alias("image_id"), "y", "x", F.when(drawn != turned, 0).otherwise(255).alias("v"))


RINGS = """rings as (select s_suppkey::bigint as image_id, cast(y as int) as y, cast(x as int) as x,
 case when ((((s_suppkey::bigint * 37 + s_nationkey * 11) % 512) >> cast(greatest(abs(y - 8), abs(x - 8)) as bigint)) % 2 = 1)
  <> (s_nationkey % 3 = 0 and x = 8 and y < 8) then 0 else 255 end as v
 from supplier, range(0, 17) a(y), range(0, 17) b(x))"""

_ORDER = {"rings": RINGS, "mosaic": MOSAIC, "gal": GAL, "cmp": CMP, "files": FILES, "log": LOG, "tta": TTA, "stage": STAGE, "ras": RAS}


def sql(*names: str, more: str = "", recursive: bool = False) -> str:
    """WITH prefix for the named work tables and further CTE text."""
    parts = [_ORDER[n] for n in names] + ([more] if more else [])
    return f"with {'recursive ' if recursive else ''}" + ",\n".join(parts) + "\n"


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round published doubles (``-0.0`` becomes ``0.0``): summation order differs between engines."""
    for name in columns:
        df = df.withColumn(name, F.round(F.col(name).cast("double"), digits) + F.lit(0.0))
    return df
