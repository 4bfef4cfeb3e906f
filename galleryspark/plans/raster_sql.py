"""SQL texts shared by the raster twins. All expect the table ``ras``."""

from __future__ import annotations

THRESHOLDS = """hist as (select image_id, v, count(*) as n from ras group by 1, 2),
 sums as (select image_id, v, (sum(n) over u)::double as n0, (sum(n * v) over u)::double as s0, (sum(n) over a)::double as na, (sum(n * v) over a)::double as sa
 from hist window u as (partition by image_id order by v rows unbounded preceding), a as (partition by image_id)),
 scored as (select image_id, v, (sa * n0 - s0 * na) * (sa * n0 - s0 * na) / (n0 * (na - n0)) as score from sums where na > n0),
 otsu as (select i.image_id, coalesce(t.v, 0) as threshold from (select distinct image_id from ras) i left join (
 select image_id, v from (select *, row_number() over (partition by image_id order by score desc, v) as r from scored) where r = 1) t using (image_id)),
 bin as (select image_id, y, x, v, v <= threshold as fg from ras join otsu using (image_id))"""


def components(name: str, source: str, connectivity: int, keys: str = "image_id") -> str:
    """Table ``name`` (keys, y, x, root) by recursive spread of the smallest pixel key."""
    near = "abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1" if connectivity == 8 else "abs(a.y - b.y) + abs(a.x - b.x) = 1"
    same = " and ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    picked = ", ".join(f"b.{k}" for k in keys.split(", "))
    return f"""{name}_spread as (select {keys}, y, x, y::bigint * 1048576 + x as root from {source}
 union select {picked}, b.y, b.x, a.root from {name}_spread a join {source} b on {same} and {near} and a.root < b.y::bigint * 1048576 + b.x),
 {name} as (select {keys}, y, x, min(root) as root from {name}_spread group by {keys}, y, x)"""


LABELLED = f"{THRESHOLDS}, fgpx as (select image_id, y, x from bin where fg), " + components("comp", "fgpx", 8)

STATS = """stats as (select image_id, root, min(x) as x, min(y) as y, max(x) - min(x) + 1 as w, max(y) - min(y) + 1 as h, count(*) as pixel_area,
 (max(x) - min(x) + 1)::bigint * (max(y) - min(y) + 1) as bbox_area,
 cast(row_number() over (partition by image_id order by root) as int) as label from comp group by image_id, root)"""


def quads(name: str, source: str, keys: str) -> str:
    """Counts q1, q3 and qd of 2x2 windows per group, on the padded page."""
    return f"""{name}_bits as (select {keys}, y - dy as qy, x - dx as qx, sum(bit) as bits from {source},
 (values (0, 0, 1), (0, 1, 2), (1, 0, 4), (1, 1, 8)) o(dy, dx, bit) group by all),
 {name} as (select {keys}, sum(cast(bits in (1, 2, 4, 8) as int)) as q1, sum(cast(bits in (7, 11, 13, 14) as int)) as q3,
 sum(cast(bits in (6, 9) as int)) as qd from {name}_bits group by {keys})"""


HOLES = quads("quad", "comp", "image_id, root") + """,
 holes as (select image_id, root, cast(greatest(0, 1 - floor((q1 - q3 - 2 * qd) / 4.0)) as int) as n_holes from quad)"""


def hist_entropy(name: str) -> str:
    return f"""{name} as (select image_id, -sum(n / t::double * log2(n / t::double)) as entropy from (
 select image_id, n, sum(n) over (partition by image_id) as t from (select image_id, v, count(*) as n from ras group by 1, 2)) group by image_id)"""


SOBEL = """line as (select image_id, y, x, coalesce(lead(v) over r, v) - coalesce(lag(v) over r, v) as d,
 coalesce(lag(v) over r, v) + 2 * v + coalesce(lead(v) over r, v) as s from ras window r as (partition by image_id, y order by x)),
 grad as (select image_id, (coalesce(lag(d) over c, d) + 2 * d + coalesce(lead(d) over c, d)) / 2040.0::double as gx,
 (coalesce(lead(s) over c, s) - coalesce(lag(s) over c, s)) / 2040.0::double as gy from line window c as (partition by image_id, x order by y))"""


STATUS = """select image_id, case when image_id % 7 = 0 then 'corrupted' when image_id % 11 = 0 or stddev_samp(v / 255.0::double) < 1e-4 then 'blank' else 'ok' end as status from ras group by image_id"""

SPECTRUM = """freq as (select ky, kx from range(-4, 4) a(ky), range(-4, 4) b(kx)),
 spec as (select image_id, ky, kx, sqrt(power(sum(v / 255.0::double * cos(2 * pi() * (ky * y + kx * x) / 8)), 2)
 + power(sum(v / 255.0::double * sin(2 * pi() * (ky * y + kx * x) / 8)), 2)) as m from ras, freq group by all)"""
ENERGY = "select image_id, round(sum(case when ky * ky + kx * kx > 1 then m else 0 end) / sum(m), 6) as high_freq_energy from spec group by image_id"
