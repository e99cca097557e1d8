"""The registered queries again, as plain SQL over the given tables."""

from __future__ import annotations

TS, RES = 16, 1000.0
R_EARTH = "6378137.0e0"

T = """t as (
  select cast(o_orderkey % 100 as int) c, cast(floor(o_orderkey / 100.0) as int) r,
    case when o_orderstatus = 'P' and o_orderkey % 7 = 0 then null
         else 20.0e0 * abs((o_orderkey % 40) - 20) + o_totalprice / 10000.0e0 end z
  from orders)"""
FR = "fr as (select c, r, 1.0e0 + floor(z / 100.0e0) f from t where z is not null)"
STARTS = """starts as (
  select distinct cast((s_suppkey * 37) % 100 as int) c, cast(floor(s_suppkey * 3 / 2.0e0) as int) r from supplier)"""
HEIGHT = "h as (select max(r) + 1 rows from t)"
RING = """pv as (
  select 0 ring, 0 i, 10.0e0 x, rows * 1 / 8.0e0 y from h union all
  select 0, 1, 80.0e0, rows * 2 / 8.0e0 from h union all
  select 0, 2, 60.0e0, rows * 7 / 8.0e0 from h union all
  select 0, 3, 15.0e0, rows * 6 / 8.0e0 from h union all
  select 0, 4, 10.0e0, rows * 1 / 8.0e0 from h union all
  select 1, 0, 30.0e0, rows * 3 / 8.0e0 from h union all
  select 1, 1, 50.0e0, rows * 3 / 8.0e0 from h union all
  select 1, 2, 50.0e0, rows * 5 / 8.0e0 from h union all
  select 1, 3, 30.0e0, rows * 5 / 8.0e0 from h union all
  select 1, 4, 30.0e0, rows * 3 / 8.0e0 from h)"""
# Position on the Z curve of a tile of the test grid; its keys stay below 2^10.
ZKEY = "(" + " + ".join(
    f"cast(((col // {1 << b}) % 2) * {1 << (2 * b)} + ((row // {1 << b}) % 2) * {1 << (2 * b + 1)} as bigint)"
    for b in range(10)
) + ")"
MERC_X = f"lon * pi() * {R_EARTH} / 180.0e0"
MERC_Y = f"{R_EARTH} * ln(tan(radians(45.0e0 + lat / 2.0e0)))"
LONLAT = "(cast(o_orderkey % 100 as int) - 50) * 1.7e0 lon, (cast(floor(o_orderkey / 100.0) as int) - 750) * 0.11e0 lat"


def neighbours(table: str = "t", value: str = "z") -> str:
    return f"""nb as (
  select a.c, a.r, a.{value} mid, o.dc, p.dr, b.{value} nz
  from {table} a cross join (values (-1), (0), (1)) o(dc) cross join (values (-1), (0), (1)) p(dr)
  left join {table} b on b.c = a.c + o.dc and b.r = a.r + p.dr
  where a.{value} is not null)"""


def slope_cte(source: str = "t") -> str:
    near = {n: f"coalesce(max(nz) filter (dc = {dc} and dr = {dr}), max(mid))" for n, dc, dr in [
        ("nw", -1, -1), ("n", 0, -1), ("ne", 1, -1), ("w", -1, 0), ("e", 1, 0), ("sw", -1, 1), ("s", 0, 1), ("se", 1, 1)]}
    return neighbours(source) + f""", win as (
  select c, r, {', '.join(f'{v} {k}' for k, v in near.items())} from nb group by c, r),
sl as (
  select c, r, degrees(atan(sqrt(gx * gx + gy * gy))) z from (
    select c, r, ((ne + 2 * e + se) - (nw + 2 * w + sw)) / (8 * {RES}e0) gx,
                 ((sw + 2 * s + se) - (nw + 2 * n + ne)) / (8 * {RES}e0) gy from win))"""


def sight_cte(vps: str, reach: int, max_distance: float, curvature: bool = True, tag: str = "") -> str:
    """``sight``: rows ``vp, n, c, r, vis`` from viewpoints ``vp, n, c, r, eye, angle, fov, altitude``.

    ``tag`` ends the names, for a second use in one statement.
    """
    drop = f"d * d / (2 * {R_EARTH})" if curvature else "0.0e0"
    return f"""rays{tag} as (
  select side * 2 * {reach} + (i + {reach}) ray,
    case side when 0 then i when 1 then {reach} when 2 then -i else -{reach} end dx,
    case side when 0 then -{reach} when 1 then i when 2 then {reach} else -i end dy
  from range(4) s(side) cross join range(-{reach}, {reach}) q(i)),
steps{tag} as (
  select v.vp, v.n, v.eye, v.altitude, y.ray, k.k,
    cast(floor((2 * k.k * y.dx + {reach}) / (2.0e0 * {reach})) as int) dc,
    cast(floor((2 * k.k * y.dy + {reach}) / (2.0e0 * {reach})) as int) dr, v.c oc, v.r orr
  from {vps} v join rays{tag} y on v.fov <= -1
    or (y.dx * cos(v.angle) - y.dy * sin(v.angle)) / sqrt(cast(y.dx * y.dx + y.dy * y.dy as double)) >= v.fov
  cross join range(1, {reach + 1}) k(k)),
far{tag} as (
  select *, oc + dc c, orr + dr r, sqrt(cast(dc * dc + dr * dr as double)) * {RES}e0 d from steps{tag}),
grad{tag} as (
  select f.vp, f.n, f.ray, f.k, f.c, f.r, (z.z - {drop} - f.eye) / d g,
    (greatest(z.z, f.altitude) - {drop} - f.eye) / d gt
  from far{tag} f join t z on z.c = f.c and z.r = f.r
  where z.z is not null and d <= {max_distance}e0),
run{tag} as (
  select *, max(g) over (partition by vp, ray order by k rows between unbounded preceding and 1 preceding) top from grad{tag}),
sight{tag} as (
  select vp, max(n) n, c, r, max(vis) vis from (
    select vp, n, c, r, case when gt >= coalesce(top, -1e300) then 1 else 0 end vis from run{tag}
    union all
    select v.vp, v.n, v.c, v.r, 1 from {vps} v join t z on z.c = v.c and z.r = v.r where z.z is not null)
  group by vp, c, r)"""


def supplier_vps(height: str = "greatest(s_acctbal / 100, 0.0e0)", angle: str = "0.0e0", fov: str = "-1.0e0",
                 altitude: str = "cast('-inf' as double)", absolute: bool = False) -> str:
    eye = height if absolute else f"z.z + {height}"
    return f"""vps as (
  select s_suppkey vp, 1 n, z.c, z.r, {eye} eye, {angle} angle, {fov} fov, {altitude} altitude
  from supplier join t z on z.c = (s_suppkey * 37) % 100 and z.r = floor(s_suppkey * 3 / 2.0e0)
  {'' if absolute else 'where z.z is not null'})"""


OR = "select cast(c as int) c, cast(r as int) r, cast(max(vis) as double) z from sight group by 1, 2"


def cost_cte(friction: str, starts: str, max_cost: float) -> str:
    return f"""e as (
  select a.c, a.r, b.c c2, b.r r2, (a.f + b.f) / 2.0e0
    * (case when a.c <> b.c and a.r <> b.r then 1.4142135623730951e0 else 1.0e0 end) * {RES}e0 w
  from {friction} a cross join (values (-1), (0), (1)) o(dc) cross join (values (-1), (0), (1)) p(dr)
  join {friction} b on b.c = a.c + o.dc and b.r = a.r + p.dr
  where o.dc <> 0 or p.dr <> 0),
cd(c, r, cost) using key (c, r) as (
  select f.c, f.r, cast(0 as double) from {friction} f join {starts} s on s.c = f.c and s.r = f.r
  union
  select n.c2, n.r2, n.m
  from (select e.c2, e.r2, min(cd.cost + e.w) m from cd join e on e.c = cd.c and e.r = cd.r group by 1, 2) n
  left join recurring.cd o on o.c = n.c2 and o.r = n.r2
  where n.m <= {max_cost}e0 and (o.cost is null or n.m < o.cost))"""


def levels_parts(source: str, top: int = 3, bottom: int = 1, keys: str = "", extra: str = "") -> tuple[str, str]:
    """The nearest-cell pyramid over ``source``: its tables, and rows ``zoom, c, r, z``; ``keys`` leads and ``extra`` ends them."""
    parts, ctes, last = [], [], source
    for zoom in range(top, bottom - 1, -1):
        parts.append(f"select {keys} {zoom} zoom, cast(c as int) c, cast(r as int) r, cast(z as double) z{extra} from {last} where z is not null")
        ctes.append(f"l{zoom - 1} as (select {keys} c // 2 c, r // 2 r, z from {last} where c % 2 = 1 and r % 2 = 1)")
        last = f"l{zoom - 1}"
    return ",\n".join(ctes), " union all ".join(parts)


def levels_sql(source: str, top: int = 3, bottom: int = 1, extra: str = "") -> str:
    return "\n".join(levels_parts(source, top, bottom, extra=extra))


def boundary_cte(source: str = "t", across: bool = False, out: str = "edge") -> str:
    """Positive cells with a missing or non-positive cell in their window."""
    tile = lambda at: f"floor(({at}) / {TS}.0e0)"
    same = f"and {tile('a.c + o.dc')} = {tile('a.c')} and {tile('a.r + p.dr')} = {tile('a.r')}"
    same = "" if across else same
    return f"""{out} as (
  select distinct a.c, a.r
  from {source} a cross join (values (-1), (0), (1)) o(dc) cross join (values (-1), (0), (1)) p(dr)
  left join {source} b on b.c = a.c + o.dc and b.r = a.r + p.dr
  where a.z is not null and floor(a.z) > 0 and (b.z is null or floor(b.z) <= 0) {same})"""


def outline_cte(edges: str, out: str = "outline") -> str:
    """Rows ``g, x0, y1, sx, sy, gc, gr`` from edges ``g, ax, ay, bx, by``."""
    def place(at, side):
        return f"least(case when {side} > 0 then floor(({at}) / nullif({side}, 0)) else 0 end, 511)"

    return f"""env as (
  select g, least(min(ax), min(bx)) x0, greatest(max(ay), max(by_)) y1,
    (greatest(max(ax), max(bx)) - least(min(ax), min(bx))) / 512 sx,
    (greatest(max(ay), max(by_)) - least(min(ay), min(by_))) / 512 sy from {edges} group by g),
ends as (
  select g, x0, y1, sx, sy,
    cast({place('ax - x0', 'sx')} as int) c0, cast({place('y1 - ay', 'sy')} as int) r0,
    cast({place('bx - x0', 'sx')} as int) c1, cast({place('y1 - by_', 'sy')} as int) r1
  from {edges} join env using (g)),
walk as (select *, greatest(abs(c1 - c0), abs(r1 - r0)) n from ends),
{out} as (
  select distinct g, x0, y1, sx, sy,
    c0 + cast(floor((2 * k * (c1 - c0) + n) / (2.0e0 * greatest(n, 1))) as int) gc,
    r0 + cast(floor((2 * k * (r1 - r0) + n) / (2.0e0 * greatest(n, 1))) as int) gr
  from walk join range(0, 512) q(k) on k <= n)"""


SUPPLIER_RINGS = """pts as (
  select s_suppkey g, u.seq, (s_suppkey * 37) % 100 * 1000.0e0 + u.dx x,
    -(floor(s_suppkey * 3 / 2.0e0) * 1000.0e0) - u.dy - s_nationkey * 100.0e0 * u.seq y
  from supplier cross join (values (0, 0.0e0, 0.0e0), (1, 7000.0e0, 1500.0e0), (2, 2500.0e0, 9000.0e0), (3, 0.0e0, 0.0e0)) u(seq, dx, dy)),
ring as (select g, seq, x, case when seq = 3 then first_value(y) over (partition by g order by seq) else y end y from pts)"""

BREAKS = [2.0 * i for i in range(225)]
STOPS = [(20, 60, 190), (110, 150, 230), (235, 235, 235), (230, 120, 100), (190, 20, 30)]


def render_sql(source: str) -> str:
    """Colours of ``c, r, z`` cells by 225 breaks 0, 2, .. 448 and the default ramp."""
    stops = ", ".join(f"({i}, {a}e0, {b}e0, {c}e0)" for i, (a, b, c) in enumerate(STOPS))
    mix = lambda k: f"cast(coalesce(floor(a.{k} + (b.{k} - a.{k}) * (spot - lo) + 0.5e0), 0) as int)"
    return f"""stops(i, red, green, blue) as (values {stops}),
cls as (select c, r, z, case when z is not null then least(greatest(ceil(z / 2.0e0), 0), 224) end k from {source}),
pos as (select c, r, z, k * 4.0e0 / 224.0e0 spot, case when z is not null then least(floor(k * 4.0e0 / 224.0e0), 3) end lo from cls)
select cast(c as int) c, cast(r as int) r, {mix('red')} red, {mix('green')} green, {mix('blue')} blue,
  case when z is null then 0 else 255 end alpha
from pos left join stops a on a.i = lo left join stops b on b.i = lo + 1"""


# All cells of the tiles that exist, including those beyond the data.
FULL = f"""tiles as (select distinct c // {TS} col, r // {TS} row from t where z is not null),
full_cells as (
  select col * {TS} + i.i c, row * {TS} + j.j r, t.z
  from tiles cross join range({TS}) i(i) cross join range({TS}) j(j)
  left join t on t.c = col * {TS} + i.i and t.r = row * {TS} + j.j)"""

TOP_TILE = f"""top_tile as (
  select c // {TS} col, r // {TS} row from t where z is not null order by z desc, c, r limit 1)"""
TOP_CELL = "top as (select c, r, z from t where z is not null order by z desc, c, r limit 1)"


def oracle() -> dict[str, str]:
    data = f"with {T} select c, r, z from t where z is not null"
    sup = supplier_vps()
    observer_vp = "ovp as (select 0 vp, 1 n, c, r, z eye, 0.0e0 angle, -1.0e0 fov, 460.0e0 altitude from top)"
    observer_out = "seen as (select c, r, cast(max(vis) as double) z from sight group by c, r)"
    sql: dict[str, str] = {}

    # Sources and sinks
    sql["read_layer"] = sql["copy_layer"] = sql["ensure_partitions"] = data
    sql["read_tile"] = f"with {T}, {TOP_TILE} select c, r, z from t join top_tile on c // {TS} = col and r // {TS} = row where z is not null"
    sql["write_layer"] = f"""with {T}, k as (select c // {TS} col, r // {TS} row, z from t where z is not null)
      select cast(col as int) col, cast(row as int) "row", {ZKEY} zkey, count(*) n, round(sum(z), 4) total from k group by col, row"""
    sql["dump_layer"] = f"""with {T} select 'terrain-' || (c // {TS}) || '-' || (r // {TS}) tile,
      (c + 0.5e0) * 1000.0e0 x, 0.0e0 - (r + 0.5e0) * 1000.0e0 y, z from t where z is not null"""
    samples = f"""s0 as (select {LONLAT}, o_custkey, z0.z from orders
      join t z0 on z0.c = cast(o_orderkey % 100 as int) and z0.r = cast(floor(o_orderkey / 100.0) as int)),
      s as (select lon + (o_custkey % 7 - 3) * 0.0001e0 lon, lat, z from s0 where z is not null)"""
    world = f"2 * pi() * {R_EARTH} / (16 * 64)"
    sql["ingest_samples"] = f"""with {T}, {samples},
      m as (select *, {MERC_X} x, {MERC_Y} y from s),
      cells as (select *, cast(floor((x + pi() * {R_EARTH}) / ({world})) as int) c, cast(floor((pi() * {R_EARTH} - y) / ({world})) as int) r from m),
      ranked as (select c, r, z, row_number() over (partition by c, r order by
        power(x - (-pi() * {R_EARTH} + (c + 0.5e0) * ({world})), 2) + power(y - (pi() * {R_EARTH} - (r + 0.5e0) * ({world})), 2), lon, lat, z) nth from cells)
      select c, r, z from ranked where nth = 1"""
    some = f"2 * pi() * {R_EARTH} / (16 * 32)"
    sql["ingest_nan_samples"] = sql["ingest_samples"].replace(world, some).replace("where z0.z is not null", "").replace(
        "from s0 where z is not null", "from s0 where z is not null and o_orderkey % 3 <> 0").replace("o_custkey, z0.z", "o_custkey, o_orderkey, z0.z")
    attrs = """a as (
      select 'layer-' || s_nationkey layer, 'altitude' name, cast(s_suppkey * 10 as varchar) v, s_suppkey nth from supplier
      union all select 'layer-' || s_nationkey, 'millis', cast(case when s_suppkey % 3 = 0 then -1 else s_suppkey end as varchar), s_suppkey from supplier)"""
    sql["read_attribute"] = f"with {attrs} select layer, name, arg_max(v, nth) as value from a group by layer, name"
    sql["layer_done"] = f"""with {attrs}, last as (select layer, arg_max(cast(v as bigint), nth) m from a where name = 'millis' group by layer)
      select layer, case when m > -1 then 'ok' else 'no' end status from last"""
    sql["read_geojson"] = f"with {SUPPLIER_RINGS} select g geom_id, 0 part, 0 ring, seq, x, y from ring"
    sql["read_points"] = "select s_suppkey point_id, ((s_suppkey * 37) % 100 + 0.5e0) * 1000.0e0 x, -(floor(s_suppkey * 3 / 2.0e0) + 0.5e0) * 1000.0e0 y from supplier"
    sql["viewpoints_from_args"] = """select s_suppkey vp_id, s_suppkey * 1.0e0 x, s_nationkey * 2.0e0 y, s_acctbal view_height, 0.0e0 angle, -1.0e0 fov,
      case when s_suppkey % 4 = 0 then cast('-inf' as double) else s_suppkey % 4 * 100.0e0 end altitude from supplier"""

    # Scalars
    sql["to_web_mercator"] = f"with g as (select o_orderkey, {LONLAT} from orders) select o_orderkey, round({MERC_X}, 3) x, round({MERC_Y}, 3) y from g"
    sql["key_extent"] = f"""with {T}, k as (select distinct c // {TS} col, r // {TS} row from t where z is not null)
      select cast(col as int) col, cast(row as int) "row", col * 16000.0e0 xmin, 0.0e0 - (row + 1) * 16000.0e0 ymin,
      (col + 1) * 16000.0e0 xmax, 0.0e0 - row * 16000.0e0 ymax from k"""
    sql["cell_center"] = f"with {T} select c, r, (c + 0.5e0) * 1000.0e0 x, 0.0e0 - (r + 0.5e0) * 1000.0e0 y from t"
    sql["map_to_cell"] = "select c_custkey, cast(floor((c_acctbal * 7.5e0) / 1000.0e0) as int) c, cast(floor((0.0e0 + c_custkey * 99.5e0) / 1000.0e0) as int) r from customer"
    sql["key_shift"] = f"""with {T}, k as (select distinct c // {TS} col, r // {TS} row from t where z is not null)
      select cast(col as int) col, cast(row as int) "row", cast(col // 4 as int) up_col, cast(row // 4 as int) up_row from k"""
    sql["zorder_key"] = f"""with k as (select o_orderkey, o_orderkey % 1000 col, o_custkey % 1000 row from orders)
      select o_orderkey, {ZKEY} zkey from k"""
    sql["is_data"] = f"with {T} select c, r, z is not null is_data, coalesce(floor(z - 200.0e0) > 0, false) positive from t"
    sql["class_index"] = f"with {T} select c, r, cast(case when z is not null then least(greatest(ceil(z / 2.0e0), 0), 224) end as int) class from t"
    sql["or_default"] = "select c_custkey, coalesce(case when c_acctbal > 0 then c_acctbal end, 144000.0e0) max_distance from customer"

    # Filters
    sql["filter_keys"] = f"""with {T}, {STARTS}, k as (select distinct c // {TS} col, r // {TS} row from starts)
      select c, r, z from t join k on c // {TS} = col and r // {TS} = row where z is not null"""
    sql["mask_layer"] = f"""with {T}, {HEIGHT}, {RING},
      e as (select a.x ax, a.y ay, b.x bx, b.y by_ from pv a join pv b on a.ring = b.ring and b.i = a.i + 1),
      hit as (select t.c, t.r, max(t.z) z, sum(case when (ay > t.r + 0.5e0) <> (by_ > t.r + 0.5e0)
        and t.c + 0.5e0 < (bx - ax) * (t.r + 0.5e0 - ay) / (by_ - ay) + ax then 1 else 0 end) n from t cross join e where t.z is not null group by t.c, t.r)
      select c, r, z from hit where n % 2 = 1"""

    sql["mask_overlapping"] = f"""with {T}, {SUPPLIER_RINGS},
      cell_ring as (select g, seq, x / 1000.0e0 x, (0.0e0 - y) / 1000.0e0 y from ring),
      e as (select a.g, a.x ax, a.y ay, b.x bx, b.y by_ from cell_ring a join cell_ring b on b.g = a.g and b.seq = a.seq + 1),
      hit as (select t.c, t.r, t.z, e.g, count(*) n from t join e on (ay > t.r + 0.5e0) <> (by_ > t.r + 0.5e0)
        and t.c + 0.5e0 < (bx - ax) * (t.r + 0.5e0 - ay) / (by_ - ay) + ax where t.z is not null group by 1, 2, 3, 4)
      select distinct c, r, z from hit where n % 2 = 1"""

    # Statistics
    sql["histogram"] = f"with {T} select cast(floor(z / 25.0e0) as bigint) bin, count(*) n from t where z is not null group by 1"
    sql["quantile_breaks"] = f"""with {T}, o as (select z, row_number() over (order by z) nth, count(*) over () n from t where z is not null)
      select cast(i as int) i, min(z) as break from range(1, 257) q(i) join o on nth >= ceil(i / 256.0e0 * n) group by i"""
    sql["layer_breaks"] = f"""with {T}, b as (select floor(z / 25.0e0) * 25.0e0 x, count(*) y from t where z is not null group by 1),
      cum as (select x, sum(y) over (order by x) upto, sum(y) over () total from b)
      select cast(i as int) i, min(x) as break from range(1, 33) q(i) join cum on upto * 32 >= i * total group by i"""
    sql["histogram_approx"] = f"with {T} select cast(80 as bigint) bins, count(*) cells, true even, true near from t where z is not null"
    sql["quantile_breaks_approx"] = "select cast(i as int) i, true near from range(1, 257) q(i)"
    sql["count_points"] = "select count(*) points from supplier"

    # Focal
    sql["slope"] = f"with {T}, {slope_cte()} select c, r, round(z, 6) z from sl"
    for name, across in (("boundary_points", False), ("boundary_points_across_tiles", True)):
        sql[name] = f"""with {T}, {FULL}, {boundary_cte('full_cells', across)} select (c + 0.5e0) * 1000.0e0 x, 0.0e0 - (r + 0.5e0) * 1000.0e0 y,
          300.0e0 view_height, 0.0e0 angle, -1.0e0 fov, cast('-inf' as double) altitude from edge"""

    sql["collect_points"] = f"""with {T}, {FULL}, {STARTS}, k as (select distinct c // {TS} col, r // {TS} row from starts),
      {boundary_cte('full_cells')} select (c + 0.5e0) * 1000.0e0 x, 0.0e0 - (r + 0.5e0) * 1000.0e0 y, 300.0e0 view_height
      from edge join k on c // {TS} = col and r // {TS} = row"""

    # Viewsheds
    near = lambda vps: f"with {T}, {vps}, {sight_cte('vps', 25, 25000.0)}"
    sql["viewshed"] = f"{near(sup)} {OR}"
    sql["viewshed_combine_debug"] = f"{near(sup)} select cast(c as int) c, cast(r as int) r, cast(sum(vis) as double) z from sight group by 1, 2"
    sql["viewshed_min_altitude"] = f"{near(supplier_vps(altitude='420.0e0 + s_nationkey'))} {OR}"
    sql["fov_cut"] = f"{near(supplier_vps(angle='s_nationkey * 0.25e0', fov='0.3e0'))} {OR}"
    sql["viewshed_absolute"] = f"{near(supplier_vps(height='300.0e0 + s_nationkey * 10', absolute=True))} {OR}"
    sql["viewshed_flat_earth"] = f"with {T}, {sup}, {sight_cte('vps', 12, 12500.0, curvature=False)} {OR}"
    sql["touched_keys"] = f"{near(sup)} select distinct cast(c // {TS} as int) col, cast(r // {TS} as int) \"row\" from sight"
    nation_vps = f"""vps as (select n_nationkey vp, 1 n, z.c, z.r, z.z + 4000.0e0 + n_nationkey eye, 0.0e0 angle, -1.0e0 fov, cast('-inf' as double) altitude
      from nation join t z on z.c = n_nationkey * 4 and z.r = n_nationkey % 5 where z.z is not null)"""
    sql["viewshed_combine_and"] = f"""with {T}, {nation_vps}, {sight_cte('vps', 120, 120000.0)}
      select cast(c as int) c, cast(r as int) r, case when sum(vis) = (select count(*) from vps) then 1.0e0 else 0.0e0 end z from sight group by 1, 2"""

    # Cost distance
    sql["travel_cost"] = f"with recursive {T}, {FR}, {STARTS}, {cost_cte('fr', 'starts', 20000.0)} select cast(c as int) c, cast(r as int) r, round(cost, 4) z from cd"
    sql["max_cost"] = f"with recursive {T}, {FR}, {STARTS}, {cost_cte('fr', 'starts', 7500.0)} select cast(c as int) c, cast(r as int) r, round(cost, 4) z from cd"

    sql["travel_cost_negative_keys"] = f"""with recursive {T}, {FR}, {STARTS}, {cost_cte('fr', 'starts', 20000.0)}
      select cast(c - 50 as int) c, cast(r - 40 as int) r, round(cost, 4) z from cd"""

    # Levels and outlines
    sql["pyramid"] = f"with {T}, {levels_sql('t')}"
    for method, function in (("mean", "avg"), ("max", "max"), ("min", "min")):
        sql[f"pyramid_{method}"] = f"with {T} select cast(c // 2 as int) c, cast(r // 2 as int) r, round({function}(z), 9) z from t where z is not null group by 1, 2"
    edges = "ed as (select a.g, a.x ax, a.y ay, b.x bx, b.y by_ from ring a join ring b on b.g = a.g and b.seq = a.seq + 1)"
    sql["rasterize_boundary"] = f"""with {SUPPLIER_RINGS}, {edges}, {outline_cte('ed')}
      select round(x0 + (gc + 0.5e0) * sx, 3) x, round(y1 - (gr + 0.5e0) * sy, 3) y, 250.0e0 view_height, cast('-inf' as double) altitude from outline"""

    tables, rows = levels_parts("t")
    sql["pyramid_retiled"] = f"""with {T}, {tables}, every as ({rows}) select zoom, cast(c // 24 as int) col, cast(r // 24 as int) "row",
      count(*) n, round(sum(z), 4) total from every group by 1, 2, 3"""
    sql["retiled"] = data

    # Rendering
    stops = ", ".join(f"({i}, {a}e0, {b}e0, {c}e0)" for i, (a, b, c) in enumerate(STOPS))
    mix = lambda k: f"cast(coalesce(floor(a.{k} + (b.{k} - a.{k}) * (spot - lo) + 0.5e0), 0) as int)"
    sql["render_stored"] = f"""with {T}, {FULL}, bars as (select floor(z / 25.0e0) * 25.0e0 x, count(*) y from t where z is not null group by 1),
      cum as (select x, sum(y) over (order by x) upto, sum(y) over () total from bars),
      brk as (select i, min(x) b from range(1, 33) q(i) join cum on upto * 32 >= i * total group by i),
      sup as (select count(*) p from supplier), stops(i, red, green, blue) as (values {stops}),
      cls as (
        select 'by-breaks' layer, f.c, f.r, max(f.z) z, case when max(f.z) is not null then count(b) filter (b < f.z) end k, 31.0e0 steps
          from full_cells f cross join (select b from brk where i < 32) group by f.c, f.r union all
        select 'by-points', c, r, z, case when z is not null then least(greatest(ceil(z), 0), p) end, greatest(p, 1) * 1.0e0 from full_cells cross join sup union all
        select 'plain', c, r, z, case when z is not null then case when z > 0 then 1 else 0 end end, 1.0e0 from full_cells),
      pos as (select *, k * 4.0e0 / steps spot, case when z is not null then least(floor(k * 4.0e0 / steps), 3) end lo from cls)
      select layer, cast(c as int) c, cast(r as int) r, {mix('red')} red, {mix('green')} green, {mix('blue')} blue, case when z is null then 0 else 255 end alpha
      from pos left join stops a on a.i = lo left join stops b on b.i = lo + 1"""
    sql["render_layer"] = f"with {T}, {FULL}, {render_sql('full_cells')}"
    sql["render_tile"] = f"with {T}, {FULL}, {TOP_TILE}, one as (select f.c, f.r, f.z from full_cells f join top_tile on c // {TS} = col and r // {TS} = row), {render_sql('one')}"

    # Whole jobs
    sql["observer_viewshed"] = f"with {T}, {TOP_CELL}, {observer_vp}, {sight_cte('ovp', 40, 40000.0)}, {observer_out}, {levels_sql('seen')}"
    nations = lambda name, test, height: f"""{name} as (select n_nationkey vp, 1 n, z.c, z.r, z.z eye, 0.0e0 angle, -1.0e0 fov, {height} altitude
      from nation join t z on z.c = n_nationkey * 4 and z.r = n_nationkey % 5 where z.z is not null and {test})"""
    tables, rows = levels_parts("seen", keys="layer,")
    sql["observer_many"] = f"""with {T}, {nations('evp', 'n_nationkey % 2 = 0', '430.0e0 + n_nationkey')}, {nations('ovp', 'n_nationkey % 2 = 1', '430.0e0 + n_nationkey')},
      {sight_cte('evp', 20, 20000.0)}, {sight_cte('ovp', 30, 30000.0, tag='2')},
      seen as (select 'seen-' || vp layer, c, r, cast(vis as double) z from sight union all select 'seen-' || vp, c, r, cast(vis as double) from sight2),
      {tables} {rows}"""
    sql["touched_runs"] = f"""with {T}, {nations('evp', 'true', '430.0e0')}, {sight_cte('evp', 20, 20000.0)}
      select distinct cast(c // 32 as int) col, cast(r // 32 as int) "row" from sight"""
    seen2 = f"""up as (select c // 2 c, r // 2 r, z from seen where c % 2 = 1 and r % 2 = 1),
      touched as (select distinct c // {2 * TS} col, r // {2 * TS} row from seen),
      up_full as (select col * {TS} + i.i c, row * {TS} + j.j r, up.z from touched cross join range({TS}) i(i) cross join range({TS}) j(j)
        left join up on up.c = col * {TS} + i.i and up.r = row * {TS} + j.j)"""
    craft_vps = "cvp as (select row_number() over () vp, 1 n, 2 * c + 1 c, 2 * r + 1 r, 460.0e0 eye, 0.0e0 angle, -1.0e0 fov, cast('-inf' as double) altitude from edge)"
    second = sight_cte("cvp", 20, 20000.0, tag="2")
    sql["craft_viewshed"] = f"""with {T}, {TOP_CELL}, {observer_vp}, {sight_cte('ovp', 40, 40000.0)}, {observer_out}, {seen2},
      {boundary_cte('up_full')}, {craft_vps}, {second},
      seen_craft as (select c, r, cast(max(vis) as double) z from sight2 group by c, r), {levels_sql('seen_craft')}"""
    area = f"""pv0 as (select ring, i, x * 0.008e0 lon, -y * 0.008e0 lat from pv),
      pm as (select ring, i, {MERC_X} x, {MERC_Y} y from pv0),
      ed as (select 0 g, a.x ax, a.y ay, b.x bx, b.y by_ from pm a join pm b on b.ring = a.ring and b.i = a.i + 1)"""
    sql["polygon_viewshed"] = f"""with {T}, {HEIGHT}, {RING}, {area}, {outline_cte('ed')},
      pvp0 as (select distinct cast(floor((x0 + (gc + 0.5e0) * sx) / 1000.0e0) as int) c, cast(floor((0.0e0 - (y1 - (gr + 0.5e0) * sy)) / 1000.0e0) as int) r from outline),
      pvp as (select row_number() over () vp, 1 n, c, r, 450.0e0 eye, 0.0e0 angle, -1.0e0 fov, cast('-inf' as double) altitude from pvp0),
      {sight_cte('pvp', 15, 15000.0)}, {observer_out}, {levels_sql('seen')}"""
    sql["travel_cost_surface"] = f"""with recursive {T}, {slope_cte()}, fs as (select c, r, z f from sl), {STARTS}, {cost_cte('fs', 'starts', 20000.0)},
      cost as (select c, r, round(cost, 4) z from cd), {levels_sql('cost', extra=', (select count(*) from cost) cells')}"""
    sql["viewshed_terrain_prep"] = f"with {T}, {levels_sql('t', extra=', cast(80 as bigint) bins, (select count(*) from t where z is not null) cells')}"
    sql["viewshed_debug"] = f"""{near(sup)} select 'seen-' || (c // {TS}) || '-' || (r // {TS}) tile, (c + 0.5e0) * 1000.0e0 x, 0.0e0 - (r + 0.5e0) * 1000.0e0 y,
      cast(max(vis) as double) z from sight group by c, r"""
    return sql
