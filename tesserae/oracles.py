"""DuckDB statements for the queries, written on their own from the operators' definitions."""

from __future__ import annotations


def r(x: str, digits: int = 6) -> str:
    return f"(round({x}, {digits}) + 0.0)"


PLANE = "img AS (SELECT vec_id AS z, 0 AS y, i - 1 AS x, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) t(i))"
CUBE = """raw AS (SELECT CAST(l_quantity AS INT) - 1 AS z, l_linenumber - 1 AS y, CAST(round_even(l_discount * 100, 0) AS INT) AS x, avg(l_extendedprice) / 79193::DOUBLE AS v FROM lineitem GROUP BY ALL),
cube AS (SELECT a.i AS z, b.i AS y, c.i AS x, coalesce(v, 0) AS v FROM range(50) a(i), range(7) b(i), range(11) c(i) LEFT JOIN raw ON raw.z = a.i AND raw.y = b.i AND raw.x = c.i)"""
BOX = "box AS (SELECT 0 AS c, p.i AS z, q.i AS y, t.i AS x, coalesce(v, 0) AS v FROM range(50) p(i), range(8) q(i), range(12) t(i) LEFT JOIN cube ON p.i = z AND q.i = y AND t.i = x)"
LAYERS = CUBE + ",\nwhole AS (SELECT 0 AS c, z, y, x, v FROM cube),\n" + BOX


def axis(name: str, image: str, tile: int, step: float = 0.5) -> str:
    """Positions ``s`` of patches along an axis, numbered by ``i``; ``m`` of them."""
    count = f"greatest(CAST(ceil((({image}) - {tile})::DOUBLE / {int(tile * step)}) AS INT) + 1, 0)"
    return f"{name} AS (SELECT i, m, CASE WHEN m > 1 THEN CAST(round_even((image - {tile})::DOUBLE / (m - 1) * i, 0) AS INT) ELSE 0 END AS s FROM (SELECT image, m, unnest(range(m)) AS i FROM (SELECT ({image}) AS image, {count} AS m)))"


# the network of the blending queries: norm within the patch, leaky activation, three heads
NET = """st AS (SELECT pid, avg(v) AS mu, var_pop(v) AS q FROM pv GROUP BY pid),
act AS (SELECT pv.*, CASE WHEN v > mu THEN (v - mu) / sqrt(q + 1e-5::DOUBLE) ELSE 0.01::DOUBLE * (v - mu) / sqrt(q + 1e-5::DOUBLE) END AS a FROM pv JOIN st USING (pid)),
lg AS (SELECT act.*, k, a * hw + hb AS l FROM act, (VALUES (0, 0.8::DOUBLE, 0.1::DOUBLE), (1, -0.5, 0.2), (2, 0.3, -0.1)) h(k, hw, hb))"""
PLANE_NET = f"""WITH {PLANE}, {axis("az", "SELECT max(vec_id) + 1 FROM embeddings", 32)}, {axis("ax", "64", 32)},
pv AS (SELECT az.i * ax.m + ax.i AS pid, z, y, x, z - az.s AS dz, x - ax.s AS dx,
  10 * exp(-((z - az.s - 16) ** 2 + (x - ax.s - 16) ** 2) / 32::DOUBLE) * exp(0) AS w, v
  FROM img JOIN az ON z >= az.s AND z < az.s + 32 JOIN ax ON x >= ax.s AND x < ax.s + 32),
{NET}"""
# 16 x 8 x 16 patches over the cube padded to 50 x 8 x 16
PADDED = "pad AS (SELECT p.i AS z, q.i AS y, t.i AS x, coalesce(v, 0) AS v FROM range(50) p(i), range(8) q(i), range(16) t(i) LEFT JOIN {0} ON p.i = z AND q.i = y + 0 AND t.i = x + 2)"
CT = "ct AS (SELECT z, y, x, (least(greatest(v, 0.01::DOUBLE), 1.1::DOUBLE) - 0.6::DOUBLE) / 0.31::DOUBLE AS v FROM cube)"
CUBE_NET = f"""WITH {CUBE}, {CT}, {PADDED.format("ct")}, {axis("az", "50", 16)},
pv AS (SELECT i AS pid, z, y, x, v, 10 * exp(-((z - s - 8) ** 2 / 8::DOUBLE + (y - 4) ** 2 / 2::DOUBLE + (x - 8) ** 2 / 8::DOUBLE)) AS w FROM pad JOIN az ON z >= s AND z < s + 16),
{NET}"""
CROPPED = "y < 7 AND x >= 2 AND x < 13"
BLEND = f"sum(w * l) / sum(w)"

SQL: dict[str, str] = {}

SQL["ct_normalize"] = f"WITH {CUBE} SELECT z, y, x, {r('(least(greatest(v, 0.25::DOUBLE), 1::DOUBLE) - 0.6::DOUBLE) / 0.31::DOUBLE')} AS v FROM cube"


def _zscore(mask: str) -> str:
    return f"""WITH d AS (SELECT l_returnflag AS volume_id, l_discount AS v, l_quantity AS q FROM lineitem),
s AS (SELECT volume_id, coalesce(avg(v) FILTER ({mask}), 0) AS m, coalesce(stddev_pop(v) FILTER ({mask}), 1) AS sd FROM d GROUP BY volume_id)
SELECT volume_id, {r("(v - m) / greatest(sd, 1e-8)")} AS v, count(*) AS n FROM d JOIN s USING (volume_id) GROUP BY ALL"""


SQL["zscore_foreground"] = _zscore("v <> 0")
SQL["zscore_custom_mask"] = _zscore("q > 25")
SQL["zscore_empty_mask"] = _zscore("q < 0")
SQL["normalize_dispatch"] = f"""WITH o AS (SELECT CAST(o_custkey % 4 AS INT) AS c, CAST(o_orderkey AS INT) AS z, o_totalprice / 1000::DOUBLE AS v FROM orders),
s AS (SELECT c, coalesce(avg(v) FILTER (v <> 0), 0) AS m, coalesce(stddev_pop(v) FILTER (v <> 0), 1) AS sd FROM o GROUP BY c)
SELECT c, z, {r("CASE c WHEN 0 THEN (least(greatest(v, 10), 300) - 100) / 50 WHEN 1 THEN (v - m) / greatest(sd, 1e-8) WHEN 2 THEN v ELSE (least(greatest(v, 20), 280) - 150) / 61.7::DOUBLE END")} AS v FROM o JOIN s USING (c)"""
SQL["normalize_engine_unknown"] = f"SELECT CAST(0 AS INT) AS c, CAST(o_orderkey AS INT) AS z, {r('o_totalprice / 1000::DOUBLE')} AS v FROM orders"
SQL["pad_symmetric"] = f"WITH {CUBE}, {PADDED.format('cube')} SELECT z, y, x, {r('v')} AS v FROM pad"
SQL["crop_inverse"] = f"WITH {CUBE} SELECT z, y, x, {r('v')} AS v FROM cube"
STEPS = """images AS (SELECT CAST(o_custkey % 97 AS INT) AS axis, CAST(count(*) AS INT) AS image, CAST(8 * (1 + o_custkey % 97 % 4) AS INT) AS tile FROM orders GROUP BY ALL),
counted AS (SELECT *, greatest(CAST(ceil((image - tile)::DOUBLE / (tile // 2)) AS INT) + 1, 0) AS m FROM images),
steps AS (SELECT axis, image, tile, i, CASE WHEN m > 1 THEN CAST(round_even((image - tile)::DOUBLE / (m - 1) * i, 0) AS INT) ELSE 0 END AS s FROM (SELECT *, unnest(range(m)) AS i FROM counted))"""
SQL["tile_steps"] = f"WITH {STEPS} SELECT axis, image, tile, i, s FROM steps"
SQL["tile_grid_3d"] = f"WITH {axis('az', '50', 16)} SELECT i AS pid, s AS s0, 0 AS s1, 0 AS s2 FROM az"
SQL["tile_step_gap"] = f"WITH {STEPS}, g AS (SELECT axis, tile, s - lag(s) OVER (PARTITION BY axis, tile ORDER BY i) AS gap FROM steps) SELECT axis, tile, coalesce(max(gap), 0) AS gap, count(*) AS n FROM g GROUP BY ALL"
SQL["patch_extract"] = f"{PLANE_NET} SELECT pid, count(*) AS n, min(z) AS z0, max(z) AS z1, min(x) AS x0, CAST(sum(dz) AS BIGINT) AS d0, CAST(sum(dx) AS BIGINT) AS d2, {r('sum(v)', 5)} AS v FROM pv GROUP BY pid"
SQL["padding_needed"] = """WITH v AS (SELECT l_returnflag AS flag, l_linenumber, CAST(max(l_quantity) AS INT) AS z, CAST(max(round_even(l_discount * 100, 0) + 1) AS INT) AS x FROM lineitem WHERE l_quantity <= 8 * l_linenumber GROUP BY ALL)
SELECT flag, bool_or(z < 32 OR x < 11) AS some, bool_and(z < 32 OR x < 11) AS all, count(*) FILTER (z < 32 OR x < 11) AS n FROM v GROUP BY flag"""
SQL["gaussian_map"] = f"""WITH {CUBE}, {PADDED.format("cube")}, {axis("az", "50", 16)}
SELECT z - s AS d0, y AS d1, x AS d2, {r("10 * exp(-((z - s - 8) ** 2 / 8::DOUBLE + (y - 4) ** 2 / 2::DOUBLE + (x - 8) ** 2 / 8::DOUBLE))", 9)} AS w, count(*) AS n FROM pad JOIN az ON z >= s AND z < s + 16 GROUP BY ALL"""
SQL["gaussian_underflow_floor"] = f"""WITH g AS (SELECT i, exp(-((i - 25) ** 2) / (2 * (50 / 400::DOUBLE) ** 2)) AS w FROM range(50) t(i)), least_one AS (SELECT min(w) AS m FROM g WHERE w <> 0)
SELECT {r("ln(CASE WHEN w = 0 THEN m ELSE w END)", 5)} AS log_w, count(*) AS n FROM lineitem JOIN g ON i = CAST(l_quantity AS INT) - 1, least_one GROUP BY ALL"""
SQL["blend_gaussian"] = f"{PLANE_NET} SELECT z, y, x, k, {r(BLEND)} AS l FROM lg GROUP BY z, y, x, k"
SQL["blend_uniform"] = f"{PLANE_NET} SELECT z, y, x, k, {r('avg(l)')} AS l FROM lg GROUP BY z, y, x, k"
SQL["blend_3d_padded"] = f"{CUBE_NET} SELECT z, y, x - 2 AS x, k, {r(BLEND)} AS l FROM lg WHERE {CROPPED} GROUP BY z, y, x, k"
SQL["blend_rolling_z"] = SQL["blend_strict"] = SQL["blend_streaming"] = SQL["blend_3d_padded"]
SQL["blend_rolling_state"] = f"""WITH raw AS (SELECT l_returnflag AS vol, CAST(l_quantity AS INT) - 1 AS z, l_linenumber - 1 AS y, CAST(round_even(l_discount * 100, 0) AS INT) AS x, avg(l_extendedprice) / 79193::DOUBLE AS v FROM lineitem GROUP BY ALL),
pad AS (SELECT f.vol, p.i AS z, q.i AS y, t.i AS x, coalesce(v, 0) AS v FROM (SELECT DISTINCT vol FROM raw) f, range(50) p(i), range(8) q(i), range(16) t(i) LEFT JOIN raw ON raw.vol = f.vol AND raw.z = p.i AND raw.y = q.i AND raw.x = t.i - 2),
{axis("az", "50", 16)},
pv AS (SELECT vol || '/' || i AS pid, vol, z, y, x, v, 10 * exp(-((z - s - 8) ** 2 / 8::DOUBLE + (y - 4) ** 2 / 2::DOUBLE + (x - 8) ** 2 / 8::DOUBLE)) AS w FROM pad JOIN az ON z >= s AND z < s + 16),
{NET}
SELECT vol AS volume_id, z, y, x - 2 AS x, k, {r(BLEND)} AS l FROM lg WHERE {CROPPED} GROUP BY vol, z, y, x, k"""
SQL["tta_axis_subsets"] = f"WITH {CUBE}, {axis('az', '(SELECT max(z) + 1 FROM cube)', 16)} SELECT i AS pid, pass, axes FROM az, (VALUES (0, ''), (1, '0'), (2, '1'), (3, '2'), (4, '01'), (5, '02'), (6, '12'), (7, '012')) t(pass, axes)"
SQL["tta_mirror_mean"] = f"""WITH {CUBE},
near AS (SELECT z, y, x, v, lag(v, 1, 0) OVER w AS before, lead(v, 1, 0) OVER w AS after FROM cube WINDOW w AS (PARTITION BY z, y ORDER BY x))
SELECT z, y, x, {r("((before - 2 * after) + (after - 2 * before)) / 2 / 7919::DOUBLE")} AS v FROM near"""
BEST = f"bl AS (SELECT z, y, x, k, {BLEND} AS l FROM lg GROUP BY z, y, x, k), best AS (SELECT z, y, x, k AS label, l AS score FROM bl QUALIFY row_number() OVER (PARTITION BY z, y, x ORDER BY l DESC, k) = 1)"
SQL["argmax_labels"] = f"{PLANE_NET}, {BEST} SELECT z, label, count(*) AS n, {r('sum(score)', 5)} AS score FROM best GROUP BY z, label"
SEGMENT = """ranked AS (SELECT pid, z, y, x, k, w * l AS s, row_number() OVER (PARTITION BY pid, z, y, x ORDER BY w * l DESC, k) AS n FROM lg),
two AS (SELECT pid, z, y, x, max(k) FILTER (n = 1) AS label1, max(s) FILTER (n = 1) AS score1, coalesce(max(k) FILTER (n = 2), 0) AS label2, coalesce(max(s) FILTER (n = 2), '-inf'::DOUBLE) AS score2 FROM ranked GROUP BY ALL),
seg AS (SELECT * FROM two QUALIFY row_number() OVER (PARTITION BY z, y, x ORDER BY score1 DESC, pid) = 1)"""
SQL["segment_top2"] = f"{PLANE_NET}, {SEGMENT} SELECT z, x, label1, {r('score1')} AS score1, label2, {r('score2')} AS score2 FROM seg"
SQL["segment_single_class"] = f"{CUBE_NET.replace('lg AS (', 'lg AS (SELECT * FROM (').replace('h(k, hw, hb))', 'h(k, hw, hb)) WHERE k = 0)')}, {SEGMENT} SELECT z, label1, label2, score2 = '-inf'::DOUBLE AS no_second, count(*) AS n, {r('sum(score1)', 4)} AS score1 FROM seg GROUP BY ALL"
SQL["segment_margin"] = f"{PLANE_NET}, {SEGMENT} SELECT x, count(DISTINCT label1) AS labels, {r('avg(score1 - score2)', 5)} AS mean, {r('median(score1 - score2)', 5)} AS median, {r('quantile_cont(score1 - score2, 0.1)', 5)} AS p10 FROM seg GROUP BY x"
SQL["segment_vs_argmax"] = f"{PLANE_NET}, {BEST}, {SEGMENT} SELECT label1, label, count(*) AS n FROM seg JOIN best USING (z, y, x) GROUP BY ALL"
SQL["softmax_probs"] = f"{CUBE_NET}, bl AS (SELECT z, y, x, k, {BLEND} AS l FROM lg WHERE {CROPPED} GROUP BY z, y, x, k), e AS (SELECT *, exp(l) AS e FROM bl) SELECT z, y, x - 2 AS x, k, {r('e / sum(e) OVER (PARTITION BY z, y, x)')} AS p FROM e"
SQL["softmax_array"] = SQL["softmax_probs"]


# layers: each helper adds one step (name, statement) that reads (c, z, y, x, v)


def kernel(n_out: int, n_in: int, size: tuple[int, int, int], salt: int = 0) -> str:
    d, h, w = size
    return f"(SELECT o, i, dz, dy, dx, ((7 * o + 5 * i + 3 * dz + 2 * dy + dx + {salt}) % 11 - 5) / 10::DOUBLE AS w FROM range({n_out}) a(o), range({n_in}) b(i), range({d}) p(dz), range({h}) q(dy), range({w}) t(dx))"


def conv(name: str, source: str, n_out: int, n_in: int, out: tuple[int, int, int], size=(3, 3, 3), stride: int = 1, salt: int = 0, bias: bool = False) -> str:
    """Gathers: every output place looks up its inputs."""
    p = [(k - 1) // 2 for k in size]
    places = ", ".join(f"range({n}) o{a}({a})" for a, n in zip("zyx", out))
    asked = ", ".join(f"{a} * {stride} + d{a} - {q} AS f{a}" for a, q in zip("zyx", p))
    add = " + (g.o - 1) / 10::DOUBLE" if bias else ""
    asked = f"(SELECT o, i, w, z, y, x, {asked} FROM (SELECT * FROM {places}), {kernel(n_out, n_in, size, salt)})"
    return f"{name} AS (SELECT g.o AS c, g.z, g.y, g.x, sum(f.v * g.w){add} AS v FROM {asked} g JOIN {source} f ON f.c = g.i AND f.z = g.fz AND f.y = g.fy AND f.x = g.fx GROUP BY g.o, g.z, g.y, g.x)"


def norm(name: str, source: str, act: bool = True) -> str:
    h = "(v - avg(v) OVER (PARTITION BY c)) / sqrt(var_pop(v) OVER (PARTITION BY c) + 1e-5::DOUBLE)"
    value = f"CASE WHEN h > 0 THEN h ELSE 0.01::DOUBLE * h END" if act else "h"
    return f"{name} AS (SELECT c, z, y, x, {value} AS v FROM (SELECT *, {h} AS h FROM {source}))"


def up(name: str, source: str, n_out: int, n_in: int, salt: int = 0, bias: bool = False) -> str:
    add = " + any_value(k.o - 1) / 10::DOUBLE" if bias else ""
    return f"{name} AS (SELECT k.o AS c, 2 * f.z + dz AS z, 2 * f.y + dy AS y, 2 * f.x + dx AS x, sum(f.v * k.w){add} AS v FROM {source} f JOIN {kernel(n_out, n_in, (2, 2, 2), salt)} k ON f.c = k.i GROUP BY ALL)"


def pool(name: str, source: str) -> str:
    return f"{name} AS (SELECT c, z // 2 AS z, y // 2 AS y, x // 2 AS x, avg(v) AS v FROM {source} GROUP BY ALL)"


def joined(name: str, a: str, b: str) -> str:
    return f"{name} AS (SELECT c, z, y, x, CASE WHEN v > 0 THEN v ELSE 0.01::DOUBLE * v END AS v FROM (SELECT c, z, y, x, sum(v) AS v FROM (SELECT * FROM {a} UNION ALL SELECT * FROM {b}) GROUP BY c, z, y, x))"


def head(name: str, source: str, channels: int) -> str:
    return f"{name} AS (SELECT o AS k, z, y, x, sum(v * ((3 * o + 2 * c) % 7 - 3) / 10::DOUBLE) + (o - 1) / 10::DOUBLE AS l FROM {source}, range(3) t(o) GROUP BY o, z, y, x)"


def select(steps: list[str], last: str, value: str = "v", key: str = "c", digits: int = 6) -> str:
    steps = [step.replace(" AS (", " AS MATERIALIZED (", 1) for step in steps]  # each is read several times
    return f"WITH {LAYERS}, {', '.join(steps)} SELECT {key}, z, y, x, {r(value, digits)} AS {value} FROM {last}"


WHOLE, FULL, HALF = (50, 7, 11), (50, 8, 12), (25, 4, 6)
SQL["conv3d_same"] = select([conv("a", "whole", 2, 1, WHOLE, bias=True)], "a")
SQL["conv3d_strided"] = select([conv("a", "box", 2, 1, HALF, stride=2, bias=True)], "a")
SQL["instance_norm"] = f"WITH {CUBE}, s AS (SELECT avg(v) AS m, var_pop(v) AS q FROM cube) SELECT 0 AS c, z, y, x, {r('(v - m) / sqrt(q + 1e-5::DOUBLE) * 1.5::DOUBLE - 0.25::DOUBLE')} AS v FROM cube, s"
SQL["leaky_relu"] = f"WITH {PLANE} SELECT z, {r('sum(CASE WHEN v > 0 THEN v ELSE 0.01::DOUBLE * v END)', 5)} AS v, count(*) FILTER (v < 0) AS below FROM img GROUP BY z"
SQL["conv_norm_act"] = select([conv("a", "whole", 2, 1, WHOLE, bias=True), norm("b", "a")], "b")
SQL["stacked_conv"] = select([conv("a", "box", 2, 1, HALF, stride=2), norm("b", "a"), conv("d", "b", 2, 2, HALF, salt=3), norm("e", "d")], "e")
SQL["avg_pool"] = f"WITH {CUBE} SELECT 0 AS c, z // 2 AS z, y // 2 AS y, x // 2 AS x, {r('avg(v)')} AS v FROM cube WHERE y < 6 AND x < 10 GROUP BY ALL"
SQL["residual_block"] = select([conv("a", "box", 2, 1, HALF, stride=2), norm("b", "a"), conv("d", "b", 2, 2, HALF, salt=3), norm("e", "d", False), pool("p", "box"), conv("s", "p", 2, 1, HALF, (1, 1, 1), salt=4), norm("t", "s", False), joined("u", "e", "t")], "u")
SQL["conv_transpose"] = select([up("a", "whole", 2, 1, bias=True)], "a")
SQL["skip_concat"] = select([conv("a", "whole", 2, 1, WHOLE, (1, 1, 1)), "b AS (SELECT * FROM a UNION ALL SELECT 2, z, y, x, v FROM whole)"], "b")
SQL["seg_head"] = select([conv("a", "whole", 2, 1, WHOLE, (1, 1, 1)), head("h", "a", 2)], "h", "l", "k")
NETS = """nets AS (SELECT p_partkey AS model, p_size % 4 + 2 AS n, 8 * (p_size % 3 + 1) AS base, 16 * (p_size % 5 + 2) AS most, p_size AS classes FROM part),
st AS (SELECT *, CAST(least(base * 2 ** s, most) AS BIGINT) AS f FROM (SELECT *, unnest(range(n)) AS s FROM nets))"""
SQL["deep_supervision_order"] = f"WITH {NETS} SELECT model, CAST(s AS INT) AS place, CAST(n - 2 - s AS INT) AS stage, CAST(f AS INT) AS width FROM st WHERE s < n - 1"
_DECODER = [up("up1", "low", 2, 3, 6), "cat AS (SELECT * FROM up1 UNION ALL SELECT c + 2, z, y, x, v FROM skip)", conv("o1", "cat", 2, 4, FULL, salt=7), norm("o2", "o1"), head("h", "o2", 2)]
SQL["tiny_unet"] = select([conv("a", "box", 2, 1, FULL), norm("skip", "a"), conv("b", "skip", 3, 2, HALF, stride=2, salt=3), norm("low", "b"), *_DECODER], "h", "l", "k", 5)
SQL["tiny_resenc_unet"] = select(
    [conv("a", "box", 2, 1, FULL), norm("stem", "a"),
     conv("r1", "stem", 2, 2, FULL, salt=1), norm("r2", "r1"), conv("r3", "r2", 2, 2, FULL, salt=2), norm("r4", "r3", False), joined("skip", "r4", "stem"),
     conv("q1", "skip", 3, 2, HALF, stride=2, salt=3), norm("q2", "q1"), conv("q3", "q2", 3, 3, HALF, salt=4), norm("q4", "q3", False),
     pool("q5", "skip"), conv("q6", "q5", 3, 2, HALF, (1, 1, 1), salt=5), norm("q7", "q6", False), joined("low", "q4", "q7"), *_DECODER], "h", "l", "k", 5)

SQL["stage_features"] = f"WITH {NETS} SELECT model, s AS stage, CAST(f AS INT) AS width FROM st"
# two convolutions of 27 places a stage and half, each with a bias and a norm of two vectors
LAYERS_OF = f"""WITH {NETS}, pairs AS (SELECT a.*, b.f AS low FROM st a LEFT JOIN st b ON a.model = b.model AND b.s = a.s + 1),
enc AS (SELECT a.model, a.f AS o, coalesce(b.f, 1) AS i FROM st a LEFT JOIN st b ON a.model = b.model AND b.s = a.s - 1),
listed AS (
  SELECT model, 'conv' AS kind, 27 * o * i AS p FROM enc UNION ALL SELECT model, 'conv', 27 * o * o FROM enc
  UNION ALL SELECT model, unnest(['bias', 'norm', 'norm', 'bias', 'norm', 'norm']), o FROM enc
  UNION ALL SELECT model, 'up', 8 * low * f FROM pairs WHERE low IS NOT NULL UNION ALL SELECT model, 'bias', f FROM pairs WHERE low IS NOT NULL
  UNION ALL SELECT model, 'conv', 54 * f * f FROM pairs WHERE low IS NOT NULL UNION ALL SELECT model, 'conv', 27 * f * f FROM pairs WHERE low IS NOT NULL
  UNION ALL SELECT model, unnest(['bias', 'norm', 'norm', 'bias', 'norm', 'norm']), f FROM pairs WHERE low IS NOT NULL
  UNION ALL SELECT model, 'head', classes * f FROM pairs WHERE low IS NOT NULL UNION ALL SELECT model, 'bias', classes FROM pairs WHERE low IS NOT NULL)"""
SQL["network_layers"] = f"{LAYERS_OF} SELECT model, kind, count(*) AS tensors, CAST(sum(p) AS BIGINT) AS parameters FROM listed GROUP BY ALL"
SQL["param_count"] = f"{LAYERS_OF} SELECT model, CAST(sum(p) AS BIGINT) AS parameters FROM listed GROUP BY ALL"
SQL["plan_defaults"] = """SELECT p_partkey AS id, CASE WHEN k = 1 THEN 'ResidualEncoderUNet' ELSE 'PlainConvUNet' END AS class_name, k = 1 AS residual, CASE WHEN k = 1 THEN p_size ELSE 32 END AS base,
  CASE WHEN k = 2 THEN p_size ELSE 320 END AS most, k <> 1 AS conv_bias, CASE WHEN k = 2 THEN 0.25::DOUBLE ELSE 0.01 END AS slope, CAST(k = 2 AS INT) AS n_options FROM (SELECT *, p_size % 4 AS k FROM part)"""
_TENSORS = """(SELECT ['enc.conv', 'dec.transpconvs.0', 'enc.norm', 'dec.ConvTranspose', 'enc.wide'][k + 1] || '.v' || vec_id || '.' || CASE k WHEN 4 THEN 'bias' ELSE 'weight' END AS key,
  [[2, 2, 2, 2, 4], [4, 2, 2, 2, 2], [64], [2, 4, 2, 2, 2], [2, 1, 4, 4, 2]][k + 1] AS s, embedding AS e, label FROM (SELECT *, vec_id % 5 AS k FROM embeddings))"""
SQL["weight_layout_transpose"] = f"""WITH t AS (SELECT key, s, e, contains(key, 'transpconv') OR contains(key, 'ConvTranspose') AS up FROM {_TENSORS}),
e AS (SELECT *, unnest(range(64)) AS j FROM t),
p AS (SELECT *, j // (s[2] * s[3] * s[4] * s[5]) AS a, j // (s[3] * s[4] * s[5]) % s[2] AS b, j % (s[3] * s[4] * s[5]) AS place FROM e WHERE len(s) = 5)
SELECT key, array_to_string(CASE WHEN up THEN [s[2], s[3], s[4], s[5], s[1]] ELSE [s[1], s[3], s[4], s[5], s[2]] END, 'x') AS shape,
  CASE WHEN up THEN (b * s[3] * s[4] * s[5] + place) * s[1] + a ELSE (a * s[3] * s[4] * s[5] + place) * s[2] + b END AS j, CAST(e[j + 1] AS DOUBLE) AS w FROM p
UNION ALL SELECT key, array_to_string(s, 'x'), j, CAST(e[j + 1] AS DOUBLE) FROM e WHERE len(s) <> 5"""
_KEYS = """(SELECT p_partkey, replace(['encoder.stages.%.0.convs.1.conv.weight', 'decoder.stages.%.convs.0.conv.weight', 'x%.all_modules.0.weight', 'decoder.encoder.stages.%.w', 'encoder.stages.%.0.foo.weight',
'encoder.stages.%.0.blocks.0.conv1.conv.weight', 'encoder.stages.%.0.convs', 'decoder.transpconvs.%.weight', 'net.stages.%.0.convs.0.all_modules.1.bias', 'stages.%.0.blocks.1.norm.weight'][p_partkey % 10 + 1], '%', p_size::VARCHAR) AS key, p_size FROM part)"""
_KEPT = "key NOT LIKE '%.all\\_modules.%' ESCAPE '\\' AND key NOT LIKE 'decoder.encoder.%'"
SQL["weight_key_filter"] = f"SELECT p_partkey, key FROM {_KEYS} WHERE {_KEPT}"
SQL["weight_key_remap"] = f"SELECT p_partkey, CASE WHEN key = 'decoder.transpconvs.7.weight' THEN 'decoder.up.7.weight' ELSE regexp_replace(key, '(^|\\.)stages\\.([0-9]+)\\.0\\.(convs|blocks)(\\.|$)', '\\1stages.\\2.\\3\\4') END AS key FROM {_KEYS} WHERE {_KEPT}"
_FUZZY = "replace(replace(replace(key, '.all_modules.0.', '.conv.'), '.all_modules.1.', '.norm.'), '.all_modules.2.', '.nonlin.')"
SQL["weight_key_fuzzy"] = f"SELECT p_partkey, key, {_FUZZY} AS fuzzy, regexp_replace(key, '(^|\\.)stages\\.([0-9]+)\\.0(\\.|$)', '\\1stages.\\2\\3') AS dropped FROM {_KEYS}"
SQL["weight_unmapped"] = f"""WITH k AS (SELECT p_partkey, key, {_FUZZY} AS fuzzy, p_size FROM {_KEYS}), known AS (SELECT DISTINCT fuzzy AS name FROM k WHERE p_size <= 20)
SELECT p_partkey, CASE WHEN key IN (FROM known) THEN key WHEN fuzzy IN (FROM known) THEN fuzzy ELSE key END AS key, key IN (FROM known) OR fuzzy IN (FROM known) AS mapped FROM k"""
SQL["weight_unmapped_head"] = f"""WITH k AS (SELECT key, {_FUZZY} AS fuzzy, p_size FROM {_KEYS}), known AS (SELECT DISTINCT fuzzy AS name FROM k WHERE p_size <= 20)
SELECT DISTINCT key FROM k WHERE key NOT IN (FROM known) AND fuzzy NOT IN (FROM known) ORDER BY key LIMIT 5"""
SQL["pending_conversions"] = """WITH p AS (SELECT *, 'm/fold_' || p_partkey || '/checkpoint_' || CASE WHEN p_size % 2 = 0 THEN 'final' ELSE 'best' END AS base FROM part)
SELECT base || '.pth' AS path, base || '.safetensors' AS target FROM p WHERE p_size % 5 <> 0 AND p_size % 3 <> 0"""
SQL["first_sorted_match"] = "SELECT min(p_brand || '/' || p_name) AS path FROM part WHERE regexp_matches(p_brand, '^Brand#[1-3]')"
_SHAPES = "(SELECT p_partkey, [32 * (p_size % 4 + 1), 16 * (p_size % 5 + 4), 16 * (p_size % 7 + 4)] AS patch, p_size AS classes FROM part)"
_ACT = f"act AS (SELECT p_partkey, patch, classes, CAST(2 * sum(f * floor(patch[1] / 2 ** i)::BIGINT * floor(patch[2] / 2 ** i)::BIGINT * floor(patch[3] / 2 ** i)::BIGINT * 8) AS BIGINT) AS bytes FROM {_SHAPES}, (VALUES (0, 32), (1, 64), (2, 128), (3, 256), (4, 320), (5, 320)) w(i, f) GROUP BY ALL)"
SQL["activation_bytes"] = f"WITH {_ACT} SELECT p_partkey, bytes FROM act"
SQL["batch_size_choice"] = f"""WITH {_ACT}, m AS (SELECT unnest([8 * 2.0 ** 30, 12.7 * 2.0 ** 30, 72 * 2.0 ** 30])::DOUBLE AS memory)
SELECT p_partkey, memory, CAST(greatest(least(trunc(memory * 0.85::DOUBLE / (3 * bytes + list_product(patch) * classes * 4)), 8), 1) AS INT) AS batch FROM act, m"""
SQL["predict_arrow"] = SQL["blend_gaussian"]
SQL["block_blend_uniform"], SQL["block_blend_3d"], SQL["block_segment"] = SQL["blend_uniform"], SQL["blend_3d_padded"], SQL["segment_top2"]
SQL["block_conv3d"], SQL["block_conv3d_strided"], SQL["block_tiny_unet"] = SQL["conv3d_same"], SQL["conv3d_strided"], SQL["tiny_unet"]
SQL["block_tiny_resenc_unet"], SQL["block_residual"], SQL["block_avg_pool"] = SQL["tiny_resenc_unet"], SQL["residual_block"], SQL["avg_pool"]
SQL["block_patch_extract"] = f"{PLANE_NET} SELECT pid, count(*) AS n, min(z) AS z0, max(z) AS z1, min(x) AS x0, {r('sum(v)', 5)} AS v FROM pv GROUP BY pid"
SQL["block_large_volume"] = f"""WITH raw AS (SELECT CAST(l_orderkey % 128 AS INT) AS z, CAST(l_partkey % 128 AS INT) AS y, CAST(l_suppkey % 128 AS INT) AS x, sum(l_extendedprice) / 79193::DOUBLE AS v FROM lineitem GROUP BY ALL),
img AS (SELECT p.i AS z, q.i AS y, t.i AS x, coalesce(v, 0) AS v FROM range(128) p(i), range(128) q(i), range(128) t(i) LEFT JOIN raw ON raw.z = p.i AND raw.y = q.i AND raw.x = t.i),
tile AS (SELECT i, i * 32 AS s FROM range(3) t(i)),
pv AS (SELECT a.i * 9 + b.i * 3 + c.i AS pid, z, y, x, v, 10 * exp(-((z - a.s - 32) ** 2 + (y - b.s - 32) ** 2 + (x - c.s - 32) ** 2) / 128::DOUBLE) AS w
  FROM img JOIN tile a ON z >= a.s AND z < a.s + 64 JOIN tile b ON y >= b.s AND y < b.s + 64 JOIN tile c ON x >= c.s AND x < c.s + 64),
st AS (SELECT pid, avg(v) AS mu, var_pop(v) AS q FROM pv GROUP BY pid),
act AS (SELECT z, y, x, sum(w * CASE WHEN v > mu THEN (v - mu) / sqrt(q + 1e-5::DOUBLE) ELSE 0.01::DOUBLE * (v - mu) / sqrt(q + 1e-5::DOUBLE) END) / sum(w) AS a FROM pv JOIN st USING (pid) GROUP BY ALL)
SELECT z, y, {r('avg(a * 0.8::DOUBLE + 0.1::DOUBLE)', 5)} AS l0, {r('avg(a * -0.5::DOUBLE + 0.2::DOUBLE)', 5)} AS l1, {r('avg(a * 0.3::DOUBLE - 0.1::DOUBLE)', 5)} AS l2 FROM act GROUP BY z, y"""
SQL["safetensors_roundtrip"] = f"SELECT coalesce(label::VARCHAR, 'none') AS label, key, array_to_string(s, 'x') AS shape, 64 AS n, {r('list_sum(list_transform(e, lambda x: x::DOUBLE))', 5)} AS total FROM {_TENSORS}"





# the engine: the cube z-scored, padded, cut into patches, a network of two stages per patch, blended.
# A parameter is ((7 j + 3 length(key)) % 11 - 5) / 16 at place j of the stored tensor.


def par(j: str, key: str) -> str:
    return f"((7 * ({j}) + {3 * len(key)}) % 11 - 5) / 16::DOUBLE"


def patch_conv(name: str, source: str, key: str, n_out: int, n_in: int, out: tuple[int, int, int], stride: int = 1) -> str:
    """Convolution, norm and activation of every patch."""
    places = ", ".join(f"range({n}) o{a}({a})" for a, n in zip("zyx", out))
    asked = ", ".join(f"{a} * {stride} + d{a} - 1 AS f{a}" for a in "zyx")
    j = f"(((o * {n_in} + i) * 3 + dz) * 3 + dy) * 3 + dx"
    k = f"(SELECT o, i, dz, dy, dx, {par(j, key + '.conv.weight')} AS w FROM range({n_out}) a(o), range({n_in}) b(i), range(3) p(dz), range(3) q(dy), range(3) t(dx))"
    asked = f"(SELECT o, i, w, z, y, x, {asked} FROM (SELECT * FROM {places}), {k})"
    sums = f"SELECT f.pid, g.o AS c, g.z, g.y, g.x, sum(f.v * g.w) + {par('g.o', key + '.conv.bias')} AS v FROM {asked} g JOIN {source} f ON f.c = g.i AND f.z = g.fz AND f.y = g.fy AND f.x = g.fx GROUP BY f.pid, g.o, g.z, g.y, g.x"
    h = f"(v - avg(v) OVER w) / sqrt(var_pop(v) OVER w + 1e-5::DOUBLE) * {par('c', key + '.norm.weight')} + {par('c', key + '.norm.bias')}"
    return f"{name} AS MATERIALIZED (SELECT pid, c, z, y, x, CASE WHEN h > 0 THEN h ELSE 0.01::DOUBLE * h END AS v FROM (SELECT *, {h} AS h FROM ({sums}) WINDOW w AS (PARTITION BY pid, c)))"


_UP, _HEAD = "decoder.transpconvs.0", "decoder.seg_layers.0"
_UP_J, _HEAD_J = "(((f.c * 2 + o) * 2 + dz) * 2 + dy) * 2 + dx", "o * 2 + c"


def engine(where: str, shape: tuple[int, int, int]) -> tuple[str, str]:
    """The statement up to the weighted scores ``lg`` of the cube's part ``where``, and the condition that crops its padding."""
    before = [max(p - n, 0) // 2 for n, p in zip(shape, (16, 8, 16))]
    box = [max(p, n) for n, p in zip(shape, (16, 8, 16))]
    ranges = ", ".join(f"range({n}) {t}(i)" for n, t in zip(box, ("p", "q", "t")))
    on = " AND ".join(f"{t}.i = {a} + {b}" for t, a, b in zip(("p", "q", "t"), "zyx", before))
    body = f"""WITH {CUBE}, part AS (SELECT * FROM cube WHERE {where}), zs AS (SELECT coalesce(avg(v) FILTER (v <> 0), 0) AS m, greatest(coalesce(stddev_pop(v) FILTER (v <> 0), 1), 1e-8) AS sd FROM part),
nz AS (SELECT z, y, x, (v - m) / sd AS v FROM part, zs), pad AS (SELECT p.i AS z, q.i AS y, t.i AS x, coalesce(v, 0) AS v FROM {ranges} LEFT JOIN nz ON {on}), {axis("az", str(box[0]), 16)},
p0 AS MATERIALIZED (SELECT i AS pid, 0 AS c, z - s AS z, y, x, v FROM pad JOIN az ON z >= s AND z < s + 16),
{patch_conv("skip", "p0", "encoder.stages.0.convs.0", 2, 1, (16, 8, 16))},
{patch_conv("low", "skip", "encoder.stages.1.convs.0", 3, 2, (8, 4, 8), 2)},
raised AS MATERIALIZED (SELECT f.pid, o AS c, 2 * f.z + dz AS z, 2 * f.y + dy AS y, 2 * f.x + dx AS x, sum(f.v * {par(_UP_J, _UP + ".weight")}) + any_value({par("o", _UP + ".bias")}) AS v
  FROM low f, range(2) a(o), range(2) p(dz), range(2) q(dy), range(2) t(dx) GROUP BY ALL),
cat AS MATERIALIZED (SELECT * FROM raised UNION ALL SELECT pid, c + 2, z, y, x, v FROM skip),
{patch_conv("dec", "cat", "decoder.stages.0.convs.0", 2, 4, (16, 8, 16))},
lg AS MATERIALIZED (SELECT pid, k, z + s AS z, y, x, 10 * exp(-((z - 8) ** 2 / 8::DOUBLE + (y - 4) ** 2 / 2::DOUBLE + (x - 8) ** 2 / 8::DOUBLE)) AS w, l
  FROM (SELECT pid, o AS k, z, y, x, sum(v * {par(_HEAD_J, _HEAD + ".weight")}) + any_value({par("o", _HEAD + ".bias")}) AS l FROM dec, range(3) t(o) GROUP BY ALL) JOIN az ON pid = i)"""
    return body, " AND ".join(f"{a} >= {b} AND {a} < {b + n}" for a, b, n in zip("zyx", before, shape))


def engine_scores(where: str, shape: tuple[int, int, int]) -> str:
    body, cropped = engine(where, shape)
    moved = ", ".join(f"{a} - {max(p - n, 0) // 2} AS {a}" for a, n, p in zip("zyx", shape, (16, 8, 16)))
    return f"{body} SELECT {moved}, k, {r(BLEND, 5)} AS l FROM lg WHERE {cropped} GROUP BY z, y, x, k"


SQL["engine_predict"] = engine_scores("true", (50, 7, 11))
SQL["engine_segment"] = f"{engine('true', (50, 7, 11))[0]}, {SEGMENT} SELECT z, y, x - 2 AS x, label1, {r('score1', 5)} AS score1, label2, {r('score2', 5)} AS score2 FROM seg WHERE {CROPPED}"
_PARTS = {"whole": ("true", (50, 7, 11)), "long": ("y < 2", (50, 2, 11)), "flat": ("z < 5", (5, 7, 11)), "plane": ("z < 1 AND x < 4", (1, 7, 4))}
SQL["engine_shapes"] = " UNION ALL ".join(f"SELECT '{n}' AS volume_id, * FROM ({engine_scores(*p)})" for n, p in _PARTS.items())
SQL["engine_normalize"] = f"WITH {CUBE}, zs AS (SELECT avg(v) FILTER (v <> 0) AS m, stddev_pop(v) FILTER (v <> 0) AS sd FROM cube) SELECT z, y, x, {r('(v - m) / greatest(sd, 1e-8)')} AS v FROM cube, zs"


SQL["tensor_source_by_key"] = "SELECT 'enc.norm.v' || vec_id || '.weight' AS key, '64' AS shape, j, CAST(embedding[j + 1] AS DOUBLE) AS w FROM embeddings, range(64) t(j) WHERE vec_id % 5 = 2"
SQL["intensity_params"] = f"""WITH o AS (SELECT CAST(o_custkey % 4 AS INT) AS c, o_totalprice / 1000::DOUBLE AS v FROM orders)
SELECT c, {r("avg(v)")} AS mean, {r("stddev_pop(v)")} AS std, {r("min(v)")} AS low, {r("max(v)")} AS high FROM o GROUP BY c"""
SQL["model_folder_scan"] = """WITH n AS (SELECT n_nationkey AS k, 'Dataset' || printf('%03d', n_nationkey) || '_' || replace(n_name, ' ', '_') || '/' AS base, replace(r_name, ' ', '_') || '__plans__3d' AS trainer FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT k AS task, base || CASE WHEN k % 3 = 0 AND 'AAA__plans__3d' < trainer THEN 'AAA__plans__3d' ELSE trainer END AS path, CASE WHEN k % 4 <> 3 THEN base || trainer END AS described FROM n"""
SQL["checkpoint_resolver"] = """WITH l AS (SELECT label AS fold, count(*) AS n FROM embeddings WHERE label IS NOT NULL GROUP BY label)
SELECT fold, CASE WHEN fold % 2 = 0 THEN 'loaded' ELSE 'pickle' END AS state, CASE WHEN fold % 2 = 0 THEN n ELSE 0 END AS n, CASE WHEN fold % 2 = 0 THEN 64 * n ELSE 0 END AS size FROM l
UNION ALL SELECT max(fold) + 1, 'missing', 0, 0 FROM l"""
SQL["convert_folder"] = f"""WITH t AS (SELECT label, list_sum(list_transform(e, lambda x: x::DOUBLE)) AS total FROM {_TENSORS} WHERE label IS NOT NULL)
SELECT CAST(count(DISTINCT label) AS INT) AS first, 0 AS second, CAST(count(DISTINCT label) AS INT) AS forced, count(*) AS tensors, {r("sum(total)", 4)} AS total FROM t"""


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
