"""Nearest neighbours, fields of splats and density clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geofold.functions.geom import apply, morton, quaternion_matrix, r6
from geofold.operators import cluster, field, filters, knn, losses, mesh, sampling, stats
from geofold.operators.knn import XYZ
from geofold.operators.shared import stash
from geofold.plans.book import Book, q6
from geofold.plans.fixtures import CAMERAS, SPLATS, cameras, corner_triples, splats, vertices
from geofold.plans.measures import BOXED, EXTENT, extent

BOOK = Book()


def NEAR(k: int, points: str = "splats", queries: str = "splats") -> str:
    return f"near AS (SELECT * FROM (SELECT q.id AS i, p.id AS j, d2, row_number() OVER (PARTITION BY q.id ORDER BY d2, p.id) - 1 AS rank FROM {queries} q, {points} p, LATERAL (SELECT (q.x - p.x) ** 2 + (q.y - p.y) ** 2 + (q.z - p.z) ** 2 AS d2)) WHERE rank < {k})"


def _points(spark, d):
    return splats(spark, d).select("id", *XYZ)


@BOOK.query(
    f"""WITH {EXTENT}, picked AS (SELECT s.id, s.x, s.y, s.z FROM splats s, extent WHERE opacity > 0.5 AND abs(x - cx) < radius AND abs(y - cy) < radius AND abs(z - cz) < radius),
    {NEAR(2, "picked", "picked")}, raw AS (SELECT -log2(100 * quantile_cont(d2 / (2 * radius), 0.1)) AS raw FROM near, extent WHERE rank = 1)
    SELECT {q6('raw', 'raw_depth')}, CAST(least(floor(raw), 10) AS INTEGER) AS depth FROM raw"""
)
def octree_depth(spark: SparkSession, d: str) -> DataFrame:
    """Depth of an octree whose leaves match the splats' spacing: squared distances over a box's length, as the rule has it."""
    box = extent(cameras(spark, d))
    ext = F.broadcast(box)
    inside = filters.inside_box([F.col(f"c{c}") - F.col("radius") for c in XYZ], [F.col(f"c{c}") + F.col("radius") for c in XYZ])
    picked = splats(spark, d).where(filters.opaque()).join(ext).where(inside).select("id", *XYZ)
    near = knn.knn(picked, 2).where("rank = 1").join(ext)
    (low,) = stats.quantiles(near, F.col("d2") / (2 * F.col("radius")), [0.1])
    raw = box.select((-F.log2(100 * F.lit(low).cast("double"))).alias("raw"))
    return raw.select(r6("raw").alias("raw_depth"), F.least(F.floor("raw"), F.lit(10)).cast("int").alias("depth"))


@BOOK.query(f"WITH {SPLATS}, {NEAR(16)} SELECT i, rank, j, {q6('d2', 'd2')} FROM near")
def knn_self_16(spark: SparkSession, d: str) -> DataFrame:
    return knn.knn(_points(spark, d), 16).select("i", F.col("rank").cast("long").alias("rank"), "j", r6("d2").alias("d2"))


@BOOK.query(f"WITH {CAMERAS}, {NEAR(4, 'splats', 'cameras')} SELECT i, rank, j, {q6('d2', 'd2')} FROM near")
def knn_cross(spark: SparkSession, d: str) -> DataFrame:
    return knn.knn(_points(spark, d), 4, cameras(spark, d)).select("i", F.col("rank").cast("long").alias("rank"), "j", r6("d2").alias("d2"))


@BOOK.query(f"WITH {SPLATS}, {NEAR(4)} SELECT i, {q6('avg(d2)', 'mean_d2')} FROM near WHERE rank BETWEEN 1 AND 3 GROUP BY i")
def knn_mean_3(spark: SparkSession, d: str) -> DataFrame:
    return knn.mean_squared(knn.knn(_points(spark, d), 4), (1, 3)).select("i", r6("mean_d2").alias("mean_d2"))


@BOOK.query(f"WITH {SPLATS}, {NEAR(4)} SELECT i, {q6('greatest(min(sqrt(d2)), 1e-7)', 'scale')} FROM near WHERE rank BETWEEN 1 AND 3 GROUP BY i")
def knn_min_scale(spark: SparkSession, d: str) -> DataFrame:
    near = knn.knn(_points(spark, d), 4).where("rank BETWEEN 1 AND 3")
    return near.groupBy("i").agg(r6(F.greatest(F.min(F.sqrt("d2")), F.lit(1e-7))).alias("scale"))


@BOOK.query(f"WITH {SPLATS}, opaque AS (SELECT * FROM splats WHERE opacity > 0.5), {NEAR(1, 'opaque', 'splats')} SELECT i, {q6('x', 'x')}, {q6('f0', 'f0')} FROM near JOIN splats ON id = j")
def nn_projection(spark: SparkSession, d: str) -> DataFrame:
    samples = splats(spark, d).where(filters.opaque()).select("id", *XYZ, "f0")
    moved = knn.knn(samples.withColumn("sx", F.col("x")), 1, _points(spark, d), payload=("sx", "f0"))
    return moved.select("i", r6("sx").alias("x"), r6("f0").alias("f0"))


@BOOK.query(f"WITH {SPLATS}, {NEAR(9)} SELECT i, {q6('var_pop(f0)', 'variance')} FROM near JOIN splats ON id = j GROUP BY i")
def local_variance(spark: SparkSession, d: str) -> DataFrame:
    return knn.local_variance(knn.knn(splats(spark, d), 9, payload=("f0",)), "f0").select("i", r6("variance").alias("variance"))


#: Splats near each splat whose shares are summed, itself the first of them.
TRACKED = 16


def _pairs(spark, d, itself: bool = True) -> DataFrame:
    """Splats with those tracked near them: own place px py pz, scales o0 .. o2, quaternion p0 .. p3; the neighbour's columns as they are."""
    all_ = splats(spark, d)
    near = knn.knn(all_.withColumns({"nx_": F.col("x"), "ny_": F.col("y"), "nz_": F.col("z")}), TRACKED, payload=("nx_", "ny_", "nz_", "s0", "s1", "s2", "q0", "q1", "q2", "q3", "opacity"))
    near = (near if itself else near.where("i != j")).withColumnsRenamed({f"n{c}_": c for c in XYZ})
    own = all_.select(F.col("id").alias("i"), *(F.col(c).alias(f"p{c}") for c in XYZ), *(F.col(f"s{n}").alias(f"o{n}") for n in range(3)), *(F.col(f"q{n}").alias(f"p{n}") for n in range(4)))
    return near.join(own, "i")


_OWN = [
    "(1 - 2 * (j_ * j_ + k_ * k_)) * dx + 2 * (i_ * j_ + w_ * k_) * dy + 2 * (i_ * k_ - w_ * j_) * dz",
    "2 * (i_ * j_ - w_ * k_) * dx + (1 - 2 * (i_ * i_ + k_ * k_)) * dy + 2 * (j_ * k_ + w_ * i_) * dz",
    "2 * (i_ * k_ + w_ * j_) * dx + 2 * (j_ * k_ - w_ * i_) * dy + (1 - 2 * (i_ * i_ + j_ * j_)) * dz",
]
PAIRS = f"""{SPLATS}, {NEAR(TRACKED)}, joined AS (SELECT n.i, n.j, n.d2, o.s0 AS o0, o.s1 AS o1, o.s2 AS o2, s.s0, s.s1, s.s2, s.opacity, o.x - s.x AS dx, o.y - s.y AS dy, o.z - s.z AS dz, sqrt(o.q0 ** 2 + o.q1 ** 2 + o.q2 ** 2 + o.q3 ** 2) AS on_, o.q0 AS p0, o.q1 AS p1, o.q2 AS p2, o.q3 AS p3,
    sqrt(s.q0 ** 2 + s.q1 ** 2 + s.q2 ** 2 + s.q3 ** 2) AS n, s.q0, s.q1, s.q2, s.q3 FROM near n JOIN splats o ON o.id = n.i JOIN splats s ON s.id = n.j),
    turned AS (SELECT *, q0 / n AS w_, q1 / n AS i_, q2 / n AS j_, q3 / n AS k_, p0 / on_ AS ow, p1 / on_ AS oi, p2 / on_ AS oj, p3 / on_ AS ok FROM joined),
    pairs AS (SELECT *, exp(-0.5 * least(1e8, (({_OWN[0]}) / s0) ** 2 + (({_OWN[1]}) / s1) ** 2 + (({_OWN[2]}) / s2) ** 2)) AS e FROM turned)"""


@BOOK.query(f"WITH {PAIRS} SELECT i, {q6('avg(e)', 'overlap')} FROM pairs WHERE i <> j GROUP BY i")
def gaussian_overlap(spark: SparkSession, d: str) -> DataFrame:
    return field.overlap(_pairs(spark, d, itself=False)).select("i", r6("overlap").alias("overlap"))


_OTHER = [x.replace("w_", "ow").replace("i_", "oi").replace("j_", "oj").replace("k_", "ok") for x in _OWN]


def _along(turned: list[str], scales: str) -> str:
    """SQL of a splat's deviation along (dx, dy, dz)."""
    return "sqrt(" + " + ".join(f"({scales}{k} * ({x})) ** 2" for k, x in enumerate(turned)) + ") / greatest(sqrt(d2), 1e-8)"


@BOOK.query(f"WITH {PAIRS} SELECT i, {q6(f'avg(abs(greatest(sqrt(d2), 1e-8) / greatest({_along(_OTHER, 'o')} + {_along(_OWN, 's')}, 1e-8) - 1))', 'alignment')} FROM pairs WHERE i <> j GROUP BY i")
def gaussian_alignment(spark: SparkSession, d: str) -> DataFrame:
    return field.alignment(_pairs(spark, d, itself=False)).select("i", r6("alignment").alias("alignment"))


FIELD = PAIRS + ", field AS (SELECT i, sum(opacity * e) AS raw, avg(least(s0, s1, s2)) AS beta, sum(opacity * e * least(s0, s1, s2)) / greatest(sum(opacity * e), 1e-12) AS weighted FROM pairs GROUP BY i), dens AS (SELECT *, CASE WHEN raw >= 1 THEN raw / (raw + 1e-12) ELSE raw END AS density FROM field)"


@BOOK.query(f"WITH {FIELD} SELECT i, {q6('density', 'density')}, {q6('beta', 'beta')}, {q6('weighted', 'weighted_beta')} FROM dens")
def density_field(spark: SparkSession, d: str) -> DataFrame:
    return field.density(_pairs(spark, d)).select("i", *(r6(c).alias(c) for c in ("density", "beta", "weighted_beta")))


@BOOK.query(f"WITH {FIELD} SELECT i, {q6('beta * (sqrt(-2 * ln(greatest(least(density, 1), 1e-12))) - sqrt(2 * ln(2)))', 'sdf')} FROM dens")
def beta_sdf(spark: SparkSession, d: str) -> DataFrame:
    return field.signed_distance(field.density(_pairs(spark, d))).select("i", r6("sdf").alias("sdf"))


_BACK = [
    "(1 - 2 * (j_ * j_ + k_ * k_)) * v0 + 2 * (i_ * j_ - w_ * k_) * v1 + 2 * (i_ * k_ + w_ * j_) * v2",
    "2 * (i_ * j_ + w_ * k_) * v0 + (1 - 2 * (i_ * i_ + k_ * k_)) * v1 + 2 * (j_ * k_ - w_ * i_) * v2",
    "2 * (i_ * k_ - w_ * j_) * v0 + 2 * (j_ * k_ + w_ * i_) * v1 + (1 - 2 * (i_ * i_ + j_ * j_)) * v2",
]


_AXES = [
    ["1 - 2 * ({j} * {j} + {k} * {k})", "2 * ({i} * {j} + {w} * {k})", "2 * ({i} * {k} - {w} * {j})"],
    ["2 * ({i} * {j} - {w} * {k})", "1 - 2 * ({i} * {i} + {k} * {k})", "2 * ({j} * {k} + {w} * {i})"],
    ["2 * ({i} * {k} + {w} * {j})", "2 * ({j} * {k} - {w} * {i})", "1 - 2 * ({i} * {i} + {j} * {j})"],
]


def _normal_sql(s: str, of: dict, name: str) -> str:
    """SQL of a splat's normal: the axis of its least scale."""
    least = f"least({s}0, {s}1, {s}2)"
    return ", ".join(f"CASE WHEN {s}0 = {least} THEN {_AXES[0][r].format(**of)} WHEN {s}1 = {least} THEN {_AXES[1][r].format(**of)} ELSE {_AXES[2][r].format(**of)} END AS {name}{r}" for r in range(3))


@BOOK.query(
    f"WITH {PAIRS}, n AS (SELECT *, {_normal_sql('s', dict(w='w_', i='i_', j='j_', k='k_'), 'n')}, {_normal_sql('o', dict(w='ow', i='oi', j='oj', k='ok'), 'm')} FROM pairs), "
    "w AS (SELECT *, opacity * e * abs(dx * n0 + dy * n1 + dz * n2) / greatest(least(s0, s1, s2), 1e-6) ** 2 AS w, sign(n0 * m0 + n1 * m1 + n2 * m2) AS side FROM n), "
    f"s AS (SELECT i, greatest(sum(w), 1e-6) AS total, {', '.join(f'any_value(m{r}) AS m{r}, sum(w * side * n{r}) AS a{r}' for r in range(3))} FROM w GROUP BY i) SELECT i, {q6(' + '.join(f'(m{r} - a{r} / total) ** 2' for r in range(3)), 'loss')} FROM s"
)
def better_normal_loss(spark: SparkSession, d: str) -> DataFrame:
    """How far each splat's normal is from the one of the field around its centre."""
    return losses.better_normal(_pairs(spark, d)).select("i", r6("loss").alias("loss"))


@BOOK.query(f"WITH {PAIRS}, v AS (SELECT *, ({_OWN[0]}) / s0 ** 2 AS v0, ({_OWN[1]}) / s1 ** 2 AS v1, ({_OWN[2]}) / s2 ** 2 AS v2 FROM pairs) SELECT i, {q6(f'sum(-opacity * e * ({_BACK[0]}))', 'gx')}, {q6(f'sum(-opacity * e * ({_BACK[1]}))', 'gy')}, {q6(f'sum(-opacity * e * ({_BACK[2]}))', 'gz')} FROM v GROUP BY i")
def density_gradient(spark: SparkSession, d: str) -> DataFrame:
    return field.gradient(_pairs(spark, d)).select("i", *(r6(f"g{c}").alias(f"g{c}") for c in XYZ))


_SLOPE = "WITH " + FIELD + ", v AS (SELECT *, " + ", ".join(f"({x}) / s{k} ** 2 AS v{k}" for k, x in enumerate(_OWN)) + " FROM pairs), g AS (SELECT i, " + ", ".join(f"sum(opacity * e * ({x})) AS g{k}" for k, x in enumerate(_BACK)) + " FROM v GROUP BY i)"
_FACTOR = "beta / greatest(greatest(density, 1e-16) * sqrt(-2 * ln(greatest(density, 1e-16))), 1e-16)"


@BOOK.query(_SLOPE + " SELECT g.i, " + ", ".join(f"round(greatest(least({_FACTOR} * g{k}, 10), -10), 5) + 0.0 AS g{c}" for k, c in enumerate(XYZ)) + " FROM g JOIN dens ON dens.i = g.i")
def sdf_gradient(spark: SparkSession, d: str) -> DataFrame:
    return field.sdf_gradient(_pairs(spark, d)).select("i", *(r6(f"g{c}", 5).alias(f"g{c}") for c in XYZ))


@BOOK.query(f"WITH {SPLATS}, {NEAR(20)}, m AS (SELECT i, avg(sqrt(d2)) AS mean_d FROM near GROUP BY i), l AS (SELECT avg(mean_d) + 2 * stddev_samp(mean_d) AS most FROM m) SELECT i, {q6('mean_d', 'mean_d')}, mean_d <= most AS kept FROM m, l")
def statistical_outlier(spark: SparkSession, d: str) -> DataFrame:
    return knn.outliers_kept(knn.knn(_points(spark, d), 20), 2.0).select("i", r6("mean_d").alias("mean_d"), "kept")


@BOOK.query()
def morton_order(spark: SparkSession, d: str) -> DataFrame:
    """Z-order codes in the box of all points and the origin."""
    p = _points(spark, d)
    box = p.agg(*(F.least(F.min(c), F.lit(0.0)).alias(f"lo{c}") for c in XYZ), *(F.greatest(F.max(c), F.lit(0.0)).alias(f"hi{c}") for c in XYZ))
    code = morton(list(XYZ), [f"lo{c}" for c in XYZ], [f"hi{c}" for c in XYZ])
    return p.join(F.broadcast(box)).select("id", code.alias("code"))


_BITS = " + ".join(f"((c{a} >> {b}) & 1) * {1 << (3 * b + a)}" for a in range(3) for b in range(10))
BOOK.sql["morton_order"] = f"WITH {SPLATS}, box AS (SELECT " + ", ".join(f"least(min({c}), 0) AS lo{c}, greatest(max({c}), 0) AS hi{c}" for c in XYZ) + "), cells AS (SELECT id, ".replace("), cells", " FROM splats), cells") + ", ".join(f"CAST(floor(({c} - lo{c}) / (hi{c} - lo{c}) * 1023) AS BIGINT) AS c{a}" for a, c in enumerate(XYZ)) + f" FROM splats, box) SELECT id, CAST({_BITS} AS BIGINT) AS code FROM cells"


@BOOK.query()
def knn_edge_centres(spark: SparkSession, d: str) -> DataFrame:
    """The 8 edge midpoints nearest to each edge midpoint of the mesh."""
    # edges of all proper order lines: those of the different faces among them are the same
    triples = corner_triples(spark, d).where("a != b AND b != c AND a != c").withColumn("fid", F.lit(0))
    e = stash(mesh.edges(triples).select("u", "v").distinct(), "edge-ends")
    v = vertices(spark, d)
    send = mesh.sender(v)
    ends = [send(v.select(F.col("vid").alias(k), *(F.col(c).alias(k + c) for c in XYZ))) for k in "uv"]
    mids = e.join(ends[0], "u").join(ends[1], "v").select((F.shiftleft(F.col("u").cast("long"), 32) + F.col("v")).alias("id"), *(((F.col(f"u{c}") + F.col(f"v{c}")) / 2).alias(c) for c in XYZ))
    return knn.self_knn(mids, 8).select("i", F.col("rank").cast("long").alias("rank"), "j", r6("d2").alias("d2"))


# ---- clusters

EPS = 0.09


@BOOK.query(f"WITH {SPLATS}, {NEAR(6)} SELECT {q6('quantile_cont(sqrt(d2), 0.5)', 'eps')} FROM near WHERE rank = 5")
def eps_percentile(spark: SparkSession, d: str) -> DataFrame:
    near = knn.knn(_points(spark, d), 6).where("rank = 5")
    (eps,) = stats.quantiles(near, F.sqrt("d2"), [0.5])
    return spark.range(1).select(r6(F.lit(eps).cast("double")).alias("eps"))


CLUSTERS = f"""WITH RECURSIVE {SPLATS}, close AS (SELECT p.id AS i, q.id AS j FROM splats p JOIN splats q ON (p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2 <= {EPS} ** 2 AND p.id <> q.id),
    cores AS (SELECT i FROM close GROUP BY i HAVING count(*) + 1 >= 6), links AS (SELECT i, j FROM close WHERE i IN (FROM cores) AND j IN (FROM cores)),
    reach AS (SELECT i, i AS r FROM cores UNION SELECT l.j, reach.r FROM reach JOIN links l ON l.i = reach.i), roots AS (SELECT i, min(r) AS root FROM reach GROUP BY i),
    border AS (SELECT c.i, min(root) AS near FROM close c JOIN roots ON roots.i = c.j GROUP BY c.i),
    labels AS (SELECT s.id, CAST(coalesce(root, near, -1) AS BIGINT) AS label FROM splats s LEFT JOIN roots ON roots.i = s.id LEFT JOIN border ON border.i = s.id)"""


@BOOK.query(f"{CLUSTERS} SELECT id, label FROM labels")
def dbscan_labels(spark: SparkSession, d: str) -> DataFrame:
    return cluster.dbscan(_points(spark, d), EPS, 6)


@BOOK.query(f"{CLUSTERS}, n AS (SELECT label, count(*) AS size FROM labels WHERE label >= 0 GROUP BY 1) SELECT label, size FROM n ORDER BY size DESC, label LIMIT 10")
def top_clusters(spark: SparkSession, d: str) -> DataFrame:
    return cluster.cluster_sizes(cluster.dbscan(_points(spark, d), EPS, 6)).orderBy(F.desc("size"), "label").limit(10)


@BOOK.query(f"{CLUSTERS}, n AS (SELECT label, count(*) AS size FROM labels WHERE label >= 0 GROUP BY 1), big AS (SELECT label FROM n WHERE size >= 0.05 * (SELECT count(*) FROM labels)) SELECT id, labels.label, CASE WHEN (SELECT count(*) FROM n) = 0 THEN true WHEN (SELECT count(*) FROM big) > 0 THEN labels.label IN (FROM big) ELSE labels.label = (SELECT label FROM n ORDER BY size DESC, label LIMIT 1) END AS kept FROM labels")
def large_cluster_keep(spark: SparkSession, d: str) -> DataFrame:
    return cluster.kept_clusters(cluster.dbscan(_points(spark, d), EPS, 6), 0.05)


PRUNED = f"""WITH RECURSIVE {BOXED}, rows AS (SELECT id, x, y, z, fg, opacity > 0.5 AS dense FROM boxed),
    close AS (SELECT p.id AS i, q.id AS j FROM rows p JOIN rows q ON p.fg = q.fg AND p.dense AND q.dense AND (p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2 <= {EPS} ** 2 AND p.id <> q.id),
    cores AS (SELECT i FROM close GROUP BY i HAVING count(*) + 1 >= 6), links AS (SELECT i, j FROM close WHERE i IN (FROM cores) AND j IN (FROM cores)),
    reach AS (SELECT i, i AS r FROM cores UNION SELECT l.j, reach.r FROM reach JOIN links l ON l.i = reach.i), roots AS (SELECT i, min(r) AS root FROM reach GROUP BY i),
    border AS (SELECT c.i, min(root) AS near FROM close c JOIN roots ON roots.i = c.j GROUP BY c.i),
    labels AS (SELECT rows.id, fg, coalesce(root, near, -1) AS label FROM rows LEFT JOIN roots ON roots.i = rows.id LEFT JOIN border ON border.i = rows.id WHERE dense),
    sizes AS (SELECT fg, label, count(*) AS size FROM labels WHERE label >= 0 GROUP BY ALL), totals AS (SELECT fg, count(*) AS total FROM labels GROUP BY fg),
    judged AS (SELECT s.fg, label, size >= 0.05 * total AS big, row_number() OVER (PARTITION BY s.fg ORDER BY size DESC, label) = 1 AS largest FROM sizes s JOIN totals t ON t.fg = s.fg),
    parts AS (SELECT fg, bool_or(big) AS any_big FROM judged GROUP BY fg),
    kept AS (SELECT l.id, l.label, CASE WHEN p.fg IS NULL THEN true WHEN any_big THEN coalesce(big, false) ELSE coalesce(largest, false) END AS kept FROM labels l LEFT JOIN parts p ON p.fg = l.fg LEFT JOIN judged j ON j.fg = l.fg AND j.label = l.label),
    counts AS (SELECT fg, count(*) AS points, count(*) FILTER (NOT coalesce(kept, true)) AS pruned, count(*) FILTER (label = -1) AS noise FROM rows LEFT JOIN kept USING (id) GROUP BY fg)
    SELECT CASE WHEN fg THEN 'fg' ELSE 'bg' END AS part, points, pruned, noise, {q6('pruned / points', 'ratio')}, {q6('pruned / points')} > 0.3 AS warn FROM counts"""


@BOOK.query(PRUNED)
def fg_bg_prune_stats(spark: SparkSession, d: str) -> DataFrame:
    """Foreground and background are clustered apart; low opacity passes by and is kept."""
    from functools import reduce

    from geofold.plans.measures import _boxed

    rows = _boxed(spark, d).select("id", *XYZ, "fg", filters.opaque().alias("dense"))
    parts = []
    for name, fg in (("fg", True), ("bg", False)):
        own = rows.where(F.col("fg") == fg)
        kept = cluster.kept_clusters(cluster.dbscan(own.where("dense").select("id", *XYZ), EPS, 6), 0.05)
        judged = own.join(kept.select("id", "label", "kept"), "id", "left").withColumn("kept", F.coalesce("kept", F.lit(True)))
        parts.append(judged.agg(F.lit(name).alias("part"), F.count("*").alias("points"), F.sum((~F.col("kept")).cast("long")).alias("pruned"), F.sum((F.col("label") == -1).cast("long")).alias("noise")))
    merged = reduce(DataFrame.unionByName, parts)
    return merged.withColumn("ratio", r6(F.col("pruned") / F.col("points"))).withColumn("warn", F.col("ratio") > 0.3)


# ---- samples


_UNIFORM = lambda c, seed: f"((CAST('0x' || substr(md5({c} || '|{seed}'), 1, 13) AS BIGINT) + 0.5) / {float(1 << 52)!r})"
_NORMAL = lambda c, seed: f"(sqrt(-2 * ln({_UNIFORM(c, seed)})) * cos(2 * pi() * {_UNIFORM(c, seed + 1)}))"


@BOOK.query("SELECT vec_id AS id, label FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5(vec_id || '|5'), vec_id) <= 20")
def per_camera_cap(spark: SparkSession, d: str) -> DataFrame:
    return sampling.capped(splats(spark, d), ["label"], ["id"], 20, seed=5).select("id", "label")


_FRAME = [
    "(1 - 2 * (j * j + k * k)) * o0 + 2 * (i * j - w * k) * o1 + 2 * (i * k + w * j) * o2",
    "2 * (i * j + w * k) * o0 + (1 - 2 * (i * i + k * k)) * o1 + 2 * (j * k - w * i) * o2",
    "2 * (i * k - w * j) * o0 + 2 * (j * k + w * i) * o1 + (1 - 2 * (i * i + j * j)) * o2",
]


@BOOK.query(
    f"WITH {SPLATS}, line AS (SELECT *, sum(s0 * s1 * s2) OVER (ORDER BY id) AS upto, s0 * s1 * s2 AS volume, sqrt(q0 ** 2 + q1 ** 2 + q2 ** 2 + q3 ** 2) AS n FROM splats), draws AS (SELECT i AS draw, {_UNIFORM('i', 9)} * (SELECT max(upto) FROM line) AS spot, "
    + ", ".join(f"{_NORMAL('i', 11 + 2 * a)} AS n{a}" for a in range(3)) + " FROM range(1000) t(i)), drawn AS (SELECT draw, id, x, y, z, q0 / n AS w, q1 / n AS i, q2 / n AS j, q3 / n AS k, s0 * n0 AS o0, s1 * n1 AS o1, s2 * n2 AS o2 FROM draws JOIN line ON spot >= upto - volume AND spot < upto) SELECT draw, id, "
    + ", ".join(q6(f"{c} + {_FRAME[a]}", c) for a, c in enumerate("xyz")) + " FROM drawn"
)
def weighted_sample(spark: SparkSession, d: str) -> DataFrame:
    """Draws in proportion to volume, each moved inside the drawn splat's own frame."""
    rows = splats(spark, d).withColumn("volume", F.col("s0") * F.col("s1") * F.col("s2"))
    frame = ["s0", "s1", "s2", "q0", "q1", "q2", "q3"]
    drawn = sampling.weighted(rows.select("id", *XYZ, *frame, "volume"), ["id"], "volume", 1000, seed=9)
    offset = apply(quaternion_matrix(frame[3:]), [F.col(f"s{a}") * sampling.normal(11 + 2 * a, "draw") for a in range(3)])
    return drawn.select("draw", "id", *(r6(F.col(c) + o).alias(c) for c, o in zip(XYZ, offset, strict=True)))


@BOOK.query("SELECT vec_id AS id FROM embeddings ORDER BY md5(vec_id || '|0'), vec_id LIMIT 50")
def uniform_subsample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.subsample(splats(spark, d).select("id"), ["id"], 50)


_GROWN = [_NORMAL("(id || '|' || part)", 10 * k) for k in range(3)]


@BOOK.query(
    f"WITH {SPLATS}, c AS (SELECT *, abs(nx) > 0.1 AND s0 <= 0.05 AS small, abs(nx) > 0.1 AND s0 > 0.05 AS large, sqrt(q0 ** 2 + q1 ** 2 + q2 ** 2 + q3 ** 2) AS qn FROM splats), "
    f"parts AS (SELECT * FROM (SELECT *, unnest([1, 2]) AS part FROM c WHERE large)), moved AS (SELECT *, q0 / qn AS w, q1 / qn AS i, q2 / qn AS j, q3 / qn AS k, {', '.join(f'{g} * s{k} AS o{k}' for k, g in enumerate(_GROWN))} FROM parts), "
    "rows AS (SELECT id, 0 AS part, x, y, z, s0, s2 FROM c WHERE NOT large UNION ALL SELECT id, 1, x, y, z, s0, s2 FROM c WHERE small UNION ALL SELECT id, part, " + ", ".join(f"{c} + {_FRAME[a]}" for a, c in enumerate("xyz")) + f", s0 / 1.6, s2 / 1.6 FROM moved) SELECT id, CAST(part AS INTEGER) AS part, {', '.join(q6(c, c) for c in ('x', 'y', 'z', 's0', 's2'))} FROM rows"
)
def densify_clone_split(spark: SparkSession, d: str) -> DataFrame:
    rows = splats(spark, d).select("id", *XYZ, "s0", "s1", "s2", "q0", "q1", "q2", "q3", "nx")
    steep = F.abs("nx") > 0.1
    return sampling.densified(rows, steep & (F.col("s0") <= 0.05), steep & (F.col("s0") > 0.05)).select("id", "part", *(r6(c).alias(c) for c in (*XYZ, "s0", "s2")))


#: Random places for each splat.
_EACH = 20


@BOOK.query(f"WITH {EXTENT}, n AS (SELECT unnest(range({_EACH} * count(*))) AS i FROM splats) SELECT i AS id, " + ", ".join(q6(f"c{c} + (2 * {_UNIFORM('i', a)} - 1) * 1.3 * radius", c) for a, c in enumerate("xyz")) + " FROM n, extent")
def random_point_cloud(spark: SparkSession, d: str) -> DataFrame:
    """Random places around the cameras, so many for each splat."""
    cloud = sampling.random_points(spark, _EACH * splats(spark, d).count())
    return cloud.join(F.broadcast(extent(cameras(spark, d)))).select("id", *(r6(F.col(f"c{c}") + F.col(c) * F.col("radius")).alias(c) for c in XYZ))
