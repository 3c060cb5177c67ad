"""Filters, summaries, series, run records and text logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geofold.functions.geom import norm, r6, sigmoid, squared_distance
from geofold.operators import filters, ordering, runs, stats
from geofold.operators.quantiles import quantile_columns
from geofold.plans.book import Book, q6
from geofold.plans.fixtures import CAMERAS, LOG, RECORDS, SPLATS, cameras, log, records, splats, table

BOOK = Book()
XYZ = ("x", "y", "z")


def extent(cams: DataFrame) -> DataFrame:
    """cx, cy, cz: mean place of the cameras; radius: 1.1 times the farthest one's distance."""
    centre = cams.agg(*(F.avg(c).alias(f"c{c}") for c in XYZ))
    d = F.sqrt(squared_distance(list(XYZ), ["cx", "cy", "cz"]))
    return cams.join(F.broadcast(centre)).agg(F.first("cx").alias("cx"), F.first("cy").alias("cy"), F.first("cz").alias("cz"), (1.1 * F.max(d)).alias("radius"))


EXTENT = CAMERAS + ", centre AS (SELECT avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM cameras), extent AS (SELECT any_value(cx) AS cx, any_value(cy) AS cy, any_value(cz) AS cz, 1.1 * max(sqrt((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2)) AS radius FROM cameras, centre)"


@BOOK.query(f"WITH {EXTENT} SELECT {q6('cx', 'cx')}, {q6('cy', 'cy')}, {q6('cz', 'cz')}, {q6('radius', 'radius')} FROM extent")
def camera_extent(spark: SparkSession, d: str) -> DataFrame:
    return extent(cameras(spark, d)).select(*(r6(c).alias(c) for c in ("cx", "cy", "cz", "radius")))


def _boxed(spark, d):
    box = quantile_columns(splats(spark, d), {f"{n}{c}": (c, q) for c in XYZ for n, q in (("lo", 0.25), ("hi", 0.75))})
    return splats(spark, d).join(F.broadcast(box)).withColumn("fg", filters.inside_box([F.col(f"lo{c}") for c in XYZ], [F.col(f"hi{c}") for c in XYZ]))


BOXED = SPLATS + ", box AS (SELECT " + ", ".join(f"quantile_cont({c}, {q}) AS {n}{c}" for c in XYZ for n, q in (("lo", 0.25), ("hi", 0.75))) + " FROM splats), boxed AS (SELECT *, " + " AND ".join(f"{c} > lo{c} AND {c} < hi{c}" for c in XYZ) + " AS fg FROM splats, box)"


@BOOK.query(f"WITH {BOXED} SELECT id, fg FROM boxed")
def fg_bbox_split(spark: SparkSession, d: str) -> DataFrame:
    return _boxed(spark, d).select("id", "fg")


@BOOK.query(f"WITH {BOXED}, e AS (SELECT *, greatest(hix - lox, hiy - loy, hiz - loz) AS size FROM boxed) SELECT id FROM e WHERE NOT fg AND greatest(abs(x - (lox + hix) / 2), abs(y - (loy + hiy) / 2), abs(z - (loz + hiz) / 2)) < size")
def bg_shell_split(spark: SparkSession, d: str) -> DataFrame:
    size = F.greatest(*(F.col(f"hi{c}") - F.col(f"lo{c}") for c in XYZ))
    shell = filters.in_shell([(F.col(f"lo{c}") + F.col(f"hi{c}")) / 2 for c in XYZ], size)
    return _boxed(spark, d).where(shell & ~F.col("fg")).select("id")


@BOOK.query(f"WITH {SPLATS} SELECT id FROM splats WHERE opacity > 0.5")
def opacity_prune(spark: SparkSession, d: str) -> DataFrame:
    return splats(spark, d).where(filters.opaque()).select("id")


@BOOK.query(f"WITH {SPLATS} SELECT id FROM splats WHERE opacity >= 0.48 AND NOT (greatest(s0, s1, s2) * 100 > 7 OR greatest(s0, s1, s2) > 0.1 * 0.7)")
def densifier_prune(spark: SparkSession, d: str) -> DataFrame:
    rows = splats(spark, d).withColumn("max_scale", F.greatest("s0", "s1", "s2")).withColumn("radius2d", F.col("max_scale") * 100)
    return rows.where(filters.dense_enough(0.48, 7.0, 0.7)).select("id")


@BOOK.query(f"WITH {SPLATS}, q AS (SELECT quantile_cont(opacity, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]) AS qs FROM splats) SELECT CAST(i AS INTEGER) AS step, {q6('qs[i + 1]', 'q')} FROM q, range(11) t(i)")
def opacity_deciles(spark: SparkSession, d: str) -> DataFrame:
    return stats.deciles(splats(spark, d), "opacity").select("step", r6("q").alias("q"))


@BOOK.query(f"SELECT l_returnflag, count(l_extendedprice) AS n, {q6('avg(l_extendedprice)', 'mean')}, {q6('quantile_cont(l_extendedprice, 0.5)', 'median')}, {q6('quantile_cont(l_extendedprice, 0.9)', 'p90')}, {q6('stddev_pop(l_extendedprice)', 'std')} FROM lineitem GROUP BY l_returnflag".replace("round(avg(l_extendedprice), 6)", "round(avg(l_extendedprice), 4)").replace("round(stddev_pop(l_extendedprice), 6)", "round(stddev_pop(l_extendedprice), 4)"))
def distribution_summary(spark: SparkSession, d: str) -> DataFrame:
    s = stats.distribution(table(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag"])
    return s.select("l_returnflag", "n", r6("mean", 4).alias("mean"), r6("median").alias("median"), r6("p90").alias("p90"), r6("std", 4).alias("std"))


@BOOK.query(f"SELECT {q6('avg(CAST(l_discount < 0.05 AS INTEGER))', 'share')} FROM lineitem")
def ratio_below_tau(spark: SparkSession, d: str) -> DataFrame:
    return stats.share_below(table(spark, d, "lineitem"), "l_discount", 0.05).select(r6("share").alias("share"))


@BOOK.query("WITH v AS (SELECT p_size * 3.6 AS a FROM part), n AS (SELECT CAST(least(floor(a / 10), 17) AS INTEGER) AS bin, count(*) AS n FROM v WHERE a BETWEEN 0 AND 180 GROUP BY 1) SELECT CAST(i AS INTEGER) AS bin, coalesce(n, 0) AS n FROM range(18) t(i) LEFT JOIN n ON bin = i")
def histogram_18(spark: SparkSession, d: str) -> DataFrame:
    return stats.histogram(table(spark, d, "part").select((F.col("p_size") * 3.6).alias("a")), "a", 10.0, 18)


@BOOK.query("SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_name, c_custkey) - 1 AS position, CASE WHEN (row_number() OVER (ORDER BY c_name, c_custkey) - 1) % 8 = 0 THEN 'test' ELSE 'train' END AS split FROM customer")
def train_test_split_mod8(spark: SparkSession, d: str) -> DataFrame:
    return filters.split_by_rank(table(spark, d, "customer").select("c_custkey", "c_name"), ["c_name", "c_custkey"])


@BOOK.query("WITH v AS (SELECT event_id, ln(value - 5) AS x FROM events WHERE value > 5 UNION ALL SELECT event_id, NULL FROM events WHERE value <= 5) SELECT count(*) AS n FROM v WHERE x IS NOT NULL AND isfinite(x)")
def finite_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("x", F.ln(F.col("value") - 5))
    return rows.where(filters.finite("x")).agg(F.count("*").alias("n"))


@BOOK.query("SELECT o_orderstatus, count(*) AS n FROM (SELECT o_orderkey, o_orderstatus, count(l_orderkey) AS track FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL) WHERE track >= 3 GROUP BY 1")
def track_length_filter(spark: SparkSession, d: str) -> DataFrame:
    tracks = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("track")).where("track >= 3")
    return table(spark, d, "orders").join(tracks, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@BOOK.query(f"WITH {SPLATS} SELECT id FROM splats WHERE z + 0.25 > 0.2")
def frustum_cull(spark: SparkSession, d: str) -> DataFrame:
    return splats(spark, d).where(F.col("z") + 0.25 > 0.2).select("id")


@BOOK.query(f"WITH {SPLATS}, q AS (SELECT quantile_cont(s0, 0.1) AS q FROM splats) SELECT id FROM splats, q WHERE s0 >= q")
def low_density_removal(spark: SparkSession, d: str) -> DataFrame:
    return filters.over_quantile(splats(spark, d), "s0", 0.1).select("id")


@BOOK.query(f"WITH {SPLATS} SELECT count(DISTINCT (round(x, 2), round(y, 2), round(z, 2))) AS places, count(*) - count(DISTINCT (round(x, 2), round(y, 2), round(z, 2))) AS duplicates FROM splats")
def duplicate_positions(spark: SparkSession, d: str) -> DataFrame:
    places = splats(spark, d).groupBy(*(r6(c, 2).alias(c) for c in XYZ)).agg(F.count("*").alias("n"))
    return places.agg(F.count("*").alias("places"), (F.sum("n") - F.count("*")).alias("duplicates"))


@BOOK.query("SELECT o_custkey, max(o_totalprice) AS radius, round(sum(o_totalprice), 4) AS grad, count(*) AS seen, round(coalesce(sum(o_totalprice) / nullif(count(*), 0), 0), 1) AS mean FROM orders WHERE o_totalprice > 0 GROUP BY 1")
def densification_accumulators(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").where("o_totalprice > 0").groupBy("o_custkey")
    return rows.agg(F.max("o_totalprice").alias("radius"), F.round(F.sum("o_totalprice"), 4).alias("grad"), F.count("*").alias("seen"), F.round(F.coalesce(F.avg("o_totalprice"), F.lit(0.0)), 1).alias("mean"))


@BOOK.query("SELECT count(DISTINCT l_returnflag) = 1 AS l_returnflag, count(DISTINCT l_linestatus) = 1 AS l_linestatus FROM lineitem")
def consistency_check(spark: SparkSession, d: str) -> DataFrame:
    return stats.consistent(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])


# ---- runs and logs


@BOOK.query("SELECT coalesce(c.k, s.k, o.k) AS run, render_balance, geometry_balance, train_orders FROM (SELECT c_custkey AS k, c_acctbal AS render_balance FROM customer) c FULL JOIN (SELECT s_suppkey * 3 AS k, s_acctbal AS geometry_balance FROM supplier) s ON c.k = s.k FULL JOIN (SELECT o_custkey + 7 AS k, count(*) AS train_orders FROM orders GROUP BY 1) o ON coalesce(c.k, s.k) = o.k")
def run_outer_merge(spark: SparkSession, d: str) -> DataFrame:
    return runs.outer_merged(
        {
            "render": table(spark, d, "customer").select(F.col("c_custkey").alias("run"), F.col("c_acctbal").alias("balance")),
            "geometry": table(spark, d, "supplier").select((F.col("s_suppkey") * 3).alias("run"), F.col("s_acctbal").alias("balance")),
            "train": table(spark, d, "orders").groupBy((F.col("o_custkey") + 7).alias("run")).agg(F.count("*").alias("orders")),
        }
    )


_OWN_OR_PARENT = ", ".join(f"CASE WHEN r.{c} IS NULL THEN a.{c} ELSE r.{c} END AS {c}, CASE WHEN r.{c} IS NOT NULL THEN 'own' WHEN a.{c} IS NOT NULL THEN 'inherited:' || parent ELSE 'missing' END AS {group}_source" for group, c in (("render", "psnr"), ("train", "loss")))


@BOOK.query(f"WITH r AS (SELECT c_custkey AS run, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS psnr, CASE WHEN c_custkey % 3 > 0 THEN c_nationkey END AS loss FROM customer), p AS (SELECT c_custkey AS run, c_custkey // 10 AS parent FROM customer WHERE c_custkey // 10 <> c_custkey) SELECT r.run, {_OWN_OR_PARENT} FROM r LEFT JOIN p ON p.run = r.run LEFT JOIN r a ON a.run = p.parent")
def provenance_inherit(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("run"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("psnr"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_nationkey")).alias("loss"))
    parents = c.select("run", F.floor(F.col("run") / 10).alias("parent")).where("run != parent")
    return runs.inherited(c, parents, {"render": ["psnr"], "train": ["loss"]})


@BOOK.query(f"WITH {RECORDS} SELECT run, {q6('coalesce(click, view / 60, purchase * 2)', 'minutes')} FROM records")
def alias_coalesce(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).select("run", r6(runs.first_present(("click", 1.0), ("view", 1 / 60), ("purchase", 2.0))).alias("minutes"))


@BOOK.query("SELECT event_id, coalesce(printf('%.2f', CASE WHEN event_type = 'error' THEN NULL ELSE value * 0 + event_id / 4.0 END), 'NA') AS shown FROM events")
def null_safe_format(spark: SparkSession, d: str) -> DataFrame:
    v = F.when(F.col("event_type") != "error", F.col("event_id") / 4)
    return table(spark, d, "events").select("event_id", runs.shown(v, 2).alias("shown"))


@BOOK.query("SELECT p_partkey, regexp_replace(replace(p_name, ' ', '_'), '^(small_|red_|big_)', '') AS run FROM part")
def run_name_normalise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", runs.normalised_name(F.replace("p_name", F.lit(" "), F.lit("_")), ("small_", "red_", "big_")).alias("run"))


@BOOK.query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS v FROM lineitem")
def map_prefix_lookup(spark: SparkSession, d: str) -> DataFrame:
    m = F.create_map(F.lit("n_all"), F.col("l_tax"), F.concat(F.lit("n_fragments_lt_"), F.col("l_linenumber").cast("string")), F.col("l_quantity"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", runs.prefixed_value(m, "n_fragments_lt_").alias("v"))


@BOOK.query("WITH b AS (SELECT c_acctbal AS base FROM customer WHERE c_custkey = 0) SELECT c_custkey, round((c_acctbal - base) / nullif(base, 0) * 100, 4) AS percent FROM customer, b")
def relative_to_base(spark: SparkSession, d: str) -> DataFrame:
    return stats.relative_to(table(spark, d, "customer"), "c_acctbal", F.col("c_custkey") == 0).select("c_custkey", F.round("percent", 4).alias("percent"))


@BOOK.query(f"WITH {LOG}, m AS (SELECT median(value) * 1.5 AS most FROM log) SELECT count(*) AS blocks, {q6('avg(value)', 'mean')}, {q6('avg(value) FILTER (iteration <= 10)', 'before')}, {q6('avg(value) FILTER (iteration > 10)', 'after')} FROM log, m WHERE value <= most")
def block_time_clean_mean(spark: SparkSession, d: str) -> DataFrame:
    kept = filters.without_contention(log(spark, d), "value")
    early = F.col("iteration") <= 10
    return kept.agg(F.count("*").alias("blocks"), r6(F.avg("value")).alias("mean"), r6(F.avg(F.when(early, F.col("value")))).alias("before"), r6(F.avg(F.when(~early, F.col("value")))).alias("after"))


@BOOK.query(f"WITH {LOG} SELECT run, count(*) AS n, {q6('CASE WHEN count(*) >= 3 THEN regr_slope(value, iteration) * 1000 END', 'slope')} FROM log GROUP BY run")
def trend_slope(spark: SparkSession, d: str) -> DataFrame:
    return stats.trend_slope(log(spark, d), ["run"], "iteration", "value").select("run", "n", r6("slope").alias("slope"))


@BOOK.query(f"WITH {LOG}, r AS (SELECT *, iteration - 1 AS i, count(*) OVER (PARTITION BY run) AS n FROM log), t AS (SELECT *, greatest(1, n // 10) AS k FROM r) SELECT run, any_value(n) AS n, max(value) FILTER (i = 0) AS first, max(value) FILTER (i = n // 2) AS middle, max(value) FILTER (i = n - 1) AS last, {q6('avg(value) FILTER (i < k)', 'head')}, {q6('avg(value) FILTER (i >= n - k)', 'tail')} FROM t GROUP BY run")
def head_tail_means(spark: SparkSession, d: str) -> DataFrame:
    r = stats.head_tail(log(spark, d), ["run"], ["iteration"], "value")
    return r.select("run", "n", "first", "middle", "last", r6("head").alias("head"), r6("tail").alias("tail"))


#: Logs cut after 1 to 6 rows by user, so that some are shorter than a window.
SHORT = LOG + ", short AS (SELECT *, count(*) OVER (PARTITION BY run) AS length FROM log WHERE iteration <= 1 + CAST(substr(run, 4) AS BIGINT) % 6)"


@BOOK.query(f"WITH {SHORT}, pairs AS (SELECT a.event_id, a.run, least(5, any_value(a.length)) AS n, sum(b.value) AS total, count(*) AS seen FROM short a JOIN short b ON a.run = b.run AND b.iteration BETWEEN a.iteration - least(5, a.length) + 1 AND a.iteration GROUP BY a.event_id, a.run), heads AS (SELECT run, value AS head FROM short WHERE iteration = 1) SELECT event_id, {q6('(total + (n - seen) * head) / n', 'smooth')} FROM pairs JOIN heads ON heads.run = pairs.run")
def moving_average_padded(spark: SparkSession, d: str) -> DataFrame:
    short = log(spark, d).where(F.col("iteration") <= 1 + F.substring("run", 4, 20).cast("long") % 6)
    return stats.moving_average(short, ["run"], ["iteration"], "value").select("event_id", r6("smooth").alias("smooth"))


_EMA = lambda w, name: f"round(sum({w} * b.value * pow({1 - w}, a.iteration - b.iteration)), 6) + 0.0 AS {name}"


@BOOK.query(f"WITH {LOG} SELECT a.event_id, {_EMA(0.4, 'ema')}, {_EMA(0.01, 'slow')} FROM log a JOIN log b ON a.run = b.run AND b.iteration <= a.iteration GROUP BY a.event_id")
def ema_loss(spark: SparkSession, d: str) -> DataFrame:
    both = stats.ema(stats.ema(log(spark, d), ["run"], ["iteration"], "value").withColumnRenamed("ema", "fast"), ["run"], ["iteration"], "value", weight=0.01)
    return both.select("event_id", r6("fast").alias("ema"), r6("ema").alias("slow"))


@BOOK.query("SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS INTEGER), -1) AS k, coalesce(json_extract_string(props, '$.a.b'), 'none') AS deep FROM events")
def json_dig(spark: SparkSession, d: str) -> DataFrame:
    path = lambda p: F.get_json_object("props", p)
    return table(spark, d, "events").select("event_id", F.coalesce(path("$.k").cast("int"), F.lit(-1)).alias("k"), F.coalesce(path("$.a.b"), F.lit("none")).alias("deep"))


@BOOK.query("SELECT page_id, TRY_CAST(nullif(regexp_extract(url, 'page=(\\d+)', 1), '') AS INTEGER) AS page, TRY_CAST(nullif(regexp_extract(url, '/(\\d+)[^/]*$', 1), '') AS BIGINT) AS doc FROM pages")
def regex_log_scan(spark: SparkSession, d: str) -> DataFrame:
    number = lambda p, kind: F.nullif(F.regexp_extract("url", p, 1), F.lit("")).try_cast(kind)
    return table(spark, d, "pages").select("page_id", number(r"page=(\d+)", "int").alias("page"), number(r"/(\d+)[^/]*$", "bigint").alias("doc"))


@BOOK.query("SELECT l_suppkey, min(n) AS first, max(n) + 1 AS last FROM (SELECT l_suppkey, row_number() OVER (ORDER BY l_suppkey, l_orderkey, l_linenumber) - 1 AS n FROM lineitem) GROUP BY 1")
def run_length_ranges(spark: SparkSession, d: str) -> DataFrame:
    return ordering.run_ranges(table(spark, d, "lineitem"), ["l_suppkey"], ["l_orderkey", "l_linenumber"])


@BOOK.query("SELECT o_orderkey, sum(tiles) OVER (ORDER BY o_orderkey) AS upto FROM (SELECT o_orderkey, CAST(o_custkey % 7 AS BIGINT) AS tiles FROM orders)".replace("sum(tiles) OVER (ORDER BY o_orderkey)", "CAST(sum(tiles) OVER (ORDER BY o_orderkey) AS BIGINT)"))
def prefix_sum_tiles(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 7).alias("tiles"))
    return ordering.prefix_sum(rows, ["o_orderkey"], "tiles", "upto").select("o_orderkey", "upto")


@BOOK.query("WITH n AS (SELECT DISTINCT p_brand AS run FROM part) SELECT run, row_number() OVER (ORDER BY CASE run WHEN 'Brand#3' THEN 1 WHEN 'Brand#1' THEN 2 ELSE 3 END, run) AS place FROM n")
def custom_run_order(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "part").select(F.col("p_brand").alias("run")).distinct()
    order = runs.preferred_order("run", ["Brand#3", "Brand#1"])
    ranked = ordering.numbered(names.select(order[0].alias("k"), "run"), ["k", "run"], "place")
    return ranked.select("run", (F.col("place") + 1).alias("place"))


@BOOK.query(f"SELECT run, {q6('a', 'a')}, {q6('b', 'b')}, abs(a - b) <= 0.5 AS ok FROM (SELECT user_id AS run, avg(value) AS a FROM events WHERE event_type = 'view' GROUP BY 1) JOIN (SELECT user_id AS run, avg(value) AS b FROM events WHERE event_type = 'click' GROUP BY 1) USING (run)")
def reconcile_psnr(spark: SparkSession, d: str) -> DataFrame:
    side = lambda k: table(spark, d, "events").where(F.col("event_type") == k).groupBy(F.col("user_id").alias("run")).agg(F.avg("value").alias("v"))
    return runs.reconciled(side("view"), side("click"), "run", "v", 0.5).select("run", r6("a").alias("a"), r6("b").alias("b"), "ok")


@BOOK.query(f"WITH {LOG} SELECT run, {q6('avg(value)', 'mean')}, {q6('stddev_pop(value)', 'std')} FROM log GROUP BY run")
def run_mean_std(spark: SparkSession, d: str) -> DataFrame:
    return stats.distribution(log(spark, d), "value", ["run"]).select("run", r6("mean").alias("mean"), r6("std").alias("std"))


@BOOK.query("SELECT event_id FROM (SELECT event_id, event_type, lag(event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events) WHERE event_type <> 'error' AND NOT coalesce(after, false)")
def stateful_line_delete(spark: SparkSession, d: str) -> DataFrame:
    return filters.lines_deleted(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error").select("event_id")


@BOOK.query("SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN 1 ELSE p_size END AS camera FROM part WHERE p_name NOT LIKE '%widget%'")
def like_delete_update(spark: SparkSession, d: str) -> DataFrame:
    kept = table(spark, d, "part").where(~F.col("p_name").like("%widget%"))
    return kept.select("p_partkey", F.when(F.col("p_type") == "ECONOMY", 1).otherwise(F.col("p_size")).alias("camera"))


@BOOK.query("SELECT event_id, lower(event_type) IN ('view', 'click') AS flag, TRY_CAST(regexp_extract_all('(' || value || ', -' || user_id || ', 3e1)', '-?\\d+\\.?\\d*(?:e\\d+)?')[2] AS DOUBLE) AS y FROM events")
def parse_bool_bbox(spark: SparkSession, d: str) -> DataFrame:
    parts = F.regexp_extract_all(F.concat(F.lit("("), F.col("value").cast("string"), F.lit(", -"), F.col("user_id").cast("string"), F.lit(", 3e1)")), F.lit(r"-?\d+\.?\d*(?:e\d+)?"), F.lit(0))
    return table(spark, d, "events").select("event_id", F.lower("event_type").isin("view", "click").alias("flag"), parts[1].try_cast("double").alias("y"))


@BOOK.query(f"WITH {SPLATS} SELECT id, {q6('opacity', 'opacity')}, {q6('ln(opacity / (1 - opacity))', 'back')} FROM splats")
def activations(spark: SparkSession, d: str) -> DataFrame:
    from geofold.functions.geom import logit

    return splats(spark, d).select("id", r6(sigmoid("opacity_logit")).alias("opacity"), r6(logit("opacity")).alias("back"))


@BOOK.query(f"WITH {LOG}, r AS (SELECT run, value - first(value) OVER (PARTITION BY run ORDER BY iteration) AS diff, iteration FROM log) SELECT run, iteration, {q6('diff', 'diff')} FROM r")
def base_row_comparison(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("run").orderBy("iteration").rowsBetween(Window.unboundedPreceding, 0)
    return log(spark, d).select("run", "iteration", r6(F.col("value") - F.first("value").over(w)).alias("diff"))


@BOOK.query(f"WITH {SPLATS}, k AS (SELECT label, id, row_number() OVER (PARTITION BY label ORDER BY s0 DESC, id) AS n FROM splats) SELECT label, id, n FROM k WHERE n <= 10".replace("row_number()", "CAST(row_number()").replace("id) AS n", "id) AS INTEGER) AS n"))
def top_by_group(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("label").orderBy(F.desc("s0"), "id")
    return splats(spark, d).withColumn("n", F.row_number().over(w)).where("n <= 10").select("label", "id", "n")


@BOOK.query(f"WITH {CAMERAS}, {{}} SELECT id, {q6('m', 'mean_distance')} FROM d".replace("{}", "d AS (SELECT c.id, avg(sqrt((c.x - p.x) ** 2 + (c.y - p.y) ** 2 + (c.z - p.z) ** 2)) AS m FROM cameras c, splats p GROUP BY c.id)"))
def camera_point_distance(spark: SparkSession, d: str) -> DataFrame:
    """Every point from every view."""
    cams = cameras(spark, d).select(F.col("id").alias("cam"), *(F.col(c).alias(f"c{c}") for c in XYZ))
    dist = norm([F.col(c) - F.col(f"c{c}") for c in XYZ])
    return stats.with_each(splats(spark, d).select(*XYZ), cams).groupBy(F.col("cam").alias("id")).agg(r6(F.avg(dist)).alias("mean_distance"))


@BOOK.query(f"WITH {RECORDS} SELECT run, {q6('click', 'click')} FROM records WHERE click IS NOT NULL EXCEPT SELECT run, {q6('view', 'click')} FROM records")
def difference_of_records(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d)
    return r.where("click IS NOT NULL").select("run", r6("click").alias("click")).exceptAll(r.select("run", r6("view").alias("click"))).distinct()
