"""Queries of the coverage, interval and signal operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.operators import coverage, intervals, signal
from helixframe.plans.views import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
LAPLACE = signal.kernel("laplace", 3, 3)
GAUSS = signal.kernel("gauss", 3, 3)


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query whose function takes a reader of views."""
    def add(f: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf: f(lambda v: view(spark, sf, v))
        if sql is not None:
            SQL[name] = with_views(sql)
        return f
    return add


def kernel_sql(weights: list[tuple[int, float]]) -> str:
    return "(VALUES " + ", ".join(f"({x}, CAST({w!r} AS DOUBLE))" for x, w in weights) + ") k(o, w)"


# --- coverage ---------------------------------------------------------------------------------

@query("cov_expand_runs", 'SELECT chrom, strand, pos, sum(value) AS value FROM (SELECT chrom, strand, unnest(range(start, "end")) AS pos, value FROM v_run) GROUP BY 1, 2, 3')
def _(v):
    return coverage.expand_runs(v("v_run"))


@query("cov_expand_runs_last", 'SELECT chrom, strand, pos, arg_max(value, start) AS value FROM (SELECT chrom, strand, start, unnest(range(start, "end")) AS pos, value FROM v_run) GROUP BY 1, 2, 3')
def _(v):
    return coverage.expand_runs(v("v_run"), on_overlap="last")


_COMBINED = """c AS (SELECT chrom, strand, pos, sum(x) AS value FROM (
  SELECT chrom, strand, pos, value * 2.0 AS x FROM v_end UNION ALL SELECT chrom, strand, pos, -value FROM v_body) GROUP BY 1, 2, 3)"""
_RUNS = """SELECT chrom, strand, min(pos) AS start, max(pos) + 1 AS "end", value FROM (
  SELECT chrom, strand, pos, value, pos - row_number() OVER (PARTITION BY chrom, strand, value ORDER BY pos) AS g FROM c WHERE value <> 0)
GROUP BY chrom, strand, value, g"""


@query("cov_combine", f"WITH {_COMBINED} SELECT * FROM c WHERE value <> 0")
def _(v):
    return coverage.combine([(v("v_end"), 2.0), (v("v_body"), -1.0)])


@query("cov_runs", f"WITH {_COMBINED} {_RUNS}")
def _(v):
    return coverage.encode_runs(coverage.combine([(v("v_end"), 2.0), (v("v_body"), -1.0)]))


@query("cov_pivot_runs", """
WITH w AS (SELECT chrom, strand, pos, sum(CASE WHEN sample = 's0' THEN value ELSE 0.0 END) AS s0, sum(CASE WHEN sample = 's1' THEN value ELSE 0.0 END) AS s1,
  sum(CASE WHEN sample = 's2' THEN value ELSE 0.0 END) AS s2 FROM v_sample GROUP BY 1, 2, 3)
SELECT chrom, strand, min(pos) AS start, max(pos) + 1 AS "end", s0, s1, s2 FROM (
  SELECT *, pos - row_number() OVER (PARTITION BY chrom, strand, s0, s1, s2 ORDER BY pos) AS g FROM w) GROUP BY chrom, strand, s0, s1, s2, g""")
def _(v):
    return coverage.pivot_runs(v("v_sample"), "sample", ["s0", "s1", "s2"])


@query("cov_rpm", "SELECT chrom, strand, pos, value, value * 1e6 / (SELECT sum(value) FROM v_end) AS rpm FROM v_end")
def _(v):
    return coverage.rpm(v("v_end"))


@query("cov_end_counts", """SELECT chrom, strand, CASE WHEN strand = '+' THEN start ELSE "end" - 1 END AS pos, sum(score) AS value FROM v_feat GROUP BY 1, 2, 3""")
def _(v):
    return coverage.end_counts(v("v_feat").withColumnRenamed("score", "weight"))


@query("cov_body", 'SELECT chrom, strand, pos, sum(score) AS value FROM (SELECT chrom, strand, unnest(range(start, "end")) AS pos, score FROM v_feat) GROUP BY 1, 2, 3')
def _(v):
    return coverage.body_coverage(v("v_feat").withColumnRenamed("score", "weight"))


# --- interval algebra -------------------------------------------------------------------------

_HIT = 'a.chrom = b.chrom AND a.strand = b.strand AND a.start < b."end" AND b.start < a."end"'


@query("iv_overlap", f"SELECT a.event_id AS a_id, b.event_id AS b_id FROM v_feat a JOIN v_point b ON {_HIT}")
def _(v):
    return intervals.overlap_join(v("v_feat"), v("v_point"), ["chrom", "strand"], width=128).select(F.col("a_event_id").alias("a_id"), F.col("b_event_id").alias("b_id"))


@query("iv_anti", f"SELECT event_id, start FROM v_feat a WHERE NOT EXISTS (SELECT 1 FROM v_point b WHERE {_HIT})")
def _(v):
    return intervals.overlap_join(v("v_feat"), v("v_point"), ["chrom", "strand"], how="left_anti", width=128).select("event_id", "start")


@query("iv_semi", f"SELECT event_id, start FROM v_feat a WHERE EXISTS (SELECT 1 FROM v_point b WHERE {_HIT})")
def _(v):
    return intervals.overlap_join(v("v_feat"), v("v_point"), ["chrom", "strand"], how="left_semi", width=128).select("event_id", "start")


def _nearest_sql(keys: str, keep: str) -> str:
    return f"""
WITH p AS (SELECT a.event_id, b.event_id AS b_event_id, a.strand,
    CASE WHEN a.start < b."end" AND b.start < a."end" THEN 0 WHEN b."end" <= a.start THEN a.start - b."end" + 1 ELSE b.start - a."end" + 1 END AS gap,
    CASE WHEN a.start < b."end" AND b.start < a."end" THEN 0 WHEN (b."end" <= a.start) = (a.strand = '-') THEN -1 ELSE 1 END AS side
  FROM v_point a JOIN f b ON {keys}),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY gap, b_event_id) AS n FROM p WHERE {keep})
"""


def _nearest(v, keys, direction, strand):
    b = v("v_feat").withColumnRenamed("event_id", "b_event_id")
    return intervals.nearest(v("v_point"), b, keys, "event_id", "b_event_id", direction, strand, width=128, shard=4096)


_FEATS = "WITH f AS (SELECT * FROM v_feat), "
for _name, _keys, _on, _dir in (
    ("iv_nearest_ahead", ["chrom", "strand"], "a.chrom = b.chrom AND a.strand = b.strand", "ahead"),
    ("iv_nearest_behind", ["chrom", "strand"], "a.chrom = b.chrom AND a.strand = b.strand", "behind"),
    ("iv_nearest_any", ["chrom"], "a.chrom = b.chrom", "any"),
):
    _keep = {"ahead": "side <= 0", "behind": "side >= 0", "any": "true"}[_dir]
    _value = "gap * side" if _dir != "any" else "gap"
    query(_name, _FEATS + _nearest_sql(_on, _keep).strip()[5:] + f"SELECT event_id, b_event_id, {_value} AS distance FROM r WHERE n = 1")(
        lambda v, k=_keys, d=_dir: _nearest(v, k, d, "strand" if d != "any" else None)
    )


@query("iv_nearest_opposite", "WITH f AS (SELECT * REPLACE (CASE strand WHEN '+' THEN '-' ELSE '+' END AS strand) FROM v_feat), "
       + _nearest_sql("a.chrom = b.chrom AND a.strand = b.strand", "true").strip()[5:] + "SELECT event_id, b_event_id, gap AS distance FROM r WHERE n = 1")
def _(v):
    b = v("v_feat").withColumn("strand", F.when(F.col("strand") == "+", "-").otherwise("+")).withColumnRenamed("event_id", "b_event_id")
    return intervals.nearest(v("v_point"), b, ["chrom", "strand"], "event_id", "b_event_id", width=128, shard=4096)


@query("iv_subtract", """
WITH m AS (SELECT DISTINCT chrom, strand, start, "end" FROM v_point),
b AS (SELECT chrom, strand, unnest(range(start, "end")) AS pos FROM m),
a AS (SELECT event_id, chrom, strand, unnest(range(start, "end")) AS pos FROM v_feat),
k AS (SELECT event_id, pos FROM a ANTI JOIN b USING (chrom, strand, pos)),
g AS (SELECT event_id, pos, pos - row_number() OVER (PARTITION BY event_id ORDER BY pos) AS g FROM k)
SELECT event_id, min(pos) AS start, max(pos) + 1 AS "end" FROM g GROUP BY event_id, g.g""")
def _(v):
    return intervals.subtract(v("v_feat"), v("v_point"), ["chrom", "strand"], "event_id", width=128).select("event_id", "start", "end")


@query("iv_map_max", f"SELECT a.event_id, coalesce(max(b.score), 0) AS mapped FROM v_feat a LEFT JOIN v_point b ON {_HIT} GROUP BY 1")
def _(v):
    return intervals.map_overlaps(v("v_feat"), v("v_point"), ["chrom", "strand"], "event_id", "score", width=128)


_MERGE = """
WITH d AS (SELECT DISTINCT chrom, strand, start, "end" FROM v_feat),
f AS (SELECT *, max("end") OVER (PARTITION BY chrom, strand ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM d),
g AS (SELECT *, sum(CASE WHEN m IS NULL OR start {op} m THEN 1 ELSE 0 END) OVER (PARTITION BY chrom, strand ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS c FROM f),
r AS (SELECT chrom, strand, min(start) AS start, max("end") AS "end" FROM g GROUP BY chrom, strand, c)
"""


@query("iv_merge", _MERGE.format(op=">") + "SELECT * FROM r")
def _(v):
    return intervals.merge(v("v_feat"), ["chrom", "strand"])


@query("iv_merge_strict", _MERGE.format(op=">=") + "SELECT * FROM r")
def _(v):
    return intervals.merge(v("v_feat"), ["chrom", "strand"], book_ended=False)


@query("iv_cluster", _MERGE.format(op=">") + 'SELECT e.event_id, r.start AS c_start, r."end" AS c_end FROM v_feat e JOIN r ON e.chrom = r.chrom AND e.strand = r.strand AND e.start >= r.start AND e.start < r."end"')
def _(v):
    return intervals.cluster(v("v_feat"), ["chrom", "strand"]).select("event_id", "c_start", "c_end")


@query("iv_merge_columns", _MERGE.format(op=">") + """
SELECT r.chrom, r.strand, r.start, r."end", count(*) AS n, min(e.score) AS least, count(DISTINCT e.user_id) AS users
FROM v_feat e JOIN r ON e.chrom = r.chrom AND e.strand = r.strand AND e.start >= r.start AND e.start < r."end" GROUP BY 1, 2, 3, 4""")
def _(v):
    c = intervals.cluster(v("v_feat"), ["chrom", "strand"])
    return c.groupBy("chrom", "strand", F.col("c_start").alias("start"), F.col("c_end").alias("end")).agg(
        F.count(F.lit(1)).alias("n"), F.min("score").alias("least"), F.countDistinct("user_id").alias("users"))


@query("iv_replicable", _MERGE.format(op=">") + """
SELECT r.chrom, r.strand, r.start, r."end" FROM v_feat e JOIN r ON e.chrom = r.chrom AND e.strand = r.strand AND e.start >= r.start AND e.start < r."end"
GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT e.user_id % 3) >= 2""")
def _(v):
    c = intervals.cluster(v("v_feat").withColumn("sample", F.col("user_id") % 3), ["chrom", "strand"])
    return c.groupBy("chrom", "strand", F.col("c_start").alias("start"), F.col("c_end").alias("end")).agg(F.countDistinct("sample").alias("n")).where("n >= 2").drop("n")


@query("iv_feature_sum", """
SELECT f.event_id, coalesce(sum(r.value * (least(f."end", r."end") - greatest(f.start, r.start))), 0) AS total
FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'A' WHEN event_id % 3 = 1 THEN 'N' ELSE 'R' END AS c FROM v_feat) f
LEFT JOIN v_run r ON f.c = r.chrom AND f.strand = r.strand AND f.start < r."end" AND r.start < f."end" GROUP BY 1""")
def _(v):
    f = v("v_feat").withColumn("chrom", F.when(F.col("event_id") % 3 == 0, "A").when(F.col("event_id") % 3 == 1, "N").otherwise("R"))
    return intervals.covered_sum(f, v("v_run"), ["chrom", "strand"], "event_id", width=128)


_MASK = "(SELECT DISTINCT CASE WHEN event_id % 3 = 0 THEN 'A' WHEN event_id % 3 = 1 THEN 'N' ELSE 'R' END AS chrom, strand, {} AS pos FROM v_feat)"
for _mode, _pos in (("inside", 'unnest(range(start, "end" + 1))'), ("up", "CASE WHEN strand = '+' THEN \"end\" ELSE start - 1 END"), ("down", "CASE WHEN strand = '+' THEN start - 1 ELSE \"end\" END")):
    @query(f"iv_mask_{_mode}", f"SELECT c.chrom, c.strand, c.pos, c.value FROM v_end c ANTI JOIN {_MASK.format(_pos)} m ON c.chrom = m.chrom AND c.strand = m.strand AND c.pos = m.pos")
    def _(v, mode=_mode):
        f = v("v_feat").withColumn("chrom", F.when(F.col("event_id") % 3 == 0, "A").when(F.col("event_id") % 3 == 1, "N").otherwise("R"))
        return coverage.mask(v("v_end"), f, mode).select("chrom", "strand", "pos", "value")


@query("cnt_feature_matrix", """
WITH f AS (SELECT DISTINCT user_id, strand, CASE WHEN user_id % 3 = 0 THEN 'A' WHEN user_id % 3 = 1 THEN 'N' ELSE 'R' END AS chrom, unnest(range(start, "end")) AS pos FROM v_feat)
SELECT n.user_id, coalesce(sum(CASE WHEN s.sample = 's0' THEN s.value END), 0) AS s0, coalesce(sum(CASE WHEN s.sample = 's1' THEN s.value END), 0) AS s1,
  coalesce(sum(CASE WHEN s.sample = 's2' THEN s.value END), 0) AS s2
FROM (SELECT DISTINCT user_id FROM v_feat) n LEFT JOIN f ON n.user_id = f.user_id LEFT JOIN v_sample s ON f.chrom = s.chrom AND f.strand = s.strand AND f.pos = s.pos GROUP BY 1""")
def _(v):
    f = v("v_feat").withColumn("chrom", F.when(F.col("user_id") % 3 == 0, "A").when(F.col("user_id") % 3 == 1, "N").otherwise("R"))
    return coverage.feature_matrix(f, v("v_sample"), "sample", ["s0", "s1", "s2"], name="user_id")


@query("iv_dedup_highscore", "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, start, \"end\", event_id) AS n FROM v_feat) WHERE n = 1")
def _(v):
    return intervals.deduplicate(v("v_feat"), ["user_id"], "highscore", ["start", "end", "event_id"]).select("event_id", "user_id")


@query("iv_dedup_upstream", """SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id
  ORDER BY CASE WHEN strand = '-' THEN -"end" ELSE start END, start, "end", event_id) AS n FROM v_feat) WHERE n = 1""")
def _(v):
    return intervals.deduplicate(v("v_feat"), ["user_id"], "upstream", ["start", "end", "event_id"]).select("event_id", "user_id")


@query("iv_dedup_unique", 'SELECT any_value(event_id) AS event_id, chrom, start FROM v_feat GROUP BY chrom, start HAVING count(*) = 1')
def _(v):
    return intervals.deduplicate(v("v_feat"), ["chrom", "start"], "first", ["event_id"], only_unique=True).select("event_id", "chrom", "start")


# adjacent rows by position with the same user: one row a run, by each way to choose
_RUN = """WITH o AS (SELECT *, row_number() OVER (ORDER BY chrom, start, "end", event_id) AS place, row_number() OVER (PARTITION BY user_id % 3 ORDER BY chrom, start, "end", event_id) AS within FROM v_feat),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id % 3, place - within ORDER BY {}) AS n FROM o) SELECT event_id FROM r WHERE n = 1"""
_ALONG = "CASE WHEN strand = '-' THEN -\"end\" ELSE start END"
for _name, _rank in {
    "first": "place", "last": "place DESC", "left": "start, place", "right": '"end" DESC, place', "upstream": f"{_ALONG}, place", "downstream": f"{_ALONG} DESC, place", "highscore": "score DESC, place", "lowscore": "score, place",
}.items():
    query(f"iv_runs_{_name}", _RUN.format(_rank))(
        lambda v, n=_name: intervals.deduplicate_runs(v("v_feat").withColumn("k", F.col("user_id") % 3), ["k"], ["chrom", "start", "end", "event_id"], select=n).select("event_id")
    )


# --- signal -----------------------------------------------------------------------------------

def _smooth_sql(weights):
    return f"""WITH c AS (SELECT chrom, strand, pos + o AS pos, sum(value * w) AS value FROM v_end, {kernel_sql(weights)} GROUP BY 1, 2, 3 HAVING pos + o >= 0 AND sum(value * w) > 1e-9)"""


@query("sig_convolve_laplace", f"SELECT chrom, strand, pos + o AS pos, sum(value * w) AS value FROM v_end, {kernel_sql(LAPLACE)} WHERE pos + o >= 0 GROUP BY 1, 2, 3 HAVING sum(value * w) > 1e-9")
def _(v):
    return signal.convolve(v("v_end"), LAPLACE)


@query("sig_convolve_gauss", f"SELECT chrom, strand, pos + o AS pos, sum(value * w) AS value FROM v_end, {kernel_sql(GAUSS)} WHERE pos + o >= 0 GROUP BY 1, 2, 3 HAVING sum(value * w) > 1e-9")
def _(v):
    return signal.convolve(v("v_end"), GAUSS)


_ISLAND = """g AS (SELECT chrom, strand, pos, value, pos - row_number() OVER (PARTITION BY chrom, strand ORDER BY pos) AS g FROM v_end WHERE value > 47),
i AS (SELECT chrom, strand, min(pos) AS start, max(pos) + 1 AS "end", g FROM g GROUP BY chrom, strand, g HAVING count(*) >= 2),
x AS (SELECT i.chrom, i.strand, i.start, i."end", e.pos, e.value FROM i JOIN v_end e ON i.chrom = e.chrom AND i.strand = e.strand AND e.pos >= i.start AND e.pos < i."end")"""


@query("sig_islands", f'WITH {_ISLAND} SELECT chrom, strand, start, "end" FROM i')
def _(v):
    return signal.islands(v("v_end"), 47, 2)


def _inside(v):
    return signal.in_features(v("v_end"), signal.islands(v("v_end"), 47, 2))


@query("sig_peaks", f"""WITH {_ISLAND} SELECT chrom, strand, start, "end", sum(value) AS total, avg(value) AS mean, max(value) AS high,
  max(CASE WHEN value = h THEN pos END) AS peak FROM (SELECT *, max(value) OVER (PARTITION BY chrom, strand, start) AS h FROM x) GROUP BY 1, 2, 3, 4""")
def _(v):
    return signal.feature_values(_inside(v))


_MAXIMA = f"""{_ISLAND}, s AS (SELECT *, lag(value) OVER f AS b FROM x WINDOW f AS (PARTITION BY chrom, strand, start ORDER BY pos)),
p AS (SELECT *, sum(CASE WHEN b = value THEN 0 ELSE 1 END) OVER (PARTITION BY chrom, strand, start ORDER BY pos ROWS UNBOUNDED PRECEDING) AS k FROM s),
q AS (SELECT chrom, strand, start, "end", k, max(pos) AS pos, any_value(value) AS value FROM p GROUP BY 1, 2, 3, 4, 5),
m AS (SELECT * FROM (SELECT *, lag(value) OVER w AS l, lead(value) OVER w AS n FROM q WINDOW w AS (PARTITION BY chrom, strand, start ORDER BY k)) WHERE (l IS NULL OR l < value) AND n < value)"""


@query("sig_local_maxima", f'WITH {_MAXIMA} SELECT chrom, strand, start, "end", pos, value FROM m')
def _(v):
    return signal.local_maxima(_inside(v))


@query("sig_secondary", f"""WITH {_MAXIMA}, r AS (SELECT *, row_number() OVER (PARTITION BY chrom, strand, start ORDER BY value DESC, pos DESC) AS r FROM m)
SELECT chrom, strand, start, "end", coalesce(string_agg(CAST(pos AS VARCHAR), ',' ORDER BY r) FILTER (WHERE r > 1), '-') AS secondary FROM r WHERE r <= 10 GROUP BY 1, 2, 3, 4""")
def _(v):
    return signal.secondary_peaks(signal.local_maxima(_inside(v)))


@query("sig_trim", f"""WITH {_ISLAND}, r AS (SELECT *, row_number() OVER t AS n, sum(value) OVER (t ROWS UNBOUNDED PRECEDING) AS run, sum(value) OVER (PARTITION BY chrom, strand, start) AS total
  FROM x WINDOW t AS (PARTITION BY chrom, strand, start ORDER BY value DESC, pos DESC)),
e AS (SELECT *, min(CASE WHEN run >= total * 0.6 - 1e-9 THEN n END) OVER (PARTITION BY chrom, strand, start) AS enough FROM r),
l AS (SELECT *, max(CASE WHEN n = enough THEN value END) OVER (PARTITION BY chrom, strand, start) AS least FROM e)
SELECT chrom, strand, start, "end", min(pos) AS new_start, max(pos) + 1 AS new_end, CAST(max(enough) AS INTEGER) AS n FROM l WHERE value >= least GROUP BY 1, 2, 3, 4""")
def _(v):
    return signal.trim(_inside(v), 0.6)


@query("sig_period", f"""WITH {_ISLAND}, k AS (SELECT *, first_value(pos) OVER (PARTITION BY chrom, strand, start ORDER BY value DESC, pos DESC) AS peak, sum(value) OVER (PARTITION BY chrom, strand, start) AS total FROM x),
y AS (SELECT *, unnest(range(1, "end" - start + 1)) AS p FROM k),
z AS (SELECT chrom, strand, start, "end", p, sum(CASE WHEN (pos - peak) % p = 0 THEN value END) AS hit, max(("end" - 1 - peak) // p + (peak - start) // p + 1) AS spots, max(total) AS total FROM y GROUP BY 1, 2, 3, 4, 5),
o AS (SELECT *, hit / spots * hit / total AS score, row_number() OVER (PARTITION BY chrom, strand, start ORDER BY hit / spots * hit / total DESC, p DESC) AS n FROM z)
SELECT chrom, strand, start, "end", CAST(p AS INTEGER) AS period, score FROM o WHERE n = 1""")
def _(v):
    return signal.period_scores(_inside(v))


@query("sig_flank_max", """
WITH s AS (SELECT chrom, strand, pos AS start, pos + 1 AS "end" FROM v_uug),
w AS (SELECT chrom, strand, start, CASE WHEN start < 20 THEN 0 ELSE start - 20 END AS a, CASE WHEN start < 20 THEN "end" - 1 ELSE "end" - 2 END AS b FROM s
  UNION ALL SELECT chrom, strand, start, start + 2, "end" + 20 FROM s)
SELECT w.chrom, w.strand, w.start, coalesce(max(e.value), 0) AS flank_max FROM w LEFT JOIN v_end e ON e.chrom = w.chrom AND e.strand = w.strand AND e.pos >= w.a AND e.pos < w.b GROUP BY 1, 2, 3""")
def _(v):
    sites = v("v_uug").select("chrom", "strand", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"))
    windows = signal.flank_windows(sites, 20).select("chrom", "strand", F.col("start").alias("site"), F.col("w_start").alias("start"), F.col("w_end").alias("end"))
    points = v("v_end").select("chrom", "strand", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), "value")
    hits = intervals.overlap_join(windows, points, ["chrom", "strand"], width=64).groupBy(
        F.col("a_chrom").alias("chrom"), F.col("a_strand").alias("strand"), F.col("a_site").alias("start")).agg(F.max("b_value").alias("m"))
    return sites.drop("end").join(hits, ["chrom", "strand", "start"], "left").select("chrom", "strand", "start", F.coalesce("m", F.lit(0.0)).alias("flank_max"))


@query("sig_moving_average", "SELECT chrom, strand, pos, avg(value) OVER (PARTITION BY chrom, strand ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS smooth FROM v_end")
def _(v):
    return signal.moving_average(v("v_end"), ["chrom", "strand"], "pos", "value", 2).select("chrom", "strand", "pos", "smooth")
