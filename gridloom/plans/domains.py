"""Display domains and series lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import domains, order
from ..sources import cube
from .registry import query

R = S.fixed


@query("""
WITH v AS (SELECT cell_id, year, unnest([{'q': 'p05', 'v': lst - n * 0.5::DOUBLE}, {'q': 'p50', 'v': lst}, {'q': 'p95', 'v': lst + n * 0.25::DOUBLE}], recursive := true) FROM obs),
d AS (SELECT v.q, abs(v.v - r.v) AS d FROM v JOIN v r ON r.cell_id = v.cell_id AND r.q = v.q AND r.year = 1996 WHERE v.year <> 1996),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d) - 1 AS r, count(*) OVER (PARTITION BY q) AS n FROM d)
SELECT q, round(d, 4) AS bound, n FROM k WHERE r = floor(0.98::DOUBLE * (n - 1)) AND d > 0""")
def q_delta_domain(spark, sf):
    """The symmetric domain of changes against the reference frame, for each quantile of the field."""
    o = cube.observations(spark, sf)
    v = F.array(*[F.struct(F.lit(q).alias("q"), (F.col("lst") + s * F.col("n")).alias("v")) for q, s in (("p05", -0.5), ("p50", 0.0), ("p95", 0.25))])
    d = domains.delta_domain(o.select("cell_id", "year", F.inline(v)), "q", "cell_id", "year", "v", 1996)
    return d.select("q", R(F.col("bound")).alias("bound"), "n")


@query("""
WITH a AS (SELECT year, lst - avg(lst) OVER (PARTITION BY year) AS a FROM obs), s AS (SELECT year, quantile_cont(a, 0.02) AS p02, quantile_cont(a, 0.98) AS p98 FROM a GROUP BY year)
SELECT year, round(greatest(abs(p02), abs(p98), 0.05), 4) AS bound, round(p02, 4) AS low, round(p98, 4) AS high FROM s""")
def q_display_domains(spark, sf):
    """Symmetric and sequential domains of a frame's anomalies from its tails."""
    o = cube.observations(spark, sf).select("year", "lst")
    mean = o.groupBy("year").agg(F.avg("lst").alias("mean"))
    a = o.join(F.broadcast(mean), "year").select("year", (F.col("lst") - F.col("mean")).alias("a"))  # one row a frame
    q = order.quantiles(a, ["year"], F.col("a"), [0.0, 0.02, 0.98, 1.0]).select("year", *[F.col("q")[i].alias(n) for i, n in enumerate(("min", "p02", "p98", "max"))])
    tails = [F.col(c) for c in ("p02", "p98", "min", "max")]
    d = q.select("year", domains.symmetric_bound(*tails).alias("bound"), domains.sequential_domain(*tails).alias("d"))
    return d.select("year", R(F.col("bound")).alias("bound"), R(F.col("d")[0]).alias("low"), R(F.col("d")[1]).alias("high"))


@query("""
WITH o AS (SELECT CAST(c_nationkey AS BIGINT) AS scope, CAST(year(o_orderdate) AS BIGINT) AS year, sum(round(o_totalprice * 100)::BIGINT)::DOUBLE / (100.0::DOUBLE * count(*)) AS mean, max(o_totalprice) AS p90 FROM orders JOIN customer ON o_custkey = c_custkey WHERE year(o_orderdate) <= 1996 GROUP BY ALL),
p AS (SELECT CAST(c_nationkey AS BIGINT) AS scope, CAST(year(o_orderdate) AS BIGINT) AS year, o_orderpriority AS ssp, sum(round(o_totalprice * 100)::BIGINT)::DOUBLE / (100.0::DOUBLE * count(*)) AS p50 FROM orders JOIN customer ON o_custkey = c_custkey WHERE year(o_orderdate) >= 1996 GROUP BY ALL),
a AS (SELECT * FROM (SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS scope FROM customer), (SELECT unnest(range(1995, 2001))::BIGINT AS year), (SELECT unnest(['mean', 'p90', 'dtr', 'uhi']) AS metric), (SELECT unnest(['1-URGENT', '5-LOW', 'other']) AS ssp))
SELECT a.scope, a.year, metric, a.ssp, CASE WHEN o.scope IS NOT NULL THEN 'observed' WHEN p.scope IS NOT NULL THEN 'projected' END AS kind,
  CASE WHEN o.scope IS NOT NULL THEN CASE WHEN metric IN ('mean', 'dtr') THEN mean WHEN metric = 'p90' THEN p90 END WHEN metric = 'mean' THEN p50 END AS value
FROM a LEFT JOIN o USING (scope, year) LEFT JOIN p ON p.scope = a.scope AND p.year = a.year AND p.ssp = a.ssp""", cube=False)
def q_metric_at(spark, sf):
    """Values of series at asked years: observed columns, the scenario's median beyond."""
    o, c = cube.table(spark, sf, "orders"), cube.table(spark, sf, "customer")
    j = o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("c_nationkey").cast("long").alias("scope"), F.year("o_orderdate").cast("long").alias("year"), "o_totalprice", F.col("o_orderpriority").alias("ssp"))
    mean = F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double") / (100.0 * F.count(F.lit(1)))  # whole cents: exact sums
    seen = j.filter("year <= 1996").groupBy("scope", "year").agg(mean.alias("mean"), F.max("o_totalprice").alias("p90"))
    ahead = j.filter("year >= 1996").groupBy("scope", "year", "ssp").agg(mean.alias("p50"))
    asked = c.select(F.col("c_nationkey").cast("long").alias("scope")).distinct()
    for name, values in (("year", [F.lit(y).cast("long") for y in range(1995, 2001)]), ("metric", [F.lit(m) for m in ("mean", "p90", "dtr", "uhi")]), ("ssp", [F.lit(s) for s in ("1-URGENT", "5-LOW", "other")])):
        asked = asked.withColumn(name, F.explode(F.array(*values)))
    return domains.metric_at(asked, seen, ahead, ["mean", "p90"])
