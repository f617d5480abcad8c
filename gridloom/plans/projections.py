"""Projections with correlated draws, and resampled fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import draws, grid, order, trends
from ..operators.scratch import stored
from ..sources import cube
from .registry import query

R = S.fixed
SEED, DRAWS, RHO = 11, 40, 0.3
MODELS, BETAS = (0.8, 1.1, 1.4, 1.9), (0.9, 1.0, 1.05, 1.2, 1.3)

_MIXED = "(((({a}) * 73856093 + ({b}) * 19349663) % 2147483647 * ((({a}) * 83492791 + ({b}) * 2654435) % 1000003 + 1)) % 2147483647)"


def _u(stream: int, of: str) -> str:
    inner = _MIXED.format(a=f"{SEED * 16 + stream}::BIGINT", b=of)
    return f"({_MIXED.format(a=inner, b='d')} + 0.5) / 2147483647.0::DOUBLE"


def _z(stream: int, of: str) -> str:
    return f"sqrt(-2 * ln({_u(stream, of)})) * cos(2 * pi() * ({_u(stream + 1, of)}))"


_TERMS = " + ".join(f"{c!r} * pow(t, {k})" for k, c in enumerate(draws.TERMS, 1))
#: Every draw of every cell as a row.
_PROJECTED = f"""
WITH r AS (SELECT least(4, floor(built * 5))::INT AS k, quantile_cont(lst - elev, [i / 20.0 for i in range(21)]) AS s FROM obs JOIN cells USING (cell_id) GROUP BY 1),
c AS (SELECT cell_id, district, row // 10 * 3 + col // 10 AS block, elev, built, s FROM cells LEFT JOIN r ON r.k = least(4, floor(built * 5))),
x AS (SELECT c.*, d, sqrt({RHO}::DOUBLE) * {_z(0, 'block')} + sqrt(1 - {RHO}::DOUBLE) * {_z(2, 'cell_id')} AS z FROM c, (SELECT unnest(range(1, {DRAWS + 1}))::BIGINT AS d)),
t AS (SELECT *, 1 / (1 + {draws.SLOPE} * abs(z)) AS t FROM x),
p AS (SELECT *, CASE WHEN z < 0 THEN exp(-z * z / 2) / sqrt(2 * pi()) * ({_TERMS}) ELSE 1 - exp(-z * z / 2) / sqrt(2 * pi()) * ({_TERMS}) END AS p FROM t),
e AS (SELECT cell_id, district, d, elev + 10 * sqrt(built) * list_extract({list(MODELS)!r}::DOUBLE[], 1 + least({len(MODELS) - 1}, floor(({_u(4, '0')}) * {len(MODELS)}))::INT)
   * list_extract({list(BETAS)!r}::DOUBLE[], 1 + least({len(BETAS) - 1}, floor(({_u(5, '0')}) * {len(BETAS)}))::INT) + coalesce(list_extract(s, 1 + least(20, floor(p * 21))::INT), 0) AS v FROM p)"""


def _projected(spark, sf):
    c = cube.cells(spark, sf).withColumn("k", F.least(F.lit(4), F.floor(F.col("built") * 5)).cast("int"))
    o = cube.observations(spark, sf).join(c, "cell_id")
    res = order.quantiles(o, ["k"], F.col("lst") - F.col("elev"), [i / 20 for i in range(21)]).select("k", F.col("q").alias("residuals"))
    c = c.join(F.broadcast(res), "k", "left")  # five error classes
    return draws.project(
        c, ["cell_id", "district"], cell=F.col("cell_id"), block=grid.block_id(10, cube.WIDTH), residuals=F.col("residuals"), base=F.col("elev"),
        pattern=10 * F.sqrt("built"), models=MODELS, betas=BETAS, rho=RHO, draws=DRAWS, seed=SEED,
    )


@query(f"{_PROJECTED} SELECT cell_id, round(quantile_cont(v, 0.05), 4) AS p05, round(quantile_cont(v, 0.5), 4) AS p50, round(quantile_cont(v, 0.95), 4) AS p95 FROM e GROUP BY cell_id")
def q_correlated_draws(spark, sf):
    """Quantiles of each cell's projected draws."""
    d = _projected(spark, sf)
    return d.select("cell_id", *[R(draws.array_quantile(F.col("draws"), p)).alias(n) for n, p in (("p05", 0.05), ("p50", 0.5), ("p95", 0.95))])


@query(f"""{_PROJECTED}, m AS (SELECT district, d, avg(v) AS m FROM e GROUP BY ALL)
SELECT district, count(*) AS n_draws, round(avg(m), 4) AS mean, round(quantile_cont(m, 0.05), 4) AS p05, round(quantile_cont(m, 0.95), 4) AS p95, round(stddev_pop(m), 4) AS spread FROM m GROUP BY district""")
def q_scope_draws(spark, sf):
    """Quantiles of a district's mean over draws: errors of one block do not average out."""
    m = stored(draws.scope_draws(_projected(spark, sf), "district"), "scopes")
    g = m.groupBy("district").agg(F.count(F.lit(1)).alias("n_draws"), R(F.avg("mean")).alias("m"), R(F.stddev_pop("mean")).alias("spread"), F.collect_list("mean").alias("all"))
    return g.select("district", "n_draws", F.col("m").alias("mean"), *[R(draws.array_quantile(F.col("all"), p)).alias(n) for n, p in (("p05", 0.05), ("p95", 0.95))], "spread")


def _sen(source: str, entity: str, x: str, y: str) -> str:
    return f"""
WITH s AS (SELECT {entity} AS e, {x} AS x, {y} AS y FROM {source}), c AS (SELECT e, count(*) AS n FROM s GROUP BY e HAVING count(*) >= 5),
t AS (SELECT e, (SELECT coalesce(sum(k * (k - 1) * (2 * k + 5)), 0) FROM (SELECT count(*) AS k FROM s q WHERE q.e = c.e GROUP BY x)) + (SELECT coalesce(sum(k * (k - 1) * (2 * k + 5)), 0) FROM (SELECT count(*) AS k FROM s q WHERE q.e = c.e GROUP BY y)) AS t, n FROM c),
p AS (SELECT e, list_sort(list((b.y - a.y) / (b.x - a.x))) AS l FROM s a JOIN s b USING (e) WHERE a.x < b.x GROUP BY e),
k AS (SELECT e, n, l, len(l) AS m, 1.959963984540054::DOUBLE * sqrt((n * (n - 1) * (2 * n + 5) - t) / 18.0) AS z FROM t JOIN p USING (e))
SELECT e AS {entity.split(" ")[-1]}, round((l[(m - 1) // 2 + 1] + l[m // 2 + 1]) / 2, 4) + 0.0 AS slope, round(l[greatest(round((m - z) / 2)::BIGINT - 1, 0) + 1], 4) + 0.0 AS lo, round(l[least(round((m + z) / 2)::BIGINT, m - 1) + 1], 4) + 0.0 AS hi, n FROM k"""


def _rounded(d):
    return d.withColumns({n: R(F.col(n)) for n in ("slope", "lo", "hi")})


@query(_sen("annual", "scope", "year", "value"))
def q_trend_interval(spark, sf):
    """Theil-Sen slope of each scope's years with its 95 % interval."""
    return _rounded(trends.theil_sen(cube.annual(spark, sf), "scope", "year", "value"))


@query(_sen("events", "event_type", "epoch(ts) / 86400", "value"))
def q_trend_interval_long(spark, sf):
    """The same for series of any length, by slope selection."""
    e = cube.table(spark, sf, "events").withColumn("day", F.unix_micros(F.col("ts").cast("timestamp")) / 86400e6)
    return _rounded(trends.theil_sen(e, "event_type", "day", "value"))


_MONTHLY = """m AS (SELECT CAST(c_nationkey AS BIGINT) AS scope, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS month, avg(o_totalprice) / 1000 AS y, avg(c_acctbal) / 1000 AS a, count(*)::DOUBLE AS b FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""
_START = _MIXED.format(a=_MIXED.format(a=f"{SEED * 16}::BIGINT", b="scope"), b="(r * 4096 + j)")
_BETA = "CASE WHEN caa * cbb - cab * cab > 1e-9 * caa * cbb THEN (cay * cbb - cby * cab) / (caa * cbb - cab * cab) END"
_COV = "covar_pop(a, a) AS caa, covar_pop(b, b) AS cbb, covar_pop(a, b) AS cab, covar_pop(a, y) AS cay, covar_pop(b, y) AS cby"


@query(f"""
WITH {_MONTHLY}, s AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY month) - 1 AS i, count(*) OVER (PARTITION BY scope) AS n FROM m),
f AS (SELECT scope, n FROM s GROUP BY scope, n HAVING n >= 6 AND max(a) > min(a)),
k AS (SELECT scope, n, least(6, n) AS size, ceil(n / least(6, n))::BIGINT AS k, r FROM f, (SELECT unnest(range(0, 100)) AS r)),
j AS (SELECT *, unnest(range(0, k)) AS j FROM k),
t AS (SELECT *, floor((({_START}) + 0.5) / 2147483647.0::DOUBLE * (n - size + 1))::BIGINT AS first, CASE WHEN j = k - 1 THEN n - size * (k - 1) ELSE size END AS len FROM j),
d AS (SELECT t.scope, t.r, {_COV} FROM t JOIN s ON s.scope = t.scope AND s.i >= t.first AND s.i < t.first + t.len GROUP BY t.scope, t.r),
b AS (SELECT scope, {_BETA} AS b FROM d), q AS (SELECT scope, quantile_cont(b, 0.025) AS lo, quantile_cont(b, 0.975) AS hi, count(b) AS used FROM b GROUP BY scope),
w AS (SELECT scope, n, {_COV} FROM s GROUP BY scope, n), o AS (SELECT scope, n, {_BETA} AS beta FROM w WHERE scope IN (SELECT scope FROM f))
SELECT scope, n, round(coalesce(beta, 1), 5) + 0.0 AS beta, round(coalesce(lo, 0.5), 5) + 0.0 AS lo, round(coalesce(hi, 1.5), 5) + 0.0 AS hi, coalesce(used, 0) AS used, beta IS NULL AS fallback
FROM (SELECT DISTINCT scope, n FROM s) LEFT JOIN o USING (scope, n) LEFT JOIN q USING (scope)""")
def q_sensitivity_interval(spark, sf):
    """Sensitivity of monthly prices to the mean balance beside the number of orders, with a moving-block interval."""
    o, c = cube.table(spark, sf, "orders"), cube.table(spark, sf, "customer")
    j = o.join(c, o["o_custkey"] == c["c_custkey"])
    m = j.groupBy(F.col("c_nationkey").cast("long").alias("scope"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long").alias("month"))
    m = stored(m.agg((F.avg("o_totalprice") / 1000).alias("y"), (F.avg("c_acctbal") / 1000).alias("a"), F.count(F.lit(1)).cast("double").alias("b")), "months")
    out = trends.block_bootstrap(m, "scope", "month", "y", "a", "b", block=6, draws=100, seed=SEED)
    return out.withColumns({n: R(F.col(n), 5) for n in ("beta", "lo", "hi")})
