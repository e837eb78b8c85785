"""Statistical tests as aggregates over lagged columns; p-values of the few result rows by small kernels."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

TINY = 2.220446049250313e-16


@pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    """P(|Z| >= |z|) of a standard normal."""
    return z.map(lambda v: None if pd.isna(v) else math.erfc(abs(v) / math.sqrt(2)))


@pandas_udf(DoubleType())
def chi2_1_sf(x: pd.Series) -> pd.Series:
    """Upper tail of chi-square with one degree of freedom."""
    return x.map(lambda v: None if pd.isna(v) else math.erfc(math.sqrt(max(v, 0.0) / 2)))


def chi2_even_sf(x: Column, df: int) -> Column:
    """Upper tail of chi-square with an even number of degrees of freedom (a finite sum)."""
    half = x / 2
    terms = [F.lit(1.0)]
    for k in range(1, df // 2):
        terms.append(terms[-1] * half / k)
    return F.exp(-half) * sum(terms[1:], terms[0])


@pandas_udf(DoubleType())
def binomial_at_most(hits: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """P(X <= hits) of a binomial."""

    def one(k, m, q):
        if pd.isna(k) or pd.isna(m) or m < 1:
            return None
        logs = [math.lgamma(m + 1) - math.lgamma(i + 1) - math.lgamma(m - i + 1) + i * math.log(q) + (m - i) * math.log1p(-q) for i in range(int(k) + 1)]
        top = max(logs)
        return min(1.0, math.exp(top) * math.fsum(math.exp(v - top) for v in logs))

    return pd.Series([one(*x) for x in zip(hits, n, p, strict=True)], dtype="float64")


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def one_sided(statistic: Column, two_sided: Column) -> Column:
    """Upper-tail p-value from a statistic and its two-sided p-value."""
    return F.when(statistic >= 0, two_sided / 2).otherwise(1 - two_sided / 2)


def hac_test(losses: DataFrame, keys, order: str, value: str, lags: int = 4) -> DataFrame:
    """Newey-West test that a mean is not zero: keys, n, mean, statistic, p_value.

    Bartlett weights, autocovariances divided by n. Fewer rows than max(20, 2 lags + 2): all null; no
    long-run variance: mean only. Lagged products are summed in one aggregation.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    v = F.col(value)
    lagged = losses.where(v.isNotNull()).select(*keys, v.alias("v"), *(F.lag(v, k).over(w).alias(f"v{k}") for k in range(1, lags + 1)))
    sums = [F.sum(F.col("v") * F.col(f"v{k}")).alias(f"p{k}") for k in range(1, lags + 1)]
    sums += [F.sum(F.when(F.col(f"v{k}").isNotNull(), F.col("v")) + F.col(f"v{k}")).alias(f"q{k}") for k in range(1, lags + 1)]
    g = lagged.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.var_pop("v").alias("g0"), *sums)
    n, m = F.col("n"), F.col("mean")
    long_run = F.col("g0")
    for k in range(1, lags + 1):
        cov = (F.coalesce(F.col(f"p{k}"), F.lit(0.0)) - m * F.coalesce(F.col(f"q{k}"), F.lit(0.0)) + F.greatest(n - k, F.lit(0)) * m * m) / n
        long_run = long_run + 2 * (1 - k / (lags + 1)) * cov
    enough = n >= max(20, 2 * lags + 2)
    statistic = F.when(enough & (F.col("long_run") > TINY), m / F.sqrt(F.col("long_run") / n))
    g = g.withColumn("long_run", long_run).withColumn("statistic", statistic)
    return g.select(*keys, "n", F.when(enough, m).alias("mean"), "statistic", normal_two_sided("statistic").alias("p_value"))


def distribution_table(series: DataFrame, keys, order: str, value: str, lags: int = 10) -> DataFrame:
    """Bias-corrected skewness and excess kurtosis, Jarque-Bera, Ljung-Box of values and of squares, status."""
    if lags % 2:
        raise ValueError("lags must be even, for the closed form of the tail")
    w = Window.partitionBy(*keys).orderBy(order)
    rows = series.select(*keys, F.col(value).alias("v"), (F.col(value) * F.col(value)).alias("s"), F.col(order).alias("_o"))
    w = Window.partitionBy(*keys).orderBy("_o")
    lagged = rows.select("*", *(F.lag(c, k).over(w).alias(f"{c}{k}") for c in "vs" for k in range(1, lags + 1)))
    sums = [F.count("*").alias("n"), F.skewness("v").alias("g1"), F.kurtosis("v").alias("g2")]
    for c in "vs":
        sums += [F.avg(c).alias(f"m_{c}"), F.var_pop(c).alias(f"d_{c}")]
        sums += [F.sum(F.col(c) * F.col(f"{c}{k}")).alias(f"p_{c}{k}") for k in range(1, lags + 1)]
        sums += [F.sum(F.when(F.col(f"{c}{k}").isNotNull(), F.col(c)) + F.col(f"{c}{k}")).alias(f"q_{c}{k}") for k in range(1, lags + 1)]
    g = lagged.groupBy(*keys).agg(*sums)
    n = F.col("n")

    def ljung_box(c):
        m = F.col(f"m_{c}")
        rho = [(F.col(f"p_{c}{k}") - m * F.col(f"q_{c}{k}") + (n - k) * m * m) / (n * F.col(f"d_{c}")) for k in range(1, lags + 1)]
        q = n * (n + 2) * sum((r * r / (n - k) for k, r in enumerate(rho, start=1)), F.lit(0.0))
        return F.when((n > lags + 2) & (F.col(f"d_{c}") > TINY), q)

    jb = n / 6 * (F.col("g1") * F.col("g1") + F.col("g2") * F.col("g2") / 4)
    skew = F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = ((n + 1) * F.col("g2") + 6) * (n - 1) / ((n - 2) * (n - 3))
    out = g.select(*keys, n.alias("n"), skew.alias("skewness"), kurt.alias("excess_kurtosis"), jb.alias("jarque_bera"), F.exp(-jb / 2).alias("jarque_bera_p"), ljung_box("v").alias("ljung_box"), ljung_box("s").alias("ljung_box_squares"))
    out = out.withColumn("ljung_box_p", chi2_even_sf(F.col("ljung_box"), lags)).withColumn("ljung_box_squares_p", chi2_even_sf(F.col("ljung_box_squares"), lags))
    warn = (F.col("jarque_bera_p") < 0.05) | F.coalesce(F.col("ljung_box_squares_p") < 0.05, F.lit(False))
    return out.withColumn("status", F.when(warn, "WARN").otherwise("PASS"))


def xlogy(x: Column, y: Column) -> Column:
    """x ln y, and 0 for x = 0."""
    return F.when(x == 0, F.lit(0.0)).otherwise(x * F.ln(y))


def coverage_tests(hits: DataFrame, keys, order: str, hit: str, probability: Column) -> DataFrame:
    """Kupiec's proportion of failures against ``probability`` and Christoffersen's independence and joint tests.

    keys, n, exceptions, kupiec_lr, kupiec_p, independence_lr, independence_p, joint_lr, joint_p.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    rows = hits.select(*keys, F.col(hit).cast("int").alias("x"), F.lag(F.col(hit).cast("int")).over(w).alias("y"), probability.alias("p0"))
    cell = lambda a, b: F.count_if((F.col("y") == a) & (F.col("x") == b)).cast("double")
    g = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("x").alias("exceptions"), F.max("p0").alias("p0"), cell(0, 0).alias("n00"), cell(0, 1).alias("n01"), cell(1, 0).alias("n10"), cell(1, 1).alias("n11"))
    n, e, p0 = F.col("n"), F.col("exceptions"), F.col("p0")
    n00, n01, n10, n11 = (F.col(c) for c in ("n00", "n01", "n10", "n11"))
    rate = e / n
    kupiec = F.greatest(F.lit(0.0), -2 * (xlogy(e, p0) + xlogy(n - e, 1 - p0) - xlogy(e, rate) - xlogy(n - e, 1 - rate)))
    ratio = lambda a, b: F.when(b > 0, a / F.greatest(b, F.lit(1.0))).otherwise(0.0)
    p01, p11, p = ratio(n01, n00 + n01), ratio(n11, n10 + n11), ratio(n01 + n11, n00 + n01 + n10 + n11)
    alone = xlogy(n00 + n10, 1 - p) + xlogy(n01 + n11, p)
    markov = xlogy(n00, 1 - p01) + xlogy(n01, p01) + xlogy(n10, 1 - p11) + xlogy(n11, p11)
    g = g.withColumn("kupiec_lr", kupiec).withColumn("independence_lr", F.greatest(F.lit(0.0), -2 * (alone - markov)))
    g = g.withColumn("joint_lr", F.col("kupiec_lr") + F.col("independence_lr"))
    return g.select(*keys, "n", "exceptions", "kupiec_lr", chi2_1_sf("kupiec_lr").alias("kupiec_p"), "independence_lr", chi2_1_sf("independence_lr").alias("independence_p"), "joint_lr", chi2_even_sf(F.col("joint_lr"), 2).alias("joint_p"))


def wilson(rate: Column, n: Column, alpha: float) -> tuple[Column, Column]:
    """Wilson bounds of a proportion at two-sided level ``alpha``."""
    z = normal_quantile(1 - alpha / 2)
    middle = (rate + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(rate * (1 - rate) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return middle - half, middle + half
