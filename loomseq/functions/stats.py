"""Count likelihoods and local false-discovery algebra, all built-in expressions.

Counts are integers, so a difference of log gammas is a sum of logarithms.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_rising(a: Column, k: Column) -> Column:
    """ln(a (a+1) ... (a+k-1)); 0 for k <= 0."""
    steps = F.sequence(F.lit(0), F.greatest(k.cast("int") - 1, F.lit(0)))
    return F.when(k > 0, F.aggregate(steps, F.lit(0.0), lambda s, i: s + F.ln(a + i))).otherwise(0.0)


def log_choose(n: Column, k: Column) -> Column:
    return log_rising(n - k + 1, k) - log_rising(F.lit(1), k)


def beta_binomial(k: Column, n: Column, a: Column, b: Column) -> Column:
    """Log probability of k of n under a beta-binomial(a, b); null outside 0 <= k <= n."""
    p = log_choose(n, k) + log_rising(a, k) + log_rising(b, n - k) - log_rising(a + b, n)
    return F.when((k >= 0) & (k <= n), p)


def binomial(k: Column, n: Column, p: float) -> Column:
    """Log probability of k of n at rate p in (0, 1); null outside 0 <= k <= n."""
    return F.when((k >= 0) & (k <= n), log_choose(n, k) + k * F.ln(F.lit(p)) + (n - k) * F.ln(F.lit(1 - p)))


def low_fraction_factor(alt: Column, ref: Column) -> Column:
    """Log Bayes factor of a low but real fraction, beta-binomial(1, 9), over errors at 0.02."""
    n = alt + ref
    return beta_binomial(alt, n, F.lit(1.0), F.lit(9.0)) - binomial(alt, n, 0.02)


def genotype(alt: Column, ref: Column, error: Column, rho: Column, concordance: Column | None = None, min_quality: int = 20) -> Column:
    """Struct gt, gq, depth, fraction, passed from alternative and reference counts.

    Beta-binomial counts around the error, one half and one less the error, at
    intra-class correlation rho; priors 1/4, 1/2, 1/4. `concordance` (0.001 to
    1) discounts each alternative read for both variant states. Negative counts
    are 0; no reads give the null genotype; the reference state has quality 0.
    """
    alt, ref = F.greatest(alt, F.lit(0)), F.greatest(ref, F.lit(0))
    n = alt + ref
    err = F.least(F.greatest(error, F.lit(1e-4)), F.lit(0.2))
    rho = F.least(F.greatest(rho, F.lit(0.0)), F.lit(0.99))
    kappa = F.when(rho <= 1e-9, 1e9).otherwise((1 - rho) / F.greatest(rho, F.lit(1e-9)))

    def state(mu: Column, prior: float) -> Column:
        return beta_binomial(alt, n, F.greatest(mu * kappa, F.lit(1e-6)), F.greatest((1 - mu) * kappa, F.lit(1e-6))) + F.ln(F.lit(prior))

    fit = F.lit(0.0) if concordance is None else F.when(alt > 0, alt * F.ln(F.least(F.greatest(concordance, F.lit(1e-3)), F.lit(1.0)))).otherwise(0.0)
    every = F.array(state(err, 0.25), state(F.lit(0.5), 0.5) + fit, state(1 - err, 0.25) + fit)

    def decide(x: Column) -> Column:
        top = F.array_max(x)
        odds = F.transform(x, lambda v: F.exp(v - top))
        mass = odds[0] + odds[1] + odds[2]
        wrong = F.greatest((mass - 1) / mass, F.lit(1e-10))
        het = x[1] >= x[2]
        plain = F.greatest(x[1], x[2]) <= x[0]
        gq = F.when(plain, 0).otherwise(F.least(F.greatest(F.round(-10 * F.log10(wrong)), F.lit(0.0)), F.lit(99.0))).cast("int")
        gt = F.when(plain, "0/0").when(het, "0/1").otherwise("1/1")
        return F.struct(gt.alias("gt"), gq.alias("gq"), n.alias("depth"), (alt / n).alias("fraction"), (~plain & (gq >= min_quality)).alias("passed"))

    # One transform over a single element, so that the states are computed once.
    return F.when(n > 0, F.transform(F.array(every), decide)[0])


def add_local_fdr(a: Column, b: Column) -> Column:
    """The local fdr of two independent pieces of evidence: their log odds added, saturating at 60."""
    odds = lambda x: F.ln(F.greatest(x, F.lit(1e-12)) / F.greatest(1 - x, F.lit(1e-12)))
    s = F.least(F.greatest(odds(a) + odds(b), F.lit(-60.0)), F.lit(60.0))
    return 1 / (1 + F.exp(-s))
