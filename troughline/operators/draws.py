"""Random draws that give the same value for the same key, seed and attempt.

Draws are a function of the row's key, so they survive retries, repartitioning and lost
executors without being stored first.
"""

import math

import numpy as np
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.model import rounded
from ..sources.storage import stage

ATTEMPTS = 16  # attempts tried in the first pass; every further pass doubles them
MOST_ATTEMPTS = 4096  # attempts of one pass at most


def uniform(*key):
    """Uniform draw in (0, 1): the first 52 bits of the MD5 of the key expressions, joined by colons."""
    text = F.concat_ws(":", *[k.cast("string") for k in key])
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + 0.5) / float(2 ** 52)


def normal(*key):
    """Standard normal draw from the key expressions."""
    radius = F.sqrt(-2.0 * F.ln(uniform(*key, F.lit("radius"))))
    return radius * F.cos(2 * math.pi * uniform(*key, F.lit("angle")))


def with_etas(patients, seed):
    """Independent random effects per patient."""
    return patients.withColumns({
        f"ETA{i}": normal(F.col("ID"), F.lit(seed), F.lit(i)) * math.sqrt(omega)
        for i, omega in enumerate(C.OMEGA, start=1)})


def with_eps(events, seed):
    """Residual draws per event row."""
    keyed = events.withColumn("_us", F.col("time") * 1e6).withColumn("_us", F.expr(rounded("_us", 0)).cast("long"))
    keyed = keyed.withColumn("_key", F.concat_ws(":", "ID", "_us", F.lit(seed)))  # the text that all draws of a row begin with
    return keyed.withColumns({
        f"EPS{i}": normal(F.col("_key"), F.lit(i)) * math.sqrt(sigma)
        for i, sigma in enumerate(C.SIGMA, start=1)}).drop("_us", "_key")


def log_moments(mean, sd):
    """Mean and standard deviation of the logarithm of a lognormal variable."""
    return math.log(mean ** 2 / math.sqrt(sd ** 2 + mean ** 2)), math.sqrt(
        math.log(sd ** 2 / mean ** 2 + 1))


def truncated_normal(patients, mean, sd, bounds, seed, log=False, name="draw"):
    """Draw per row, repeated until it lies inside the closed bounds."""
    low, high = min(bounds), max(bounds)
    mu, sigma = log_moments(mean, sd) if log else (mean, sd)
    _check_bounds(mu, sigma, low, high, log)

    def draw(attempt):
        value = normal(F.col("ID"), F.lit(seed), attempt) * sigma + mu
        return F.struct((F.exp(value) if log else value).alias(name))

    return _until_inside(patients, draw, lambda d: d[name].between(low, high))


def truncated_mvn(patients, mean, sd, corr, lower, upper, seed, log=False, prefix="x"):
    """Correlated draws per row; all components are redrawn while any is out of bounds.

    The log form is ``exp(N(0, cov)) * mean`` with ``cov`` from the log-scale deviations.
    """
    size = len(mean)
    if not size == len(sd) == len(lower) == len(upper):
        raise ValueError("mean, sd, lower and upper must have the same length")
    corr = np.asarray(corr, dtype=float)
    if corr.shape != (size, size):
        raise ValueError("the correlation matrix must be square, one row per component")
    scale = np.array([log_moments(m, s)[1] for m, s in zip(mean, sd)] if log else sd, dtype=float)
    factor = np.linalg.cholesky(corr * np.outer(scale, scale))
    for i in range(size):
        _check_bounds(math.log(mean[i]) if log else mean[i], scale[i], lower[i], upper[i], log)

    def draw(attempt):
        z = [normal(F.col("ID"), F.lit(seed), attempt, F.lit(j)) for j in range(size)]
        fields = []
        for i in range(size):
            mixed = sum(z[j] * float(factor[i, j]) for j in range(i + 1))
            value = F.exp(mixed) * float(mean[i]) if log else mixed + float(mean[i])
            fields.append(value.alias(f"{prefix}{i + 1}"))
        return F.struct(*fields)

    def inside(d):
        test = F.lit(True)
        for i in range(size):
            test = test & d[f"{prefix}{i + 1}"].between(float(lower[i]), float(upper[i]))
        return test

    return _until_inside(patients, draw, inside)


def _check_bounds(mu, sigma, low, high, log):
    """An interval that no draw can fall into is an error; an unlikely one is only slow."""
    if log:
        low, high = (math.log(x) if x > 0 else -math.inf for x in (low, high))
    below = 0.5 * math.erfc((mu - low) / (sigma * math.sqrt(2)))
    upto = 0.5 * math.erfc((mu - high) / (sigma * math.sqrt(2)))
    above = 0.5 * math.erfc((low - mu) / (sigma * math.sqrt(2)))
    beyond = 0.5 * math.erfc((high - mu) / (sigma * math.sqrt(2)))
    if not low < high or not max(upto - below, above - beyond) > 0:
        raise ValueError("no draw can fall between the bounds")


def _until_inside(patients, draw, inside):
    """First draw per row that passes; rows without one go to the next pass, until none is left.

    No attempt is drawn after the one that passes.
    """
    kind = patients.select(draw(F.lit(1))).schema[0].dataType

    def first_hit(hit, attempt):
        tried = F.transform(F.array(draw(attempt)), lambda d: F.when(inside(d), d))
        return F.when(hit.isNotNull(), hit).otherwise(F.element_at(tried, 1))

    done, open_rows, first, count = None, patients, 0, ATTEMPTS
    while True:
        attempts = F.sequence(F.lit(first + 1), F.lit(first + count))
        hit = F.aggregate(attempts, F.lit(None).cast(kind), first_hit)
        tried = stage(open_rows.withColumn("_hit", hit), "draws")
        passed = tried.where("_hit is not null").select(*patients.columns, "_hit.*")
        done = passed if done is None else done.unionByName(passed)
        open_rows = tried.where("_hit is null").drop("_hit")
        if open_rows.isEmpty():
            return done
        first, count = first + count, min(2 * count, MOST_ATTEMPTS)
