"""Column functions over numbers: rates, bounds, weights and scores."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the rungs of the causal ladder.
CAUSAL_WEIGHTS = {"perturbation_in_human": 1.0, "perturbation_in_animal": 0.85, "perturbation_in_vitro": 0.80, "knowledge_base": 0.90, "correlation_in_human": 0.80, "human_genetics": 0.75, "association": 0.50}
# Predicates whose edges state a mechanism.
MECHANISM_PREDICATES = ("TREATS", "TARGETS", "INHIBITS", "ACTIVATES", "PARTICIPATES_IN", "EXPRESSED_IN")
Z_95, Z_POWER_80 = 1.959964, 0.841621


def jeffreys_rate(responders: Column, n: Column) -> Column:
    """(r + 0.5) / (n + 1): never exactly 0 or 1."""
    return F.when(n > 0, (responders + 0.5) / (n + 1.0))


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def expit(x: Column) -> Column:
    """The logistic function; large values do not overflow."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def bounds(responders: Column, analysed: Column, group: Column) -> Column:
    """Range of a rate over a whole group of which only some were counted.

    (reported, floor, ceiling, width, identified), null where the record supports no bounds.
    """
    sound = responders.isNotNull() & (analysed > 0) & (group > 0) & (responders >= 0) & (responders <= analysed) & (group >= analysed)
    missing = group - analysed
    low, high = 100.0 * responders / group, 100.0 * (responders + missing) / group
    return F.when(sound, F.struct((100.0 * responders / analysed).alias("reported"), low.alias("floor"), high.alias("ceiling"), (high - low).alias("width"), (missing == 0).alias("identified")))


def covers(bound: Column, percent: Column) -> Column:
    return (bound["floor"] <= percent) & (percent <= bound["ceiling"])


def edge_weight(claim: Column, level: Column, confidence: Column, predicate: Column) -> Column:
    """Weight of an edge by claim, causal rung, predicate and confidence."""
    observed = F.upper(F.coalesce(claim, F.lit("ASSERTED"))) == "OBSERVED"
    table = F.create_map(*[F.lit(x) for pair in CAUSAL_WEIGHTS.items() for x in pair])
    p = F.coalesce(predicate, F.lit(""))
    mechanism = F.when(observed, F.when(p.isin("TREATS", "INHIBITS", "ACTIVATES"), 1.0).otherwise(0.90)).otherwise(F.greatest(F.lit(0.65), confidence * 0.90))
    return (
        F.when(p == "CHANGES", F.lit(0.20))
        .when(p.isin(*MECHANISM_PREDICATES), mechanism)
        .when(observed, F.coalesce(F.try_element_at(table, level), F.greatest(F.lit(0.65), confidence)))
        .otherwise(F.greatest(F.lit(0.20), confidence * 0.50))
    )


def daily_dose(value: Column, frequency: Column) -> Column:
    return value * F.when(frequency == "BID", 2.0).otherwise(1.0)


def binomial_loglik(r: Column, n: Column, p: Column, eps: float = 1e-12) -> Column:
    """Log-likelihood without its constant; 0 log 0 is 0."""
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.when(r > 0, r * F.log(q)).otherwise(0.0) + F.when(n > r, (n - r) * F.log1p(-q)).otherwise(0.0)


def lgamma(x: Column) -> Column:
    """ln Gamma for x >= 1/2, by the Stirling series after eight steps up; error under 1e-13."""
    up = sum((F.log(x + k) for k in range(1, 8)), F.log(x))
    z = x + 8.0
    series = 1 / (12 * z) - 1 / (360 * F.pow(z, 3)) + 1 / (1260 * F.pow(z, 5)) - 1 / (1680 * F.pow(z, 7))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - up


def binomial_log_pmf(r: Column, n: Column, p: Column) -> Column:
    return lgamma(n + 1.0) - lgamma(r + 1.0) - lgamma(n - r + 1.0) + binomial_loglik(r, n, p)


def hr_log_score(hr: Column, low: Column, high: Column, mean: Column, sd: Column) -> Column:
    """Log score of a hazard ratio under a normal forecast of its logarithm."""
    se = (F.log(high) - F.log(low)) / (2 * Z_95)
    var = sd * sd + se * se
    return -0.5 * (F.log(2 * math.pi * var) + F.pow(F.log(hr) - mean, F.lit(2)) / var)


def trial_size(stop_loss: Column, hazard_ratio: Column, dropout: float = 0.15) -> Column:
    """(maintain_loss, events, patients) of a two-arm maintenance trial with 80% power."""
    events = 4 * (Z_95 + Z_POWER_80) ** 2 / F.pow(F.log(hazard_ratio), F.lit(2))
    maintain = 1 - F.pow(1 - stop_loss, hazard_ratio)
    patients = events / ((stop_loss + maintain) / 2) / (1 - dropout)
    return F.struct(maintain.alias("maintain_loss"), F.ceil(events).alias("events"), F.ceil(patients).alias("patients"), F.ceil(patients / 2).alias("per_arm"))


def log_mean_exp(values: Column) -> Column:
    """Of an array: peak + log of the mean of the rest."""
    peak = F.array_max(values)
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + F.exp(x - peak))
    return peak + F.log(total / F.size(values))


def exact_mean(name: str) -> Column:
    """Mean of a column of doubles that does not depend on the order of its rows, so that equal means are equal.

    It sums decimals of 18 places; a group with a value that such a decimal does not hold is summed as doubles.
    """
    x = F.col(name)
    exact = x.try_cast("decimal(28,18)")
    return F.when(F.count_if(exact.cast("double") == x) == F.count(x), F.try_avg(exact).cast("double")).otherwise(F.avg(x))
