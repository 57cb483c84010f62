"""What the label of a result group says: a table of rules over columns, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words of a result group's label.
CONTROL_WORDS = ("placebo", "vehicle")
PERIOD_WORDS = ("period", "cohort")
FREQUENCY_WORDS = {"BID": ("bid", "twice daily"), "QD": ("qd", "once daily")}
ROUTE_WORDS = {
    "topical": ("cream", "ointment", "gel", "topical", "solution", "foam", "lotion"),
    "oral": ("tablet", "tablets", "capsule", "capsules", "oral"),
}
LIGHT_WORDS = ("nb-uvb", "nbuvb", "narrow band", "narrow-band", "narrowband", "phototherapy", "excimer", "uvb", "puva")
DOSE_UNITS = ("mg", "%")

NUMBER = r"[0-9]+(?:\.[0-9]+)?"
DOSE = f"({NUMBER}) ?({'|'.join(DOSE_UNITS)})"
LOADING = rf"({NUMBER})\s*mg\s*-\s*({NUMBER})\s*mg"
STEP_MARK = r"\bto\b|\bthen\b|:"


def any_word(words: tuple[str, ...]) -> str:
    """A pattern for any of the words, standing alone in lower-case text."""
    return "(?<![a-z0-9])(?:" + "|".join(words) + ")(?![a-z0-9])"


def first_named(text: Column, table: dict[str, tuple[str, ...]]) -> Column:
    """The first name of a table that one of its words stands for, null if none does."""
    return F.coalesce(*[F.when(text.rlike(any_word(words)), F.lit(name)) for name, words in table.items()])


def doses(text: Column) -> Column:
    """The distinct doses of a text, sorted: (value, unit)."""
    each = F.transform(F.regexp_extract_all(text, F.lit(DOSE), F.lit(0)), lambda d: F.struct(F.regexp_extract(d, DOSE, 1).cast("double").alias("value"), F.regexp_extract(d, DOSE, 2).alias("unit")))
    return F.array_sort(F.array_distinct(each))


def arm(label: Column, agents: Column, trial_agents: Column, trial_routes: Column) -> Column:
    """(period, role, agent, dose_value, dose_unit, loading_dose_value, frequency, route, phototherapy, flags).

    agents are the catalogue names that the label mentions, in catalogue order.  A flag says
    what was inferred, and why a value is left out.
    """
    whole = F.trim(label)
    head = rf"(?i)^([^:]*\b(?:{'|'.join(PERIOD_WORDS)})\b[^:]*):\s*(?=\S)"
    body = F.lower(F.regexp_replace(whole, head, ""))
    steps = F.filter(F.split(body, STEP_MARK), lambda p: p.rlike(r"[^\s,]"))
    given, many = doses(body), F.size(steps) > 1
    loading, control, named = body.rlike(LOADING), body.rlike(any_word(CONTROL_WORDS)), F.size(agents) > 0
    regimens = F.array_distinct(F.transform(steps, lambda p: F.struct(doses(p).alias("d"), first_named(p, FREQUENCY_WORDS).alias("f"))))
    steady = many & ~control & (F.size(regimens) == 1)  # the same regimen in every step
    changes = (many | ((F.size(given) > 1) & ~loading) | (control & named)) & ~steady
    active = ~changes & (~control | steady)
    role = F.when(changes, "sequence").when(active, "active").otherwise("placebo")
    treated, alone = changes | active, F.size(trial_agents) == 1
    own_route, one_route = first_named(body, ROUTE_WORDS), F.size(trial_routes) == 1
    stepped, single = active & loading, active & ~loading & (F.size(given) == 1)
    flags = {
        "treatment_changes_within_arm": changes,
        "agent_inferred_from_trial": treated & ~named & alone,
        "multiple_agents_in_arm": treated & (F.size(agents) > 1),
        "loading_dose_regimen": stepped,
        "route_inferred_from_trial": treated & own_route.isNull() & one_route,
    }
    amount = lambda i: F.regexp_extract(body, LOADING, i).cast("double")
    parsed = F.struct(
        F.when(whole.rlike(head), F.trim(F.regexp_extract(whole, head, 1))).alias("period"),
        role.alias("role"),
        F.when(treated, F.when(named, F.get(agents, F.lit(0))).when(alone, F.get(trial_agents, F.lit(0)))).alias("agent"),
        F.when(stepped, amount(2)).when(single, F.get(given, F.lit(0))["value"]).alias("dose_value"),
        F.when(stepped, F.lit("mg")).when(single, F.get(given, F.lit(0))["unit"]).alias("dose_unit"),
        F.when(stepped, amount(1)).alias("loading_dose_value"),
        first_named(body, FREQUENCY_WORDS).alias("frequency"),
        F.when(treated, F.coalesce(own_route, F.when(one_route, F.get(trial_routes, F.lit(0))))).alias("route"),
        body.rlike(any_word(LIGHT_WORDS)).alias("phototherapy"),
        F.array_compact(F.array(*[F.when(holds, F.lit(name)) for name, holds in flags.items()])).alias("flags"),
    )
    return F.when(label.isNotNull(), parsed)
