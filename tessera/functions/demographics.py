"""Demographic groupings as column expressions over fixed vocabularies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

OTHER = "Other/Unknown"

# Source terms of each group.
HISPANIC_ETHNICITIES = (
    "Hispanic or Latino", "Dominican", "Mexican", "South American", "Central American", "Latin American", "Puerto Rican", "Nicaraguan", "Colombian", "Peruvian",
    "Mexicano", "Guatemalan", "Chilean", "Ecuadorian", "Spaniard", "Central American Indian", "Salvadoran", "Cuban", "Bolivian", "Honduran",
)
RACES = {
    "Black": ("African", "Black or African American", "Black", "African American", "Black, not of hispanic origin"),
    "Indigenous": ("Alaska Indian", "Alaska Native", "American Indian", "American Indian or Alaska Native", "Native Hawaiian", "Native Hawaiian or Other Pacific Islander", "Other Pacific Islander"),
    "Asian": ("Asian", "Asian Indian", "Cambodian", "Chinese", "Filipino", "Indian", "Indonesian", "Japanese", "Korean", "Laotian", "Malaysian", "Sri Lankan", "Taiwanese", "Thai", "Vietnamese", "Asian or Pacific islander"),
    "White": ("European", "White or Caucasian", "White", "Caucasian", "Caucasian, not of hispanic origin"),
    "Middle Eastern": ("Middle Eastern or North African", "Pakistani"),
    "Caribbean": ("Bahamian", "Jamaican", "Trinidadian"),
    "Hispanic": ("Hispanic", "Hispanic, white", "Hispanic, black"),
    "Mixed": ("Mixed racial group",),
}
# Patterns in the order in which they are tried.
RACE_PATTERNS = {"Black": "black|african", "White": "white|caucasian|european", "Asian": "asian|chinese|japanese|korean|vietnamese", "Hispanic": "hispanic|latino", "Indigenous": "native|indian|alaska"}
GENDER_PATTERNS = {"Male": "^male$|^m$", "Female": "^female$|^f$"}
MARITAL_PATTERNS = {"Married": "married|spouse", "Single": "single|never", "Divorced/Separated": "divorced|separated", "Widowed": "widowed"}
AGE_BOUNDS = (0, 18, 35, 50, 65, 80, 200)
AGE_LABELS = ("<18", "18-34", "35-49", "50-64", "65-79", "80+")


def by_terms(col: Column, groups: dict[str, Sequence[str]], other: str) -> Column:
    """The group whose terms hold the value exactly; one lookup in a literal map."""
    pairs = [F.lit(x) for group, terms in groups.items() for term in terms for x in (term, group)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.coalesce(col, F.lit(""))), F.lit(other))


def by_patterns(col: Column, patterns: dict[str, str], other: str = OTHER) -> Column:
    """The first group whose pattern is found in the value, in any case."""
    return F.coalesce(*(F.when(col.rlike(f"(?i){p}"), F.lit(g)) for g, p in patterns.items()), F.lit(other))


def ethnicity_group(col: Column) -> Column:
    return by_terms(col, {"Hispanic": HISPANIC_ETHNICITIES}, "Not Hispanic")


def race_group(col: Column) -> Column:
    return by_terms(col, RACES, OTHER)


def race_group_by_pattern(col: Column) -> Column:
    return by_patterns(col, RACE_PATTERNS)


def gender_group(col: Column) -> Column:
    return by_patterns(col, GENDER_PATTERNS)


def marital_group(col: Column) -> Column:
    return by_patterns(col, MARITAL_PATTERNS)


def age_group(col: Column, bounds: Sequence[float] = AGE_BOUNDS, labels: Sequence[str] = AGE_LABELS) -> Column:
    """Half-open groups [a, b); a value outside all of them, or null, is Unknown."""
    if len(labels) != len(bounds) - 1:
        raise ValueError(f"{len(bounds)} bounds need {len(bounds) - 1} labels, not {len(labels)}")
    return F.coalesce(*(F.when((col >= a) & (col < b), F.lit(t)) for a, b, t in zip(bounds, bounds[1:], labels)), F.lit("Unknown"))


def age_at(birth: Column, at: Column) -> Column:
    """Whole years, a year being 365.25 days."""
    return F.floor(F.datediff(at, birth) / F.lit(365.25)).cast("int")
