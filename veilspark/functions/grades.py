"""Grade and source orders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRADES = ("C", "S", "O")


def grade_rank(grade: Column) -> Column:
    """C 3 > S 2 > O 1; anything else 0."""
    g = F.upper(F.coalesce(grade, F.lit("")))
    return F.when(g == "C", 3).when(g == "S", 2).when(g == "O", 1).otherwise(0)


def grade_of_rank(rank: Column) -> Column:
    return F.when(rank == 3, "C").when(rank == 2, "S").when(rank == 1, "O")


def source_rank(source: Column) -> Column:
    """regex 1 < ner 2 < ai 3 < unknown 99; the smaller one wins."""
    s = F.lower(F.coalesce(source, F.lit("")))
    return F.when(s == "regex", 1).when(s == "ner", 2).when(s == "ai", 3).otherwise(99)


def top_grade(grade: Column) -> Column:
    """Aggregate: highest grade, null when there is none."""
    return grade_of_rank(F.max(F.when(grade_rank(grade) > 0, grade_rank(grade))))


def document_grade(grade: Column) -> Column:
    """Aggregate: highest grade, ``O`` when nothing was found."""
    return F.coalesce(top_grade(grade), F.lit("O"))


def top_grade_in(grades: Column) -> Column:
    """Highest of an array of grades; only exact C/S/O count."""
    return (
        F.when(F.array_contains(grades, "C"), "C")
        .when(F.array_contains(grades, "S"), "S")
        .when(F.array_contains(grades, "O"), "O")
    )
