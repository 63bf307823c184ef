"""Rule trees as column expressions: the tree is read once on the driver, the rows are judged by Spark."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from cutline.functions.columns import all_of, any_of

#: The order of grades.
GRADES = {"F": 0, "S": 1, "C": 2, "B": 3, "A": 4}


def grade_rank(grade: Column) -> Column:
    """Rank of a grade; an unknown grade is an error."""
    ranks = F.create_map(*(F.lit(x) for kv in GRADES.items() for x in kv))
    rank = F.try_element_at(ranks, F.upper(grade))
    return F.when(rank.isNull(), F.raise_error(F.concat(F.lit("unknown grade: "), F.coalesce(grade, F.lit("null")))).cast("int")).otherwise(rank)


def _rank_of(rule: dict) -> int:
    grade = str(rule.get("min_grade", "S")).upper()
    if grade not in GRADES:
        raise ValueError(f"unknown grade: {grade!r}")
    return GRADES[grade]


Passing = Callable[[Sequence[str] | None, int], Column]


def _tree(rule: dict | str | None, stream: Column, passing: Passing) -> Column:
    """A rule as a condition; ``passing`` is how many of the named subjects, or of all, have a grade of some rank at least."""
    if rule is None:
        return F.lit(True)
    rule = json.loads(rule) if isinstance(rule, str) else rule
    kind = rule["type"]
    match kind:
        case "and":
            return all_of(*(_tree(c, stream, passing) for c in rule["conditions"]))
        case "or":
            return any_of(*(_tree(c, stream, passing) for c in rule["conditions"]))
        case "stream_is":
            return F.coalesce(stream.isin(*rule["streams"]), F.lit(False))
        case "subject_min_grade":
            return passing([rule["subject"]], _rank_of(rule)) >= 1
        case "one_of_min_grade":
            return passing(list(rule["subjects"]), _rank_of(rule)) >= 1
        case "count_from_list":
            return passing(list(rule["subjects"]), _rank_of(rule)) >= rule["count"]
        case "any_n_subjects":
            return passing(None, _rank_of(rule)) >= rule["count"]
    raise ValueError(f"unknown rule: {kind!r}")


def _passes(subject: Column, grade: Column, names: Sequence[str] | None, least: int) -> Column:
    good = grade_rank(grade) >= least
    return good if names is None else F.when(subject.isin(*names), good).otherwise(F.lit(False))


def compile_rule(rule: dict | str | None, subjects: Column, stream: Column) -> Column:
    """Boolean column of a rule over ``subjects`` (array of subject and grade) and a stream; no rule passes."""
    return _tree(rule, stream, lambda names, least: F.size(F.filter(subjects, lambda s: _passes(s["subject"], s["grade"], names, least))))


def counted_gate(key: Column, rules: dict[str, dict | str], subject: Column, grade: Column, stream: Column) -> tuple[list[Column], Column]:
    """What a table of one row for each subject is to count in its group by, and the rule of each key over these counts.

    Each different leaf is one conditional count, added up on each task before the shuffle; no array is made. Keys without
    a rule pass. Rows that have no subject at all are to count as zeros.
    """
    leaves: dict[tuple, str] = {}

    def passing(names: Sequence[str] | None, least: int) -> Column:
        return F.coalesce(F.col(leaves.setdefault((names and tuple(names), least), f"leaf_{len(leaves)}")), F.lit(0))

    gate = F.lit(True)
    for name, rule in rules.items():
        gate = F.when(key == name, _tree(rule, stream, passing)).otherwise(gate)
    return [F.count_if(_passes(subject, grade, names, least)).alias(leaf) for (names, least), leaf in leaves.items()], gate


def rule_gate(key: Column, rules: dict[str, dict | str], subjects: Column, stream: Column) -> Column:
    """The rule of each row's key; keys without one pass. For many rules, split the rows by key and union."""
    out = None
    for name, rule in rules.items():
        judged = compile_rule(rule, subjects, stream)
        out = F.when(key == name, judged) if out is None else out.when(key == name, judged)
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def input_problem(z: Column, place: Column, stream: Column, period: Column, subjects: Column) -> Column:
    """What is wrong with a request, the first of all that is, or null: z in -2 to 4, codes, a period from 2000 to 2100 or none, and
    exactly three subjects of 1 to 100 characters with a grade of one letter that is known, whatever its case."""
    blank = lambda c: c.isNull() | (F.length(c) < 1)
    named = lambda s: ~blank(s["subject"]) & (F.length(s["subject"]) <= 100)
    graded = lambda s: (F.length(s["grade"]) == 1) & F.upper(s["grade"]).isin(*GRADES)
    every = lambda test: F.coalesce(F.forall(subjects, lambda s: F.coalesce(test(s), F.lit(False))), F.lit(False))
    return (
        F.when(z.isNull() | F.isnan(z.cast("double")) | ~z.between(-2, 4), "z out of range")
        .when(blank(place), "no place")
        .when(blank(stream), "no stream")
        .when(period.isNotNull() & ~period.between(2000, 2100), "period out of range")
        .when(subjects.isNull() | (F.size(subjects) != 3), "not three subjects")
        .when(~every(named), "subject without a name")
        .when(~every(graded), "unknown grade")
    )


@dataclass(frozen=True)
class Baskets:
    """Names by basket for ``basket_rule``; areas hold names of which one may be taken."""

    core: tuple[str, ...]
    belief: tuple[str, ...]
    pairs: tuple[tuple[str, str], ...]
    arts: tuple[tuple[str, ...], ...]
    national: tuple[str, ...]
    classical: tuple[str, ...]
    foreign: tuple[str, ...]
    chosen: int = field(default=3)


def basket_rule(subjects: Column, b: Baskets, least: str = "S") -> Column:
    """Whether the passed subjects obey the caps of their baskets; unknown grades count as failed here."""
    ranks = F.create_map(*(F.lit(x) for kv in GRADES.items() for x in kv))
    passed = F.filter(subjects, lambda s: F.coalesce(F.try_element_at(ranks, F.upper(s["grade"])), F.lit(-1)) >= GRADES[least])
    names = F.transform(passed, lambda s: s["subject"])

    def n(wanted: tuple[str, ...]) -> Column:
        return F.size(F.array_intersect(names, F.array(*map(F.lit, wanted)))) if wanted else F.lit(0)

    every_art = tuple(x for area in b.arts for x in area)
    national, classical, foreign = n(b.national), n(b.classical), n(b.foreign)
    languages, belief, arts = national + classical + foreign, n(b.belief), n(every_art)
    both = any_of(*(F.array_contains(names, x) & F.array_contains(names, y) for x, y in b.pairs))
    all_national = (national == 3) & (F.size(F.array_distinct(names)) == 3) & F.lit(len(b.national) == 3)
    mixed = (languages == 3) & (national >= 1) & (classical >= 1) & (foreign == 0)
    two_and_one = (languages == 2) & (belief + arts == 1)
    return all_of(
        F.size(names) == b.chosen,
        belief <= 2,
        ~both,
        arts <= 2,
        *(n(area) <= 1 for area in b.arts),
        ~((classical == 3) | (foreign == 3)),
        (languages <= 2) | all_national | mixed,
        (n(b.core) > 0) | all_national | mixed | two_and_one,
    )
