"""Ordered validation rules whose messages accumulate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import count_of, is_yes, stripped

# Curricula that say nothing.
UNCLEAR = ("unclear", "none", "unknown")


def _said(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit("None"))


def _negative(amount: Column, *text: Column | str) -> Column:
    return F.when(amount < 0, F.concat(*(F.lit(t) if isinstance(t, str) else t for t in text), F.lit(" cannot be negative: "), amount.cast("string")))


def errors(curriculum: Column, found: Column, grades: Column, low: Column, high: Column, costs: Column, confidence: Column) -> Column:
    """All messages of a record in rule order; an empty array means that it is valid.

    ``confidence`` is text or a number. Null amounts are not negative. Rules on
    tuition hold only where it was found.
    """
    lacks = F.coalesce(curriculum, F.lit("")) == ""
    first = F.when(lacks, F.lit("Curriculum information is missing.")).when(
        F.lower(stripped(curriculum)).isin(*UNCLEAR), F.concat(F.lit("Curriculum type is unclear or unknown ('"), curriculum, F.lit("')."))
    )

    def grade(g: Column, i: Column) -> Column:
        level = _said(g["grade_level"])
        return F.array(
            F.when(F.coalesce(g["grade_level"], F.lit("")) == "", F.concat(F.lit("Grade breakdown item at index "), i.cast("string"), F.lit(" is missing 'grade_level'."))),
            _negative(g["annual_thb"], "Annual tuition for '", level, "'"),
            _negative(g["semester_thb"], "Semester tuition for '", level, "'"),
        )

    def cost(c: Column, i: Column) -> Column:
        return F.array(
            F.when(F.coalesce(c["name"], F.lit("")) == "", F.concat(F.lit("Hidden cost item at index "), i.cast("string"), F.lit(" is missing a name."))),
            _negative(c["amount_thb"], "Hidden cost amount for '", _said(c["name"]), "'"),
        )

    none = F.array().cast("array<string>")
    empty = F.array(F.lit("Tuition was marked as found, but the grade breakdown table is empty."))
    listed = F.when(count_of(grades) > 0, F.flatten(F.transform(grades, grade))).otherwise(empty)
    tuition = F.when(is_yes(found), F.concat(listed, F.array(_negative(low, "Minimum tuition"), _negative(high, "Maximum tuition")))).otherwise(none)
    number = confidence.cast("string").try_cast("double")
    last = F.when(confidence.isNotNull() & number.isNull(), F.concat(F.lit("Confidence score must be a number: "), confidence.cast("string"))).when(
        ~number.between(0.0, 1.0), F.concat(F.lit("Confidence score must be between 0.0 and 1.0: "), confidence.cast("string"))
    )
    return F.array_compact(F.concat(F.array(first), tuition, F.coalesce(F.flatten(F.transform(costs, cost)), none), F.array(last)))


def validated(records: DataFrame) -> DataFrame:
    """``records`` with ``errors`` and ``validation`` (``success`` or ``failed``)."""
    found = errors(*(F.col(c) for c in ("curriculum", "tuition_found", "tuition_by_grade", "tuition_min_thb", "tuition_max_thb", "hidden_costs", "confidence")))
    return records.withColumn("errors", found).withColumn("validation", F.when(F.size("errors") == 0, "success").otherwise("failed"))


# What a safety part of the wrong kind is told.
SAFETY_KINDS = ("'safety_and_security' must be a dictionary/object.", "'safety_and_security.highlights' must be a list.", "'safety_and_security.policy_summary' must be a string.")
#: Fields of a record that must be of a kind, where they are there.
LISTS, NUMBERS = ("tuition_by_grade", "hidden_costs"), ("tuition_min_thb", "tuition_max_thb")


def _at(record: Column, name: str, kind: str = "variant") -> Column:
    """A field of a variant, null if the field is not there or does not cast."""
    return F.try_variant_get(record, f"$.{name}", kind)


def _kind(value: Column) -> Column:
    """``OBJECT``, ``ARRAY``, ``STRING``, ``BIGINT``, ``VOID`` (a JSON null) and so on; null for a field that is not there."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def safety_errors(safety: Column) -> Column:
    """Messages on the kinds of a safety part (a variant): an object, its highlights a list, its summary a string, each if it is there; a JSON null is no list and no string."""
    highlights, summary = (_kind(_at(safety, name)) for name in ("highlights", "policy_summary"))
    return _safety_errors(_kind(safety), highlights, summary)


def _safety_errors(safety: Column, highlights: Column, summary: Column) -> Column:
    is_there = safety.isNotNull() & (safety != "VOID")
    inner = F.array(F.when(highlights != "ARRAY", SAFETY_KINDS[1]), F.when(summary != "STRING", SAFETY_KINDS[2]))
    return F.array_compact(F.when(~is_there, F.array().cast("array<string>")).when(safety != "OBJECT", F.array(F.lit(SAFETY_KINDS[0]))).otherwise(inner))


#: Fields of a record that its rules read.
FIELDS = ("curriculum", "tuition_found", "confidence", "safety_and_security", *LISTS, *NUMBERS)


def validated_untyped(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``errors``: all messages of the record that is a variant in ``column``, in rule order: kinds of fields, the rules of ``errors``, then those on safety.

    A field of another kind than its rule needs is told once and counts as absent for the rule; a list's items likewise, field by
    field. Numbers may be written with a fraction. A record that is no object is told so, and null (text that is no JSON) too.
    Fields, their kinds and lists are columns on the way, so each is read from the variant once, however many rules need it.
    """
    record, value, kind = F.col(column), (lambda n: F.col(f"__v_{n}")), (lambda n: F.col(f"__k_{n}"))
    steps = [{f"__v_{n}": _at(record, n) for n in FIELDS} | {"__k_": _kind(record)}]
    steps += [{f"__k_{n}": _kind(value(n)) for n in FIELDS} | {f"__v_safety_{n}": _at(value("safety_and_security"), n) for n in ("highlights", "policy_summary")}]

    number = lambda k: k.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")
    text = lambda x, name: F.when(_kind(_at(x, name)) == "STRING", _at(x, name, "string"))
    amount = lambda x, name: F.when(number(_kind(_at(x, name))), _at(x, name, "decimal(28,0)"))
    items = lambda name: F.when(kind(name) == "ARRAY", F.try_variant_get(value(name), "$", "array<variant>"))
    grades = F.transform(items("tuition_by_grade"), lambda g: F.struct(text(g, "grade_level").alias("grade_level"), amount(g, "annual_thb").alias("annual_thb"), amount(g, "semester_thb").alias("semester_thb")))
    costs = F.transform(items("hidden_costs"), lambda c: F.struct(text(c, "name").alias("name"), amount(c, "amount_thb").alias("amount_thb")))
    cast = lambda name, to: F.try_variant_get(value(name), "$", to)
    last = {"__grades": grades, "__costs": costs, "__curriculum": cast("curriculum", "string"), "__found": F.coalesce(cast("tuition_found", "boolean"), F.lit(False))}
    last |= {f"__{n}": F.when(number(kind(n)), cast(n, "decimal(28,0)")) for n in NUMBERS} | {"__confidence": F.when(~kind("confidence").isin("VOID"), cast("confidence", "string"))}
    steps += [last | {f"__k_safety_{n}": _kind(value(f"safety_{n}")) for n in ("highlights", "policy_summary")}]

    faults = [F.when(~kind(n).isin("ARRAY", "VOID"), f"'{n}' must be a list.") for n in LISTS]
    faults += [F.when(~number(kind(n)) & (kind(n) != "VOID"), f"'{n}' must be a number.") for n in NUMBERS]
    ruled = errors(*(F.col(f"__{n}") for n in ("curriculum", "found", "grades", *NUMBERS, "costs", "confidence")))
    of_object = F.concat(F.array_compact(F.array(*faults)), ruled, _safety_errors(kind("safety_and_security"), kind("safety_highlights"), kind("safety_policy_summary")))
    found = F.when(F.coalesce(kind("") == "OBJECT", F.lit(False)), of_object).otherwise(F.array(F.lit("Record is not a JSON object.")))
    made = rows
    for step in steps:
        made = made.withColumns(step)
    return made.withColumn("errors", found).drop(*(c for step in steps for c in step))


def validated_json(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``errors`` and ``validation`` of the untyped record whose JSON text is in ``column``. No text ends the read."""
    made = validated_untyped(rows.withColumn("__record", F.try_parse_json(column)), "__record").drop("__record")
    return made.withColumn("validation", F.when(F.size("errors") == 0, "success").otherwise("failed"))
