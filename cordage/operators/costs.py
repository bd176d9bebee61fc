"""Multi-year cost projection of any number of scenarios in one pass over the records.

A record carries its tiers and costs as arrays, whose order has meaning, so the
whole projection is a map: no shuffle, no window and no join. What a tier or a
cost is, by its texts, is found once for the record, before it meets scenarios.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import count_of, filled, first_match, half_up, has_any, holds_any, lowered, share_percent

TIER = "struct<grade_level:string,annual_thb:bigint,semester_thb:bigint,notes:string>"
COST = "struct<name:string,amount_thb:bigint,notes:string>"
# Amounts that stand in for absent ones.
LOW, HIGH, YEAR = 520000, 750000, 500000
MISSING_LOW, MISSING_HIGH = 500000, 800000
LONGEST = 15
# Words that tell kinds of costs.
MANDATORY = ("application", "entrance", "registration", "admission", "guaranteed place", "deposit")
ADMISSION = ("entrance", "registration", "admission", "guaranteed")
SIBLING = "second and subsequent"
RELATIVE_NAMES = (SIBLING, "sibling", "alumni")
RELATIVE_NOTES = ("alumni", "subsequent children")
ONCE = ("once only", "one-time", "one-off")
#: Deductions from the registration fee of one kind of child: words in the school's name, and the amount.
ALUMNI_RULES = (("harrow", 100000),)
# Names, categories and notes of line items.
ASK = "ติดต่อโรงเรียน (ไม่มีระบุในเอกสารทางการ)"
ONE_TIME, TUITION, ADDON, DISCOUNT = "One-Time Mandatory", "Annual Tuition", "Selected Campus Add-on", "Discount"
FEES = (
    ("Application & Assessment Fee (Mandatory)", "Mandatory to submit enrollment application"),
    ("Registration & Entrance Fee (Mandatory)", "Non-refundable one-time enrollment admission fee"),
    ("Refundable Campus Deposit (Mandatory)", "Refundable upon withdrawal per school policy"),
)


@dataclass(frozen=True)
class Scenario:
    """A what-if: first tier, years, names of add-ons (None: all of them), kind of child and percent off tuition."""

    start: int = 0
    years: int = 6
    addons: tuple[str, ...] | None = ()
    child: str = "first_child"
    percent: int = 0


def tiers(grades: Column, low: Column, high: Column) -> Column:
    """The given tiers, or three made from the least and the greatest amount; 0 counts as absent."""
    low, high = F.coalesce(filled(low, 0), F.lit(LOW)).cast("bigint"), F.coalesce(filled(high, 0), F.lit(HIGH)).cast("bigint")
    mid = half_up((low + high) / 2)
    made = lambda name, x, notes: F.struct(F.lit(name).alias("grade_level"), x.alias("annual_thb"), half_up(x / 2).alias("semester_thb"), F.lit(notes).alias("notes"))
    three = F.array(
        made("Early Years / Kindergarten", low, "Standard Early Years rate"),
        made("Primary (Years 1–6 / Grades 1–5)", mid, "Standard Primary rate"),
        made("Secondary & High School", high, "Standard High School / Diploma rate"),
    )
    return F.when(count_of(grades) > 0, grades.cast(f"array<{TIER}>")).otherwise(three.cast(f"array<{TIER}>"))


def yearly_times(name: Column, notes: Column, twice: tuple[str, ...] = ("semester",), thrice: tuple[str, ...] = ("term",), once: tuple[str, ...] = ONCE) -> Column:
    """How often a year a cost is due; 0 stands for once in all. The first rule that fits counts."""
    name, notes = lowered(name), lowered(notes)
    either = lambda words: holds_any(name, words) | holds_any(notes, words)
    return F.when(either(twice), 2).when(either(thrice), 3).when(holds_any(notes, once), 0).otherwise(1)


#: What a cost is by its lower-cased name: an application; a deposit, but for boarding; an admission of a first child, and of a second one.
KINDS = {
    "application": lambda name: holds_any(name, ("application",)),
    "deposit": lambda name: holds_any(name, ("deposit",)) & ~holds_any(name, ("boarding",)),
    "admission": lambda name: holds_any(name, ADMISSION) & ~holds_any(name, (SIBLING,)),
    "sibling": lambda name: holds_any(name, (SIBLING,)),
}


def with_first_costs(rows: DataFrame) -> DataFrame:
    """``rows``, which have ``costs``, with ``names`` and ``notes`` of these, lower-cased once, and the first cost of each of ``KINDS``."""
    rows = rows.withColumns({"names": F.transform("costs", lambda c: lowered(c["name"])), "notes": F.transform("costs", lambda c: lowered(c["notes"]))})
    place = lambda test: F.array_position(F.transform("names", test), F.lit(True)).cast("int")
    return rows.withColumns({kind: F.get("costs", place(test) - 1) for kind, test in KINDS.items()})


def is_addon(name: Column, notes: Column) -> Column:
    """Whether a cost of lower-cased texts is no admission fee and not for siblings or former pupils; one without a name is not."""
    relative = (name != "") & (holds_any(name, RELATIVE_NAMES) | holds_any(notes, RELATIVE_NOTES))
    return ~holds_any(name, MANDATORY) & ~relative


def deducted(fee: Column, name: Column, child: Column | str, rules: Iterable[tuple[str, int]] = ALUMNI_RULES, kind: str = "alumni") -> Column:
    """``fee`` less what the rules for the school's name deduct for this kind of child, not under 0; null stays null."""
    child = F.lit(child) if isinstance(child, str) else child
    out = fee
    for words, amount in rules:
        out = F.when((child == kind) & has_any(name, (words,)), F.greatest(F.lit(0).cast("bigint"), fee - amount)).otherwise(out)
    return F.when(fee.isNotNull(), out)


def mandatory_cards(records: DataFrame, child: str = "first_child") -> DataFrame:
    """``school_name`` and its three one-time fees, null where no amount is known.

    Unlike in the projection, a second child's fee without an amount falls
    through to the normal one.
    """
    rows, fee = with_first_costs(records.select("school_name", F.col("hidden_costs").alias("costs"))), F.col("admission.amount_thb")
    if child == "second_child":
        fee = F.coalesce(F.col("sibling.amount_thb"), fee)
    return rows.select(
        "school_name", F.col("application.amount_thb").alias("application_thb"),
        deducted(fee, F.col("school_name"), child).alias("registration_thb"), F.col("deposit.amount_thb").alias("deposit_thb"),
    )


def _scenario_rows(scenarios: list[Scenario]) -> Column:
    rows = []
    for i, s in enumerate(scenarios):
        names = F.lit(None).cast("array<string>") if s.addons is None else F.array(*map(F.lit, s.addons)).cast("array<string>")
        rows.append(F.struct(F.lit(i).alias("id"), F.lit(s.start).alias("start"), F.lit(max(1, min(s.years or 1, LONGEST))).alias("years"), names.alias("addons"), F.lit(s.child).alias("child"), F.lit(s.percent).alias("percent")))
    return F.array(*rows)


def _off(tuition: Column, percent: Column) -> Column:
    return half_up(tuition * (percent / 100))


def project(records: DataFrame, scenarios: list[Scenario]) -> DataFrame:
    """Each record under each scenario: ``school_name``, ``scenario``, ``schedule``, ``line_items`` and ``totals``, and of what ``cost_schedule`` makes rows: ``terms`` and ``years``.

    ``records`` has ``school_name``, ``tuition_by_grade``, ``hidden_costs``,
    ``tuition_min_thb`` and ``tuition_max_thb``. Null or empty tiers are made
    from the bounds, null costs are none, null add-on amounts count 0, and costs
    without a name are no add-ons. Years
    are cut to 1 to 15 and the first tier to those there are. A year takes its
    tier, or the last one. One-time add-ons are part of both the one-time and
    the add-on total, but of the journey's total once. Repeated rows stay.
    """
    bigint = lambda x: x.cast("bigint")
    amount = lambda c: F.coalesce(bigint(c["amount_thb"]), F.lit(0).cast("bigint"))
    item = lambda category, name, unit, total, once, notes: F.struct(F.lit(category).alias("category"), name.alias("name"), bigint(unit).alias("unit_thb"), bigint(total).alias("total_thb"), F.lit(once).alias("one_time"), notes.alias("notes"))
    total_of = lambda items, value: F.aggregate(items, F.lit(0).cast("bigint"), lambda s, x: s + bigint(value(x)))

    tuition = lambda t: F.coalesce(filled(t["annual_thb"], 0), filled(t["semester_thb"], 0) * 2, F.lit(YEAR)).cast("bigint")
    rows = records.select(
        "school_name",
        tiers(F.col("tuition_by_grade"), F.col("tuition_min_thb"), F.col("tuition_max_thb")).alias("tiers"),
        F.coalesce(F.col("hidden_costs").cast(f"array<{COST}>"), F.array().cast(f"array<{COST}>")).alias("costs"),
    )
    rows = with_first_costs(rows).withColumn("added", F.zip_with("names", "notes", is_addon))
    added = F.filter("costs", lambda c, i: c["name"].isNotNull() & F.get("added", i))
    rows = rows.select(
        "school_name", "tiers", F.transform("tiers", tuition).alias("prices"), F.transform("tiers", lambda t: filled(t["grade_level"])).alias("levels"), F.exists("tiers", lambda t: filled(t["grade_level"]).isNull()).alias("unnamed"),
        *KINDS, F.transform(added, lambda c: F.struct(c["name"].alias("name"), amount(c).alias("amount"), c["notes"].alias("notes"), yearly_times(c["name"], c["notes"]).alias("times"))).alias("extras"),
        _scenario_rows(scenarios).alias("all"),
    )
    rows = rows.select(*(c for c in rows.columns if c != "all"), F.explode("all").alias("s"))  # structs made beside a generator lose their names
    rows = rows.select(
        "school_name", "tiers", "prices", "levels", "unnamed", "s", "application", "deposit",
        F.when((F.col("s.child") == "second_child") & F.col("sibling").isNotNull(), F.col("sibling")).otherwise(F.col("admission")).alias("registration"),
        F.when(F.col("s.addons").isNull(), F.col("extras")).otherwise(F.filter("extras", lambda a: F.coalesce(F.array_contains("s.addons", a["name"]), F.lit(False)))).alias("addons"),
        F.least(F.greatest(F.col("s.start"), F.lit(0)), F.size("tiers") - 1).alias("first"),
    )
    rows = rows.withColumns(
        {
            "fees": F.array(
                amount(F.col("application")),
                F.coalesce(deducted(bigint(F.col("registration.amount_thb")), F.col("school_name"), F.col("s.child")), F.lit(0).cast("bigint")),
                amount(F.col("deposit")),
            ),
            "once_addons": total_of(F.filter("addons", lambda a: a["times"] == 0), lambda a: a["amount"]),
            "year_addons": total_of(F.col("addons"), lambda a: a["amount"] * a["times"]),
        }
    ).withColumn("once", total_of(F.col("fees"), lambda x: x) + F.col("once_addons"))

    # plain arrays by year, which are zipped at last: structs made in a lambda are slow
    years, nil = F.col("s.years"), F.lit(0).cast("bigint")
    of_years = lambda x: F.concat(F.slice(x, F.col("first") + 1, years), F.array_repeat(F.element_at(x, -1), F.greatest(F.lit(0), years - F.size(x) + F.col("first"))))
    rows = rows.withColumns({"tuition_thb": of_years(F.col("prices")), "grade": of_years(F.col("levels"))})
    percent, sliced = F.col("s.percent"), F.col("tuition_thb")
    rows = rows.withColumns(
        {
            "grade": F.when(F.col("unnamed"), F.transform("grade", lambda g, i: F.coalesce(g, F.concat(F.lit("Grade "), (i + 1).cast("string"))))).otherwise(F.col("grade")),
            "discount_thb": F.when(percent > 0, F.transform(sliced, lambda t: _off(t, percent))).otherwise(F.array_repeat(nil, years)),
        }
    )
    rows = rows.withColumns({"tuition": total_of(sliced, lambda x: x), "off": F.when(percent > 0, total_of(F.col("discount_thb"), lambda x: x)).otherwise(nil)})
    rows = rows.withColumns(
        {
            "year": F.sequence(F.lit(1), years),
            "one_time_thb": F.concat(F.array("once"), F.array_repeat(nil, years - 1)),
            "addons_thb": F.array_repeat("year_addons", years),
            "total_thb": F.transform(sliced, lambda t, i: t - F.get("discount_thb", i) + F.col("year_addons") + F.when(i == 0, F.col("once")).otherwise(nil)),
        }
    )
    schedule = F.arrays_zip("year", "grade", "tuition_thb", "one_time_thb", "addons_thb", "discount_thb", "total_thb")
    journey = F.col("tuition") - F.col("off") + F.col("year_addons") * years + F.col("once")
    average = half_up(journey / years)
    totals = F.struct(
        journey.alias("journey_thb"), (F.get("tuition_thb", F.lit(0)) - F.get("discount_thb", F.lit(0)) + F.col("year_addons") + F.col("once")).alias("year1_thb"), average.alias("average_thb"), half_up(average / 12).alias("month_thb"),
        F.col("once").alias("one_time_thb"), F.col("tuition").alias("tuition_thb"), (F.col("year_addons") * years + F.col("once_addons")).alias("addons_thb"), F.col("off").alias("discount_thb"),
    )

    def fee(i: int, found: Column) -> Column:
        name, notes = FEES[i]
        text = F.when(found["amount_thb"].isNotNull(), F.coalesce(filled(found["notes"]), F.lit(notes))).otherwise(F.lit(ASK))
        return item(ONE_TIME, F.lit(name), F.get("fees", F.lit(i)), F.get("fees", F.lit(i)), True, text)

    grade = lambda at, other: F.coalesce(F.get("tiers", at)["grade_level"], other)
    span = F.concat(grade(F.col("first"), F.lit("Grade 1")), F.lit(" through to "), grade(F.least(F.col("first") + years - 1, F.size("tiers") - 1), F.concat(F.lit("Grade "), years.cast("string"))))
    base = item(TUITION, F.concat(F.lit("Base Tuition ("), years.cast("string"), F.when(years > 1, F.lit(" years)")).otherwise(F.lit(" year)"))), half_up(F.col("tuition") / years), F.col("tuition"), False, span)

    def addon(a: Column) -> Column:
        often = F.when(a["times"] > 1, F.concat(a["times"].cast("string"), F.lit("x per year"))).otherwise(F.lit("per year"))
        once = a["times"] == 0
        unit = F.when(once, a["amount"]).otherwise(a["amount"] * a["times"])
        notes = F.coalesce(filled(a["notes"]), F.when(once, F.lit("One-time campus service")).otherwise(F.concat(F.lit("Annualized ("), often, F.lit(")"))))
        return F.struct(F.lit(ADDON).alias("category"), a["name"].alias("name"), bigint(unit).alias("unit_thb"), bigint(F.when(once, unit).otherwise(unit * years)).alias("total_thb"), once.alias("one_time"), notes.alias("notes"))

    discount = item(DISCOUNT, F.concat(F.lit("Simulated Family / Sibling Discount ("), F.col("s.percent").cast("string"), F.lit("%)")), half_up(F.col("off") / years), -F.col("off"), False, F.lit("Simulated tuition reduction"))
    fees = F.array(fee(0, F.col("application")), fee(1, F.col("registration")), fee(2, F.col("deposit")), base)
    items = F.concat(fees, F.transform("addons", addon), F.when(F.col("s.percent") > 0, F.array(discount)).otherwise(F.filter(F.array(discount), lambda x: F.lit(False))))
    return rows.select(
        "school_name", F.col("s.id").alias("scenario"), schedule.alias("schedule"), items.alias("line_items"), totals.alias("totals"),
        F.struct(percent.alias("percent"), F.col("once").alias("once"), F.col("year_addons").alias("year_addons")).alias("terms"), F.arrays_zip("grade", "tuition_thb").alias("years"),
    )


def cost_schedule(projected: DataFrame) -> DataFrame:
    """A row for each year."""
    # outer: there is always a year, and a plain explode would filter on their number, with the whole projection written out once more
    rows = projected.select("school_name", "scenario", "terms", F.posexplode_outer("years").alias("at", "y")).select("school_name", "scenario", "terms.*", "at", "y.*")
    nil = F.lit(0).cast("bigint")
    rows = rows.withColumns({"one_time_thb": F.when(F.col("at") == 0, F.col("once")).otherwise(nil), "discount_thb": F.when(F.col("percent") > 0, _off(F.col("tuition_thb"), F.col("percent"))).otherwise(nil)})
    total = F.col("tuition_thb") - F.col("discount_thb") + F.col("year_addons") + F.col("one_time_thb")
    return rows.select("school_name", "scenario", (F.col("at") + 1).alias("year"), "grade", "tuition_thb", "one_time_thb", F.col("year_addons").alias("addons_thb"), "discount_thb", total.alias("total_thb"))


def cost_line_items(projected: DataFrame) -> DataFrame:
    """A row for each line item with its place from 0."""
    # outer as in cost_schedule
    return projected.select("school_name", "scenario", F.posexplode_outer("line_items").alias("place", "i")).select("school_name", "scenario", "place", "i.*")


def cost_summary(projected: DataFrame) -> DataFrame:
    """A row of totals with the percent that tuition, one-time costs and add-ons have of the journey's total.

    The parts are gross and share one-time add-ons, so they can exceed 100.
    """
    rows = projected.select("school_name", "scenario", "totals.*")
    return rows.withColumns({f"{p}_percent": share_percent(F.col(f"{p}_thb"), F.col("journey_thb")) for p in ("tuition", "one_time", "addons")})


def normalised(scenario: Scenario, n_tiers: int) -> Scenario:
    """The scenario with its years cut to the tiers that are left from its start."""
    left = max(1, n_tiers - max(0, scenario.start))
    return Scenario(scenario.start, max(1, min(scenario.years, left)), scenario.addons, scenario.child, scenario.percent)
