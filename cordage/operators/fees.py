"""Fee rows, safety texts and dates of merged records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.values import count_of, filled, first_filled, is_yes

CONTACT = "Contact school"
# Texts for a confirmed and an unconfirmed measure.
SAFETY = {
    "security_guards": ("24/7 Professional Security Guards Stationed & Patrol", "Standard Campus Security"),
    "cctv_monitoring": ("Full CCTV Monitoring & Perimeter Surveillance", "Campus Security System"),
    "nurse_medical_clinic": ("Certified School Nurse & Medical Clinic On-site", "First-Aid Station"),
    "child_safeguarding_policy": ("Comprehensive Child Protection & Safeguarding Policy Verified", "School Safety Code of Conduct"),
    "air_quality_pm25_protocol": ("Automated PM2.5 Clean-Air Positive Pressure System", "Indoor Air Quality Monitored"),
    "visitor_access_control": ("Strict Gated Entry & Visitor RFID Badge Verification", "Controlled Campus Entry"),
}
DRILL = "Termly evacuation, fire safety, and emergency response drills"
SUMMARY = "Comprehensive campus safety protocols and child safeguarding standards."


def _baht(amount: Column) -> Column:
    return F.concat(F.lit("฿"), F.format_number(amount.cast("bigint"), 0))


def fee_rows(grades: Column, costs: Column) -> Column:
    """``array<struct<label, amount>>``: a row for each named grade, then for each named cost.

    A grade shows its annual amount, else twice the half-year's; 0 counts as
    absent. Nothing to show gives the contact text.
    """
    nothing = F.array().cast("array<struct<label:string,amount:string>>")

    def grade(g: Column) -> Column:
        year = F.coalesce(filled(g["annual_thb"], 0), filled(g["semester_thb"], 0) * 2)
        return F.struct(F.concat(F.lit("Tuition ("), g["grade_level"], F.lit(")")).alias("label"), F.coalesce(F.concat(_baht(year), F.lit(" / yr")), F.lit(CONTACT)).alias("amount"))

    def cost(c: Column) -> Column:
        note = F.coalesce(F.concat(F.lit(" ("), filled(c["notes"]), F.lit(")")), F.lit(""))
        return F.struct(F.concat(c["name"], note).alias("label"), F.coalesce(_baht(filled(c["amount_thb"], 0)), F.lit(CONTACT)).alias("amount"))

    named = lambda items, field: F.filter(items, lambda x: x[field] != "")
    return F.concat(F.coalesce(F.transform(named(grades, "grade_level"), grade), nothing), F.coalesce(F.transform(named(costs, "name"), cost), nothing))


def replaced_if_any(new: Column, old: Column) -> Column:
    """``new`` if it has elements, else ``old``."""
    return F.when(count_of(new) > 0, new).otherwise(old)


def measure_text(flag: Column, name: str) -> Column:
    """Text of a safety measure; false and null give the plain one."""
    yes, no = SAFETY[name]
    return F.when(is_yes(flag), F.lit(yes)).otherwise(F.lit(no))


def safety_texts(safety: Column, old_summary: Column, old_highlights: Column, old_url: Column, page: Column) -> Column:
    """A struct of display texts from a safety struct, with what was there before as the next choice."""
    return F.struct(
        *(measure_text(safety[k], k).alias(k) for k in SAFETY),
        F.lit(DRILL).alias("emergency_drill"),
        F.coalesce(first_filled(safety["policy_summary"], old_summary), F.lit(SUMMARY)).alias("summary"),
        F.coalesce(F.when(count_of(safety["highlights"]) > 0, safety["highlights"]), old_highlights, F.array().cast("array<string>")).alias("highlights"),
        F.coalesce(first_filled(safety["policy_url"], old_url), page).alias("policy_url"),
    )


def policy_url(known: Column, pdfs: Column, page: Column) -> Column:
    """The known address, else the first document, else the page."""
    return F.coalesce(filled(known), F.get(pdfs, F.lit(0)), page)
