"""The cost projection on written-out records."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cordage.operators import costs
from cordage.operators.costs import Scenario
from cordage.sources.schema import RECORD

FIELDS = "school_name string, tuition_by_grade array<struct<grade_level:string,annual_thb:bigint,semester_thb:bigint,notes:string>>, hidden_costs array<struct<name:string,amount_thb:bigint,notes:string>>, tuition_min_thb bigint, tuition_max_thb bigint"
GRADES = [("K1", 500000, None, None), ("K2", 0, 260000, None), ("", None, None, None)]
COSTS = [
    ("Application Fee", 4000, None), ("Entrance Fee", 250000, "once"), ("Entrance Fee (Second and Subsequent Children)", 200000, None), ("Boarding Deposit", 9, None), ("Campus Deposit", 50000, None),
    ("Lunch", 10000, "per term"), ("Bus", 20000, "per semester, or per term"), ("Kit", 7000, "one-time"), ("Trips", None, "per year"), ("Sibling rebate", 5, None), (None, 3, None),
]


def projected(spark, rows, *scenarios):
    return costs.project(spark.createDataFrame(rows, FIELDS), list(scenarios))


def test_totals(spark):
    rows = projected(spark, [("Plain", GRADES, COSTS, None, None)], Scenario(0, 6), Scenario(0, 6, None), Scenario(1, 99, (), "second_child", 10))
    a, b, c = sorted(costs.cost_summary(rows).collect(), key=lambda r: r.scenario)
    # years: 500000, 520000, then the last tier, which has no amount and counts 500000
    assert (a.one_time_thb, a.tuition_thb, a.journey_thb, a.year1_thb) == (304000, 3020000, 3324000, 804000)
    assert (a.average_thb, a.month_thb, a.addons_thb, a.discount_thb) == (554000, 46167, 0, 0)
    assert (b.one_time_thb, b.addons_thb, b.journey_thb) == (311000, 70000 * 6 + 7000, 3020000 + 70000 * 6 + 311000)
    assert c.one_time_thb == 254000 and c.tuition_thb == 520000 + 14 * 500000 and c.discount_thb == c.tuition_thb // 10


def test_line_items(spark):
    rows = costs.cost_line_items(projected(spark, [("Plain", GRADES, COSTS, None, None)], Scenario(0, 2, ("Lunch", "Kit"), "first_child", 5))).orderBy("place").collect()
    assert [r.category for r in rows] == [costs.ONE_TIME] * 3 + [costs.TUITION, costs.ADDON, costs.ADDON, costs.DISCOUNT]
    assert [(r.unit_thb, r.total_thb) for r in rows] == [(4000, 4000), (250000, 250000), (50000, 50000), (510000, 1020000), (30000, 60000), (7000, 7000), (25500, -51000)]
    assert rows[3].name == "Base Tuition (2 years)" and rows[3].notes == "K1 through to K2" and rows[1].notes == "once"


def test_fallback_tiers_and_missing_costs(spark):
    rows = projected(spark, [("None", [], None, None, None)], Scenario(0, 6), Scenario(-1, 0))
    a, b = sorted(costs.cost_summary(rows).collect(), key=lambda r: r.scenario)
    assert (a.tuition_thb, a.journey_thb, a.year1_thb, a.average_thb, a.month_thb) == (4155000, 4155000, 520000, 692500, 57708)
    assert b.tuition_thb == 520000
    assert costs.cost_schedule(rows).where("scenario = 0").orderBy("year").first().grade == "Early Years / Kindergarten"
    assert projected(spark, [], Scenario()).count() == 0


def test_deductions_and_cards(spark):
    cost = [("Admission", 225000, None), ("Second and subsequent child admission", None, None)]
    rows = spark.createDataFrame([("The HARROW House", GRADES, cost, None, None), ("Other", GRADES, cost, None, None), ("Harrow small", GRADES, [("Admission", 5, None)], None, None)], FIELDS)
    fees = {r.school_name: r.registration_thb for r in costs.mandatory_cards(rows, "alumni").collect()}
    assert fees == {"The HARROW House": 125000, "Other": 225000, "Harrow small": 0}
    assert {r.registration_thb for r in costs.mandatory_cards(rows.where("school_name = 'Other'"), "second_child").collect()} == {225000}
    # the projection does not fall through to the normal fee
    assert costs.cost_summary(costs.project(rows.where("school_name = 'Other'"), [Scenario(child="second_child")])).first().one_time_thb == 0


def test_no_python_and_no_shuffle(spark):
    plan = projected(spark, [("Plain", GRADES, COSTS, None, None)], Scenario())._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan and "Join" not in plan


def test_normalised_scenario():
    assert costs.normalised(Scenario(2, 15), 5).years == 3 and costs.normalised(Scenario(9, 4), 5).years == 1


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 10**6), st.one_of(st.none(), st.integers(0, 10**6))), max_size=5), st.integers(-2, 20), st.integers(0, 20), st.integers(0, 100))
def test_schedule_adds_up(spark, amounts, start, years, percent):
    grades = [(f"G{i}", a, s, None) for i, (a, s) in enumerate(amounts)]
    rows = projected(spark, [("x", grades, COSTS, None, None)], Scenario(start, years, None, "first_child", percent))
    total = rows.selectExpr("totals.journey_thb = aggregate(schedule, 0L, (s, x) -> s + x.total_thb) AS same", "size(schedule) AS n").first()
    assert total.same and total.n == max(1, min(years or 1, 15))


def test_record_schema_is_readable(spark):
    assert spark.createDataFrame([], RECORD).columns[0] == "school_name"


def test_rows_of_years_are_the_schedule(spark):
    grades = [("", None, 7, None), ("G", 0, None, None), (None, 11, 1, None)]
    rows = projected(spark, [("Plain", grades, COSTS, None, None), ("Bare", None, None, 5, None)], Scenario(1, 15, None, "second_child", 15), Scenario(0, 2), Scenario(7, 1, ("Bus",), "alumni", 0))
    made = costs.cost_schedule(rows).collect()
    want = rows.selectExpr("school_name", "scenario", "inline(schedule)").collect()
    assert len(made) == 2 * (15 + 2 + 1) and sorted(map(str, made)) == sorted(map(str, want))
    plan = costs.cost_schedule(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan and "discount_thb" not in plan.split("Generate")[-1]  # years are made by rows, not by structs in a lambda


def test_texts_of_costs_are_lowered_once(spark):
    plan = costs.cost_summary(projected(spark, [("Plain", GRADES, COSTS, None, None)], Scenario(), Scenario(1, 15, None)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") < 16


def test_line_items_make_no_schedule(spark):
    plan = costs.cost_line_items(projected(spark, [("Plain", GRADES, COSTS, None, None)], Scenario(1, 15, None)))._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan and plan.count("lower(") < 16
