"""Filters, lookups, merge, validation, state, upsert, links and texts on written-out rows."""

import random
import time

import pytest
from pyspark.sql import functions as F

from cordage.functions import labels as show
from cordage.operators import pages as operators_pages
from cordage.operators import facets, fees, links, lookup, merge, state, texts, upsert, validate


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_facets(spark):
    df = spark.createDataFrame([(1, "British", 600000, 4.0), (2, "IB", 600001, 10.0), (3, None, None, None)], "id int, curriculum string, start long, km double")
    ids = lambda d: [r.id for r in d.orderBy("id").collect()]
    assert ids(facets.facet_filter(df)) == [1, 2, 3]
    assert ids(facets.facet_filter(df, {"curriculum": "All Curricula"}, ("start", 600), ("km", "Within 10 km"))) == [1, 3]
    assert ids(facets.facet_filter(df, {"curriculum": "IB"}, None, ("km", "Phuket"))) == [2]
    assert ids(facets.text_search(df, " ", ["curriculum"])) == [1, 2, 3] and ids(facets.text_search(df, "BRIT", ["curriculum"])) == [1] and ids(facets.text_search(df, " b", ["curriculum"])) == []
    assert ids(facets.category_filter(df, "curriculum", "All")) == [1, 2, 3] and ids(facets.status_gate(df, "curriculum", "IB")) == [2]


def test_lookups(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "id int")
    facts = spark.createDataFrame([(2, None), (0, "first")], "id int, v string")
    assert rows_of(lookup.lookup_or_default(df, facts, "id")) == rows_of(spark.createDataFrame([(1, "first"), (2, None), (None, "first")], "id int, v string"))
    assert lookup.lookup_or_default(df, facts.limit(0), "id").where("v is not null").count() == 0
    assert lookup.at_position(facts, ["id"], 2).first().id == 2 and lookup.at_position(facts, ["id"], 3).count() == 0 and lookup.at_position(facts, ["id"], 0).count() == 0


def by_force(records, seeds):
    out = {}
    for r, name in records:
        for s, seed in sorted(seeds):
            if name is not None and seed is not None and (name.lower() in seed.lower() or seed.lower() in name.lower()):
                out[r] = s
                break
    return out


@pytest.mark.parametrize("seed", range(4))
def test_containment_against_brute_force(spark, seed):
    rng = random.Random(seed)
    words = ["ab", "b-c", "School", "of", "INTER", "Bangkok", "x", "éa", ""]
    name = lambda: None if rng.random() < 0.05 else " ".join(rng.choice(words) for _ in range(rng.choice((0, 1, 2, 5, 9))))
    seeds = [(i, name()) for i in range(30)]
    records = []
    for i in range(60):
        s = rng.choice(seeds)[1]
        records.append((i, f"t{s} und ab" if s is not None and rng.random() < 0.4 else s[1:-1] if s and rng.random() < 0.5 else name()))
    if seed % 2:  # without empty names, which match everything
        seeds, records = [x for x in seeds if x[1] != ""], [x for x in records if x[1] != ""]
    found = merge.first_containment(spark.createDataFrame(records, "r long, name string"), spark.createDataFrame(seeds, "s long, name string"), "r", "name", "s", "name")
    assert {x.record: x.seed for x in found.collect()} == by_force(records, seeds)


@pytest.mark.parametrize("common", [1, 16, 10**6])
def test_containment_in_two_rounds(spark, common, monkeypatch):
    monkeypatch.setattr(merge.candidates, "__defaults__", (common,))
    rng = random.Random(common)
    seeds = [(i, rng.choice(["School#0000001", "green valley school", "Green", "x", "日本 学校", "école"]) + str(rng.randrange(9))) for i in range(40)]
    records = [(i, rng.choice(["", "the "]) + (rng.choice(seeds)[1] if rng.random() < 0.5 else rng.choice(["School#00000017", "valley", "本 学", "een valley school4"])) + rng.choice(["", "2", " of"])) for i in range(80)]
    found = merge.first_containment(spark.createDataFrame(records, "r long, name string"), spark.createDataFrame(seeds, "s long, name string"), "r", "name", "s", "name")
    assert {x.record: x.seed for x in found.collect()} == by_force(records, seeds)


def test_names_that_begin_alike_are_few_candidates(spark):
    names = [f"School#{i:09d}" for i in range(4000)] + [f"Bangkok International School Campus {i}" for i in range(2000)]
    rows = spark.createDataFrame(list(enumerate(n.lower() for n in names)), "pos long, name string")
    pairs = merge.candidates(rows, rows)
    true = 4000 + sum(1 for i in range(2000) for j in range(2000) if str(j).startswith(str(i)))
    assert true <= pairs.distinct().count() <= pairs.count() < true + 6000
    found = merge.first_containment(rows, rows, "pos", "name", "pos", "name")
    assert found.count() == 6000 and found.where("record <> seed and record < 4000").count() == 0


def test_merge(spark):
    catalogue = spark.createDataFrame([(1, "Alpha School", "IB", 5), (2, "Beta", "French", 6), (3, "Gamma", None, 7)], "id long, name string, curriculum string, start long")
    records = spark.createDataFrame([(1, "alpha", "British", 9), (2, "The Alpha School of X", "Unclear", None), (3, "beta", "", 0), (4, None, "US", 1)], "pos long, school string, curriculum string, low long")
    merged = merge.merge_records(catalogue, records, "id", "name", "pos", "school", {"curriculum": "curriculum"}, {"start": "low"})
    assert [(r.id, r.curriculum, r.start, r.matched_record) for r in merged.orderBy("id").collect()] == [(1, "British", 9, 2), (2, "French", 0, 3), (3, None, 7, None)]
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_fee_rows_and_safety(spark):
    df = spark.createDataFrame(
        [([("G1", 1000, None), ("G2", 0, 600), ("G3", None, None), ("", 5, 5), (None, 1, 1)], [("Bus", 1500, "yr"), ("Kit", 0, None), (None, 2, None)])],
        "g array<struct<grade_level:string,annual_thb:bigint,semester_thb:bigint>>, c array<struct<name:string,amount_thb:bigint,notes:string>>",
    )
    made = df.select(fees.fee_rows(F.col("g"), F.col("c")).alias("f")).first().f
    assert [tuple(x) for x in made] == [("Tuition (G1)", "฿1,000 / yr"), ("Tuition (G2)", "฿1,200 / yr"), ("Tuition (G3)", "Contact school"), ("Bus (yr)", "฿1,500"), ("Kit", "Contact school")]
    kind = "s struct<" + ",".join(f"{k}:boolean" for k in fees.SAFETY) + ",highlights:array<string>,policy_summary:string,policy_url:string>"
    safe = spark.createDataFrame([((True, False, None, True, True, True, [], "", None),)], kind)
    got = safe.select(fees.safety_texts(F.col("s"), F.lit(None).cast("string"), F.array(F.lit("old")), F.lit(""), F.lit("page")).alias("t")).first().t
    assert got.security_guards == fees.SAFETY["security_guards"][0] and got.nurse_medical_clinic == fees.SAFETY["nurse_medical_clinic"][1]
    assert (got.summary, got.highlights, got.policy_url) == (fees.SUMMARY, ["old"], "page")


def test_validation_order(spark):
    kind = "curriculum string, tuition_found boolean, tuition_by_grade array<struct<grade_level:string,annual_thb:bigint,semester_thb:bigint>>, tuition_min_thb bigint, tuition_max_thb bigint, hidden_costs array<struct<name:string,amount_thb:bigint>>, confidence string"
    df = spark.createDataFrame([(" Unclear ", True, [(None, -1, -2), ("A", 1, None)], -3, -4, [("", None), ("B", -5)], "1.01"), ("", True, [], None, None, None, "abc"), ("IB", False, None, -1, -1, [], "1.0"), ("IB", None, None, None, None, None, None)], kind)
    a, b, c, d = (r.errors for r in validate.validated(df).collect())
    assert a == [
        "Curriculum type is unclear or unknown (' Unclear ').", "Grade breakdown item at index 0 is missing 'grade_level'.", "Annual tuition for 'None' cannot be negative: -1", "Semester tuition for 'None' cannot be negative: -2",
        "Minimum tuition cannot be negative: -3", "Maximum tuition cannot be negative: -4", "Hidden cost item at index 0 is missing a name.", "Hidden cost amount for 'B' cannot be negative: -5", "Confidence score must be between 0.0 and 1.0: 1.01",
    ]
    assert b == ["Curriculum information is missing.", "Tuition was marked as found, but the grade breakdown table is empty.", "Confidence score must be a number: abc"]
    assert c == [] and d == []


def test_state(spark):
    steps = [("u", i, x) for i, x in enumerate("abcdbdade")] + [("v", 0, "a"), ("v", 1, "a"), (None, 0, "n")]
    df = spark.createDataFrame(steps, "user string, at int, item string")
    want, held = {}, []
    for u in ("u", "v", None):
        held = []
        for _, _, x in [s for s in steps if s[0] == u]:
            held = [y for y in held if y != x] if x in held else [*held, x] if len(held) < 3 else held
        want[u] = held
    assert {r.user: r["items"] for r in state.bounded_toggle(df, "user", "item", ["at"]).collect()} == want
    assert {(r.user, r.item) for r in state.toggled_on(df, ["user", "item"]).collect()} == {("u", "b"), ("u", "c"), ("u", "d"), ("u", "e"), (None, "n")} - ({("u", "b")} if "abcdbdade".count("b") % 2 == 0 else set())
    assert state.bounded_toggle(df.limit(0), "user", "item", ["at"]).count() == 0


def test_upsert(spark):
    base = spark.createDataFrame([("Alpha", 1), ("Beta", 2), (None, 3)], "name string, v int")
    batch = spark.createDataFrame([("ALPHA", 10, 1), ("alpha", 11, 2), ("New", 12, 3)], "name string, v int, seq int")
    once = upsert.upsert(base, batch, "name", "seq")
    assert rows_of(once) == sorted([("alpha", 11), ("Beta", 2), (None, 3), ("New", 12)], key=str)
    assert rows_of(upsert.upsert(once, batch, "name", "seq")) == rows_of(once)


def test_links(spark):
    html = '<a href="/fees">Fees</a><a class="x" href="/fees">again</a><a href="mailto:a@b">fee</a><a href="http://o.org/Policy.PDF">  Safety policy </a><iframe src="http://o.org/f.pdf"></iframe> http://o.org/raw-fee.pdf'
    pages = spark.createDataFrame([(1, "https://s.th/a/b?x=1", html), (2, "http://t", None)], "page_id long, url string, html string")
    found = links.link_candidates(pages, {"fee": links.FEE_WORDS, "safety": links.SAFETY_WORDS})
    assert rows_of(found) == [(1, "fee", 1, "https://s.th/fees", "Fees"), (1, "safety", 1, "http://o.org/Policy.PDF", "Safety policy")]
    scored = links.scored_documents(pages, most=9)
    assert [(r.href, r.score) for r in scored.orderBy("place").collect()] == [("http://o.org/f.pdf", 3), ("http://o.org/Policy.PDF", 2), ("http://o.org/raw-fee.pdf", 1)]


def test_texts(spark):
    html = '<header>h</header><p>One <b>two</b></p>\n\n<div style="display: none">gone</div><span hidden>x</span><svg><g/></svg><script>var t="</p>";</script> end '
    df = spark.createDataFrame([(html,), (None,), ("",)], "html string").select(texts.clean_text(F.col("html")).alias("t"))
    assert [r.t for r in df.collect()] == ["One \ntwo\n end", None, ""]
    pages = spark.createDataFrame([("d", 1, "short"), ("d", 2, None), ("d", 6, "The FEE is 1"), ("e", 1, "y" * 300), ("e", 9, "fee")], "doc string, page int, body string")
    got = {r.doc: r.text for r in texts.document_text(pages, "doc", "page", "body", ("fee",)).collect()}
    assert got == {"d": "--- Page 6 ---\nThe FEE is 1", "e": "y" * 300}
    both = spark.range(1).select(texts.sections(("A", F.lit("x")), ("B", F.lit("")), ("C", F.lit("z"))).alias("s")).first().s
    assert both == "--- A ---\nx\n\n--- C ---\nz"


def test_labels(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(show.currency(F.lit(1234567.5), "THB")) == "฿1,234,568" and one(show.currency(F.lit(None).cast("double"), "USD")) == "$0" and one(show.currency(F.lit(-2.5), "??")) == "฿-2"
    assert one(show.compact_amount(F.lit(1150000))) == "฿1.1M" and one(show.compact_amount(F.lit(2250000))) == "฿2.3M" and one(show.compact_amount(F.lit(520000))) == "฿520K"
    assert one(show.distance_label(F.lit(0.85))) == "850 m" and one(show.distance_label(F.lit(12.34))) == "12.3 km" and one(show.stars(F.lit(4.5))) == 5
    assert one(show.updated_label(F.lit("2026-01-05"))) == "Jan 5, 2026" and one(show.updated_label(F.lit(" Term 1 "))) == "Term 1" and one(show.updated_label(F.lit(""))) == show.NO_DATE
    assert one(show.shortened(F.lit("é" * 220))) == "é" * 220 + "…" and one(show.shortened(F.lit("é" * 219))) == "é" * 219
    assert abs(one(show.kilometres(F.lit(13.7306), F.lit(101.5688), 13.7306, 100.5688)) - 108.01) < 0.1


def test_one_decimal_is_exact(spark):
    import math
    from fractions import Fraction

    values = [random.Random(4).uniform(0, 2047) for _ in range(500)] + [i / 20 for i in range(400)] + [i / 1000 for i in range(50, 10000, 100)]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", show.one_decimal(F.col("x")).alias("t")).collect()
    assert all(r.t == "{}.{}".format(*divmod(math.floor(Fraction(r.x) * 10 + Fraction(1, 2)), 10)) for r in rows)


def test_liked_posts(spark):
    posts = spark.createDataFrame(
        [(1, 5, True, [(7, 1, None), (8, None, True)]), (2, None, None, None), (None, 3, True, [])], "id long, likes long, liked boolean, comments array<struct<id:long,likes:long,liked:boolean>>"
    )
    toggles = spark.createDataFrame([(1, None), (1, 7), (1, 8), (1, 8), (2, None), (2, None), (2, None), (9, 1), (None, None), (1, 99)], "id long, comment_id long")
    got = {r.id: (r.likes, r.liked, None if r.comments is None else [tuple(c) for c in r.comments]) for r in state.liked_posts(posts, toggles).collect()}
    assert got == {1: (5, False, [(7, 2, True), (8, 1, True)]), 2: (1, True, None), None: (4, True, [])}
    assert state.liked_posts(posts.limit(0), toggles).count() == 0 and state.liked_posts(posts, toggles.limit(0)).count() == 3


def test_collected_text(spark):
    shape = "u string, t string, d array<struct<url:string,text:string>>, su string, st string, sd array<struct<url:string,text:string>>"
    df = spark.createDataFrame([("a", "x", [("p", "q"), ("r", ""), ("s", None)], "b", "y", None), ("a", None, None, None, "lost", [("p", "lost")])], shape)
    got = [r.t for r in df.select(texts.collected_text(*(F.col(c) for c in ("u", "t", "d", "su", "st", "sd"))).alias("t")).collect()]
    first = "=== TUITION & FEE PAGE (a) ===\nx\n\n--- Fee PDF content from p ---\nq\n\n=== CAMPUS SAFETY & SAFEGUARDING POLICY PAGE (b) ===\ny"
    assert got == [first, "=== TUITION & FEE PAGE (a) ===\n"]


def test_blank_pages_of_documents_leave_no_line(spark):
    pages = spark.createDataFrame([("d", 1, "\ta" * 100), ("d", 2, " \n"), ("d", 3, "b" * 200 + "\n")], "doc string, page int, body string")
    assert texts.document_text(pages, "doc", "page", "body", ("fee",)).first().text == ("\ta" * 100)[1:] + "\n" + "b" * 200


def test_radius(spark):
    df = spark.createDataFrame([(13.7306, 100.5688), (14.5, 100.5688), (None, 1.0)], "lat double, lng double")
    assert [r.near for r in df.select(show.within(F.col("lat"), F.col("lng"), 13.7306, 100.5688).alias("near")).collect()] == [True, False, False]


def test_pages_as_browsers_read_them(spark):
    html = """<p class="note hidden" title="no hidden costs">kept</p><div hidden><p>gone <b>too</b></p><div>x</div></div>after<nav><nav>inner</nav>outer</nav>
    <div style='color:red; display: none'><br>y<img src="a>b"></div><script>if (a<b && "</div>") {}</script>caf&eacute; &amp; &#169;<!-- <p>no</p> --><input hidden>end<DIV HIDDEN>z</DIV><section data-x="hidden">seen</section>"""
    df = spark.createDataFrame([(html,), ("<p>a &amp; b</p>",), (None,), ("",), ("<div hidden><p>never closed",)], "html string").select(texts.clean_text(F.col("html")).alias("t"))
    assert [r.t for r in df.collect()] == ["kept\nafter\n    \ncafé & ©\nend\nseen", "a & b", None, "", ""]


def test_links_in_any_writing(spark):
    html = """<a href="/f"><span>Tuition</span> <b>Fees</b></a><A HREF='/g'>Fee two</A><a class=x href=/h>fee &amp; three</a><a href="/f">fee again</a><a name="fee">none</a><a
      data-href="/no" href="/i?a=1&amp;b=2">fee
      four</a><iframe src='/fees.pdf'></iframe><EMBED SRC=/x.pdf><a href="/fees.PDF"><i>read</i></a>"""
    pages = spark.createDataFrame([(1, "https://s.org/d/p", html), (2, None, None), (3, "https://s.org", "")], "page_id long, url string, html string")
    found = links.link_candidates(pages, {"fee": ("fee",), "none": ("zzz",)}).orderBy("place").collect()
    assert [(r.page_id, r["class"], r.place, r.href, r.text) for r in found] == [
        (1, "fee", 1, "https://s.org/f", "Tuition Fees"), (1, "fee", 2, "https://s.org/g", "Fee two"), (1, "fee", 3, "https://s.org/h", "fee & three"),
        (1, "fee", 4, "https://s.org/i?a=1&b=2", "fee four"), (1, "fee", 5, "https://s.org/fees.PDF", "read"),
    ]
    scored = links.scored_documents(pages, most=9).orderBy("place").collect()
    assert [(r.place, r.href, r.score) for r in scored] == [(1, "https://s.org/fees.pdf", 3), (2, "https://s.org/x.pdf", 3), (3, "https://s.org/fees.PDF", 2)]
    assert "Exchange" not in links.scored_documents(pages)._jdf.queryExecution().executedPlan().toString()


def test_links_that_patterns_miss(spark):
    html = """<a title="a > b" href="/x">T</a><!-- <a href="/c">comment</a> --><script>var s = '<a href="/s">script</a>'</script><a href="/open">left open <b>bold</b>
    <a href="/one">one <a href='/two'>two</a> after</a><A HREF = /up>UP&eacute;<script>gone()</script></A><a
    href="/q?a='1'&gt;2" hidden>q</a><a name=x>no address</a><a href="">empty</a><a/href="/slash">s</a><p title='<a href="/v">'>value</p><a href=" /blank ">b</a><a href="/last">never closed <i>x"""
    pages = spark.createDataFrame([(1, "https://s.org/d/p", html), (2, "https://s.org/", None), (3, "https://s.org/", "<a href=/y>cut <a href='/z>")], "page_id long, url string, html string")
    found = links.anchors(pages).orderBy("page_id", "pos").collect()
    assert [(r.page_id, r.href.removeprefix("https://s.org"), r.text) for r in found] == [
        (1, "/x", "T"), (1, "/open", "left open bold"), (1, "/one", "one"), (1, "/two", "two"), (1, "/up", "UPé"), (1, "/q?a='1'>2", "q"), (1, "/slash", "s"), (1, "/blank", "b"), (1, "/last", "never closed x"),
        (3, "/y", "cut"),
    ]


@pytest.mark.parametrize("piece", ["<a ", '<a x="', "<a href='x>", "<!--", "<script>", "<a href=x>", "<", "</a ", "<style><a href=y>", "<div hidden>", "<p title=\"", "<!-- <a href=x>"])
def test_pages_are_walked_in_linear_time(piece):
    def seconds(times):
        began = time.process_time()
        operators_pages.visible_text(piece * times), operators_pages.links_of(piece * times)
        return time.process_time() - began

    seconds(1000)
    assert seconds(100_000) < 10 * max(seconds(20_000), 0.05)


def test_names_of_raw_elements_end_them_whole(spark):
    pages = ["a<script>x</scripty>y</script>b", "a<STYLE>p<b>q</Style >c", "<p>1 < 2 <3 </ >x", "<!-->a", "<!doctype html><p>t", "<?php echo ?>u", "a<br/>b<nav/>c", "x</nav>y"]
    found = spark.createDataFrame(list(enumerate(pages)), "i int, h string").select("i", texts.clean_text(F.col("h")).alias("t")).orderBy("i").collect()
    assert [r.t for r in found] == ["a\nb", "a\nc", "1 < 2 <3 </ >x", "a", "t", "u", "a\nb\nc", "x\ny"]


UNTYPED = [
    ("not json", ["Record is not a JSON object."]), (None, ["Record is not a JSON object."]), ("[1]", ["Record is not a JSON object."]), ("null", ["Record is not a JSON object."]),
    ("{}", ["Curriculum information is missing."]),
    ('{"curriculum": " Unknown "}', ["Curriculum type is unclear or unknown (' Unknown ')."]),
    ('{"curriculum": "IB", "confidence": "x"}', ["Confidence score must be a number: x"]), ('{"curriculum": "IB", "confidence": 1.5}', ["Confidence score must be between 0.0 and 1.0: 1.5"]),
    ('{"curriculum": "IB", "confidence": null, "hidden_costs": null, "tuition_min_thb": null}', []),
    ('{"curriculum": "IB", "tuition_found": true, "tuition_by_grade": [{"annual_thb": -5}, {"grade_level": "G2", "semester_thb": "no"}, 7], "tuition_max_thb": -1}',
     ["Grade breakdown item at index 0 is missing 'grade_level'.", "Annual tuition for 'None' cannot be negative: -5", "Grade breakdown item at index 2 is missing 'grade_level'.", "Maximum tuition cannot be negative: -1"]),
    ('{"curriculum": "IB", "hidden_costs": {"name": 1}, "tuition_max_thb": [1]}', ["'hidden_costs' must be a list.", "'tuition_max_thb' must be a number."]),
    ('{"curriculum": "IB", "hidden_costs": [{"name": "Bus", "amount_thb": -2}, {"amount_thb": 1}]}', ["Hidden cost amount for 'Bus' cannot be negative: -2", "Hidden cost item at index 1 is missing a name."]),
    ('{"curriculum": "IB", "safety_and_security": []}', ["'safety_and_security' must be a dictionary/object."]),
    ('{"curriculum": "IB", "safety_and_security": {"highlights": null, "policy_summary": null}}', ["'safety_and_security.highlights' must be a list.", "'safety_and_security.policy_summary' must be a string."]),
    ('{"curriculum": "IB", "safety_and_security": {"highlights": [], "policy_summary": ""}}', []), ('{"curriculum": "IB", "safety_and_security": {}}', []), ('{"curriculum": "IB", "safety_and_security": null}', []),
]


def test_untyped_records(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(UNTYPED)], "i int, text string")
    found = validate.validated_json(rows, "text").orderBy("i").collect()
    assert [(r.i, r.errors) for r in found] == [(i, e) for i, (_, e) in enumerate(UNTYPED)]
    assert all((r.validation == "success") == (not r.errors) for r in found)


def test_untyped_records_are_parsed_once(spark):
    rows = spark.createDataFrame([(1, '{"hidden_costs": [{"name": 5, "amount_thb": -2}], "curriculum": "IB"}'), (2, "[1]"), (3, None)], "id long, record string")
    found = validate.validated_json(rows, "record")
    assert found.columns == ["id", "record", "errors", "validation"]
    assert [r.errors for r in found.orderBy("id").collect()] == [["Hidden cost item at index 0 is missing a name.", "Hidden cost amount for 'None' cannot be negative: -2"]] + [["Record is not a JSON object."]] * 2
    assert found._jdf.queryExecution().optimizedPlan().toString().lower().replace("_", "").count("parsejson") == 1


def test_few_pages_of_a_batch_are_objects_at_once(monkeypatch):
    import pyarrow as pa

    live, most = [], []
    monkeypatch.setattr(operators_pages.pa, "array", lambda values, kind, make=pa.array: (most.append(len(values)), make(values, kind))[1])
    pages = pa.chunked_array([[f'<a href="x{i}">t</a>' for i in range(1000)] + [None]]).combine_chunks()
    found = operators_pages._mapped(pages, operators_pages._LINKS, lambda p: live.append(p) or {"anchors": operators_pages.links_of(p)[0] if p else [], "frames": []})
    assert max(most) <= operators_pages.AT_ONCE and len(live) == len(found) == 1001
    assert found[999].as_py() == {"anchors": [{"href": "x999", "text": "t"}], "frames": []} and found[1000].as_py() == {"anchors": [], "frames": []}
