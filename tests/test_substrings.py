"""Searching through postings against reading the whole table."""

import random

import pytest
from pyspark.sql import functions as F

from cordage.operators.facets import text_search
from cordage.sources.substrings import SubstringIndex


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    pick = random.Random(5)
    words = ["international", "school", "bangkok", "İstanbul", "école", "straße", "日本語学校", "😀x😀y", "a_b%c", "ΣΑΣ"]
    rows = [(n, " ".join(pick.choice(words) for _ in range(pick.randint(1, 4))), pick.choice(["ring", "RINGS", "", None, "ab"])) for n in range(3000)]
    rows += [(3000, None, None), (3001, "", "x"), (3002, "Only Here: Quartz", "z"), (3002, "Only Here: Quartz", "z"), (None, "quartz", None), (3003, "long " * 200_000 + "needle", None)]
    df = spark.createDataFrame(rows, "id long, name string, brand string").repartition(40)
    return df, SubstringIndex(spark, f"file://{tmp_path_factory.mktemp('index')}/t", ["name", "brand"], parts=40, buckets=8).build(df)


@pytest.mark.parametrize("query", ["Ring", "school bangkok", "QUARTZ", "here: q", "İST", "istanbul", "STRASSE", "straße", "本語学", "😀x", "b%c", "σας", "ΑΣ ", "ng", "  ", "", "nothing like it", "g needle", "l sch"])
def test_same_as_the_whole_table(indexed, query):
    df, index = indexed
    rows = lambda d: sorted((str(r.id), str(r.name)[:40], str(r.brand)) for r in d.collect())
    got = index.search(query)
    assert got.columns == df.columns and rows(got) == rows(text_search(df, query, ["name", "brand"]))


def test_few_files_are_read(indexed):
    df, index = indexed
    every = len(index._read("rows", "__part").inputFiles())
    found = index.search("quartz")
    files = [f for f in found.inputFiles() if "/rows/" in f]
    assert every >= 40 and 1 <= len(files) <= 3 and found.count() == 3
    grams = index._rarest("only here: quartz", 4)
    assert len(grams) == 4 and index._rarest("no such words", 4) is None


def test_an_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], "id long, name string")
    index = SubstringIndex(spark, f"file://{tmp_path}/none", ["name"]).build(none)
    assert index.search("ring").count() == index.search("").count() == index.search("ab").count() == 0


def test_an_index_is_not_overwritten(indexed):
    df, index = indexed
    with pytest.raises(Exception, match="(?i)exists"):
        index.build(df)


def test_grams_are_of_whole_characters(spark):
    from cordage.sources.substrings import _grams

    row = spark.createDataFrame([("a😀bA😀b",), ("ab",), (None,)], "t string").select(_grams(F.col("t"))).collect()
    assert [r[0] for r in row] == [["a😀b", "😀ba", "ba😀"], [], []]
