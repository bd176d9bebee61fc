"""How filters interact: every order of them, executed along a trie of permutations.

A node of the trie is what a prefix of an order leaves. Prefixes of the same filters
leave the same documents, so a node is kept by its set and each set is made
once: depth first, its survivors are persisted, counted by part for every filter that may come
next, and given on to the nodes below. An edge's counts are those of actual removals.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import made_folder, written

SPACE = r"[\x20\x09-\x0D]+"


def measured_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What the filters ask of each row of ``docs`` (``doc_id``, ``text``, ``source``), without its text.

    Columns ``part`` (the source, null: empty), ``n_words``, ``n_distinct``, ``n_capitals``,
    ``n_points``, ``has_sign``, ``repeats`` (a row of smaller id has the same text), and ``good`` and
    ``toxic`` from ``labels``, of which any row of an id counts. Null texts are empty. A null id is
    smaller than none and greater than none. Equal texts are told by their SHA-256.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text")).select(
        "doc_id", "part", F.length("text").alias("n_points"), F.length(F.regexp_replace("text", "[^A-Z]+", "")).alias("n_capitals"), F.col("text").rlike("[#$%&*|]").alias("has_sign"),
        F.sha2("text", 256).alias("digest"), words.alias("words"),
    )
    rows = rows.withColumn("n_words", F.size("words")).withColumn("n_distinct", F.size(F.array_distinct("words"))).drop("words")
    rows = written(rows, "measured")
    # joined by id and text, not by text: a text that many rows share is no hot key
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("__id")).select("__id", F.col("digest").alias("__digest"))
    said = labels.groupBy(F.col("doc_id").cast("long").alias("__of")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = rows.join(first, (F.col("doc_id") == F.col("__id")) & (F.col("digest") == F.col("__digest")), "left")
    rows = rows.withColumn("repeats", F.col("doc_id").isNotNull() & F.col("__id").isNull()).drop("__id", "__digest", "digest")
    rows = rows.join(said.where("__of is not null"), F.col("doc_id") == F.col("__of"), "left").drop("__of")
    return rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})


def document_filters() -> dict[str, Column]:
    """The five filters over ``measured_documents``: when a document fails each."""
    return {
        "A": F.expr("n_words < 50"),
        "B": F.expr("100L * n_distinct < 65L * n_words"),
        "C": F.expr("100L * n_capitals > 5L * n_points"),
        "D": F.expr("has_sign"),
        "E": F.expr("repeats"),
    }


def trie_edges(rows: DataFrame, filters: dict[str, Column], part: str, marks: Sequence[str]) -> DataFrame:
    """``part``, ``state``, ``filter``, ``entered``, ``removed`` and ``<mark>_lost`` of every edge of the trie.

    ``state`` is the set of filters before, as a number with a bit for each. A part without
    survivors has no row at that state. Each node's counts are one aggregate, pre-aggregated by task and written to
    the shared folder; of survivors only the nodes from the root to the one in
    work are persisted. A lost executor's blocks are made again from ``rows``, which must be stored.
    """
    names, folder, memo = list(filters), made_folder(rows.sparkSession, "edges"), set()

    def visit(state: int, survivors: DataFrame) -> None:
        if state in memo:
            return
        memo.add(state)
        ahead = [i for i in range(len(names)) if not state >> i & 1]
        if not ahead:
            return
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        fails = {i: F.coalesce(filters[names[i]], F.lit(False)) for i in ahead}
        counts = [F.count_if(fails[i]).alias(f"removed{i}") for i in ahead] + [F.count_if(fails[i] & F.col(m)).alias(f"{m}{i}") for i in ahead for m in marks]
        by_part = survivors.groupBy(part).agg(F.count("*").alias("entered"), *counts)
        edges = F.explode(F.array(*[F.struct(F.lit(names[i]).alias("filter"), F.col(f"removed{i}").alias("removed"), *[F.col(f"{m}{i}").alias(f"{m}_lost") for m in marks]) for i in ahead]))
        by_part.select(part, "entered", edges.alias("edge")).select(part, "entered", "edge.*").write.parquet(f"{folder}/state={state}")
        for i in ahead:
            visit(state | 1 << i, survivors.where(~fails[i]))
        survivors.unpersist()

    visit(0, rows)
    return rows.sparkSession.read.parquet(folder)


def audit_filters(rows: DataFrame, filters: dict[str, Column], part: str = "part", marks: Sequence[str] = ()) -> DataFrame:
    """Every order of ``filters`` step by step, for each value of ``part``.

    ``rows`` is a stored table, ``filters`` has the condition under which a row fails (null: it does not), and
    ``marks`` are boolean columns (not null). Columns: ``part``, ``filter_order`` (names joined), ``step`` (from 1), ``kept``,
    ``removed``, ``redundant`` (failing, but removed before), ``unique_fails`` (failing this filter only), ``<mark>_lost``
    and ``shapley`` (removed, summed over all orders). Steps that remove nothing have
    their row. No rows give none. There are n! * n rows a part and 2**n nodes for n filters, so n is 7 at most.
    """
    names = list(filters)
    if not 1 <= len(names) <= 7:
        raise ValueError("one to seven filters")
    edges = written(trie_edges(rows, filters, part, marks), "all-edges")
    n, last = len(names), (1 << len(names)) - 1
    bit = F.element_at(F.create_map(*[x for i, name in enumerate(names) for x in (F.lit(name), F.lit(1 << i))]), F.col("filter"))
    orders_before = F.element_at(F.array(*[F.lit(math.factorial(k) * math.factorial(n - 1 - k)).cast("long") for k in range(n)]), F.bit_count("state").cast("int") + 1)
    by_filter = edges.groupBy(part, "filter").agg(
        F.sum(F.when(F.col("state") == 0, F.col("removed"))).alias("failing"),
        F.coalesce(F.sum(F.when(F.col("state") == F.lit(last) - bit, F.col("removed"))), F.lit(0)).alias("unique_fails"),
        F.sum(F.col("removed") * orders_before).alias("shapley"),
    )
    orders = list(itertools.permutations(range(n)))
    steps = [("".join(names[i] for i in o), k + 1, sum(1 << i for i in o[:k]), names[o[k]]) for o in orders for k in range(n)]
    spark = rows.sparkSession
    table = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, state int, filter string"))  # n! * n rows
    spine = by_filter.join(table, "filter").alias("s")  # a row for each part, order and step
    found = spine.join(edges.alias("e"), [part, "state", "filter"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return found.select(
        F.col(part).alias("part"), "filter_order", "step", (zero("entered") - zero("removed")).alias("kept"), zero("removed").alias("removed"), (F.col("failing") - zero("removed")).alias("redundant"),
        "unique_fails", *[zero(f"{m}_lost").alias(f"{m}_lost") for m in marks], "shapley",
    )
