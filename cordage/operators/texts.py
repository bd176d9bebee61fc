"""Texts of pages, documents and threads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pages import DROPPED, walked_text  # noqa: F401

# Common entities, for the SQL of the test tables.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&"))
EDGES = r"^[\s\x{00A0}]+|[\s\x{00A0}]+$"


def clean_text(html: Column, limit: int = 9000) -> Column:
    """Readable text of a page: no dropped or hidden elements, tags as line ends, and at most ``limit`` code points.

    An element is hidden by the attribute ``hidden`` or a style of ``display:none``,
    with all that it holds. A null page has no text.
    """
    text = F.regexp_replace(F.regexp_replace(walked_text(html), r"\n\n+", "\n"), EDGES, "")
    return F.substring(text, 1, limit)


def sections(*parts: tuple[str, Column]) -> Column:
    """Headed parts in order with an empty line between; null and empty parts are left out."""
    made = [F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(f"--- {head} ---\n"), text)) for head, text in parts]
    return F.array_join(F.array_compact(F.array(*made)), "\n\n")


def joined_turns(turns: DataFrame, key: str, order: str, head: str, text: str) -> DataFrame:
    """``key`` and ``sections``: each thread's non-empty turns under their heads, in order."""
    part = F.concat(F.lit("--- "), F.coalesce(F.col(head), F.lit("")), F.lit(" ---\n"), F.col(text))
    rows = turns.where(F.col(text) != "").select(key, F.struct(F.col(order).alias("o"), part.alias("p")).alias("t"))
    return rows.groupBy(key).agg(F.sort_array(F.collect_list("t")).alias("ts")).select(key, F.array_join(F.transform("ts", lambda t: t["p"]), "\n\n").alias("sections"))


def first_items(rows: DataFrame, key: str, order: list[str], show: int = 2) -> DataFrame:
    """The first ``show`` rows of each key, with their ``place`` and how many ``more`` there are.

    Rows are numbered within keys, and counts are made before their shuffle.
    """
    from pyspark.sql import Window

    counts = rows.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("__n"))
    numbered = rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= show)
    return numbered.join(counts, F.col(key).eqNullSafe(F.col("__key"))).withColumn("more", F.greatest(F.col("__n") - show, F.lit(0))).drop("__key", "__n")


# Fixed value: the head that scraped documents carry over a page picked by its words.
PAGE_HEAD = "--- หน้าที่ {} ---\n"


def document_text(pages: DataFrame, key: str, page: str, text: str, words: tuple[str, ...], enough: int = 200, first: int = 5, keyed: int = 4, limit: int = 8000, head_text: str = "--- Page {} ---\n") -> DataFrame:
    """``key`` and ``text`` of documents given page by page.

    The first ``first`` pages, blank ones left out, count if they have
    ``enough`` characters together; else the first ``keyed`` pages that hold one
    of ``words``, each under ``head_text`` with its number; else the short text.
    Pages count from 1. Null texts are blank.
    """
    from ..functions.values import has_any

    before, after = head_text.split("{}")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = pages.select(F.col(key).alias("k"), F.col(page).alias("p"), body.alias("t"), has_any(body, words).alias("w"))
    head = F.collect_list(F.when((F.col("p") <= first) & F.col("t").rlike(r"\S"), F.struct("p", "t")))
    # of the pages with words only their numbers gather; the first few then bring their texts
    wanted = rows.where("w").groupBy("k").agg(F.slice(F.array_sort(F.collect_set("p")), 1, keyed).alias("ps")).select("k", F.explode("ps").alias("p"))
    tail = rows.where("w").join(wanted, ["k", "p"]).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("p", "t"))).alias("found"))
    base = rows.groupBy("k").agg(F.array_sort(head).alias("head")).join(tail, "k", "left")
    plain = F.regexp_replace(F.array_join(F.transform("head", lambda x: x["t"]), "\n"), r"^\s+|\s+$", "")
    marked = F.array_join(F.transform("found", lambda x: F.concat(F.lit(before), x["p"].cast("string"), F.lit(after), x["t"])), "\n\n")
    chosen = F.when(F.length(plain) >= enough, plain).otherwise(F.coalesce(marked, plain))
    return base.select(F.col("k").alias(key), F.substring(chosen, 1, limit).alias("text"))


# The heads of a record's page and document texts.
FEE_PAGE, FEE_DOCUMENT = "=== TUITION & FEE PAGE ({}) ===\n", "--- Fee PDF content from {} ---\n"
SAFETY_PAGE, SAFETY_DOCUMENT = "=== CAMPUS SAFETY & SAFEGUARDING POLICY PAGE ({}) ===\n", "--- Policy PDF Content from {} ---\n"


def collected_text(fee_url: Column, fee_text: Column, fee_documents: Column, safety_url: Column, safety_text: Column, safety_documents: Column) -> Column:
    """One text of a fee page, its documents, a safety page and its documents, each under its head.

    Documents are ``array<struct<url, text>>``; those without a text are left
    out. Without a ``safety_url`` nothing of the safety page is there. Null page
    texts are empty.
    """

    def headed(head: str, url: Column, text: Column) -> Column:
        before, after = head.split("{}")
        return F.concat(F.lit(before), F.coalesce(url, F.lit("")), F.lit(after), F.coalesce(text, F.lit("")))

    def documents(head: str, items: Column) -> Column:
        full = F.filter(items, lambda d: F.coalesce(d["text"], F.lit("")) != "")
        return F.coalesce(F.transform(full, lambda d: headed(head, d["url"], d["text"])), F.array().cast("array<string>"))

    fee = F.concat(F.array(headed(FEE_PAGE, fee_url, fee_text)), documents(FEE_DOCUMENT, fee_documents))
    safety = F.concat(F.array(headed(SAFETY_PAGE, safety_url, safety_text)), documents(SAFETY_DOCUMENT, safety_documents))
    return F.array_join(F.when(safety_url.isNull(), fee).otherwise(F.concat(fee, safety)), "\n\n")
