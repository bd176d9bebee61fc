"""Links of pages: candidates by keyword class, and scored documents."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import has_any, stripped
from .pages import walked_links

# Keywords of the two classes, and of documents worth reading first.
FEE_WORDS = ("tuition", "fee", "fees", "admission", "admissions", "cost", "costs", "payment", "enroll", "enrolment", "enrollment", "ค่าเทอม", "ค่าธรรมเนียม", "ค่าเล่าเรียน", "การชำระเงิน", "สมัครเรียน", "รับสมัคร")
SAFETY_WORDS = ("safety", "security", "safeguarding", "child protection", "child-protection", "health", "clinic", "nurse", "policy", "policies", "wellbeing", "well-being", "ความปลอดภัย", "นโยบาย", "การคุ้มครองเด็ก", "พยาบาล", "ห้องพยาบาล", "สุขอนามัย")
DOCUMENT_WORDS = ("fee", "tuition", "ค่าเทอม", "ค่าธรรมเนียม", "ค่าเล่าเรียน", "payment", "admission", "safety", "security", "safeguarding", "child-protection", "policy", "policies")


def resolved(url: Column, base: Column) -> Column:
    """An absolute address: ``url`` itself, or put after the base's host if it begins with a slash, else after its folder."""
    host = F.regexp_extract(base, r"^(https?://[^/]+)", 1)
    folder = F.regexp_extract(base, r"^(https?://[^/]+(?:/[^?#]*/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), url).when(url.startswith("//"), F.concat(F.lit("https:"), url)).when(url.startswith("/"), F.concat(host, url)).otherwise(F.concat(folder, url))


def anchors_of(html: Column, base: Column) -> Column:
    """``array<struct<href, text>>`` of a page's anchors with an address: it is absolute, and the text is that of all elements inside.

    Names may be in any case, and values quoted or not. An anchor ends at its end tag, at the next anchor, or with the page.
    """
    text = lambda x: stripped(F.regexp_replace(x, r"\s+", " "))
    return F.transform(walked_links(html)["anchors"], lambda a: F.struct(resolved(a["href"], base).alias("href"), text(a["text"]).alias("text")))


def anchors(pages: DataFrame) -> DataFrame:
    """``page_id``, ``pos``, ``href`` (absolute) and ``text`` of the anchors; null pages have none."""
    rows = pages.select("page_id", anchors_of(F.col("html"), F.col("url")).alias("a"))
    return rows.select("page_id", F.posexplode("a").alias("pos", "a")).select("page_id", "pos", "a.href", "a.text")


def _first_of_each(items: Column) -> Column:
    """Of array elements with one ``href`` the first."""
    return F.filter(items, lambda x, i: F.array_position(items["href"], x["href"]) == i + 1)


def link_candidates(pages: DataFrame, classes: dict[str, Iterable[str]], most: int = 12, width: int = 80) -> DataFrame:
    """``page_id``, ``class``, ``place`` (from 1), ``href`` and ``text`` of each page's first links of each class.

    ``pages`` has ``page_id``, ``url`` and ``html``. A link is of a class if its
    text or address holds one of the class's words, whatever the case; it can be
    of several. Only addresses that begin with ``http`` count, and of one
    address the first link. Texts are trimmed and cut. All that a page needs is
    in its row, so nothing is shuffled.
    """
    names = list(classes)
    rows = pages.select("page_id", F.filter(anchors_of(F.col("html"), F.col("url")), lambda a: a["href"].startswith("http")).alias("a"))
    hay = lambda a: F.concat_ws(" ", a["text"], a["href"])
    of_class = lambda words: F.filter("a", lambda a: has_any(hay(a), words))
    rows = rows.select("page_id", *(of_class(words).alias(f"c{i}") for i, words in enumerate(classes.values())))
    rows = rows.select("page_id", *(F.slice(_first_of_each(F.col(f"c{i}")), 1, most).alias(f"c{i}") for i in range(len(names))))
    named = lambda i: F.transform(f"c{i}", lambda a, p: F.struct(F.lit(names[i]).alias("class"), (p + 1).alias("place"), a["href"].alias("href"), F.substring(a["text"], 1, width).alias("text")))
    made = [named(i) for i in range(len(names))]
    # outer: a plain explode would make the links once more, to filter on their number
    return rows.select("page_id", F.explode_outer(F.concat(*made)).alias("x")).where("x is not null").select("page_id", "x.*")


def scored_documents(pages: DataFrame, mark: str = ".pdf", words: Iterable[str] = DOCUMENT_WORDS, seen: str | None = None, most: int = 2) -> DataFrame:
    """``page_id``, ``place``, ``href`` and ``score`` of each page's best document addresses.

    Addresses that hold ``mark`` score 4 if ``seen`` (an array column) has
    them, 3 as frames, 2 as anchors and 1 in raw text, anchors and raw text only
    if they hold one of ``words`` and else 0. An address keeps its best score,
    and equal scores the order of first sight. Nothing is shuffled.
    """
    html, url = F.col("html"), F.col("url")
    entry = lambda href, score: F.struct(href.alias("href"), score.cast("int").alias("score"))
    held = lambda items: F.filter(items, lambda x: (x["href"] != "") & F.contains(F.lower(x["href"]), F.lit(mark.lower())))
    of_links = held(F.transform(anchors_of(html, url), lambda a: entry(a["href"], F.when(has_any(a["href"], words) | has_any(a["text"], words), 2).otherwise(0))))
    of_frames = held(F.transform(walked_links(html)["frames"], lambda x: entry(resolved(x, url), F.lit(3))))
    escaped = "".join("\\" + c if not c.isalnum() and c != "/" else c for c in mark)
    raw = F.regexp_extract_all(html, F.lit(rf"""(?i)https?://[^\s'"<>]+{escaped}"""), F.lit(0))
    of_raw = F.transform(raw, lambda x: entry(x, F.when(has_any(x, words), 1).otherwise(0)))
    none = F.array().cast("array<struct<href:string,score:int>>")
    of_seen = F.transform(F.filter(F.col(seen), lambda x: x != ""), lambda x: entry(x, F.lit(4))) if seen else none
    rows = pages.select("page_id", F.concat(*(F.coalesce(x, none) for x in (of_links, of_frames, of_raw, of_seen))).alias("a"))
    rows = rows.select("page_id", "a", _first_of_each(F.col("a")).alias("firsts"))
    best = F.transform("firsts", lambda x, i: F.struct((-F.array_max(F.transform(F.filter("a", lambda y: y["href"] == x["href"]), lambda y: y["score"]))).alias("score"), i.alias("sight"), x["href"].alias("href")))
    rows = rows.select("page_id", F.posexplode_outer(F.slice(F.array_sort(best), 1, most)).alias("place", "x")).where("x is not null")  # outer as above
    return rows.select("page_id", (F.col("place") + 1).alias("place"), F.col("x.href").alias("href"), (-F.col("x.score")).alias("score"))
