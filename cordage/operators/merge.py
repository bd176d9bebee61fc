"""Merging extracted facts into a catalogue by first-match name containment.

A record belongs to the first catalogue row where one name, in lower case,
contains the other. No pair of unrelated rows is ever formed: whatever holds a
name holds each run of characters (gram) of that name, so a name is looked up by that of its
grams that the fewest holders have, and not at all if none has one of them. Grams at words'
starts come first, as there are few; names whose rarest is common among
these are looked up by grams at any place. Containment is then tested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored

#: Lengths that a gram may have, in characters; the longest that a name has counts.
LENGTHS = (24, 12, 6, 3, 1)
#: Holders of a gram at words' starts up to which it serves as a key.
COMMON = 16
_WORD = "0-9\\p{L}"
_AT_WORDS, _INSIDE = f"(?<![{_WORD}])(?=[{_WORD}])", f"(?<=[^{_WORD}])(?=[{_WORD}])"


def _prepared(df: DataFrame, pos: str, name: str) -> DataFrame:
    low = F.lower(F.col(name))
    return df.select(F.col(pos).alias("pos"), low.alias("name")).where("name is not null")


def _grams(n: int, at: str = "") -> Column:
    """All grams of ``n`` characters of a name that stand where ``at`` holds."""
    return F.regexp_extract_all("name", F.lit(f"(?s){at}(?=(.{{{n}}}))"), F.lit(1))


def _looked_up(needles: DataFrame, holders: DataFrame, at_needle: str, at_holder: str) -> tuple[DataFrame, DataFrame] | None:
    """``pos``, ``key`` and ``held`` of each needle: the gram that the fewest holders have (null: it has none), and by how many; and each such gram's holders (``pos``, ``key``)."""
    grams = F.coalesce(*(F.when(F.size(g) > 0, g) for g in (_grams(n, at_needle) for n in LENGTHS)))
    options = stored(needles.select("pos", F.explode_outer(F.array_distinct(grams)).alias("key")), "grams")
    lengths = sorted(r[0] for r in options.where("key is not null").select(F.length("key")).distinct().collect())  # at most those of LENGTHS
    if not lengths:
        return None
    # outer: a plain explode would make the keys twice, once to filter on their number
    having = holders.select("pos", F.explode_outer(F.array_distinct(F.concat(*(_grams(n, at_holder) for n in lengths)))).alias("key"))
    having = stored(having.join(options.select("key").distinct(), "key", "left_semi"), "holders")
    counted = options.join(having.groupBy("key").agg(F.count("*").alias("held")), "key", "left")
    best = counted.groupBy("pos").agg(F.min(F.when(F.col("key").isNotNull(), F.struct(F.coalesce("held", F.lit(0)).alias("held"), F.col("key")))).alias("b"))
    return stored(best.select("pos", "b.key", "b.held"), "rarest"), having


def candidates(holders: DataFrame, needles: DataFrame, common: int = COMMON) -> DataFrame:
    """``holder`` and ``needle``: positions of rows of which the one can contain the other; ``needles`` have no empty names.

    There are as many pairs as holders have the rarest gram of each needle. Grams at words' starts serve if on the
    whole they give no more than ``common`` pairs a row, else only those with at most ``common`` holders.
    """
    longest, rows = holders.agg(F.max(F.length("name")), F.count("*")).first()
    needles = needles.where(F.length("name") <= (longest or 0))
    none = needles.select(F.col("pos").alias("holder"), F.col("pos").alias("needle")).limit(0)
    met = lambda best, having: having.join(best.select(F.col("pos").alias("needle"), "key"), "key").select(F.col("pos").alias("holder"), "needle")
    found, left = none, needles
    at_words = _looked_up(needles, holders, _INSIDE, _AT_WORDS)
    if at_words:
        best, having = at_words
        pairs, all_ = best.agg(F.sum("held"), F.count("*")).first()
        most = common if (pairs or 0) > common * (rows + all_) else pairs or 0
        found = met(best.where(f"held between 1 and {most}"), having)  # without a holder of one of its grams a name is held by none
        left = needles.join(best.where(f"key is null or held > {most}"), "pos", "left_semi")
    anywhere = _looked_up(left, holders, "", "")
    return found.unionByName(met(anywhere[0].where("held > 0"), anywhere[1])) if anywhere else found


def _contained(holders: DataFrame, needles: DataFrame, holder: str, needle: str) -> DataFrame:
    needles = needles.where("name <> ''")
    pairs = candidates(holders, needles).select(F.col("holder").alias(holder), F.col("needle").alias(needle))  # positions alone: names may be long
    inside = needles.select(F.col("pos").alias(needle), F.col("name").alias("inside"))
    outside = holders.select(F.col("pos").alias(holder), F.col("name").alias("outside"))
    return pairs.join(inside, needle).join(outside, holder).where(F.contains("outside", "inside")).select(holder, needle)


def _first_of_each(rows: DataFrame) -> DataFrame:
    """The row of smallest ``pos`` of each name: later ones are never a first match. Names meet by their digests."""
    told = rows.withColumn("digest", F.sha2("name", 256))
    first = told.groupBy("digest").agg(F.min("pos").alias("pos"))
    return told.join(first, ["pos", "digest"], "left_semi").drop("digest")


def first_containment(records: DataFrame, catalogue: DataFrame, record_pos: str, record_name: str, seed_pos: str, seed_name: str) -> DataFrame:
    """``record`` and ``seed``: the position of each record that matches, and of the first catalogue row that it matches.

    Names match if either, in lower case, contains the other. An empty name is
    contained in every name, so it matches the first row. Null names match
    nothing. Records without a match have no row.
    """
    r, s = _prepared(records, record_pos, record_name), _first_of_each(_prepared(catalogue, seed_pos, seed_name))
    found = _contained(r, s, "record", "seed").unionByName(_contained(s, r, "seed", "record"))
    first = s.agg(F.min("pos").alias("any"), F.min(F.when(F.col("name") == "", F.col("pos"))).alias("blank")).first()
    if first["any"] is not None:
        found = found.unionByName(r.where("name = ''").select(F.col("pos").alias("record"), F.lit(first["any"]).alias("seed")))
    if first["blank"] is not None:
        found = found.unionByName(r.select(F.col("pos").alias("record"), F.lit(first["blank"]).alias("seed")))
    return found.groupBy("record").agg(F.min("seed").alias("seed"))


def merge_records(
    catalogue: DataFrame, records: DataFrame, seed_pos: str, seed_name: str, record_pos: str, record_name: str, texts: dict[str, str], amounts: dict[str, str]
) -> DataFrame:
    """``catalogue`` with facts of the last record that matches each row.

    ``texts`` maps catalogue columns to record columns that override them
    unless null, empty or ``unclear``; ``amounts`` to ones that override unless
    null, 0 included. ``matched_record`` is the record's position or null.
    Several records on one row apply in turn, so of each column the last
    override counts.
    """
    links = first_containment(records, catalogue, record_pos, record_name, seed_pos, seed_name)
    given = {**{c: F.when((F.col(v) != "") & (F.lower(F.col(v)) != "unclear"), F.col(v)) for c, v in texts.items()}, **{c: F.col(v) for c, v in amounts.items()}}
    facts = records.select(F.col(record_pos).alias("record"), *(e.alias(f"__{c}") for c, e in given.items())).join(links, "record")
    last = facts.groupBy("seed").agg(F.max("record").alias("matched_record"), *(F.max_by(f"__{c}", F.when(F.col(f"__{c}").isNotNull(), F.col("record"))).alias(f"__{c}") for c in given))
    joined = catalogue.join(last, F.col(seed_pos) == F.col("seed"), "left")
    return joined.withColumns({c: F.coalesce(f"__{c}", c) for c in given}).drop("seed", *(f"__{c}" for c in given))
