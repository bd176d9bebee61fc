"""Rows within a distance of each of many points, by cells of a grid.

Bands of latitude are as high as the distance, and each is cut into cells at least as wide,
fewer towards the poles. A point lies in one cell; a circle is covered by a few in
three bands. Cells are counted first: what a cell holds is cut into blocks of bounded
size, blocks meet in an equi-join of as many tasks as there are pairs to test, and the
distance is then tested.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import kilometres
from ..sources.scratch import stored

EARTH = 6371.0
# What a task of the join gets at most, on the whole.
PAIRS, ROWS = 50_000_000, 1_000_000


def _cells_of_band(band: Column, height: float) -> Column:
    """How many cells a band has: none of them is narrower than the band is high, wherever in the band one measures."""
    widest = F.least(F.lit(90.0), F.greatest(F.abs(band * height - 90), F.abs((band + 1) * height - 90)))
    return F.greatest(F.lit(1.0), F.floor(360 * F.cos(F.radians(widest)) / height)).cast("long")


def _place(lng: Column, cells: Column) -> Column:
    """The cell of a longitude, which may be any number of degrees."""
    turned = F.pmod(lng + 180, F.lit(360.0))
    return F.least(F.floor(turned * cells / 360).cast("long"), cells - 1)


def _with_vector(rows: DataFrame, lat: str, lng: str, name: str) -> DataFrame:
    """``rows`` with the place as a vector of length 1."""
    la, lo = F.radians(lat), F.radians(lng)
    return rows.withColumns({f"{name}x": F.cos(la) * F.cos(lo), f"{name}y": F.cos(la) * F.sin(lo), f"{name}z": F.sin(la)})


def _in_blocks(rows: DataFrame, given: DataFrame, crowded: DataFrame, cell: list[str], own: tuple[str, str], other: tuple[str, str]) -> DataFrame:
    """``rows`` with the number of its block among its own kind, once for each block of the other kind in its cell."""
    hashed = [c for c, kind in given.dtypes if "map<" not in kind and "variant" not in kind]
    count = lambda c: F.coalesce(F.greatest(F.col(c), F.lit(1)), F.lit(1)).cast("long")
    rows = rows.join(crowded, cell, "left").withColumn(own[1], F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in hashed)), count(own[0])))
    return rows.withColumn(other[1], F.explode(F.sequence(F.lit(0).cast("long"), count(other[0]) - 1))).drop("__m", "__n")


def within_each(points: DataFrame, centres: DataFrame, km: float, lat: str = "lat", lng: str = "lng", at_lat: str = "at_lat", at_lng: str = "at_lng", block: int = 4096) -> DataFrame:
    """Every pair of a row of ``points`` and a row of ``centres`` that are at most ``km`` apart, with the columns of both and ``km``.

    Coordinates are degrees, latitudes from -90 to 90; rows with a null or non-finite one, or a latitude beyond, are near nothing. The two tables share no column
    names. A centre is repeated for each cell of its cover, some fifteen at most. Where a cell holds more than ``block`` of either, its rows are dealt to blocks by a hash of
    all their columns, and each block of points meets each block of centres on its own, so no task's work follows a crowded cell. Both tables are read twice, first to be counted.
    """
    height = min(180.0, max(math.degrees(km / EARTH) * (1 + 1e-9), 1e-4))  # the slack keeps rounding inside
    bands = max(1, math.floor(180 / height))
    height = 180 / bands
    sound = lambda a, b: F.col(a).between(-90, 90) & F.col(b).isNotNull() & ~F.isnan(F.col(b).cast("double")) & (F.abs(F.col(b)) < 1e6)
    band_of = lambda x: F.least(F.floor((x + 90) / height).cast("long"), F.lit(bands - 1))

    here = points.where(sound(lat, lng)).withColumn("__band", band_of(F.col(lat)))
    here = _with_vector(here.withColumn("__cell", _place(F.col(lng), _cells_of_band(F.col("__band"), height))), lat, lng, "__p")

    own = band_of(F.col(at_lat))
    there = centres.where(sound(at_lat, at_lng)).withColumn("__band", F.explode(F.sequence(F.greatest(own - 1, F.lit(0)), F.least(own + 1, F.lit(bands - 1)))))
    cells = _cells_of_band(F.col("__band"), height)
    angle = min(math.pi, km / EARTH * (1 + 1e-9))
    # how far east and west a circle reaches; around a pole it reaches everywhere
    sine = F.lit(math.sin(angle)) / F.cos(F.radians(at_lat))
    reach = F.when((F.abs(F.col(at_lat)) + math.degrees(angle) >= 90) | (sine >= 1), F.lit(180.0)).otherwise(F.degrees(F.asin(sine)) + 1e-9)
    first, wide = _place(F.col(at_lng) - reach, cells), F.least(cells, F.ceil(2 * reach * cells / 360).cast("long") + 1)
    there = there.withColumn("__first", first).withColumn("__cells", cells).withColumn("__step", F.explode(F.sequence(F.lit(0).cast("long"), wide - 1)))
    there = there.withColumn("__cell", F.pmod(F.col("__first") + F.col("__step"), F.col("__cells"))).drop("__first", "__cells", "__step")
    there = _with_vector(there, at_lat, at_lng, "__c")

    cell = ["__band", "__cell"]
    cells = here.groupBy(cell).agg(F.count("*").alias("__points")).join(there.groupBy(cell).agg(F.count("*").alias("__centres")), cell, "full").fillna(0, ["__points", "__centres"])
    cells = stored(cells, "cells")
    pairs, rows = cells.agg(F.sum(F.col("__points") * F.col("__centres")), F.sum(F.col("__points") + F.col("__centres"))).first()
    crowded = cells.where((F.col("__points") > block) | (F.col("__centres") > block))  # broadcast: at most one for ``block`` rows
    crowded = F.broadcast(crowded.select(*cell, F.ceil(F.col("__points") / block).alias("__m"), F.ceil(F.col("__centres") / block).alias("__n")))
    key, n = [*cell, "__i", "__j"], max(points.sparkSession.sparkContext.defaultParallelism, math.ceil((pairs or 0) / PAIRS), math.ceil((rows or 0) / ROWS))
    here = _in_blocks(here, points, crowded, cell, ("__m", "__i"), ("__n", "__j")).repartition(n, *key)
    there = _in_blocks(there, centres, crowded, cell, ("__n", "__j"), ("__m", "__i")).repartition(n, *key)

    # the chord between two places tells nearly all pairs without an angle; the distance itself decides within a slack far above rounding
    chord, slack = 2 * math.sin(min(math.pi, km / EARTH) / 2), 1e-9
    square = sum(((F.col(f"__p{d}") - F.col(f"__c{d}")) * (F.col(f"__p{d}") - F.col(f"__c{d}")) for d in "yz"), (F.col("__px") - F.col("__cx")) * (F.col("__px") - F.col("__cx")))
    distance = kilometres(F.col(lat), F.col(lng), F.col(at_lat), F.col(at_lng))
    close = (square <= (chord + slack) ** 2) & ((square <= max(0.0, chord - slack) ** 2) | (distance <= km))
    met = here.alias("h").join(there.alias("t").hint("merge"), [*(F.col(f"h.{k}") == F.col(f"t.{k}") for k in key), close])
    return met.select(*(F.col(f"h.`{c}`") for c in points.columns), *(F.col(f"t.`{c}`") for c in centres.columns), distance.alias("km"))
