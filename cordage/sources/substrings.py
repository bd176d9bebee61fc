"""A table whose texts are searched by what they hold, through postings of three-character grams.

Rows lie in parts, one for each task that wrote them as far as parts go. A posting is a gram and a row that
holds it; postings lie in hash buckets of their gram, sorted by it. A search reads the buckets of a few of the
query's grams, those that the fewest rows hold, and then only the parts of rows that hold them all. An
exact test follows, so the result is that of reading the whole table.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.facets import text_search
from .scratch import stored

ROW, PART, BUCKET, GRAM = "__row", "__part", "__bucket", "__gram"
_SCHEMAS = {"postings": f"{GRAM} string, {ROW} long, {PART} int, {BUCKET} int", "counts": f"{GRAM} string, n long, {BUCKET} int"}


def _grams(text: Column) -> Column:
    """The distinct grams of a text in lower case, in time that follows its length; null or under three characters: none."""
    three = lambda s: F.transform(F.sequence(F.lit(0), F.size(s) - 3), lambda n: F.concat(F.get(s, n), F.get(s, n + 1), F.get(s, n + 2)))
    signs = F.array(F.split(F.lower(text), ""))  # bound to a name, for else it would be split again for each place
    return F.when(F.length(F.lower(text)) >= 3, F.array_distinct(F.transform(signs, three)[0])).otherwise(F.array().cast("array<string>"))


class SubstringIndex:
    """Rows and postings in a folder that executors share; ``build`` makes it once, ``search`` reads it."""

    def __init__(self, spark: SparkSession, path: str, columns: list[str], parts: int = 1024, buckets: int = 256) -> None:
        self.spark, self.path, self.columns, self.parts, self.buckets = spark, path.rstrip("/"), columns, parts, buckets

    def _bucket(self, gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(self.buckets)).cast("int")

    def build(self, rows: DataFrame) -> SubstringIndex:
        """Write ``rows``, all columns, and the postings of ``columns``. An index that is there already is an error.

        Rows are written where they are, without a shuffle; postings are made from the written rows, so that a repeated
        task gives the same. Rows may repeat. A null text has no postings.
        """
        numbered = rows.withColumns({ROW: F.monotonically_increasing_id(), PART: F.pmod(F.spark_partition_id(), F.lit(self.parts))})
        numbered.write.partitionBy(PART).parquet(f"{self.path}/rows")
        self.spark.createDataFrame([(numbered.schema.json(),)], "value string").coalesce(1).write.text(f"{self.path}/schema")
        written = self._read("rows", PART)
        held = F.array_distinct(F.flatten(F.array(*(_grams(F.col(c)) for c in self.columns))))
        postings = written.select(F.explode(held).alias(GRAM), ROW, PART).withColumn(BUCKET, self._bucket(F.col(GRAM)))
        # a bucket's rows come from one task, or from several if adaptive execution splits it
        postings.hint("rebalance", BUCKET).sortWithinPartitions(BUCKET, GRAM).write.partitionBy(BUCKET).parquet(f"{self.path}/postings")
        counts = self._read("postings", BUCKET).groupBy(GRAM).agg(F.count("*").alias("n")).withColumn(BUCKET, self._bucket(F.col(GRAM)))
        counts.hint("rebalance", BUCKET).sortWithinPartitions(BUCKET, GRAM).write.partitionBy(BUCKET).parquet(f"{self.path}/counts")
        return self

    def _row_schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.spark.read.text(f"{self.path}/schema").first()[0]))

    def _read(self, what: str, column: str, wanted: list[int] | None = None) -> DataFrame:
        """The table, or only its folders of ``wanted`` values that are there; no other is listed."""
        at, schema = f"{self.path}/{what}", _SCHEMAS.get(what) or self._row_schema()
        if wanted is None:
            return self.spark.read.schema(schema).parquet(at)
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        fs = hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        there = {s.getPath().getName() for s in fs.listStatus(hadoop)}
        folders = [f"{at}/{column}={n}" for n in sorted(wanted) if f"{column}={n}" in there]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", at).parquet(*folders)

    def _rarest(self, query: str, most: int) -> list[tuple[str, int]] | None:
        """Up to ``most`` grams of the query with their buckets, those that the fewest rows hold; None if one of them is in no row."""
        asked = self.spark.range(1).select(F.explode(F.slice(_grams(F.lit(query)), 1, 64)).alias(GRAM)).withColumn(BUCKET, self._bucket(F.col(GRAM)))
        asked = {r[GRAM]: r[BUCKET] for r in asked.collect()}  # of the query: at most 64
        counts = self._read("counts", BUCKET, sorted(set(asked.values()))).where(F.col(GRAM).isin(list(asked)))
        found = {r[GRAM]: r["n"] for r in counts.select(GRAM, "n").collect()}
        if len(found) < len(asked):
            return None
        return [(g, asked[g]) for g in sorted(found, key=lambda g: (found[g], g))[:most]]

    def search(self, query: str, most: int = 4) -> DataFrame:
        """Rows of which any of ``columns`` holds ``query``, whatever the case: those that ``facets.text_search`` gives.

        A blank query gives all rows, and one of under three characters reads all. At most ``most`` grams, of the query's first
        64, choose the rows that are tested; which they are only decides how many rows are read.
        """
        everything = self._read("rows", PART)
        if not query.strip() or self.spark.range(1).select(F.size(_grams(F.lit(query)))).first()[0] == 0:
            return text_search(everything, query, self.columns).drop(ROW, PART)
        grams = self._rarest(query, most)
        if grams is None:
            return self.spark.createDataFrame([], everything.schema).drop(ROW, PART)
        postings = self._read("postings", BUCKET, sorted({b for _, b in grams})).where(F.col(GRAM).isin([g for g, _ in grams]))
        held = stored(postings.groupBy(ROW, PART).agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select(ROW, PART), "held")
        parts = [r[0] for r in held.select(PART).distinct().collect()]  # at most ``parts``
        near = self._read("rows", PART, parts).join(held.select(ROW), ROW, "left_semi")
        return text_search(near, query, self.columns).drop(ROW, PART)
