"""Secret scans by DataFrame functions only: patterns propose, a random forest removes false positives.

Known key formats, other tokens of 20 signs or more if they have a digit, and
shorter values that a secret word names are candidates. The forest judges a
candidate's length, the likelihood of its character transitions, how much of it
frequent words of the corpus cover, whether it stands in a path, and the words
near it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import written

# Formats of known keys, by kind.
KNOWN = {
    "aws": r"AKIA[0-9A-Z]{16}",
    "github": r"gh[pousr]_[A-Za-z0-9]{36,251}",
    "slack": r"xox[abeprs]-[A-Za-z0-9-]{10,250}",
    "google": r"AIza[0-9A-Za-z_-]{35}",
    "api": r"sk[-_](?:live_|test_|ant-|proj-)?[A-Za-z0-9_-]{20,250}",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,2000}\.[A-Za-z0-9_-]{8,4000}\.[A-Za-z0-9_-]{8,1000}",
    "key_block": r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[A-Za-z0-9+/=:,\s-]{0,20000}?-----END [A-Z ]{0,40}PRIVATE KEY-----)?",
}
# Words that name a secret to which a value is assigned.
NAMES = "password|passwd|passphrase|pwd|secret|token|api_?key|access_?key"
TOKEN = rf"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z0-9_+/=-]{{20}})(?![A-Za-z0-9_]*(?i:{NAMES})=)[A-Za-z0-9_+/=-]{{20,}}"
_LINK = r"""["']?[ \t]{0,3}[=:][ \t]{0,3}["'`]?"""
_SIGN = r"""[^\s"'`<>,;=:]"""
#: What is assigned to such a word. The first two conditions, which cost little, spare most places the third.
VALUE = rf"""(?<=[=:"'`\s])(?<=[=:][ \t]{{0,3}}["'`]?)(?<=(?i:{NAMES}){_LINK}){_SIGN}{{8,}}"""
ASSIGNED = f"(?i:{NAMES}){_LINK}$"
PATTERN = "|".join([*KNOWN.values(), TOKEN, VALUE])
# How texts with a known key look at least, a known key or a value that ends a token after a name, and what makes a match a candidate.
OPENINGS = ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "AIza", "sk-", "sk_", "eyJ", "-----BEGIN")
NAMED = f"^(?:[^=]*=({'|'.join(KNOWN.values())})|[^=]*(?i:{NAMES})[A-Za-z0-9_]{{0,10}}=([^=].{{7,}}))$"
PROPOSED = f"[0-9]|(?:^|=)(?:{'|'.join(KNOWN.values())})$"
# Words near a candidate that speak for or against a secret.
FOR = r"(?i)(token|secret|passw|pwd|api.?key|access.?key|auth|bearer|credential|private)"
AGAINST = r"(?i)(commit|sha.?1|sha.?256|md5|checksum|digest|hash|uuid|guid|revision|example|placeholder|isbn|order|invoice|tracking)"
NEAR = 40
BUCKETS = 64
#: The letters of a transition: small ones as they are, all digits, all capitals, and all else.
LETTERS = "abcdefghijklmnopqrstuvwxyz0A."
NUMBERS = ["length", "changes", "kinds", "variety", "digits", "uppers", "hexadecimal", "transitions", "dictionary", "path", "near_for", "near_against", "assigned", "quoted", "known"]


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_key``, ``start``, ``end``, ``candidate`` and the text ``before`` and ``after`` it.

    Rows with equal id and text are one. A known format counts with or without a
    digit, and so does a value of 8 signs or more that is assigned to a word such
    as ``password``, both without the name and sign of equality before them; any
    other token of 20 signs needs a digit. Only texts with a digit, the opening
    of a known format or such an assignment are searched in full.
    """
    assigned = F.col("text").rlike(f"(?i:{NAMES}){_LINK}{_SIGN}{{8}}")
    some = reduce(lambda any_, o: any_ | F.contains(F.col("text"), F.lit(o)), OPENINGS, F.col("text").rlike("[0-9]")) | assigned
    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text").where(some)
    cut = keyed.select("doc_id", "text_key", assigned.alias("assigned"), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)).alias("found"), F.split("text", PATTERN).alias("gaps"))
    cut = cut.where(F.exists("found", lambda f: f.rlike(PROPOSED)) | F.col("assigned"))
    parts = F.expr(f"""transform(found, (f, i) -> struct(i AS i, f AS candidate, length(gaps[i]) AS gap,
        right(gaps[i], {NEAR}) AS before, left(gaps[i + 1], {NEAR}) AS after))""")
    rows = cut.select("doc_id", "text_key", parts.alias("parts")).dropDuplicates(["doc_id", "text_key"])
    rows = rows.select("doc_id", "text_key", F.explode("parts").alias("p")).select("doc_id", "text_key", "p.*")
    upto = Window.partitionBy("doc_id", "text_key").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.length("candidate")).over(upto).cast("long"))
    rows = rows.withColumn("key", F.concat(F.regexp_extract("candidate", NAMED, 1), F.regexp_extract("candidate", NAMED, 2)))
    rows = rows.where(F.col("candidate").rlike(PROPOSED) | (F.col("key") != "") | F.col("before").rlike(ASSIGNED))
    name = F.expr("left(candidate, length(candidate) - length(key))")
    rows = rows.withColumn("before", F.when(F.col("key") == "", F.col("before")).otherwise(F.right(F.concat("before", name), F.lit(NEAR))))
    rows = rows.withColumn("candidate", F.when(F.col("key") == "", F.col("candidate")).otherwise(F.col("key")))
    return rows.select("doc_id", "text_key", (F.col("end") - F.length("candidate")).alias("start"), "end", "candidate", "before", "after")


def frequent_words(docs: DataFrame, share: float = 1 / 20000) -> DataFrame:
    """``word`` and ``count`` of the words of 4 to 12 letters that make up at least ``share`` of all such words of ``docs``.

    All texts are counted. There are ``1 / share`` such words at most, whatever the size of the corpus.
    """
    found = F.regexp_extract_all(F.lower("text"), F.lit("(?<!\\p{L})\\p{L}{4,12}(?!\\p{L})"), F.lit(0))
    counts = written(docs.select(F.explode(found).alias("word")).groupBy("word").count(), "words")
    return counts.join(F.broadcast(counts.agg(F.sum("count").alias("all"))), F.col("count") >= F.col("all") * share).select("word", "count")


def _kind(candidate: Column) -> Column:
    return reduce(lambda rest, x: F.when(candidate.rlike(f"^(?:{x[1]})$"), x[0]).otherwise(rest), reversed(KNOWN.items()), F.lit("token"))


def _letters(c: Column) -> Column:
    """Places in ``LETTERS`` of a candidate's signs."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[0-9]", "0"), "[A-Z]", "A"), "[^a-z0A]", ".")
    return F.transform(F.split(plain, ""), lambda x: F.instr(F.lit(LETTERS), x) - 1)


def _transitions(c: Column) -> Column:
    """Numbers of the pairs of neighbouring signs."""
    return F.transform(F.array(F.struct(_letters(c).alias("l"))), lambda x: F.zip_with(F.slice(x["l"], 1, F.greatest(F.size(x["l"]) - 1, F.lit(0))), F.slice(x["l"], 2, F.size(x["l"])), lambda a, b: a * len(LETTERS) + b))[0]


def transition_odds(findings: DataFrame) -> list[float]:
    """For each pair of signs the log of its share in secrets over that in other findings, each pair counted once more than seen."""
    pairs = findings.select("label", F.explode(_transitions(F.coalesce("candidate", F.lit("")))).alias("pair")).groupBy("pair")
    seen = pairs.agg(F.sum("label").alias("yes"), F.sum(1 - F.col("label")).alias("no")).collect()  # a row for each pair of LETTERS at most
    yes, no = sum(r.yes for r in seen) + len(LETTERS) ** 2, sum(r.no for r in seen) + len(LETTERS) ** 2
    odds = [math.log(no / yes)] * len(LETTERS) ** 2
    for r in seen:
        odds[r.pair] = math.log((r.yes + 1) / yes) - math.log((r.no + 1) / no)
    return odds


#: Signs of a candidate that one row of ``covered`` works on.
PIECE = 512


def covered(rows: DataFrame, words: DataFrame) -> DataFrame:
    """``rows`` with ``dictionary``, the share of each candidate's signs that lie in an occurrence of one of ``words`` (``frequent_words``: bounded).

    Candidates are cut into pieces with as many signs around as a word can reach, so rows and bytes follow the
    candidates' lengths: of what is made for each sign only words that are found are shuffled, under the candidate's number.
    """
    texts = written(rows.select("candidate").distinct().withColumn("number", F.monotonically_increasing_id()), "distinct")
    piece = F.explode(F.expr(f"sequence(0, cast((greatest(length(candidate), 1) - 1) div {PIECE} as int))"))
    # a word that covers a sign of a piece begins at most 11 signs before it
    cut = texts.select("number", "candidate", piece.alias("piece")).selectExpr("number", "piece", f"greatest(0, piece * {PIECE} - 11) AS base", f"substr(candidate, greatest(0, piece * {PIECE} - 11) + 1, {PIECE} + 22) AS part")
    starts = cut.select("number", "piece", "base", F.explode(F.expr("transform(sequence(1, length(part)), p -> struct(p AS p, lower(substr(part, p, 12)) AS long))")).alias("s"))
    spans = starts.select("number", "piece", (F.col("base") + F.col("s.p") - 1).alias("at"), F.explode(F.expr("transform(sequence(4, length(s.long)), n -> left(s.long, n))")).alias("word")).where("length(word) between 4 and 12")
    found = spans.join(F.broadcast(words.select("word")), "word").groupBy("number", "piece").agg(F.array_sort(F.collect_set(F.struct("at", F.length("word").alias("n")))).alias("spans"))
    signs = F.expr(f"""aggregate(spans, named_struct('upto', piece * {PIECE}, 'n', 0), (s, w) -> named_struct('upto', greatest(s.upto, least(w.at + w.n, (piece + 1) * {PIECE})),
        'n', s.n + greatest(0, least(w.at + w.n, (piece + 1) * {PIECE}) - greatest(w.at, s.upto))), s -> s.n)""")
    counts = found.select("number", signs.alias("signs")).groupBy("number").agg(F.sum("signs").alias("signs"))
    shares = texts.join(counts, "number", "left").select("candidate", (F.coalesce("signs", F.lit(0)) / F.greatest(F.length("candidate"), F.lit(1))).alias("dictionary"))
    return rows.join(shares, "candidate")


def described(rows: DataFrame, words: DataFrame, odds: list[float]) -> DataFrame:
    """``rows`` of candidates with their kind and ``features``; nulls count as empty text."""
    rows = covered(rows.fillna("", ["candidate", "before", "after"]), words)
    c, before, after = F.col("candidate"), F.col("before"), F.col("after")
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[0-9]", "\u0001"), "[a-z]", "\u0002"), "[A-Z]", "\u0003"), "[^\u0001-\u0003]", "\u0004")
    n = F.greatest(F.length(c), F.lit(1)).cast("double")
    share = lambda pattern: (F.length(c) - F.length(F.regexp_replace(c, pattern, ""))) / n
    table = F.lit(odds).cast("array<double>")
    mean = F.aggregate(_transitions(c), F.lit(0.0), lambda s, x: s + F.get(table, x)) / F.greatest(n - 1, F.lit(1.0))
    near = F.concat(F.transform(F.slice(F.reverse(F.regexp_extract_all(F.lower(before), F.lit("\\p{L}+"), F.lit(0))), 1, 3), lambda w: F.concat(F.lit("<"), w)), F.transform(F.slice(F.regexp_extract_all(F.lower(after), F.lit("\\p{L}+"), F.lit(0)), 1, 2), lambda w: F.concat(F.lit(">"), w)))
    rows = rows.withColumns(
        {
            "kind": _kind(c),
            "length": F.length(c).cast("double"),
            "changes": (F.length(F.regexp_replace(classes, r"(.)\1*", "x")) - 1) / n,
            "kinds": F.size(F.array_distinct(F.split(classes, ""))).cast("double"),
            "variety": F.size(F.array_distinct(F.split(F.lower(c), ""))).cast("double"),
            "digits": share("[0-9]"),
            "uppers": share("[A-Z]"),
            "hexadecimal": share("[0-9a-fA-F]"),
            "transitions": mean,
            "path": (c.rlike("/.*/|^/") | before.rlike(r"[/.\\]$") | after.rlike(r"^[./\\][A-Za-z]")).cast("double"),
            "near_for": before.rlike(FOR).cast("double"),
            "near_against": before.rlike(AGAINST).cast("double"),
            "assigned": before.rlike(r"""[:=]\s*["'`]?$""").cast("double"),
            "quoted": before.rlike("""["'`]$""").cast("double"),
            "known": (_kind(c) != "token").cast("double"),
            "near": near,
        }
    )
    rows = HashingTF(numFeatures=BUCKETS, binary=True, inputCol="near", outputCol="words_near").transform(rows)
    return VectorAssembler(inputCols=[*NUMBERS, "words_near"], outputCol="features").transform(rows)


# Ordinary words of made findings, where no corpus gives its own.
ORDINARY = "about after again between could every first found great group house large later light might never number other people place point right should small sound still study their there these thing think under water where which while world would write version sample index value name user data page item image file code block class public static example".split()


def labelled_findings(spark: SparkSession, n: int = 4000, words: list[str] | None = None) -> DataFrame:
    """Labelled findings to train on: ``candidate``, ``before``, ``after``, ``label`` (1 secret, 0 not).

    No table of findings is given, so ``n`` rows are made from hashes of their
    numbers and from ``words``, in the ways keys, passwords, digests, numbers,
    paths and long words are written. A caller with findings of its own passes those instead.
    """
    rows = spark.range(n).withColumn("k", F.expr("cast(pmod(hash(id, 1), 14) as int)")).withColumn("words", F.lit(words or ORDINARY))
    word = "words[cast(pmod(hash(id, {0}), size(words)) as int)]"
    hex40, hex64, b64 = "sha1(cast(id as string))", "sha2(cast(id as string), 256)", "regexp_replace(base64(unhex(sha2(cast(id as string), 256))), '[+/=]', '')"
    say = "element_at(array({0}), 1 + cast(pmod(hash(id, {1}), size(array({0}))) as int))"
    names = "'token', 'secret', 'api_key', 'password', 'access_key', 'auth', 'private_key'"
    others = "'commit', 'sha1', 'checksum', 'md5', 'digest', 'hash', 'uuid', 'order', 'tracking', 'invoice'"
    link = say.format("' = \"', ': ', '=', ' is ', ': \"', ' = '", 2)
    text = f"concat({word.format(3)}, ' ', {word.format(4)}, ' ')"
    candidate = f"""case k when 0 then {hex40} when 1 then {b64} when 2 then left({hex64}, 24 + cast(pmod(hash(id, 5), 40) as int))
        when 3 then concat('AKIA', upper(left({hex40}, 16))) when 4 then concat('ghp_', left({b64}, 36)) when 5 then left({b64}, 22 + cast(pmod(hash(id, 6), 18) as int))
        when 6 then {hex40} when 7 then concat({word.format(7)}, '-', {word.format(8)}, '-', cast(pmod(hash(id, 9), 1000) as string), '-', {word.format(10)})
        when 8 then concat(regexp_replace({hex64}, '[a-f]', ''), '00000000000000000000') when 9 then concat(left({hex40}, 8), '-', substr({hex40}, 9, 4), '-4', substr({hex40}, 14, 3), '-a', substr({hex40}, 17, 3), '-', substr({hex40}, 20, 12))
        when 10 then concat('/', {word.format(11)}, '/', {word.format(12)}, cast(pmod(hash(id, 13), 100) as string), '/', {word.format(14)})
        when 11 then concat({word.format(15)}, {word.format(16)}, {word.format(17)}, cast(pmod(hash(id, 18), 10) as string))
        when 12 then case pmod(hash(id, 25), 3) when 0 then left({b64}, 8 + cast(pmod(hash(id, 26), 10) as int))
            when 1 then concat({word.format(27)}, cast(pmod(hash(id, 28), 9000) + 10 as string), {say.format("'!', 'xyz', '#', '', 'Qz'", 29)})
            else concat({word.format(27)}, cast(pmod(hash(id, 28), 90) as string), {word.format(37)}, {say.format("'!', '#', '$', '_', '%'", 29)}, {word.format(38)}) end
        else concat({word.format(30)}, if(pmod(hash(id, 31), 2) = 0, concat({say.format("'', '_', '.', '()', '-'", 32)}, {word.format(33)}), '')) end"""
    secret = "(k < 6 or k = 12)"
    before = f"""case when k in (12, 13) then concat({text}, {say.format("'token', 'secret', 'password', 'pwd', 'passwd'", 34)}, {say.format("' = \"', ': ', '=', ': \"', ' = '", 35)})
        when {secret} then concat({text}, if(pmod(hash(id, 19), 10) < 8, concat({say.format(names, 20)}, {link}), ''))
        when k in (6, 8, 9) then concat({text}, {say.format(others, 21)}, {say.format("' ', ': ', ' = '", 22)})
        else concat({text}, if(pmod(hash(id, 23), 8) = 0, {link}, '')) end"""
    after = f"concat({say.format(chr(39) + chr(34) + ' ' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + '. ' + chr(39), 24)}, {word.format(36)})"
    return rows.select(F.expr(candidate).alias("candidate"), F.expr(before).alias("before"), F.expr(after).alias("after"), F.expr(f"if({secret}, 1.0D, 0.0D)").alias("label"))


@dataclass
class Scanner:
    """The frequent words and transition odds that features need, and the forest that judges them."""

    words: DataFrame
    odds: list[float]
    forest: RandomForestClassificationModel

    def judged(self, rows: DataFrame) -> DataFrame:
        """``rows`` of candidates with ``kind`` and ``score``, the forest's probability of a secret."""
        scored = self.forest.transform(described(rows, self.words, self.odds))
        return scored.withColumn("score", F.round(vector_to_array("probability")[1], 6))


def train(findings: DataFrame, words: DataFrame, trees: int = 24, depth: int = 8, seed: int = 7) -> Scanner:
    """A random forest on labelled findings (``candidate``, ``before``, ``after``, ``label``; other labels than 0 and 1 are left out)."""
    rows = findings.where("label in (0, 1)").withColumn("label", F.col("label").cast("double"))
    odds = transition_odds(rows)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.8, featureSubsetStrategy="onethird")
    inputs = written(described(rows, words, odds).select("features", "label"), "inputs")  # the fit reads them several times
    return Scanner(words, odds, forest.fit(inputs))


def trained_on(docs: DataFrame) -> Scanner:
    """A scanner with the frequent words of ``docs``, trained on made findings that use the 200 most frequent of them."""
    words = written(frequent_words(docs), "dictionary")
    most = [r.word for r in words.orderBy(F.desc("count"), "word").limit(200).collect()]
    return train(labelled_findings(docs.sparkSession, words=most), words)


def scan_secrets(docs: DataFrame, model: Scanner | None = None, threshold: float = 0.5) -> DataFrame:
    """Each candidate of each whole text with its ``score`` and ``is_secret``.

    Returns ``doc_id``, ``text_key`` (``xxhash64`` of the text), ``start``, ``end`` (code points, end exclusive), ``kind``,
    ``candidate``, ``score`` and ``is_secret``. A null or empty text has none,
    rows with equal id and text count once, a null ``doc_id`` stays null, and no
    rows give none. Other columns are ignored. Without a ``model`` one is
    trained by ``trained_on``.
    """
    rows = (model or trained_on(docs)).judged(written(candidates(docs), "candidates"))
    return rows.select("doc_id", "text_key", "start", "end", "kind", "candidate", "score", (F.col("score") >= threshold).alias("is_secret"))


def redact_secrets(docs: DataFrame, model: Scanner | None = None, threshold: float = 0.5, mark: str = "[SECRET]") -> DataFrame:
    """``docs``, all columns and rows, with every span judged a secret replaced by ``mark`` and ``n_chars``, where there is one, counted again.

    Spans belong to an id and a text, so rows that share an id keep their own; a
    row without an id is found by its text. Null and empty texts stay, repeated
    rows are treated alike, and no rows give none.
    """
    found = scan_secrets(docs.select("doc_id", "text"), model, threshold).where("is_secret")
    spans = found.groupBy(F.coalesce("doc_id", F.lit(-1)).alias("__id"), F.col("doc_id").isNull().alias("__none"), F.col("text_key").alias("__key"))
    spans = written(spans.agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__spans")), "secrets")
    ident = F.col("doc_id").cast("long")
    joined = docs.join(spans, (F.coalesce(ident, F.lit(-1)) == F.col("__id")) & (ident.isNull() == F.col("__none")) & (F.xxhash64("text") == F.col("__key")), "left")
    cut = f"""aggregate(__spans, named_struct('out', '', 'at', 0L),
        (s, x) -> named_struct('out', concat(s.out, substr(text, cast(s.at as int) + 1, cast(x.start - s.at as int)), '{mark}'), 'at', x.end), s -> concat(s.out, substr(text, cast(s.at as int) + 1)))"""
    out = joined.withColumn("text", F.expr(f"if(__spans is null, text, {cut})"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
