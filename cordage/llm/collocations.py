"""Collocations: phrases that hold together, mined with suffix automata of shards.

A shard is half a million characters of texts. Its generalised suffix automaton,
bounded at the longest phrase, has a state for each class of phrases that end at
the same places: it holds the longest of them, the number of places, and how long
the phrases of its suffix link are, beyond which the class begins. Every phrase of
the shard is thus enumerated once with its count, and Spark sums the counts.

Counts by hash come first and only tell which phrases can be frequent: words and
pairs, then triples of which both pairs (the link and the state before) are. A last
pass counts the phrases that remain by their letters, so results are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bitmap, discard, in_bitmap, positions, written
from .text import code_points, give_back, gram_hashes, lower_ascii, mix, runs, span_hashes

SHARD = 1 << 19
BITS = 21  # of a word's number in its shard, which holds at most SHARD / 2 words unless one text does
HASH_SCHEMA = "key long, n long"
PHRASE_SCHEMA = "lang string, size int, phrase string, n long"
_U = np.uint64
#: 1 for a space or tab, 2 for what ends a piece, 0 for all else.
_KIND = np.zeros(128, dtype=np.uint8)
_KIND[[9, 32]] = 1
_KIND[[ord(c) for c in ".,;:!?\n\v\f\r"]] = 2


class States(NamedTuple):
    """States of an automaton: the longest phrase's words (last first, packed), its length, its link's length, its places."""

    words: np.ndarray
    length: np.ndarray
    link: np.ndarray
    places: np.ndarray


def suffix_states(ends: np.ndarray, depth: int, bits: int = BITS) -> States:
    """The states of the automaton of a shard, up to phrases of ``depth`` words.

    ``ends`` has, for each place, the number of its word and of the words before it,
    ``bits`` bits each from the high end; 0 where the piece begins. Phrases with
    the same last words are neighbours once sorted, so each run is a phrase, and a
    phrase that has but one word before it shares the state of the longer phrase.
    """
    ends = np.sort(ends)
    out, low, places = [], np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
    levels = []
    for d in range(1, depth + 1):
        head = ends >> _U(bits * (depth - d))
        at = np.flatnonzero(np.concatenate([np.ones(min(1, len(ends)), bool), head[1:] != head[:-1]]))
        n = np.diff(np.append(at, len(ends)))
        real = (head[at] & _U((1 << bits) - 1)) != 0
        at, n = at[real], n[real]
        same = places[at] == n if d > 1 else np.zeros(len(at), bool)  # the shorter phrase ends nowhere else
        low[at] = np.where(same, low[at], d - 1)
        places[at] = n
        levels.append((d, at, n, low[at]))
        if d > 1:
            _, before, m, link = levels[-2]
            longer = np.zeros(len(ends), np.int64)
            longer[at] = n
            top = longer[before] != m
            out.append((ends[before[top]], np.full(top.sum(), d - 1), link[top], m[top]))
    d, at, n, link = levels[-1]
    out.append((ends[at], np.full(len(at), d), link, n))
    return States(*(np.concatenate(x) for x in zip(*out, strict=True)))


class Shard:
    """Words of some texts, numbered from 1, and the states of their automaton."""

    def __init__(self, texts: list[str], langs: list[str], depth: int):
        points, offsets = code_points(texts)
        self.points = lower_ascii(points)
        kind = _KIND[np.minimum(self.points, 127)]
        starts, ends, first = runs(kind == 0, offsets)
        of = np.repeat(np.arange(len(texts)), np.diff(first))
        piece = np.cumsum(kind == 2, dtype=np.int64)[starts]
        joined = np.zeros(len(starts), bool)
        joined[1:] = (of[1:] == of[:-1]) & (piece[1:] == piece[:-1])
        self.langs = sorted(set(langs))
        number = {lang: i for i, lang in enumerate(self.langs)}
        lang = np.array([number[x] for x in langs], np.int64)
        self.words_of = np.bincount(lang, weights=np.diff(first), minlength=len(self.langs)).astype(np.int64)
        salt = np.array([int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for x in self.langs], _U)
        hashes = mix(span_hashes(self.points, starts, ends) ^ salt[lang][of])
        self.hashes, at, ids = np.unique(hashes, return_index=True, return_inverse=True)
        self.bits = max(BITS, (len(self.hashes) + 1).bit_length())  # more than 21 only for one text over a shard's size
        if self.bits * depth > 64:
            raise ValueError("a text has too many different words for phrases of this length")
        self.starts, self.ends, self.lang = starts[at], ends[at], lang[of[at]]
        self.depth = depth
        number, inside, ends = (ids + 1).astype(_U), np.ones(len(ids), bool), np.zeros(len(ids), _U)
        for d in range(depth):
            before = np.zeros(len(ids), _U)
            before[d:] = number[: len(ids) - d]
            ends = (ends << _U(self.bits)) | np.where(inside, before, _U(0))
            inside = inside & np.concatenate([np.zeros(min(d + 1, len(ids)), bool), joined[1 : len(ids) - d]]) if len(ids) > d + 1 else np.zeros(len(ids), bool)
        self.states = suffix_states(ends, depth, self.bits)

    def phrases(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers (from 0, in reading order) of all phrases of ``size`` words, and their counts: those of the states that hold one."""
        s = self.states
        of = (s.link < size) & (size <= s.length)
        mask = _U((1 << self.bits) - 1)
        words = [(s.words[of] >> _U(self.bits * (self.depth - size + j))) & mask for j in range(size)]  # the first word lies lowest
        return np.stack(words, axis=1).astype(np.int64).reshape(-1, size) - 1, s.places[of]

    def keys(self, words: np.ndarray) -> np.ndarray:
        """A hash of each phrase and its language."""
        size = words.shape[1]
        return gram_hashes(self.hashes[words].reshape(-1), size)[::size]

    def spelling(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of the ``wanted`` words, a space after each, and where each word (by number) begins and how long it is."""
        text = self.points.tobytes().decode("utf-32-le", "surrogatepass")
        spelt = [text[a:b].encode("utf-8", "replace") for a, b in zip(self.starts[wanted].tolist(), self.ends[wanted].tolist(), strict=True)]
        size, at = np.zeros(len(self.starts), np.int64), np.zeros(len(self.starts), np.int64)
        size[wanted] = np.fromiter(map(len, spelt), np.int64, len(spelt)) + 1
        at[wanted] = np.cumsum(size[wanted]) - size[wanted]
        return np.frombuffer(b" ".join(spelt) + b" ", np.uint8), at, size


def letters(words: np.ndarray, blob: np.ndarray, at: np.ndarray, size: np.ndarray) -> pa.Array:
    """Phrases as text, words joined by a space, from their ``spelling``."""
    long, spans = size[words], at[words].reshape(-1)
    flat = long.reshape(-1)
    ends = np.cumsum(flat)
    taken = blob[np.repeat(spans - (ends - flat), flat) + np.arange(ends[-1] if len(ends) else 0)]
    bounds = np.concatenate([[0], np.cumsum(long.sum(axis=1))])
    keep = np.ones(len(taken), bool)
    keep[bounds[1:] - 1] = False  # the space after each last word
    offsets = (bounds - np.arange(len(bounds))).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(words), pa.py_buffer(offsets.tobytes()), pa.py_buffer(taken[keep].tobytes())).cast(pa.string())


def _shards(batches: Iterator[pa.RecordBatch], depth: int, most: int = SHARD) -> Iterator[Shard]:
    texts, langs, size = [], [], 0
    for batch in batches:
        text, lang = batch.column("text"), batch.column("lang")
        for i in range(len(text)):
            if one := text[i].as_py():
                if texts and size + len(one) > most:
                    yield Shard(texts, langs, depth)
                    texts, langs, size = [], [], 0
                texts.append(one)
                langs.append(lang[i].as_py())
                size += len(one)
    if texts:
        yield Shard(texts, langs, depth)
    del texts
    give_back()


def _hashed(sizes: list[int], known: np.ndarray | None):
    """Hash and count of the phrases of ``sizes`` in each shard, if both phrases one word shorter are ``known``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, max(sizes)):
            for size in sizes:
                words, n = shard.phrases(size)
                if known is not None:
                    may = in_bitmap(known, shard.keys(words[:, 1:])) & in_bitmap(known, shard.keys(words[:, :-1]))
                    words, n = words[may], n[may]
                keys = shard.keys(words)
                for at in range(0, len(keys), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + (1 << 16)].view(np.int64)), pa.array(n[at : at + (1 << 16)])], names=["key", "n"])

    return run


def _spelt(longest: int, known: np.ndarray):
    """Phrases whose hash is ``known``, by letters, and a row of size 0 for all words of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, longest):
            langs = pa.array(shard.langs)
            none = pa.array([""] * len(langs))
            yield pa.RecordBatch.from_arrays([langs, pa.array(np.zeros(len(langs), np.int32)), none, pa.array(shard.words_of)], names=["lang", "size", "phrase", "n"])
            found = []
            for size in range(1, longest + 1):
                words, n = shard.phrases(size)
                may = in_bitmap(known, shard.keys(words))
                found.append((size, words[may], n[may]))
            spelling = shard.spelling(np.unique(np.concatenate([words.reshape(-1) for _, words, _ in found])))
            for size, words, n in found:
                for at in range(0, len(n), 1 << 16):
                    part = words[at : at + (1 << 16)]
                    langs_of = langs.take(pa.array(shard.lang[part[:, 0]]))
                    yield pa.RecordBatch.from_arrays([langs_of, pa.array(np.full(len(part), size, np.int32)), letters(part, *spelling), pa.array(n[at : at + (1 << 16)])], names=["lang", "size", "phrase", "n"])

    return run


def phrase_counts(docs: DataFrame, least: int = 10, longest: int = 3) -> DataFrame:
    """``lang``, ``size``, ``phrase``, ``n`` of all phrases of up to ``longest`` words that occur ``least`` times in a language.

    Texts are lower-cased (A-Z) and cut into pieces at ``.,;:!?`` and line ends, and
    pieces into words at spaces and tabs. A row of size 0 has the number of all
    words of a language. A null language is ``und``; null and empty texts hold
    nothing; repeated rows count each time; other columns are ignored.
    """
    if longest not in (2, 3):
        raise ValueError("phrases have two or three words at most")
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    frequent = lambda sizes, known: written(texts.mapInArrow(_hashed(sizes, known), HASH_SCHEMA).groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "frequent")
    found = [frequent([1, 2], None)]
    if longest == 3:
        found.append(frequent([3], bitmap(found[0], "key")))
    known = bitmap(reduce(DataFrame.union, found), "key")
    discard(*found)
    counts = texts.mapInArrow(_spelt(longest, known), PHRASE_SCHEMA).groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))
    return written(counts.where((F.col("n") >= least) | (F.col("size") == 0)), "phrases")


def score(a: str, l: str, r: str) -> Column:  # noqa: E741
    """``floor(10**6 * a * a / (l * r))`` in whole decimals of up to 38 digits: exact for counts under 10**16."""
    return F.expr(f"cast(1000000 * cast(cast({a} AS decimal(16,0)) * cast({a} AS decimal(16,0)) AS decimal(32,0)) AS decimal(38,0)) div (cast({l} AS decimal(19,0)) * cast({r} AS decimal(19,0)))")


def collocations(docs: DataFrame, least: int = 10, longest: int = 3, top: int = 2000, subsumed: int = 50) -> DataFrame:
    """The first ``top`` phrases of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    A candidate has two words or more and occurs ``a >= least`` times. Its score is
    ``floor(10**6 * a * a / (l * r))`` of its worst cut, where ``l`` and ``r`` are the
    counts of what lies before and after the cut; of equal cuts the first is
    taken. A candidate goes if a longer one that contains it occurs at least
    ``subsumed`` per cent as often: one that is a word longer tells, as counts only fall with
    length. Order: score and count falling, then the phrase's bytes.

    Texts as in ``phrase_counts``; without words there are no rows. Ranks come from a range
    partitioning of all candidates, so no task holds a language.
    """
    counts = phrase_counts(docs, least, longest)
    words = F.split("phrase", " ")
    candidates = counts.where("size >= 2").select("lang", "phrase", F.col("n").alias("a"), "size", words.alias("w"))
    part = lambda a, b: F.array_join(F.slice("w", a, b), " ")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    known = counts.where("size >= 1")
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    cuts = cuts.withColumn("score", score("a", "l", "r"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # of a longer candidate: its suffix link, and the state before its last word
    inside = candidates.where("size > 2").select("lang", "a", F.explode(F.array(part(F.lit(2), F.col("size") - 1), part(F.lit(1), F.col("size") - 1))).alias("phrase"))
    longer = inside.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("most") < subsumed * F.col("a"), F.lit(True)))
    kept = kept.select("lang", "phrase", "a", "cut.score", "cut.l", "cut.r")
    placed = positions(kept, "lang", F.desc("score"), F.desc("a"), "phrase")
    begins = placed.groupBy(F.col("lang").alias("__lang")).agg(F.min("position").alias("__first"))
    total = counts.where("size = 0").select(F.col("lang").alias("__of"), "n")
    ranked = placed.join(begins, F.col("lang") == F.col("__lang")).withColumn("rank", F.col("position") - F.col("__first") + 1).where(F.col("rank") <= top)
    return ranked.join(total, F.col("lang") == F.col("__of")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
