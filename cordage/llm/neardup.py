"""Near-duplicate documents by a chosen-path similarity join on shingle sets.

Each distinct shingle set follows the paths of independent trees: a node is a
sequence of minwise coordinates and the values that the set has there, so two
sets of similarity J share a step with probability J. Nodes with few sets are
compared exhaustively. In a larger one all sets are compared with one leader,
which joins whole groups of copies with as many pairs as sets. Only what stays
apart from it is compared further, with all sets of the node: at once where that
is a block's work, else the node branches on further coordinates until it is, or
until the path ends. Every link is confirmed on full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bitmap, connected_components, discard, in_bitmap, small_side, written
from .text import chunks, code_points, gram_hashes, lower_ascii, mix, span_hashes, spaced_words

COORDINATES = 64
SKETCH_SCHEMA = "doc_id long, n_shingles long, set_a long, set_b long, sketch binary"
MEMBER = ["rep", "n", "root", "out"]
MEMBER_SCHEMA = "rep long, n long, root long, out boolean"
_MULTIPLIERS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)
_MASKS = mix(np.arange(1001, COORDINATES + 1001, dtype=np.uint64))


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """Sorted hashes of the distinct k-word shingles of each text."""
    points, offsets = code_points(texts)
    points = lower_ascii(points)
    starts, ends, first = spaced_words(points, offsets)
    words = span_hashes(points, starts, ends)
    grams = gram_hashes(words, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        out.append(np.unique(grams[a : b - k + 1]) if b - a >= k else gram_hashes(words[a:b], b - a) if b > a else grams[:0])
    return out


def minwise(flat: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A row of minwise values for each (non-empty) run of ``flat`` that starts at ``begin``."""
    out = np.empty((len(begin), COORDINATES), dtype=np.uint32)
    for i in range(COORDINATES):
        out[:, i] = np.minimum.reduceat((((flat ^ _MASKS[i]) * _MULTIPLIERS[i]) >> np.uint64(32)).astype(np.uint32), begin)
    return out


def _sketcher(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(batch.column("text")):
                sets = shingle_sets(texts, k)
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                full = np.flatnonzero(sizes)
                a, b = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
                sketches: list[bytes | None] = [None] * len(sets)
                if len(full):
                    flat = np.concatenate([sets[i] for i in full])
                    begin = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                    a[full] = np.add.reduceat(mix(flat), begin)
                    b[full] = np.add.reduceat(mix(flat ^ np.uint64(0xA5A5A5A5A5A5A5A5)), begin)
                    for i, row in zip(full.tolist(), minwise(flat, begin)):
                        sketches[i] = row.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, len(texts)),
                        pa.array(sizes, pa.int64()),
                        pa.array(a.astype(np.int64)),
                        pa.array(b.astype(np.int64)),
                        pa.array(sketches, pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "sketch"],
                )

    return run


def _sketch_array(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, COORDINATES)


def _roots(trees: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketch = _sketch_array(batch.column("sketch")).astype(np.uint64)
            for tree in range(trees):
                i, j = (2 * tree) % COORDINATES, (2 * tree + 1) % COORDINATES
                node = mix(mix(sketch[:, i] + np.uint64(tree << 40)) + sketch[:, j])
                yield pa.RecordBatch.from_arrays([pa.array(node.astype(np.int64)), batch.column("rep"), batch.column("n_shingles")], names=["node", "rep", "n"])

    return run


def _subtrees(branch: int, levels: int):
    """The nodes that a set reaches below each node: ``branch`` of the next level, then ``branch`` of each of these, and so on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketch, row = _sketch_array(batch.column("sketch")), np.arange(batch.num_rows)
            above, found = [batch.column("node").to_numpy().astype(np.uint64)], []
            for level in range(levels):
                reached = []
                for node in above:
                    for child in range(branch):
                        chosen = mix(node + np.uint64(level * 64 + child + 1))  # all sets of a node choose alike
                        at = (chosen % np.uint64(COORDINATES)).astype(np.int64)
                        reached.append(mix(chosen + sketch[row, at].astype(np.uint64)))
                found += reached
                above = reached
            below = pa.array(np.stack(found, axis=1).astype(np.int64).ravel())
            cuts = pa.array(np.arange(batch.num_rows + 1) * len(found), pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in MEMBER), pa.ListArray.from_arrays(cuts, below)], names=[*MEMBER, "below"])

    return run


def _children(rows: DataFrame, branch: int, levels: int) -> DataFrame:
    """A row for each node of the next level, with what is below it, from ``below`` of that many ``levels``."""
    offset = [sum(branch**u for u in range(1, t)) for t in range(1, levels + 1)]
    parts = lambda c: ", ".join(f"slice(below, {offset[t] + c * branch**t + 1}, {branch**t})" for t in range(1, levels)) or "cast(array() AS array<bigint>)"
    kids = ", ".join(f"named_struct('node', below[{c}], 'below', concat({parts(c)}))" for c in range(branch))
    return rows.select(*MEMBER, F.expr(f"array({kids})").alias("kids")).select(*MEMBER, F.explode("kids").alias("kid")).select("kid.node", *MEMBER, "kid.below")


def _likely(least: int):
    """Drops pairs whose sketches agree too seldom, or whose sizes rule a link out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            agree = (_sketch_array(batch.column("sketch_a")) == _sketch_array(batch.column("sketch_b"))).sum(axis=1)
            keep = pa.array(agree >= least)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], names=["a", "b"])

    return run


def _set_reader(wanted: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("doc_id")
            near = pa.array(in_bitmap(wanted, keys.fill_null(0).to_numpy(zero_copy_only=False)))
            ids, texts = keys.filter(near), batch.column("text").filter(near)
            for at, part in chunks(texts):
                sets = shingle_sets(part, k)
                cuts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                values = pa.array(np.concatenate(sets).astype(np.int64))
                key = [int(mix(s).sum().astype(np.int64)) if len(s) else 0 for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(part)), pa.array(key, pa.int64()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), values)],
                    names=["doc_id", "set_a", "shingles"],
                )

    return run


def _shared_counts(x: list[np.ndarray], y: list[np.ndarray], width: int = 2048) -> np.ndarray:
    """How many keys each of ``x`` shares with each of ``y``, by products of ``width`` keys at a time."""
    sides = []
    common = np.intersect1d(np.concatenate(x), np.concatenate(y))
    for sets in (x, y):
        flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), list(map(len, sets)))
        at = np.minimum(np.searchsorted(common, flat), max(len(common) - 1, 0))
        known = common[at] == flat if len(common) else np.zeros(len(flat), dtype=bool)
        order = np.argsort(at[known], kind="stable")
        sides.append((row[known][order], at[known][order], len(sets)))
    out = np.zeros((len(x), len(y)), dtype=np.float32)
    for low in range(0, len(common), width):
        held = []
        for row, at, n in sides:
            cut = slice(*np.searchsorted(at, [low, low + width]))
            held.append(np.bincount(row[cut] * width + at[cut] - low, minlength=n * width).reshape(n, width).astype(np.float32))
        out += held[0] @ held[1].T
    return out.astype(np.int64)


def _blocks_apart(percent: int):
    """Links of one block pair of a node that join different groups, the closest first, and no more than join them."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf.side == 0], pdf[pdf.side == 1]
        out: list[tuple[int, int]] = []
        if len(left) and len(right):
            sizes = np.add.outer(left["n"].to_numpy(), right["n"].to_numpy())
            surplus = (100 + percent) * _shared_counts(left["shingles"].to_list(), right["shingles"].to_list()) - percent * sizes
            root_x, root_y = left["root"].to_numpy(), right["root"].to_numpy()
            i, j = np.nonzero((surplus >= 0) & (root_x[:, None] != root_y[None, :]))
            order = np.argsort(-surplus[i, j], kind="stable")
            above: dict[int, int] = {}
            for a, b in zip(i[order].tolist(), j[order].tolist()):
                ends = [int(root_x[a]), int(root_y[b])]
                for e in range(2):
                    while ends[e] in above:
                        ends[e] = above[ends[e]]
                if ends[0] != ends[1]:
                    above[max(ends)] = min(ends)
                    out.append((left.rep.iloc[a], right.rep.iloc[b]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def near_duplicates(
    docs: DataFrame, k: int = 5, percent: int = 80, trees: int = 16, node_size: int = 16, branch: int = 2, depth: int = 4, agree: int | None = None, block: int = 1024
) -> DataFrame:
    """Groups of documents whose sets of ``k``-word shingles have a Jaccard similarity of ``percent`` or more.

    ``docs`` has ``doc_id`` and ``text``. Words are runs of anything but ASCII
    white space, with A-Z in lower case; a text of fewer than ``k`` words has
    its whole sequence as one shingle. A null text, or one without words, has
    an empty set and no link. Links are transitive.

    Returns ``doc_id``, ``n_shingles``, ``component_id`` (the smallest reachable
    id) and ``kept`` (it is its own), a row for each row of ``docs``. Equal sets
    are one class throughout and never paired. A null ``doc_id`` takes the
    component of its class, or null, and is kept only there. A repeated
    ``doc_id`` keeps a row each. Other columns are ignored.

    With the defaults a pair of similarity 0.8 shares no first node, of two
    steps, with a probability of about 8e-8, and none of a large node's branches
    with one of about 4e-7. ``trees`` is at most 32; ``node_size`` bounds
    exhaustive comparison of all pairs, ``block`` the sets on a side of a block,
    and ``depth`` the steps of a path. A node at the end of a path is compared
    in as many blocks as it takes. ``agree`` is the least number of the 64
    minwise values that a pair must share to be confirmed on full sets; by
    default five standard deviations below its expectation.
    """
    j = percent / 100
    least = int(COORDINATES * j - 5 * (COORDINATES * j * (1 - j)) ** 0.5) if agree is None else agree
    source = docs.select(F.col("doc_id").cast("long"), "text")
    rows = written(source.mapInArrow(_sketcher(k), SKETCH_SCHEMA), "sketches")
    key = ["set_a", "set_b"]
    full = rows.where("n_shingles > 0")
    classes = full.groupBy(*key).agg(F.min("doc_id").alias("rep")).where("rep is not null")
    own = full.select(F.col("doc_id").alias("rep"), *key, "n_shingles", "sketch")
    reps = written(own.join(classes, ["rep", *key], "left_semi").dropDuplicates(["rep", *key]).select("rep", "set_a", "n_shingles", "sketch"), "sets")

    nodes = written(reps.select("rep", "n_shingles", "sketch").mapInArrow(_roots(trees), "node long, rep long, n long"), "nodes")
    sizes = written(nodes.groupBy("node").agg(F.count("*").alias("size"), F.min("rep").alias("leader")).where("size > 1"), "sizes")
    sized = written(nodes.join(small_side(sizes), "node"), "sized")  # written as it is, so that adaptive execution may split a hot node
    discard(nodes, sizes)
    small = sized.where(F.col("size") <= node_size).groupBy("node").agg(F.collect_set("rep").alias("reps"))  # at most node_size
    pairs = small.select(F.explode("reps").alias("a"), "reps").select("a", F.explode(F.expr("filter(reps, r -> r > a)")).alias("b"))
    large = sized.where(F.col("size") > node_size).select("node", "leader", "rep", "n")
    edges = _confirmed(source, reps, pairs.union(large.where("rep <> leader").select("leader", "rep")).distinct(), k, percent, least)
    roots = written(connected_components(edges), "roots")

    apart = _apart(large, reps, roots, branch, depth, block)
    if apart is not None:
        sets = _full_sets(source, reps, apart.select("rep").distinct(), k)
        found = _compared(apart, sets, percent, block)
        if not found.isEmpty():
            roots = written(connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(found)), "roots")
        discard(sets, found)
    discard(sized, edges)
    member = rows.select("doc_id", "n_shingles", *key).join(classes, key, "left").join(roots, F.col("rep") == F.col("node"), "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("root", "rep"))
    return member.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def _full_sets(source: DataFrame, reps: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``rep`` and ``shingles`` of the sets of ``wanted`` (distinct ``rep``), built again from the texts."""
    wanted = written(wanted, "wanted")
    sets = source.mapInArrow(_set_reader(bitmap(wanted, "rep"), k), "doc_id long, set_a long, shingles array<long>").withColumnRenamed("doc_id", "rep")
    needed = reps.select("rep", "set_a").join(wanted, "rep", "left_semi")
    sets = sets.dropDuplicates(["rep", "set_a"])  # rows may repeat
    out = written(sets.join(needed, ["rep", "set_a"], "left_semi").select("rep", "shingles"), "shingles")
    discard(wanted)
    return out


def _confirmed(source: DataFrame, reps: DataFrame, pairs: DataFrame, k: int, percent: int, least: int) -> DataFrame:
    """The pairs that are links, by their full sets. Only sets of likely pairs are built again."""
    a = reps.select(F.col("rep").alias("a"), F.col("n_shingles").alias("n_a"), F.col("sketch").alias("sketch_a"))
    b = reps.select(F.col("rep").alias("b"), F.col("n_shingles").alias("n_b"), F.col("sketch").alias("sketch_b"))
    sized = pairs.toDF("a", "b").join(a, "a").join(b, "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    likely = written(sized.select("a", "b", "sketch_a", "sketch_b").mapInArrow(_likely(least), "a long, b long"), "likely")
    sets = _full_sets(source, reps, likely.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), k)
    x, y = (sets.select(F.col("rep").alias(n), F.col("shingles").alias(f"s_{n}")) for n in "ab")
    both = likely.join(x, "a").join(y, "b").withColumn("same", F.size(F.array_intersect("s_a", "s_b")))
    links = written(both.where(f"100 * same >= {percent} * (size(s_a) + size(s_b) - same)").select("a", "b"), "links")
    discard(likely, sets)
    return links


def _apart(large: DataFrame, reps: DataFrame, roots: DataFrame, branch: int, depth: int, block: int) -> DataFrame | None:
    """The sets of large nodes that hold more groups than their leader's; None without such nodes.

    A set is ``out`` if it is in another group than the leader of its first node.
    Two sets that are not out are joined already, so a node's work is each out
    set against all sets. Nodes of more than a block's work branch, and their
    branches without an out set end there. Returns ``node``, ``rep``, ``n``,
    ``root``, ``out`` and the numbers of blocks ``n_all`` and ``n_out``.
    """
    lead = roots.select(F.col("node").alias("leader"), F.col("root").alias("lead"))
    member = large.join(roots.withColumnRenamed("node", "rep"), "rep", "left").join(lead, "leader", "left").withColumn("root", F.coalesce("root", "rep"))
    member = member.select("node", "rep", "n", "root", (F.col("root") != F.coalesce("lead", "leader")).alias("out"))
    parts: list[DataFrame] = []
    for level in range(2, depth + 1):
        member = written(member, "members")
        # as many blocks as keep each side to ``block`` sets and about 1024 shingles for each of them
        blocks = lambda n: F.greatest(F.ceil(F.count(n) / block), F.ceil(F.sum(n) / (block << 10))).cast("int")
        outs = F.when(F.col("out"), F.col("n"))
        sizes = member.groupBy("node").agg(F.count("*").alias("size"), F.count(outs).alias("outs"), blocks(F.col("n")).alias("n_all"), blocks(outs).alias("n_out"))
        sizes = written(sizes.where("outs > 0 and size > 1"), "sizes")
        known = written(member.join(small_side(sizes), "node"), "known")
        discard(member, sizes)
        fits = F.lit(True) if level == depth else F.col("outs") * F.col("size") <= block * block
        parts.append(known.where(fits).select("node", "rep", "n", "root", "out", "n_all", "n_out"))
        rest = known.where(~fits)
        if level == depth or rest.isEmpty():
            break
        if level == 2:  # whole paths, so that sketches are joined once
            rest = rest.select("node", *MEMBER).join(reps.select("rep", "sketch"), "rep")
            rest = rest.mapInArrow(_subtrees(branch, depth - 2), f"{MEMBER_SCHEMA}, below array<long>")
        member = _children(rest, branch, depth - level)
    found = reduce(DataFrame.union, parts)
    return None if found.isEmpty() else found


def _compared(apart: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links of the nodes of ``apart`` on full ``sets``: as many as join groups, and no more than a block pair has groups."""
    at = lambda n, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(n)).cast("int")
    # an outer set goes to its block against all blocks; every set goes to its block against all outer blocks
    outer = F.transform(F.sequence(F.lit(0), F.col("n_all") - 1), lambda j: F.struct(at("n_out", 0).alias("i"), j.alias("j"), F.lit(0).alias("side")))
    every = F.transform(F.sequence(F.lit(0), F.col("n_out") - 1), lambda i: F.struct(i.alias("i"), at("n_all", 1).alias("j"), F.lit(1).alias("side")))
    cells = apart.withColumn("cells", F.concat(F.when(F.col("out"), outer).otherwise(F.slice(outer, 1, 0)), every)).join(sets, "rep")
    cells = cells.select("node", "rep", "root", "n", "shingles", F.explode("cells").alias("cell")).select("node", "cell.*", "rep", "root", "n", "shingles")
    found = cells.groupBy("node", "i", "j").applyInPandas(_blocks_apart(percent), "a long, b long")
    return written(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, **parameters) -> DataFrame:
    """``docs``, all columns, with the document of smallest id of each group of near-duplicates.

    Of rows that repeat a kept id with an equal text one stays. Ids are under
    2**62. A document without an id stays if it is near no document that has one and, among
    equals without an id, once.
    """
    # over 2**62, so that a document with an id is always the smaller one
    ident = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62)))
    groups = written(near_duplicates(docs.select(ident.alias("doc_id"), "text"), k, percent, **parameters), "groups")
    drop = groups.groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept").select(F.col("doc_id").alias("__id"))
    rest = docs.join(written(drop, "dropped"), ident == F.col("__id"), "left_anti")
    twice = written(groups.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__id")), "repeated")
    if twice.isEmpty():
        return rest
    single = rest.join(twice, ident == F.col("__id"), "left_anti")
    several = rest.join(twice, ident == F.col("__id"), "left_semi")
    mark = several.withColumns({"__key": ident, "__text": F.xxhash64("text")})
    return single.unionByName(mark.dropDuplicates(["__key", "__text"]).drop("__key", "__text"))
