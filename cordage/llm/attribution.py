"""Token counts of sections by the offsets of one encoding of the whole document.

Encoding each section alone changes tokens at its ends. Here a document is
encoded once, and token spans are joined to section spans by interval: both are
in order, so each section finds its tokens by two searches. A token that
crosses a boundary is allocated by a rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encode import Encoder, cuts_by_bytes
from .text import chunks, code_points

SCHEMA = "doc_id long, section int, name string, start long, end long, n_tokens double, n_crossing long"
RULES = ("first", "most", "share")


def _line_sections(text: str) -> list[tuple[str | None, int, int]]:
    out, at = [], 0
    for line in text.split("\n"):
        out.append((None, at, at + len(line) + 1))
        at += len(line) + 1
    out[-1] = (None, out[-1][1], len(text))
    return out


def allocate(edges: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of those touching it also reach outside.

    ``edges`` are the byte positions between tokens, with both ends of the text.
    """
    n = len(edges) - 1
    if n < 1:
        return np.zeros(len(starts)), np.zeros(len(starts), dtype=np.int64)
    begin, after = np.searchsorted(edges, starts, "right") - 1, np.searchsorted(edges, ends, "left")
    filled = ends > starts
    cut_left = filled & (begin >= 0) & (begin < n) & (edges[np.clip(begin, 0, n)] < starts)
    cut_right = filled & (after > 0) & (after <= n) & (edges[np.clip(after, 0, n)] > ends)
    one = cut_left & cut_right & (after - begin == 1)
    crossing = cut_left.astype(np.int64) + cut_right - one
    if rule == "share":
        place = lambda at: np.interp(at, edges, np.arange(n + 1.0))
        return np.where(filled, place(ends) - place(starts), 0.0), crossing
    held = np.where(filled, np.searchsorted(edges[:-1], ends) - np.searchsorted(edges[:-1], starts), 0).astype(float)
    if rule == "most":
        for token in np.unique(np.concatenate([begin[cut_left], after[cut_right] - 1])).tolist():
            a, b = edges[token], edges[token + 1]
            overlap = np.minimum(ends, b) - np.maximum(starts, a)
            held -= filled & (starts <= a) & (a < ends)
            if overlap.max() > 0:
                held[int(np.argmax(overlap))] += 1  # the earlier section of equals
    return held, crossing


def _counter(path: str, rule: str, spans: bool):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.for_path(path)
        sizes = encoder.byte_sizes()
        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            given = batch.column("sections").to_pylist() if spans else None
            for at, texts in chunks(batch.column("text")):
                ids, cuts = encoder(texts)
                points, offsets = code_points(texts)
                width = np.concatenate([[0], np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))])
                edges = np.concatenate([[0], np.cumsum(sizes[ids])])
                rows: dict[str, list] = {k: [] for k in ("doc_id", "section", "name", "start", "end", "n_tokens", "n_crossing")}
                for i, text in enumerate(texts):
                    parts = _line_sections(text) if given is None else [(s["name"], s["start"], s["end"]) for s in given[at + i] or () if s]
                    if not parts:
                        continue
                    lo = np.clip([p[1] or 0 for p in parts], 0, len(text))
                    hi = np.maximum(np.clip([len(text) if p[2] is None else p[2] for p in parts], 0, len(text)), lo)
                    own = edges[cuts[i] : cuts[i + 1] + 1]
                    held, crossing = allocate(own, width[offsets[i] + lo], width[offsets[i] + hi], rule)
                    rows["doc_id"] += [keys[at + i]] * len(parts)
                    rows["section"] += range(len(parts))
                    rows["name"] += [p[0] for p in parts]
                    rows["start"] += lo.tolist()
                    rows["end"] += hi.tolist()
                    rows["n_tokens"] += held.tolist()
                    rows["n_crossing"] += crossing.tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rows["doc_id"], pa.int64()),
                        pa.array(rows["section"], pa.int32()),
                        pa.array(rows["name"], pa.string()),
                        *(pa.array(rows[k], pa.int64()) for k in ("start", "end")),
                        pa.array(rows["n_tokens"], pa.float64()),
                        pa.array(rows["n_crossing"], pa.int64()),
                    ],
                    names=list(rows),
                )

    return count


def attribute_tokens(docs: DataFrame, tokenizer: str, rule: str = "first", sections: str | None = None) -> DataFrame:
    """A row for each section of each document with its share of the document's tokens.

    ``sections`` names a column ``array<struct<name, start, end>>`` of
    code-point spans, end exclusive; without it the lines are the sections,
    each with its line end. ``rule`` allocates a token that crosses a boundary:
    ``first`` to the section of its first character, ``most`` to the section
    with most of its bytes (the earlier of equals), ``share`` in proportion of
    its bytes. Over sections that tile a text the counts sum to the document's
    tokens under any rule; tokens outside all sections are counted nowhere.

    A null text is empty; an empty text is one empty line. Null or missing
    sections give no rows; spans are cut to the text. Repeated rows count each
    time; a null ``doc_id`` stays null. Other columns are ignored. The
    tokenizer must be byte-level, so that token sizes add up to the text.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    if not cuts_by_bytes(tokenizer):
        raise ValueError("the tokenizer must be byte-level, without a normalizer or prefix")
    columns = [F.col("doc_id").cast("long"), F.col("text")]
    if sections:
        columns.append(F.col(sections).cast("array<struct<name:string,start:bigint,end:bigint>>").alias("sections"))
    return docs.select(*columns).mapInArrow(_counter(tokenizer, rule, bool(sections)), SCHEMA)
