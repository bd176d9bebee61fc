"""Mixing, the filter audit and collocations against brute-force versions."""

import itertools
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from cordage.llm import collocations, filter_audit, mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets_by_force(sizes, weights=(3, 1, 2), share=Fraction(3, 2), most=2):
    """Sizes by source, in order."""
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sizes)}
    left, target = share * sum(sizes.values()), {}
    free = dict(sizes)
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] >= most * sizes[s]]
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = Fraction(most * free.pop(s))
            left -= target[s]
    return target


def documents(n, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["a"] * 6 + ["B", "é", "", "z", None])
        text = rng.choice([None, "", " \n"]) if rng.random() < 0.1 else " ".join(rng.choice("uvwxyz") for _ in range(rng.choice([1, 3, 3, 3, 7, rng.randint(1, 60)])))
        rows.append((i, text, source, "clash"))
    return rows


def in_order(sources):
    return sorted((s for s in sources if s is not None), key=lambda s: s.encode()) + [None] * (None in sources)


@pytest.mark.parametrize("exact", [1 << 16, 40])
def test_mix_meets_its_targets(spark, exact, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 4)  # so that thresholds are looked for in buckets
    rows = documents(900)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    found = {r.doc_id: r for r in mixing.mix_sources(docs, exact=exact).collect()}
    assert len(found) == len(rows)
    sizes = Counter({s: 0 for s in in_order({r[2] for r in rows})})
    for _, text, source, _ in rows:
        sizes[source] += len(WORD.findall(text or ""))
    target = targets_by_force(sizes)
    taken = Counter()
    for i, text, source, _ in rows:
        r = found[i]
        assert (r["size"], r.source_size) == (len(WORD.findall(text or "")), sizes[source])
        assert r.target == pytest.approx(float(target[source]), rel=1e-12)
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[source] += r.taken
    for s in sizes:
        assert 0 <= target[s] - taken[s] < 1, (s, taken[s], target[s])
    again = {r.doc_id: r for r in mixing.mix_sources(docs.repartition(7), exact=exact).collect()}
    assert again == found
    other = {r.doc_id: r.taken for r in mixing.mix_sources(docs, seed=5).collect()}
    assert other != {i: r.taken for i, r in found.items()}


def test_mix_edges(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix_sources(spark.createDataFrame([], schema)).count() == 0
    empty = mixing.mix_sources(spark.createDataFrame([(1, None, None), (2, "", "a"), (2, "", "a")], schema)).collect()
    assert sorted(tuple(r) for r in empty) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    rows = [(7, "a b c", "s")] * 5 + [(None, "a b", "s"), (None, "a c", "s"), (None, "a c", None), (8, "w " * 40000, "t")]
    found = mixing.mix_sources(spark.createDataFrame(rows, schema)).collect()
    assert len(found) == 9
    by_source = defaultdict(list)
    for r in found:
        by_source[r.source_size].append(r)
        assert r.taken in (0, r["size"], 2 * r["size"])
    assert all(sum(r.taken for r in group) <= group[0].target for group in by_source.values())
    assert len({r.taken for r in found if r.doc_id == 7}) == 1


def test_budget_is_fitted_as_well_as_can_be():
    rng = random.Random(4)
    for _ in range(200):
        lengths = sorted(rng.sample(range(1, 40), rng.randint(1, 5)))
        counts = [rng.randint(1, 4) for _ in lengths]
        total = sum(a * b for a, b in zip(lengths, counts))
        budget = rng.randrange(total)
        sums = {sum(a * b for a, b in zip(lengths, x)) for x in itertools.product(*[range(c + 1) for c in counts])}
        taken = mixing.fit_budget(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(taken, counts))
        assert sum(a * b for a, b in zip(lengths, taken)) == max(s for s in sums if s <= budget)
        near = mixing.fit_budget(lengths, counts, budget, exact=20)
        assert all(0 <= t <= c for t, c in zip(near, counts)) and sum(a * b for a, b in zip(lengths, near)) <= budget
    lengths, counts = list(range(1, 2000)), [50] * 1999
    taken = mixing.fit_budget(lengths, counts, 70_000_003)
    assert sum(a * b for a, b in zip(lengths, taken)) == 70_000_003 and max(abs(t / c - 0.7) for t, c in zip(taken, counts)) < 0.1  # four of the longest lengths at most


def audit_by_force(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    docs = []
    for i, text, source in rows:
        text = text or ""
        w = WORD.findall(text)
        fails = "".join(
            x for x, bad in zip("ABCDE", [
                len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search(r"[#$%&*|]", text)), i is not None and first[text] < i,
            ]) if bad
        )
        docs.append((source or "", fails, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part in {d[0] for d in docs}:
        for order in map("".join, itertools.permutations("ABCDE")):
            alive = [d for d in docs if d[0] == part]
            everything = list(alive)
            for step, f in enumerate(order, 1):
                gone, alive = [d for d in alive if f in d[1]], [d for d in alive if f not in d[1]]
                failing = sum(f in d[1] for d in everything)
                out[part, order, step] = [len(alive), len(gone), failing - len(gone), sum(d[1] == f for d in everything), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                shapley[part, f] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit(spark):
    rng = random.Random(9)
    rows = []
    for i in range(300):
        words = [rng.choice(["aB", "c", "dé", "e", "f", "x%", "G"] if rng.random() < 0.2 else [f"w{rng.randrange(400)}"]) for _ in range(rng.choice([0, 10, 55, 80]))]
        text = " ".join(words) if words else rng.choice([None, "", "\n"])
        rows.append((i, rows[-1][1] if rows and rng.random() < 0.3 else text, rng.choice(["s", "S", "", None])))
    rows += [rows[5], rows[6], (None, rows[7][1], "s"), (None, "w " * 50000, "t"), (3, "another text of the same id", "s")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 300, 2)] + [(4, 1, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, part string")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    measured = filter_audit.written(filter_audit.measured_documents(docs, table), "t")
    assert measured.count() == len(rows)
    found = filter_audit.audit_filters(measured, filter_audit.document_filters(), marks=["good", "toxic"]).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in found} == audit_by_force(rows, labels)
    assert len(found) == 600 * 3 + 600
    none = filter_audit.written(filter_audit.measured_documents(docs.limit(0), table.limit(0)), "t")
    assert filter_audit.audit_filters(none, filter_audit.document_filters(), marks=["good", "toxic"]).count() == 0


def test_each_state_of_the_trie_is_made_once(spark):
    rows = filter_audit.written(spark.range(64).select("id", F.lit("p").alias("part")), "t")
    filters = {f"f{i}": F.expr(f"id & {1 << i} > 0") for i in range(4)}
    edges = filter_audit.trie_edges(rows, filters, "part", [])
    assert edges.select("state").distinct().count() == 15 and edges.count() == 4 * 8
    assert {(r.entered, r.removed) for r in edges.where("state = 3").collect()} == {(16, 8)}
    out = filter_audit.audit_filters(rows, filters)
    assert out.count() == 24 * 4 and out.where("step = 4").select("kept").distinct().collect() == [(4,)]
    with pytest.raises(ValueError):
        filter_audit.audit_filters(rows, {})


def phrases_by_force(rows, least, longest, top, subsumed):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for s in range(1, longest + 1):
                for i in range(len(w) - s + 1):
                    f[lang][tuple(w[i : i + s])] += 1
    out = []
    for lang, of in f.items():
        candidates = {g: a for g, a in of.items() if len(g) > 1 and a >= least}
        scored = []
        for g, a in candidates.items():
            score, k = min((10**6 * a * a // (of[g[:k]] * of[g[k:]]), k) for k in range(1, len(g)))
            inside = lambda h: any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))
            if not any(len(h) > len(g) and 100 * b >= subsumed * a and inside(h) for h, b in candidates.items()):
                scored.append((-score, -a, " ".join(g).encode(), of[g[:k]], of[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def phrase_rows(seed=6):
    rng = random.Random(seed)
    words = ["The", "the", "of", "größe", "ÀB", "日本", "x-y", "'s", "1.5", "😀", "end", "new york city"]
    rows = [(" ".join(rng.choice(words) + rng.choice(["", "", "", ",", ".", "\t", "\n", " "]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None, "und", ""])) for _ in range(150)]
    return rows + [(None, "en"), ("", None), ("a a a a a a a a a a a a a a", "en"), ("z " * 30000, "fr"), (" . ; \n", "fr"), ("same thing here " * 12, "en")] + [("same thing here", "en")] * 5


@pytest.mark.parametrize("least, longest, top, subsumed, shard", [(10, 3, 2000, 50, 1 << 22), (2, 3, 7, 50, 300), (3, 2, 2000, 50, 5000), (10, 3, 2000, 90, 1 << 22)])
def test_collocations(spark, monkeypatch, least, longest, top, subsumed, shard):
    rows = phrase_rows()
    docs = spark.createDataFrame([(i, *r, "x", 1) for i, r in enumerate(rows)], "doc_id long, text string, lang string, phrase string, n int").repartition(3)
    small = collocations._shards
    monkeypatch.setattr(collocations, "_shards", lambda batches, depth, most=shard: small(batches, depth, most))
    found = collocations.collocations(docs, least, longest, top, subsumed).collect()
    assert sorted(map(tuple, found)) == phrases_by_force(rows, least, longest, top, subsumed)
    assert len({r.lang for r in found}) == (5 if least == 2 else len({x[0] for x in phrases_by_force(rows, least, longest, top, subsumed)}))


def test_collocation_edges(spark):
    docs = spark.createDataFrame([(None, None), ("", "en"), ("alone", "en")], "text string, lang string")
    assert collocations.collocations(docs).count() == 0
    assert collocations.collocations(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        collocations.collocations(docs, longest=4)


def test_states_are_classes_of_places():
    """States, links and counts against classes of phrases that end at the same places."""
    rng = random.Random(3)
    for _ in range(50):
        pieces = [[rng.randint(1, 4) for _ in range(rng.randint(1, 12))] for _ in range(rng.randint(1, 4))]
        ends, depth = [], 3
        places = defaultdict(set)
        for p, piece in enumerate(pieces):
            for i in range(len(piece)):
                packed = 0
                for d in range(depth):
                    packed = packed << collocations.BITS | (piece[i - d] if i >= d else 0)
                    if i >= d:
                        places[tuple(piece[i - d : i + 1])].add((p, i))
                ends.append(packed)
        classes = defaultdict(list)
        for g, where in places.items():
            classes[frozenset(where)].append(len(g))
        s = collocations.suffix_states(np.array(ends, np.uint64), depth)
        assert sorted(zip(s.length.tolist(), s.link.tolist(), s.places.tolist())) == sorted((max(v), min(v) - 1, len(k)) for k, v in classes.items())


def test_scores_pass_64_bits(spark):
    big = 3 * 10**9
    row = spark.createDataFrame([(big, big + 1, big + 2)], "a long, l long, r long")
    assert row.select(collocations.score("a", "l", "r")).first()[0] == 10**6 * big * big // ((big + 1) * (big + 2))


@pytest.mark.parametrize("name", ["op12_filter_audit", "op13_collocations"])
def test_sql(spark, sf_dir, name):
    import duckdb

    from cordage.llm import queries

    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    found = queries.queries()[name](spark, sf_dir)
    columns = ", ".join(found.columns)
    assert sorted(map(tuple, found.collect())) == sorted(db.execute(f"select {columns} from ({queries.oracle_sql()[name]})").fetchall())
