"""Odd ids, odd JSON, long candidates: cases that once lost rows or ended a task."""

import json
import random

import pytest
from pyspark.sql import functions as F

from cordage.llm import chat, decontaminate, secrets


def test_a_row_without_id_is_not_judged_by_an_id(spark):
    passage = " ".join(f"word{i}" for i in range(20))
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    key = spark.range(1).select(F.xxhash64(F.lit(None).cast("string")), F.xxhash64(F.lit("clean text"))).first()
    rows = [(key[0], passage), (key[1], passage), (None, None), (None, "clean text"), (None, passage), (None, ""), (7, None), (8, "clean text"), (9, passage), (9, None)]
    kept = decontaminate.drop_contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert sorted(map(str, (tuple(r) for r in kept))) == sorted(map(str, [(None, None), (None, "clean text"), (None, ""), (7, None), (8, "clean text")]))


def strict(text):
    def refuse(what):
        raise ValueError(what)

    return json.loads(text.encode("utf-8").decode("utf-8"), parse_constant=refuse)


ODD_ARGUMENTS = [
    '{"x":"\\ud800"}', '{"\\udfff":1}', "[" * 20000 + "]" * 20000, "[" * 20000, '{"x":NaN}', "Infinity", "-Infinity", '{"x":1e999}', '{"x":-1e999}', '{"x":1,"x":2}', "9" * 5000, '"' + "[{" * 5000 + '"', "", " ", "nul", '{"x":1}x',
    '{"x":"\\u0000"}', "﻿{}", '{"x":"\\ud83d\\ude00"}', '{"x":' + "[" * 90 + "]" * 90 + "}", None,
]


def test_arguments_of_any_text(spark):
    calls = spark.createDataFrame([(1, f"c{i:03}", i, "t", a, []) for i, a in enumerate(ODD_ARGUMENTS)], chat.CALL)
    found = chat.link_tool_calls(calls, spark.createDataFrame([], chat.RESULT), {"t": {"type": "object", "properties": {"x": {}}}}).orderBy("turn").collect()
    assert len(found) == len(ODD_ARGUMENTS)
    valid = {0, 1, 16, 18, 19, 20}
    assert {r.turn for r in found if r.valid} == valid
    for r in found:
        message = strict(r.message)
        assert (message["arguments"] is None) == (r.errors == ["$: not JSON"])
    assert found[11].errors == ["$: not object"]


def test_rules_of_schemas(spark):
    with pytest.raises(ValueError, match="unknown type"):
        chat.link_tool_calls(spark.createDataFrame([], chat.CALL), spark.createDataFrame([], chat.RESULT), {"t": {"type": "object", "properties": {"a": {"type": ["string", "text"]}}}})
    assert chat.schema_errors(True, {"enum": [1]}) and not chat.schema_errors(1, {"enum": [1.0]})
    assert not chat.schema_errors([{"a": 1}], {"enum": [[{"a": 1}]]})


def coverage_by_force(candidate, words):
    signs, low = set(), candidate.lower()
    for p in range(len(low)):
        for n in range(4, 13):
            if p + n <= len(low) and low[p : p + n] in words:
                signs.update(range(p, p + n))
    return len(signs) / max(1, len(candidate))


def test_dictionary_coverage(spark, monkeypatch):
    rng = random.Random(8)
    known = ["about", "house", "sehr", "größe", "userconfigdb", "http"]
    made = ["", "a", "abo", "About", "aboutabout", "httphouse" * 20, "größehouseX", "x" * 700]
    made += ["".join(rng.choice([*known, "q", "7", "-", "abou", "ouse"]) for _ in range(rng.randint(1, 300))) for _ in range(30)]
    rows = spark.createDataFrame([(m, i) for i, m in enumerate(made)] + [("About", 99)], "candidate string, i int")
    words = spark.createDataFrame([(w, 1) for w in known], "word string, count long")
    for piece in (512, 16):
        monkeypatch.setattr(secrets, "PIECE", piece)
        found = {r.i: r.dictionary for r in secrets.covered(rows, words).collect()}
        assert len(found) == len(made) + 1
        assert all(found[i] == pytest.approx(coverage_by_force(m, known)) for i, m in enumerate(made))


def test_a_candidate_of_a_million_signs(spark):
    words = spark.createDataFrame([(w, 1) for w in secrets.ORDINARY if len(w) > 3], "word string, count long")
    rng = random.Random(1)
    long = "".join(rng.choice(secrets.ORDINARY) for _ in range(200_000))[:1_000_000] + "1"
    rows = spark.createDataFrame([(long, "token = ", " "), ("ghp_" + "a1B2" * 9, "token = ", " ")], "candidate string, before string, after string")
    out = secrets.described(rows, words, [0.1] * len(secrets.LETTERS) ** 2).select("length", "dictionary", "features").orderBy("length").collect()
    assert out[1].length == 1_000_001 and out[1].dictionary > 0.9 and out[0].dictionary == 0


def test_a_key_block_goes_whole(spark):
    body = "\n".join("MIIEpAIBAAKCAQEA" + c * 48 for c in "qwerty") + "\nAbCdEf=="
    block = f"-----BEGIN RSA PRIVATE KEY-----\n{body}\n-----END RSA PRIVATE KEY-----"
    texts = [f"see {block} and more", "-----BEGIN PRIVATE KEY----- was cut off", f"{block}\n{block}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = secrets.candidates(docs).where("candidate like '%BEGIN%'").collect()
    assert sorted((r.doc_id, r.candidate) for r in found) == sorted([(0, block), (1, "-----BEGIN PRIVATE KEY-----"), (2, block), (2, block)])
    assert all(texts[r.doc_id][r.start : r.end] == r.candidate for r in found)
    assert sorted(r.text for r in secrets.redact_secrets(docs).collect()) == sorted(["see [SECRET] and more", "[SECRET] was cut off", "[SECRET]\n[SECRET]"])


def test_passing_tables_of_two_threads(spark):
    import threading

    from cordage.llm import shared

    kept, gate = {}, threading.Barrier(2)

    def work(name, fails):
        try:
            with shared.passing_tables(spark):
                table = shared.written(spark.range(3), name)
                gate.wait(60)
                if fails:
                    raise OSError
                gate.wait(60)
                kept[name] = table.count()
        except OSError:
            kept[name] = table.inputFiles()
            gate.wait(60)

    threads = [threading.Thread(target=work, args=x) for x in (("one", True), ("two", False))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert kept["two"] == 3
    assert all(not spark._jvm.java.io.File(f.removeprefix("file://")).exists() for f in kept["one"])


def test_items_that_share_windows(spark):
    prompt = " ".join(f"p{i}" for i in range(30))
    items = [(i, f"{prompt} own{i} " + " ".join(f"t{i}x{j}" for j in range(12))) for i in range(300)] + [(300, prompt), (300, prompt), (None, prompt), (301, "t5x1")]
    texts = [prompt, f"{prompt} own7 " + " ".join(f"t7x{j}" for j in range(12)), "nothing here", None, "so t5x1 it is"]
    found = decontaminate.benchmark_hits(spark.createDataFrame([*enumerate(texts), (None, prompt), (None, None)], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((str(r.doc_id), r.n_hit, r.n_items) for r in found.collect()) == [("0", 30, 301), ("1", 43, 301), ("2", 0, 0), ("3", 0, 0), ("4", 1, 1), ("None", 0, 0), ("None", 30, 301)]
