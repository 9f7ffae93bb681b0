import json

import pytest
from pyspark.sql import functions as F

from corpusmill.config import LIGHT, AdmitConfig, AnnealingConfig, NearDedupConfig
from corpusmill.functions.prefix import running_total
from corpusmill.functions.textfn import code_blocks, estimate_tokens, ngrams, u01
from corpusmill.operators import chat, decontam, evalkit, mixture, recall, redact, signals, synth, training
from corpusmill.operators.admit import admit
from corpusmill.operators.components import components
from corpusmill.operators.exact_dedup import exact_dedup
from corpusmill.operators.near_dedup import near_dedup
from corpusmill.plans.pipeline import run_pipeline
from corpusmill.sources import ingest, jsonl, problems
from corpusmill.streaming import stages

DOC = "content string, path string, stars long, commit_time double, source string, doc_id string, ord long"


def docs(spark, *rows):
    full = [(c, p, s, t, "github", i or "", o) for o, (c, p, s, t, i) in enumerate(rows)]
    return spark.createDataFrame(full, DOC)


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


GOOD = '"""Sum."""\n\nimport math\n\n\ndef area(r):\n    # area of a circle\n    value = math.pi * r * r\n    return value\n\n\nprint(area(2))\nprint(area(3))\nprint(area(4))\n'


def test_admit(spark):
    df = admit(docs(spark, ("a\r\nb\rc\n", "x/good.py", 0, 0.0, "1"), ("x" * 50, "big.py", 0, 0.0, "2"), ("x", "a.zzz", 0, 0.0, "3"), ("y", "dir.d/.bashrc", 0, 0.0, "4"), ("", "e.py", 0, 0.0, "5"), (None, "n.py", 0, 0.0, "6"), ("q", "t.MD", 0, 0.0, "")), AdmitConfig(max_file_bytes=40))
    got = {r.path: r for r in df.collect()}
    assert set(got) == {"x/good.py", "t.MD"}
    assert got["x/good.py"].content == "a\nb\nc\n" and got["x/good.py"].language == "Python" and got["x/good.py"].category == "code"
    assert got["t.MD"].category == "text" and len(got["t.MD"].doc_id) == 64


def test_exact_dedup_keeps_best_then_first(spark):
    df = docs(spark, ("a", "p", 5, 1.0, "1"), ("a", "p", 100, 0.0, "2"), ("b", "p", 1, 1.0, "3"), ("b", "p", 1, 1.0, "4"))
    assert values(exact_dedup(df), "doc_id") == [("2",), ("3",)]


def test_near_dedup_collapses_edits_and_blanks(spark):
    text = " ".join(f"word{i}" for i in range(200))
    df = docs(spark, (text, "a", 1, 0.0, "1"), (text.replace("word77", "other"), "b", 9, 0.0, "2"), ("nothing alike in here at all", "c", 0, 0.0, "3"), (" ", "d", 0, 0.0, "4"), ("\n", "e", 0, 0.0, "5"))
    assert values(near_dedup(df, LIGHT), "doc_id") == [("2",), ("3",), ("4",)]
    for n in (1, 7):
        assert values(near_dedup(df.repartition(n), LIGHT), "doc_id") == [("2",), ("3",), ("4",)]
    with pytest.raises(ValueError):
        NearDedupConfig(num_perm=10, bands=3, rows=3)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (3, 4), (9, 8), (8, 9), (5, 5), (None, 1)] + [(100 + i, 101 + i) for i in range(60)], "u long, v long")
    got = dict(values(components(edges), "node", "component"))
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8} | {100 + i: 100 for i in range(61)}
    assert components(edges.limit(0)).count() == 0


def test_redaction(spark):
    text = 'password = "hunter2secret"\nmail = "me@example.com"\nhost = "10.0.0.1"\nopen_quote token: "abc\n'
    r = redact.redact_pii(docs(spark, (text, "p", 0, 0.0, "1"))).first()
    assert r.content == 'password = "<password>"\nmail = "<email>"\nhost = "<ip_address>"\nopen_quote token: "<password>"\n'
    assert (r.email, r.ip, r.secret, r.private_key) == (1, 1, 2, 0)
    compile(r.content.split("\nopen")[0], "x", "exec")


@pytest.mark.parametrize(
    ("before", "after"),
    [
        ("# Copyright 2020 X\n# MIT License\n\nimport os\n", "import os\n"),
        ('"""Plain docstring."""\nx = 1\n', '"""Plain docstring."""\nx = 1\n'),
        ("#!/bin/sh\n# Licensed under X\necho hi\n", "#!/bin/sh\necho hi\n"),
        ("/* (c) me */\nint x;\n", "int x;\n"),
        ("/* copyright never closed\nint x;\n", "/* copyright never closed\nint x;\n"),
        ("// just a note\nint x;\n", "// just a note\nint x;\n"),
        ("// SPDX-License-Identifier: X\n#include <a>\n", "#include <a>\n"),
        ("# all rights reserved\n#include <a>\nint x;\n", "int x;\n"),
        ("<!-- license -->\n<p>", "<p>"),
        ("\n\n# copyright\n\n\n# more\nx", "x"),
        ("", ""), ("\n\n", "\n\n"), ("#!only", "#!only"),
    ],
)
def test_headers(spark, before, after):
    assert redact.remove_headers(docs(spark, (before, "p", 0, 0.0, "1"))).first().content == after


def test_rules(spark):
    df = admit(docs(spark, (GOOD, "g.py", 0, 0.0, "good"), ("def f(:\n  x\n\n", "b.py", 0, 0.0, "bad"), ("assert a\n" * 9 + "x = 1\n", "a.py", 0, 0.0, "assert"), ("# TODO\n" + GOOD, "t.py", 0, 0.0, "todo")))
    got = {r.doc_id: r for r in signals.annotate(df).collect()}
    assert got["good"].filtered_by == [] and "py_not_parseable" in got["bad"].filtered_by
    assert "code_assert_lines" in got["assert"].filtered_by and got["todo"].placeholder_line_ratio > 0.01
    hits = dict(values(signals.rule_hits(signals.annotate(df)), "rule", "n"))
    assert hits["py_not_parseable"] == 1 and "good" in {r.doc_id for r in signals.keep_unfired(signals.annotate(df)).collect()}


def test_recall(spark):
    seed = spark.createDataFrame([("def f import class return", 1), ("npm install code", 1), ("cake recipe sugar", 0), ("holiday beach sun", 0)], "content string, label long")
    web = spark.createDataFrame([("sugar", "a/Requirements.txt", "1"), ("def import class npm", "b/x.html", "2"), ("cake sugar beach", "c/y.html", "3"), ("", "d/README.md", "4")], "content string, path string, doc_id string")
    got = {r.doc_id: r.code_prob for r in recall.recall(web, recall.train(seed)).collect()}
    assert set(got) == {"1", "2", "4"} and got["1"] is None and got["2"] > 0.5


def test_decontaminate(spark):
    bench = spark.createDataFrame([("one two three four five six seven eight nine ten eleven",)], "text string")
    rows = spark.createDataFrame([(1, "uses has_close here"), (2, "ONE two  three four five six seven eight nine ten"), (3, "clean"), (4, "has_closely")], "id long, text string")
    for names in (["has_close"], ["has_close"] + [f"n{i}" for i in range(600)]):
        judged = decontam.decontaminate(rows, bench, names)
        assert values(judged, "id", F.coalesce("reason", F.lit("-"))) == [(1, "entry_point"), (2, "ngram"), (3, "-"), (4, "-")]
    assert dict(values(decontam.report(judged), "reason", "n")) == {"entry_point": 1, "ngram": 1, "kept": 2} and decontam.clean(judged).count() == 2


def test_mixture_and_quotas(spark):
    rows = spark.createDataFrame([(f"w{i} " * 10, f"p{i}", ["refinecode", "algorithmic", "none"][i % 3], str(i), i) for i in range(90)], "content string, path string, source string, doc_id string, ord long")
    mixed = mixture.mixture(rows, 300, AnnealingConfig())
    got = {r.source: r for r in mixture.mixture_report(mixed, 300, AnnealingConfig()).collect()}
    assert 252 <= got["refinecode"].tokens < 262 and 37 <= got["algorithmic"].tokens < 47 and got["code_textbook"].docs == 0
    composed = mixture.compose_two_stage(rows, {"refinecode": 4, "missing": 3}, {"algorithmic": 100}, id="doc_id")
    assert values(mixture.compose_report(composed, {"refinecode": 4, "missing": 3}, {"algorithmic": 100}), "stage", "source", "target", "actual") == [(1, "missing", 3, 0), (1, "refinecode", 4, 4), (2, "algorithmic", 100, 30)]


def test_running_total_in_any_cut(spark):
    df = spark.createDataFrame([(i, i % 3, (i * 7) % 11) for i in range(200)], "o long, g long, v long")
    exp = sorted((i, sum((j * 7) % 11 for j in range(i) if j % 3 == i % 3)) for i in range(200))
    for far in (0, 10**15):  # an order with an outlier
        moved = df.withColumn("o", F.when(F.col("o") == 199, F.col("o") + far).otherwise(F.col("o")))
        assert [b for _, b in values(running_total(moved, "v", "o", by="g"), "o", "before")] == [b for _, b in exp]
    assert values(running_total(df, "v", ("g", "o")), "g", "o", "before")[0] == (0, 0, 0)
    assert running_total(df.limit(0), "v", "o").count() == 0


def test_training_sequences(spark):
    texts = ["héllo", "", "abc" * 30, "z"]
    df = docs(spark, *((t, "p", 0, 0.0, str(i)) for i, t in enumerate(texts)))
    stream = b"".join(t.encode() + b"\n" for t in texts)
    got = [r.ids for r in training.pack_blocks(df, 16).orderBy("block").collect()]
    assert got == [list(stream[i : i + 16]) for i in range(0, len(stream) // 16 * 16, 16)]
    row = training.sft_examples(spark.createDataFrame([("add", " two ")], "instruction string, response string"), 128).first()
    assert len(row.ids) == len(row.mask) == 128 and row.mask[0] == 0 and 0 < sum(row.mask) < 128 and sum(row.mask) == len(" two \n<|end|>")
    assert training.batches(training.pack_blocks(df, 16), 4).count() == len(got) // 4 * 4


def test_ingestion(spark):
    rows = spark.createDataFrame([("b1", 10, "p.py", "2020-01-01T00:00:00Z"), ("b2", 10**8, "q.py", ""), (None, 1, "r.py", "7"), ("b3", 1, "s.py", "x"), ("b4", 1, "t.py", "0")], "blob_id string, length_bytes long, path string, visit_date string")
    blobs = spark.createDataFrame([("b1", "x = 1"), ("b4", "")], "blob_id string, content string")
    judged = ingest.ingest_status(rows, blobs)
    assert dict(values(ingest.counters(judged), "status", "n")) == {"yielded": 1, "skip_too_large": 1, "skip_no_blob": 1, "skip_fetch_error": 1, "skip_empty": 1}
    doc = ingest.to_documents(judged, F.lit("Python")).first()
    assert doc.commit_time == 1577836800.0 and doc.category == "code"
    raw = spark.createDataFrame([("b", "utf-8", bytearray(b"a\xffb")), ("c", "no-such", bytearray(b"x"))], "blob_id string, src_encoding string, raw binary")
    assert values(ingest.decode_blobs(raw), "blob_id", "content") == [("b", "a�b"), ("c", "x")]


def test_pass_at_k_and_programs(spark):
    rows = spark.createDataFrame([(5, 0, 1), (5, 5, 1), (5, 1, 1), (10, 1, 10), (3, 1, 0)], "n long, c long, k long")
    assert [round(r.p, 6) for r in rows.select(evalkit.pass_at_k(F.col("n"), F.col("c"), F.col("k")).alias("p")).collect()] == [0.0, 1.0, 0.2, 1.0, 0.0]
    one = spark.createDataFrame([("def add(a, b):\n", "add", "def check(f):\n    assert f(1, 2) == 3", "    return a + b\n\ndef other(): pass")], "prompt string, e string, t string, g string")
    program = evalkit.completion_program(F.col("prompt"), F.col("e"), F.col("t"), F.col("g"))
    with pytest.raises(PermissionError):
        evalkit.run_programs(one)
    runs = one.select(program.alias("program")).unionByName(spark.createDataFrame([("assert False",), ("while True: pass",), (None,)], "program string"))
    assert sorted((r.passed, r.timed_out) for r in evalkit.run_programs(runs, 3, allow=True).collect()) == [(False, False), (False, False), (False, True), (True, False)]


def test_chat(spark):
    turns = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "def q"), (1, 2, "assistant", "short"), (2, 0, "user", "x"), (2, 1, "user", "import y"), (2, 2, "assistant", "z" * 50)], "conv_id long, turn long, role string, text string")
    pairs = chat.dialogue_pairs(turns)
    assert values(pairs, "conv_id", "turn") == [(1, 1), (2, 1)]
    assert values(chat.build_realuser(pairs), "conv_id", "response", "regenerated") == [(1, "short", False), (2, "z" * 50, False)]  # a short answer stays where there is no other
    new = spark.createDataFrame([("def q", " better ")], "instruction string, response string")
    assert values(chat.build_realuser(pairs, new), "conv_id", "response")[0] == (1, "better")
    assert chat.format_dataset(pairs).filter("conv_id = 1").first().text == "<|system|>\nYou are a helpful programming assistant.\n<|user|>\ndef q\n<|assistant|>\nshort\n<|end|>"


def test_text_functions(spark):
    df = spark.createDataFrame([("a b c, d!",), ("",), ("```python\n x = 1 \n```\n```\ny\n```",)], "t string")
    assert [r[0] for r in df.select(estimate_tokens(F.col("t"))).collect()][:2] == [6, 0]
    assert [r[0] for r in df.select(code_blocks(F.col("t"))).collect()] == [["a b c, d!"], [], ["x = 1", "y"]]
    assert df.select(ngrams(F.array(*map(F.lit, "abcab")), 2)).first()[0] == ["a b", "b c", "c a"]
    assert 0 <= df.select(u01(F.col("t"), 1)).first()[0] < 1


def test_synthesis(spark):
    seeds = spark.createDataFrame([(0, "Write add. Subscribe now! Use ints."), (1, "No answer.")], "ord long, content string")
    assert seeds.select(synth.clean_seed(F.col("content"))).first()[0] == "Write add. Use ints."
    q, code, tests = F.col("content"), "def add(a, b):\n    return a + b", "assert add(1, 2) == 3"
    first = seeds.filter("ord = 0")
    answer = first.select(synth.prompt_key(synth.answer_prompt(q, F.lit("Python"))).alias("prompt_key"), F.lit(f"```python\n{code}\n```").alias("response"))
    checks = first.select(synth.prompt_key(synth.tests_prompt(q, F.lit(code), F.lit("Python"))).alias("prompt_key"), F.lit(f"```\n{tests}\n```").alias("response"))
    teacher = answer.unionByName(checks)
    results = spark.createDataFrame([(True,)], "passed boolean").select(F.sha2(F.lit(f"{code}\n\n{tests}\n"), 256).alias("program_key"), "passed")
    assert [r.content for r in synth.snippets(seeds, teacher, results).collect()] == [code]
    assert synth.snippets(seeds, teacher, results.filter("false")).count() == 0
    assert synth.missing(seeds, synth.answer_prompt(q, F.lit("Python")), teacher).count() == 1
    scored = spark.createDataFrame([(GOOD,), ("x = (",), ("x = 1",)], "s string").select(synth.seed_score("s")).collect()
    assert [round(r[0], 1) for r in scored] == [1.0, 0.0, 0.3]
    assert synth.api_table(spark, ("json", "no_such_module")).count() == 8


def test_sources(spark, tmp_path):
    path = str(tmp_path / "d")
    rows = docs(spark, ("é\n", "a.py", 3, 1.5, "1")).drop("ord")
    assert jsonl.write(rows, path, gzip=True) == 1
    back = jsonl.read_documents(spark, path).first()
    assert back.content == "é\n" and back.stars == 3 and back.language == ""
    (tmp_path / "x.jsonl").write_text(json.dumps({"id": "t1", "prompt": "do", "test_list": ["assert 1"]}) + "\n")
    p = problems.load_function(spark, str(tmp_path / "x.jsonl")).first()
    assert (p.task_id, p.text, p.code) == ("t1", "do", "")
    (tmp_path / "bad.jsonl").write_text("{\n")
    with pytest.raises(Exception):
        jsonl.read_documents(spark, str(tmp_path / "bad.jsonl")).collect()
    wrapped = jsonl.wrap_examples(spark.createDataFrame([("q", ""), ("q", "a")], "prompt string, output string"), "s")
    assert values(wrapped, "instruction", "response") == [("q", "a")]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("".join(json.dumps({"content": c, "path": "g.py", "doc_id": str(i)}) + "\n" for i, c in enumerate([GOOD, "def f(:\n\n\n"])))
    stages.write(stages.clean(stages.read_documents(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [r.doc_id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["0"]


def test_pipeline_counts_fall(spark):
    df = docs(spark, (GOOD, "g.py", 1, 0.0, "1"), (GOOD, "h.py", 2, 0.0, "2"), ("def f(:\n\n\n", "b.py", 0, 0.0, "3"))
    result = run_pipeline(df)
    counts = [r.n for r in result.stage_counts.orderBy("stage").collect()]
    assert counts == sorted(counts, reverse=True) and [r.doc_id for r in result.documents.collect()] == ["2"]


def test_any_hash(spark):
    import hashlib

    from corpusmill.operators.exact_dedup import content_hash

    df = spark.createDataFrame([("é",), (None,)], "t string")
    for name in ("md5", "sha1", "sha224", "sha512", "blake2b", "sha3_256"):
        assert [r[0] for r in df.select(content_hash(F.col("t"), name)).collect()] == [hashlib.new(name, "é".encode()).hexdigest(), None]
    with pytest.raises(ValueError):
        content_hash(F.col("t"), "nothing")


def test_names_of_any_form_stand_in_long_lists(spark):
    bench = spark.createDataFrame([], "text string")
    rows = spark.createDataFrame([(1, "call a.b-c now"), (2, "call a.b-cd now"), (3, "the n7, here"), (4, "n70000 is not"), (5, "two words")], "id long, text string")
    for more in (0, 600):
        judged = decontam.decontaminate(rows, bench, ["a.b-c", "n7", "two words"] + [f"q{i}" for i in range(more)])
        assert values(judged, "id", F.coalesce("reason", F.lit("-"))) == [(1, "entry_point"), (2, "-"), (3, "entry_point"), (4, "-"), (5, "entry_point")]
    grams = spark.createDataFrame([("one two three four five six seven eight nine ten eleven",)], "text string")
    far = spark.createDataFrame([(1, "x one two three four five six seven eight nine ten"), (2, "one two three four five six seven eight nine")], "id long, text string")
    for most in (2_000_000, 0):
        decontam.BROADCAST_GRAMS, old = most, decontam.BROADCAST_GRAMS
        assert values(decontam.decontaminate(far, grams, []), "id", F.coalesce("reason", F.lit("-"))) == [(1, "ngram"), (2, "-")]
        decontam.BROADCAST_GRAMS = old


def _teacher(spark, prompts):
    return prompts.select(synth.prompt_key(F.col("p")).alias("prompt_key"), synth.scripted_answer(F.col("p")).alias("response"))


def test_synthesis_with_a_scripted_teacher(spark):
    """Each turn's prompts are answered once its table is there, as a run against a cache goes."""
    seeds = spark.createDataFrame([(1, "def area(r):\n    # of a circle\n    return 3 * r * r\n\nprint(area(2))\n"), (2, "not python (")], "ord long, content string")
    asked = seeds.select(synth.answer_prompt(F.col("content"), F.lit("Python")).alias("p"), "content")
    solved = asked.withColumn("s", F.get(code_blocks(synth.scripted_answer(F.col("p"))), 0))
    tests = solved.select(synth.tests_prompt(F.col("content"), F.col("s"), F.lit("Python")).alias("p"))
    teacher = _teacher(spark, asked.select("p").unionByName(tests))
    programs = solved.select("s", synth.tests_prompt(F.col("content"), F.col("s"), F.lit("Python")).alias("p")).select(F.concat("s", F.lit("\n\n"), F.get(code_blocks(synth.scripted_answer(F.col("p"))), 0), F.lit("\n")).alias("program"))
    results = evalkit.run_programs(programs, allow=True).select(F.sha2("program", 256).alias("program_key"), "passed")
    assert results.filter("passed").count() == 2
    rows = synth.educational(seeds, teacher, results).collect()
    assert [(r.ord, r.validated, r.instruction.split("\n")[0]) for r in rows] == [(1, True, "Study this snippet and write a well-documented solution:")] and rows[0].response.startswith("def solution_")
    assert synth.snippets(seeds, teacher, results).count() == 2
    mixed = mixture.build_annealing(seeds.withColumn("path", F.lit("a/greedy.py")), seeds, 10_000, teacher, results)
    assert {r.source for r in mixed.collect()} == {"refinecode", "algorithmic", "synthetic_snippet"}


def test_apis_and_their_examples(spark, tmp_path):
    apis = synth.api_table(spark, ("json", "no_such_library"), 2)
    assert values(apis, "library", "api") == [("json", "JSONDecodeError"), ("json", "JSONDecoder")]
    prompts = apis.select(synth.package_prompt(F.col("library"), F.col("api"), F.col("signature"), F.col("doc")).alias("p"))
    asked = prompts.select(synth.prompt_key(F.col("p")).alias("prompt_key"), F.col("p").alias("prompt"))
    path = str(tmp_path / "teacher")
    teacher = synth.write_back(asked, synth.scripted_answer(F.col("prompt")), path)
    made = synth.package(apis, teacher).collect()
    assert len(made) == 2 and all(r.instruction.startswith("Using the current version of `json`, show how to use `json.JSONDecode") for r in made)
    assert synth.missing(prompts, F.col("p"), teacher).count() == 0


def test_limit_per_language(spark):
    rows = spark.createDataFrame([(i, ["a", "b"][i % 2], "yielded" if i % 3 else "skip_empty") for i in range(40)], "ord long, language string, status string")
    got = ingest.limited(rows, 3, "ord")
    assert values(got.filter("status = 'yielded'").groupBy("language").count(), "language", "count") == [("a", 3), ("b", 3)]
    assert dict(values(ingest.stats(got), "status", "n")) == {"yielded": 6, "skip_empty": 3, "seen": 9}


def test_evaluation(spark):
    problems = spark.createDataFrame([("t1", "def f():\n", "f", "def check(g):\n    assert g() == 1\n"), ("t2", "def f():\n", "f", "def check(g):\n    assert g() == 2\n")], "task_id string, prompt string, entry_point string, test string")
    generations = spark.createDataFrame([("t1", "    return 1\n"), ("t1", "    return 2\n"), ("t2", "    return 1\n"), ("t2", "    return 1\n")], "task_id string, generation string")
    program = evalkit.completion_program(F.col("prompt"), F.col("entry_point"), F.col("test"), F.col("generation"))
    counts, scores = evalkit.evaluate(problems, generations, program, (2, 1), allow=True)
    assert values(counts, "task_id", "n", "c") == [("t1", 2, 1), ("t2", 2, 0)]
    assert evalkit.report_lines(scores) == ["pass@1: 0.250", "pass@2: 0.500", "solved: 1 of 2"]
    assert evalkit.evaluate(problems, generations, program, limit=1, allow=True)[0].count() == 1


def test_best_copies_on_a_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text('{"content": "x", "stars": 1, "path": "p"}\n{"content": "y", "stars": 3, "path": "q"}\n{"content": "x", "stars": 7, "path": "r"}\n')
    query = stages.keep_best(stages.read_documents(spark, str(folder))).writeStream.format("memory").queryName("best_copies").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert values(spark.table("best_copies"), "best.row.path", "best.stars") == [("q", 3), ("r", 7)]


def test_sample_problems_pass_with_their_solutions(spark):
    first = problems.sample_completion(spark)
    program = evalkit.completion_program(F.col("prompt"), F.col("entry_point"), F.col("test"), F.col("generation"))
    _, scores = evalkit.evaluate(first, first.select("task_id", F.col("canonical_solution").alias("generation")), program, allow=True)
    assert evalkit.report_lines(scores) == ["pass@1: 1.000", "solved: 3 of 3"]
    other = problems.sample_function(spark)
    program = evalkit.function_program(F.col("test_setup_code"), F.col("test_list"), F.col("generation"))
    _, scores = evalkit.evaluate(other, other.select("task_id", F.col("code").alias("generation")), program, allow=True)
    assert evalkit.report_lines(scores) == ["pass@1: 1.000", "solved: 3 of 3"]


def test_languages_are_read_from_their_own_folders(spark, tmp_path):
    path = str(tmp_path / "meta")
    ingest.write_partitioned(spark.createDataFrame([("a", "C"), ("b", "Go"), ("c", "C"), ("d", "SQL")], "blob_id string, language string"), path)
    got = ingest.read_language(spark, path, "C", "SQL")
    assert values(got, "blob_id") == [("a",), ("c",), ("d",)] and len(got.inputFiles()) >= 2
    assert "PartitionFilters: [language" in got._jdf.queryExecution().toString()
    assert ingest.read_language(spark, path).count() == 4 and ingest.read_language(spark, path, "Rust").count() == 0


def test_texts_without_content_are_left_out(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"content": "x"}\n{"text": "y"}\n{"content": "", "text": ""}\n{"other": 1}\n')
    assert values(jsonl.read_texts(spark, str(tmp_path / "a.jsonl")), "text") == [("x",), ("y",)]
