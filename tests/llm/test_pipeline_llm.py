"""The corpus pipeline, stage by stage, and whole."""

import collections
import random

from pyspark.sql import functions as F

import corpus_pipeline
from corpusmill.llm import queries
from tests.llm.test_operators_llm import DOCS, WORD, brute_components, corpus, table


def documents():
    rng = random.Random(21)
    rows = [r for r in corpus(21) if r[0] is not None]
    return rows + [(4000 + i, " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit"]) for _ in range(20)) + (" stupid moron" if i % 3 == 0 else " fine") + f" u{i} v{i}", "en", "s1") for i in range(60)]


def test_stages(spark, tmp_path):
    rows = documents()
    folder = str(tmp_path / "sf")
    table(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(4000 + i, 1, int(i % 3 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if i < 4:
            assert docs.dtypes == before.dtypes
        out[name] = docs.collect()
    left = {r.doc_id for r in out["toxicity"]}
    assert left == {r[0] for r in rows} - {4000 + i for i in range(0, 60, 3)}
    near = [(r.doc_id, r.text) for r in out["line_dedup"]]
    groups = collections.defaultdict(set)
    for d, n, c, _ in brute_components(near):
        groups[c if n else None].add(d)
    kept = {r.doc_id for r in out["near_dup"]}
    assert kept == {c for c in groups if c is not None} | groups[None]
    assert sum(len(WORD.findall(r.text or "")) for r in out["mixing"]) > 0
    packed = sum(r.length for r in out["packing"])
    assert packed > 0 and len({r.sequence_id for r in out["packing"]}) <= packed // 1024 + 2
    whole = corpus_pipeline.run(spark, folder)
    assert whole.agg(F.sum("length")).first()[0] == packed


def test_near_copies_share_five_words(spark):
    """Pairs of 0.8 to 0.9 and just below 0.8, by brute force over shingles of five words."""
    rng = random.Random(31)
    rows = [(r[0], r[1]) for r in corpus(31) if r[0] is not None]
    passage = [f"p{rng.randrange(900)}" for _ in range(60)]
    for k in range(30):
        base = [f"v{rng.randrange(900)}" for _ in range(rng.randint(20, 300))] + passage * (k % 2)
        rows.append((5000 + 10 * k, " ".join(base)))
        for c in range(1, 5):
            w, cut = list(base), rng.randrange(len(base))
            if c % 2:
                w[cut:cut] = [f"n{rng.randrange(900)}" for _ in range(len(base) * rng.randint(10, 26) // 100)]
            else:
                for _ in range(rng.randint(1, 2 + len(base) // 40)):
                    w[rng.randrange(len(w))] = f"e{rng.randrange(900)}"
            rows.append((5000 + 10 * k + c, " ".join(w)))
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    alike = lambda a, b, num: 100 * len(a & b) >= num * len(a | b)
    between = 0
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and alike(a, sets[j], 80):
                between += not alike(a, sets[j], 90)
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    assert between > 20
    least = {}
    for (d, _), g in zip(rows, group):
        least[g] = min(d, least.get(g, d))
    want = [least[g] for g in {g for g, s in zip(group, sets) if s}] + sorted(d for (d, _), s in zip(rows, sets) if not s)
    docs = table(spark, [(d, t, "en", "s") for d, t in rows])
    got = [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    assert sorted(got) == sorted(want)


def test_stages_on_nothing(spark, tmp_path):
    folder = str(tmp_path / "sf")
    spark.createDataFrame([], DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
