"""The ten operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import math
import random
import re
import struct
import tracemalloc
import zlib
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusmill.llm import chat_quotes, fingerprints, jaccard_join, line_dedup, mixing, packing, quality_rules, suffix_dedup, toxicity, url_filters
from corpusmill.llm.queries import RULES
from corpusmill.sources import scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t)) for i, t, lang, src in rows], DOCS)


def corpus(seed=1, n=60):
    """Texts with exact and near copies, shared passages, periodic text, nulls and blanks; (doc_id, text, lang, source) rows."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéö") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage, base = text(60), text(120)
    out = []
    for i in range(n):
        kind = i % 10
        if kind == 0:
            t = base
        elif kind in (1, 2):
            w = base.split()
            for _ in range(kind):
                w[rng.randrange(len(w))] = "edit"
            t = " ".join(w)
        elif kind == 3:
            t = text(20) + "\n" + passage + "\n" + text(20)
        elif kind == 4:
            t = "ab " * rng.choice([100, 150, 400])
        elif kind == 5:
            t = rng.choice([None, "", " \t\n", "x", "one two"])
        else:
            t = "\n".join(text(rng.randint(1, 30)) for _ in range(rng.randint(1, 6)))
        out.append((i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s2", "ü", None])))
    out += [out[0], (None, text(30), "en", "s1"), (None, None, None, None), (7, text(40), "en", "s2"), (10**12, text(5000), "en", "s1")]
    return out


# 1: URL filters


def test_url_filters(spark):
    urls = [None, "", "no scheme", "http://A.Example.ORG/es/x?q#f", "https://example.org/en/12", "https://example.org/en/2", "http://xexample.org/es/", "ftp://com/fr/", "http://a.com/de/?x", "http://a.com/fr", "http://org", "http://org/", "http://a://b.org/x", "x://com/de/#://org/"]
    urls += urls[3:5]
    df = spark.createDataFrame([(i % 9, u, "clash", "clash") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")

    def expected(u):
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "")
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fit = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, None, "allow"))
        return host, path, best[1], best[2]

    got = url_filters.judge(df, url_filters.rule_table(spark, RULES))
    assert sorted(map(repr, ((r.page_id, r.url, r.host, r.path, r.rule, r.verdict) for r in got.collect()))) == sorted(map(repr, ((i % 9, u, *expected(u)) for i, u in enumerate(urls))))
    none = url_filters.judge(df, url_filters.rule_table(spark, RULES).limit(0))
    assert {r.verdict for r in none.collect()} == {"allow"} and url_filters.judge(df.limit(0), url_filters.rule_table(spark, RULES)).count() == 0


def test_url_rule_ties(spark):
    rules = url_filters.rule_table(spark, [("a.b", "/x", "allow"), ("a.b", "/x", "block"), ("b", "/x/y/", "allow"), (None, "/", "block")])
    df = spark.createDataFrame([("http://a.b/x",), ("http://a.b/x/y/z",)], "url string")
    assert [(r.rule, r.verdict) for r in url_filters.judge(df, rules).orderBy("url").collect()] == [("a.b/x", "block"), ("b/x/y/", "allow")]


# 2: suffix-array dedup


def brute_removed(texts, least):
    raw = [(t or "").encode() for t in texts]
    count = collections.Counter(b[i : i + least] for b in raw for i in range(len(b) - least + 1))
    out = []
    for b in raw:
        cover = np.zeros(len(b), bool)
        for i in range(len(b) - least + 1):
            if count[b[i : i + least]] > 1:
                cover[i : i + least] = True
        runs = int((np.diff(np.concatenate(([0], cover.astype(int)))) == 1).sum())
        out.append((bytes(np.frombuffer(b, np.uint8)[~cover]), runs))
    return out


@pytest.mark.parametrize(("seed", "block"), [(1, suffix_dedup.BLOCK), (2, 1500)])
def test_suffix_dedup(spark, seed, block):
    rows = [r for r in corpus(seed) if r[1] is None or len(r[1]) < 9000]
    df = table(spark, rows).withColumn("kept", F.lit("clash")).withColumn("node", F.lit(1)) if seed == 1 else table(spark, rows)
    got = suffix_dedup.dedup(df.drop("node"), block=block).collect()
    expected = [(i, k, n) for (i, *_), (k, n) in zip(rows, brute_removed([r[1] for r in rows], 200), strict=True)]
    assert sorted(map(repr, ((r.doc_id, bytes(r.kept), len(r.removed)) for r in got))) == sorted(map(repr, expected))
    assert suffix_dedup.dedup(df.limit(0)).count() == 0


def test_repeat_groups_cover_what_repeats():
    rng = random.Random(4)
    for t in range(200):
        base = "".join(rng.choice("abcd"[: 2 + t % 3]) for _ in range(60)).encode()
        items = sorted({base[a : a + rng.randint(8, 40)] for a in (rng.randint(0, 40) for _ in range(rng.randint(1, 6)))} | {base[:9] + b"x" + base[10:40]})
        count = collections.Counter(x[i : i + 8] for x in items for i in range(len(x) - 7))
        expected, got, whole = [], np.zeros(sum(map(len, items)), bool), b"".join(items)
        for x in items:
            m = np.zeros(len(x), bool)
            for i in range(len(x) - 7):
                if count[x[i : i + 8]] > 1:
                    m[i : i + 8] = True
            expected.append(m)
        for length, places in suffix_dedup.repeat_groups(items, [1] * len(items), 8):
            assert length >= 8 and len({whole[p : p + length] for p in places}) == 1 and len(set(places.tolist())) == len(places) > 1
            for p in places:
                got[p : p + length] = True
        assert (got == np.concatenate(expected)).all()


def brute_repeats(rows, least):
    """{(string, every (doc_id, start))}: maximal repeats from all pairs of places with unlike left neighbours."""
    raw = [(i, (t or "").encode()) for i, t, *_ in rows]
    found = set()
    places = [(k, p) for k, (_, x) in enumerate(raw) for p in range(len(x) - least + 1)]
    by = collections.defaultdict(list)
    for k, p in places:
        by[raw[k][1][p : p + least]].append((k, p))
    for own in by.values():
        for n, (k, p) in enumerate(own):
            for m, q in own[:n]:
                x, y = raw[k][1], raw[m][1]
                if p and q and x[p - 1] == y[q - 1]:
                    continue
                size = least
                while p + size < len(x) and q + size < len(y) and x[p + size] == y[q + size]:
                    size += 1
                found.add(x[p : p + size])
    return {(w, frozenset((i, p) for i, x in raw for p in range(len(x) - len(w) + 1) if x[p : p + len(w)] == w)) for w in found}


def test_suffix_dedup_scratch_files(spark):
    """Scratch tables have a file a core, not one a partition, and rows do not depend on partitions."""
    docs = table(spark, corpus()).select("doc_id", "text")
    top = Path(re.sub("^file:/*", "/", scratch.scratch_dir(spark)))
    before, rows = set(top.glob("*")), [sorted(map(repr, suffix_dedup.dedup(docs.repartition(n)).collect())) for n in (24, 1)]
    assert rows[0] == rows[1]
    assert max(len(list(d.glob("*.parquet"))) for d in set(top.glob("*")) - before) <= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize(("block", "klass"), [(suffix_dedup.BLOCK, suffix_dedup.CLASS), (60, suffix_dedup.CLASS), (60, 700)])
def test_repeats_are_all_maximal_groups(spark, block, klass):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abé") for _ in range(n))
    base, other = word(90), word(30)
    rows = [(i, x, "en", "s") for i, x in enumerate([base, base[10:70] + "x" + other, other + base[30:], word(40) + other, base, None, "", "ab" * 20, "y" + base[5:60] + base[5:40]])]
    got = collections.defaultdict(set)
    for r in suffix_dedup.repeats(table(spark, rows).withColumn("node", F.lit("clash")), 16, 4, block, klass).collect():
        got[r.grp].add((r.doc_id, r.start, r.length))
    text = {i: (t or "").encode() for i, t, *_ in rows}
    groups = set()
    for own in got.values():
        (w,) = {text[i][p : p + n] for i, p, n in own}
        groups.add((w, frozenset((i, p) for i, p, _ in own)))
    assert groups == brute_repeats(rows, 16) and len(groups) == len(got)


@pytest.mark.parametrize("block", [suffix_dedup.BLOCK, 1000, 250])
def test_a_long_passage_is_one_group(spark, block):
    rng = random.Random(1)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(1000))
    rows = [(i, f"{'vwxyz'[i]} head {i}{'pqrst'[i]}{shared}{'klmno'[i]} tail {i * 7}", "en", "s") for i in range(5)]
    got = [(r.grp, r.length, r.doc_id, r.start) for r in suffix_dedup.repeats(table(spark, rows), block=block).collect()]
    assert len({g for g, *_ in got}) == 1 and sorted((n, i, p) for _, n, i, p in got) == [(1000, i, 9) for i in range(5)]
    assert suffix_dedup.repeats(table(spark, [])).count() == 0


# 3: line dedup


def test_line_dedup(spark):
    own = [" ".join(f"{c}{x}" for x in "pqrstu") for c in "abcdefghij"]
    rows = [(i, f"{own[i]}\nOrder 10{i} was shipped to you\nOrder ready was shipped now\n\nsame boilerplate line here", "en", "s") for i in range(8)]
    rows += [(None, "same boilerplate line here", "en", "s"), (99, None, None, None), (98, "", "en", "s"), (97, "  same\tboilerplate line  here ", "en", "s"), rows[0]]
    df = table(spark, rows).withColumn("n_lines", F.lit("clash"))
    got = {(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup(df).collect()}
    assert (0, rows[0][1], 5, 0) in got and (99, None, 0, 0) in got and (98, "", 1, 0) in got and (97, "", 1, 1) in got
    assert (3, own[3] + "\n", 5, 3) in got and (None, "", 1, 1) in got
    few = line_dedup.dedup(table(spark, rows[:4]))
    assert few.filter("n_dropped > 0").count() == 0 and line_dedup.dedup(df.limit(0)).count() == 0
    line_dedup.BROADCAST_LEAVES, old = 0, line_dedup.BROADCAST_LEAVES
    assert {(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup(df).collect()} == got
    line_dedup.BROADCAST_LEAVES = old


def brute_lines(rows, leading=3, min_docs=5, share=0.7, long=50, long_docs=2):
    """(doc_id, text that stays) of each row: documents are distinct (id, text) pairs, counted as sets all along."""
    split = lambda t: [tuple("<*>" if re.search("[0-9]", w) else w for w in re.findall(r"[^\x20\x09\x0B-\x0D]+", x)) for x in (t or "").split("\n")]
    holders = collections.defaultdict(set)
    for i, t, *_ in rows:
        for w in split(t):
            if w:
                holders[w].add((i, t))
    leaf = lambda w: (len(w), w[:leading])
    at = collections.defaultdict(set)
    for w, docs in holders.items():
        for k, x in enumerate(w):
            if x != "<*>":
                at[leaf(w), k, x] |= docs
    shape = {w: tuple((k, x) for k, x in enumerate(w) if len(at.get((leaf(w), k, x), ())) >= min_docs) for w in holders}
    teams = collections.defaultdict(set)
    for w, s in shape.items():
        if s and len(s) * 1000 >= len(w) * round(share * 1000):
            teams[leaf(w), s] |= holders[w]
    rank = lambda i: 2**63 - 1 if i is None else i
    owner = {}
    for w, s in shape.items():
        if s and len(s) * 1000 >= len(w) * round(share * 1000) and len(team := teams[leaf(w), s]) >= min_docs:
            owner[w] = min(rank(i) for i, _ in team)
        elif len(w) >= long and sum(x != "<*>" for x in w) * 1000 >= len(w) * round(share * 1000) and len(holders[w]) >= long_docs:
            owner[w] = min(rank(i) for i, _ in holders[w])
    out = []
    for i, t, *_ in rows:
        if t is None:
            out.append((i, None))
        else:
            out.append((i, "\n".join(x for x, w in zip(t.split("\n"), split(t), strict=True) if owner.get(w, rank(i)) == rank(i))))
    return out


def test_line_dedup_counts_documents(spark):
    """One document with many variants of a template is one document, however many of them it holds."""
    four = "\n".join(f"user {x} has logged in today" for x in ("anna", "bert", "carl", "dora"))
    rows = [(1, four, "en", "s"), (2, "user emil has logged in today\nown words", "en", "s")]
    assert {r.doc_id: r.text for r in line_dedup.dedup(table(spark, rows)).collect()} == {i: t for i, t, *_ in rows}
    numbers = [(i, f"{i} {i + 1} {i + 2} {i + 3}", "en", "s") for i in range(9)]  # nothing but variable fields
    assert line_dedup.dedup(table(spark, numbers)).filter("n_dropped > 0").count() == 0


def test_line_dedup_takes_apart_lines_of_templates_alone(spark, monkeypatch):
    """A leaf that fewer documents reach than a template needs is not counted word by word; passages in it are dropped all the same."""
    passage, taken, enough = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)), [], line_dedup._enough
    monkeypatch.setattr(line_dedup, "_enough", lambda rows, keys, *a: (taken.append(rows.count()) if "word" in keys else None, enough(rows, keys, *a))[1])
    rows = [(i, f"user {x} has logged in" + f"\n{passage}" * (i < 4), "en", "s") for i, x in enumerate(("7", "8", "9", "10", "11"))]
    expected = [(0, rows[0][1])] + [(i, "") for i in range(1, 5)]
    assert sorted((r.doc_id, r.text) for r in line_dedup.dedup(table(spark, rows)).collect()) == expected == sorted(brute_lines(rows))
    assert taken == [4]  # the unmasked words of one line, not the 60 of the passage


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_by_brute_force(spark, seed):
    rng = random.Random(seed)
    stems = ["the quick brown fox jumps over", "order was sent to you by", "a b c d e f"]
    passages = [" ".join(rng.choice("abcdefgh") * 3 for _ in range(n)) for n in (49, 50, 80)]
    rows = []
    for i in range(40):
        lines = []
        for _ in range(rng.randint(0, 5)):
            w = rng.choice(stems).split()
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(1, len(w))] = rng.choice(["x", "y", "7", f"u{rng.choice('klmnop')}"])
            lines.append(rng.choice([" ", "  ", "\t"]).join(w))
        lines += [x for x in passages if rng.random() < 0.08] + [""] * rng.randint(0, 1)
        rows.append((rng.choice([i, i, i, None]), "\n".join(lines) if i % 13 else None, "en", "s"))
    rows += rows[:6]
    got = [(r.doc_id, r.text) for r in line_dedup.dedup(table(spark, rows)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_lines(rows)))


# 4: quality rules


def brute_measure(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    count, hit = collections.Counter(windows), set()
    for i, x in enumerate(windows):
        if count[x] > 1:
            hit.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(hit)


def test_quality_features(spark):
    rows = [*corpus(3), (500, "a\x1cb c\u00a0d\x85e\nq\n\nq\nq# $\n" + "r s t u v w x y z " * 3, "en", "s")]
    df = table(spark, rows).withColumn("n_words", F.lit("clash"))
    got = quality_rules.features(df.select("doc_id", "text", "n_words")).collect()
    assert sorted(map(repr, ((r.doc_id, *(r[c] for c in quality_rules.FEATURES)) for r in got))) == sorted(map(repr, ((i, *brute_measure(t)) for i, t, *_ in rows)))


def test_binomial_tail_and_choice():
    import math

    for n, k, p in ((10, 3, 0.4), (200, 0, 0.01), (50, 50, 0.2), (300, 7, 0.05)):
        exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(min(k, n) + 1))
        assert abs(quality_rules.binomial_tail(k, n, p) - exact) < 1e-12
    assert quality_rules.choose([0, 0, 1, 60], 2000, 0.02, 0.01) == 2 and quality_rules.choose([0], 20, 0.02, 0.01) == -1 and quality_rules.choose([0], 0, 0.02, 0.01) == -1


def test_quality_verdicts(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    clean = lambda: " ".join(word() for _ in range(40))
    rows = [(i, clean() if i % 5 else " ".join(f"{word()}***" for _ in range(40)), "en", "s") for i in range(4000)] + [(5000 + i, " ".join(f"{word()}***" for _ in range(40)), "fr", "s") for i in range(5)] + [(9000, None, None, None), (9001, "a b c", "en", "s"), (9002, "a b c d e f g h i " * 5, "en", "s")]
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(4000)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_rules.judge(table(spark, rows), labels).collect()}
    assert all(got[i].kept == bool(i % 5) for i in range(4000)) and all(got[5000 + i].kept for i in range(5))
    assert got[9000].base_failed and not got[9000].kept and got[9001].base_failed and got[9002].base_failed
    none = quality_rules.judge(table(spark, rows[:50]), labels.limit(0))
    assert none.filter("not base_failed and not kept").count() == 0 and quality_rules.judge(table(spark, []), labels).count() == 0


def test_binomial_tail_far_above_the_mean():
    for n in (1_000, 5_000, 10_000, 100_000, 1_000_000):
        mean = n // 200
        for k in (mean + 1, 2 * mean, n // 20, n // 4, n // 2, n - 1):
            assert quality_rules.binomial_tail(k, n, 0.005) > 0.5
        tails = [quality_rules.binomial_tail(k, n, 0.005) for k in range(max(0, mean - 50), mean + 50)]
        assert tails == sorted(tails) and tails[0] < 0.5 < tails[-1]
        # One step of the grid from none to a quarter of the good documents: only the cutoffs before it hold.
        assert quality_rules.choose([0, n // 4, n // 4, n // 2], n, 0.005, 0.05) == 0
    exact = sum(math.comb(1000, x) * 0.005**x * 0.995 ** (1000 - x) for x in range(10))
    assert abs(quality_rules.binomial_tail(9, 1000, 0.005) - exact) < 1e-12


# 5: chat quotes


def test_chat_quotes(spark):
    rows = [
        (1, 0, "user", "How do I sort a list?\nAlso, what is a tuple?"), (1, 1, "assistant", "A tuple cannot change."),
        (1, 2, "user", "Anna wrote:\n> How do I  SORT a list?\n\nUse sorted()."), (1, 3, "user", ">> How do I sort a list?\n> Use sorted().\nThanks!"),
        (1, 4, None, "> words nobody said\nown"), (2, 0, "user", "> How do I sort a list?\nother talk"), (2, 1, "user", None), (None, 0, "user", "> x"), (1, 3, "user", ">> How do I sort a list?\n> Use sorted().\nThanks!"),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, depth string")
    got = {(r.conv_id, r.turn): r for r in chat_quotes.conversations(df).collect()}
    assert chat_quotes.conversations(df).count() == len(rows)
    assert [(got[1, t].parent_turn, got[1, t].root_turn, got[1, t].depth) for t in range(5)] == [(None, 0, 0), (None, 1, 0), (0, 0, 1), (2, 0, 2), (None, 4, 0)]
    assert got[1, 2].clean_text == "Use sorted()." and got[1, 3].clean_text == "Thanks!" and got[1, 3].n_quoted == 2
    assert got[2, 0].parent_turn is None and got[2, 1].clean_text == "" and got[1, 4].formatted == "<|unknown|>\nown"
    assert chat_quotes.conversations(df.limit(0)).count() == 0


def test_reply_order_and_blocks(spark):
    rows = [
        (1, 0, "user", "intro\n\nfirst line of it\nand the second\n\nend"), (1, 1, "user", "> first line of\n> it and\n> the second\nyes"), (1, 2, "user", "> first line of it\nno"),
        (1, 3, "user", "> yes\nwhy"), (1, 4, "user", "> no\nbecause"), (2, 0, "user", ""), (2, None, "user", "> x"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("path", "formatted", "root_turn")})
    got = chat_quotes.conversations(df)
    assert [r.turn for r in got.filter("conv_id = 1").orderBy("conv_id", "path").collect()] == [0, 1, 3, 2, 4]
    assert {r.turn: r.path for r in got.filter("conv_id = 1").collect()} == {0: [0], 1: [0, 1], 2: [0, 2], 3: [0, 1, 3], 4: [0, 2, 4]}


def test_quoting_links_what_it_quotes(spark):
    rows = [(c, t, "user", f"message {t} of {c}\n\nwith a second part {t}") for c in range(3) for t in range(8)] + [(9, 0, "user", None), (9, 1, "user", "x")]
    got = {(r.conv_id, r.turn): (r.parent_turn, r.depth, r.clean_text) for r in chat_quotes.conversations(chat_quotes.quoting(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    for c in range(3):
        assert [got[c, t][:2] for t in range(8)] == [(None, 0), (0, 1), (1, 2), (1, 2), (None, 0), (4, 1), (5, 2), (5, 2)]
        assert all(got[c, t][2] == f"message {t} of {c}\n\nwith a second part {t}" for t in range(8))
    assert got[9, 0] == (None, 0, "") and got[9, 1] == (None, 0, "x")


def test_deep_threads(spark):
    rows = [(1, i, "user", (f"> message {i - 1}\n" if i else "") + f"message {i}") for i in range(40)]
    got = {r.turn: (r.parent_turn, r.root_turn, r.depth) for r in chat_quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {0: (None, 0, 0)} | {i: (i - 1, 0, i) for i in range(1, 40)}


# 6: fingerprints


def brute_fingerprint(text, k=3, least=2, bins=64):
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    long = lambda v, seed: xxhash.xxh64_intdigest(struct.pack("<q", v), seed=seed)
    s = re.findall(r"[^\x20\x09-\x0D]{1,16}", text)
    if not s:
        return []
    top = 2 ** (63 - fingerprints.POS)
    kmers = []
    for i in range(max(len(s) - k, 0) + 1):
        h = 42
        for j in range(k):
            if i + j < len(s):
                h = xxhash.xxh64_intdigest(s[i + j].encode(), seed=h)
        kmers.append(signed(h))
    seen, packed = collections.Counter(), []
    for i, h in enumerate(kmers):
        packed.append((signed(long(seen[h], long(h % top, 42))) % top, i))
        seen[h] += 1
    ordered, out = sorted(packed), []
    for b in range(bins):
        first = next((k for k, (h, _) in enumerate(ordered) if int(h / (top / bins)) >= b), 0)
        own = {ordered[(first + d) % len(ordered)][1] for d in range(min(least, len(ordered)))}
        h = 42
        for i in sorted(own):
            h = long(kmers[i], h)
        out.append(f"{h & 0xFFFFFFFF:08x}")
    return out


def test_fingerprints(spark):
    rows = corpus(6)
    rows = [r for r in rows if r[0] not in (None, 7)] + [(7, "a a a a a a a a b", "en", "s")]
    rows = list({r[0]: r for r in rows}.values())
    got = {r.doc_id: r for r in fingerprints.compare(table(spark, rows)).collect()}
    ordered = sorted(rows)
    for (i, t, *_), (_, u, *_) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        t, u = t or "", u or ""
        edited = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        a, b, c = brute_fingerprint(t), brute_fingerprint(edited), brute_fingerprint(u)
        like = lambda x, y: 1.0 if not x and not y else sum(p == q for p, q in zip(x, y, strict=False)) / 64
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (" ".join(a), " ".join(b)) and (r.near_edited, r.near_next) == (like(a, b), like(a, c))


def test_fingerprints_edges(spark):
    odd = table(spark, [(None, "a b c d", "en", "s"), (5, None, None, None), (5, "x y", "en", "s"), (5, "x y", "en", "s")])
    assert fingerprints.compare(odd).count() == 4 and fingerprints.compare(odd.limit(0)).count() == 0
    one = fingerprints.compare(table(spark, [(1, "alone here", "en", "s")])).first()
    assert one.near_next == 1.0
    clash = odd.withColumns({c: F.lit("clash") for c in ("signature", "edited", "fingerprint", "next_text")})
    assert fingerprints.compare(clash).count() == 4


@pytest.mark.parametrize(("bucket", "fan"), [(30, 64), (30, 4), (10**9, 64)])
def test_next_rows_in_any_buckets(spark, monkeypatch, bucket, fan):
    """Clustered ids, an outlier, repeated rows, null ids, one long text."""
    monkeypatch.setattr(fingerprints, "BUCKET", bucket)
    monkeypatch.setattr(fingerprints, "FAN", fan)
    rows = [(i * i if i % 3 else 10**15 + i, f"text {i}" * (200 if i == 7 else 1), "en", "s") for i in range(150)] + [(None, "none", "en", "s"), (-(10**18), "least", "en", "s")]
    df = table(spark, rows).withColumn("_hash", F.xxhash64("text"))
    after = {r.doc_id: r.next_text for r in fingerprints.with_next(df, ("text",), ("doc_id", "_hash"), F.octet_length("text")).collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert after == {a[0]: b[1] for a, b in zip(ordered, ordered[1:] + ordered[:1], strict=True)}
    again = table(spark, [(5, "same", "en", "s")] * 40 + [(6, "other", "en", "s")]).withColumn("_hash", F.xxhash64("text"))
    got = collections.Counter((r.text, r.next_text) for r in fingerprints.with_next(again, ("text",), ("doc_id", "_hash"), F.octet_length("text")).collect())
    assert got == {("same", "same"): 39, ("same", "other"): 1, ("other", "same"): 1}


def test_order_counts_in_short_texts(spark):
    """Halves of a text changed about: the k-mers are almost the same ones, their order is not."""
    rng = random.Random(5)
    rows = []
    for i, n in enumerate((30, 66, 400)):
        w = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        rows += [(2 * i, " ".join(w), "en", "s"), (2 * i + 1, " ".join(w[n // 2 :] + w[: n // 2]), "en", "s")]
    near = {r.doc_id: r.near_next for r in fingerprints.compare(table(spark, rows)).collect()}
    assert all(near[2 * i] < 0.66 for i in range(3))


# 7: mixing


def brute_targets(sizes, weights, epochs=3):
    total, fixed = sum(sizes), {}
    while True:
        left = total - sum(fixed.values())
        free = [i for i in range(len(sizes)) if i not in fixed]
        level = left / sum(weights[i] for i in free) if free else 0
        over = [i for i in free if level * weights[i] >= epochs * sizes[i]]
        if not over:
            return [fixed.get(i, level * weights[i]) for i in range(len(sizes))]
        fixed |= {i: epochs * sizes[i] for i in over}


def test_mixing(spark):
    rows = corpus(7, 80)
    got = mixing.plan(table(spark, rows)).collect()
    size = lambda t: len(WORD.findall(t or ""))
    names = sorted({r[3] for r in rows if r[3] is not None}) + [None]
    sizes = [sum(size(t) for _, t, _, s in rows if s == x) for x in names]
    targets = brute_targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))])
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(i), size(t)) for i, t, *_ in rows)
    for name, target, n in zip(names, targets, sizes, strict=True):
        own = [r for r in got if r.source == name]
        assert all(abs(r.target - target) < 1e-6 and r.source_size == n and 0 <= r.taken <= 3 * r.size for r in own) and sum(r.taken for r in own) == round(target)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.plan(table(spark, rows).repartition(7)).collect()))
    assert mixing.plan(table(spark, [])).count() == 0 and {r.taken for r in mixing.plan(table(spark, [(1, None, "en", "s"), (2, " ", "en", None)])).collect()} == {0}


def test_mixture_rows(spark):
    rows = [r for r in corpus(8, 50)[:50]]
    taken = {r.doc_id: r.taken for r in mixing.plan(table(spark, rows)).collect()}
    out = collections.defaultdict(list)
    for r in mixing.expand(table(spark, rows)).collect():
        out[r.doc_id].append(r.text)
        assert r.n_chars == len(r.text)
    text = {r[0]: r[1] for r in rows}
    assert {i: sum(len(WORD.findall(t)) for t in ts) for i, ts in out.items()} == {i: n for i, n in taken.items() if n}
    assert all(text[i].startswith(t) for i, ts in out.items() for t in ts)


def test_equal_rows_share_every_word(spark):
    """What does not divide among equal rows is handed out, too: no word of a source's target is lost."""
    rows = [(1, "a b c d e", "en", "s1")] * 7 + [(2, "f g h", "en", "s1"), (3, "x " * 40, "en", "s2"), (4, "y", "en", None), (5, None, "en", "s1")]
    plan = mixing.plan(table(spark, rows)).collect()
    out = mixing.expand(table(spark, rows).withColumns({c: F.lit("clash") for c in ("size", "target", "taken")})).collect()
    for source in ("s1", "s2", None):
        assert sum(len(WORD.findall(r.text)) for r in out if r.source == source) == sum(r.taken for r in plan if r.source == source)
    assert {r.size for r in out} == {"clash"} and mixing.expand(table(spark, [])).count() == 0


# 8: toxicity


def test_toxicity(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("aeioulnrstd") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    bad = ["stupid", "moron", "worthless", "vermintisch"]
    rows, labels = [], []
    for i in range(600):
        t = [rng.choice(words) for _ in range(rng.randint(15, 40))]
        if i % 4 == 0:
            t.insert(rng.randrange(len(t)), rng.choice(bad))
        rows.append((i, " ".join(t), "en", "s"))
        labels.append((i, int(i % 4 == 0)))
    hidden = ["st*pid", "m0r0n", "w o r t h l e s s", "stuuuupid", "s.t.u.p.i.d", "$tup1d", "MORON", "worthl3ss!", "s,t,u,p,i,d", "s~t~u~p~i~d", "m'o'r'o'n", "stuupid", "mmorronn", "s  t \t u\np i d", "s t u p i d.", '"s t u p i d"', "(moron)", "$tupid", "m0r0n!!"]
    rows += [(1000 + i, " ".join(rng.choice(words) for _ in range(20)) + f" {x} " + rng.choice(words), "en", "s") for i, x in enumerate(hidden)]
    rows += [(2000 + i, x, "en", "s") for i, x in enumerate(["", " \n", None, "12345 +1 (555) 010-2000 *** $$$", "z" * 20_000 + " " + "a1!" * 9000, "1a" * 3000, rng.choice(words) + " 3.14 a b c"])]
    df = table(spark, rows).withColumn("score", F.lit("clash"))
    model = toxicity.fit(df, spark.createDataFrame([*labels, (None, 1), (3, None), (4, 0)], "doc_id long, toxic int"))
    got = {r.doc_id: r.predicted for r in toxicity.score(df, model).collect()}
    assert all(got[i] == int(i % 4 == 0) for i in range(600)) and all(got[1000 + i] for i in range(len(hidden))), [x for i, x in enumerate(hidden) if not got[1000 + i]]
    assert not any(got[2000 + i] for i in range(7))
    longs = toxicity.fit(df, spark.createDataFrame([*labels, (None, 1), (3, None), (4, 0)], "doc_id long, toxic long"))
    assert longs.weights == model.weights and longs.bias == model.bias
    for r in toxicity.score(df, model).collect()[::7]:  # the score by hand: features one by one, without tables or caches
        words, hit = model.words(r.text), set()
        for w in words:
            for x in (w, *(w[:n] + "-" for n in toxicity.HEADS if len(w) >= n)):
                hit |= {x} & model.weights.keys()
        short = lambda x: re.sub(r"(.)\1+", r"\1", x)
        for w in words:
            if (c := short(w)) != w:
                same = {f for f in model.weights if short(f) in (c, *(c[:n] + "-" for n in range(1, len(c) + 1)))}
                if same:
                    hit |= same | {x for v in model.viterbi(w) for x in (v, *(v[:n] + "-" for n in toxicity.HEADS if len(v) >= n)) if x in model.weights}
        assert abs(r.score - 1 / (1 + math.exp(-model.bias - sum(model.weights[x] for x in hit)))) < 1e-9
    plain = toxicity.fit(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(0 <= r.score < 0.3 for r in toxicity.score(df, plain).collect()) and toxicity.score(df.limit(0), plain).count() == 0
    ids = spark.createDataFrame([(i,) for i in range(50)], "doc_id long").withColumn("h", toxicity.held_out("doc_id"))
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in ids.collect())


def brute_reading(log, token):
    """The least cost of all readings of a short token, and those that have it, by trying every choice for every character."""
    n, found = toxicity.N, []

    def walk(i, a, b, cost, letters):
        if i == len(token):
            found.append((cost - (log[(a * n + b) * n] if b else 0.0), tuple(letters)))
            return
        sign, code = token[i], toxicity._OF.get(token[i], 0)
        again, gap = i > 0 and sign == token[i - 1], sign in toxicity.SEPARATORS or sign not in toxicity.LOOKALIKES
        if code:
            ways = [(code, 0.0)]
        elif sign.isalpha():
            ways = [(0, 0.0)]
        else:
            ways = [(toxicity._OF[c], toxicity.STAR if sign == "*" else toxicity.SUBSTITUTE) for c in toxicity.LOOKALIKES.get(sign, "")] + [(0, toxicity.BREAK if gap else toxicity.LOSE)]
        for c, price in ways:
            if c == 0 and b == 0:
                walk(i + 1, a, b, cost + price, letters)
            else:
                walk(i + 1, b, c, cost + price - log[(a * n + b) * n + c], [*letters, c])
        if not code or again:
            walk(i + 1, a, b, cost + (toxicity.REPEAT if again else toxicity.DROP if gap else toxicity.LOSE), letters)

    walk(0, 0, 0, 0.0, [])
    return min(found)[0], {x for c, x in found if c < min(found)[0] + 1e-6}


def test_viterbi_is_exact(monkeypatch):
    rng = random.Random(90)
    counts = np.random.default_rng(90).integers(0, 50, toxicity.N**3) * (np.random.default_rng(91).random(toxicity.N**3) < 0.05)
    model = toxicity.Model.of(counts)
    log = model.trigrams.tolist()
    for settle in (toxicity.SETTLE, 2):
        monkeypatch.setattr(toxicity, "SETTLE", settle)
        for _ in range(80):
            token = "".join(rng.choice("aab1!*0. -6я") for _ in range(rng.randint(1, 6)))
            _, best = brute_reading(log, token)
            words = {tuple("".join(toxicity.LETTERS[c - 1] if c else " " for c in x).split()) for x in best}
            assert model.viterbi(token) in words


def test_tokens_of_a_megabyte():
    import time
    import tracemalloc

    model = toxicity.Model.of(np.random.default_rng(9).integers(0, 5, toxicity.N**3))
    for unit in ("1a", "z", "*", "a!", "1"):
        tracemalloc.start()
        began, peaks = time.time(), []
        for size in (10_000, 20_000):
            tracemalloc.reset_peak()
            model.viterbi(unit * (size // len(unit)))
            peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert time.time() - began < 60 and max(peaks) < 20_000_000, (unit, peaks)
    model._log, began = None, time.time()
    model.score("a1" * 500_000)
    assert time.time() - began < 60


def test_logistic_is_at_its_least():
    rng = np.random.default_rng(9)
    rows = [sorted(set(rng.integers(0, 12, rng.integers(0, 5)).tolist())) for _ in range(400)]
    toxic = np.array([float(rng.random() < (0.8 if 3 in r else 0.2)) for r in rows])
    weight = rng.random(400) + 0.1
    at, of = np.repeat(np.arange(400), [len(r) for r in rows]), np.array([k for r in rows for k in r])
    w, b = toxicity.logistic(at, of, toxic, weight, 12, 0.5, 3000)
    x = np.zeros((400, 12))
    for i, r in enumerate(rows):
        x[i, r] = 1
    gap = weight * (1 / (1 + np.exp(-(x @ w + b))) - toxic)
    assert np.abs(x.T @ gap + 0.5 * w).max() < 1e-5 and abs(gap.sum()) < 1e-5 and w[3] > 1


# 9: packing


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    rows = [*corpus(10), (800, "a <|endoftext|> b\u3042\u00a0\u2003c 's 12", "en", "s"), (801, "x" * 5000, "en", "s")]
    for options in ({}, {"fan_in": 2, "slack": 0}):
        clash = table(spark, rows).withColumns({c: F.lit("clash") for c in ("size", "n", "grp", "rank", "length", "offset", "piece", "done")})
        got = packing.pack(clash.repartition(5), **options).collect()
        bins = collections.defaultdict(list)
        for r in got:
            bins[r.sequence_id].append((r.offset, r.length))
        for b in bins.values():
            b.sort()
            assert all(o == sum(n for _, n in b[:k]) for k, (o, _) in enumerate(b)) and sum(n for _, n in b) <= 1024
        expected = []
        for i, t, *_ in rows:
            ids = reference.encode(t or "", add_special_tokens=False).ids + [2]
            n = len(ids)
            at = [0, *range(n % 1024 or 1024, n, 1024), n] if n > 1024 else [0, n]
            expected += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(at, at[1:], strict=False))]
        assert sorted(map(repr, ((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got))) == sorted(map(repr, expected))
        assert len(bins) <= -(-sum(r.length for r in got) // 1024) + 1
    assert packing.pack(table(spark, [])).count() == 0


def test_ids_are_those_of_the_tokenizers_library():
    """Every text of a test table, other scripts, and long runs of one kind."""
    import duckdb
    import public_tokenizers
    from tokenizers import Tokenizer

    reference, own = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY)), packing.encoder(packing.VOCABULARY)
    texts = [x for (x,) in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    texts += ["Привет, мир! Это тест", "你好,世界。这是一个测试", "مرحبا بالعالم", "हिन्दी पाठ यहाँ", "한국어 텍스트", "日本語のテキスト\u3000です", "👩‍👩‍👧 emoji 🇩🇪", "a\u0301e\u0308 \u200b\u200d \ufeff", "\x00\x01\x1f\x7f\x85", "½²³ ⅷ ٣٤", "I'll don't WE'RE 's'S", "\r\n\t  \n\n x  "]
    texts += ["x" * 20_000, " " * 20_000, "\n" * 5_000, "9" * 20_000, "ab" * 10_000, "é" * 5_000, "a b" * 5_000 + " <|endoftext|>"]
    for t in texts:
        if t is not None:
            assert list(own(t)) == reference.encode(t, add_special_tokens=False).ids


def test_clustered_sizes_meet_across_partitions(spark):
    """Partitions of 600 tokens alone and of 424 alone: every sequence is full, which no partition can do by itself."""
    sizes = table(spark, [(i, " a" * (599 if i < 300 else 423), "en", "s") for i in range(600)]).repartitionByRange(6, "doc_id")
    for runs in (packing.BROADCAST_RUNS, 0):
        packing.BROADCAST_RUNS, old = runs, packing.BROADCAST_RUNS
        bins = collections.defaultdict(int)
        for r in packing.pack(sizes, fan_in=2).collect():
            bins[r.sequence_id] += r.length
        packing.BROADCAST_RUNS = old
        assert len(bins) == 300 and set(bins.values()) == {1024}


def test_best_fit():
    bins, offsets, fills = packing.best_fit([5, 4, 3, 3, 5, 10], 10)
    assert sorted(fills) == [10, 10, 10] and max(offsets) < 10 and len(set(bins)) == 3


def test_best_fit_of_histograms_is_that_of_items():
    rng = random.Random(10)
    for _ in range(60):
        length = rng.choice([10, 64, 1024])
        counts = {n: [(c, rng.randint(1, 40)) for c in range(rng.randint(1, 3))] for n in {rng.randint(1, length) for _ in range(rng.randint(1, 30))}}
        runs, alike = packing.best_fit_runs(counts, length)
        items = sorted((c, n, first + i) for c, n, first, many, *_ in runs for i in range(many))
        assert items == sorted((c, n, i) for n, own in counts.items() for c, k in own for i in range(k))
        held = collections.defaultdict(list)
        for c, n, _, many, instance, offset in runs:
            for i in range(many):
                held[instance + i].append((offset, n))
        fill = {at + i: f for at, n, f in alike for i in range(n)}
        assert fill.keys() == held.keys()
        for b, own in held.items():
            own.sort()
            assert all(o == sum(n for _, n in own[:k]) for k, (o, _) in enumerate(own)) and sum(n for _, n in own) == fill[b] <= length
        assert len(fill) <= len(packing.best_fit([n for n, own in counts.items() for _, k in own for _ in range(k)], length)[2])


# 10: Jaccard join


def brute_components(rows, num=90, den=100):
    def shingles(t):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set())

    sets = [shingles(t) for _, t, *_ in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
                links[i] += 1
                links[j] += 1
    least = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(s), least.get(root(i)) if s else d, n) for i, ((d, *_), s, n) in enumerate(zip(rows, sets, links, strict=True))]


@pytest.mark.parametrize(("block", "elements", "broadcast"), [(1024, 2_000_000, 1_000_000), (4, 2_000_000, 0), (1024, 700, 1_000_000)])
def test_jaccard_join(spark, monkeypatch, block, elements, broadcast):
    rng = random.Random(11)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    near = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        near.append((3000 - i, " ".join(w) if i % 2 else "  ".join(w).upper(), "en", "s"))
    rows = [*corpus(11), *near, (600, "Aa bb", "en", "s"), (601, "aA  BB", "en", "s"), (602, "aa", "en", "s")]
    for name, value in (("BLOCK", block), ("ELEMENTS", elements), ("BROADCAST_NODES", broadcast)):
        monkeypatch.setattr(jaccard_join, name, value)
    got = jaccard_join.linked(table(spark, rows).withColumns({c: F.lit("clash") for c in ("node", "n_shingles", "copies", "group")})).collect()
    assert sorted(map(repr, ((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got))) == sorted(map(repr, brute_components(rows)))
    assert jaccard_join.linked(table(spark, [])).count() == 0


def test_jaccard_links_hold_little():
    rng = np.random.default_rng(13)
    base, sets = rng.integers(0, 2**64, 5000, dtype=np.uint64), []
    for _ in range(80):
        s, n = base.copy(), int(rng.integers(40, 200))  # some pairs above the threshold, some below
        s[rng.integers(0, len(s), n)] = rng.integers(0, 2**64, n, dtype=np.uint64)
        sets.append(np.unique(s))
    copies = rng.integers(1, 5, len(sets))
    for left in (np.zeros(len(sets), bool), np.arange(len(sets)) % 2 == 0):
        tracemalloc.start()
        found, degree = jaccard_join.links(sets, left, 90, 100, copies)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        alike = np.array([[100 * len(np.intersect1d(a, b)) >= 90 * len(np.union1d(a, b)) for b in sets] for a in sets]) & ~np.eye(len(sets), dtype=bool)
        if left.any():
            alike &= left[:, None] != left[None, :]
        assert degree.tolist() == (alike * copies).sum(1).tolist() and 0 < alike.sum() < 0.9 * alike.size
        assert all(alike[u, v] for u, v in found)
        assert peak < 40 * sum(map(len, sets))


def test_jaccard_links_in_few_files(spark):
    words = [[f"w{i}x{j}" for j in range(60)] for i in range(80)]
    rows = [(2 * i + k, " ".join(w[k:]), "en", "s") for i, w in enumerate(words) for k in (0, 1)]
    _, found, degrees = jaccard_join.join(table(spark, rows))
    assert (found.count(), degrees.count()) == (80, 160)
    assert len(found.inputFiles()) == 1


def test_signatures_never_miss():
    rng = np.random.default_rng(12)
    for _ in range(400):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        drop = int(rng.integers(0, max(1, len(a) // 9) + 1))
        b = np.unique(np.concatenate((rng.permutation(a)[drop:], rng.integers(0, 2**64, int(rng.integers(0, drop + 1)), dtype=np.uint64))))
        inter = len(np.intersect1d(a, b))
        if inter and 100 * inter >= 90 * (len(a) + len(b) - inter):
            assert len(np.intersect1d(jaccard_join.signatures(a), jaccard_join.signatures(b)))
