"""Toxicity: noisy-channel deobfuscation, then a linear model's score of the restored text.

The channel: a letter may be written as a look-alike ("1d10t"), hidden by a star ("st*pid"), repeated ("loooser") or set
apart from the next one ("s t u p i d", "s.c.u.m"). Every token that shows such signs becomes a lattice of what each of
its characters may stand for; Viterbi finds the likeliest reading under a character trigram model counted over all
documents, exactly: no state is cut. Signs at the ends of a token may be letters or punctuation, so such a token is read both ways.
A letter doubled only opens a lattice where a feature of the model could be in it.

The features of a text are its words and their heads, as written and as restored. Those that are commoner or rarer in toxic documents than
chance allows enter a logistic regression with an L2 penalty, in which near copies share one document's weight. Only the text
enters a score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import written

#: Look-alikes: what a sign may stand for (fixed values).
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¥": "y", "*": "aeiou"}
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœß"
#: Natural-log costs of the channel: a look-alike, a star, a separator left out or taken as a gap, any other sign so, a repeated letter left out.
SUBSTITUTE, STAR, DROP, BREAK, LOSE, REPEAT = 0.7, 2.0, 1.0, 3.0, 12.0, 1.0
SEPARATORS = " \t.,-_*'`~"
#: Labelled documents to fit on at most, families of documents that a feature must be in, standard deviations between its share of toxic
#: documents and that of all, and the penalty of the squared weights.
FIT_ROWS, LEAST_DOCS, DEVIATIONS, PENALTY = 20_000, 5, 3.0, 1.0
THRESHOLD = 0.3
HEADS = (4, 5, 6, 7, 8)
N = len(LETTERS) + 1  # 0: anything between words
#: Characters after which paths are followed back to where they part, so that what is settled can go; a longer run of one sign is read as so many.
SETTLE, RUN = 512, 16
CACHE, CACHED_LENGTH = 200_000, 40

_word = re.compile(r"[^\W\d_]+")
_any = re.compile(r"[0-9@$!|+(€£¥*.,\-_'`~]")
_thrice = re.compile(r"([^\W\d_])\1\1")
_one = r"[\"'(\[{<.,:;!?-]{0,2}(?:[^\W_]|[@$!|+*(€£¥])[\"')\]}>.,:;!?-]{0,2}"
_apart = re.compile(rf"(?<!\S){_one}(?:\s+{_one}){{2,}}(?!\S)")
_run = re.compile(r"(.)\1+", re.S)
_long = re.compile(r"(.)\1{%d,}" % RUN, re.S)
_edge = "\"'.,;:?!()[]{}<>#%&*-_~`"
_hull = _edge + "$|+@€£¥"  # signs that may be letters at an end, too
_plain = "\"'.,;:?)[]{}<>#%&-_~`"  # signs that cannot


def _codes() -> np.ndarray:
    of = np.zeros(0x250, np.int64)
    for i, c in enumerate(LETTERS, 1):
        of[ord(c)] = i
    return of


_CODE = _codes()
_OF = {c: i for i, c in enumerate(LETTERS, 1)}


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of letter trigrams over all whole texts, as N * N * N numbers: each task sums its own, and the sums are added by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(N**3, np.int64)
        for b in batches:
            for x in b.column(0):
                if text := x.as_py():
                    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), np.uint32)
                    code = np.where(points < 0x250, _CODE[np.minimum(points, 0x24F)], 0)
                    code = code[np.concatenate(([True], (code[1:] != 0) | (code[:-1] != 0)))]
                    total += np.bincount(code[:-2] * (N * N) + code[1:-1] * N + code[2:], minlength=N**3) if len(code) > 2 else 0
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], names=["cell", "n"])

    found = docs.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # N * N * N cells at most
    counts = np.zeros(N**3, np.int64)
    for cell, n in found:
        counts[cell] = n
    return counts


@dataclass
class Model:
    """What executors need: log P(c | a, b), and the weights of features. Bounded by N and the features of FIT_ROWS documents, whatever the input."""

    trigrams: np.ndarray
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    _log: list[float] | None = None
    _seen: dict[str, tuple[str, ...]] = field(default_factory=dict)
    _known: dict[str, tuple[str, ...]] = field(default_factory=dict)
    _short: tuple | None = None

    def __getstate__(self):
        return self.__dict__ | {"_log": None, "_seen": {}, "_known": {}, "_short": None}

    @classmethod
    def of(cls, counts: np.ndarray) -> Model:
        c3 = counts.reshape(N, N, N).astype(np.float64)
        c2, c1 = c3.sum(0), c3.sum((0, 1))
        p1 = (c1 + 0.5) / (c1 + 0.5).sum()
        p2 = (c2 + 20 * p1) / (c2.sum(1, keepdims=True) + 20)
        p3 = (c3 + 20 * p2) / (c3.sum(2, keepdims=True) + 20)
        return cls(np.log(p3).astype(np.float32).ravel())

    def restore(self, token: str) -> tuple[str, ...]:
        """The words of the likeliest readings of a token (or run of single characters), lower-cased: of what is between the signs at its
        ends, and with those signs as letters, where they may be, or as letters or nothing.

        The latter are left out where a plain word is followed by such signs and no feature of a fitted model goes on from that word."""
        if (known := self._seen.get(token)) is None:
            inner, core, known = token.strip(_edge), token.strip(_plain), ()
            if inner and (not inner.isalpha() or _thrice.search(inner)):
                known = self.viterbi(inner)
            if core != token.strip(_hull):
                lead = _word.match(core)
                alone = lead and len(lead[0]) >= max(HEADS) and not core[lead.end() :].strip(_hull) and self.weights and _run.sub(r"\1", lead[0]) not in self._index()[3]
                if not alone:
                    known += self.viterbi(core) + self.viterbi(core, ends=True)
            known = tuple(dict.fromkeys(known))
            if len(token) <= CACHED_LENGTH:
                if len(self._seen) >= CACHE:
                    self._seen.clear()
                self._seen[token] = known
        return known

    def viterbi(self, token: str, ends: bool = False) -> tuple[str, ...]:
        """The words of the likeliest reading. ends: look-alike signs other than digits at either end may be left out like separators."""
        if self._log is None:
            self._log = self.trigrams.tolist()
        token = _long.sub(lambda m: m[0][:RUN], token)
        log, best, back, out, settle = self._log, {0: 0.0}, [], [], SETTLE
        loose = len(token) - len(token.lstrip(_hull)), len(token.rstrip(_hull))

        def follow(state: int, until: int) -> int:
            """Read the first `until` steps of the path to a state, as letters."""
            path = []
            for came in reversed(back[:until]):
                state, c = came[state]
                if c >= 0:
                    path.append(c)
            out.extend(reversed(path))
            return state

        before = ""
        for i, sign in enumerate(token):
            code, again = _OF.get(sign, 0), sign == before
            before = sign
            if code and not again and len(best) == 1 and not back:  # a plain letter after a settled one
                ((state, s),) = best.items()
                best = {state % N * N + code: s + log[state * N + code]}
                out.append(code)
                continue
            if code:
                ways = [(code, 0.0)]
            elif sign.isalpha():
                ways = [(0, 0.0)]  # a letter of another script passes as a gap
            else:
                cost = STAR if sign == "*" else SUBSTITUTE
                gap = sign in SEPARATORS or sign not in LOOKALIKES
                ways = [(_OF[c], cost) for c in LOOKALIKES.get(sign, "")] + [(0, BREAK if gap else LOSE)]
            lost = REPEAT if again else DROP if sign in SEPARATORS or sign not in LOOKALIKES or (ends and not loose[0] <= i < loose[1]) else LOSE
            after: dict[int, float] = {}
            came: dict[int, tuple[int, int]] = {}
            for state, s in best.items():
                b = state % N
                for c, cost in ways:
                    if c == 0 and b == 0:
                        to, t, c = state, s - cost, -1
                    else:
                        to, t = b * N + c, s - cost + log[state * N + c]
                    if t > after.get(to, -1e18):
                        after[to], came[to] = t, (state, c)
                if (not code or again) and (t := s - lost) > after.get(state, -1e18):
                    after[state], came[state] = t, (state, -1)
            best = after
            back.append(came)
            if len(best) == 1:
                follow(next(iter(best)), len(back))
                back.clear()
            elif len(back) >= settle:  # paths that have met before this stretch share all that lies behind
                heads, at = set(best), len(back)
                while at and len(heads) > 1:
                    at -= 1
                    heads = {back[at][h][0] for h in heads}
                if len(heads) == 1:
                    follow(next(iter(heads)), at)
                    del back[:at]
                settle = max(SETTLE, 2 * len(back))
        state = max(best, key=lambda x: best[x] + (log[x * N] if x % N else 0.0))
        follow(state, len(back))
        return tuple("".join(LETTERS[c - 1] if c else " " for c in out).split())

    def _index(self) -> tuple[dict[str, set[str]], set[int], set[int], set[str]]:
        """The model's features by their letters without repetition (heads end in '-'), the lengths of such heads and of heads as they are,
        and the beginnings of words among the former."""
        if self._short is None:
            short: dict[str, set[str]] = {}
            for w in self.weights:
                short.setdefault(_run.sub(r"\1", w), set()).add(w)
            begin = {x[:n] for x in short for n in range(1, len(x) + 1) if not x.endswith("-")}
            self._short = short, {len(x) - 1 for x in short if x.endswith("-")}, {len(x) - 1 for x in self.weights if x.endswith("-")}, begin
        return self._short

    def words(self, text: str | None) -> set[str]:
        """The words of a text, as written and as restored."""
        low = (text or "").lower()
        tokens = set(low.split())
        found = {t for t in tokens if t.isalpha()}
        rest = tokens - found
        odd = list(odd_tokens(rest))
        if _thrice.search(low):
            odd += filter(_thrice.search, found)
        found.update(_word.findall(" ".join(rest)))
        for t in odd:
            found.update(self.restore(t))
        for m in _apart.findall(low):
            found.update(self.restore(" ".join(m.split())))
        return found

    def features(self, text: str | None) -> set[str]:
        words = self.words(text)
        return words | {f"{w[:n]}-" for n in HEADS for w in words if len(w) >= n}

    def _features_of(self, word: str) -> tuple[str, ...]:
        """The model's features in a word. One that it is but for letters doubled counts, and so do those of its reading then."""
        short, lengths, heads, _ = self._index()
        hit = [x for x in (word, *(f"{word[:n]}-" for n in heads if n <= len(word))) if x in self.weights]
        if (c := _run.sub(r"\1", word)) != word and (own := [short[x] for x in (c, *(f"{c[:n]}-" for n in lengths)) if x in short]):
            hit += [x for y in own for x in y]
            for w in self.viterbi(word):
                hit += [x for x in (w, *(f"{w[:n]}-" for n in heads if n <= len(w))) if x in self.weights]
        return tuple(hit)

    def present(self, text: str | None) -> list[str]:
        """The model's features in a text, sorted, so that a score is summed in one order."""
        known, hit = self._known, set()
        for w in self.words(text) if self.weights else ():
            if (own := known.get(w)) is None:
                own = self._features_of(w)
                if len(w) <= CACHED_LENGTH:
                    if len(known) >= CACHE:
                        known.clear()
                    known[w] = own
            if own:
                hit.update(own)
        return sorted(hit)

    def score(self, text: str | None) -> float:
        s = self.bias + sum(self.weights[x] for x in self.present(text))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, s))))


def odd_tokens(tokens: set[str]) -> Iterator[str]:
    """Of lower-cased tokens, less plain punctuation at their ends, those that hold letters and a sign of the channel, or a letter three times on end."""
    for t in tokens:
        core = t.strip(_plain)
        if core.isalpha():
            if _thrice.search(core):
                yield core
        elif (_any.search(core) or _thrice.search(core)) and _word.search(core):
            yield core


def counted(docs: DataFrame, model: Model) -> DataFrame:
    """(feature, marked, docs): in how many of the labelled documents (text, toxic) a feature is, toxic ones apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                names = list(model.features(x))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([int(y > 0)] * len(names), pa.int64())], names=["feature", "toxic"])

    rows = docs.select("text", "toxic").mapInArrow(run, "feature string, toxic long")
    return rows.groupBy("feature").agg(F.sum("toxic").alias("marked"), F.count(F.lit(1)).alias("docs"))


def family(text: str | None) -> int:
    """The least hash of a text's five-word shingles, which near copies mostly share: many copies of one text are no more evidence than one."""
    words = (text or "").split()
    return min(zlib.crc32(" ".join(words[i : i + 5]).encode()) for i in range(max(1, len(words) - 4)))


def logistic(at: np.ndarray, of: np.ndarray, toxic: np.ndarray, weight: np.ndarray, n: int, penalty: float = PENALTY, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights of n binary features and the bias that minimise weighted log loss + penalty / 2 * |weights|^2, by accelerated gradient
    descent. Row at[i] has feature of[i]; toxic and weight are those of rows."""
    rows = len(toxic)

    def summed(index: np.ndarray, size: int, values: np.ndarray, by: np.ndarray) -> np.ndarray:
        """values[by] summed by index, a stretch at a time."""
        total = np.zeros(size)
        for lo in range(0, len(index), 500_000):
            total += np.bincount(index[lo : lo + 500_000], values[by[lo : lo + 500_000]], size)
        return total

    w = np.zeros(n + 1)
    share = min(max(float((weight * toxic).sum() / weight.sum()), 1e-3), 1 - 1e-3)
    w[n] = math.log(share / (1 - share))
    # Step sizes by feature: a quarter of what its rows could add to the curvature at most.
    width = np.bincount(at, minlength=rows) + 1.0
    curve = np.append(summed(of, n, weight * width, at), (weight * width).sum()) / 4 + penalty
    ahead, speed = w.copy(), 1.0
    for _ in range(rounds):
        s = summed(at, rows, ahead, of) + ahead[n]
        gap = weight * (1 / (1 + np.exp(-np.clip(s, -40, 40))) - toxic)
        slope = np.append(summed(of, n, gap, at) + penalty * ahead[:n], gap.sum())
        new = ahead - slope / curve
        faster = (1 + math.sqrt(1 + 4 * speed * speed)) / 2
        if float(slope @ (new - w)) > 0:  # uphill: start anew from here
            faster = 1.0
        ahead, w, speed = new + (speed - 1) / faster * (new - w) * (faster > 1), new, faster
    return w[:n], float(w[n])


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """The character model of all docs, and weights from at most fit_rows of the labelled ones (labels: doc_id, toxic).

    The labelled rows are those of least md5(doc_id), so that every run takes the same; null labels and ids are left out, and a document
    labelled twice counts as toxic if any label says so. What the driver gathers of them is a list of feature numbers a document, bounded
    by fit_rows. Without labels, or without features, every score is the share of toxic labels (0.01 at least).
    """
    model = Model.of(trigram_counts(docs))
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("long")).alias("toxic"))
    known = written(known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(fit_rows))
    # known has fit_rows rows at most, a proven bound. Copies of a text count once, so that no large group makes marks of its own.
    sample = written(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic")))
    total = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.count_if(F.col("toxic") > 0), F.lit(0)).alias("t")).first()
    n, t = int(total.n), int(total.t)
    base = min(max((t + 0.5) / (n + 1), 0.01), 0.25) if n else 0.01
    model.bias = math.log(base / (1 - base))
    if not t:
        return model
    share, seen = t / n, F.col("docs")
    apart = (F.col("marked") - seen * share) * (F.col("marked") - seen * share) >= DEVIATIONS**2 * seen * share * (1 - share)
    names = sorted(counted(sample, model).filter((seen >= LEAST_DOCS) & apart).select("feature").toArrow()["feature"].to_pylist())  # of fit_rows documents
    number = {x: i for i, x in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            found = [sorted(number[x] for x in model.features(t) & number.keys()) for t in texts]
            own = pa.array([zlib.crc32((t or "").encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([family(t) for t in texts], pa.int64()), own, b.column(1), pa.array(found, pa.list_(pa.int32()))], names=["family", "own", "toxic", "found"])

    # Arrays of numbers, in an order that does not depend on the run.
    rows = sample.select("text", "toxic").mapInArrow(run, "family long, own long, toxic long, found array<int>").toArrow().combine_chunks().sort_by([("family", "ascending"), ("own", "ascending")])
    lists = rows["found"].combine_chunks()
    at, of = np.repeat(np.arange(n, dtype=np.int32), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
    _, team, alike = np.unique(rows["family"].to_numpy(), return_inverse=True, return_counts=True)
    families, last, edges = np.zeros(len(names), np.int64), np.full(len(names), -1), lists.offsets.to_numpy()
    for i in range(n):  # rows of a family stand together
        own = of[edges[i] : edges[i + 1]]
        families[own] += last[own] != team[i]
        last[own] = team[i]
    kept = np.flatnonzero(families >= LEAST_DOCS)
    if len(kept):
        place = np.full(len(names), -1, np.int64)
        place[kept] = np.arange(len(kept))
        some = place[of] >= 0
        weights, model.bias = logistic(at[some], place[of[some]], (rows["toxic"].to_numpy() > 0).astype(float), 1 / alike[team], len(kept))
        model.weights = {names[i]: float(w) for i, w in zip(kept, weights, strict=True)}
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from THRESHOLD on); columns of these names are replaced, others stay.

    Null and empty texts get the score of no features; texts may be of any length, and a token of any length is read in memory that does not
    grow with it but for its letters. Repeated rows stay, with one score; an empty table stays empty.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [model.score(x) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(s, pa.float64()), pa.array([int(v >= THRESHOLD) for v in s], pa.int32())], names=[*kept, "score", "predicted"])

    return docs.select(*kept).mapInArrow(run, docs.select(*kept).schema.add("score", "double").add("predicted", "integer"))


def held_out(doc_id):
    """Rows whose labels are never learnt from: crc32 of the id's text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
