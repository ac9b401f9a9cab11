"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding undoes look-alikes: compatibility forms, combining marks, zero-width
characters, letters of other scripts, and digits or signs inside words. The text
becomes lower-case words between single spaces, and lexicon terms are " word " or, for a
beginning of words, " wor". Terms and weights are learned from labelled rows: smoothed
log-odds of a term among toxic and clean documents. A word's weight is that of its
heaviest term; words inside an exception phrase count nothing. The sum, and the sum
normalised by length, feed a logistic curve fitted on labelled rows that the lexicon
has not seen.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Rows that a model is fitted on at most (about). Terms and phrases of them are kept whenever they pass the limits below.
FIT_ROWS = 40_000
LEAST_DOCS, LEAST_ODDS, MOST_CALM, PREFIXES = 4, 2.5, -1.0, (3, 4, 5, 6, 7, 8)
THRESHOLD = 0.3

# Letters of other scripts that look like Latin ones, and digits and signs written for letters.
HOMOGLYPHS = str.maketrans(
    "абвгдеёзикмнорстухіјѕԁԛԝһӏαβγεηικνορτυχωϲսոօցɑɡıłøđß",
    "abbrdee3ukmhopctyxijsdqwhlabyenikvoptuxwcunogagilodb")
DIGITS = str.maketrans("013456789@$!|+", "oieasgtbgasilt")
IGNORED = re.compile("[\u00ad\u034f\u200b-\u200f\u2060-\u2064\ufe00-\ufe0f\ufeff]")
_WORD = re.compile(r"[^\W_](?:[\w@$!|+]*[^\W_])?")
_PLAIN = re.compile(r"[0-9@$!|+]")


def fold(text: str | None) -> list[str]:
    """Folded words of a text; digits and signs are letters only in words that have a letter."""
    t = (text or "").lower()
    if not t.isascii():
        t = unicodedata.normalize("NFKD", IGNORED.sub("", t)).lower()
        t = "".join(c for c in t if not unicodedata.combining(c)).translate(HOMOGLYPHS)
    words = _WORD.findall(t)
    if _PLAIN.search(t):
        words = [w if w.isalpha() or w.isdigit() else w.translate(DIGITS) for w in words]
    return words


@dataclass(frozen=True)
class Lexicon:
    """Weights of whole words and of beginnings of words, exception phrases (words), and the curve."""

    words: dict[str, float]
    starts: dict[str, float]
    exceptions: tuple[tuple[str, ...], ...] = ()
    curve: tuple[float, float, float] = (-3.0, 1.0, 1.0)

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        terms: dict[str, list] = {}
        for w, x in self.words.items():
            terms.setdefault(f" {w} ", []).append((x, 0))
        for w, x in self.starts.items():
            terms.setdefault(f" {w}", []).append((x, 0))
        for p in self.exceptions:
            terms.setdefault(f" {' '.join(p)} ", []).append((0.0, len(p)))
        for k, v in terms.items():
            a.add_word(k, (len(k), tuple(v)))
        if terms:
            a.make_automaton()
        return a


def features(words: list[str], a: ahocorasick.Automaton) -> tuple[float, float]:
    """log(1 + weight) and log(1 + weight per 100 words)."""
    if not words or not len(a):
        return 0.0, 0.0
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (n, found) in a.iter(f" {' '.join(words)} "):
        at = end - n + 1
        for weight, phrase in found:
            if phrase:
                spared.append((at, end))
            elif weight > best.get(at, 0.0):
                best[at] = weight
    for lo, hi in spared:
        for at in [x for x in best if lo <= x < hi]:
            del best[at]
    total = sum(best.values())
    return math.log1p(total), math.log1p(100 * total / len(words))


def _doc_terms(words: list[str]) -> set[str]:
    own = set(words)
    return {f"{w} " for w in own} | {w[:n] for w in own for n in PREFIXES if len(w) > n}


def _doc_phrases(words: list[str], known: set[str]) -> set[str]:
    """Pairs of neighbouring words with a term among them."""
    hit = [f"{w} " in known or any(w[:n] in known for n in PREFIXES if len(w) > n) for w in words]
    return {f"{words[i]} {words[i + 1]}" for i in range(len(words) - 1) if hit[i] or hit[i + 1]}


def _counted(rows: DataFrame, of) -> DataFrame:
    """(term, t, c): toxic and clean documents that hold each of ``of``(words); summed within the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            keys = list(seen[0].keys() | seen[1].keys())
            cols = [pa.array([seen[k][x] for x in keys], pa.int64()) for k in (1, 0)]
            seen[0].clear(), seen[1].clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *cols], ["term", "t", "c"])

        for b in batches:
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                seen[int(toxic)].update(of(fold(text)))
                if len(seen[0]) + len(seen[1]) > 400_000:
                    yield flush()
        yield flush()

    t = rows.select("text", "toxic").mapInArrow(run, "term string, t long, c long")
    return t.groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))


def learn(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """A lexicon from texts (doc_id, text) and their labels (doc_id, toxic 0 or 1).

    At most about FIT_ROWS labels are used, those of the smallest hashes of doc_id: three
    quarters for terms and weights, the rest for the curve. That bounds the broadcast
    of (doc_id, toxic), and with it what comes to the driver: terms of at least LEAST_DOCS toxic
    rows and log-odds of at least LEAST_ODDS, neighbouring words of at least LEAST_DOCS clean rows
    and log-odds of at most MOST_CALM, and two features of the curve's rows. Which terms these are
    does not depend on an order, so there are no ties. Null labels and null doc_ids are left out, a
    doc_id with several labels counts with each; without labels of both kinds every text gets one score.
    """
    lab = labels.where("toxic in (0, 1) and doc_id is not null").select(
        "doc_id", F.col("toxic").cast("int").alias("toxic"), F.pmod(F.xxhash64(F.col("doc_id"), F.lit(3)), F.lit(1_000_000)).alias("place"))
    by = {r["toxic"]: r["count"] for r in lab.groupBy("toxic").count().collect()}
    if len(by) < 2:
        return Lexicon({}, {}, (), (3.0 if by.get(1) else -3.0, 0.0, 0.0))
    upto = int(1_000_000 * min(1.0, FIT_ROWS / sum(by.values())))
    rows = docs.select("doc_id", "text").join(F.broadcast(lab.where(F.col("place") < upto)), "doc_id")
    rows = written(rows.select("place", "text", "toxic"), "labelled")
    fit, rest = rows.where("place % 4 <> 0"), rows.where("place % 4 = 0")
    n = {r["toxic"]: r["count"] for r in fit.groupBy("toxic").count().collect()}
    nt, nc = n.get(1, 0) + 1, n.get(0, 0) + 1
    odds = F.log((F.col("t") + 0.5) / nt) - F.log((F.col("c") + 0.5) / nc)
    heavy = _counted(fit, _doc_terms).where((F.col("t") >= LEAST_DOCS) & (odds >= LEAST_ODDS))
    got = {r["term"]: r["odds"] for r in heavy.select("term", odds.alias("odds")).collect()}
    known = set(got)
    calm = _counted(fit, lambda words: _doc_phrases(words, known)).where((F.col("c") >= LEAST_DOCS) & (odds <= MOST_CALM)).collect()
    lex = Lexicon({k[:-1]: got[k] for k in known if k[-1] == " "}, {k: got[k] for k in known if k[-1] != " "},
                  tuple(tuple(r["term"].split(" ")) for r in calm))
    x = np.array([tuple(r) for r in featured(rest, lex).select("a", "b", "toxic").collect()], float).reshape(-1, 3)
    return Lexicon(lex.words, lex.starts, lex.exceptions, _fit(x[:, :2], x[:, 2]))


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton's method with a small penalty."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        h = x.T @ (x * (p * (1 - p))[:, None]) + np.diag([1e-3, 1e-1, 1e-1])
        w = w - np.linalg.solve(h, x.T @ (p - y) + np.array([1e-3, 1e-1, 1e-1]) * w)
    return tuple(float(v) for v in w)


def featured(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """``docs`` with text replaced by the features a and b."""
    @F.pandas_udf("a double, b double")
    def both(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        a = lex.automaton()
        for s in texts:
            yield pd.DataFrame([features(fold(t), a) for t in s], columns=["a", "b"], dtype=float)

    f = docs.withColumn("text", both("text"))
    return f.select(*[c for c in docs.columns if c != "text"], "text.a", "text.b")


def held_out(doc_id: str) -> Column:
    """Whether the labels of a document are never learned from: crc32 of doc_id as text, mod 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def probability(text: str, lex: Lexicon) -> Column:
    """Toxicity (0 to 1) of the text column: the curve at the text's features."""
    k, *slope = lex.curve

    @F.pandas_udf("double")
    def toxic(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        a = lex.automaton()
        for s in texts:
            x = np.array([features(fold(t), a) for t in s], float).reshape(-1, 2)
            yield pd.Series(1 / (1 + np.exp(-(k + x @ np.array(slope)))))

    return toxic(text)


def score(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """doc_id and toxicity (0 to 1) of each row of ``docs`` (doc_id, text).

    Null, empty and wordless texts get the score of no match. A text's score depends on nothing
    but the text, so repeated rows and rows with a null doc_id are scored like any; other columns are ignored; an empty table gives no rows.
    """
    return docs.select("doc_id", probability("text", lex).alias("score"))
