"""Toxicity scores from a weighted lexicon matched by Aho-Corasick on folded text.

Folding lower-cases, maps look-alike letters of other scripts and digits or
signs that stand for letters, and writes i, l, 1, !, | alike. Lexicon terms are whole words
or beginnings of words; a word counts with its heaviest term, unless it lies in an exception
phrase or holds no letter. The weights' sum and its share of the text's words pass through a
logistic curve.

Terms, weights and curve are learned from labelled rows: a bounded sample of about
``most_toxic`` and ``most_clean`` rows by a hash of the id. A term's weight is the log of how
many times as often toxic rows hold it, less ``doubt`` standard errors; it needs to reach
``least``, and the term to stand in at least ``support`` of the toxic rows. Exception phrases
are those given and those learned: a matched word with the next one that clean rows hold as
often as toxic ones. Scores cover whole texts.

Nulls: a null text is empty and scores as a text without terms. Rows with a null label teach
nothing; a label given twice counts as its highest. Without toxic or without clean rows to
learn from every score is 0. Repeated rows count each. Empty in, empty out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_texts, texts

# Letters that look like Latin ones, and signs that stand for letters.
ALIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "к": "k", "м": "m", "т": "t", "н": "h", "в": "b",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "ν": "v", "ι": "i", "κ": "k", "η": "n", "ω": "w",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "l": "i"}
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "clown nose")
PREFIXES = range(4, 9)


def _table() -> dict[int, str]:
    out: dict[int, str] = {}
    for c in range(0x500):
        low = chr(c).lower()
        out[c] = low if len(low) == 1 else chr(c)
    for c, to in ALIKE.items():
        out[ord(c)] = out[ord(c.upper())] = to
    for c, to in SIGNS.items():
        out[ord(c)] = out[ord(c.upper())] = to
    for c in range(ord("ａ"), ord("ｚ") + 1):  # full width
        out[c] = out[c - 32] = chr(c - ord("ａ") + ord("a"))
    return {c: SIGNS.get(to, to) if to == "l" else to for c, to in out.items()}


FOLD = _table()


def fold(text: str) -> str:
    """The text with one character for each of its characters."""
    return text.translate(FOLD)


#: Letters and digits, with signs only where they stand within a word.
WRITTEN = re.compile(r"[^\W_]+(?:[@$!|][^\W_]+)*")


#: Two words, one space apart.
PHRASE = re.compile(rf"{WRITTEN.pattern} {WRITTEN.pattern}")


def folded_words(text: str) -> list[str]:
    """The folded words that hold a letter as written."""
    return [fold(w) for w in WRITTEN.findall(text) if any(c.isalpha() for c in w)]


@dataclass
class Lexicon:
    words: dict[str, float]  # folded
    prefixes: dict[str, float]  # folded
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = (-4.0, 0.4, 0.4)  # of 1, the log sum, the log share

    @classmethod
    def of(cls, weights: dict[str, float], exceptions: Iterable[str] = EXCEPTIONS) -> Lexicon:
        """From terms as people write them; a trailing * marks a beginning."""
        whole = {fold(t): w for t, w in weights.items() if not t.endswith("*")}
        return cls(whole, {fold(t[:-1]): w for t, w in weights.items() if t.endswith("*")}, tuple(exceptions))


class Matcher:
    def __init__(self, lexicon: Lexicon) -> None:
        import ahocorasick

        self.lexicon, self.automaton = lexicon, ahocorasick.Automaton()
        terms: dict[str, list[tuple[str, float]]] = {}
        for kind, own in (("word", lexicon.words), ("prefix", lexicon.prefixes)):
            for t, w in own.items():
                terms.setdefault(t, []).append((kind, w))
        for phrase in lexicon.exceptions:
            terms.setdefault(fold(phrase), []).append(("exception", 0.0))
        for t, kinds in terms.items():
            self.automaton.add_word(t, (len(t), kinds))
        if terms:
            self.automaton.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the matched words, in order; each with its heaviest term."""
        if not len(self.automaton):
            return []
        raw = fold(text)
        found: dict[int, tuple[int, float]] = {}
        spared: list[tuple[int, int]] = []
        for last, (n, kinds) in self.automaton.iter(raw):
            start, end = last - n + 1, last + 1
            if start and text[start - 1].isalnum():
                continue
            closed = end == len(raw) or not text[end].isalnum()
            for kind, w in kinds:
                if kind == "exception":
                    if closed:
                        spared.append((start, end))
                elif (closed or kind == "prefix") and any(c.isalpha() for c in text[start:end]) and w > found.get(start, (0, -math.inf))[1]:
                    found[start] = (end, w)
        return sorted((s, e, w) for s, (e, w) in found.items() if not any(a <= s < b for a, b in spared))

    def features(self, text: str) -> tuple[float, float]:
        total = sum(w for _, _, w in self.hits(text))
        return math.log1p(total), math.log1p(1000 * total / max(1, len(text.split()))) if total else 0.0

    def score(self, text: str) -> float:
        b, x, y = self.lexicon.curve
        p, q = self.features(text)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, b + x * p + y * q))))


def _fit_curve(features: np.ndarray, toxic: np.ndarray, ridge: float = 0.01) -> tuple[float, float, float]:
    """Logistic regression by Newton steps, both classes weighing alike."""
    x = np.column_stack((np.ones(len(features)), features))
    weight = np.where(toxic, 0.5 / max(1, toxic.sum()), 0.5 / max(1, (~toxic).sum())) * len(x)
    beta = np.zeros(3)
    penalty = ridge * len(x) * np.array([0.01, 1, 1]) / 100
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (toxic - p)) - penalty * beta
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty), gradient)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(map(float, beta))


#: Exception phrases that are learned at most.
MOST_PHRASES = 500


def _harmless(rows: DataFrame, lexicon: Lexicon, bad: int, good: int, doubt: float) -> list[str]:
    """Phrases of a matched word and the next that stand in clean rows as often as in toxic ones, sure by doubt standard errors."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    def phrases(batch: pa.RecordBatch) -> pa.RecordBatch:
        m, out = Matcher(shared.value), []
        for text, toxic in zip(texts(batch), batch.column(1).to_pylist(), strict=True):
            own = {fold(x.group()) for start, _, _ in m.hits(text) if (x := PHRASE.match(text, start))}
            out += [(p, toxic) for p in own]
        ps, ls = zip(*out, strict=True) if out else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(ps, pa.string()), pa.array(ls, pa.int64())], ["phrase", "toxic"])

    counted = map_texts(rows, phrases, "phrase string, toxic long").groupBy("phrase").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    b, g = F.col("bad") + 0.5, F.col("good") + 0.5
    most = F.log(b / (bad + 1) / (g / (good + 1))) + doubt * F.sqrt(1 / b + 1 / g)
    return [r[0] for r in counted.where((F.col("good") >= 3) & (most <= 0)).orderBy(most, "phrase").limit(MOST_PHRASES).select("phrase").collect()]


def fit(docs: DataFrame, labels: DataFrame, most_toxic: int = 2000, most_clean: int = 6000, support: float = 0.01, least: float = 1.2, doubt: float = 2.0, most_terms: int = 2000, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon | None:
    """The lexicon that labels (doc_id, toxic) teach on docs; None without both classes."""
    spark = docs.sparkSession
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    limit = F.when(F.col("toxic") == 1, most_toxic / max(1, sizes.get(1, 0))).otherwise(most_clean / max(1, sizes.get(0, 0)))
    sample = F.broadcast(known.where(part < limit))  # about most_toxic + most_clean ids
    rows = cut(docs.select("doc_id", "text").join(sample, "doc_id").select("text", F.col("toxic").cast("int").alias("toxic")))  # read once

    def terms(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple[str, int]] = []
        for text, toxic in zip(texts(batch), batch.column(1).to_pylist(), strict=True):
            own = {f"={w}" for w in folded_words(text)}
            own |= {f"^{w[1:n + 1]}" for w in own for n in PREFIXES if len(w) - 1 > n}
            out += [("", toxic), *((t, toxic) for t in own)]
        ts, ls = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ts, pa.string()), pa.array(ls, pa.int64())], ["term", "toxic"])

    counted = map_texts(rows, terms, "term string, toxic long").groupBy("term").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    totals = counted.where("term = ''").first()
    if totals is None or not totals["bad"] or not totals["good"]:
        return None
    bad, good = totals["bad"], totals["good"]
    b, g = F.col("bad") + 0.5, F.col("good") + 0.5
    weight = F.log(b / (bad + 1) / (g / (good + 1))) - doubt * F.sqrt(1 / b + 1 / g)
    kept = counted.where(F.col("term") != "").where(F.col("bad") >= max(2, support * bad)).withColumn("weight", weight).where(F.col("weight") >= least)
    found = kept.orderBy(F.desc("weight"), "term").limit(most_terms).collect()
    weights = {r["term"]: r["weight"] for r in found}
    lexicon = Lexicon({t[1:]: w for t, w in weights.items() if t[0] == "="}, {t[1:]: w for t, w in weights.items() if t[0] == "^"}, exceptions)
    lexicon.exceptions = (*exceptions, *_harmless(rows, lexicon, bad, good, doubt))
    shared = spark.sparkContext.broadcast(lexicon)

    def measured(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = Matcher(shared.value)
        own = np.array([m.features(t) for t in texts(batch)])
        return pa.RecordBatch.from_arrays([pa.array(own[:, 0]), pa.array(own[:, 1]), batch.column(1)], ["a", "b", "toxic"])

    points = map_texts(rows, measured, "a double, b double, toxic int").toPandas()  # as bounded as the sample
    lexicon.curve = _fit_curve(points[["a", "b"]].to_numpy(), points["toxic"].to_numpy() == 1)
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon | None, column: str = "toxicity") -> DataFrame:
    """docs' columns, then the score (0 to 1) as column, which replaces one of this name."""
    docs = docs.drop(column)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    made: list[Matcher] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if shared.value is None:
            own = [0.0] * batch.num_rows
        else:
            if not made:
                made.append(Matcher(shared.value))
            own = [made[0].score(t) for t in texts(batch)]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.float64())], [*batch.schema.names, column])

    return map_texts(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{column}` double")
