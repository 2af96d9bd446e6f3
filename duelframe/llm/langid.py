"""Language identification by word-first backoff.

A word that the model knows scores by its log frequency in each language. A word it does not
know falls back to its known character n-grams of the greatest length that has any, ever
shorter, with less weight for each step. A text's language has the highest sum.

The model is fitted on a bounded sample: of each language about ``docs_per_lang`` rows by a
hash of the id (all, if fewer), the ``vocabulary`` most frequent words shared among the
languages, and the n-grams of those words. Prediction covers every whole text.

Nulls: rows without language are not learned from; a null text, or one without a letter, is
``und`` with score 0, as is every text where nothing could be learned. Ties go to the
language first in code point order. Repeated rows count each. Empty in, empty out.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_texts
from .common import texts as texts_of

WORDS = re.compile(r"[^\W\d_]+")
LONGEST = 5
STEP = 0.7
REMEMBERED = 300_000
UNKNOWN = "und"


def words(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def ngrams(word: str, n: int) -> list[str]:
    padded = f"<{word}>"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)] if n > 1 else list(word)


@dataclass
class Model:
    langs: list[str]
    words: dict[str, np.ndarray]  # log frequency in each language
    grams: list[dict[str, np.ndarray]]  # by length, 1 to LONGEST

    def unseen(self, word: str) -> np.ndarray:
        """The backed-off scores of a word that the model does not know."""
        weight = STEP
        for n in range(LONGEST, 0, -1):
            found = [g for x in ngrams(word, n) if (g := self.grams[n - 1].get(x)) is not None]
            if found:
                return weight * np.mean(found, axis=0)
            weight *= STEP
        return np.zeros(len(self.langs))


def _logs(counts: dict[str, Counter], langs: list[str]) -> dict[str, np.ndarray]:
    every = sorted(set().union(*counts.values()))
    table = np.array([[counts[lang][x] for lang in langs] for x in every], float).reshape(len(every), len(langs)) + 0.5
    return dict(zip(every, np.log(table / table.sum(0)), strict=True))


def fit_counts(counts: dict[str, Counter]) -> Model:
    """A model from each language's word counts."""
    langs = sorted(counts)
    if not langs:
        return Model([], {}, [{} for _ in range(LONGEST)])
    grams = []
    for n in range(1, LONGEST + 1):
        own = {lang: Counter() for lang in langs}
        for lang in langs:
            for word, k in counts[lang].items():
                for x in ngrams(word, n):
                    own[lang][x] += k
        grams.append(_logs(own, langs))
    return Model(langs, _logs(counts, langs), grams)


def fit(labelled: DataFrame, docs_per_lang: int = 3000, vocabulary: int = 60_000) -> Model:
    """The model of labelled (doc_id, text, lang). Only the bounded word table reaches the driver."""
    known = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    sizes = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}  # a row for each language
    if not sizes:
        return fit_counts({})
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.create_map(*(F.lit(v) for lang, n in sizes.items() for v in (lang, min(1.0, docs_per_lang / n))))
    sample = known.where(part < F.element_at(share, F.col("lang")))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        by: dict[str, Counter] = {}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by.setdefault(lang, Counter()).update(words(text))
        rows = [(lang, w, k) for lang, c in by.items() for w, k in c.items()]
        langs, ws, ks = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(ws, pa.string()), pa.array(ks, pa.int64())], ["lang", "word", "n"])

    counted = map_texts(sample.select("text", "lang"), count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    top = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    kept = counted.withColumn("r", top).where(F.col("r") <= max(1, vocabulary // len(sizes)))
    counts: dict[str, Counter] = {lang: Counter() for lang in sizes}
    for lang, word, n in kept.select("lang", "word", "n").collect():
        counts[lang][word] = n
    return fit_counts(counts)


class Scorer:
    """A model's words as rows of one matrix, with a bounded memory of unseen words."""

    def __init__(self, model: Model) -> None:
        self.model, self.rows = model, {w: i for i, w in enumerate(model.words)}
        self.matrix = np.array(list(model.words.values())) if model.words else np.zeros((0, len(model.langs)))
        self.unseen: dict[str, np.ndarray] = {}

    def score(self, text: str) -> tuple[str, float]:
        own = words(text)
        if not self.model.langs or not any(c.isalpha() for w in own for c in w):
            return UNKNOWN, 0.0
        rows = list(map(self.rows.get, own))
        known = [r for r in rows if r is not None]
        total = self.matrix[known].sum(0)
        if len(known) < len(own):
            for w, r in zip(own, rows, strict=True):
                if r is None:
                    v = self.unseen.get(w)
                    if v is None:
                        if len(self.unseen) > REMEMBERED:
                            self.unseen.clear()
                        v = self.unseen[w] = self.model.unseen(w)
                    total = total + v
        best = int(total.argmax())
        # The evidence of a long text counts as that of twenty words, so that the score stays a degree.
        return self.model.langs[best], float(1 / np.exp((total - total[best]) * min(1.0, 20 / len(own))).sum())


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the text, then lang_pred and score, which replace columns of these names."""
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by fit's vocabulary
    made: list[Scorer] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(Scorer(shared.value))
        found = [made[0].score(t) for t in texts_of(batch)]
        return pa.RecordBatch.from_arrays([*(c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n != "text"), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], [*(n for n in batch.schema.names if n != "text"), "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text") + ", lang_pred string, score double"
    return map_texts(docs, run, schema)
