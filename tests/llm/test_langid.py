import math
import re
from collections import Counter

import pytest
from duelframe.llm import langid as L
from duelframe.llm import queries as Q

from ..conftest import SF


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    out = Q.op10_langid(spark, SF).join(docs, "doc_id").where("held_out").collect()
    assert len(out) > 20 and sum(r.lang == r.lang_pred for r in out) >= 0.97 * len(out) and all(0 <= r.score <= 1 for r in out)


def test_words_first_then_shorter_ngrams():
    model = L.fit_counts({"x": Counter({"hello": 9, "abcde": 3}), "y": Counter({"hallo": 9, "vwxyz": 3})})
    s = L.Scorer(model)
    assert s.score("hello")[0] == "x" and s.score("HALLO 12")[0] == "y"
    assert s.score("hellos")[0] == "x" and s.score("vwx")[0] == "y"
    assert (model.unseen("abcdef") == L.STEP * sum(model.grams[4][g] for g in ("<abcd", "abcde")) / 2).all()
    assert (model.unseen("qqq") == 0).all() and s.score("123 ½ ...") == ("und", 0.0) and s.score("") == ("und", 0.0)


def test_odd_rows(odd, clashing, rows, nothing):
    model = L.fit(odd)
    assert model.langs == ["de", "en", "fr"]
    for docs in (odd.select("doc_id", "text"), clashing):
        out = L.predict(docs, model).collect()
        assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
        assert {r.lang_pred for r in out if r.doc_id in (1, 2, 3)} == {"und"}
    assert L.fit(nothing).langs == [] and L.predict(nothing, model).collect() == []
    assert {(r.lang_pred, r.score) for r in L.predict(odd, L.fit(nothing)).collect()} == {("und", 0.0)}


def test_bounds_hold(odd):
    assert len(L.fit(odd, vocabulary=9).words) <= 9


@pytest.mark.parametrize("word", ["a", "word", "é"])
def test_ngrams(word):
    assert L.ngrams(word, 1) == list(word) and L.ngrams(word, 2)[0] == "<" + word[0]


def naive(text, model):
    """A text's language and score word by word, from the model's tables alone."""
    own = re.findall(r"[^\W\d_]+", (text or "").lower())
    if not own:
        return "und", 0.0
    total = [0.0] * len(model.langs)
    for w in own:
        found, weight = [model.words[w]] if w in model.words else [], 1.0
        for n in range(L.LONGEST, 0, -1):
            if found:
                break
            weight *= L.STEP
            padded = f"<{w}>" if n > 1 else w
            found = [model.grams[n - 1][g] for g in (padded[i : i + n] for i in range(len(padded) - n + 1)) if g in model.grams[n - 1]]
        for i in range(len(total)):
            total[i] += weight * sum(g[i] for g in found) / max(1, len(found))
    best = max(range(len(total)), key=lambda i: (total[i], -i))
    return model.langs[best], 1 / sum(math.exp((x - total[best]) * min(1.0, 20 / len(own))) for x in total)


def test_predictions_equal_brute_force(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = L.fit(docs.where("doc_id % 2 = 0"), vocabulary=2000)
    for d in (docs.select("doc_id", "text"), odd.select("doc_id", "text")):
        got = sorted((str(r.doc_id), r.lang_pred, round(r.score, 6)) for r in L.predict(d, model).collect())
        assert got == sorted((str(r.doc_id), (x := naive(r.text, model))[0], round(x[1], 6)) for r in d.collect())
