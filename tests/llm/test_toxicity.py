import math
from collections import Counter

import pytest
from duelframe.llm import queries as Q
from duelframe.llm import toxicity as T


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    out = Q.op3_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out AND toxic IS NOT NULL").collect()
    good = [r.score for r in out if r.toxic]
    bad = [r.score for r in out if not r.toxic]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.9 and sum(r.predicted for r in out if not r.toxic) <= 0.03 * len(bad)


@pytest.mark.parametrize("text,hits", [
    ("you loser", 1), ("you L0SER!", 1), ("lоsеr", 1), ("ｌｏｓｅｒ", 1), ("1oser", 1), ("closer losers", 0), ("loser_", 1), ("trash can, trash", 1), ("455", 0), ("a$$", 1), ("a55", 1),
    ("lowering", 1), ("slowering", 0), ("", 0), ("loser" * 3, 0), ("loser!!loser", 2),
])
def test_folding_boundaries_and_exceptions(text, hits):
    m = T.Matcher(T.Lexicon.of({"loser": 2.0, "trash": 1.0, "ass": 1.0, "lower*": 1.0}))
    assert len(m.hits(text)) == hits


def test_heaviest_term_and_length():
    m = T.Matcher(T.Lexicon.of({"idiot": 1.0, "idio*": 3.0}))
    assert m.hits("an 1d10t") == [(3, 7, 3.0)]
    assert m.score("idiot") > m.score("idiot " + "word " * 500) > m.score("word") and T.Matcher(T.Lexicon.of({}, ())).hits("x") == []


def test_learning_and_odd_rows(spark, odd, clashing, rows, nothing):
    docs = spark.createDataFrame([(i, ("filth and " if i % 4 == 0 else "plain ") + f"words here {i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(0, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    lexicon = T.fit(docs, labels)
    assert "fiith" in lexicon.words
    scores = {r.doc_id: r.toxicity for r in T.score(docs, lexicon).collect()}
    assert min(scores[i] for i in range(0, 200, 4)) > 0.7 > max(scores[i] for i in range(200) if i % 4)
    for d in (odd, clashing):
        assert Counter(r.doc_id for r in T.score(d, lexicon).collect()) == Counter(r[0] for r in rows)
    assert T.score(nothing, lexicon).collect() == [] and T.fit(nothing, labels) is None and T.fit(docs, labels.where("toxic = 0")) is None
    assert {r.toxicity for r in T.score(odd, None).collect()} == {0.0}


def naive_score(text, lexicon):
    """Every term tried at every place, without an automaton."""
    raw = T.fold(text)
    edge = lambda i: i in (-1, len(raw)) or not text[i].isalnum()
    spared = [(i, i + len(p)) for p in map(T.fold, lexicon.exceptions) for i in range(len(raw)) if raw.startswith(p, i) and edge(i - 1) and edge(i + len(p))]
    total = 0.0
    for i in (i for i in range(len(raw)) if edge(i - 1)):
        if any(a <= i < b for a, b in spared):
            continue
        own = [w for t, w in lexicon.words.items() if raw.startswith(t, i) and edge(i + len(t)) and any(c.isalpha() for c in text[i : i + len(t)])]
        own += [w for t, w in lexicon.prefixes.items() if raw.startswith(t, i) and any(c.isalpha() for c in text[i : i + len(t)])]
        total += max(own, default=0.0)
    b, x, y = lexicon.curve
    p, q = math.log1p(total), math.log1p(1000 * total / max(1, len(text.split()))) if total else 0.0
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, b + x * p + y * q))))


def test_scores_equal_brute_force(spark, rows):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    lexicon = T.fit(docs, labels)
    some = docs.orderBy("n_chars").limit(150)
    for d in (some, spark.createDataFrame([r[:2] for r in rows if len(r[1] or "") < 5000] + [(900, "you t r a s h trash can"), (901, "TRASH can"), (902, "id10t")], "doc_id long, text string")):
        got = sorted((str(r.doc_id), round(r.toxicity, 9)) for r in T.score(d, lexicon).collect())
        assert got == sorted((str(r.doc_id), round(naive_score(r.text or "", lexicon), 9)) for r in d.collect())


def test_exception_phrases_are_learned(spark):
    texts = {i: f"you filth number {i}" if i % 4 == 0 else f"filth bucket and plain words {i}" if i % 4 == 1 else f"plain words {i}" for i in range(400)}
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    lexicon = T.fit(docs, labels, doubt=1.0, least=0.3)
    assert T.fold("filth bucket") in lexicon.exceptions and T.fold("filth number") not in lexicon.exceptions
