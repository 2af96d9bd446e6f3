import random
import re

import xxhash
from duelframe.llm import common
from duelframe.llm import simhash as S

from .conftest import words


def naive(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(items, linked):
    parent = {i: i for i in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in items:
        for b in items:
            if a < b and linked(a, b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in items}


def test_fingerprints_and_components(odd, clashing, rows):
    own = [(r[0], naive(r[1])) for r in rows]
    root = classes({f for _, f in own}, lambda a, b: bin(a ^ b).count("1") <= 2)
    least = {}
    for d, f in own:
        if d is not None:
            least[root[f]] = min(d, least.get(root[f], d))
    want = sorted(((d, f"{f:016x}", least.get(root[f])) for d, f in own), key=str)
    for docs in (odd, clashing):
        assert sorted((tuple(r) for r in S.near_duplicates(docs).collect()), key=str) == want


def test_ball_links_reach_all_pairs(spark):
    base = 0x0123456789ABCDEF
    fps = [base, base ^ 1, base ^ 3, base ^ 7, base ^ (1 << 63), base ^ 0xFFFF, 0, 2**64 - 1]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {r.node: r.root for r in S.components(S.links(df)).collect()}
    want = classes(signed, lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= 2)
    assert {f: got.get(f, f) for f in signed} == want


def test_components_of_chains_and_hubs(spark):
    chain = [(i + 1, i) for i in range(100, 160)]
    hub = [(i, 7) for i in range(1000, 1200)]
    got = {r.node: r.root for r in S.components(spark.createDataFrame(chain + hub, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(101, 161)) and all(got[i] == 7 for i in range(1000, 1200))


def test_similar_groups(odd, rows):
    docs = odd.where("doc_id IS NOT NULL AND doc_id <> 20").dropDuplicates(["doc_id"])
    sets = {}
    for d, t, *_ in rows:
        if d is not None and d != 20:
            w = (t or "").lower().split()
            sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    want = classes(sorted(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    got = {r.doc_id: r.component_id for r in S.similar_groups(docs).collect()}
    assert got == want and len({got[i] for i in (*range(50, 56), 60, 61)}) == 1


def test_keeping_one(odd, nothing):
    kept = S.keep_one_similar(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(None) == 2 and 50 in ids and not {51, 60, 61} & set(ids) and ids.count(20) <= 2
    assert S.keep_one_similar(nothing).collect() == [] and S.near_duplicates(nothing).collect() == [] and S.keep_one(nothing).collect() == []
    assert {1, 5, 6} <= {r.doc_id for r in S.keep_one(odd).collect()}


def test_settled_groups_still_meet(spark):
    """1~3 and 2~4 are first choices; 3~4 joins their groups."""
    w = [f"word{i}" for i in range(200)]
    docs = spark.createDataFrame([(i, " ".join(w[at : at + 100])) for i, at in ((1, 0), (3, 10), (4, 20), (2, 30))], "doc_id long, text string")
    first = spark.createDataFrame([(3, 1), (4, 2)], "a long, b long")
    near = spark.createDataFrame([(3, 1), (4, 2), (4, 3)], "a long, b long")
    got = {r.node: r.root for r in S.joined(first, lambda _: near, docs, 5, 0.8).collect()}
    assert {i: got.get(i, i) for i in (1, 2, 3, 4)} == dict.fromkeys((1, 2, 3, 4), 1)


def shingled(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_planted_pairs_are_all_found(spark):
    """Appended and replaced blocks and scattered edits at 0.80 to 0.90, among texts that share a passage."""
    r, texts, new = random.Random(5), {}, iter(range(10**9))
    fresh = lambda n: [f"w{next(new)}x" for _ in range(n)]
    for i in range(60):
        base, kind = fresh(r.randint(150, 400)), i % 3
        copy, share = list(base), r.uniform(0.02, 0.13)
        k = int(share * len(base))
        if kind == 0:
            copy += fresh(k)
        elif kind == 1:
            copy[50 : 50 + k] = fresh(k)
        else:
            for at in r.sample(range(len(base)), max(1, k // 6)):
                copy[at] = next(iter(fresh(1)))
        texts[2 * i], texts[2 * i + 1] = " ".join(base), " ".join(copy)
    passage = fresh(60)
    for i in range(200, 230):
        texts[i] = " ".join(fresh(40) + passage)
    sets = {i: shingled(t) for i, t in texts.items()}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    want = classes(sorted(texts), alike)
    assert sum(want[2 * i + 1] == 2 * i for i in range(60)) > 30
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    assert {x.doc_id: x.component_id for x in S.similar_groups(docs).collect()} == want


def test_members_meet_past_a_dissimilar_smallest(spark):
    """Of one shingle's texts the smallest id is unlike the others, which are alike."""
    far = [0x5555555555555555] * S.PARITY
    rows = spark.createDataFrame([(7, i, 0, 100, far if i == 1 else [i] + [0] * (S.PARITY - 1)) for i in (1, 2, 3, 4)], "s long, doc_id long, pos int, n long, parity array<long>")
    roots = spark.createDataFrame([(4, 3)], "node long, root long")
    assert S.stars(rows, 0.8).collect() == []
    assert {tuple(r) for r in S.between(rows, roots, 0.8).collect()} == {(3, 2), (4, 2)}


def test_chains_of_near_copies_stay_whole(spark):
    """Sixty chains of six texts: neighbours are similar, ends often are not; components equal brute force."""
    r, texts, new = random.Random(11), {}, iter(range(10**9))
    for c in range(60):
        words = [f"c{next(new)}" for _ in range(r.randint(60, 300))]
        for k in range(6):
            texts[100 * c + k] = " ".join(words)
            words = list(words)
            n = max(1, int(len(words) * r.uniform(0.01, 0.09)))
            kind, at = r.randrange(3), r.randrange(len(words) - n)
            if kind == 0:
                words[at : at + n] = [f"c{next(new)}" for _ in range(n)]
            elif kind == 1:
                words = words[n:] + [f"c{next(new)}" for _ in range(n)]
            else:
                words[at:at] = [f"c{next(new)}" for _ in range(n)]
    order = list(texts)
    r.shuffle(order)
    texts = {i: texts[o] for i, o in enumerate(order)}  # ids say nothing of the chains
    sets = {i: shingled(t) for i, t in texts.items()}
    want = classes(sorted(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string").repartition(5)
    assert {x.doc_id: x.component_id for x in S.similar_groups(docs).collect()} == want and 60 <= len(set(want.values())) < 200


def _held(spark):
    """Names of what the checkpoint folder holds."""
    from pathlib import Path

    from duelframe.session import checkpoints

    return {p.name for p in Path(checkpoints(spark).removeprefix("file:")).iterdir()}


def test_only_the_results_own_table_stays(spark, odd):
    before = _held(spark)
    found = S.similar_groups(odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]))
    assert found.count() and len(_held(spark) - before) == 1
    common.drop(found)
    assert _held(spark) == before
    with common.scratch(spark):
        assert S.near_duplicates(odd).count() == odd.count() and _held(spark) > before
    assert _held(spark) == before


def test_a_hot_shingle_is_dealt_in_pairs_of_blocks(spark):
    """Sixty texts of a shingle, a third of them alike: every block size finds what one block does."""
    r = random.Random(8)
    own = [(1, i, i % 5, 100 + i % 3, [r.getrandbits(60) if i % 3 else i % 2 for _ in range(8)]) for i in range(60)]
    rows = spark.createDataFrame([*own, (2, 3, 0, 100, own[3][4]), (2, 9, 1, 100, own[3][4])], "s long, doc_id long, pos int, n long, parity array<long>")
    roots = spark.createDataFrame([(5, 3)], "node long, root long")
    brute = lambda block: sorted(map(tuple, S.between(rows, roots, 0.2, block).collect()))
    assert brute(1000) == brute(7) == brute(1) and len(brute(7)) == len(set(brute(7))) > 3


def test_similar_texts_meet_in_balls(spark, monkeypatch):
    """Balls of fingerprints propose the pairs that they hold; the exact filter only adds those that they miss."""
    r = random.Random(8)
    texts = []
    for _ in range(12):
        base = words(r, 400).split()
        texts += [" ".join(base), " ".join([*base, "more"]), " ".join(["less", *base])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fps, sets = [S.fingerprint(t, 5) for t in texts], [shingled(t) for t in texts]
    similar = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    held = lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2 and similar(a, b)
    ids = range(len(texts))
    balls = classes(ids, held)
    assert len(set(balls.values())) < len(texts)
    group = lambda: {x.doc_id: x.component_id for x in S.similar_groups(docs, 5, 0.8).collect()}
    assert group() == classes(ids, similar)
    own = S.members
    monkeypatch.setattr(S, "members", lambda reps: own(reps.where("false")))
    assert group() == balls
