import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from duelframe.llm import packing as P
from duelframe.llm.tokenizers import word_bpe
from tokenizers import Tokenizer

ODD = ["<|endoftext|>x a<|startoftext|> b", "é áé x", "ΣΑΣ σας   a b 's don't", "\x1c\x1fab c\x85d", "a b İI", "", "it'll 'tis ½² x²y", "漢字 ab\x00c", "#" * 3000]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(word_bpe())


def test_ids_equal_the_tokenizers(rows, tokenizer):
    encoder = P.WordEncoder(word_bpe())
    for text in [*ODD, *(r[1] or "" for r in rows)]:
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_every_token_merges_into_itself():
    import json

    model = json.load(open(word_bpe(), encoding="utf-8"))["model"]
    ranks = {tuple(m): i for i, m in enumerate(model["merges"])}
    for token in model["vocab"]:
        if token.startswith("<|"):
            continue
        body = token.removesuffix("</w>")
        parts = list(body)
        parts[-1] += token[len(body) :]
        while len(parts) > 1:
            rank, i = min((ranks.get((a, b), 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            assert rank < 1 << 30, token
            parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("capacity", [16, 2048])
def test_pieces_and_places(odd, clashing, rows, tokenizer, capacity):
    want = Counter()
    for d, t, *_ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for i, at in enumerate(range(0, len(ids), capacity)):
            own = ids[at : at + capacity]
            want[d, i, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    for docs in (odd, clashing):
        out = P.pack(docs, word_bpe(), capacity).collect()
        assert Counter(tuple(r)[:5] for r in out) == want
        by = defaultdict(list)
        for r in out:
            by[r.sequence_id].append((r.offset, r.length))
        for own in by.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= capacity
        assert len(by) <= 1.05 * sum(r.length for r in out) / capacity + 2


def test_plans_hold_the_histogram_and_beat_best_fit():
    r = random.Random(1)
    for n in (1, 50, 20_000):
        h = Counter(min(2048, max(1, int(r.lognormvariate(6.3, 1.1)))) for _ in range(n))
        configs = P.configurations(h)
        held = Counter()
        for config, k in configs:
            assert sum(x * m for x, m in config) <= 2048
            for x, m in config:
                held[x] += m * k
        assert held == h and sum(k for _, k in configs) <= sum(P.best_fit(dict(h), 2048).values())
    assert P.configurations({}) == []


@pytest.mark.parametrize("h", [{1000: 100, 700: 100, 400: 100}, {1100: 500, 900: 500}, {683: 1000, 500: 700, 1030: 300}, {2048: 5, 2000: 7, 30: 10}])
def test_under_full_configurations_meet_the_dual_bound(h):
    found = P.fractional(h, 2048)
    held = Counter()
    for config, n in found.uses.items():
        assert n > 0 and sum(x * m for x, m in config) <= 2048
        for x, m in config:
            held[x] += m * n
    assert all(held[x] >= k * (1 - 1e-6) for x, k in h.items()) and found.bound <= found.total <= 1.01 * found.bound
    assert sum(k for _, k in P.configurations(h)) <= found.bound * 1.005 + 1


def test_the_bound_holds_for_the_best_packing():
    """Against the fewest sequences, by search over all packings of a few pieces."""
    r = random.Random(4)

    def fewest(items, bins):
        if not items:
            return len(bins)
        return min(fewest(items[1:], bins[:i] + (b + items[0],) + bins[i + 1 :]) for i, b in [*enumerate(bins), (len(bins), 0)] if b + items[0] <= 20)

    for _ in range(8):
        items = tuple(sorted((r.randint(3, 18) for _ in range(7)), reverse=True))
        h = Counter(items)
        best = fewest(items, ())
        assert P.fractional(h, 20).bound <= best + 1e-6 and sum(k for _, k in P.configurations(h, 20)) <= best + 1


def test_equal_rows_are_dealt_out(spark):
    """Rows alike in every column: places stay different, and no bucket holds them all."""
    found = spark.range(40_000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "1L AS length")
    out = P.place(found, 16).selectExpr("sequence_id", "offset").distinct()
    assert out.count() == 40_000 and out.selectExpr("max(offset)").first()[0] == 15


def test_knapsack_is_best():
    best, last = P.knapsack(np.array([3.0, 4.0, 9.0]), np.array([2, 3, 6]), 11)
    assert best[11] == 9 + 4 + 3 and P._chosen(last, np.array([2, 3, 6]), 11) in (Counter({2: 1, 1: 1, 0: 1}), Counter({0: 4, 1: 1}))


def test_empty(nothing):
    assert P.pack(nothing, word_bpe()).collect() == []


def test_words_in_use_stay_remembered(monkeypatch):
    """A word that recurs is encoded once, however many others pass by; what is remembered stays bounded."""
    monkeypatch.setattr(P, "REMEMBERED", 100)
    encoder, asked = P.WordEncoder(word_bpe()), []
    core = encoder.merges.core

    class Counting:
        def encode_single_piece(self, piece):
            asked.append(piece)
            return core.encode_single_piece(piece)

    encoder.merges.core = Counting()
    again = Tokenizer.from_file(word_bpe())
    for i in range(60):
        text = " ".join(["often", "frequent,"] + [f"w{chr(97 + i % 26)}{chr(97 + j)}{chr(97 + i // 26)}" for j in range(20)])
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == again.encode(text, add_special_tokens=False).ids
        assert len(encoder.known) + len(encoder.older) <= 200
    assert asked.count(b"often\xff") == 1 and asked.count(b"frequent\xff") == 1
