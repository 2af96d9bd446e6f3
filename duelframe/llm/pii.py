"""Personal data by candidate generation and gradient boosting.

Base rules find emails, addresses, cards and phones exactly as their patterns say and always
count. Beside them, high-recall generators propose spans that may overlap: written-out
emails (up to the 64 and 63 characters that local parts and labels may have), addresses with
written or bracketed dots and those of eight groups, digit runs of cards and phones in other
layouts, social security numbers, bank accounts, keys and tokens. Boosted trees score each proposal by its format and its context;
a kind's calibrated threshold decides. Accepted spans that overlap neither a base span nor a
better proposal are added.

The trees are fitted once on the driver on ``examples`` generated proposals (a fixed seed):
data of known kinds and look-alikes such as versions, dates and order numbers, in invented
text. A fifth of them sets the thresholds. Nothing is learned from the corpus.

Nulls: a null text is empty and has no spans. Offsets are code points, ends exclusive.
Repeated rows count each. Empty in, empty out.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts, texts

Span = tuple[int, int, str]
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "ssn", "iban", "secret")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9][0-9.]*")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> list[Span]:
    """Around each @, so that long words without one cost nothing: the pattern starts where its run of characters does."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            out.append((start, end, "email"))
        at = text.find("@", max(at + 1, end))
        end = max(end, 0)
    return out


def _ips(text: str) -> list[Span]:
    out = []
    for run in DOTTED.finditer(text):
        if run.group().count(".") >= 3:
            for m in IP.finditer(run.group()):
                if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in m.group().split(".")):
                    out.append((run.start() + m.start(), run.start() + m.end(), "ip"))
    return out


def _counted(text: str, pattern: re.Pattern, kind: str, least: int, most: int, test=None) -> list[Span]:
    out = []
    for m in pattern.finditer(text):
        if least <= m.end() - m.start():
            digits = _digits(m.group())
            if least <= len(digits) <= most and (test is None or test(digits)):
                out.append((m.start(), m.end(), kind))
    return out


def base_spans(text: str) -> list[Span]:
    """The base rules' spans by start, then kind."""
    out = _emails(text) if "@" in text else []
    out += _ips(text)
    out += _counted(text, CARD, "card", 12, 19, luhn)
    if "+" in text:
        out += _counted(text, PHONE, "phone", 9, 15)
    return sorted(out, key=_order)


def _order(span: Span) -> tuple[int, int]:
    return span[0], KINDS.index(span[2])


#: What stands for the at sign; its white space is looked at apart, so that long runs of it are read once.
AT = re.compile(r"\[\s*at\s*\]|\(\s*at\s*\)|\{\s*at\s*\}|\s[Aa][Tt]\s")
DOT = r"\s*(?:\[\s*dot\s*\]|\(\s*dot\s*\)|\{\s*dot\s*\}|\s[Dd][Oo][Tt]\s|\.)\s*"
GENERATORS = {
    "phone": re.compile(r"(?<![0-9+])(?![0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]))(?:\(?[0-9]{2,4}\)?[ .-]){1,4}[0-9]{3,4}(?:[ .-][0-9]{2,4})?(?![0-9])"),
    "card": re.compile(r"(?<![0-9])(?:[0-9]{4}[ .-]?){3,4}[0-9]{1,4}(?![0-9])"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "secret": re.compile(r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{16,}(?![A-Za-z0-9_/+-])"),
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}(?: ?(?:\[\.\]|\(\.\)|\[[Dd][Oo][Tt]\]|\([Dd][Oo][Tt]\)|(?<= )[Dd][Oo][Tt](?= )) ?[0-9]{1,3}){3}(?![0-9])|(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
}
WRITTEN_DOMAIN = re.compile(rf"\s*[A-Za-z0-9-]{{1,63}}(?:{DOT}[A-Za-z0-9-]{{2,63}}){{1,4}}")
CUES = {
    "email": re.compile(r"mail|contact|write|reach|e-?mail", re.I),
    "phone": re.compile(r"tel|phone|call|fax|mobile|dial|\bph\b", re.I),
    "card": re.compile(r"card|visa|credit|payment|master", re.I),
    "ip": re.compile(r"\bip\b|host|server|addr", re.I),
    "ssn": re.compile(r"ssn|social|security", re.I),
    "iban": re.compile(r"iban|bank|account|transfer", re.I),
    "secret": re.compile(r"token|secret|key|passw|auth|bearer", re.I),
}
COUNTER_CUES = re.compile(r"order|invoice|version|serial|isbn|date|build|ref|no\.|id\b|commit|sha|hash|page|chapter", re.I)
HAS_DIGITS = re.compile(r"[0-9]")
SPELT_DOT = re.compile(r"\[\.\]|\(\.\)|[Dd][Oo][Tt]")
LONG_WORD = re.compile(r"[A-Za-z0-9_/+-]{16}")


def _spelt_out(text: str) -> Iterator[Span]:
    """E-mail addresses with a written at sign: up to 64 characters of a local part before it, a domain with dots of any kind behind."""
    for m in AT.finditer(text):
        end = m.start()
        while end and text[end - 1].isspace():
            end -= 1
        start = end
        while start and end - start <= 64 and text[start - 1] in LOCAL:
            start -= 1
        if 0 < end - start <= 64 and (domain := WRITTEN_DOMAIN.match(text, m.end())):
            yield start, domain.end(), "email"


def candidates(text: str) -> list[Span]:
    """Every generator's proposals; they may overlap."""
    kinds = []
    if HAS_DIGITS.search(text):
        kinds += ["phone", "card", "ssn", "iban"]
        if SPELT_DOT.search(text) or text.count(":") >= 7:
            kinds.append("ip")
    if LONG_WORD.search(text):
        kinds.append("secret")
    return [*_spelt_out(text), *((m.start(), m.end(), k) for k in kinds for m in GENERATORS[k].finditer(text))]


def _entropy(text: str) -> float:
    n = len(text)
    return -sum(k / n * math.log2(k / n) for k in Counter(text).values())


def iban_ok(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(text: str, span: Span) -> list[float]:
    """Of a proposal: its kind, its format, what stands around it."""
    start, end, kind = span
    own, before, after = text[start:end], text[max(0, start - 30) : start], text[end : end + 10]
    digits = _digits(own)
    n = len(own)
    groups = [len(g) for g in re.findall(r"[0-9]+", own)]
    return [
        float(KINDS.index(kind)), float(n), float(len(digits)), len(digits) / n, sum(c.isupper() for c in own) / n, sum(c.islower() for c in own) / n,
        float(sum(not c.isalnum() for c in own)), float(len(groups)), float(groups[0] if groups else 0), float(groups[-1] if groups else 0),
        _entropy(own), float(len(digits) >= 12 and luhn(digits)), float(kind == "iban" and iban_ok(own)),
        float(bool(CUES[kind].search(before))), float(bool(COUNTER_CUES.search(before))), float(bool(re.search(r"[=:]\s*[\"']?$", before))),
        float(own[:4] in ("AKIA", "ghp_", "sk_l", "xoxb")), float(own[:1] in "(+"), float(bool(re.search(r"\[|\(|\{", own[1:]))), float(bool(re.match(r"[A-Za-z]", after))),
        float(bool(re.fullmatch(r"(19|20)[0-9]{2}[ .-][0-9]{2}[ .-][0-9]{2,4}.*", own))), float(len(set(digits)) if digits else 0),
        float(min(999, max((int(g[:4]) for g in re.findall(r"[0-9]+", own)), default=0))), float(own.count(":")),
    ]


@dataclass
class Tree:
    """Depth-limited; nodes as arrays, leaves where feature is -1."""

    feature: list[int]
    threshold: list[float]
    left: list[int]
    right: list[int]
    value: list[float]

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), int)
        f, t, lo, hi, v = map(np.array, (self.feature, self.threshold, self.left, self.right, self.value))
        for _ in range(16):
            inner = f[at] >= 0
            if not inner.any():
                break
            go = x[np.arange(len(x)), np.maximum(f[at], 0)] <= t[at]
            at = np.where(inner, np.where(go, lo[at], hi[at]), at)
        return v[at]


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> Tree:
    tree = Tree([], [], [], [], [])

    def node(rows: np.ndarray, level: int) -> int:
        i = len(tree.feature)
        for a, v in ((tree.feature, -1), (tree.threshold, 0.0), (tree.left, -1), (tree.right, -1), (tree.value, float(g[rows].sum() / (h[rows].sum() + 1.0)))):
            a.append(v)
        if level == depth or len(rows) < 20:
            return i
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-3, -1, 0.0)
        for f in range(x.shape[1]):
            order = np.argsort(x[rows, f], kind="stable")
            v, cg, ch = x[rows, f][order], np.cumsum(g[rows][order])[:-1], np.cumsum(h[rows][order])[:-1]
            ok = v[1:] > v[:-1]
            if ok.any():
                gain = np.where(ok, cg**2 / (ch + 1) + (total_g - cg) ** 2 / (total_h - ch + 1) - total_g**2 / (total_h + 1), -1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, float((v[k] + v[k + 1]) / 2))
        if best[1] >= 0:
            tree.feature[i], tree.threshold[i] = best[1], best[2]
            low = x[rows, best[1]] <= best[2]
            tree.left[i], tree.right[i] = node(rows[low], level + 1), node(rows[~low], level + 1)
        return i

    node(np.arange(len(x)), 0)
    return tree


@dataclass
class Model:
    trees: list[Tree]
    rate: float
    start: float
    thresholds: dict[str, float]

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.start)
        for t in self.trees:
            raw += self.rate * t.predict(x)
        return 1 / (1 + np.exp(-raw))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, rate: float = 0.3, depth: int = 4) -> Model:
    """Gradient boosting of the logistic loss with Newton leaves."""
    p = np.clip(y.mean(), 0.01, 0.99)
    model = Model([], rate, float(np.log(p / (1 - p))), {})
    raw = np.full(len(x), model.start)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        model.trees.append(_grow(x, y - p, p * (1 - p), depth))
        raw += rate * model.trees[-1].predict(x)
    return model


def _card(r: random.Random) -> str:
    body = r.choice(("4", "51", "37")) + "".join(r.choice("0123456789") for _ in range(14))
    body = body[:15]
    return next(body + d for d in "0123456789" if luhn(body + d))


def _iban(r: random.Random) -> str:
    body, country = "".join(r.choice("0123456789") for _ in range(18)), r.choice(("DE", "FR", "ES"))
    check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
    return f"{country}{check:02d}{body}"


def _example(r: random.Random) -> tuple[str, str, bool]:
    """(text with one planted item, the item, whether it is personal data)."""
    word = lambda a=3, b=8: "".join(r.choice("abcdeghilmnoprstuv") for _ in range(r.randint(a, b)))
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    hexa = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    mixed = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789") for _ in range(n))
    a, d = r.choice((("[at]", "[dot]"), ("(at)", "(dot)"), (" at ", " dot "), (" AT ", " DOT "), (" [at] ", " [dot] "))), r.choice((" ", "-"))
    item, real, cue = r.choice((
        lambda: (f"{word()}.{word()}{a[0]}{word()}{a[1]}{r.choice(('com', 'org', 'net', 'de'))}", True, "email"),
        lambda: (f"{word()} at {word()} . {word()}", False, ""), lambda: (f"{word()} at {word()}.{word()}", False, ""),
        lambda: (f"({num(3)}) {num(3)}-{num(4)}", True, "phone"), lambda: (f"{num(3)}-{num(3)}-{num(4)}", True, "call"), lambda: (f"0{num(2)} {num(3)} {num(4)}", True, "tel"),
        lambda: (f"{r.randint(1990, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", False, "date"), lambda: (f"{num(3)} {num(3)}", False, ""), lambda: (f"{num(2)}.{num(2)}.{num(4)}", False, "version"),
        lambda: (f"{num(3)} {num(4)}", False, "page"), lambda: (d.join((c := _card(r))[i : i + 4] for i in (0, 4, 8, 12)), True, "card"), lambda: (num(16), False, "order"), lambda: (d.join(num(4) for _ in range(4)), False, "serial"),
        lambda: (f"{r.randint(1, 899):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}", True, "ssn"), lambda: (f"{num(3)}-{num(2)}-{num(4)}", False, "ref"),
        lambda: (_iban(r), True, "iban"), lambda: (r.choice(("AB", "XZ")) + num(2) + num(12), False, "serial"),
        lambda: ("AKIA" + mixed(16).upper(), True, "key"), lambda: (hexa(40), True, 'token = "'), lambda: (mixed(32), True, "secret: "), lambda: (hexa(40), False, "commit"), lambda: (word(18, 30), False, ""),
        lambda: (r.choice(("[.]", "(.)", "[dot]", "(dot)", " dot ", " [.] ")).join(str(r.randint(0, 255)) for _ in range(4)), True, "host"), lambda: (r.choice(("[.]", "(.)", " dot ")).join(str(r.randint(256, 999)) for _ in range(4)), False, ""),
        lambda: (":".join(hexa(r.randint(1, 4)) for _ in range(8)), True, "ip"), lambda: (":".join(f"{r.randint(0, 59):02d}" for _ in range(8)), False, "date"),
        lambda: (f"{word(6, 9)}-{word(6, 9)}-{word(4, 8)}", False, ""), lambda: (f"{word(6, 9)}/{word(6, 9)}/{word(4, 8)}", False, ""), lambda: ("=" * 0 + "-" * r.randint(16, 40), False, ""), lambda: (num(r.randint(16, 24)), False, "id"),
    ))()
    lead = f"{word()} {word()} " + (cue + ("" if cue[-1:] in '" ' else r.choice((" ", ": "))) if cue and r.random() < (0.7 if real else 0.5) else "")
    if "token" in cue or "secret" in cue:
        lead = f"{word()} {cue}"
    return f"{lead}{item} {word()} {word()}", item, real


@functools.cache
def trained(examples: int = 4000, seed: int = 7, precision: float = 0.98) -> Model:
    """The boosted trees and each kind's lowest threshold that reaches the precision on held-out examples."""
    r = random.Random(seed)
    rows, truth = [], []
    for _ in range(examples):
        text, item, real = _example(r)
        at = text.find(item)
        for s in candidates(text):
            rows.append((KINDS.index(s[2]), features(text, s)))
            truth.append(real and abs(s[0] - at) <= 1 and abs(s[1] - at - len(item)) <= 1)
    x, y, kinds = np.array([f for _, f in rows]), np.array(truth, float), np.array([k for k, _ in rows])
    held = np.arange(len(x)) % 5 == 0
    model = boost(x[~held], y[~held])
    scores = model.score(x[held])
    for i, kind in enumerate(KINDS):
        own = kinds[held] == i
        model.thresholds[kind] = _threshold(scores[own], y[held][own], precision)
    return model


def _threshold(scores: np.ndarray, truth: np.ndarray, precision: float) -> float:
    order = np.argsort(-scores, kind="stable")
    right = np.cumsum(truth[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(right >= precision)
    return max(0.5, float(scores[order][good[-1]])) if len(good) else 1.1


def proposals(text: str) -> tuple[list[Span], list[Span]]:
    """The base spans, and the candidates that don't touch one."""
    base = base_spans(text)
    proposed = candidates(text)
    taken = sorted((s, e) for s, e, _ in base)
    ends = list(itertools.accumulate((e for _, e in taken), max))

    def free(s: int, e: int) -> bool:
        i = bisect.bisect_left(taken, (e, -1))
        return i == 0 or ends[i - 1] <= s

    return base, [p for p in proposed if free(p[0], p[1])]


def chosen(base: list[Span], proposed: list[Span], scores: np.ndarray, thresholds: dict[str, float]) -> list[Span]:
    """The base spans and those proposed that reach their kind's threshold, of overlapping ones the best: by start, then kind."""
    added: list[Span] = []
    starts: list[tuple[int, int]] = []
    for i in sorted(range(len(proposed)), key=lambda i: (-scores[i], proposed[i])):
        s, e, kind = proposed[i]
        if scores[i] < thresholds[kind]:
            continue
        j = bisect.bisect_left(starts, (e, -1))
        if j == 0 or starts[j - 1][1] <= s:
            bisect.insort(starts, (s, e))
            added.append(proposed[i])
    return sorted(base + added, key=_order)


def spans_of(own: list[str], model: Model) -> list[tuple[list[Span], list[Span]]]:
    """Of each text the base spans, and all spans; the trees score all texts' proposals at once."""
    found = [proposals(t) for t in own]
    rows = [features(t, p) for t, (_, proposed) in zip(own, found, strict=True) for p in proposed]
    scores = model.score(np.array(rows)) if rows else np.zeros(0)
    out, at = [], 0
    for base, proposed in found:
        out.append((base, chosen(base, proposed, scores[at : at + len(proposed)], model.thresholds)))
        at += len(proposed)
    return out


def spans(text: str, model: Model) -> tuple[list[Span], list[Span]]:
    """The base spans, and all spans: by start, then kind."""
    return spans_of([text], model)[0]


def joined(found: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in found)


def redact(text: str, found: list[Span]) -> str:
    """The text with each span, overlapping ones as one, replaced by its first kind in brackets."""
    out, at = [], 0
    for s, e, kind in found:
        if s >= at:
            out += [text[at:s], f"[{kind}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, redacted: bool = False, model: Model | None = None) -> DataFrame:
    """doc_id, base and spans (as kind:start:end, comma-joined), n_email, n_ip, n_card, n_phone of the base, and the redacted text if asked for."""
    shared = docs.sparkSession.sparkContext.broadcast(model or trained())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = texts(batch)
        both = spans_of(own, shared.value)
        columns = [batch.column(0), pa.array([joined(b) for b, _ in both], pa.string()), pa.array([joined(a) for _, a in both], pa.string())]
        columns += [pa.array([sum(s[2] == k for s in b) for b, _ in both], pa.int64()) for k in BASE]
        columns.append(pa.array([redact(t, a) if redacted else None for t, (_, a) in zip(own, both, strict=True)], pa.string()))
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "base", "spans", *(f"n_{k}" for k in BASE), "redacted"])

    schema = "doc_id long, base string, spans string, " + ", ".join(f"n_{k} long" for k in BASE) + ", redacted string"
    found = map_texts(docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text"), run, schema)
    return found if redacted else found.drop("redacted")
