"""Personal data by fixed patterns and a semi-Markov conditional random field.

Base spans come from four patterns (email, ip, card, phone) with their checks. The field adds spans that the patterns miss: written-out
or bracketed signs in addresses, numbers without a plus, unusual separators. It scores whole candidate spans by features of the span (shape,
digit groups, check sum, words before it); a dynamic program over the words around a candidate, with entities of at most ``LONGEST`` words, chooses
boundaries and types jointly. Words far from any candidate can only be outside an entity, so they need no work.

Weights are trained by gradient steps on the log-likelihood, over windows of all texts: base spans are the positives, also rewritten in forms that the patterns miss; numbers that fail the
checks, and dates, sums and versions put in a span's place, are the negatives. Of each kind, and of windows without a span, those of least hash are used, at most ``KIND_WINDOWS``, so that
a rare kind is learned wherever it is. Finding spans needs one text and the weights: nothing is shuffled.

Defined cases: a null text is the empty one and has no spans; base spans stay as they are, added ones never overlap them;
repeated rows come back as often; without any base span to learn from nothing is added.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.common import fresh, in_batches, rows_of, table, texts
from marquee.session import cut

KINDS = ("email", "ip", "card", "phone")
LONGEST = 40
KIND_WINDOWS = 600
BEFORE, AFTER = 48, 24
LONGEST_WORD = 256

DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# each begins where a run of digits does, so that a long run is read once; a greedy match takes whole runs
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def small_parts(ip: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in ip.split("."))


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches, found from each @: before it the longest run of name signs, after it two or more labels."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in NAME:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end(), "email"
        floor = m.end() if m else at + 1  # a run of name signs ends at an @, so that none is read twice
        at = text.find("@", floor)


def base_spans(text: str) -> list[Span]:
    """Spans of the four patterns that pass their checks, by start, then kind as listed."""
    out = list(emails(text)) if "@" in text else []
    if DIGITS.search(text):
        out += [(*m.span(), "ip") for m in IP.finditer(text) if small_parts(m.group())] if text.count(".") >= 3 else []
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                d = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(d) <= 19 and luhn(d):
                    out.append((*m.span(), "card"))
        out += [(*m.span(), "phone") for m in PHONE.finditer(text) if 9 <= len(DIGITS.findall(m.group())) <= 15] if "+" in text else []
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


# ---- candidates and features of whole spans ----

AT = r"\s?(?:@|＠|\(at\)|\[at\]|\{at\}|\(@\)|\[@\])\s?|\sat\s"
DOT = r"\.|\s?(?:\(dot\)|\[dot\]|\{dot\}|\(\.\)|\[\.\])\s?|\sdot\s"
SHAPES = {
    "email": re.compile(rf"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9])?(?:{AT})[A-Za-z0-9-]+(?:(?:{DOT})[A-Za-z0-9-]+)+", re.I),
    "ip": re.compile(rf"[0-9]{{1,3}}(?:(?:{DOT})[0-9]{{1,3}}){{3}}", re.I),
    "card": re.compile(r"[0-9](?:[\x20._/-]{0,2}[0-9]){11,18}"),
    "phone": re.compile(r"[+(]?[(]?[0-9](?:[\x20()./ -]{0,3}[0-9]){6,14}"),
}
TRIGGER = re.compile(rf"[0-9](?:[\x20()._/ -]{{0,3}}[0-9]){{6,}}|(?:{AT})[A-Za-z0-9-]+(?:{DOT})[A-Za-z]{{2,}}|[0-9]{{1,3}}(?:(?:{DOT})[0-9]{{1,3}}){{3}}", re.I)
TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\w\s]|_")
CUES = {"phone": "phone", "tel": "phone", "call": "phone", "fax": "phone", "mobile": "phone", "cell": "phone", "dial": "phone", "telefon": "phone", "mail": "email", "email": "email",
        "contact": "email", "write": "email", "ip": "ip", "host": "ip", "server": "ip", "address": "ip", "card": "card", "visa": "card", "mastercard": "card", "credit": "card", "amex": "card"}


def features(kind: str, text: str, start: int, end: int) -> list[str]:
    """Names of the features of one whole span as one kind."""
    s = text[start:end]
    digits = "".join(filter(str.isdigit, s))
    groups = re.findall(r"[0-9]+", s)
    before = re.findall(r"[^\W\d_]+", text[max(0, start - BEFORE) : start].lower())[-3:]
    f = ["bias", f"digits {len(digits)}", f"groups {min(len(groups), 6)}"]
    f += [f"cue {CUES[w]}" for w in {w for w in before if w in CUES}]
    if start and text[start - 1].isalnum() or end < len(text) and text[end : end + 1].isalnum():
        f.append("inside a word")
    if kind in ("card", "phone"):
        f += [f"shape {'-'.join(str(len(g)) for g in groups[:6])}", f"plus {s[0] == '+'}", f"brackets {'(' in s}", f"split {len(groups) > 1}"]
        f += [f"sum {luhn(digits)}", f"range {12 <= len(digits) <= 19}", f"four {bool(groups) and all(len(g) == 4 for g in groups)}"]
        f += [f"year {bool(groups) and any(len(g) == 4 and g[:2] in ('19', '20') for g in groups) and len(digits) == 8}", f"edge {text[start - 1 : start] in '.-/+' and start > 0}"]
        f += [f"separators {''.join(sorted(set(re.sub(r'[0-9]', '', s))))}"]
    elif kind == "ip":
        f += [f"small {all(int(g) <= 255 for g in groups)}", f"zero {any(len(g) > 1 and g[0] == '0' for g in groups)}", f"plain {'[' not in s and '(' not in s and 'd' not in s.lower()}"]
    else:
        f += [f"sign {'@' in s or '＠' in s}", f"bracket {bool(re.search(r'[(\[{]', s))}", f"spaced {' ' in s}", f"end {min(len(re.split(r'[^A-Za-z]', s)[-1]), 5)}", f"word at {bool(re.search(r'\sat\s', s))}", f"word dot {bool(re.search(r'\sdot\s', s))}"]
    return [f"{kind}:{x}" for x in f]


class Taken:
    """Spans that stay as they are, asked about by their starts and the furthest end up to each."""

    def __init__(self, spans: list[tuple[int, int]]):
        spans = sorted(spans)
        self.starts = [a for a, _ in spans]
        self.furthest = list(itertools.accumulate((b for _, b in spans), max))

    def overlaps(self, start: int, end: int) -> bool:
        n = bisect_left(self.starts, end)
        return n > 0 and self.furthest[n - 1] > start

    def holds(self, start: int, end: int) -> bool:
        """Whether one span has all of it."""
        n = bisect_right(self.starts, start)
        return n > 0 and self.furthest[n - 1] >= end


class Window:
    """The words around candidates, and every candidate segment (first word, words, kind) with its features."""

    def __init__(self, text: str, start: int, end: int, taken: Taken = Taken([])):  # noqa: B008
        self.tokens = [m.span() for m in TOKEN.finditer(text, start, end)]
        self.segments: list[tuple[int, int, str, list[str]]] = []
        for i, (a, _) in enumerate(self.tokens):
            if not (text[a].isalnum() or text[a] in "+("):
                continue
            possible = [(kind, shape) for kind, shape in SHAPES.items() if shape.match(text, a, end)]  # what no text from here on fits needs no look at its ends
            has_digit = False
            for j in range(i, min(len(self.tokens), i + LONGEST) if possible else i):
                b = self.tokens[j][1]
                if taken.overlaps(a, b):
                    break
                has_digit = has_digit or text[self.tokens[j][0]].isdigit()
                if b - a < 5 or not text[b - 1].isalnum():
                    continue
                for kind, shape in possible:
                    if (kind == "email" or has_digit) and shape.fullmatch(text, a, b):
                        self.segments.append((i, j - i + 1, kind, features(kind, text, a, b)))


def score_of(weights: dict[str, float], names: list[str]) -> float:
    return sum(weights.get(n, 0.0) for n in names)


def best(window: Window, weights: dict[str, float]) -> list[tuple[int, int, str]]:
    """The best labelling's entities (first word, words, kind): the maximum over all segmentations."""
    n = len(window.tokens)
    ends: dict[int, list] = {}
    for i, k, kind, f in window.segments:
        ends.setdefault(i + k, []).append((score_of(weights, f), i, kind))
    top, back = [0.0] * (n + 1), [None] * (n + 1)
    for j in range(1, n + 1):
        top[j] = top[j - 1]
        for s, i, kind in ends.get(j, ()):
            if top[i] + s > top[j]:
                top[j], back[j] = top[i] + s, (i, kind)
    out, j = [], n
    while j > 0:
        if back[j] is None:
            j -= 1
        else:
            i, kind = back[j]
            out.append((i, j - i, kind))
            j = i
    return out[::-1]


def gradient(window: Window, gold: set[tuple[int, int, str]], weights: dict[str, float]) -> dict[str, float]:
    """Of the log-likelihood: features of the given entities less their expectation, by the forward and backward sums."""
    n = len(window.tokens)
    scores = [score_of(weights, f) for *_, f in window.segments]
    ends: dict[int, list] = {}
    starts: dict[int, list] = {}
    for s, (i, k, _, _) in zip(scores, window.segments, strict=True):
        ends.setdefault(i + k, []).append((i, s))
        starts.setdefault(i, []).append((i + k, s))
    a, b = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):
        a[j] = float(np.logaddexp.reduce([a[j - 1], *(a[i] + s for i, s in ends.get(j, ()))])) if j in ends else a[j - 1]
    for j in range(n - 1, -1, -1):
        b[j] = float(np.logaddexp.reduce([b[j + 1], *(b[e] + s for e, s in starts.get(j, ()))])) if j in starts else b[j + 1]
    g: dict[str, float] = {}
    for s, (i, k, kind, f) in zip(scores, window.segments, strict=True):
        d = ((i, k, kind) in gold) - float(np.exp(min(0.0, a[i] + s + b[i + k] - a[n])))
        if abs(d) > 1e-4:
            for name in f:
                g[name] = g.get(name, 0.0) + d
    return g


def windows(text: str) -> Iterator[tuple[int, int]]:
    """Joined stretches around candidates; each begins at a word's edge, for words of up to ``LONGEST_WORD`` signs."""
    held = None
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - BEFORE), min(len(text), m.end() + AFTER)
        while a > max(0, m.start() - LONGEST_WORD) and not text[a - 1].isspace():
            a -= 1
        if held and a <= held[1]:
            held = held[0], b
        else:
            if held:
                yield held
            held = a, b
    if held:
        yield held


def added_spans(text: str, base: list[Span], weights: dict[str, float]) -> list[Span]:
    if not weights:
        return []
    taken = Taken([(a, b) for a, b, _ in base])
    out: list[Span] = []
    for start, end in windows(text):
        if taken.overlaps(start, end) and all(taken.holds(*m.span()) for m in TRIGGER.finditer(text, start, end)):
            continue  # every candidate is a base span
        w = Window(text, start, end, taken)
        out += [(w.tokens[i][0], w.tokens[i + k - 1][1], kind) for i, k, kind in best(w, weights)] if w.segments else []
    return out


# ---- training ----

def variants(kind: str, s: str, pick: int) -> list[str]:
    """Forms of a span that the patterns miss."""
    if kind == "email":
        name, _, rest = s.partition("@")
        return [[f"{name} at {rest.replace('.', ' dot ')}", f"{name} (at) {rest}", f"{name}[at]{rest.replace('.', '[dot]')}", f"{name} [at] {rest.replace('.', ' [dot] ')}"][pick % 4]]
    if kind == "ip":
        return [s.replace(".", ["[.]", "(.)", "[dot]"][pick % 3])]
    digits = "".join(filter(str.isdigit, s))
    if kind == "card":
        four = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        return [[".", "/", "  ", "_"][pick % 4].join(four)]
    d = digits[-10:].rjust(10, "5")
    return [[f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}", f"1-{d[:3]}-{d[3:6]}-{d[6:]}", f"00{digits[:2]} {d[:3]} {d[3:]}"][pick % 5]]


def decoys(digits: str, pick: int) -> str:
    """Numbers of other kinds in a span's place."""
    d = (digits + "73514926")[:8]
    return [f"20{d[:2]}-0{int(d[2]) % 9 + 1}-1{d[3]}", f"1{d[0]}/0{int(d[1]) % 9 + 1}/20{d[2:4]}", f"{d[0]} {d[1:4]} {d[4:7]}", f"{d[:2]}.{d[2]}.{d[3]}.{d[4:8]}", d[:7], digits + d, f"{d[:4]}-{d[4:8]}", f"19{d[:2]} 20{d[2:4]}"][pick % 8]


def examples(text: str) -> Iterator[tuple[str, int, int, str]]:
    """(window text, start, end, kind) around base spans and around numbers that are none (kind empty)."""
    base = base_spans(text)
    for start, end in windows(text):
        inside = [s for s in base if start <= s[0] and s[1] <= end]
        if len(inside) > 1 or end - start > 400:
            continue
        if inside:
            a, b, kind = inside[0]
            yield text[start:end], a - start, b - start, kind
        elif not any(s[0] < end and start < s[1] for s in base):
            yield text[start:end], 0, 0, ""


def train(rows: list[tuple[str, int, int, str]], rounds: int = 6) -> dict[str, float]:
    cases: list[tuple[Window, set]] = []

    def add(text: str, a: int, b: int, kind: str) -> None:
        w = Window(text, 0, len(text))
        starts, ends = [t[0] for t in w.tokens], [t[1] for t in w.tokens]
        gold = {(starts.index(a), ends.index(b) - starts.index(a) + 1, kind)} if kind and a in starts and b in ends else set()
        if w.segments and (not kind or any((i, k, c) in gold for i, k, c, _ in w.segments)):
            cases.append((w, gold))

    if not any(kind for *_, kind in rows):
        return {}
    for n, (text, a, b, kind) in enumerate(rows):
        add(text, a, b, kind)
        if kind:
            for v in variants(kind, text[a:b], n):
                add(text[:a] + v + text[b:], a, a + len(v), kind)
            for k in range(2):
                add(text[:a] + decoys("".join(filter(str.isdigit, text[a:b])), n + 3 * k) + text[b:], 0, 0, "")
    weights: dict[str, float] = {}
    squares: dict[str, float] = {}
    for _ in range(rounds):
        for w, gold in cases:
            for name, g in gradient(w, gold, weights).items():
                g -= 1e-3 * weights.get(name, 0.0)
                squares[name] = squares.get(name, 0.0) + g * g
                weights[name] = weights.get(name, 0.0) + 0.5 * g / (1e-8 + squares[name] ** 0.5)
    return weights


def fit(docs: DataFrame) -> dict[str, float]:
    """Weights from the windows of all texts, a bounded number of each kind."""
    schema = pa.schema([("text", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_batches((e for _, text in rows_of(batches) for e in examples(text)), schema)

    found = cut(texts(docs).mapInArrow(run, "text string, start int, stop int, kind string").distinct()).withColumn("h", F.xxhash64("text"))
    rows = [r for kind in ("", *KINDS) for r in found.where(F.col("kind") == kind).orderBy("h", "text", "start").limit(KIND_WINDOWS).collect()]
    return train([(r.text, r.start, r.stop, r.kind) for r in sorted(rows, key=lambda r: (r.h, r.text, r.start))])


def find(docs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``doc_id``, counts of base spans by kind, ``base_sha256``, ``spans`` (all, by start, then kind), ``n_added`` of each row."""
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for doc_id, text in rows_of(batches):
                base = base_spans(text)
                more = added_spans(text, base, weights)
                every = sorted([*base, *more], key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
                counts = [sum(s[2] == k for s in base) for k in KINDS]
                yield doc_id, *counts, hashlib.sha256(written(base).encode()).hexdigest(), written(every), len(more)

        yield from in_batches(rows(), schema)

    return texts(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long")


def masked(text: str, weights: dict[str, float]) -> str:
    """The text with every span, overlapping ones together, replaced by the kind of the first."""
    base = base_spans(text)
    out, at = [], 0
    for a, b, kind in sorted([*base, *added_spans(text, base, weights)], key=lambda s: (s[0], KINDS.index(s[2]))):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


def mask(docs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``docs`` with spans masked in ``text``, and ``n_chars``, if there, set anew; a null text stays null."""
    @F.pandas_udf("string")
    def clean(s):  # noqa: ANN001, ANN202
        return s.map(lambda t: None if t is None else masked(t, weights))

    new = fresh(docs, "_text")
    out = docs.withColumn(new, clean(F.col("text").cast("string")))
    columns = {"text": F.col(new), "n_chars": F.char_length(new).cast(dict(docs.dtypes).get("n_chars", "long"))}
    return out.select(*[columns.get(c, F.col(c)).alias(c) for c in docs.columns])


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find(docs, fit(docs))
