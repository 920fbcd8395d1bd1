"""Secret scans: exact base rules, and a linear-chain conditional random field that adds spans.

Tokens are runs of secret characters. The field tags each as outside, begin or inside from its
shape, its neighbours and the characters between, and features of the whole text. It is trained
here on windows of tokens from a bounded sample of documents: around the spans of the base rules;
around copies of them in which the value is replaced by a secret of another shape and the word
that announces it by another word or nothing; and away from them, where a token is replaced by
something that looks alike but is no secret (dates, paths, numbers, names). Tokens of a secret's
shape that no rule explains are not labelled: windows with them are left out, so the field is
free to add them. Decoding is Viterbi's. A token whose
outside score leads by more than all transitions can weigh is outside on the best path whatever
its neighbours are, so only the stretches between such tokens are decoded, which is exact.

Base kinds, leftmost and not overlapping within a kind: ``assign``, ``access``, ``hex``. Added
spans have kind ``crf`` and never overlap base ones.

Defined cases: null text counts as empty and has no spans; without a base span in the sample
nothing is learned and nothing is added; repeated rows are kept apart; other columns are left out
of the spans, and kept by ``redact``.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pathweave.llm.samples import bounded_sample
from pathweave.llm.texts import Texts, slices

#: The base rules and words that announce a secret.
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN = re.compile(
    rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "crf")

#: The classifier is fitted on at most so many documents, and so many windows of each.
SAMPLE_DOCUMENTS = 8192
WINDOWS = 4
WINDOW = 12
STEPS = 160
#: Copies with other values of each base span that is taken, and text kept around them.
COPIES = 4
AROUND = 2000
#: Windows without a secret are thinned to so many times those with one.
PLAIN_WINDOWS = 3
#: An added span is dropped when it is shorter.
SHORTEST = 8

FEATURES = (
    "bias", "len6", "len10", "len16", "len24", "len36", "digit", "digits", "capital", "mixed",
    "hex", "numeric", "turns2", "turns4", "turns8", "wide", "joined", "dotted", "after_equals",
    "quoted", "after_keyword", "near_keyword", "before_keyword", "after_long", "before_long",
    "text_keyword", "text_equals", "plain", "long_plain", "long_numeric", "turns12", "capital_hex",
    "assigned_mix",
)


def _table(characters: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters)] = True
    return table


_DIGIT = _table(b"0123456789")
_UPPER = _table(bytes(range(65, 91)))
_LOWER = _table(bytes(range(97, 123)))
_HEX = _table(b"0123456789abcdef")
_CAPITAL_HEX = _table(b"0123456789ABCDEF")
_WIDE = _table(bytes(range(128, 256)))
_JOIN = _table(b"+/_-")
_DOT = _table(b".")
_EQUALS = _table(b"=:")
_QUOTE = _table(b"\"'`")
_TOKEN = _DIGIT | _UPPER | _LOWER | _WIDE | _JOIN | _DOT
_CLASS = (_DIGIT * 1 + _UPPER * 2 + _LOWER * 3).astype(np.int8)


def base_spans(texts: Texts) -> list[np.ndarray]:
    """For each base kind the byte spans in the slice, as rows of (start, end, value start)."""
    assign, access = [], []
    whole = texts.data.tobytes()
    low = whole.lower()
    for number in range(texts.count):
        begin, end = int(texts.offsets[number]), int(texts.offsets[number + 1])
        at = sorted(p for word in KEYWORDS for p in _places(low, word, begin, end))
        done = begin
        for p in at:
            if p >= done and (m := ASSIGN.match(whole, p, end)):
                done = m.end()
                if m.end(2) - m.start(2) >= 6:
                    assign.append((m.start(), m.end(), m.start(2)))
        done = begin
        for p in _places(whole, b"AKIA", begin, end):
            if p >= done and (m := ACCESS.match(whole, p, end)):
                done = m.end()
                if m.end() - p >= 20:
                    access.append((p, m.end(), p))
    starts, ends = texts.spans(_HEX[texts.data])
    long = ends - starts >= 24
    spans = [np.array(x, np.int64).reshape(-1, 3) for x in (assign, access)]
    return [*spans, np.stack([starts[long], ends[long], starts[long]], 1)]


def _places(data: bytes, word: bytes, begin: int, end: int):
    at = data.find(word, begin, end)
    while at >= 0:
        yield at
        at = data.find(word, at + 1, end)


def token_features(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the tokens, and a 0/1 row of ``FEATURES`` for each."""
    data = texts.data
    starts, ends = texts.spans(_TOKEN[data])
    of = texts.text_of(starts)
    size = ends - starts
    total = np.zeros(len(data) + 1, np.int32)

    def count(mask: np.ndarray) -> np.ndarray:
        np.cumsum(mask, out=total[1:], dtype=np.int32)
        return total[ends] - total[starts]

    digits, uppers = count(_DIGIT[data]), count(_UPPER[data])
    lowers, hexes = count(_LOWER[data]), count(_HEX[data])
    capital_hexes = count(_CAPITAL_HEX[data])
    kind = _CLASS[data]
    turn = np.zeros(len(data), bool)
    turn[1:] = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
    np.cumsum(turn, out=total[1:], dtype=np.int32)
    turns = np.where(size > 0, total[ends] - total[np.minimum(starts + 1, ends)], 0)
    wide, joined, dots = count(_WIDE[data]), count(_JOIN[data]), count(_DOT[data])
    inner_dot = dots > (_DOT[data[ends - 1]] if len(ends) else 0)

    same_before = np.zeros(len(of), bool)
    same_before[1:] = of[1:] == of[:-1]
    same_after = np.zeros(len(of), bool)
    same_after[:-1] = same_before[1:]
    previous_end = np.where(same_before, np.concatenate(([0], ends[:-1]))[: len(of)], starts)
    equal = np.concatenate(([0], np.cumsum(_EQUALS[data], dtype=np.int32)))
    quote = np.concatenate(([0], np.cumsum(_QUOTE[data], dtype=np.int32)))

    low = data.tobytes().lower()
    word_at = np.sort(np.fromiter((p for w in KEYWORDS for p in _places(low, w, 0, len(low))), np.int64))
    keyword = np.searchsorted(word_at, ends) > np.searchsorted(word_at, starts)
    text_keyword = np.bincount(of[keyword], minlength=texts.count)[of] > 0
    text_equals = (np.diff(equal[texts.offsets]) > 0)[of]

    def before(mask: np.ndarray, steps: int = 1) -> np.ndarray:
        moved = np.zeros(len(mask), bool)
        moved[steps:] = mask[:-steps]
        return moved & same_before

    def after(mask: np.ndarray) -> np.ndarray:
        moved = np.zeros(len(mask), bool)
        moved[:-1] = mask[1:]
        return moved & same_after

    long = (size >= 16) & (digits > 0)
    plain = digits + joined == 0
    rows = [
        np.ones(len(of), bool), size >= 6, size >= 10, size >= 16, size >= 24, size >= 36,
        digits > 0, 4 * digits > size, uppers > 0, (uppers > 0) & (lowers > 0) & (turns > 1),
        hexes == size, digits == size, turns >= 2, turns >= 4, turns >= 8, wide > 0, joined > 0,
        inner_dot, equal[starts] > equal[previous_end], quote[starts] > quote[previous_end],
        before(keyword), before(keyword, 2) if len(of) > 2 else before(keyword),
        after(keyword), before(long), after(long), text_keyword, text_equals,
        plain, plain & (size >= 12), (digits == size) & (size >= 10), turns >= 12,
        (capital_hexes == size) & (turns > 1), (equal[starts] > equal[previous_end]) & (turns >= 2),
    ]
    return starts, ends, of, np.stack(rows, 1) if len(of) else np.zeros((0, len(FEATURES)), bool)


def weak_labels(starts: np.ndarray, ends: np.ndarray, base: list[np.ndarray]) -> np.ndarray:
    """0 outside, 1 begin, 2 inside: tokens of the base spans' values."""
    labels = np.zeros(len(starts), np.int8)
    for begin, end, value in sorted(map(tuple, np.concatenate(base).tolist())):
        first = int(np.searchsorted(ends, value, side="right"))
        last = int(np.searchsorted(starts, end))
        if first < last and not labels[first]:
            labels[first] = 1
            labels[first + 1 : last] = 2
    return labels


@dataclass(frozen=True)
class Field:
    """Weights of (feature, label) and of (label, next label)."""

    emit: np.ndarray
    move: np.ndarray

    def tags(self, features: np.ndarray, of: np.ndarray) -> np.ndarray:
        """The best labels of each text's tokens; ``of`` numbers the texts in rising order."""
        score = features.astype(np.float32) @ self.emit.astype(np.float32)
        score = score.astype(np.float64)
        move = self.move
        labels = np.zeros(len(of), np.int8)
        lead = max(
            max(max(move[:, x] - move[:, 0]), 0.0) + max(max(move[x] - move[0]), 0.0) for x in (1, 2)
        )
        open_ = score[:, 0] - score[:, 1:].max(1) <= lead + 1e-6
        if not open_.any():
            return labels
        where = np.flatnonzero(open_)
        fresh = np.ones(len(where), bool)
        fresh[1:] = (np.diff(where) > 1) | (np.diff(of[where]) > 0)
        begin = where[fresh]
        size = np.diff(np.append(np.flatnonzero(fresh), len(where)))
        # a stretch inside a text has certain outside tokens, or nothing, on both sides
        led = np.where((begin > 0) & (of[begin - 1] == of[begin]), 1.0, 0.0)[:, None] * move[0]
        last = begin + size
        inside = (last < len(of)) & (of[np.minimum(last, len(of) - 1)] == of[begin])
        order = np.argsort(-size, kind="stable")
        begin, size, led, inside = begin[order], size[order], led[order], inside[order]
        best = score[begin] + led
        back = []
        for t in range(1, int(size[0])):
            n = int(np.searchsorted(-size, -t))  # stretches longer than t
            paths = best[:n, :, None] + move
            back.append(paths.argmax(1).astype(np.int8))
            best[:n] = paths.max(1) + score[begin[:n] + t]
        state = (best + inside[:, None] * move[:, 0]).argmax(1)
        for t in range(int(size[0]) - 1, -1, -1):
            n = int(np.searchsorted(-size, -t)) if t else len(size)
            labels[begin[:n] + t] = state[:n]
            if t:
                state[:n] = back[t - 1][np.arange(n), state[:n]]
        return labels


def fitted_field(features: np.ndarray, labels: np.ndarray) -> Field:
    """Maximum likelihood with a small quadratic penalty; windows x tokens x features."""
    x, n, length = features.astype(np.float64), len(features), labels.shape[1]
    one = np.eye(3)[labels]
    seen = np.tensordot(x, one, ([0, 1], [0, 1])), np.einsum("nta,ntb->ab", one[:, :-1], one[:, 1:])
    emit, move = np.zeros((x.shape[2], 3)), np.zeros((3, 3))
    momentum = [np.zeros_like(emit), np.zeros_like(move)]
    square = [np.zeros_like(emit), np.zeros_like(move)]
    for step in range(1, STEPS + 1):
        score = x @ emit
        ahead, behind = np.zeros((length, n, 3)), np.zeros((length, n, 3))
        ahead[0] = score[:, 0]
        for t in range(1, length):
            ahead[t] = np.logaddexp.reduce(ahead[t - 1][:, :, None] + move, 1) + score[:, t]
        for t in range(length - 2, -1, -1):
            behind[t] = np.logaddexp.reduce(move + (score[:, t + 1] + behind[t + 1])[:, None], 2)
        norm = np.logaddexp.reduce(ahead[-1], 1)
        each = np.exp(ahead + behind - norm[:, None]).transpose(1, 0, 2)
        pairs = sum(
            np.exp(
                ahead[t][:, :, None] + move + (score[:, t + 1] + behind[t + 1])[:, None]
                - norm[:, None, None]
            ).sum(0)
            for t in range(length - 1)
        )
        expected = np.tensordot(x, each, ([0, 1], [0, 1])), pairs
        for k, weights in enumerate((emit, move)):
            slope = (seen[k] - expected[k]) / n - 1e-4 * weights
            momentum[k] = 0.9 * momentum[k] + 0.1 * slope
            square[k] = 0.99 * square[k] + 0.01 * slope**2
            weights += (
                0.15 * momentum[k] / (1 - 0.9**step)
                / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
            )
    return Field(emit, move)


_ALNUM = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def _drawn(random: np.random.Generator, characters: bytes, size: int) -> bytes:
    return bytes(random.choice(np.frombuffer(characters, np.uint8), size))


def secret_value(random: np.random.Generator, assigned: bool) -> bytes:
    """A value of some shape that secrets have; short ones only behind an assignment."""
    shape = int(random.integers(0, 7 if assigned else 6))
    if shape == 0:
        return _drawn(random, b"0123456789ABCDEF", int(random.integers(32, 65)))
    if shape == 1:  # letters, an underscore, letters and digits
        prefix = _drawn(random, b"abcdefghijklmnopqrstuvwxyz", int(random.integers(2, 4)))
        middle = (b"_live_", b"_test_", b"_")[int(random.integers(0, 3))]
        return prefix + middle + _drawn(random, _ALNUM, int(random.integers(24, 41)))
    if shape == 2:  # three parts of a signed message
        parts = [_drawn(random, _ALNUM + b"-_", int(random.integers(12, 60))) for _ in range(2)]
        return b".".join([b"eyJ" + parts[0], b"eyJ" + parts[1], _drawn(random, _ALNUM + b"-_", 43)])
    if shape == 3:
        return _drawn(random, _ALNUM + b"/+", 40)
    if shape == 4:
        return base64.b64encode(random.bytes(int(random.integers(18, 48)))).rstrip(b"=")
    if shape == 5:
        return _drawn(random, _ALNUM, int(random.integers(24, 41)))
    word = _drawn(random, b"abcdefghijklmnopqrstuvwxyz", int(random.integers(4, 8))).capitalize()
    return word + _drawn(random, b"0123456789", 2) + _drawn(random, _ALNUM, int(random.integers(3, 8)))


def harmless_value(random: np.random.Generator) -> bytes:
    """Something with digits, capitals or joints that is no secret."""
    def word() -> bytes:
        return _drawn(random, b"abcdefghijklmnopqrstuvwxyz", int(random.integers(3, 10)))

    def number(size: int) -> bytes:
        return _drawn(random, b"0123456789", size)

    shape = int(random.integers(0, 9))
    date = b"-".join([b"20" + number(2), b"0" + number(1), b"1" + number(1)])
    if shape == 0:
        return date + (b"T1" + number(1) if random.integers(0, 2) else b"")
    if shape == 1:
        return b"/" + b"/".join([word() for _ in range(4)]) + b".txt"
    if shape == 2:
        return number(int(random.integers(5, 20)))
    if shape == 3:
        return b"_".join([word(), word(), b"20" + number(2), b"final.pdf"])
    if shape == 4:
        return b"".join([word().capitalize() for _ in range(3)])
    if shape == 5:
        return b"www." + word() + b".org/" + word() + b"/" + word() + b"-" + number(3)
    if shape == 6:
        return word().upper()[:4] + b"-" + number(6)
    if shape == 7:
        return b"-".join([word(), word(), word(), word()])
    return number(1) + b"." + number(2) + b"." + number(1) + b"-beta"


#: What may stand before a value besides the words of the base rules.
_LEADS = (b"", b" ", b"pwd = ", b"pwd: ", b"auth: ", b"credential = \"", b"passphrase: ", b"key='", b"use ", b"with ")
_PLAIN_LEADS = (b" ", b" ", b"name = ", b"date: ", b"path=", b"size = ", b"see ", b"version: ", b"id=\"")


def changed_copies(texts: Texts, number: int, spans: np.ndarray, tokens: np.ndarray):
    """Copies of the text around some places as (bytes, start, end, secret): the new value's place."""
    begin, end = int(texts.offsets[number]), int(texts.offsets[number + 1])
    whole = texts.data[begin:end].tobytes()
    random = np.random.default_rng(zlib.crc32(whole))

    def copy(first: int, last: int, lead: bytes, value: bytes, secret: bool):
        left, right = max(0, first - AROUND), min(len(whole), last + AROUND)
        while left and whole[left] & 0xC0 == 0x80:
            left -= 1
        while right < len(whole) and whole[right] & 0xC0 == 0x80:
            right += 1
        head = whole[left:first] + lead
        return head + value + whole[last:right], len(head), len(head) + len(value), secret

    for start, stop, _ in spans.tolist():
        for _ in range(COPIES):
            lead = _LEADS[int(random.integers(0, len(_LEADS)))]
            yield copy(start - begin, stop - begin, lead, secret_value(random, b"=" in lead or b":" in lead), True)
    for at in tokens.tolist():
        lead = _PLAIN_LEADS[int(random.integers(0, len(_PLAIN_LEADS)))]
        yield copy(at - begin, at - begin, b" " + lead, harmless_value(random) + b" ", False)


def _window(first: int, last: int, token: int) -> np.ndarray:
    """Numbers of the tokens of a window around ``token`` of a text with tokens ``first`` to ``last``."""
    return min(max(first, token - WINDOW // 2), last - WINDOW) + np.arange(WINDOW)


def training_windows(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of labelled windows: windows x tokens x features, windows x tokens."""
    base = base_spans(texts)
    spans = np.concatenate(base)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    owner = texts.text_of(spans[:, 0])
    starts, ends, of, features = token_features(texts)
    labels = weak_labels(starts, ends, base)
    shaped = unexplained(features, labels)
    bounds = np.searchsorted(of, np.arange(texts.count + 1))
    windows, tags, copies = [], [], []
    for number in np.flatnonzero(np.diff(bounds) >= WINDOW).tolist():
        low, high = int(bounds[number]), int(bounds[number + 1])
        begins = np.flatnonzero(labels[low:high] == 1)[: WINDOWS - 1] + low
        # away from the spans: around the longest other token, and at one more place
        size = np.where(labels[low:high] > 0, 0, (ends - starts)[low:high])
        away = np.array([low + int(size.argmax()), low + (high - low) * (number % 7) // 7])
        for token in [*begins.tolist(), *away.tolist()]:
            window = _window(low, high, token)
            if not shaped[window].any():
                windows.append(features[window])
                tags.append(labels[window])
        mine = spans[owner == number][: WINDOWS - 1]
        copies += changed_copies(texts, number, mine, starts[away[~(labels[away] > 0)]])
    if copies:
        changed = Texts(pa.array([c[0].decode("utf-8", "replace") for c in copies]))
        base = base_spans(changed)
        starts, ends, of, features = token_features(changed)
        labels = weak_labels(starts, ends, base)
        bounds = np.searchsorted(of, np.arange(changed.count + 1))
        for number, (_, begin, end, secret) in enumerate(copies):
            low, high = int(bounds[number]), int(bounds[number + 1])
            offset = int(changed.offsets[number])
            first = low + int(np.searchsorted(ends[low:high], offset + begin, side="right"))
            last = low + int(np.searchsorted(starts[low:high], offset + end))
            if high - low < WINDOW or first >= last:
                continue
            labels[first:last] = 0
            if secret:
                labels[first], labels[first + 1 : last] = 1, 2
            window = _window(low, high, first)
            other = unexplained(features[window], labels[window])
            other[(window >= first) & (window < last)] = False
            if not other.any():
                windows.append(features[window])
                tags.append(labels[window])
    if not windows:
        return np.zeros((0, WINDOW, len(FEATURES)), bool), np.zeros((0, WINDOW), np.int8)
    return np.stack(windows), np.stack(tags)


_SIXTEEN, _DIGITS, _FOUR = (FEATURES.index(f) for f in ("len16", "digit", "turns4"))


def unexplained(features: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Tokens of a secret's shape that no base rule has found: neither label would be sure."""
    return (labels == 0) & features[:, _SIXTEEN] & features[:, _DIGITS] & features[:, _FOUR]


def fit(documents: DataFrame) -> Field | None:
    """A field learned from a bounded sample; None when the base rules find nothing in it."""

    def run(batches):
        for piece in slices(batches):
            features, labels = training_windows(Texts(piece.column(1)))
            if len(labels):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([features.tobytes()]), pa.array([labels.tobytes()])],
                    names=["features", "labels"],
                )

    rows = (
        bounded_sample(documents.select("doc_id", F.col("text").cast("string")), SAMPLE_DOCUMENTS)
        .mapInArrow(run, "features binary, labels binary")
        .collect()
    )
    if not rows:
        return None
    rows.sort(key=lambda r: (bytes(r["labels"]), bytes(r["features"])))
    labels = np.frombuffer(b"".join(bytes(r["labels"]) for r in rows), np.int8).reshape(-1, WINDOW)
    features = np.frombuffer(b"".join(bytes(r["features"]) for r in rows), np.bool_)
    if not labels.any():
        return None
    features = features.reshape(len(labels), WINDOW, len(FEATURES))
    alike, times = np.unique(labels.any(1), return_counts=True)
    keep = np.ones(len(labels), bool)
    if len(times) == 2 and times[0] > PLAIN_WINDOWS * times[1]:
        plain = np.flatnonzero(~labels.any(1))
        keep[plain] = False
        keep[plain[np.linspace(0, len(plain) - 1, PLAIN_WINDOWS * times[1]).astype(int)]] = True
    return fitted_field(features[keep], labels[keep])


def text_spans(texts: Texts, field: Field | None) -> list[list[tuple[int, int, int]]]:
    """For each text its (start, kind number, end) in code points, by start and kind."""
    base = base_spans(texts)
    rows = [np.insert(x[:, :2], 1, k, 1) for k, x in enumerate(base)]
    if field is not None:
        starts, ends, of, features = token_features(texts)
        tags = field.tags(features, of)
        inside = tags > 0
        begins = inside.copy()
        begins[1:] &= (tags[1:] == 1) | ~inside[:-1] | (of[1:] != of[:-1])
        first = np.flatnonzero(begins)
        stops = inside.copy()
        stops[:-1] &= begins[1:] | ~inside[1:]
        last = np.flatnonzero(stops)
        a, b = starts[first], ends[last]
        b = b - (_DOT[texts.data[b - 1]] if len(b) else 0)
        taken = np.concatenate([x[:, :2] for x in base])
        free = b - a >= SHORTEST
        if len(taken):
            taken = taken[np.argsort(taken[:, 0], kind="stable")]
            reach = np.maximum.accumulate(taken[:, 1])
            at = np.searchsorted(taken[:, 0], b) - 1
            free &= (at < 0) | (reach[at] <= a)
        rows.append(np.stack([a[free], np.full(free.sum(), 3), b[free]], 1))
    found = np.concatenate(rows)
    found = found[np.lexsort((found[:, 1], found[:, 0]))]
    number = texts.text_of(found[:, 0])
    if len(found):
        points = texts.code_points_before()
        shift = points[texts.offsets[number]]
        found[:, 0] = points[found[:, 0]] - shift
        found[:, 2] = points[found[:, 2]] - shift
    spans: list[list[tuple[int, int, int]]] = [[] for _ in range(texts.count)]
    for n, row in zip(number.tolist(), found.tolist(), strict=True):
        spans[n].append(tuple(row))
    return spans


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(documents: DataFrame, field: Field | None) -> DataFrame:
    """``doc_id``, counts of the base kinds, ``base_sha256``, ``spans`` and ``n_added``."""

    def run(batches):
        for piece in slices(batches):
            spans = text_spans(Texts(piece.column(1)), field)
            base = [[s for s in mine if s[1] < 3] for mine in spans]
            counts = [pa.array([sum(s[1] == k for s in x) for x in spans], pa.int64()) for k in range(4)]
            digests = [hashlib.sha256(_written(x).encode()).hexdigest() for x in base]
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column(0), *counts[:3], pa.array(digests, pa.string()),
                    pa.array([_written(x) for x in spans], pa.string()), counts[3],
                ],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added"],
            )

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run,
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
        "n_added long",
    )


def redact(documents: DataFrame, field: Field | None, mask: str = "[SECRET]") -> DataFrame:
    """``documents`` with every span of ``text`` replaced, and ``n_chars`` of such texts anew.

    Texts without a span stay as they are.
    """
    names = documents.columns
    place = names.index("text")
    length = names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        for piece in slices(batches):
            texts = piece.column("text").to_pylist()
            sizes = piece.column(length).to_pylist() if length is not None else []
            for k, spans in enumerate(text_spans(Texts(piece.column("text")), field)):
                if spans:
                    parts, done = [], 0
                    for start, _, end in sorted((s, k, e) for s, k, e in spans):
                        if end > done:
                            parts += [texts[k][done : max(start, done)], mask if start >= done else ""]
                            done = end
                    texts[k] = "".join([*parts, texts[k][done:]])
                    if length is not None:
                        sizes[k] = len(texts[k])
            columns = list(piece.columns)
            columns[place] = pa.array(texts, pa.string())
            if length is not None:
                columns[length] = pa.array(sizes, columns[length].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return documents.mapInArrow(run, documents.schema)
