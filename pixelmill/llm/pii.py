"""Personal data: base patterns, and a linear-chain conditional random field over word shapes that adds to them.

A text's tokens are its runs of letters and digits and its single marks. A token's features are its shape (kind of mark;
case, length, whether letters and digits mix, whether all are hexadecimal) and the shapes of the tokens up to two places
away, each with whether white space parts them from the token, and for digits whether they belong to a group of digits in
the form of a card number that passes Luhn's check. The field's weights are trained on a small labelled table (an argument;
``training_table`` by default: sentences with marked spans) by gradient ascent on the conditional likelihood; its labels
are outside and inside of the kinds. Decoding is Viterbi over batches of sequences in numpy. A token whose own score for
"outside" exceeds every other label by more than any transitions can make up is outside on every best path, so long
stretches of plain words fall away before decoding, and what is decoded is still the best labelling of the whole text.

Spans: those of the base patterns (kinds email, ip, card, phone) always; spans of the field (kinds as the base's, and
``secret`` for keys and passwords) where they overlap no base span. A card of the field passes Luhn's check.

Defined cases: null and empty texts have no spans; rows that are equal are rows each; extra columns are carried, columns
named as an output column are replaced; an empty table gives no rows. Of the labelled table, rows without text, spans that
are null or of other kinds, and all but ``FIT_ROWS`` rows (by a hash of the text) do not count; an empty one adds no spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import shared, tokens

KINDS = ["email", "ip", "card", "phone"]
ADDED = [*KINDS, "secret"]
LABELS = ["O", *ADDED]
#: Fixed patterns of the base.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL, DOMAIN = re.compile(r"[A-Za-z0-9._%+-]*\Z"), re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the email pattern, found from its at signs: the longest local part before one (not before the
    last match's end), then the domain."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by start, then kind."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# Tokens and shapes, for many texts at once.

WORD, SPACE, MARK = range(3)
_KIND = np.full(128, SPACE, np.uint8)
_KIND[33:127] = MARK
_DIGIT, _UPPER, _PLAIN = np.zeros(128, np.uint8), np.zeros(128, np.uint8), np.zeros(128, np.uint8)
for _a, _b in (("a", "z"), ("A", "Z"), ("0", "9")):
    _KIND[ord(_a) : ord(_b) + 1] = WORD
_KIND[127] = WORD  # all beyond ASCII
_DIGIT[48:58], _UPPER[65:91] = 1, 1
_PLAIN[[*range(71, 91), *range(103, 123), 127]] = 1  # letters that are no hexadecimal digits
_MARKS = {c: i for i, c in enumerate("@.+-()=:_/%,\"'#[]")}
#: Shapes: letters by case (lower, first upper, all upper, other) and length (1, 2-3, 4-7, 8 and more), letters beyond
#: ASCII as lower case; digits by length (1, 2, 3, 4, 5-7, 8-11, 12-19, more); letters mixed with digits by case (lower,
#: all upper, other), length (up to 4, 8, 15, 31, more) and whether all are hexadecimal; marks one by one, other marks;
#: the edge.
N_LETTERS, N_DIGITS, N_MIXED = 16, 8, 30
FIRST_MARK = N_LETTERS + N_DIGITS + N_MIXED
N_SHAPES = FIRST_MARK + len(_MARKS) + 2
EDGE = N_SHAPES - 1
_MARK_SHAPE = np.full(128, FIRST_MARK + len(_MARKS), np.int64)
for _c, _i in _MARKS.items():
    _MARK_SHAPE[ord(_c)] = FIRST_MARK + _i
_LETTER_LENGTH = np.array([0, 0, 1, 1, 2, 2, 2, 2, 3])
_DIGIT_LENGTH = np.array([0, 0, 1, 2, 3, 4, 4, 4, 5, 5, 5, 5, 6, 6, 6, 6, 6, 6, 6, 6, 7])
_MIXED_LENGTH = np.array([0] * 5 + [1] * 4 + [2] * 7 + [3] * 16 + [4])
REACH = (-2, -1, 0, 1, 2)
#: See ``Field``.
SPARE = 0.5
#: Digits may be: in no group of a card's length, in one that fails, in one that passes, in several that pass together.
CARD_STATES = 4
#: A feature is a place, whether white space lies between, and a shape; or a card state.
N_FEATURES = len(REACH) * 2 * N_SHAPES + CARD_STATES
#: How card numbers are grouped.
GROUPS = {(4, 4, 4, 4), (4, 4, 4, 4, 3), (4, 6, 5), (4, 6, 4), *((n,) for n in range(13, 20))}


class Tokens:
    """Of all texts' tokens: text, start, end (code points in the text), shape, whether white space precedes, card state."""

    def __init__(self, texts: list[str]) -> None:
        lens = np.array([len(t) for t in texts], np.int64)
        code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        low = np.minimum(code, 127).astype(np.uint8)
        kind = _KIND[low]
        begin_of = np.cumsum(lens) - lens
        new = np.ones(len(code), bool)
        np.not_equal(kind[1:], kind[:-1], out=new[1:])
        new |= kind == MARK
        new[begin_of[lens > 0]] = True
        every = np.flatnonzero(new)
        kinds = kind[every]
        real = np.flatnonzero(kinds != SPACE)
        count = lambda flag: np.add.reduceat(flag[low], every, dtype=np.int32)[real] if len(every) else np.zeros(0, np.int32)
        start, end, kinds = every[real], np.append(every[1:], len(code))[real], kinds[real]
        size, digits, uppers = end - start, count(_DIGIT), count(_UPPER)
        letters = size - digits
        case = np.where(uppers == 0, 0, np.where(uppers == letters, 2, np.where((uppers == 1) & (_UPPER[low[start]] == 1), 1, 3)))
        shape = np.where(digits == 0, case * 4 + _LETTER_LENGTH[np.minimum(size, 8)], N_LETTERS + _DIGIT_LENGTH[np.minimum(size, 20)])
        if len(mixed := np.flatnonzero((digits > 0) & (letters > 0))):
            hexes = np.array([not _PLAIN[low[a:b]].any() for a, b in zip(start[mixed].tolist(), end[mixed].tolist(), strict=True)])
            cased = np.array([0, 2, 1, 2])[case[mixed]]
            shape[mixed] = N_LETTERS + N_DIGITS + (cased * 5 + _MIXED_LENGTH[np.minimum(size[mixed], 32)]) * 2 + hexes
        self.shape = np.where(kinds == WORD, shape, _MARK_SHAPE[low[start]])
        self.text = np.searchsorted(begin_of + lens, start, "right")
        self.gap = np.ones(len(start), bool)
        self.gap[1:] = (start[1:] != end[:-1]) | (self.text[1:] != self.text[:-1])
        self.card = self._cards(code, low, start, end, (digits == size) & (kinds == WORD))
        self.start, self.end = (start - begin_of[self.text], end - begin_of[self.text]) if len(start) else (start, end)

    def _cards(self, code: np.ndarray, low: np.ndarray, start: np.ndarray, end: np.ndarray, digit: np.ndarray) -> np.ndarray:
        """Card states: groups of digits one blank, dot or hyphen apart."""
        out, own = np.zeros(len(start), np.int64), np.flatnonzero(digit)
        self.numbers: dict[int, int] = {}  # the first token of each group that passes, and how many tokens it has
        if len(own) < 1:
            return out
        apart = np.ones(len(own), bool)
        between = end[own[:-1]]
        apart[1:] = (start[own[1:]] - between != 1) | ~np.isin(low[np.minimum(between, len(low) - 1)], [32, 45, 46]) | (self.text[own[1:]] != self.text[own[:-1]])
        first = np.flatnonzero(apart)
        total = np.add.reduceat((end - start)[own], first)
        for a, b in zip(first[total >= 12].tolist(), np.append(first[1:], len(own))[total >= 12].tolist(), strict=True):
            run = own[a:b]
            size = (end[run] - start[run]).tolist()
            out[run] = 1
            for i in range(len(run)):
                for n in (5, 4, 3, 1):
                    if i + n <= len(run) and tuple(size[i : i + n]) in GROUPS and luhn("".join(code[start[t] : end[t]].astype(np.uint8).tobytes().decode() for t in run[i : i + n])):
                        out[run[i : i + n]] = 2 + (n > 1)
                        self.numbers.setdefault(int(run[i]), n)
        return out


def features(t: Tokens) -> np.ndarray:
    """The indices of each token's features, a column a place and one for the card state."""
    n = len(t.shape)
    out, gaps, shape = np.empty((n, len(REACH) + 1), np.int32), np.cumsum(t.gap, dtype=np.int32), t.shape.astype(np.int32)
    for k, d in enumerate(REACH):
        column = out[:, k]
        column[:] = (k * 2 + 1) * N_SHAPES + EDGE
        if abs(d) < n:
            here, there = slice(max(-d, 0), n - max(d, 0)), slice(max(d, 0), n - max(-d, 0))
            parted = gaps[here] != gaps[there]
            column[here] = np.where(t.text[here] == t.text[there], (k * 2 + parted) * N_SHAPES + shape[there], column[here])
    out[:, -1] = len(REACH) * 2 * N_SHAPES + t.card
    return out


class Field:
    """Weights of features by label, and of transitions."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray) -> None:
        self.weights, self.moves = weights, moves
        # Of runs of tokens that prefer "outside" by over ``floor``: no best path leaves "outside" between two of them,
        # enters further than ``rim`` tokens from either side, or crosses ``least`` tokens (each token of such a detour
        # loses SPARE more than its transitions gain, and a detour's ends gain ``into``, ``out`` or both at most).
        stay, (mark, other) = moves[0, 0], (moves[0, 1:], moves[1:, 0])
        inner = max(moves[1:, 1:].max() - stay, mark.max() + other.max() - 2 * stay - SPARE, 0)
        into, out = moves[1:, 1:].max() - mark.min() + stay, moves[1:, 1:].max() - other.min()
        self.floor = float(inner + SPARE)
        self.rim = int(np.ceil(max(mark.max() - mark.min(), other.max() - other.min(), 0) / SPARE)) + 1
        self.least = int(np.ceil(max(into + out - stay, 0) / SPARE)) + 1

    def emit(self, x: np.ndarray) -> np.ndarray:
        out = self.weights[x[:, 0]]
        for k in range(1, x.shape[1]):
            out = out + self.weights[x[:, k]]
        return out

    def viterbi(self, emit: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The best labels of the sequences emit[start:end], all at once, longest first. An outer "O" stands beside them."""
        out = np.zeros(len(emit), np.int8)
        size = ends - starts
        order = np.argsort(-size, kind="stable")
        starts, size = starts[order], size[order]
        if not len(size):
            return out
        back = []
        score = emit[starts] + self.moves[0]
        for t in range(1, int(size[0])):
            live = int(np.searchsorted(-size, -t, "left"))  # sequences longer than t
            paths = score[:live, :, None] + self.moves[None]
            back.append(paths.argmax(1).astype(np.int8))
            score[:live] = paths.max(1) + emit[starts[:live] + t]
        label = (score + self.moves[:, 0]).argmax(1)
        out[starts + size - 1] = label
        for t in range(int(size[0]) - 1, 0, -1):
            live = int(np.searchsorted(-size, -t, "left"))
            label[:live] = back[t - 1][np.arange(live), label[:live]]
            out[starts[:live] + t - 1] = label[:live]
        return out

    def label(self, t: Tokens) -> np.ndarray:
        """The best label of each token."""
        emit, text = self.emit(features(t)), t.text
        if not len(emit):
            return np.zeros(0, np.int8)
        calm = emit[:, 0] - emit[:, 1:].max(1) > self.floor
        new = np.ones(len(calm), bool)
        new[1:] = (calm[1:] != calm[:-1]) | (text[1:] != text[:-1])
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(calm)))
        place = np.arange(len(calm)) - np.repeat(begin, size)
        size = np.repeat(size, size)
        plain = calm & (size >= self.least) & (place >= self.rim) & (place < size - self.rim)
        own = np.flatnonzero(~plain)
        if not len(own):
            return np.zeros(len(emit), np.int8)
        cut = np.flatnonzero((np.diff(own) > 1) | (np.diff(text[own]) != 0)) + 1
        starts, ends = own[np.concatenate([[0], cut])], own[np.concatenate([cut - 1, [len(own) - 1]])] + 1
        return self.viterbi(emit, starts, ends)

    @classmethod
    def blank(cls) -> Field:
        """Labels everything outside."""
        weights = np.zeros((N_FEATURES, len(LABELS)), np.float32)
        weights[:, 0] = 1
        return cls(weights, np.zeros((len(LABELS), len(LABELS)), np.float32))

    @classmethod
    def train(cls, rows: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = 80, rate: float = 0.6, decay: float = 1e-4) -> Field:
        """Gradient ascent (with adaptive steps) on the conditional log-likelihood of (text, spans) rows."""
        t = Tokens([r[0] for r in rows])
        text, n, labels = t.text, len(rows), len(LABELS)
        x, y = features(t), np.zeros(len(text), np.int64)
        if not len(text):
            return cls.blank()
        for i, (_, spans) in enumerate(rows):
            own = slice(*np.searchsorted(text, [i, i + 1]))
            for kind, a, b in spans:
                y[own][(t.start[own] < b) & (t.end[own] > a)] = LABELS.index(kind)
        first = np.searchsorted(text, np.arange(n))
        size = np.searchsorted(text, np.arange(n), "right") - first
        keep = size > 0
        first, size = first[keep], size[keep]
        longest, seqs = int(size.max()), len(size)
        at = first[:, None] + np.minimum(np.arange(longest), size[:, None] - 1)
        live = np.arange(longest) < size[:, None]
        weights, moves = np.zeros((N_FEATURES, labels)), np.zeros((labels, labels))
        sums = [np.full_like(weights, 1e-6), np.full_like(moves, 1e-6)]
        gold_w, gold_m = np.zeros_like(weights), np.zeros_like(moves)
        for k in range(x.shape[1]):
            np.add.at(gold_w, (x[:, k], y), 1)
        last = first + size - 1
        np.add.at(gold_m, (0, y[first]), 1)
        np.add.at(gold_m, (y[last], 0), 1)
        inner = np.flatnonzero(text[1:] == text[:-1])
        np.add.at(gold_m, (y[inner], y[inner + 1]), 1)
        for _ in range(rounds):
            emit = sum(weights[x[:, k]] for k in range(x.shape[1]))[at]
            forward, backward = np.zeros((longest, seqs, labels)), np.zeros((longest, seqs, labels))
            forward[0] = emit[:, 0] + moves[0]
            for t in range(1, longest):
                step = np.logaddexp.reduce(forward[t - 1][:, :, None] + moves[None], 1) + emit[:, t]
                forward[t] = np.where(live[:, t, None], step, forward[t - 1])
            backward[-1] = moves[:, 0]
            for t in range(longest - 2, -1, -1):
                step = np.logaddexp.reduce(moves[None] + (emit[:, t + 1] + backward[t + 1])[:, None, :], 2)
                backward[t] = np.where(live[:, t + 1, None], step, moves[None, :, 0])
            total = np.logaddexp.reduce(forward[-1] + moves[:, 0], 1)
            got_w, got_m, each = np.zeros_like(weights), np.zeros_like(moves), np.zeros((len(x), labels))
            for t in range(longest):
                on = live[:, t]
                p = np.exp(forward[t] + backward[t] - total[:, None])[on]
                each[at[on, t]] = p
                if t == 0:
                    got_m[0] += p.sum(0)
                else:
                    pair = forward[t - 1][on][:, :, None] + moves[None] + (emit[on, t] + backward[t][on])[:, None, :] - total[on][:, None, None]
                    got_m += np.exp(pair).sum(0)
                ending = on & (size - 1 == t)
                got_m[:, 0] += np.exp(forward[t] + backward[t] - total[:, None])[ending].sum(0)
            for k in range(x.shape[1]):
                for y_ in range(labels):
                    got_w[:, y_] += np.bincount(x[:, k], each[:, y_], N_FEATURES)
            for value, gold, got, s in ((weights, gold_w, got_w, sums[0]), (moves, gold_m, got_m, sums[1])):
                grad = gold - got - decay * value
                s += grad * grad
                value += rate * grad / np.sqrt(s)
        return cls(weights.astype(np.float32), moves.astype(np.float32))


def _checked(digits: str) -> str:
    """With the last digit that passes Luhn's check."""
    return next(digits + c for c in "0123456789" if luhn(digits + c))


def training_table(rows: int = 700, seed: int = 1) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """The default labelled table: sentences of invented words with marked spans, made by rule. Among them are forms that
    the base patterns miss (phones without a plus, at signs in words, card numbers beside other digits, keys and
    passwords) and forms that are not personal data (numbers that fail Luhn's check, versions, prices, dates, identifiers)."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[int(rng.integers(len(x)))]
    of = lambda n, chars: "".join(rng.choice(list(chars), int(n)))
    upto = lambda a, b: int(rng.integers(a, b + 1))
    digits = lambda n: of(n, "0123456789")
    word = lambda a=1, b=9: of(upto(a, b), "aeiounrstlchdmé")
    name = lambda: word(3, 8).replace("é", "e")
    small, large = "0123456789abcdefghijklmnopqrstuvwxyz", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    both, hexes = small + large[10:], small[:16]
    grouped = lambda d, sizes, sep: sep.join(d[sum(sizes[:i]) : sum(sizes[: i + 1])] for i in range(len(sizes)))
    sizes = lambda: pick((16,), (4, 4, 4, 4), (4, 6, 5), (14,), (4, 4, 4, 4, 3), (13,), (16,))

    def card() -> str:
        g = sizes()
        return grouped(_checked(digits(sum(g) - 1)), g, pick(" ", "-", "-", "."))

    def failing() -> str:
        g = sizes()
        d = _checked(digits(sum(g) - 1))
        return grouped(d[:-1] + str((int(d[-1]) + upto(1, 9)) % 10), g, pick(" ", "-", "."))

    def key() -> str:
        return pick(lambda: of(pick(32, 40, 40, 64, 24), hexes), lambda: of(upto(16, 40), both), lambda: of(upto(16, 32), small), lambda: of(upto(16, 24), large), lambda: f"{word(2, 3)}_{word(3, 5)}_{of(upto(16, 32), both)}".replace("é", "e"))()

    def told() -> tuple[str, str, str]:
        """What stands before a secret, the secret, what closes it."""
        quote = pick("", '"', "'")
        sign = pick("=", " = ", ": ", ":", " ")
        label = pick(name(), f"{name()}_{name()}", f"{name()}-{name()}", f"{name().upper()}_{name().upper()}", f"{name()} {name()}")
        return label + sign + quote, key(), quote

    plain = [
        lambda: f"version {upto(1, 9)}.{upto(0, 20)}.{upto(0, 9)}", lambda: f"{digits(2)},{digits(2)}", lambda: f"{upto(1900, 2030)}", lambda: f"{digits(4)}-{digits(2)}-{digits(2)}",
        lambda: f"{digits(2)}/{digits(2)}/{digits(4)}", lambda: f"{digits(2)}:{digits(2)}:{digits(2)}", lambda: f"{upto(1900, 1999)}-{upto(2000, 2030)}", lambda: f"${digits(3)}.{digits(2)}",
        lambda: f"{name().upper()}-{digits(4)}", lambda: f"{word(1, 3)}{digits(1)}{word(1, 2)}", lambda: f"{name()}{digits(2)}", lambda: f"#{of(6, hexes)}",
        lambda: "-".join(of(n, hexes) for n in (8, 4, 4, 4, 12)), lambda: f"{name()} {of(7, hexes)}", failing, failing, failing, lambda: digits(upto(9, 24)).lstrip("0") + "1",
        lambda: f"978-{digits(1)}-{digits(3)}-{digits(5)}-{digits(1)}", lambda: " ".join(digits(upto(1, 4)) for _ in range(upto(2, 9))), lambda: f"{name()}/{name()}/{name()}.{name()}",
        lambda: f"{name()}: {name()} = {name()}", lambda: f"({name()}, {digits(2)})", lambda: f"{name()}{pick('!!', '***', '%%%', '&&&', '###')} {name()}{pick('|', '~', '^^', '...')}",
        lambda: f"{name().capitalize()} {name().upper()} a {name()}", lambda: f'"{name()}" {name()}', lambda: f"{digits(1)}% {name()} {digits(2)}.{digits(1)}%", lambda: f"<{name()}>", lambda: " ".join([word(1, 2)] * upto(2, 8)),
        lambda: pick(" ", ", ", "!! ").join(word(2, 14).upper() for _ in range(upto(2, 7))), lambda: word(8, 16).capitalize(),
        lambda: f"+{digits(2)}%", lambda: f"{name()} @ {digits(2)}", lambda: f"[{digits(1)}] {name()}", lambda: f"{name()}_{name()}_{digits(2)}",
    ]
    marked = {
        "email": [lambda: f"{name()}.{name()}@{name()}.com", lambda: f"{name()}{digits(2)}@{name()}.{name()}.org", lambda: f"{name()} @ {name()}.com", lambda: f"{name()} [at] {name()}.net", lambda: f"{name()}(at){name()}.{pick('com', 'org', 'de')}", lambda: f"{name()}_{name()}@{name()}-{name()}.net"],
        "ip": [lambda: ".".join(str(upto(1, 254)) for _ in range(4)), lambda: ":".join(of(4, hexes) for _ in range(8))],
        "card": [card],
        "phone": [lambda: f"+{upto(1, 99)} {digits(3)} {digits(3)} {digits(4)}", lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}", lambda: f"{digits(3)}.{digits(3)}.{digits(4)}"],
    }
    out = []
    for _ in range(rows):
        text, spans = "", []
        for _ in range(upto(1, 3)):
            words = [word() for _ in range(upto(1, 8))]
            words[0] = words[0].capitalize() if rng.random() < 0.5 else words[0]
            text += " ".join(words) + pick(" ", " ", ", ", ". ", "\n", ": ", " | ")
            kind = LABELS[int(rng.integers(len(LABELS)))] if rng.random() < 0.6 else "O"
            if kind == "secret":
                before, form, after = told() if rng.random() < 0.8 else ("", of(pick(32, 40, 64), hexes), "")
            elif kind == "card" and rng.random() < 0.4:
                before, form, after = pick((digits(upto(1, 3)) + " ", card(), ""), ("", card(), " " + digits(2)))
            else:
                before, form, after = "", pick(*(plain if kind == "O" else marked[kind]))(), ""
            text += before
            if kind != "O":
                spans.append((kind, len(text), len(text) + len(form)))
            text += form + after + pick(" ", ". ", ", ", "\n", " | ", "; ")
        out.append((text + word() + ".", spans))
    return out


#: Most rows of a labelled table that the field is trained on.
FIT_ROWS = 2000


@lru_cache(maxsize=1)
def field() -> Field:
    return Field.train(training_table())


def trained(labelled: DataFrame | None) -> Field:
    """The field of a labelled table: text string, spans array of (kind string, start, end) in code points."""
    if labelled is None:
        return field()
    known = labelled.select("text", "spans").where("text is not null and spans is not null").orderBy(F.xxhash64("text"), "text").limit(FIT_ROWS).collect()
    fit = lambda s: s is not None and s["kind"] in ADDED and s["start"] is not None and s["end"] is not None
    return Field.train([(r["text"], [(s["kind"], s["start"], s["end"]) for s in r["spans"] if fit(s)]) for r in known])


def spans_of(texts: list[str], model: Field) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """Of each text: base spans, and all spans (kind, start, end) by start, then kind."""
    t = Tokens(texts)
    label = model.label(t)
    own = np.flatnonzero(label)
    new = np.ones(len(own), bool)
    new[1:] = (np.diff(own) != 1) | (label[own[1:]] != label[own[:-1]]) | (t.text[own[1:]] != t.text[own[:-1]])
    first = own[new]
    last = own[np.append(np.flatnonzero(new)[1:] - 1, len(own) - 1)] if len(own) else own
    added: dict[int, list[tuple[str, int, int]]] = {}
    for i, j in zip(first.tolist(), last.tolist(), strict=True):
        kind, at = LABELS[label[i]], i
        while at <= j:  # of a run of card tokens, the numbers that pass
            n = t.numbers.get(at, 0) if kind == "card" else j - i + 1
            if n and at + n - 1 <= j:
                added.setdefault(int(t.text[at]), []).append((kind, int(t.start[at]), int(t.end[at + n - 1])))
            at += max(n, 1)
    out = []
    for i, text in enumerate(texts):
        base, more = base_spans(text), added.get(i, [])
        if more and base:  # by start; of the base spans that begin before a span ends, none may reach into it
            begins, reach = [a for _, a, _ in base], np.maximum.accumulate([b for _, _, b in base])
            before = np.searchsorted(begins, [b for _, _, b in more])
            more = [s for s, n in zip(more, before.tolist(), strict=True) if not n or reach[n - 1] <= s[1]]
        out.append((base, sorted(base + more, key=lambda s: (s[1], ADDED.index(s[0]), s[2]))))
    return out


def _said(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, text: str = "text", labelled: DataFrame | None = None) -> DataFrame:
    """``docs`` with n_email, n_ip, n_card, n_phone (of the base), base_sha256, spans, n_added and n_spans (of all)."""
    counts = [f"n_{k}" for k in KINDS]
    docs = docs.drop(*counts, "base_sha256", "spans", "n_added", "n_spans")
    sent = docs.sparkSession.sparkContext.broadcast(trained(labelled))
    more = [T.StructField(c, T.LongType()) for c in counts] + [T.StructField(c, T.StringType()) for c in ("base_sha256", "spans")] + [T.StructField(c, T.LongType()) for c in ("n_added", "n_spans")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tokens.slices(batch, text, 512 << 10):
                found = spans_of([t or "" for t in piece.column(text).to_pylist()], sent.value)
                cols = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
                cols += [pa.array([hashlib.sha256(_said(base).encode()).hexdigest() for base, _ in found]), pa.array([_said(every) for _, every in found]), pa.array([len(every) - len(base) for base, every in found], pa.int64()), pa.array([len(every) for _, every in found], pa.int64())]
                yield pa.RecordBatch.from_arrays([*piece.columns, *cols], names=[*piece.schema.names, *(f.name for f in more)])

    return docs.mapInArrow(shared.lean(task), T.StructType([*docs.schema.fields, *more]))


def query(spark, sf_dir: str) -> DataFrame:
    """op1: the documents' personal data."""
    return find(shared.table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
