"""Personal data: exact patterns, and a linear-chain conditional random field for what no pattern holds.

The base finds e-mail addresses, IP addresses, card numbers and phone numbers by their patterns. Each pattern is run only over the
stretches of a text that consist of its characters and hold enough digits (or an @), which numpy finds for a slice of texts at once; matches
can't leave such a stretch, so they are those of a scan of the whole text.

The field labels the tokens (parts between white space) of every line as one of KINDS or as nothing. A token is seen as its shape (letter case,
digits, marks, runs taken together), its size (length, digits, hexadecimal) and, if the labelled table has it often enough, its own text; a label depends on
these of the two tokens before it, itself and the two after it, and on the label before. ``fit`` maximises the penalised likelihood of a small labelled
table by forward-backward and gradient steps; the model is as large as that table's features, not as the data. Viterbi decodes
all sequences of a slice side by side. Sequences end where a line or a sentence does. One whose tokens all favour no label by more
than any transitions could win back is left out, which can't change the best path.

Spans of the field that touch a span of the base are dropped, so base spans stay as they are.

Defined results: a null text is empty and has no span; repeated rows are read alike; other columns are ignored.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from functools import cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import _kernels as K
from millrace.llm._spark import map_chunks, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "person")
_U = np.uint64

# The base ---------------------------------------------------------------------------------------------------------------

DIGITS = "0123456789"
WORDS = DIGITS + "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
PATTERNS = {"ip": re.compile(r"[0-9]+(?:\.[0-9]+){3}"), "card": re.compile(r"[0-9](?:[ -]?[0-9])+"), "phone": re.compile(r"\+[0-9][ ().0-9-]+[0-9]")}
#: The characters of a match, the digits it needs, and a character it can't do without.
STRETCH = {"ip": (DIGITS + ".", 4, "."), "card": (DIGITS + " -", 12, ""), "phone": (DIGITS + "+ ().-", 9, "+")}


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of the others."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) << (i & 1)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def holds(kind: str, match: str) -> bool:
    """The conditions on a match that its pattern doesn't state."""
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in match.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


def _total(mask: np.ndarray) -> np.ndarray:
    out = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def _emails(cps: np.ndarray, off: np.ndarray) -> list[tuple[int, int, str]]:
    """Addresses around each @: the local part reaches back over its characters to the match before at most."""
    at = np.flatnonzero(cps == ord("@"))
    if not len(at):
        return []
    near = np.zeros(len(cps), bool)
    near[at] = True
    s, e, _ = K.runs(near | K.among(cps, WORDS + "._%+-"), off)
    out = []
    for i in np.unique(np.searchsorted(s, at, "right") - 1):
        text, done = cps[s[i] : e[i]].astype(np.uint8).tobytes().decode(), 0
        last = 0  # where the characters of a local part begin
        for m in re.finditer("@", text):
            p = m.start()
            start = max(done, last)
            last = p + 1
            if start < p and (d := DOMAIN.match(text, p + 1)):
                out.append((int(s[i]) + start, int(s[i]) + d.end(), "email"))
                done = d.end()
    return out


def base_spans(cps: np.ndarray, off: np.ndarray) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base's spans over all rows of a slice."""
    out = _emails(cps, off)
    digit = (cps >= 48) & (cps <= 57)
    digits = _total(digit)
    for kind, (chars, least, needed) in STRETCH.items():
        s, e, _ = K.runs(K.among(cps, chars), off)
        full = np.flatnonzero(digits[e] - digits[s] >= least)
        for i in full:
            text = cps[s[i] : e[i]].astype(np.uint8).tobytes().decode()
            if needed in text:
                out.extend((int(s[i]) + m.start(), int(s[i]) + m.end(), kind) for m in PATTERNS[kind].finditer(text) if holds(kind, m[0]))
    return out


# The field --------------------------------------------------------------------------------------------------------------

REACH = (-2, -1, 0, 1, 2)
SHAPE = 12
LENGTHS = np.array([2, 3, 4, 5, 7, 10, 16, 25, 40])
COUNTS = np.array([1, 2, 3, 4, 5, 7, 9, 12, 16, 17, 20])
#: A feature that fewer tokens of the labelled table have is not told apart from one never seen.
SEEN = 5
CAUTION = 2.0


@cache
def _classes() -> np.ndarray:
    """By code point: 1 upper case, 2 other letters, 3 digits, 4 other marks, ASCII marks as themselves."""
    upper = K.lower_map() != np.arange(len(K.lower_map()))
    out = np.full(len(upper), 4, np.uint32)
    out[33:127] = np.arange(33, 127)
    out[K.letter_mask()] = 2
    out[K.letter_mask() & upper] = 1
    out[48:58] = 3
    return out


class Tokens:
    """The tokens of a slice: s, e, row, line (tokens of one line are each other's neighbours), seq (tokens of one sequence), and their three features."""

    def __init__(self, cps: np.ndarray, off: np.ndarray):
        word = K.nonspace_mask()[cps]
        self.s, self.e, first = K.runs(word, off)
        s, e, n = self.s, self.e, len(self.s)
        self.row = np.repeat(np.arange(len(off) - 1), np.diff(first))
        new = np.ones(n, bool)
        lines = _total(cps == 10)
        new[1:] = (self.row[1:] != self.row[:-1]) | (lines[s[1:]] != lines[s[:-1]])
        self.line = np.cumsum(new)
        stop = np.zeros(n, bool)
        stop[1:] = K.among(cps[e - 1], ".!?")[:-1]
        self.seq = np.cumsum(new | stop)
        cls = _classes()[cps]
        keep = word.copy()
        keep[1:] &= (cls[1:] != cls[:-1]) | ~word[:-1]
        keep[s] = True
        at = _total(keep)
        shape = K.span_hashes(cls[keep], at[s], np.minimum(at[e], at[s] + SHAPE))
        digit, hexa = _total(cls == 3), _total((cls == 3) | ((cps >= 97) & (cps <= 102)) | ((cps >= 65) & (cps <= 70)))
        length, digits = e - s, digit[e] - digit[s]
        size = np.searchsorted(LENGTHS, length, "right") * 64 + np.searchsorted(COUNTS, digits, "right") * 2 + ((hexa[e] - hexa[s] >= 16) & (digits > 0))
        self.features = (shape, size.astype(_U), K.span_hashes(K.lower_map()[cps], s, e))


@dataclass(frozen=True)
class Model:
    """known: by feature, the values told apart, in order. weights: by place and feature, a row for each value (0: any other) and a column
    for each label. after: by label and the label before it. caution: what no label is favoured by, for each token."""

    known: tuple[np.ndarray, ...]
    weights: dict[tuple[int, int], np.ndarray]
    after: np.ndarray
    caution: float = CAUTION

    def codes(self, tokens: Tokens) -> list[np.ndarray]:
        out = []
        for known, value in zip(self.known, tokens.features, strict=True):
            i = np.minimum(np.searchsorted(known, value), len(known) - 1)
            out.append(np.where(known[i] == value, i + 1, 0))
        return out

    def emissions(self, tokens: Tokens) -> np.ndarray:
        """The score of every token and label. Tokens of equal features are looked up once."""
        n = len(tokens.s)
        shape, size, text = self.codes(tokens)
        a, b = len(self.known[1]) + 1, len(self.known[2]) + 1
        different, code = np.unique((shape * a + size) * b + text, return_inverse=True)
        each = (different // b // a, different // b % a, different % b)
        out = np.zeros((n, len(KINDS) + 1), np.float32)
        for place in REACH:
            table_ = sum(self.weights[place, j][each[j]] for j in range(3)).astype(np.float32)
            to, of = neighbours(tokens.line, place)
            out[to] += table_[code[of]]
        return out


def neighbours(line: np.ndarray, place: int) -> tuple[np.ndarray | slice, np.ndarray | slice]:
    """Tokens that have a neighbour at ``place`` in their line, and that neighbour."""
    n = len(line)
    if place == 0:
        return slice(None), slice(None)
    k = min(abs(place), n)
    same = np.flatnonzero(line[k:] == line[: n - k])
    return (same, same + k) if place > 0 else (same + k, same)


def viterbi(scores: np.ndarray, starts: np.ndarray, ends: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The best labels of sequences [start, end) of tokens, all decoded side by side: longest first, so those that go on are a prefix. Ties go to the lower label."""
    labels = np.zeros(len(scores), np.int64)
    order = np.argsort(starts - ends, kind="stable")
    starts, size = starts[order], (ends - starts)[order]
    if not len(starts):
        return labels
    back = np.zeros(scores.shape, np.int8)
    best = scores[starts].copy()
    live = len(starts)
    final = np.zeros(len(starts), np.int64)
    for t in range(1, int(size[0]) + 1):
        going = int(np.searchsorted(-size, -t, "left"))  # those longer than t
        final[going:live] = best[going:live].argmax(1)
        if not going:
            break
        step = best[:going, None, :] + after[None]
        at = starts[:going] + t
        back[at] = step.argmax(2)
        best = step.max(2) + scores[at]
        live = going
    labels[starts + size - 1] = final
    now = final
    for t in range(int(size[0]) - 1, 0, -1):
        going = int(np.searchsorted(-size, -t, "left"))
        at = starts[:going] + t
        now[:going] = back[at, now[:going]]
        labels[at - 1] = now[:going]
    return labels


def decode(model: Model, tokens: Tokens) -> np.ndarray:
    """The label of every token: 0, or 1 + the place in KINDS."""
    n = len(tokens.s)
    if not n:
        return np.zeros(0, np.int64)
    scores = model.emissions(tokens)
    scores[:, 0] += model.caution
    first = np.flatnonzero(np.concatenate(([True], tokens.seq[1:] != tokens.seq[:-1])))
    last = np.append(first[1:], n)
    # A run of labelled tokens wins at most this much by transitions, for each token of it.
    most = 2 * max(0.0, float((model.after - model.after[0, 0]).max()))
    wins = np.maximum.reduceat((scores[:, 1:].max(1) - scores[:, 0] + most >= 0).astype(np.int8), first) > 0
    return viterbi(scores, first[wins], last[wins], model.after.astype(np.float32))


def _likelihood(scores: np.ndarray, labels: np.ndarray, starts: np.ndarray, ends: np.ndarray, after: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log-likelihood, and its gradients in the scores and in ``after``. Sequences run side by side, longest first, as in ``viterbi``."""

    def total(v: np.ndarray, axis: int) -> np.ndarray:
        m = v.max(axis, keepdims=True)
        return np.squeeze(m, axis) + np.log(np.exp(v - m).sum(axis))

    order = np.argsort(starts - ends, kind="stable")
    starts, ends = starts[order], ends[order]
    size = ends - starts
    going = [int(np.searchsorted(-size, -t, "left")) for t in range(int(size[0]))]  # by place t, the sequences longer than t
    fore, rear = scores.copy(), np.zeros_like(scores)
    for t in range(1, len(going)):
        at = starts[: going[t]] + t
        fore[at] += total(fore[at - 1][:, None, :] + after[None], 2)
    for t in range(len(going) - 1, 0, -1):
        at = starts[: going[t]] + t
        rear[at - 1] = total((rear[at] + scores[at])[:, :, None] + after[None], 1)
    z = total(fore[ends - 1], 1)
    of = np.zeros(len(scores), np.int64)  # the sequence of a token
    of[starts] = 1
    by_place = np.argsort(starts)
    z_at = z[by_place][np.cumsum(of) - 1]
    grad = np.exp(fore + rear - z_at[:, None])
    every = np.arange(len(scores))
    grad[every, labels] -= 1
    second = np.flatnonzero(of == 0)
    both = np.exp(fore[second - 1][:, None, :] + after[None] + (scores + rear)[second][:, :, None] - z_at[second][:, None, None])
    step = both.sum(0)
    np.add.at(step, (labels[second], labels[second - 1]), -1)
    loss = z.sum() - scores[every, labels].sum() - after[labels[second], labels[second - 1]].sum()
    return float(loss), grad, step


def fit(rows: list[tuple[str, list[tuple[int, int, str]]]], rounds: int = 100, rate: float = 0.1, penalty: float = 0.05) -> Model:
    """The field that explains a labelled table of (text, [(start, end, kind)]): penalised likelihood, in ``rounds`` gradient steps of
    adapted size (Adam), the same on every run."""
    cps, off = K.codepoints(pa.array([t for t, _ in rows], pa.string()))
    tokens = Tokens(cps, off)
    labels = np.zeros(len(tokens.s), np.int64)
    for r, (_, spans) in enumerate(rows):
        for s, e, kind in spans:
            labels[(tokens.row == r) & (tokens.s - off[r] < e) & (tokens.e - off[r] > s)] = 1 + KINDS.index(kind)
    known = []
    for value in tokens.features:
        v, n = np.unique(value, return_counts=True)
        known.append(v[n >= SEEN] if (n >= SEEN).any() else v[:1])
    k = len(KINDS) + 1
    weights = {(p, j): np.zeros((len(known[j]) + 1, k)) for p in REACH for j in range(3)}
    after = np.zeros((k, k))
    codes = Model(tuple(known), weights, after).codes(tokens)
    first = np.flatnonzero(np.concatenate(([True], tokens.seq[1:] != tokens.seq[:-1])))
    last = np.append(first[1:], len(tokens.s))
    where = {p: neighbours(tokens.line, p) for p in REACH}
    groups = {}  # by place and feature: tokens in order of the value they see there, where each value begins, and the values
    for p, j in weights:
        seen = codes[j][where[p][1]]
        order = np.argsort(seen, kind="stable")
        at = np.flatnonzero(np.concatenate(([True], seen[order][1:] != seen[order][:-1])))
        groups[p, j] = np.arange(len(tokens.s))[where[p][0]][order], at, seen[order][at]
    names = [*weights, "after"]
    value = weights | {"after": after}
    mean, square = {n: np.zeros_like(value[n]) for n in names}, {n: np.zeros_like(value[n]) for n in names}
    for i in range(1, rounds + 1):
        scores = np.zeros((len(tokens.s), k))
        for (p, j), w in weights.items():
            to, of = where[p]
            scores[to] += w[codes[j][of]]
        _, grad, step = _likelihood(scores, labels, first, last, after)
        slope = {"after": step}
        for w, (order, at, seen) in groups.items():
            slope[w] = np.zeros_like(weights[w])
            slope[w][seen] = np.add.reduceat(grad[order], at, axis=0)
        for n in names:
            g = slope[n] + penalty * value[n]
            mean[n] = 0.9 * mean[n] + 0.1 * g
            square[n] = 0.99 * square[n] + 0.01 * g * g
            value[n] -= rate * (mean[n] / (1 - 0.9**i)) / (np.sqrt(square[n] / (1 - 0.99**i)) + 1e-8)
    return Model(tuple(known), weights, after)


# The labelled table -----------------------------------------------------------------------------------------------------

#: Sentences with slots; what fills them is made by rule. Fixed values.
MARKED = [
    "call {phone} before noon", "you can reach us at {phone} or {phone} any day", "tel {phone}", "phone: {phone}", "tel.: {phone}", "fax {phone}", "mobile {phone} , ask for {person}", "ring {phone} after {word} {word}", "{word} {phone} {word} {word}",
    "write to {email} today", "mail: {email}", "e-mail {email} or call {phone}", "contact {email} for {word}", "{word} {word} {email} {word}", "send it to {email} , {word} {word}", "{email}",
    "token = \"{secret}\"", "{word} {word} token = \"{secret}\" {word} {word}", "password: {secret}", "secret = '{secret}'", "api_key = {secret}", "key: {secret} {word}", "the access token is {secret} {word}", "TOKEN = \"{secret}\"!! {word}",
    "card {card} expires {date}", "paid with {card} on {date}", "{word} {card} {word} {word}", "card number: {card}", "visa {card} , {word}",
    "host {ip} {word}", "from {ip} to {ip}", "server {ip} is {word}", "{word} {word} {ip} {word}", "ip: {ip}",
    "my name is {person}", "mr. {person} {word} {word}", "mrs. {person} lives {word}", "dear dr. {person} ,", "dr. {person} and mr. {person}", "signed {person}", "ms. {person} called", "mein name ist {person}", "herr {person} {word}", "frau {person} {word}", "je m'appelle {person}", "madame {person} {word}", "me llamo {person}", "señor {person} {word}",
]
PLAIN = [
    "{Word} {word} {word} {word} {word}.", "{word} {word}, {word} {word} {word}", "{Word} {Word} {word} {Word}.", "{WORD} {WORD}!! {WORD} {WORD}!!", "{word} | {word} | {Word} | {word} |", "{word}&&& {word}%%% {word}$$$ {word}", "{Word}: {word} {word}, {Word} {word}.",
    "on {date} {word} {word}", "{Word} {date} {Word}", "in {year} {word} {word} {year}", "{price} for {number} {word}", "{number} {word} and {number} {word}", "version {version} of {word}", "page {number} , section {section}", "chapter {number}", "at {time} {word}", "order #{number} {word}", "{percent} of {word}", "[{number}] {word} {word}",
    "{word} and {word} and {Word} and {word}", "and {word} and and {word}", "is {word} is {word} to {word} to {word}", "{word} {number} {word} {word} {word}", "{Word} {number}, {word} {Word} {year}.", "the token {word} {word}", "a key {word} is {word}", "my name {word} {word}", "the card {word} {word}", "call {word} {word}", "phone {word} {word}", "the password {word} {word}", "mail {word} {word}", "mr {word} {word}", "* {word} {word}", "- {word}", "# {Word} {word}", "{word}/{word} {word}-{word} ({word})", "\"{Word} {word}\" {word}", "{word} {word}; {word}: {word}? {Word} {word}!",
    "{word} {word} {word} {word} {word} {word} {word} {word} {word} {word}", "copyright {year} {word} {Word}", "licensed under the {word} license, version {version}", "isbn {number}-{number}-{number}", "{number}. {Word} {word}", "{number} / {number} = {number}", "room {number} , floor {number}",
]


@cache
def _common() -> list[str]:
    """The plain words of the sentences: in prose they stand without what follows them there."""
    return sorted({w for t in MARKED + PLAIN for w in t.split() if w.isalpha() and w.islower()})


LETTERS = "aaabcdeeeefghiiijklmnnoooprrssttuuvwyzéèüößñ"


def filled(template: str, rng: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """A template with its slots filled, and the spans of those of KINDS."""
    n = lambda k: "".join(rng.choice(DIGITS) for _ in range(k))
    word = lambda: "".join(rng.choice(LETTERS) for _ in range(rng.choice([2, 2, 3, 3, 4, 5, 6, 7, 8, 10, 13])))
    name = lambda: "".join(rng.choice(LETTERS) for _ in range(rng.randint(3, 9))).capitalize()

    common = _common()

    def prose() -> str:
        """Words with the marks, capitals and numbers of any text."""
        out, start = [], rng.random() < 0.6
        junk = rng.choice(["", "", "", "", "", "&&&", "%%%", "!!", "***", "###"])
        for _ in range(rng.randint(3, 14)):
            w = rng.choice(common) if rng.random() < 0.25 else name() if start or rng.random() < 0.08 else word()
            w = w.capitalize() if start else w
            w = w.upper() if rng.random() < 0.03 else n(rng.randint(1, 5)) if rng.random() < 0.04 else w
            end = rng.choice(["", "", "", "", "", "", ",", ".", ".", ":", "?"]) + junk * (rng.random() < 0.6)
            start = "." in end or "?" in end
            out.append(w + end + rng.choice(["", "", "", "", "", " |", "\n"] if start else [""]))
        return " ".join(out).replace("\n ", "\n")

    def value(slot: str) -> str:
        host = rng.choice([f"{word()}.com", f"mail{n(1)}.{word()}.org", f"{word()}-{word()}.net"])
        return rng.choice({
            "phone": lambda: [f"({n(3)}) {n(3)}-{n(4)}", f"{n(3)}-{n(3)}-{n(4)}", f"0{n(3)} {n(3)} {n(4)}", f"0{n(3)}-{n(7)}", f"+{n(2)} {n(3)} {n(7)}", f"+1 ({n(3)}) {n(3)}-{n(4)}", f"0{n(3)}/{n(6)}", f"{n(3)}.{n(3)}.{n(4)}", f"00{n(2)} {n(2)} {n(8)}"],
            "email": lambda: [f"{word()}@{host}", f"{word()}.{n(2)}@{host}", f"{word()}(at){host}", f"{word()}[at]{host}", f"{word()} [at] {host}", f"{word()}_{word()} (at) {host}"],
            "secret": lambda: ["".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([24, 32, 40, 64]))), "".join(rng.choice("0123456789ABCDEF") for _ in range(rng.choice([32, 40]))), "".join(rng.choice(WORDS) for _ in range(rng.choice([16, 20, 36]))), f"sk_{''.join(rng.choice(WORDS) for _ in range(24))}"],
            "card": lambda: [n(16), f"{n(4)} {n(4)} {n(4)} {n(4)}", f"{n(4)}-{n(4)}-{n(4)}-{n(4)}", f"{n(4)} {n(6)} {n(5)}", n(15)],
            "ip": lambda: [".".join(str(rng.randint(1, 255)) for _ in range(4)), ".".join(str(rng.randint(1, 255)) for _ in range(4)) + f":{n(4)}", ":".join("".join(rng.choice("0123456789abcdef") for _ in range(4)) for _ in range(8))],
            "person": lambda: [f"{name()} {name()}", name()],
            "date": lambda: [f"{n(4)}-0{n(1)}-1{n(1)}", f"{n(1)}/{n(2)}/{n(4)}", f"1{n(1)}.0{n(1)}.19{n(2)}", f"{n(2)}/{n(2)}"],
            "year": lambda: [f"19{n(2)}", f"20{n(2)}"], "number": lambda: [n(1), n(2), n(3), n(4), n(5), f"{n(1)},{n(3)}"], "price": lambda: [f"${n(2)}.{n(2)}", f"{n(3)}.{n(2)}", f"€{n(2)}"],
            "version": lambda: [f"{n(1)}.{n(1)}", f"{n(1)}.{n(2)}.{n(1)}", f"v{n(1)}.{n(1)}"], "section": lambda: [f"{n(1)}.{n(1)}", f"{n(1)}.{n(1)}.{n(1)}"], "time": lambda: [f"{n(2)}:{n(2)}", f"{n(1)} pm"], "percent": lambda: [f"{n(2)}%", f"{n(1)}.{n(1)} %"],
            "prose": lambda: [prose()], "word": lambda: [word()], "Word": lambda: [name()], "WORD": lambda: [word().upper()],
        }[slot]())

    out, spans = "", []
    for i, part in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2 == 0:
            out += part
            continue
        got = value(part)
        if part in KINDS:
            spans.append((len(out), len(out) + len(got), part))
        out += got
    return out, spans


def labelled(copies: int = 6, seed: int = 11) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """The small labelled table: every sentence ``copies`` times with other fillings, two in three of them set into prose."""
    rng = random.Random(seed)
    rows = []
    for template in (MARKED + PLAIN + ["{prose}"] * len(MARKED)) * copies:
        before, behind = rng.random() < 0.66, rng.random() < 0.66
        rows.append(filled("{prose} " * before + template + " {prose}" * behind, rng))
    return rows


# The operator -----------------------------------------------------------------------------------------------------------

LEADING, TRAILING = "\"'([<{=*#&|", "\"')]>}.,;:!?*#&%$|"


def field_spans(model: Model, cps: np.ndarray, off: np.ndarray) -> list[tuple[int, int, str]]:
    """(start, end, kind) of runs of equally labelled tokens, without the marks around them."""
    tokens = Tokens(cps, off)
    labels = decode(model, tokens)
    at = np.flatnonzero(labels)
    out = []
    if not len(at):
        return out
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (labels[at[1:]] != labels[at[:-1]]) | (tokens.seq[at[1:]] != tokens.seq[at[:-1]])
    first = np.flatnonzero(new)
    for a, b in zip(first, np.append(first[1:], len(at)), strict=True):
        s, e, kind = int(tokens.s[at[a]]), int(tokens.e[at[b - 1]]), KINDS[labels[at[a]] - 1]
        while s < e and chr(cps[s]) in (LEADING.replace("(", "") if kind == "phone" else LEADING):
            s += 1
        while s < e and chr(cps[e - 1]) in TRAILING:
            e -= 1
        if s < e:
            out.append((s, e, kind))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted((s, KINDS.index(k), e, k) for s, e, k in spans))


def measure(text: pa.Array, model: Model) -> dict:
    """Counts and spans of every row of a slice."""
    cps, off = K.codepoints(text)
    rows = len(off) - 1
    base = base_spans(cps, off)
    covered = np.zeros(len(cps) + 1, np.int64)
    for s, e, _ in base:
        covered[s] += 1
        covered[e] -= 1
    covered = _total(np.cumsum(covered)[:-1] > 0)
    added = [x for x in field_spans(model, cps, off) if covered[x[1]] == covered[x[0]]]
    by_row: list[tuple[list, list]] = [([], []) for _ in range(rows)]
    for j, spans in enumerate((base, added)):
        if spans:
            for (s, e, k), r in zip(spans, np.searchsorted(off, [x[0] for x in spans], "right") - 1, strict=True):
                by_row[r][j].append((s - int(off[r]), e - int(off[r]), k))
    out = {f"n_{k}": pa.array([sum(x[2] == k for x in b) for b, _ in by_row], pa.int64()) for k in BASE}
    return out | {
        "base_sha256": pa.array([sha256(joined(b).encode()).hexdigest() for b, _ in by_row], pa.string()),
        "spans": pa.array([joined(b + a) for b, a in by_row], pa.string()),
        "n_added": pa.array([len(a) for _, a in by_row], pa.int64()),
    }


def find(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, counts of base spans, their digest, all spans, and how many the field added. A narrow pass."""
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as large as the labelled table's features
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    counts = "".join(f"n_{k} long, " for k in BASE)
    return map_chunks(rows, lambda part: {"key": part.column("key")} | measure(part.column("text"), shared.value), f"key {kind}, {counts}base_sha256 string, spans string, n_added long").withColumnRenamed("key", key)


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), fit(labelled()))
