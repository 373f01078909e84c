"""Personal data: fixed rules, and a character-level bidirectional LSTM with CRF transitions.

Rules find e-mail addresses, IP addresses, payment cards and telephone numbers. The model adds spans of
the same kinds that the rules' forms miss (a telephone number without its plus sign, a card grouped by
dots, an address with letters beyond ASCII). It is trained in numpy on generated text whose spans are
labelled by construction, among look-alikes (keys, dates, prices, versions) that are labelled as none.

A text is read in windows of WINDOW characters, STRIDE on. A span that counts holds a mark: an ASCII digit, an
at sign or one written out, (at) or [at] (`_plausible` asks for it). Every window that holds a mark is run, so
also any that could decide a span that counts; the others are left. A test holds this against running all.
Every window is decoded by Viterbi; a span counts in the window whose middle part holds the span's middle,
so each is decided once whatever windows see it. Then all spans of a text are reconciled: rule spans stay,
model spans that touch one go, and of model spans that touch each other the longer stays.

Defined results: null text counts as empty (`redact` leaves it null); equal rows have equal results; offsets are
code points; an empty table gives an empty result; columns besides id and text, whatever their names, are
ignored by `scan` and kept by `redact`.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperloom.llm import textkernel as tk
from hyperloom.llm.shared import small_batches, table, text_column

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 128, 64
HIDDEN = 16
TAGS = 1 + 2 * len(KINDS)

# ---------------------------------------------------------------------------------------- rules

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str):
    """Matches of the address pattern, found from the at signs so that long words cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the rules' spans, by start, then kind."""
    found = [(s, 0, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


# -------------------------------------------------------------------------------------- symbols

_SIGNS = "@.+-()_:=/%#,;\"'"
#: Symbols: space, other, letters a to z, capital, digit, beyond ASCII, then the signs one by one.
SYMBOLS = 31 + len(_SIGNS)
_SYMBOL = np.ones(129, np.int64)
_SYMBOL[[32, 9, 10, 11, 12, 13]] = 0
_SYMBOL[97:123] = np.arange(2, 28)
_SYMBOL[65:91], _SYMBOL[48:58], _SYMBOL[128] = 28, 29, 30
for _i, _c in enumerate(_SIGNS):
    _SYMBOL[ord(_c)] = 31 + _i


def symbols(text: str) -> np.ndarray:
    return _SYMBOL[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 128)]


# ----------------------------------------------------------------------------- labelled samples


def labelled_windows(n: int, seed: int = 7, length: int = 96) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and tags of generated windows."""
    draw = np.random.default_rng(seed)
    pick = lambda xs: xs[int(draw.integers(len(xs)))]
    digits = lambda k: "".join(map(str, draw.integers(0, 10, k)))
    syllables = ("the on er st nd re ha in th ti ou en ea sh wh le es tion an ent qu ment con que vi ch ge eau "
                 "ung keit lich der ein é è ñ ü ß ó ci el la os mo da ri ba").split()  # fmt: skip

    def word():
        w = "".join(pick(syllables) for _ in range(int(draw.integers(1, 5))))
        return (w.capitalize() if draw.random() < 0.1 else w) + pick(["", "", "", "", ",", "."])

    def name():
        return "".join(pick("abcdefghijklmnoprstuvw") for _ in range(int(draw.integers(2, 9))))

    def email():
        local = pick([name() + "." + digits(2), name() + "_" + name(), name() + "." + name(), name(), name() + "é" + name(), name() + "+" + name()])
        host = pick(["mail" + digits(1) + ".example.com", name() + ".com", name() + ".example.org", name() + "." + name() + ".net"])
        return local + pick(["@", "@", "@", " @ ", " (at) ", "[at]"]) + host

    def ip():
        parts = [str(int(draw.integers(1, 256))) for _ in range(4)]
        return pick([".", ".", ".", " . "]).join(parts)

    def card():
        d = pick("3456") + digits(15)
        return pick([d, d, " ".join(d[i : i + 4] for i in range(0, 16, 4)), "-".join(d[i : i + 4] for i in range(0, 16, 4)), ".".join(d[i : i + 4] for i in range(0, 16, 4))])

    def phone():
        a, b, c = digits(3), digits(3), digits(4)
        return pick([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{digits(2)} {digits(2)} {digits(4)} {digits(4)}", f"+1{a}{b}{c}", f"00{digits(2)} {a} {b} {c}"])

    def other():
        hexes = "".join(pick("0123456789abcdef") for _ in range(int(draw.integers(8, 41))))
        return pick([hexes, "password=" + hexes, 'token = "' + hexes + '"', "AKIA" + "".join(pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)),
                     f"{1990 + int(draw.integers(40))}-{digits(2)}-{digits(2)}", digits(int(draw.integers(1, 8))), f"CC BY-NC {int(draw.integers(1, 5))}.0", "Apache License 2.0",
                     f"v{digits(1)}.{digits(1)}.{digits(2)}", f"{digits(3)},{digits(3)}.{digits(2)}", digits(2) + ":" + digits(2), "@" + name(), "#" + digits(4), digits(2) + "%",
                     "id_" + digits(6), digits(22), f"{digits(3)}-{digits(2)}", f"p. {digits(2)}-{digits(2)}", f"{digits(4)}/{digits(2)}", name() + "@", f"{digits(1)}.{digits(1)}", f"({digits(4)})"])

    makers = (email, ip, card, phone)
    x, y = np.zeros((n, length), np.int64), np.zeros((n, length), np.int64)
    for k in range(n):
        text, tags = "", []
        while len(text) < 2 * length:
            roll = draw.random()
            if roll < 0.10:
                kind = int(draw.integers(4))
                piece = makers[kind]()
                tags += [1 + 2 * kind] + [2 + 2 * kind] * (len(piece) - 1)
            else:
                piece = other() if roll < 0.17 else word()
                tags += [0] * len(piece)
            gap = pick([" ", " ", " ", " ", "\n", ", ", ". "])
            text += piece + gap
            tags += [0] * len(gap)
        at = int(draw.integers(len(text) - length))
        x[k], y[k] = symbols(text)[at : at + length], tags[at : at + length]
    return x, y


# ---------------------------------------------------------------------------------------- model


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Model:
    """Input tables and recurrent weights of both directions, tag weights, and transitions."""

    def __init__(self, seed: int = 3):
        draw = np.random.default_rng(seed)
        h = HIDDEN
        self.p = {}
        for d in "fb":
            self.p["x" + d] = draw.normal(0, 0.3, (SYMBOLS, 4 * h)).astype(np.float32)
            self.p["x" + d][:, h : 2 * h] += 1  # forget gates start open
            self.p["h" + d] = draw.normal(0, 1 / np.sqrt(h), (h, 4 * h)).astype(np.float32)
        self.p["o"] = draw.normal(0, 0.3, (2 * h, TAGS)).astype(np.float32)
        self.p["ob"] = np.zeros(TAGS, np.float32)
        self.p["t"] = np.zeros((TAGS, TAGS), np.float32)
        self.p["s"] = np.zeros(TAGS, np.float32)

    def _pass(self, x, d, saved=None):
        """Hidden states (time, batch, HIDDEN) of one direction; x is (time, batch)."""
        h, n = HIDDEN, x.shape[1]
        hs = np.zeros((len(x), n, h), np.float32)
        now, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        table, weight = self.p["x" + d], self.p["h" + d]
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            z = table[x[t]] + now @ weight
            gate = _sigmoid(z[:, : 3 * h])
            new = np.tanh(z[:, 3 * h :])
            before, last = cell, now
            cell = gate[:, h : 2 * h] * cell + gate[:, :h] * new
            out = np.tanh(cell)
            now = gate[:, 2 * h :] * out
            hs[t] = now
            if saved is not None:
                saved[t] = (gate, new, before, out, last)
        return hs

    def emissions(self, x):
        """Tag scores (time, batch, TAGS) for symbols (time, batch)."""
        both = np.concatenate([self._pass(x, "f"), self._pass(x, "b")], axis=2)
        return both @ self.p["o"] + self.p["ob"]

    def decode(self, windows: np.ndarray) -> np.ndarray:
        """Best tags of windows (batch, time), by Viterbi."""
        e = self.emissions(windows.T)
        score, back = e[0] + self.p["s"], np.zeros(e.shape, np.int8)
        for t in range(1, len(e)):
            every = score[:, :, None] + self.p["t"]
            back[t] = every.argmax(axis=1)
            score = every.max(axis=1) + e[t]
        out = np.zeros(windows.shape, np.int8)
        out[:, -1] = score.argmax(axis=1)
        rows = np.arange(len(windows))
        for t in range(len(e) - 1, 0, -1):
            out[:, t - 1] = back[t][rows, out[:, t]]
        return out

    def gradients(self, x, y):
        """Loss and gradients for symbols and tags (time, batch)."""
        p, (steps, n), h = self.p, x.shape, HIDDEN
        saved = {d: [None] * steps for d in "fb"}
        both = np.concatenate([self._pass(x, d, saved[d]) for d in "fb"], axis=2)
        e = both @ p["o"] + p["ob"]
        # CRF: scaled forward and backward sums give the marginals.
        move = np.exp(p["t"])
        alpha, beta, scale = np.zeros(e.shape), np.ones(e.shape), np.zeros((steps, n))
        shift = e.max(axis=2, keepdims=True)
        lift = np.exp(e - shift)
        for t in range(steps):
            a = np.exp(p["s"]) * lift[0] if t == 0 else (alpha[t - 1] @ move) * lift[t]
            scale[t] = a.sum(axis=1)
            alpha[t] = a / scale[t][:, None]
        for t in range(steps - 2, -1, -1):
            beta[t] = ((lift[t + 1] * beta[t + 1]) @ move.T) / scale[t + 1][:, None]
        marginal = alpha * beta
        log_all = (np.log(scale) + shift[:, :, 0]).sum()
        rows, cols = np.arange(steps)[:, None], np.arange(n)[None, :]
        gold = e[rows, cols, y].sum() + p["t"][y[:-1], y[1:]].sum() + p["s"][y[0]].sum()
        g = {k: np.zeros_like(v) for k, v in p.items()}
        de = marginal.copy()
        de[rows, cols, y] -= 1
        for t in range(1, steps):
            pair = alpha[t - 1].T @ ((lift[t] * beta[t]) / scale[t][:, None])
            g["t"] += pair * move
        np.add.at(g["t"], (y[:-1], y[1:]), -1)
        g["s"] = marginal[0].sum(axis=0) - np.bincount(y[0], minlength=TAGS)
        de = (de / n).astype(np.float32)
        g["t"], g["s"] = g["t"] / n, (g["s"] / n).astype(np.float32)
        g["o"], g["ob"] = np.tensordot(both, de, ([0, 1], [0, 1])), de.sum(axis=(0, 1))
        dh = de @ p["o"].T
        for k, d in enumerate("fb"):
            order = range(steps - 1, -1, -1) if d == "f" else range(steps)
            next_h, next_c = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            for t in order:
                gate, new, before, out, last = saved[d][t]
                i, f, o = gate[:, :h], gate[:, h : 2 * h], gate[:, 2 * h :]
                now = dh[t][:, k * h : (k + 1) * h] + next_h
                dc = next_c + now * o * (1 - out * out)
                dz = np.concatenate([dc * new * i * (1 - i), dc * before * f * (1 - f), now * out * o * (1 - o), dc * i * (1 - new * new)], axis=1)
                np.add.at(g["x" + d], x[t], dz)
                g["h" + d] += last.T @ dz
                next_h, next_c = dz @ p["h" + d].T, dc * f
        return (log_all - gold) / n, g


@functools.lru_cache(maxsize=4)
def train(windows: int = 2400, epochs: int = 7, batch: int = 48, rate: float = 1e-2, seed: int = 7) -> Model:
    """Trains the model on generated labelled windows; equal arguments give an equal model."""
    x, y = labelled_windows(windows, seed)
    model, draw = Model(), np.random.default_rng(seed)
    m, v, step, steps = {k: 0.0 for k in model.p}, {k: 0.0 for k in model.p}, 0, epochs * (windows // batch)
    for _ in range(epochs):
        order = draw.permutation(windows)
        for i in range(0, windows - batch + 1, batch):
            _, g = model.gradients(x[order[i : i + batch]].T, y[order[i : i + batch]].T)
            step += 1
            norm = np.sqrt(sum(float(np.square(a).sum()) for a in g.values()))
            for k, a in g.items():
                a = a * min(1.0, 5.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.99 * v[k] + 0.01 * a * a
                pace = rate * (1 - 0.9 * step / steps)
                model.p[k] = (model.p[k] - pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


# ------------------------------------------------------------------------------------- scanning

#: Digits that a span must hold, by kind; an e-mail address needs its at sign, be it written out.
_LEAST_DIGITS = (0, 4, 12, 7)
_MOST_DIGITS = (99, 12, 19, 15)
_AT = re.compile(r"[(\[]at[)\]]")
_MAIL = re.compile(r"[^\s,;:\"'<>()]+\s?(?:@|[(\[]at[)\]])\s?\w[\w-]*(?:\.\w[\w-]*)+")
_TRIM = " \t\n\r\x0b\x0c,;:\"'"


def _plausible(kind: int, piece: str) -> bool:
    n = len(_digits(piece))
    if not _LEAST_DIGITS[kind] <= n <= _MOST_DIGITS[kind]:
        return False
    if kind == 0:
        return bool(_MAIL.fullmatch(piece))
    if kind == 1:
        return bool(re.fullmatch(r"\d+(?:\s?\.\s?\d+){3}", piece))
    return not re.search(r"[^\W\d_]", piece) and (kind == 2 or bool(re.search(r"[\s().-]", piece)))


def model_spans(model: Model, texts: list[str], batch: int = 256, every: bool = False) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) of the model's spans in each text, before reconciliation; every: from windows without a mark as well."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    waiting: list[tuple[int, int, np.ndarray]] = []

    def flush():
        if not waiting:
            return
        tags = model.decode(np.stack([x for _, _, x in waiting]))
        for (k, lo, _), row in zip(waiting, tags, strict=True):
            at = 0
            for i in np.flatnonzero(row).tolist():
                if i < at:
                    continue
                kind, to = (int(row[i]) - 1) // 2, i + 1
                while to < WINDOW and row[to] == 2 + 2 * kind:
                    to += 1
                at = to
                # The window whose middle part holds the span's middle decides.
                middle = (2 * lo + i + to) // 2
                side = (WINDOW - STRIDE) // 2
                if (middle >= lo + side or lo == 0) and (middle < lo + side + STRIDE or lo + WINDOW >= len(texts[k])):
                    out[k].append((lo + i, kind, min(lo + to, len(texts[k]))))
        waiting.clear()

    for k, text in enumerate(texts):
        code = symbols(text)
        marks = np.append(np.flatnonzero((code == 29) | (code == 31)), [m.start() for m in _AT.finditer(text)]).astype(np.int64)
        last = max(0, -(-(len(code) - WINDOW) // STRIDE))
        for w in range(last + 1) if every else np.unique(np.clip(np.concatenate([marks // STRIDE, marks // STRIDE - 1]), 0, last)).tolist():
            x = np.zeros(WINDOW, np.int64)
            piece = code[w * STRIDE : w * STRIDE + WINDOW]
            x[: len(piece)] = piece
            waiting.append((k, w * STRIDE, x))
            if len(waiting) >= batch:
                flush()
    flush()
    return out


def reconcile(text: str, base: list[tuple[int, int, int]], added: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """All spans of a text by start, then kind: the base, and what the model adds beside it."""
    kept: list[tuple[int, int, int]] = []
    trimmed = []
    for start, kind, end in added:
        while start < end and text[start] in _TRIM:
            start += 1
        while start < end and text[end - 1] in _TRIM + ".":
            end -= 1
        if kind == 0 and (m := _MAIL.search(text, start, end)):  # no words around the address
            start, end = m.span()
        if start < end and _plausible(kind, text[start:end]):
            trimmed.append((start, kind, end))
    taken = bytearray(len(text))  # by place, so that the work is that of the spans' lengths
    for start, _, end in base:
        taken[start:end] = b"\1" * (end - start)
    for start, kind, end in sorted(set(trimmed), key=lambda x: (x[0] - x[2], x)):
        if taken.find(1, start, end) < 0:
            kept.append((start, kind, end))
            taken[start:end] = b"\1" * (end - start)
    return sorted([*base, *kept])


def all_spans(model: Model, column: pa.Array) -> tuple[list[str], list[list], list[list]]:
    """Texts of a batch, their base spans and all their spans."""
    data, offsets = tk.arrow_bytes(column)
    mark = ((data >= 48) & (data <= 57)) | (data == 64)
    if len(data) > 3:  # (at) and [at]
        a, d = data[:-3], data[3:]
        mark[:-3] |= ((a == 40) | (a == 91)) & (data[1:-2] == 97) & (data[2:-1] == 116) & ((d == 41) | (d == 93))
    marked = np.add.accumulate(np.append(0, mark.astype(np.int64)))
    some = marked[offsets[1:]] > marked[offsets[:-1]]
    texts = [x or "" for x in column.to_pylist()]
    base = [base_spans(x) if k else [] for x, k in zip(texts, some.tolist(), strict=True)]
    at = np.flatnonzero(some).tolist()
    every = list(base)
    for k, added in zip(at, model_spans(model, [texts[k] for k in at]), strict=True):
        if added:
            every[k] = reconcile(texts[k], base[k], added)
    return texts, base, every


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def scan(docs: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, counts of base spans by kind, their digest, and all spans."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            _, base, every = all_spans(shared.value, batch.column(1))
            counts = [pa.array([sum(x[1] == k for x in spans) for spans in base], pa.int64()) for k in range(len(KINDS))]
            digests = [hashlib.sha256(_joined(x).encode()).hexdigest() for x in base]
            yield pa.record_batch([batch.column(0), *counts, pa.array(digests), pa.array([_joined(x) for x in every])], [c.split()[0] for c in OUT.split(", ")])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), text_column(text).alias("text")).mapInArrow(run, OUT)


def redacted(text: str, spans) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one, named by the first."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The same rows and columns with personal data in the text replaced; null texts stay null."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            column = batch.column(place)
            texts, _, every = all_spans(shared.value, column)
            new = [None if null else redacted(x, s) if s else x for x, s, null in zip(texts, every, column.is_null().to_pylist(), strict=True)]
            yield batch.set_column(place, batch.schema.field(place), pa.array(new, column.type))

    return docs.mapInArrow(run, docs.schema)


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return scan(table(spark, sf_dir, "documents", ["doc_id", "text"]), train())


QUERIES = {"op7_personal_data": op7_personal_data}
ORACLE: dict[str, str] = {}
