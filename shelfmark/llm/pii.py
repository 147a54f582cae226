"""Personal data in texts: exact patterns, and a character-level bidirectional LSTM with CRF transitions.

The patterns give the base spans, which always stay. The tagger is trained in numpy from labelled spans (those of
the patterns in a bounded sample of texts, and made-up examples of looser forms), reads overlapping windows of
WINDOW characters and adds spans the patterns miss. Every kind holds a digit or an at sign, plain or spelt, so
windows without one are known to hold nothing and are not decoded. A window's spans count unless they touch its
margin, where another window sees more. What no window shows whole is decoded again in sections twice as wide, up to
WIDEST, in which a span of 320 characters (the most that an address can have) stands clear wherever it was met. The
windows of a text are then reconciled over the whole text:
spans found twice are one, and of spans that overlap each other the surer and then the earlier stays. Spans that
overlap a base span are dropped.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE, MARGIN = 128, 64, 16
WIDEST = 1024
SURE = 0.9
TOGETHER = 1_000  # texts that a task holds as Python objects at once
SAMPLE_TEXTS, SAMPLE_WINDOWS, MADE = 2_000, 3_000, 1_500
EMBED, HIDDEN, EPOCHS, BATCH = 12, 16, 5, 64
TAGS = 1 + 2 * len(KINDS)

# The base patterns.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits is taken whole, so a match can only begin where a run does.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]|(?<![A-Za-z])[Aa][Tt](?![A-Za-z])")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The local part reaches back over its characters to the end of the match before."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns' matches, by start and then kind as listed."""
    found = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") or "0" for p in m.group().split(".")]
            if all(len(p) <= 3 and int(p) <= 255 for p in parts):
                found.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() <= 37:
                d = _digits(m.group())
                if 14 <= len(d) <= 19 and luhn(d):
                    found.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_digits(m.group())) <= 15:
                    found.append(("phone", *m.span()))
    return ordered(found)


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _codes(text: str) -> np.ndarray:
    """Characters as numbers below 132: ASCII as it is, other letters and other marks in two more."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.where(x < 128, x, np.where(x < 0x2000, 128, 129))


CODES, PAD = 132, 131


def windows(text: str) -> list[int]:
    """Starts of the windows that hold a trigger. Windows begin at the multiples of STRIDE."""
    found = set()
    for m in _TRIGGER.finditer(text):
        last = m.start() // STRIDE
        found.update(range(max(0, last - WINDOW // STRIDE + 1), last + 1))
    return [i * STRIDE for i in sorted(found)]


def _cut_out(codes: np.ndarray, start: int, size: int = WINDOW) -> np.ndarray:
    part = codes[start:start + size]
    return np.pad(part, (0, size - len(part)), constant_values=PAD)


def _tags(spans: list[tuple[str, int, int]], start: int) -> np.ndarray:
    out = np.zeros(WINDOW, np.int64)
    for kind, a, b in spans:
        k, lo, hi = 1 + 2 * KINDS.index(kind), max(a - start, 0), min(b - start, WINDOW)
        if lo < hi and not out[lo:hi].any():
            out[lo:hi] = k + 1
            if a >= start:
                out[lo] = k
    return out


def made_up(n: int, seed: int = 5) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Texts with labelled spans of the base forms and looser ones, and texts with other numbers."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[rng.integers(len(xs))]
    number = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    syllables = "an ber co de el fa gi ha in ka lo me na or pa qui re sa ti un ve wo".split()
    word = lambda: "".join(pick(syllables) for _ in range(rng.integers(1, 4)))

    def card() -> str:
        body = pick("345") + number(14)
        body += next(str(d) for d in range(10) if luhn(body + str(d)))
        return pick(["", " ", "-", "."]).join(body[i:i + 4] for i in range(0, 16, 4))

    def email() -> str:
        name = word() + pick(["", "." + word(), "_" + number(2), number(2)])
        return name + pick(["@", "@", "@", " (at) ", "[at]", " @ "]) + word() + number(rng.integers(0, 2)) + pick([".com", ".example.org", ".de"])

    def phone() -> str:
        return pick(["+1 ({}) {}-{}", "({}) {}-{}", "+44 {} {} {}", "1-{}-{}-{}", "+49.{}.{}.{}"]).format(number(3), number(3), number(4))

    kinds = {"email": email, "ip": lambda: ".".join(str(rng.integers(0, 256)) for _ in range(4)), "card": card, "phone": phone}
    other = [lambda: "version " + number(1) + "." + number(1), lambda: "".join(pick("0123456789abcdef") for _ in range(rng.integers(18, 41))),
             lambda: "AKIA" + "".join(pick("ABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(16)), lambda: number(rng.integers(1, 9)),
             lambda: f"{number(4)}-{number(2)}-{number(2)}", lambda: number(rng.integers(1, 4)) + "." + number(2), lambda: "@" + word(), lambda: number(2) + ":" + number(2)]
    out = []
    for _ in range(n):
        text, spans = " ".join(word() for _ in range(rng.integers(1, 8))) + " ", []
        for _ in range(rng.integers(1, 3)):
            kind = pick([*KINDS, *KINDS, "none", "none", "none"])
            own = kinds[kind]() if kind in kinds else pick(other)()
            if kind in kinds:
                spans.append((kind, len(text), len(text) + len(own)))
            text += own + pick([" ", ", ", ". ", "\n"]) + " ".join(word() for _ in range(rng.integers(1, 8))) + " "
        out.append((text, spans))
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _lstm(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray):
    """Hidden states (T, B, H) of inputs (T, B, D), with what the way back needs."""
    steps, rows = x.shape[:2]
    zx, size = x @ w + b, u.shape[0]
    h, c = np.zeros((rows, size), x.dtype), np.zeros((rows, size), x.dtype)
    hs, kept = np.empty((steps, rows, size), x.dtype), []
    for t in range(steps):
        z = zx[t] + h @ u
        gates, g = _sigmoid(z[:, :3 * size]), np.tanh(z[:, 3 * size:])
        i, f, o = gates[:, :size], gates[:, size:2 * size], gates[:, 2 * size:]
        before = c
        c = f * c + i * g
        top = np.tanh(c)
        kept.append((h, before, gates, g, top))
        h = o * top
        hs[t] = h
    return hs, kept


def _states(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hidden states of _lstm, bit for bit, where nothing goes back: a step's own arrays are all that is held."""
    steps, rows = x.shape[:2]
    size = u.shape[0]
    h, c = np.zeros((rows, size), x.dtype), np.zeros((rows, size), x.dtype)
    hs = np.empty((steps, rows, size), x.dtype)
    for t in range(steps):
        z = x[t] @ w + b + h @ u
        gates, g = _sigmoid(z[:, :3 * size]), np.tanh(z[:, 3 * size:])
        i, f, o = gates[:, :size], gates[:, size:2 * size], gates[:, 2 * size:]
        c = f * c + i * g
        h = o * np.tanh(c)
        hs[t] = h
    return hs


def _lstm_back(x, w, u, kept, dh_out):
    steps, rows, size = dh_out.shape
    dz = np.empty((steps, rows, 4 * size), x.dtype)
    dh, dc, du = np.zeros((rows, size), x.dtype), np.zeros((rows, size), x.dtype), np.zeros_like(u)
    for t in range(steps - 1, -1, -1):
        h, before, gates, g, top = kept[t]
        i, f, o = gates[:, :size], gates[:, size:2 * size], gates[:, 2 * size:]
        d = dh_out[t] + dh
        dc = dc + d * o * (1 - top * top)
        own = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), d * top * o * (1 - o), dc * i * (1 - g * g)], 1)
        dz[t] = own
        du += h.T @ own
        dh, dc = own @ u.T, dc * f
    flat = dz.reshape(-1, 4 * size)
    return dz @ w.T, x.reshape(-1, x.shape[2]).T @ flat, du, flat.sum(0)


def _emissions(m: dict, codes: np.ndarray, keep: bool = False):
    x = m["embed"][codes.T]
    if not keep:
        both = np.concatenate([_states(x, m["wf"], m["uf"], m["bf"]), _states(x[::-1], m["wb"], m["ub"], m["bb"])[::-1]], 2)
        return both @ m["v"] + m["c"]
    fore, kept_f = _lstm(x, m["wf"], m["uf"], m["bf"])
    back, kept_b = _lstm(x[::-1], m["wb"], m["ub"], m["bb"])
    both = np.concatenate([fore, back[::-1]], 2)
    return both @ m["v"] + m["c"], x, both, kept_f, kept_b


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def _marginals(e: np.ndarray, trans: np.ndarray):
    """CRF forward and backward over emissions (T, B, K): log Z, tag marginals, expected transitions."""
    steps, rows, k = e.shape
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0]
    for t in range(1, steps):
        alpha[t] = e[t] + _logsum(alpha[t - 1][:, :, None] + trans, 1)
    for t in range(steps - 2, -1, -1):
        beta[t] = _logsum(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
    z = _logsum(alpha[-1], 1)
    marginal = np.exp(alpha + beta - z[:, None])
    expected = np.zeros((k, k))
    for t in range(1, steps):
        expected += np.exp(alpha[t - 1][:, :, None] + trans + (e[t] + beta[t])[:, None, :] - z[:, None, None]).sum(0)
    return z, marginal, expected


def fit(codes: np.ndarray, tags: np.ndarray, seed: int = 3, epochs: int = EPOCHS) -> dict:
    """The tagger's weights, by Adam on the CRF likelihood of the windows' tags."""
    rng = np.random.default_rng(seed)
    draw = lambda a, b: (rng.normal(0, 1 / np.sqrt(a), (a, b))).astype(np.float32)
    m = {"embed": draw(CODES, EMBED) * 3, "v": draw(2 * HIDDEN, TAGS), "c": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32)}
    for d in "fb":
        bias = np.zeros(4 * HIDDEN, np.float32)
        bias[HIDDEN:2 * HIDDEN] = 1
        m |= {"w" + d: draw(EMBED, 4 * HIDDEN), "u" + d: draw(HIDDEN, 4 * HIDDEN), "b" + d: bias}
    first, second = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2))
    step, rounds = 0, max(1, len(codes) // BATCH)
    for epoch in range(epochs):
        order = rng.permutation(len(codes))
        for lo in range(rounds):
            at = order[lo * BATCH:(lo + 1) * BATCH]
            own, gold = codes[at], tags[at].T
            e, x, both, kept_f, kept_b = _emissions(m, own, keep=True)
            _, marginal, expected = _marginals(e.astype(np.float64), m["trans"].astype(np.float64))
            slope = marginal
            np.put_along_axis(slope, gold[:, :, None], np.take_along_axis(slope, gold[:, :, None], 2) - 1, 2)
            slope = (slope / len(at)).astype(np.float32)
            seen = np.bincount((gold[:-1] * TAGS + gold[1:]).ravel(), minlength=TAGS * TAGS).reshape(TAGS, TAGS)
            grads = {"v": both.reshape(-1, 2 * HIDDEN).T @ slope.reshape(-1, TAGS), "c": slope.sum((0, 1)), "trans": ((expected - seen) / len(at)).astype(np.float32)}
            d = slope @ m["v"].T
            dx, grads["wf"], grads["uf"], grads["bf"] = _lstm_back(x, m["wf"], m["uf"], kept_f, d[:, :, :HIDDEN])
            dxb, grads["wb"], grads["ub"], grads["bb"] = _lstm_back(x[::-1], m["wb"], m["ub"], kept_b, d[::-1, :, HIDDEN:])
            grads["embed"] = np.zeros_like(m["embed"])
            np.add.at(grads["embed"], own.T, dx + dxb[::-1])
            step, rate = step + 1, 0.015 * (1 - epoch / epochs) + 1e-3
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for k, g in grads.items():
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                m[k] = m[k] - (rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return m


def decode(m: dict, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Viterbi tags (B, T) of windows and, per character, how sure the emissions are of its tag."""
    e = _emissions(m, codes)
    steps, rows, _ = e.shape
    score, back = e[0], np.empty(e.shape, np.int8)
    for t in range(1, steps):
        way = score[:, :, None] + m["trans"]
        back[t] = way.argmax(1)
        score = np.take_along_axis(way, back[t][:, None, :].astype(np.int64), 1)[:, 0] + e[t]
    tags = np.empty((steps, rows), np.int64)
    tags[-1] = score.argmax(1)
    for t in range(steps - 1, 0, -1):
        tags[t - 1] = np.take_along_axis(back[t], tags[t][:, None], 1)[:, 0]
    p = np.exp(e - e.max(2, keepdims=True))
    p /= p.sum(2, keepdims=True)
    return tags.T, np.take_along_axis(p, tags[:, :, None], 2)[:, :, 0].T


def _plausible(kind: str, text: str) -> bool:
    """What an added span must hold, whatever the tagger says."""
    d = len(_digits(text))
    if kind == "email":
        return ("@" in text or "at" in text.lower()) and "." in text and len(text) >= 6
    return {"ip": 4 <= d <= 12 and text.count(".") == 3, "card": 14 <= d <= 19 and luhn(_digits(text)), "phone": 10 <= d <= 15}[kind] and (
        kind == "ip" or not re.search(r"[A-Za-z]", text))


def _window_spans(tags: np.ndarray, sure: np.ndarray, start: int, length: int) -> tuple[list[tuple[float, str, int, int]], list[tuple[int, int]]]:
    """A window's spans, and where those are that touch its margin."""
    out, touching, i, size = [], [], 0, len(tags)
    while i < size:
        k = tags[i]
        if not k:
            i += 1
            continue
        kind, j = (k - 1) // 2, i + 1
        while j < size and tags[j] == 2 * kind + 2:
            j += 1
        a, b = start + i, start + j
        if (i >= MARGIN or start == 0) and (j <= size - MARGIN or start + size >= length):
            if b <= length:
                out.append((float(sure[i:j].mean()), KINDS[kind], a, b))
        else:
            touching.append((a, min(b, length)))
        i = j
    return out, touching


def reconcile(text: str, base: list[tuple[str, int, int]], found: list[tuple[float, str, int, int]]) -> list[tuple[str, int, int]]:
    """The base spans and those of the windows that stand, in order."""
    taken = [(a, b) for _, a, b in base]
    added = []
    for sure, kind, a, b in sorted(set(found), key=lambda s: (-s[0], s[2], s[1])):
        if sure >= SURE and _plausible(kind, text[a:b]) and not any(a < y and x < b for x, y in taken):
            taken.append((a, b))
            added.append((kind, a, b))
    return ordered(base + added)


def _sections(parts: list[tuple[int, int]], known: list[tuple[int, int]], size: int) -> list[int]:
    """Starts of sections with the parts of spans in their middle, but for those within a known span. Starts are
    multiples of an eighth of the size, so sections are no more than eight times the text."""
    known, starts, furthest, at = sorted(known), set(), -1, 0
    for a, b in sorted(parts):
        while at < len(known) and known[at][0] <= a:
            furthest, at = max(furthest, known[at][1]), at + 1
        if b > furthest:
            starts.add(max(0, ((a + b) // 2 - size // 2) // (size // 8) * (size // 8)))
    return sorted(starts)


def find(texts: list[str | None], model: dict) -> list[tuple[list, list]]:
    """Per text its base spans and all its spans."""
    texts = [t or "" for t in texts]
    out = [[base_spans(t), None] for t in texts]
    found: list[list] = [[] for _ in texts]
    touching: list[list] = [[] for _ in texts]
    queue: list[tuple[int, int]] = []
    held: list[np.ndarray] = []

    def flush() -> None:
        if queue:
            tags, sure = decode(model, np.stack(held))
            for k in np.flatnonzero(tags.any(1)):
                i, start = queue[k]
                whole, cut_off = _window_spans(tags[k], sure[k], start, len(texts[i]))
                found[i] += whole
                touching[i] += cut_off
            queue.clear()
            held.clear()

    def read(wanted: Iterator[tuple[int, list[int]]], size: int) -> None:
        for i, starts in wanted:
            codes = _codes(texts[i]) if starts else None
            for start in starts:
                queue.append((i, start))
                held.append(_cut_out(codes, start, size))
                if len(queue) * size >= 512 * WINDOW:
                    flush()
        flush()

    read(((i, windows(text)) for i, text in enumerate(texts)), WINDOW)
    size = WINDOW
    while size < WIDEST and any(touching):
        size *= 2
        wider = []
        for i, parts in enumerate(touching):
            if parts:
                wider.append((i, _sections(parts, [*((a, b) for _, a, b in out[i][0]), *((a, b) for _, _, a, b in found[i])], size)))
                touching[i] = []
        read(iter(wider), size)
    for i, text in enumerate(texts):
        out[i][1] = reconcile(text, out[i][0], found[i]) if found[i] else out[i][0]
    return [tuple(x) for x in out]


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for drawn, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            codes, spans = _codes(text), base_spans(text)
            for start in windows(text)[:8]:
                rows.append((drawn, start, _cut_out(codes, start).astype(np.uint8).tobytes(), _tags(spans, start).astype(np.uint8).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(
            (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["drawn", "start", "codes", "tags"])


def learn(docs: DataFrame, text_col: str = "text") -> dict:
    """The tagger from labelled spans of at most SAMPLE_TEXTS texts (8 windows each) with digits or at signs, drawn by
    hash, and MADE made-up ones. Only this fit is bounded; detection reads every whole text."""
    text = F.col(text_col).cast("string")
    some = docs.select(text.alias("text")).where(F.col("text").rlike("[0-9@]")).select(
        F.xxhash64("text").alias("drawn"), "text")
    n = docs.count()
    share = min(1.0, 16.0 * SAMPLE_TEXTS / max(n, 1))
    some = some.where(F.pmod("drawn", F.lit(1 << 30)) <= int(share * (1 << 30))).dropDuplicates(["drawn"])
    rows = some.mapInArrow(_examples, "drawn long, start long, codes binary, tags binary").orderBy(
        "drawn", "start").limit(SAMPLE_WINDOWS).toArrow()
    codes = [np.frombuffer(x, np.uint8).astype(np.int64) for x in rows["codes"].to_pylist()]
    tags = [np.frombuffer(x, np.uint8).astype(np.int64) for x in rows["tags"].to_pylist()]
    for text_, spans in made_up(MADE):
        start = 0 if len(text_) <= WINDOW else STRIDE * ((len(text_) - WINDOW) // STRIDE + 1) // 2 // STRIDE * STRIDE
        codes.append(_cut_out(_codes(text_), start))
        tags.append(_tags(spans, start))
    return fit(np.stack(codes), np.stack(tags), epochs=EPOCHS)


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most TOGETHER."""
    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            yield batch.slice(at, TOGETHER)


_DETECTED = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def detect(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) per row of docs, in code points, ends exclusive.

    Counts and spans cover base and added spans; base_sha256 the base spans alone. Null and empty texts have none.
    Repeated rows give repeated results; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            found = find(batch.column(1).to_pylist(), shared.value)
            counts = [pa.array([sum(s[0] == k for s in spans) for _, spans in found], pa.int64()) for k in KINDS]
            prints = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(prints, pa.string()), pa.array([joined(s) for _, s in found], pa.string())],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, _DETECTED)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans go under the first."""
    out, done = [], 0
    for kind, a, b in spans:
        if a >= done:
            out += [text[done:a], f"<{kind.upper()}>"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def mask(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """docs with the spans of its texts masked; other columns, rows and null texts stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            texts = batch.column(at).to_pylist()
            new = [t if t is None else masked(t, s) for t, (_, s) in zip(texts, find(texts, shared.value))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(new, pa.string()) if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
