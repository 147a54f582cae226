"""Language of a text by a bidirectional gated recurrent network over its bytes.

Two gated recurrent chains read the UTF-8 bytes, one from either end; at every position their states give the
probabilities of the languages. A document's probabilities are the means over its letters. Gates and states squash by
x / (1 + |x|), which costs a third of tanh and is trained as it is. The network is trained in
numpy by backpropagation through time, on windows of a bounded sample of labelled texts. Whole texts are read when
predicting: long ones in windows of SPAN bytes that overlap by MARGIN on either side, of which each position is taken
from the window that shows most round it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_TEXTS, TEXT_WINDOWS = 6_000, 4
MOST_LANGUAGES = 256  # that are learnt: the most frequent
HIDDEN = 10
LENGTH, BATCH, STEPS, RATE = 64, 128, 500, 0.02
SPAN, MARGIN = 256, 12
GROUP = 768  # windows read at a time
UNKNOWN = "und"
_PAD = 256
_LETTER = re.compile(r"[^\W\d_]")
_IS_LETTER = np.zeros(_PAD + 1, bool)
_IS_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _encoded(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


# Shapes below: time first, then the two directions, then windows, then units. The second direction reads reversed.

def _both_ways(codes: np.ndarray) -> np.ndarray:
    """codes: windows x time, padded at the end. Padding leaves a state as it is, so a reversed window may begin with it."""
    return np.stack([codes, codes[:, ::-1]]).transpose(2, 0, 1)


def _squash(x: np.ndarray, room: np.ndarray | None = None) -> np.ndarray:
    """x / (1 + |x|), in place; its slope is (1 - |result|) ** 2."""
    room = np.abs(x, out=room)
    room += 1
    x /= room
    return x


def _states(m: dict, codes: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States at every position: time x 2 x windows x HIDDEN, the second direction from the end. With y the squashed
    input of a gate, the gate is (1 + y) / 2. keep gathers what the way back needs."""
    steps = _both_ways(codes) + np.array([[0], [_PAD + 1]])
    table, gated = m["table"].reshape(-1, 3 * HIDDEN), 2 * HIDDEN
    time, _, windows = steps.shape
    h = np.zeros((2, windows, HIDDEN), table.dtype)
    out = np.empty((time, *h.shape), table.dtype)
    inp, rec = (np.empty((2, windows, 3 * HIDDEN), table.dtype) for _ in range(2))
    gate, new, room, room2 = np.empty_like(inp[..., :gated]), h.copy(), np.empty_like(inp[..., :gated]), h.copy()
    for t in range(time):
        np.take(table, steps[t], axis=0, out=inp, mode="clip")
        np.matmul(h, m["recur"], out=rec)
        np.add(inp[..., :gated], rec[..., :gated], out=gate)
        _squash(gate, room)
        np.multiply(gate[..., HIDDEN:], rec[..., gated:], out=new)
        new += rec[..., gated:]
        new *= 0.5
        new += inp[..., gated:]
        _squash(new, room2)
        if keep is not None:
            keep.append((h, gate.copy(), new.copy(), rec[..., gated:].copy()))
        mixed = out[t]  # ((h + new) + y (h - new)) / 2
        np.subtract(h, new, out=mixed)
        mixed *= gate[..., :HIDDEN]
        mixed += h
        mixed += new
        mixed *= 0.5
        h = mixed
    return out


def _probabilities(m: dict, states: np.ndarray) -> np.ndarray:
    """Languages first: languages x time x windows."""
    logits = states[:, 0] @ m["out"][:HIDDEN] + states[::-1, 1] @ m["out"][HIDDEN:]
    logits += m["bias"]
    logits = np.ascontiguousarray(logits.transpose(2, 0, 1))
    logits -= logits.max(0)
    np.exp(logits, out=logits)
    logits /= logits.sum(0)
    return logits


def gradients(m: dict, codes: np.ndarray, target: np.ndarray) -> tuple[float, dict]:
    """Mean loss over the letters of windows (windows x time, targets by window), and its gradients through time."""
    keep: list = []
    states = _states(m, codes, keep)
    p = _probabilities(m, states).transpose(1, 2, 0)
    letter = _IS_LETTER[codes].T
    n = max(int(letter.sum()), 1)
    windows = np.arange(len(target))
    loss = float(-(np.log(np.maximum(p[:, windows, target], 1e-9)) * letter).sum() / n)
    p[:, windows, target] -= 1
    p *= (letter / n)[..., None].astype(p.dtype)
    joined = np.concatenate([states[:, 0], states[::-1, 1]], axis=2).reshape(-1, 2 * HIDDEN)
    flat = p.reshape(-1, p.shape[-1])
    grads = {"out": joined.T @ flat, "bias": flat.sum(0)}
    back = p @ m["out"].T
    back = np.stack([back[..., :HIDDEN], back[::-1, :, HIDDEN:]], axis=1)
    turned = m["recur"].transpose(0, 2, 1)
    carry = np.zeros_like(back[0])
    d_recur = np.zeros_like(m["recur"])
    d_in = np.empty((*back.shape[:3], 3 * HIDDEN), back.dtype)
    for t in reversed(range(len(back))):
        h, gate, new, rec = keep[t]
        slope = (1 - np.abs(gate)) ** 2
        z, r = (1 + gate[..., :HIDDEN]) / 2, (1 + gate[..., HIDDEN:]) / 2
        dh = back[t] + carry
        d_new = dh * (1 - z) * (1 - np.abs(new)) ** 2
        d_z, d_r = dh * (h - new) / 2 * slope[..., :HIDDEN], d_new * rec / 2 * slope[..., HIDDEN:]
        d_in[t] = np.concatenate([d_z, d_r, d_new], -1)
        d_rec = np.concatenate([d_z, d_r, d_new * r], -1)
        d_recur += h.transpose(0, 2, 1) @ d_rec
        carry = dh * z + d_rec @ turned
    grads["recur"], grads["table"] = d_recur, np.zeros_like(m["table"])
    steps = _both_ways(codes)
    for way in (0, 1):
        which = steps[:, way].ravel()
        order = np.argsort(which, kind="stable")
        found, starts = np.unique(which[order], return_index=True)
        grads["table"][way, found] = np.add.reduceat(d_in[:, way].reshape(-1, 3 * HIDDEN)[order], starts)
    grads["table"][:, _PAD] = 0
    return loss, grads


def blank(languages: int, seed: int = 7) -> dict:
    rng = np.random.default_rng(seed)
    normal = lambda *shape: (rng.standard_normal(shape) * 0.2).astype(np.float32)
    m = {"table": normal(2, _PAD + 1, 3 * HIDDEN), "recur": normal(2, HIDDEN, 3 * HIDDEN),
         "out": normal(2 * HIDDEN, languages), "bias": np.zeros(languages, np.float32)}
    m["table"][:, _PAD] = 0
    m["table"][:, _PAD, :HIDDEN] = 1e4  # the gate that keeps the state as it is
    return m


def fit(windows: np.ndarray, target: np.ndarray, languages: int, seed: int = 7) -> dict:
    """windows: padded codes; target: a number below `languages` for each. Adam, the rate falling to nothing."""
    m = blank(languages, seed)
    rng = np.random.default_rng(seed)
    first, second = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2))
    for step in range(1, STEPS + 1 if len(windows) else 1):
        at = rng.integers(0, len(windows), BATCH)
        _, grads = gradients(m, windows[at], target[at])
        norm = float(np.sqrt(sum((g * g).sum() for g in grads.values())))
        rate = RATE * 0.5 * (1 + np.cos(np.pi * step / STEPS))
        for k, g in grads.items():
            g = g * np.float32(min(1.0, 1.0 / max(norm, 1e-9)))
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            m[k] -= (rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return m


def _cut_windows(code: np.ndarray, drawn: int) -> list[bytes]:
    """The first LENGTH bytes of a text and TEXT_WINDOWS - 1 stretches from anywhere in it."""
    rng = np.random.default_rng(drawn & 0xFFFFFFFF)
    room = len(code) - LENGTH
    starts = [0] if room <= 0 else sorted({0, *map(int, rng.integers(0, room + 1, TEXT_WINDOWS - 1))})
    return [code[s:s + LENGTH].tobytes() for s in starts]


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        drawn, lang, out = [], [], []
        for d, x, text in zip(*(c.to_pylist() for c in batch.columns)):
            if _LETTER.search(text):
                cut = _cut_windows(_encoded(text), d)
                drawn += [d] * len(cut)
                lang += [x] * len(cut)
                out += cut
        yield pa.RecordBatch.from_arrays([pa.array(drawn, pa.int64()), pa.array(lang, pa.string()), pa.array(out, pa.binary())],
                                         ["drawn", "lang", "bytes"])


def learn(docs: DataFrame, trusted: Column, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id") -> dict:
    """A model of the languages of `lang_col`, from rows where it is not null and `trusted` is true. It is fitted on
    about SAMPLE_TEXTS texts, an even number for each language as far as it has them, those of the least hashes of
    key_col and length. Without rows to learn from it knows no language."""
    known = docs.where(trusted & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    known = known.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"),
                         F.xxhash64(F.col(key_col), F.length(text_col)).alias("drawn"))
    sizes = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()
    if not sizes:
        return {"languages": []}
    each = SAMPLE_TEXTS // len(sizes)
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, 1.1 * each / r["count"]))])
    part = F.pmod("drawn", F.lit(1 << 20)) / F.lit(1 << 20)
    chosen = known.where(part < F.coalesce(share[F.col("lang")], F.lit(0.0))).select("drawn", "lang", "text")
    rows = chosen.mapInArrow(_sampled, "drawn long, lang string, bytes binary")
    rows = rows.orderBy("drawn", "lang", "bytes").limit(2 * SAMPLE_TEXTS * TEXT_WINDOWS).toArrow().to_pydict()
    languages = sorted(set(rows["lang"]))
    windows = np.full((len(rows["bytes"]), LENGTH), _PAD, np.int64)
    for i, data in enumerate(rows["bytes"]):
        windows[i, :len(data)] = np.frombuffer(data, np.uint8)
    target = np.array([languages.index(x) for x in rows["lang"]], np.int64)
    return {**fit(windows, target, max(len(languages), 1)), "languages": languages}


def document_probabilities(m: dict, texts: list[str | None]) -> np.ndarray:
    """Mean probabilities over the letters of each whole text; zeros where there is none."""
    spans, owner, first = [], [], []
    for i, text in enumerate(texts):
        if text is None or not _LETTER.search(text):
            continue
        code = _encoded(text)
        inner = SPAN - 2 * MARGIN
        for k in range(max(1, -(-(len(code) - 2 * MARGIN) // inner))):
            spans.append(code[k * inner:k * inner + SPAN])
            owner.append(i)
            first.append(0 if k == 0 else MARGIN)
    sums, count = np.zeros((len(texts), len(m["languages"]))), np.zeros(len(texts))
    sizes = np.array([len(s) for s in spans], np.int64)
    owner, first = np.array(owner, np.int64), np.array(first, np.int64)
    ends = np.r_[owner[1:] != owner[:-1], True] if len(owner) else owner
    order = np.argsort(sizes, kind="stable")
    for lo in range(0, len(order), GROUP):
        at = order[lo:lo + GROUP]
        codes = np.full((len(at), sizes[at].max()), _PAD, np.int64)
        for row, i in enumerate(at):
            codes[row, :sizes[i]] = spans[i]
        p = _probabilities(m, _states(m, codes))
        where = np.arange(codes.shape[1])
        taken = _IS_LETTER[codes] & (where >= first[at][:, None])
        taken &= where < np.where(ends[at], sizes[at], sizes[at] - MARGIN)[:, None]
        np.add.at(sums, owner[at], np.einsum("ktw,tw->wk", p, taken.T.astype(p.dtype)))
        np.add.at(count, owner[at], taken.sum(1))
    return sums / np.maximum(count, 1)[:, None]


def predict(docs: DataFrame, model: dict, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """docs with the predicted language and its probability, in columns of the given names (which must be free).

    Texts that are null or hold no letter are `und` with score 0, and so is every text under a model of no language.
    Nothing but the text counts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang:string,score:double>")
    def told(texts):
        import pandas as pd

        m = shared.value
        values = [None if x is None or x is pd.NA or x != x else x for x in texts]
        if not m["languages"]:
            return pd.DataFrame({"lang": [UNKNOWN] * len(values), "score": 0.0})
        p = document_probabilities(m, values)
        best = p.argmax(1)
        top = p[np.arange(len(p)), best]
        names = [m["languages"][b] if s > 0 else UNKNOWN for b, s in zip(best, top)]
        return pd.DataFrame({"lang": names, "score": np.clip(top, 0, 1)})

    held = f"_{lang_name}_{score_name}"
    said = told(F.col(text_col).cast("string"))
    return docs.withColumn(held, said).select(
        *[docs[c] for c in docs.columns], F.col(held)["lang"].alias(lang_name), F.col(held)["score"].alias(score_name))
