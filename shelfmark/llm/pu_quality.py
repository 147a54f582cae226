"""A quality classifier learnt from trusted positives and unlabelled text.

Positive-unlabelled learning: with class prior p, the risk of a scorer g is
    p E+[loss(g, 1)] + max(0, Eu[loss(g, 0)] - p E+[loss(g, 0)]),
which needs no negative examples; the maximum keeps the part that stands for the negatives from going below zero
(while a step would, the gradient of its negative is followed instead). The prior is estimated first: a scorer
trained to tell positives from unlabelled text puts the negatives low, and above any threshold the share of the
unlabelled is at least p times the share of the positives, so the least ratio of the two estimates p.

Texts are described by their shape: byte classes and their successions, word lengths, repetition, and lines. Nothing
but the text is an input. The model is a small network, fitted in numpy on at most SAMPLE positives and SAMPLE
unlabelled rows (least hashes first); scoring covers every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 8_000
HIDDEN = 24
EPOCHS = 40
_COARSE = 8
_MARKS = [chr(i) for i in range(33, 127) if not chr(i).isalnum()]


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Byte to fine class (one for each ASCII mark) and to coarse class (letters, digits, marks, space, lines)."""
    fine, coarse = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for i in range(256):
        c = chr(i)
        if i >= 128:
            fine[i], coarse[i] = 1, 1
        elif c.islower():
            fine[i], coarse[i] = 2, 2
        elif c.isupper():
            fine[i], coarse[i] = 3, 3
        elif c.isdigit():
            fine[i], coarse[i] = 4, 4
        elif c == " ":
            fine[i], coarse[i] = 5, 5
        elif c == "\n":
            fine[i], coarse[i] = 6, 6
        elif c in _MARKS:
            fine[i], coarse[i] = 7 + _MARKS.index(c), 7
    return fine, coarse


_FINE, _PAIR = _tables()
FEATURES = 7 + len(_MARKS) + _COARSE * _COARSE + 10


def describe(text: str | None) -> np.ndarray:
    """The features of one text; all zero but a constant for a null or empty one."""
    out = np.zeros(FEATURES, np.float32)
    out[-1] = 1
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return out
    fine = np.bincount(_FINE[data], minlength=7 + len(_MARKS)) / len(data)
    kinds = _PAIR[data]
    pairs = np.bincount(kinds[:-1] * _COARSE + kinds[1:], minlength=_COARSE ** 2) / len(data)
    words = text.split()
    n = max(len(words), 1)
    lines = [x for x in text.split("\n") if x]
    same = sum(map(str.__eq__, words[1:], words)) / n
    distinct = len(set(words))
    shape = [np.log1p(len(data)) / 10, np.log1p(n) / 10, len(data) / n / 20, same, distinct / n, np.log1p(distinct) / 10,
             np.log1p(len(lines)) / 5, len(set(lines)) / max(len(lines), 1), len(lines) / n]
    out[:-1] = np.concatenate([np.sqrt(fine), np.sqrt(pairs), shape])
    return out


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [describe(t.as_py()).tobytes() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["drawn", "features"])


def _forward(m: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.tanh(x @ m["w1"] + m["b1"])
    return h, h @ m["w2"] + m["b2"]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _fit(pos: np.ndarray, unl: np.ndarray, prior: float | None, seed: int) -> dict:
    """Adam on the non-negative risk; without a prior, on the plain risk of telling positives from unlabelled."""
    rng = np.random.default_rng(seed)
    m = {"w1": rng.normal(0, 1 / np.sqrt(pos.shape[1]), (pos.shape[1], HIDDEN)), "b1": np.zeros(HIDDEN),
         "w2": rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), "b2": np.zeros(1)}
    first, second = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2))
    step, size = 0, 256
    # Small samples get as many steps as they need to settle.
    rounds = max(4, max(len(pos), len(unl)) // size)
    for epoch in range(EPOCHS):
        rate = 0.01 * (1 - epoch / EPOCHS) + 1e-4
        for _ in range(rounds):
            p, u = pos[rng.integers(0, len(pos), size)], unl[rng.integers(0, len(unl), size)]
            x = np.concatenate([p, u])
            h, g = _forward(m, x)
            s = _sigmoid(g)
            gp, gu = s[:size], s[size:]
            if prior is None:
                slope = np.r_[gp - 1, gu] / size
            else:
                # Losses: -log s for class 1, -log(1 - s) for class 0.
                negative = -np.log1p(-gu + 1e-12).mean() + prior * np.log1p(-gp + 1e-12).mean()
                if negative >= 0:
                    slope = np.r_[prior * (gp - 1) - prior * gp, gu] / size
                else:
                    slope = np.r_[prior * gp, -gu] / size
            back = slope[:, None] * m["w2"] * (1 - h * h)
            grads = {"w1": x.T @ back, "b1": back.sum(0), "w2": h.T @ slope, "b2": slope.sum(keepdims=True)}
            step += 1
            for k, d in grads.items():
                d = d + 1e-4 * m[k]
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.999 * second[k] + 0.001 * d * d
                m[k] = m[k] - rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    return m


def prior_of(pos: np.ndarray, unl: np.ndarray, seed: int = 7) -> float:
    """The class prior: fitted on one half of the rows and read off on the other, both ways round."""
    found = []
    for turn in (0, 1):
        model = _fit(pos[turn::2], unl[turn::2], None, seed + turn)
        p, u = np.sort(_forward(model, pos[1 - turn::2])[1]), _forward(model, unl[1 - turn::2])[1]
        # Thresholds at the positives' own quantiles, from all of them down to a fifth.
        cuts = p[np.unique((np.linspace(0, 0.8, 81) * (len(p) - 1)).astype(int))]
        above_p = 1 - np.searchsorted(p, cuts) / len(p)
        above_u = 1 - np.searchsorted(np.sort(u), cuts) / len(u)
        found.append((above_u / above_p).min())
    return float(np.clip(np.mean(found), 0.05, 0.98))


def train(pos: np.ndarray, unl: np.ndarray, seed: int = 11) -> dict:
    """The fitted model, with the scaling of its inputs and the estimated prior."""
    if not len(pos) or not len(unl):
        return {"prior": 0.5}
    mean, scale = unl.mean(0), unl.std(0) + 0.02
    pos, unl = ((x - mean) / scale for x in (pos, unl))
    prior = prior_of(pos, unl) if min(len(pos), len(unl)) > 1 else 0.5
    return _fit(pos, unl, prior, seed) | {"mean": mean, "scale": scale, "prior": prior}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    if "w1" not in model:
        return np.full(len(x), model["prior"])
    return _sigmoid(_forward(model, np.clip((x - model["mean"]) / model["scale"], -20, 20))[1])


def learn(docs: DataFrame, labels: DataFrame, trusted: Column, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality") -> dict:
    """A model from the rows of docs where `trusted` (a boolean over docs, by id) holds and their labels.

    Positives are rows with a label of 1; all trusted rows count as unlabelled, whatever their label. Labels of 0 are
    never read. Null ids and labels, and labels without a document, are passed over.
    """
    base = docs.where(trusted & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    drawn = F.xxhash64(F.lit("drawn"), F.col("doc"))
    named = labels.where(F.col(label_col) == 1).select(F.col(id_col).cast("long").alias("doc")).distinct()
    # At most SAMPLE ids, so the broadcast is bounded.
    chosen = named.orderBy(F.xxhash64(F.lit("drawn"), F.col("doc")), "doc").limit(SAMPLE)
    share = min(1.0, 1.2 * SAMPLE / max(docs.count(), 1))
    some = base.where(F.pmod(F.xxhash64("doc"), F.lit(1 << 30)) <= int(share * (1 << 30)))
    held = [x.select(drawn.alias("drawn"), "text").mapInArrow(_described, "drawn long, features binary")
            .orderBy("drawn", "features").limit(SAMPLE).toArrow()["features"].to_pylist()
            for x in (base.join(F.broadcast(chosen), "doc"), some)]
    pos, unl = (np.frombuffer(b"".join(x), np.float32).reshape(-1, FEATURES).astype(np.float64) for x in held)
    return train(pos, unl)


def score(docs: DataFrame, model: dict, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with one more column, the score of its text (0 to 1, higher: good likelier). Null and empty texts get a
    score too. A column of that name is replaced; rows are scored one by one, so repeats and ties score alike."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        out = np.empty(len(texts))
        for lo in range(0, len(texts), 512):
            part = texts.iloc[lo:lo + 512]
            out[lo:lo + len(part)] = predict(shared.value, np.stack([describe(t) for t in part]).astype(np.float64))
        return pd.Series(out)

    return docs.withColumn(name, of(F.col(text_col).cast("string")))
