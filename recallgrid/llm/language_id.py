"""Language of a text by a bidirectional gated recurrent network over its UTF-8 bytes.

The network (one embedding of the byte into each gate, an update and a reset
gate per direction, a linear layer over both states) is trained in numpy by
backpropagation through time. Gates are hard sigmoids and states hard tangents,
which train as well here and cost a fraction. It labels every byte of a text
that carries a letter or belongs to one (bytes from 128 on and A-Z, a-z); a
document's probabilities are the mean over those positions. Texts run in
windows of WINDOW bytes with a state of zero at both ends, so a text of any
length takes bounded memory.

Training uses a bounded sample: one window of each row, at a place chosen by
hash, and at most PER_LANGUAGE different ones of a language, smallest by hash. Prediction
reads whole texts and nothing but the text.

Defined results: text that is null or has no letter gives `und` and score 0;
rows without a language or a text are not learnt from; with no row to learn
from every text gives `und`; equal texts get equal results; an empty table
gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import by_bytes, quoted, smallest_by_hash

WINDOW, HIDDEN = 64, 8
PER_LANGUAGE, EPOCHS, BATCH, RATE, SEED = 1500, 10, 128, 0.02, 7
#: Windows that run side by side.
WIDTH = 2048
UNKNOWN = "und"
_LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])


def new_weights(n_labels: int, hidden: int = HIDDEN, seed: int = SEED) -> dict[str, np.ndarray]:
    """For each direction d and gate g (z, r, c): input table `xdg` by byte, recurrent `udg`; `w`, `b` of the last layer."""
    rng = np.random.default_rng(seed)
    out = {}
    for d in "fb":
        for g in "zrc":
            out[f"x{d}{g}"] = rng.normal(0, 0.4, (256, hidden)).astype(np.float32)
            out[f"u{d}{g}"] = rng.normal(0, 0.8 / np.sqrt(hidden), (hidden, hidden)).astype(np.float32)
        out[f"x{d}z"] += 0.3
        out[f"x{d}r"] += 0.5
    out["w"] = rng.normal(0, 0.3, (2 * hidden, n_labels)).astype(np.float32)
    out["b"] = np.zeros(n_labels, np.float32)
    return out


def states(p: dict, d: str, x: np.ndarray, real: np.ndarray | None, keep: bool = False):
    """States (time, row, unit) of direction `d` over bytes x (time, row). Padding, where `real` is false, leaves a state as it is.

    With `keep` also what backpropagation needs.
    """
    steps, rows = x.shape
    hidden = p["w"].shape[0] // 2
    h = np.zeros((rows, hidden), np.float32)
    z, r, c, g = (np.empty_like(h) for _ in range(4))
    out = np.empty((steps, rows, hidden), np.float32)
    saved = []
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        before = h.copy() if keep else h
        np.take(p[f"x{d}z"], x[t], axis=0, out=z, mode="clip")
        z += np.matmul(h, p[f"u{d}z"], out=g)
        np.clip(z, 0, 1, out=z)
        if real is not None:
            z *= real[t][:, None]
        np.take(p[f"x{d}r"], x[t], axis=0, out=r, mode="clip")
        r += np.matmul(h, p[f"u{d}r"], out=g)
        np.clip(r, 0, 1, out=r)
        if keep:
            gate = r.copy()
        r *= h
        np.take(p[f"x{d}c"], x[t], axis=0, out=c, mode="clip")
        c += np.matmul(r, p[f"u{d}c"], out=g)
        np.clip(c, -1, 1, out=c)
        if keep:
            saved.append((t, before, z.copy(), gate, c.copy()))
        c -= h
        c *= z
        h += c
        out[t] = h
    return (out, saved) if keep else out


def _softmax(logits: np.ndarray) -> np.ndarray:
    """Over the first axis."""
    logits -= logits.max(0)
    np.exp(logits, out=logits)
    logits /= logits.sum(0)
    return logits


def gradients(p: dict, x: np.ndarray, real: np.ndarray, letters: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Mean cross entropy over the letters of x (time, row), rows labelled y, and its gradients through time."""
    hidden = p["w"].shape[0] // 2
    runs = {d: states(p, d, x, real, keep=True) for d in "fb"}
    h = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
    prob = _softmax((h @ p["w"] + p["b"]).reshape(-1, len(p["b"])).T.copy()).T.reshape(*x.shape, -1)
    weight = letters / max(1, letters.sum())
    rows = np.arange(len(y))
    loss = float(-(np.log(np.maximum(prob[:, rows, y], 1e-9)) * weight).sum())
    err = prob
    err[:, rows, y] -= 1
    err *= weight[:, :, None]
    grad = {k: np.zeros_like(v) for k, v in p.items()}
    grad["w"] = np.einsum("tbh,tbl->hl", h, err, optimize=True)
    grad["b"] = err.sum((0, 1))
    down = err @ p["w"].T
    for d, part in (("f", slice(0, hidden)), ("b", slice(hidden, None))):
        carried = np.zeros((x.shape[1], hidden), np.float32)
        for t, before, z, r, c in reversed(runs[d][1]):
            dh = down[t, :, part] + carried
            dz = dh * (c - before) * ((z > 0) & (z < 1))
            dc = dh * z * (np.abs(c) < 1)
            reset = dc @ p[f"u{d}c"].T
            dr = reset * before * ((r > 0) & (r < 1))
            carried = dh * (1 - z) + reset * r + dz @ p[f"u{d}z"].T + dr @ p[f"u{d}r"].T
            grad[f"u{d}c"] += (r * before).T @ dc
            grad[f"u{d}z"] += before.T @ dz
            grad[f"u{d}r"] += before.T @ dr
            for g, v in zip("zrc", (dz, dr, dc)):
                np.add.at(grad[f"x{d}{g}"], x[t], v)
    return loss, grad


def _padded(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, is real), both (time, row)."""
    x = np.zeros((len(windows), WINDOW), np.intp)
    real = np.zeros((len(windows), WINDOW), np.float32)
    for i, w in enumerate(windows):
        x[i, : len(w)] = np.frombuffer(w, np.uint8)
        real[i, : len(w)] = 1
    return np.ascontiguousarray(x.T), np.ascontiguousarray(real.T)


def train(windows: list[bytes], labels: list[str], hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = SEED) -> tuple[dict, list[str]]:
    """Weights and the sorted label values, by Adam over shuffled batches."""
    names = sorted(set(labels))
    y = np.array([names.index(v) for v in labels], np.intp)
    x, real = _padded(windows)
    letters = real * _LETTER[x]
    p = new_weights(max(1, len(names)), hidden, seed)
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    rng, step = np.random.default_rng(seed), 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            _, grad = gradients(p, x[:, pick], real[:, pick], letters[:, pick], y[pick])
            step += 1
            size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            rate = RATE * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, g in grad.items():
                g = g * min(1.0, 1.0 / max(size, 1e-9))
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                p[k] -= (rate * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
    return p, names


def label_positions(p: dict, x: np.ndarray, real: np.ndarray | None) -> np.ndarray:
    """Probabilities (label, time, row) of every position of the windows x (time, row)."""
    out = np.empty((len(p["b"]), x.size), np.float32)
    hidden = p["w"].shape[0] // 2
    np.matmul(p["w"][:hidden].T, states(p, "f", x, real).reshape(-1, hidden).T, out=out)
    out += p["w"][hidden:].T @ states(p, "b", x, real).reshape(-1, hidden).T
    out += p["b"][:, None]
    return _softmax(out).reshape(-1, *x.shape)


def pooled(p: dict, texts: list[bytes]) -> np.ndarray:
    """Mean probabilities (text, label) over the letters of each whole text; rows of zeros where there is none."""
    n = np.array([len(t) for t in texts])
    per = -(-n // WINDOW)
    joined = np.frombuffer(b"".join(t.ljust(k * WINDOW, b"\0") for t, k in zip(texts, per)), np.uint8).reshape(-1, WINDOW)
    owner = np.repeat(np.arange(len(texts)), per)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    length = np.minimum(WINDOW, n[owner] - within * WINDOW)
    total, letters = np.zeros((len(texts), len(p["b"]))), np.zeros(len(texts))
    for at in range(0, len(owner), WIDTH):
        who, size = owner[at : at + WIDTH], length[at : at + WIDTH]
        x = np.ascontiguousarray(joined[at : at + WIDTH].T).astype(np.intp)
        real = None if (size == WINDOW).all() else (np.arange(WINDOW)[:, None] < size).astype(np.float32)
        weight = _LETTER[x].astype(np.float32) if real is None else _LETTER[x] * real
        prob = label_positions(p, x, real)
        prob *= weight
        sums = prob.sum(1)
        for label in range(len(sums)):
            total[:, label] += np.bincount(who, sums[label], len(texts))
        letters += np.bincount(who, weight.sum(0), len(texts))
    return total / np.maximum(letters, 1)[:, None]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def training_sample(rows: DataFrame, text: str, lang: str, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(window, lang): at most `per_language` different windows of each language. Only windows are sorted, not texts."""
    place = F.xxhash64(F.lit("place"), F.col(text))
    raw = F.encode(F.col(text), "UTF-8")
    room = F.greatest(F.octet_length(raw) - WINDOW, F.lit(0)) + 1
    picked = rows.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & (F.octet_length(text) > 0)).select(
        F.substring(raw, F.pmod(place, room).cast("int") + 1, F.lit(WINDOW)).alias("window"), F.col(lang).alias("lang"))
    return smallest_by_hash(picked, "lang", F.xxhash64(F.lit("pick"), F.col("window")), per_language)


def learn(rows: DataFrame, text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> tuple[dict, list[str]]:
    """Trains on a bounded sample of `rows`; the sample is a few hundred kilobytes."""
    sample = sorted((bytes(r["window"]), r["lang"]) for r in training_sample(rows, text, lang, per_language).toLocalIterator())
    return train([w for w, _ in sample], [v for _, v in sample])


def predict(docs: DataFrame, model: tuple[dict, list[str]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, `lang_pred` and `score` of every row of `docs`."""
    weights, names = model
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 1 << 20):
            texts = [t if t and has_letter(t) else None for t in batch.column("text").to_pylist()]
            at = [i for i, t in enumerate(texts) if t is not None] if names else []
            lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            if at:
                prob = pooled(weights, [texts[i].encode() for i in at])
                for i, best, value in zip(at, prob.argmax(1), prob.max(1)):
                    lang[i], score[i] = names[best], round(float(value), 6)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [key, "lang_pred", "score"])

    return docs.select(docs[key].alias("id"), docs[text].alias("text")).mapInArrow(run, f"{quoted(key)} {kind}, lang_pred string, score double")


def is_held_out(key: Column, folds: int = 5) -> Column:
    """Rows kept from training: checksum of the key as text divisible by `folds`. A null key is never held out."""
    return F.coalesce(F.crc32(key.cast("string")) % folds == 0, F.lit(False))
