"""Language of whole texts by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HIDDEN = 8
STEPS = 64
"""Steps of a window; a step reads two bytes, and whole texts are cut into windows."""
TRAINED_ROWS = 600
"""Labelled documents per language that the network is fitted on, by the least hash of doc_id; each gives two windows."""
EPOCHS, BATCH, RATE = 24, 128, 0.02
UNKNOWN = "und"
_AT_ONCE = 2048
_LETTER = re.compile(r"[^\W\d_]")

Weights = dict[str, np.ndarray]


def _pairs(data: bytes) -> np.ndarray:
    """The bytes of a text, two a step, A-Z folded; an odd last byte is paired with a zero."""
    data = data.lower()
    return np.frombuffer(data + b"\0" * (len(data) % 2), ">u2")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def initial(languages: int, seed: int = 1) -> Weights:
    rng = np.random.default_rng(seed)
    weights: Weights = {}
    for side in ("f", "b"):
        weights[f"{side}_first"] = rng.normal(0, 0.3, (256, 3 * HIDDEN))
        weights[f"{side}_second"] = rng.normal(0, 0.3, (256, 3 * HIDDEN))
        weights[f"{side}_bias"] = np.zeros(3 * HIDDEN)
        weights[f"{side}_hidden"] = rng.normal(0, 0.3, (HIDDEN, 3 * HIDDEN))
    weights["out"] = rng.normal(0, 0.3, (2 * HIDDEN, languages))
    weights["out_bias"] = np.zeros(languages)
    return {k: v.astype(np.float32) for k, v in weights.items()}


def gradients(weights: Weights, x: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> tuple[float, Weights]:
    """Mean loss over all positions of windows x (steps, windows), and its gradients by backpropagation through time."""
    steps, n = x.shape
    h3 = 3 * HIDDEN
    found: Weights = {}
    states, saved = {}, {}
    for side, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
        read = weights[f"{side}_first"][x >> 8] + weights[f"{side}_second"][x & 255] + weights[f"{side}_bias"]
        hidden = weights[f"{side}_hidden"]
        h = np.zeros((n, HIDDEN), np.float32)
        states[side], saved[side] = np.zeros((steps, n, HIDDEN), np.float32), {}
        for t in order:
            u = h @ hidden
            gates = _sigmoid(read[t, :, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            new = np.tanh(read[t, :, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
            saved[side][t] = (h, z, r, new, u[:, 2 * HIDDEN :])
            h = (new + z * (h - new)) * mask[t][:, None]
            states[side][t] = h
    both = np.concatenate([states["f"], states["b"]], axis=2)
    logits = both @ weights["out"] + weights["out_bias"]
    logits -= logits.max(axis=2, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=2, keepdims=True)
    total = mask.sum()
    loss = float(-(np.log(p[:, np.arange(n), labels] + 1e-9) * mask).sum() / total)
    d = p
    d[:, np.arange(n), labels] -= 1
    d *= (mask / total)[:, :, None]
    found["out"] = np.einsum("tnh,tnk->hk", both, d)
    found["out_bias"] = d.sum(axis=(0, 1))
    back = d @ weights["out"].T
    for side, order in (("f", range(steps - 1, -1, -1)), ("b", range(steps))):
        own = back[:, :, :HIDDEN] if side == "f" else back[:, :, HIDDEN:]
        hidden = weights[f"{side}_hidden"]
        dh = np.zeros((n, HIDDEN), np.float32)
        read = np.zeros((steps, n, h3), np.float32)
        found[f"{side}_hidden"] = np.zeros_like(hidden)
        for t in order:
            h, z, r, new, u = saved[side][t]
            dh = (dh + own[t]) * mask[t][:, None]
            dnew = dh * (1 - z) * (1 - new * new)
            dz = dh * (h - new) * z * (1 - z)
            dr = dnew * u * r * (1 - r)
            read[t] = np.concatenate([dz, dr, dnew], axis=1)
            du = np.concatenate([dz, dr, dnew * r], axis=1)
            found[f"{side}_hidden"] += h.T @ du
            dh = dh * z + du @ hidden.T
        flat, codes = read.reshape(-1, h3), x.reshape(-1)
        for name, code in (("first", codes >> 8), ("second", codes & 255)):
            one = np.zeros((len(codes), 256), np.float32)
            one[np.arange(len(codes)), code] = 1
            found[f"{side}_{name}"] = one.T @ flat
        found[f"{side}_bias"] = flat.sum(axis=0)
    return loss, found


def _windows(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows (rows) of a text's steps, the last filled with zeros, and how many steps of each are real."""
    count = max(1, -(-len(data) // STEPS))
    padded = np.zeros(count * STEPS, np.uint16)
    padded[: len(data)] = data
    lengths = np.full(count, STEPS)
    lengths[-1] = len(data) - (count - 1) * STEPS
    return padded.reshape(count, STEPS), lengths


def fit(samples: list[tuple[bytes, int]], languages: int, seed: int = 1) -> Weights:
    """Weights after EPOCHS passes over windows of labelled bytes (Adam)."""
    cut = [_windows(_pairs(data)) for data, _ in samples]
    x = np.concatenate([w for w, _ in cut]).T.astype(np.int64)
    lengths = np.concatenate([n for _, n in cut])
    labels = np.repeat(np.array([k for _, k in samples]), [len(n) for _, n in cut])
    mask = (np.arange(STEPS)[:, None] < lengths).astype(np.float32)
    weights, rng = initial(languages, seed), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in weights.items()}
    second = {k: np.zeros_like(v) for k, v in weights.items()}
    t = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(x.shape[1])
        rate = RATE * (1 - epoch / EPOCHS)
        for k in range(0, len(order), BATCH):
            rows = order[k : k + BATCH]
            _, g = gradients(weights, x[:, rows], mask[:, rows], labels[rows])
            t += 1
            for name in weights:
                first[name] = 0.9 * first[name] + 0.1 * g[name]
                second[name] = 0.999 * second[name] + 0.001 * g[name] ** 2
                weights[name] -= (rate * first[name] / (1 - 0.9**t) / (np.sqrt(second[name] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return weights


class Network:
    """Fitted weights ready to label: what two bytes add to the gates is looked up by both at once."""

    def __init__(self, weights: Weights):
        code = np.arange(1 << 16)
        self._read = {s: (weights[f"{s}_first"][code >> 8] + weights[f"{s}_second"][code & 255] + weights[f"{s}_bias"]).astype(np.float32) for s in "fb"}
        self._hidden = {s: np.ascontiguousarray(weights[f"{s}_hidden"].T) for s in "fb"}
        self._out, self._bias = np.ascontiguousarray(weights["out"].T), weights["out_bias"][:, None]

    def positions(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Probabilities (steps, languages, windows) at every position of windows x (steps, windows)."""
        steps, n = x.shape
        both = np.empty((steps, 2 * HIDDEN, n), np.float32)
        full = bool((lengths == steps).all())
        rows = np.empty((n, 3 * HIDDEN), np.float32)
        for side, order, at in (("f", range(steps), 0), ("b", range(steps - 1, -1, -1), HIDDEN)):
            h = np.zeros((HIDDEN, n), np.float32)
            for t in order:
                np.take(self._read[side], x[t], axis=0, out=rows, mode="clip")
                read = np.ascontiguousarray(rows.T)
                u = self._hidden[side] @ h
                gates = read[: 2 * HIDDEN] + u[: 2 * HIDDEN]
                gates *= 0.5
                np.tanh(gates, out=gates)
                gates *= 0.5
                gates += 0.5
                new = gates[HIDDEN:] * u[2 * HIDDEN :]
                new += read[2 * HIDDEN :]
                np.tanh(new, out=new)
                h = h - new
                h *= gates[:HIDDEN]
                h += new
                if not full:
                    h *= t < lengths
                both[t, at : at + HIDDEN] = h
        p = self._out @ both + self._bias
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        return p

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities (texts, languages) over all positions of each whole text."""
        cut = [_windows(_pairs(t)) for t in texts]
        owner = np.repeat(np.arange(len(texts)), [len(n) for _, n in cut])
        x, lengths = np.concatenate([w for w, _ in cut]), np.concatenate([n for _, n in cut])
        order = np.argsort(lengths, kind="stable")
        sums = np.zeros((len(texts), len(self._bias)))
        for k in range(0, len(order), _AT_ONCE):
            rows = order[k : k + _AT_ONCE]
            own = lengths[rows]
            steps = int(own.max())
            if not steps:
                continue
            p = self.positions(np.ascontiguousarray(x[rows, :steps].T.astype(np.intp)), own)
            p *= (np.arange(steps)[:, None] < own)[:, None, :]
            np.add.at(sums, owner[rows], p.sum(axis=0).T)
        return sums / np.maximum(sums.sum(axis=1, keepdims=True), 1e-12)


def held_out(doc_id: str = "doc_id"):
    """Whether a document is not learned from: crc32 of its id as text is 2 modulo 4, or it has no id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(True))


def train(docs: DataFrame, rows_per_language: int = TRAINED_ROWS) -> tuple[list[str], Weights | None]:
    """Languages and weights from at most `rows_per_language` labelled documents each, two windows of bytes from each.

    The documents are those of least hash; the windows start where their hash says, anywhere in the text.
    """
    labelled = docs.select("doc_id", "text", "lang").filter(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    size = 2 * STEPS
    place = lambda seed: F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.greatest(F.length("text") - size, F.lit(0)) + 1) + 1
    pieces = [F.encode(F.substring("text", place(s), F.lit(size)), "utf-8").alias(f"piece{s}") for s in (1, 2)]
    ranked = labelled.select("lang", F.xxhash64("doc_id").alias("order"), *pieces)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("order", "piece1", "piece2"))
    sample = ranked.withColumn("rank", rank).filter(F.col("rank") <= rows_per_language).select("lang", "rank", "piece1", "piece2").collect()
    sample.sort(key=lambda r: (r["lang"], r["rank"]))
    languages = sorted({r["lang"] for r in sample})
    if not languages:
        return [], None
    number = {lang: k for k, lang in enumerate(languages)}
    return languages, fit([(bytes(r[c])[:size], number[r["lang"]]) for r in sample for c in ("piece1", "piece2")], len(languages))


def identify(docs: DataFrame, rows_per_language: int = TRAINED_ROWS) -> DataFrame:
    """Per row of `docs`: doc_id, held_out, lang_pred, score (the pooled probability of the predicted language).

    The network is fitted on `docs` themselves (see `train`), then labels every position of every whole text; a text's
    probabilities are the mean over its positions.  Only the text is read for a prediction.  Null texts and texts without a
    letter are `und` with score 0, as is everything if no document is labelled.
    """
    languages, weights = train(docs, rows_per_language)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Network(weights) if languages else None
        for batch in batches:
            texts = batch.column("text").to_pylist()
            names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            written = [k for k, t in enumerate(texts) if t and network and _LETTER.search(t)]
            for k in range(0, len(written), 256):
                part = written[k : k + 256]
                p = network.pooled([texts[i].encode("utf-8", "surrogatepass") for i in part])
                for i, best, score in zip(part, p.argmax(axis=1).tolist(), p.max(axis=1).tolist()):
                    names[i], scores[i] = languages[best], min(score, 1.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
