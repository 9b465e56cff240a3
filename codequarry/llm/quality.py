"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of ``PASSAGE`` bytes.  Every passage is encoded by the shares of its
bytes, of the steps between classes of characters, by how well it compresses and how full it is; a
learned layer makes that a vector.  Gated attention, learned from the documents' labels alone, weighs
the passages, and the weighted sum of their vectors is scored.

Rows: NULL and empty texts are one passage without bytes.  Rows are scored by themselves, so repeated
rows repeat; labels other than 0 and 1 and NULL ids are not learned from.  Without labels of both
kinds the score is their share, or 0.5 without labels.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import labelled_sample, own_name, slices

PASSAGE = 1024
SAMPLE = 8_000  # labelled documents learned from, at most
SAMPLE_PASSAGES = 24  # passages of each that are learned from, at most; all passages are scored
HIDDEN, GATE = 24, 16
EPOCHS, BAGS = 25, 64
CLASSES = 8
WIDTH = 256 + CLASSES * CLASSES + 2


def _class(b: int) -> int:
    c = chr(b)
    if b >= 0x80:
        return 7
    return 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if c.isdigit() else 3 if c == " " else 4 if c == "\n" else 5 if c in ".,;:'\"-" else 6


_CLASS = np.array([_class(b) for b in range(256)], np.int64)


def encode_passages(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(passages x WIDTH, number of passages of each text)."""
    raw = pc.fill_null(column, "").cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    sizes = np.diff(ends)
    data = np.frombuffer(raw.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    counts = np.maximum(1, -(-sizes // PASSAGE))
    total = int(counts.sum())
    nth = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = np.repeat(ends[:-1] - ends[0], counts) + nth * PASSAGE
    lengths = np.clip(np.repeat(sizes, counts) - nth * PASSAGE, 0, PASSAGE)
    passage = np.repeat(np.arange(total), lengths)
    out = np.zeros((total, WIDTH), np.float32)
    share = np.maximum(lengths, 1)[:, None]
    out[:, :256] = np.sqrt(np.bincount(passage * 256 + data, minlength=total * 256).reshape(total, 256) / share)
    kinds = _CLASS[data]
    if len(data) > 1:
        same = passage[1:] == passage[:-1]
        step = (passage[1:] * CLASSES**2 + kinds[:-1] * CLASSES + kinds[1:])[same]
        out[:, 256 : 256 + CLASSES**2] = np.sqrt(np.bincount(step, minlength=total * CLASSES**2).reshape(total, -1) / share)
    view = memoryview(data)
    packed = [len(zlib.compress(view[s : s + n], 1)) for s, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
    out[:, -2] = np.minimum(np.array(packed) / share[:, 0], 2.0)
    out[:, -1] = lengths / PASSAGE
    return out, counts


class Model:
    """Parameters of the network; ``prior`` alone where there was nothing to learn from."""

    def __init__(self, prior: float, seed: int = 3):
        dice = np.random.default_rng(seed)

        def layer(rows: int, columns: int) -> np.ndarray:
            return (dice.standard_normal((rows, columns)) / np.sqrt(rows)).astype(np.float32)

        self.prior, self.learned = prior, False
        self.mean, self.scale = np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32)
        self.p = {
            "W": layer(WIDTH, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": layer(HIDDEN, GATE), "U": layer(HIDDEN, GATE),
            "w": layer(GATE, 1), "c": layer(HIDDEN, 1), "d": np.zeros(1, np.float32),
        }
        self.slope, self.shift = 1.0, 0.0  # calibration

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict:
        p, first = self.p, np.cumsum(counts) - counts
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-np.clip(h @ p["U"], -30, 30)))
        a = ((t * s) @ p["w"])[:, 0]
        e = np.exp(a - np.repeat(np.maximum.reduceat(a, first), counts))
        weight = e / np.repeat(np.add.reduceat(e, first), counts)
        z = np.add.reduceat(weight[:, None] * h, first, axis=0)
        return {"h": h, "t": t, "s": s, "weight": weight, "z": z, "out": (z @ p["c"])[:, 0] + p["d"][0], "first": first}

    def gradients(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray) -> dict:
        p, f = self.p, self.forward(x, counts)
        g = ((1 / (1 + np.exp(-np.clip(f["out"], -30, 30))) - y) / len(y)).astype(np.float32)
        dz = np.repeat(g[:, None] * p["c"][:, 0], counts, axis=0)
        dw = (dz * f["h"]).sum(axis=1)
        inner = np.repeat(np.add.reduceat(f["weight"] * dw, f["first"]), counts)
        da = (f["weight"] * (dw - inner))[:, None]
        dts = da * p["w"][:, 0]
        dt, ds = dts * f["s"] * (1 - f["t"] ** 2), dts * f["t"] * f["s"] * (1 - f["s"])
        dh = (f["weight"][:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - f["h"] ** 2)
        return {
            "W": x.T @ dh, "b": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "w": (f["t"] * f["s"]).T @ da,
            "c": f["z"].T @ g[:, None], "d": np.array([g.sum()], np.float32),
        }

    def logits(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.forward((x - self.mean) / self.scale, counts)["out"]

    def score(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if not self.learned:
            return np.full(len(counts), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(x, counts).astype(np.float64) + self.shift, -30, 30)))

    def learn(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray, seed: int = 3) -> None:
        """Adam on the bags' log loss; a fifth of the bags picks the epoch and calibrates."""
        dice = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = (x - self.mean) / self.scale
        first = np.cumsum(counts) - counts
        order = dice.permutation(len(y))
        aside, bags = order[: len(y) // 5], order[len(y) // 5 :]

        def pick(some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            n = counts[some]
            at = np.repeat(first[some], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            return x[at], n, y[some]

        test = pick(aside) if len(aside) else pick(bags)
        m, v = ({k: np.zeros_like(q) for k, q in self.p.items()} for _ in range(2))
        step, best, kept = 0, np.inf, None
        for _ in range(EPOCHS):
            dice.shuffle(bags)
            for start in range(0, len(bags), BAGS):
                step += 1
                for k, g in self.gradients(*pick(bags[start : start + BAGS])).items():
                    g = g + 1e-4 * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - 2e-3 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
            out = self.forward(test[0], test[1])["out"]
            loss = np.mean(np.logaddexp(0, out) - test[2] * out)
            if loss < best:
                best, kept = loss, {k: q.copy() for k, q in self.p.items()}
        self.p, self.learned = kept, True
        out = self.forward(test[0], test[1])["out"].astype(np.float64)
        w = np.array([1.0, 0.0])
        design = np.c_[out, np.ones(len(out))]
        for _ in range(20):  # Platt's curve with a ridge towards the network's own
            q = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
            grad = design.T @ (q - test[2]) + (w - [1.0, 0.0])
            w = w - np.linalg.solve((design * (q * (1 - q))[:, None]).T @ design + np.eye(2), grad)
        if w[0] > 0:
            self.slope, self.shift = float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, trained: Column, rows: int = SAMPLE, most: int = SAMPLE_PASSAGES) -> Model:
    """Learn from at most ``rows`` labelled documents, of the label rows that ``trained`` allows.

    The driver gets at most ``rows`` times ``most`` encoded passages: of a longer document those at
    even distances.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                x, counts = encode_passages(part.column("text"))
                bags, at = [], 0
                for n in counts.tolist():
                    chosen = at + np.unique(np.linspace(0, n - 1, min(n, most)).astype(np.int64))
                    bags.append(x[chosen].astype(np.float16).tobytes())
                    at += n
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(bags, pa.binary())], ["doc_id", "label", "bag"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    sample = labelled_sample(docs, labels, "quality", trained, rows).mapInArrow(run, f"doc_id {kind}, label int, bag binary")
    bags = sorted((r["doc_id"], r["label"], bytes(r["bag"])) for r in sample.collect())
    y = np.array([b[1] for b in bags], np.float32)
    model = Model(float(y.mean()) if len(y) else 0.5)
    if len(np.unique(y)) == 2:
        each = [np.frombuffer(b[2], np.float16).reshape(-1, WIDTH) for b in bags]
        model.learn(np.concatenate(each).astype(np.float32), np.array([len(e) for e in each]), y)
    return model


def _with_score(docs: DataFrame, model: Model, carried: list[str], name: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                score = model.score(*encode_passages(part.column("text")))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), pa.array(score, pa.float64())], [*carried, name])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)
    return docs.select(*dict.fromkeys([*carried, "text"])).mapInArrow(run, f"{schema}, {name} double")


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row; the score is the chance of label 1."""
    return _with_score(docs, model, ["doc_id"], "score")


def accepted(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows with a score of ``least`` or more, with all their columns."""
    score = own_name()
    return _with_score(docs, model, docs.columns, score).where(F.col(score) >= least).drop(score)
