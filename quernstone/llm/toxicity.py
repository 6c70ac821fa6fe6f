"""Toxicity by a chain of linear classifiers.

The categories are predicted one after the other. Each model is a logistic regression over a document's
distinct words and their character 4-grams (hashed; weighted by the log ratio of their frequencies in
the two classes) and over the probabilities of the categories before it. While training, those
probabilities are out-of-fold: rows get them from models that haven't seen the rows, so later models
meet the same kind of error as when they score. The last category's cut is the one with the best F1
out of fold.

The models are fitted in one task over at most ``TRAIN_ROWS`` labelled rows, those with the smallest
hash of the id: a bounded sample by design, the only one here. Their features stay on the executors, and
the driver gets the weights. Every document is scored by its whole text, in one pass without a shuffle.

Nulls and edges: null text is empty; null labels don't count, and of several labels of one id the
largest does; a category with one class or without labels gets a constant probability (its share, or
0.5); without any usable label of the last category nothing is toxic; repeated rows score alike; only
the id and the text are read, other columns pass through ``reject``.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import trimmed

TRAIN_ROWS, DIM, FOLDS, GRAM = 6000, 1 << 18, 3, 4
#: Features seen in fewer rows, or with a smaller log ratio, are left out of a model.
LEAST_ROWS, LEAST_RATIO = 3, 0.6
CACHE = 200_000
#: Training features worked on at once, or one row's if it has more.
BLOCK = 1 << 17
MODEL = pa.schema([("k", pa.int32()), ("f", pa.list_(pa.int32())), ("w", pa.list_(pa.float64())), ("earlier", pa.list_(pa.float64())), ("intercept", pa.float64()), ("cut", pa.float64())])
_WORDS = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[int]:
    """Hashed features of one word: itself and its distinct character grams."""
    framed = f"^{word}$"
    grams = {framed[i : i + GRAM]: None for i in range(max(1, len(framed) - GRAM + 1))}
    return [zlib.crc32(g.encode()) % DIM for g in (f"w:{word}", *grams)]


def words(text: str | None) -> set[str]:
    return set(_WORDS.findall((text or "").lower()))


@dataclass
class Model:
    """weights over features, one weight for each earlier category's probability, and the intercept."""

    weights: np.ndarray
    earlier: np.ndarray
    intercept: float


@dataclass
class Chain:
    categories: list[str]
    models: list[Model] = field(default_factory=list)
    cut: float = 2.0


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class _Rows:
    """Sparse counts of training rows, in blocks of whole rows: only the counts have the size of all rows, temporaries that of a block."""

    def __init__(self, ids: list[np.ndarray], counts: list[np.ndarray]):
        self.n, lengths = len(ids), np.array([len(x) for x in ids], dtype=np.int64)
        ends, self.held, low = np.cumsum(lengths), [], 0
        while low < self.n:
            high = max(low + 1, int(np.searchsorted(ends, ends[low] - lengths[low] + BLOCK, side="right")))
            self.held.append((low, lengths[low:high], ids[low:high], counts[low:high]))
            low = high

    def blocks(self):
        """(slice of rows, each feature's row in it, feature, count)."""
        for low, lengths, ids, counts in self.held:
            yield slice(low, low + len(lengths)), np.repeat(np.arange(len(lengths), dtype=np.int32), lengths), np.concatenate(ids), np.concatenate(counts)


def fit(rows: _Rows, earlier: np.ndarray, y: np.ndarray, train: np.ndarray, steps: int = 150, penalty: float = 1e-3) -> Model:
    """Logistic regression on the rows where ``train`` holds."""
    n = int(train.sum())
    share = float(y[train].mean()) if n else 0.5
    if n == 0 or share in (0.0, 1.0):
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Model(np.zeros(DIM), np.zeros(earlier.shape[1]), float(np.log(share / (1 - share))))
    yes, all_ = np.zeros(DIM), np.zeros(DIM, np.int64)
    for own, row, ids, _ in rows.blocks():
        inside = train[own][row]
        np.add.at(yes, ids[inside], y[own][row[inside]])
        np.add.at(all_, ids[inside], 1)
    ratio = np.log(((yes + 1) / (y[train].sum() + 2)) / ((all_ - yes + 1) / (n - y[train].sum() + 2)))
    kept = (all_ >= LEAST_ROWS) & (np.abs(ratio) >= LEAST_RATIO)
    names, place = np.flatnonzero(kept), np.cumsum(kept, dtype=np.int32) - 1
    parts = []
    for own, row, ids, count in rows.blocks():
        used = kept[ids] & train[own][row]
        parts.append((own, row[used], place[ids[used]], count[used] * ratio[ids[used]]))
    target, weight = y * 1.0, train / n
    w, e, b = np.zeros(len(names)), np.zeros(earlier.shape[1]), float(np.log(share / (1 - share)))
    m = [np.zeros_like(w), np.zeros_like(e), 0.0]
    v = [np.zeros_like(w), np.zeros_like(e), 0.0]
    for t in range(1, steps + 1):
        z = np.zeros(rows.n)
        for own, row, at, value in parts:
            z[own] = np.bincount(row, weights=value * w[at], minlength=own.stop - own.start)
        d = (_sigmoid(z + earlier @ e + b) - target) * weight
        slope = np.zeros(len(names))
        for own, row, at, value in parts:
            np.add.at(slope, at, value * d[own][row])
        grads = [slope + penalty * w, earlier.T @ d + penalty * e, d.sum()]
        new = []
        for k, (x, g) in enumerate(zip((w, e, b), grads)):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            new.append(x - 0.05 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8))
        w, e, b = new
    full = np.zeros(DIM)
    full[names] = w * ratio[names]
    return Model(full, e, float(b))


def predict(model: Model, rows: _Rows, earlier: np.ndarray) -> np.ndarray:
    z = np.zeros(rows.n)
    for own, row, ids, count in rows.blocks():
        z[own] = np.bincount(row, weights=count * model.weights[ids], minlength=own.stop - own.start)
    return _sigmoid(z + earlier @ model.earlier + model.intercept)


def fit_chain(ids: list[np.ndarray], counts: list[np.ndarray], labels: dict[str, np.ndarray], fold: np.ndarray) -> Chain:
    """``ids``, ``counts``: each row's features; ``labels``: by category in chain order, NaN where unknown."""
    rows, chain = _Rows(ids, counts), Chain(list(labels))
    before = np.zeros((rows.n, 0))
    for name, y in labels.items():
        known = ~np.isnan(y)
        y = np.nan_to_num(y)
        held_out = np.zeros(rows.n)
        for k in range(FOLDS):
            model = fit(rows, before, y, known & (fold != k))
            held_out = np.where(fold == k, predict(model, rows, before), held_out)
        chain.models.append(fit(rows, before, y, known))
        chain.cut = _best_cut(held_out[known], y[known])
        before = np.column_stack([before, held_out])
    return chain


def _best_cut(p: np.ndarray, y: np.ndarray) -> float:
    if y.sum() == 0:
        return 2.0
    order = np.argsort(-p, kind="stable")
    hits, ranked = np.cumsum(y[order]), p[order]
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + y.sum())
    ends = np.append(ranked[1:] < ranked[:-1], True)
    k = int(np.argmax(np.where(ends, f1, -1)))
    low = ranked[k + 1] if k + 1 < len(p) else 0.0
    return float((ranked[k] + low) / 2)


def train(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> Chain:
    """Fits the chain on at most ``rows`` labelled documents."""
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(*[F.max(F.col(c).cast("double")).alias(f"_y{k}") for k, c in enumerate(categories)])
    chosen = F.broadcast(known.orderBy(F.xxhash64("_id"), "_id").limit(rows))  # at most ``rows`` small rows
    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(chosen, "_id")

    def run(batches):
        for batch in batches:
            found = [np.unique(np.array([f for w in words(t) for f in features(w)], np.int32), return_counts=True) for t in batch["_text"].to_pylist()]
            columns = [pa.array([x[k].astype(np.int32) for x in found], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch["_id"].cast(pa.string()), *[batch[f"_y{k}"] for k in range(len(categories))], *columns], names=["id", *[f"y{k}" for k in range(len(categories))], "f", "n"])

    def fitted(batches):
        ids, counts, fold, y = [], [], [], [[] for _ in categories]
        for batch in batches:
            fold += [zlib.crc32(x.encode()) % FOLDS for x in batch["id"].to_pylist()]
            for k, own in enumerate(y):
                own.append(batch[f"y{k}"].to_numpy(zero_copy_only=False).astype(float))
            for c, held in (("f", ids), ("n", counts)):
                held += [np.asarray(x.values) for x in batch[c]]
        chain = fit_chain(ids, counts, {c: np.concatenate(own) if own else np.zeros(0) for c, own in zip(categories, y)}, np.array(fold, dtype=int))
        for k, m in enumerate(chain.models):
            used = np.flatnonzero(m.weights)
            yield pa.RecordBatch.from_pydict({"k": [k], "f": [used.astype(np.int32)], "w": [m.weights[used]], "earlier": [m.earlier], "intercept": [m.intercept], "cut": [chain.cut]}, MODEL)

    schema = ", ".join(["id string", *[f"y{k} double" for k in range(len(categories))], "f array<int>", "n array<int>"])
    found = picked.mapInArrow(trimmed(run), schema).repartition(1).sortWithinPartitions("id", "f", "n")
    models = found.mapInArrow(trimmed(fitted), "k int, f array<int>, w array<double>, earlier array<double>, intercept double, cut double").toArrow().sort_by("k")
    if models.num_rows == 0:  # no task had rows
        return fit_chain([], [], {c: np.zeros(0) for c in categories}, np.zeros(0, int))
    chain = Chain(list(categories), cut=models["cut"][0].as_py())
    for r in range(models.num_rows):
        weights = np.zeros(DIM)
        weights[models["f"][r].values.to_numpy()] = models["w"][r].values.to_numpy()
        chain.models.append(Model(weights, models["earlier"][r].values.to_numpy(), models["intercept"][r].as_py()))
    return chain


def score(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """Adds ``p_<category>`` for each category and ``is_<last category>``."""
    held = docs.sparkSession.sparkContext.broadcast(([m.weights for m in chain.models], [m.earlier for m in chain.models], [m.intercept for m in chain.models], chain.cut))
    names, n = docs.columns, len(chain.models)
    new = [*[f"p_{c}" for c in chain.categories], f"is_{chain.categories[-1]}"]
    keep = [c for c in names if c not in new]

    def run(batches):
        weights, earlier, intercept, cut = held.value
        table = np.stack(weights)
        used = np.flatnonzero(np.abs(table).sum(axis=0))
        some = dict(zip(used.tolist(), table[:, used].T.tolist()))
        none = (0.0,) * n
        known: dict[str, tuple[float, ...]] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            sums = np.zeros((batch.num_rows, n))
            for r, text in enumerate(batch[text_col].to_pylist()):
                found = []
                for w in words(text):
                    x = known.get(w)
                    if x is None:
                        if len(known) >= CACHE:
                            known.clear()
                        own = [some[f] for f in features(w) if f in some]
                        x = known[w] = tuple(map(sum, zip(*own))) if own else none
                    if x is not none:
                        found.append(x)
                if found:
                    sums[r] = [sum(sorted(x)) for x in zip(*found)]
            p = np.zeros((batch.num_rows, n))
            for k in range(n):
                p[:, k] = _sigmoid(sums[:, k] + p[:, :k] @ earlier[k] + intercept[k])
            columns = [*[batch[c] for c in keep], *[pa.array(p[:, k]) for k in range(n)], pa.array(p[:, n - 1] >= cut)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *new])

    schema = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep], *[f"`{c}` double" for c in new[:-1]], f"`{new[-1]}` boolean"])
    return docs.mapInArrow(trimmed(run), schema)


def reject(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """The rows that aren't toxic, with the columns of ``docs``."""
    scored = score(docs, chain, text_col)
    return scored.filter(~F.col(f"is_{chain.categories[-1]}")).select(*[F.col(f"`{c}`") for c in docs.columns])
