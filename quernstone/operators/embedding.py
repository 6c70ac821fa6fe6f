"""Vectors of sequences by an encoder that is passed in: token checks, batches of like lengths, padding, pooling over residues."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.functions.records import ALPHABET
from quernstone.operators.batching import pack
from quernstone.session import share_code


@dataclass(frozen=True)
class Tokens:
    """Token ids: a beginning, padding, an end, an unknown token, then the residues in order; ``most`` counts both specials."""

    residues: str = ALPHABET
    begin: int = 0
    padding: int = 1
    end: int = 2
    unknown: int = 3
    most: int = 1024

    def ids(self, sequence: str) -> np.ndarray:
        """Beginning, one token a residue, end; an unknown residue, an empty or too long sequence is an error."""
        known = np.full(256, self.unknown, np.int64)
        known[np.frombuffer(self.residues.encode(), np.uint8)] = 4 + np.arange(len(self.residues))
        body = known[np.frombuffer(sequence.encode("ascii", "replace"), np.uint8)]
        if not len(body) or len(body) + 2 > self.most:
            raise ValueError(f"{len(body)} residues don't fit 1 to {self.most - 2}")
        if (body == self.unknown).any():
            raise ValueError(f"unknown residue at {int(np.flatnonzero(body == self.unknown)[0])}")
        return np.concatenate([[self.begin], body, [self.end]])


#: (token ids, attention mask) of (rows, tokens) to states of (rows, tokens, width).
Encoder = Callable[[np.ndarray, np.ndarray], np.ndarray]


def pooled(states: np.ndarray, ids: np.ndarray, tokens: Tokens) -> np.ndarray:
    """The mean state of each row's residues; specials and padding don't count, a row without residues is an error."""
    mask = ~np.isin(ids, [tokens.begin, tokens.padding, tokens.end])
    if not mask.any(axis=1).all():
        raise ValueError("a row without residues has no mean")
    return np.einsum("ntd,nt->nd", states.astype(np.float64), mask) / mask.sum(axis=1)[:, None]


def encoded(sequences: Sequence[str], encoder: Encoder, tokens: Tokens, budget: int) -> np.ndarray:
    """A vector for each sequence, in the given order; batches hold like lengths and at most ``budget`` padded tokens."""
    ids = [tokens.ids(s) for s in sequences]
    lengths = np.array([len(x) for x in ids])
    order = np.lexsort((np.arange(len(ids)), lengths))
    batch, out = np.array(pack(lengths[order].tolist(), budget)), None
    for b in range(int(batch[-1]) + 1 if len(batch) else 0):
        own = order[batch == b]
        padded = np.full((len(own), int(lengths[own].max())), tokens.padding, np.int64)
        for k, row in enumerate(own):
            padded[k, : lengths[row]] = ids[row]
        found = pooled(encoder(padded, (padded != tokens.padding).astype(np.int64)), padded, tokens)
        out = np.zeros((len(ids), found.shape[1])) if out is None else out
        out[own] = found
    return out if out is not None else np.zeros((0, 0))


def extract(rows: DataFrame, key: str, sequence: str, load: Callable[[], Encoder], tokens: Tokens | None = None, budget: int = 16384, window: int = 4096) -> DataFrame:
    """(key, vector): one mean vector a row, rows in their order.

    ``load`` makes the encoder, once for each task. A task sorts ``window`` rows at a time by length, so it never holds more. The result depends on
    the row alone, so a task that runs again, or other batches, give the same. Null sequences have null vectors.
    """
    share_code(rows.sparkSession)
    rules = tokens or Tokens()
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for whole in batches:
            for low in range(0, whole.num_rows, window):
                part = whole.slice(low, window)
                encoder = encoder or load()
                texts = part.column("s").to_pylist()
                some = [k for k, s in enumerate(texts) if s is not None]
                found = encoded([texts[k] for k in some], encoder, rules, budget)
                vectors: list = [None] * len(texts)
                for k, v in zip(some, found):
                    vectors[k] = v.tolist()
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(vectors, pa.list_(pa.float64()))], names=[key, "vector"])

    return rows.select(F.col(key).alias("k"), F.col(sequence).alias("s")).mapInArrow(run, f"`{key}` {kind}, vector array<double>")
