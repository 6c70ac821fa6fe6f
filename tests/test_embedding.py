"""Extraction by batches against one row at a time."""

import numpy as np
import pytest

from quernstone.operators.embedding import Tokens, encoded, extract


def loader():
    """Made inside a function, so that workers get it by value."""

    def small_encoder():
        """States that depend on the token, its place and its left neighbour, but not on padding."""

        def states(ids, mask):
            shifted = np.pad(ids * mask, ((0, 0), (1, 0)))[:, :-1]
            place = np.arange(ids.shape[1]) * mask
            return np.stack([ids * mask, ids * place, shifted + 0.5 * ids, np.sin(place)], axis=2).astype(float)

        return states

    return small_encoder


small_encoder = loader()


def test_batches_equal_single_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(k, "".join(rng.choice(list("ACDEFGHIKLMNPQRSTVWY"), int(rng.integers(1, 120))))) for k in range(300)] + [(900, None)]
    frame = spark.createDataFrame(rows, "id int, s string").repartition(3)
    got = {r["id"]: r["vector"] for r in extract(frame, "id", "s", small_encoder, budget=700, window=40).collect()}
    assert got[900] is None and len(got) == 301
    for k, s in rows[:-1]:
        assert np.allclose(got[k], encoded([s], small_encoder(), Tokens(), 1)[0], rtol=1e-12)
    assert extract(frame.limit(0), "id", "s", small_encoder).collect() == []


def test_order_and_errors(spark):
    frame = spark.createDataFrame([(k, "A" * (1 + (k * 7) % 13)) for k in range(50)], "id int, s string").coalesce(1)
    assert [r["id"] for r in extract(frame, "id", "s", small_encoder, budget=30).collect()] == list(range(50))
    for bad in ("", "AB", "ACX", "A" * 1023, "é"):
        with pytest.raises(ValueError):
            Tokens().ids(bad)
    assert Tokens().ids("AY").tolist() == [0, 4, 23, 2] and len(Tokens().ids("A" * 1022)) == 1024
