"""Names compared by bits against names compared by arrays, and amounts beyond what can be held."""

from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest

from txnrecon.operators import fx, similarity


def named():
    rng = np.random.default_rng(0)
    letters = list("abcdé 日1")
    made = {"".join(rng.choice(letters, rng.integers(0, 14))) for _ in range(150)}
    return sorted(made | {"x" * 64, "x" * 70, "ab" * 40, "ab" * 32, "b" + "ab" * 31, "", "a", "b"})


def test_bits_equal_arrays():
    names = named()
    known = similarity._Names(pa.array(names), pa.array([n.split() for n in names], pa.list_(pa.string())))
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(names)), np.arange(len(names)), indexing="ij"))
    want = similarity._by_length([known.names[k] for k in i], [known.names[k] for k in j])
    assert np.array_equal(known.jaro_winkler(i, j), want)
    for threshold in (0.7, 0.85, 0.9):
        assert not (~similarity._may_reach(known, i, j, threshold) & (want >= threshold)).any()


@pytest.mark.parametrize("left, right", [([3, 0, 2], [2, 5, 1]), ([70_000], [2]), ([1], [70_000])])
def test_every_pair_is_looked_at_once(left, right):
    seen = [np.stack(x) for x in similarity._pairs(np.array(left), np.array(right))]
    got = np.concatenate(seen, axis=1).T
    assert len(got) == sum(n * m for n, m in zip(left, right)) == len(np.unique(got, axis=0))


def test_products_that_cannot_be_held_are_deferred(spark):
    row = [(Decimal(9_000_000_000_000_000), "USD", "DOP", 2, Decimal(20_000), None)]
    frame = spark.createDataFrame(
        row,
        "amount decimal(20,4), currency string, account_currency string, account_decimals int, rate decimal(28,12), defer_reason string",
    )
    found = fx.convert(frame).first()
    assert found.booked_amount is None and found.defer_reason == "amount_out_of_range"
