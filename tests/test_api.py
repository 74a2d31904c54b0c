"""The interactive classes: sequences, records, and what their methods refuse."""

from __future__ import annotations

import numpy as np
import pytest

from hyperloom import api

STOPS = ["harbour", "mill", "bridge", "tower", "market", "orchard"]
#: The symbols and the relation of the well-known analogy of records, and its answer.
RECORDS = ["NAM", "MON", "CAP", "USA", "DOL", "WDC", "MEX", "PES", "MXC"]
RELATION = "((NAM * USA) + (CAP * WDC) + (MON * DOL)) * ((NAM * MEX) + (CAP * MXC) + (MON * PES))"
ASKED, ANSWER = "DOL", "PES"
SELF_INVERSE = [(api.BinarySpatterCode, 20_000), (api.MultiplyAddPermute, 20_000)]
OTHERS = [(api.HolographicReducedRepresentation, 2048), (api.VectorDerivedTransformationBinding, 10_000)]


@pytest.mark.parametrize(("kind", "size"), SELF_INVERSE)
def test_journeys(spark, kind, size):
    """A journey is a bundle of rotated stops. Rotated back it gives the stop of a place, and bound with a traveller it is told from others."""
    storage = kind(42).create_storage(size)
    storage.extend([*STOPS, "anna", "bert"])
    there = storage.execute(" + ".join(f"{name} ^ {k}" for k, name in enumerate(STOPS)))
    for k in (1, 4, 5):
        assert storage.find_name(there.permute(size - k)) == STOPS[k]
    back = storage.execute(" + ".join(f"{name} ^ {k}" for k, name in enumerate(reversed(STOPS))))
    both = storage.get("anna") * there + storage.get("bert") * back
    assert storage.find_name((both * storage.get("bert")).permute(size - 5)) == STOPS[0]
    assert both.similarity(storage.get("anna") * there) > 0.3 > abs(both.similarity(storage.get("anna") * back))


def test_known_analogy(spark):
    storage = api.MultiplyAddPermute(42).create_storage(20_000)
    storage.extend(RECORDS)
    assert storage.find_name(storage.execute(RELATION) * storage.get(ASKED)) == ANSWER


def test_unbinding_by_inverse(spark):
    """What a key was bound with comes back by the key's inverse, from a bundle of three."""
    storage = api.HolographicReducedRepresentation(42).create_storage(2048)
    storage.extend(STOPS)
    pairs = storage.execute("harbour * mill + bridge * tower + market * orchard")
    key = storage.get("bridge")
    assert key.inverse().equals(-key)
    decoded = {name: (pairs * -key).similarity(storage.get(name)) for name in STOPS}
    assert max(decoded, key=decoded.get) == "tower" and decoded["tower"] > 2 * max(v for n, v in decoded.items() if n != "tower")


@pytest.mark.parametrize(("kind", "size"), OTHERS)
def test_inverse_unbinds(spark, kind, size):
    vsa = kind(42)
    a, b, c = (vsa.random_vector(size) for _ in range(3))
    decoded = (a * b + c) * -b
    assert decoded.similarity(a) > 0.3 > 0.1 > abs(decoded.similarity(b))


@pytest.mark.parametrize(("kind", "size"), SELF_INVERSE + OTHERS)
def test_bundles(spark, kind, size):
    vsa = kind(42)
    a, b, c = (vsa.random_vector(size) for _ in range(3))
    assert not a.equals(b) and a.similarity(a) == pytest.approx(1.0) and abs(a.similarity(b)) < 0.1
    loose = a.bundle_unnormalized(b)
    assert isinstance(loose, api.UnnormalizedVector) and loose.size() == size
    if vsa.architecture() != "BinarySpatterCode":
        assert loose.normalize().equals(a.bundle(b)) and (a + b).equals(a.bundle(b))
        assert (loose + c).equals(c.bundle_unnormalized(loose))
        np.testing.assert_allclose(loose.bundle_accumulators(loose).data, 2 * loose.data)
    # The accumulator stands left, whichever side it was on.
    assert (c * loose).equals(loose * c) and (loose * c).equals(loose.bind(c))
    assert a.permute(3).permute(size - 3).equals(a)


def test_from_normalized():
    for vsa, numbers in ((api.MultiplyAddPermute(1), [1, -1, 1]), (api.BinarySpatterCode(1), [0, 1, 1]), (api.HolographicReducedRepresentation(1), [0.6, 0.8])):
        made = vsa.from_normalized(numbers)
        assert isinstance(made, api.Vector) and list(made) == numbers
    for vsa, numbers in ((api.MultiplyAddPermute(1), [1, 0]), (api.BinarySpatterCode(1), [2]), (api.VectorDerivedTransformationBinding(1), [1.0, 0.0])):
        with pytest.raises(ValueError):
            vsa.from_normalized(numbers)


def test_row_tables(spark):
    """Vectors of rows as a table, with a column that has the name of the helper."""
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "_order int, kind string, form string")
    vsa = api.MultiplyAddPermute(42)
    storage = api.Storage.from_dataframe(vsa, 64, df.select("kind", "form"))
    found = storage.subset(df.select("kind", "form"), order_by=None).rows("bind")
    assert "vector" in found.columns and found.count() == 2
    ordered = storage.subset(df, order_by="_order")
    assert [v.to_list() for v in ordered.bind_rows()] == [storage.execute(t).to_list() for t in ("kind * a * (form * x)", "kind * b")]
    assert {r["name"] for r in storage.similarity_table(storage.get("a")).collect()} == {"a", "b", "x", "kind", "form"}
    with pytest.raises(ValueError, match="unknown fold"):
        ordered.rows("sum")


def test_numbers():
    vsa = api.MultiplyAddPermute(1)
    v = vsa.parse([-1.0, 0.0, 2.0])
    assert list(v) == [-1, 1, 1] and v.to_list() == [0.0, 1.0, 1.0] and v[0] == -1 and len(v) == 3
    assert v.bundle_unnormalized(v).to_list() == [-2.0, 2.0, 2.0]
    assert api.BinarySpatterCode(1).parse([0.5, 0.4]).to_list() == [1.0, 0.0]
    assert api.VectorDerivedTransformationBinding(1).parse([1.0, 2.0]) is None and vsa.parse([1.0], 2) is None


def test_messages(spark):
    with pytest.raises(NotImplementedError, match="create_storage must be implemented"):
        api.VSA().create_storage(10)
    with pytest.raises(ValueError, match="size must be > 0"):
        api.MultiplyAddPermute(1).create_storage(0)
    with pytest.raises(ValueError, match="invalid vector size"):
        api.VectorDerivedTransformationBinding(1).create_storage(128)
    with pytest.raises(ValueError, match="differ in size"):
        api.MultiplyAddPermute(1).random_vector(4) * api.MultiplyAddPermute(1).random_vector(5)
    vsa = api.MultiplyAddPermute(42)
    storage = vsa.create_storage(128)
    assert storage.get("abc") is None and storage.values() == [] and storage.find(vsa.random_vector(128)) is None
    assert storage.push("abc").equals(storage.push("abc")) and storage.values() == ["abc"]
    storage.extend(["abc", "def"])
    assert storage.execute("abc * def").equals(storage.get("abc") * storage.get("def"))
    with pytest.raises(ValueError, match="Unknown value: x"):
        storage.execute("x")
    with pytest.raises(ValueError, match="not a table"):
        storage.subset([1])
    assert repr(vsa) == "VSA(architecture=MultiplyAddPermute)"
    assert repr(storage) == "MapStorage(size=128, columns=0, values=2)" and repr(storage.get("abc")) == "MapVector(size=128)"


def test_symbols_are_functions_of_seed_and_name(spark):
    one, two = api.MultiplyAddPermute(42).create_storage(64), api.MultiplyAddPermute(42).create_storage(64)
    other = api.MultiplyAddPermute(42, stream="b").create_storage(64)
    two.push("first")
    assert one.push("a").equals(two.push("a")) and not one.push("a").equals(other.push("a"))
