import pytest

from caseloom.llm import mixing


def test_positions(documents):
    rows = mixing.mix(documents).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(documents.count()))
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in documents.collect())


@pytest.mark.parametrize("weights", [None, {"a": 5, "b": 1, "c": 3, None: 2}, {"b": 7}])
def test_odd_rows(odd_docs, weights):
    placed = mixing.mix(odd_docs, weights)
    assert placed.count() == odd_docs.count()
    assert sorted(r.position for r in placed.collect()) == list(range(odd_docs.count()))
    assert {"position", "weight", "block"} <= set(placed.columns)
    ordered = mixing.mixed_order(odd_docs, weights)
    assert ordered.columns == odd_docs.columns
    assert sorted(map(repr, ordered.collect())) == sorted(map(repr, odd_docs.collect()))


def test_empty(no_docs):
    assert mixing.mix(no_docs).collect() == [] and mixing.mixed_order(no_docs).collect() == []


@pytest.mark.parametrize("quotas", [{"a": 5, "b": 3, "c": 1}, {"a": 97, "b": 1, "c": 1, "d": 1}, {"a": 1}, {f"s{i}": i % 7 + 1 for i in range(40)}])
def test_less_than_one_block_off(quotas):
    slots = mixing.schedule(quotas)
    length = sum(quotas.values())
    owner = {slot: key for key, own in slots.items() for slot in own}
    assert sorted(owner) == list(range(length))
    had = dict.fromkeys(quotas, 0)
    for t in range(length):
        had[owner[t]] += 1
        assert all(abs(had[key] * length - quotas[key] * (t + 1)) < length for key in quotas)


def test_share_at_every_prefix(spark):
    rows = [(i, "ab"[i % 3 == 0]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    order = [r.source for r in mixing.mix(docs, {"a": 3, "b": 1}).orderBy("position").collect()]
    for t in range(1, 500):
        assert abs(order[:t].count("a") - 0.75 * t) < 1


def test_many_sources_keep_their_shares():
    """The largest of many sources gets what it wants, small ones no more than a slot of a round."""
    for sources in (1, 5, 50, 200, 1000):
        counts = {f"s{i}": 10_000_000 // (i + 1) for i in range(sources)}
        weights = mixing.root_weights(counts)
        total, roots = sum(weights.values()), {k: n ** 0.5 for k, n in counts.items()}
        for key, n in roots.items():
            want = n / sum(roots.values())
            assert abs(weights[key] / total - want) <= 1.5 / mixing.resolution_of(sources), (sources, key)


def test_columns_of_any_name_and_kind(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2], {"k": i}, i, "x", 0.5) for i in range(40)],
                                 "doc_id long, source string, attributes map<string, long>, _mix_weight long, `a.b` string, position double")
    got = mixing.placed(docs, {"a": 3, "b": 1}, "place")
    assert got.columns == [*docs.columns, "place"]
    rows = got.collect()
    assert sorted(r.place for r in rows) == list(range(40)) and {r.position for r in rows} == {0.5}
    assert mixing.mixed_order(docs).columns == docs.columns
