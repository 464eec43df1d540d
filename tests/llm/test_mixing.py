import pytest

from braidflow.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, target double"


def rows():
    out = [(i, "w " * (i % 7), f"s{i % 5}", "x", 1.0) for i in range(200)]
    out += [(1000 + i, "a b\tc", None, "x", 1.0) for i in range(20)] + [(2000, None, "zero", "x", 1.0), (2001, "", "zero", "x", 1.0), (2002, "x " * 5000, "long", "x", 1.0)]
    return out + [(7, "w w", "s0", "x", 1.0), (7, "w w", "s0", "x", 1.0), (None, "w w w", "Z", "x", 1.0), (None, "w", "Z", "x", 1.0)]


def wanted(sizes, max_epochs=2, share=1.5):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, total, out = set(names), share * sum(sizes.values()), {}
    while left:
        level = total / sum(weight[s] for s in left)
        over = {s for s in left if weight[s] * level > max_epochs * sizes[s]}
        if not over:
            return out | {s: weight[s] * level for s in left}
        for s in over:
            out[s] = max_epochs * sizes[s]
            total -= out[s]
        left -= over
    return out


@pytest.mark.parametrize("broadcast", [True, False])
def test_targets_and_taken(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(mixing, "BROADCAST_BYTES", -1)
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    got = mixing.mix(docs).select("doc_id", "source", "text", "__size", "__source_size", "__target", "__taken").collect()
    assert len(got) == len(rows())
    sizes, taken = {}, {}
    for r in got:
        assert r["__size"] == len((r["text"] or "").split())
        assert 0 <= r["__taken"] <= 2 * r["__size"]
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["__size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["__taken"]
    want = wanted(sizes)
    for r in got:
        assert r["__source_size"] == sizes[r["source"]] and r["__target"] == pytest.approx(want[r["source"]])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    again = mixing.mix(docs.repartition(3)).select("doc_id", "__size", "__taken").collect()
    assert sorted((str(r["doc_id"]), r["__size"], r["__taken"]) for r in again) == sorted((str(r["doc_id"]), r["__size"], r["__taken"]) for r in got)


def test_mixed_documents_hold_what_was_taken(spark):
    docs = spark.createDataFrame([r[:3] for r in rows()], "doc_id long, text string, source string")
    taken = sum(r["__taken"] for r in mixing.mix(docs).select("__taken").collect())
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert sum(len((r["text"] or "").split()) for r in out.collect()) == taken


def test_empty(spark):
    assert mixing.mix_sizes(spark.createDataFrame([], SCHEMA)).collect() == []
    nothing = spark.createDataFrame([(1, None, "a", "x", 1.0), (2, "", None, "x", 1.0)], SCHEMA)
    assert {r["taken"] for r in mixing.mix_sizes(nothing).collect()} == {0}
