"""Mixing, WARC archives, line dedup and vectors: odd tables and brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from counterfair.llm import lines, mixing, vectors, warc


def test_mix_stays_within_one_block(spark):
    rows = [(i, s) for s, n in (("a", 50), ("b", 7), ("c", 3)) for i in range(n)]
    weights = {"a": 5, "b": 3, "c": 2}
    out = mixing.mix(spark.createDataFrame(rows, "doc_id BIGINT, source STRING"), weights, block_rows=2).collect()
    slots = {r["slot"]: r["cls"] for r in out}
    order = [slots[t] for t in range(len(slots))]
    for cls, w in weights.items():
        had = np.cumsum([c == cls for c in order])
        assert np.abs(had - np.arange(1, len(order) + 1) * w / 10).max() < 1
    assert {(r["row"]["doc_id"], r["cls"]) for r in out if r["epoch"] == 0} == set(rows)
    again = Counter((r["row"]["doc_id"], r["cls"], r["epoch"]) for r in out)
    assert max(again.values()) == 1
    assert len({r["position"] for r in out}) == len(out)


def test_mix_odd_and_empty(odd, empty):
    out = mixing.mix(odd, {"src0": 2, "src1": 1}, block_rows=1).collect()
    assert Counter(str(r["row"]) for r in out if r["epoch"] == 0) == Counter(str(r) for r in odd.collect())
    assert mixing.mix(empty, {"src0": 2}).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(odd, {"src0": 0})
    with pytest.raises(ValueError):
        mixing.mix(odd, {"src0": mixing.MAX_FRAME + 1})


def test_warc_round_trip(spark):
    big = "<p>é</p>" * 300
    rows = [(1, "http://a", big), (2, None, big), (2, "http://b", big), (3, "x\r\ny", None), (4, "http://c", ""), (None, "http://d", big)]
    pages = spark.createDataFrame(rows + [(5, "u", "small"), (6, "u", "small")], "page_id BIGINT, url STRING, html STRING")
    index = warc.archive(pages)
    got = warc.read(index).collect()
    assert len(got) == 8
    sha = hashlib.sha1(big.encode()).hexdigest()
    kinds = {(r["page_id"], r["record_type"], r["refers_to"]) for r in got if r["digest"] == sha}
    assert kinds == {(1, "revisit", 2), (2, "response", None), (None, "revisit", 2)}
    assert all(r["payload_bytes"] == len(big.encode()) for r in got if r["digest"] == sha)
    assert all(r["payload"] == big.encode() for r in got if r["page_id"] == 2)
    assert {r["record_type"] for r in got if r["page_id"] in (5, 6)} == {"response"}
    some = warc.read(index.where("page_id = 4")).collect()
    assert [(r["payload"], r["payload_bytes"]) for r in some] == [(b"", 0)]
    assert warc.read(warc.archive(pages.limit(0))).count() == 0


def test_warc_refuses_a_changed_payload(spark):
    index = warc.archive(spark.createDataFrame([(1, "u", "text")], "page_id BIGINT, url STRING, html STRING"))
    with pytest.raises(Exception, match="does not match"):
        warc.read(index.selectExpr("page_id", "url", "file", "offset", "length", "'0' AS digest", "record_type", "refers_to")).collect()


def test_lines_odd(odd, empty):
    out = lines.line_dedup(odd, min_docs=4).collect()
    got = {}
    for r in out:
        got.setdefault(r["row"]["doc_id"], []).append((r["text"], r["n_lines"], r["n_dropped"]))
    line = "The same line of text, long enough to count here."
    assert got[1] == [("short\n", 3, 1)]
    assert got[2] == [("other words", 2, 1)] * 2
    assert got[3] == [("", 1, 1)]
    assert got[4] == [(line, 1, 0)]  # the largest id keeps it
    assert got[5] == got[6] == [("", 1, 0)]
    assert got[None] == [(line + "\nno id", 2, 0)]
    assert len(out) == 12
    assert lines.line_dedup(empty).count() == 0


def _links(vecs, threshold=0.95):
    x = np.array(vecs, dtype=float)
    n = np.linalg.norm(x, axis=1)
    return (x @ x.T) / np.outer(n, n) >= threshold


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    x = np.concatenate([c + rng.normal(size=(25, 16)) * s for c, s in zip(centres, np.linspace(0.02, 0.4, 12))])
    x = np.concatenate([x, x[:40], 3 * x[:5]])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    got = {r["vec_id"]: r for r in vectors.near_vectors(frame).collect()}
    near = _links(x)
    label = np.arange(len(x))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    assert [got[i]["n_links"] for i in range(len(x))] == (near.sum(axis=1) - 1).tolist()
    assert [got[i]["component_id"] for i in range(len(x))] == label.tolist()
    assert all(got[i]["kept"] == (i == label[i]) for i in range(len(x)))


def test_compare_never_loses_a_pair(monkeypatch):
    monkeypatch.setattr(vectors, "STEPS", (2, 3))
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 6))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    turned = unit @ np.linalg.eigh(unit.T @ unit)[1][:, ::-1]
    a, b = vectors.compare(x, x, turned, turned, 0.9)
    assert set(zip(a.tolist(), b.tolist())) == set(zip(*(v.tolist() for v in np.nonzero(_links(x, 0.9)))))


def test_vectors_odd(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, []), (6, [float("nan"), 1.0]), (7, [None, 1.0])]
    rows += [(8, [float("inf"), 1.0]), (None, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, [-0.0, -1.0]), (11, [0.0, -1.0]), (1, [1.0, 0.0])]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>")).collect()
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"], r["kept"]))
    assert by[1] == [(2, 1, True)] * 2 and by[2] == [(2, 1, False)]
    assert by[10] == [(1, 10, True)] and by[11] == [(1, 10, False)]
    assert all(by[i] == [(0, i, True)] for i in (3, 4, 5, 6, 7, 8, 9))
    assert by[None] == [(0, None, False)]
    none = spark.createDataFrame([], "vec_id BIGINT, embedding ARRAY<FLOAT>")
    assert vectors.near_vectors(none).count() == 0
