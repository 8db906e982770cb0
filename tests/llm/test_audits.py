"""Filter audit, source divergence and suffix dedup: plain Python forms and odd tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from counterfair.llm import divergence, filters, suffixes
from counterfair.llm.queries import FAILURES

LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, 0, 1), (5, None, None), (9, 1, 0), (None, 1, 1)]
WORD = re.compile("[^\x20\x09-\x0d]+")


def _audit(rows, labels):
    fails = []
    for i, text, part in rows:
        t = text or ""
        words = WORD.findall(t)
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        failed = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": re.search("[#$%&*|]", t) is not None,
            "E": copy,
        }
        mine = [x for x in labels if i is not None and x[0] == i]
        good, toxic = any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)
        fails.append((part or "", {k for k, v in failed.items() if v}, good, toxic))
    out, shapley = {}, Counter()
    for part in {f[0] for f in fails}:
        for order in permutations("ABCDE"):
            left = [f for f in fails if f[0] == part]
            for k, letter in enumerate(order):
                gone = [f for f in left if letter in f[1]]
                left = [f for f in left if letter not in f[1]]
                all_failing = sum(letter in f[1] for f in fails if f[0] == part)
                alone = sum(f[1] == {letter} for f in fails if f[0] == part)
                shapley[part, letter] += len(gone)
                out[part, "".join(order), k + 1] = [
                    len(left), len(gone), all_failing - len(gone), alone, sum(f[2] for f in gone), sum(f[3] for f in gone)
                ]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_path_counts_are_those_of_all_orders():
    forward, backward = filters.path_counts(4)
    reached = Counter(sum(1 << i for i in order[:k]) for order in permutations(range(4)) for k in range(5))
    assert all(forward[s] * backward[s] == n for s, n in reached.items())


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_filter_audit(request, spark, table):
    docs = request.getfixturevalue(table)
    docs = docs.union(docs.where("doc_id % 3 = 0").withColumn("doc_id", docs["doc_id"] + 100_000))
    labels = spark.createDataFrame(LABELS, "doc_id BIGINT, quality INT, toxic INT")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    got = filters.filter_audit(docs, FAILURES, labels, copies="E").collect()
    assert {(r[0], r[1], r[2]): tuple(r)[3:] for r in got} == _audit(rows, LABELS) and len(got) == 600 * len({r[2] or "" for r in rows})


def test_audits_of_empty_tables(spark, empty, odd):
    labels = spark.createDataFrame([], "doc_id BIGINT, quality INT, toxic INT")
    assert filters.filter_audit(empty, FAILURES, labels, copies="E").count() == 0
    assert filters.filter_audit(odd, FAILURES, labels, copies="E").where("good_lost > 0 OR toxic_lost > 0").count() == 0
    assert divergence.source_divergence(empty).count() == 0
    assert suffixes.suffix_dedup(empty).count() == 0 and suffixes.maximal_repeats(empty).count() == 0


def _divergence(rows, min_docs=3, scale=10**9, top=200):
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        words = term.findall("".join(c.lower() if c < "\x80" else c for c in text or ""))
        count[lang, source].update(words)
        docs[lang].update(set(words))
    out = set()
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)
        whole = Counter()
        for s in sources:
            whole.update(count[lang, s])

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + scale * (counts[t] + 1) // (total + len(kept)) for t in kept}

        share = {s: shares(count[lang, s]) for s in sources}
        q = shares(whole)
        for s, p in share.items():
            pairs = [(-sum((p[t] - o[t]) ** 2 // o[t] for t in kept), x) for x, o in share.items() if x != s]
            terms = [(-((p[t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if count[lang, s][t] and p[t] > q[t]]
            out |= {(lang, s, "pair", x, -v, k + 1) for k, (v, x) in enumerate(sorted(pairs))}
            out |= {(lang, s, "term", t.decode(), -v, k + 1) for k, (v, t) in enumerate(sorted(terms)[:top])}
    return out


def test_terms_are_sent_within_a_batch(monkeypatch):
    monkeypatch.setattr(divergence, "HELD_TERMS", 10)
    texts = ["".join(chr(97 + i // 10) + chr(97 + (i + j) % 10) + " " for j in range(4)).encode() for i in range(60)]
    names = ["lang", "source", "text"]
    batch = pa.record_batch([pa.array(["en"] * 60), pa.array([str(i % 2) for i in range(60)]), pa.array(texts, pa.binary())], names=names)
    sent = list(divergence._count_terms([batch]))
    assert len(sent) > 5 and max(b.num_rows for b in sent) < 10 + 4
    got, want = Counter(), Counter()
    for r in (r for b in sent for r in b.to_pylist()):
        got[r["source"], r["term"]] += r["n"]
        assert r["n"] == r["docs"]
    for i, t in enumerate(texts):
        want.update((str(i % 2), w) for w in t.decode().split())
    assert got == want


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_source_divergence(request, monkeypatch, table):
    docs = request.getfixturevalue(table)
    rows = [(r["text"], r["lang"], r["source"]) for r in docs.collect()]
    got = divergence.source_divergence(docs).collect()
    assert {tuple(r) for r in got} == _divergence(rows) and len(got) == len(_divergence(rows))


def test_products_in_small_blocks_and_tiles(monkeypatch):
    rng = np.random.default_rng(5)
    counts = rng.poisson(0.6, (500, 7)) * rng.integers(1, 400, (500, 1))
    totals = counts.sum(axis=0).tolist()

    def share(g, c):
        return 1 + 10**9 * (int(c) + 1) // (totals[g] + 500)

    want = [[sum((share(g, a) - share(h, b)) ** 2 // share(h, b) for a, b in zip(counts[:, g], counts[:, h])) for h in range(7)] for g in range(2, 6)]
    for rows, columns in ((4096, 2048), (64, 40), (8, 8)):
        monkeypatch.setattr(divergence, "ROWS", rows)
        monkeypatch.setattr(divergence, "COLUMNS", columns)
        monkeypatch.setattr(divergence, "LEAST_ROWS", min(rows, 64))
        assert divergence.pair_sums(counts, 2, 6, totals, 500, 10**9).tolist() == want


def test_terms_of_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 10)
    text = ("abc def-ghi " * 9 + "x" * 50 + " é日本 end").encode()
    assert [t for found in divergence.term_lists(text) for t in found] == divergence.TERM.findall(text)


def _cut(rows, width):
    first = {}
    for i, t in rows:
        for s in range(len(t) - width + 1) if i is not None else ():
            g = t[s : s + width]
            first[g] = min(first.get(g, i), i)
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        for s in range(len(t) - width + 1) if i is not None else ():
            if first[t[s : s + width]] < i:
                gone[s : s + width] = b"\1" * width
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        out.append((i, hashlib.sha256(kept).hexdigest(), len(t), spans))
    return sorted(out, key=str)


def _texts(seed, n):
    """Passages in many places, periodic texts, copies, single-letter alphabets, ends and starts in common."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 4)))
    passages = [" ".join(word() for _ in range(rng.randint(8, 60))) for _ in range(8)] + ["ab" * 60, "a" * 130, "\x00" * 70]
    out = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            parts.append(p[a : a + rng.randint(20, 400)] if rng.random() < 0.5 else p)
            parts.append(word())
        out.append((rng.randint(0, n), "".join(parts)))
    return out


@pytest.mark.parametrize("hot, chunk", [(32, 8 << 20), (2, 1500)])
def test_suffix_dedup(spark, monkeypatch, hot, chunk):
    rows = _texts(hot, 400)
    docs = spark.createDataFrame([*rows, (None, rows[0][1]), (7, None), (8, "")], "doc_id BIGINT, text STRING").repartition(5)
    monkeypatch.setattr(suffixes, "HOT", hot)  # reaches the tasks by value below, the module's own as it is on workers
    monkeypatch.setattr(suffixes, "CHUNK_BYTES", chunk)
    got = suffixes.suffix_dedup(docs).collect()
    plain = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    mine = sorted(((r["doc_id"], hashlib.sha256(bytes(r["kept"])).hexdigest(), r["n_bytes"], [tuple(s) for s in r["spans"]]) for r in got), key=str)
    assert mine == _cut(plain, 50)


def _plain_parts(rows, width, bits):
    """The exchange without Spark, on one chunk per document: as many chunks as make runs hot."""
    import pandas as pd

    chunks = []
    for n, (i, t) in enumerate(rows):
        chunks.append((n, suffixes._pack(np.array([i])), suffixes._pack(np.array([len(t)])), suffixes.zstandard.compress(t)))
    table = pd.DataFrame(chunks, columns=["chunk", "ids", "sizes", "body"])
    import pyarrow as pa

    sent = pd.concat([b.to_pandas() for b in suffixes._send_keys([pa.RecordBatch.from_pandas(table)], width, bits)])
    answers = pd.concat([suffixes._answer_keys(g) for _, g in sent.groupby("part")])
    contexts = pd.concat([suffixes._send_contexts(table[table["chunk"] == n], answers[answers["chunk"] == n], width, bits) for n in table["chunk"]])
    told = pd.concat([*(suffixes._repeats(g, width, False) for _, g in contexts.groupby("part")), answers])
    return pd.concat([suffixes._cut(table[table["chunk"] == n], told[told["chunk"] == n], width) for n in table["chunk"]]), contexts


@pytest.mark.parametrize("hot", [2, 5, 10_000])
def test_hot_runs_are_split_without_loss(monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    rows = [(i, t.encode()) for i, t in _texts(3, 120)]
    out, _ = _plain_parts(rows, 50, 4)
    mine = [(i, hashlib.sha256(k).hexdigest(), n, [(s["start"], s["stop"]) for s in sp]) for i, k, n, sp in out.itertuples(index=False)]
    assert sorted(mine, key=str) == _cut(rows, 50)


def test_intervals_against_all_pairs():
    rng = random.Random(1)
    words = sorted("".join(rng.choice("ab") for _ in range(rng.randint(3, 9))) for _ in range(60))
    common = [0] + [next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b))) for a, b in zip(words, words[1:])]
    left = [rng.randint(0, 1) for _ in words]
    ids = [rng.randint(0, 9) for _ in words]
    got = suffixes.intervals(np.array(common), np.array(left), np.array(ids), np.array(ids), 3)
    want = set()
    for a in range(len(words)):
        for b in range(a + 1, len(words)):
            c = min(common[a + 1 : b + 1])
            maximal = common[a] < c and (b + 1 == len(words) or common[b + 1] < c)
            if c >= 3 and maximal and len(set(left[a : b + 1])) > 1 and len(set(ids[a : b + 1])) > 1:
                want.add((a, b, c, min(ids[a : b + 1])))
    assert set(got) == want and len(got) == len(want)


def test_maximal_repeats_list_all_occurrences(spark, odd):
    passage = "It was one long passage of text, which three documents share between their own words."
    texts = [(1, "a first " + passage + " one"), (2, "second: " + passage + " two"), (3, "and 3rd " + passage + " 3"), (4, "nothing like the others, nothing at all, it is alone.")]
    found = suffixes.maximal_repeats(spark.createDataFrame(texts, "doc_id BIGINT, text STRING")).collect()
    by_id = defaultdict(set)
    for r in found:
        t = dict(texts)[r["doc_id"]]
        by_id[r["repeat_id"]].add((r["doc_id"], t[r["start"] : r["start"] + r["length"]]))
    assert by_id and all(len({t for _, t in held}) == 1 and {i for i, _ in held} == {1, 2, 3} for held in by_id.values())
    covered = {k for r in found if r["doc_id"] == 3 for k in range(r["start"], r["start"] + r["length"])}
    assert covered == set(range(7, 7 + len(passage) + 2))
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in odd.collect()]
    got = suffixes.suffix_dedup(odd).collect()
    mine = sorted(((r["doc_id"], hashlib.sha256(bytes(r["kept"])).hexdigest(), r["n_bytes"], [tuple(s) for s in r["spans"]]) for r in got), key=str)
    assert mine == _cut(rows, 50)
