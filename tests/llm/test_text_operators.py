"""Scores, fingerprints, near duplicates, passages and tokens: odd tables and brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import sentencepiece

from counterfair.llm import context_tree, fingerprint, jaccard, passages, quality, sentencepieces, words

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def split(text):
    return WORD.findall((text or "").encode().lower())


def test_words_are_those_of_the_pattern():
    texts = ["", " ", "a", " A b\tB\x0bc\x1c\xa0d ", "é É x" * 50, "日本 語\n"]
    w = words.Words([words.lowered(t) for t in texts])
    seen = {}
    for i, t in enumerate(texts):
        assert len(w.of(i)) == len(split(t))
        for h, x in zip(w.of(i).tolist(), split(t)):
            assert seen.setdefault(h, x) == x
    assert len(seen) == len({x for t in texts for x in split(t)})


def _base(rows):
    held = {i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i, _ in rows}
    count = Counter(x for i, t in rows if not held[i] for x in [*split(t), None])
    n, v = sum(count.values()), len(count)
    return {(i, t or ""): (len(split(t)) + 1, sum(count[x] > 0 for x in [*split(t), None]), n, held[i],
                           sum(math.log10((count[x] + 1) / (n + v + 1)) for x in [*split(t), None])) for i, t in rows}


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_context_tree_base_score(request, table):
    docs = request.getfixturevalue(table)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = sorted(_base(rows).items(), key=lambda x: str(x))
    got = context_tree.score_texts(docs).collect()
    assert len(got) == len(rows)
    mine = {}
    for r in got:
        mine.setdefault(r["doc_id"], r)
    for (i, _), (n, known, total, held, base) in want:
        r = mine[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, total, held)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        assert r["score"] < 0 and math.isfinite(r["score"])


def _tree_probability(train, text, depth):
    """Plain recursive context-tree weighting; contexts as byte strings, nodes as (context, bits above)."""
    counts = defaultdict(lambda: [0, 0])
    longer = defaultdict(set)
    for t in train:
        data = bytes(depth) + t + b"\0"
        for k in range(depth, len(data)):
            for bit in range(8):
                above, one = (1 << bit) | data[k] >> (8 - bit), data[k] >> (7 - bit) & 1
                for d in range(depth + 1):
                    counts[data[k - d : k], above][one] += 1
                    if d < depth:
                        longer[data[k - d : k], above].add(data[k - d - 1 : k])

    def own(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(context, above):
        pe = own(*counts[context, above])
        if len(context) == depth:
            return pe
        below = sum(weighted(c, above) for c in longer[context, above])
        return np.logaddexp(pe, below) - math.log(2)

    total = 0.0
    data = bytes(depth) + text + b"\0"
    for k in range(depth, len(data)):
        for bit in range(8):
            above, one = (1 << bit) | data[k] >> (8 - bit), data[k] >> (7 - bit) & 1
            estimate = []
            for d in range(depth + 1):
                zeros, ones = counts.get((data[k - d : k], above), (0, 0))
                estimate.append((ones + 0.5) / (zeros + ones + 1) if zeros + ones or d == 0 else estimate[-1])
            p = estimate[depth]
            for d in range(depth - 1, -1, -1):
                c = data[k - d : k]
                if (c, above) in counts:
                    w = math.exp(own(*counts[c, above]) - weighted(c, above)) / 2
                    p = w * estimate[d] + (1 - w) * p
            total += math.log10(p if one else 1 - p)
    return total


def test_context_tree_against_recursion(spark):
    rows = [(i, t) for i, t in enumerate(["abab", "abba", "", "b a", "abab é", "cab", "baab", None, "aaaaaaa", "zz"])]
    got = {r["doc_id"]: r for r in context_tree.score_texts(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"), depth=2).collect()}
    train = [(t or "").encode() for i, t in rows if not context_tree.is_held_out(i)]
    assert any(r["held_out"] for r in got.values())
    for i, t in rows:
        assert math.isclose(got[i]["score"], _tree_probability(train, (t or "").encode(), 2), rel_tol=1e-9)


def test_context_tree_empty(empty):
    assert context_tree.score_texts(empty).count() == 0


def test_quality_learns(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").selectExpr("doc_id", "quality AS label")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = quality.train(docs, labels.where(quality.is_training(labels["doc_id"])))
    rows = quality.score(docs, model).select("row.doc_id", "score").join(labels.where(~quality.is_training(labels["doc_id"])), "doc_id").collect()
    right = [(r["score"] >= 0.3) == (r["label"] == 1) for r in rows]
    assert len(rows) > 50 and sum(right) / len(right) > 0.95


def test_quality_odd(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, None), (None, 1), (4, 7), (99, 0)], "doc_id BIGINT, label INT")
    out = quality.score(odd, quality.train(odd, labels)).collect()
    assert len(out) == 12 and all(0 <= r["score"] <= 1 for r in out)
    assert {str(r["row"]) for r in out} == {str(r) for r in odd.collect()}
    plain = quality.train(odd, labels.limit(0))
    assert {r["score"] for r in quality.score(odd, plain).collect()} == {0.5}
    assert quality.score(empty, plain).count() == 0


def test_trees_walk_as_one_row_at_a_time():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    trees = quality.fit(x, y, trees=20, depth=3)
    for row, s in zip(x[:30], trees.score(x)[:30]):
        raw = trees.base
        for f, c, leaf in zip(trees.feature, trees.cut, trees.leaf):
            node = 1
            for _ in range(3):
                node = 2 * node + int(row[f[node]] > c[node])
            raw += leaf[node - 8]
        assert math.isclose(s, 1 / (1 + math.exp(-raw)), rel_tol=1e-12)
    assert ((trees.score(x) > 0.5) == y).mean() > 0.9


def _digests(text):
    return set(fingerprint.Digests([text.encode()]).keys.tolist())


def test_fingerprints_against_sets(documents):
    rows = sorted((r["doc_id"], r["text"]) for r in documents.collect())
    got = {r["doc_id"]: r for r in fingerprint.fingerprint_versions(documents).collect()}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        e = fingerprint.edited(t, following)
        assert got[i]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        gone, new = ({x % 2**64 for x in got[i][c]} for c in ("lost", "gained"))
        assert (gone, new) == (_digests(t) - _digests(e), _digests(e) - _digests(t))
        for name, other in (("near_edited", e), ("near_next", following)):
            a, b = _digests(t), _digests(other)
            assert math.isclose(got[i][name], len(a & b) / len(a | b) if a | b else 1, abs_tol=1e-12)
    assert np.mean([r["near_edited"] > r["near_next"] for r in got.values()]) > 0.95


def _plain_mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 % 2**64
    x ^= x >> 27
    x = x * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


def _paragraphs(text):
    """Paragraphs with how often each came before, cut byte by byte."""
    out, start, seen = [], 0, Counter()
    for k, byte in enumerate(text):
        last = sum(text[k - back] << 8 * back for back in range(4) if k >= back)
        mask = next(m for limit, m in fingerprint.CUTS if k < limit)
        if byte == 10 or k + 1 == len(text) or _plain_mix(last) & mask == 0:
            p = text[start : k + 1]
            out.append((p, seen[p]))
            seen[p] += 1
            start = k + 1
    return out


def test_digests_stand_for_paragraphs(documents, odd):
    texts = [(r["text"] or "").encode() for t in (documents.limit(60), odd) for r in t.collect()]
    texts += [b"", b"\n", b"\n\n\n", b"ab" * 700]
    of = {}
    d = fingerprint.Digests(texts)
    for i, t in enumerate(texts):
        mine = set(_paragraphs(t))
        keys = set(d.keys[d.bounds[i] : d.bounds[i + 1]].tolist())
        assert len(keys) == len(mine)
        one = fingerprint.Digests([t])
        assert set(one.keys.tolist()) == keys
        of[i] = (mine, keys)
    for i in range(0, len(texts) - 1):
        (m1, k1), (m2, k2) = of[i], of[i + 1]
        assert len(m1 & m2) == len(k1 & k2)


def test_differing_digests_are_recovered(documents):
    texts = [r["text"] for r in documents.orderBy("doc_id").limit(80).collect()] + ["", "x"]
    changed = [t if k % 4 == 0 else t[: len(t) // 3] + " new words here " + t[len(t) // 3 :] if k % 4 == 1 else texts[k - 1] for k, t in enumerate(texts)]
    a, b = (fingerprint.Digests([t.encode() for t in x]) for x in (texts, changed))
    every = np.arange(len(texts))
    pair, keys, sign = fingerprint.differences(a, every, b, every)
    small = 0
    for k in range(len(texts)):
        one, two = _digests(texts[k]), _digests(changed[k])
        mine = [{int(x) for x in keys[(pair == k) & (sign == s)]} for s in (1, -1)]
        assert mine == [one - two, two - one]
        found = fingerprint.subtract(fingerprint.fingerprints(a, len(texts))[k], fingerprint.fingerprints(b, len(texts))[k])
        small += found is not None
        assert found in (None, (sorted(one - two), sorted(two - one)))
        assert fingerprint.changed_digests(texts[k], changed[k]) == (sorted(one - two), sorted(two - one))
    assert small >= len(texts) // 3


def test_fingerprints_odd(odd, empty, spark):
    out = fingerprint.fingerprint_versions(odd).collect()
    assert len(out) == 12
    twins = [r for r in out if r["doc_id"] == 2]
    assert len({r["fingerprint"] for r in twins}) == 1 and max(r["near_next"] for r in twins) == 1
    assert {r["doc_id"]: r["n_chars"] for r in out}[5] == 0
    assert fingerprint.fingerprint_versions(empty).count() == 0
    one = fingerprint.fingerprint_versions(spark.createDataFrame([(1, "abcdefgh")], "doc_id BIGINT, text STRING")).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and one[0]["near_next"] == 1


def _classes(rows):
    sets = {}
    for i, t in rows:
        w = split(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    of = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = of[i], of[j]
                of = {k: min(a, b) if v in (a, b) else v for k, v in of.items()}
    return {i: (len(sets[i]), of[i]) for i in sets}


def test_jaccard_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for family in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 8, 40, 120]))]
        for _ in range(12):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                k = rng.randrange(len(t) + 1)
                t[k : k + rng.randint(0, 1)] = [f"w{rng.randrange(400)}"] * rng.randint(0, 1)
            rows.append((len(rows), " ".join(t)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in
           jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect()}
    assert got == _classes(rows)


def test_jaccard_odd(odd, empty):
    out = jaccard.near_duplicates(odd).collect()
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out}
    assert len(out) == 12
    assert by[1][1] == by[3][1] == by[4][1] == 1 and by[2][1] == 2  # 6 of 7 shingles, 6 of 8
    assert by[5] == (0, 5) and by[6] == (0, 6) and by[7] == (0, 7)
    assert by[9] == (1, 9) and by[10] == (1, 10) and by[None][1] is None
    assert jaccard.near_duplicates(empty).count() == 0


def test_chain_follows_the_order():
    at = np.array([0, 5, 10, 15, 20, 25])
    other = np.array([100, 105, 3, 112, 117, 122])
    best = passages.chain(at, other)[0]
    assert at[best].tolist() == [0, 5, 15, 20, 25]


def test_passages_against_brute_force(spark):
    rng = random.Random(9)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    shared = [fresh(70), fresh(60)]
    fuzzy = [w if k % 12 else "changed" for k, w in enumerate(shared[0])]
    texts = [fresh(80) + shared[0] + fresh(30), shared[0] + fresh(90) + shared[1], fresh(10) + fuzzy + fresh(5)]
    texts += [shared[1] + fresh(4), fresh(200), fresh(20) + shared[0][:30] + fresh(20), fresh(3)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id BIGINT, text STRING")
    got = {(r["doc_id"], r["other_id"]): r for r in passages.shared_passages(docs).collect()}
    assert set(got) == {(1, 0), (2, 0), (3, 1)}
    assert (got[1, 0]["start_word"], got[1, 0]["end_word"], got[1, 0]["other_start"], got[1, 0]["likeness"]) == (0, 70, 80, 1.0)
    assert (got[3, 1]["start_word"], got[3, 1]["end_word"], got[3, 1]["other_start"]) == (0, 60, 160)
    assert got[2, 0]["likeness"] > 0.85 and got[2, 0]["end_word"] - got[2, 0]["start_word"] >= 60


def test_passages_whose_parts_stand_in_earlier_documents(spark):
    rng = random.Random(11)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    s, t = [fresh(30), fresh(30)], [fresh(30), fresh(30)]
    u = [fresh(30), fresh(30)]
    texts = [s[0], s[1], s[0] + s[1], s[0] + s[1]]
    texts += [t[0], t[1], fresh(9) + t[0] + t[1] + fresh(9), t[0], t[1], fresh(9) + t[0] + t[1] + fresh(9)]  # neither first nor last
    texts += [u[0], u[1], u[0] + u[1], u[0] + fresh(4) + u[1]]  # no seed across the border
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id BIGINT, text STRING")
    got = {(r["doc_id"], r["other_id"]): r for r in passages.shared_passages(docs).collect()}
    assert set(got) == {(3, 2), (9, 6), (13, 12)}
    assert (got[3, 2]["start_word"], got[3, 2]["end_word"], got[3, 2]["likeness"]) == (0, 60, 1.0)
    assert (got[9, 6]["start_word"], got[9, 6]["end_word"], got[9, 6]["other_start"]) == (9, 69, 9)
    assert (got[13, 12]["end_word"], got[13, 12]["equal_words"]) == (64, 60)


def test_every_exact_run_lies_in_a_passage(spark):
    rng = random.Random(12)
    lines = [[f"u{rng.randrange(10**9)}" for _ in range(rng.randint(4, 9))] for _ in range(12)]
    texts = [sum((rng.choice(lines) for _ in range(rng.randint(2, 9))), []) for _ in range(60)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id BIGINT, text STRING")
    rows = defaultdict(list)
    for r in passages.shared_passages(docs, min_words=15).collect():
        rows[r["doc_id"]].append((r["start_word"], r["end_word"]))
    seen = set()
    for i, t in enumerate(texts):
        runs = [tuple(t[k : k + 15]) for k in range(len(t) - 14)]
        assert all(any(a <= k and k + 15 <= b for a, b in rows[i]) for k, run in enumerate(runs) if run in seen)
        seen.update(runs)


def test_passages_of_four_equal_words_in_five(spark):
    """Planted changed copies against their brute-force likeness: all evenly changed ones, and nearly all others."""
    rng = random.Random(13)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    rows, even, mixed = [], set(), set()
    for k in range(200):
        own = fresh(60 if k < 80 else 100)
        changed = set(range(k % 5, 60, 5 + k // 20)) if k < 80 else set(rng.sample(range(1, 99), 10 + (k - 80) // 12))
        copy = [w if j not in changed else f"c{rng.randrange(10**9)}" for j, w in enumerate(own)]
        assert sum(a == b for a, b in zip(own, copy)) >= 0.8 * len(own)
        (even if k < 80 else mixed).add((2 * k + 1, 2 * k))
        rows += [(2 * k, " ".join(fresh(40) + own + fresh(40))), (2 * k + 1, " ".join(fresh(25) + copy + fresh(40)))]
    out = passages.shared_passages(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect()
    got = {(r["doc_id"], r["other_id"]) for r in out}
    print(f"even {len(even & got)} of {len(even)}, mixed {len(mixed & got)} of {len(mixed)}")
    assert even <= got <= even | mixed and len(mixed & got) >= 0.97 * len(mixed)
    assert all(r["likeness"] >= 0.8 for r in out)


def test_changed_copies_between_other_holders_of_their_parts(spark):
    """Both halves stand in two documents before and two after the one that a changed copy is of."""
    rng = random.Random(14)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    rows, want = [], set()
    for k in range(8):
        own = fresh(70)
        copy = [w if j % 9 else f"c{rng.randrange(10**9)}" for j, w in enumerate(own, 1)]
        halves = [own[:47], own[23:]]
        texts = [*(h + fresh(30) for h in halves), fresh(20) + own + fresh(20), *(fresh(30) + h for h in halves), fresh(9) + copy]
        rows += [(6 * k + j, " ".join(t)) for j, t in enumerate(texts)]
        want.add((6 * k + 5, 6 * k + 2))
    out = passages.shared_passages(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect()
    found = {(r["doc_id"], r["other_id"]) for r in out}
    assert want <= found and all(r["likeness"] >= 0.8 for r in out)
    assert len(out) == len({(r["doc_id"], r["other_id"], r["start_word"], r["end_word"]) for r in out})


def test_packed_seed_places_against_brute_force():
    """First and last earlier holders over chunks that send each key once, negative and large ids among them."""
    rng = np.random.default_rng(15)
    ids = np.append(rng.choice(10**12, 40, replace=False), [-5, 0, 7, 2**62])
    chunks, parts = np.array_split(np.unique(ids), 5), 16
    names = rng.integers(0, 2**64, 60, dtype=np.uint64)
    held = []
    for c in chunks:
        doc = rng.choice(c, 90)
        held.append((rng.choice(names, 90), doc, rng.integers(0, 500, 90).astype(np.int32)))
    every = [(int(k), int(d), int(a)) for keys, doc, at in held for k, d, a in zip(keys, doc, at)]
    sent = pd.concat([passages.Holders(*h).sent(c, parts) for c, h in enumerate(held)])
    assert len(sent) <= len(chunks) * parts
    answers = pd.concat([passages._answered(g) for _, g in sent.groupby("part")])
    for c, h in enumerate(held):
        found = passages.Holders(*h).linked(answers[answers["chunk"] == c])
        for key, doc, (first, first_at, last, last_at, before, crowded) in zip(h[0].tolist(), h[1].tolist(), zip(*found)):
            same = [(d, a) for k, d, a in every if k == key]
            earlier = [p for p in same if p[0] < doc]
            assert (first, first_at) == min(same) and before == bool(earlier)
            assert not before or (last, last_at) == max(earlier)
            assert crowded == (len({d for d, _ in same}) > 3)


def test_shared_pairs_are_those_that_span_enough(monkeypatch):
    """Anchors in small lots, of pairs of which one stretch may hold a passage, against all pairs."""
    rng = np.random.default_rng(16)
    monkeypatch.setattr(passages, "ANCHORS_AT_ONCE", 64)
    left, held = ((rng.integers(0, 40, n, dtype=np.uint64), rng.integers(low, 60, n), rng.integers(0, 90, n).astype(np.int32)) for n, low in ((300, 20), (500, 0)))
    got = pd.concat(passages._shared_pairs(left, held, 50))
    pairs = defaultdict(list)
    for k, d, a in zip(*left):
        for h, o, b in zip(*held):
            if k == h and o < d:
                pairs[int(d), int(o)].append((int(a), int(b)))
    wide = {(d, o, *p) for (d, o), every in pairs.items() for p in every if max(every)[0] - min(every)[0] + passages.K >= 44}
    assert wide and set(got.itertuples(index=False, name=None)) == wide
    assert len(got) == sum(len(v) for (d, o), v in pairs.items() if max(v)[0] - min(v)[0] + passages.K >= 44)


def test_a_common_line_is_not_looked_up_in_all_its_holders(monkeypatch):
    """400 documents hold one line of 12 seeds, each two of them a longer passage too: only those are pairs."""
    seeds = [(k, i, k) for i in range(400) for k in range(12)] + [(1000 * (i // 2 + 1) + k, i, 40 + k) for i in range(400) for k in range(50)]
    table = tuple(np.array(v, dtype=np.int64) for v in zip(*sorted(seeds, key=lambda s: s[1:])))
    looked_up, each = [], passages._each
    monkeypatch.setattr(passages, "_each", lambda of, low, n: looked_up.append(int(n.sum())) or each(of, low, n))
    got = pd.concat(passages._shared_pairs(table, table, 50, passages.REACH))
    want = {(i, i - 1, a, a) for i in range(1, 400, 2) for a in [*range(12), *range(40, 90)]}
    assert len(got) == len(want) and set(got.itertuples(index=False, name=None)) == want
    assert sum(looked_up) < 120 * 400 < 12 * 400 * 399 / 2


@pytest.mark.parametrize("n_keys", [6, 40, 300])
def test_spared_seeds_lose_no_pair_that_can_hold_a_passage(monkeypatch, n_keys):
    monkeypatch.setattr(passages, "SPARE_FROM", 0)
    rng = np.random.default_rng(17)
    weights = 1 / np.arange(1, n_keys + 1)
    names = lambda n: rng.choice(n_keys, n, p=weights / weights.sum())
    left, held = ((names(n), rng.integers(low, 40, n), rng.integers(0, 600, n).astype(np.int32)) for n, low in ((500, 10), (700, 0)))
    pairs = defaultdict(list)
    for k, d, a in zip(*left):
        for h, o, b in zip(*held):
            if k == h and o < d:
                pairs[int(d), int(o)].append((int(a), int(b)))

    def wide(pairs):
        out = set()
        for pair, every in pairs.items():
            every = sorted(every)
            keep = passages._regions(np.array([a for a, _ in every]), 50)
            out |= {(*pair, *p) for p, k in zip(every, keep) if k}
        return out

    got = defaultdict(list)
    for some in passages._shared_pairs(left, held, 50, passages.REACH):
        for d, o, a, b in some.itertuples(index=False, name=None):
            got[d, o].append((a, b))
    assert wide(pairs) and wide(got) == wide(pairs)


def test_seeds_packed_for_the_second_pass_come_back():
    rng = np.random.default_rng(18)
    doc = np.sort(rng.choice([-7, 0, 3, 2**62], 300))
    at = rng.integers(0, 70_000, 300).astype(np.int32)
    at = at[np.lexsort((at, doc))]
    for key in (rng.integers(0, 2**40, 300), np.zeros(300, dtype=np.int64)):
        assert all((a == b).all() for a, b in zip(passages._seeds_unpacked(*passages._seeds_packed(key, doc, at)), (key, doc, at)))


def test_passages_leave_no_shuffle_files(spark, monkeypatch):
    """The jobs that write the tables between the steps take their shuffle files away, and the setting is as before."""
    before = spark.conf.get(passages.CLEANUP, None)
    rows = [(i, " ".join(f"w{j * j}" for j in range(80))) for i in range(3)]
    asked, written = [], passages.staged
    monkeypatch.setattr(passages, "staged", lambda df, name: asked.append(spark.conf.get(passages.CLEANUP)) or written(df, name))
    assert passages.shared_passages(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).count() > 0
    assert asked == ["true"] * 6 and spark.conf.get(passages.CLEANUP, None) == before


def test_passages_odd(odd, empty):
    assert all(r["doc_id"] > r["other_id"] for r in passages.shared_passages(odd, min_words=8).collect())
    assert passages.shared_passages(empty).count() == 0


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=sentencepieces.default_model())


def _encoded(texts):
    v = sentencepieces.load(sentencepieces.default_model())
    ids, bounds = sentencepieces.Encoder(v)(texts)
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]


def test_tokens_are_the_library_s(library, documents):
    texts = ["", " ", "a  b\n\tc ", "▁x", "a" * 99, "x" * 5000, " " * 40 + "b", "é😀\x00<s></s><0x41>", "日本語テキスト\r\n"]
    rng = random.Random(1)
    texts += ["".join(rng.choice("abcdeh  ▁éñß.,01日😀\n") for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    texts += [r["text"] for r in documents.collect()]
    assert _encoded(texts) == library.encode(texts, num_threads=1)


def test_tokens_where_pairs_share_slots(library, monkeypatch):
    monkeypatch.setattr(sentencepieces.Pairs, "BITS", 3)
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdeh  éß.,01日😀\n") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    v = sentencepieces.load(sentencepieces.default_model())
    assert len(sentencepieces.Pairs(v).held) == 8
    assert _encoded(texts) == library.encode(texts, num_threads=1)


def test_tokens_odd(odd, empty, library):
    out = sentencepieces.encode(odd).collect()
    assert len(out) == 12 and all(r["decoded_ok"] and r["n_tokens"] == len(r["ids"]) for r in out)
    assert {r["doc_id"]: r["ids"] for r in out}[8] == library.encode("é▁日本語 😀 \x00 end")
    assert {r["doc_id"]: r["ids"] for r in out}[5] == []
    assert sentencepieces.encode(empty).count() == 0


def test_rows_of_one_id_are_one_node(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (9, b), (9, ""), (20, c), (21, c), (20, b), (30, None), (30, c + " end"), (40, "")]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {*((i, 1) for i in (1, 5, 9, 20, 21, 30)), (40, 40)}


def test_both_texts_of_an_id_stay_sets_of_their_own(spark):
    """Two texts of equal size led by one id: a third text like their union alone links with neither."""
    a, b = [f"a{i}" for i in range(40)], [f"b{i}" for i in range(40)]
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(a)), (3, " ".join(b)), (7, " ".join(a[:20] + b[:20]))]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7}


def test_models_that_normalise_are_refused(monkeypatch):
    real = sentencepiece.SentencePieceProcessor

    class Normalising(real):
        def encode(self, text, **kw):
            import unicodedata

            return super().encode(unicodedata.normalize("NFKC", text), **kw)

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Normalising)
    sentencepieces.load.cache_clear()
    with pytest.raises(ValueError, match="normalise"):
        sentencepieces.load(sentencepieces.default_model())
    sentencepieces.load.cache_clear()
