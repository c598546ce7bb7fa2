"""Collocations, exact top-k search and the filter audit: odd tables, and plain loops beside them."""

import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlake.llm import audit, collocations, topk

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id bigint, text string, lang string, source string, n bigint, score string, part int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns of the results' names."""
    base = "New York City is new. New york city, the big Apple! the big\tapple\nnew york city is"
    rows = [(1, base, "en", "a"), (1, base, "en", "a"), (2, base, None, "a"), (3, None, "en", None), (4, "", "fr", ""), (None, base, "en", "b"), (None, base, "en", "b"), (5, ".,;:!?", "en", "b"),
            (6, "a " * 3000 + "a", "fr", "b"), (7, "x" * 600_000, None, "c"), (8, "É\x0bÀ b É\x0cÀ B é à b", "fr", "c"), (9, "\x00   new york", "en", "c"), (2, "SHOUT $5 " * 120, "en", "d"), (10, "SHOUT $5 " * 120, "en", "d")]
    return spark.createDataFrame([(*r, None, "s", 1) for r in rows], DOCS).repartition(3)


def mined(rows, least, longest, top, percent):
    counts, total = {}, {}
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            total[lang] = total.get(lang, 0) + len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    key = (lang, *words[i : i + k])
                    counts[key] = counts.get(key, 0) + 1
    candidates = {k: n for k, n in counts.items() if len(k) > 2 and n >= least}
    out = {}
    for key, a in candidates.items():
        lang, words = key[0], key[1:]
        inside = lambda other: other[0] == lang and len(other) > len(key) and any(other[i : i + len(words)] == words for i in range(1, len(other)))  # noqa: B023, E731
        if any(100 * n >= percent * a for other, n in candidates.items() if inside(other)):
            continue
        cuts = [(1000 * a * total[lang] // (counts[key[: k + 1]] * counts[(lang, *words[k:])]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), counts[key[: k + 1]], counts[(lang, *words[k:])]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top]))


@pytest.mark.parametrize(("least", "top", "percent", "bits"), [(2, 2000, 100, 20), (1, 7, 100, 17), (3, 2000, 60, 17), (2, 5, 100, 16)])
def test_collocations_against_loops(spark, odd, monkeypatch, least, top, percent, bits):
    monkeypatch.setattr(collocations, "BLOCK", 500)
    monkeypatch.setattr(collocations, "HELD", 8)
    rows = [(r.text, r.lang or "und") for r in odd.collect()]
    got = collocations.mine(odd, least, 5, top, percent, bits)
    assert sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in got.collect()) == mined(rows, least, 5, top, percent)


def test_collocations_of_little(odd):
    assert collocations.mine(odd.where("false")).count() == 0
    assert collocations.mine(odd.where("text is null or text = ''"), 1).count() == 0
    assert collocations.mine(odd, 10**6).count() == 0


def test_scores_are_exact_beyond_64_bits(spark, monkeypatch):
    facts = [("en", "a", 1, 9_000_000_000_001), ("en", "b", 1, 7_000_000_000_003), ("en", "a b", 2, 5_000_000_000_007)]
    n = 90_000_000_000_000_011
    monkeypatch.setattr(collocations, "frequent", lambda *a: (spark.createDataFrame(facts, "lang string, phrase string, k int, n bigint"), spark.createDataFrame([("en", n)], "lang string, n bigint")))
    row = collocations.mine(spark.range(0)).collect()[0]
    assert row.score == 1000 * 5_000_000_000_007 * n // (9_000_000_000_001 * 7_000_000_000_003)


def test_bitmaps_never_hide_a_phrase():
    rng = np.random.default_rng(0)
    sums = collocations.Counts(100)
    all_ = rng.integers(0, 1 << 20, 50_000).astype(np.uint32)
    seen = {}
    for part in np.array_split(all_, 7):
        sums.add(part)
    batch = sums.rows()
    for s, places, counts in zip(*(batch.column(c).to_pylist() for c in ("slice", "places", "counts")), strict=True):
        for p, c in zip(np.frombuffer(places, np.uint16), np.frombuffer(counts, np.uint8), strict=True):
            seen[(s << 16) + int(p)] = int(c)
    u, c = np.unique(all_, return_counts=True)
    assert seen == dict(zip(u.tolist(), np.minimum(c, 100).tolist(), strict=True)) and sums.rows() is None


HOT = [1.0, -2.5, 0.25]


@pytest.fixture(scope="module")
def vectors():
    rng, rows = np.random.default_rng(1), []
    for i in range(240):
        r = rng.random()
        v = HOT if r < 0.4 else [float(x) for x in rng.normal(0, 1 + 50 * (r > 0.9), 3 if r < 0.8 else 2)]
        rows.append((i if rng.random() > 0.05 else (None if rng.random() < 0.5 else 20), v))
    rows += [(20, HOT)] * 3 + [(40, HOT)] * 2 + [(None, HOT), (60, None), (60, [1.0, None]), (80, [math.nan]), (80, [math.inf, 1.0]), (100, []), (120, [1e300, -1e300]), (140, [1e18]), (141, [3e15, 4.0]), (160, [-1e16, 2.0])]
    return rows


@pytest.mark.parametrize(("k", "block"), [(20, 7), (3, 8192), (1000, 50)])
def test_top_k_against_loops(spark, vectors, monkeypatch, k, block):
    monkeypatch.setattr(topk, "SCORES", 4000)
    monkeypatch.setattr(topk, "BLOCK", block)
    df = spark.createDataFrame([(*r, "x", 1) for r in vectors], "vec_id bigint, embedding array<double>, score string, rank int").repartition(5)
    got = topk.search(df, F.col("vec_id") % 20 == 0, k).collect()
    low, high = -(1 << 63), (1 << 63) - 1
    clip = lambda x: min(max(x, low), high)
    clean = [(i, [clip(math.floor(64 * x)) for x in v]) for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for a, (i, v) in enumerate(clean):
        if i is not None and i % 20 == 0:
            best = sorted((-clip(sum(x * y for x, y in zip(v, w))), j is None, j or 0) for b, (j, w) in enumerate(clean) if b != a)[:k]
            want += [(i, n, None if void else j, -s) for n, (s, void, j) in enumerate(best, 1)]
    key = lambda rows: sorted(map(repr, map(tuple, rows)))
    assert key(got) == key(want)


def test_top_k_of_little(spark):
    df = spark.createDataFrame([(20, [1.0]), (21, [2.0])], "vec_id bigint, embedding array<double>")
    assert [tuple(r) for r in topk.search(df, F.col("vec_id") % 20 == 0).collect()] == [(20, 1, 21, 64 * 128)]
    assert topk.search(df.where("vec_id = 20"), F.col("vec_id") % 20 == 0).count() == 0
    assert topk.search(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0
    assert topk.search(df, F.col("vec_id") == 7).count() == 0


def audited(rows, labels):
    facts = []
    for i, (doc, text, part) in enumerate(rows):
        t = text or ""
        w = re.findall("[^ \t-\r]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)),
                 "E": any(d is not None and doc is not None and d < doc and (x or "") == t for d, x, _ in rows)}
        mine = [x for x in labels if doc is not None and x[0] == doc]
        facts.append((part or "", fails, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out = []
    for part in {f[0] for f in facts}:
        here = [f for f in facts if f[0] == part]
        steps = {}
        for order in map("".join, itertools.permutations("ABCDE")):
            for s, c in enumerate(order):
                before = [f for f in here if not any(f[1][x] for x in order[:s])]
                gone = [f for f in before if f[1][c]]
                failing = [f for f in here if f[1][c]]
                steps[order, s + 1] = (len(before) - len(gone), len(gone), len(failing) - len(gone), sum(sum(f[1].values()) == 1 for f in failing), sum(f[2] for f in gone), sum(f[3] for f in gone))
        whole = {c: sum(v[1] for (order, s), v in steps.items() if order[s - 1] == c) for c in "ABCDE"}
        out += [(part, order, s, *v, whole[order[s - 1]]) for (order, s), v in steps.items()]
    return sorted(out)


def test_audit_against_loops(spark, odd):
    labels = [(1, 1, 0), (1, 0, 1), (2, 1, None), (4, None, 1), (5, 0, 0), (None, 1, 1), (10, 1, 1)]
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    got = audit.audit(odd, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert sorted(map(tuple, got.collect())) == audited(rows, labels)
    assert audit.audit(odd.where("false"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).count() == 0
    none = audit.audit(odd, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    assert none.agg(F.sum("good_lost"), F.sum("toxic_lost")).first()[:] == (0, 0) and none.count() == 5 * 600
