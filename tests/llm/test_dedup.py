"""Joins and deduplication against plain Python on small documents."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftgrid.llm import minimisers, ngram_join, substring_dedup, suffix_dedup
from shiftgrid.llm.minimisers import Unit, gram_hashes, minima, runs


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def brute_words(rows, window):
    """A word goes if a window over it starts in a document with a smaller id; null is larger than any id."""
    high = float("inf")
    least = defaultdict(lambda: (high,))
    split = [(i, (t or "").encode().split()) for i, t in rows]
    where = defaultdict(set)
    for i, w in split:
        for k in range(len(w) - window + 1):
            where[tuple(w[k:k + window])].add(high if i is None else i)
    del least
    out = []
    for i, w in split:
        gone = [False] * len(w)
        own = high if i is None else i
        for k in range(len(w) - window + 1):
            if min(where[tuple(w[k:k + window])]) < own:
                gone[k:k + window] = [True] * window
        out.append((i, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g))))
    return Counter(out)


def brute_bytes(rows, window):
    count = Counter()
    for _, t in rows:
        b = (t or "").encode()
        count.update(b[k:k + window] for k in range(len(b) - window + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, int)
        for k in range(len(b) - window + 1):
            if count[b[k:k + window]] > 1:
                gone[k] += 1
                gone[k + window] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return Counter(out)


@pytest.mark.parametrize("options", [{}, {"unpack_from": 1}, {"unpack_bytes": 3_000}, {"chunk_bytes": 500}])
def test_substring_dedup(docs, texts, options):
    got = substring_dedup.dedup(docs, **options).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == brute_words(texts, 50)


@pytest.mark.parametrize("options", [{}, {"unpack_from": 1}, {"unpack_bytes": 3_000}, {"chunk_bytes": 500}])
def test_suffix_dedup(docs, texts, options):
    got = suffix_dedup.dedup(docs, **options).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == brute_bytes(texts, 200)


@pytest.fixture(scope="module")
def logs(spark):
    """One document of 1,000 lines with one beginning, a copy of some of its lines, and repeated rows."""
    rng = random.Random(8)
    head = " ".join(rng.choice("alpha beta gamma delta".split()) + str(rng.randint(0, 99)) for _ in range(45))
    lines = [f"{head} {' '.join(str(rng.randint(0, 10 ** 6)) for _ in range(8))}" for _ in range(1_000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(lines[400:430])), (3, "\n".join(lines[410:420])), (3, "\n".join(lines[410:420])),
            (None, lines[5]), (4, "z" * 5_000)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_runs_of_one_document_make_a_minimiser_common(logs):
    """The runs count, not the documents: no bucket gets more than ``unpack_from`` of them."""
    rows, docs = logs
    found = minimisers.repeated_pieces(
        docs, lambda: suffix_dedup.Bytes(200, 48), "doc_id", "text", F.sum("n") > 1, 20, 1 << 30).where("mark IS NOT NULL").cache()
    assert found.where("hot").count() > 900
    assert found.where("NOT hot").groupBy("mark").count().agg(F.max("count")).first()[0] <= 20
    by_bytes = minimisers.repeated_pieces(
        docs, lambda: suffix_dedup.Bytes(200, 48), "doc_id", "text", F.sum("n") > 1, 1 << 30, 4_000).where("mark IS NOT NULL")
    kept = by_bytes.where("NOT hot").groupBy("mark").agg(F.sum(F.length("piece")).alias("b"))
    assert kept.agg(F.max("b")).first()[0] <= 4_000
    found.unpersist()


def test_common_minimisers_lose_nothing(logs):
    rows, docs = logs
    got = suffix_dedup.dedup(docs, unpack_from=20).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == brute_bytes(rows, 200)
    got = substring_dedup.dedup(docs, unpack_from=20).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == brute_words(rows, 50)


def test_empty_tables(no_docs):
    assert substring_dedup.dedup(no_docs).count() == 0
    assert suffix_dedup.dedup(no_docs).count() == 0
    assert ngram_join.join(no_docs).count() == 0


def test_suffix_order_is_the_sorted_order():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 150)
        text = np.array([rng.choice([0, 1, 2, 3, 255][:rng.randint(1, 5)]) for _ in range(n)], np.uint8)
        wanted = np.array([rng.random() < 0.7 for _ in range(n)])
        order = suffix_dedup.suffix_order(text, wanted, n + 8).tolist()
        pad = [text[i:].tobytes() + b"\0" * n for i in range(n)]
        assert sorted(order) == np.flatnonzero(wanted).tolist()
        keys = [pad[i][:n] for i in order]
        assert keys == sorted(keys)


def test_colliding_hashes_do_not_merge_windows(monkeypatch):
    """With a hash that is the same for all windows, sorting still tells them apart."""
    monkeypatch.setattr(substring_dedup, "gram_hashes", lambda v, k: np.zeros(v.size - k + 1, np.uint64))
    monkeypatch.setattr(suffix_dedup, "gram_hashes", lambda v, k: np.zeros(v.size - k + 1, np.uint64))
    rng = random.Random(1)
    words = [b" ".join(rng.choice([b"a", b"b", b"c"]) for _ in range(30)) for _ in range(8)]
    words += [words[0]]
    owner = np.arange(9)
    got = substring_dedup.smallest(words, owner, 10)
    least = {}
    for o, p in enumerate(words):
        w = p.split()
        for k in range(21):
            least[tuple(w[k:k + 10])] = min(o, least.get(tuple(w[k:k + 10]), 99))
    seen = {(p, k): best for p, a, b, best in got for k in range(a, b)}
    assert seen == {(p, k): least[tuple(words[p].split()[k:k + 10])] for p in range(9) for k in range(21)}
    pieces = [bytes(rng.choice(b"ab") for _ in range(40)) for _ in range(6)] + [b"a" * 30]
    count = Counter(p[k:k + 16] for p in pieces for k in range(len(p) - 15))
    hits = {(p, k) for p, a, b in suffix_dedup.repeated_windows(pieces, np.ones(7, int), 16) for k in range(a, b)}
    assert hits == {(i, k) for i, p in enumerate(pieces) for k in range(len(p) - 15) if count[p[k:k + 16]] > 1}


def test_minimisers_cover_every_window_once():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 4, 3_000).astype(np.uint64)
    seen = np.zeros(values.size - 29, int)
    low = minima(gram_hashes(values, 5), 26)
    for mark, start, end, _ in runs(values, 30, 5):
        for m, a, b in zip(mark, start, end):
            seen[a:b] += 1
            assert (low[a:b].view(np.int64) == m).all()
    assert (seen == 1).all()
    assert Unit(30, 5).window == 30


def shingle_sets(rows):
    out = []
    for _, t in rows:
        w = (t or "").encode().split()
        out.append(frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    return out


def brute_links(rows):
    sets, n = shingle_sets(rows), len(rows)
    parent, links = list(range(n)), [0] * n

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and 5 * common >= 4 * (len(sets[i]) + len(sets[j]) - common):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    low = {}
    for i in range(n):
        r = find(i)
        low[r] = min(low.get(r, (True, 0)), (rows[i][0] is None, rows[i][0] or 0))
    return Counter((rows[i][0], None if low[find(i)][0] else low[find(i)][1], links[i]) for i in range(n)), len(low)


@pytest.mark.parametrize("options", [{}, {"node_limit": 30, "block": 3}])
def test_join_links(spark, docs, texts, options):
    rng = random.Random(9)
    base = texts[0][1].split()
    rows = list(texts)
    for i in range(40):  # near copies at many distances, around the threshold
        w = list(base)
        for k in rng.sample(range(300), rng.randint(1, 14)):
            w[k] = f"w{rng.randint(0, 9)}"
        rows.append((100 + i, " ".join(w)))
    more = spark.createDataFrame(rows, "doc_id long, text string")
    want, _ = brute_links(rows)
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.join(more, **options).collect())
    assert got == want


def test_one_document_of_each_class_stays(docs, texts):
    _, classes = brute_links(texts)
    kept = ngram_join.distinct_documents(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    # texts without a word are alone; every other class leaves one
    assert len(rows) == classes
    assert Counter(r["doc_id"] for r in rows)[1] == 1 and 2 not in {r["doc_id"] for r in rows}


def test_runs_reach_the_target_recall():
    assert ngram_join.runs_for(0.9) < ngram_join.runs_for(1 - 1e-6)
    q = ngram_join.survival(ngram_join.FIRST_DEPTH)
    assert 1 - (1 - q) ** ngram_join.runs_for(0.999) >= 0.999


def test_pairs_at_the_threshold_meet_in_deep_buckets(spark):
    """Every bucket counts as large, so all pairs go down to the last level."""
    rng = random.Random(21)
    rows = []
    for i in range(1_200):
        n = rng.randint(100, 140)
        words = [f"p{i}x{k}" for k in range(n + 4)]  # n shingles; m changed ones at the end leave J = (n - m) / (n + m) >= 0.8
        m = n // 9 - rng.randint(0, 2)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:-m] + [f"q{i}x{k}" for k in range(m)]))]
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), node_limit=1).select("doc_id", "class_id", "n_links").collect()
    assert len(got) == len(rows)
    lost = [tuple(r) for r in got if (r["class_id"], r["n_links"]) != (r["doc_id"] // 2 * 2, 1)]
    assert not lost


def test_misses_stay_below_the_target_at_every_depth():
    half = 1 - 5e-7
    least = ngram_join.least_equal(half)
    for depth in (ngram_join.FIRST_DEPTH, ngram_join.DEEPEST):
        assert ngram_join.missed(ngram_join.runs_for(half, depth), depth, least) <= 5e-7


def test_verification_is_exact_in_both_forms():
    from fractions import Fraction

    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 40, 120).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(120) < s, rng.integers(0, 1 << 40, 120).astype(np.uint64), base)) for s in rng.random(30) * 0.3]
    weight = rng.integers(1, 4, 30)
    links, root = ngram_join.verify(sets, None, weight, Fraction(4, 5))
    want = np.zeros(30, int)
    for i in range(30):
        for j in range(30):
            common = np.intersect1d(sets[i], sets[j]).size
            if i != j and 5 * common >= 4 * (sets[i].size + sets[j].size - common):
                want[i] += weight[j]
    assert links.tolist() == want.tolist() and (root <= np.arange(30)).all()
