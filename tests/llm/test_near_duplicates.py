"""Near duplicates against all pairs of sets: mixed groups, crowded buckets, and rows that share a doc_id."""

import random

from cellweave.llm import minhash_dedup
from cellweave.llm.minhash_dedup import near_duplicates


def plain(rows):
    """component_id of each doc_id, from all pairs of texts."""
    sets, up = [], {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())))
        up[i] = i

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    grams = {}
    for n, (_, s) in enumerate(sets):
        for g in s:
            grams.setdefault(g, []).append(n)
    for n, (i, s) in enumerate(sets):
        common = {}
        for g in s:
            for m in grams[g]:
                if m < n:
                    common[m] = common.get(m, 0) + 1
        for m, c in common.items():
            if 100 * c >= 75 * (len(s) + len(sets[m][1]) - c):
                x, y = sorted((root(i), root(sets[m][0])))
                up[y] = x
    return {i: root(i) for i in up}


def components_of(spark, rows, **how):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {r.doc_id: r.component_id for r in near_duplicates(docs, **how).collect()}


def test_crowded_buckets_lose_no_link_and_miss_no_pair(spark):
    """Half of each text is shared, so band buckets hold hundreds of unlike texts; between them, chains of near copies on both sides of 0.75."""
    rng = random.Random(7)
    words = ["w%d" % i for i in range(5000)]
    shared = [rng.choice(words) for _ in range(60)]
    rows = []
    for i in range(260):
        own = [rng.choice(words) for _ in range(50)]
        text = shared + own
        rows.append((10 * i, " ".join(text)))
        for j in range(1, 1 + i % 4):  # each differs from the one before
            for _ in range(rng.randrange(1, 4)):
                text[rng.randrange(60, len(text))] = rng.choice(words)
            rows.append((10 * i + j, " ".join(text)))
    rng.shuffle(rows)
    want = plain(rows)
    assert 260 <= len(set(want.values())) < len(rows)
    assert components_of(spark, rows, block=32) == want


def test_rows_that_share_a_doc_id_with_other_texts(spark):
    rng = random.Random(8)
    a, b = ([str(rng.random()) for _ in range(60)] for _ in range(2))
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(a + ["q"])), (3, " ".join(b + ["q"])), (4, " ".join(b[:30])), (1, " ".join(a)), (9, "short one"), (8, "SHORT one"), (7, None)]
    assert components_of(spark, rows) == plain(rows) == {1: 1, 2: 1, 3: 1, 4: 4, 9: 8, 8: 8, 7: 7}


def test_a_hot_key_is_spread(spark, monkeypatch):
    """With every key hot the results stay the same."""
    from cellweave.llm import common

    monkeypatch.setattr(common, "HOT", 10**9)
    rng = random.Random(9)
    base = [str(rng.randrange(1000)) for _ in range(80)]
    rows = [(i, " ".join(base[:-1] + [str(i % 3)] if i % 2 else base)) for i in range(60)] + [(100 + i, str(i) + " x" * i) for i in range(20)]
    assert components_of(spark, rows) == plain(rows)


def test_similar_counts_sets():
    import numpy as np

    x = np.arange(100)
    assert minhash_dedup.similar(x, x[25:], 75) and not minhash_dedup.similar(x, x[26:], 75)
