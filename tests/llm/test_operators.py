"""Each operator against a plain version on small tables with nulls, empty texts, repeated rows and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cellweave.llm import token_files
from cellweave.llm.common import PieceCache
from cellweave.llm.decontaminate import decontaminate, overlaps
from cellweave.llm.exact_dedup import exact_dedup
from cellweave.llm.html_extract import extract, repeated
from cellweave.llm.licenses import license_scan
from cellweave.llm.minhash_dedup import near_duplicates
from cellweave.llm.packing import pack, sequences
from cellweave.llm.phrase_dedup import phrase_dedup
from cellweave.llm.suffix_dedup import blind_trie, suffix_dedup
from cellweave.llm.toxicity import LEAST, forms, learn_lexicon, sample, toxicity, train

SCHEMA = "doc_id long, text string, kept string, ids int, h int"


def corpus(seed=1):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(400)] + ["É", "ß!", "Über"]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared, near = make(80), make(120)
    texts = [None, "", " \n\t", "one", "One", make(30), shared, make(40) + "\n" + shared + " " + make(10), make(300) + " " + shared, near, near, near.upper(), "a" * 450, "aa bb " * 200]
    for i in range(12):  # near copies
        w = near.split()
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(" ".join(w))
    rows = [(i, t, "x", 1, 2) for i, t in enumerate(texts)]
    return rows + [(None, near, None, None, None), (5, texts[5], "x", 1, 2)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def marked(seqs, window, hit):
    out = []
    for i, s in enumerate(seqs):
        m = [False] * len(s)
        for j in range(len(s) - window + 1):
            if hit(i, s[j : j + window]):
                m[j : j + window] = [True] * window
        out.append(m)
    return out


def test_suffix_dedup(docs, none):
    rows = corpus()
    seqs = [(r[1] or "").encode() for r in rows]
    n = {}
    for s in seqs:
        for j in range(len(s) - 199):
            n[s[j : j + 200]] = n.get(s[j : j + 200], 0) + 1
    want = []
    for r, s, m in zip(rows, seqs, marked(seqs, 200, lambda i, w: n[w] > 1), strict=True):
        spans = sum(a and not b for a, b in zip(m, [False, *m], strict=False))
        want.append((r[0], len(s), sum(m), spans, hashlib.sha256(bytes(c for c, x in zip(s, m, strict=True) if not x)).hexdigest()))
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:5]) for r in suffix_dedup(docs, 200).collect())
    assert suffix_dedup(none, 200).count() == 0


def test_blind_trie_sorts():
    rng = random.Random(3)
    for _ in range(50):
        strings = [bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(9))) for _ in range(rng.randrange(1, 30))]
        order = [strings[i] for i, _ in blind_trie(strings)]
        assert order == sorted(strings)


def test_phrase_dedup(docs, none):
    rows = corpus()
    seqs = [(r[1] or "").encode().split() for r in rows]
    low = {}
    for r, s in zip(rows, seqs, strict=True):
        for j in range(len(s) - 49):
            if r[0] is not None:
                low[tuple(s[j : j + 50])] = min(r[0], low.get(tuple(s[j : j + 50]), r[0]))
    ids = [r[0] for r in rows]
    want = []
    for r, s, m in zip(rows, seqs, marked(seqs, 50, lambda i, w: ids[i] is not None and low[tuple(w)] < ids[i]), strict=True):
        want.append((r[0], len(s), sum(m), hashlib.sha256(b" ".join(c for c, x in zip(s, m, strict=True) if not x)).hexdigest()))
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:4]) for r in phrase_dedup(docs, 50).collect())
    assert phrase_dedup(none, 50).count() == 0


def test_near_duplicates(docs, none):
    sets, up = {}, {}
    for i, t, *_ in corpus():
        w = (t or "").encode().lower().split()
        if i is not None:
            sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
            up[i] = i

    def root(x):
        return x if up[x] == x else root(up[x])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    got = near_duplicates(docs).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None} == {(i, len(s), root(i), root(i) == i) for i, s in sets.items()}
    assert len(got) == len(corpus()) and all(r.kept for r in got if r.doc_id is None)
    assert near_duplicates(none).count() == 0


def test_exact_dedup(spark, docs, none):
    low = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    for keep, best in (("largest", max), ("smallest", min)):
        groups = {}
        for i, t, *_ in corpus():
            groups.setdefault((t or "").encode().translate(low), []).append(i)
        want = []
        for i, t, *_ in corpus():
            key = (t or "").encode().translate(low)
            stays = best((x for x in groups[key] if x is not None), default=None)
            want.append((i, stays, len(groups[key]), i == stays, hashlib.sha256(key).hexdigest()))
        got = exact_dedup(docs, keep).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert exact_dedup(none).count() == 0


def test_exact_dedup_keeps_columns_of_any_name(spark):
    rows = [(1, "A", 1, 2, 3, 4, 5, 6, 7), (2, "a", 1, 2, 3, 4, 5, 6, 7), (3, "b", 1, 2, 3, 4, 5, 6, 7)]
    d = spark.createDataFrame(rows, "doc_id long, text string, __norm int, __keep int, __h int, h int, `d.x` int, keep_id int, c1 int")
    got = exact_dedup(d, "largest").orderBy("doc_id").collect()
    assert [tuple(r)[:8] for r in got] == [(*r[:7], 7) for r in rows]
    assert [(r.keep_id, r.group_size, r.kept) for r in got] == [(2, 2, False), (2, 2, True), (3, 1, True)]


def test_simple8b_round_trip():
    rng = np.random.default_rng(1)
    for t in range(60):
        v = rng.integers(0, 1 << int(rng.integers(1, 64)), int(rng.integers(0, 700)), dtype=np.uint64)
        if t % 3 == 0:
            v[rng.random(len(v)) < 0.7] = 0
        if t % 5 == 0 and len(v):
            v[rng.integers(0, len(v), 3)] = np.uint64(2**64 - 1)
            v[rng.integers(0, len(v), 2)] = np.uint64((15 << 60) | ((1 << 60) - 1))
        assert (token_files.decode_block(token_files.encode_block(v))[: len(v)] == v).all()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_give_the_tokenizers_ids(name):
    rng = random.Random(2)
    signs = list("abCÉß \n\t  '’s1.9,!— 　​́e<|endoftext|>中\x1cªİĿ²ﬁæ…€%#яΣ©")
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(3000)]
    cache, tokenizer = PieceCache(str(P.path(name))), Tokenizer.from_file(str(P.path(name)))
    got = [x.tolist() for x in cache.encode_many(texts)]
    assert got == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_packing(docs, none):
    path = str(P.path("word_bpe_49k.json"))
    tokenizer = Tokenizer.from_file(path)
    pieces = pack(docs, path, end_id=1, length=64)
    got = pieces.collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
    for k, own in by.items():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == list(np.cumsum([0, *(r.length for r in own[:-1])]))
        assert sum(r.length for r in own) == 64 or k == max(by)
    own = {}  # the stream falls into documents: pieces in order, a new one where start is 0
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        if r.start == 0:
            own.setdefault(r.doc_id, []).append(b"")
        assert r.start == len(own[r.doc_id][-1]) // 4
        own[r.doc_id][-1] += r.ids
    want = {}
    for i, t, *_ in corpus():
        want.setdefault(i, []).append(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())
    assert own == want
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and r.length == len(r.ids) // 4 for r in got)
    assert all(r.doc_tokens in [len(x) // 4 for x in want[r.doc_id]] for r in got)
    joined = {r.sequence_id: r for r in sequences(pieces, 64).collect()}
    for k, parts in by.items():
        n, ids = sum(r.length for r in parts), b"".join(r.ids for r in sorted(parts, key=lambda r: r.offset))
        assert joined[k].n_tokens == n and joined[k].ids == ids + bytes(0 if n & (n - 1) == 0 else 4 * (64 - n))
    assert pack(none, path).count() == 0


def test_token_files(spark, docs, none, tmp_path):
    path, folder = str(P.path("byte_bpe_50k.json")), tmp_path / "shards"
    tokenizer = Tokenizer.from_file(path)
    token_files.write_tokens(docs, path, str(folder), end_id=2, shard_ids=500)
    rows = sorted(corpus(), key=lambda r: (-1 if r[0] is None else r[0], r[1] is not None, (r[1] or "").encode()))
    want, start = [], 0
    for i, t, *_ in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        want.append((i, start, len(ids) // 4, zlib.crc32(ids), ids))
        start += len(ids) // 4
    back = token_files.read_tokens(spark, str(folder)).collect()
    assert sorted(tuple(r) for r in back if r.doc_id is not None) == sorted(w for w in want if w[0] is not None)
    assert [tuple(r) for r in back if r.doc_id is None] == [w for w in want if w[0] is None]
    files = sorted(f for f in folder.glob("part-*") if f.stat().st_size > 1)
    assert len(files) > 4
    every = [x for f in files for x in zip(*token_files.read_shard(f.read_bytes()), strict=True)]  # names sort as doc_ids do
    assert [(i, x.astype("<u4").tobytes()) for i, x in every] == [(w[0], w[4]) for w in want]
    token_files.write_tokens(none, path, str(tmp_path / "none"))
    assert token_files.read_tokens(spark, str(tmp_path / "none")).count() == 0


def test_texts_of_many_parts_keep_their_ids():
    rng = random.Random(6)
    signs = ["word", "É", " ", "  ", "\n", "\t", "'s", "'", "12", "…", "x" * 300]
    text = "".join(rng.choice(signs) for _ in range(4000))
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        cache, tokenizer = PieceCache(str(P.path(name)), 50), Tokenizer.from_file(str(P.path(name)))  # 50: the table is emptied and grows
        for at_once in (64, 1000, 1 << 20):
            assert cache.encode_many([text, "", text[:99]], at_once)[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_extract(spark):
    nav = "<div>home about contact imprint terms privacy jobs press help</div>"
    pages = [(1, "http://a.x/1", f"{nav}<p>unique one</p>"), (2, "http://a.x/2", f"{nav}<p>other words</p>"), (3, "http://b.x/1", f"{nav}<p>z"), (4, None, None), (5, "u", "")]
    pages += [(6, "http://a.x/3", "<nav>n</nav><article><h1>T</h1><p>a &amp;  b<br>c<div class='comments'>no</div><p>3 < 4</article><footer>f</footer>")]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {1: "unique one", 2: "other words", 3: "home about contact imprint terms privacy jobs press help\n\nz", 4: "", 5: "", 6: "T\n\na & b c\n\n3 < 4"}


def test_overlaps_catch_reordered_passages(spark, docs, none):
    item = " ".join(f"q{i}" for i in range(20))
    w = item.split()
    bench = spark.createDataFrame([(1, item), (2, "too short"), (3, None), (None, item)], "item_id long, text string")
    texts = spark.createDataFrame([(1, "x " + " ".join(w[10:] + ["y"] + w[:10]).upper()), (2, " ".join(w[:9])), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r.overlaps for r in overlaps(texts, bench).collect()}
    assert [(o.item_id, o.n_matched, o.n_tiles) for o in got[1]] == [(1, 20, 2)] and not got[2] and not got[3] and not got[4]
    assert overlaps(none, bench).count() == 0


def plain_tiling(item, doc, least):
    """Greedy string tiling as it is told: mark the longest match of unmarked words until none has `least`."""
    a, b, out = [False] * len(item), [False] * len(doc), []
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for q in range(len(doc)):
                n = 0
                while p + n < len(item) and q + n < len(doc) and item[p + n] == doc[q + n] and not a[p + n] and not b[q + n]:
                    n += 1
                if n > best[0]:
                    best = (n, p, q)
        n, p, q = best
        if n < least:
            return out
        a[p : p + n] = b[q : q + n] = [True] * n
        out.append((p, q, n))


def test_tiling_against_a_plain_version(spark):
    rng = random.Random(12)
    words = list("abcdefgh")
    items = [(i, [rng.choice(words) for _ in range(rng.randrange(1, 25))]) for i in range(6)]
    items.append((3, ["q%d" % i for i in range(12)]))  # another item of the same id
    docs = []
    for i in range(40):
        own = [rng.choice(words) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            t = items[rng.randrange(7)][1]
            k, at = rng.randrange(len(t)), rng.randrange(len(own) + 1)
            own[at:at] = t[k:] + ["zz"] + t[:k]
        docs.append((i, own))
    want = []
    for i, d in docs:
        for k, t in items:
            if len(t) >= 5:
                found = plain_tiling(t, d, 5)
                n = sum(x[2] for x in found)
                if n >= len(t) / 2:
                    want.append((i, k, n, len(t), len(found)))
    rows = [(i, " ".join(d).upper()) for i, d in docs]
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in items] * 2, "item_id long, text string")
    got = overlaps(spark.createDataFrame(rows + rows[:3], "doc_id long, text string").repartition(3), bench).collect()
    assert len(got) == 43 and len(want) > 10
    assert sorted((r.doc_id, o.item_id, o.n_matched, o.n_tokens, o.n_tiles) for r in got for o in r.overlaps) == sorted(want + [w for w in want if w[0] < 3])
    assert sorted(r.doc_id for r in decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()) == sorted(i for i, _ in docs if i not in {w[0] for w in want})


def test_overlaps_replace_a_clashing_column(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    got = overlaps(spark.createDataFrame([(None, "a b c d e f", 3, 4, 5)], "doc_id long, text string, overlaps int, fp int, item_id int"), bench).collect()
    assert [(r.doc_id, r.overlaps, r.fp, r.item_id) for r in got] == [(None, [], 4, 5)]


def labelled(spark, rows):
    """Documents and labels of (text, label), none of them held out."""
    ids = [i for i in range(3 * len(rows)) if zlib.crc32(str(i).encode()) % 4 != 2]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in zip(ids, rows)], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, y) for i, (_, y) in zip(ids, rows)], "doc_id long, toxic int")


def test_lexicon_against_plain_counts(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(3, 8))) for _ in range(60)]
    rows = [(" ".join(rng.choice(words) for _ in range(6)) + rng.choice(["", " vilest", " vilely", " vilers", " vilesta"]) * (i % 4 == 0), int(i % 4 == 0)) for i in range(400)]
    n, counts = Counter(y for _, y in rows), {0: Counter(), 1: Counter()}
    for t, y in rows:
        counts[y].update(forms(t))
    df = spark.createDataFrame([(w, counts[1][w], counts[0][w]) for w in {*counts[0], *counts[1]}], "w string, a long, b long")
    want = {}
    for w, a in counts[1].items():
        b = counts[0][w]
        odds = math.log((a + 0.5) / (n[1] - a + 0.5)) - math.log((b + 0.5) / (n[0] - b + 0.5))
        score = odds - 2 * math.sqrt(1 / (a + 0.5) + 1 / (n[1] - a + 0.5) + 1 / (b + 0.5) + 1 / (n[0] - b + 0.5))
        ends = sum(v[-1] != "*" and len(v) > len(w) - 1 and v.startswith(w[:-1]) for v in counts[1])
        if a >= LEAST and score > 1 and a > 4 * b and (w[-1] != "*" or ends >= 3 and b * 50 <= a and a >= 2 * LEAST):
            want[w] = round(score, 9)
    got = learn_lexicon(df, n[1], n[0])
    assert {w: round(s, 9) for w, s in got.terms.items()} == want and "vilest" in want and "vile*" in want
    edits = lambda v, w: len(v) == len(w) and sum(x != y for x, y in zip(v, w)) == 1 or abs(len(v) - len(w)) == 1 and any(max(v, w, key=len)[:i] + max(v, w, key=len)[i + 1 :] == min(v, w, key=len) for i in range(9))
    near = {w for w in counts[0] if w[-1] != "*" and len(w) >= 5 and w not in want and counts[0][w] > counts[1][w] / 4 and any(edits(w, t) for t in want if t[-1] != "*")}
    assert near <= got.innocent


def test_toxicity(spark, none):
    rng = random.Random(4)
    words = ["word%s" % c for c in "abcdefghijklmnop"]
    rows = [(" ".join(rng.choice(words) for _ in range(30)) + (" vilest" if i % 5 == 0 else ""), int(i % 5 == 0)) for i in range(300)]
    model = train(*labelled(spark, rows))
    d = spark.createDataFrame([(1, "worda vilest wordb"), (2, "worda wordb"), (3, None), (4, ""), (None, "worda vilezt wordb")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity(d, model).collect()}
    assert got[1].predicted == 1 and not any(got[i].predicted for i in (2, 3, 4)) and model.lexicon["vilezt"] == ("vilest", 1)
    assert toxicity(none, model).count() == 0


def test_toxicity_of_misspelt_terms_and_clashing_columns(spark):
    rng = random.Random(5)
    words = ["word%s" % c for c in "abcdefghijklmnop"]
    make = lambda t: " ".join([*(rng.choice(words) for _ in range(30)), *t])
    rows = [(make(["vilest"] if i % 5 == 0 else []), int(i % 5 == 0)) for i in range(400)]
    model = train(*labelled(spark, rows))
    for w in ("vilezt", "v1lest", "vilets", "vielst", "vilst"):
        assert model.lexicon[w] == ("vilest", 1) and model.score(make([w])) >= 0.3, w
    assert model.score(make([])) < 0.3 and model.weights[1] > 0
    d = spark.createDataFrame([(1, make(["vilest"]), "x", 7), (1, make(["vilest"]), "x", 7), (2, None, "x", 7)], "doc_id long, text string, score string, predicted int")
    got = toxicity(d, model).collect()
    assert sorted((r.doc_id, r.predicted) for r in got) == [(1, 1), (1, 1), (2, 0)] and all(0 <= r.score <= 1 for r in got)


def test_training_leaves_out_held_out_rows_and_takes_long_texts(spark):
    ids = list(range(400))
    out = {i for i in ids if zlib.crc32(str(i).encode()) % 4 == 2}
    text = lambda i: "clean words here " * (20_000 if i == 0 else 3) + ("heldout" if i in out else "vilest" if i % 3 == 0 else "")
    docs = spark.createDataFrame([(i, text(i)) for i in ids] + [(401, None), (None, "vilest")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0 or i in out)) for i in ids] + [(401, 1), (1, None), (0, 0)], "doc_id long, toxic int")
    terms = train(docs, labels).lexicon.terms
    assert "vilest" in terms and "heldout" not in terms


def test_training_with_a_very_long_text_first(spark):
    """Whatever text comes first in hash order, the others teach the same."""
    rng = random.Random(9)
    rows = [(" ".join(rng.choice(["one", "two", "three"]) for _ in range(5)) + " vilest" * (i % 3 == 0), int(i % 3 == 0)) for i in range(120)]
    docs, labels = labelled(spark, rows)
    first = sample(docs, labels, 1).first().doc_id
    long = docs.withColumn("text", F.when(F.col("doc_id") == first, F.concat("text", F.repeat(F.lit(" one two three"), 200_000))).otherwise(F.col("text")))
    assert set(train(long, labels).lexicon.terms) == set(train(docs, labels).lexicon.terms) == {"vilest"}
    assert sample(docs, labels, 50).count() == 50 and sample(docs.union(docs), labels, 500).count() == 120


def test_license_inheritance(spark):
    files = [("a/LICENSE", "Released under the MIT License."), ("a/b/x.py", "code"), ("a/b/y.py", "# Licensed under the Apache License, Version 2.0.\ncode"), ("c/z", None), (None, "")]
    got = {r.path: (r.license, r.found_in) for r in license_scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got == {"a/LICENSE": ("MIT", "text"), "a/b/x.py": ("MIT", "directory"), "a/b/y.py": ("Apache-2.0", "text"), "c/z": (None, "none"), None: (None, "none")}


def test_keys_with_many_contexts_give_the_same_ranges(docs):
    """A key with over one context is divided until its windows stand alone."""
    from cellweave.llm import phrase_dedup, suffix_dedup, windows

    ways = [
        (windows.byte_symbols, suffix_dedup.cut_bytes, suffix_dedup.part_of, suffix_dedup.recurring(200), 200, 100, False, False),
        (phrase_dedup.word_symbols, phrase_dedup.cut_words, phrase_dedup.part_of, phrase_dedup.occurrences(50), 50, 25, True, True),
    ]
    for way in ways:
        one, two, three = ({(r.doc_id, r.fp): windows.union([s.asDict() for s in r.spans]) for r in windows.covered(docs, *way, most).collect()} for most in (50_000, 4, 1))
        assert one and one == two == three


def test_multikey_quicksort_orders_rows():
    from cellweave.llm.suffix_dedup import multikey_quicksort

    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 500):
        keys, group = rng.integers(0, 4, (n, 3)).astype(np.uint64), np.sort(rng.integers(0, 5, n))
        order, edge = multikey_quicksort(keys, group)
        rows = [(group[i], *keys[i]) for i in range(n)]
        assert [rows[i] for i in order] == sorted(rows) and list(edge) == [i == 0 or rows[order[i]] != rows[order[i - 1]] for i in range(n)]


def test_texts_beyond_a_slice(spark):
    """Texts of several slices, a repeated passage across a slice's border, and a word longer than a slice."""
    rng = random.Random(11)
    make = lambda n: " ".join("%x" % rng.randrange(1 << 40) for _ in range(n))
    passage = make(120)
    long = make(26_000)
    rows = [(1, long[: (1 << 18) - 600] + " " + passage + " " + long[1 << 18 :]), (2, "x " + passage + " y"), (3, long[-200_000:]), (4, "z" * 300_000), (5, "ab " + "z" * 500), (6, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    seqs, n = [(t or "").encode() for _, t in rows], {}
    for s in seqs:
        for j in range(len(s) - 199):
            k = hash(s[j : j + 200])
            n[k] = n.get(k, 0) + 1
    want = {i: sum(m) for (i, _), m in zip(rows, marked(seqs, 200, lambda i, w: n[hash(w)] > 1), strict=True)}
    assert {r.doc_id: r.n_removed for r in suffix_dedup(d, 200).collect()} == want and want[2] and want[3] and want[4]
    seqs, low = [s.split() for s in seqs], {}
    for (i, _), s in zip(rows, seqs, strict=True):
        for j in range(len(s) - 49):
            low.setdefault(tuple(s[j : j + 50]), i)
    want = {i: sum(m) for (i, _), m in zip(rows, marked(seqs, 50, lambda k, w: low[tuple(w)] < rows[k][0]), strict=True)}
    assert {r.doc_id: r.n_removed for r in phrase_dedup(d, 50).collect()} == want and want[2] and want[3]


@pytest.mark.parametrize("part", [20_000, 3])
def test_host_suffixes_find_the_longest_prefix_on_another_page(spark, part):
    rng = np.random.default_rng(5)
    rows = [(f"h{h}", page, b, " ".join(rng.choice(list("abc"), rng.integers(1, 14)))) for h in range(2) for page in range(5) for b in range(3)]
    rows += [("h0", 9, 0, "a b a b a b a b a b a b a b"), ("h2", 10, 0, "c c c c c c c c c c")]  # a page that repeats itself
    least, depth = 2, 6
    got = {(r.page, r.block, r.at, h): r.covered for h in ("h0", "h1", "h2") for r in repeated(spark.createDataFrame([r for r in rows if r[0] == h], "host string, page long, block int, text string"), least, depth, part).collect()}
    want = {}
    for host, page, block, text in rows:
        t = text.split()
        for i in range(len(t) - least + 1):
            best = 0
            for h, p, _, other in rows:
                u = other.split()
                if h == host and p != page:
                    for j in range(len(u) - least + 1):
                        k = 0
                        while k < depth and i + k < len(t) and j + k < len(u) and t[i + k] == u[j + k]:
                            k += 1
                        best = max(best, k)
            if best >= least:
                want[page, block, i, host] = best
    assert got == want


GPL3_HEADER = """# foo.py - does foo
#
# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details.
import foo
"""


def test_licenses_of_ties_repeated_paths_and_no_files(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    files = [("a/LICENSE", mit, "x"), ("a/COPYING", gpl, "x"), ("a/b", "code", "x"), ("a/b", "code", "x"), ("top", "", "x"), ("d/both", mit + "\n" + gpl, "x")]
    got = license_scan(spark.createDataFrame(files, "path string, text string, license string")).collect()
    of = {r.path: r for r in got}
    assert len(got) == 6 and of["a/b"].license_from == "a/COPYING" and of["a/b"].license == "GPL-3.0"  # equal scores: the smallest path
    assert of["top"].found_in == "none" and of["d/both"].license == "MIT" and of["d/both"].score == 1.0  # equal scores: the greater name
    assert license_scan(spark.createDataFrame([], "path string, text string")).count() == 0


def test_licenses_of_wrapped_headers_and_whole_texts(spark):
    from cellweave.llm import license_texts

    whole = dict(license_texts.whole())
    files = {f"{k}/COPYING.md": (k, f"Copyright (c) 2015, Foo Inc. All rights reserved.\n\n{t}") for k, t in whole.items()} | {f"{k}/code": (k, "x = 1") for k in whole}
    files |= {
        "a": ("GPL-3.0", GPL3_HEADER),
        "b": ("proprietary", "/* Copyright (c) 2015, Foo Inc. All rights reserved. */\nint x;"),
        "c": ("MIT", "/**\n * This source code is licensed under the MIT license found in the\n * LICENSE file in the root directory of this source tree.\n */\nlet x"),
        "d": ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE\nVersion 2"),
        "e": ("LGPL-2.1", GPL3_HEADER.replace("General", "Lesser General").replace("version 3", "version 2.1")),
        "f": (None, "The driver needs a license to drive, and permission of the owner to use the car on public roads."),
    }
    got = {r.path: r.license for r in license_scan(spark.createDataFrame([(p, t) for p, (_, t) in files.items()], "path string, text string")).collect()}
    assert got == {p: k for p, (k, _) in files.items()}


def test_runs_of_short_blocks_on_other_pages_are_removed(spark):
    menu = "<div>Home</div><div>All news</div><ul><li>About us</li><li>Contact</li></ul><div>Read more</div><p>(c) 2024 Foo</p>"
    pages = [(i, f"http://h/{i}", f"<body>{menu}<div>story {i} says x{i} y{i}</div><div>end {i}</div></body>") for i in range(3)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: f"{i} says x{i} y{i}\n\nend {i}" for i in range(3)}


def test_extract_of_no_pages_repeated_pages_and_clashing_columns(spark):
    kind = "page_id long, url string, html string, text int, found int"
    assert extract(spark.createDataFrame([], kind)).count() == 0
    rows = [(1, "http://h/1", "<article>one</article>", 1, 2)] * 2 + [(2, "http://h/2", "<div>just some words</div>", 1, 2)] * 2
    assert sorted((r.page_id, r.text, r.n_chars) for r in extract(spark.createDataFrame(rows, kind)).collect()) == [(1, "one", 3)] * 2 + [(2, "just some words", 15)] * 2


def test_marks_inside_an_article_count_only_as_whole_names_of_containers():
    from cellweave.llm.html_extract import decided

    kept = ['<h2 id="related-work">a</h2>', '<section id="search-algorithms">b</section>', '<p class="notice">c</p>', '<div class="social-history">d</div>']
    kept += ['<div aria-hidden="false">e</div>', '<div data-state="hidden">f</div>', "<p>g <math>h</math> <label>i</label></p>", '<div title="x hidden class=comments">j</div>']
    cut = ['<div class="wide comments">x</div>', "<div hidden>x</div>", '<ul id="share">x</ul>', '<div style="display: none">x</div>', '<p hidden="">x</p>']
    assert decided(f"<article>{''.join(kept + cut)}</article>") == ["a", "b", "c", "d", "e", "f", "g h i", "j"]


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article><p>Story.</p><div class='comment-list'>great post!</div><div class='user-comments'>me too</div><ul class='x newsletter-signup'><li>Join</li></ul></article>", "Story."),
        ("<article><p>Lunch.</p><div class='menu'>Soup 5 EUR</div><ul class='related'><li>Work</li></ul><section id='search'>How search works</section><div class='promo'>A trailer</div></article>", "Lunch.\n\nSoup 5 EUR\n\nWork\n\nHow search works\n\nA trailer"),
        ("<body><div class='content-header'><h1>Title</h1></div><div class='search-results-article'>Found.</div><div class='site-header'>Home</div><div class='main-nav'>About</div></body>", "Title\n\nFound."),
        ("<body><div class='article-comments'>great</div><p>Text.</p></body>", "Text."),
    ],
)
def test_names_that_mark_and_names_that_do_not(spark, page, want):
    got = extract(spark.createDataFrame([(1, "http://a.com/x", page)], "page_id long, url string, html string")).collect()
    assert [r.text for r in got] == [want]


def test_pages_with_an_article_go_through_the_suffix_array(spark):
    """A notice that stands in most articles of a host goes; copies, what few articles quote, and another host's text stay."""
    rng = random.Random(21)
    words = lambda n: " ".join("%x" % rng.randrange(1 << 40) for _ in range(n))
    notice, quote, story = words(12), words(15), words(60)
    stories = {i: [words(30), words(20)] for i in range(6)}
    stories |= {6: [story], 7: [story], 8: [story[:-5] + " other", words(9)]}  # a copy, and one with a change
    stories[2].append(quote)
    stories[4].append(quote)
    paragraphs = lambda own: "".join(f"<p>{t}</p>" for t in own)
    page = lambda i, own: f"<div>{words(3)}</div><article>{paragraphs(own)}<div>{notice}</div><p>end {i}</p></article>"
    rows = [(i, f"http://h/{i}", page(i, own)) for i, own in stories.items()] + [(20, "http://other/1", page(20, stories[0]))]
    rows += [(30, "http://h/print", f"<body>{paragraphs(stories[0])}</body>")]  # no article, and its text is another page's article
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    whole = {i: "\n\n".join([*own, f"end {i}"]) for i, own in stories.items()}
    assert got == whole | {20: "\n\n".join([*stories[0], notice, "end 20"]), 30: "\n\n".join(stories[0])}


def test_covered_tokens_of_all_pages_against_a_plain_version(spark):
    """Both kinds of streams, every page, against a search over all windows of the host; small alphabets make keys and contexts clash."""
    from pyspark.sql import functions as F

    from cellweave.llm.html_extract import anchors, covers
    from cellweave.llm.windows import union

    rng = random.Random(22)
    streams, rows = [], []
    for i in range(60):
        host, kind = i % 2, i % 3 != 0
        t = [rng.choice("abc") for _ in range(rng.randrange(60))] + (["q%d" % k for k in range(30)] if i % 7 == 0 else [])
        streams.append((host, kind, t))
        rows.append((i, host, i, i, f"<article><p>{' '.join(t)}</p></article>" if kind else f"<p>{' '.join(t)}</p>"))
    pages = spark.createDataFrame(rows, "part int, host long, page long, row long, html string").repartition(3)
    got = {r.row: union([x.asDict() for x in r.spans]) for r in covers(anchors(pages, 8), 8).filter(F.size("spans") > 0).collect()}
    want = {}
    for i, (host, kind, t) in enumerate(streams):
        other = {tuple(u[j : j + 8]) for k, (h, m, u) in enumerate(streams) if (h, m) == (host, kind) and k != i for j in range(len(u) - 7)}
        if spans := [{"s": j, "e": j + 8} for j in range(len(t) - 7) if tuple(t[j : j + 8]) in other]:
            want[i] = union(spans)
    assert got == want and len(want) > 20 and any(streams[i][1] for i in want) and any(not streams[i][1] for i in want)


def test_what_a_tag_says_is_read_once_and_does_not_depend_on_other_pages(monkeypatch):
    from cellweave.llm import html_extract

    calls = []
    marked = html_extract.marked
    monkeypatch.setattr(html_extract, "marked", lambda *x: calls.append(x) or marked(*x))
    page = "<article>" + "".join(f'<div class="lead">a {i}</div><div class="comments">b</div>' for i in range(500)) + "</article>"
    assert html_extract.blocks(page) == [(f"a {i}", True) for i in range(500)] and len(calls) <= 4
    odd = ['<p"b c" d>one</p>', '<p"b c" d>one " two > three</p>', '<p class="a>b">x</p>', "<p class='menu'>y</p>", "<<p>z", "<p hidden", "\x1f a  b\xa0c <b>d</b>"]
    alone = [html_extract.TAGS.clear() or html_extract.blocks(p) for p in odd]
    assert alone == [html_extract.blocks(p) for p in odd] and alone[-1] == [("a b c d", False)]


def test_keys_move_many_in_a_row_and_contexts_that_stand_alone_are_not_sorted(spark, monkeypatch):
    """Copies share every key, and a key of theirs has one context: all of their tokens are covered without a suffix."""
    from cellweave.llm import html_extract

    rng = random.Random(23)
    text = " ".join("%x" % rng.randrange(1 << 40) for _ in range(3000))
    pages = spark.createDataFrame([(i, 0, i, i, f"<p>{text}</p>") for i in range(4)], "part int, host long, page long, row long, html string").coalesce(1)
    sorted_rows, array = [], html_extract.suffix_array
    monkeypatch.setattr(html_extract, "suffix_array", lambda one, *x: sorted_rows.append(one.count()) or array(one, *x))
    got = html_extract.covers(html_extract.anchors(pages, 8), 8).collect()
    assert {r.row: html_extract.union([x.asDict() for x in r.spans]) for r in got} == {i: [(0, 3000)] for i in range(4)}
    assert sorted_rows == [0]
    dealt = html_extract.dealt_keys(pages, 8).collect()
    assert len(dealt) < 1000 < sum(len(r["keys"]) // 8 for r in dealt) // 4
