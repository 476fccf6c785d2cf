"""The pipeline on a small corpus against plain versions of its stages."""

import random

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

pipeline = pytest.importorskip("corpus_pipeline")
from test_near_duplicates import plain  # noqa: E402
from test_operators import plain_tiling  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(21)
    words = ["%s%s" % (a, b) for a in "bcdfghjklm" for b in ("ano", "eri", "olu", "ita", "usa", "emo")]
    make = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, " ".join("t%dq%d" % (i, j) for j in range(16))) for i in range(3)]
    texts, toxic = [], {}
    for i in range(160):
        own = make(60)
        if i % 4 == 0:
            own[5] = "vilest"
            toxic[i] = 1
        elif i < 120:
            toxic[i] = 0
        if i % 10 == 3:
            w = items[i % 3][1].split()
            own[10:10] = w[8:] + ["and"] + w[:8]
        texts.append(" ".join(own))
    texts += [None, "", " ", texts[1].upper(), texts[1], texts[7] + " tail", texts[7] + " tail end", "x " + texts[9]]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return rows + [(None, texts[17] + " more", "en", "s", 1), (None, None, "en", "s", 0)], items, toxic


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, items, toxic = corpus()
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_and_run(spark, folder):
    rows, items, _ = corpus()
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), rows
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.schema.names == [c.split()[0] for c in SCHEMA.split(", ")]
        if name == "toxicity":
            kept = [r for r in kept if "vilest" not in (r[1] or "")]
        elif name == "exact dedup":
            low = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
            key = lambda r: (r[1] or "").encode().translate(low)
            best = {}
            for r in kept:
                best[key(r)] = max(-1 if r[0] is None else r[0], best.get(key(r), -1))
            kept = [r for r in kept if best[key(r)] == (-1 if r[0] is None else r[0])]
        elif name == "near dedup":
            of = plain([r[:2] for r in kept if r[0] is not None])
            kept = [r for r in kept if r[0] is None or of[r[0]] == r[0]]
        else:
            tiled = lambda t, d: sum(x[2] for x in plain_tiling(t, d, 5))
            kept = [r for r in kept if all(2 * tiled(t.split(), (r[1] or "").lower().split()) < len(t.split()) for _, t in items)]
        before, docs = docs, docs.cache()
        assert sorted(map(str, map(tuple, docs.collect()))) == sorted(map(str, kept)), name
        assert docs.filter("doc_id % 2 = 0").count() and before.count() == len(kept) < len(rows)
    tokenizer = Tokenizer.from_file(str(P.path("word_bpe_49k.json")))
    want = sorted((-1 if r[0] is None else r[0], len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + 1) for r in kept)
    pieces = pipeline.run(spark, folder).collect()
    whole = sorted((-1 if r.doc_id is None else r.doc_id, r.doc_tokens) for r in pieces if r.start == 0)
    assert whole == want and sum(r.length for r in pieces) == sum(n for _, n in want)
    at = sorted(r.sequence_id * 2048 + r.offset for r in pieces)
    assert at[0] == 0 and at == sorted(np.cumsum([0, *(r.length for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)))])[:-1].tolist())


def test_stages_of_an_empty_table(spark, folder):
    none = spark.createDataFrame([], SCHEMA)
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0
