"""Near-duplicate documents by b-bit MinHash.

Equal shingle sets are merged first. Minima of PERMS hash functions make BANDS bands of ROWS rows; at similarity 0.75 a
pair shares no band with probability (1 - 0.75 ** 4) ** 48, about 1e-8. Two low bits of each minimum are packed into bit
planes; equal places, counted by bits and corrected for chance agreement, estimate the similarity of candidates, and
only pairs whose estimate is within 4.5 standard deviations of the threshold are compared by their full sets.

A band bucket of any size costs a pair for each member in a round: every member meets one centre. Two rounds with
other centres join nearly all of a group of copies. What is still apart inside a bucket is compared in pairs of blocks,
both of bounded size, each pair of classes in the first of its bands only: bit planes tell which classes of a pair of
blocks have a candidate there, and only these come back with their full sets. So no link is lost, no pair is written
before it is confirmed, and no task holds a whole group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FIRST, LOWER_BYTES, U, discard, fresh, mix, signed, spread_join, stored, tune, utf8, whole_groups, words

PERMS, ROWS = 192, 4
BANDS = PERMS // ROWS
MULTIPLIERS = mix(np.arange(1, PERMS + 1, dtype=U) * U(0xD6E8FEB86659FD93)) | U(1)
SKETCH = "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, planes array<long>"
SET = ["s1", "s2", "n_shingles"]
#: Rows of a block, shingles of a block, and members that meet a centre in one task.
BLOCK, BLOCK_SHINGLES, CHUNK = 1024, 1 << 19, 256


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of k words."""
    data, offsets = utf8(column)
    _, _, hashes, first = words(data, offsets, LOWER_BYTES)
    sums = FIRST.sums(hashes)
    every = mix(FIRST.windows(sums, k)) if len(hashes) >= k else hashes[:0]
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        n = b - a
        if n >= k:
            yield np.unique(every[a : b - k + 1])
        elif n:
            yield mix(FIRST.spans(sums, np.array([a]), np.array([b])) ^ U(n))
        else:
            yield hashes[:0]


def second(own: np.ndarray) -> np.uint64:
    return mix(own ^ U(0x5851F42D4C957F2D)).sum(dtype=U)


def minima(own: np.ndarray) -> np.ndarray:
    out = np.full(PERMS, np.iinfo(np.uint64).max, U)
    for i in range(0, len(own), 512):
        np.minimum(out, (own[i : i + 512, None] * MULTIPLIERS).min(axis=0), out=out)
    return mix(out)


def sketches(k: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        for batch in batches:
            m = batch.num_rows
            n, s1, s2 = np.zeros(m, np.int64), np.zeros(m, U), np.zeros(m, U)
            low = np.zeros((m, PERMS), U)
            for i, own in enumerate(shingle_sets(batch.column("text"), k)):
                n[i] = len(own)
                if len(own):
                    low[i] = minima(own)
                    s1[i], s2[i] = own.sum(dtype=U), second(own)
            bands = np.zeros((m, BANDS), U)
            for j in range(BANDS):
                h = np.full(m, U(j + 1))
                for r in range(ROWS):
                    h = mix(h * U(0x9E3779B97F4A7C15) + low[:, j * ROWS + r])
                bands[:, j] = h
            planes = [np.packbits(((low >> U(b)) & U(1)).astype(np.uint8), axis=1, bitorder="little").view("<u8") for b in (0, 1)]
            planes = np.concatenate(planes, axis=1)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * x.shape[1]), pa.array(signed(np.ascontiguousarray(x).ravel().astype(U)))) for x in (bands, planes)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(signed(s1)), pa.array(signed(s2)), *lists], names=["doc_id", "n_shingles", "s1", "s2", "bands", "planes"])

    return rows


def set_rows(k: int):
    """mapInArrow function: (id, s1, s2, text) to (id, shingles), for the texts whose set is the one asked for."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s1, s2 = (batch.column(c).to_numpy().view(U) for c in ("s1", "s2"))
            own, at = [], []
            for i, x in enumerate(shingle_sets(batch.column("text"), k)):
                if (x.sum(dtype=U), second(x)) == (s1[i], s2[i]):
                    own.append(x)
                    at.append(i)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
            flat = pa.array(signed(np.concatenate([np.zeros(0, U), *own])))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int64())), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["id", "shingles"])

    return rows


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of each node of edges(a, b): each round, every node's neighbours go to the smallest one.

    Alternates large-star and small-star steps; each round's edges are written to the shared folder. A node with very
    many neighbours is no single key of a join.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    while True:
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
        now = ends.agg(F.sum("up").alias("n"), F.sum(F.when((F.col("up") > 1) | (F.col("up") * F.col("down") > 0), 1)).alias("open")).first()
        if not now.open:  # every edge leads to a node without smaller neighbours
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = spread_join(both, low, ["a"], "n", 2 * now.n, ["b"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.filter("a <> b").distinct(), "edges")
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        joined = spread_join(large, low, ["a"], "n", now.n, ["b"])
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b")))
        before, edges = edges, stored(small.filter("a <> b").distinct(), "edges")
        discard(before, large)


def estimate(a, b):
    """Similarity from bit planes: a place agrees if both bits do; agreement by chance is 1/4."""
    words = PERMS // 64
    apart = sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))).bitwiseOR(F.get(a, F.lit(i + words)).bitwiseXOR(F.get(b, F.lit(i + words))))) for i in range(words)), F.lit(0))
    return 1 - (apart / F.lit(float(PERMS))) / 0.75


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 75, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of docs.

    Documents whose sets of k-word shingles (A-Z lower-cased, words as runs of characters other than ASCII white space; a
    text with fewer words is one shingle) have 100 * intersection >= percent * union are linked; component_id is the
    smallest doc_id that links reach, and that row is kept. Texts without words, null texts among them, are linked with
    nothing. Rows that share a doc_id are one document for links, whether their texts are equal or not; each row has the
    n_shingles of its own text. A row with a null doc_id is left out of the links: its component_id is null and it is
    kept. Other columns are ignored; an empty table gives no rows. `block`: classes in a block.
    """
    tune(docs.sparkSession, 500, 4)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = stored(slim.mapInArrow(sketches(k), SKETCH), "sketches")
    real = sketch.filter("n_shingles > 0 and doc_id is not null")
    merged = real.groupBy(*SET).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first"), F.min_by(F.struct("bands", "planes"), "doc_id").alias("sig"))
    classes = stored(merged.select(F.monotonically_increasing_id().alias("id"), *SET, "copies", "first", "sig.bands", "sig.planes"), "classes")
    total = sketch.count()
    n_classes = classes.count()
    keys = sketch.select("doc_id", "n_shingles", *(F.when(F.col("doc_id").isNotNull(), F.col(c)).alias(c) for c in ("s1", "s2")))
    of = stored(spread_join(keys, classes.select(*SET, "id", "copies"), SET, "copies", total, ["doc_id"], "left").select("doc_id", "n_shingles", "id"), "members")
    discard(sketch)
    several = of.filter("id is not null").groupBy("doc_id").agg(F.min("id").alias("b"), F.max("id").alias("z")).filter("b <> z").select("doc_id", "b")
    one_doc = of.join(several, "doc_id").select(F.col("id").alias("a"), "b").filter("a <> b").distinct()

    rows = classes.select("id", F.posexplode("bands").alias("band", "key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("size"), *(F.min_by("id", F.xxhash64("id", F.lit(t))).alias(f"centre{t}") for t in (0, 1))).filter("size > 1")
    shared = stored(shared, "shared")
    buckets = stored(spread_join(rows, shared, ["key"], "size", BANDS * n_classes, ["id"]), "buckets")
    wanted = classes.join(buckets.select("id").distinct(), "id").select("id", "s1", "s2", F.col("first").alias("doc_id"))
    sets = slim.join(wanted, "doc_id").select("id", "s1", "s2", "text").mapInArrow(set_rows(k), "id long, shingles array<long>")
    sets = stored(sets.dropDuplicates(["id"]), "sets")  # repeated rows of a table
    facts = classes.select("id", F.col("n_shingles").alias("n"), "bands", "planes")
    margin = percent / 100 - 4.5 * 0.039

    edges = stored(one_doc, "links")
    component = facts.select(F.col("id").alias("node"), F.col("id").alias("component")).limit(0)
    for turn in range(2):
        at = facts.select("id", "n", "planes").join(component, facts.id == component.node, "left").select("id", "n", "planes", F.coalesce("component", "id").alias("component"))
        pairs = stored(buckets.select("id", F.col(f"centre{turn}").alias("centre")).filter("id <> centre").distinct(), "pairs")
        centres = pairs.groupBy("centre").agg(F.count("*").alias("members"))
        centres = centres.join(at.toDF("centre", "cn", "cplanes", "ccomponent"), "centre")
        p = spread_join(pairs.join(at, "id"), centres, ["centre"], "members", pairs.count(), ["id"])
        p = p.filter("component <> ccomponent").filter(100 * F.least("n", "cn") >= percent * F.greatest("n", "cn")).filter(estimate(F.col("planes"), F.col("cplanes")) >= margin)
        chunk = F.pmod(F.xxhash64("id"), F.ceil(F.col("members") / CHUNK))
        p = stored(p.select("id", "centre", chunk.alias("chunk")), "candidates")
        found = stored(with_centres(p, sets, percent), "links")
        discard(pairs, p)
        edges = edges.unionByName(found)
        component = components(edges)
    rest = stored(between_blocks(buckets, component, facts, sets, percent, margin, block), "links")
    whole = components(edges.unionByName(rest))
    named = classes.select("id", "first", "copies").join(whole, classes.id == whole.node, "left").withColumn("component", F.coalesce("component", "id"))
    roots = named.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("parts"))
    named = spread_join(named.select("id", "copies", "component"), roots, ["component"], "parts", n_classes, ["id"]).select("id", "copies", "component_id")
    out = spread_join(of, named, ["id"], "copies", total, ["doc_id"], "left")
    component_id = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component_id.alias("component_id"), F.coalesce(F.col("doc_id") == component_id, F.lit(True)).alias("kept"))


def with_centres(candidates: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links among candidates(id, centre, chunk): a centre's set stands before the sets of a chunk of its members, which stream past it."""
    members = candidates.join(sets, "id").select("centre", "chunk", F.lit(1).alias("place"), "id", "shingles")
    lead = candidates.select("centre", "chunk").distinct().join(sets.withColumnRenamed("id", "centre"), "centre").select("centre", "chunk", F.lit(0).alias("place"), F.col("centre").alias("id"), "shingles")
    at = lead.unionByName(members).repartition("centre", "chunk").sortWithinPartitions("centre", "chunk", "place")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, np.int64)
        for batch in batches:
            a, b = [], []
            centre, place, node = (batch.column(c).to_pylist() for c in ("centre", "place", "id"))
            flat, at = lists(batch.column("shingles"))
            for i, c in enumerate(centre):
                x = flat[at[i] : at[i + 1]]
                if not place[i]:
                    own = x.copy()
                elif similar(own, x, percent):
                    a.append(node[i])
                    b.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return at.mapInArrow(links, "a long, b long")


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column and where each list begins."""
    at = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False), at


def similar(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have enough in common."""
    if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
        return False
    both = len(np.intersect1d(p, q, assume_unique=True))
    return 100 * both >= percent * (len(p) + len(q) - both)


def between_blocks(buckets: DataFrame, component: DataFrame, facts: DataFrame, sets: DataFrame, percent: int, margin: float, block: int = BLOCK) -> DataFrame:
    """Links between classes of a bucket that are still in different components.

    Outsiders, the members outside a bucket's largest component, are dealt to blocks of about `block` members and
    BLOCK_SHINGLES shingles, and so are the others. A block of outsiders meets each block of its bucket, itself included.
    """
    at = buckets.filter("size > 2").select("id", "band", "key")  # of two members one was the centre
    at = at.join(facts.select("id", "n").join(component, facts.id == component.node, "left").select("id", "n", F.coalesce("component", "id").alias("component")), "id")
    at = stored(at, "apart")
    counts = at.groupBy("key", "component").agg(F.count("*").alias("rows"), F.sum("n").alias("w"))
    main = counts.groupBy("key").agg(F.max_by(F.struct("component", "rows", "w"), F.struct("rows", "component")).alias("main"), F.sum("rows").alias("size"), F.sum("w").alias("w"), F.count("*").alias("parts")).filter("parts > 1")
    blocks = lambda n, w: F.greatest(F.ceil(n / block), F.ceil(w / BLOCK_SHINGLES)).cast("int")
    main = main.select("key", "size", F.col("main.component").alias("main"), blocks(F.col("size") - F.col("main.rows"), F.col("w") - F.col("main.w")).alias("outer"), blocks(F.col("main.rows"), F.col("main.w")).alias("inner"))
    at = spread_join(at, stored(main, "buckets"), ["key"], "size", at.count(), ["id"])
    outside = F.col("component") != F.col("main")
    own = F.when(outside, F.pmod(F.xxhash64("id"), "outer")).otherwise(F.col("outer") + F.pmod(F.xxhash64("id"), "inner")).cast("int")
    at = at.withColumn("own", own).join(facts.select("id", "bands", "planes"), "id")
    partners = F.sequence(F.lit(0), F.when(outside, F.col("outer") + F.col("inner")).otherwise(F.col("outer")) - 1)
    at = at.withColumn("partner", F.explode(partners))
    columns = ["key", F.least("own", "partner").alias("x"), F.greatest("own", "partner").alias("y"), "own", "id", "component", "n", "band", "bands", "planes"]
    at = at.select(*columns).repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "id")
    group = ["key", "x", "y"]

    def candidates(t: pa.Table, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows p and q, with estimates, of the pairs of a group that may be linked and have no earlier band in common."""
        x, y, band = t.column("x")[a].as_py(), t.column("y")[a].as_py(), t.column("band")[a].as_py()
        own, comp, n = (t.column(c).slice(a, b - a).to_numpy() for c in ("own", "component", "n"))
        planes = t.column("planes").slice(a, b - a).combine_chunks().flatten().to_numpy().view(U).reshape(b - a, -1)
        bands = t.column("bands").slice(a, b - a).combine_chunks().flatten().to_numpy().reshape(b - a, -1)
        w = PERMS // 64
        left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
        ps, qs, es = [], [], []
        for i in range(0, len(left), step := max(1, 200_000 // max(1, len(right)))):
            some = left[i : i + step]
            apart = np.zeros((len(some), len(right)), np.int16)
            for j in range(w):
                apart += np.bitwise_count((planes[some, None, j] ^ planes[None, right, j]) | (planes[some, None, j + w] ^ planes[None, right, j + w]))
            ok = (1 - apart / PERMS / 0.75 >= margin) & (comp[some, None] != comp[None, right])
            ok &= 100 * np.minimum(n[some, None], n[None, right]) >= percent * np.maximum(n[some, None], n[None, right])
            p, q = np.nonzero(ok)
            e = apart[p, q]
            p, q = some[p], right[q]
            new = ~(bands[p, :band] == bands[q, :band]).any(axis=1) & ((p < q) | (x != y))
            ps.append(p[new])
            qs.append(q[new])
            es.append(e[new])
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *ps]) + a, np.concatenate([none, *qs]) + a, np.concatenate([none, *es])

    def hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, group):
            yes = np.zeros(len(t), bool)
            for a, b in zip(at, at[1:], strict=False):
                if b - a > 1:
                    p, q, _ = candidates(t, a, b)
                    yes[p] = yes[q] = True
            yield from t.filter(pa.array(yes)).combine_chunks().to_batches()

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, group, 1):
            out_a, out_b = [], []
            node, comp = t.column("id").to_pylist(), t.column("component").to_pylist()
            for a, b in zip(at, at[1:], strict=False):
                own = t.column("shingles").slice(a, b - a).combine_chunks()
                parent = {c: c for c in comp[a:b]}

                def root(x: int, parent: dict = parent) -> int:
                    while parent[x] != x:
                        parent[x] = x = parent[parent[x]]
                    return x

                p, q, e = candidates(t, a, b)
                for i in np.argsort(e, kind="stable").tolist():
                    i, j = int(p[i]), int(q[i])
                    if root(comp[i]) != root(comp[j]) and similar(own[i - a].values.to_numpy(), own[j - a].values.to_numpy(), percent):
                        out_a.append(node[i])
                        out_b.append(node[j])
                        parent[root(comp[i])] = root(comp[j])
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    first = stored(at.mapInArrow(hopeful, at.schema), "hopeful")
    both = first.join(sets, "id").select(*at.columns, "shingles").repartition(*group).sortWithinPartitions(*group, "id")
    return both.mapInArrow(links, "a long, b long")
