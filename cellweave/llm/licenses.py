"""License scans: TF-IDF cosine of lines to templates, of blocks and whole texts to standard headers and licence texts, then inheritance from the nearest directory above."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import license_texts
from .common import stored, texts, tune

#: The statements by which files name their licence.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("proprietary", "All rights reserved."),
]
TERM = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


def terms(line: str) -> list[str]:
    return TERM.findall(line.lower())


class Matcher:
    """Cosine of a line to each template, with weights 1 + log tf times idf. Words outside the templates weigh as if in one line."""

    def __init__(self, templates: list[tuple[str, str]], counts: dict[str, int], lines: int):
        self.rare = math.log(1 + lines)
        self.idf = {t: math.log(1 + lines / max(1, counts.get(t, 0))) for _, text in templates for t in terms(text)}
        self.templates = []
        for name, text in templates:
            v = self.vector(Counter(terms(text)))
            self.templates.append((name, v, math.sqrt(sum(x * x for x in v.values()))))

    def vector(self, tf: Counter) -> dict[str, float]:
        return {t: (1 + math.log(n)) * self.idf.get(t, self.rare) for t, n in tf.items()}

    def best(self, line: str, threshold: float) -> tuple[float, str] | None:
        tf = Counter(terms(line))
        v = self.vector(tf)
        norm = math.sqrt(sum(x * x for x in v.values()))
        found = [(sum(w * x for t, x in own.items() if (w := v.get(t))) / (norm * size), name) for name, own, size in self.templates if norm and size]
        top = max(found, key=lambda f: (f[0], f[1]), default=None)
        return top if top and top[0] >= threshold else None


#: A word of each text of license_texts; the beginnings of comment lines; where a line may hold a statement besides others.
GATE = ("license", "licence", "copyright", "permission", "redistribut", "reserved", "spdx", "cc by", "cc-by", "cc0")
COMMENT = re.compile(r"^\s*(?://+!?|/\*+!?|\*+/?|#+|--+|;+|%+|<!--|\.\.|dnl\b|rem\b|\"\"\"|\'\'\')\s?|\s*(?:\*+/|-->)\s*$", re.I)
SIGNS = frozenset("/*#-;%<.\"'dDrR")
SENTENCE = re.compile(r"(?<=[.;!?])\s+|,?\s+(?=all rights reserved)", re.I)


def gated(low: str) -> bool:
    return any(w in low for w in GATE)


class Blocks:
    """TF-IDF cosine of pairs of neighbouring words to the headers (for blocks of lines) and licence texts (for whole texts)."""

    def __init__(self):
        named = [(name, text, False) for name, text in license_texts.HEADERS] + [(name, text, True) for name, text in license_texts.whole()]
        bags = [self.pairs(text) for _, text, _ in named]
        seen = Counter(t for b in bags for t in b)
        self.rare = math.log(1 + len(bags))
        self.idf = {t: math.log(1 + len(bags) / n) for t, n in seen.items()}
        self.templates = []
        for (name, _, whole), bag in zip(named, bags, strict=True):
            v = {t: (1 + math.log(n)) * self.idf[t] for t, n in bag.items()}
            self.templates.append((name, whole, v, math.sqrt(sum(x * x for x in v.values()))))

    @staticmethod
    def pairs(text: str) -> Counter:
        words = terms(text)
        return Counter(zip(words, words[1:], strict=False))

    def best(self, text: str, whole: bool, threshold: float) -> tuple[float, str] | None:
        """The best header for a block, or the best licence text for a whole text."""
        known, all_ = {}, 0.0
        for t, n in self.pairs(text).items():
            idf = self.idf.get(t)
            w = (1 + math.log(n)) * (idf or self.rare)
            all_ += w * w
            if idf:
                known[t] = w
        if sum(w * w for w in known.values()) < threshold * threshold * all_ or not known:
            return None  # no cosine is larger than the share of the known pairs
        found = [(sum(w * own[t] for t, w in known.items() if t in own) / (math.sqrt(all_) * size), name) for name, full, own, size in self.templates if whole == full]
        top = max(found)
        return (min(top[0], 1.0), top[1]) if top[0] >= threshold else None


def paragraphs(text: str) -> tuple[list[str], str]:
    """Blocks of lines between blank ones or where comments begin or end, without comment signs; and the first comment or block, blank lines inside it included."""
    out: list[list[str]] = [[]]
    head: list[str] = []
    kind, in_head = None, True
    for line in text.split("\n"):
        bare = line.strip()
        if comment := bare[:1] in SIGNS or bare[-2:] == "*/":
            bare = COMMENT.sub("", COMMENT.sub("", bare)).strip()
            comment = bare != line.strip()
        if bare and kind is not None and comment != kind:
            out.append([])
            in_head = in_head and not any(head)
        if not bare:
            out.append([])
            in_head = in_head and (comment or kind is not False)
            continue
        kind = comment
        out[-1].append(bare)
        if in_head:
            head.append(bare)
    return [" ".join(b) for b in out if b], " ".join(head)


def vocabulary(templates: list[tuple[str, str]]) -> set[str]:
    return {t for _, text in templates for t in terms(text)}


def line_counts(files: DataFrame, templates: list[tuple[str, str]]) -> tuple[dict[str, int], int]:
    """How many lines of all texts have each term of the templates, and how many lines there are; what comes to the driver is a row for each such term."""
    vocab = vocabulary(templates)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        n = 0
        for batch in batches:
            for text in texts(batch.column("text")):
                for line in text.split("\n"):
                    n += 1
                    low = line.lower()
                    if hit := vocab.intersection(low.split()) or vocab.intersection(TERM.findall(low)):
                        counts.update(vocab.intersection(TERM.findall(low)) if hit else ())
        counts[""] = n
        yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

    got = files.select(F.col("text").cast("string").alias("text")).mapInArrow(rows, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    counts = {r.term: r.n for r in got.collect()}
    return counts, counts.pop("", 0)


def license_scan(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.6) -> DataFrame:
    """files(path, text, ...) with license, score, found_in ('text', 'directory' or 'none') and license_from (a path).

    The best line, sentence of a line, block of lines or whole text gives a text's own license (ties: the greater name); "proprietary"
    counts only without a block. A licence file is one named LICENSE, LICENCE or
    COPYING, one of which every line that is not blank names one license, or one that is a licence text as a whole; it stands for its directory. A file without a
    license of its own has that of the nearest directory above it with one (of several licence files there, the best
    score, then the smallest path). Null texts are empty; a null path inherits nothing; repeated paths inherit alike;
    input columns with the new names are replaced; an empty table gives no rows.
    """
    spark = files.sparkSession
    tune(spark)
    files = files.drop("license", "score", "found_in", "license_from")
    counts, lines = line_counts(files, templates)
    shared = spark.sparkContext.broadcast((Matcher(templates, counts, lines), Blocks()))
    vocab = vocabulary(templates)

    @F.arrow_udf("struct<license: string, score: double, whole: boolean>")
    def scan(text: pa.Array) -> pa.Array:
        (matcher, wide), out = shared.value, []
        for t in texts(text):
            best, blank, other, names = None, 0, 0, set()
            near = gated(t.lower())
            for line in t.split("\n"):
                low = line.lower()
                hit = None
                if len(vocab.intersection(low.split())) or len(vocab.intersection(TERM.findall(low))):
                    hit = matcher.best(low, threshold)
                    if near and not hit and gated(low):  # a statement among others of its line names a license, but not the line as a whole
                        best = max([x for s in SENTENCE.split(low) if (x := matcher.best(s, threshold))] + ([best] if best else []), default=None)
                if hit:
                    names.add(hit[1])
                    best = max(best or hit, hit)
                elif line.strip():
                    other += 1
            full = None
            if near:
                blocks, head = paragraphs(t)
                full = wide.best(" ".join(blocks), True, threshold)
                found = [x for b in {*blocks, head} if gated(b.lower()) and (x := wide.best(b, False, threshold))] + ([full] if full else [])
                if found:  # such texts reserve all other rights besides
                    best = max([*found, *([best] if best and best[1] != "proprietary" else [])])
            out.append({"license": best[1] if best else None, "score": best[0] if best else 0.0, "whole": full is not None or not other and len(names) == 1})
        return pa.array(out, pa.struct([("license", pa.string()), ("score", pa.float64()), ("whole", pa.bool_())]))

    scanned = files.withColumn("__own", scan(F.col("text").cast("string")))
    named = F.upper(F.regexp_extract("path", r"([^/.]+)[^/]*$", 1)).isin("LICENSE", "LICENCE", "COPYING")
    slim = scanned.filter("__own.license is not null and path is not null").filter(named | F.col("__own.whole"))
    slim = slim.select("path", "__own")
    here = F.regexp_replace("path", r"/?[^/]*$", "")
    dirs = slim.groupBy(here.alias("dir")).agg(F.min_by(F.struct(F.col("__own.license").alias("license"), "path"), F.struct(-F.col("__own.score"), "path")).alias("given"))
    dirs = stored(dirs, "directories")
    above = F.transform(F.sequence(F.lit(0), F.size(F.split("path", "/")) - 1), lambda i: F.array_join(F.slice(F.split("path", "/"), 1, i), "/"))
    paths = files.select("path").filter("path is not null").distinct()
    chains = paths.select("path", F.explode(above).alias("dir"))
    nearest = chains.join(dirs, "dir").groupBy("path").agg(F.max_by("given", F.length("dir")).alias("__given"))
    out = scanned.join(nearest, "path", "left")
    own = F.col("__own.license").isNotNull()
    given = F.col("__given").isNotNull()
    return out.select(
        *[c for c in files.columns],
        F.coalesce("__own.license", "__given.license").alias("license"),
        F.round(F.col("__own.score"), 9).alias("score"),
        F.when(own, "text").when(given, "directory").otherwise("none").alias("found_in"),
        F.when(own, F.col("path")).otherwise(F.col("__given.path")).alias("license_from"),
    )
