"""Toxicity: Levenshtein automata over a lexicon trie, and windows of context that tell quotation from abuse.

The lexicon and the weights are learnt from labelled rows; nothing is built in but the frames of a quotation.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, stored, tune

#: Marks and verbs that frame a quotation or a mention of a word.
QUOTES = "\"'“”„«»‘’‚‹›`"
FRAMES = frozenset("said says quoted called quote wrote word term sagte nannte zitat wort dit cité mot dijo cita palabra".split())
#: Letters, with digits and signs between them that may stand for letters.
WORD = re.compile(r"[^\W\d_]+(?:[0-9@$!|+*]{1,2}[^\W\d_]+)*")
STEMS = (6, 5, 4)
FEATURES = ["exact", "near", "quoted", "rate", "distinct"]


def within(state: tuple[int, ...], term: str, c: str, k: int) -> tuple[int, ...]:
    """The next state of the Levenshtein automaton of `term`: distances up to k + 1 after one more character."""
    new = [min(state[0] + 1, k + 1)]
    for i, t in enumerate(term):
        new.append(min(state[i] + (t != c), state[i + 1] + 1, new[i] + 1, k + 1))
    return tuple(new)


class Lexicon(dict):
    """Terms in a trie, and as a mapping what each word met so far stands for: (term, distance) or None.

    A word is looked up by walking the trie with the word's Levenshtein automaton; dead states end a branch. A word that
    shares no form with one letter less with any term cannot be within distance 1 and is spared the walk. Two neighbours
    that changed places are one edit.
    """

    LIMIT = 200_000

    def __init__(self, terms: dict[str, float], known: frozenset[str] = frozenset(), fuzzy_from: int = 5):
        self.terms, self.innocent, self.fuzzy_from = terms, known, fuzzy_from
        self.trie: dict = {}
        whole = [t for t in terms if t[-1] != "*"]
        for t in whole:
            node = self.trie
            for c in t:
                node = node.setdefault(c, {})
            node[""] = t
        self.shorter = {t[:i] + t[i + 1 :] for t in whole for i in range(len(t))} | set(whole)

    def __reduce__(self):
        return Lexicon, (self.terms, self.innocent, self.fuzzy_from)

    def _search(self, word: str, k: int) -> tuple[str, int] | None:
        best = None
        stack = [(self.trie, tuple(min(i, k + 1) for i in range(len(word) + 1)))]
        while stack:
            node, state = stack.pop()
            for c, child in node.items():
                if c == "":
                    if state[-1] <= k and (best is None or (state[-1], child) < best):
                        best = (state[-1], child)
                    continue
                new = within(state, word, c, k)
                if min(new) <= k:
                    stack.append((child, new))
        return (best[1], best[0]) if best else None

    def __missing__(self, word: str) -> tuple[str, int] | None:
        """The term a word stands for and its distance, 0 or 1. Words met in clean texts are never taken for misspellings."""
        hit = (word, 0) if word in self.terms else None
        for k in STEMS:
            if hit is None and len(word) > k and word[:k] + "*" in self.terms:
                hit = (word[:k] + "*", 0)
        if hit is None and self.fuzzy_from <= len(word) <= 40 and word not in self.innocent:
            if word in self.shorter or any(word[:i] + word[i + 1 :] in self.shorter for i in range(len(word))):
                swapped = (word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1))
                hit = self._search(word, 1) or next(((w, 1) for w in swapped if w in self.terms), None)
        if len(self) > self.LIMIT:
            self.clear()
        self[word] = hit
        return hit

    def features(self, text: str, window: int = 3) -> np.ndarray:
        """Counts of exact, misspelt and quoted terms, their rate for each 100 words and the number of different terms."""
        exact = near = quoted = n = 0
        weight = 0.0
        met = set()
        words = WORD.findall(text.lower())
        if not any(map(self.__getitem__, words)):
            return np.zeros(len(FEATURES))
        found = list(WORD.finditer(text))
        for i, m in enumerate(found):
            n += 1
            hit = self[m.group().lower()]
            if hit is None:
                continue
            before, after = text[max(0, m.start() - 2) : m.start()].strip(), text[m.end() : m.end() + 2].strip()
            framed = (before[-1:] != "" and before[-1:] in QUOTES and after[:1] != "" and after[0] in QUOTES) or any(x.group().lower() in FRAMES for x in found[max(0, i - window) : i])
            met.add(hit[0])
            weight += self.terms[hit[0]] * (0.25 if framed else 1.0)
            if framed:
                quoted += 1
            elif hit[1]:
                near += 1
            else:
                exact += 1
        return np.array([math.log1p(exact), math.log1p(near), math.log1p(quoted), math.log1p(100.0 * weight / n) if n else 0.0, math.log1p(len(met))])


    def misspelt(self, text: str) -> str | None:
        """The text with each whole term, long enough to be looked up so, less its middle letter; None without one."""
        swap = lambda m: w[: len(w) // 2] + w[len(w) // 2 + 1 :] if (w := m.group()).lower() in self.terms and len(w) > self.fuzzy_from else w
        other = WORD.sub(swap, text)
        return other if other != text else None


class Model:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray, bias: float):
        self.lexicon, self.weights, self.bias = lexicon, weights, bias

    def score(self, text: str) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.lexicon.features(text) @ self.weights + self.bias, -30, 30))))


LEAST, MOST = 3, 2_000


def forms(text: str) -> set[str]:
    """The different words of a text and their stems (`abcd*`)."""
    found = set(WORD.findall(text.lower()))
    return found | {w[:k] + "*" for w in found for k in STEMS if len(w) > k}


def newton(x: np.ndarray, y: np.ndarray, share: np.ndarray, steps: int = 50, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic regression."""
    a = np.column_stack([x, np.ones(len(x))])
    theta = np.zeros(a.shape[1])
    penalty = np.append(np.full(x.shape[1], ridge * share.sum()), 1e-6)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ theta, -30, 30)))
        step = np.linalg.solve((a * (share * p * (1 - p))[:, None]).T @ a + np.diag(penalty) + 1e-9 * np.eye(len(theta)), a.T @ (share * (p - y)) + penalty * theta)
        theta = theta - step
        if np.abs(step).max() < 1e-6:
            break
    # a misspelt or quoted term never speaks against toxicity
    return np.maximum(theta[:-1], 0.0), float(theta[-1])


def learn_lexicon(counts: DataFrame, toxic: int, clean: int, fuzzy_from: int = 5) -> Lexicon:
    """Words and stems that mark toxic texts, from counts(w, a, b): in how many toxic and clean texts each stands.

    In at least LEAST toxic ones, and with a log-odds ratio that its own standard error supports; the MOST best. A stem needs three words of toxic
    texts that it begins, and hardly any clean one. Words met in clean texts that are within reach of a term are known as innocent."""
    a, b, n1, n0 = F.col("a"), F.col("b"), F.lit(float(toxic)), F.lit(float(clean))
    stems = counts.filter("a > 0 and not endswith(w, '*')").select("w", F.explode(F.array(*map(F.lit, STEMS))).alias("k")).filter("length(w) > k")
    ends = stems.groupBy(F.expr("concat(substring(w, 1, k), '*')").alias("w")).agg(F.count("*").alias("ends"))
    odds = F.log((a + 0.5) / (n1 - a + 0.5)) - F.log((b + 0.5) / (n0 - b + 0.5))
    error = F.sqrt(1 / (a + 0.5) + 1 / (n1 - a + 0.5) + 1 / (b + 0.5) + 1 / (n0 - b + 0.5))
    good = counts.filter((a >= LEAST) & (F.length("w") >= 3) & (a > 4 * b)).join(ends, "w", "left").withColumn("score", odds - 2.0 * error).filter(odds - 2.0 * error > 1.0)
    good = good.filter(~F.col("w").endswith("*") | ((F.coalesce("ends", F.lit(0)) >= 3) & (b * 50 <= a) & (a >= 2 * LEAST)))
    lexicon = Lexicon({r.w: r.score for r in good.orderBy(F.desc("score"), F.desc("w")).select("w", "score").limit(MOST).collect()}, frozenset(), fuzzy_from)

    @F.pandas_udf("boolean")
    def near(words: pd.Series) -> pd.Series:
        return words.map(lambda w: lexicon[w] is not None)

    innocent = counts.filter(~F.col("w").endswith("*") & (b > a / 4) & (F.length("w") >= fuzzy_from) & (F.length("w") <= 40)).filter(near("w"))  # at one edit from MOST terms
    return Lexicon(lexicon.terms, frozenset(r.w for r in innocent.select("w").collect() if r.w not in lexicon.terms), fuzzy_from)


def sample(docs: DataFrame, labels: DataFrame, most_rows: int) -> DataFrame:
    """(doc_id, text, toxic, half) of at most `most_rows` labelled rows, in hash order of doc_id."""
    y = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1) and doc_id is not null")
    y = y.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    y = y.join(docs.filter("text is not null and doc_id is not null").select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    rows = docs.filter("text is not null").select("doc_id", "text").join(F.broadcast(y), "doc_id")  # most_rows rows of two numbers
    return rows.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).withColumn("half", F.xxhash64("doc_id").bitwiseAND(F.lit(1)).cast("int"))


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 8_000) -> Model:
    """Fit on at most `most_rows` labelled rows: in hash order of doc_id those of `labels` that are not held out and have a text of any length.

    Rows with a null label, doc_id or text are no examples; rows with several labels count once, as toxic if any label says so; of rows that
    share a doc_id one is an example. The lexicon of one half of the rows weighs the other half, so rare chance terms get no credit; then
    all rows give the lexicon. Words are counted in Spark; only the MOST terms of a lexicon and the features of each row reach the driver.
    """
    rows = stored(sample(docs, labels, most_rows), "toxic-sample")
    n = {(r.half, r.toxic): r["count"] for r in rows.groupBy("half", "toxic").count().collect()}
    size = lambda y, halves=(0, 1): sum(n.get((h, y), 0) for h in halves)
    if not size(0) or not size(1):
        return Model(Lexicon({}), np.zeros(len(FEATURES)), 3.0 if size(1) else -3.0)

    def counted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for text, toxic, half in part.itertuples(index=False):
                yield pd.DataFrame({"w": sorted(forms(text)), "toxic": toxic, "half": half})

    every = rows.select("text", "toxic", "half").mapInPandas(counted, "w string, toxic int, half int").groupBy("w")
    of = lambda y, h: F.count_if((F.col("toxic") == y) & (F.col("half") == h)).alias(f"n{y}{h}")
    words = stored(every.agg(*[of(y, h) for y in (0, 1) for h in (0, 1)]), "toxic-words")
    lexicon = learn_lexicon(words.select("w", (F.col("n10") + F.col("n11")).alias("a"), (F.col("n00") + F.col("n01")).alias("b")), size(1), size(0))
    halves = [learn_lexicon(words.select("w", F.col(f"n1{h}").alias("a"), F.col(f"n0{h}").alias("b")), size(1, (h,)), size(0, (h,))) for h in (0, 1)]

    def measured(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for text, label, half in part.itertuples(index=False):
                other = halves[1 - half]
                # a toxic text stands half for itself and half for its misspelt form, which weighs misspelt terms
                kinds = [text, *([m] if label and (m := other.misspelt(text)) else [])]
                out += [(label, 1 / len(kinds), other.features(t).tolist()) for t in kinds]
            yield pd.DataFrame(out, columns=["y", "share", "x"])

    got = rows.select("text", "toxic", "half").mapInPandas(measured, "y int, share double, x array<double>").collect()  # two rows for an example at most
    got.sort(key=lambda r: (r.y, r.share, r.x))  # sums do not depend on the order of tasks
    weights, bias = newton(np.array([r.x for r in got]), np.array([r.y for r in got], float), np.array([r.share for r in got]))
    discard(rows, words)
    return Model(lexicon, weights, bias)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def toxicity(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """docs with held_out, score and predicted (score >= threshold), one row for each input row.

    Null and empty texts get the score of a text without terms; a null doc_id is not held out; a text's length has no
    bound. Input columns with the names of the new ones are replaced. An empty table gives no rows.
    """
    spark = docs.sparkSession
    tune(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by the lexicon's `most`

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fresh()
        m = shared.value
        for s in parts:
            yield pd.Series([m.score(t or "") for t in s], dtype="float64")
        m.lexicon.clear()  # a reused worker keeps the broadcast model
        fresh()

    own = docs.drop("held_out", "score", "predicted")
    out = own.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("score", score(F.col("text").cast("string")))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
