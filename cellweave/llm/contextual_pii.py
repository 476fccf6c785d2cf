"""Operator 11: personal data by bootstrapped contextual extraction.

Strict patterns of four kinds give the seeds. The words around seeds induce lexical patterns; a bipartite graph of patterns and
instances (a kind and a value) is scored in rounds: a pattern by the share of its places in the whole corpus that hold known
instances, an instance by the best pattern on either side of it. Instances of high-confidence patterns that look like their kind
without matching its strict form (obfuscated, without a prefix, with a wrong check digit) become known, and so on until none is new.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import BYTES, FIRST, LOWER_BYTES, WHITE, U, _cuts, discard, fresh, mix, signed, spread_join, stored, texts, tune, utf8

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

# The strict forms of the contract, in a shape that takes linear time on any text.
BEFORE_AT = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IPS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARDS = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONES = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Loose forms, in which a kind may hide.
MASKED_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:@|[\[({] ?at ?[\])}]) ?[A-Za-z0-9-]++(?:(?:\.| ?[\[({] ?dot ?[\])}] ?)[A-Za-z0-9-]++)*", re.I)
MASKED_IP = re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,3}+(?:(?: \. |[\[({] ?(?:\.|dot) ?[\])}]|,|-)[0-9]{1,3}+){3}(?![0-9A-Za-z.])", re.I)
DIGITS = re.compile(r"(?<![0-9A-Za-z.+])\(?[0-9](?:[ ().\-/]{0,2}[0-9])++(?![0-9A-Za-z])")
TOKEN = re.compile(r"(?<![0-9A-Za-z.+])[0-9](?:[.\-/]?[0-9])++(?![0-9A-Za-z])")
HAS_DIGIT, NOT_DIGIT = re.compile("[0-9]").search, re.compile("[^0-9]+")


def luhn(digits: str) -> bool:
    back = [int(c) for c in reversed(digits)]
    return (sum(back[::2]) + sum(sum(divmod(2 * d, 10)) for d in back[1::2])) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """By each @: what stands before it up to another character or the last match, and a domain after it."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and BEFORE_AT.match(text, start - 1, start):
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            last = domain.end()
            yield start, last
        at = text.find("@", max(last, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the strict forms, by start and kind."""
    out = [(s, e, EMAIL) for s, e in emails(text)] if "@" in text else []
    if HAS_DIGIT(text):
        for m in IPS.finditer(text):
            if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.group().split(".")):
                out.append((*m.span(), IP))
        for m in CARDS.finditer(text):
            if m.end() - m.start() <= 37:
                digits = NOT_DIGIT.sub("", m.group())
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((*m.span(), CARD))
        for m in PHONES.finditer(text) if "+" in text else ():
            if 10 <= sum(map(str.isdigit, m.group())) <= 15:
                out.append((*m.span(), PHONE))
    return sorted(out, key=lambda s: (s[0], s[2]))


def loose_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, kind) of places that look like a kind and overlap no strict form."""
    out = set()
    if "@" in text or re.search(r"[\[({] ?at ?[\])}]", text, re.I):
        out.update((*m.span(), EMAIL) for m in MASKED_EMAIL.finditer(text))
    if HAS_DIGIT(text):
        for m in MASKED_IP.finditer(text):
            if all(int(p) <= 255 for p in re.findall("[0-9]+", m.group())):
                out.add((*m.span(), IP))
        chains: Spans = [[] for _ in KINDS]
        for form in (DIGITS, TOKEN):
            for m in form.finditer(text):
                n = sum(map(str.isdigit, m.group())) if m.end() - m.start() < 60 else 0
                for kind in [k for k, low, high in ((PHONE, 7, 15), (CARD, 13, 19)) if low <= n <= high]:
                    if form is DIGITS:
                        chains[kind].append(m.span())
                    elif touches(m.span(), [chains[kind]]):
                        continue  # a part of a longer place of its kind
                    out.add((*m.span(), kind))
    taken = by_kind(base)
    return sorted(s for s in out if not touches(s[:2], taken))


#: For each kind (start, end) in order, without overlaps.
Spans = list[list[tuple[int, int]]]


def by_kind(spans: list[tuple[int, int, int]]) -> Spans:
    return [[s[:2] for s in spans if s[2] == k] for k in range(len(KINDS))]


def touches(span: tuple[int, int], taken: Spans) -> bool:
    """Whether a taken place has a character of the span."""
    return any((at := bisect.bisect_left(places, (span[1],))) and places[at - 1][1] > span[0] for places in taken)


def value_of(text: str, kind: int) -> str:
    """What spellings of one identifier have in common; long ones by their digest."""
    if kind == EMAIL:
        text = re.sub(r"[\[({]\s*at\s*[\])}]", "@", text.lower())
        text = re.sub(r"[\[({]\s*dot\s*[\])}]", ".", text).replace(" ", "")
    elif kind == IP:
        text = ".".join(str(int(p[-4:])) for p in re.findall("[0-9]+", text))
    else:
        text = NOT_DIGIT.sub("", text)
    return text if len(text) <= 64 else hashlib.md5(text.encode(), usedforsecurity=False).hexdigest()


#: Runs of letters and digits (as one kind of byte) and single signs are tokens; digits count as one digit, A-Z as a-z.
WORD = np.zeros(256, bool)
WORD[[*b"0123456789", *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True
PLAIN = LOWER_BYTES.copy()
PLAIN[[*b"0123456789"]] = BYTES[ord("0")]
ORDER, MOST = U(0x9E3779B97F4A7C15), 3


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the tokens of all texts, and each text's first token."""
    starts, ends, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, U)]
    cuts = _cuts(data, offsets)
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        part = data[lo:hi]
        word, sign = WORD[part], ~WORD[part] & ~WHITE[part]
        before, after = np.zeros(len(part), bool), np.zeros(len(part), bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        inner = offsets[np.searchsorted(offsets, lo, "right") : np.searchsorted(offsets, hi, "left")] - lo
        before[inner], after[inner - 1] = False, False
        s, e = np.flatnonzero(word & ~before | sign), np.flatnonzero(word & ~after | sign) + 1
        starts.append(s + lo)
        ends.append(e + lo)
        hashes.append(mix(FIRST.spans(FIRST.sums(PLAIN[part]), s, e) + (e - s).astype(U)))
    first = np.concatenate(starts)
    return first, np.concatenate(ends), np.concatenate(hashes), np.searchsorted(first, offsets)


def grams(hashes: np.ndarray, first: np.ndarray) -> Iterator[np.ndarray]:
    """For n = 1 to MOST the hash of the n tokens that end at each token, 0 where the text has fewer before it."""
    place = np.arange(len(hashes)) - np.repeat(first[:-1], np.diff(first))
    total = np.zeros(len(hashes), U)
    for n in range(1, MOST + 1):
        total[n - 1 :] = total[n - 1 :] * ORDER + hashes[: len(hashes) - n + 1]
        out = mix(total + U(n))
        out[place < n - 1] = 0
        yield out


SCANNED = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, found array<struct<kind:int,start:long,stop:long,value:string,strict:boolean,patterns:array<struct<side:int,gram:long,words:string>>>>"


def written(spans: list[tuple[int, int, int]]) -> str:
    """Spans as (start, kind, end), in order."""
    return ",".join([f"{KINDS[k]}:{s}:{e}" for s, k, e in spans])


def contexts(texts: list[str], spans: list[list[tuple[int, int, int]]]) -> Iterator[list[list[dict]]]:
    """The patterns around each span: up to three tokens before it, up to two after it, with their words."""
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    data = np.frombuffer(b"".join(raw), np.uint8)
    starts, ends, hashes, first = tokens(data, offsets)
    by_n = [signed(g) for g in grams(hashes, first)]
    for i, (text, mine) in enumerate(zip(texts, spans, strict=True)):
        byte = (lambda k: k) if len(raw[i]) == len(text) else (lambda k, text=text: len(text[:k].encode()))
        out = []
        for s, e, _ in mine:
            left = int(np.searchsorted(ends, offsets[i] + byte(s), "right")) - 1
            right = int(np.searchsorted(starts, offsets[i] + byte(e), "left"))
            around = []
            for n in range(1, MOST + 1):
                if left - n + 1 >= first[i]:
                    around.append((0, by_n[n - 1][left], left - n + 1, left))
                if n < MOST and right + n <= first[i + 1]:
                    around.append((1, by_n[n - 1][right + n - 1], right, right + n - 1))
            out.append([{"side": side, "gram": int(g), "words": data[starts[a] : min(ends[b], starts[a] + 80)].tobytes().decode(errors="replace").lower()} for side, g, a, b in around])
        yield out


def scanned(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Each row's strict spans, and all spans with their values and patterns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        for batch in batches:
            ids, all_texts = batch.column(0).cast(pa.int64()).to_pylist(), texts(batch.column(1))
            base = [base_spans(t) for t in all_texts]
            spans = [sorted([(*s, True) for s in b] + [(*s, False) for s in loose_spans(t, b)]) for t, b in zip(all_texts, base, strict=True)]
            some = [i for i, s in enumerate(spans) if s]
            found: list[list[dict]] = [[] for _ in ids]
            for i, around in zip(some, contexts([all_texts[i] for i in some], [[s[:3] for s in spans[i]] for i in some]), strict=True):
                found[i] = [{"kind": k, "start": s, "stop": e, "value": value_of(all_texts[i][s:e], k), "strict": strict, "patterns": p} for (s, e, k, strict), p in zip(spans[i], around, strict=True)]
            counts = [[sum(s[2] == k for s in b) for b in base] for k in range(4)]
            spelt = [written([(s, k, e) for s, e, k in b]) for b in base]
            columns = [pa.array(ids, pa.int64()), *(pa.array(c, pa.int64()) for c in counts), pa.array([hashlib.sha256(s.encode()).hexdigest() for s in spelt]), pa.array(spelt), pa.array(found, FOUND_TYPE)]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCANNED.split(", ")])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCANNED)


FOUND_TYPE = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("value", pa.string()), ("strict", pa.bool_()), ("patterns", pa.list_(pa.struct([("side", pa.int32()), ("gram", pa.int64()), ("words", pa.string())])))]))
BITS = 1 << 26


def places(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """(gram, places): how often each of the wanted grams occurs in the whole corpus, whatever stands beside it.

    A bitmap of BITS hashed grams, 8 MiB whatever the input, keeps most others out; counts are summed in the tasks first."""
    slot = F.col("gram").bitwiseAND(F.lit(BITS - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    rows = wanted.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()  # at most BITS / 64 rows
    bitmap = np.zeros(BITS // 64, np.uint64)
    bitmap[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        bits, held, size = sent.value, [], 0
        for batch in batches:
            _, _, hashes, first = tokens(*utf8(batch.column(0)))
            for g in grams(hashes, first):
                slots = g & U(BITS - 1)
                hit = (bits[(slots >> U(6)).astype(np.int64)] >> (slots & U(63))) & U(1)
                held.append(np.unique(g[hit.astype(bool) & (g != 0)], return_counts=True))
                size += len(held[-1][0])
            if size > 1 << 20:
                held = [_merged(held)]
                if (size := len(held[0][0])) > 1 << 19:
                    yield _counted(held.pop())
                    size = 0
        if held:
            yield _counted(_merged(held))

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("places"))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(where, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)


def _counted(part: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(signed(part[0])), pa.array(part[1])], ["gram", "n"])


INSTANCE, KEY = ["kind", "value"], ["kind", "side", "gram"]


def bootstrap(found: DataFrame, docs: DataFrame, text: str, support: int, confidence: float, accept: float) -> tuple[DataFrame, DataFrame]:
    """Known instances (kind, value, score, strict) and the strong patterns (kind, side, gram, words, support, confidence)."""
    instances = stored(found.groupBy(*INSTANCE).agg(F.max("strict").alias("strict"), F.sum(F.size("patterns")).alias("n")), "pii-instances")
    edges = found.select(*INSTANCE, F.explode("patterns").alias("p")).select(*INSTANCE, "p.side", "p.gram", "p.words")
    edges = edges.groupBy(*INSTANCE, "side", "gram").agg(F.count("*").alias("times"), F.min("words").alias("words"))
    total = instances.agg(F.sum("n")).first()[0] or 0
    edges = stored(spread_join(edges, instances.select(*INSTANCE, F.col("strict").alias("seed"), "n"), INSTANCE, "n", total, ["side", "gram"]).drop("n"), "pii-edges")
    rate = edges.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("words").alias("words"))
    induced = stored(rate.filter(F.col("n") >= support), "pii-induced")  # the others can never have enough known values
    seen = places(docs, text, induced.select("gram"))
    induced = stored(induced.join(seen, "gram").select(*KEY, "words", "places", "n"), "pii-patterns")
    near = stored(spread_join(edges.drop("words"), induced.select(*KEY, "places", "n"), KEY, "n", total, ["value"]), "pii-graph")
    discard(edges)
    known = instances.filter("strict").select(*INSTANCE, F.lit(1.0).alias("score"))
    n_known, strong = -1, None
    while True:
        known = stored(known, "pii-known")
        if (n := known.count()) == n_known:
            return known.join(instances.select(*INSTANCE, "strict"), INSTANCE), strong
        n_known = n
        counted = known.join(instances, INSTANCE).select(*INSTANCE, "score", "n")
        held = spread_join(near, counted, INSTANCE, "n", total, ["side", "gram"])
        rated = held.groupBy(*KEY, "places").agg(F.count("*").alias("support"), (F.sum(F.col("times") * F.col("score")) / F.col("places")).alias("confidence"))
        rated = rated.filter((F.col("support") >= support) & (F.col("confidence") >= confidence))
        strong = stored(rated.join(induced.select(*KEY, "words", "n"), KEY).withColumn("confidence", F.least("confidence", F.lit(1.0))), "pii-strong")
        mine = spread_join(near.filter("not seed").drop("n", "places"), strong.select(*KEY, "confidence", "n"), KEY, "n", total, ["value"])
        best = lambda side: F.coalesce(F.max(F.when(F.col("side") == side, F.col("confidence"))), F.lit(0.0))
        scored = mine.groupBy(*INSTANCE).agg((1 - (1 - best(0)) * (1 - best(1))).alias("score"))
        known = instances.filter("strict").select(*INSTANCE, F.lit(1.0).alias("score")).unionByName(scored.filter(F.col("score") >= accept))


@F.arrow_udf(StringType())
def joined(base: pa.Array, added: pa.Array) -> pa.Array:
    """Strict spans with the added ones, of which the better scored go first where two overlap."""
    out = []
    for b, new in zip(base.to_pylist(), added.to_pylist(), strict=True):
        taken = by_kind([(int(s), int(e), KINDS.index(k)) for k, s, e in (x.split(":") for x in b.split(",") if x)])
        for a in sorted(new or [], key=lambda a: (-a["score"], a["start"], -a["stop"], a["kind"])):
            if not touches((a["start"], a["stop"]), taken):
                bisect.insort(taken[a["kind"]], (a["start"], a["stop"]))
        out.append(written(sorted((s, k, e) for k, spans in enumerate(taken) for s, e in spans)))
    return pa.array(out, pa.string())


def find_pii(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", support: int = 3, confidence: float = 0.5, accept: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """A row for each row of docs (doc_id, strict spans by kind, their digest, `spans` with the added ones, n_added), and the strong patterns.

    A pattern is strong if it stands beside `support` known values or more and these fill at least `confidence` of all its places in
    the corpus. A loose value is known from `accept` on: 1 - (1 - l)(1 - r) for its best patterns on the left and on the right; or if
    its value is a strict one elsewhere. Rounds go on until no value is new; values are never given up, so they end.
    Null and empty texts have no spans; repeated rows count each; a null doc_id stays null; other columns are not read. An empty table gives none.
    """
    tune(docs.sparkSession)
    rows = stored(scanned(docs, text, doc_id).withColumn("row", F.monotonically_increasing_id()), "pii-rows")
    found = rows.select("row", F.explode("found").alias("f")).select("row", "f.*")
    known, strong = bootstrap(found, docs, text, support, confidence, accept)
    loose = found.filter("not strict").drop("patterns", "strict")
    counted = stored(loose.groupBy(*INSTANCE).count().join(known, INSTANCE), "pii-loose")
    total = counted.agg(F.sum("count")).first()[0] or 0
    added = spread_join(loose, counted.select(*INSTANCE, "score", "count"), INSTANCE, "count", total, ["row"])
    added = added.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "stop", "score")).alias("added"))  # of one text
    base = rows.drop("found")
    more = base.join(added, "row").withColumn("all", joined("spans", "added")).select("row", "all")
    out = base.join(more, "row", "left")
    parts = lambda c: F.when(F.col(c) == "", 0).otherwise(F.size(F.split(c, ","))).cast("long")
    out = out.withColumn("all", F.coalesce("all", "spans")).withColumn("n_added", parts("all") - parts("spans"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.col("all").alias("spans"), "n_added"), strong
