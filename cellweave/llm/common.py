"""What the text operators share: intermediate tables, Arrow text buffers, hashing and public tokenizers."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
MIX1, MIX2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession, rows: int = 2000, mb: int = 16) -> None:
    """Small Arrow batches bound the memory of a Python worker; shuffle files go when the job that made them ends."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of this machine only where none is set and all runs in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="cellweave-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of `df` by a table written once in the shared folder; a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cellweave-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of `stored` that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        jvm.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(jvm, True)


#: A key is hot if it has more than 1 / HOT of all rows; so there are fewer than HOT of them, whatever the data.
HOT = 1000


def spread_join(many: DataFrame, one: DataFrame, on: list[str], count: str, total: int, by: list[str], how: str = "inner") -> DataFrame:
    """many joined with `one`, which has a row for each key and the number of its rows in the column `count`.

    The hot keys' rows of `one`, fewer than HOT as the counts add up to `total` at most, are sent to every task. Rows of
    `many` with a hot or null key need no partner from the shuffle: they are dealt by a hash of `by`, so no task gets a
    whole hot key. how: inner or left.
    """
    payload = [c for c in one.columns if c not in on]
    packed = F.struct(*payload)
    hot = one.filter(F.col(count) > total // HOT).select(*on, packed.alias("__hot"))
    rest = one.filter(F.col(count) <= total // HOT).select(*on, packed.alias("__rest"), F.lit(0).alias("__salt"))
    left = many.join(F.broadcast(hot), on, "left")  # fewer than HOT rows
    none = F.lit(False)
    for c in on:
        none = none | F.col(c).isNull()
    left = left.withColumn("__salt", F.when(none | F.col("__hot").isNotNull(), 1 + F.pmod(F.xxhash64(*by), F.lit(1 << 20))).otherwise(0).cast("int"))
    out = left.join(rest, [*on, "__salt"], "left").withColumn("__got", F.coalesce("__hot", "__rest"))
    if how == "inner":
        out = out.filter("__got is not null")
    return out.select(*many.columns, *(F.col(f"__got.{c}").alias(c) for c in payload if c not in many.columns))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 4000) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables of whole groups, and where each group begins (and the last ends); rows come sorted by the keys, which are integers."""
    held: list[pa.RecordBatch] = []
    n, first = 0, 0

    def edges(t: pa.Table) -> list[int]:
        new = np.zeros(len(t), bool)
        for k in keys:
            v = t.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return [0, *np.flatnonzero(new).tolist()]

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n < first + rows:
            continue
        t = pa.Table.from_batches(held)
        at = edges(t)
        if at[-1]:
            yield t.slice(0, at[-1]), at
        rest = t.slice(at[-1])
        held, n = rest.to_batches(), len(rest)
        first = n  # a long group is looked at again when it has grown
    if held:
        t = pa.Table.from_batches(held)
        yield t, [*edges(t), len(t)]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, one text after the other, and the offsets of the texts; null is empty."""
    a = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U(30))
    x *= MIX1
    x ^= x >> U(27)
    x *= MIX2
    x ^= x >> U(31)
    return x


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def fresh() -> None:
    """At the start of a task of another operator: a reused worker gives back what the tokenizing ones kept, and free memory to the system."""
    PieceCache._of.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


class Rolling:
    """Polynomial hashes over 64-bit words: every window of a sequence costs two array operations."""

    def __init__(self, base: int):
        self.base, self.inverse, self.n = base, pow(base, -1, 1 << 64), 0

    def _grow(self, n: int) -> None:
        if n > self.n:
            m = max(n, 1 << 16)
            for name, b in (("up", self.base), ("down", self.inverse)):
                a = np.full(m, U(b))
                a[0] = 1
                with np.errstate(over="ignore"):
                    setattr(self, name, np.cumprod(a))
            self.n = m

    def sums(self, symbols: np.ndarray) -> np.ndarray:
        self._grow(len(symbols) + 1)
        out = np.zeros(len(symbols) + 1, U)
        np.cumsum(symbols * self.up[: len(symbols)], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (sums[ends] - sums[starts]) * self.down[starts]

    def windows(self, sums: np.ndarray, k: int) -> np.ndarray:
        n = len(sums) - k
        return (sums[k:] - sums[:n]) * self.down[:n]


FIRST, SECOND = Rolling(0x9E3779B97F4A7C15), Rolling(0xD1342543DE82EF95)
BYTES = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
LOWER_BYTES = BYTES.copy()
LOWER_BYTES[ord("A") : ord("Z") + 1] = BYTES[ord("a") : ord("z") + 1]
PIECE = 1 << 18


def _cuts(data: np.ndarray, offsets: np.ndarray) -> list[int]:
    """Places at which no word is cut: between texts or after white space, PIECE bytes apart where words allow."""
    cuts, pos, n = [0], 0, len(data)
    while pos < n:
        end = pos + PIECE
        if end < n:
            white = np.flatnonzero(WHITE[data[pos:end]])
            text = int(offsets[np.searchsorted(offsets, end, "right") - 1])
            back = max(text, pos + int(white[-1]) + 1 if len(white) else 0)
            while back <= pos and end < n:  # a single word: go on to its end
                step = data[end : end + PIECE]
                white, text = np.flatnonzero(WHITE[step]), int(offsets[np.searchsorted(offsets, end, "left")])
                back = min(text, end + int(white[0]) + 1 if len(white) else text if text <= end + PIECE else n + 1)
                if back > n:
                    back, end = pos, end + PIECE
            end = back if back > pos else n
        pos = min(end, n)
        cuts.append(pos)
    return cuts


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` of all texts, and each text's first word."""
    starts, ends, hashes = [], [], []
    cuts = _cuts(data, offsets)
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        part = data[lo:hi]
        solid = ~WHITE[part]
        inner = offsets[np.searchsorted(offsets, lo, "right") : np.searchsorted(offsets, hi, "left")] - lo
        before, after = np.zeros(len(part), bool), np.zeros(len(part), bool)
        before[1:], after[:-1] = solid[:-1], solid[1:]
        before[inner], after[inner - 1] = False, False
        s, e = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
        sums = FIRST.sums(table[part])
        starts.append(s + lo)
        ends.append(e + lo)
        hashes.append(mix(FIRST.spans(sums, s, e) + (e - s).astype(U)))
    none = np.zeros(0, np.int64)
    starts = np.concatenate([none, *starts])
    return starts, np.concatenate([none, *ends]), np.concatenate([none.view(U), *hashes]), np.searchsorted(starts, offsets)


def texts(column: pa.Array) -> list[str]:
    return pc.fill_null(column.cast(pa.large_string()), "").to_pylist()


ODD_SPACE = "[\x1c\x1d\x1e\x1f\x85\xa0\u1680\u180e\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]"
#: Letters and signs on which the pattern libraries of Python and of the tokenizers agree, with no composition to do.
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-ſ"
SIGNS = "\\t-\\r\\x20-\\x7e\xa1-\xa9\xab\xac\xae-\xb1\xb4\xb6-\xb8\xbb\xbf\xd7\xf7‐-‧‰-⁞₠-₿"
#: What the patterns of the two public tokenizers split off after an apostrophe.
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
LETTER, DIGIT, SIGN, SPACE = range(4)
KIND = np.full(256, SIGN, np.uint8)
KIND[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", *range(0x80, 0x100)]] = LETTER
KIND[[*b"0123456789"]] = DIGIT
KIND[WHITE] = SPACE


def pieces_of(data: np.ndarray, offsets: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces into which the tokenizers' patterns split texts (as UTF-8) of LETTERS and SIGNS.

    Runs of letters, of digits and of signs, and the ENDINGS. spaced: a space belongs to the run after it, and other white
    space makes pieces of its own; else white space makes none and each digit is a piece.
    """
    kind = KIND[data]
    high = np.flatnonzero(data >= 0xC2)
    for lead, width, letters in ((0xC2, 2, (0xAA, 0xB5, 0xBA)), (0xC3, 2, None), (0xE2, 3, ())):
        at = high[data[high] == lead]
        after = data[at + 1]
        at = at[(after == 0x97) | (after == 0xB7) if letters is None else ~np.isin(after, letters)]
        for k in range(width):
            kind[at + k] = SIGN
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    new = first.copy()
    new[1:-1] |= kind[1:] != kind[:-1]
    after = np.flatnonzero(~first[1:-1] & (kind[1:] != SPACE) & (kind[:-1] == SPACE)) + 1
    quote = np.flatnonzero(data == 0x27)
    before = np.where(first[quote], SPACE, kind[quote - 1])
    quote = quote[(before != SIGN) & (first[quote] | (data[quote - 1] != 0x20) | (not spaced))]
    padded = np.append(data, [0, 0]).astype(np.uint8)
    one, two = padded[quote + 1], padded[quote + 2]
    long = ((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C)  # re, ve, ll
    size = np.where(long, 3, np.where(np.isin(one, [*b"stmd"]), 2, 0))
    left = offsets[np.searchsorted(offsets, quote, "right")] - quote
    quote, size = quote[(size > 0) & (size <= left)], size[(size > 0) & (size <= left)]
    if spaced:
        own = data[after - 1] == 0x20
        new[after - 1] = True
        new[after[own]] = False
    else:
        new[:-1] |= kind == DIGIT
    new[quote + 1] = False
    new[(quote + 2)[size == 3]] = False
    new[quote + size] = True
    starts = np.flatnonzero(new[:-1])
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    if not spaced:
        word = kind[starts] != SPACE
        starts, ends = starts[word], ends[word]
    return starts, ends


class PieceCache:
    """Token ids of a text from the ids of its pieces: each distinct piece is encoded once.

    The tokenizer never joins what its own pattern splits, so the ids of the pieces, one after the other, are those of the
    text. Texts of common letters and signs are split by that pattern, many at a time; another one before white space that
    follows other characters, where every such pattern splits; one with white space beyond ASCII goes to the tokenizer
    whole. Pieces are known by 128-bit hashes in a table with open addressing. Pieces of common letters need no
    normalising or splitting: the tokenizer's model encodes them, in the letters that stand for their bytes. A worker
    keeps its cache from task to task, up to `limit` pieces, of about 40 bytes each.
    """

    _of: dict[str, "PieceCache"] = {}
    OTHER = 100_000  # pieces of texts beyond the common letters

    @classmethod
    def at(cls, path: str, limit: int) -> "PieceCache":
        if path not in cls._of:
            cls._of[path] = cls(path, limit)
        return cls._of[path]

    def __init__(self, path: str, limit: int = 1_000_000):
        import json
        import os
        import re

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        with open(path, encoding="utf8") as f:
            parts = json.load(f)
        before, special = parts["pre_tokenizer"] or {}, any(t["content"] for t in parts["added_tokens"])
        self.lower = "Lowercase" in json.dumps(parts["normalizer"])
        self.spaced = before.get("type") == "ByteLevel" and before.get("use_regex") and not parts["normalizer"]
        self.fine = bool(self.spaced or self.lower and ENDINGS in json.dumps(before))
        self.strange = re.compile(f"[^{LETTERS}{SIGNS}]" + ("|<\\|" if special else "")).search
        self.coarse = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+").findall
        self.odd = re.compile(ODD_SPACE).search
        self.word = re.compile((" ?" if self.spaced else "") + f"[{LETTERS}]+").fullmatch
        last = before if before.get("type") == "ByteLevel" else (before.get("pretokenizers") or [{}])[-1]
        stands = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        mapped = last.get("type") == "ByteLevel" and not parts["model"].get("byte_fallback")
        self.letters = {ord(c): stands(c)[0][0] for c in map(chr, range(0x180)) if c == " " or self.word(c)} if mapped else None
        self.other: dict[str, np.ndarray] = {}
        self.limit, self.bits = limit, max(10, (limit * 3 // 2).bit_length())
        self.clear()

    def clear(self) -> None:
        self.n = 0
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.k1, self.k2, self.at_id = np.zeros(1024, U), np.zeros(1024, U), np.zeros(1025, np.int64)
        self.pool = np.zeros(4096, self.dtype)

    def alone(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def pieces(self, new: list[str]) -> tuple[list[int], list[int]]:
        """The ids of pieces, one after the other, and how many each has."""
        words = list(filter(self.word, new)) if self.letters else []
        mapped = iter("\n".join(words).translate(self.letters).split("\n")) if words else iter(())
        tokenize, ids, n = self.model.tokenize, [], []
        for p in new:
            own = [t.id for t in tokenize(next(mapped))] if self.letters and self.word(p) else self.alone(p).tolist()
            ids += own
            n.append(len(own))
        return ids, n

    def find(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """The entries of pieces, -1 for unknown ones."""
        slot = (k1 >> U(64 - self.bits)).astype(np.int64)
        entry = self.slots[slot]
        lost = np.flatnonzero((entry >= 0) & ((self.k1[entry] != k1) | (self.k2[entry] != k2)))
        while len(lost):
            slot[lost] = (slot[lost] + 1) & (len(self.slots) - 1)
            e = self.slots[slot[lost]]
            entry[lost] = e
            lost = lost[(e >= 0) & ((self.k1[e] != k1[lost]) | (self.k2[e] != k2[lost]))]
        return entry

    def enter(self, entries: np.ndarray) -> None:
        """Give each entry the next free slot."""
        slot = (self.k1[entries] >> U(64 - self.bits)).astype(np.int64)
        while len(entries):
            free = np.flatnonzero(self.slots[slot] < 0)
            _, one = np.unique(slot[free], return_index=True)
            placed = free[one]
            self.slots[slot[placed]] = entries[placed]
            left = np.ones(len(entries), bool)
            left[placed] = False
            entries, slot = entries[left], (slot[left] + 1) & (len(self.slots) - 1)

    def add(self, k1: np.ndarray, k2: np.ndarray, ids: list[int], sizes: list[int]) -> None:
        m, flat = len(sizes), np.array(ids, self.dtype)
        while self.n + m > len(self.k1):
            self.k1, self.k2 = np.append(self.k1, np.zeros_like(self.k1)), np.append(self.k2, np.zeros_like(self.k2))
            self.at_id = np.append(self.at_id, np.zeros(len(self.at_id) - 1, np.int64))
        used = int(self.at_id[self.n])
        while used + len(flat) > len(self.pool):
            self.pool = np.append(self.pool, np.zeros_like(self.pool))
        self.k1[self.n : self.n + m], self.k2[self.n : self.n + m] = k1, k2
        self.at_id[self.n + 1 : self.n + m + 1] = used + np.cumsum(sizes)
        self.pool[used : used + len(flat)] = flat
        self.enter(np.arange(self.n, self.n + m, dtype=np.int32))
        self.n += m

    def plain(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of texts that the pattern may split."""
        starts, ends = pieces_of(data, offsets, self.spaced)
        if self.n > self.limit // 2 and self.n + len(starts) // 4 > self.limit:  # the pieces met first tend to be frequent
            self.n = self.limit // 2
            self.slots[:] = -1
            self.enter(np.arange(self.n, dtype=np.int32))
        size = (ends - starts).astype(U)
        k1, k2 = (mix(r.spans(r.sums(BYTES[data]), starts, ends) + size) for r in (FIRST, SECOND))
        entry = self.find(k1, k2)
        lost = np.flatnonzero(entry < 0)
        while len(lost):
            _, one = np.unique(k1[lost], return_index=True)
            one = lost[one]
            raw = data.tobytes()
            for i in range(0, len(one), 10_000):
                some = one[i : i + 10_000]
                new = [raw[s:e].decode() for s, e in zip(starts[some].tolist(), ends[some].tolist(), strict=True)]
                self.make_room(len(new))
                self.add(k1[some], k2[some], *self.pieces(new))
            entry[lost] = self.find(k1[lost], k2[lost])
            lost = lost[entry[lost] < 0]
        a, n = self.at_id[entry], self.at_id[entry + 1] - self.at_id[entry]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = self.pool[np.repeat(a - total[:-1], n) + np.arange(total[-1])]
        cut = total[np.searchsorted(starts, offsets)]
        return [ids[x:y] for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

    def make_room(self, n: int) -> None:
        while 2 * (self.n + n) > len(self.slots):  # a batch with more new pieces than usual
            self.bits += 1
            self.slots = np.full(1 << self.bits, -1, np.int32)
            self.enter(np.arange(self.n, dtype=np.int32))

    def beyond(self, text: str) -> np.ndarray:
        if self.odd(text):
            return self.alone(text)
        if len(self.other) > self.OTHER:
            self.other.clear()
        out = []
        for p in self.coarse(text):
            if p not in self.other:
                self.other[p] = self.alone(p)
            out.append(self.other[p])
        return np.concatenate([np.zeros(0, self.dtype), *out])

    @staticmethod
    def parts(raw: bytes, size: int) -> Iterator[bytes]:
        """Parts of about `size` bytes, cut before white space that follows other characters."""
        pos, end = 0, size
        while end < len(raw):
            white = WHITE[np.frombuffer(raw, np.uint8, end - pos, pos)]
            cuts = np.flatnonzero(white[1:] & ~white[:-1])
            if len(cuts):
                cut = pos + int(cuts[-1]) + 1
                yield raw[pos:cut]
                pos, end = cut, cut + size
            else:
                end += end - pos
        if pos < len(raw):
            yield raw[pos:]

    def encode_many(self, texts: list[str], at_once: int = 1 << 20) -> list[np.ndarray]:
        """The ids of each text. Long texts are cut before white space that follows other characters."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[bytes] = []
        who: list[int] = []
        size = 0

        def flush() -> None:
            offsets = np.cumsum([0, *map(len, held)])
            for i, ids in zip(who, self.plain(np.frombuffer(b"".join(held), np.uint8), offsets), strict=True):
                out[i].append(ids)
            held.clear()
            who.clear()

        for i, text in enumerate(texts):
            common = text.isascii() and "<|" not in text and text.replace("\n", "").isprintable()  # what most texts are
            if not self.fine or not common and self.strange(text):
                out[i].append(self.beyond(text))
                continue
            for part in self.parts((text.lower() if self.lower else text).encode(), at_once):
                held.append(part)
                who.append(i)
                size += len(part)
                if size >= at_once:
                    flush()
                    size = 0
        if held:
            flush()
        return [x[0] if len(x) == 1 else np.concatenate([np.zeros(0, self.dtype), *x]) for x in out]
