"""Main text of web pages by a host-wide suffix array, with an exact check by structure.

Every block outside menus, headers, footers, sidebars, forms and the like is a candidate. Each page's candidates are token
streams, one of what an article or main element holds and one of the rest; the suffixes of all streams of a host are
sorted, and a substring repeated on another page covers its tokens. Only unique runs stay; on pages with an article the
check gives back covered text, as copies share articles, but for standing blocks (see `standing`).
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, discard, mix, signed, spread_join, stored, texts, tune, utf8, words
from .windows import contexts, pieces, union

#: Fixed values of the HTML standard: elements without an end tag, elements that break a line of text, elements without prose.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BREAKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
SKIPPED = frozenset("aside audio button canvas datalist dialog fieldset footer form head iframe input label math menu nav noscript object script select style svg template textarea title video".split())
RAW = frozenset("script style textarea title noscript iframe xmp template".split())
RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
CLOSED_BY = {"p": BREAKS - {"html", "body"}, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"})}
#: Words of class, id and role attributes that mark what is not the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent contentinfo cookie cookies disqus footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice popup promo promotion related replies search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
#: For each tag the open elements that it ends.
CLOSES = {tag: frozenset(k for k, by in CLOSED_BY.items() if tag in by) for tag in frozenset().union(*CLOSED_BY.values())}
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: What the attributes that can mark an element have in them.
TELLING = re.compile("class|id|role|aria-label|hidden|style", re.I)
NAMES = frozenset(("class", "id", "role", "aria-label"))
#: What an article may hold: elements that a mark does not drop unless they hold others; text that is skipped elsewhere.
CONTAINERS = frozenset("center dd details div dl li ol section table td ul".split())
PROSE = frozenset(("label", "math"))
PARTS = re.compile(r"[a-z]+")
#: Of the marks those that name nothing an article could hold, also as a part of a name (comment-list, user-comments).
FOREIGN = frozenset("advert adverts advertisement advertising adsense comment comments commentlist consent cookie cookies disqus gdpr newsletter replies signup sponsored subscribe".split())
#: Of the marks those that an article may use for its own parts (a dish menu, related work, a search story).
OWN = frozenset("banner header menu notice promo promotion related search social widget".split())
#: Names of which these are a part belong to the text, whatever other mark they have.
CONTENT = frozenset("article content entry post results story text".split())


def named(name: str, value: str, main: bool) -> bool:
    """Whether a class, id, role or label has a mark. A foreign part of a name decides; other marks by parts of a name without a word for
    content, inside an article (`main`) only as a whole name, and never one that it may use itself."""
    names = value.split() if name == "class" else [value.strip()]
    for one in names:
        parts = set(PARTS.findall(one))
        if parts & FOREIGN:
            return True
        if one in MARKS - OWN if main else parts & MARKS and not parts & CONTENT:
            return True
    return False


def marked(attributes: str, tag: str = "", main: bool = False) -> bool:
    """Whether an element is hidden or its attributes have a mark; inside an article (`main`) only a container can have one."""
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or (name == "style" and "display:none" in value.replace(" ", "")):
            return True
        if name in NAMES and (not main or tag in CONTAINERS) and named(name, value, main):
            return True
    return False


def tag_of(m: re.Match) -> tuple | None:
    """What the parser needs of a tag, all from its own text: name, whether it ends an element, breaks a line, which elements it ends,
    whether it holds nothing, is raw, makes an article, and is left out outside of an article and inside; None if it is no tag."""
    slash, tag, attributes, slash2, tag2, attributes2 = m.groups()
    tag = tag or tag2
    if tag is None:
        return None
    tag, closing, attributes = tag.lower(), bool(slash or slash2), attributes or attributes2 or ""
    if closing:
        return tag, True, tag in BREAKS, (), False, False, False, False, False
    empty = tag in VOID or attributes.endswith("/") and tag not in BREAKS
    article = tag == "article" or tag == "main" or "role=" in attributes and re.search(r"role=.?(main|article)\b", attributes) is not None
    can = tag not in ("body", "html", "article", "main") and TELLING.search(attributes) is not None
    outside = tag in SKIPPED or tag == "header" or can and marked(attributes, tag, False)
    inside = tag in SKIPPED and tag not in PROSE or can and marked(attributes, tag, True)
    return tag, False, tag in BREAKS, CLOSES.get(tag, ()), empty, tag in RAW, article, outside, inside


#: Tags by their text, as a worker has met them; most are the same from page to page. The longest that are kept, and how many.
TAGS: dict[str, tuple] = {}
TAG_LENGTH, TAG_COUNT = 200, 20_000


def blocks(page: str) -> list[tuple[str, bool]]:
    """The blocks of text in page order outside what structure excludes, each with whether an article or main element holds it."""
    out: list[tuple[str, bool]] = []
    text: list[str] = []
    stack: list[str] = []  # open elements
    states: list[tuple[bool, bool]] = [(False, False)]  # skipped, main: of the page and of each open element
    skipped = main = False

    def flush() -> None:
        whole = "".join(text)
        text.clear()
        if whole := whole.strip(" ") if whole.isprintable() and "  " not in whole else " ".join(whole.split()):  # of white space only the space is printable
            out.append((whole, main))

    at, n, match, find, known = 0, len(page), TOKEN.match, page.find, TAGS.get
    while at < n:
        start = find("<", at)
        if start != at:
            if start < 0:
                start = n
            if not skipped:
                part = page[at:start]
                text.append(html.unescape(part) if "&" in part else part)
            at = start
            continue
        found = known(page[start : (at := find(">", start, start + TAG_LENGTH) + 1)])
        if found is None:
            m = match(page, start)
            at = m.end()
            found = tag_of(m)
            if found is None:
                if at == start + 1 and not skipped:
                    text.append("<")
                continue
            if at - start <= TAG_LENGTH and (m[2] or "").isalnum() and page[m.end(2)] in " />\n":  # a quote in a name leaves its end to what follows
                if len(TAGS) >= TAG_COUNT:
                    TAGS.clear()
                TAGS[page[start:at]] = found
        tag, closing, breaks, closes, empty, is_raw, article, outside, inside = found
        if breaks:
            if text:
                flush()
        elif tag == "br":
            text.append(" ")
        if closing:
            if tag in stack:
                while True:
                    states.pop()
                    if stack.pop() == tag:
                        break
                skipped, main = states[-1]
            continue
        if closes:
            while stack and stack[-1] in closes:
                stack.pop()
                states.pop()
            skipped, main = states[-1]
        if is_raw:
            end = RAW_END[tag].search(page, at) if tag != "template" else None
            if end:
                at = end.end()
                continue
            if tag in ("script", "style"):
                break
        if empty:
            continue
        stack.append(tag)
        skipped, main = skipped or (inside if main else outside), main or article
        states.append((skipped, main))
    if text:
        flush()
    return out


def decided(page: str) -> list[str] | None:
    """The blocks of the article, or None if no element tells."""
    found = blocks(page)
    inside = [t for t, main in found if main]
    return inside or None


def repeated(streams: DataFrame, least: int = 8, depth: int = 24, part: int = 20_000) -> DataFrame:
    """page, block, at, covered: how many tokens from there a substring that another page of the host shares covers.

    streams(host, page, block, text). Each token begins a suffix of at most `depth` tokens. Equal suffixes of a host are
    merged with their first and last page before the shuffle; suffixes are dealt by their first `least` tokens, so a
    repeated substring is whole in one task, and sorted there: common prefixes of neighbours, carried over suffixes of the
    same page to the nearest of another one, tell what a suffix shares with other pages. As a suffix begins at each token,
    suffixes of `depth` tokens cover repeated substrings of any length. A task holds `part` suffixes at a time.
    """
    one = suffixes(streams, least, depth)
    merged = one.groupBy("host", "head", "tail").agg(F.min("page").alias("lo"), F.max("page").alias("hi"))
    found = suffix_array(merged, least, ["host", "head", "tail"], part).groupBy("host", "head", "tail").agg(F.max("covered").alias("covered"))
    return one.join(found, ["host", "head", "tail"]).select("page", "block", "at", "covered")


def suffixes(streams: DataFrame, least: int, depth: int) -> DataFrame:
    """The suffixes of the column `text`: place, first `least` tokens and the next ones up to `depth`."""
    n = F.size("t")
    one = streams.withColumn("t", F.split("text", " ")).filter(n >= least).withColumn("at", F.explode(F.sequence(F.lit(0), n - least)))
    head = F.array_join(F.slice("t", F.col("at") + 1, least), " ")
    return one.withColumn("head", head).withColumn("tail", F.array_join(F.slice("t", F.col("at") + 1 + least, depth - least), " ")).drop("t", "text")


def suffix_array(one: DataFrame, least: int, keep: list[str], part: int = 20_000) -> DataFrame:
    """keep and covered: how many tokens a suffix of a host shares with one of another page, where it shares `least`.

    one(host, head, tail, lo, hi): suffixes with the first and the last page that has them; a suffix may come several times.
    """
    given = [*dict.fromkeys(["host", "head", "tail", "lo", "hi", *keep])]
    at = [given.index(k) for k in keep]
    one = one.select(*given).repartition("host", "head").sortWithinPartitions("host", "head", "tail")

    def shared_prefix(a: list[str], b: list[str]) -> int:
        k = 0
        while k < min(len(a), len(b)) and a[k] == b[k]:
            k += 1
        return k

    def widest(group: list[tuple], lcp: list[int], order: range) -> list[int]:
        """For each suffix the longest prefix it shares with a suffix of another page that comes before it in `order`.

        The nearest such suffix has it. Two are kept: the last suffix's page, and the nearest of a page other than that one.
        """
        out, step = [0] * len(group), order.step
        near: list[list] = []  # [page or None for several pages, shared prefix with the current suffix]
        for i in order:
            for c in near:
                c[1] = min(c[1], lcp[i] if step == 1 else lcp[i + 1])
            page = group[i][3] if group[i][3] == group[i][4] else None
            out[i] = max((c[1] for c in near if page is None or c[0] != page), default=0)
            near = [[page, 1 << 30], *[c for c in near if c[0] != page or page is None][:1]]
        return out

    def sorted_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: list[pa.DataType] = []
        out: list[tuple] = []

        def rows():
            for batch in batches:
                types[:] = [batch.schema.field(k).type for k in keep]
                yield from zip(*(batch.column(c).to_pylist() for c in given), strict=True)

        def emit(group: list[tuple]) -> None:
            if len(group) == 1:  # no neighbour
                if group[0][3] != group[0][4]:
                    out.append((group[0], least + (group[0][2].count(" ") + 1 if group[0][2] else 0)))
                return
            tails = [g[2].split(" ") if g[2] else [] for g in group]
            lcp = [0, *(least + shared_prefix(p, q) for p, q in zip(tails, tails[1:], strict=False))]
            cover = [least + len(t) if g[3] != g[4] else 0 for g, t in zip(group, tails, strict=True)]
            n = len(group)
            cover = map(max, cover, widest(group, lcp, range(n)), widest(group, lcp, range(n - 1, -1, -1)))
            out.extend((g, c) for g, c in zip(group, cover, strict=True) if c)

        def flush() -> pa.RecordBatch:
            columns = [pa.array([g[k] for g, _ in out], t) for k, t in zip(at, types, strict=True)]
            columns.append(pa.array([c for _, c in out], pa.int32()))
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=[*keep, "covered"])

        def carried(group: list[tuple]) -> list[tuple]:
            """What the next part of a long run needs: its last suffixes of one page, and the one before them."""
            last, k = group[-1][3:5], len(group) - 1
            while last[0] == last[1] and k and group[k][3:5] == last:
                k -= 1
            return group[k:]

        group: list[tuple] = []
        fresh_from, host, head = 0, None, None
        for row in rows():
            same = row[1] == head and row[0] == host
            if group and not same or len(group) - fresh_from >= part:
                emit(group)
                group = carried(group) if same else []
                fresh_from = len(group)
                if len(out) >= 5000:
                    yield flush()
            group.append(row)
            host, head = row[0], row[1]
        if group:
            emit(group)
        if out:
            yield flush()

    return one.mapInArrow(sorted_neighbours, ", ".join(f"{k} {one.schema[k].dataType.simpleString()}" for k in keep) + ", covered int")


#: Windows of `least` tokens are keyed by the smallest hash among their grams of so many tokens.
GRAM = 4
#: To be found again, a key goes as 40 of its bits and 24 of its page's part, in one of 4,096 buckets by another 12 of its bits.
BUCKETS, PLACE = U((1 << 12) - 1), U((1 << 24) - 1)
#: Keys that a task holds at a time.
HELD = 1 << 20
ANCHORS = "h long, ch long, host long, page long, row long, own boolean, at int, body string, sizes array<int>, ids array<long>"


def candidates(page: str) -> tuple[list[str], list[str]]:
    """The blocks that an article holds and the other ones, each a stream; the page's text is in the first that is not empty."""
    found = blocks(page)
    return [t for t, main in found if main], [t for t, main in found if not main]


def keyed(parts: list[tuple[list[str], list[str]]], host: np.ndarray, least: int) -> Iterator[tuple]:
    """The contexts (see `windows`) of pages' streams, a slice of bounded size at a time, keyed within host and kind of stream.

    Their keys, contents, rows, whether the page's text is in their stream, first tokens, and the bytes and ends of their tokens.
    """
    which = [(i, kind, not (kind and own[0]), own[kind]) for i, own in enumerate(parts) for kind in (0, 1) if own[kind]]
    row, kinds, decides = np.array([w[0] for w in which], np.int64), np.array([w[1] for w in which], U), np.array([w[2] for w in which], bool)
    data, offsets = utf8(pa.array([" ".join(w[3]) for w in which], pa.large_string()))
    starts, ends, hashes, first = words(data, offsets)
    symbols = mix(hashes ^ np.repeat(mix(host.view(U)[row] ^ kinds * U(0x9E3779B97F4A7C15)), np.diff(first)))
    for i, j, lo, hi in pieces(first, least):
        bounds = np.clip(first[i : j + 1], lo, hi) - lo
        h, ch, geo, text, at = contexts(symbols[lo:hi], bounds[:-1], bounds[1:], least, GRAM)
        text = text + i
        yield h, ch, row[text], decides[text], at + lo - first[text], data, starts[at + lo], ends[at + lo + (geo >> 8) + least - 2]


def within(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """A hash of a key and the row of a batch."""
    return mix(h ^ mix(row.astype(U) + U(1)))


def short(h: np.ndarray) -> np.ndarray:
    """The bits of keys by which they are found again."""
    return h & ~PLACE | h & BUCKETS


def lists_of(ids: np.ndarray, values: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """A row for each id with the bytes of its values."""
    order = np.argsort(ids, kind="stable")
    ids, values = ids[order], values[order]
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])[: len(ids)])
    offsets = np.append(first, len(ids)).astype(np.int32) * 8
    lists = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(values)])
    return pa.RecordBatch.from_arrays([pa.array(ids[first].astype(np.int32)), lists], names=names)


def dealt_keys(pages: DataFrame, least: int) -> DataFrame:
    """bucket, keys: the keys of all streams, many in a row, each once for a page."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def flush() -> pa.RecordBatch:
            h, part = map(np.concatenate, zip(*held, strict=True))
            held.clear()
            return lists_of((h & BUCKETS).astype(np.uint16), h & ~PLACE | part, ["bucket", "keys"])

        for batch in batches:
            part = batch.column("part").to_numpy().astype(U) & PLACE
            for h, _, row, *_ in keyed([candidates(p) for p in texts(batch.column("html"))], batch.column("host").to_numpy(), least):
                once = np.unique(within(h, row), return_index=True)[1]
                held.append((h[once], part[row[once]]))
                n += len(once)
                if n >= HELD:
                    yield flush()
                    n = 0
        if held:
            yield flush()

    return pages.select("html", "host", "part").mapInArrow(rows, "bucket int, keys binary")


def came_again(dealt: DataFrame) -> DataFrame:
    """part, keys: those that a bucket has more than once, as `short` tells them; a part has a row for each task at most, or a few."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def flush() -> pa.RecordBatch:
            part, key = map(np.concatenate, zip(*held, strict=True))
            held.clear()
            return lists_of(part, key, ["part", "keys"])

        pairs = ((int(b), k) for batch in batches for b, k in zip(batch.column("bucket").to_numpy(), batch.column("keys").to_pylist(), strict=True))
        for bucket, group in groupby(pairs, key=lambda x: x[0]):
            one = np.frombuffer(b"".join(k for _, k in group), U)
            one = np.sort(one)
            same = one[1:] & ~PLACE == one[:-1] & ~PLACE
            one = one[np.append(False, same) | np.append(same, False)]
            held.append(((one & PLACE).astype(np.int32), one & ~PLACE | U(bucket)))
            n += len(one)
            if n >= HELD:
                yield flush()
                n = 0
        if held:
            yield flush()

    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(rows, "part int, keys binary")


def anchors(pages: DataFrame, least: int) -> DataFrame:
    """The contexts of all streams whose key another page of the host has, as ANCHORS, and a row for each page's outline.

    body: the context's tokens; at: its first one. An outline (h is null) has the tokens and hashes of the blocks of an
    article. Keys are found again before any text moves, and move many in a row; a page sends a key once. Streams then meet their keys that came again, compressed.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        for batch in batches:
            streams = ["\n\n".join(map("\n".join, candidates(p))).encode() for p in texts(batch.column("html"))]
            ids = [batch.column(k) for k in ("part", "host", "page", "row")]
            out = [pa.array(list(map(len, streams)), pa.int64()), pa.array([codec.compress(t, asbytes=True) for t in streams], pa.binary())]
            yield pa.RecordBatch.from_arrays([*ids, *out], names=["part", "host", "page", "row", "size", "streams"])

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in ANCHORS.split(", ")]
        kinds = {"own": pa.bool_(), "at": pa.int32(), "body": pa.string(), "sizes": pa.list_(pa.int32()), "ids": pa.list_(pa.int64())}

        def batch_of(n: int, columns: dict) -> pa.RecordBatch:
            types = [kinds.get(k, pa.int64()) for k in names]
            return pa.RecordBatch.from_arrays([columns[k].cast(t) if k in columns else pa.nulls(n, t) for k, t in zip(names, types, strict=True)], names=names)

        codec = pa.Codec("zstd")
        for batch in batches:
            ids = {k: batch.column(k) for k in ("host", "page", "row")}
            whole = [codec.decompress(x, n, asbytes=True).decode() for x, n in zip(batch.column("streams").to_pylist(), batch.column("size").to_pylist(), strict=True)]
            parts = [tuple(t.split("\n") if t else [] for t in x.split("\n\n")) for x in whole]
            lists = list(map(b"".join, batch.column("wanted").to_pylist()))
            flat, of = np.frombuffer(b"".join(lists), U), np.repeat(np.arange(len(lists)), [len(x) // 8 for x in lists])
            wanted = np.unique(within(flat, of))  # a clash only brings a context without a partner
            for h, ch, row, own, at, data, s, e in keyed(parts, ids["host"].to_numpy(), least):
                take = np.flatnonzero(np.isin(within(short(h), row), wanted))
                raw, r = data.tobytes(), pa.array(row[take])
                body = [raw[a:b].decode() for a, b in zip(s[take].tolist(), e[take].tolist(), strict=True)]
                mine = {"h": signed(h[take]), "ch": signed(ch[take]), "own": own[take], "at": at[take], "body": body}
                yield batch_of(len(take), {k: pa.array(v, kinds.get(k, pa.int64())) for k, v in mine.items()} | {k: v.take(r) for k, v in ids.items()})
            outline = [(i, own[0]) for i, own in enumerate(parts) if own[0]]
            r = pa.array([i for i, _ in outline], pa.int64())
            sizes = [[t.count(" ") + 1 for t in own] for _, own in outline]
            digests = [[int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little", signed=True) for t in own] for _, own in outline]
            yield batch_of(len(r), {"sizes": pa.array(sizes, kinds["sizes"]), "ids": pa.array(digests, kinds["ids"])} | {k: v.take(r) for k, v in ids.items()})

    pages = pages.withColumn("part", F.col("part").bitwiseAND(F.lit(int(PLACE))))
    wanted = stored(came_again(dealt_keys(pages, least)).groupBy("part").agg(F.collect_list("keys").alias("wanted")), "wanted")
    streams = pages.select("html", "part", "host", "page", "row").mapInArrow(packed, "part int, host long, page long, row long, size long, streams binary")
    out = stored(streams.join(wanted, "part").mapInArrow(bodies, ANCHORS), "anchors")
    discard(wanted)
    return out


def covers(found: DataFrame, least: int) -> DataFrame:
    """row, host, page, spans: the ranges of tokens of each page's deciding stream that substrings of other pages of the host cover.

    found: ANCHORS, which are deleted. Equal contexts are merged with their first and last page before their suffixes are made.
    A window has one key, so a context that stands alone under its key is covered whole or not at all, and has no suffixes sorted.
    """
    places = stored(found.filter("own and h is not null").select("h", "ch", "host", "page", "row", "at"), "places")
    merged = found.filter("h is not null").groupBy("h", "ch", "body").agg(F.min("page").alias("lo"), F.max("page").alias("hi"), F.count("*").alias("n"))
    merged = stored(merged.withColumnsRenamed({"h": "host", "body": "text"}), "contexts")
    discard(found)
    kinds = spread_join(merged, merged.groupBy("host").agg(F.count("*").alias("kinds")), ["host"], "kinds", merged.count(), ["ch"])
    kinds = stored(kinds, "kinds")
    discard(merged)
    tokens = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1
    alone = kinds.filter("kinds = 1 and lo < hi").select(F.col("host").alias("h"), "ch", "n", F.array(F.struct(F.lit(0).alias("at"), tokens.alias("covered"))).alias("hits"))
    hits = suffix_array(suffixes(kinds.filter("kinds > 1"), least, 1 << 10), least, ["host", "ch", "n", "at"])
    hits = hits.groupBy(F.col("host").alias("h"), "ch").agg(F.first("n").alias("n"), F.collect_list(F.struct("at", "covered")).alias("hits"))
    hits = stored(alone.unionByName(hits), "suffixes")
    discard(kinds)
    total = hits.agg(F.sum("n")).first()[0] or 0
    mine = spread_join(places, hits, ["h", "ch"], "n", total, ["row", "at"]).withColumn("x", F.explode("hits"))
    mine = mine.select("row", "host", "page", (F.col("at") + F.col("x.at")).alias("s"), (F.col("at") + F.col("x.at") + F.col("x.covered")).alias("e"))
    out = stored(mine.groupBy("row").agg(F.first("host").alias("host"), F.first("page").alias("page"), F.collect_set(F.struct("s", "e")).alias("spans")), "covers")
    discard(places, hits)
    return out


def unions(spans: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """List, start and end of the disjoint, maximal ranges of lists of ranges s, e, in order."""
    flat, n = spans.flatten(), pc.list_value_length(spans).to_numpy()
    of, s, e = np.repeat(np.arange(len(n)), n), *(pc.struct_field(flat, k).to_numpy().astype(np.int64) for k in "se")
    order = np.lexsort((s, of))
    of, s, e = of[order], s[order], e[order]
    far = int(e.max(initial=0)) + 1
    reach = np.maximum.accumulate(of * far + e)
    new = np.append(True, of[1:] * far + s[1:] > reach[:-1])[: len(of)]
    new[1:] |= of[1:] != of[:-1]
    last = np.append(new[1:], True)[: len(of)]
    return of[new], s[new], (reach - of * far)[last]


def standing(cover: DataFrame, outlines: DataFrame, sizes: DataFrame) -> DataFrame:
    """row, dropped: the standing blocks of articles, by their number.

    A block stands if it is covered as a whole, in articles of which less than half is covered, on three pages or more that
    are more than half of the host's. So what copies of an article share, and what a few articles quote, is kept.
    outlines(row, sizes, ids); sizes(host, pages).
    """

    @F.arrow_udf("struct<own: boolean, blocks: array<int>>")
    def whole(lengths: pa.Array, spans: pa.Array) -> pa.Array:
        """Whether less than half is covered; the blocks that are covered as a whole."""
        n = pc.list_value_length(lengths).to_numpy()
        size, row = lengths.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(len(n)), n)
        of, s, e = unions(spans)
        ends = np.cumsum(size)
        total = np.append(0, ends)[np.cumsum(np.append(0, n))]
        ends -= total[row]
        far = int(max(ends.max(initial=0), e.max(initial=0))) + 1
        k = np.searchsorted(of * far + s, row * far + ends - size, "right") - 1  # the last range that begins before the block
        held = (k >= 0) & (np.append(of * far + e, -1)[k] >= row * far + ends)
        own = 2 * np.bincount(of, e - s, len(n)) < np.diff(total)
        first = np.append(0, np.cumsum(n))[:-1][row]
        offsets = np.append(0, np.cumsum(np.bincount(row[held], minlength=len(n)))).astype(np.int32)
        found = pa.ListArray.from_arrays(pa.array(offsets), pa.array((np.arange(len(row)) - first)[held].astype(np.int32)))
        return pa.StructArray.from_arrays([pa.array(own), found], names=["own", "blocks"])

    one = cover.join(outlines, "row").withColumn("w", whole("sizes", "spans")).withColumn("block", F.explode("w.blocks"))
    one = stored(one.select("row", "host", "page", "block", F.element_at("ids", F.col("block") + 1).alias("id"), "w.own"), "blocks")
    often = one.filter("own").groupBy("host", "id").agg(F.count_distinct("page").alias("n")).filter("n >= 3").join(sizes, "host").filter("2 * n > pages")
    return one.join(often.select("host", "id"), ["host", "id"]).groupBy("row").agg(F.collect_set("block").alias("dropped"))


def extract(pages: DataFrame, least: int = 8) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each row of pages(page_id, url, html).

    The streams of every page go through the host's suffix array. A page without an article keeps its unique runs; one with
    an article keeps the article but for its standing blocks. What other pages hold as their article is no boilerplate
    elsewhere, so the two kinds of streams are compared apart. Pages are parsed again in each pass instead of being stored.
    Blocks are joined by two line feeds; white space inside a block is one space; character references are decoded. Null
    and empty html give an empty text; a null url has a host of its own; rows that share a page_id and url are one page;
    a page of any length is taken whole. Other columns are ignored; an empty table gives no rows.
    """
    tune(pages.sparkSession)
    slim = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    host = F.coalesce(F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#]+)", 1), F.concat(F.lit("?"), F.col("page_id")))
    slim = slim.withColumn("host", F.xxhash64(host)).withColumn("page", F.xxhash64("page_id", "url")).withColumn("row", F.xxhash64("page_id", "url", "html"))
    found = anchors(slim.withColumn("part", F.hash("row")), least)
    outlines = stored(found.filter("h is null").select("row", "sizes", "ids").dropDuplicates(["row"]), "outlines")
    cover = covers(found, least)
    sizes = slim.groupBy("host").agg(F.count_distinct("page").alias("pages"))
    dropped = standing(cover, outlines, sizes)
    runs = cover.join(outlines, "row", "left_anti").select("row", "spans")
    known = stored(runs.join(dropped, "row", "full"), "known")
    discard(outlines, cover)

    @F.arrow_udf("string")
    def kept(page: pa.Array, spans: pa.Array, dropped: pa.Array) -> pa.Array:
        out = []
        for p, ranges, gone in zip(texts(page), spans.to_pylist(), dropped.to_pylist(), strict=True):
            inside, rest = candidates(p)
            own = inside or rest
            if gone:  # an article of standing blocks alone is kept
                own = [t for i, t in enumerate(own) if i not in gone] or own
            if ranges:
                tokens = [(w, k) for k, block in enumerate(own) for w in block.split(" ")]
                left: dict[int, list[str]] = {}
                at = 0
                for s, e in [*union(ranges), (len(tokens), len(tokens))]:
                    for w, k in tokens[at:s]:
                        left.setdefault(k, []).append(w)
                    at = e
                own = [" ".join(ws) for ws in left.values()]
            out.append("\n\n".join(own))
        return pa.array(out, pa.string())

    whole = slim.join(known, "row", "left").select("page_id", "url", kept("html", "spans", "dropped").alias("text"))
    return whole.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
