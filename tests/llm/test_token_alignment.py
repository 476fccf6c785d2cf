"""Alignment of two tokenizers' tokens against a plain comparison of all byte ranges."""

import hashlib
import random
from collections import Counter

import pandas as pd
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cellweave.llm.queries import op13_token_alignment, tokenizer
from cellweave.llm.token_alignment import SIDE, Aligner, byte_letters, cross_tokenizer

SF = "/root/testdata/sf0.001"
A, B = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


class Plain:
    """Whole texts by the two libraries, every A range compared with the B ranges near it."""

    def __init__(self):
        self.a, self.b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True
        self.letters = byte_letters()

    def piece(self, i):
        p = self.b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()

    def ranges(self, ids, parts):
        out, at = [], 0
        for i, p in zip(ids, parts):
            out.append((at, at + len(p), i))
            at += len(p)
        return out

    def align(self, text):
        """n_a, n_b, n_groups, n_links, digest, links by pair."""
        if not text:
            return 0, 0, 0, 0, "", {}
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        x, y = [bytes(self.letters[c] for c in self.a.id_to_token(i)) for i in a], [self.piece(i) for i in b]
        if not b"".join(x) == b"".join(y) == (" " + text).encode():
            return 0, 0, 0, 0, "", {}
        ra, rb = self.ranges(a, x), self.ranges(b, y)
        links, low = Counter(), 0
        for s, e, i in ra:
            while rb[low][1] <= s:
                low += 1
            for q, r, j in rb[low:]:
                if q >= e:
                    break
                if s < r:
                    links[i * SIDE + j] += 1
        at = {e for _, e, _ in ra} & {e for _, e, _ in rb}
        groups, p, q = [], 0, 0
        for end in sorted(at):
            n, m = p, q
            while n < len(ra) and ra[n][1] <= end:
                n += 1
            while m < len(rb) and rb[m][1] <= end:
                m += 1
            groups.append(",".join(str(r[2]) for r in ra[p:n]) + "|" + ",".join(str(r[2]) for r in rb[q:m]))
            p, q = n, m
        return len(a), len(b), len(at), sum(links.values()), sha(groups), links


def sha(groups):
    return hashlib.sha256(";".join(groups).encode()).hexdigest()


@pytest.fixture(scope="module")
def plain():
    return Plain()


def expected(plain, texts):
    """The contract's columns of all texts."""
    one = [plain.align(t) for t in texts]
    count = Counter(p for r in one for p in r[5])
    best = Counter()
    for p, n in count.items():
        best[p // SIDE] = max(best[p // SIDE], n)
    return [(*r[:4], sum(k for p, k in r[5].items() if count[p] == best[p // SIDE]), sum(k * count[p] for p, k in r[5].items()), r[4]) for r in one]


@pytest.mark.parametrize("at_once", [40, 1 << 20])
@pytest.mark.parametrize("kept", [50, 100_000])
def test_texts_in_parts(plain, at_once, kept):
    rng = random.Random(2)
    texts = ["", " ", "  ", "a  ", "\n\n x", " <|endoftext|> <s>", "▁a b", "日本語 テキスト", "a　 b", "\x1c a", "\x85 b​ c", "x" * 300 + " y", "².5 ²", "don't 'll"]
    texts += ["".join(rng.choice([*" \n\tab\xa0 ,’s'.()_1é日", "<|endoftext|>", "\U0001f600"]) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    for text, got in zip(texts, Aligner(A, B, kept).align_many(texts, True, at_once)):
        want = plain.align(text)
        assert tuple(got[0].tolist()) == want[:4] and got[1] == want[4] and dict(zip(got[2].tolist(), got[3].tolist())) == want[5], repr(text)
        assert not got[1] or hashlib.sha256(got[4].encode()).hexdigest() == got[1]


def test_query(spark, plain):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in op13_token_alignment(spark, SF).collect()}
    assert got == dict(zip(docs.doc_id, expected(plain, docs.text)))


@pytest.mark.parametrize("frequent", [1, 30])
def test_rare_pairs(spark, plain, frequent):
    """Counts of pairs beyond the sent ones come from the join; nulls, repeated rows, a hot text, and columns with clashing names."""
    texts = ["the same text over and over.", None, "", "▁no", "other words here", "other words there", "the quick brown fox"] + ["the same text over and over."] * 20
    rows = [(k % 9 or None, t, "x", 1) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pair string, row int").repartition(3)
    got = cross_tokenizer(df, A, B, frequent=frequent, with_groups=True).collect()
    want = [(r[0], *w) for r, w in zip(rows, expected(plain, texts))]
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is not None, r))
    assert order([tuple(r[c] for c in ["doc_id", *COLUMNS]) for r in got]) == order(want)
    assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in got if r.groups_sha256)
    assert cross_tokenizer(df.limit(0), A, B).count() == 0
