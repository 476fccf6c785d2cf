"""Strict forms against the contract's own patterns; the rounds on a corpus with cues."""

import hashlib
import random
import re

import pandas as pd
import pytest

from cellweave.llm.contextual_pii import KINDS, base_spans, find_pii, luhn
from cellweave.llm.queries import op11_contextual_pii

SF = "/root/testdata/sf0.001"
FORMS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    """Spans by the contract's patterns as they stand."""
    out = []
    for kind, form in enumerate(FORMS):
        for m in re.finditer(form, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = [True, kind == 1 and all(int(p) <= 255 for p in m.group().split(".")), 14 <= len(digits) <= 19 and luhn(digits), 10 <= len(digits) <= 15][kind]
            out += [(*m.span(), kind)] if good else []
    return sorted(out, key=lambda s: (s[0], s[2]))


def written(spans):
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def test_strict_forms():
    rng = random.Random(5)
    bits = ["@", ".", "+", "-", " ", "(", ")", "a", "b.c", "1", "25", "256", "4", "é", "x@y.zz", "1.2.3.4", "4465758382889437", "+1 (555) 555-0100", "\n", "0.0"]
    for _ in range(20000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert base_spans(text) == plain(text), text


@pytest.mark.parametrize("text", ["a" * 300_000, "1" * 300_000, "1 " * 150_000, "1." * 150_000, "+1" * 150_000, "a@" * 150_000, "+1" + " " * 300_000, "a@b." * 75_000])
def test_long_runs_take_linear_time(text):
    assert len(base_spans(text)) >= 0


def test_query(spark):
    got = {r.doc_id: r for r in op11_contextual_pii(spark, SF).collect()}
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    assert sorted(got) == sorted(docs.doc_id)
    for doc_id, text in zip(docs.doc_id, docs.text):
        r, want = got[doc_id], plain(text)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[2] == k for s in want) for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(written(want).encode()).hexdigest()
        assert set(filter(None, written(want).split(","))) <= set(filter(None, r.spans.split(",")))


def cued():
    """Mail addresses and phone numbers after cues; masked ones after the same cues, and after a cue that only masked ones show."""
    rows = [f"word{k} lorem Mail: user{k}@host{k % 5}.example.com . ipsum" for k in range(12)]
    rows += [f"dolor hotline {k} sit call us at +1 (555) 555-01{k:02d} today amet" for k in range(12)]
    rows += ["lorem Mail: jane [at] host1 [dot] example [dot] com . ipsum", "sit call us at (555) 555-0142 today amet"]
    rows += [f"other words, mailto jane{k} [at] host1 [dot] example [dot] com end Mail: jane{k} [at] host1 [dot] example [dot] com . ipsum" for k in range(4)]
    rows += ["other words, mailto bob [at] host2 [dot] example [dot] com end"]
    rows += ["the order 555 555 0143 came in", "version 1.2.3 of the lorem (555) 555-0144 ipsum", "a user [at] work writes", None, ""]
    return rows


def test_rounds(spark):
    rows = cued()
    df = spark.createDataFrame([(k, t, "row", 1.0) for k, t in enumerate(rows)], "doc_id long, text string, kind string, score double").repartition(3)
    out, strong = find_pii(df)
    got = {r.doc_id: r for r in out.collect()}
    assert {(r.kind, r.words) for r in strong.collect()} >= {(0, "mail:"), (3, "us at"), (0, "mailto")}
    added = {k: [rows[k][int(s) : int(e)] for x in r.spans.split(",") for kind, s, e in [x.split(":")] if (int(s), int(e), KINDS.index(kind)) not in plain(rows[k])] for k, r in got.items() if r.n_added}
    mask = lambda who, host: f"{who} [at] {host} [dot] example [dot] com"
    want = {24: [mask("jane", "host1")], 25: ["(555) 555-0142"], 30: [mask("bob", "host2")]} | {26 + k: [mask(f"jane{k}", "host1")] * 2 for k in range(4)}
    assert added == want
    assert got[34].spans == got[35].spans == "" and got[34].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_hard_rows(spark):
    """A value in a third of all rows, known from its strict form; repeated rows; null ids; an empty table."""
    card = "4465758382889437"
    rows = [(k % 7 or None, f"a {card} {card} b") for k in range(60)] + [(100, f"x {card} y"), (100, f"x {card} y"), (101, None)]
    out = find_pii(spark.createDataFrame(rows, "doc_id long, text string"))[0].collect()
    assert len(out) == 63 and sum(r.n_added for r in out) == 120 and sum(r.n_card for r in out) == 2
    assert find_pii(spark.createDataFrame([], "doc_id long, text string"))[0].count() == 0
