"""Personal data against a plain reading of the patterns."""

import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from cutloom.llm import pii, queries

KINDS = ["email", "ip", "card", "phone"]


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute(text):
    out = []
    digits = lambda x: re.sub(r"[^0-9]", "", x)
    for rank, (pattern, ok) in enumerate(
        [
            (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
            (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
            (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
            (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
        ]
    ):
        out += [(m.start(), rank, m.end(), KINDS[rank]) for m in re.finditer(pattern, text or "") if ok(m[0])]
    return sorted(out)


ODD = [
    None, "", "é😀 a@b.c", "x@y", "a@b.c_x@d.e", "a@b.c.d@e.f @@ a@@b.c", "1.2.3.4.5.6.7.8", "256.1.1.1 001.002.003.255 0000255.1.1.1",
    "1.2.3.99999999999999999999", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111 4111111111111111", "+1 (555) 123-4567", "+1 2",
    "+1 (555) 123-4567)))", "+49 30 1234567890123456", "++1 555 123 4567 8", "+4111111111111111 a+b@c.de", "1  2", "5500 0000 0000 0004\n5500-0000-0000-0004",
    "a" * 60000, "1" * 60000, "a@" * 300, " x@y.zz" * 1200, "1.1.1.1 " * 700, "+1-555-123-4567,",
]


def test_base_spans(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(ODD)], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in pii.find(df).collect()}
    assert len(got) == len(ODD)
    for i, t in enumerate(ODD):
        assert [(s.start, s["rank"], s.end, s.kind) for s in got[i].base] == brute(t), t[:50]
    assert pii.find(df.limit(0)).count() == 0


def test_op1(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op1_pii(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[3] == k for s in want) for k in KINDS]
        text = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(text.split(",")) <= {*r.spans.split(","), ""}


def test_disclosing_terms(spark):
    rows = [(i, f"Kontakt {'abc'[i % 3]}{i} über zzz: a{i}@mail.de gerne") for i in range(12)]
    rows += [(100 + i, f"nothing here zzz gerne {i}") for i in range(200)]
    rows += [(400 + i, "copied zebra: b@mail.de") for i in range(30)]  # one line, however often copied
    rows += [(500, None), (501, ""), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.term for r in pii.disclosing_terms(df).collect()}
    assert found == {"kontakt", "über"}
    got = pii.find(df).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    first = by[0][0]
    text = rows[0][1]
    assert [text[s.start : s.end] for s in first.spans if s.kind == "term"] == ["Kontakt", "über"]
    assert all(not [s for s in r.spans if s.kind == "term"] for r in by[400] + by[100])
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert clean[0] == "[TERM] a0 [TERM] zzz: [EMAIL] gerne"
    assert clean[100] == rows[12][1] and clean[500] is None and clean[501] == ""


def test_terms_count_by_lines_and_texts(spark):
    rows = [(i, f"signal: s{i}@mail.de") for i in range(100)]
    rows += [(1000 + i, rows[0][1]) for i in range(300)]  # copies of a document leave the term disclosing
    rows += [(2000, "\n".join(f"einmal x{i}@mail.de" for i in range(8)))]  # many lines of one text are no evidence
    rows += [(2001, rows[-1][1])]
    rows += [(3000 + i, f"nothing here {i}") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = [tuple(r) for r in pii.disclosing_terms(df).collect()]
    assert [f[:2] for f in found] == [("signal", "email")] and abs(found[0][2] - 1) < 1e-9


def test_overlapping_spans_become_one(spark):
    df = spark.createDataFrame([(1, "é 4111111111111111@x.de, +4111111111111111!")], "doc_id long, text string")
    assert pii.sanitise(df).first().text == "é [EMAIL], +[CARD]!"


KEY = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"


def test_secrets_and_terms_in_documents_without_entities(spark):
    rows = [(i, f"some words apikey = \"{KEY[i:]}{KEY[:i]}\" more") for i in range(12)]
    rows += [(100, "an apikey of nobody"), (101, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1 " + "ab1" * 20), (102, "internationalisation-of-long-words-is-none")]
    rows += [(200 + i, f"plain words here {i} some more") for i in range(300)]
    rows += [(600, f"{KEY}@mail.de"), (601, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, `a.b` string")
    got = {r.doc_id: r for r in pii.find(df).collect()}
    assert all([s.kind for s in got[i].spans] == ["term", "secret"] for i in range(12))
    assert [(s.kind, s.start, s.end) for s in got[100].spans] == [("term", 3, 9)]
    assert not got[101].spans and not got[102].spans and not got[601].spans and not any(got[200 + i].spans for i in range(300))
    assert [s.kind for s in got[600].spans] == ["email"] and got[600]["a.b"] == "x"
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert clean[0] == 'some words [TERM] = "[SECRET]" more' and clean[601] is None
