"""License scans and PII against plain restatements."""

import random

import pytest
from brute import licenses as plain_licenses
from brute import pii as plain_pii
from pyspark.sql import functions as F

from vendorlake.llm import licenses, pii
from vendorlake.llm.queries import op8_license_scans, op10_pii

ODD = [
    None, "", " ", "\n\n", "MIT License", "cc by cc by", "x mit license mit license\nApache-License", "the İstanbul mit license", "Released under the MIT License.",
    "mit\nlicense", "cc-by", "a" * 5000, "GNU General Public License gnu general public license", "Ünï mit  licensE ünï", "permission granted",
    "x@y@z.com", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "999.1.1.1 1.1.1.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567 +12", "+1+1+1 22222222 3",
    "😀 a@b.co 😀 1.2.3.4", "1 " * 3000, "1" * 4000, "a@" + "b." * 2000 + "c", "00001.2.3.4", "." * 3000, "5 5", "mail: a.b+c@d-e.fr, b@c", "+" * 2000,
]


def made(n, seed):
    r = random.Random(seed)
    bits = ["mit", "license", "cc", "by", "gnu", "general", "public", "apache", "é", "x@y.z", "@", ".", "1", "12", "255", "300", "+", "+49", "-", " ", "\n", "4111111111111111", "a", "_", "%", "😀", "(", ")"]
    return ["".join(r.choice(bits) + r.choice(["", " ", ""]) for _ in range(r.randrange(40))) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    return list(enumerate([*ODD, *made(400, 1)]))


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, labels string, hits int")


def test_license_base(docs, rows):
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    for i, t in rows:
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain_licenses(t), (i, t)
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) | {""}
        assert 0 <= r["score"] <= 1


def wrapped(text, mark="# ", width=30):
    import textwrap

    return "\n".join(mark + line for line in textwrap.wrap(text, width))


def test_templates_meet_the_threshold_exactly(spark):
    from brute import LOWER, WORD

    r = random.Random(5)
    texts = ["Released under the MIT License.", "zz\nreleased UNDER the license", "released under", None, "", *licenses.TEMPLATES.values(), *map(wrapped, licenses.TEMPLATES.values()), *made(100, 3)]
    for t in licenses.TEMPLATES.values():
        for _ in range(8):
            words = t.split()
            for _ in range(r.randrange(1, 5)):
                words[r.randrange(len(words))] = r.choice(["x", "the", "license", "of"])
            texts.append(" ".join([*["x"] * r.randrange(4), *words, *["y the"] * r.randrange(4)]))
    texts.append(" ".join(w + " filler" * 9 for w in licenses.TEMPLATES["bsd-terms"].split()))  # scattered: no block
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = licenses.with_templates(licenses._texts(docs, "doc_id", "text"), licenses.template_order(docs)).collect()
    got = {(r["id"], m["label"]): m["share"] for r in rows for m in r["met"]}
    want = {}
    for i, t in enumerate(texts):
        words = WORD.findall((t or "").translate(LOWER))
        for label, template in licenses.TEMPLATES.items():
            own, size = set(template.split()), len(template.split())
            for k in range(len(words)):
                block = set(words[k : k + size])
                if 100 * len(own & block) >= 80 * len(own) and licenses.TELLING.get(label, words[k]) in block | {words[k]}:
                    want[i, label] = max(want.get((i, label), 0), len(own & block) / len(own))
    assert got == want and len(got) > 40
    whole = {i - 5: label for (i, label), share in got.items() if 5 <= i < 5 + len(licenses.TEMPLATES) and share == 1}
    assert len(whole) == len(licenses.TEMPLATES) and not any(i == len(texts) - 1 for i, _ in got)


def test_license_labels_by_row(spark):
    docs = spark.createDataFrame([(None, "Licensed under CC BY-NC 4.0"), (1, wrapped(licenses.TEMPLATES["mit-grant"])), (1, "x"), (2, "the gnu general public license, \u212a \u0130")], "doc_id long, text string")
    got = [(r["doc_id"], r["labels"]) for r in licenses.scan(docs).collect()]
    assert sorted(got, key=str) == [(1, ""), (1, "mit-grant"), (2, "gpl"), (None, "cc-by,cc-by-nc-4.0")]


def _spans(pattern):
    import re

    return lambda text: [m.span() for m in re.finditer(pattern, text)]


PATTERN_OF = {
    "email": _spans(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": _spans(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": _spans(r"[0-9]([\x20-]?[0-9])+"), "phone": _spans(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def test_pii_base(docs, rows):
    got = {r["doc_id"]: r for r in pii.sanitise(docs).withColumn("names", pii.span_names(F.col("hits"))).collect()}
    for i, t in rows:
        assert got[i]["names"] == ",".join(plain_pii(t)[-1]), (i, t[:80])


def test_pii_sanitised(spark):
    texts = ["write to a@b.co now", "ip 1.2.3.4!", None, "😀 +49 170 1234567 x"]
    got = {r["doc_id"]: r["sanitised"] for r in pii.sanitise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: "write to [EMAIL] now", 1: "ip [IP]!", 2: "", 3: "😀 [PHONE] x"}


def test_pii_revealing_terms(spark):
    # "zorba" stands beside one address only, in different contexts; "the" stands everywhere.
    texts = [f"the {x} zorba the a@b.co {x} the" for x in ("red", "green", "blue", "grey")] + [f"the {i} nothing" for i in range(60)] + [f"the mail q{i}@b.co the" for i in range(6)]
    rows = pii.sanitise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    found = {r["doc_id"]: {texts[r["doc_id"]][t["start"] : t["stop"]] for t in r["terms"]} for r in rows}
    assert all(found[i] == {"zorba"} for i in range(4)) and not any(found[i] for i in range(4, len(texts)))
    assert next(r for r in rows if r["doc_id"] == 0)["sanitised"] == "the red  the [EMAIL] red the"


def test_pii_terms_far_away_and_in_other_documents(spark):
    far = "the " * 40
    texts = [f"zorba {far}{x} the a@b.co {x} {far} Zorba" for x in ("red", "green", "blue", "grey")] + ["the zorba alone", "no zorbax the"] + [f"the {i} nothing" for i in range(100)]
    rows = {r["doc_id"]: r for r in pii.sanitise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    marked = {i: [texts[i][t["start"] : t["stop"]] for t in rows[i]["terms"]] for i in rows}
    assert [marked[i] for i in range(4)] == [["zorba", "Zorba"]] * 4 and marked[4] == ["zorba"] and not any(marked[i] for i in range(5, len(texts)))
    assert rows[4]["sanitised"] in ("the [TERM] alone", "the  alone") and "orba" not in rows[0]["sanitised"]


def test_pii_of_very_many_values_takes_time_in_proportion(spark):
    import time

    text = lambda n: "".join(f"a{i}@b.co " for i in range(n))
    seconds = []
    for n in (100, 25_000, 100_000):
        began = time.perf_counter()
        row = pii.sanitise(spark.createDataFrame([(1, text(n))], "doc_id long, text string")).select(F.size("hits"), "sanitised").first()
        seconds.append(time.perf_counter() - began)
        assert row[0] == n and row[1] == "[EMAIL] " * n
    assert seconds[2] - seconds[0] < 60


def plain_terms(rows, support=3, reach=60, least=0.8):
    """rows: (id, text) -> the spans of revealing terms of each row, by brute force."""
    import math
    import re

    kinds = ("email", "ip", "card", "phone")
    held, words, contexts, n_rows = {}, [], {}, len(rows)
    for k, (_, text) in enumerate(rows):
        hits = [(h.split(":")[0], *map(int, h.split(":")[1:])) for h in plain_pii(text)[-1]]
        masked = list(text or "")
        for _, a, b in hits:
            masked[a:b] = "\uffff" * (b - a)
        found = re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(masked))
        words.append([(m.start(), m.end(), m.group().lower()) for m in found if not re.fullmatch("[0-9]*", m.group()) and "\uffff" not in m.group()])
        for kind in kinds:
            own = [(a, b) for x, a, b in hits if x == kind]
            every = PATTERN_OF[kind](text or "")
            for a, b in own:
                at = every.index((a, b))
                left = every[at - 1][1] if at else 0
                right = every[at + 1][0] if at + 1 < len(every) else len(text)
                e = (kind, text[a:b].lower())
                held.setdefault(e, set()).add(k)
                contexts.setdefault((e, k), set()).add((text[max(left, a - reach) : a], text[b : min(right, b + reach)]))
    has = {}
    for k, ws in enumerate(words):
        for *_, t in ws:
            has.setdefault(t, set()).add(k)
    bad = set()
    for e, docs in held.items():
        for t in {t for k in docs for *_, t in words[k]}:
            both = has[t] & docs
            seen = set().union(*(contexts[e, k] for k in both))
            if len(seen) >= support and len(docs) < n_rows and math.log(len(both) * n_rows / (len(docs) * len(has[t]))) / math.log(n_rows / len(docs)) >= least - 1e-12:
                bad.add(t)
    return [[(a, b) for a, b, t in ws if t in bad] for ws in words]


def test_pii_terms_against_brute_force(spark):
    r = random.Random(12)
    common = ["the", "of", "and", "Red", "green", "lake", "é", "12", "hill"]
    owners = [(f"own{i}", f"Code{i}", f"u{i}@b.co" if i % 2 else f"10.0.0.{i}") for i in range(12)]
    rows = []
    for i in range(260):
        ws = [r.choice(common) for _ in range(r.randrange(3, 30))]
        for a, b, e in r.sample(owners, r.choice((0, 0, 1, 2))):
            for x in (a, b if r.random() < 0.6 else "", e):
                ws.insert(r.randrange(len(ws) + 1), x)
        if i % 40 == 0:
            ws.append(r.choice(owners)[0])
        rows.append((i, " ".join(ws)))
    rows += [rows[3], rows[3], rows[7], (900, None), (901, ""), (None, rows[5][1])]
    found = pii.sanitise(spark.createDataFrame([(*x, "c", 0) for x in rows], "doc_id long, text string, terms string, key int")).select("doc_id", "terms").collect()
    got = sorted(((x["doc_id"] is None, x["doc_id"] or 0), [(t["start"], t["stop"]) for t in x["terms"]]) for x in found)
    want = sorted(((i is None, i or 0), t) for (i, _), t in zip(rows, plain_terms(rows), strict=True))
    assert got == want and sum(map(bool, (t for _, t in got))) > 20


def long_rows():
    """Documents of thousands of words, some with revealing terms and their entities far apart."""
    r = random.Random(5)
    common = ["the", "of", "and", "Red", "green", "lake", "é", "12", "hill"]
    rows = [(i, " ".join(r.choice(common) for _ in range(r.randrange(3, 40)))) for i in range(150)]
    for i in range(8):
        ws = [r.choice(common) for _ in range(3000)]
        for x in ("zorba", "Zorba,", "u1@b.co"):
            ws.insert(r.randrange(len(ws)), x)
        rows.append((200 + i, " ".join(ws)))
    return rows


def test_pii_terms_of_long_texts_against_brute_force(spark):
    rows = long_rows()
    found = pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "terms").collect()
    got = {x["doc_id"]: [(t["start"], t["stop"]) for t in x["terms"]] for x in found}
    assert got == {i: t for (i, _), t in zip(rows, plain_terms(rows), strict=True)} and sum(map(len, got.values())) == 16


def test_pii_a_long_text_with_a_revealing_term_takes_seconds(spark):
    import time

    rows = long_rows()
    rows.append((300, "zorba " + " ".join(f"w{i % 5000} the" for i in range(20_000)) + " u1@b.co and Zorba"))
    began = time.perf_counter()
    found = pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 300").select("sanitised", F.size("terms").alias("n")).first()
    assert time.perf_counter() - began < 45 and found["n"] == 2 and "orba" not in found["sanitised"] and "[EMAIL]" in found["sanitised"]


def test_pii_no_text_is_split_inside_a_lambda(spark):
    """Each array of a text's parts is made once a text, never once an element."""
    df = pii.with_masked(pii.with_hits(spark.createDataFrame([(1, "a@b.co x")], "doc_id long, text string")))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    for body in plan.split("lambdafunction(")[1:]:
        depth, end = 1, 0
        while depth and end < len(body):
            depth += {"(": 1, ")": -1}.get(body[end], 0)
            end += 1
        assert "split(" not in body[:end] and "regexp_extract_all(" not in body[:end]


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert licenses.scan(none).count() == 0 and pii.sanitise(none).count() == 0


def test_null_ids_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "mit license a@b.co"), (1, "x"), (1, "x")], "doc_id long, text string")
    assert licenses.scan(docs).count() == 3 and pii.sanitise(docs).count() == 3


def test_queries(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op8_license_scans(spark, sf).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain_licenses(docs[r["doc_id"]])
    for r in op10_pii(spark, sf).collect():
        *counts, digest, spans = plain_pii(docs[r["doc_id"]])
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == counts and r["base_sha256"] == digest
        assert r["spans"].split(",")[: len(spans)] == spans or not spans
