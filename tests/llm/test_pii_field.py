"""What the field adds to patterns and what it rejects, and the query's rows against plain regular expressions."""

import hashlib
import re

import pytest

from dockmill.llm import pii, queries

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: A closing pattern for secrets: the field has to do better than it.
ALIKE = re.compile(r"[A-Za-z0-9_+/=-]{16,}")


@pytest.fixture(scope="module")
def model():
    return pii.trained()


def spans(text, model):
    ((_, every),) = pii.find_spans([text], model)
    return [(pii.KINDS[k], text[s:e]) for s, e, k in every]


def test_secrets_are_told_by_their_words(model):
    value = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    assert spans(f'the token = "{value}" here', model) == [("secret", value)]
    assert spans(f'the sha1 = "{value}" here', model) == [] == spans(f"commit {value}", model)
    assert spans("password: hunter22!", model) == [("secret", "hunter22")] or spans("password: hunter22!", model) == [("secret", "hunter22!")]
    assert spans("tel: (030) 555-0199 or", model) == [("phone", "(030) 555-0199")]
    assert spans("anna [at] host [dot] org", model) == [("email", "anna [at] host [dot] org")]
    assert spans("in 2019 page 12 of 300", model) == []


def test_field_against_the_pattern_alone(model):
    held = pii.labelled_table(500, 77)
    want = [y for _, labels in held for y in labels]
    said = [pii.LABELS[x] for path in model.decode([w for w, _ in held]) for x in path]
    flat = [w[1:] for words, _ in held for w in words]
    plain = ["B-secret" if (m := ALIKE.search(w)) and sum(c.isdigit() for c in m[0]) >= 3 and any(c.isalpha() for c in m[0]) else "O" for w in flat]

    def f1(got):
        hit = sum(g == w == "B-secret" for g, w in zip(got, want, strict=True))
        return 2 * hit / (got.count("B-secret") + want.count("B-secret"))

    assert f1(said) > 0.93 and f1(plain) < 0.7
    assert sum(a == "B-secret" and b == "O" for a, b in zip(said, plain, strict=True)) > 20  # found where the pattern finds nothing
    assert sum(a == "O" and b == "B-secret" == c for a, b, c in zip(said, plain, want, strict=True)) < 10
    assert sum(a == "O" and b == "B-secret" for a, b in zip(said, plain, strict=True)) > 20  # rejected where it would accept


def plain_spans(t):
    def digits(m):
        return re.sub("[^0-9]", "", m[0])

    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)] + [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(p) < 256 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(t) if 12 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return sorted(out + [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 9 <= len(digits(m)) <= 15])


def test_query_rows_equal_plain_search(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.QUERIES["op8_pii"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        base, r = plain_spans(d.text or ""), got[d.doc_id]
        said = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in base) for j in range(4)]
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert {*said.split(",")} - {""} <= {*r.spans.split(",")}
        assert all(d.text[int(x[1]) : int(x[2])] for x in (y.split(":") for y in r.spans.split(",") if y))
