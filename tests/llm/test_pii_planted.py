"""Planted entities of every kind and many forms: found, replaced consistently and distinctly; plain text stays."""

import random
import re

from revlytics.llm import pii

FORMS = {
    "email": ["{a}.{n}@example{n}.org", "{A}{n}+x@sub.müller{n}.example.com", "jörg{n}@m{n}.de", "иван{n}@почта{n}.рф"],
    "phone": ["({p}) 555-{d4}", "{p}-555-{d4}", "{p} 555 {d4}", "+1 {p} 555 {d4}", "+49 (0)30 {d4} {d4}", "+33 1 23 45 {d2} {d2}"],
    "ip": ["10.{b}.{c}.7", "203.0.{b}.{c}", "fe80::1ff:fe{x2}:{x4}:890a", "2001:db8::{x4}:{x4}", "2001:0db8:85a3:0000:0000:8a2e:{x4}:{x4}"],
    "card": ["4111 1111 {d4} {d4}", "41111111{d4}{d4}"],
    "identity": ["{p}-{d2}-{d4}", "{p} {d2} {d4}"],
    "account": ["DE{d2} {d4} {d4} {d4} {d4} {d2}", "GB{d2}WEST{d4}{d4}{d4}{d2}"],
    "name": ["Mrs. Anna Maria {F}", "Mrs. de {F}", "MR. {FF}", "Dr. J. K. {F}", "Herr Ludwig van der {F}", "Señora Lucía {F}", "госпожа Анна Мария {C}", "Prof {F}", "Mme {F}"],
}
PLAIN = ["std::vector<a>", "at 12:30:45 we met", "a::b", "version 1.2.3", "Mr and Mrs", "the year 2024 05 11", "00:1a:2b:3c:4d:5e", "100 200 300 400 500", "1234 567 890 12345", "x@y", "sr engineer", "Drs. are here", "Ämter und Häuser"]


def make(rng, form):
    d = lambda k: "".join(rng.choices("0123456789", k=k))
    x = lambda k: "".join(rng.choices("123456789abcdef", k=k))
    family = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8))
    values = {"a": "".join(rng.choices("abcdef", k=5)), "A": "".join(rng.choices("ABCDEF", k=5)), "n": rng.randrange(10**6), "p": rng.randrange(200, 999), "b": rng.randrange(256), "c": rng.randrange(256), "F": family.capitalize(), "FF": family.upper(), "C": "".join(rng.choices("бвгдежзиклмнопрст", k=8)).capitalize()}
    out = re.sub(r"\{d(\d)\}", lambda m: d(int(m[1])), form)
    out = re.sub(r"\{x(\d)\}", lambda m: x(int(m[1])), out)
    return out.format(**values)


def test_planted_entities_go(spark):
    rng, rows = random.Random(12), []
    for kind, forms in FORMS.items():
        for form in forms:
            for _ in range(25):
                rows.append((kind, make(rng, form)))
    docs = [(i, f"Please ask about {e}, twice: {e}; then rest.") for i, (_, e) in enumerate(rows)]
    got = {r["doc_id"]: r for r in pii.replace_pii(spark.createDataFrame(docs, "doc_id long, text string"), "k").collect()}
    for kind, forms in FORMS.items():
        mine = [i for i, (k, _) in enumerate(rows) if k == kind]
        gone = [i for i in mine if rows[i][1] not in got[i]["text"] and got[i][f"n_{kind}"] == 2 and rows[i][1].split()[-1] not in got[i]["text"].split()]
        assert len(gone) >= 0.98 * len(mine), (kind, [(rows[i][1], got[i]["text"]) for i in mine if i not in gone][:5])
    new = {}
    for i, (kind, e) in enumerate(rows):
        found = re.fullmatch(r"Please ask about (.*), twice: (.*); then rest\.", got[i]["text"])
        assert found and found[1] == found[2], got[i]["text"]  # one entity, one surrogate; the text around it stays
        new.setdefault((kind, found[1].lower() if kind in ("email", "ip") else re.sub(r"[^0-9A-Z]", "", found[1]) if kind not in ("name",) else found[1].split()[-1].lower()), set()).add(re.sub(r"\D", "", e)[-10:] if kind in ("phone", "identity", "card") else e.split()[-1].lower() if kind == "name" else e.lower())
    assert all(len(v) == 1 for v in new.values()), [x for x in new.items() if len(x[1]) > 1][:3]


def test_plain_text_stays(spark):
    docs = [(i, t) for i, t in enumerate(PLAIN)]
    got = {r["doc_id"]: r["text"] for r in pii.replace_pii(spark.createDataFrame(docs, "doc_id long, text string"), "k").collect()}
    assert got == dict(docs)


def test_no_public_key(spark):
    assert spark.conf.get("revlytics.pii.key", None) is None
    key = pii.own_key(spark)
    assert len(key) == 64 and pii.own_key(spark) == key
    spark.conf.set("revlytics.pii.key", "mine")
    try:
        assert pii.own_key(spark) == "mine"
    finally:
        spark.conf.unset("revlytics.pii.key")
