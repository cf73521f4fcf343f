"""Columns whose names are an operator's own keep their values; a chunk store holds each digest's bytes once."""

import random

from revlytics.llm import media, pii, quality_classifier, secrets, substrings
from revlytics.llm.common import free_name

OWN = ("_doc", "_tag", "_group", "doc", "row", "text", "_k1", "new", "n_email", "uid", "pieces", "found", "score", "key", "fp", "mark", "node")


def clashing(spark):
    texts = ["mail a.b@c.example.com and more words of this text", None, "", "a passage of more than fifty bytes that two documents have alike", "a passage of more than fifty bytes that two documents have alike!"]
    rows = [(i, t, *(f"{c}{i}" for c in OWN)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, body string, " + ", ".join(f"`{c}` string" for c in OWN))


def test_clashing_names_keep_their_values(spark):
    df = clashing(spark)
    want = {r["doc_id"]: [r[c] for c in OWN] for r in df.collect()}
    model = quality_classifier.fit_quality(df, df.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality"), text_col="body")
    outs = {
        "repeats": substrings.remove_repeats(df, text_col="body"), "pii": pii.replace_pii(df, "k", text_col="body"), "secrets": secrets.redact_secrets(df, text_col="body"),
        "quality": quality_classifier.score_quality(df, model, text_col="body", score_col=free_name(df, "score")),
    }
    for name, out in outs.items():
        got = {r["doc_id"]: r for r in out.collect()}
        assert {i: [r[c] for c in OWN] for i, r in got.items()} == want, name
        assert out.columns[: len(df.columns)] == df.columns, name
        if name == "pii":
            assert got[0]["n_email_"] == 1 and "a.b@c" not in got[0]["body"] and got[1]["body"] is None
        if name == "repeats":
            assert got[3]["body"].startswith("a passage") and len(got[4]["body"]) < 10


def test_store_holds_each_digest_once(spark):
    rng = random.Random(6)
    block = ["".join(rng.choices("abcdefgh ", k=9000)) for _ in range(4)]
    texts = ["".join(rng.sample(block, 2)) + str(i % 9) for i in range(40)] + ["plain text", "plain text", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    plan, unsure = media.plan_store(media.chunk_lists(df))
    held = [(d, b) for r in media.write_store(df, plan, unsure).collect() for d, b in zip(r["digests"], r["bodies"]) if b is not None]
    want = {media.digest(c): len(c) for t in texts for c in media.chunks(media.medium((t or "").encode())[0])}
    assert sorted((bytes(d), len(b)) for d, b in held) == sorted(want.items())
