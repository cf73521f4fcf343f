"""What staged tables leave on local disks, and what repeated passages' rows take there."""

import time

import numpy as np
import pyarrow as pa

from revlytics.llm import common, substrings
from revlytics.llm.common import utf8

SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in files.split("\n") if "/shuffle_" in f}


def test_shuffle_files_go_with_the_write_that_made_them(spark, monkeypatch):
    monkeypatch.setattr(common, "clean", lambda spark: None)  # no garbage is collected
    df = spark.range(1000).selectExpr("id % 100 as k").repartition(7).groupBy("k").count()
    before = _shuffle_files(spark)
    first = common.stage(df, "t")
    until = time.monotonic() + 10
    while _shuffle_files(spark) - before and time.monotonic() < until:
        time.sleep(0.1)
    assert not _shuffle_files(spark) - before
    assert spark.conf.get(SETTING, None) in (None, "false")
    assert first.count() == common.stage(df, "t").count() == df.count() == 100  # the frame may be run again


def test_runs_take_few_bytes_on_their_way_to_buckets(spark):
    rng = np.random.default_rng(5)
    texts = ["".join(map(chr, rng.integers(97, 123, 2000))) for _ in range(400)]
    source, _, groups = substrings._prepared(spark.createDataFrame(list(enumerate(texts)), "doc long, text string"))
    runs = substrings._local_runs(source, 8, groups, 50)
    fields = [c for c, t in runs.dtypes if t == "binary"]
    held = sum(len(x or b"") for r in runs.select(*fields).collect() for x in r)
    data, offsets = utf8(pa.array(texts))
    assert held < 20 * len(substrings.runs_of(data, offsets)["row"])  # 30 as they are


def test_packed_fields_come_back(spark):
    rng, n = np.random.default_rng(6), 5000
    ends = np.array([-(2**63), 2**63 - 1, 0, -1])
    fields = {"doc": np.concatenate([ends, rng.integers(-(2**63), 2**63 - 1, n - 4)]), "tag": rng.integers(0, 2**32, n), "pos": rng.integers(0, 2**32, n), "num": rng.integers(0, 40, n)}
    for key in (np.zeros(n, np.int64), np.arange(n), rng.integers(0, 60, n)):
        rows = substrings._packed(substrings.MARK, 1, key, fields)
        order = np.argsort(key, kind="stable")
        assert [r["key"] for r in rows] == sorted(set(key.tolist())) and {r["kind"] for r in rows} == {1}
        back = substrings._unpacked(pa.Table.from_pylist(rows, substrings.PACKED_ARROW), substrings.MARK)
        for c, t in substrings.MARK.items():
            assert back[c].dtype == t and (back[c] == fields[c][order].astype(t)).all()
    none = {c: np.zeros(0) for c in substrings.MARK}
    assert substrings._packed(substrings.MARK, 1, np.zeros(0, np.int64), none) == []
    assert all(len(x) == 0 for x in substrings._unpacked(substrings.PACKED_ARROW.empty_table(), substrings.MARK).values())


def test_contexts_that_cannot_match_are_left_out_and_no_other(spark):
    rng, length = np.random.default_rng(7), substrings.LENGTH
    pieces = ["".join(map(chr, rng.integers(97, 101, k))) for k in rng.integers(15, 70, 40)]
    texts = ["".join(pieces[k] for k in rng.integers(0, 40, 12)) for _ in range(60)]
    data, offsets = utf8(pa.array(texts))
    r = substrings.runs_of(data, offsets)
    body = [texts[a][p : p + k + length - 1] for a, p, k in zip(r["row"].tolist(), r["pos"].tolist(), r["num"].tolist())]
    joined, ends = utf8(pa.array(body))
    keep = substrings.may_match(joined, ends, r["row"])
    whose, same_anchor = {}, {}
    for text, doc, anchor in zip(body, r["row"].tolist(), r["anchor"].tolist()):
        same_anchor.setdefault(anchor, set()).add(doc)
        for k in range(len(text) - length + 1):
            whose.setdefault(text[k : k + length], set()).add(doc)
    must = [any(len(whose[t[k : k + length]]) > 1 for k in range(len(t) - length + 1)) for t in body]
    asked = sum(len(same_anchor[a]) > 1 for a in r["anchor"].tolist())
    assert all(k for k, m in zip(keep.tolist(), must) if m)
    assert sum(must) < keep.sum() < asked
