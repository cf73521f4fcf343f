"""Line numbers of files that are read in many splits; the first line that isn't JSON."""

import random

import pytest

from revlytics.sources.lines import numbered_lines, read_strict


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "9"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v) if v else spark.conf.unset(k)


def test_lines_are_numbered_across_splits(spark, tmp_path, small_splits):
    rng, want = random.Random(5), {}
    for name, ends in (("a", ["\n"]), ("b", ["\r\n"]), ("c", ["\n", "\r\n"]), ("d", ["\n"]), ("e", [])):
        lines = [rng.choice(["", "é" * rng.randrange(40), "x" * rng.randrange(300), "1"]) for _ in range(400 if ends else 0)]
        text = "".join(x + rng.choice(ends) for x in lines) + ("last" if name == "d" else "")
        (tmp_path / name).write_bytes(text.encode())
        want |= {(name, i): x for i, x in enumerate(lines + ["last"] * (name == "d"), 1)}
    df = numbered_lines(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() > 9 or spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 9
    assert {(r["file"].rsplit("/", 1)[1], r["line"]): r["value"] for r in df.collect()} == want
    some = numbered_lines(spark, str(tmp_path), lambda v: v == "1")
    assert {(r["file"].rsplit("/", 1)[1], r["line"]) for r in some.collect()} == {k for k, v in want.items() if v == "1"}


def test_the_first_bad_line_is_named(spark, tmp_path, small_splits):
    rows = ['{"id": %d, "v": "%s"}' % (i, "y" * 50) for i in range(300)]
    path = tmp_path / "cases.jsonl"
    path.write_text("\n\n".join(rows) + "\n  \n")
    assert sorted(r["id"] for r in read_strict(spark, str(path), "id int, v string", "id").collect()) == list(range(300))
    rows[250], rows[120] = "{broken", '{"id": 1,}'
    path.write_text("\r\n\r\n".join(rows))
    with pytest.raises(ValueError, match=r"cases.jsonl:241: not JSON"):
        read_strict(spark, str(path), "id int, v string")
    path.write_text('{"id": 7}\n{"id": 8}\n{"id": 8}\n')
    with pytest.raises(ValueError, match="id comes 2 times: 8"):
        read_strict(spark, str(path), "id int", "id")
