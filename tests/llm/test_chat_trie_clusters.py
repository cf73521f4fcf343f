"""Chat formatting, the conversation trie and centroid clustering against brute force and DuckDB; nulls, ties, repeats, clashing names."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from revlytics.llm import catalog, chat, clusters, tries

TURNS = "conv_id long, turn long, role string, text string"
NASTY = [
    (1, 0, "user", "a"), (1, 1, "assistant", None), (1, None, None, "before all"), (2, 0, "user", ""), (2, 0, "user", ""), (2, 1, "assistant", "</s>"),
    (3, 0, "user", "[INST] x [/INST]y</s><s>"), (3, 1, "assistant", "<\\/s>[\\\\INST]<|im_end|><<SYS>>"), (4, 5, "a [/INST] role</s>", "\\"), (None, 0, "assistant", "no id"),
    (5, 0, "user", "x" * 300_000), (5, 1, "assistant", "é漢🙂 " * 9000 + "<"), (6, 0, "assistant", "</s"), (6, 1, "assistant", " [/INST"), (-3, 0, "user", "b"),
]


@pytest.fixture(scope="module")
def turns(spark):
    df = spark.createDataFrame(NASTY, TURNS)
    return df.withColumns({c: F.lit(7) for c in ("start", "chunk", "formatted", "token", "key", "words", "n", "range", "kind", "source", "as", "t", "base", "h")})


def duck(sf):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(rows):
    return sorted((tuple(None if pd.isna(v) else v if isinstance(v, str) else int(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", ["op11_chat_round_trip", "op12_conversation_trie", "op13_centroid_clusters"])
def test_query_equals_sql(spark, sf, name):
    got, want = catalog.queries()[name](spark, sf).toPandas(), duck(sf).execute(catalog.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert plain(got[columns].itertuples(index=False)) == plain(want[columns].itertuples(index=False))


# ---- 11 chat


def brute_chats(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(v)] for c, v in by.items()}


def test_chats_come_back(turns):
    written = chat.format_chats(turns)
    want = brute_chats(NASTY)
    got = {r["conv_id"]: r for r in chat.read_chats(written).collect()}
    assert got.keys() == want.keys()
    for c, said in want.items():
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == said
        assert "".join(got[c]["learned"]) == "".join(t for r, t in said if r == "assistant")
        assert got[c]["formatted"].count("</s>") == len(said) == len(re.findall(r"<s>\[INST\] ", got[c]["formatted"]))
    spans = {r["conv_id"]: r for r in written.collect()}
    assert [spans[1]["formatted"][s["loss_start"] : s["loss_end"]] for s in spans[1]["turns"]] == ["", "", ""]
    assert spans[6]["formatted"][spans[6]["turns"][0]["loss_start"] : spans[6]["turns"][0]["loss_end"]] == "</s"
    digests = {r["conv_id"]: r for r in chat.chat_digests(written).collect()}
    assert digests[2]["turns_sha256"] == hashlib.sha256(b"user\n\nuser\n\nassistant\n</s>\n").hexdigest()
    assert (digests[2]["loss_chars"], digests[2]["n_turns"]) == (4, 3)


def test_only_conflicting_turns_are_escaped(spark):
    df = spark.createDataFrame([(1, 0, "user", "plain < text [ | /s>"), (1, 1, "assistant", "a </s> b")], TURNS)
    assert chat.format_chats(df).first()["formatted"] == "<s>[INST] user [/INST]plain < text [ | /s></s><s>[INST] assistant [/INST]a <\\/s> b</s>"


def test_random_control_strings(spark):
    rng = random.Random(3)
    bits = ["<", "[", "\\", "/", "s>", "</s>", "<s>", "[INST]", " [/INST]", "|", "<|", "SYS>>", "a", " ", "\n", "$1", "é"]
    make = lambda: "".join(rng.choices(bits, k=rng.randrange(9)))
    rows = [(c, t, rng.choice(["user", "assistant", make()]), make()) for c in range(400) for t in range(rng.randrange(1, 6))]
    got = {r["conv_id"]: [tuple(x) for x in r["turns"]] for r in chat.read_chats(chat.format_chats(spark.createDataFrame(rows, TURNS))).collect()}
    assert got == brute_chats(rows)


def test_chat_is_native(spark, turns):
    text = chat.chat_digests(chat.format_chats(turns))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|ExternalRDD", text.replace("Scan ExistingRDD", ""))


def test_chat_empty(turns):
    assert chat.chat_digests(chat.format_chats(turns.where("false"))).collect() == []


# ---- 12 trie


def brute_trie(convs):
    """convs: id -> list of (token, words)."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, t in convs.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
        ends[tuple(t)].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    saved, leaves = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * node[-1][1] if node else 0
        saved[node] = own + sum(saved[k] for k in kids[node])
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
    return sorted(
        ((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids[n]), leaves[n], saved[n], hashlib.sha256(",".join(map(str, sorted(ends.get(n, [])))).encode()).hexdigest()) for n, m in members.items()),
        key=str,
    )


def found(trie):
    return sorted((tuple(r) for r in trie.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def framed(spark, convs):
    return spark.createDataFrame([(c, [(hashlib.md5(k.encode()).hexdigest(), w) for k, w in t]) for c, t in convs.items()], "conv_id long, turns array<struct<token string, words int>>")


@pytest.mark.parametrize("seed,ranges,run_rows", [(1, 1, 4096), (2, 5, 7), (3, 13, 1), (4, 40, 3)])
def test_trie_is_the_brute_force_trie(spark, seed, ranges, run_rows):
    rng = random.Random(seed)
    convs = {}
    for c in rng.sample(range(3000), 300):
        convs[c] = [(k, ord(k)) for k in (rng.choice("ab") if rng.random() < 0.8 else rng.choice("cdefgh") for _ in range(rng.choice([0, 1, 2, 3, 5, 9])))]
    for c in range(5000, 5300):  # a hot group of copies over several blocks
        convs[c * 11] = [("a", 97), ("hot", 3)]
    convs[9] = [("deep", 1)] * 700  # a long chain, and one that shares it
    convs[10] = [("deep", 1)] * 690 + [("x", 2)]
    assert found(tries.prefix_trie(framed(spark, convs), ranges, run_rows)) == brute_trie(convs)


def test_loser_tree_keeps_lcps():
    rng = random.Random(5)
    keys = list({bytes(rng.choices(b"ab", k=rng.randrange(7))) for _ in range(200)})
    keys = [b"".join(bytes([x]) * tries.UNIT for x in k) for k in keys]
    for n in (1, 2, 3, 7, 50):
        runs = [tries.sorted_run([(k,) for k in keys[i::n]]) for i in range(n)]
        out = list(tries.merged([r for r in runs if r[0]]))
        assert [r[0] for r, _ in out] == sorted(keys)
        assert [k for _, k in out][1:] == [tries.shared(a, b, 0) for a, b in zip(sorted(keys), sorted(keys)[1:])]
    assert list(tries.merged([])) == []


def test_trie_nasty(spark, turns):
    own = tries.conversations(turns)
    said = {c: [(r, t, len(re.findall(tries.WORD, t))) for r, t in v] for c, v in brute_chats(NASTY).items() if c is not None}
    base = lambda c: c - int(np.fmod(c, 20))
    convs = {}
    for c, t in said.items():
        h = zlib.crc32(str(c).encode()) % 4
        convs[c] = [((r, x), w) for r, x, w in said.get(base(c), [])[:h] + t[h:]]
    assert found(tries.prefix_trie(tries.rebuilt(own), 3, 2)) == brute_trie(convs)
    assert found(tries.prefix_trie(tries.rebuilt(tries.conversations(turns.where("false"))))) == []


def test_rebuilt_takes_the_head_of_the_group(spark):
    rows = [(c, t, "user", f"{c}:{t}") for c in (20, 21, 22, 23, 24, 33, 41, 47) for t in range(c % 5 + 1)]
    said = brute_chats(rows)
    got = {r["conv_id"]: len(r["turns"]) for r in tries.rebuilt(tries.conversations(spark.createDataFrame(rows, TURNS))).collect()}
    want = {c: len(said.get(c - c % 20, [])[: (h := zlib.crc32(str(c).encode()) % 4)] + said[c][h:]) for c in said}
    assert got == want


# ---- 13 clusters


def brute_clusters(rows, k, rounds, dims):
    kept = [(i, [int(np.floor(1024 * np.float64(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    name = lambda i: (i is None, hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest())
    cents = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), np.array(r[1], "<i4").tobytes()))[:k]]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min(range(len(cents)), key=lambda j: (gap(v, cents[j]), j))
    for _ in range(rounds):
        at = [near(v) for _, v in kept]
        for j in range(len(cents)):
            mine = [v for (_, v), a in zip(kept, at) if a == j]
            if mine:
                cents[j] = [sum(c) // len(mine) for c in zip(*mine)]
    return sorted(((i, near(v), gap(v, cents[near(v)])) for i, v in kept), key=str)


def test_clusters_are_the_brute_force_clusters(spark):
    rng = random.Random(8)
    rows = [(i, [rng.choice([-1, 0, 1]) / 1024 if i % 3 else rng.uniform(-2, 2) for _ in range(6)]) for i in range(200)]
    rows += [(1, rows[1][1]), (1, rows[2][1]), (None, [0.5] * 6), (300, None), (301, []), (302, [0.1] * 5), (303, [0.1] * 7), (304, [None] + [0.1] * 5), (305, [float("nan")] * 6), (306, [float("inf")] + [0.0] * 5), (307, [1e4, -1e4, 0.0, 3e4, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"x": F.lit(1), "cluster": F.lit("c"), "name": F.lit(0)}).repartition(5)
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    for k, rounds in ((8, 10), (3, 1), (1, 2)):
        got, _ = clusters.centroid_clusters(df, k=k, rounds=rounds, dims=6)
        assert sorted((tuple(r) for r in got.select("vec_id", "cluster", "distance").collect()), key=str) == brute_clusters(rows, k, rounds, 6)
    few, cents = clusters.centroid_clusters(df.where("vec_id in (4, 5)"), dims=6)
    assert len(cents) == 2 and few.count() == 2
    assert clusters.centroid_clusters(df.where("false"), dims=6)[0].collect() == []


def test_screening_never_loses_the_nearest():
    rng = np.random.default_rng(2)
    for size in (3, 1 << 12, 1 << 20, (1 << 27) - 1):
        c = rng.integers(-size, size + 1, (9, 64))
        c[5], c[6, 3] = c[2], min(size, c[2, 3] + 1)
        x = np.concatenate([rng.integers(-size, size + 1, (300, 64)), (c[rng.integers(0, 9, 300)] + c[rng.integers(0, 9, 300)]) // 2])
        exact = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w)) for w in c] for v in x], object)
        assert clusters.nearest(x, c).tolist() == [min(range(9), key=lambda j: (row[j], j)) for row in exact]


def test_too_large_a_component_fails(spark):
    df = spark.createDataFrame([(1, [1e9] * 4)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="64 bits"):
        clusters.centroid_clusters(df, dims=4)[0].collect()
