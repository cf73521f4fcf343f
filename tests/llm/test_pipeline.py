import random

import corpus_pipeline as cp
from revlytics.llm.components import connected_components


def test_stages_keep_columns_and_clean_documents(spark, sf, docs):
    now, sizes = docs, []
    for name, step in cp.STAGES:
        out = step(spark, now, sf)
        if name != "packing":
            assert out.columns == docs.columns
        path = spark.conf.get("spark.checkpoint.dir") + f"/test-{name}"
        out.write.mode("overwrite").parquet(path)
        now = spark.read.parquet(path)
        sizes.append(now.count())
    assert sizes[0] <= docs.count() and sizes[1] <= sizes[0] and sizes[2] == sizes[3] == sizes[1]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    path = spark.conf.get("spark.checkpoint.dir") + "/test-quality"
    kept = {r["doc_id"] for r in spark.read.parquet(path).select("doc_id").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) > 0.97 * len(good)


def test_near_duplicates_keep_one_of_each_group(spark, sf):
    base = " ".join(f"word{k}" for k in range(200))
    near = base.replace("word57 ", "other ")
    rows = [(5, base), (3, near), (9, base), (7, " ".join(f"other{k}" for k in range(200))), (None, base)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [r["doc_id"] for r in cp.near_duplicate(spark, df, sf).collect()]
    assert sorted(got) == [3, 7]  # a row without an id is a copy like any other


def test_stages_take_nasty_rows(spark, sf, nasty, none):
    for df in (nasty, none):
        for _, step in cp.STAGES:
            step(spark, df, sf).count()


def similar_by_brute_force(texts):
    """Least id of each text's group: exact Jaccard of distinct five-word shingles, 0.8 or more, chained."""
    sets = {}
    for i, t in texts.items():
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    group = {i: i for i in texts}
    for i in texts:
        for j in texts:
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and group[i] != group[j]:
                a, b = sorted((group[i], group[j]))
                group = {k: a if g == b else g for k, g in group.items()}
    return group


def kept_ids(spark, sf, texts):
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    return sorted(r["doc_id"] for r in cp.near_duplicate(spark, df, sf).collect())


def test_distinct_documents_of_one_template_stay(spark, sf):
    # 300 shared words and 100 of their own (similarity 0.58), and one line repeated 200 times before 30 words of their own.
    shared = " ".join(f"w{k}" for k in range(300))
    texts = {d: shared + " " + " ".join(f"own{d}x{k}" for k in range(100)) for d in range(12)}
    texts |= {50 + d: "all rights are reserved here " * 200 + " ".join(f"mine{d}x{k}" for k in range(30)) for d in range(6)}
    assert kept_ids(spark, sf, texts) == sorted(texts)


def test_near_duplicates_against_brute_force(spark, sf):
    rng = random.Random(8)
    texts = {}
    for family in range(60):
        base = [f"f{family}w{k}" for k in range(rng.randint(20, 200))]
        for _ in range(4):  # contiguous changes: similarities from 0.7 to 0.9
            at, n = rng.randrange(len(base)), rng.randint(1, max(1, len(base) // 9))
            texts[len(texts)] = " ".join(base[:at] + [f"n{len(texts)}x{k}" for k in range(n)] + base[at + n :])
    group = similar_by_brute_force(texts)
    assert 60 < len(set(group.values())) < len(texts)
    assert kept_ids(spark, sf, texts) == sorted(set(group.values()))


def test_near_duplicates_of_short_texts_that_share_phrases(spark, sf):
    rng = random.Random(3)
    texts = {0: "a b c d e f g h", 1: "a b c d e f g h i"}  # 4 and 5 shingles: exactly 4/5
    phrases = [[f"p{p}w{k}" for k in range(rng.randint(6, 30))] for p in range(8)]
    for d in range(2, 240):
        words = sum(rng.sample(phrases, rng.randint(1, 3)), [])
        at = rng.randint(0, len(words) // 5)
        texts[d] = " ".join(words[at:] + [f"t{d}"] * rng.randint(0, 1))
    group = similar_by_brute_force(texts)
    assert 20 < len(set(group.values())) < len(texts) - 20
    assert kept_ids(spark, sf, texts) == sorted(set(group.values()))


def test_components_by_union(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(7, 900), (8, 900), (7, 7)] + [(1000 + k, 1001 + k) for k in range(60)]
    root = {i: i for e in edges if e[0] != e[1] for i in e}
    for _ in range(400):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert sorted((r["node"], r["root"]) for r in got) == sorted(root.items())
