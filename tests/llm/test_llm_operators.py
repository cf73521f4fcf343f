"""Each operator against brute force on a small table, and on rows that are null, empty, very long or repeated."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from revlytics.llm import bpe, bwt, catalog, media, packing, pii, quality_classifier, quality_rules, secrets, sharding, simhash, substrings
from revlytics.llm.common import utf8

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df):
    return df.collect()


# ---- 1 sharding


def best_contiguous(sizes, shards):
    def fits(c):
        n, at = 1, 0
        for s in sizes:
            if s > c:
                return False
            if at + s > c:
                n, at = n + 1, 0
            at += s
        return n <= shards

    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


def test_sharding_is_minimax(spark, docs, sf):
    base = sharding.sized(docs, "doc_id", "text", 16)
    sizes = defaultdict(int)
    for r in rows(base):
        sizes[r["key"]] += r["size"]
    for shards in (3, 7, 40):
        got = defaultdict(int)
        place = {}
        for r in rows(sharding.minimax_shards(docs, shards)):
            got[r["shard"]] += r["size"]
            place.setdefault(r["shard"], []).append(r["slot"])
        assert max(got.values()) == best_contiguous([sizes[k] for k in sorted(sizes)], shards)
        assert all(sorted(v) == list(range(len(v))) for v in place.values())


def test_sharding_with_a_hot_group():
    # One group of more than a share: the others still use all shards.
    ranges = sharding._Ranges([(i, 0, 1000 if i == 5 else 10, True) for i in range(100)])
    capacity = ranges.smallest(10)
    cuts = ranges.even_cuts(capacity, 10)
    assert capacity == 1000 and len(set(cuts)) == 9


def test_sharding_nasty(nasty, none):
    got = rows(sharding.minimax_shards(nasty, 4))
    assert len(got) == 12 and {r["shard"] for r in got if r["doc_id"] in (1, 2)}.__len__() == 1
    assert [r["size"] for r in got if r["doc_id"] == 3] == [16]
    assert rows(sharding.minimax_shards(none, 4)) == []


# ---- 2 SimHash


def brute_print(text, n=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    if not w:
        return 0
    sh = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_query_against_brute_force(spark, sf, texts):
    prints = {i: brute_print(t) for i, t in texts.items()}
    ids, root = sorted(prints), {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows(simhash.op2_simhash_near_dedup(spark, sf))}
    assert got == {i: (f"{prints[i]:016x}", find(i)) for i in ids}


@pytest.mark.parametrize("bits,radius", [(64, 4), (64, 0), (128, 20), (256, 48)])
def test_bit_sliced_pairs(bits, radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, (20, bits // 64), dtype=np.uint64)
    words = base[rng.integers(0, 20, 300)].copy()
    flat = np.unpackbits(words.view(np.uint8), axis=1)
    flat ^= rng.random(flat.shape) < radius / bits
    words = np.packbits(flat, axis=1).view(np.uint64)
    far = np.bitwise_count(words[:, None, :] ^ words[None, :, :]).sum(-1)
    got = {(i, int(j)) for i, near in simhash.close_pairs(np.unpackbits(words.view(np.uint8), axis=1, bitorder="little"), radius) for j in near}
    assert got == {(i, j) for i in range(300) for j in range(i + 1, 300) if far[i, j] <= radius}


def test_large_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 8)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    words = np.unique(np.array([int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 5), replace=False)) for b in base for _ in range(30)], np.uint64))
    df = spark.createDataFrame([(bytearray(w.tobytes()),) for w in words], "fp binary")
    root = {w.tobytes(): w.tobytes() for w in words}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in rows(simhash.links(df, 4, simhash.Blocks(64, 4))):
        x, y = find(bytes(r["a"])), find(bytes(r["b"]))
        root[max(x, y)] = min(x, y)
    mine = [find(w.tobytes()) for w in words]
    for i in range(len(words)):
        for j in range(i):
            if (int(words[i]) ^ int(words[j])).bit_count() <= 4:
                assert mine[i] == mine[j]


def test_links_where_adaptive_execution_broadcasts_the_counts(spark):
    # As with large tables: planned as a sort-merge join on the bucket's key, turned into a broadcast join while running. A bucket's rows must still meet.
    settings = {"spark.sql.autoBroadcastJoinThreshold": "50k", "spark.sql.sources.fileCompressionFactor": "1000", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 2, dtype=np.uint64)
    words = np.unique(np.array([int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 5), replace=False)) for b in base for _ in range(400)], np.uint64))
    df = spark.createDataFrame([(bytearray(w.tobytes()),) for w in words], "fp binary").repartition(4)
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        found = rows(simhash.links(df, 4, simhash.Blocks(64, 4)))
    finally:
        for k in settings:
            spark.conf.unset(k)
    root = {w.tobytes(): w.tobytes() for w in words}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in found:
        x, y = find(bytes(r["a"])), find(bytes(r["b"]))
        root[max(x, y)] = min(x, y)
    mine = [find(w.tobytes()) for w in words]
    near = np.argwhere(np.bitwise_count(words[:, None] ^ words[None, :]) <= 4).tolist()
    assert sum(mine[i] != mine[j] for i, j in near) == 0


def test_simhash_nasty(nasty, none):
    got = rows(simhash.near_duplicates(nasty))
    group = defaultdict(set)
    for r in got:
        group[r["doc_id"]].add(r["component_id"])
    assert len(got) == 12 and group[2] == {1} and group[3] == group[4] == group[5] == {3}
    assert rows(simhash.near_duplicates(none)) == []


# ---- 3 repeated passages


def brute_repeats(named, length=50):
    """named: (id, text) pairs; expected (n_bytes, n_removed, n_spans, sha256) for each."""
    least = {}
    for i, t in named:
        raw = (t or "").encode()
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            if i is not None:
                least[s] = min(least.get(s, i), i)
    out = []
    for i, t in named:
        raw = (t or "").encode()
        gone = [False] * len(raw)
        for p in range(len(raw) - length + 1):
            if i is not None and least[raw[p : p + length]] < i:
                gone[p : p + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()))
    return out


def as_tuples(df):
    return sorted(map(tuple, rows(df)), key=str)


def test_repeats_query_against_brute_force(spark, sf, texts):
    assert as_tuples(substrings.op3_suffix_dedup(spark, sf)) == sorted(brute_repeats(list(texts.items())), key=str)


@pytest.mark.parametrize("hot", [4000, 2])
def test_repeats_of_random_pieces(spark, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    rng = random.Random(hot)
    pieces = ["".join(rng.choices("ab \n", k=rng.randint(20, 130))) for _ in range(12)] + ["é" * 40, "z" * 200]
    named = [(rng.randint(0, 40), "".join(rng.choice(pieces)[rng.randint(0, 20) :] for _ in range(rng.randint(0, 5)))) for _ in range(60)]
    named = list(dict(named).items())
    df = spark.createDataFrame(named, "doc_id long, text string").repartition(5)
    assert as_tuples(substrings.repeated_spans(df)) == sorted(brute_repeats(named), key=str)


def test_repeats_nasty(nasty, none):
    named = [(r["doc_id"], r["text"]) for r in rows(nasty)]
    assert as_tuples(substrings.repeated_spans(nasty)) == sorted(brute_repeats(named), key=str)
    assert rows(substrings.repeated_spans(none)) == []
    kept = substrings.remove_repeats(nasty)
    assert kept.columns == nasty.columns and kept.count() == 12


def test_merged_transforms():
    rng = random.Random(4)
    for _ in range(60):
        depth, held, shards = rng.choice([1, 3, 6]), [], []
        for _ in range(rng.randint(1, 4)):
            strings = [bytes(rng.choices(b"ab\x00\xff", k=rng.randint(0, 25))) for _ in range(rng.randint(1, 5))]
            held.append(strings)
            shards.append(bwt.Shard(np.frombuffer(b"".join(strings), np.uint8), np.cumsum([0, *map(len, strings)]).astype(np.int64)))
        z, string, at, block = bwt.merge(shards, depth)
        prefix = [held[a][b][c : c + depth] for a, b, c in zip(z, string, at)]
        whole = [k for k, p in enumerate(prefix) if len(p) == depth]
        assert [prefix[k] for k in whole] == sorted(prefix[k] for k in whole)
        assert len({(prefix[k], block[k]) for k in whole}) == len({prefix[k] for k in whole}) == len({block[k] for k in whole})


# ---- 4 secrets


def brute_secrets(text):
    found = []
    for k, rule in enumerate(secrets.RULES):
        for m in re.finditer(rule.regex, text or "", re.ASCII):
            if len(m[rule.group]) >= rule.least:
                found.append((m.start(), k, rule.kind, m.end()))
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found))


def test_secrets_query_against_brute_force(spark, sf, texts):
    base = {r.kind for r in secrets.BASE_RULES}
    for r in rows(secrets.op4_secret_scan(spark, sf)):
        want = brute_secrets(texts[r["doc_id"]])
        mine = [s for s in want.split(",") if s.split(":")[0] in base]
        assert r["spans"] == want and r["base_sha256"] == hashlib.sha256(",".join(mine).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s.startswith(k + ":") for s in mine) for k in ("assign", "access", "hex")]


def test_trigram_queries_hold():
    assert secrets.trigram_query("[0-9a-f]+") is True
    assert secrets.trigram_query("AKIA[A-Z0-9]+") == ("and", (b"aki", b"kia"))
    assert secrets.trigram_query("abc|xyz") == ("or", (b"abc", b"xyz"))
    assert secrets.trigram_query("a+bcd?") is True
    rng, scanner = random.Random(1), secrets.Scanner()
    parts = ["password", "PassWD", "token", "api_key", "APIKEY", " ", "=", ":", '"', "AKIA", "ABCDEFGHIJKLMNOP", "deadbeefdeadbeef", "é漢", "ghp_" + "a" * 36, "\n", "_.="]
    for _ in range(150):
        texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(6)]
        data, offsets = utf8(pa.array(texts))
        got = [",".join(f"{scanner.rules[k].kind}:{a}:{b}" for a, b, k in s) for s in scanner.block(data, offsets)]
        assert got == [brute_secrets(t) for t in texts]


def test_secrets_nasty(nasty, none):
    got = rows(secrets.scan_secrets(nasty))
    assert len(got) == 12 and sum(bool(r["spans"]) for r in got) == 2
    clean = secrets.redact_secrets(nasty)
    assert clean.columns == nasty.columns
    assert all(r["n_chars"] == len(r["text"] or "") for r in rows(clean))
    assert not any("deadbeef" in (r["text"] or "") for r in rows(clean))
    assert rows(secrets.scan_secrets(none)) == []


# ---- 5 media


def test_media_query_round_trip(spark, sf, texts):
    for r in rows(media.op5_media_chunks(spark, sf)):
        raw = texts[r["doc_id"]].encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        stored = media.wav(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"], r["feature"]) == (zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), media.features(payload))


def test_chunks_borrowed_between_media(spark):
    rng = random.Random(5)
    block = ["".join(rng.choices("abcdefgh ", k=6000)) for _ in range(3)]
    named = [(i, "".join(rng.sample(block, 2)) + str(i % 7)) for i in range(20)]
    df = spark.createDataFrame(named, "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: r["payload_sha256"] for r in rows(media.store_media(df))}
    assert got == {i: hashlib.sha256(t.encode() + bytes(-len(t) % 64)).hexdigest() for i, t in named}


def test_media_nasty(nasty, none):
    got = rows(media.store_media(nasty))
    assert len(got) == 12 and {r["payload_bytes"] for r in got if r["doc_id"] in (3, 4)} == {64}
    assert rows(media.store_media(none)) == []


# ---- 6 packing and 7 BPE


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path())


def library_ids(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


def test_bpe_query_against_the_library(spark, sf, texts, library):
    for r in rows(bpe.op7_bpe_round_trip(spark, sf)):
        ids = library_ids(library, texts[r["doc_id"]])
        shown = library.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(shown.encode()).hexdigest())


def test_bpe_words_and_trees(library):
    own, rng = bpe.Encoder(bpe.vocabulary_path()), random.Random(6)
    parts = ["ab", "Don't", "'s", "é", "<|endoftext|>", "<|ENDOFTEXT|>", " ", "\n", " ", "漢字", "Σας", "12", ".", "a.", "İ", "&&&", "</w>", "thention", "x" * 700, "\x1c", "한"]
    for _ in range(120):
        text = "".join(rng.choices(parts, k=rng.randint(0, 9)))
        assert own.encode([text.encode()]) == [library_ids(library, text)]
    for _ in range(25):
        text = "".join(rng.choices(rng.choice(["ab", "abcdefghijklmnop", "é漢ab", "-=*"]), k=rng.randint(600, 4000)))
        assert own.stretch(text, rng.choice([16, 64, 512])).tobytes() == library_ids(library, text)


def test_bpe_of_dealt_texts(spark, nasty, library):
    got = sorted((str(r["doc_id"]), bytes(r["ids"])) for r in rows(bpe.encode_texts(nasty, bpe.vocabulary_path(), part_bytes=300)))
    assert got == sorted((str(r["doc_id"]), library_ids(library, r["text"])) for r in rows(nasty))


def test_packing_query(spark, sf, texts, library):
    got, seen = rows(packing.op6_best_fit_packing(spark, sf)), defaultdict(list)
    pieces = defaultdict(dict)
    for r in got:
        seen[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]][r["piece"]] = r
    for places in seen.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    for i, t in texts.items():
        ids = library_ids(library, t) + bytes(4)
        want = [(p, a // 4, len(ids[a : a + 8192]) // 4, zlib.crc32(ids[a : a + 8192])) for p, a in enumerate(range(0, len(ids), 8192))]
        assert [(p, r["start"], r["length"], r["ids_crc32"]) for p, r in sorted(pieces[i].items())] == want
    assert len(seen) <= 1.05 * sum(r["length"] for r in got) / 2048 + 1


def test_packing_plans():
    rng = random.Random(7)
    for capacity in (10, 64, 300):
        for _ in range(60):
            histogram = {rng.randint(1, capacity): rng.randint(0, 50) for _ in range(rng.randint(0, 25))}
            for groups, free in packing.TRIES:
                taken = Counter()
                for pattern, n in packing.plan_patterns(histogram, capacity, groups, keep_free=free):
                    assert sum(pattern) <= capacity and n > 0
                    taken.update({s: n * pattern.count(s) for s in set(pattern)})
                assert taken == Counter({s: n for s, n in histogram.items() if n})


def test_packing_nasty(nasty, none):
    got = rows(packing.pack_documents(nasty, bpe.vocabulary_path(), capacity=64))
    assert sum(r["piece"] == 0 for r in got) == 12 and max(r["offset"] + r["length"] for r in got) <= 64
    assert rows(packing.pack_documents(none, bpe.vocabulary_path())) == []


# ---- 8 PII


def test_surrogates_keep_type_format_and_identity(spark):
    texts = [
        "Mail Bob.Smith99@Corp.example.com or bob.smith99@corp.example.com, x@y.io.", "Call +1 (017) 555-7713 or (017) 555-7713 now 999",
        "cards 4111 1111 1111 1111 4111111111111111, 9807915762804490.", "ip 10.1.2.3 and 97.51.17.173! v1.2.3.4.5", "Mrs. Anna Schmidt met Mr Ivan Petrov; Mrs. Anna Schmidt left", "госпожа Анна Иванова",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in rows(pii.replace_pii(df, "k"))}
    again = {r["doc_id"]: r["text"] for r in rows(pii.replace_pii(df, "other"))}
    assert all(got[i] != texts[i] and got[i] != again[i] for i in got)
    a, b, c = re.findall(r"\S+@[\w.]+\w", got[0])
    assert a == b != c and re.fullmatch(r"[a-z]{3}\.[a-z]{5}\d\d@m[0-9a-f]{16}\.example\.com", a)
    a, b = re.findall(r"\(\d{3}\) \d{3}-\d{4}", got[1])
    assert a == b and got[1].endswith("now 999") and got[1].startswith("Call +1 (")
    a, b, c = re.findall(r"\d{4} \d{4} \d{4} \d{4}|\d{16}", got[2])
    luhn = lambda s: sum(sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(reversed(s))) % 10
    assert a.replace(" ", "") == b != c and luhn(b) == 0 and b[0] == "4" and c[0] == "9"
    assert re.match(r"ip 10\.\d+\.\d+\.\d+ and ", got[3]) and got[3].endswith("v1.2.3.4.5")
    a, b = re.findall(r"Mrs\. (\w+ \w+)", got[4])
    fits = lambda name, kind: name in pii.FIRST_NAMES[kind].split() or name.endswith(pii.ENDINGS[kind])
    assert a == b and fits(a.split()[0], "Lf") and fits(got[4].split(" met Mr ")[1].split()[0], "Lm")
    assert fits(got[5].split()[1], "Cf")


def test_names_corefer(spark):
    texts = ["Mrs. Anna Schmidt, Dr. Anna Schmidt and Mrs. Schmidt; Anna Schmidt or Schmidt, not Schmidtchen", "Prof. Anna Weber", "host 172.16.0.9"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in rows(pii.replace_pii(df, "k"))}
    first, last = re.match(r"Mrs\. (\w+) (\w+),", got[0]).groups()
    assert got[0] == f"Mrs. {first} {last}, Dr. {first} {last} and Mrs. {last}; {first} {last} or {last}, not Schmidtchen" and {first, last}.isdisjoint({"Anna", "Schmidt"})
    assert got[1].split()[1] == first and got[1].split()[2] not in (last, "Weber")
    assert re.fullmatch(r"host 172\.(1[6-9]|2\d|3[01])\.\d+\.\d+", got[2]) and got[2] != texts[2]


def test_full_spaces_grow(spark):
    found = [("ip", f"192.168.{k // 250}.{k % 250 + 1}") for k in range(50_000)]
    df = spark.createDataFrame(found, "kind string, entity string")
    got = pii.surrogates(df, "k").toPandas()
    assert len(got) == 50_000 == got["surrogate"].nunique() and not set(got["surrogate"]) & {e for _, e in found}


def test_hint_passes_every_kind(spark):
    examples = {
        "email": ["a@b.example.com"], "ip": ["10.1.2.3"], "card": ["4111 1111 1111 1111", "4111111111111111"], "identity": ["078-05-1120"],
        "phone": ["+45 12 34 56 78", "+47 22 12 34 56", "+49-30-12-34-56", "+1 415 555 2671", "+33 1 23 45 67 89", "+33 (0)1 23 45 67 89", "(415) 555-2671", "415.555.2671", "+1 (415) 555-2671"],
        "account": ["DE12 ABCD EFGH", "GB82WEST12345698765432"], "name": ["Mrs. Ada Byron", "Dr Who", "г-жа Иванова"],
    }
    assert examples.keys() == pii.PATTERNS.keys()
    cases = [(k, x) for k, found in examples.items() for x in found]
    df = spark.createDataFrame([(n, f"see {x}, please") for n, (_, x) in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in rows(pii.replace_pii(df, "k"))}
    for n, (kind, x) in enumerate(cases):
        assert {k: got[n][f"n_{k}"] for k in pii.KINDS} == {k: int(k == kind) for k in pii.KINDS}, x
        assert x not in got[n]["text"] and got[n]["text"].endswith(", please"), x


def test_surrogates_stay_distinct(spark):
    # 26 one-letter addresses of one domain use up one-letter surrogates; the rest are drawn longer.
    found = [("email", f"{chr(97 + k)}@d.example.com") for k in range(26)] + [("email", f"{k}@d.example.com") for k in range(10)]
    got = rows(pii.surrogates(spark.createDataFrame(found, "kind string, entity string"), "k"))
    assert len(got) == 36 == len({r["surrogate"] for r in got}) and not {r["surrogate"] for r in got} & {e for _, e in found}


def test_pii_query(spark, sf, texts):
    got = {r["doc_id"]: r for r in rows(pii.op8_pii_surrogates(spark, sf))}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        assert (got[i]["text"] == t) == (got[i]["n_entities"] == 0)
        for e in re.findall(r"[\w.]+@[\w.]+\w|\+1 \(\d{3}\) \d{3}-\d{4}|\b\d{16}\b", t):
            assert e not in got[i]["text"]


def test_pii_nasty(nasty, none):
    out = pii.replace_pii(nasty, "k")
    assert out.columns[: len(nasty.columns)] == nasty.columns and out.count() == 12
    assert [r["text"] for r in rows(out) if r["doc_id"] == 3] == [None]
    assert rows(pii.replace_pii(none, "k")) == []


# ---- 9 quality rules


def test_rule_counts_against_brute_force(spark, sf, texts):
    for r in rows(quality_rules.op9_quality_rules(spark, sf)):
        t = texts[r["doc_id"]]
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        inside = {k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
        failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside))
        assert r["base_failed"] == failed and (not r["kept"] or not failed)


def test_decision_list_finds_a_planted_rule():
    rng = np.random.default_rng(8)
    x = {"a": rng.random(3000), "b": rng.random(3000)}
    bad = (x["a"] > 0.8) & (x["b"] <= 0.5)
    rules = quality_rules.learn(x, bad)
    hit = np.logical_or.reduce([r.covers(x) for r in rules.rules])
    assert (hit == bad).mean() > 0.97
    assert quality_rules.learn({"a": np.zeros(0)}, np.zeros(0, bool)).rules == []


def test_rule_counts_nasty(nasty, none):
    got = {r["doc_id"]: r for r in rows(quality_rules.text_counts(nasty))}
    assert got[3]["n_words"] == got[4]["n_words"] == got[5]["n_words"] == 0 and got[6]["n_words"] == 1 and got[7]["n_words"] == 700
    assert rows(quality_rules.text_counts(none)) == []
    assert quality_rules.fit_decision_list(none, none.selectExpr("doc_id", "1 as quality")).rules == []


# ---- 10 quality classifier


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in rows(quality_classifier.op10_quality_classifier(spark, sf))}
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    held = [(got[i]["score"], q) for i, q in labels if got[i]["held_out"]]
    assert all(r["held_out"] == quality_classifier.is_held_out(i) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for i, r in got.items())
    good, bad = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.85


def test_classifier_nasty(nasty, none):
    model = quality_classifier.fit_quality(nasty, nasty.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality"))
    out = quality_classifier.score_quality(nasty, model)
    assert out.columns == [*nasty.columns, "score"] and all(0 <= r["score"] <= 1 for r in rows(out))
    assert rows(quality_classifier.score_quality(none, model)) == []
    empty = quality_classifier.fit_quality(none, none.selectExpr("doc_id", "1 as quality"))
    assert empty.bias == 0


def test_all_thirteen_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.queries()) == list(range(1, 14))


def test_a_very_long_text_does_not_end_the_sample(spark):
    # Whichever comes first by hash: all long texts are passed over, and the rest is learned from.
    good, bad = "a plain sentence of ordinary words that follow each other " * 4, "xx ## zz buy buy buy %% $$ qq " * 6
    data = [(i, (good if i % 2 else bad) + str(i), i % 2) for i in range(60)] + [(100 + i, "word " * 4000, i % 2) for i in range(40)]
    df = spark.createDataFrame(data, "doc_id long, text string, quality int")
    model = quality_classifier.fit_quality(df, df.select("doc_id", "quality"), max_bytes=16 * 4096)
    got = {r["doc_id"]: r["score"] for r in rows(quality_classifier.score_quality(df, model))}
    assert np.mean([got[i] for i in range(1, 60, 2)]) > 0.7 > 0.3 > np.mean([got[i] for i in range(0, 60, 2)])
