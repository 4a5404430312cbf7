"""Exact deduplication, SimHash components and repeated strings against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from foliospark.llm import near_copies, simhash, suffix_dedup
from foliospark.llm.components import connected_components
from foliospark.llm.exact_dedup import exact_dedup, without_copies
from foliospark.llm.near_copies import near_dedup
from foliospark.llm.simhash import near_links, simhash_components
from foliospark.llm.suffix_arrays import common_prefixes, suffix_array
from foliospark.llm.suffix_dedup import remove_repeats, repeat_digests

DOC = "doc_id long, text string"
#: Columns that operators use inside, to clash with.
CLASH = "doc_id long, text string, norm int, h128 int, fp int, row int, doc int, component_id int, kept_text int"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(200)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 5, 40, 200]))) for _ in range(n)]
    shared = " ".join(rng.choice(words) for _ in range(30))
    for k in range(0, n, 5):
        cut = rng.randint(0, len(texts[k]))
        texts[k] = texts[k][:cut] + shared[rng.randint(0, 20) :] + texts[k][cut:]
    for k in range(3, n, 7):
        other = texts[rng.randrange(n)]
        texts[k] = other if rng.random() < 0.5 else other.replace(" ", "\n", 1) + rng.choice(["", " end", "x"])
    return list(enumerate(texts))


# -- exact ---------------------------------------------------------------------------------


def exact_brute(docs):
    groups = defaultdict(list)
    for doc, text in docs:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc))
    out = []
    for doc, text in docs:
        norm = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        keep = min(groups[norm])[1]
        out.append((doc, keep, len(groups[norm]), doc == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact_dedup_is_brute_force(spark):
    docs = corpus(1) + [(100, None), (101, ""), (102, " \t\n\x0b\x0c\r"), (103, "\xa0"), (104, "a b"), (105, "ab"), (106, "a b" * 50_000)]
    assert rows(exact_dedup(spark.createDataFrame(docs, DOC))) == exact_brute(docs)


def test_exact_dedup_odd_tables(spark):
    assert rows(exact_dedup(spark.createDataFrame([], DOC))) == []
    odd = spark.createDataFrame([(None, "x", 1, 1, 1, 1, 1, 1, 1), (7, "x", 1, 1, 1, 1, 1, 1, 1), (7, "x", 1, 1, 1, 1, 1, 1, 1), (None, None, 1, 1, 1, 1, 1, 1, 1)], CLASH)
    got = rows(exact_dedup(odd).select("doc_id", "keep_id", "group_size", "kept"))
    assert got == sorted([(None, 7, 3, False), (7, 7, 3, True), (7, 7, 3, True), (None, None, 1, True)], key=repr)
    assert without_copies(odd).columns == odd.columns


# -- near ----------------------------------------------------------------------------------


def print_brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(ids, prints):
    root = {k: k for k in ids}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(ids):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                x, y = find(a), find(ids[j])
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in ids}


@pytest.mark.parametrize("chunk", [1 << 15, 7])
def test_fingerprint_is_brute_force(monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    for text in [None, "", " \t", "One", "One TWO", "ÄB c", "a b c a b c a b", *(t for _, t in corpus(2, 20))]:
        assert simhash.fingerprint(text) == print_brute(text)


@pytest.mark.parametrize("limit", [128, 1])
def test_links_and_components_of_near_fingerprints(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "CELL_LIMIT", limit)
    rng = random.Random(3)
    prints = set()
    for _ in range(25):
        f = rng.getrandbits(64)
        for _ in range(rng.randint(1, 9)):
            prints.add(f)
            for _ in range(rng.randint(1, 3)):
                f ^= 1 << rng.randrange(64)
    prints = sorted(prints)
    signed = [f - 2**64 if f >= 2**63 else f for f in prints]
    links = near_links(spark.createDataFrame([(s, s) for s in signed], "node long, fp long"))
    for a, b in links.collect():
        assert ((a ^ b) % 2**64).bit_count() <= 2
    got = {s: s for s in signed} | {r.node: r.component for r in connected_components(links).collect()}
    want = closure(signed, prints)
    assert got == want


def test_simhash_components_are_brute_force(spark):
    docs = corpus(4, 40) + [(200, None), (201, ""), (202, "  ")]
    prints = {d: print_brute(t) for d, t in docs}
    want = closure(list(prints), list(prints.values()))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_components(spark.createDataFrame(docs, DOC)).collect()}
    assert got == {d: (f"{prints[d]:016x}", want[d]) for d in prints}


def test_simhash_odd_tables(spark):
    assert rows(simhash_components(spark.createDataFrame([], DOC))) == []
    odd = spark.createDataFrame([(None, "a b c d", 1, 1, 1, 1, 1, 1, 1), (None, None, 1, 1, 1, 1, 1, 1, 1), (5, "a b c d", 1, 1, 1, 1, 1, 1, 1), (5, "a b c d", 1, 1, 1, 1, 1, 1, 1)], CLASH)
    got = rows(simhash_components(odd).select("doc_id", "component_id"))
    assert got == sorted([(None, 5), (None, None), (5, 5), (5, 5)], key=repr)


def test_components_of_long_paths(spark):
    edges = [(k, k + 1) for k in range(100)] + [(500, 500), (None, 3), (700, 600), (700, 600)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {k: 0 for k in range(101)} | {600: 600, 700: 600}


def near_brute(docs):
    sets = []
    for _, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[k : k + 5]) for k in range(max(len(words) - 4, min(len(words), 1)))})
    root = list(range(len(docs)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if root[i] != root[j] and 5 * len(a & b) >= 4 * len(a | b):
                root = [root[j] if r == root[i] else r for r in root]
    best = {}
    for k, (doc, text) in enumerate(docs):
        best[root[k]] = min(best.get(root[k], (1 << 63, "")), ((1 << 63) - 1 if doc is None else doc, text or ""))
    return sorted(((None if d == (1 << 63) - 1 else d, t) for d, t in best.values()), key=repr)


@pytest.mark.parametrize("crowd,least", [(64, 20), (2, 3), (2, 10**6)])
def test_near_copies_are_brute_force(spark, monkeypatch, crowd, least):
    monkeypatch.setattr(near_copies, "CROWD", crowd)
    monkeypatch.setattr(near_copies, "PROBE_LEAST", least)
    rng = random.Random(6)
    docs = corpus(6, 50) + [(200, None), (201, ""), (202, "  "), (203, "ONE two"), (204, "one  two"), (205, "one two x")]
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    for k in range(60):  # copies on both sides of 0.8
        words = list(base)
        for _ in range(k % 6):
            words[rng.randrange(150)] = f"new{rng.randrange(10**6)}"
        docs.append((300 + k, " ".join(words)))
    got = near_dedup(spark.createDataFrame(docs, DOC))
    assert sorted(((r.doc_id, r.text or "") for r in got.collect()), key=repr) == near_brute(docs)
    assert near_dedup(spark.createDataFrame([], DOC)).collect() == []


def test_null_and_repeated_ids_bring_no_copy_back(spark):
    one, two, three = ("".join(f" {p}{k}" for k in range(12)) for p in "xyz")
    docs = [(None, one), (3, one), (None, two), (None, two), (7, three), (7, one), (7, three), (8, "a b"), (8, "ab "), (None, None), (None, "")]
    frame = spark.createDataFrame(docs, DOC)
    want = sorted([(None, two), (3, one), (7, three)], key=repr)
    for keep in (without_copies, near_dedup):
        got = keep(frame)
        assert got.columns == frame.columns
        assert [r for r in rows(got) if len(r[1] or "") > 3] == want
        assert [r[0] for r in rows(got) if not r[1]] == [None]
    assert sum(r.doc_id == 8 for r in without_copies(frame).collect()) == 1


# -- repeated strings ----------------------------------------------------------------------


@pytest.mark.parametrize("shard,frequent", [(2_000_000, 0.005), (400, 2.0)])
def test_repeats_are_brute_force(spark, monkeypatch, shard, frequent):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)
    monkeypatch.setattr(suffix_dedup, "FREQUENT_SHARE", frequent)
    docs = corpus(5, 80) + [(300, ""), (301, "a" * 5000), (302, "b" + "a" * 300), (303, "ab" * 400), (304, "x" + "ab" * 60)]
    assert rows(repeat_digests(spark.createDataFrame(docs, DOC))) == sorted(suffix_dedup.brute_force(docs), key=repr)


def test_repeats_odd_tables(spark):
    assert rows(repeat_digests(spark.createDataFrame([], DOC))) == []
    text = "".join(random.Random(1).choice("abcdef") for _ in range(80))
    odd = [(None, text, 1, 1, 1, 1, 1, 1, 1), (9, text, 1, 1, 1, 1, 1, 1, 1), (9, text, 1, 1, 1, 1, 1, 1, 1), (9, None, 1, 1, 1, 1, 1, 1, 1)]
    out = remove_repeats(spark.createDataFrame(odd, CLASH)).drop("kept_text")
    assert sorted((r.doc_id or 0, r.text or "", r.n_removed) for r in out.collect()) == sorted([(0, text, 80), (9, text, 0), (9, text, 0), (9, "", 0)])


def test_cut_characters_are_left_out(spark):
    shared = "é" * 30  # 60 bytes
    docs = [(1, "x" + shared), (2, "é" + shared + "!")]
    kept = {r.doc_id: r.kept_text for r in remove_repeats(spark.createDataFrame(docs, DOC), as_text=True).collect()}
    assert kept[1] == docs[0][1] and "�" not in kept[2]


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array_and_prefixes(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 60, 12)
    text = rng.integers(97, 97 + rng.integers(1, 4), lengths.sum()).astype(np.uint8)
    starts = np.cumsum(lengths) - lengths
    order = suffix_array(text, 50)
    data = text.tobytes()
    assert [data[k : k + 50] for k in order] == sorted(data[k : k + 50] for k in range(len(data)))
    shared = common_prefixes(text, order, starts, lengths, 50)
    padded = data + bytes(50)
    for n, (a, b) in enumerate(zip(order[:-1], order[1:]), 1):
        want = next((k for k in range(50) if padded[a + k] != padded[b + k]), 50)
        assert (shared[n] >= 50) == (want >= 50) and shared[n] <= want
