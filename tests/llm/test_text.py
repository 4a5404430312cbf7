"""Tokenising, packing, quality rules, chats, web pages, licenses and the pipeline."""

import hashlib
import itertools
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from foliospark.llm import chat, packing, quality, warc
from foliospark.llm.bpe import bpe_digests, decode_ids, encode_ids, encoder
from foliospark.llm.chat import chat_digests, format_chats, read_turns
from foliospark.llm.html_extract import Composer, extract_main, fitted, labelled, main_texts
from foliospark.llm.html_tree import Tree
from foliospark.llm.licenses import FILE_SHARE, as_files, scan_licenses
from foliospark.llm.packing import hilbert_index, pack
from foliospark.llm.quality import QualityModel, fit_quality, quality_rules, with_good_quality
from foliospark.llm.queries import ORACLE_SQL, QUERIES, TOKENIZER

DOC = "doc_id long, text string"
CLASH = "doc_id long, text string, ids int, mix int, part int, curve int, n int, score int, path int"
SF = "/root/testdata/sf0.001"
ODD = ["", " ", "a", "<|endoftext|> x<|endoftext|>", "don't I'LL we've", " x　 日本語 😀 ’s", "  \n\n  a \t", "aaaa" * 700, "\x00\x1f", "é́", "123 45", "—…!?"]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(TOKENIZER)


def library_ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


# -- tokenising ----------------------------------------------------------------------------


def test_bpe_is_the_library(spark, library):
    docs = [*enumerate([*ODD, None]), (None, "x"), (3, ODD[3])]
    want = []
    for doc, text in docs:
        ids = library_ids(library, text)
        want.append((doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    frame = spark.createDataFrame(docs, DOC)
    assert rows(bpe_digests(frame, TOKENIZER)) == sorted(want, key=repr)
    back = decode_ids(encode_ids(frame, TOKENIZER), TOKENIZER)
    assert sorted(r.text for r in back.collect()) == sorted(t or "" for _, t in docs)
    assert rows(bpe_digests(spark.createDataFrame([], DOC), TOKENIZER)) == []


def test_compatible_pairs_are_what_merging_gives():
    words = encoder(TOKENIZER).vocabulary
    rng = random.Random(1)
    usual = [words.id_of[t] for t in words.id_of if len(t) < 5]
    pairs = [(rng.choice(usual), rng.choice(usual)) for _ in range(4000)] + [(t, t) for t in usual[:3000]]
    for a, b in pairs:
        assert words.compatible(a, b) == (words.merged(words.bytes_of[a] + words.bytes_of[b]) == [a, b])


def test_backtracking_is_merging():
    words = encoder(TOKENIZER).vocabulary
    rng = random.Random(2)
    for _ in range(3000):
        data = bytes(rng.choice(b"aabehinorst \xc3\xa9") for _ in range(rng.randint(1, 24)))
        assert words.encode_bytes(data) == words.merged(data)


# -- packing -------------------------------------------------------------------------------


def check_packing(pieces, ids_of, length):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == set(ids_of)
    for doc, parts in by_doc.items():
        at = 0
        for p in sorted(parts, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids_of[doc])
            assert p.ids_crc32 == zlib.crc32(np.array(ids_of[doc][at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids_of[doc])
    for s, parts in by_sequence.items():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == length or s == max(by_sequence)
    assert sorted(by_sequence) == list(range(len(by_sequence)))


@pytest.mark.parametrize("length,tokens", [(1024, 16_000_000), (16, 40)])
def test_packing_holds_every_id_once(spark, library, monkeypatch, length, tokens):
    monkeypatch.setattr(packing, "RANGE_TOKENS", tokens)
    docs = [*enumerate([*ODD, None, *["the same text"] * 40, *(" ".join(random.Random(k).choices("ab cd ef gh the of".split(), k=k)) for k in range(60))])]
    ids_of = {d: [*library_ids(library, t), 0] for d, t in docs}
    check_packing(pack(spark.createDataFrame(docs, DOC), TOKENIZER, length).collect(), ids_of, length)


def test_packing_odd_tables(spark):
    assert rows(pack(spark.createDataFrame([], DOC), TOKENIZER)) == []
    odd = spark.createDataFrame([(None, "x", 1, 1, 1, 1, 1, 1, 1), (4, "x", 1, 1, 1, 1, 1, 1, 1), (4, "x", 1, 1, 1, 1, 1, 1, 1)], CLASH)
    got = pack(odd, TOKENIZER, with_ids=True).collect()
    assert sorted((r.doc_id or 0, r.length, len(r.ids)) for r in got) == [(0, 2, 2), (4, 2, 2), (4, 2, 2)]


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_steps_to_neighbours(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    at = hilbert_index(cells, bits).astype(np.int64)
    assert sorted(at) == list(range(len(cells)))
    path = cells[np.argsort(at)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


# -- quality -------------------------------------------------------------------------------


def quality_brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    count = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if count[w] > 1 for j in range(5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def ngram_brute(texts):
    out = np.zeros(1 << quality.BUCKET_BITS)
    for t in texts:
        data = t.encode()
        for k in range(len(data) - 2):
            code = int.from_bytes(data[k : k + 3], "little")
            out[(code * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - quality.BUCKET_BITS] += 1
    return out


def test_quality_is_brute_force(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice("a bb ccc dddd e\n f\tg h*# $i".split(" ")) for _ in range(rng.choice([0, 4, 9, 10, 30, 200]))) for _ in range(60)]
    texts += [None, "", "x", "é", "one two three four five six seven eight nine ten\n" * 2, "\n\n a\n a\n"]
    docs = list(enumerate(texts))
    ratios = np.random.default_rng(1).standard_normal(1 << quality.BUCKET_BITS)
    got = {r.doc_id: tuple(r)[1:] for r in quality_rules(spark.createDataFrame(docs, DOC), QualityModel(ratios, 0.05)).collect()}
    for doc, text in docs:
        want = quality_brute(text)
        assert got[doc][:6] == want
        counts = ngram_brute([text or ""])
        score = counts @ ratios / max(counts.sum(), 1)
        assert abs(got[doc][7] - score) < 1e-9 and got[doc][6] == (not want[5] and score >= 0.05)
    counted = quality.ngram_counts(spark.createDataFrame([(t or "",) for t in texts], "text string").repartition(3))
    assert (counted == ngram_brute([t or "" for t in texts])).all()


def test_quality_verdicts_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    known = labels.where("doc_id % 2 = 0")
    model = fit_quality(docs, known)
    held = labels.where("doc_id % 2 = 1").join(quality_rules(docs, model), "doc_id").where("NOT base_failed").collect()
    good, bad = [r for r in held if r.quality == 1], [r for r in held if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.99 * len(good) and sum(r.kept for r in bad) <= 0.2 * len(bad)
    kept = {r.doc_id for r in with_good_quality(docs, model).collect()}
    assert kept == {r.doc_id for r in quality_rules(docs, model).where("kept").collect()}


def test_quality_odd_tables(spark):
    empty, labels = spark.createDataFrame([], DOC), spark.createDataFrame([], "doc_id long, quality int")
    assert rows(quality_rules(empty, fit_quality(empty, labels))) == []
    odd = spark.createDataFrame([(None, "a b c d e f g h i j", 1, 1, 1, 1, 1, 1, 1), (1, None, 1, 1, 1, 1, 1, 1, 1)], CLASH)
    model = fit_quality(odd, spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int"))
    assert rows(quality_rules(odd, model).select("doc_id", "base_failed", "kept")) == sorted([(None, False, True), (1, True, False)], key=repr)
    assert with_good_quality(odd, model).columns == odd.columns


# -- chats ---------------------------------------------------------------------------------

CHAT = "conv_id long, turn long, role string, text string"


def chats_brute(turns):
    by = defaultdict(list)
    for conv, turn, role, text in turns:
        by[conv].append((turn is None, turn or 0, role or "", text or ""))
    out = []
    for conv, held in by.items():
        held.sort()
        targets = "".join(t for _, _, r, t in held if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in held)
        out.append((conv, len(held), hashlib.sha256(said.encode()).hexdigest(), len(targets), hashlib.sha256(targets.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("budget,history", [(1024, 256), (30, 12), (1, 0)])
def test_chats_come_back_from_their_windows(spark, budget, history):
    rng = random.Random(8)
    bits = ["</s>", "[INST]", "[/INST]", "<s> ", "[\\INST]", "\\", "[ROLE x] ", " [/ROLE]", "[SYS] ", " ", "a b", "\n", "[", "<"]
    turns = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (None, 1, None, None), (5, None, "tool x]", "y"), (5, 1, "assistant", "é"), (5, 1, "assistant", "é")]
    for conv in range(12):
        for turn in range(rng.randint(1, 30)):
            role = "system" if turn == 0 and conv % 2 else rng.choice(["user", "assistant"])
            turns.append((conv + 10, turn, role, "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))))
    windows = format_chats(spark.createDataFrame(turns, CHAT), budget, history)
    assert rows(chat_digests(windows).drop("formatted_chars")) == chats_brute(turns)
    seen = defaultdict(int)
    for w in windows.orderBy("conv_id", "window").collect():
        held = read_turns(w.text)
        fresh = held[w.n_repeated :]
        assert fresh and [w.text[s.start : s.end] for s in w.loss] == [chat.escape(t) for r, t in fresh if r == "assistant"]
        if w.n_tokens > budget:
            assert len(fresh) == 1
        if seen[w.conv_id] and w.conv_id and w.conv_id > 10 and w.conv_id % 2 and held[: w.n_repeated]:
            assert held[0][0] == "system"
        seen[w.conv_id] += 1


def test_no_chats(spark):
    assert rows(chat_digests(format_chats(spark.createDataFrame([], CHAT)))) == []


# -- pages ---------------------------------------------------------------------------------

PAGE = "page_id long, url string, html string"


@pytest.mark.parametrize("size", [200, 8_000_000])
def test_archives_read_back_by_ranges(spark, tmp_path, size):
    rng = random.Random(9)
    body = ["<p>" + "".join(rng.choice("abcdefgh é") for _ in range(n)) + "</p>" for n in (0, 10, 92, 93, 300, 20_000)]
    pages = [(k, None if k % 7 == 0 else f"http://x.example/é {k}%", rng.choice(body)) for k in range(60)] + [(100, "u", None), (101, "u", "")]
    pages += [(None, "u", body[4]), (3, "v", body[4])]
    folder = f"file://{tmp_path}/warc"
    manifest = warc.write_archives(spark.createDataFrame(pages, PAGE), folder)
    out = warc.read_archives(spark, manifest, folder, size, with_payload=True).collect()
    first = {}
    for k, _, html in pages:
        data = (html or "").encode()
        if k is not None and len(data) >= 100:
            first[data] = min(first.get(data, k), k)
    want = []
    for k, url, html in pages:
        data = (html or "").encode()
        revisit = data in first and first[data] != k
        want.append((k, url, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first[data] if revisit else None))
    assert sorted((tuple(r)[:6] for r in out), key=repr) == sorted(want, key=repr)
    assert all(r.payload is None or hashlib.sha256(r.payload).hexdigest() == r.payload_digest for r in out)


def test_no_archives(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    assert rows(warc.read_archives(spark, warc.write_archives(spark.createDataFrame([], PAGE), folder), folder)) == []


def test_main_text_of_held_out_pages():
    composer, model = Composer(123), fitted()
    kept = lost = extra = 0
    for _ in range(120):
        page = composer.page()
        tree = Tree(page)
        y = labelled(tree)
        want = Counter(t for k, t in enumerate(tree.text) if t and y[k])
        got = Counter(main_texts([page.replace(Composer.KEEP, "")], model)[0].split("\n\n"))
        kept += sum(len(t) * n for t, n in want.items())
        lost += sum(len(t) * n for t, n in (want - got).items())
        extra += sum(len(t) * n for t, n in (got - want).items())
    assert lost < 0.03 * kept and extra < 0.1 * kept


def test_main_text_of_a_page(spark):
    html = """<html><head><title>no</title><script>x="</p>"</script></head><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>
      <div class="ad">Buy now, it is cheap.</div><article><h1>A  title &amp; more</h1><p>First <b>bold
      words</b>, and a longer sentence that says something.<br>next<p>Second para&shy;graph&nbsp;here &lt;p&gt;.</p></article>
      <section id="comments"><h2>Comments</h2><div class="comment"><p>I liked it, thanks for writing this.</p></div></section>
      <footer>&copy; example.com</footer></body></html>"""
    pages = [(1, "u", html), (2, None, None), (None, "u", ""), (4, "u", "<"), (5, "u", "<nav><a href=x>menu</a></nav>"), (6, "u", "<div" * 3000)]
    got = {r.page_id: r.text for r in extract_main(spark.createDataFrame(pages, PAGE)).collect()}
    assert got[1] == "A title & more\n\nFirst bold words, and a longer sentence that says something. next\n\nSecond para\xadgraph here <p>."
    assert got[2] == got[None] == got[5] == ""
    assert rows(extract_main(spark.createDataFrame([], PAGE))) == []


# -- licenses ------------------------------------------------------------------------------


def test_licenses_and_inheritance(spark):
    filler = "\n".join(f"some w{k} other x{k} words y{k}" for k in range(40))
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    files = [
        ("a/LICENSE", mit + "\n" + filler), ("a/b/c/one.txt", filler), ("a/b/two.txt", filler + "\n" + apache), ("a/b/COPYING.md", apache), ("a/b/d/x.txt", None),
        ("e/f.txt", filler), ("e/gpl.txt", "this work is licensed under the gnu general public license version 3"), ("ab/x.txt", filler), ("top.txt", filler), (None, mit), ("a/b/c/one.txt", filler),
    ]
    got = {r.path: (r.own_license, r.license, r.inherited_from, r.license_file) for r in scan_licenses(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got == {
        "a/LICENSE": ("MIT", "MIT", None, True), "a/b/c/one.txt": (None, "Apache-2.0", "a/b", False), "a/b/two.txt": ("Apache-2.0", "Apache-2.0", None, False),
        "a/b/COPYING.md": ("Apache-2.0", "Apache-2.0", None, True), "a/b/d/x.txt": (None, "Apache-2.0", "a/b", False), "e/f.txt": (None, "GPL-3.0", "e", False),
        "e/gpl.txt": ("GPL-3.0", "GPL-3.0", None, True), "ab/x.txt": (None, None, None, False), "top.txt": (None, None, None, False),
    }
    assert rows(scan_licenses(spark.createDataFrame([], "path string, text string"))) == []


# -- queries -------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_are_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.select(*sorted(got.columns))) == sorted(want.select(*sorted(want.columns)).fetchall(), key=repr)


def test_pipeline_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before, docs_of = docs.columns, None, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs_of, SF).persist()
        assert out.columns == columns, name
        before = {r.doc_id for r in docs_of.select("doc_id").collect()}
        assert {r.doc_id for r in out.select("doc_id").collect()} <= before
        docs_of = out
    texts = {r.doc_id: r.text for r in docs_of.collect()}
    library = Tokenizer.from_file(TOKENIZER)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs_of, SF).collect()
    check_packing(pieces, {d: [*library_ids(library, t), 0] for d, t in texts.items()}, 1024)
    assert rows(corpus_pipeline.run(spark, SF).select("doc_id", "doc_tokens").distinct()) == sorted({(p.doc_id, p.doc_tokens) for p in pieces}, key=repr)


def test_page_trees_keep_what_follows_an_empty_drawing_and_close_in_linear_time():
    from foliospark.llm.html_tree import Tree

    assert [t for t in Tree('<p>One <svg class="i"/> two.</p><p>Three.</p>').text if t] == ["One two.", "Three."]
    assert [t for t in Tree('<p>A<svg><path d="x"/></svg>B</p>').text if t] == ["AB"]
    assert [t for t in Tree("<div>a</b1></p>b<section>c</div>d").text if t] == ["a", "b", "c", "d"]
    deep = Tree("<div>" * 20_000 + "x" + "</section>" * 20_000 + "y")
    assert [t for t in deep.text if t] == ["x", "y"]
