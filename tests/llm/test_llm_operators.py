"""The ten operators against brute force, on small tables with nulls, ties, empty and repeated rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from maskwright.llm import decontaminate, exact_dedup, language, licenses, line_dedup, main_text, near_dedup, pieces, quality, token_files
from maskwright.llm.queries import BYTE_BPE, PIECE_BPE, tokenizer_file

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n_words string, component string"


def words(text):
    return ALNUM.findall((text or "").translate(LOWER))


def corpus(seed=1, n=120):
    rnd = random.Random(seed)
    syllables = ["an", "the", "Er", "of", "tion", "é", "ñ", "x9", "ß", "internationalisation", "日本"]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 3)))
    line = lambda k: " ".join(word() + rnd.choice(["", "", ",", ".", "--"]) for _ in range(k))
    passage = line(60)
    texts = [None, "", "   ", "\n\n", "\t", "a", "A ", "a\n", "!!!", "αβγ", "two words", passage]
    while len(texts) < n:
        k = rnd.random()
        if k < 0.2 and len(texts) > 15:
            texts.append(rnd.choice(texts))
        elif k < 0.4 and len(texts) > 15 and (old := rnd.choice(texts)):
            w = old.split(" ")
            w[rnd.randrange(len(w))] = word()
            texts.append(" ".join(w))
        elif k < 0.5:
            texts.append(line(5) + "\n" + passage + "\n" + line(7))
        elif k < 0.55:
            texts.append("x" * 5000 + " " + line(3000))
        else:
            texts.append("\n".join(line(rnd.randint(1, 20)) for _ in range(rnd.randint(1, 8))))
    return [(i, t, rnd.choice(["aa", "bb", None]), rnd.choice(["s0", "s0", "s1", None]), 1, 0.5, "?", "c") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# -- 1 --------------------------------------------------------------------


def brute_contamination(rows, items, size=10, slop=2):
    windows = []
    for item, text in items:
        w = words(text)
        if w:
            windows += [(str(item), w[s : s + size]) for s in range(max(len(w) - size, 0) + 1)]
    out = []
    for doc_id, text, *_ in rows:
        w, hit, found, near, near_found = words(text), set(), set(), set(), set()
        for item, win in windows:
            for s in range(len(w) - len(win) + 1):
                if w[s : s + len(win)] == win:
                    hit.update(range(s, s + len(win)))
                    found.add(item)
                elif len(win) == size and w[s] == win[0]:
                    rest = iter(w[s : s + size + slop])
                    if all(x in rest for x in win):  # in order, each at its next place
                        near.add(s)
                        near_found.add(item)
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), digest, bool(hit), len(near), ",".join(sorted(near_found))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_words", [2_000_000, 40])
def test_contamination(spark, docs, rows, block_words, monkeypatch):
    short = [r for r in rows if not r[1] or len(r[1]) < 3000]
    some = words(short[40][1])
    items = [(1, " ".join(some[:14])), (2, "two WORDS"), (3, None), (4, "!!"), (10, "a"), (11, rows[11][1]), (12, " ".join(some[3:9])), (2, "two words"), (20, " ".join(some[:14])), (None, "two")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    items[-1] = ("null", "two")
    monkeypatch.setattr(decontaminate.phrase_matches, "__defaults__", (10, block_words, 2))
    got = decontaminate.contamination(docs.filter("length(text) < 3000 or text is null"), bench).collect()
    assert sorted(map(tuple, got), key=repr) == brute_contamination(short, items)
    assert decontaminate.contamination(docs.limit(5), bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("block_words", [2_000_000, 3])
def test_contamination_of_repeated_ids_and_near_phrases(spark, block_words, monkeypatch):
    rnd = random.Random(1)
    item = [f"w{i}" for i in range(14)] + ["w3", "w4", "w5"]
    rows = [(1, "one two three four"), (1, "five six"), (2, "zz"), (2, "zz"), (None, "one two"), (None, "w0 w1 zz"), (3, None)]
    for i in range(60):
        w = list(item)
        for _ in range(rnd.randint(1, 4)):
            w.insert(rnd.randrange(len(w)), rnd.choice(["x", "w3", "w4"]))
        rows.append((100 + i, " ".join(w) + "\n" + " ".join(item[rnd.randrange(9) :])))
    rows.append((200, ("long " * 30_000 + " ".join(item)) + " one two"))
    items = [(1, " ".join(item)), (2, "one two"), (3, "five six"), (4, "one two")]
    monkeypatch.setattr(decontaminate.phrase_matches, "__defaults__", (10, block_words, 2))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, decontaminate.contamination(docs, bench).collect()), key=repr) == brute_contamination(rows, items)
    left = sorted(decontaminate.decontaminate(docs, bench).collect(), key=repr)
    clean = [r for r in rows if not brute_contamination([r], items)[0][5]]
    assert [tuple(r) for r in left] == sorted(clean, key=repr) and (None, "w0 w1 zz") in clean and len(clean) > 4


def test_decontaminate_drops_hits(spark, docs):
    bench = spark.createDataFrame([(1, "two words")], "item_id long, text string")
    left = decontaminate.decontaminate(docs, bench)
    assert left.columns == docs.columns and left.count() == docs.count() - docs.filter("lower(text) like '%two words%'").count()


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red big old fox"), (2, "fox red"), (3, "red x y z fox"), (4, None)], "doc_id long, text string")
    got = decontaminate.proximity_matches(docs, ["red fox"], slop=2).collect()
    assert [tuple(r) for r in got] == [(1, "red fox", 0, 3)]


def test_few_terms_are_pushed_to_the_scan(spark, docs, capsys):
    index = decontaminate.build_index(docs.select("doc_id", "text"), segment_bytes=2000)
    few = [(("two", "words"), "p"), (("a",), "q"), (("no-such-term", "a"), "r")]
    places = decontaminate.search(index, few, [0, 0, 0])
    places.explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(term,[B" in plan.split("PushedFilters", 1)[1] and "ReadSchema: struct<segment:bigint,term:binary,positions:array<int>>" in plan
    # the same places if the terms are asked for along with more than are pushed
    more = few + [((f"absent{i}", "a"), "s") for i in range(decontaminate.PUSHED_TERMS)]
    rows = sorted(map(tuple, places.collect()))
    assert rows and rows == sorted(map(tuple, decontaminate.search(index, more, [0] * len(more)).collect()))


def test_phrases_are_ordered_by_their_rarest_term():
    plan = decontaminate._plan([("a", "b", "c"), ("c",), ("b", "d"), ("a", "a")], [2, 0, 0, 0])
    own = decontaminate._ordered(plan, np.array([9, 5, 1, 0]))  # of a, b, c, d
    assert own["phrase"].tolist() == [3, 0, 1] and own["terms"].tolist() == [[0, 0, -1], [2, 1, 0], [2, -1, -1]]
    assert own["offsets"][:2].tolist() == [[0, 1, 2], [2, 1, 0]] and own["slops"].tolist() == [0, 2, 0]
    assert not len(decontaminate._ordered(plan, np.zeros(4, np.int64))["phrase"])


def test_index_serves_any_test_set(spark, docs):
    index = decontaminate.build_index(docs.select("doc_id", "text"), segment_bytes=2000)
    total = index.filter("term is not null").selectExpr("sum(n) n", "sum(size(positions)) m").first()
    assert total.n == total.m == decontaminate.documents(index).selectExpr("sum(n_words) n").first().n
    assert index.select("segment").distinct().count() > 10


# -- 2 --------------------------------------------------------------------


def test_token_files(spark, docs, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_file(BYTE_BPE))
    expected, start = [], 0
    for doc_id, text, *_ in sorted(rows, key=lambda r: r[0]):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        expected.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    manifest = token_files.write_shards(docs, tokenizer_file(BYTE_BPE), 2)
    got = token_files.read_shards(manifest, token_files.crc32).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == expected
    asked = spark.createDataFrame([(5,), (77,), (10**9,), (None,)], "doc_id long")
    found = {r.doc_id: r.ids for r in token_files.look_up(manifest, asked).collect()}
    assert set(found) == {5, 77} and found[77] == library.encode(rows[77][1] or "", add_special_tokens=False).ids + [2]


def test_token_files_without_rows_and_with_null_keys(spark, none):
    assert token_files.tokenised(none, tokenizer_file(BYTE_BPE), 2).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (3, "a"), (3, "b  c")], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.n_tokens) for r in token_files.tokenised(odd, tokenizer_file(BYTE_BPE), 2).collect()) == [(False, 2), (False, 4), (True, 3)]


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(3).choice(10**12, 5000, replace=False).astype(np.uint64)
    sizes, words, ranks = token_files.build_hash(keys)
    assert sorted(token_files.slot_of(keys, sizes, lambda b: words.reshape(-1, 8)[b], lambda b: ranks[b])) == list(range(5000))


def test_look_up_reads_as_much_whatever_the_size(tmp_path, monkeypatch):
    read = []
    for n in (1_000, 1_000_000):
        path = f"{tmp_path}/{n}.bin"
        keys = np.sort(np.random.default_rng(n).choice(10**12, n, replace=False))
        with open(path, "wb") as f:
            f.write(token_files.shard_head(keys, np.ones(n, np.int64), "<u2") + np.arange(n).astype("<u2").tobytes())
        shard, total, calls = token_files.Shard(path), [0], keys[:: n // 500]
        own = shard.read
        monkeypatch.setattr(shard, "read", lambda part, first, k: (total.__setitem__(0, total[0] + k), own(part, first, k))[1])
        for place, key in zip(range(0, n, n // 500), calls.tolist()):
            assert shard.look_up(key).tolist() == [place % 65536]
        assert shard.look_up(-5) is None and shard.look_up(token_files.NULL_KEY) is None
        read.append(total[0] / len(calls))
    assert read[1] < 1.5 * read[0] < 100


def test_token_files_with_many_shards_and_hot_keys(spark, docs, rows):
    odd = spark.createDataFrame([(None, f"n {i}") for i in range(30)] + [(7, f"seven {i}") for i in range(30)] + [(8, "x\ny, z.")], "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    manifest = token_files.write_shards(odd, tokenizer_file(BYTE_BPE), 2, shard_docs=5)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert manifest.count() > 10
    got = token_files.read_shards(manifest, token_files.crc32).collect()
    assert sorted(r.doc_id or -1 for r in got) == [-1] * 30 + [7] * 30 + [8]
    upto = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == upto
        upto += r.n_tokens
    first = min(r.start for r in got if r.doc_id == 7)
    found = {r.doc_id: r.ids for r in token_files.look_up(manifest, spark.createDataFrame([(7,), (8,), (9,)], "doc_id long")).collect()}
    assert set(found) == {7, 8} and next(r for r in got if r.start == first).value == token_files.crc32(np.array(found[7]))


def test_encoder_equals_the_library():
    import pyarrow as pa

    rnd = random.Random(3)
    letters = "abet  \n\n'sd,.1é×÷ßжЖ日\u00a0\u3000\t—“”A!"
    some = ["it's", "<|endoftext|>", "a,", "b.", "é,", "×,", "don't", "1,2", "x\ny", "—,", "日,", "'s", "...", ",", "\n", "\r"]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(4000)] + [" ".join(rnd.choice(some) for _ in range(rnd.randint(0, 12))) for _ in range(4000)]
    for limit in (1_000_000, 200):
        own = token_files.PieceEncoder(tokenizer_file(BYTE_BPE), limit)
        for first in range(0, len(texts), 500):
            for a, n, ids in own.encode(pa.array(texts[first : first + 500]), 2):
                expected = own.tokenizer.encode_batch_fast(texts[first + a : first + a + len(n)], add_special_tokens=False)
                assert ids.tolist() == [i for x in expected for i in x.ids + [2]] and n.tolist() == [len(x.ids) + 1 for x in expected]


# -- 3 --------------------------------------------------------------------


@pytest.mark.parametrize("bucket_bytes", [32 << 20, 2000])
def test_exact_dedup(docs, rows, bucket_bytes):
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc_id))
    expected = {}
    for flat, members in groups.items():
        keep = min(members)[1]
        for _, doc_id in members:
            expected[doc_id] = (keep, len(members), doc_id == keep, hashlib.sha256(flat.encode()).hexdigest())
    assert {r.doc_id: tuple(r)[1:] for r in exact_dedup.deduplicate(docs, bucket_bytes).collect()} == expected


def test_exact_dedup_spills_until_buckets_fit(spark, monkeypatch):
    passes = []
    monkeypatch.setattr(exact_dedup, "FILL", 1)
    monkeypatch.setattr(exact_dedup, "merged", lambda r, b, own=exact_dedup.merged: (passes.append(1), own(r, b))[1])
    rows = [(i, f"text number {i % 90}") for i in range(300)] + [(1000 + i, "z" * 50_000 + str(i % 2)) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in exact_dedup.deduplicate(docs.filter("doc_id < 1000"), 1000).collect()}
    assert len(passes) > 1
    got |= {r.doc_id: r for r in exact_dedup.deduplicate(docs.filter("doc_id >= 1000"), 10**9).collect()}
    assert len(got) == 306
    assert all(got[i].keep_id == i % 90 and got[i].group_size == len(range(i % 90, 300, 90)) and got[i].kept == (i < 90) for i in range(300))
    assert [(got[i].keep_id, got[i].group_size) for i in range(1000, 1006)] == [(1000, 3), (1001, 3)] * 3


def test_exact_dedup_of_repeated_ids_and_rows(spark, none):
    rows = [(1, "a b c"), (1, "abc"), (2, "abc"), (3, "x"), (3, "x"), (3, "x"), (None, "ab\nc"), (None, None), (9, ""), (None, "q"), (None, "q")]
    got = exact_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == len(rows)
    kept = sorted((r.text_sha256[:4], r.doc_id, r.group_size) for r in got if r.kept)
    sha = lambda x: hashlib.sha256(x).hexdigest()[:4]
    assert kept == sorted([(sha(b"abc"), 1, 4), (sha(b"x"), 3, 3), (sha(b""), 9, 2), (sha(b"q"), None, 2)])
    assert exact_dedup.deduplicate(none).count() == 0
    long = [(1, "w " * 400_000), (2, "w" * 400_000), (3, None)]
    assert {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.deduplicate(spark.createDataFrame(long, "doc_id long, text string")).collect()} == {1: (1, 2), 2: (1, 2), 3: (3, 1)}


# -- 4 --------------------------------------------------------------------


def test_license_scan(spark):
    filler = " ".join(f"w{i}" for i in range(100))
    texts = ["Released under the MIT License.", "cc by cc-BY\nx", "All  rights, reserved. all rights", filler + " Licensed under the Apache License, Version 2.0. " + filler, None, "", "GNU General Public License"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert (got[0].labels, got[0].score, got[0].n_base) == ("mit", 1.0, 0)
    assert (got[1].base_labels, got[1].n_base, got[1].first_word, got[1].last_word) == ("cc-by", 2, 0, 2)
    assert (got[2].base_labels, got[2].n_words) == ("reserved", 5)
    assert got[3].labels == "apache-2.0" and got[3].n_base == 0
    assert (got[4].n_words, got[4].labels, got[4].score, got[4].first_word) == (0, "", 0.0, None)
    assert got[6].base_labels == "gpl"


def test_license_blocks_find_all_that_meet_the_threshold(spark):
    rnd = random.Random(5)
    vocabulary = "license under the mit apache version of x y z".split()
    templates = [("a", "under the mit license"), ("b", "apache license version of the x"), ("c", "z y x of"), ("a", "version license x y under z mit the of apache the")]
    texts = ["\n".join(" ".join(rnd.choice(vocabulary + ["q"] * rnd.choice([0, 9])) for _ in range(rnd.randint(0, 9))) for _ in range(4)) for _ in range(200)]
    rows = [*enumerate(texts), (7, "under the mit license"), (None, "z y x of"), (500, "q " * 30_000 + "z y\nx " + "q " * 100), (501, None), (502, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = []
    for d, text in rows:
        w, labels, best = words(text), set(), 0.0
        for label, t in templates:
            width, own = int(len(t.split()) / 0.7 + 1e-9), set(t.split())
            for s in range(max(len(w) - width, 0) + 1):
                held = len(own & set(w[s : s + width])) / len(own)
                if held >= 0.7 - 1e-9:
                    labels.add(label)
                    best = max(best, held)
        expected.append((d, len(w), ",".join(sorted(labels)), best))
    got = [(r.doc_id, r.n_words, r.labels, r.score) for r in licenses.scan(docs, templates, 0.7).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr) and sum(bool(r[2]) for r in got) > 50
    assert licenses.scan(docs.limit(0)).count() == 0


def test_whole_licenses_are_found(spark):
    for label, body in licenses.TEMPLATES:
        assert all(w.isalnum() and w == w.lower() for w in body.split())
    wrapped = lambda body: "/*\n * " + "\n * ".join(" ".join(body.split()[i : i + 9]) for i in range(0, len(body.split()), 9)) + "\n */\nint main() { return 0; }"
    docs = spark.createDataFrame([(i, "x " * i + wrapped(body)) for i, (_, body) in enumerate(licenses.TEMPLATES)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert all(label in got[i].labels.split(",") and got[i].score == 1.0 for i, (label, _) in enumerate(licenses.TEMPLATES))
    survey = licenses.surveyed(docs)
    met = licenses.license_blocks(docs, survey).join(survey.select("key", "doc_id"), "key")
    starts = {r.doc_id: r.start for r in met.filter("template = doc_id and containment = 1").collect()}
    assert set(starts) == set(got)


def test_many_templates_cost_little_more_than_few(spark):
    import time

    rnd = random.Random(8)
    made = [("own", " ".join(rnd.choice(["the", "license", "of", "under", "and"]) if rnd.random() < 0.5 else f"rare{rnd.randrange(20_000)}" for _ in range(20))) for _ in range(1500)]
    docs = spark.createDataFrame([(i, " ".join(rnd.choice(["the", "license", "of", "under", "and", "w"]) for _ in range(300)) + (" " + made[i][1] if i % 50 == 0 else "")) for i in range(600)], "doc_id long, text string")

    def cost(templates):
        began = time.perf_counter()
        found = {r.doc_id for r in licenses.scan(docs, templates).filter("labels like '%own%'").collect()}
        return time.perf_counter() - began, found

    cost(licenses.TEMPLATES)
    few, many = (min((cost(t) for _ in range(2)), key=lambda x: x[0]) for t in (licenses.TEMPLATES, [*licenses.TEMPLATES, *made]))
    assert many[1] == set(range(0, 600, 50)) and few[1] == set() and many[0] < 4 * few[0] + 10


def test_license_notices_wrapped_over_lines(spark):
    mit = " * Permission is hereby granted, free of charge, to any\n * person obtaining a copy of this software\n * and associated documentation files (the X)"
    apache = "# you may not use this\n# file except in compliance with the License.\n# You may obtain a copy\n# of the License at\n"
    far = "mit " + "w " * 6 + "\n" + "w " * 6 + "released under the license"
    texts = [mit, "a b\n" * 50 + apache + "c d\n" * 50, "x\nreleased under\nthe MIT\nlicense", far, "released\n\n" + "w " * 9, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(docs).collect()}
    assert {d: x[0] for d, x in got.items()} == {0: "mit", 1: "apache-2.0", 2: "mit", 3: "mit", 4: "", 5: ""}
    assert got[0][1] == got[1][1] == got[2][1] == 1.0 and got[3][1] == 0.8  # its last line alone


# -- 5 --------------------------------------------------------------------


def test_sentencepiece_equals_the_library(docs, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(PIECE_BPE))
    expected = {}
    for doc_id, text, *_ in rows:
        ids = sp.encode(text or "") + [sp.eos_id()]
        expected[doc_id] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())
    assert {r.doc_id: tuple(r)[1:] for r in pieces.round_trip(docs, tokenizer_file(PIECE_BPE)).collect()} == expected


def test_sentencepiece_on_odd_strings():
    own, rnd = pieces.encoder(tokenizer_file(PIECE_BPE)), random.Random(2)
    for _ in range(4000):
        text = "".join(rnd.choice("abet hoin  ▁éß日\n<s>,.1'　\0😀") for _ in range(rnd.randint(0, 30)))
        assert own.encode(text) == own.library.encode(text) + [own.end], text


# -- 6 --------------------------------------------------------------------


def test_language_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.9 * len(got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in language.identify(docs).collect())


def test_language_of_texts_without_letters(docs, rows, none):
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    for doc_id, text, *_ in rows:
        assert (got[doc_id].lang_pred == "und") == (not any(c.isalpha() for c in text or ""))
        assert 0 <= got[doc_id].score <= 1
    assert language.identify(none).count() == 0
    assert {r.lang_pred for r in language.identify(docs.withColumn("lang", docs["lang"].substr(9, 9)).filter("lang is null")).collect()} == {"und"}


def test_grams_do_not_cross_documents():
    b1, r1, _ = language.gram_buckets(["abc", "xyz"], 1 << 16, 3)
    alone = [set(language.gram_buckets([t], 1 << 16, 3)[0].tolist()) for t in ("abc", "xyz")]
    assert [set(b1[r1 == i].tolist()) for i in (0, 1)] == alone


def plain_buckets(text, buckets=1 << 16, max_n=3, full=(1 << 64) - 1):
    """The hashed n-grams of a text by single steps."""
    low = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in f" {text} ")
    low, out = re.sub(" +", " ", low), []
    for n in range(1, max_n + 1):
        for i in range(len(low) - n + 1):
            if n == 1 and low[i] == " ":
                continue
            value = 0
            for c in low[i : i + n]:
                value = value * 0x110003 + ord(c) & full
            x = value + (n << 56) & full
            x = (x ^ x >> 32) * 0x9E3779B97F4A7C15 & full
            x = (x ^ x >> 29) * 0xC2B2AE3D27D4EB4F & full
            out.append((x ^ x >> 32) & buckets - 1)
    return out


def test_language_equals_plain_naive_bayes(spark):
    import math

    rnd = random.Random(6)
    sounds = {"aa": ["ba", "ko", "mi "], "bb": ["xu", "ér", "zz "], "cc": ["ба", "ми ", "ko "]}
    rows = [(i, "".join(rnd.choice(sounds[g]) for _ in range(rnd.randint(1, 60))) + " 12!", g) for i, g in enumerate(rnd.choice("abc") * 2 for _ in range(150))]
    rows += [(500, None, "aa"), (501, "", "bb"), (502, "77 !!", None), (503, "ba mi", None), (503, "xu zz", None), (None, "ба ми", "cc"), (504, "ko" * 20_000, None), (505, "ko", None)]
    counts = {}
    for doc_id, text, lang in rows:
        if lang and (doc_id is None or zlib.crc32(str(doc_id).encode()) % 3 != 1):  # a null id is never held out
            own = counts.setdefault(lang, [0.5] * (1 << 16))
            for b in plain_buckets(text or ""):
                own[b] += 1
    totals = {g: sum(c) for g, c in counts.items()}
    expected = []
    for doc_id, text, _ in rows:
        if not any(c.isalpha() for c in text or ""):
            expected.append((doc_id, "und", 0.0))
            continue
        grams = plain_buckets(text)
        log = {g: min(1, 200 / len(grams)) * sum(math.log(c[b] / totals[g]) for b in grams) for g, c in counts.items()}
        best = max(sorted(log), key=log.get)
        expected.append((doc_id, best, 1 / sum(math.exp(x - log[best]) for x in log.values())))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = sorted(((r.doc_id, r.lang_pred, r.score) for r in language.identify(docs).collect()), key=lambda r: (str(r[0]), r[1], r[2]))
    expected.sort(key=lambda r: (str(r[0]), r[1], r[2]))
    assert [r[:2] for r in got] == [r[:2] for r in expected]
    assert max(abs(a[2] - b[2]) for a, b in zip(got, expected)) < 1e-3


# -- 7 --------------------------------------------------------------------


def brute_components(rows, size, percent):
    sets = {}
    for doc_id, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets[doc_id] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    name = {d: d for d in sets}
    find = lambda x: x if name[x] == x else find(name[x])
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                name[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(docs, rows, size):
    got = {r.doc_id: tuple(r)[1:] for r in near_dedup.near_duplicates(docs, size).collect()}
    assert got == brute_components(rows, size, 80)


def test_near_duplicates_of_odd_tables(spark, docs, none):
    assert near_dedup.near_duplicates(none).count() == 0
    odd = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c"), (None, "q r"), (5, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in near_dedup.near_duplicates(odd).collect())
    assert got == [(-1, -1, True), (-1, 4, False), (4, 4, True), (4, 4, True), (5, 5, True)]
    assert near_dedup.keep_one(docs).columns == docs.columns


def test_one_row_of_each_group_stays(spark):
    base = [f"w{i}" for i in range(60)]
    near = " ".join(base[:59] + ["x"])
    rows = [(4, " ".join(base)), (4, " ".join(base)), (4, "quite another text of one id"), (4, near), (None, near), (None, "q r s t u v"), (None, "q r s t u v"), (None, "q r s t u V"), (5, None), (5, ""), (3, "Quite another text OF one id"), (6, "long " * 50_000), (7, "long " * 40_000)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, mark string, component string").repartition(4)
    left = sorted(((r.doc_id or -1, (r.text or "")[:12]) for r in near_dedup.keep_one(docs).collect()))
    assert left[:2] == [(-1, left[0][1]), (3, "Quite anothe")] and left[0][1].lower() == "q r s t u v"[:12] and left[2][0] == 4
    assert left[3:] == [(5, ""), (5, ""), (6, "long long lo")]
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(rows) and sorted(r.component_id for r in got if r.doc_id is None and r.n_shingles > 10) == [4]
    assert all(r.component_id == 3 for r in got if 0 < r.n_shingles == 5 and r.doc_id in (3, 4))


def test_near_duplicates_that_no_leader_is_alike_to(spark):
    """Groups of variants below the threshold whose smallest and largest doc_ids lead most
    buckets; in the middle two variants that are alike to each other only."""
    rnd, texts = random.Random(7), {}
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(100)]
        for v in range(142):
            doc_id, w = 1000 * g + v, list(base)
            for i in rnd.sample(range(1, 99, 3), 1 if v in (70, 71) else 3):
                w[i] = f"v{doc_id}x{i}"
            texts[doc_id] = " ".join(w)
    rows = sorted(texts.items())
    expected = brute_components(rows, 2, 90)
    assert sum(not kept for _, _, kept in expected.values()) == 3
    for parts in (1, 5):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        assert {r.doc_id: tuple(r)[1:] for r in near_dedup.near_duplicates(docs, 2, 90).collect()} == expected


def test_near_duplicates_among_variants_of_one_text(spark):
    """Pairs (one word apart) of 800 variants (four words replaced) of one text: no link is lost, whoever leads."""
    rnd, texts = random.Random(4), []
    base = [f"w{i}" for i in range(120)]
    for v in range(800):
        w = list(base)
        for i in rnd.sample(range(120), 4):
            w[i] = f"v{v}x{i}"
        other = list(w)
        other[rnd.randrange(120)] = f"o{v}"
        texts += [" ".join(w), " ".join(other)]
    rnd.shuffle(texts)
    sets = [{(a, b) for a, b in zip(w, w[1:])} for w in map(str.split, texts)]
    number = {}
    for s in sets:
        for x in s:
            number.setdefault(x, len(number))
    held = np.zeros((len(texts), len(number)), np.float32)
    for i, s in enumerate(sets):
        held[i, [number[x] for x in s]] = 1
    shared, sizes = held @ held.T, held.sum(axis=1)
    linked = 100 * shared >= 80 * (sizes[:, None] + sizes[None] - shared)
    name = np.arange(len(texts))
    while True:
        least = np.where(linked, name[None], len(texts)).min(axis=1)
        if (least == name).all():
            break
        name = least
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()}
    assert [got[i] for i in range(len(texts))] == name.tolist()


# -- 8 --------------------------------------------------------------------


def test_repeated_passages_go(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    line = lambda k: " ".join(word() for _ in range(k))
    one, many = line(55), "\n".join(line(9) for _ in range(7))
    texts = {1: line(9) + "\n" + one + "\n" + line(4), 2: one, 3: line(30) + "\n" + one + "\n" + line(30), 4: many, 5: line(3) + "\n" + many + "\n\n" + line(3), 6: line(200), 7: line(20) + "\n" + line(20), 8: None, 9: ""}
    short = line(20)
    texts[10], texts[11] = short + "\n" + line(40), short + "\n" + line(41)
    texts[12] = one + "\n" + line(5) + "\n" + one
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in line_dedup.deduplicate_lines(docs).collect()}
    assert {d: list(r.removed) for d, r in got.items() if r.removed} == {2: [0], 3: [1], 5: [1, 2, 3, 4, 5, 6, 7], 12: [0, 2]}
    assert got[3].text == "\n".join(texts[3].split("\n")[::2]) and got[2].text == "" and got[8].text is None and got[1].text == texts[1]
    assert {r.doc_id for r in line_dedup.remove_repeats(docs, drop_empty=True).collect()} == set(texts) - {2}


def test_removed_lines_stand_earlier_and_no_long_run_is_left(spark, docs, rows):
    got = {r.doc_id: r for r in line_dedup.deduplicate_lines(docs.withColumn("removed", docs["score"])).collect()}
    earlier, windows = set(), set()
    marks = {r.doc_id: r.m for r in docs.selectExpr("doc_id", "xxhash64(text) m").collect()}
    for doc_id, text, *_ in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0], marks[r[0]])):
        lines = [x.strip() for x in text.split("\n")]
        for i, x in enumerate(lines):
            assert i not in got[doc_id].removed or x in earlier
            earlier.add(x)
        gone = set(got[doc_id].removed)
        for i in range(len(lines)):
            n = 0
            for j in range(i, len(lines)):
                n += len(lines[j].split())
                if n >= 50:
                    key = "\n".join(lines[i : j + 1]).strip()
                    assert key not in windows or gone.issuperset(k for k in range(i, j + 1) if lines[k]), (doc_id, i, j)
                    windows.add(key)
                    break


def test_repeats_whose_parts_stand_earlier_alone(spark):
    """Documents that share less than min_words with all others stand before the copies."""
    rnd = random.Random(9)
    line = lambda k: " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(k))
    texts, expected = {}, {}
    for g in range(8):
        part = [line(13) for _ in range(4)] + ["", line(3)]
        own = [line(5) for _ in range(4)]
        for k, rows in enumerate((part[:3], part[1:4], [own[0], *part, own[1]], [own[2], "", *part, own[3]])):
            texts[10 * g + k] = "\n".join(rows)
        expected[10 * g + 3] = [2, 3, 4, 5, 6, 7]
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: list(r.removed) for r in line_dedup.deduplicate_lines(docs).collect() if r.removed}
    assert got == expected


def test_copies_of_what_stands_in_another_document(spark):
    """A = P, B = P + Q, C = P + Q: nothing of C stays, whatever the lines' hashes choose."""
    rnd, texts, expected = random.Random(11), {}, {}
    line = lambda: " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(5))
    for g in range(100):
        p, q = [line() for _ in range(11)], [line() for _ in range(5)]
        texts |= {10 * g: "\n".join(p), 10 * g + 1: "\n".join(p + q), 10 * g + 2: "\n".join(p + q)}
        expected |= {10 * g + 1: list(range(11)), 10 * g + 2: list(range(16))}
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string").repartition(3)
    assert {r.doc_id: list(r.removed) for r in line_dedup.deduplicate_lines(docs).collect() if r.removed} == expected


def test_blank_lines_cost_linear_time(spark):
    import time

    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    began = time.perf_counter()
    hashes, words = [0] * 400_000, [0] * 400_000
    for i in range(0, 400_000, 20_000):
        hashes[i], words[i] = i, 20
    assert line_dedup.fingerprints(hashes, words, 25, 50) and time.perf_counter() - began < 20
    run = "\n".join(word() + " " + word() for _ in range(40))
    texts = [run + "\n" * 100_000 + run, "\n" * 100_000 + "x" + "\n" * 50_000 + run + "\ny"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.deduplicate_lines(docs).collect()}
    assert list(got[0].removed) == list(range(100_039, 100_079))
    assert got[1].text.replace("\n", "") == "xy" and time.perf_counter() - began < 90


# -- 9 --------------------------------------------------------------------


def test_quality_finds_toxic_documents(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score(docs, labels).join(labels, "doc_id").collect()
    assert sum((r.p_toxic >= 0.5) == (r.toxic == 1) for r in got) >= 0.95 * len(got)
    assert sum((r.p_quality >= 0.5) == (r.quality == 1) for r in got) >= 0.9 * len(got)


def test_quality_of_odd_tables(spark, docs, none):
    labels = spark.createDataFrame([(1, None, 1), (2, 1, None), (10**6, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.score(docs, labels).count() == docs.count()
    assert quality.score(none, labels.limit(0)).count() == 0


def test_sparse_sites_shrink_to_their_parent(spark):
    rows = [(i, "a", "l", "good" if i % 2 else "bad") for i in range(400)] + [(1000, "a", "l", "rare")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(i % 2 or i % 5 == 0), 0) for i, *_ in rows], "doc_id long, quality int, toxic int")
    path, rates = quality.sites(docs, labels)
    p = {r.host: r.s_quality for r in path.collect()}
    assert p["good"] > 0.95 and p["bad"] < 0.3 and abs(p["rare"] - rates["quality"]) < 0.35


def test_quality_of_held_out_labels(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    seen = labels.filter("crc32(cast(doc_id as string)) % 3 <> 1")
    got = quality.score(docs, seen).join(labels.subtract(seen), "doc_id").collect()
    assert len(got) > 50
    assert sum((r.p_toxic >= 0.5) == (r.toxic == 1) for r in got) >= 0.9 * len(got)
    assert sum((r.p_quality >= 0.5) == (r.quality == 1) for r in got) >= 0.95 * len(got)


def test_site_posteriors_equal_plain_sums(spark):
    rnd = random.Random(13)
    rows, marks = [], []
    for i in range(900):
        host, path = rnd.choice(["h0"] * 4 + ["h1", "h2", None]), rnd.choice(["p", "q", None])
        rows.append((i, "t", path, host))
        if rnd.random() < 0.7:
            marks.append((i, int(rnd.random() < (0.8 if host == "h0" else 0.3 if path == "p" else 0.5)), None))
    marks += [(5, 1, 0), (10**6, 1, 1), (None, 1, 1)]
    place = {i: (h or "", p or "") for i, _, p, h in rows}
    named = [(place[i], y) for i, y, _ in marks if i in place and y is not None]
    rate = sum(y for _, y in named) / len(named)

    def counted(depth):
        out = {}
        for at, y in named:
            n, g = out.get(at[:depth], (0, 0))
            out[at[:depth]] = n + 1, g + y
        return out

    def strength(groups):
        n, n2 = sum(n for n, _ in groups.values()), sum(n * n for n, _ in groups.values())
        spread = sum(n * (g / n - rate) ** 2 for n, g in groups.values())
        between = (spread - (len(groups) - 1) * rate * (1 - rate)) / (n - n2 / n)
        return max(1.0, rate * (1 - rate) / between - 1)

    hosts, paths = counted(1), counted(2)
    kh, kp = strength(hosts), strength(paths)
    host = {h: (g + kh * rate) / (n + kh) for h, (n, g) in hosts.items()}
    expected = {at: (g + kp * host[at[:1]]) / (n + kp) for at, (n, g) in paths.items()}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {(r.host, r.path): r.s_quality for r in quality.sites(docs, labels)[0].collect()}
    assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-9 for k in got)
    twice = docs.unionByName(docs.filter("doc_id < 3")).unionByName(spark.createDataFrame([(None, "x", None, None)], docs.schema))
    assert quality.score(twice, labels).count() == 904


# -- 10 -------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href=/a>one</a></li><li><a href=/b>two</a></li></ul></nav><div class="ad">Buy &amp; save.</div>
<article><h1>Head &amp; line</h1><p><b>First  para&eacute;\n goes<br>on for some length of text that counts.<br><p>Short.</p>
<div class="share-bar">Share</div><form><p>mail</p></form><ul><li>item one<li>item two</ul><section class="comments"><p>A reader says so.</p></section></article>
<aside>Side text that is rather long and could be taken for an article by its length alone.</aside><footer>&copy; x</footer></body>"""


def test_main_text():
    assert main_text.extract(PAGE) == "Head & line\nFirst paraé goes on for some length of text that counts.\nShort.\nitem one\nitem two"
    assert main_text.extract("") == "" and main_text.extract("<p>") == "" and main_text.extract("plain &lt;text&gt;") == "plain <text>"


@pytest.mark.parametrize("block", [1, 2, 3])
def test_languages_in_blocks_are_those_in_one(spark, docs, monkeypatch, block):
    many = docs.withColumn("lang", docs["doc_id"].cast("string").substr(1, 1))
    whole = sorted((r.doc_id, r.lang_pred, round(r.score, 9)) for r in language.identify(many).collect())
    monkeypatch.setattr(language, "BLOCK", block)
    assert sorted((r.doc_id, r.lang_pred, round(r.score, 9)) for r in language.identify(many).collect()) == whole
    assert len({x[1] for x in whole}) > 4


def test_main_text_without_article():
    body = "".join(f"<p>{'word ' * 40}{i}</p>" for i in range(5))
    page = f"<body><div id=top><a href=x>a</a> <a href=y>b</a></div><div><div class=post>{body}<p>End.</p></div></div><div class=sidebar>{body}</div></body>"
    assert main_text.extract(page).split("\n")[-1] == "End." and len(main_text.extract(page).split("\n")) == 6


def test_main_text_inside_layout_elements_named_like_menus():
    body = "".join(f"<p>{'word ' * 30}{i}</p>" for i in range(3))
    menu = "<ul class=menu><li><a href=x>a</a></ul>"
    for page in (f"<body><div class='page with-sidebar'>{menu}<article>{body}</article></div>", f"<body><div class='page with-sidebar'>{menu}{body}</div>"):
        assert main_text.extract(page).count("word") == 90 and main_text.extract(page).split("\n")[0].startswith("word")
    comments = f"<section id=comments>{body}</section><article class='comment'>{body}</article>"
    assert main_text.extract(f"<body><main><article>{body}{comments}</article></main>").count("word") == 90
    assert main_text.extract(f"<body><div class=newsletter><p>Join us now</p></div><article>{body}<div class='ad'>Buy</div></article>").count("\n") == 2


def test_main_text_keeps_all_content_regions():
    long = lambda w, n=4: "".join(f"<p>{(w + ' ') * 40}{i}</p>" for i in range(n))
    lead = f"<body><div id=top><a href=x>a</a></div><div><p>{'lead ' * 40}</p><div>{long('inner', 9)}</div><section>{long('more', 1)}</section></div>"
    got = main_text.extract(lead)
    assert [got.count(w) for w in ("lead", "inner", "more")] == [40, 360, 40] and got.startswith("lead")
    two = f"<body><div><article>{long('first')}</article><article>{long('second', 1)}<p>End.</p></article></div><div><a href=x>y</a></div>"
    assert [main_text.extract(two).count(w) for w in ("first", "second", "End.")] == [160, 40, 1]
    comment = two.replace("</div>", f"<article class=comment>{long('reader')}</article></div>", 1)
    assert main_text.extract(comment) == main_text.extract(two)
    teaser = two.replace("</div>", f"</div><div class=related><article>{long('teaser', 1)}</article></div>", 1)
    assert main_text.extract(teaser) == main_text.extract(two)
    for head in ("<html><head><title>T</title><meta charset=utf-8><body>", "<head><title>T</title><script>var a;</script>"):
        assert main_text.extract(f"{head}<article>{long('x')}</article>").count("x") == 160
        assert main_text.extract(f"{head}{long('x')}").count("x") == 160


def test_names_alone_drop_no_part_of_an_article():
    part = lambda tag, name, text: f"<{tag} {name}><h2 id={name.split('=')[1]}>Heading of it</h2><p>{text}</p><p>And more.</p></{tag}>"
    names = ["id=related-work", "id=related", "id=search", "class=header", "class=notice", "class=post-header", "id=menu", "class=sidebar", "class=banner", "id=login"]
    inside = "".join(part("section" if i % 2 else "div", n, f"Text {i} of the section.") for i, n in enumerate(names))
    links = "<div class=related><h3>Related</h3><ul><li><a href=a>One more article to read</a><li><a href=b>Another article to read</a></ul></div>"
    page = f"<body><div class=header>Site</div><article><h1 id=header class=banner>Title</h1>{inside}{links}<div class=share-buttons>Share it</div><div class='article-comments'><p>A reader.</p></div></article><div class=notice>We use cookies.</div></body>"
    got = main_text.extract(page).split("\n")
    assert got == ["Title", *(x for i in range(len(names)) for x in ("Heading of it", f"Text {i} of the section.", "And more."))]


def test_ratio_clusters_choose_the_regions():
    long = lambda w, n=4: "".join(f"<p>{(w + ' ') * 40}{i}</p>" for i in range(n))
    teasers = "".join(f"<article><a href=x>teaser {i} of a story</a></article>" for i in range(6))
    assert main_text.extract(f"<body><div>{teasers}</div><div><p>Short.</p>{long('body')}</div></body>").split("\n")[0] == "Short."
    menu = "<div><ul>" + "".join(f"<li><a href=x>topic number {i}</a>" for i in range(9)) + "</ul></div>"
    got = main_text.extract(f"<body><form id=aspnetForm>{menu}<div>{long('one', 2)}<div>{menu}</div><p>x</p><div>Sub <b>part</b>.</div>{long('two', 2)}</div>{menu}</form></body>")
    assert "topic" not in got and got.split("\n")[2:4] == ["x", "Sub part."] and got.count("one") == got.count("two") == 80
    assert main_text.extract(f"<body><table><tr><td>{menu}<td>{long('cell')}</table>").count("cell") == 160


def test_main_text_costs_linear_time():
    import time

    long, end = "<p>" + "word " * 50, "</p><p>End.</p>"
    n = 100_000
    for html in ("<b>" * n + long + end, "<b><p>" * n + long + end, "<div>" * n + long + end, "<div>x" * n + long + end, "<div class=ad>" * n + "x", "<td>" * n + long, "<li><b>" * n + long, "</b>" * n + long + "</div>" * n):
        began = time.perf_counter()
        main_text.extract(html)
        assert time.perf_counter() - began < 20, html[:20]
    assert main_text.extract("<article>" + "<p>one</p>" * n + "</article>").count("\n") == n - 1


@pytest.mark.parametrize(
    "piece", ["a<b c", "<b c ", '<b c="', "<b c='x ", "<!--", "<!--x>", "<!-- -", "<!x ", "<![cdata[x>", "<![if x", "<![foo[x>", "<?x ", "</x ", "</ x>", "&#", "&ampx", "<", "<script></x ", '<a b="\'><c d=\'">']
)
def test_main_text_costs_linear_time_on_what_is_not_closed(piece):
    import time

    article, many = "<article><p>" + "word " * 50 + "</p></article>", piece * (1_000_000 // len(piece))
    for html in (many, many + '"', many + ">", article + many, "<p>" + many):
        began = time.perf_counter()
        got = main_text.extract(html)
        assert time.perf_counter() - began < 5, html[:20]
        assert html[:9] != "<article>" or got.startswith("word word")


def test_main_text_keeps_what_follows_the_last_tag():
    assert main_text.extract("<article><p>One</p>two &amp; a < b") == "One\ntwo & a < b"
    assert main_text.extract("<article><p>One <![CDATA[x > y]]>two<![foo[z]>three<!-- c --></p>") == "One twothree"
    assert main_text.extract("no markup at all") == "no markup at all" and main_text.extract("<script>a > b; c") == ""


def test_reader_threads_go_by_their_structure():
    body = "".join(f"<p>{'word ' * 30}{i}</p>" for i in range(3))
    one = lambda i: f"<p>user{i}</p><p>I read this with interest, thank you. {i}</p>"
    div, items = "".join(f"<div class=r>{one(i)}</div>" for i in range(4)), "<ol>" + "".join(f"<li>{one(i)}</li>" for i in range(4)) + "</ol>"
    for name in ("class=reader-responses", "class=discussion", "id=userFeedback"):
        for thread in (div, items, "<h3>What readers say</h3>" + div):
            assert main_text.extract(f"<body><article>{body}<section {name}>{thread}</section></article></body>").count("\n") == 2
    paper = f"<section class=discussion><h2>Discussion</h2>{body}<div>{body}</div></section>"
    assert main_text.extract(f"<body><article>{body}{paper}</article></body>").count("\n") == 9


def test_main_text_of_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    for r in main_text.main_text(pages).join(pages.select("page_id", "html"), "page_id").collect():
        inside = r.html.split("<article>")[1].split("</article>")[0]
        import html as h

        blocks = [" ".join(h.unescape(re.sub(r"<[^>]+>", "", re.sub(r"<br>", " ", x))).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)
    odd = spark.createDataFrame([(1, None, None), (1, "u", "")], "page_id long, url string, html string")
    assert [r.text for r in main_text.main_text(odd).collect()] == ["", ""]


# -- 8 by brute force -------------------------------------------------------


def brute_repeats(rows, min_words):
    """The lines of all runs of ``min_words`` words or more that stand earlier."""
    first, gone = {}, {}
    for turn in (0, 1):
        for doc_id, text in sorted(rows):
            lines = [x.strip() for x in text.split("\n")]
            for i in range(len(lines)):
                n = 0
                for j in range(i, len(lines)):
                    n += len(lines[j].split())
                    if n >= min_words:
                        run, place = tuple(lines[i : j + 1]), (doc_id, i)
                        if not turn:
                            first[run] = min(first.get(run, place), place)
                        elif first[run] < place:
                            gone.setdefault(doc_id, set()).update(range(i, j + 1))
    return {d: sorted(x) for d, x in gone.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_lines_by_brute_force(spark, seed):
    rnd = random.Random(seed)
    line = lambda: rnd.choice(["", "", " ", *(" ".join(f"w{rnd.randrange(40)}" for _ in range(rnd.randint(1, 9))) for _ in range(4))])
    shared = [line() for _ in range(60)]
    rows = []
    for d in range(120):
        lines = []
        while len(lines) < rnd.randint(3, 30):
            at = rnd.randrange(60)
            lines += shared[at : at + rnd.randint(1, 20)] if rnd.random() < 0.5 else [line() for _ in range(rnd.randint(1, 4))]
        rows.append((d, "\n".join(lines)))
    rows.append((500, "one two three four\n\n" * 40))  # repeats of itself that overlap
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute_repeats(rows, 20)
    got = {r.doc_id: r.removed for r in line_dedup.repeated_lines(docs, 20).collect()}
    assert len(want) > 60 and got == want
