"""Nulls in any column, empty and repeated rows, ties, empty tables and clashing column names: each case as the docstrings say."""

import hashlib

import pytest

from maskwright.llm import decontaminate, exact_dedup, language, licenses, line_dedup, main_text, near_dedup, pieces, quality, token_files
from maskwright.llm.queries import BYTE_BPE, PIECE_BPE, tokenizer_file

PASSAGE = " ".join(f"word{i}" for i in range(60))
ROWS = [
    (None, PASSAGE, "aa", "s"), (None, PASSAGE, "aa", "s"), (1, PASSAGE, None, None), (1, PASSAGE, None, None), (1, "other text\n" + PASSAGE, "bb", "s"),
    (2, None, None, None), (3, "", "aa", None), (4, " \n\t\n ", "bb", "t"), (5, "MIT", "aa", "s"), (5, "MIT", "aa", "s"),
]
CLASHING = ["mark", "row", "segment", "bucket", "component", "print", "rep", "lines", "spaced", "removed", "sha", "half", "items", "_id", "_mark", "first", "n"]


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").repartition(3)
    return docs.select("*", *[docs["lang"].alias(c) for c in CLASHING])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, None), (None, 0, 1), (3, None, 0), (3, 0, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")


def jobs(spark, labels):
    bench = spark.createDataFrame([(1, PASSAGE), (2, None), (None, "")], "item_id long, text string")
    return {
        "decontaminate": lambda d: decontaminate.contamination(d, bench),
        "token_files": lambda d: token_files.tokenised(d, tokenizer_file(BYTE_BPE), 2),
        "exact_dedup": exact_dedup.deduplicate,
        "licenses": licenses.scan,
        "pieces": lambda d: pieces.round_trip(d, tokenizer_file(PIECE_BPE)),
        "language": language.identify,
        "near_dedup": near_dedup.near_duplicates,
        "line_dedup": line_dedup.deduplicate_lines,
        "quality": lambda d: quality.score(d, labels),
    }


@pytest.mark.parametrize("name", ["decontaminate", "exact_dedup", "language", "licenses", "line_dedup", "near_dedup", "pieces", "quality", "token_files"])
def test_a_row_for_each_row(spark, odd, labels, name):
    job = jobs(spark, labels)[name]
    got = job(odd).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ROWS)
    assert job(odd.limit(0)).count() == 0


def test_line_dedup_of_repeated_and_unnamed_rows(odd):
    got = line_dedup.deduplicate_lines(odd).collect()
    # rows of one doc_id and text are one document; the other text of that doc_id comes before or after it by its hash
    removed = sorted((str(r.doc_id), list(r.removed)) for r in got if r.removed)
    assert removed in ([("1", [1])], [("1", [0]), ("1", [0])])
    assert all(not r.removed and r.text == PASSAGE for r in got if r.doc_id is None)


def test_pieces_of_null_and_repeated_rows(odd):
    got = pieces.round_trip(odd, tokenizer_file(PIECE_BPE)).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert {(r.n_tokens, r.decoded_sha256) for r in got if r.doc_id in (2, 3)} == {(1, empty)}
    assert len({r.ids_sha256 for r in got if r.doc_id is None}) == 1 and len({r.ids_sha256 for r in got if r.doc_id == 1}) == 2


def test_ties_go_to_the_first_language(spark):
    docs = spark.createDataFrame([(None, "abc", g) for g in ("zz", "aa", "mm")] + [(7, "abc", None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.identify(docs).collect()} == {"aa"}


def test_main_text_of_odd_pages(spark):
    html = "<article><p>Text one.</p></article>"
    pages = spark.createDataFrame([(None, None, html, "x"), (1, "u", html, "x"), (1, "u", html, "x"), (2, None, None, None), (3, "v", "", "t")], "page_id long, url string, html string, text string")
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in main_text.main_text(pages).collect())
    assert got == [("1", "Text one.", 9)] * 2 + [("2", "", 0), ("3", "", 0), ("None", "Text one.", 9)]
    assert main_text.main_text(pages.limit(0)).count() == 0


def test_stages_keep_odd_rows_apart(spark, odd):
    bench = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    clean = decontaminate.decontaminate(odd, bench)
    assert sorted(str(r.doc_id) for r in clean.collect()) == ["2", "3", "4", "5", "5"] and clean.columns == odd.columns
    one = near_dedup.keep_one(odd)
    assert sorted(str(r.doc_id) for r in one.collect()) == ["1", "2", "3", "4", "5"] and one.columns == odd.columns
    assert line_dedup.remove_repeats(odd, into=None).columns == odd.columns


def test_scratch_folders_are_a_thread_s_own(spark):
    import threading

    from maskwright.llm import store

    inside, done = threading.Event(), threading.Event()

    def pipeline():
        with store.scratch(spark):
            inside.set()
            done.wait(60)

    other = threading.Thread(target=pipeline)
    other.start()
    inside.wait(60)
    table = store.written(spark.range(10).toDF("id"))  # lazily read after the other thread's block has gone
    done.set()
    other.join()
    assert table.count() == 10
