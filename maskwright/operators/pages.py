"""Phrases on pages of positioned words."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate
from math import ceil, sqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.patterns import RUN, SPACE, Automaton, fold, strip
from ..functions.text import WS, py_strip
from .mask import rank_replacements
from .meeting import meet, small

PLACE = ["doc_id", "page_no"]
WORD_ORDER = ("block_no", "line_no", "word_no")


def page_texts(words: DataFrame) -> DataFrame:
    """(doc_id, page_no, words, text): each page's words in order, and joined by a space. Null words count as empty."""
    item = F.struct(*WORD_ORDER, F.coalesce("word", F.lit("")).alias("word"), "x0", "y0", "x1", "y1")
    rows = words.groupBy(*PLACE).agg(F.array_sort(F.collect_list(item)).alias("words"))
    return rows.withColumn("text", F.array_join("words.word", " "))


class Phrases:
    """M9 for all of a document's values: as they are (level 1) and with white space made one space (level 2), in any case."""

    def __init__(self, entries: list[dict]):
        self.entries = entries
        own = [fold(strip(e["original_text"])) for e in entries]
        one = [((v, (1, i)),) for i, v in enumerate(own)]
        two = [((RUN.sub(" ", v), (2, i)),) if SPACE.search(v) else () for i, v in enumerate(own)]
        self.automaton = Automaton(x for xs in [*one, *two] for x in xs)

    def hits(self, text: str) -> list[tuple[int, int, int, int]]:
        """(value, level, start, end) of a page: level 2 only of values that level 1 doesn't find there."""
        found, upto = {}, {}
        for start, end, x in self.automaton.hits(fold(text)):
            if start >= upto.get(x, 0):
                upto[x] = end
                found.setdefault(x, []).append((start, end))
        return [(i, level, a, b) for (level, i), spans in found.items() if level == 1 or (1, i) not in found for a, b in spans]


_HIT = T.StructType([T.StructField("rank", T.IntegerType()), T.StructField("mask", T.StringType()), T.StructField("original_text", T.StringType()),
                     *[T.StructField(c, T.IntegerType()) for c in ("level", "start", "end", "first", "last")]])


def exact_hits(pages: DataFrame, ranked: DataFrame) -> DataFrame:
    """(doc_id, page_no, rank, mask, original_text, level, start, end, first, last) of the values of a page's document; the last two number
    the page's words that a hit touches. A page is walked once, whatever the number of values."""
    at = pages.select(*PLACE, "text", F.transform("words.word", F.length).alias("lengths"))

    def use(held: Phrases, text: str, lengths: list[int]) -> list[tuple]:
        out, starts = [], list(accumulate((n + 1 for n in lengths), initial=0))[:-1]
        for i, level, a, b in held.hits(text):
            e, first, last = held.entries[i], bisect_right(starts, a) - 1, bisect_left(starts, b) - 1
            out.append((e["rank"], e["mask"], e["original_text"], level, a, b, first, last))
        return out

    values = ranked.select("doc_id", "rank", "original_text", "mask")
    return meet(at, values, Phrases, use, ["text", "lengths"], _HIT, keep=PLACE, left=False)


def search_phrase_exact(words: DataFrame, ranked: DataFrame) -> DataFrame:
    """M9: (doc_id, page_no, rank, mask, original_text, level, start, end): in any case, the value as
    it is (level 1); on pages without such a hit, with white space made one space (level 2)."""
    return exact_hits(page_texts(words), ranked).drop("first", "last")


def norm(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, r"[^\p{L}\p{N}_]+", ""))


def search_phrase_words(words: DataFrame, ranked: DataFrame) -> DataFrame:
    """(doc_id, page_no, rank, mask, original_text, block_no, line_no, first, n) of values of two
    words or more whose words, without signs and in lower case, follow each other on one line. Lines meet
    values by (doc_id, first word), at the places of that word only."""
    item = F.struct("word_no", norm(F.col("word")).alias("w"))
    lines = words.groupBy(*PLACE, "block_no", "line_no").agg(F.array_sort(F.collect_list(item)).alias("items"))
    lines = lines.select(*PLACE, "block_no", "line_no", F.transform("items", lambda x: x["w"]).alias("line"), F.transform("items", lambda x: x["word_no"]).alias("numbers"))
    at = lines.select(*PLACE, "block_no", "line_no", "line", "numbers", F.posexplode("line").alias("i", "head"))
    target = F.transform(F.split(py_strip(F.col("original_text")), f"{WS}+", -1), norm)
    keys = ranked.withColumn("target", target).filter("size(target) >= 2").withColumn("head", F.col("target")[0])
    met = at.join(keys, ["doc_id", "head"]).filter(F.slice("line", F.col("i") + 1, F.size("target")) == F.col("target"))
    return met.select(*PLACE, "rank", "mask", "original_text", "block_no", "line_no", F.col("numbers")[F.col("i")].alias("first"), F.size("target").alias("n"))


def match_boxes(words: DataFrame, replacements: DataFrame) -> DataFrame:
    """(doc_id, page_no, x0, y0, x1, y1, mask, rank): the boxes round the words of all
    hits; of boxes equal to 0.1 on a page the one of the longer value stays. Values with an exact
    hit on a page aren't searched word by word there."""
    ranked = rank_replacements(replacements)
    pages = page_texts(words)
    exact = exact_hits(pages, ranked).select(*PLACE, "rank", "mask", "start", F.explode(F.sequence("first", "last")).alias("i"))
    boxes = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    numbered = pages.select(*PLACE, F.posexplode("words").alias("i", "w")).select(*PLACE, "i", *[f"w.{c}" for c in ("x0", "y0", "x1", "y1")])
    exact = exact.join(numbered, [*PLACE, "i"]).groupBy(*PLACE, "rank", "mask", "start").agg(*boxes)
    one = exact.select(*PLACE, "rank", "mask", "x0", "y0", "x1", "y1")
    by_word = search_phrase_words(words, ranked).join(exact.select(*PLACE, "rank").distinct(), [*PLACE, "rank"], "left_anti")
    w = words.select(*PLACE, "block_no", "line_no", "word_no", "x0", "y0", "x1", "y1")
    hits = by_word.join(w, [*PLACE, "block_no", "line_no"]).filter((F.col("word_no") >= F.col("first")) & (F.col("word_no") < F.col("first") + F.col("n")))
    two = hits.groupBy(*PLACE, "rank", "mask", "block_no", "line_no", "first").agg(*boxes).drop("block_no", "line_no", "first")
    every = one.unionByName(two)
    sides = ("x0", "y0", "x1", "y1")
    kept = every.groupBy(*PLACE, *[F.round(c, 1).alias(f"r{c}") for c in sides]).agg(F.min(F.struct("rank", *sides, "mask")).alias("b"))
    return kept.select(*PLACE, *[f"b.{c}" for c in sides], "b.mask", "b.rank")


def redact_pages(words: DataFrame, boxes: DataFrame, add_text_overlay: bool = True) -> DataFrame:
    """(doc_id, page_no, masked): the pages' words without those under a box (their middle lies
    in it), the mask in the place of a box's first word if asked for."""
    mid_x, mid_y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    word = F.struct(*WORD_ORDER, "word", mid_x.alias("mx"), mid_y.alias("my"))
    box = F.struct("rank", F.col("x0").alias("a"), F.col("y0").alias("b"), F.col("x1").alias("c"), F.col("y1").alias("d"), "mask" if add_text_overlay else F.lit("").alias("mask"))
    listed = words.groupBy(*PLACE).agg(F.array_sort(F.collect_list(word)).alias("_words"))
    over = boxes.filter("x0 <= x1 and y0 <= y1").groupBy(*PLACE).agg(F.array_sort(F.collect_list(box)).alias("_boxes"))
    to = T.StructType([*[words.schema[c] for c in PLACE], T.StructField("masked", T.StringType())])
    to = T.StructType([T.StructField(f.name, f.dataType, True) for f in to.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(to)
        for batch in small(batches):
            pairs = zip(batch.column("_words").to_pylist(), batch.column("_boxes").to_pylist(), strict=True)
            masked = pa.array([" ".join(left_words(w, b or [])) for w, b in pairs], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).cast(kinds.field(c).type) for c in PLACE], masked.cast(kinds.field("masked").type)], schema=kinds)

    return listed.join(over, PLACE, "left").select(*PLACE, "_words", "_boxes").mapInArrow(run, to)


def left_words(words: list[dict], boxes: list[dict]) -> list[str]:
    """M12 of a page: its words in order, those under a box gone; a box's mask stands at its first word. Of the boxes over a word
    the first counts. The grid has about a cell for four words: boxes go to the cells they touch, words look in that of their middle."""
    held = [w for w in words if w["mx"] is not None and w["my"] is not None and None not in [w[c] for c in WORD_ORDER]] if boxes else []
    over: dict[tuple, int] = {}
    if held:
        k = max(1, min(256, ceil(sqrt(len(words) / 4))))
        ends = {c: (min(w[c] for w in held), max(w[c] for w in held)) for c in ("mx", "my")}

        def cell(place: float, c: str) -> int:
            low, high = ends[c]
            at = (place - low) / (high - low) * k if high > low else 0
            return min(k - 1, int(min(at, k))) if at > 0 else 0

        grid: dict[tuple[int, int], list[int]] = {}
        for n, b in enumerate(boxes):
            for x in range(cell(b["a"], "mx"), cell(b["c"], "mx") + 1):
                for y in range(cell(b["b"], "my"), cell(b["d"], "my") + 1):
                    grid.setdefault((x, y), []).append(n)
        for w in held:
            for n in grid.get((cell(w["mx"], "mx"), cell(w["my"], "my")), ()):
                b = boxes[n]
                if b["a"] <= w["mx"] <= b["c"] and b["b"] <= w["my"] <= b["d"]:
                    at = tuple(w[c] for c in WORD_ORDER)
                    over[at] = min(n, over.get(at, n))
                    break
    out, seen = [], set()
    for w in words:
        n = over.get(tuple(w[c] for c in WORD_ORDER))
        key = None if n is None else tuple(boxes[n].values())
        if n is None:
            out.append(w["word"])
        elif key not in seen:
            seen.add(key)
            out.append(boxes[n]["mask"])
    return [x for x in out if x]


def page_area_counts(words: DataFrame, boxes: DataFrame) -> DataFrame:
    """(doc_id, page_no, n_areas), pages without any too."""
    counted = boxes.groupBy(*PLACE).agg(F.count("*").alias("n"))
    return words.select(*PLACE).distinct().join(counted, PLACE, "left").select(*PLACE, F.coalesce("n", F.lit(0)).alias("n_areas"))
