"""Detect texts that were cut by a size limit or a broken transfer, and how often each source cuts.

The vocabulary of the whole corpus (every word but the last of each text) is a trie held as a table: one row per
prefix with the uses of that very word, of longer words that start so, and with the lines or sentences that end in
the word. A text is cut when what it ends in is an unknown proper prefix of known words, a known word that ends
no line or sentence anywhere, or a cut mark; an end without closing sign at a length that the source's texts pile up
at (the length evidence) counts as well.

Defined results: null and empty texts are not cut; texts without letters are judged by marks and length alone; equal
texts are judged alike; deliberate dots after a whole word, signatures, links, code and list items are no cuts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pkgloom.engine import cut, join_skewed

#: A word is unknown when it stands fewer than 1/RARE times as often as the words that it begins.
RARE = 2000
#: A known word with at least so many uses that hardly ever ends a line or sentence cannot end a text.
COMMON, END_SHARE = 20, 0.01
#: Lengths where the texts of a source pile up: so many times what their neighbours let expect, and at least so many.
PILE_TIMES, PILE_LEAST = 6.0, 5
#: A last line is a footer when at least so many distinct texts, and this share of its source's distinct texts, end in it.
FOOTER_LEAST, FOOTER_SHARE = 4, 0.002
#: Neighbourhood of a length, in characters, from which the expected number is taken.
PILE_SPAN = 64

# What a transfer or a shortening tool leaves at the end.
MARKS = r"(?:\(more\)?|\[(?:\.\.\.|…)\]|&(?:h(?:e(?:l(?:l(?:i(?:p;?)?)?)?)?)?|#\d*|amp|lt|gt|nbsp|raquo)|(?<=\S)<|�+|(?<=\p{L})-)$"
MARKED = re.compile(MARKS.replace(r"\p{L}", r"[^\W\d_]") + "|(?:…|\\.\\.\\.)$")
WORD = r"\p{L}+"
BLANKS = "\t\n\x0b\x0c\r \u00a0"
LETTERS = re.compile(r"[^\W\d_]+")
#: What ends a sentence or line: a closing sign before a blank, or a line break before anything but a small letter.
BORDER = re.compile(r"[.?!:]\s|\n(?=[^a-z])")
LAST = re.compile(r"([^\W\d_]+)[)`\"]?$")


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, source, n, word, last_line, ...) of every text. Whole lines are judged: the last one, and for marks and
    signatures the three before it, however long they are."""
    ending = F.substring_index(F.rtrim("text", F.lit(BLANKS)), "\n", -4)
    marked = F.regexp_extract(F.substring_index(ending, "\n", -1), MARKS, 0)
    body = F.rtrim(F.regexp_replace(ending, MARKS, ""), F.lit(BLANKS))
    dotted = F.regexp_extract(body, r"(?:…|\.\.\.)$", 0)
    core = F.regexp_replace(body, r"(?:…|\.\.\.)$", "")
    return (
        docs.select(
            "doc_id",
            F.coalesce("source", F.lit("")).alias("source"),
            F.length("text").alias("n"),
            F.xxhash64("text").alias("spelled"),
            (marked != "").alias("marked"),
            (dotted != "").alias("dotted"),
            core.alias("core"),
            ((F.length("text") - F.length(F.replace("text", F.lit("```"), F.lit("")))) / 3 % 2 == 1).alias("fence_open"),
        )
        .withColumn("word", F.lower(F.regexp_extract("core", rf"(?<!\p{{L}})({WORD}+)$", 1)))
        .withColumn("last_line", F.substring_index("core", "\n", -1))
        .withColumn(
            "signed",
            F.col("core").rlike(r"(?:^|\n)(?:-- ?|\p{L}[\p{L} ]{0,24},?)\n\p{Lu}\p{L}*$") & ~F.col("core").rlike(r"\n\n\p{Lu}\p{L}*$"),
        )
        .withColumn("bracket_open", F.col("last_line").rlike(r"\([^()]*$"))
        .withColumn("comma", F.col("core").rlike(r",$"))
        .withColumn("closed", F.col("core").rlike(r"[.?!)\]`>\"'»”]$"))
    )


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial counts of one batch: every word but the last of each text, and the words before unit borders."""
    for batch in batches:
        words, ends = Counter(), Counter()
        for text in batch["text"].dropna():
            text = text.lower().rstrip()
            line = text.rfind("\n") + 1
            text = text[:line] + MARKED.sub("", text[line:])
            found = LETTERS.findall(text)
            words.update(found[:-1])
            units = BORDER.split(text)
            for unit in units[:-1]:
                last = unit[unit.rfind(" ") + 1 :]
                if last.isalpha():
                    ends[last] += 1
                elif m := LAST.search(last):
                    ends[m[1]] += 1
        if words:
            yield pd.DataFrame({"word": list(words), "texts": list(words.values()), "ends": [ends[w] for w in words]})


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, texts, ends): uses of the word elsewhere than at the end of a text, and lines and sentences that end in it.
    Words are counted per batch before they are shuffled."""
    partial = docs.select("text").mapInPandas(_count_words, "word string, texts bigint, ends bigint")
    return partial.groupBy("word").agg(F.sum("texts").alias("texts"), F.sum("ends").alias("ends"))


def trie(words: DataFrame) -> DataFrame:
    """(prefix, texts, ends, longer): one row per trie node."""
    nodes = words.select(
        F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda k: F.substring("word", F.lit(1), k))).alias("prefix"),
        "word", "texts", "ends",
    )
    own = F.col("prefix") == F.col("word")
    return nodes.groupBy("prefix").agg(
        F.sum(F.when(own, F.col("texts")).otherwise(0)).alias("texts"),
        F.sum(F.when(own, F.col("ends")).otherwise(0)).alias("ends"),
        F.sum(F.when(own, 0).otherwise(F.col("texts"))).alias("longer"),
    )


def piled_lengths(shapes: DataFrame) -> DataFrame:
    """(source, n, c): lengths that a source's distinct texts pile up at, with the number of these texts."""
    counts = shapes.select("source", "n", "spelled").distinct().groupBy("source", "n").agg(F.count(F.lit(1)).alias("c"))
    near = counts.select(
        "source", F.explode(F.sequence(F.expr(f"n div {PILE_SPAN} - 1"), F.expr(f"n div {PILE_SPAN} + 1"))).alias("slot"), "c"
    ).groupBy("source", "slot").agg(F.sum("c").alias("around"))
    joined = counts.withColumn("slot", F.expr(f"n div {PILE_SPAN}")).join(near, ["source", "slot"])
    expected = (F.col("around") - F.col("c")) / (3 * PILE_SPAN - 1)
    return joined.where((F.col("c") >= PILE_LEAST) & (F.col("c") > PILE_TIMES * expected + 3 * F.sqrt(expected) + 1)).select(
        "source", "n", "c", F.lit(True).alias("piled")
    )


def footers(shapes: DataFrame) -> DataFrame:
    """(source, last_line, c): lines that many distinct texts of a source end in, with the number of rows that end so.
    Copies of one text count once, so a torn line is no footer because its text is copied."""
    texts = shapes.groupBy("source", "n", "spelled", "last_line").agg(F.count(F.lit(1)).alias("c"))
    lines = cut(texts.groupBy("source", "last_line").agg(F.count(F.lit(1)).alias("texts"), F.sum("c").alias("c")))
    sizes = lines.groupBy("source").agg(F.sum("texts").alias("size"))
    often = (F.col("texts") >= FOOTER_LEAST) & (F.col("texts") >= FOOTER_SHARE * F.col("size"))
    return lines.where("last_line <> ''").join(sizes, "source").where(often).select("source", "last_line", "c", F.lit(True).alias("footer"))


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, source, cut) of every document."""
    shapes = cut(features(docs))
    asked = shapes.where("word <> ''").select(F.col("word").alias("prefix")).distinct()
    known = trie(vocabulary(docs)).join(asked, "prefix", "left_semi").withColumnRenamed("prefix", "word")
    counted = shapes.where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("finals"))
    known = cut(known.join(counted, "word").select("word", "texts", "ends", "longer", "finals"))
    joined = join_skewed(shapes, known, ["word"], "finals", "left")
    joined = join_skewed(joined, cut(piled_lengths(shapes)), ["source", "n"], "c", "left").drop("c")
    joined = join_skewed(joined, cut(footers(shapes)), ["source", "last_line"], "c", "left")
    texts, ends, longer = (F.coalesce(c, F.lit(0)) for c in ("texts", "ends", "longer"))
    worded = F.col("word") != ""
    inside = worded & (longer > 0) & (texts * RARE < longer)
    never_last = worded & (texts >= COMMON) & (ends < END_SHARE * texts)
    torn = ~F.col("signed") & ~F.coalesce("footer", F.lit(False)) & (inside | never_last)
    at_limit = F.coalesce("piled", F.lit(False)) & ~F.col("closed") & ~F.col("dotted")
    verdict = (
        F.col("marked")
        | (F.col("dotted") & torn)
        | (~F.col("dotted") & (torn | F.col("bracket_open") | F.col("fence_open") | F.col("comma") | at_limit))
    )
    return joined.select("doc_id", "source", (verdict & (F.col("n") > 0)).alias("cut"))


def cut_texts(docs: DataFrame) -> DataFrame:
    """(doc_id) of every document whose text was cut off."""
    return judge(docs).where("cut").select("doc_id")


def cut_rates(docs: DataFrame) -> DataFrame:
    """(source, texts, cut_texts, rate) per source."""
    return (
        judge(docs)
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("texts"), F.sum(F.col("cut").cast("long")).alias("cut_texts"))
        .withColumn("rate", F.round(F.col("cut_texts") / F.col("texts"), 6))
    )
