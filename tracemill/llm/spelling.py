"""Grouping of spelling variants by anagram hashing.

A word's key is the sum of a fifth power for each of its letters, so it is the same for all orders of the letters, and
one letter added, removed or exchanged changes it by one power or by the difference of two. Two words whose keys differ by an
exchange value have equal keys once each gives up the letter it exchanges; so each word meets the others on its key and on its key
less each of its letters, a few rows for each word where all exchange values would be thousands. No two exchange values over
this alphabet are equal, so a pair meets once. What meets is near if its letters are in order too: edit distance 1.

Keys that more than ``GROUP`` rows share are not compared pair by pair: there a word gives one row for each place it can lose a
letter, and meets only rows with the same letters left, in the same order (and the same place, for an exchange). Such a group has at
most as many rows as the alphabet has letters, or one word and what one letter adds to it. So the pairs compared are bounded by the
number of words, whatever they share.

The form of a word is the most frequent near word, where that is ``ratio`` times as frequent; its root is the end of the
chain of forms. Chains have few links, as each multiplies the count, and are closed by doubling.

Edge cases: null text has no words, null ids read as empty in the hash; repeated rows count again; words of any length are
taken whole; an empty table has no words. Columns other than id and text are not read.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only, scratch, text_of
from .graph import join_groups

GROUP = 64


def words(docs: DataFrame, least_length: int = 6, least_count: int = 5, every: int = 199, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the distinct words and their occurrences. Where a hash of id and word is divisible by ``every``, the word has lost a letter."""
    lowered = F.translate(text_of(text_col), ascii_uppercase, ascii_lowercase)
    # Runs that are too short stay so when they lose a letter.
    runs = F.regexp_extract_all(lowered, F.lit(f"[a-zÀ-ÿ]{{{least_length},}}"), F.lit(0))
    found = docs.select(text_of(id_col).alias("id"), F.explode(runs).alias("run"))
    found = found.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"), F.length("run").alias("size"))
    gone = F.pmod(F.col("h"), F.col("size")).cast("int")
    less = F.concat(F.substr("run", F.lit(1), gone), F.substr("run", gone + 2, F.col("size")))
    changed = found.select(F.when(F.col("h") % every == 0, less).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= least_length)
    return changed.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def value(letter: Column) -> Column:
    """The letter's part of a key: the fifth power of its place among a-z and À-ÿ."""
    code = F.ascii(letter).cast("long")
    place = F.when(code <= ord("z"), code - (ord("a") - 1)).otherwise(code - (0xC0 - 27))
    return place * place * place * place * place


def letters(word: Column) -> Column:
    return F.filter(F.split(word, ""), lambda c: c != "")


def anagram_key(word: Column) -> Column:
    return F.aggregate(letters(word), F.lit(0).cast("long"), lambda key, c: key + value(c))


def _less(word: Column, at: Column) -> Column:
    """The word without its letter at a place from 0 on."""
    return F.concat(F.substr(word, F.lit(1), at), F.substr(word, at + 2, F.length(word)))


def near_pairs(vocabulary: DataFrame, group: int = GROUP) -> DataFrame:
    """word, other: each pair of words of edit distance 1, once. ``vocabulary`` has distinct words."""
    keyed = scratch(vocabulary.select("word", anagram_key(F.col("word")).alias("whole")), "anagrams")
    # Kind 0 is the word itself; 1 the word less one of its letters.
    rows = keyed.select(
        "word",
        F.explode(
            F.concat(
                F.array(F.struct(F.lit(0).alias("kind"), F.col("whole").alias("key"))),
                F.transform(F.array_distinct(letters(F.col("word"))), lambda c: F.struct(F.lit(1).alias("kind"), (F.col("whole") - value(c)).alias("key"))),
            )
        ).alias("e"),
    ).select("word", "e.kind", "e.key")
    rows = scratch(rows, "anagram_rows")
    sizes = scratch(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "anagram_sizes")
    met = scratch(join_groups(rows, sizes, ["key"], "size", rows.count()).filter("size is not null"), "anagram_met")
    few = met.filter(F.col("size") <= group)
    a, b = few.select("key", "kind", "word"), few.select("key", F.col("kind").alias("kind_b"), F.col("word").alias("other"))
    near = a.join(b, "key").filter("word < other and kind + kind_b > 0").filter(F.levenshtein("word", "other", 1) == 1).select("word", "other")

    many = met.filter(F.col("size") > group).select("word", "kind", "key")
    places = F.when(F.col("kind") == 0, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.length("word") - 1))
    apart = many.select("*", F.explode(places).alias("at"))
    letter = F.substr("word", F.col("at") + 1, F.lit(1))
    # Of the places of the letter that was taken from the key; the key itself says which letter that is.
    apart = apart.join(keyed, "word").filter((F.col("kind") == 0) | (F.col("whole") - value(letter) == F.col("key")))
    rest = F.when(F.col("kind") == 0, F.col("word")).otherwise(_less(F.col("word"), F.col("at")))
    apart = scratch(apart.select("word", "kind", "at", rest.alias("rest"), (letter == F.substr("word", F.col("at"), F.lit(1))).alias("again")), "anagram_places")
    lost = apart.filter("kind = 1")
    exchanged = lost.join(lost.select("at", "rest", F.col("word").alias("other")), ["at", "rest"]).filter("word < other")
    added = apart.filter("kind = 0").select("rest", "word").join(
        # Of a run of one letter, each place leaves the same word.
        lost.filter((F.col("at") == 0) | ~F.col("again")).select("rest", F.col("word").alias("other")),
        "rest",
    )
    return near.unionByName(exchanged.select("word", "other")).unionByName(added.select(F.least("word", "other").alias("word"), F.greatest("word", "other").alias("other")))


def forms(vocabulary: DataFrame, pairs: DataFrame, ratio: int = 5) -> DataFrame:
    """word, n, n_near, form, form_n for each row of ``vocabulary``."""
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("word").alias("other")))
    counted = both.join(vocabulary.select(F.col("word").alias("other"), F.col("n").alias("m")), "other")
    best = counted.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("other"))).alias("best"))
    out = vocabulary.join(best, "word", "left")
    enough = -F.col("best.m") >= ratio * F.col("n")
    return out.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(enough, F.col("best.other")).alias("form"),
        F.when(enough, -F.col("best.m")).alias("form_n"),
    )


def roots(formed: DataFrame) -> DataFrame:
    """word, root for the words that have a form. Each round doubles the links a word has followed."""
    step = scratch(formed.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        on = step.select(F.col("word").alias("root"), F.col("root").alias("further"))
        jumped = scratch(step.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        step = jumped.select("word", "root")
        if not jumped.filter("moved").take(1):
            return step


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word of ``docs``: word, form, root, n, n_near, form_n. Runs jobs."""
    with only("variants") as keep:
        vocabulary = scratch(words(docs, id_col=id_col, text_col=text_col), "words")
        formed = scratch(forms(vocabulary, near_pairs(vocabulary)), "forms")
        out = formed.join(roots(formed), "word", "left")
        return keep(out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
