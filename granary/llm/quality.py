"""Quality rules: adaptive thresholds from mergeable quantile sketches per language and source.

DataFrame functions only. Word statistics are computed inside each row with array functions in
O(n log n); a KLL sketch of every statistic is aggregated per (language, source) and merged upwards, and each
document is joined with the thresholds of its own group.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import bounded, written

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
#: Sketch size: exact up to about so many documents a group, then a rank error under 0.1 %.
SKETCH_K = 4096
#: A fence stands SPREAD times the distance from the median to the upper quartile above the median.
SPREAD = 6.0
#: Copies of each group's row of thresholds, and salts of the documents that look them up.
SALTS = 16
#: Groups with fewer documents take the thresholds of their language, and those the thresholds of the corpus.
LEAST_DOCS = 200
#: Statistics, each with the least distance from its median to its fence: groups of even texts keep ordinary variation.
STATISTICS = {"symbol_rate": 0.25, "dup_line_rate": 0.4, "repeat_rate": 0.35, "word_length": 1.5}
#: The fixed part of the rules, which the thresholds add to.
LEAST_WORDS, MOST_REPEATED = 50, 50


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != F.lit(""))


def _windows(words: Column, n: Column) -> Column:
    """Every 3-word window's hash and place, from 1."""
    return F.transform(
        F.when(n >= 3, F.sequence(F.lit(1), n - 2)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)).alias("h"), i.alias("i")),
    )


def text_key() -> Column:
    """With doc_id it names a row by all that decides its verdict, also where ids are null or repeated."""
    return F.xxhash64(*(F.coalesce(c, F.lit("")) for c in ("text", "lang", "source")))


def features(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the word statistics of every text, null texts being empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", "lang", "source", text.alias("t"), text_key().alias("text_key")).withColumn("w", _words(F.col("t"))).withColumn("n", F.size("w"))
    d = d.withColumn("s", F.sort_array(_windows(F.col("w"), F.col("n"))))
    # Neighbours in hash order tell which windows occur again; back in text order their cover is counted.
    same = lambda k, x: F.coalesce(F.get(F.col("s"), k)["h"] == x["h"], F.lit(False))
    flagged = F.transform("s", lambda x, k: F.when(same(k - 1, x) | same(k + 1, x), x["i"]))
    d = d.withColumn("p", F.sort_array(F.filter(flagged, lambda i: i.isNotNull())))
    cover = F.aggregate(
        F.col("p"),
        F.struct(F.lit(0).alias("to"), F.lit(0).cast("bigint").alias("c")),
        lambda a, i: F.struct((i + 2).alias("to"), (a["c"] + F.least(F.lit(3), i + 2 - a["to"])).cast("bigint").alias("c")),
        lambda a: a["c"],
    )
    lines = F.filter(F.split("t", "\n"), lambda x: F.translate(x, BLANKS, "") != F.lit(""))
    d = d.withColumn("l", lines)
    return d.select(
        "doc_id", "lang", "source", "text_key",
        F.col("n").cast("bigint").alias("n_words"),
        F.length(F.translate("t", BLANKS, "")).cast("bigint").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("bigint").alias("n_dup_lines"),
        F.size("l").cast("bigint").alias("n_lines"),
        cover.alias("n_repeat_words"),
    )


def rates(f: DataFrame) -> DataFrame:
    """The statistics that the thresholds are about, and the fixed part's verdict."""
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)).cast("double")
    return f.withColumns({
        "symbol_rate": rate("n_symbols", "n_words"), "dup_line_rate": rate("n_dup_lines", "n_lines"),
        "repeat_rate": rate("n_repeat_words", "n_words"), "word_length": rate("word_chars", "n_words"),
        "base_failed": (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")),
        "lang_key": F.coalesce("lang", F.lit("")), "source_key": F.coalesce("source", F.lit("")),
    })


def thresholds(f: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """One row a (lang_key, source_key): the fence of every statistic.

    Sketches are made once, for the smallest groups, and merged into those of the languages and of the corpus. A
    group under least_docs documents has its language's fences, a language under it the corpus's.
    """
    cells = f.groupBy("lang_key", "source_key").agg(*[F.kll_sketch_agg_double(F.when(~F.col("base_failed"), F.col(m)), F.lit(SKETCH_K)).alias(m) for m in STATISTICS])
    merged = [F.kll_merge_agg_double(F.col(m), F.lit(SKETCH_K)).alias(m) for m in STATISTICS]
    langs = cells.groupBy("lang_key").agg(*merged)
    corpus = cells.agg(*merged)

    def fences(df: DataFrame, by: str) -> DataFrame:
        n = F.coalesce(F.kll_sketch_get_n_double(F.col("word_length")), F.lit(0))
        q = lambda m, r: F.kll_sketch_get_quantile_double(F.col(m), F.lit(r))
        fence = {m: F.when(n > 0, q(m, 0.5) + F.greatest(F.lit(least), SPREAD * (q(m, 0.75) - q(m, 0.5)))) for m, least in STATISTICS.items()}
        keys = [c for c in df.columns if c.endswith("_key")]
        return df.select(*keys, n.alias(f"{by}_n"), F.struct(*[v.alias(m) for m, v in fence.items()]).alias(f"{by}_fence"))

    every = fences(corpus, "all").withColumn("of", F.lit("corpus"))
    t = fences(cells, "cell").join(fences(langs, "lang"), "lang_key").withColumn("of", F.lit("corpus")).join(every, "of")
    pick = F.when(F.col("cell_n") >= least_docs, F.col("cell_fence")).when(F.col("lang_n") >= least_docs, F.col("lang_fence")).otherwise(F.col("all_fence"))
    return t.select("lang_key", "source_key", pick.alias("fence"))


def judge(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Every document's statistics, base_failed and kept.

    A document stays if it passes the fixed part and none of its statistics is above its group's fence. Null texts
    are empty and fail; null languages and sources form groups of their own; repeated rows are judged alike; a statistic
    that equals its fence is not above it; very long texts are counted whole; an empty table gives an empty result; columns beside
    doc_id, text, lang and source are not read.
    """
    f = written(features(docs), "quality")
    r = rates(f)
    salted = thresholds(r, least_docs).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    r = r.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int"))
    above = F.lit(False)
    for m in STATISTICS:
        above = above | F.coalesce(F.col(m) > F.col("fence")[m], F.lit(False))
    return r.join(salted, ["lang_key", "source_key", "salt"], "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~above).alias("kept"),
        "n_lines", "text_key", *STATISTICS, *[F.col("fence")[m].alias(f"{m}_fence") for m in STATISTICS],
    )


def accepted(docs: DataFrame, least_docs: int = LEAST_DOCS, at_once: int = 2_000_000) -> DataFrame:
    """docs, all columns, without the rejected documents. The rejected rows' keys go to the documents if they are
    at_once or fewer, otherwise both sides are shuffled by key. Rows with one id, or without, share a fate only if text, language and
    source are equal; docs may have columns of any name."""
    name, key = (f"{n}_{uuid.uuid4().hex}" for n in ("id", "key"))
    bad = written(judge(docs, least_docs).where("NOT kept").select(F.col("doc_id").alias(name), F.col("text_key").alias(key)).distinct(), "rejected")
    return docs.join(bounded(bad, at_once), docs["doc_id"].eqNullSafe(bad[name]) & (text_key() == bad[key]), "left_anti")
