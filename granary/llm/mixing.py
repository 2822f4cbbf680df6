"""Mixing sources to target weights by iterative proportional fitting.

Tokens are counted in cells of source, language and topic. The cells' weights are raked until their marginals meet
the targets. A cell's raked weight, scaled to the token budget, is how often its documents are expected in the mix: below 1
a hash of the id decides whether one is taken, above 1 it is repeated and the hash decides about the last copy. So the
mix has the target marginals also where the corpus has less of a cell than they ask for. A sample without repetition has
probabilities of at most 1 and fills what is missing from other cells: it holds the budget, and the documents of the mix
with it, but not the targets.
"""

from __future__ import annotations

import functools
import uuid
import warnings
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import bounded, written
from granary.llm.quality import BLANKS, SPACE, SYMBOLS

OTHER = "other"
#: Target shares of tokens. Values not named count as OTHER, so the cells are at most the product of these tables' sizes.
TARGETS: dict[str, dict[str, float]] = {
    "source": {f"src{k}": 0.0475 for k in range(20)} | {OTHER: 0.05},
    "lang": {"en": 0.5, "fr": 0.18, "de": 0.18, "es": 0.12, OTHER: 0.02},
    "topic": {"prose": 0.62, "longform": 0.25, "fragment": 0.05, "shouting": 0.02, "symbols": 0.03, "repeats": 0.03},
}
#: Share of all tokens that the sample holds on average.
BUDGET = 0.8
SEED = 17


LOWER = "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of a text; of one without words, one empty string."""
    return F.split(F.btrim(text, F.lit(BLANKS)), SPACE)


def topic_of(text: Column, words: Column) -> Column:
    """A document's form, for corpora without topics: fragment, symbols, shouting, repeats, longform or prose."""
    n = F.size(words)
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    lower = F.length(text) - F.length(F.translate(text, LOWER, ""))
    return (
        F.when(n < 50, "fragment").when(symbols * 4 > n, "symbols").when(lower * 4 < F.length(text), "shouting")
        .when(F.size(F.array_distinct(words)) * 3 < n, "repeats").when(n > 1000, "longform").otherwise("prose")
    )


def targets_of(table: DataFrame) -> dict[str, dict[str, float]]:
    """Targets from a table: marginal, category, target."""
    out: dict[str, dict[str, float]] = {}
    for m, k, x in table.select("marginal", "category", F.col("target").cast("double")).collect():  # as many rows as there are targets
        out.setdefault(m, {})[k] = x
    return out


def attributes(docs: DataFrame, topic: str | None = None) -> DataFrame:
    """doc_id, source, lang, topic and n_tokens (words) of every document. topic names a column with topics, by a classifier or
    from the source; without it a document's topic is its form."""
    given = F.lit(None).cast("string") if topic is None else F.col(topic)
    d = docs.select("doc_id", "source", "lang", given.alias("given"), F.coalesce("text", F.lit("")).alias("t")).withColumn("w", words_of(F.col("t")))
    n = F.when(F.get("w", F.lit(0)) == "", 0).otherwise(F.size("w"))
    topic_ = topic_of(F.col("t"), F.col("w")) if topic is None else F.col("given")
    return d.select("doc_id", "source", "lang", topic_.alias("topic"), n.cast("long").alias("n_tokens"), row_key("t", "given").alias("row_key"))


def row_key(text: str, topic: str | None = None) -> Column:
    """With doc_id it names a row by what decides its cell, also where ids are null or repeated."""
    return F.xxhash64(*(F.coalesce(c, F.lit("")) for c in (text, "source", "lang")), *([] if topic is None else [F.coalesce(topic, F.lit(""))]))


def rake(tokens: np.ndarray, groups: list[np.ndarray], targets: list[np.ndarray], tolerance: float = 1e-10, rounds: int = 1000) -> np.ndarray:
    """Cell weights, sum 1, that begin as the cells' shares of tokens and are scaled to one marginal after another until
    all hold. groups: of each marginal, the category of every cell; targets: shares of the categories; those of categories
    without tokens are spread over the others in proportion. Warns if the corpus lacks cells that the targets need together."""
    total = tokens.sum()
    if not total:
        return np.zeros(len(tokens))
    w = tokens / total
    want = []
    for g, t in zip(groups, targets):
        t = np.where(np.bincount(g, tokens, len(t)) > 0, t, 0)
        want.append(t / t.sum() if t.sum() else np.bincount(g, w, len(t)))
    for _ in range(rounds):
        off = 0.0
        for g, t in zip(groups, want):
            have = np.bincount(g, w, len(t))
            off = max(off, float(np.abs(have - t).max()))
            w = w * np.divide(t, have, out=np.zeros(len(t)), where=have > 0)[g]
        if off < tolerance:
            break
    else:
        if off > 1e-4:
            warnings.warn(f"marginals are up to {off:.2g} from their targets after {rounds} rounds", stacklevel=2)
    return w / w.sum() if w.sum() else w


def expected_copies(tokens: np.ndarray, weights: np.ndarray, budget: float) -> np.ndarray:
    """How often each cell's documents come in a mix of budget * all tokens that has the weights; above 1 they are repeated."""
    return budget * tokens.sum() * np.divide(weights, tokens, out=np.zeros(len(tokens)), where=tokens > 0)


def probabilities(tokens: np.ndarray, weights: np.ndarray, budget: float) -> np.ndarray:
    """min(1, scale * weight / tokens) of each cell, the scale such that budget * all tokens are kept on average, or all
    tokens of cells with weight if these are fewer."""
    rate = np.divide(weights, tokens, out=np.zeros(len(tokens)), where=tokens > 0)
    want, full = budget * tokens.sum(), np.zeros(len(tokens), dtype=bool)
    p = np.zeros(len(tokens))
    while (free := ~full & (rate > 0)).any():
        scale = max(0.0, want - tokens[full].sum()) / weights[free].sum()
        p = np.where(full, 1.0, scale * rate)
        over = free & (p > 1)
        if not over.any():
            return p
        full |= over
    return np.where(rate > 0, 1.0, 0.0) if full.any() else p


def _category(col: str, targets: Mapping[str, float]) -> Column:
    named = [k for k in targets if k != OTHER]
    return F.when(F.col(col).isin(named), F.col(col)).otherwise(OTHER)


def unit(doc_id: Column, key: Column, seed: int) -> Column:
    """A number from 0 to 1 by the id alone, by the row's key where it is null: 52 bits of the MD5 of seed and digits."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.concat(F.lit("key:"), key.cast("string")))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def calibrated(attrs: DataFrame, targets: Mapping[str, Mapping[str, float]] = TARGETS, budget: float = BUDGET) -> DataFrame:
    """The cells (a column a marginal, named <marginal>_cell) with tokens, n_docs, weight, prob and expected copies."""
    keys = [f"{m}_cell" for m in targets]
    cells = attrs.select("n_tokens", *[_category(m, t).alias(f"{m}_cell") for m, t in targets.items()]).groupBy(*keys).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs"))
    got = cells.toPandas().sort_values(keys, ignore_index=True)  # rows bounded by the tables of targets
    groups, shares = [], []
    for m, t in targets.items():
        names = [*[k for k in t if k != OTHER], OTHER]
        groups.append(got[f"{m}_cell"].map({k: i for i, k in enumerate(names)}).to_numpy(dtype=np.int64))
        shares.append(np.array([t.get(k, 0.0) for k in names]))
    tokens = got["tokens"].to_numpy(dtype=np.float64)
    got["weight"] = rake(tokens, groups, shares)
    weights = got["weight"].to_numpy()
    for name, f in (("prob", probabilities), ("expected", expected_copies)):
        got[name] = np.where(tokens > 0, f(tokens, weights, budget), 1.0)  # nothing to weigh
    schema = ", ".join(f"{k} string" for k in keys) + ", tokens long, n_docs long, weight double, prob double, expected double"
    return attrs.sparkSession.createDataFrame(got[[*keys, "tokens", "n_docs", "weight", "prob", "expected"]].values.tolist() if len(got) else [], schema)


def marginals(rows: DataFrame, targets: Mapping[str, Mapping[str, float]] = TARGETS) -> DataFrame:
    """marginal, category, target, and the corpus's and the mix's shares of tokens, for rows of mixed()."""
    parts = [rows.select(F.lit(m).alias("marginal"), _category(m, t).alias("category"), "n_tokens", "copies") for m, t in targets.items()]
    out = functools.reduce(DataFrame.union, parts).groupBy("marginal", "category").agg(F.sum("n_tokens").alias("a"), F.sum(F.col("n_tokens") * F.col("copies")).alias("b"))
    named = rows.sparkSession.createDataFrame([(m, k, float(x)) for m, t in targets.items() for k, x in t.items()], "marginal string, category string, target double")
    every = Window.partitionBy("marginal")  # as many rows as the table of targets has
    share = lambda c: (F.coalesce(c, F.lit(0)) / F.sum(c).over(every))
    return out.join(named, ["marginal", "category"], "full").select("marginal", "category", "target", share(F.col("a")).alias("corpus"), share(F.col("b")).alias("mix"))


def _decided(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] = TARGETS, budget: float = BUDGET, seed: int = SEED, topic: str | None = None) -> DataFrame:
    attrs = written(attributes(docs, topic), "attributes")
    keyed = attrs.withColumns({f"{m}_cell": _category(m, t) for m, t in targets.items()})
    cells = calibrated(attrs, targets, budget).select(*[f"{m}_cell" for m in targets], "weight", "prob", "expected")
    out = keyed.join(F.broadcast(cells), [f"{m}_cell" for m in targets], "left")  # bounded by the tables of targets
    whole, u = F.floor("expected"), unit(F.col("doc_id"), F.col("row_key"), seed)
    out = out.withColumn("copies", whole + (u < F.col("expected") - whole).cast("long"))
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "prob", "row_key", (u < F.col("prob")).alias("sampled"), "copies")


def mixed(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] = TARGETS, budget: float = BUDGET, seed: int = SEED, topic: str | None = None) -> DataFrame:
    """Every document with its attributes, its cell's weight (share of the mix), prob, whether it is sampled and its copies
    in the mix. sampled takes no document twice and misses targets that the corpus can't fill; copies meet them.

    Null and unnamed sources, languages and topics count as OTHER; null and empty texts have no tokens, and a very long one counts with
    all its words; a cell without tokens keeps its documents; a document whose number equals its probability is left out;
    repeated rows share their fate, as do rows without an id whose texts, sources and languages are equal; an empty table gives an
    empty result; columns beside doc_id, text, source, lang and topic, if one is named, are not read.
    """
    return _decided(docs, targets, budget, seed, topic).drop("row_key")


def _keys(decided: DataFrame, docs: DataFrame, topic: str | None, *more: Column) -> tuple[DataFrame, Column]:
    """The keys of decided rows under names that no column of docs has, and the condition that joins docs with them."""
    name, key = (f"{n}_{uuid.uuid4().hex}" for n in ("id", "key"))
    out = written(decided.select(F.col("doc_id").alias(name), F.col("row_key").alias(key), *more).distinct(), "keys")
    # The topic's place in the key is taken even where none is named.
    own = F.xxhash64(*(F.coalesce(docs[c], F.lit("")) for c in ("text", "source", "lang")), F.lit("") if topic is None else F.coalesce(docs[topic], F.lit("")))
    return out, docs["doc_id"].eqNullSafe(out[name]) & (own == out[key])


def sample(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] = TARGETS, budget: float = BUDGET, seed: int = SEED, at_once: int = 2_000_000, topic: str | None = None) -> DataFrame:
    """The sampled documents with all their columns. The keys of those left out go to the documents if they are at_once or
    fewer, otherwise both sides are shuffled by key."""
    out, same = _keys(_decided(docs, targets, budget, seed, topic).where("NOT sampled"), docs, topic)
    return docs.join(bounded(out, at_once), same, "left_anti")


def repeated(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] = TARGETS, budget: float = BUDGET, seed: int = SEED, at_once: int = 2_000_000, topic: str | None = None) -> DataFrame:
    """The mix with the target marginals: documents with all their columns, each as often as it has copies. The keys of those
    whose copies are not 1 go to the documents if they are at_once or fewer, otherwise both sides are shuffled by key."""
    n, copy = (f"{x}_{uuid.uuid4().hex}" for x in ("copies", "copy"))
    other, same = _keys(_decided(docs, targets, budget, seed, topic).where("copies != 1"), docs, topic, F.col("copies").cast("int").alias(n))
    out = docs.join(bounded(other, at_once), same, "left")
    return out.withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.coalesce(n, F.lit(1))))).select(*[docs[c] for c in docs.columns])
