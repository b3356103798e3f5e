"""Mixing sources to target weights by iterative proportional fitting.

Documents are grouped into cells of source, language and topic. Raking scales
the cells' token weights to one set of marginals after the other: sources,
languages, topics, again and again. A document's sampling probability is its
cell's factor, scaled so that the largest is 1; a hash of the document's id
decides, so a rerun takes the same documents. With a token budget the factors
are scaled further, and cells that reach probability 1 are taken whole, until
the expected tokens meet the budget: targets far from the corpus are then
approached as far as the budget allows, and one scarce cell cannot shrink all others.

The cells are few (one row a combination) and stay a DataFrame; each sweep is
three grouped sums, each checkpointed. Documents are scanned twice and shuffled once,
as partial sums, never by a hot source: factors join back as broadcast only
where Spark measures the cells as small.

Defined results: null source, language or topic is a category of its own
(the empty name). Null text has no tokens and follows its cell. A null id is
hashed as empty text. Categories without a target share what the named targets
leave, 0.02 at least, in proportion to their tokens; targets of absent categories are dropped and the others scaled
to a sum of 1. A cell without tokens has probability 1. Repeated rows share one decision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlift.llm.common import WORD, written

DIMS = ("source", "lang", "topic")
#: Steps towards the budget's scale; it is approached from below and met once no further cell saturates.
SCALE_STEPS = 6


def topic_rule(text: Column, words: Column) -> Column:
    """A coarse topic from the text's form: table, shouting, symbols, note (under 50 words) or prose."""
    text, least = F.coalesce(text, F.lit("")), F.greatest(words, F.lit(1))

    def found(mark: str) -> Column:
        return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(mark), F.lit("")))) / len(mark)
    symbols = sum((found(3 * c) for c in "#$%&*"), F.lit(0.0))
    return (F.when(found("|") * 5 >= least, "table").when(found("!!") * 5 >= least, "shouting")
            .when(symbols * 5 >= least, "symbols").when(words < 50, "note").otherwise("prose"))


def draw(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) from the md5 of seed and id."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def rest_share(wanted: dict[str, float]) -> float:
    return max(0.02, 1.0 - sum(wanted.values()))


def _targets(cells: DataFrame, dim: str, wanted: dict[str, float]) -> DataFrame:
    """(value, goal): the share of every present value, summing to 1."""
    rest = rest_share(wanted)
    tokens = cells.groupBy(F.col(dim).alias("value")).agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    goal = F.lit(None).cast("double")
    for k, v in wanted.items():
        goal = F.when(F.col("value") == k, float(v)).otherwise(goal)
    tokens = tokens.withColumn("goal", goal)
    other = F.when(F.col("goal").isNull(), F.col("tokens"))
    others, given = tokens.agg(F.sum(other), F.sum("goal")).first()
    full = (given or 0.0) + (0.0 if others is None else rest)
    goal = F.coalesce("goal", F.col("tokens") / F.lit(others).cast("long") * rest)
    return tokens.select("value", (goal / F.lit(full)).alias("goal"))


def rake(cells: DataFrame, targets: dict[str, dict[str, float]], *, sweeps: int = 8) -> DataFrame:
    """cells (source, lang, topic, tokens) with weight: the raked share of all tokens of each cell.

    Every step starts from written cells: a step over the plan of the one before would hold that plan twice, and a sweep
    each plan eight times."""
    cells = written(cells.where("tokens > 0"), "cells")
    whole = cells.agg(F.sum("tokens")).first()[0]
    now = cells.withColumn("weight", F.col("tokens") / F.lit(whole).cast("long"))
    for d in DIMS:
        now = now.join(_targets(cells, d, targets.get(d, {})).toDF(d, f"{d}_goal"), d)
    now = written(now, "goals")
    for _ in range(sweeps):
        for d in DIMS:
            factor = now.groupBy(d).agg((F.max(f"{d}_goal") / F.sum("weight")).alias("f"))
            now = written(now.join(factor, d).withColumn("weight", F.col("weight") * F.col("f")).drop("f"), "step")
    return now.drop(*[f"{d}_goal" for d in DIMS])


def budget_scale(cells: DataFrame, budget: float) -> float:
    """Factor of the probabilities at which min(1, factor * probability) keeps ``budget`` of the tokens of cells."""
    whole = cells.agg(F.sum("tokens")).first()[0] or 0
    scale = 1.0
    for _ in range(SCALE_STEPS):
        full = F.col("probability") * scale >= 1
        taken, open_ = cells.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)),
                                 F.sum(F.when(full, 0.0).otherwise(F.col("tokens") * F.col("probability")))).first()
        if not open_:
            break
        scale = max(scale, (budget * whole - taken) / open_)
    return scale


def mix_sources(docs: DataFrame, targets: dict[str, dict[str, float]], *, budget: float | None = None, id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source", lang_col: str = "lang", topic: Column | None = None, sweeps: int = 8,
                seed: str = "mix", carry: bool = False) -> DataFrame:
    """Sampling probability and decision of every document.

    ``targets`` has shares for values of source, lang and topic; ``budget`` is the
    share of all tokens to keep (None: what the exact targets leave); ``topic`` is a
    column expression over ``docs`` (default: ``topic_rule`` of text and words).
    Returns doc_id, source, lang, topic, tokens, probability, kept; ``carry`` adds ``row``.
    """
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), name(F.col(source_col)).alias("source"),
        name(F.col(lang_col)).alias("lang"), F.col(text_col).cast("string").alias("text"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"),
        *([topic.alias("topic")] if topic is not None else []), *([F.struct(*docs.columns).alias("row")] if carry else []))
    topic = topic_rule(F.col("text"), F.col("tokens")) if topic is None else F.col("topic")
    rows = rows.withColumn("topic", name(topic)).drop("text")
    cells = rows.groupBy(*DIMS).agg(F.sum("tokens").alias("tokens"))
    raked = rake(cells, targets, sweeps=sweeps)
    ratio = F.col("weight") / F.col("tokens")
    top = raked.agg(F.max(ratio)).first()[0]
    probability = raked.select(*DIMS, "tokens", (ratio / F.lit(top).cast("double")).alias("probability"))
    scale = 1.0 if budget is None else budget_scale(probability, budget)
    probability = probability.select(*DIMS, F.least(F.col("probability") * scale, F.lit(1.0)).alias("probability"))
    out = rows.join(probability, list(DIMS), "left").withColumn("probability", F.coalesce("probability", F.lit(1.0)))
    return out.withColumn("kept", draw(F.col("doc_id"), seed) < F.col("probability"))
