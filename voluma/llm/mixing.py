"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities.

The contingency table of tokens by source, language and topic is an aggregate with map-side combine. Each
sweep rakes it to the three target marginals in turn by an aggregate and a join that stay small or are
split by AQE; a table in the shared folder follows each of the three, so that no plan holds more than these two. A document's
probability is its cell's factor times a common scale, with the scale solved so that the expected sample holds the asked share of all tokens. Where that passes 1,
the cells are raked again with the bound inside, so that the expected sample meets the marginals; ``weight``
stays the factor without the bound. A category with fewer tokens than its target is taken whole, and
the others share the rest in proportion to their targets. A document is in the sample if a hash of its id lies below its probability, so a retry draws the same sample.
DataFrame functions only.

Targets: by default a category's share of the tokens to the power ``temper``, normalised, which lifts small
categories and lowers large ones; ``targets`` may give (category, share) tables instead. Topic: a column, or else the
nearest of a few directions to the shares of the document's distinct words in 16 buckets, less the mean shares of its
language, so that the words which a language always has decide nothing.

Targets that can't be met together leave a residual: ``residual`` is the largest miss of a target share, over all three
marginals of the fitted weights; it is near zero where the fit has converged, and the sweeps end at ``most_sweeps``.

Defined cases: tokens are words plus one end marker, so empty or null texts weigh one token; a null source,
language or topic is the category ''; categories that a given target table lacks get probability 0; rows
that share a ``doc_id`` share the draw; an empty table gives an empty sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voluma.llm.common import cut, cut_with, fresh, id_or_least, read, text_or_empty
from voluma.llm.syncmers import let

DIMENSIONS = ("source", "lang", "topic")
_SPACE = "[\\x20\\x09-\\x0D]+"
#: Buckets of word hashes, a power of two.
BUCKETS = 16


def _features(docs: DataFrame, topic: str | None) -> dict[str, Column]:
    """source, lang, tokens, and the topic or the shares of the distinct words in each bucket."""
    category = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    words = F.filter(F.split(text_or_empty(), _SPACE), lambda w: w != "")
    found = {"source": category("source"), "lang": category("lang")}
    if topic:
        return found | {"tokens": F.size(words).cast("long") + 1, "topic": category(topic)}

    def counted(w: Column) -> Column:
        # the distinct words' buckets and one of each, sorted: a bucket's count is how far the next one's first place is
        buckets = F.transform(F.array_distinct(w), lambda x: F.pmod(F.xxhash64(x), F.lit(BUCKETS)).cast("int"))
        places = let(F.sort_array(F.concat(buckets, F.sequence(F.lit(0), F.lit(BUCKETS)))), lambda p: F.array(*[F.array_position(p, F.lit(b)) for b in range(BUCKETS + 1)]))
        share = let(places, lambda p: F.array(*[(p[b + 1] - p[b] - 1) / F.greatest(p[BUCKETS] - BUCKETS - 1, F.lit(1)) for b in range(BUCKETS)]))
        return F.struct((F.size(w).cast("long") + 1).alias("tokens"), share.alias("shares"))

    both = let(words, counted)
    return found | {"tokens": both["tokens"], "shares": both["shares"]}


def _signs(topics: int) -> list[list[int]]:
    """Rows of the Sylvester matrix of order BUCKETS, without the first, and their negatives: the directions of the topics."""
    rows = [[-1 if (row & b).bit_count() % 2 else 1 for b in range(BUCKETS)] for row in range(1, 1 + (topics + 1) // 2)]
    return [sign for row in rows for sign in (row, [-x for x in row])][:topics]


def language_means(features: DataFrame) -> DataFrame:
    """(mixture_lang, mixture_mean): the mean shares of each language's documents."""
    return features.groupBy(F.col("lang").alias("mixture_lang")).agg(F.array(*[F.avg(F.col("shares")[b]) for b in range(BUCKETS)]).alias("mixture_mean"))


def with_topic(tagged: DataFrame, out: str, means: DataFrame, topics: int) -> DataFrame:
    """``tagged`` with the struct ``out`` of source, lang, tokens and topic, the nearest of ``topics`` directions."""
    key, mean = fresh(tagged, "mixture_lang", "mixture_mean")

    def nearest(x: Column) -> Column:
        along = F.array(*[sum((x[b] * sign for b, sign in enumerate(row)), F.lit(0.0)) for row in _signs(topics)])
        return let(along, lambda a: F.array_position(a, F.array_max(a)) - 1)

    joined = tagged.withColumn(key, F.col(out)["lang"]).join(means.toDF(key, mean), key)
    topic = let(F.zip_with(F.col(out)["shares"], F.col(mean), lambda x, m: x - m), nearest).cast("string")
    cell = F.struct(*[F.col(out)[c].alias(c) for c in ("source", "lang", "tokens")], topic.alias("topic"))
    return joined.select(*[F.col(f"`{c}`") for c in tagged.columns if c != out], cell.alias(out))


def by_category(cells: DataFrame, *aggregates: Column) -> DataFrame:
    """(dimension, category, aggregates): all marginals of ``cells`` by one aggregate; a category's target share is ``goal`` if ``cells`` has them."""
    goal = lambda d: [F.col(f"goal_{d}").alias("goal")] if f"goal_{d}" in cells.columns else []
    each = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("category"), *goal(d)) for d in DIMENSIONS])
    return cells.select("tokens", "w", F.explode(each).alias("of")).select("tokens", "w", "of.*").groupBy("dimension", "category").agg(*aggregates)


def aimed(cells: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """``cells`` with the target shares (category, share) of their categories in ``goal_`` columns, 0 where there is none."""
    for d, target in targets.items():
        cells = cells.drop(f"goal_{d}").join(target.select(d, F.col("share").cast("double").alias(f"goal_{d}")), d, "left").withColumn(f"goal_{d}", F.coalesce(f"goal_{d}", F.lit(0.0)))
    return cells


def rake(cells: DataFrame, whole: float, most_sweeps: int = 25, close: float = 1e-4, bounded: bool = False) -> tuple[DataFrame, float, float]:
    """``cells`` (dimensions, tokens, w, target shares) with ``w`` fitted to shares of ``whole``; the sum of w, and of the tokens of cells with any.

    ``bounded``: min(tokens, w) is what is fitted. A factor is then a Newton step for the cells below their bound, so each
    sweep refits what the clipped ones leave.
    """
    free = F.col("w") < F.col("tokens") if bounded else F.lit(True)
    for _ in range(most_sweeps):
        most = 0.0
        for d in DIMENSIONS:  # a table after each: plans of one aggregate and one join spare the driver
            now = cells.groupBy(d).agg(
                F.sum(F.when(free, F.col("w")).otherwise(0.0)).alias("free"), F.sum(F.when(free, 0.0).otherwise(F.col("tokens"))).alias("full"), (F.max(f"goal_{d}") * F.lit(whole)).alias("goal")
            )
            goal, reached = F.col("goal"), F.col("free") + F.col("full")
            if bounded:
                step = F.when(goal <= 0, 0.0).when(reached >= goal, goal / reached).when(F.col("free") > 0, (goal - F.col("full")) / F.col("free")).otherwise(1.0)
            else:
                step = F.when(F.col("free") > 0, goal / F.col("free")).otherwise(0.0)
            fitted = F.coalesce(F.col("w") * F.col("factor"), F.lit(0.0))
            moved = F.when(F.col("w") > 0, F.abs(F.col("factor") - 1)).otherwise(0.0)  # how far each marginal was from its target
            after = cells.join(now.select(d, step.alias("factor")), d).withColumn("w", F.least(fitted, F.col("tokens") * 1e9) if bounded else fitted).withColumn("gap", moved).drop("factor")
            cells, (worst, fit, there) = cut_with(after, [F.max("gap"), F.sum("w"), F.sum(F.when(F.col("w") > 0, F.col("tokens")))], instead_of=cells)
            most = max(most, worst or 0.0)
        if most < close:
            break
    return cells, float(fit or 0), float(there or 0)


def residual(cells: DataFrame, fit: float) -> float:
    """The largest miss of a target share by the weights ``w`` of ``cells``, whose sum is ``fit``, over all categories of all marginals."""
    miss = F.abs(F.sum("w") / F.lit(fit) - F.max("goal"))
    return by_category(cells, miss.alias("miss")).agg(F.max("miss")).first()[0] or 0.0 if fit else 0.0


def reachable(cells: DataFrame, whole: float) -> dict[str, DataFrame]:
    """The targets with no category over the tokens it has; what it cannot take goes to the others in proportion."""
    asked = cut(by_category(cells.where("w > 0"), F.sum("tokens").cast("double").alias("there"), (F.max("goal") * F.lit(whole)).alias("asked")))
    lifts = dict.fromkeys(DIMENSIONS, 1.0)
    for _ in range(60):
        full = {d: F.col("asked") * F.lit(lift) >= F.col("there") for d, lift in lifts.items()}
        of = {d: F.col("dimension") == d for d in DIMENSIONS}
        sums = asked.agg(*[F.sum(F.when(of[d], F.when(full[d], x).otherwise(y))) for d in DIMENSIONS for x, y in ((F.col("there"), 0.0), (0.0, F.col("asked")))]).first()
        now = {d: (whole - (taken or 0.0)) / left if left else lifts[d] for d, taken, left in zip(DIMENSIONS, sums[::2], sums[1::2], strict=True)}
        more = {d: lift for d, lift in now.items() if lift > lifts[d] * (1 + 1e-12)}
        if not more:
            break
        lifts |= more
    share = lambda lift: F.least(F.col("there"), F.col("asked") * F.lit(lift)) / F.lit(whole)
    return {d: asked.where(F.col("dimension") == d).select(F.col("category").alias(d), share(lift).alias("share")) for d, lift in lifts.items()}


def tempered(cells: DataFrame, temper: float) -> dict[str, DataFrame]:
    """Targets: each category's share of the tokens to the power ``temper``, normalised."""
    raised = by_category(cells, F.pow(F.sum("tokens").cast("double"), F.lit(temper)).alias("raised"))
    raised, wholes = cut_with(raised, [F.sum(F.when(F.col("dimension") == d, F.col("raised"))) for d in DIMENSIONS])
    return {d: raised.where(F.col("dimension") == d).select(F.col("category").alias(d), (F.col("raised") / F.lit(whole or 1.0)).alias("share")) for d, whole in zip(DIMENSIONS, wholes, strict=True)}


def scale_for(cells: DataFrame, goal: float) -> float:
    """The scale at which sum(min(tokens, scale * w)) is ``goal``, by passes over ever finer grids."""
    if not goal:
        return 0.0
    grid = [2.0 ** (i / 6 - 8) for i in range(240)]
    for _ in range(2):
        tried = cells.select("tokens", "w", F.explode(F.lit(grid)).alias("scale"))
        taken = tried.groupBy("scale").agg(F.sum(F.least(F.col("tokens").cast("double"), F.col("w") * F.col("scale"))).alias("taken"))
        sums = {r["scale"]: r["taken"] for r in taken.collect()}  # one row for each value of the grid
        low = max((g for g, s in sums.items() if s <= goal), default=0.0)
        high = min((g for g, s in sums.items() if s > goal), default=grid[-1])
        grid = [low + (high - low) * i / 239 for i in range(240)]
    return (low + high) / 2


def bounded_fit(fitted: DataFrame, asked: float, fit: float, there: float) -> DataFrame:
    """``fitted`` with ``w`` scaled to ``asked`` tokens; where that passes a cell's tokens, raked again under that bound."""
    scaled = fitted.withColumn("w", F.col("w") * F.lit(scale_for(fitted, min(asked, there) if fit else 0.0)))
    whole, over = scaled.agg(F.sum(F.least(F.col("tokens").cast("double"), F.col("w"))), F.sum(F.greatest(F.col("w") - F.col("tokens"), F.lit(0.0)))).first()
    if not whole or over <= 1e-9 * whole:
        return scaled
    again, fit, there = rake(cut(aimed(scaled, reachable(scaled, whole))), whole, close=1e-3, bounded=True)
    return again.withColumn("w", F.col("w") * F.lit(scale_for(again, min(asked, there) if fit else 0.0)))


def mixture(docs: DataFrame, share: float = 0.6, temper: float = 0.7, topics: int = 8, topic: str | None = None, targets: dict[str, DataFrame] | None = None, seed: int = 9) -> DataFrame:
    """``docs`` and a struct column of its cell, tokens, weight, probability and draw; the column is the last one."""
    (out, key) = fresh(docs, "mixture", "mixture_cell")
    if not 1 <= topics <= 2 * (BUCKETS - 1):
        raise ValueError(f"topics must be 1 to {2 * (BUCKETS - 1)}")
    tagged = docs.withColumn(out, F.struct(*[c.alias(n) for n, c in _features(docs, topic).items()]))
    narrow = cut(tagged.select(F.col(out).alias("cell")))  # some 150 bytes a document: the texts are read here and for the result
    if not topic:
        means = cut(language_means(narrow.select("cell.*")))
        tagged, narrow = (with_topic(x, name, means, topics) for x, name in ((tagged, out), (narrow, "cell")))
    cells = narrow.groupBy(*[F.col("cell")[d].alias(d) for d in DIMENSIONS]).agg(F.sum(F.col("cell")["tokens"]).alias("tokens"))
    cells, (total,) = cut_with(cells.withColumn("w", F.col("tokens").cast("double")), [F.sum("tokens")])
    targets = targets or {}
    own = tempered(cells, temper) if any(d not in targets for d in DIMENSIONS) else {}
    goals = {d: targets.get(d, own.get(d)) for d in DIMENSIONS}
    fitted, fit, there = rake(cut(aimed(cells, goals), instead_of=cells), float(total or 0))
    missed = residual(fitted, fit)
    drawn = bounded_fit(fitted.withColumn("fitted", F.col("w")), share * (total or 0), fit, there)
    weights = drawn.select(F.struct(*DIMENSIONS).alias(key), (F.col("fitted") / F.col("tokens")).alias(f"{key}_weight"), (F.col("w") / F.col("tokens")).alias(f"{key}_odds"))
    joined = tagged.withColumn(key, F.struct(*[F.col(out)[d].alias(d) for d in DIMENSIONS])).join(weights, key, "left")
    weight = F.coalesce(F.col(f"{key}_weight"), F.lit(0.0))
    probability = F.least(F.lit(1.0), F.coalesce(F.col(f"{key}_odds"), F.lit(0.0)))
    draw = F.xxhash64(F.lit(seed), id_or_least()).bitwiseAND((1 << 53) - 1) / F.lit(float(1 << 53))
    struct = F.struct(F.col(f"{out}.*"), weight.alias("weight"), probability.alias("probability"), (draw < probability).alias("sampled"), F.lit(missed).alias("residual"))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], struct.alias(out))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The documents of the sample."""
    tagged = mixture(docs, **options)
    return tagged.where(F.col(tagged.columns[-1])["sampled"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).select(
        "doc_id", "mixture.source", "mixture.lang", "mixture.topic", F.col("mixture.tokens").alias("n_tokens"), "mixture.weight", "mixture.probability", "mixture.sampled", "mixture.residual"
    )
