"""Mixing sources to target weights by temperature.

Source shares of the tokens are raised to an exponent between 0 (uniform) and 1
(as they are) and normalised; the exponent is bisected to meet a target entropy
or a limit on repetition.  A source's part of the token budget is realised as
whole passes over its documents and one partial pass.  A pass is a permutation
given by a hash: its leading digits are the blocks, which the budget takes in
order; only the block in which the budget ends is looked at document by document.
DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavepanel.llm.common import checked_broadcast, forget, let, materialise, packed, unpacked, words_of

STEPS = 40  # of the bisection: the exponent is exact to 2^-40
PARTS = 1_000_000_000  # weights are whole billionths
DIGITS = (3, 6)  # hex digits of the hash that name the coarse and the fine blocks: 4,096 each in the one above
STREAM_BLOCKS = 1024  # of the mixed stream
SEED = "wavepanel"
MAX_PASSES = 4.0  # repetition beyond about four passes is known to help little
ENTROPY_GAIN = 0.5  # of the way from the corpus's own entropy to the uniform one


def _key(source: Column, doc_id: Column, kind: str, seed: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), F.lit(kind), F.coalesce(source, F.lit("")), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def _bisect(sizes: Column, too_flat) -> Column:
    """The smallest exponent of [0, 1], to 2^-STEPS, that isn't too flat; 1 if all are."""
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def step(s, _):
        def half(mid):
            flat = too_flat(mid)
            return F.struct(F.when(flat, mid).otherwise(s["lo"]).alias("lo"), F.when(flat, s["hi"]).otherwise(mid).alias("hi"))

        return let((s["lo"] + s["hi"]) / 2, half)

    found = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)["hi"]
    return F.when(too_flat(F.lit(0.0)), found).otherwise(F.lit(0.0))


def solve_exponent(sizes: DataFrame, budget: Column, *, entropy_gain: float | None, target_entropy: float | None, max_passes: float | None) -> DataFrame:
    """One row: ``alpha`` and ``total``, the sum of all shares to that power.

    ``sizes`` has a row for each source with its ``tokens`` > 0.  Sources of one
    size share an entry of the array that is bisected over.
    """
    rows = sizes.groupBy("tokens").agg(F.count("*").alias("k"))
    one = rows.agg(F.sort_array(F.collect_list(F.struct("tokens", "k"))).alias("s"), F.sum(F.col("tokens") * F.col("k")).alias("t"))
    one = one.select(
        F.transform("s", lambda x: F.struct((x["tokens"].cast("double") / F.col("t").cast("double")).alias("p"), x["k"].cast("double").alias("k"))).alias("s"),
        "t",
    )

    def power_sum(s, a):
        return F.aggregate(s, F.lit(0.0), lambda acc, x: acc + x["k"] * F.pow(x["p"], a))

    def entropy(s, a):
        def of(z):
            def term(acc, x):
                return acc - x["k"] * (F.pow(x["p"], a) / z) * (a * F.log(x["p"]) - F.log(z))

            return F.aggregate(s, F.lit(0.0), term)

        return let(power_sum(s, a), of)

    def passes(s, a):  # of the smallest source, which is repeated most
        return F.pow(s[0]["p"], a - 1) / power_sum(s, a) * (budget.cast("double") / F.col("t").cast("double"))

    def of(s):
        wanted = [F.lit(0.0)]
        if target_entropy is not None:
            # the flattest exponent of at most the target: entropy falls as the exponent grows
            wanted.append(_bisect(s, lambda a: entropy(s, a) > F.lit(float(target_entropy))))
        if entropy_gain is not None:
            goal = entropy(s, F.lit(1.0)) + (entropy(s, F.lit(0.0)) - entropy(s, F.lit(1.0))) * F.lit(float(entropy_gain))
            wanted.append(let(goal, lambda g: _bisect(s, lambda a: entropy(s, a) > g)))
        if max_passes is not None:
            wanted.append(_bisect(s, lambda a: passes(s, a) > F.lit(float(max_passes))))
        return let(F.greatest(*wanted, F.lit(0.0)), lambda a: F.struct(a.alias("alpha"), power_sum(s, a).alias("total"), F.col("t").alias("tokens")))

    return one.where("size(s) > 0").select(let(F.col("s"), of).alias("x")).select("x.*")


def mix(
    docs: DataFrame,
    *,
    budget_tokens: int | None = None,
    entropy_gain: float | None = ENTROPY_GAIN,
    target_entropy: float | None = None,
    max_passes: float | None = MAX_PASSES,
    seed: str = SEED,
) -> DataFrame:
    """The rows of ``docs`` that the mixture takes, one row for each pass that takes them.

    Columns added: ``n_tokens`` (words of the text), ``weight_ppb`` (of the
    source, in billionths), ``mix_pass`` (0, 1, ...), ``mix_block`` (of
    ``STREAM_BLOCKS``) and ``mix_key``; columns of ``docs`` with these names are
    replaced.  The stream is the rows in order of ``mix_block, mix_key``; each
    block of it holds the sources by their weights, as far as chance allows.

    The budget is the corpus's own number of tokens unless given.  With several
    targets the least flat exponent holds.  A source gets floor(weight * budget)
    tokens: its partial pass ends before the first document that would exceed
    them.  Null sources are one source.  A source without tokens (null or empty
    texts only) has weight 0 and is not taken.  Rows of one source with one
    doc_id have one key: the partial pass takes all of them or none.  An empty
    table gives an empty table.
    """
    rows = packed(docs, ["n_tokens", "weight_ppb", "mix_pass", "mix_block", "mix_key"], "doc_id", "source", "text")
    key = _key(F.col("source"), F.col("doc_id"), "cut", seed)
    slim = materialise(rows.select("source", key.alias("_k"), F.size(words_of(F.col("text"))).cast("long").alias("n")), "mix-rows")
    # block sums: a hot source is summed in every task before the shuffle
    coarse = slim.groupBy("source", F.substring("_k", 1, DIGITS[0]).alias("b")).agg(F.sum("n").alias("n"))
    coarse = materialise(coarse, "mix-blocks")
    sizes = coarse.groupBy("source").agg(F.sum("n").alias("tokens")).where("tokens > 0")
    budget = F.lit(budget_tokens).cast("long") if budget_tokens is not None else F.col("t")
    solved = solve_exponent(sizes, budget, entropy_gain=entropy_gain, target_entropy=target_entropy, max_passes=max_passes).first()
    if solved is None:  # no tokens at all
        alpha, total, corpus = 1.0, 1.0, 1
    else:
        alpha, total, corpus = solved["alpha"], solved["total"], solved["tokens"]
    budget_tokens = corpus if budget_tokens is None else budget_tokens
    share = F.col("tokens").cast("double") / F.lit(float(corpus))
    weights = sizes.withColumn("weight_ppb", F.round(F.pow(share, F.lit(alpha)) / F.lit(total) * PARTS).cast("long"))
    due = F.floor(F.col("weight_ppb").cast("decimal(38,0)") * F.lit(budget_tokens).cast("decimal(20,0)") / F.lit(PARTS).cast("decimal(10,0)")).cast("long")
    weights = weights.withColumn("due", due)
    plan = materialise(
        weights.select("source", "tokens", "weight_ppb", F.expr("due div tokens").alias("full"), (F.col("due") % F.col("tokens")).alias("rest")), "mix-plan"
    )
    cut = _cut(slim, coarse, plan)
    cut = materialise(cut, "mix-cut")
    forget(slim, coarse)
    by_source = checked_broadcast(
        cut.select(F.col("source").alias("_source"), F.col("weight_ppb").alias("_w"), "full", "cut", F.expr("full + rest / tokens").alias("reps"))
    )
    joined = rows.withColumn("_k", key).join(by_source, F.col("source").eqNullSafe(F.col("_source")))
    last = F.col("full") - F.when(F.col("_k") <= F.col("cut"), 0).otherwise(1)  # nothing of the partial pass if cut is null
    taken = joined.withColumn("_last", last).where("_last >= 0")
    taken = taken.withColumn("mix_pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))))
    mix_key = F.when(
        F.col("mix_pass") == F.col("full"), F.col("_k")
    ).otherwise(F.md5(F.concat_ws("|", F.col("mix_pass").cast("string"), F.col("_k")).cast("binary")))
    place = F.conv(F.substring("mix_key", 1, 12), 16, 10).cast("double") / F.lit(float(16**12))
    block = F.least(F.floor((F.col("mix_pass") + place) / F.col("reps") * STREAM_BLOCKS), F.lit(STREAM_BLOCKS - 1))
    return unpacked(
        taken.withColumn("mix_key", mix_key),
        F.size(words_of(F.col("text"))).cast("long").alias("n_tokens"),
        F.col("_w").alias("weight_ppb"),
        F.col("mix_pass").cast("int").alias("mix_pass"),
        block.cast("int").alias("mix_block"),
        "mix_key",
    )


def _cut(slim: DataFrame, coarse: DataFrame, plan: DataFrame) -> DataFrame:
    """``plan`` with ``cut``: the last hash that the partial pass of a source takes, null if none.

    Three levels, each inside one block of the level above: the sums of 4,096
    coarse blocks, of 4,096 fine blocks, then the documents of one fine block.
    """

    def through(blocks: DataFrame, by: str) -> DataFrame:
        """Running sums in order of ``by``, ties together."""
        w = Window.partitionBy("source").orderBy(by).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        return blocks.withColumn("upto", F.sum("n").over(w))

    def boundary(blocks: DataFrame, left: DataFrame, by: str) -> DataFrame:
        """For each source its first block in which the rest is exceeded, and what is left before it."""
        met = through(blocks, by).join(left, blocks["source"].eqNullSafe(left["_s"])).where("upto > rest")
        first = met.groupBy("source").agg(F.min_by(F.struct(by, (F.col("rest") - F.col("upto") + F.col("n")).alias("rest")), by).alias("x"))
        return first.select(F.col("source").alias("_s"), F.col(f"x.{by}").alias("at"), F.col("x.rest").alias("rest"))

    left = plan.select(F.col("source").alias("_s"), "rest").where("rest > 0")
    top = boundary(coarse, left, "b")
    inside = slim.join(top, slim["source"].eqNullSafe(F.col("_s")) & (F.substring("_k", 1, DIGITS[0]) == F.col("at"))).select("source", "_k", "n")
    inside = materialise(inside, "mix-inside")
    fine = inside.groupBy("source", F.substring("_k", 1, DIGITS[1]).alias("b")).agg(F.sum("n").alias("n"))
    mid = boundary(fine, top.select("_s", "rest"), "b")
    last = inside.join(mid, inside["source"].eqNullSafe(F.col("_s")) & (F.substring("_k", 1, DIGITS[1]) == F.col("at"))).select("source", "_k", "n", "rest")
    fits = through(last, "_k").where("upto <= rest").groupBy("source").agg(F.max("_k").alias("doc_cut"))
    # where no document of the last fine block fits, the cut is just before that block
    ends = mid.join(fits, mid["_s"].eqNullSafe(fits["source"]), "left").select("_s", F.coalesce("doc_cut", F.col("at")).alias("cut"))
    return plan.join(ends, plan["source"].eqNullSafe(ends["_s"]), "left").select("source", "tokens", "weight_ppb", "full", "rest", "cut")
