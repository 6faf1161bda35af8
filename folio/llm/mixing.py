"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

Each source s has a mean repetition rate: weight(s) / sum of weights * total / rows(s). A document's
count is the Poisson quantile at a uniform number in [0, 1) derived from its id and a seed, so it
depends on nothing else: neither on the partitioning nor on other rows, and a lost task repeats it.
The documents are exploded by their counts and shuffled globally: sorted by a hash of id, seed and
copy number over range partitions, which a source of any size can't make uneven.

The expected number of rows of each source is its share of the total. Mixing draws rows by its
nature: a source that shall shrink has a rate below 1, and some of its documents get a count of 0.

Edge cases: a null source is a source of its own. A null id is hashed as an empty text, so all rows
of null id get one count. Repeated rows get the same count and the same keys. A source without a
given weight gets 0 when weights are given: it isn't wanted. Weights must be finite, not negative.
An empty table gives an empty result. Columns of docs named like ours (copy_no, n_copies, mix_key)
are replaced. Texts aren't looked at, so null, empty and long ones are alike.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.storage import saved

#: Hexadecimal digits of MD5 that make the uniform number: 52 bits, exact in a double.
DIGITS = 13
#: Largest rate whose zero-term exp(-rate) is far from underflow; larger rates are refused.
MAX_RATE = 600.0
#: Numbers in all sources' cumulative distributions (8 bytes each) up to which these are broadcast; beyond it they are joined by shuffle.
BROADCAST_NUMBERS = 4_000_000


def uniform(id_col: Column, seed: int) -> Column:
    """In [0, 1), from the id's decimal digits and the seed."""
    key = F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, DIGITS), 16, 10).cast("double") / F.lit(float(16**DIGITS))


def mix_key(id_col: Column, copy: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.coalesce(id_col.cast("string"), F.lit("")), F.lit(str(seed)), copy.cast("string")).cast("binary"))


def cumulative(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... up to where no double below 1 lies above."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct(F.exp(-rate).alias("term"), F.exp(-rate).alias("total"), F.array(F.exp(-rate)).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        term = acc["term"] * rate / k
        total = acc["total"] + term
        return F.struct(term.alias("term"), total.alias("total"), F.concat(acc["cdf"], F.array(total)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["cdf"])


def repetition_rates(docs: DataFrame, source_col: str, weights: dict | None = None, temperature: float = 2.0, total: float | None = None) -> DataFrame:
    """(source, n, rate). Without weights, a source weighs its number of rows to the power 1 / temperature."""
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(1.0 / temperature))
    else:
        if any(not (math.isfinite(w) and w >= 0) for w in weights.values()):
            raise ValueError("weights must be finite and not negative")
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    counts = counts.withColumn("weight", weight)
    counts = saved(counts, "mix-rates")
    all_weight, all_n = counts.agg(F.sum("weight"), F.sum("n")).first()
    whole = float(total if total is not None else all_n or 0)
    rate = F.col("weight") / F.lit(float(all_weight)) * F.lit(whole) / F.col("n") if all_weight else F.lit(0.0)
    return counts.select("source", "n", rate.alias("rate"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict | None = None, temperature: float = 2.0, total: float | None = None, seed: int = 17) -> DataFrame:
    """The columns of docs, with n_copies, copy_no (from 1) and mix_key, in the order of mix_key."""
    rates = repetition_rates(docs, source_col, weights, temperature, total)
    rates = rates.select(F.col("source").alias("_source"), F.when(F.col("rate") > MAX_RATE, F.raise_error(F.lit(f"a repetition rate is over {MAX_RATE}"))).otherwise(cumulative(F.col("rate"))).alias("_cdf"))
    rates = saved(rates, "mix-distributions")
    rates = F.broadcast(rates) if (rates.agg(F.sum(F.size("_cdf"))).first()[0] or 0) <= BROADCAST_NUMBERS else rates
    u = uniform(F.col(id_col), seed)
    named = docs.drop("copy_no", "n_copies", "mix_key")
    counted = named.join(rates, named[source_col].eqNullSafe(rates["_source"])).withColumn("n_copies", F.size(F.filter("_cdf", lambda c: c <= u)))
    copies = counted.where("n_copies > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("n_copies")))).drop("_source", "_cdf")
    return copies.withColumn("mix_key", mix_key(F.col(id_col), F.col("copy_no"), seed)).sort("mix_key")
