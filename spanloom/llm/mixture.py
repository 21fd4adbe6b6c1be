"""One mixture of several sources by target weights, with a cap on how often a document is repeated.

1. The contingency table: tokens by source, language and topic, as a list of the cells that occur. Every language and topic
   has a margin of its own, and so has a missing one.
2. Iterative proportional fitting: cell weights are raked to the sources' target shares, and to the languages' and
   topics' own shares, in turn, no cell beyond its tokens times the cap. The sources' margin is fitted last, and exactly. Up to
   MOST_CELLS cells are raked in arrays on the driver, more in joins on the cluster.
3. The copies of a document in a cell are the whole part of the cell's weight, and one more with the probability
   of the rest. The draw is a hash of the document's id, so that a repeated run gives the same mixture. The draw's threshold is
   calibrated per source on a histogram of tokens by draw, so that the tokens drawn, not just the expectation, meet the target.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.tokenizer import count_tokens
from spanloom.session import cut

#: Listed sources; the table of targets is small and fixed, more are an error.
MOST_SOURCES = 10_000
#: Cells that are raked on the driver; more are raked with joins.
MOST_CELLS = 500_000
#: Most rounds of fitting, and when it has settled, as a share of all tokens. What is left is reported as the residual.
ROUNDS, SETTLED = 200, 1e-9
#: Rounds of the fitting with joins, each of which is a few jobs.
JOINED_ROUNDS = 25
#: Bins of each of the two histograms of the draw; so many rows per listed source come to the driver at most.
BINS = 512
#: How much a margin may fall short of its target by rounding.
ROUNDING = 1e-9


@dataclass
class Mixture:
    """documents: doc_id, source, n_tokens, copies (> 0). report: one row per listed source. margins: one row per source, language
    and topic, what each was to get, what the fit gives and what the draw gave. residual: the greatest share of all tokens by which a fitted margin
    of languages or topics misses its goal, where caps and targets leave no table that meets them all."""

    documents: DataFrame
    report: DataFrame
    margins: DataFrame
    residual: float


def sized(documents: DataFrame, targets: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, source, lang, genre and n_tokens of the listed sources' documents; null texts count 0. Cut, as it is read often."""
    listed = F.broadcast(targets.where("source IS NOT NULL").select("source").distinct())  # MOST_SOURCES at most, see wanted_shares
    rows = documents.join(listed, "source", "left_semi").select("doc_id", "source", "lang", "genre", "text")
    return cut(count_tokens(rows, "text", "n_tokens", path).drop("text"))


def wanted_shares(targets: DataFrame) -> dict[str, tuple[float, int]]:
    """Each listed source's target share and cap, in the order of their names.

    Null and negative weights and repeats count as 0. A source listed twice counts with its largest weight and cap.
    """
    t = targets.where("source IS NOT NULL").groupBy("source").agg(F.max("target_weight").alias("w"), F.max("max_repeats").alias("r"))
    rows = t.limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources in a table of targets")
    weights = {r["source"]: max(0.0, r["w"] or 0.0) for r in rows}
    total = sum(weights.values())
    return {r["source"]: (weights[r["source"]] / total if total else 0.0, max(0, r["r"] or 0)) for r in sorted(rows, key=lambda r: r["source"])}


def fill(out: np.ndarray, most: np.ndarray, wanted: float) -> np.ndarray:
    """The cells of one source scaled so that they sum to `wanted`, none beyond `most`, those at their cap passing on what
    they can't take. If all at their caps are too little, that is the result."""
    if most.sum() <= wanted:
        return most.copy()
    out = np.where((out <= 0) & (most > 0), 1e-12 * max(wanted, 1.0), out)
    room = np.divide(most, out, out=np.zeros_like(most), where=out > 0)
    order = np.argsort(room, kind="stable")
    capped = np.concatenate([[0.0], np.cumsum(most[order])])[:-1]  # of the cells before each, at their caps
    free = np.cumsum(out[order][::-1])[::-1]  # of each and those behind it
    factor = np.divide(wanted - capped, free, out=np.full_like(free, np.inf), where=free > 0)
    at = int(np.flatnonzero(factor <= room[order])[0])
    return np.minimum(out * max(factor[at], 0.0), most)


def rake(source: np.ndarray, others: list[np.ndarray], cells: np.ndarray, wanted: np.ndarray, cap: np.ndarray) -> tuple[np.ndarray, float]:
    """Tokens wanted in each cell, by iterative proportional fitting, and the residual.

    source: each cell's source, as a place in `wanted` (tokens) and `cap`; others: each cell's place in the other margins, whose
    goals are their shares of `cells`. No cell gets more than its tokens times its source's cap. Sources are fitted last.
    """
    out, most = cells.astype(float), cells * cap[source].astype(float)
    own = [np.flatnonzero(source == s) for s in range(len(wanted))]
    able = np.array([min(w, most[at].sum()) for w, at in zip(wanted, own)])
    size, all_cells = able.sum(), max(cells.sum(), 1.0)
    goals = [np.bincount(o, cells) / all_cells * size if len(o) else np.zeros(0) for o in others]
    for _ in range(ROUNDS):
        before = out
        for o, goal in zip(others, goals):
            now = np.bincount(o, out, len(goal))
            f = np.divide(goal, now, out=np.ones_like(goal), where=now > 0)
            out = np.minimum(out * f[o], most)
        fitted = np.zeros_like(out)
        for s, at in enumerate(own):
            fitted[at] = fill(out[at], most[at], wanted[s])
        out = fitted
        if np.abs(out - before).sum() <= SETTLED * max(size, 1.0):
            break
    missed = [np.abs(np.bincount(o, out, len(g)) - g).max(initial=0.0) for o, g in zip(others, goals)]
    return out, float(max(missed, default=0.0) / max(size, 1.0))


def rake_joined(cells: DataFrame, wanted: DataFrame, total: float) -> tuple[DataFrame, float]:
    """The same on tables of any number of cells. cells: s, l, g, n; wanted: s, target, cap. Result: cells with `fitted`.

    Margins of languages and topics are joined, sources are few and broadcast. A source's cells at their caps pass on what they can't
    take in one step a round, so that the sources' margin is met more closely with each round; a last fill is exact to rounding.
    """
    rows = cells.join(F.broadcast(wanted), "s").withColumn("most", F.col("n") * F.col("cap"))
    rows = cut(rows.withColumn("fitted", F.col("n").cast("double")))
    able = rows.groupBy("s").agg(F.least(F.max("target"), F.sum("most")).alias("able"))
    size = able.agg(F.sum("able")).first()[0] or 0.0
    scale = size / max(total, 1.0)

    def by_source(rows: DataFrame, times: int) -> DataFrame:
        for _ in range(times):
            full = F.col("fitted") >= F.col("most")
            sums = rows.groupBy("s").agg(F.sum(F.when(full, F.col("most")).otherwise(0.0)).alias("held"), F.sum(F.when(~full, F.col("fitted")).otherwise(0.0)).alias("free"))
            f = F.when(F.col("free") > 0, F.greatest(F.lit(0.0), F.col("target") - F.col("held")) / F.nullif(F.col("free"), F.lit(0.0))).otherwise(1.0)
            # with all of it beyond the target, those at their caps shrink too
            over = F.col("held") > F.col("target")
            part = F.when(over, F.col("fitted") * F.col("target") / F.nullif(F.col("held") + F.col("free"), F.lit(0.0))).when(full, F.col("most")).otherwise(F.least(F.col("fitted") * f, F.col("most")))
            rows = rows.join(F.broadcast(sums), "s").withColumn("fitted", part).drop("held", "free")
        return rows

    for _ in range(JOINED_ROUNDS):
        for name in ("l", "g"):
            sums = rows.groupBy(name).agg((F.sum("n") * scale / F.nullif(F.sum("fitted"), F.lit(0.0))).alias("f"))
            rows = rows.join(sums, name).withColumn("fitted", F.least(F.col("fitted") * F.coalesce("f", F.lit(1.0)), F.col("most"))).drop("f")
        rows = cut(by_source(rows, 2))
    rows = cut(by_source(rows, 6))
    missed = 0.0
    for name in ("l", "g"):
        gap = F.abs(F.sum("fitted") - F.sum("n") * scale)
        missed = max(missed, rows.groupBy(name).agg(gap.alias("d")).agg(F.max("d")).first()[0] or 0.0)
    return rows.select("s", "l", "g", "n", "fitted"), missed / max(size, 1.0)


def _label(column: str) -> Column:
    """A value of a margin as a key that is never null: missing values are one of their own, beside all that are there."""
    return F.coalesce(F.concat(F.lit("="), F.col(column)), F.lit(""))


def _value(column: str) -> Column:
    return F.when(F.col(column) != "", F.substring(F.col(column), 2, 1 << 30))


def mix(documents: DataFrame, targets: DataFrame, path: str | None = None, seed: int = 17) -> Mixture:
    """The mixture of the listed sources' documents. Its size is that of all their tokens; a source whose fitted margin is
    less than its target even with all its cells at their caps is short, and gives all it may. Documents without tokens are never
    drawn. Languages and topics may be null, which is a value of theirs.
    """
    spark = documents.sparkSession
    shares = wanted_shares(targets)
    names = list(shares)
    place = {x: i for i, x in enumerate(names)}
    rows = sized(documents, targets, path).select("doc_id", "source", "n_tokens", _label("lang").alias("l"), _label("genre").alias("g"))
    table = rows.groupBy(F.col("source").alias("s"), "l", "g").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("d"))
    few = table.limit(MOST_CELLS + 1).collect()
    cap = np.array([float(shares[x][1]) for x in names])
    if len(few) <= MOST_CELLS:
        source = np.array([place[r["s"]] for r in few], np.int64)
        n = np.array([r["n"] for r in few], float)
        size, held = np.bincount(source, n, len(names)), np.bincount(source, [r["d"] for r in few], len(names))
        target = np.array([shares[x][0] for x in names]) * size.sum()
        others = [np.unique([r[m] for r in few], return_inverse=True)[1].astype(np.int64) for m in ("l", "g")] if few else []
        fitted, residual = rake(source, others, n, target, cap)
        margin = np.bincount(source, fitted, len(names))
        known = [(r["s"], r["l"], r["g"], int(r["n"]), float(f)) for r, f in zip(few, fitted)]
        cells = F.broadcast(spark.createDataFrame(known, "s string, l string, g string, n bigint, fitted double"))  # MOST_CELLS at most
    else:
        per = {r["s"]: r for r in table.groupBy("s").agg(F.sum("n").alias("n"), F.sum("d").alias("d")).collect()}
        size = np.array([float(per[x]["n"]) if x in per else 0.0 for x in names])
        held = np.array([per[x]["d"] if x in per else 0 for x in names])
        target = np.array([shares[x][0] for x in names]) * size.sum()
        wanted = spark.createDataFrame([(x, float(target[i]), float(cap[i])) for x, i in place.items()], "s string, target double, cap double")
        cells, residual = rake_joined(table.drop("d"), wanted, float(size.sum()))
        got = {r["s"]: r["f"] for r in cells.groupBy("s").agg(F.sum("fitted").alias("f")).collect()}
        margin = np.array([got.get(x, 0.0) for x in names])
    total = float(size.sum())
    weight = F.coalesce(F.col("fitted") / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0))
    drawn = rows.where("n_tokens > 0").join(cells.select(F.col("s").alias("source"), "l", "g", weight.alias("weight")), ["source", "l", "g"])
    chosen = _drawn(drawn, dict(zip(names, margin)), seed)
    # what came out, by source and by the other margins
    got = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"), F.sum("copies").cast("bigint").alias("copies"), F.max("copies").alias("most_repeats"))
    listed = [(x, shares[x][0], shares[x][1], int(size[i]), int(held[i]), float(target[i]), float(margin[i]), bool(margin[i] < target[i] * (1 - ROUNDING))) for x, i in place.items()]
    per_source = spark.createDataFrame(listed, "source string, target_share double, max_repeats int, size bigint, documents bigint, target double, fitted double, is_short boolean")
    joined = per_source.join(F.broadcast(got), "source", "left")  # a row per listed source
    tokens = F.coalesce("mixed_tokens", F.lit(0))
    every = F.sum(tokens).over(W.partitionBy())
    report = joined.select(
        "source", "target_share", "max_repeats", "size", "documents", tokens.alias("mixed_tokens"), F.coalesce("copies", F.lit(0)).alias("copies"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), F.coalesce(tokens / F.nullif(every, F.lit(0)), F.lit(0.0)).alias("actual_share"), (tokens / F.lit(total or 1.0)).alias("share_of_goal"), "is_short",
    )
    margins = per_source.join(F.broadcast(got), "source", "left").select(F.lit("source").alias("margin"), F.col("source").alias("value"), F.col("target").alias("wanted"), "fitted", tokens.alias("mixed_tokens"))
    scale = F.lit(float(margin.sum()) / total if total else 0.0)
    for name, column in (("language", "l"), ("topic", "g")):
        fit = cells.groupBy(column).agg((F.sum("n") * scale).alias("wanted"), F.sum("fitted").alias("fitted"))
        out = chosen.groupBy(column).agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"))
        margins = margins.unionByName(fit.join(out, column, "left").select(F.lit(name).alias("margin"), _value(column).alias("value"), "wanted", "fitted", tokens.alias("mixed_tokens")))
    return Mixture(chosen.drop("l", "g"), report, margins, residual)


def _drawn(rows: DataFrame, wanted: dict[str, float], seed: int) -> DataFrame:
    """Sequential Poisson sampling: a document gets one more copy if its uniform draw, over its probability, is under its source's threshold.

    The threshold is found on a coarse histogram of ranks, and then on a fine one within the bin that meets the target.
    Ranks r are spread as r / (1 + r), which has no end bin.
    """
    spark = rows.sparkSession
    uniform = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    rows = rows.withColumn("whole", F.floor("weight")).withColumn("part", F.col("weight") - F.col("whole"))
    scaled = F.when(F.col("part") > 0, uniform / (uniform + F.col("part"))) * BINS
    coarse = F.least(F.floor(scaled), F.lit(BINS - 1)).cast("int")
    fine = F.least(F.floor((scaled - coarse) * BINS), F.lit(BINS - 1)).cast("int")
    rows = rows.withColumn("bin", coarse).withColumn("cell", fine)
    missing = dict(wanted)
    totals: dict[str, list] = {}
    for r in rows.groupBy("source", "bin").agg(F.sum("n_tokens").alias("n"), F.sum(F.col("n_tokens") * F.col("whole")).alias("sure")).collect():
        missing[r["source"]] -= float(r["sure"])
        if r["bin"] is not None:
            totals.setdefault(r["source"], []).append((r["bin"], r["n"]))
    crossing, before = {}, {}
    for source, bins in totals.items():
        run = 0.0
        for b, n in sorted(bins):
            crossing[source], before[source] = b, run
            run += n
            if run >= missing[source]:
                break
    at = F.broadcast(spark.createDataFrame(list(crossing.items()), "source string, edge int"))
    inner: dict[str, list] = {}
    for r in rows.join(at, "source").where("bin = edge").groupBy("source", "cell").agg(F.sum("n_tokens").alias("n")).collect():
        inner.setdefault(r["source"], []).append((r["cell"], r["n"]))
    limits = []
    for source, b in crossing.items():
        run = before[source]
        best, last = abs(missing[source] - run), -1
        for c, n in sorted(inner.get(source, [])):
            run += n
            if abs(missing[source] - run) < best:
                best, last = abs(missing[source] - run), c
        limits.append((source, b, last))
    edges = F.broadcast(spark.createDataFrame(limits, "source string, edge int, last_cell int"))
    taken = (F.col("bin") < F.col("edge")) | (F.col("bin") == F.col("edge")) & (F.col("cell") <= F.col("last_cell"))
    copies = (F.col("whole") + F.when(taken, 1).otherwise(0)).cast("int")
    return rows.join(edges, "source", "left").select("doc_id", "source", "n_tokens", copies.alias("copies"), "l", "g").where("copies > 0")
