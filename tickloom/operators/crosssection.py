"""Covariance structure and allocation over a chosen set of names.

The reduction over time is the heavy part: the N-by-N product is cut into tiles,
and each task adds up one tile over blocks of sessions.  What is left is a table
with a row per pair, where N is the number of names the caller chose; trees and
orders over it are Spark rounds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators.performance import product, sharpe
from tickloom.session import checkpointed
from tickloom.sizing import small

CLUSTER_CUT = 0.5
ILL_CONDITIONED = 1e6
CONCENTRATED = 0.3
MIN_SESSIONS = 60
TINY = 1e-300


def chosen(names: DataFrame, count: int) -> DataFrame:
    """Chosen symbols with their column number; more than ``count`` are refused, not cut."""
    listed = names.select("symbol").distinct()
    if listed.limit(count + 1).count() > count:
        raise ValueError(f"more than {count} names chosen")
    return listed.withColumn("idx", F.row_number().over(W.orderBy("symbol")) - 1)


def session_vectors(returns: DataFrame, names: DataFrame) -> DataFrame:
    """One vector per session with a return for every chosen name, 0 if missing."""
    tagged = returns.join(F.broadcast(names), "symbol").where(F.col("ret").isNotNull())
    cells = tagged.groupBy("event_time").agg(
        F.map_from_entries(F.collect_list(F.struct("idx", "ret"))).alias("_m")  # one per chosen name
    )
    last = names.agg(F.max("idx")).scalar()
    fill = F.transform(
        F.sequence(F.lit(0), F.col("_last")), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0))
    )
    return cells.withColumn("_last", last).select("event_time", fill.alias("vector"))


_MOMENTS = ("n", "s1_i", "s1_j", "s2_i", "s2_j", "a", "b_ij", "b_ji", "c")
#: Columns of a tile of the product, and sessions of a strip and of one partial sum.
TILE, STRIP, PARTIAL = 256, 512, 8192


def moment_table(returns: DataFrame, names: DataFrame, tile: int = TILE, strip: int = STRIP, partial: int = PARTIAL) -> DataFrame:
    """Sums of products of every pair of chosen names, ``(i, j, moments...)``.

    A session counts if any chosen name has a return in it; a name without one counts 0 there.
    The product is cut into tiles of ``tile`` by ``tile`` pairs.  Sessions are cut into strips, a
    strip of a block of names goes to the tiles that need it, and a task adds up one tile over at
    most ``partial`` sessions, so it never holds more than that tile and two strips.
    """
    tagged = returns.join(small(names.select("symbol", "idx"), names.count()), "symbol").where(F.col("ret").isNotNull())
    # one row per session
    sessions = checkpointed(
        tagged.select("event_time").distinct().withColumn("_s", F.row_number().over(W.orderBy("event_time")) - 1)
    )
    n, blocks = sessions.count(), -(-names.count() // tile)
    row = lambda c: F.col(c).cast("int")
    placed = tagged.join(small(sessions, n), "event_time").select(
        row("_s").alias("s"), F.floor(F.col("idx") / tile).cast("int").alias("block"), F.pmod("idx", F.lit(tile)).cast("int").alias("col"), "ret"
    )
    strips = placed.groupBy(F.floor(F.col("s") / strip).cast("int").alias("strip"), "block").agg(
        F.collect_list(F.struct("s", "col", "ret")).alias("cells")
    )
    other = F.explode(F.sequence(F.lit(0), F.lit(max(blocks - 1, 0)))).alias("other")
    dealt = strips.select("strip", "block", "cells", other).select(
        F.least("block", "other").alias("p"),
        F.greatest("block", "other").alias("q"),
        F.floor(F.col("strip") * strip / partial).cast("int").alias("part"),
        "strip",
        "block",
        F.transform("cells", lambda x: F.pmod(x.s, F.lit(strip)).cast("int")).alias("at"),
        F.transform("cells", lambda x: x.col).alias("col"),
        F.transform("cells", lambda x: x.ret).alias("ret"),
    )
    schema = "i int, j int, " + ", ".join(f"{m} double" for m in _MOMENTS[1:])

    def multiply(key: tuple, table: pa.Table) -> pa.Table:
        p, q, _ = (k.as_py() for k in key)
        strips: dict[int, dict[int, np.ndarray]] = {}
        for number, block, *cells in zip(*(table.column(c).to_pylist() for c in ("strip", "block")), *(table.column(c).combine_chunks() for c in ("at", "col", "ret"))):
            dense = np.zeros((strip, tile))
            at, col, ret = (c.values.to_numpy(zero_copy_only=False) for c in cells)
            dense[at, col] = ret
            strips.setdefault(number, {})[block] = dense
        sums = [np.zeros(tile) for _ in range(4)] + [np.zeros((tile, tile)) for _ in range(4)]
        none = np.zeros((strip, tile))
        for some in strips.values():
            x, y = some.get(p, none), some.get(q, none)
            xx, yy = x * x, y * y
            for total, more in zip(sums, (x.sum(0), y.sum(0), xx.sum(0), yy.sum(0), x.T @ y, xx.T @ y, x.T @ yy, xx.T @ yy)):
                total += more
        si, sj, qi, qj, a, b, b_turned, c = sums
        i, j = (g.ravel() for g in np.indices((tile, tile)))
        one = (i + p * tile, j + q * tile, si[i], sj[j], qi[i], qj[j], a.ravel(), b.ravel(), b_turned.ravel(), c.ravel())
        turned = [one[k] for k in (1, 0, 3, 2, 5, 4, 6, 8, 7, 9)]
        columns = one if p == q else [np.concatenate(pair) for pair in zip(one, turned)]
        kinds = [pa.int32()] * 2 + [pa.float64()] * 8
        return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], names=["i", "j", *_MOMENTS[1:]])

    cells = dealt.groupBy("p", "q", "part").applyInArrow(multiply, schema)
    if n > partial:
        cells = cells.groupBy("i", "j").agg(*[F.sum(m).alias(m) for m in _MOMENTS[1:]])
    # the last block may be wider than the names
    size = names.count()
    return cells.where((F.col("i") < size) & (F.col("j") < size)).select("i", "j", F.lit(float(n)).alias("n"), *_MOMENTS[1:])


def sample_covariance(moments: DataFrame) -> DataFrame:
    """Covariance with one degree of freedom removed."""
    n = F.col("n")
    return moments.select("i", "j", ((F.col("a") - F.col("s1_i") * F.col("s1_j") / n) / (n - 1)).alias("value"))


def ledoit_wolf(moments: DataFrame) -> DataFrame:
    """Covariance shrunk to a constant correlation, with the intensity.

    Every quantity is a sum over pairs of the moment table.
    """
    c = F.col
    n = c("n")
    mi, mj = c("s1_i") / n, c("s1_j") / n
    centred = c("a") / n - mi * mj
    fourth = (
        c("c") - 2 * mj * c("b_ij") + mj * mj * c("s2_i") - 2 * mi * c("b_ji") + 4 * mi * mj * c("a")
        - 2 * mi * mj * mj * c("s1_i") + mi * mi * c("s2_j") - 2 * mi * mi * mj * c("s1_j") + n * mi * mi * mj * mj
    ) / n
    cells = moments.select(
        "i",
        "j",
        n.alias("n"),
        centred.alias("s"),
        (fourth - centred * centred).alias("phi"),
        F.sqrt(F.greatest(c("s2_i") / n - mi * mi, F.lit(TINY))).alias("di"),
        F.sqrt(F.greatest(c("s2_j") / n - mj * mj, F.lit(TINY))).alias("dj"),
    )
    # the target and its distance are polynomials in the mean correlation, so one aggregate holds all of them
    off = c("i") != c("j")
    scale = c("di") * c("dj")
    only = lambda x: F.coalesce(F.sum(F.when(off, x)), F.lit(0.0))
    totals = cells.agg(
        F.coalesce(F.avg(F.when(off, c("s") / scale)), F.lit(0.0)).alias("_rho"),
        F.sum("phi").alias("_phi"),
        only(scale * scale).alias("_tt"),
        only(scale * c("s")).alias("_ts"),
        only(c("s") * c("s")).alias("_ss"),
        F.max("n").alias("_n"),
    )
    gamma = c("_rho") * c("_rho") * c("_tt") - 2 * c("_rho") * c("_ts") + c("_ss")
    raw = F.try_divide(c("_phi"), gamma * c("_n"))
    intensity = F.when(gamma > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))).otherwise(0.0)
    aimed = cells.join(F.broadcast(totals.select("_rho", intensity.alias("intensity"))), F.lit(True))  # one row
    target = F.when(off, c("_rho") * scale).otherwise(c("s"))
    return aimed.select("i", "j", (c("intensity") * target + (1 - c("intensity")) * c("s")).alias("value"), "intensity")


def correlation(covariance: DataFrame) -> DataFrame:
    """Correlation of a covariance table, clipped, with a unit diagonal."""
    own = covariance.where("i = j").select("i", F.sqrt(F.greatest("value", F.lit(TINY))).alias("_di"))
    names = own.count()
    df = covariance.select("i", "j", "value").join(small(own, names), "i").join(small(own.toDF("j", "_dj"), names), "j")
    rho = F.col("value") / (F.col("_di") * F.col("_dj"))
    value = F.when(F.col("i") == F.col("j"), 1.0).otherwise(F.least(F.greatest(rho, F.lit(-1.0)), F.lit(1.0)))
    return df.select("i", "j", value.alias("value"))


def effective_bets(corr: DataFrame) -> DataFrame:
    """N squared over the sum of squared correlations (positive semi-definite)."""
    n = F.count_if(F.col("i") == F.col("j"))
    off = F.avg(F.when(F.col("i") != F.col("j"), F.col("value")))
    return corr.agg(
        n.alias("names"),
        F.try_divide(n * n, F.sum(F.col("value") * F.col("value"))).alias("effective_bets"),
        F.coalesce(off, F.lit(0.0)).alias("mean_correlation"),
    )


def distances(corr: DataFrame) -> DataFrame:
    """Correlation distance of every pair."""
    gap = F.sqrt(F.greatest((1 - F.col("value")) / 2, F.lit(0.0)))
    return corr.select("i", "j", F.when(F.col("i") == F.col("j"), 0.0).otherwise(gap).alias("distance"))


def clusters(corr: DataFrame, cut: float = CLUSTER_CUT) -> DataFrame:
    """Single-linkage clusters at ``cut``: connected components of close pairs.

    Labels spread to the smallest reachable member; each round also jumps to
    the label's own label, so the rounds grow with the log of a chain.
    """
    edges = checkpointed(distances(corr).where(F.col("distance") <= cut).select("i", "j"))
    labels = edges.groupBy("i").agg(F.min("j").alias("label"))
    moved = 1
    while moved:  # labels only fall, so this ends
        near = edges.join(labels.select(F.col("i").alias("j"), F.col("label").alias("_l")), "j")
        best = near.groupBy("i").agg(F.min("_l").alias("label"))
        jump = best.join(labels.select(F.col("i").alias("label"), F.col("label").alias("_up")), "label")
        new = checkpointed(jump.select("i", F.least("label", "_up").alias("label")))
        moved = new.join(labels.withColumnRenamed("label", "_old"), "i").where("label <> _old").limit(1).count()
        labels = new
    return labels


def spanning_tree(corr: DataFrame) -> DataFrame:
    """The minimum spanning tree of the correlation distances, ``(i, j, distance)`` with i < j.

    Boruvka rounds: every component takes its least outgoing edge, and the components that these
    edges join become one; their number at least halves.  Edges are ordered by distance (to twelve
    decimals), i and j, so ties have one answer.  Only a row per name is broadcast.
    """
    edges = checkpointed(distances(corr).where("i < j").withColumn("distance", F.round("distance", 12)))
    labels = checkpointed(corr.where("i = j").select("i", F.col("i").alias("label")))
    names = labels.count()
    tree = None
    while True:
        here, there = (small(labels.select(F.col("i").alias(c), F.col("label").alias(f"_{c}")), names) for c in "ij")
        out = edges.join(here, "i").join(there, "j").where("_i <> _j")
        edge = F.struct("distance", "i", "j")
        both = out.select(F.explode(F.array(F.struct(F.col("_i").alias("own"), F.col("_j").alias("to")), F.struct(F.col("_j").alias("own"), F.col("_i").alias("to")))).alias("_e"), edge.alias("edge"))
        least = both.groupBy("_e.own").agg(F.min("edge").alias("edge"), F.min_by("_e.to", "edge").alias("to"))
        picks = checkpointed(least)
        if picks.isEmpty():
            break
        found = picks.select("edge.i", "edge.j", "edge.distance").distinct()
        tree = found if tree is None else tree.unionByName(found)
        labels = checkpointed(_contracted(labels, picks.select("own", "to"), names))
    return tree if tree is not None else edges.limit(0).select("i", "j", "distance")


def _contracted(labels: DataFrame, picks: DataFrame, names: int) -> DataFrame:
    """New labels once every component hangs below the one that its least edge leads to."""
    back = picks.select(F.col("own").alias("to"), F.col("to").alias("_back"))
    # the only cycles are two components that chose one edge; the smaller label is the root
    root = (F.col("_back") == F.col("own")) & (F.col("own") < F.col("to"))
    up = checkpointed(picks.join(small(back, names), "to").select("own", F.when(root, F.col("own")).otherwise(F.col("to")).alias("to")))
    while True:
        above = small(up.select(F.col("own").alias("to"), F.col("to").alias("_up")), names)
        new = checkpointed(up.join(above, "to").select("own", F.col("_up").alias("to"), (F.col("_up") != F.col("to")).alias("_moved")))
        up = new.select("own", "to")
        if new.where("_moved").isEmpty():
            break
    return labels.join(small(up.select(F.col("own").alias("label"), "to"), names), "label").select("i", F.col("to").alias("label"))


def leaf_order(tree: DataFrame) -> DataFrame:
    """Leaves of the single-linkage tree, the older branch of a merge first: ``(i, position)``.

    The merges of single linkage are the edges of the spanning tree, short ones first; a branch is as
    old as its last merge, and a single name is older than any merge.  The input has one edge less
    than there are names, and is merged in one task.
    """

    def order(edges: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(edges["distance"], edges["i"], edges["j"]))
        up = {int(i): int(i) for _, *ends in rows for i in ends}
        # of each root: age, first and last leaf; of each leaf: the next one
        branch, follows = {i: (i, i, i) for i in up}, {}

        def root(i: int) -> int:
            while up[i] != i:
                up[i] = i = up[up[i]]
            return i

        for born, (_, a, b) in enumerate(rows, len(up)):
            a, b = sorted((root(int(a)), root(int(b))), key=lambda x: branch[x][0])
            follows[branch[a][2]] = branch[b][1]
            up[b], branch[a] = a, (born, branch[a][1], branch[b][2])
        leaves, at = [], branch[root(next(iter(up)))][1] if up else None
        while at is not None:
            leaves.append(at)
            at = follows.get(at)
        return pd.DataFrame({"i": leaves, "position": range(len(leaves))}, dtype="int32")

    return tree.withColumn("_k", F.lit(0)).groupBy("_k").applyInPandas(order, "i int, position int")


def hierarchical_weights(covariance: DataFrame, order: DataFrame) -> DataFrame:
    """Hierarchical risk parity over a leaf order, ``(i, weight_hrp)``.

    The ordered names are halved again and again; every half gets a share by the variance of the other
    half under inverse-variance weights.  Which halves a name lies in follows from its position alone,
    so the variances of all halves of all levels are one aggregate over the covariance cells.
    """
    variance = F.greatest(F.col("value"), F.lit(TINY))
    names = order.count()
    levels = max(1, (names - 1).bit_length())
    state = "struct<b:int,e:int,path:array<struct<parent:int,stop:int,b:int,e:int>>>"

    def halve(at, _):
        middle = (at.b + F.floor((at.e - at.b) / 2)).cast("int")
        first = F.col("position") < middle
        b, e = F.when(first, at.b).otherwise(middle), F.when(first, middle).otherwise(at.e)
        step = F.struct(at.b.alias("parent"), at.e.alias("stop"), b.alias("b"), e.alias("e"))
        down = F.struct(b.alias("b"), e.alias("e"), F.concat(at.path, F.array(step)).alias("path")).cast(state)
        return F.when(at.e - at.b > 1, down).otherwise(at)

    start = F.struct(F.lit(0).alias("b"), F.lit(names).alias("e"), F.array().alias("path")).cast(state)
    paths = order.select("i", F.aggregate(F.sequence(F.lit(1), F.lit(levels)), start, halve, lambda at: at.path).alias("path"))
    known = checkpointed(paths.join(covariance.where("i = j").select("i", (1 / variance).alias("share")), "i"))
    side = lambda c: small(known.select(F.col("i").alias(c), F.col("path").alias(f"_p{c}"), F.col("share").alias(f"_w{c}")), names, 512)
    shared = F.filter("_pi", lambda x, k: F.get(F.col("_pj"), k) == x)
    cells = covariance.join(side("i"), "i").join(side("j"), "j")
    risks = cells.select(F.explode(shared).alias("half"), (F.col("value") * F.col("_wi") * F.col("_wj")).alias("v")).groupBy("half").agg(F.sum("v").alias("v"))
    flat = known.select(F.explode("path").alias("half"), "share").groupBy("half").agg(F.sum("share").alias("w"))
    halves = risks.join(flat, "half").withColumn("risk", F.col("v") / (F.col("w") * F.col("w")))
    first = F.col("half.b") == F.col("half.parent")
    pairs = halves.groupBy("half.parent", "half.stop").agg(F.max(F.when(first, F.col("risk"))).alias("l"), F.max(F.when(~first, F.col("risk"))).alias("r"))
    l, r = F.col("l"), F.col("r")
    part = F.when(l + r > 0, r / F.when(l + r > 0, l + r)).otherwise(0.5)
    parts = small(pairs.select("parent", "stop", part.alias("first")), names)
    steps = known.select("i", F.explode("path").alias("half")).select("i", "half.parent", "half.stop", (F.col("half.b") == F.col("half.parent")).alias("is_first"))
    weights = steps.join(parts, ["parent", "stop"]).groupBy("i").agg(F.product(F.when(F.col("is_first"), F.col("first")).otherwise(1 - F.col("first"))).alias("weight_hrp"))
    total = weights.agg(F.sum("weight_hrp").alias("_t"))
    return weights.join(F.broadcast(total), F.lit(True)).select("i", (F.col("weight_hrp") / F.col("_t")).alias("weight_hrp"))


def inverse_variance(covariance: DataFrame) -> DataFrame:
    share = 1 / F.greatest(F.col("value"), F.lit(TINY))
    diagonal = covariance.where("i = j").select("i", share.alias("_w"))
    return diagonal.select("i", (F.col("_w") / F.sum("_w").over(W.partitionBy(F.lit(0)))).alias("weight"))


def _dense(frame: pd.DataFrame) -> np.ndarray:
    k = int(frame["i"].max()) + 1
    out = np.zeros((k, k))
    out[frame["i"].to_numpy(), frame["j"].to_numpy()] = frame["value"].to_numpy()
    return out


def _erc(matrix: np.ndarray, tolerance: float = 1e-12) -> np.ndarray:
    """Equal risk contributions by cyclical coordinate descent.

    The weights minimise half the variance less the mean log weight; in one
    coordinate that is the positive root of a quadratic.  The objective falls
    with every step, so sweeps go on until it no longer does.
    """
    k = len(matrix)
    own = np.maximum(np.diag(matrix), TINY)
    x = 1 / np.sqrt(own * k)
    pull = matrix @ x
    before = np.inf
    while (value := x @ pull / 2 - np.log(x).mean()) < before - tolerance * max(1.0, abs(value)):
        before = value
        for i in range(k):
            rest = pull[i] - own[i] * x[i]
            new = (np.sqrt(rest * rest + 4 * own[i] / k) - rest) / (2 * own[i])
            pull += matrix[:, i] * (new - x[i])
            x[i] = new
    return x / x.sum()


def equal_risk(covariance: DataFrame, key: str | None = None) -> DataFrame:
    """Equal risk contributions and the condition number, a dense matrix of the chosen names per key."""
    tagged = covariance if key else covariance.withColumn("_k", F.lit(0))
    group = key or "_k"
    kind = dict((f.name, f.dataType) for f in tagged.schema)[group]
    schema = T.StructType(
        [T.StructField(group, kind), T.StructField("i", T.IntegerType())]
        + [T.StructField(c, T.DoubleType()) for c in ("weight_erc", "condition_number")]
    )

    def run(name: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        matrix = _dense(frame)
        values = np.abs(np.linalg.eigvalsh(matrix))
        condition = float(values.max() / values.min()) if values.min() > 0 else float("inf")
        out = pd.DataFrame({"i": range(len(matrix)), "weight_erc": _erc(matrix)})
        out.insert(0, group, name[0])
        return out.assign(condition_number=condition)

    made = tagged.select(group, "i", "j", "value").groupBy(group).applyInPandas(run, schema)
    return made if key else made.drop("_k")


def allocations(covariance: DataFrame) -> DataFrame:
    """Risk-parity weights of a covariance table, ``(i, weight_erc, weight_hrp, condition_number)``."""
    order = checkpointed(leaf_order(spanning_tree(correlation(covariance))))
    single = covariance.where("i = 0 and j = 0").select("i").join(order.select("i").limit(1), F.lit(True), "left_anti")
    lone = single.select("i", F.lit(1.0).alias("weight_hrp"))
    return equal_risk(covariance).join(hierarchical_weights(covariance, order).unionByName(lone), "i").select("i", "weight_erc", "weight_hrp", "condition_number")


def diversification(covariance: DataFrame, weights: DataFrame, weight: str) -> DataFrame:
    """Weighted volatility over portfolio volatility."""
    wi = weights.select("i", F.col(weight).alias("wi"))
    wj = weights.select(F.col("i").alias("j"), F.col(weight).alias("wj"))
    cells = covariance.join(F.broadcast(wi), "i").join(F.broadcast(wj), "j")
    own = F.sum(F.when(F.col("i") == F.col("j"), F.col("wi") * F.sqrt(F.greatest("value", F.lit(0.0)))))
    book = F.sqrt(F.greatest(F.sum(F.col("wi") * F.col("wj") * F.col("value")), F.lit(0.0)))
    return cells.agg(F.when(book > 0, F.try_divide(own, book)).otherwise(1.0).alias("diversification_ratio"))


def concentration(effective: Column, names: Column) -> Column:
    """Fewer independent bets than a third of the names."""
    return F.try_divide(effective, names) < CONCENTRATED


def name_statistics(vectors: DataFrame, names: DataFrame, periods: int = 252) -> DataFrame:
    """Return, volatility, Sharpe, beta and correlation to the equal-weight market."""
    size = F.size("vector")
    market = F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x) / size
    long = vectors.select("event_time", market.alias("m"), F.posexplode("vector").alias("idx", "ret"))
    r, m = F.col("ret"), F.col("m")
    cov, vr, vm = F.covar_samp(r, m), F.var_samp(r), F.var_samp(m)
    stats = long.groupBy("idx").agg(
        F.count(F.lit(1)).alias("sessions"),
        (product(1 + r) - 1).alias("total_return"),
        (F.stddev_samp(r) * periods**0.5).alias("annual_volatility"),
        sharpe(r, periods=periods).alias("sharpe"),
        F.when(vm > 0, F.try_divide(cov, vm)).otherwise(0.0).alias("beta"),
        F.when((vm > 0) & (vr > 0), F.try_divide(cov, F.sqrt(vr) * F.sqrt(vm))).otherwise(0.0).alias("correlation_to_market"),
    )
    return stats.join(F.broadcast(names), "idx").drop("idx")


def analyse(returns: DataFrame, names: DataFrame, count: int) -> DataFrame:
    """Per-name table with weights and cluster, book statistics on every row."""
    if count < 2:
        raise ValueError("a cross-section needs at least two names")
    listed = checkpointed(chosen(names, count))
    vectors = session_vectors(returns, listed)
    moments = checkpointed(moment_table(returns, listed))
    cov = checkpointed(ledoit_wolf(moments))
    corr = correlation(cov)
    weights = allocations(cov)
    groups = clusters(corr)
    book = (
        effective_bets(corr)
        .join(F.broadcast(diversification(cov, weights, "weight_hrp")), F.lit(True), "left")
        .join(F.broadcast(cov.agg(F.max("intensity").alias("shrinkage"))), F.lit(True), "left")
    )
    return (
        name_statistics(vectors, listed)
        .where(F.col("sessions") >= MIN_SESSIONS)
        .join(F.broadcast(listed), "symbol")
        .withColumnRenamed("idx", "i")
        .join(F.broadcast(weights), "i")
        .join(F.broadcast(groups.withColumnRenamed("label", "cluster")), "i")
        .join(F.broadcast(book), F.lit(True), "left")
        .withColumns(
            {
                "ill_conditioned": F.col("condition_number") > ILL_CONDITIONED,
                "concentrated": concentration(F.col("effective_bets"), F.col("names")),
            }
        )
        .drop("i")
    )
