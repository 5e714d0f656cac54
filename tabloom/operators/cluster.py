"""Nearest centres, and k-means whose groups have equal size."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.sql import DataFrame, functions as F

from tabloom.frame import Table, c
from tabloom.functions.linear import first_min, squared_distances
from tabloom.functions.rank import ROWS_PER_RANGE, running_total
from tabloom.operators.trees import VEC, vector
from tabloom.session import cut_lineage


def _gaps(t: Table, centres: np.ndarray):
    return squared_distances([t.number(n) for n in t.features], centres)


def kmeans_assign(t: Table, centres: np.ndarray) -> DataFrame:
    """(key, cluster): the nearest centre, the first one on ties."""
    gaps = _gaps(t, centres)
    return t.df.select(*[c(k) for k in t.key], first_min(gaps, list(range(len(gaps)))).alias("cluster"))


def kmeans_transform(t: Table, centres: np.ndarray) -> DataFrame:
    """(key, d0..): Euclidean distance to every centre."""
    return t.df.select(*[c(k) for k in t.key], *[F.sqrt(g).alias(f"d{i}") for i, g in enumerate(_gaps(t, centres))])


def kmeans_score(t: Table, centres: np.ndarray) -> DataFrame:
    """Negative inertia."""
    gaps = _gaps(t, centres)
    nearest = F.least(*gaps) if len(gaps) > 1 else gaps[0]
    return t.df.agg((-F.sum(nearest)).alias("score"))


def balanced_assign(t: Table, centres: np.ndarray, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """(key, cluster): at most ceil(n / k) rows per centre.

    Rows propose to their nearest centre that still has room; a centre takes
    the nearest proposals up to its room. A round with leftovers fills at least
    one centre, so there are at most k rounds.
    """
    k = len(centres)
    rows = t.df.count()
    room = dict.fromkeys(range(k), math.ceil(rows / k))
    keys = list(t.key)
    left = cut_lineage(t.df.select(*[c(n) for n in keys], F.array(*_gaps(t, centres)).alias("__g")))
    done: list[DataFrame] = []
    for _ in range(k):
        open_ids = [i for i in range(k) if room[i] > 0]
        gaps = [F.get("__g", F.lit(i)) for i in open_ids]
        proposed = left.withColumn("cluster", first_min(gaps, open_ids)).withColumn(
            "__d", F.get("__g", F.col("cluster"))
        )
        counts = {r["cluster"]: r["n"] for r in proposed.groupBy("cluster").agg(F.count("*").alias("n")).collect()}
        crowded = [i for i, n in counts.items() if n > room[i]]
        if not crowded:
            done.append(proposed.select(*keys, "cluster"))
            break
        calm = proposed.where(~F.col("cluster").isin(crowded))
        full = running_total(
            proposed.where(F.col("cluster").isin(crowded)),
            ["__d", *keys],
            ["cluster"],
            out="__p",
            rows_per_range=rows_per_range,
        )
        limit = F.get(F.array(*[F.lit(room[i]) for i in range(k)]), F.col("cluster"))
        judged = cut_lineage(full.withColumn("__in", F.col("__p") < limit))
        done += [calm.select(*keys, "cluster"), judged.where("__in").select(*keys, "cluster")]
        for i, n in counts.items():
            room[i] -= min(n, room[i])
        left = judged.where(~F.col("__in")).select(*keys, "__g")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def swap_round(offers: DataFrame, keys: list[str], k: int, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """One round of swaps over (keys, cluster, __g: squared distances); sizes stay, inertia does not rise.

    Every row offers itself to the cluster that would gain most (or lose least) by it. The offers from a to b are
    ranked by gain, as are those from b to a; offers of equal rank are swapped where their gains add up to more
    than zero. Ranks come from ranges and partners meet on (pair, rank), so a pair of clusters that holds
    most rows is no single task.
    """
    others = F.array(*[F.when(F.col("cluster") != i, F.struct(F.get("__g", F.lit(i)).alias("d"), F.lit(i).alias("i"))) for i in range(k)])
    best = F.array_min(F.filter(others, lambda o: o.isNotNull()))
    moved = offers.withColumn("__to", best["i"]).withColumn("__loss", best["d"] - F.get("__g", F.col("cluster")))
    ranked = cut_lineage(running_total(moved, ["__loss", *keys], ["cluster", "__to"], out="__rank", rows_per_range=rows_per_range))
    partner = ranked.select(F.col("cluster").alias("__pf"), F.col("__to").alias("__pt"), F.col("__rank").alias("__pr"), F.col("__loss").alias("__pl"))
    met = (F.col("cluster") == F.col("__pt")) & (F.col("__to") == F.col("__pf")) & (F.col("__rank") == F.col("__pr"))
    swapped = F.coalesce(F.col("__loss") + F.col("__pl") < 0, F.lit(False))
    joined = ranked.join(partner, met, "left")
    return joined.select(*[c(n) for n in keys], F.when(swapped, F.col("__to")).otherwise(F.col("cluster")).alias("cluster"), "__g", swapped.alias("__moved"))


def balanced_swaps(t: Table, assigned: DataFrame, centres: np.ndarray, rounds: int = 10, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """(key, cluster) after rounds of swaps for the given centres, until a round moves no row or ``rounds`` is reached."""
    keys = list(t.key)
    gaps = t.df.select(*[c(n) for n in keys], F.array(*_gaps(t, centres)).alias("__g"))
    now = gaps.join(assigned.select(*[c(n) for n in keys], "cluster"), keys)
    for _ in range(rounds if len(centres) > 1 else 0):
        now = cut_lineage(swap_round(now.select(*[c(n) for n in keys], "cluster", "__g"), keys, len(centres), rows_per_range))
        if not now.where("__moved").limit(1).count():
            break
    return now.select(*[c(n) for n in keys], "cluster")


def balanced_kmeans(t: Table, k: int, max_iter: int = 5, seed: int = 42, swaps: int = 0) -> tuple[DataFrame, np.ndarray]:
    """Equal-size groups: balanced assignment, up to ``swaps`` rounds of swaps, and new means, from k-means centres.

    Returns (key, cluster) and the centres of the best round by inertia.
    """
    model = KMeans(k=k, seed=seed, featuresCol=VEC, predictionCol="__c").fit(t.df.select(vector(t).alias(VEC)))
    centres = np.array(model.clusterCenters())
    best = None
    for _ in range(max_iter):
        assigned = cut_lineage(balanced_assign(t, centres))
        if swaps:
            assigned = balanced_swaps(t, assigned, centres, swaps)
        joined = t.df.join(assigned, list(t.key))
        own = F.get(F.array(*_gaps(t, centres)), F.col("cluster"))
        means = joined.groupBy("cluster").agg(
            F.sum(own).alias("inertia"), *[F.avg(t.number(n)).alias(f"m{i}") for i, n in enumerate(t.features)]
        ).collect()
        inertia = sum(r["inertia"] for r in means)
        if best is not None and inertia >= best[0] * (1 - 1e-6):
            break
        best = (inertia, assigned, centres)
        centres = centres.copy()
        for r in means:
            centres[r["cluster"]] = [r[f"m{i}"] for i in range(len(t.features))]
    return best[1], best[2]
