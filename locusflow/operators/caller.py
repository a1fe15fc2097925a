"""Allele frequencies by expectation-maximisation and variant calls by backward likelihood-ratio selection.

Observations of a position count by base and quality before they leave the JVM, so that the model's cost doesn't grow with
the number of samples. Arrow batches of positions go through the model together, padded to one array.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusflow.functions import stats
from locusflow.operators.pileup import BASES, SITE, is_base, ranksums, strand_counts

ROUNDS, CONVERGED = 100, 0.001
#: Chi-squared below which the smaller model is taken.
ACCEPT = 24.0
MONO_DEPTH, MONO_QUAL, LOW_QUAL = 10, 5000.0, 20.0
SUBSETS = {k: [sum(1 << i for i in c) for c in combinations(range(4), k)] for k in range(1, 5)}


def counted(obs: DataFrame, by: list[str] = SITE) -> DataFrame:
    """One row per position (and further keys) with its (base, qual, n) in order."""
    keys = [*by, "ref_base"]
    n = obs.where(is_base(F.col("base"))).groupBy(*keys, "base", "qual").agg(F.count("*").alias("n"))
    return n.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("base", "qual", "n"))).alias("classes"))


def _padded(classes: list[list[dict]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (sites x classes), likelihoods (sites x classes x 4) and depths (sites x 4)."""
    wide = max(map(len, classes))
    weight, like, depth = np.zeros((len(classes), wide)), np.ones((len(classes), wide, 4)), np.zeros((len(classes), 4))
    for s, site in enumerate(classes):
        for c, x in enumerate(site):
            j, eps = BASES.index(x["base"]), np.exp(-x["qual"] * np.log(10) / 10)
            weight[s, c], like[s, c], like[s, c, j] = x["n"], eps / 3, 1 - eps
            depth[s, j] += x["n"]
    return weight, like, depth


def expect(weight: np.ndarray, like: np.ndarray, freq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and log-likelihoods of jobs: one step before the loop, at most ROUNDS in it.

    The likelihood is that of the last expectation, one step behind the frequencies. Rows whose likelihood is 0
    under a model make it impossible: -inf.
    """

    def step(f, w, l):  # noqa: E741
        joint = l * f[:, None, :]
        margin = joint.sum(2)
        with np.errstate(divide="ignore", invalid="ignore"):
            post = np.where(margin[..., None] > 0, joint / margin[..., None], 0.0)
            logs = np.where(w > 0, np.log(margin), 0.0)
        return (post * w[..., None]).sum(1) / w.sum(1)[:, None], logs

    freq, logs = step(freq, weight, like)
    live = np.arange(len(freq))
    for _ in range(ROUNDS):
        new, now = step(freq[live], weight[live], like[live])
        with np.errstate(invalid="ignore"):
            delta = (np.abs(now - logs[live]) * weight[live]).sum(1)
        freq[live], logs[live] = new, now
        live = live[delta >= CONVERGED]
        if not len(live):
            break
    with np.errstate(invalid="ignore"):
        return freq, np.where(weight > 0, logs * weight, 0.0).sum(1)


def select(classes: list[list[dict]], min_af: np.ndarray, allowed: np.ndarray) -> dict[str, np.ndarray]:
    """The bases left by backward selection (bit mask), their frequencies and the last chi-squared, by site."""
    weight, like, depth = _padded(classes)
    total = depth.sum(1)
    bit = 1 << np.arange(4)
    active = (((depth / np.maximum(total, 1)[:, None] >= min_af[:, None]) & (allowed[:, None] & bit > 0) & (depth > 0)) * bit).sum(1)
    freq, chi, loglike = np.zeros((len(total), 4)), np.zeros(len(total)), np.zeros(len(total))

    def fit(sites: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = depth[sites] / total[sites][:, None] * (masks[:, None] & bit > 0)
        return expect(weight[sites], like[sites], start)

    going = np.flatnonzero(active)
    if len(going):
        freq[going], loglike[going] = fit(going, active[going])
    size = (active[:, None] & bit > 0).sum(1)
    for k in (3, 2, 1):
        live = going[size[going] == k + 1]
        jobs = [(s, m) for s in live.tolist() for m in SUBSETS[k] if m & ~int(active[s]) == 0]
        if not jobs:
            continue
        sites, masks = (np.array(x) for x in zip(*jobs))
        fs, ls = fit(sites, masks)
        for s in live.tolist():
            own = np.flatnonzero(sites == s)
            gain = 2 * (loglike[s] - ls[own])
            best = own[int(np.argmin(np.where(np.isnan(gain), np.inf, gain)))]
            chi[s] = 2 * (loglike[s] - ls[best])
            loglike[s] = ls[best]
            if chi[s] < ACCEPT:
                active[s], freq[s], size[s] = masks[best], fs[best], k
            else:
                size[s] = 9  # stays as it is
    return {"active": active, "freq": freq, "chi": chi, "depth": depth, "total": total}


CALL = "alts array<string>, afs array<double>, acs array<bigint>, cafs array<double>, chi double, mono boolean, dp bigint"


def _calls(keys: list[str], min_af: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            masks = batch["allowed"].to_numpy(np.int64)
            out = select(batch["classes"].tolist(), np.full(len(batch), np.float32(min_af), np.float64), masks)
            rows = []
            for i, ref in enumerate(batch["ref_base"]):
                alts = [j for j in range(4) if int(out["active"][i]) >> j & 1 and BASES[j] != ref.upper()[:1]]
                left = [j for j in range(4) if int(out["active"][i]) >> j & 1]
                mono = len(left) == 1 and out["total"][i] > MONO_DEPTH and out["depth"][i][left[0]] / out["total"][i] > 0.5
                rows.append(([BASES[j] for j in alts], [float(out["freq"][i][j]) for j in alts], [int(out["depth"][i][j]) for j in alts], [float(out["depth"][i][j] / out["total"][i]) for j in alts], float(out["chi"][i]), bool(mono), int(out["total"][i])))
            made = pd.DataFrame(rows, columns=["alts", "afs", "acs", "cafs", "chi", "mono", "dp"])
            yield pd.concat([batch[keys].reset_index(drop=True), made], axis=1)

    return run


def call(obs: DataFrame, min_af: float = 0.01, by: list[str] = SITE, allowed: DataFrame | None = None) -> DataFrame:
    """Variant sites: alts, frequencies, counts, shares by count, depth and qual.

    allowed: positions with a bit mask of the bases to consider (all four otherwise); other positions are left out.
    """
    sites = counted(obs, by)
    sites = sites.withColumn("allowed", F.lit(15)) if allowed is None else sites.join(allowed, SITE)
    keys = [*by, "ref_base"]
    kinds = dict(sites.dtypes)
    made = sites.mapInPandas(_calls(keys, min_af), ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " + CALL)
    p = made.withColumn("p", stats.chi2_tail(F.col("chi")))
    return p.withColumn("qual", F.when(F.col("mono"), MONO_QUAL).otherwise(stats.phred(F.col("p")))).drop("p").where(F.size("alts") > 0)


def genotypes(obs: DataFrame, calls: DataFrame) -> DataFrame:
    """obs with gt: 0/. for the reference, ./i for the i-th called ALT, ./. for all else."""
    alts = calls.select(*SITE, "alts")
    place = F.array_position("alts", F.col("base"))
    known = F.when(F.col("base") == F.upper("ref_base"), "0/.").when(place > 0, F.concat(F.lit("./"), place.cast("string")))
    return obs.join(alts, SITE, "left").withColumn("gt", F.coalesce(F.when(is_base(F.col("base")), known), F.lit("./."))).drop("alts")


def called(obs: DataFrame, calls: DataFrame) -> DataFrame:
    """The observations of called positions that count for their statistics: the reference's base and the called ALTs."""
    base = F.col("base")
    return obs.join(calls.select(*SITE, "alts"), SITE).where((base == F.upper("ref_base")) | F.array_contains("alts", base)).drop("alts")


def info(obs: DataFrame, calls: DataFrame) -> DataFrame:
    """calls with quality by depth, strand counts and bias and the three rank sums, cut to whole numbers, of the reference against the called ALTs."""
    own = called(obs, calls)
    names = {"MQRankSum": "mapq", "ReadPosRankSum": "rank", "BaseQRankSum": "qual"}
    per = ranksums(own, names).groupBy(*SITE).agg(*[F.max(F.when(F.col("name") == n, F.col("phred"))).cast("int").alias(n) for n in names])
    four = [F.col(c) for c in ("ref_fwd", "ref_rev", "alt_fwd", "alt_rev")]
    out = calls.join(strand_counts(own).drop("ref_base", "depth"), SITE).join(per, SITE)
    qd = F.col("qual") / F.aggregate("acs", F.lit(0.0), lambda s, n: s + n)
    return out.withColumn("QD", qd).withColumn("FS", stats.fisher_phred(*four)).withColumn("SOR", stats.odds_ratio(*four))


def sample_text(gt: Column, base: Column, strand: Column, qual: Column) -> Column:
    """GT:AB:SO:BP of an observation: genotype, base, strand and the chance that the base is right; ./. alone for N and indels."""
    return F.when(is_base(base), F.concat_ws(":", gt, base, strand, F.format_string("%.6f", 1 - stats.error_of(qual)))).otherwise("./.")


def mask_of(bases: Column) -> Column:
    """The bit mask of an array of bases."""
    return F.aggregate(bases, F.lit(0), lambda s, b: s + F.when(b == "A", 1).when(b == "C", 2).when(b == "G", 4).when(b == "T", 8).otherwise(0))


def call_groups(obs: DataFrame, sites: DataFrame, groups: DataFrame, min_af: float = 0.01) -> DataFrame:
    """Frequencies of the called sites' alleles by group; a group lists the alleles that its own selection leaves."""
    allowed = sites.select(*SITE, mask_of(F.array_union(F.array(F.upper("ref_base")), "alts")).alias("allowed"))
    return call(obs.join(groups, "sample_idx"), min_af, [*SITE, "group"], allowed)


def frequencies(obs: DataFrame, by: list[str] = SITE) -> DataFrame:
    """The frequencies of all bases seen, without selection."""
    keys, kinds = [*by, "ref_base"], dict(obs.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            weight, like, depth = _padded(batch["classes"].tolist())
            freq, loglike = expect(weight, like, depth / depth.sum(1)[:, None])
            made = pd.DataFrame({f"af_{b}": freq[:, j] for j, b in enumerate(BASES)} | {"loglike": loglike})
            yield pd.concat([batch[keys].reset_index(drop=True), made], axis=1)

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " + ", ".join(f"af_{b} double" for b in BASES) + ", loglike double"
    return counted(obs, by).mapInPandas(run, schema)
