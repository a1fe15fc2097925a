"""Likelihoods of genotypes from a pile of bases whose errors depend on one another.

A base that is wrong makes the next of the same kind likelier to be wrong alike. Bases are taken from the best quality
down; the k-th of n that reads a base costs what it adds to the chance that so many of n are errors at its quality, and
is discounted by how many before it read the same on the same strand. A genotype's likelihood is the cost of the bases
that it doesn't explain and, for two alleles, of how their bases are split.

What a site needs of its bases is how often each of (quality, strand, base) occurs. That is counted in Spark; batches of
sites are then fitted together in numpy.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the model: bases that are told apart at a site, bounds on a quality, the share of errors that no other explains, phred units of a natural logarithm.
MOST, LOWEST, HIGHEST, INDEPENDENT, PHRED = 255, 4, 63, 0.03, 4.343
BASES = "ACGT"


@lru_cache(maxsize=4)
def tables(dependence: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Discount by earlier bases alike; cost by quality, depth and place; split of two alleles by depth and the second's count (natural logarithms)."""
    n = np.arange(MOST + 1)
    discount = (1 - dependence) ** n * (1 - INDEPENDENT) + INDEPENDENT
    discount[0] = 1.0
    fact = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, MOST + 1)))])
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        choose = np.where(n[None, :] <= n[:, None], fact[:, None] - fact[None, :] - fact[np.abs(n[:, None] - n[None, :])], -np.inf)
        cost = np.zeros((HIGHEST + 1, MOST + 1, MOST + 1))
        for q in range(LOWEST, HIGHEST + 1):
            e = 10.0 ** (-q / 10)
            log = choose + n[None, :] * np.log(e) + (n[:, None] - n[None, :]) * np.log1p(-e)
            tail = np.logaddexp.accumulate(log[:, ::-1], axis=1)[:, ::-1]  # of k errors or more
            cost[q] = -10 / np.log(10) * (np.concatenate([tail[:, 1:], np.full((MOST + 1, 1), -np.inf)], axis=1) - tail)
    return discount, cost, choose - np.log(2) * n[:, None]


def sampled(counts: np.ndarray, key: str, seed: int, most: int = MOST) -> np.ndarray:
    """counts of kinds cut to ``most`` in all: a sample without replacement that the site and the seed alone decide."""
    if counts.sum() <= most:
        return counts
    return np.random.Generator(np.random.Philox(key=[seed, zlib.crc32(key.encode())])).multivariate_hypergeometric(counts, most, method="marginals")


def likelihoods(sites: np.ndarray, quals: np.ndarray, strands: np.ndarray, bases: np.ndarray, n_sites: int, n_bases: int = len(BASES), dependence: float = 0.17) -> np.ndarray:
    """(site, allele, allele) in phred units; the arrays have a value per base read, at most MOST of a site."""
    discount, cost, split = tables(dependence)
    quals = np.clip(quals, LOWEST, HIGHEST)
    order = np.lexsort((-bases, -strands, -quals, sites))
    sites, quals, strands, bases = (x[order] for x in (sites, quals, strands, bases))

    def earlier(key: np.ndarray) -> np.ndarray:
        """How many before each have the same key."""
        by = np.argsort(key, kind="stable")
        first = np.r_[True, np.diff(key[by]) != 0] if len(by) else np.zeros(0, bool)
        begins = np.flatnonzero(first)
        out = np.empty(len(by), np.int64)
        out[by] = np.arange(len(by)) - np.repeat(begins, np.diff(np.r_[begins, len(by)]))
        return out

    depth = np.bincount(sites, minlength=n_sites)
    of = sites * n_bases + bases
    each = discount[earlier(of * 2 + strands)] * cost[quals, depth[sites], earlier(of)]
    load = np.bincount(of, each, n_sites * n_bases).reshape(n_sites, n_bases)
    count = np.bincount(of, minlength=n_sites * n_bases).reshape(n_sites, n_bases)
    out = np.zeros((n_sites, n_bases, n_bases))
    for a in range(n_bases):
        others = [k for k in range(n_bases) if k != a]
        out[:, a, a] = load[:, others].sum(axis=1)
        for b in range(a + 1, n_bases):
            rest = load[:, [k for k in others if k != b]].sum(axis=1)
            out[:, a, b] = out[:, b, a] = rest - PHRED * split[count[:, a] + count[:, b], count[:, b]]
    return np.maximum(out, 0.0)


def genotype_likelihoods(obs: DataFrame, keys: tuple[str, str] = ("contig", "pos"), dependence: float = 0.17, seed: int = 0) -> DataFrame:
    """keys, depth and likelihoods: AA, AC, AG, AT, CC, ... TT in phred units; bases other than A, C, G, T are left out.

    obs has the keys, base, qual and strand ('+' or '-'). Sites deeper than MOST are sampled; reruns agree.
    """
    kind = F.struct(F.col("qual").cast("int").alias("qual"), (F.col("strand") == "-").cast("int").alias("strand"), (F.instr(F.lit(BASES), F.col("base")) - 1).alias("base"))
    own = obs.where(F.col("base").isin(*BASES)).select(*keys, F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), "qual")).alias("qual"), "strand", "base")
    counted = own.groupBy(*keys, kind.alias("kind")).agg(F.count("*").alias("n"))
    # A site has a few hundred kinds at most.
    piles = counted.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("kind.qual", "kind.strand", "kind.base", "n"))).alias("pile"))
    upper = [(a, b) for a in range(len(BASES)) for b in range(a, len(BASES))]

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("pile")
            flat, sizes = lists.flatten(), np.asarray(lists.value_lengths())
            qual, strand, base, n = (np.array(flat.field(k), dtype=np.int64) for k in range(4))
            ends = np.cumsum(sizes)
            depth = np.add.reduceat(n, ends - sizes) if len(sizes) else np.zeros(0, np.int64)
            for i in np.flatnonzero(depth > MOST):
                at = slice(ends[i] - sizes[i], ends[i])
                n[at] = sampled(n[at], ":".join(str(batch.column(k)[i].as_py()) for k in keys), seed)
            q = likelihoods(*(np.repeat(x, n) for x in (np.repeat(np.arange(len(sizes)), sizes), qual, strand, base)), len(sizes), dependence=dependence)
            values = np.stack([q[:, a, b] for a, b in upper], axis=1) if len(sizes) else np.zeros((0, len(upper)))
            found = pa.FixedSizeListArray.from_arrays(pa.array(values.reshape(-1)), len(upper)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(depth), found], [*keys, "depth", "likelihoods"])

    types = {f.name: f.dataType.simpleString() for f in piles.schema.fields}
    return piles.mapInArrow(fit, ", ".join(f"{k} {types[k]}" for k in keys) + ", depth bigint, likelihoods array<double>")
