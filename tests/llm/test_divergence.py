"""The source audit against a plain version over dense counts."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from locusflow.llm import divergence

SCHEMA = "text string, lang string, source string"


def plain(rows, top):
    terms = [(lang or "", source or "", [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for text, lang, source in rows]
    df, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, ts in terms:
        df[lang].update(set(ts))
        groups[lang].add(source)
    kept = {lang: sorted(t for t, n in c.items() if n >= 3) for lang, c in df.items()}
    for lang, source, ts in terms:
        counts[lang, source].update(t for t in ts if df[lang][t] >= 3)
        counts[lang, None].update(t for t in ts if df[lang][t] >= 3)
    p = lambda lang, source, t: 1 + 10**9 * (counts[lang, source][t] + 1) // (sum(counts[lang, source].values()) + len(kept[lang]))
    out = set()
    for lang, sources in groups.items():
        for s in sources:
            pairs = [(sum((p(lang, s, t) - p(lang, x, t)) ** 2 // p(lang, x, t) for t in kept.get(lang, [])), x) for x in sources if x != s]
            marked = [((p(lang, s, t) - p(lang, None, t)) ** 2 // p(lang, None, t), t) for t in kept.get(lang, []) if counts[lang, s][t] and p(lang, s, t) > p(lang, None, t)]
            for part, found in (("pair", pairs), ("term", marked)):
                for k, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1):
                    if part == "pair" or k <= top:
                        out.add((lang, s, part, item, v, k))
    return out


def rows_of(seed, n):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in ("Wort", "été", "tea", "ΣΑ", "x", "\U0001f600") for b in ("", "en", "S", "é", "ab")]
    return [(" ".join(r.choice(words[: r.randint(1, 30)]) + r.choice(["", ".", "_1", "\0"]) for _ in range(r.randint(0, 25))), r.choice(["en", "de", None, ""]), r.choice(["s1", "s2", "s3", None, "é", "z"])) for _ in range(n)]


@pytest.mark.parametrize("bound", [1 << 20, 7, 1])
def test_audit(spark, bound, monkeypatch):
    """One fit, several shards, shards of shards; sums over more than one cut of pairs."""
    monkeypatch.setattr(divergence, "FAN", 3)
    monkeypatch.setattr(divergence, "SAMPLE", 1)
    monkeypatch.setattr(divergence, "PAIRS", 50 if bound > 7 else 5)  # a table of sums, or the sums that occur
    rows = [*rows_of(1, 150), ("only once", "fr", "s1"), (None, "fr", "s2"), ("", "it", "s1"), ("a" * 500_000 + " tea", "en", "s1")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("id", "terms", "part", "n", "shard")})
    got = {tuple(r) for r in divergence.audit(docs, top=4, bound=bound if bound > 1 else 12).collect()}
    assert got == plain(rows, 4)


def test_empty_and_equal(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [("same words here", "en", "a")] * 3 + [("same words here", "en", "b")] * 3
    assert {tuple(r) for r in divergence.audit(spark.createDataFrame(rows, SCHEMA)).collect()} == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}


def test_shares_are_exact_for_large_counts(spark):
    cases = [(0, 1), (10**15 - 1, 10**15), (3 * 10**14, 7 * 10**14 + 1), (5, 9)]
    got = spark.createDataFrame(cases, "n bigint, every bigint").select("n", "every", divergence.share(F.col("n"), F.col("every")).alias("p")).collect()
    assert all(r["p"] == 1 + 10**9 * (r["n"] + 1) // r["every"] for r in got)


def test_terms_of_a_batch():
    """Terms end with their text, empty texts have none, and slices of a batch are read as such."""
    import pyarrow as pa

    texts = pa.array(["zz", "Ab", "cD e", "", "..", "\u00c9a-b"]).slice(1)
    letters, bounds, rows = divergence._cut(texts)
    assert [bytes(letters[a:b]).decode() for a, b in zip(bounds, bounds[1:])] == ["ab", "cd", "e", "\u00c9a", "b"] and list(rows) == [0, 1, 1, 4, 4]
    h = divergence._hashes(letters, bounds)
    assert len(set(h.tolist())) == 5
    for empty in (pa.array([], pa.string()), pa.array(["", ""])):
        assert divergence._cut(empty)[2].size == 0


def test_sums_of_vectors(monkeypatch):
    """By a table of sums and by sorting, one batch at a time or several; a batch leaves as many rows as it has sums."""
    import numpy as np
    import pyarrow as pa

    r, want, batches = random.Random(5), Counter(), []
    for k in range(6):
        rows = [(r.choice([3, 8 << 33, 9]), sorted(r.sample(range(50), r.randint(0, 9)))) for _ in range(0 if k == 2 else 40)]
        values = [[float(r.randint(1, 5)) for _ in places] for _, places in rows]
        for (group, places), own in zip(rows, values):
            want.update({(group, p): int(v) for p, v in zip(places, own)})
        arrays = [pa.array([g for g, _ in rows], pa.int64()), pa.array([p for _, p in rows], pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))]
        batches.append(pa.RecordBatch.from_arrays(arrays, ["group", "indices", "values"]))
    for entries, dense in ((1 << 20, 8), (1, 0), (300, 0), (300, 8)):
        monkeypatch.setattr(divergence, "ENTRIES", entries)
        monkeypatch.setattr(divergence, "DENSE", dense)
        got, out = Counter(), list(divergence._counted(iter(batches)))
        for b in out:
            rows = list(zip(*(b.column(c).to_pylist() for c in ("group", "place", "n"))))
            assert len({x[:2] for x in rows}) == len(rows)
            got.update({(g, p): n for g, p, n in rows})
        assert got == want
    assert np.all([b.num_rows <= 150 for b in out])
    assert list(divergence._counted(iter([]))) == []


def test_documents_folded_before_they_are_counted(spark):
    """A group's copies are a few rows whose times add up, of which min_docs bear each of their terms."""
    rows = [(f"same Words, words w{i % 2}", "en", "a") for i in range(500)] + [("rare words words words", "de", None), ("rare", "de", "b"), (None, "fr", "b"), ("", "fr", "b")]
    held = divergence.terms(spark.createDataFrame(rows, SCHEMA).coalesce(1)).where("shard >= 0").collect()
    assert len(held) <= divergence.PARTS * 4 * 3 and all(len(set(r["terms"])) == len(r["terms"]) for r in held)
    sums, seen = Counter(), Counter()
    for r in held:
        for t in r["terms"]:
            sums[r["lang"], r["source"], t.split("\0")[1]] += r["times"]
            seen[t] += 1
    assert sums == {("en", "a", "same"): 500, ("en", "a", "words"): 1000, ("en", "a", "w"): 500, ("de", "", "rare"): 1, ("de", "", "words"): 3, ("de", "b", "rare"): 1}
    assert seen == {"en\0same": 3, "en\0words": 3, "en\0w": 3, "de\0rare": 2, "de\0words": 1}


@pytest.mark.parametrize("min_docs", [1, 2, 5])
def test_folding_against_counts(min_docs):
    import numpy as np

    r = random.Random(min_docs)
    rows = sorted((r.randrange(60), r.randrange(7)) for _ in range(700))
    row, term = (np.array(x) for x in zip(*rows))
    group = row % 4
    out = list(zip(*(x.tolist() for x in divergence._folded(group, term, row, min_docs))))
    want, docs = Counter(zip(group.tolist(), term.tolist())), Counter((d % 4, t) for d, t in set(rows))
    got = Counter()
    for g, t, slot, times in out:
        got[g, t] += times
        assert times >= 1 and slot < min_docs
    assert got == want and Counter(x[:2] for x in out) == {k: min(n, min_docs) for k, n in docs.items()}
