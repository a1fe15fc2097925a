"""Scored pairing of records, regions and targets on small tables."""

import pytest

from locusflow.operators import pairing

R, S, I, O = pairing.REF, pairing.SNP, pairing.INDEL, pairing.OTHER  # noqa: E741


def test_scores_of_kinds():
    assert pairing.kind_scores("some") == pairing.kind_scores("exact") == {}
    both = pairing.kind_scores("both_ref")
    assert (both[S, S], both[I, I], both[S, R], both[R, I], both[S | I, R], both[S | I, I]) == (3, 3, 2, 2, 2, 3) and (S, I) not in both and (O, O) not in both
    every = pairing.kind_scores("any")
    assert (every[S, S], every[S, R], every[S, I], every[O, O], every[S | I, S]) == (3, 2, 1, 1, 1)


CASES = [
    # Equal records are together whatever the logic; copies go with copies.
    ("exact", [(0, "A>C", S), (0, "A>C", S), (1, "A>C", S), (2, "A>G", S)], [[0, 2], [1], [3]]),
    ("exact", [(0, "A>C,A>G", S), (1, "A>G,A>C", S), (2, "A>g,A>c", S)], [[0, 1, 2]]),
    ("exact", [(0, "A>C,A>G", S), (1, "A>C", S)], [[0], [1]]),
    # One ALT in common is enough for all others, if the kinds meet.
    ("some", [(0, "A>C,A>G", S), (1, "A>G", S), (1, "A>T", S)], [[0, 1], [2]]),
    ("some", [(0, "A>C", S), (1, "A>T", S)], [[0], [1]]),
    # SNPs with SNPs: the second source's first one is taken first; a REF record needs a logic that names it.
    ("snps", [(0, "A>C", S), (1, "A>G", S), (1, "A>T", S), (2, "A>.", R)], [[0, 1], [2], [3]]),
    ("snp_ref", [(0, "A>C", S), (1, "A>.", R), (2, "A>G", S)], [[0, 1], [2]]),
    ("both_ref", [(0, "A>.", R), (1, "AC>A", I), (2, "A>C", S)], [[0, 1], [2]]),
    # The set in most sources chooses first, and what more records have is taken first.
    ("both", [(0, "A>C", S), (1, "A>G", S), (2, "A>G", S), (3, "A>T", S)], [[0, 1, 2, 3]]),
    ("both", [(0, "A>C", S), (1, "A>T", S), (2, "A>T", S), (1, "A>G", S)], [[0, 1, 2], [3]]),
    # Kinds must agree with all members of a set, the strictest deciding; shared alleles beat kinds.
    ("any", [(0, "A>C", S), (1, "AC>A", I), (1, "A>.", R), (1, "A>G", S)], [[0, 3], [1], [2]]),
    ("any", [(0, "A>C,A>G", S), (1, "A>T", S), (1, "A>G", S)], [[0, 2], [1]]),
    ("id", [(0, "rs1:A>C", S), (1, "rs1:A>C", S), (2, "rs2:A>C", S)], [[0, 1], [2]]),
    ("some", [(0, "A><DEL>/50", O), (1, "A><DEL>/90", O), (2, "A><DEL>/50", O)], [[0, 2], [1]]),
]


@pytest.mark.parametrize("logic, records, want", CASES)
def test_rows(logic, records, want):
    assert pairing.rows_of(records, logic) == want


def test_paired_tables(spark):
    schema = "contig string, pos bigint, ref string, alts array<string>, id string, end bigint, key bigint"
    tables = [
        [("c1", 5, "A", ["C"], "r", None, 1), ("c1", 5, "A", ["<DEL>"], "r", 9, 2), ("c2", 1, "G", [], None, None, 3)],
        [("c1", 5, "A", ["G"], "r", None, 4), ("c1", 5, "A", ["<DEL>"], "r", 9, 5)],
        [("c1", 5, "A", ["<DEL>"], "r", 99, 6), ("c1", 7, "A", ["T"], "r", None, 7)],
    ]
    sources = [spark.createDataFrame(t, schema) for t in tables]
    rows = lambda logic: sorted((r["contig"], r["pos"], r["nth"], [x["record"]["order"] for x in r["records"]]) for r in pairing.paired(sources, logic).collect())
    assert rows("some") == [("c1", 5, 0, [2, 5]), ("c1", 5, 1, [1]), ("c1", 5, 2, [4]), ("c1", 5, 3, [6]), ("c1", 7, 0, [7]), ("c2", 1, 0, [3])]
    assert rows("snps")[:2] == [("c1", 5, 0, [2, 5]), ("c1", 5, 1, [1, 4])]


def test_claimed_and_targets(spark):
    records = spark.createDataFrame([(1, "c", 10, "ACGT", ["A"]), (2, "c", 20, "A", ["AT"]), (3, "d", 10, "A", ["C"])], "key bigint, contig string, pos bigint, ref string, alts array<string>")
    regions = spark.createDataFrame([("c", 13, 15), ("c", 1, 11), ("c", 21, 30), ("c", 13, 15)], "contig string, beg bigint, end bigint")
    rows = lambda mode: sorted((r["key"], r["region_beg"]) for r in pairing.claimed(records, regions, "key", mode).collect())
    assert rows("pos") == [(1, 1)] and rows("record") == [(1, 1)] and rows("variant") == [(1, 1)]
    targets = spark.createDataFrame([("c", 20, 20)], "contig string, beg bigint, end bigint")
    assert [r["key"] for r in pairing.on_targets(records, targets, "key").collect()] == [2]
    assert sorted(r["key"] for r in pairing.on_targets(records, targets, "key", exclude=True).collect()) == [1, 3]
