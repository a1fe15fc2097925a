"""The error model, modified bases, capped quality and realignment against plain versions."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusflow.functions import cigar as cg
from locusflow.operators import errormodel, modifications, realign


def plain_likelihoods(pile, dependence=0.17):
    """pile: (qual, reverse, base index); the model base by base."""
    n = len(pile)
    seen_strand, seen, load = {}, [0] * 4, [0.0] * 4
    for qual, reverse, base in sorted(pile, reverse=True):
        e = 10 ** (-min(max(qual, 4), 63) / 10)
        tail = lambda k, e=e: math.fsum(math.comb(n, j) * e**j * (1 - e) ** (n - j) for j in range(k, n + 1))
        w = seen_strand.get((reverse, base), 0)
        f = (1 - dependence) ** w * 0.97 + 0.03 if w else 1.0
        load[base] += f * -10 * math.log10(tail(seen[base] + 1) / tail(seen[base]))
        seen[base] += 1
        seen_strand[reverse, base] = w + 1
    out = {}
    for a in range(4):
        out[a, a] = sum(x for i, x in enumerate(load) if i != a)
        for b in range(a + 1, 4):
            c = seen[a] + seen[b]
            out[a, b] = max(0.0, sum(x for i, x in enumerate(load) if i not in (a, b)) - 4.343 * (math.log(math.comb(c, seen[b])) - math.log(2) * c))
    return out


def test_error_model():
    r = random.Random(1)
    piles = [[(r.choice([2, 10, 20, 30, 40, 70]), r.randint(0, 1), r.choice([0, 0, 0, 1, 3])) for _ in range(r.choice([1, 2, 7, 40, 90]))] for _ in range(25)]
    site = np.repeat(np.arange(len(piles)), [len(p) for p in piles])
    q, s, b = (np.array([x[k] for p in piles for x in p]) for k in range(3))
    got = errormodel.likelihoods(site, q, s, b, len(piles))
    for i, pile in enumerate(piles):
        for (x, y), want in plain_likelihoods([(min(max(q, 4), 63), s, b) for q, s, b in pile]).items():
            assert got[i, x, y] == pytest.approx(want, abs=1e-6) and got[i, y, x] == got[i, x, y]
    assert errormodel.likelihoods(*[np.zeros(0, np.int64)] * 4, 1).max() == 0


def test_deep_sites_are_sampled_alike(spark):
    rows = [("c", 1, "ACGT"[(k % 10 == 0)], 20 + k % 15, "+-"[k % 2]) for k in range(2000)] + [("c", 2, "N", 30, "+"), ("c", 2, "A", 30, "+"), ("c", 3, "A", 30, "+")]
    obs = spark.createDataFrame(rows, "contig string, pos int, base string, qual int, strand string")
    one, two = ([(r["pos"], r["depth"], r["likelihoods"]) for r in errormodel.genotype_likelihoods(obs.repartition(n)).orderBy("pos").collect()] for n in (1, 7))
    assert one == two and [x[:2] for x in one] == [(1, 2000), (2, 1), (3, 1)] and one[0][2][0] < one[0][2][4]
    counts = np.array([1000, 0, 500, 1])
    assert errormodel.sampled(counts, "c:1", 0).sum() == 255 and (errormodel.sampled(counts, "c:1", 0) == errormodel.sampled(counts, "c:1", 0)).all()


CALLS = [
    ("ACCGC", False, "C+m,0,1;", [10, 20], [(1, "C", "+", "m", 10), (4, "C", "+", "m", 20)]),
    ("GCGGT", True, "C+m,0,1;", [10, 20], [(0, "C", "+", "m", 20), (3, "C", "+", "m", 10)]),
    ("ACCGC", False, "C+mh?,1;A+a,0;", [1, 2, 3], [(0, "A", "+", "a", 3), (2, "C", "+", "m", 1), (2, "C", "+", "h", 2)]),
    ("ACCGC", False, "G-m.,0;C+76792,2;", None, [(3, "G", "-", "m", None), (4, "C", "+", "76792", None)]),
    ("ACNGC", False, "N+n,2,0;", None, [(2, "N", "+", "n", None), (3, "N", "+", "n", None)]),
    ("ATTU", False, "U+x,1;", None, [(2, "T", "+", "x", None)]),
    ("ACCGC", False, "C+m;", None, []),
    ("", False, "", None, []),
]


@pytest.mark.parametrize("seq, reverse, mm, ml, want", CALLS)
def test_modified_bases(seq, reverse, mm, ml, want):
    assert [x[:5] for x in modifications.called(seq, reverse, mm, ml)] == want


@pytest.mark.parametrize("mm, ml, length, fault", [("C+m,0", None, None, "no list"), ("X+m,0;", None, None, "no list"), ("C*m,0;", None, None, "no list"), ("C+m,3;", None, None, "skipped"), ("C+m,0,1;", [1], None, "too few"), ("C+m,0;", [1, 2], None, "too many"), ("C+m,0;", None, 9, "another length"), ("C+" + "m" * 257 + ",0;", None, None, "too many codes")])
def test_tags_that_do_not_fit(mm, ml, length, fault):
    with pytest.raises(ValueError, match=fault):
        modifications.called("ACCGC", False, mm, ml, length)


def test_states_and_positions(spark):
    assert [(x[0], x[5]) for x in modifications.called("CCAC", False, "C+m?,1;", None, None, True)] == [(0, "unchecked"), (1, "modified"), (3, "unchecked")]
    assert [(x[0], x[5]) for x in modifications.called("CCAC", False, "C+m,1;", None, None, True)] == [(0, "unmodified"), (1, "modified"), (3, "unmodified")]
    rows = [("r1", 0, "c", 10, "1S2M1I2M", "CCAGCC", {"MM": "Z:C+m,0,0,0;", "ML": "B:C,5,6,7"}), ("r2", 0, "c", 10, "3M", "ACC", {"MM": "Z:C+m,5;"}), ("r3", 0, "c", 10, "3M", "ACC", {}), ("r4", 4, None, 0, None, "ACC", {"MM": "i:3"}), ("r5", 0, "c", 11, "3M", "CCC", {"MM": "Z:C+m,0;"})]
    reads = spark.createDataFrame(rows, "qname string, flag int, contig string, pos bigint, cigar string, seq string, tags map<string,string>")
    found = {r["qname"]: (len(r["mods"]), r["fault"]) for r in modifications.with_modifications(reads).collect()}
    assert found == {"r1": (3, None), "r2": (0, "more bases are skipped than there are"), "r3": (0, None), "r4": (0, "MM isn't text"), "r5": (1, None)}
    assert sorted((r["pos"], r["n"], r["likelihood"]) for r in modifications.by_position(reads).collect()) == [(10, 1, 6), (11, 1, None), (12, 1, 7)]


def ops_of(cigar):
    return [(o, int(n)) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]


def plain_cap(cigar, seq, qual, ref, most):
    x = y = mismatches = load = length = clipped = 0
    for op, n in ops_of(cigar):
        if op in "M=X":
            for j in range(n):
                if x + j >= len(ref):
                    break
                if ref[x + j] != "N" and seq[y + j] != "N" and qual[y + j] >= 13:
                    length += 1
                    if seq[y + j] != ref[x + j] and seq[y + j] != "=":
                        mismatches, load = mismatches + 1, load + min(33, qual[y + j])
            if x + n > len(ref):
                break
            x, y, length = x + n, y + n, length + n
        elif op == "D":
            if x + n > len(ref):
                break
            x += n
        elif op == "N":
            x += n
        elif op == "S":
            clipped, y = clipped + sum(qual[y : y + n]), y + n
        elif op == "H":
            clipped += 13 * n
        elif op == "I":
            y += n
    t = load - 4.343 * math.log(math.prod(length / (i + 1) for i in range(mismatches))) + clipped / 5
    return -1 if t > most else int(math.sqrt((most - max(t, 0)) / most) * most + 0.499)


def some_alignments(seed, n):
    r, out = random.Random(seed), []
    for i in range(n):
        ref = "".join(r.choice("ACGT") for _ in range(200))
        pos, parts, seq = r.randint(1, 40), [], ""
        if r.random() < 0.3:
            parts.append((r.randint(1, 5), "S"))
            seq += "".join(r.choice("ACGT") for _ in range(parts[-1][0]))
        x = pos - 1
        for k in range(r.randint(1, 3)):
            m = r.randint(4, 25)
            seq += "".join(c if r.random() > 0.04 else r.choice("ACGTN") for c in ref[x : x + m])
            parts.append((m, "M"))
            x += m
            if k < 2 and r.random() < 0.5:
                g = r.randint(1, 4)
                parts.append((g, r.choice("ID")))
                seq += "".join(r.choice("ACGT") for _ in range(g)) if parts[-1][1] == "I" else ""
                x += g if parts[-1][1] == "D" else 0
        merged = []
        for m, o in parts:
            if merged and merged[-1][1] == o:
                merged[-1] = (merged[-1][0] + m, o)
            else:
                merged.append((m, o))
        cigar = "".join(f"{m}{o}" for m, o in merged) + (f"{r.randint(1, 3)}H" if r.random() < 0.2 else "")
        qual = [r.randint(2, 40) for _ in seq]
        out.append((i, 0, "c", pos, cigar, seq, "".join(chr(33 + q) for q in qual), ref))
    return out


def test_capped_quality(spark):
    rows = some_alignments(1, 80) + [(100, 0, "c", 195, "4S30M", "A" * 34, "I" * 34, "A" * 200), (101, 0, "c", 198, "2M3D5M2S", "A" * 9, "I" * 9, "A" * 200), (102, 0, "c", 5, "4M", "ACGT", None, "A" * 200)]
    reads = spark.createDataFrame(rows, "key int, flag int, contig string, pos bigint, cigar string, seq string, qual string, ref string").withColumn("ref", F.expr("substring(ref, cast(pos as int), 1000)"))
    got = {r["key"]: r["cap"] for r in reads.select("key", realign.capped_quality(cg.placed(cg.blocks(F.col("cigar"))), F.col("seq"), F.col("qual"), F.col("ref")).alias("cap")).collect()}
    for i, _, _, pos, cigar, seq, qual, ref in rows:
        assert got[i] == (None if qual is None else plain_cap(cigar, seq, [ord(c) - 33 for c in qual], ref[pos - 1 :], 40)), (i, cigar)
    assert len(set(got.values())) > 10


def plain_glocal(ref, query, qual, band, d=0.001, e=0.1):
    """The HMM cell by cell: (place, inserted, quality) of each base."""
    n, m = len(query), len(ref)
    band = max(min(band, max(n, m)), abs(n - m))
    err, end = [10 ** (-q / 10) for q in qual], 1 / (2 * n + 2)
    emit = lambda i, k: 1.0 if ref[k - 1] not in "ACGT" or query[i - 1] not in "ACGT" else 1 - err[i - 1] if ref[k - 1] == query[i - 1] else err[i - 1] * 0.33333333333
    inside = lambda i: range(max(1, i - band), min(m, i + band) + 1)
    f, s = [{} for _ in range(n + 1)], [1.0] * (n + 2)
    get = lambda row, k, z: row.get((k, z), 0.0)
    for i in range(1, n + 1):
        for k in inside(i):
            if i == 1:
                f[1][k, 0], f[1][k, 1] = emit(1, k) * (1 - d) / m, 0.25 * d / m
                continue
            b = f[i - 1]
            f[i][k, 0] = emit(i, k) * ((1 - 2 * d) * (1 - end) * get(b, k - 1, 0) + (1 - e) * (1 - end) * get(b, k - 1, 1) + (1 - e) * get(b, k - 1, 2)) / s[i - 1]
            f[i][k, 1] = 0.25 * (d * (1 - end) * get(b, k, 0) + e * (1 - end) * get(b, k, 1)) / s[i - 1]
            f[i][k, 2] = d * (1 - end) * get(f[i], k - 1, 0) + e * get(f[i], k - 1, 2)
        s[i] = sum(f[i].values())
    s[n + 1] = sum((get(f[n], k, 0) + get(f[n], k, 1)) * end for k in inside(n)) / s[n]
    b = [{} for _ in range(n + 1)]
    for k in inside(n):
        b[n][k, 0] = b[n][k, 1] = end / s[n] / s[n + 1]
    for i in range(n - 1, 0, -1):
        raw = {}
        for k in reversed(inside(i)):
            x = 0.0 if k >= m else emit(i + 1, k + 1) * get(b[i + 1], k + 1, 0)
            raw[k, 1] = x * (1 - e) * (1 - end) + 0.25 * e * (1 - end) * get(b[i + 1], k, 1)
            raw[k, 0] = x * (1 - 2 * d) * (1 - end) + 0.25 * d * (1 - end) * get(b[i + 1], k, 1) + d * (1 - end) * get(raw, k + 1, 2)
            raw[k, 2] = (x * (1 - e) + e * get(raw, k + 1, 2)) * (i > 1)
        b[i] = {key: v / s[i] for key, v in raw.items()}
    out = []
    for i in range(1, n + 1):
        ways = {(k, z): get(f[i], k, z) * get(b[i], k, z) / s[i] for k in inside(i) for z in (0, 1)}
        (k, z), most = max(ways.items(), key=lambda w: (w[1], -w[0][0], -w[0][1]))
        wrong = 1 - most / sum(ways.values())
        q = 999 if wrong <= 0 else int(-4.343 * math.log(wrong) + 0.499)
        out.append((k - 1, z, 99 if q > 100 else q))
    return out


def test_forward_and_backward_passes():
    r = random.Random(4)
    for length, band in ((1, 7), (3, 2), (20, 7), (41, 3)):
        refs, queries, quals = [], [], []
        for _ in range(6):
            ref = "".join(r.choice("ACGTN" if r.random() < 0.1 else "ACGT") for _ in range(max(1, length + r.randint(-2, 6))))
            query = (ref[r.randint(0, 2) :] + "ACGT" * 20)[:length]
            refs.append(ref)
            queries.append("".join(c if r.random() > 0.1 else r.choice("ACGTN") for c in query))
            quals.append([r.randint(3, 40) for _ in range(length)])
        for ref, query, qual in zip(refs, queries, quals):
            wide = max(min(band, max(length, len(ref))), abs(length - len(ref)))
            place, inserted, quality = realign.glocal(realign._codes(ref)[None], np.array([len(ref)]), realign._codes(query)[None], np.array([qual]), wide)
            assert list(zip(place[0], inserted[0], quality[0])) == plain_glocal(ref, query, qual, band)
    # Reads of one length and band together, with references of several lengths.
    n_ref = np.array([len(x) for x in refs])
    wide = 8
    packed = np.full((len(refs), n_ref.max()), 4)
    for i, x in enumerate(refs):
        packed[i, : len(x)] = realign._codes(x)
    place, inserted, quality = realign.glocal(packed, n_ref, np.stack([realign._codes(x) for x in queries]), np.array(quals), wide)
    for i in range(len(refs)):
        assert list(zip(place[i], inserted[i], quality[i])) == plain_glocal(refs[i], queries[i], quals[i], wide)


def plain_baq(pos, cigar, seq, qual, ref, extended):
    ops, n = ops_of(cigar), len(seq)
    x, y, marks = pos - 1, 0, []
    for op, size in ops:
        if op == "N":
            return None
        if op in "M=X":
            marks.append((x, y, size))
        x += size if op in "M=XD" else 0
        y += size if op in "M=XSI" else 0
    if not marks:
        return None
    xb, yb, xe, ye = marks[0][0], marks[0][1], marks[-1][0] + marks[-1][2], marks[-1][1] + marks[-1][2]
    band = 7 if abs((xe - xb) - (ye - yb)) <= 7 else abs((xe - xb) - (ye - yb)) + 3
    xb, xe = max(0, xb - yb - band // 2), xe + n - ye + band // 2
    if xe - xb - n > band:
        xb += (xe - xb - n - band) // 2
        xe -= (xe - xb - n - band) // 2
    states = plain_glocal(ref[xb:xe], seq, qual, band)
    left = list(qual)
    for x, y, size in marks:
        own = [states[i][2] if states[i][1] == 0 and states[i][0] == x - xb + i - y else 0 for i in range(y, y + size)]
        if extended:
            own = [min(max(own[: i + 1]), max(own[i:])) for i in range(size)]
        left[y : y + size] = [min(a, b) for a, b in zip(qual[y : y + size], own)]
    return "".join(chr(q - k + 64) for q, k in zip(qual, left))


@pytest.mark.parametrize("extended", [False, True])
def test_base_alignment(spark, extended):
    rows = [(i, f, c, p, re.sub(r"\d+H", "", cigar), s, q, ref) for i, f, c, p, cigar, s, q, ref in some_alignments(2, 30)]
    rows += [(90, 4, None, 0, None, "ACGT", "IIII", ""), (91, 0, "c", 3, "2M5N2M", "ACGT", "IIII", "A" * 60), (92, 0, "c", 3, "4M", "ACGT", None, "A" * 60), (93, 0, "c", 3, "4S", "ACGT", "IIII", "A" * 60)]
    reads = spark.createDataFrame(rows, "key int, flag int, contig string, pos bigint, cigar string, seq string, qual string, ref string").withColumn("ref_beg", F.lit(1))
    got = {r["key"]: (r["bq"], r["left"]) for r in realign.with_base_alignment(reads, extended).collect()}
    for i, flag, _, pos, cigar, seq, qual, ref in rows:
        q = [ord(c) - 33 for c in qual or ""]
        want = None if flag & 4 or qual is None else plain_baq(pos, cigar, seq, q, ref, extended)
        assert got[i][0] == want, (i, cigar)
        assert got[i][1] == (qual if want is None else "".join(chr(33 + a - ord(b) + 64) for a, b in zip(q, want)))


def test_reference_under_reads(spark):
    text = "".join(random.Random(9).choice("ACGT") for _ in range(1000))
    reference = spark.createDataFrame([("c", k + 1, text[k : k + 64]) for k in range(0, 1000, 64)], "contig string, start bigint, seq string")
    rows = [(1, "c", 60, "5M3D10M"), (2, "c", 1, "4M"), (3, "c", 995, "20M"), (4, "d", 1, "4M"), (5, "c", 100, "200M")]
    reads = spark.createDataFrame(rows, "key int, contig string, pos bigint, cigar string")
    got = {r["key"]: (r["ref_beg"], r["ref"]) for r in realign.with_reference(reads, reference, "key", 3, 64).collect()}
    assert got == {1: (57, text[56:80]), 2: (1, text[:7]), 3: (992, text[991:]), 4: (1, ""), 5: (97, text[96:302])}
