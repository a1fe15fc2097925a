"""Conversation repair and chat formatting against plain versions; defined cases."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from locusflow.llm import chat, repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def plain(rows):
    """(counts, cost, audit, repaired lines) of one conversation: the best string for each state, row by row."""
    faults, seen = [], set()
    for _, role, text in rows:
        shown = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {"": (0, "", ())}  # the initials so far, as far as they matter, to cost, audit, lines
    turn = lambda s: "a" if s.endswith("u") else "u"
    names = {"u": "user", "a": "assistant"}

    def offer(to, state, way):
        to[state] = min(to.get(state, way), way)

    def with_inserts(states):
        out = dict(states)
        for _ in range(4):
            for s, (c, audit, lines) in list(out.items()):
                offer(out, turn(s), (c + 3, audit + "I", (*lines, f"{names[turn(s)]}:")))
        return out

    for (_, role, text), fault in zip(rows, faults):
        new = {}
        for s, (c, audit, lines) in with_inserts(best).items():
            offer(new, s, (c + 4, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more, first = 3 * (fault == "truncated"), role[:1]
            offer(new, turn(s), (c + 3 + more, audit + "R", (*lines, f"{names[turn(s)]}:{text}")))
            if first == "s" and s == "" or first in ("u", "a") and first == turn(s):
                offer(new, first, (c + more, audit + "K", (*lines, f"{role}:{text}")))
        best = new
    cost, audit, lines = min(way for s, way in with_inserts(best).items() if s in ("", "a"))
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return {"gaps": gaps, **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")}, "illegal": illegal, "cost": cost, "audit": audit}, "\n".join(lines)


def talk(seed):
    r = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "usher", "tool", " ", ""], ["yes.", "no", "What?", " ", "", "why\n", "go! \t", "é."]
    return [(t, r.choice(roles[: r.choice([2, 3, 7])]), f"{r.choice(texts)}{r.choice(['', '', ' more.', 'x'])}") for t in sorted(r.sample(range(40), r.randint(1, 17)))]


@pytest.mark.parametrize("chunk", [1, 3, 4096])
def test_repair_in_chunks(spark, chunk):
    talks = {i: talk(i) for i in range(40)}
    talks[40] = [(t, ("user", "assistant")[t % 3 == 0], f"line {t}{'.' * (t % 5 > 0)}") for t in range(120)]
    rows = [(i, *row) for i, own in talks.items() for row in own]
    random.Random(1).shuffle(rows)
    done, repaired = repair.repair(spark.createDataFrame(rows, SCHEMA).repartition(5), chunk)
    got = {r["conv_id"]: r.asDict() for r in done.collect()}
    lines = {}
    for r in sorted(repaired.collect(), key=lambda r: (r["chunk"], r["place"])):
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for i, own in talks.items():
        counts, text = plain(own)
        assert {k: got[i][k] for k in counts} == counts, own
        assert "\n".join(lines.get(i, [])) == text


def test_hirschberg_meets_what_whole_tables_say():
    for seed in range(300):
        r = random.Random(seed)
        codes = bytes(r.choice([0, 1, 2, 1, 2, 3, 5, 6, 8, 9, 10]) for _ in range(r.randint(1, 30)))
        steps = [repair.STEPS[c] for c in codes]
        best = {0: (0, "")}
        for step in steps:
            new = {}
            for p, (c, audit) in best.items():
                for q, more, letters in step[p]:
                    new[q] = min(new.get(q, (repair.NONE,)), (c + more, audit + letters))
            best = new
        cost, rank = repair.forward(steps, 0, len(steps), 0)
        assert {q: cost[q] for q in best} == {q: c for q, (c, _) in best.items()}
        assert sorted(best, key=lambda q: best[q][1]) == sorted(best, key=lambda q: rank[q])
        for q in best:
            assert repair.solved(codes, 0, q) == best[q][1]


def test_repair_of_odd_rows(spark):
    """Nulls everywhere, ties, repeated rows, a null conversation, long texts, clashing columns; an empty table."""
    long = "word " * 200_000 + "."
    rows = [(1, None, None, None), (1, None, "user", "a."), (1, 0, "assistant", None), (2, 5, "user", "x."), (2, 5, "user", "x."), (2, 5, "user", "x."), (2, 9, "assistant", "y."), (None, 1, "user", long), (None, 2, "assistant", "z."), (3, 1, None, "t")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("other") for c in ("codes", "chunk", "place", "h1", "kind", "first", "count")})
    done, repaired = repair.repair(docs, 2)
    got = {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["illegal"], r["cost"], r["audit"]) for r in done.collect()}
    assert got == {1: (0, 2, 0, 1, 11, "DKDI"), 2: (3, 0, 2, 2, 8, "KDDK"), None: (0, 0, 0, 0, 0, "KK"), 3: (0, 0, 0, 0, 4, "D")}
    assert max(len(r["text"]) for r in repaired.collect()) == len(long)
    none, nothing = repair.repair(spark.createDataFrame([], SCHEMA))
    assert none.count() == 0 and nothing.count() == 0


def test_damage():
    """The checksum settles the damage: five of twenty residues, by conv_id and turn."""
    import zlib

    assert zlib.crc32(b"12:3") % 20 in range(20) and zlib.crc32(b" : ") % 20 in range(20)


TURNS = [("system", "Be brief."), ("user", r"a\b ### x </turn> \</turn>"), ("assistant", "</turn>\n### User: no"), ("user", ""), ("assistant", "<"), ("a:b ### </turn>\\", "\\"), ("", "é\U0001f600 \\"), ("assistant", " </turn>\n")]


def test_marked_template_is_reversible():
    t = chat.Marked()
    assert t.parse(t.render(TURNS)) == TURNS
    r = random.Random(3)
    for _ in range(500):
        turns = [("".join(r.choice([":", "\\", "###", " ", "</turn>", "u", "\n"]) for _ in range(r.randint(0, 5))), "".join(r.choice(["\\", "###", "#", " ", "</turn>", "</turn", ">", "\n", "x"]) for _ in range(r.randint(0, 9)))) for _ in range(r.randint(0, 4))]
        assert t.parse(t.render(turns)) == turns
    with pytest.raises(ValueError):
        t.parse("### user: a")


@pytest.mark.parametrize("window", [1, 2, 3, 100])
def test_spans_by_prefixes(window):
    t = chat.Marked()
    whole, rewrites_at, found = chat.spans(t.render, TURNS, window)
    assert rewrites_at is None and whole == t.render(TURNS)
    assert [t.restored(whole[a:b]) for _, _, _, a, b in found] == [text for _, text in TURNS]
    assert "".join(whole[a:b] for _, a, b, _, _ in found) == whole


def test_other_templates():
    """Any callable: with a head, numbered turns (which cut prefixes get wrong and whole ones right), history rewritten late or early, texts that can't be told."""
    head = lambda turns: "<s>" + "".join(f"[{r}]{x}[/{r}]" for r, x in turns)
    numbered = lambda turns: "".join(f"{k}|{x}|" for k, (_, x) in enumerate(turns))
    turns = [("user", f"t{k}") for k in range(9)]
    for render in (head, numbered):
        for window in (1, 2, 50):
            whole, at, found = chat.spans(render, turns, window)
            assert at is None and [whole[a:b] for _, _, _, a, b in found] == [x for _, x in turns] and found[-1][2] == len(whole)
    forgets = lambda turns: "".join(f"[{x if k > len(turns) - 4 else '-'}]" for k, (_, x) in enumerate(turns))
    ends = lambda turns: "".join(f"[{x}]" for _, x in turns) + "<end>"
    assert chat.spans(forgets, turns, 50)[1:] == (3, []) and chat.spans(forgets, turns, 2)[1:] == (3, []) and chat.spans(ends, turns, 50)[1:] == (0, [])
    with pytest.raises(ValueError):
        chat.spans(lambda turns: "".join(f"{len(x)};" for _, x in turns), turns)


def test_formatted_rows(spark):
    rows = [(1, 2, "assistant", "b"), (1, None, "user", "first"), (1, 1, "user", None), (None, 1, None, "x"), (2, 1, "assistant", "c"), (2, 1, "assistant", "c"), (3, 0, "assistant", "y" * 3_000_000)]
    rows += [(4, k, ("user", "assistant")[k % 2], f"t{k} ###") for k in range(150)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("formatted", "spans", "n_turns")})
    t = chat.Marked()
    got = {r["conv_id"]: r.asDict() for r in chat.masked(chat.formatted(docs, t.render), t).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha("user\nfirst\nuser\n\nassistant\nb\n") and got[1]["loss_sha256"] == sha("b")
    assert got[None]["turns_sha256"] == sha("\nx\n") and (got[None]["loss_chars"], got[None]["loss_sha256"]) == (0, sha(""))
    assert (got[2]["n_turns"], got[2]["loss_sha256"]) == (2, sha("cc")) and got[3]["loss_chars"] == 3_000_000
    assert got[4]["loss_sha256"] == sha("".join(f"t{k} ###" for k in range(1, 150, 2)))
    assert chat.formatted(spark.createDataFrame([], SCHEMA), t.render).count() == 0
