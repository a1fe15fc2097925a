"""Small fixtures and brute-force versions of the operators."""

import random
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COMMON = "the of and to in is that with for was".split()


def vocabulary(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice(["th", "er", "on", "an", "re", "ti", "es", "or", "é", "ng"]) for _ in range(r.randint(2, 4))) for _ in range(n)]


def prose(seed: int, n: int) -> str:
    r, words = random.Random(seed), vocabulary(7, 900)
    return " ".join(r.choice(COMMON) if r.random() < 0.3 else r.choice(words) for _ in range(n))


def corpus() -> list[tuple]:
    """(doc_id, text, source): passages, copies, near copies, chains, odd rows."""
    r, rows = random.Random(5), []
    passage = prose(100, 60)
    for i in range(30):
        rows.append((i, f"{prose(i, 80)}\n{passage if i % 4 == 0 else ''} {prose(1000 + i, 40)}", f"s{i % 4}"))
    base = prose(55, 120).split()
    for i in range(40, 60):
        copy = list(base)
        for _ in range(2 + i % 3):
            copy[r.randrange(len(copy))] = f"edit{i}{r.randrange(99)}"
        rows.append((i, " ".join(copy), "s1"))
    chain = prose(66, 200).split()
    rows += [(70 + k, " ".join(chain[10 * k : 10 * k + 120]), "s2") for k in range(6)]
    rows += [(80, rows[3][1], "s0"), (81, rows[3][1], "s0"), (82, "", "s3"), (83, None, "s3"), (84, "one two three", None), (85, "One  two\tthree", None), (86, "same " * 90, "s1"), (87, " \n\t ", None)]
    rows += [(88, None, "s3"), (89, "a|b # $ 100%\n" * 12, "s2"), (90, "é" * 3000, "s2")]
    return rows


def substring_dedup(rows: list[tuple]) -> dict:
    """doc_id to (n_words, n_removed, kept words)."""
    seen, out = set(), {}
    for i, text, *_ in sorted(rows):
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for j in range(len(w) - 19):
            k = tuple(w[j : j + 20])
            if k in seen:
                gone[j : j + 20] = [True] * 20
            seen.add(k)
        out[i] = len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)
    return out


def classes(rows: list[tuple]) -> dict:
    """doc_id to (set size, smallest linked id)."""
    sets = {}
    for i, text, *_ in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    ids, root = sorted(sets), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            k = len(sets[a] & sets[b])
            if a < b and k and 100 * k >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def base_features(text: str | None) -> tuple:
    t = text or ""
    w = WORD.findall(t)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def targets(rows: list[tuple]) -> dict:
    """source to target by repeated resharing."""
    size = defaultdict(int)
    for _, text, source in rows:
        size[source] += len(WORD.findall(text or ""))
    names = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, open_, out = 1.5 * sum(size.values()), set(names), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] >= 2 * size[s]}
        if not over:
            out |= {s: share * weight[s] for s in open_}
            break
        out |= {s: 2.0 * size[s] for s in over}
        left -= sum(2 * size[s] for s in over)
        open_ -= over
    return out
