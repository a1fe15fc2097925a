"""Quality filtering by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Everything runs as DataFrame expressions. One pass over the texts computes the features and the votes and
writes them as a narrow table. The vote patterns (at most 3 to the number of rules, whatever the input size)
are counted, one fold over that small array estimates each rule's accuracies and the share of good documents,
and a scalar subquery hands the estimates to the scoring projection.

Defined results: a null or empty text has no words and fails the base test; extra columns pass through
untouched, and one that bears the name of a column that is added is refused with a ValueError; repeated rows are scored
one by one and equal texts get equal verdicts; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusflow.llm.common import words, written

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 8
#: Common words of the four languages, as they stand inside a sentence.
STOP_WORDS = "the and of to in is that le la les de et des que der die und den das el los y en un una con a".split()


@dataclass(frozen=True)
class Rule:
    """A rule abstains unless a bound is met: ``good`` and ``junk`` are boolean columns, good first."""

    name: str
    good: Column
    junk: Column

    def vote(self) -> Column:
        return F.when(self.good, 1).when(self.junk, -1).otherwise(0)


def _stage(df: DataFrame, **columns: Column) -> DataFrame:
    return df.withColumns(columns)


#: The columns that are added.
ADDED = {"n_words", "word_chars", "n_symbols", "n_shouts", "n_upper", "n_stops", "n_distinct", "n_lines", "n_dup_lines", "n_repeat_words", "votes", "base_failed", "quality", "kept"}


def _free(columns: list[str]) -> None:
    if taken := sorted(ADDED.intersection(c.lower() for c in columns)):
        raise ValueError(f"columns of these names are added: {taken}")


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the base features: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and more.

    n_repeat_words counts the words inside 8-word windows that occur at least twice in the text.
    """
    _free(docs.columns)
    t = F.coalesce(F.col(text), F.lit(""))
    df = _stage(docs, __words=words(F.col(text)))
    df = _stage(
        df,
        n_words=F.size("__words").cast("long"),
        __hash=F.transform("__words", lambda w: F.xxhash64(w)),
        word_chars=F.length(F.translate(t, SPACES, "")).cast("long"),
        n_symbols=(F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        n_shouts=(F.length(t) - F.length(F.translate(t, "!", ""))).cast("long"),
        n_upper=(F.length(t) - F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long"),
        n_stops=F.size(F.filter("__words", lambda w: w.isin(STOP_WORDS))).cast("long"),
        n_distinct=F.size(F.array_distinct("__words")).cast("long"),
        __lines=F.filter(F.split(t, "\n"), lambda x: F.translate(x, SPACES, "") != ""),
    )
    at = lambda i, k: F.get(F.col("__hash"), i + k)
    df = _stage(
        df,
        n_lines=F.size("__lines").cast("long"),
        n_dup_lines=(F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        __windows=F.when(
            F.col("n_words") > WINDOW,
            F.transform(F.sequence(F.lit(0), (F.col("n_words") - WINDOW).cast("int")), lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)])),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    # Only texts with a repeated window go on; for the others the arrays below are empty.
    df = _stage(df, __twice=F.when(F.size(F.array_distinct("__windows")) < F.size("__windows"), F.col("__windows")).otherwise(F.array().cast("array<bigint>")))
    df = _stage(df, __sorted=F.array_sort(F.transform("__twice", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = _stage(
        df,
        __pairs=F.filter(
            F.zip_with("__sorted", F.slice("__sorted", 2, F.greatest(F.size("__sorted"), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
            lambda p: p["a"]["h"] == p["b"]["h"],
        ),
    )
    df = _stage(df, __starts=F.sort_array(F.array_union(F.transform("__pairs", lambda p: p["a"]["i"]), F.transform("__pairs", lambda p: p["b"]["i"]))))
    df = _stage(
        df,
        n_repeat_words=F.aggregate(
            F.zip_with("__starts", F.slice("__starts", 2, F.greatest(F.size("__starts"), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)).cast("long")),
            F.lit(0).cast("long"),
            lambda s, x: s + x,
        ),
    )
    return df.drop("__words", "__hash", "__lines", "__windows", "__twice", "__sorted", "__pairs", "__starts")


def rules() -> list[Rule]:
    """The labelling rules over the features."""
    n, c = F.col("n_words"), F.col("word_chars")
    return [
        Rule("symbols", F.col("n_symbols") * 100 <= n, F.col("n_symbols") * 5 >= n),
        Rule("upper", F.col("n_upper") * 8 <= c, F.col("n_upper") * 4 >= c),
        Rule("shouts", F.col("n_shouts") * 100 <= n, F.col("n_shouts") * 5 >= n),
        Rule("word_length", (c >= 3 * n) & (c <= 7 * n), (c < 2 * n) | (c > 8 * n)),
        Rule("stop_words", F.col("n_stops") * 10 >= n, F.col("n_stops") * 20 < n),
        Rule("repeat_lines", F.col("n_dup_lines") == 0, (F.col("n_dup_lines") * 4 >= F.col("n_lines")) & (F.col("n_lines") >= 3)),
        Rule("repeat_words", F.col("n_repeat_words") * 50 <= n, F.col("n_repeat_words") * 5 >= n),
        Rule("variety", F.col("n_distinct") * 3 >= n, F.col("n_distinct") * 6 <= n),
    ]


#: The first guess at how rules vote (junk, abstain, good) on good and on junk documents, and the share of good ones.
GUESS_GOOD, GUESS_JUNK, GUESS_PRIOR = (0.02, 0.08, 0.9), (0.4, 0.2, 0.4), 0.85


def estimate(votes: DataFrame, n_rules: int, rounds: int = 25, anchor: float = 0.02) -> DataFrame:
    """One row ``model``: prior, and the chances good and junk of the votes -1, 0, 1 of each rule, three by three.

    votes has the column ``votes`` (array of 1, -1, 0). Rules vote independently given the class, abstentions
    included. The first guess counts as ``anchor`` times the number of documents in each round, which fixes
    the class that is called good.
    """
    patterns = votes.groupBy("votes").agg(F.count("*").cast("double").alias("n")).agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("patterns"))
    cells = F.sequence(F.lit(0), F.lit(3 * n_rules - 1))
    guesses = {k: F.flatten(F.array_repeat(F.array(*map(F.lit, g)), n_rules)) for k, g in (("good", GUESS_GOOD), ("junk", GUESS_JUNK))}

    def posterior(state: Column, v: Column) -> Column:
        terms = F.aggregate(
            F.transform(v, lambda x, i: F.log(F.get(state["good"], 3 * i + x + 1) / F.get(state["junk"], 3 * i + x + 1))),
            F.log(state["prior"] / (F.lit(1.0) - state["prior"])),
            lambda s, t: s + t,
        )
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-terms))

    def total(patterns: Column, post: Column, weigh) -> Column:
        return F.aggregate(F.zip_with(patterns, post, weigh), F.lit(0.0), lambda s, x: s + x)

    def step(state: Column, k: Column) -> Column:
        p, q = F.col("patterns"), state["post"]
        expect = F.struct(state["prior"].alias("prior"), state["good"].alias("good"), state["junk"].alias("junk"), F.transform(p, lambda x: posterior(state, x["votes"])).alias("post"))
        every = F.aggregate(p, F.lit(0.0), lambda s, x: s + x["n"])
        pull = anchor * every + 1

        def chances(kind: str, of) -> Column:
            mass = total(p, q, lambda x, y: x["n"] * of(y))
            cell = lambda i: total(p, q, lambda x, y: F.when(F.get(x["votes"], (i / 3).cast("int")) == i % 3 - 1, x["n"] * of(y)).otherwise(F.lit(0.0)))
            return F.transform(cells, lambda i: (pull * F.get(guesses[kind], i) + cell(i)) / (pull + mass))

        prior = (pull * GUESS_PRIOR + total(p, q, lambda x, y: x["n"] * y)) / (pull + every)
        maximise = F.struct(prior.alias("prior"), chances("good", lambda y: y).alias("good"), chances("junk", lambda y: F.lit(1.0) - y).alias("junk"), q.alias("post"))
        return F.when(k % 2 == 1, expect).otherwise(maximise)

    start = F.struct(F.lit(GUESS_PRIOR).alias("prior"), guesses["good"].alias("good"), guesses["junk"].alias("junk"), F.array().cast("array<double>").alias("post"))
    finish = lambda s: F.struct(s["prior"].alias("prior"), s["good"].alias("good"), s["junk"].alias("junk"))
    return patterns.select(F.aggregate(F.sequence(F.lit(1), F.lit(2 * rounds)), start, step, finish).alias("model"))


def score(docs: DataFrame, text: str = "text", keep: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """Columns ``keep`` of docs (all but the text by default) with the features, base_failed, quality and kept.

    quality is the posterior probability that the document is good; kept is false where the base test fails.
    """
    chosen = rules()
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    voted = features(docs.select(*dict.fromkeys([*keep, text])), text).withColumn("votes", F.array(*[r.vote() for r in chosen])).drop(*({text} - set(keep)))
    voted = written(voted, "votes")
    model = estimate(voted, len(chosen)).scalar()
    odds = F.log(model["prior"] / (F.lit(1.0) - model["prior"]))
    for i in range(len(chosen)):
        cell = F.get("votes", F.lit(i)) + (3 * i + 1)
        odds = odds + F.log(F.get(model["good"], cell) / F.get(model["junk"], cell))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return voted.withColumn("base_failed", failed).withColumn("quality", F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def query(spark, sf_dir: str) -> DataFrame:
    """op4: the base features and the verdict for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs.select("doc_id", "text"), keep=["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality"))
