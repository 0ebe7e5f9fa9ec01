"""Quality rules by weak supervision: rules vote, expectation-maximisation weighs them.

Every rule looks at counts of one document and votes good (1), bad (-1) or abstains (0).
Nobody says which documents are good; the rules' accuracies and the share of good documents
are estimated together by expectation-maximisation over the counts of vote patterns, and a
document is judged by its posterior probability, not by an all-must-pass filter.

Only built-in functions are used, so everything runs in the JVM and no text is shuffled:
a document's counts come from its own row, and just the vote patterns (at most 3 to the
number of rules, whatever the input) are aggregated across documents.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import to_table

# Fixed values of the contract.
WORD_GAP = r"[\x20\x09-\x0D]+"
WORD_CHAR = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: name, SQL condition of a bad vote, SQL condition of a good vote (looked at in this order).
RULES: list[tuple[str, str, str]] = [
    ("length", "n_words < 50", "n_words >= 80"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 12 * n_words", "word_chars between 3 * n_words and 10 * n_words"),
    ("symbols", "10 * n_symbols > n_words", "100 * n_symbols <= n_words"),
    ("dup_lines", "10 * n_dup_lines > 3 * n_lines", "n_dup_lines = 0 and n_lines > 1"),
    ("repeats", "10 * n_repeat_words > 4 * n_words", "10 * n_repeat_words <= n_words"),
    ("capitals", "10 * n_capitals > 3 * word_chars", "10 * n_capitals <= word_chars"),
    ("exclaims", "10 * n_exclaims > n_words", "100 * n_exclaims <= n_words"),
]
ITERATIONS = 10
PRIOR_GOOD = 0.8
ACCURACY = 0.85


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_row: bool = False) -> DataFrame:
    """Per row of ``docs``: its id and the counts that the rules look at (all long).

    With ``keep_row`` the first column is the whole row as a struct in place of the id.
    """
    first = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if keep_row else F.col(id_col)
    d = docs.select(first.alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    d = d.select("doc_id", "t", F.array_remove(F.split("t", WORD_GAP), "").alias("w"))
    d = d.select("doc_id", "t", "w", F.size("w").alias("n"))
    windows = F.sort_array(F.arrays_zip(
        F.slice("w", 1, F.col("n") - 2), F.slice("w", 2, F.col("n") - 2), F.slice("w", 3, F.col("n") - 2), F.sequence(F.lit(1), F.col("n") - 2)
    ))
    d = d.select("doc_id", "t", "n", F.length(F.array_join("w", "")).alias("chars"), F.when(F.col("n") >= 4, windows).alias("s"))

    def same(x: Column, y: Column) -> Column:
        return (x["0"] == y["0"]) & (x["1"] == y["1"]) & (x["2"] == y["2"])

    found = F.filter("s", lambda x, i: same(x, F.get("s", i - 1)) | same(x, F.get("s", i + 1)))
    d = d.select("doc_id", "t", "n", "chars", found.alias("p"),
                 F.filter(F.split("t", "\n", -1), lambda x: x.rlike(WORD_CHAR)).alias("lines"))
    d = d.withColumn("p", F.when(F.size("p") > 0, F.transform("p", lambda x: x["3"])))
    covered = F.concat("p", F.transform("p", lambda x: x + 1), F.transform("p", lambda x: x + 2))

    def times(pattern: str) -> Column:
        return F.regexp_count("t", F.lit(pattern)).cast("long")

    return d.select(
        "doc_id", F.col("n").cast("long").alias("n_words"), F.col("chars").cast("long").alias("word_chars"),
        times(SYMBOL).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("p").isNull(), 0).otherwise(F.size(F.array_distinct(covered))).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"), times("[A-Z]").alias("n_capitals"), times("!").alias("n_exclaims"),
    )


def _votes() -> list[str]:
    return [f"case when {bad} then -1 when {good} then 1 else 0 end as v{j}" for j, (_, bad, good) in enumerate(RULES)]


@dataclass
class LabelModel:
    """Share of good documents and, for each rule, P(vote | good) and P(vote | bad)."""

    good: float
    #: by rule: ((P(-1|good), P(0|good), P(1|good)), (the same given bad))
    votes: list[tuple[tuple[float, ...], tuple[float, ...]]]

    @staticmethod
    def start() -> LabelModel:
        third = (1 - ACCURACY) / 2
        return LabelModel(PRIOR_GOOD, [((third, third, ACCURACY), (ACCURACY, third, third))] * len(RULES))

    def posterior(self, votes: tuple[int, ...]) -> float:
        x = math.log(self.good / (1 - self.good)) + sum(math.log(g[v + 1] / b[v + 1]) for v, (g, b) in zip(votes, self.votes, strict=True))
        return 1 / (1 + math.exp(-x))

    def logit_sql(self) -> str:
        """Log odds of good given the columns v0, v1, ..."""
        parts = [repr(math.log(self.good / (1 - self.good)))]
        for j, (g, b) in enumerate(self.votes):
            low, none, high = (math.log(x / y) for x, y in zip(g, b, strict=True))
            parts.append(f"case v{j} when -1 then {low!r} when 1 then {high!r} else {none!r} end")
        return " + ".join(f"cast({p} as double)" for p in parts)


def fit(patterns: list[tuple[tuple[int, ...], float]], iterations: int = ITERATIONS) -> LabelModel:
    """Expectation-maximisation over ``(votes, count)`` pairs, in the order given.

    Each count gets half an observation of smoothing.  A rule never counts for the side that it
    votes against (its good vote is at least as likely given good as given bad, and the other
    way round), so that the two classes can't change places.  No patterns: the start values.
    """
    model = LabelModel.start()
    for _ in range(iterations if patterns else 0):
        g = [[0.5] * 3 for _ in RULES]
        b = [[0.5] * 3 for _ in RULES]
        good, bad = 0.0, 0.0
        for votes, n in patterns:
            p = model.posterior(votes)
            good, bad = good + n * p, bad + n * (1 - p)
            for j, v in enumerate(votes):
                g[j][v + 1] += n * p
                b[j][v + 1] += n * (1 - p)
        both = []
        for j in range(len(RULES)):
            x, y = [v / (good + 1.5) for v in g[j]], [v / (bad + 1.5) for v in b[j]]
            y[0], y[2] = max(y[0], x[0]), min(y[2], x[2])
            both.append((tuple(x), tuple(y)))
        model = LabelModel((good + 0.5) / (good + bad + 1), both)
    return model


def fit_on(voted: DataFrame) -> LabelModel:
    """The model of the vote columns of ``voted``.

    Only the counts of vote patterns reach the driver: at most 3 to the number of rules rows,
    whatever the size of the input.
    """
    names = [f"v{j}" for j in range(len(RULES))]
    rows = voted.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()
    return fit(sorted((tuple(r[c] for c in names), float(r["n"])) for r in rows))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: counts, votes' posterior and the verdict.

    Null texts count as empty, so they fail the base test; ids may be null or repeated, as
    nothing is joined by them; other columns of ``docs`` are not looked at, whatever their
    names; equal texts get equal verdicts; an empty table gives an empty one.
    """
    seen = to_table(counts(docs, id_col, text_col), "quality-counts")
    voted = seen.selectExpr("*", *_votes())
    model = fit_on(voted)
    failed = f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"
    out = voted.selectExpr(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        f"({failed}) as base_failed", f"1 / (1 + exp(-({model.logit_sql()}))) as p_good",
    )
    return out.selectExpr(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "(not base_failed and p_good >= 0.5) as kept", "round(p_good, 6) as p_good",
    )


def good_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns, that :func:`judge` keeps.

    Counts and rows are written together once: the model is fitted on the votes, then the verdict
    is read beside each row, so repeated or null ids are no matter and no text is shuffled.
    Null texts count as empty and go; equal texts stay or go together; an empty table gives an
    empty one.
    """
    failed = f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"
    seen = counts(docs, id_col, text_col, keep_row=True).selectExpr("doc_id as row_", f"({failed}) as failed_", *_votes())
    seen = to_table(seen, "quality-rows")
    model = fit_on(seen)
    kept = seen.where(F.expr(f"not failed_ and 1 / (1 + exp(-({model.logit_sql()}))) >= 0.5"))
    return kept.select(*[F.col(f"row_.`{c}`") for c in docs.columns])
