"""Licence scans by ordered signature rules.

A document is a list of words; a rule is a regular expression that must match from a given
word on; as many words are looked at as its rules can span.  Three gates keep the rules cheap: a document is looked at only if it holds one of a
few keywords, a word only if some rule starts with it, and then just the rules of that word
are tried.  Overlapping detections are resolved by order: one that lies inside another of
higher priority (or the same priority and more words, or else the earlier rule) is dropped.

Only built-in functions are used and no row leaves its partition.
"""

from __future__ import annotations

import re._constants as rc
import re._parser as rp
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import FORMS, NAMES, PASSAGES

# Fixed values of the contract.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BASE = [("mit", ["mit", "license"]), ("apache", ["apache", "license"]), ("gpl", ["general", "public", "license"])]

#: Least length of a gate; shorter ones stand in most texts.
GATE_LENGTH = 5


def _heads(items, heads: set[str]) -> set[str]:
    """``heads`` carried on through a parsed expression, each up to its first space."""
    for op, arg in items:
        done = {h for h in heads if " " in h}
        if done == heads:
            break
        more = heads - done
        if op is rc.LITERAL:
            more = {h + chr(arg) for h in more}
        elif op is rc.IN and all(kind is rc.LITERAL for kind, _ in arg):
            more = {h + chr(c) for h in more for _, c in arg}
        elif op is rc.SUBPATTERN:
            more = _heads(arg[-1], more)
        elif op is rc.BRANCH:
            more = set().union(*[_heads(part, more) for part in arg[1]])
        elif op is rc.MAX_REPEAT and arg[:2] == (0, 1):
            more = more | _heads(arg[2], more)
        else:
            raise ValueError(f"an opening word can't have {op}")
        heads = done | more
    return heads


def _openings(expression: str) -> list[str]:
    """All words that a match of ``expression``, which is followed by a space, can begin with."""
    words = {h.split(" ")[0] for h in _heads(rp.parse(expression + " "), {""})}
    if not all(words):
        raise ValueError(f"no opening word: {expression}")
    return sorted(words)


def _spaces(items) -> int:
    """Spaces that a match of a parsed expression can hold; of any characters, every second one may be a space."""
    n = 0
    for op, arg in items:
        if op is rc.LITERAL:
            n += arg == 32
        elif op is rc.SUBPATTERN:
            n += _spaces(arg[-1])
        elif op is rc.BRANCH:
            n += max(_spaces(part) for part in arg[1])
        elif op is rc.MAX_REPEAT:
            _, most, what = arg
            any_ = what[0][0] is rc.ANY
            each = 1 if any_ else _spaces(what)
            if each and most is rc.MAXREPEAT:
                raise ValueError("a signature has no bound")
            n += (most + 1) // 2 if any_ else most * each if each else 0
        elif op is not rc.AT and (op is not rc.IN or not all(kind in (rc.LITERAL, rc.RANGE) and value != 32 for kind, value in arg)):
            raise ValueError(f"spaces of {op} can't be counted")
    return n


def reach(expression: str) -> int:
    """Words that a match of ``expression`` can span, with the one after it."""
    return _spaces(rp.parse(expression)) + 1


@cache
def rules() -> list[tuple[int, str, str, int, str]]:
    """(number, opening word, label, priority, expression), ordered; a rule stands there once for each of its opening words."""
    out = [(priority, label, text) for label, priority, text in PASSAGES]
    for priority, before, after in FORMS:
        out += [(priority, label, before + name + after) for label, name in NAMES]
    return [(i, word, label, p, f"^({text}) ") for i, (p, label, text) in enumerate(out) for word in _openings(text)]


def _runs(expression: str) -> list[str]:
    """Letters and digits that stand in a row in every match of ``expression``, if there are enough of them."""
    literal = [chr(arg) if op is rc.LITERAL else " " for op, arg in rp.parse(expression)]
    return [run for run in "".join(literal).split() if len(run) >= GATE_LENGTH]


def _gates() -> list[str]:
    """Parts of single words, such that each rule and each base phrase needs one of them.

    The part that most of the rules need comes first, then the one that most of the others need.
    """
    left = [_runs(text[2:-2]) for _, _, _, _, text in rules()] + [parts for _, parts in BASE]
    if not all(left):
        raise ValueError("a rule has no word that all its matches hold")
    out = []
    while left:
        out.append(min({run for runs in left for run in runs}, key=lambda g: (-sum(any(g in run for run in runs) for runs in left), -len(g), g)))
        left = [runs for runs in left if not any(out[-1] in run for run in runs)]
    return out


#: Each rule needs one of these in the lower-cased text, whatever stands between its words.
GATES = _gates()


def _rule_map() -> Column:
    by_word: dict[str, list[str]] = {}
    for i, word, label, p, text in rules():
        by_word.setdefault(word, []).append(f"named_struct('n', {i}, 'label', '{label}', 'p', {p}, 're', r'{text}')")
    return F.expr("map(" + ", ".join(f"'{w}', array({', '.join(r)})" for w, r in by_word.items()) + ")")


def _reach_map() -> Column:
    """How many words the longest rule of each opening word can span."""
    by_word: dict[str, int] = {}
    for _, word, _, _, text in rules():
        by_word[word] = max(by_word.get(word, 0), reach(text))
    return F.expr("map(" + ", ".join(f"'{w}', {n}" for w, n in by_word.items()) + ")")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: words, base phrases, labels, score and the detections.

    Null texts count as empty: no words, no labels (empty strings), null first_word and
    last_word, score 0.  Ids may be null or repeated; other columns are not looked at.  Equal
    texts get equal results; an empty table gives an empty one.  ``detections`` has the
    accepted spans (start and end in words, label, priority) in order of start.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    low = F.lower("t")
    gate = F.lit(False)
    for g in GATES:
        gate = gate | low.contains(g)
    d = d.select("doc_id", "t", gate.alias("gate"))
    words = F.regexp_extract_all(F.translate("t", UPPER, LOWER), F.lit(WORD), F.lit(0))
    d = d.select("doc_id", F.regexp_count("t", F.lit(WORD_ANY_CASE)).cast("long").alias("n_words"), F.when(F.col("gate"), words).alias("w"))
    keys = sorted({r[1] for r in rules()} | {b[1][0] for b in BASE})
    d = d.select("doc_id", "n_words", "w", F.filter(F.transform("w", lambda x, i: F.struct(x.alias("k"), i.alias("i"))), lambda c: c["k"].isin(keys)).alias("c"))

    def phrase(c: Column, parts: list[str]) -> Column:
        hit = c["k"] == parts[0]
        for j, part in enumerate(parts[1:], 1):
            hit = hit & F.coalesce(F.get("w", c["i"] + j) == part, F.lit(False))
        return hit

    def base_label(c: Column) -> Column:
        out = F.lit(None).cast("string")
        for label, parts in BASE:
            out = F.when(phrase(c, parts), F.lit(label)).otherwise(out)
        return out

    based = F.filter(F.transform("c", lambda c: F.struct(c["i"].alias("i"), base_label(c).alias("label"))), lambda c: c["label"].isNotNull())
    span = _reach_map()
    context = F.transform("c", lambda c: F.struct(c["k"].alias("k"), c["i"].alias("i"), F.concat(F.array_join(F.slice("w", c["i"] + 1, F.coalesce(F.try_element_at(span, c["k"]), F.lit(0))), " "), F.lit(" ")).alias("x")))
    d = d.select("doc_id", "n_words", based.alias("b"), context.alias("c"))
    table = _rule_map()

    def hits(c: Column) -> Column:
        found = F.filter(F.try_element_at(table, c["k"]), lambda r: F.rlike(c["x"], r["re"]))
        return F.coalesce(F.transform(found, lambda r: F.struct(
            c["i"].alias("start"),
            (c["i"] + F.size(F.split(F.call_function("regexp_extract", c["x"], r["re"], F.lit(1)), " "))).alias("end"),
            r["p"].alias("p"), r["n"].alias("n"), r["label"].alias("label"),
        )), F.expr("cast(array() as array<struct<start int, end int, p int, n int, label string>>)"))

    d = d.select("doc_id", "n_words", "b", F.array_sort(F.flatten(F.transform("c", hits))).alias("h"))

    def inside(x: Column, y: Column) -> Column:
        longer = (y["end"] - y["start"]) > (x["end"] - x["start"])
        same = (y["end"] - y["start"]) == (x["end"] - x["start"])
        first = (y["p"] > x["p"]) | ((y["p"] == x["p"]) & (longer | (same & (y["n"] < x["n"]))))
        return (y["start"] <= x["start"]) & (y["end"] >= x["end"]) & first

    d = d.select("doc_id", "n_words", "b", F.filter("h", lambda x: ~F.exists("h", lambda y: inside(x, y))).alias("h"))
    labels = lambda *cols: F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.transform(c, lambda x: x["label"]) for c in cols]))), ",")
    best = F.greatest(F.when(F.size("b") > 0, F.lit(50)).otherwise(0), F.coalesce(F.array_max(F.transform("h", lambda x: x["p"])), F.lit(0)))
    return d.select(
        "doc_id", "n_words", F.greatest(F.size("b"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(F.transform("b", lambda x: x["i"])).cast("long").alias("first_word"),
        F.array_max(F.transform("b", lambda x: x["i"])).cast("long").alias("last_word"),
        F.coalesce(labels("b"), F.lit("")).alias("base_labels"), F.coalesce(labels("b", "h"), F.lit("")).alias("labels"),
        (F.coalesce(best, F.lit(0)) / F.lit(100.0)).alias("score"),
        F.coalesce(F.transform("h", lambda x: F.struct(x["start"], x["end"], x["label"], x["p"].alias("priority"))),
                   F.expr("cast(array() as array<struct<start int, end int, label string, priority int>>)")).alias("detections"),
    )
