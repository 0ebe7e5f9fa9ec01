"""Secret scans by a trigram inverted index.

From each rule's expression a Boolean query over trigrams is derived: every match of
``AKIA[A-Z0-9]+`` holds ``aki`` and ``kia``, for instance.  The index has a posting for each
text and trigram that some query asks for; intersecting postings gives the rules that may match
a text, and only those are run on it.  A rule without mandatory trigrams is run on every text.

Only built-in functions are used.  Postings are rows, dealt out by text, so a trigram that
stands in every text is never gathered in one place.  A text that no rule may match is not moved.
"""

from __future__ import annotations

import re._constants as rc
import re._parser as rp
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import is_small, to_table


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression, and the least length of one of its groups."""

    kind: str
    expression: str
    group: int = 0
    least: int = 1


# Fixed values of the contract: the base kinds, in order.
BASE = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: Kinds that the base does not know.
MORE = (
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{30,}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("sendgrid", r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}"),
    Rule("npm", r"npm_[A-Za-z0-9]{36}"),
    Rule("pem", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("login", r"://[A-Za-z0-9._%+-]+:[A-Za-z0-9._%+!$*-]+@"),
    Rule("bearer", r"[Bb]earer [A-Za-z0-9._~+/-]{20,}"),
)
RULES = BASE + MORE

#: Expressions may stand for so many strings before they count as open.
MOST_STRINGS = 16
#: A conjunction of alternatives, each a set of trigrams.
Query = list[list[frozenset[str]]]


def _grams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _clause(strings: set[str]) -> Query:
    """What it means that one of ``strings`` stands in the text; nothing if one is too short."""
    sets = {_grams(s) for s in strings}
    return [] if frozenset() in sets else [sorted(sets, key=sorted)]


def _strings(item: tuple) -> set[str] | None:
    """All lower-cased strings that an item matches, None if there are too many."""
    op, arg = item
    if op is rc.LITERAL:
        return {chr(arg).lower()}
    if op is rc.IN:
        out: set[str] = set()
        for kind, value in arg:
            if kind is rc.LITERAL:
                out.add(chr(value).lower())
            elif kind is rc.RANGE and value[1] - value[0] < MOST_STRINGS:
                out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return out if len(out) <= MOST_STRINGS else None
    if op is rc.SUBPATTERN:
        return _all(arg[-1])
    if op is rc.BRANCH:
        parts = [_all(x) for x in arg[1]]
        out = set().union(*[p or set() for p in parts])
        return out if all(p is not None for p in parts) and len(out) <= MOST_STRINGS else None
    if op is rc.MAX_REPEAT and arg[1] <= 1:
        inner = _all(arg[2])
        return inner if inner is None or arg[0] == 1 else inner | {""}
    return None


def _all(items) -> set[str] | None:
    out = {""}
    for item in items:
        s = _strings(item)
        if s is None or len(out) * len(s) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in s}
    return out


def trigram_query(expression: str) -> Query:
    """Trigrams that every match of ``expression`` has, lower-cased; empty if none is mandatory."""

    def of(items) -> Query:
        out: Query = []
        run = {""}
        for item in items:
            s = _strings(item)
            if s is not None and len(run) * len(s) <= MOST_STRINGS:
                run = {a + b for a in run for b in s}
                continue
            out += _clause(run)
            run = s if s is not None else {""}
            op, arg = item
            if s is None and op is rc.SUBPATTERN:
                out += of(arg[-1])
            elif s is None and op is rc.BRANCH:
                parts = [of(x) for x in arg[1]]
                if all(len(p) == 1 for p in parts):
                    out.append([a for p in parts for a in p[0]])
            elif s is None and op is rc.MAX_REPEAT and arg[0] > 0:
                out += of(arg[2])
        return out + _clause(run)

    return of(rp.parse(expression))


#: Items of an array that are folded before what they give is added to the rest, so that the rest is seldom copied.
FOLDED = 64


def _fold(items: Column, start: list[Column], out: Column, step: Callable[[Column, Column], list[Column]], add: Callable[[Column, Column], Column]) -> Column:
    """All arrays that ``add`` gives for (state, item), in a row; ``step`` gives the next state, which ``start`` begins."""
    state = lambda cols, found: F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cols)], found.alias("found"))
    now = lambda a, n=len(start): [a[f"c{i}"] for i in range(n)]

    def part(a: Column, k: Column) -> Column:
        some = F.slice(items, k * FOLDED + 1, FOLDED)
        return F.reduce(some, state(now(a), out), lambda b, x: state(step(b, x), F.concat(b["found"], add(b, x))), lambda b: state(now(b), F.concat(a["found"], b["found"])))

    parts = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / FOLDED).cast("int"))
    return F.when(F.size(items) > 0, F.reduce(parts, state(start, out), part, lambda a: a["found"])).otherwise(out)


def _spans(text: Column, order: int, rule: Rule) -> Column:
    """Leftmost matches that do not overlap: array of (start, order, end), in code points.

    ``text`` is free of the two marks; a match is framed by them and the pieces are measured.
    """
    empty = F.expr("cast(array() as array<struct<s int, o int, e int>>)")
    pieces = F.split(F.regexp_replace(text, rule.expression, "\x01$0\x02"), "[\x01\x02]", -1)
    size = lambda p: F.length(F.regexp_extract(p, rule.expression, rule.group) if rule.group else p)

    # The state: where the piece begins, and whether it is a match.
    end = lambda a, p: a["c0"] + F.length(p)
    one = lambda a, p: F.array(F.struct(a["c0"].alias("s"), F.lit(order).alias("o"), end(a, p).alias("e")))
    spans = _fold(pieces, [F.lit(0), F.lit(False)], empty, lambda a, p: [end(a, p), ~a["c1"]], lambda a, p: F.when(a["c1"] & (size(p) >= rule.least), one(a, p)).otherwise(empty))
    return F.when(F.rlike(text, F.lit(rule.expression)), spans).otherwise(empty)


def postings(docs: DataFrame, queries: dict[int, Query]) -> DataFrame:
    """``docs(key, t)`` as index rows ``(trigram, key)``, for the trigrams that a query has."""
    wanted = sorted({g for q in queries.values() for clause in q for alt in clause for g in alt})
    present = F.filter(F.array(*[F.lit(g) for g in wanted]), lambda g: F.contains(F.col("low"), g))
    return docs.select("key", F.lower("t").alias("low")).select(F.explode(present).alias("trigram"), "key")


def candidates(docs: DataFrame, queries: dict[int, Query]) -> DataFrame:
    """``(key, rules)``: rules whose trigram query a text satisfies, by intersecting postings."""
    terms = [(r, c, a, g, len(alt), len(q)) for r, q in queries.items() for c, clause in enumerate(q) for a, alt in enumerate(clause) for g in sorted(alt)]
    table = docs.sparkSession.createDataFrame(terms, "rule int, clause int, alt int, trigram string, need int, clauses int")
    hit = postings(docs, queries).join(F.broadcast(table), "trigram")  # a few rows for each rule
    alts = hit.groupBy("key", "rule", "clause", "alt").agg(F.count_distinct("trigram").alias("n"), F.first("need").alias("need"), F.first("clauses").alias("clauses"))
    met = alts.where("n = need").groupBy("key", "rule").agg(F.count_distinct("clause").alias("n"), F.first("clauses").alias("clauses"))
    return met.where("n = clauses").groupBy("key").agg(F.collect_set("rule").alias("rules"))


def scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", rules: tuple[Rule, ...] = RULES, keep: list[str] | None = None) -> DataFrame:
    """All rows of ``docs`` with ``found``: the spans as (start, order of the rule, end), sorted.

    ``keep`` names the columns to carry (the id by default).  Null texts count as empty and
    hold nothing.  Ids may be null or repeated: postings are keyed by id and text together,
    so each row meets at most one row of candidates, and repeated rows get the same spans.
    An empty table gives an empty one.  Candidates are written to the shared folder; up to
    ``BROADCAST_BYTES`` of them are broadcast to the texts, beyond that texts are joined by key.
    """
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.expression))}
    key = F.struct(F.coalesce(F.col("id_").cast("string"), F.lit("-")).alias("i"), F.xxhash64("t").alias("h"))
    row = F.struct(*[F.col(f"`{c}`") for c in (keep or [id_col])])
    d = docs.select(row.alias("row_"), F.col(id_col).alias("id_"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).select("row_", "t", key.alias("key"))
    some = to_table(candidates(d.select("key", "t"), queries), "secret-candidates")
    # Few texts are candidates as a rule: then they go to the texts, and no text is moved.
    found = d.join(F.broadcast(some) if is_small(some) else some, "key", "left")
    clean = found.withColumn("x", F.when(F.rlike("t", F.lit("[\x01\x02]")), F.translate("t", "\x01\x02", "\x03\x03")).otherwise(F.col("t")))
    none = F.expr("cast(array() as array<struct<s int, o int, e int>>)")
    parts = []
    for i, rule in enumerate(rules):
        spans = _spans(F.col("x"), i, rule)
        parts.append(F.when(F.array_contains("rules", i), spans).otherwise(none) if i in queries else spans)
    return clean.select("row_", "t", F.array_sort(F.concat(*parts)).alias("found"))


def _joined(spans: Column, rules: tuple[Rule, ...]) -> Column:
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["o"]), s["s"].cast("string"), s["e"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: numbers and digest of the base spans, and all spans as text."""
    d = scan(docs, text_col, id_col).select(F.col(f"row_.{id_col}").alias("doc_id"), "found", F.filter("found", lambda s: s["o"] < len(BASE)).alias("base"))
    count = lambda k: F.size(F.filter("base", lambda s: s["o"] == k)).cast("long")
    return d.select(
        "doc_id", *[count(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE)],
        F.sha2(_joined(F.col("base"), RULES), 256).alias("base_sha256"), _joined(F.col("found"), RULES).alias("spans"),
    )


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by: str = "[secret]") -> DataFrame:
    """``docs``, all rows and columns, with each found stretch of the text replaced by ``by``.

    Overlapping spans are masked as one.  A text without secrets is left alone, null stays null.
    """
    found = scan(docs, text_col, id_col, keep=docs.columns)

    # The state: where the last masked stretch ended.
    end = lambda a, s: F.greatest(a["c0"], s["e"])
    before = lambda a, s: F.array(F.substring(F.col("t"), a["c0"] + 1, s["s"] - a["c0"]), F.lit(by))
    parts = _fold(F.col("found"), [F.lit(0)], F.expr("cast(array() as array<string>)"), lambda a, s: [end(a, s)], lambda a, s: F.when(s["s"] >= a["c0"], before(a, s)).otherwise(F.expr("cast(array() as array<string>)")))
    last = F.array_max(F.transform("found", lambda s: s["e"]))
    masked = F.concat(F.array_join(parts, ""), F.substring(F.col("t"), last + 1, F.length("t")))
    text = F.when(F.size("found") > 0, masked).otherwise(F.col(f"row_.`{text_col}`"))
    return found.select(*[(text if c == text_col else F.col(f"row_.`{c}`")).alias(c) for c in docs.columns])
