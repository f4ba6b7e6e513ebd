"""Secret scanning through a trigram inverted index.

Every rule is a regular expression. From each one a Boolean trigram query is
derived (an OR of ANDs of three-character strings that any match must contain),
after folding A-Z to a-z. The index holds, for every text, the distinct
trigrams that some query asks for: its postings. A rule's candidates are the
texts whose postings hold all trigrams of one of its conjunctions, found by a
join with the small table of query terms and a count per text. Only candidates
are verified by the rule's expression. A rule whose query asks for nothing
(like ``hex``) has no mandatory trigram and scans every text.

Everything on the main path is a built-in Spark SQL function: regular
expressions, split, explode, joins and windows; no Python runs in the tasks.

Matching, per kind, is leftmost and non-overlapping. A rule keeps a match only
if its group ``group`` has ``min_len`` code points or more; failing matches are
dropped without retrying inside them. Positions are code points, ends exclusive.

Defined results: a null text is empty and has no spans; a null key is kept as a
row of its own; repeated rows each get their row, with equal spans; an empty
table gives no rows; very long texts are scanned whole. Only the key and the text
are read, so extra columns cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut
from .common import fold_case


@dataclass(frozen=True)
class Rule:
    kind: str
    # The expression of the rule, as dealt.
    pattern: str
    # The group whose length decides, and its least length.
    group: int
    min_len: int
    # An expression whose leftmost matches are exactly the kept ones, where one is known
    # (a class run after a literal: a failing run holds no longer one). Shorter scans.
    kept: str | None = None

    @property
    def scanned(self) -> str:
        return self.kept or self.pattern


# The base rules of the contract, in their listed order.
BASE_RULES = (
    Rule("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]+", 0, 16, r"[0-9a-f]{16,}"),
)
# Commonly published token formats that the method adds.
EXTRA_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    Rule("slack", r"xox[baprs]-[A-Za-z0-9-]{10,}", 0, 0),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}", 0, 0),
    Rule("stripe", r"[sr]k_live_[0-9A-Za-z]{24,}", 0, 0),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
)
RULES = BASE_RULES + EXTRA_RULES
BASE_KINDS = tuple(r.kind for r in BASE_RULES)

# --- Boolean trigram queries of expressions ----------------------------------
# A query is a set of conjunctions, each a set of trigrams; the empty conjunction is always true.

Query = frozenset
ALL: Query = frozenset({frozenset()})
#: Most strings an exact set holds before it is turned into a query.
MAX_EXACT = 16
#: Classes of more characters than this match "anything" for the query.
MAX_CLASS = 6
#: Repetitions of a bounded quantifier that the query asks for at most.
MAX_REPEAT = 3


def _minimal(query: set) -> Query:
    if frozenset() in query:
        return ALL
    return frozenset(c for c in query if not any(o < c for o in query))


def q_and(a: Query, b: Query) -> Query:
    return _minimal({x | y for x in a for y in b})


def q_or(a: Query, b: Query) -> Query:
    return _minimal(set(a) | set(b))


def trigrams(s: str) -> frozenset:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def q_strings(strings) -> Query:
    """True of a text that holds one of ``strings``."""
    if any(len(s) < 3 for s in strings):
        return ALL
    return _minimal({trigrams(s) for s in strings})


@dataclass(frozen=True)
class Info:
    """What every match of a part of an expression holds: its exact strings when they are
    few, else a query, strings that surely begin and end it, and whether it can be empty."""

    exact: frozenset | None
    match: Query = ALL
    prefix: frozenset = frozenset({""})
    suffix: frozenset = frozenset({""})
    empty: bool = True


EMPTY = Info(frozenset({""}))
ANY = Info(None, empty=False)
STAR = Info(None)


def opened(i: Info) -> Info:
    if i.exact is None:
        return i
    return Info(
        None, q_strings(i.exact), frozenset(s[:2] for s in i.exact), frozenset(s[-2:] for s in i.exact), "" in i.exact
    )


def concat(x: Info, y: Info) -> Info:
    if x.exact is not None and y.exact is not None and len(x.exact) * len(y.exact) <= MAX_EXACT:
        return Info(frozenset(a + b for a in x.exact for b in y.exact))
    x, y = opened(x), opened(y)
    joins = {a + b for a in x.suffix for b in y.prefix}
    match = q_and(q_and(x.match, y.match), q_strings(joins) if len(joins) <= MAX_EXACT else ALL)
    prefix = x.prefix if not x.empty else frozenset({""})
    suffix = y.suffix if not y.empty else frozenset({""})
    return Info(None, match, prefix, suffix, x.empty and y.empty)


def either(x: Info, y: Info) -> Info:
    if x.exact is not None and y.exact is not None and len(x.exact | y.exact) <= MAX_EXACT:
        return Info(x.exact | y.exact)
    x, y = opened(x), opened(y)
    return Info(None, q_or(x.match, y.match), x.prefix | y.prefix, x.suffix | y.suffix, x.empty or y.empty)


def repeat(x: Info, least: int, most: int | None) -> Info:
    out = reduce(concat, [x] * min(least, MAX_REPEAT), EMPTY)
    if most is None or most > least:
        out = concat(out, STAR)
    return out


def _fold(chars) -> frozenset:
    return frozenset(c.lower() if "A" <= c <= "Z" else c for c in chars)


class _Parser:
    """Literals, escapes, classes, groups, alternation and quantifiers: what the rules use."""

    def __init__(self, pattern: str):
        self.p, self.at = pattern, 0

    def peek(self) -> str:
        return self.p[self.at] if self.at < len(self.p) else ""

    def take(self) -> str:
        c = self.peek()
        self.at += 1
        return c

    def alternation(self) -> Info:
        out = self.sequence()
        while self.peek() == "|":
            self.take()
            out = either(out, self.sequence())
        return out

    def sequence(self) -> Info:
        # Runs of exact parts are joined first, so that literals after an open part stay strings.
        items: list[Info] = []
        while self.peek() not in ("", "|", ")"):
            item = self.quantified(self.atom())
            last = items[-1] if items else None
            if last and last.exact is not None and item.exact is not None and len(last.exact) * len(item.exact) <= MAX_EXACT:
                items[-1] = concat(last, item)
            else:
                items.append(item)
        return reduce(concat, items, EMPTY)

    def atom(self) -> Info:
        c = self.take()
        if c == "(":
            if self.p.startswith("?:", self.at):
                self.at += 2
            elif self.p.startswith("?", self.at):  # inline flags: the query folds case anyway
                self.at = self.p.index(")", self.at) + 1
                return EMPTY
            inner = self.alternation()
            self.take()
            return inner
        if c == "[":
            return self.cls()
        if c == ".":
            return ANY
        if c == "\\":
            return self.escape()
        if c in "^$":
            return EMPTY
        return Info(_fold(c))

    def escape(self) -> Info:
        c = self.take()
        if c == "x":
            if self.peek() == "{":
                end = self.p.index("}", self.at)
                code, self.at = self.p[self.at + 1 : end], end + 1
            else:
                code, self.at = self.p[self.at : self.at + 2], self.at + 2
            return Info(_fold(chr(int(code, 16))))
        if c in "dDwWsSbB":
            return ANY if c not in "bB" else EMPTY
        return Info(_fold(c))

    def cls(self) -> Info:
        negated = self.peek() == "^"
        if negated:
            self.take()
        chars, wide, first = set(), negated, True
        while first or self.peek() != "]":
            first = False
            c = self.take()
            if c == "\\":
                info = self.escape()
                if info.exact is None:
                    wide = True
                    continue
                c = next(iter(info.exact))
            if self.peek() == "-" and self.p[self.at + 1 : self.at + 2] not in ("]", ""):
                self.take()
                stop = self.take()
                chars |= {chr(o) for o in range(ord(c), ord(stop) + 1)}
            else:
                chars.add(c)
        self.take()
        if wide or len(chars) > MAX_CLASS:
            return ANY
        return Info(_fold(chars))

    def quantified(self, x: Info) -> Info:
        c = self.peek()
        if c == "?":
            self.take()
            return either(x, EMPTY)
        if c == "*":
            self.take()
            return STAR
        if c == "+":
            self.take()
            return repeat(x, 1, None)
        if c == "{":
            end = self.p.index("}", self.at)
            low, comma, high = self.p[self.at + 1 : end].partition(",")
            self.at = end + 1
            most = int(low) if not comma else (int(high) if high else None)
            return repeat(x, int(low), most)
        return x


def trigram_query(pattern: str) -> Query:
    """The trigrams (of text with A-Z folded) that every match of ``pattern`` holds, as an OR of ANDs."""
    parser = _Parser(pattern)
    info = parser.alternation()
    if parser.at != len(pattern):
        raise ValueError(f"cannot read the expression {pattern!r} at {parser.at}")
    return opened(info).match


def query_terms(rules=RULES) -> list[tuple[str, int, str, int]]:
    """(kind, conjunction, trigram, trigrams of the conjunction) of every rule that has mandatory trigrams."""
    rows = []
    for rule in rules:
        query = trigram_query(rule.pattern)
        if query == ALL:
            continue
        for number, conj in enumerate(sorted(query, key=sorted)):
            rows += [(rule.kind, number, gram, len(conj)) for gram in sorted(conj)]
    return rows


def _literal(gram: str) -> str:
    return "".join(c if c.isalnum() and c.isascii() else f"\\x{{{ord(c):x}}}" for c in gram)


# --- the scan ------------------------------------------------------------------


def postings(rows: DataFrame, grams: list[str]) -> DataFrame:
    """(_row, trigram): the distinct asked-for trigrams of every text, found at every place at once."""
    if not grams:
        return rows.sparkSession.createDataFrame([], "_row long, trigram string")
    ahead = "(?=(" + "|".join(map(_literal, sorted(set(grams)))) + "))"
    found = F.array_distinct(F.regexp_extract_all(fold_case(F.col("text")), F.lit(ahead), 1))
    return rows.select("_row", F.explode(found).alias("trigram"))


def candidates(rows: DataFrame, rules=RULES) -> DataFrame:
    """(_row, kinds): the rules whose trigram query a text satisfies, by intersected postings."""
    spark = rows.sparkSession
    terms = query_terms(rules)
    found = postings(rows, [t[2] for t in terms])
    if not terms:
        return spark.createDataFrame([], "_row long, kinds array<string>")
    # One row per trigram of a conjunction: bounded by the rules, not the data.
    table = spark.createDataFrame(terms, "kind string, conj int, trigram string, need int")
    hits = (
        found.join(F.broadcast(table), "trigram")
        .groupBy("_row", "kind", "conj")
        .agg(F.count("*").alias("n"), F.first("need").alias("need"))
        .where(F.col("n") == F.col("need"))
    )
    return hits.groupBy("_row").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def _matches(rule: Rule, rank: int, text: Column) -> Column:
    """Array of (rank, k, gap, whole, value) of every leftmost match of the rule's scan."""
    pattern = F.lit(rule.scanned)
    whole = F.regexp_extract_all(text, pattern, 0)
    value = F.regexp_extract_all(text, pattern, rule.group) if rule.group else whole
    gaps = F.split(text, rule.scanned, -1)
    return F.transform(
        whole,
        lambda m, k: F.struct(
            F.lit(rank).alias("rank"), k.alias("k"), F.length(F.get(gaps, k)).alias("gap"), F.length(m).alias("len"),
            F.length(F.get(value, k)).alias("value"),
        ),
    )


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", rules=RULES) -> DataFrame:
    """One row per row of ``docs``: the key, and ``spans``, an array of (start, rank, end, kind)
    ordered by start, then by the rules' order (``rank``)."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col(key).alias("_key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    ).withColumn("_row", F.monotonically_increasing_id())
    # Written, so its size is known when it is joined: small, it is broadcast; large, both sides shuffle.
    chosen = cut(candidates(rows, rules), "secret-candidates")
    scanned = rows.join(chosen, "_row", "left")
    indexed = {t[0] for t in query_terms(rules)}
    per_rule = []
    for rank, rule in enumerate(rules):
        found = _matches(rule, rank, F.col("text"))
        if rule.kind in indexed:
            found = F.when(F.array_contains(F.col("kinds"), rule.kind), found)
        per_rule.append(F.coalesce(found, F.array().cast(found_type())))
    exploded = scanned.select("_row", F.explode(F.flatten(F.array(*per_rule))).alias("m")).select("_row", "m.*")
    # Start of a match: the lengths of all gaps and matches before it, per row and rule.
    before = W.partitionBy("_row", "rank").orderBy("k").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = exploded.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(before)).withColumn(
        "start", F.col("end") - F.col("len")
    )
    minimum = F.element_at(F.array(*[F.lit(r.min_len) for r in rules]), F.col("rank") + 1)
    kinds = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("rank") + 1)
    kept = placed.where(F.col("value") >= minimum).select(
        "_row", F.struct(F.col("start").cast("long").alias("start"), "rank", F.col("end").cast("long").alias("end"),
                         kinds.alias("kind")).alias("span")
    )
    spans = cut(kept.groupBy("_row").agg(F.array_sort(F.collect_list("span")).alias("spans")), "secret-spans")
    empty = F.array().cast("array<struct<start:long,rank:int,end:long,kind:string>>")
    return (
        rows.select("_row", "_key")
        .join(spans, "_row", "left")
        .select(F.col("_key").alias(key), F.coalesce("spans", empty).alias("spans"))
    )


def found_type() -> str:
    return "array<struct<rank:int,k:int,gap:int,len:int,value:int>>"


def written(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def digest_columns(found: DataFrame, key: str = "doc_id") -> DataFrame:
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        key, *map(count, BASE_KINDS), F.sha2(written(base).cast("binary"), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"),
    )
