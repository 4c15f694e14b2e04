r"""Secret scans through a trigram inverted index, in DataFrame functions only.

Each rule's regular expression is compiled on the driver to a Boolean trigram query: an OR of clauses, each an AND of
trigrams that every match must contain.  One pass over the lower-cased texts writes postings (document, trigram) for the
trigrams that some query needs; postings are intersected by document as bit sets, a clause holding where all its bits are
there.  The documents' candidate rules are joined to the texts by id (one shuffle), and only candidates are verified
with the regular expression.  A rule without mandatory trigrams scans every text.

Spans are half-open and in code points; those of one rule are leftmost and don't overlap.  Null and empty texts have
none.  Postings of rows with the same id (or null ids) are united, which only adds candidates.  Repeated rows each get a
row.  Other columns are ignored; an empty table gives no rows.  A text may hold any number of spans: running sums and
maxima are worked out in chunks of the root of their number, and texts are cut in blocks, so no step copies what all
steps before it made.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from re import _constants as K
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A clause is a set of trigrams; more clauses than this are not multiplied out (the query only gets weaker).
_MAX_CLAUSES = 64
_MAX_STRINGS = 32
_BITS = 62


@dataclass(frozen=True)
class Rule:
    """kind; a pattern that Java and Python read alike; least length of what the group holds, else the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: What the method adds: well-known formats with a fixed mark.
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\x00-\x20:/@]{1,64}:[^\x00-\x20:/@]{3,64}@"),
)
RULES = BASE + ADDED

Clauses = frozenset[frozenset[str]]
_ANY: Clauses = frozenset([frozenset()])


def _least(clauses: set[frozenset[str]]) -> Clauses:
    return frozenset(c for c in clauses if not any(d < c for d in clauses))


def _both(a: Clauses, b: Clauses) -> Clauses:
    if len(a) * len(b) > _MAX_CLAUSES:
        return min(a, b, key=len)
    return _least({x | y for x in a for y in b})


def _of_strings(strings: set[str]) -> Clauses:
    return _least({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


def _letters(items) -> set[str] | None:
    """The lower-case letters a class stands for, or None if they are more than a few."""
    out: set[str] = set()
    for op, arg in items:
        if op is K.LITERAL:
            out.add(chr(arg).lower())
        elif op is K.RANGE and arg[1] - arg[0] < 4:
            out |= {chr(x).lower() for x in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= 6 else None


def _query(nodes) -> tuple[set[str] | None, Clauses]:
    """All strings that nodes can match, if they are few, and the clauses that every match satisfies."""
    exact, current, query = True, {""}, _ANY

    def unknown() -> None:
        nonlocal exact, current, query
        query, current, exact = _both(query, _of_strings(current)), {""}, False

    def follow(strings: set[str]) -> None:
        nonlocal exact, current, query
        current = {a + b for a in current for b in strings}
        if len(current) > _MAX_STRINGS:
            query, current, exact = _both(query, _of_strings(current)), {x[-2:] for x in current}, False

    for op, arg in nodes:
        if op is K.LITERAL:
            follow({chr(arg).lower()})
        elif op is K.IN and (few := _letters(arg)):
            follow(few)
        elif op in (K.SUBPATTERN, K.BRANCH):
            found = [_query(x) for x in (arg[1] if op is K.BRANCH else [arg[-1]])]
            if all(x is not None for x, _ in found):
                follow(set().union(*[x for x, _ in found]))
            else:
                unknown()
                query = _both(query, _least({c for _, clauses in found for c in clauses}))
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT):
            low, high, sub = arg
            strings, clauses = _query(sub)
            if strings is not None and high == 1:
                follow(strings | {""} if low == 0 else strings)
            elif low == 0:
                unknown()
            else:
                if strings is not None:
                    follow(strings)
                unknown()
                query = _both(query, clauses)
                if strings is not None and len(strings) <= _MAX_STRINGS:
                    current = set(strings)
        elif op is not K.AT:
            unknown()
    if exact:
        return current, _both(query, _of_strings(current))
    return None, _both(query, _of_strings(current))


def trigram_query(pattern: str) -> Clauses:
    """Clauses of lower-case trigrams of which each match of the pattern satisfies one; one empty clause: scan all."""
    return _query(_parser.parse(pattern))[1]


def _needed(rules: tuple[Rule, ...]) -> tuple[dict[str, Clauses], list[str]]:
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    queries = {k: c for k, c in queries.items() if frozenset() not in c}
    return queries, sorted({t for c in queries.values() for clause in c for t in clause})


def postings(docs: DataFrame, trigrams: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted index of the given lower-case trigrams: (trigram, doc_id), a row for each text that holds it."""
    lowered = docs.select(F.col(id_col).alias("doc_id"), F.lower(text_col).alias("lowered"))
    held = F.array_compact(F.array(*[F.when(F.contains("lowered", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams)]))
    return lowered.select("doc_id", F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rules): the rules with mandatory trigrams that a document may match."""
    queries, trigrams = _needed(rules)
    index = postings(docs, trigrams, id_col, text_col)
    words = range(-(-len(trigrams) // _BITS))
    bit = F.expr(f"shiftleft(1L, trigram % {_BITS})")
    sets = index.groupBy("doc_id").agg(*[F.bit_or(F.when(F.floor(F.col("trigram") / _BITS) == w, bit)).alias(f"w{w}") for w in words])
    number = {t: i for i, t in enumerate(trigrams)}

    def holds(clause: frozenset[str]) -> Column:
        masks = [sum(1 << (number[t] % _BITS) for t in clause if number[t] // _BITS == w) for w in words]
        return reduce(lambda a, b: a & b, [F.coalesce(F.col(f"w{w}"), F.lit(0)).bitwiseAND(F.lit(m)) == m for w, m in zip(words, masks, strict=True) if m])

    named = [F.when(reduce(lambda a, b: a | b, [holds(c) for c in sorted(clauses, key=sorted)]), F.lit(kind)) for kind, clauses in queries.items()]
    return sets.select("doc_id", F.array_compact(F.array(*named)).alias("rules")).where(F.size("rules") > 0)


_SPANS = "array<struct<start:int,ord:int,end:int,kind:string>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once: a lambda's variable is bound to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Running results over an array that isn't empty of whole numbers from 0 up: a step is a sum or a maximum.

    Chunks have the length of the root of the array's: results run within each, then over the last ones of the chunks.
    """

    def append(results: Column, x: Column) -> Column:
        return F.concat(results, F.array(step(F.element_at(results, -1), x)))

    def within(chunk: Column) -> Column:
        return F.aggregate(F.slice(chunk, F.lit(2), F.size(chunk)), F.slice(chunk, 1, 1), append)

    def over(chunks: Column) -> Column:
        lasts = F.transform(chunks, lambda c: F.element_at(c, -1))
        carried = F.aggregate(lasts, F.array(F.lit(0)), append)
        return _let(carried, lambda before: F.flatten(F.transform(chunks, lambda c, k: F.transform(c, lambda x: step(F.get(before, k), x)))))

    def cut(held: Column) -> Column:
        width = F.greatest(F.lit(1), F.sqrt(F.size(held)).cast("int"))
        begins = F.sequence(F.lit(0), F.size(held) - 1, width)
        return _let(F.transform(begins, lambda i: within(F.slice(held, i + 1, width))), over)

    return _let(values, cut)


def _spans(text: str, rule: Rule, order: int) -> Column:
    """Sorted (start, order, end, kind) of a rule's matches in a text column: the parts between matches give their places."""
    whole = F.regexp_extract_all(F.col(text), F.lit(rule.pattern), F.lit(0))

    def located(found: Column) -> Column:
        between = F.split(F.col(text), rule.pattern, -1)
        groups = F.regexp_extract_all(F.col(text), F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
        rows = F.arrays_zip(found.alias("m"), F.slice(between, 1, F.size(found)).alias("b"), groups.alias("g"))
        sizes = F.transform(rows, lambda r: F.struct((F.length(r["b"]) + F.length(r["m"])).alias("step"), F.length(r["m"]).alias("n"), (F.length(r["g"]) >= rule.least).alias("kept")))

        def placed(steps: Column) -> Column:
            def span(s: Column, i: Column, ends: Column) -> Column:
                end = F.get(ends, i)
                return F.when(s["kept"], F.struct((end - s["n"]).alias("start"), F.lit(order).alias("ord"), end.alias("end"), F.lit(rule.kind).alias("kind")))

            ends = _running(F.transform(steps, lambda s: s["step"]), lambda a, b: a + b)
            return F.array_compact(_let(ends, lambda e: F.transform(steps, lambda s, i: span(s, i, e))))

        return _let(sizes, placed).cast(_SPANS)

    return _let(whole, lambda found: F.when(F.size(found) > 0, located(found)).otherwise(F.array().cast(_SPANS)))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, keep..., spans): all spans of each text, by start, then in the order of the rules; the three names win over columns to keep."""
    queries, _ = _needed(rules)
    keep = tuple(c for c in keep if c not in ("doc_id", "text", "spans"))
    extra = [F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(text_col).isNull().alias("no_text"), *extra)
    if queries:
        found = candidates(docs, rules, id_col, text_col).withColumnRenamed("doc_id", "c_id")
        rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col("c_id")), "left").drop("c_id")
    else:
        rows = rows.withColumn("rules", F.array().cast("array<string>"))
    parts = []
    for i, r in enumerate(rules):
        spans = _spans("text", r, i)
        parts.append(F.when(F.array_contains("rules", r.kind), spans).otherwise(F.array().cast(_SPANS)) if r.kind in queries else spans)
    named = [F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)]
    return rows.select("doc_id", F.when(~F.col("no_text"), F.col("text")).alias("text"), *named, F.sort_array(F.concat(*parts)).alias("spans"))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(scanned: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) from scan()'s rows."""
    base = F.filter("spans", lambda s: s["ord"] < len(BASE))
    rows = scanned.select("doc_id", "spans", base.alias("base"))

    def of_kind(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == F.lit(kind))).cast("long").alias(f"n_{kind}")

    counts = [of_kind(r.kind) for r in BASE]
    return rows.select("doc_id", *counts, F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))


#: Code points of the blocks that a text is cut in to read parts of it.
_BLOCK = 4096


def _part(blocks: Column, start: Column, end: Column) -> Column:
    """The code points from start to end of a text cut in blocks."""

    def of_block(k: Column) -> Column:
        begin = F.greatest(start - k * _BLOCK, F.lit(0))
        return F.substring(F.get(blocks, k), begin + 1, F.least(end - k * _BLOCK, F.lit(_BLOCK)) - begin)

    numbers = F.sequence(F.floor(start / _BLOCK).cast("int"), F.floor((end - 1) / _BLOCK).cast("int"))
    return F.when(start < end, F.array_join(F.transform(numbers, of_block), "")).otherwise("")


def redacted(mark: str = "[SECRET]") -> Column:
    """The text of scan()'s rows with each stretch of overlapping spans replaced by a mark; null stays null."""

    def cut(ends: Column) -> Column:
        """ends: the farthest end of the spans up to each one."""

        def fresh(i: Column) -> Column:
            return (i == 0) | (F.get(F.col("spans"), i)["start"] >= F.get(ends, i - 1))

        firsts = F.filter(F.sequence(F.lit(0), F.size("spans") - 1), fresh)
        between = F.transform(firsts, lambda i: F.struct(F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1)).alias("a"), F.get(F.col("spans"), i)["start"].alias("b")))
        last = F.array(F.struct(F.element_at(ends, -1).alias("a"), F.length("text").alias("b")))
        blocks = F.regexp_extract_all(F.col("text"), F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))
        return _let(blocks, lambda held: F.array_join(F.transform(F.concat(between, last), lambda g: _part(held, g["a"], g["b"])), mark))

    farthest = _running(F.transform("spans", lambda s: s["end"]), F.greatest)
    return F.when(F.size("spans") > 0, _let(farthest, cut)).otherwise(F.col("text"))
