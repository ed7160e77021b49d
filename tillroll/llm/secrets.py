"""Secret scanning through a trigram inverted index, with built-in functions only.

For every rule a Boolean query over trigrams is derived from its regular
expression (``trigram_query``): every text that matches must satisfy it. The
index holds, per block of documents, the posting list of each trigram that
some query mentions; the queries are answered by intersecting and joining
posting lists, and only their candidates are verified by the expression
itself. A rule without mandatory trigrams (the hexadecimal run) scans every
text.

Everything here is a DataFrame plan: no Python runs on the executors.
"""

from __future__ import annotations

import re._parser as sre  # type: ignore[import-not-found]
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import count_rows, handed_on

BLOCK_DOCS = 4096  # documents per index block; bounds the length of a posting list


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  # same meaning in Java's and Python's syntax
    group: int = 0  # the group whose length counts
    least: int = 1  # its least number of characters
    base: bool = False


# A run of hex digits of 32 or more is what the greedy [0-9a-f]+ finds there,
# and a run of 16 or more what AKIA[A-Z0-9]+ does: a shorter match never hides
# a longer one. The assignment keeps its "+", since a short match consumes text.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]{12,}", 0, 16, True),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
)

# -- Boolean trigram queries --------------------------------------------------
# A query is True (no condition), a trigram, or ("and" | "or", (queries...)).
_SMALL = 16  # strings kept exactly before they are turned into a condition


def _and(*qs):
    flat = {q for q in qs if q is not True}
    return True if not flat else flat.pop() if len(flat) == 1 else ("and", tuple(sorted(flat, key=str)))


def _or(*qs):
    if any(q is True for q in qs):
        return True
    flat = set(qs)
    return flat.pop() if len(flat) == 1 else ("or", tuple(sorted(flat, key=str)))


_COMMON_FIRST = "etaoinshrdlcumwfgypbvkjxqz"
LEADING = 2  # trigrams asked for per literal; any subset of its trigrams is a necessary condition


def _of_strings(strings) -> object:
    """The least common trigrams (by letter) of each string; strings are alternatives."""
    def rare(t: str) -> int:
        return -sum(_COMMON_FIRST.find(c) % 30 for c in t)

    return _or(*[_and(*sorted({s[i:i + 3] for i in range(len(s) - 2)}, key=lambda t: (rare(t), t))[:LEADING]) for s in strings])


def _strings(op, arg) -> set[str] | None:
    """All strings a node can match, if they are few; lower case."""
    name = str(op)
    if name == "LITERAL":
        return {chr(arg).lower()}
    if name == "IN":
        chars: set[str] = set()
        for o, a in arg:
            if str(o) == "LITERAL":
                chars.add(chr(a).lower())
            elif str(o) == "RANGE" and a[1] - a[0] < _SMALL:
                chars |= {chr(c).lower() for c in range(a[0], a[1] + 1)}
            else:
                return None
        return chars if len(chars) <= 8 else None
    if name == "SUBPATTERN":
        return _sequence(arg[3])[0]
    if name == "BRANCH":
        parts = [_sequence(x)[0] for x in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[1] == 1:
        inner = _sequence(arg[2])[0]
        return None if inner is None else inner | ({""} if arg[0] == 0 else set())
    return None


def _sequence(nodes) -> tuple[set[str] | None, object]:
    """(all strings, if few; else None, the condition every match meets)."""
    run, conds, exact = {""}, [], True
    for op, arg in nodes:
        own = _strings(op, arg)
        if own is not None and len(run) * len(own) <= _SMALL:
            run = {a + b for a in run for b in own}
            continue
        exact = False
        conds.append(_of_strings(run))
        run = {""} if own is None else own
        name = str(op)
        if own is None and name == "SUBPATTERN":
            conds.append(_sequence(arg[3])[1])
        elif own is None and name == "BRANCH":
            conds.append(_or(*[_sequence(x)[1] for x in arg[1]]))
        elif own is None and name.endswith("REPEAT") and arg[0] > 0:
            conds.append(_sequence(arg[2])[1])
    conds.append(_of_strings(run))
    return (run if exact else None), _and(*conds)


def trigram_query(pattern: str) -> object:
    """The Boolean query over lower-case trigrams that every match satisfies; True if none is mandatory."""
    return _sequence(sre.parse(pattern))[1]


def trigrams(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


# -- index --------------------------------------------------------------------

def index(docs: DataFrame, wanted: set[str], key: str = "_key", text_col: str = "text") -> DataFrame:
    """Posting lists ``(block, trigram, docs)`` of the wanted trigrams.

    Documents go to blocks of about ``BLOCK_DOCS`` by their key, so a trigram
    found everywhere has many short lists instead of one long one.
    """
    blocks = max(1, count_rows(docs) // BLOCK_DOCS)
    low = docs.select(F.col(key), F.lower(text_col).alias("_low"))  # lowered once, not per trigram
    found = F.array_compact(F.array(*[F.when(F.contains("_low", F.lit(t)), F.lit(t)) for t in sorted(wanted)]))
    post = low.select(F.col(key), F.pmod(F.col(key), F.lit(blocks)).alias("block"), F.explode(found).alias("trigram"))
    return post.groupBy("block", "trigram").agg(F.collect_set(key).alias("docs"))


def _answer(query, lists: Column) -> Column:
    """Documents of a block that satisfy a query."""
    if isinstance(query, str):
        return F.coalesce(F.element_at(lists, F.lit(query)), F.expr("cast(array() as array<bigint>)"))
    join = F.array_intersect if query[0] == "and" else F.array_union
    return reduce(join, [_answer(q, lists) for q in query[1]])


def candidates(postings: DataFrame, queries: dict[str, object]) -> DataFrame:
    """``(_key, kinds)``: per document the kinds of rule whose query it satisfies."""
    block = postings.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "docs"))).alias("lists"))
    each = F.array(*[F.struct(F.lit(k).alias("kind"), _answer(q, F.col("lists")).alias("docs")) for k, q in queries.items()])
    flat = block.select(F.explode(each).alias("r")).select("r.kind", F.explode("r.docs").alias("_key"))
    return flat.groupBy("_key").agg(F.collect_set("kind").alias("kinds"))


# -- verification ---------------------------------------------------------------

FOUND = "array<struct<start:int,ord:int,end:int,kind:string>>"
BLOCK = 256  # matches folded together, so that the work on a text of many matches stays near its length


def _blocks(a: Column) -> Column:
    """The array in slices of BLOCK elements."""
    last = F.greatest(F.ceil(F.size(a) / BLOCK).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(a, b * BLOCK + 1, F.lit(BLOCK)))


def _with(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def spans(text: Column, rule: Rule, order: int) -> Column:
    """Leftmost non-overlapping matches as (start, order, end, kind) in code points.

    The pieces between the matches give the positions: a match starts after
    the pieces and matches before it.
    """
    p = F.lit(rule.pattern)
    pieces = F.transform(F.split(text, rule.pattern, -1), lambda s: F.length(s))
    sizes = F.transform(F.regexp_extract_all(text, p, F.lit(0)), lambda s: F.length(s))
    counted = F.transform(F.regexp_extract_all(text, p, F.lit(rule.group)), lambda s: F.length(s)) if rule.group else sizes
    zipped = F.arrays_zip(pieces.alias("gap"), sizes.alias("size"), counted.alias("counted"))
    none = F.expr(f"cast(array() as {FOUND})")

    def step(acc: Column, z: Column) -> Column:
        start = acc["at"] + z["gap"]
        end = start + F.coalesce(z["size"], F.lit(0))
        hit = F.array(F.struct(start.alias("start"), F.lit(order).alias("ord"), end.alias("end"), F.lit(rule.kind).alias("kind")))
        good = z["size"].isNotNull() & (z["counted"] >= rule.least)
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["out"], hit)).otherwise(acc["out"]).alias("out"))

    def block(acc: Column, part: Column) -> Column:
        return F.aggregate(part, F.struct(acc["at"].alias("at"), none.alias("out")), step,
                           lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    zero = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{FOUND}>)").alias("out"))
    return _with(zipped, lambda z: F.aggregate(_blocks(z), zero, block, lambda acc: F.flatten(acc["out"])))


def scan(docs: DataFrame, columns: list[str] | None = None, rules: tuple[Rule, ...] = RULES,
         text_col: str = "text", key_col: str = "doc_id") -> DataFrame:
    """Secrets in every whole text of docs.

    Returns ``columns`` of docs (default: all) plus ``spans``, an array of
    (start, ord, end, kind) sorted by start, then rule order; code points, end
    exclusive. One row per row: null and empty texts have no spans, repeated
    rows and repeated or null keys keep their rows (the key only leads to
    candidates, which are verified). A column of docs called ``spans`` is
    handed on as ``in_spans``.
    """
    keep = columns or docs.columns
    src = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(keep)], F.col(text_col).alias("_text"),
                      F.xxhash64(F.col(key_col)).alias("_key"))
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q is not True}
    text = F.coalesce("_text", F.lit(""))
    none = F.expr(f"cast(array() as {FOUND})")
    if indexed:
        postings = index(src.select("_key", "_text"), set().union(*map(trigrams, indexed.values())), "_key", "_text")
        src = src.join(candidates(postings, indexed), "_key", "left")
    found = []
    for i, r in enumerate(rules):
        may = F.array_contains("kinds", r.kind) if r.kind in indexed else F.col("_text").rlike(r.pattern)
        found.append(F.when(F.coalesce(may, F.lit(False)), spans(text, r, i)).otherwise(none))
    return src.select(*[F.col(f"_c{i}").alias(a) for i, a in enumerate(handed_on(keep, ["spans"]))],
                      F.array_sort(F.concat(*found)).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The columns of docs with every span of the text replaced by ``mark``.

    Overlapping and touching spans become one mark; rows without spans, null
    texts included, are unchanged.
    """
    names = docs.columns
    s = scan(docs, names, rules)

    def step(acc: Column, x: Column, head: Column, base: Column) -> Column:
        gap = F.concat(acc["out"], F.substring(head, acc["at"] - base + 1, x["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"),
                        F.when(x["start"] > acc["at"], gap).when(acc["at"] == 0, F.lit(mark)).otherwise(acc["out"]).alias("out"))

    def block(acc: Column, part: Column) -> Column:
        """Of the rest of the text, the head up to the last end of a block is worked on."""
        size = F.coalesce(F.array_max(F.transform(part, lambda x: x["end"])), F.lit(0)) - acc["at"]
        return _with(F.substring(acc["rest"], F.lit(1), F.greatest(size, F.lit(0))), lambda head: F.aggregate(
            part, F.struct(acc["at"].alias("at"), F.lit("").alias("out")), lambda r, x: step(r, x, head, acc["at"]),
            lambda r: F.struct(r["at"].alias("at"), F.substr(acc["rest"], r["at"] - acc["at"] + 1).alias("rest"),
                               F.concat(acc["out"], F.array(r["out"])).alias("out"))))

    zero = F.struct(F.lit(0).alias("at"), F.col("text").alias("rest"), F.expr("cast(array() as array<string>)").alias("out"))
    done = F.aggregate(_blocks(F.col("spans")), zero, block, lambda acc: F.concat(F.array_join(acc["out"], ""), acc["rest"]))
    s = s.withColumn("text", F.when(F.size("spans") > 0, done).otherwise(F.col("text")))
    return s.select(*[F.col(a).alias(c) for a, c in zip(handed_on(names, ["spans"]), names)])


def _of_kind(kind: str):
    return lambda x: x["kind"] == kind


def report(docs: DataFrame) -> DataFrame:
    """Digest columns per document: counts by base kind, hash, all spans."""
    s = scan(docs.select("doc_id", "text"), ["doc_id"])
    text = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    kinds = [r.kind for r in RULES if r.base]
    base = F.filter("spans", lambda x: x["kind"].isin(kinds))
    n = [F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{k}") for k in kinds]
    return s.select("doc_id", *n, F.sha2(F.array_join(F.transform(base, text), ","), 256).alias("base_sha256"),
                    F.array_join(F.transform("spans", text), ",").alias("spans"))


def _duck_spans(rule: Rule, order: int) -> str:
    """The span list of a rule in DuckDB SQL (ASCII case spelled out)."""
    p = rule.pattern.replace("'", "''")
    for word in ("password", "passwd", "secret", "token", "api_?key"):
        p = p.replace(word, "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word))
    p = p.replace("(?i:", "(?:")
    sizes = f"list_transform(regexp_extract_all(t, '{p}', 0), lambda x: length(x))"
    counted = f"list_transform(regexp_extract_all(t, '{p}', {rule.group}), lambda x: length(x))"
    gaps = f"list_transform(string_split_regex(t, '{p}'), lambda x: length(x))"
    ends = (f"list_transform(range(1, len(s.sizes) + 1), lambda i: {{'start': list_sum(s.gaps[:i]) + coalesce(list_sum(s.sizes[:i - 1]), 0), "
            f"'size': s.sizes[i], 'counted': s.counted[i]}})")
    return (f"(SELECT list_transform(list_filter({ends}, lambda x: x.counted >= {rule.least}), "
            f"lambda x: {{'start': CAST(x.start AS BIGINT), 'ord': {order}, 'txt': '{rule.kind}:' || CAST(x.start AS BIGINT) || ':' || CAST(x.start + x.size AS BIGINT)}}) "
            f"FROM (SELECT {sizes} AS sizes, {counted} AS counted, {gaps} AS gaps) s)")


def _oracle() -> str:
    lists = ", ".join(f"{_duck_spans(r, i)} AS s{i}" for i, r in enumerate(RULES))
    base = [i for i, r in enumerate(RULES) if r.base]
    joined = lambda ids: "array_to_string(list_transform(list_sort(" + " || ".join(f"s{i}" for i in ids) + "), lambda x: x.txt), ',')"
    counts = ", ".join(f"CAST(len(s{i}) AS BIGINT) AS n_{RULES[i].kind}" for i in base)
    return (f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (SELECT doc_id, {lists} FROM d) "
            f"SELECT doc_id, {counts}, sha256({joined(base)}) AS base_sha256, {joined(range(len(RULES)))} AS spans FROM f")


ORACLE = _oracle()
