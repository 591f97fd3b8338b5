"""Secret scan with a trigram index; DataFrame code only.

Each rule's regex is parsed into a Boolean query: an OR of clauses, each the set of lower-case
trigrams that a match must hold. One pass over each text finds the trigrams that any query names
and inverts them to posting lists of line numbers. Posting lists are intersected within a
clause and united over clauses; the regex itself runs over the candidate lines alone. A rule
without mandatory trigrams scans all lines. No pattern matches a line feed, so lines lose nothing.
Offsets are running totals over lines and over the matches of a line, made by doubling, so that time
grows as n log n with a text's matches, on many lines or on one.
The span of a private key goes on from its first line to its END line, or over the lines of base64
that follow where there is none; SQL states the first line alone.
The index lives in the row: no shuffle, and memory in proportion to one text.

The contract's base kinds are assign, access and hex; the further kinds are github, private_key,
jwt and slack. Spans are code points, end exclusive; they may overlap across kinds.

Edge cases: null counts as empty (no spans, digest of the empty string). Matches of a kind are
leftmost and do not overlap; those that fail the rule's length test are dropped after matching.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.llm.common import table


def _quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def any_case(word: str) -> str:
    """A pattern of a word whose ASCII letters may be in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Of a match, group must have at least so many characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


_KEYS = "|".join([any_case("password"), any_case("passwd"), any_case("secret"), any_case("token"), any_case("api") + "_?" + any_case("key")])
#: The first three are fixed by the contract.
RULES = (
    Rule("assign", rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]+", 0, 24),
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", 0, 15),
)
BASE = ("assign", "access", "hex")
#: The END line of a private key, and most of its characters; lines of its body, the last of which may be short.
_END, _CLOSING = "^-----END [A-Z ]*PRIVATE KEY-----", 200
_BASE64, _LAST = r"^[\x20\t]*[A-Za-z0-9+/]{16,}={0,2}\s*$", r"^[\x20\t]*[A-Za-z0-9+/]{1,15}={0,2}\s*$"
_HEADER, _BLANK = r"^[\x20\t]*(Proc-Type|DEK-Info):", r"^\s*$"
#: What takes the place of a secret in redacted texts.
MASK = "[REDACTED]"
#: Sets of exact strings and of a class's characters larger than these are given up.
_STRINGS, _CHARS = 64, 6
#: Levels of running totals, each of sixteen values; characters of a chunk of a text that is redacted.
LEVELS = 7
CHUNK = 1024

Clauses = frozenset  # of frozensets of trigrams; None stands for "any text"


def _trigrams(strings: set[str]) -> Clauses | None:
    if any(len(s) < 3 for s in strings):
        return None
    return frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _both(a: Clauses | None, b: Clauses | None) -> Clauses | None:
    if a is None or b is None:
        return b if a is None else a
    return frozenset(x | y for x in a for y in b)


def _least(a: Clauses | None) -> Clauses | None:
    """Without clauses that a smaller one implies."""
    return None if a is None else frozenset(x for x in a if not any(y < x for y in a))


def _sequence(nodes) -> tuple[set[str] | None, Clauses | None]:
    """(exact strings or None, clauses) of a parsed sequence, lower-cased."""
    whole: set[str] | None = {""}
    run: set[str] = {""}
    need: Clauses | None = None
    for op, arg in nodes:
        exact, query = _node(op, arg)
        if exact is not None and len(run) * len(exact) <= _STRINGS:
            run = {a + b for a in run for b in exact}
            whole = run if whole is not None else None
            continue
        need = _least(_both(_both(need, _trigrams(run)), query))
        run, whole = (exact if exact is not None else {""}), None
    return whole, _least(_both(need, _trigrams(run)))


def _node(op, arg) -> tuple[set[str] | None, Clauses | None]:
    if op is sre.LITERAL:
        return {chr(arg).lower()}, None
    if op is sre.IN:
        chars: set[str] = set()
        for kind, x in arg:
            if kind is sre.LITERAL:
                chars.add(chr(x).lower())
            elif kind is sre.RANGE and x[1] - x[0] < _CHARS:
                chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None, None
        return (chars if len(chars) <= _CHARS else None), None
    if op is sre.SUBPATTERN:
        return _sequence(arg[3])
    if op is sre.BRANCH:
        parts = [_sequence(x) for x in arg[1]]
        if all(e is not None for e, _ in parts):
            strings = set().union(*(e for e, _ in parts))
            return strings, _trigrams(strings)
        queries = [q for _, q in parts]
        return None, None if any(q is None for q in queries) else _least(frozenset().union(*queries))
    if op is sre.MAX_REPEAT:
        low, high, inner = arg
        exact, query = _sequence(inner)
        if (low, high) == (0, 1) and exact is not None:
            return exact | {""}, None
        return None, query if low else None
    return None, None


def trigram_query(pattern: str) -> Clauses | None:
    """Clauses of lower-case trigrams, one of which every match holds whole; None if there are none."""
    return _sequence(_parser.parse(pattern))[1]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is made once a row."""
    return F.get(F.transform(F.array(value), body), 0)


def running(values: Column, add: Callable[[Column, Column], Column], step: int = -1) -> Column:
    """Running totals of an array from its begin (step -1) or to its end (1), in n log n steps.

    Doubling, sixteen-fold: after level j a place holds the total of the 16 ** j values up to it.
    Arrays of up to 16 ** LEVELS values are done in full.
    """

    def level(v: Column, j: int) -> Column:
        if j == LEVELS:
            return v
        at = lambda w: lambda x, i: F.aggregate(F.sequence(F.lit(1), F.lit(15)), x, lambda s, t: add(s, F.get(w, i + t * (step * 16**j))))
        return _let(v, lambda w: F.when(F.size(w) <= 16**j, w).otherwise(level(F.transform(w, at(w)), j + 1)))

    return level(values, 0)


def _sum(a: Column, b: Column) -> Column:
    return a + F.coalesce(b, F.lit(0))


def _branches(strings: set[str]) -> str:
    """A pattern of strings of one length as a tree whose branches are halved, so that a place fails after few tests."""
    heads = sorted({t[0] for t in strings if t})
    if len(heads) > 3:
        low = set(heads[: len(heads) // 2])
        parts = [{t for t in strings if (t[0] in low) == x} for x in (True, False)]
        return "|".join("(?=[" + "".join(re.escape(c) for c in sorted({t[0] for t in p})) + f"])(?:{_branches(p)})" for p in parts)
    return "|".join(re.escape(c) + f"(?:{_branches({t[1:] for t in strings if t[0] == c})})" for c in heads)


def _lines(docs: DataFrame, text: str, rules: tuple[Rule, ...]) -> DataFrame:
    """docs with __text, __lines and the index __index: (trigram, line number) of every trigram that
    rules need, found in one pass over the text."""
    grams = sorted({t for r in rules for c in (trigram_query(r.pattern) or ()) for t in c})
    own = docs.withColumn("__text", F.coalesce(F.col(text), F.lit(""))).withColumn("__lines", F.split("__text", "\n", -1))
    wanted = F.lit(f"(?=({_branches(set(grams))}))")
    entry = lambda line, i: F.transform(F.array_distinct(F.regexp_extract_all(F.lower(line), wanted, F.lit(1))), lambda t: F.struct(t.alias("gram"), i.alias("line")))
    return own.withColumn("__index", F.flatten(F.transform("__lines", entry)) if grams else F.expr("cast(array() as array<struct<gram:string,line:int>>)"))


def _candidates(rule: Rule) -> Column:
    """Numbers of the lines that may hold a match, in order."""
    query = trigram_query(rule.pattern)
    if query is None:
        return F.sequence(F.lit(0), F.size("__lines") - 1)
    posting = lambda t: f"transform(filter(__index, e -> e.gram = {_quoted(t)}), e -> e.line)"
    lists = [reduce(lambda x, y: f"array_intersect({x}, {y})", map(posting, clause)) for clause in sorted(sorted(c) for c in query)]
    return F.expr(reduce(lambda x, y: f"array_union({x}, {y})", lists))


def _key_end(s: Column, dash: Column, past: Column) -> Column:
    """Where a private key ends whose first line is the match s.

    It ends after its END line if that is the next one with five dashes; else after the lines of
    base64 that follow; else with its first line. dash and past have, for each line, the next one with
    dashes and the next one that is none of a key's body.
    """
    lines, starts = F.col("__lines"), F.col("__starts")
    closing = lambda x: F.length(F.regexp_extract(F.substring(x, F.locate("-----", x), _CLOSING), _END, 0))
    there = F.get(dash, s["i"] + 1)
    line = F.get(lines, there)
    stop = F.coalesce(F.get(past, s["i"] + 1), F.size(lines))
    more = (stop > s["i"] + 1) & F.get(lines, stop - 1).rlike(_BASE64) & F.coalesce(F.get(lines, stop).rlike(_LAST), F.lit(False))
    last = F.when(more, stop).otherwise(stop - 1)
    at = (
        F.when(F.contains(s["rest"], F.lit("-----")), F.when(closing(s["rest"]) > 0, s["end"] + F.locate("-----", s["rest"]) - 1 + closing(s["rest"])))
        .when(s["final"] & there.isNotNull() & (closing(line) > 0), F.get(starts, there) + F.locate("-----", line) - 1 + closing(line))
    )
    body = F.when(s["final"] & s["rest"].rlike(_BLANK) & (last > s["i"]), F.get(starts, last) + F.length(F.get(lines, last))).otherwise(s["end"])
    return F.coalesce(at, body)


def _keys_whole(found: Column, number: int) -> Column:
    """Matches with those of private keys extended to the whole key."""
    lines = F.col("__lines")
    header = lambda x: F.coalesce(x.rlike(_HEADER), F.lit(False))
    body = lambda x, j: x.rlike(_BASE64) | header(x) | (x.rlike(_BLANK) & header(F.get(lines, j - 1)))
    # both tests in one running minimum from the end
    tests = F.transform(lines, lambda x, j: F.struct(F.when(F.contains(x, F.lit("-----")), j).alias("d"), F.when(~body(x, j), j).alias("p")))
    least = lambda a, b: F.struct(F.least(a["d"], b["d"]).alias("d"), F.least(a["p"], b["p"]).alias("p"))
    whole = lambda x: F.transform(found, lambda s: F.when(s["kind"] == number, s.withField("end", _key_end(s, x["d"], x["p"]))).otherwise(s))
    return F.when(F.exists(found, lambda s: s["kind"] == number), _let(running(tests, least, 1), lambda w: _let(F.struct(F.transform(w, lambda t: t["d"]).alias("d"), F.transform(w, lambda t: t["p"]).alias("p")), whole))).otherwise(found)


def _spans(rules: tuple[Rule, ...]) -> Column:
    """Array of (start, kind, end) of the matches, from the lines with matches in __cut."""
    sums = lambda s: running(F.transform(s["m"], lambda n, k: n + F.length(F.get(s["gap"], k))), _sum)
    least = F.array(*[F.lit(r.least) for r in rules])

    def one(s: Column, n: Column, k: Column, total: Column) -> Column:
        end = F.get("__starts", s["i"]) + F.get(total, k)
        return F.struct((end - n).alias("start"), s["kind"].alias("kind"), end.alias("end"), F.get(s["v"], k).alias("v"), s["i"].alias("i"), F.get(s["gap"], k + 1).alias("rest"), (k == F.size(s["m"]) - 1).alias("final"))

    found = F.flatten(F.transform("__cut", lambda s: _let(sums(s), lambda total: F.transform(s["m"], lambda n, k: one(s, n, k, total)))))
    found = F.filter(found, lambda s: s["v"] >= F.get(least, s["kind"]))
    keys = [k for k, r in enumerate(rules) if r.kind == "private_key"]
    if keys:
        found = _let(found, lambda x: _keys_whole(x, keys[0]))
    return F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))


_NONE = "cast(array() as array<struct<start:int,kind:int,end:int>>)"
_NO_CUT = "cast(array() as array<struct<kind:int,i:int,m:array<int>,v:array<int>,gap:array<string>>>)"


def _cut(rule: Rule, number: int) -> Column:
    """(kind, i, m, v, gap) of the candidate lines that match: number of the rule and of the line,
    lengths of the matches and of their tested groups, and the texts around them."""
    pattern = F.lit(rule.pattern)
    wide = rule.least and rule.group == 0 and re.fullmatch(r"\[[^\]]*\]\+", rule.pattern)
    probe = f"{rule.pattern[:-1]}{{{rule.least}}}" if wide else rule.pattern  # a class alone: as many in a row
    lines = F.filter(F.transform(_candidates(rule), lambda i: F.struct(i.alias("i"), F.get("__lines", i).alias("line"))), lambda s: s["line"].rlike(probe))
    sizes = lambda s, group: F.transform(F.regexp_extract_all(s["line"], pattern, F.lit(group)), F.length)
    made = F.transform(lines, lambda s: F.struct(F.lit(number).alias("kind"), s["i"].alias("i"), sizes(s, 0).alias("m"), sizes(s, rule.group).alias("v"), F.split(s["line"], pattern, -1).alias("gap")))
    if trigram_query(rule.pattern) is not None:
        return made
    return F.when(F.col("__text").rlike(probe), made).otherwise(F.expr(_NO_CUT))


def find_secrets(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, out: str = "secrets") -> DataFrame:
    """docs with an array of (start, kind, end), by start, then kind (a number into rules)."""
    own = _lines(docs, text, rules)
    own = own.withColumn("__cut", F.concat(F.expr(_NO_CUT), *[_cut(r, k) for k, r in enumerate(rules)]))
    before = _let(F.transform("__lines", lambda x: F.length(x) + 1), lambda n: F.zip_with(running(n, _sum), n, lambda t, x: t - x))
    own = own.withColumn("__starts", F.when(F.size("__cut") > 0, before))
    own = own.withColumn(out, F.when(F.size("__cut") > 0, _spans(rules)).otherwise(F.expr(_NONE)))
    return own.drop("__text", "__lines", "__index", "__starts", "__cut")


def _piece(chunks: Column, begin: Column, end: Column) -> Column:
    """Characters begin to end of a text that is cut into chunks of CHUNK characters."""
    i, j = F.floor(begin / CHUNK).cast("int"), F.floor((end - 1) / CHUNK).cast("int")
    head = F.substring(F.get(chunks, i), begin - i * CHUNK + 1, F.lit(CHUNK))
    tail = F.substring(F.get(chunks, j), F.lit(1), end - j * CHUNK)
    within = F.substring(F.get(chunks, i), begin - i * CHUNK + 1, end - begin)
    inner = F.when(j > i + 1, F.array_join(F.slice(chunks, F.greatest(i + 2, F.lit(1)), F.greatest(j - i - 1, F.lit(0))), "")).otherwise("")
    return F.when(end <= begin, "").when(i == j, within).otherwise(F.concat(head, inner, tail))


def spelled(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, mask: str = MASK) -> DataFrame:
    """docs with secrets in the text masked (overlapping ones by one mask); other columns as they are."""
    own = find_secrets(docs, text, rules, "__secrets")
    chunks = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    far = running(F.transform("__secrets", lambda s: s["end"]), F.greatest)

    def masked(x: Column) -> Column:
        spans, ends, parts = F.col("__secrets"), x["ends"], x["chunks"]
        past = lambda i: F.when(i > 0, F.get(ends, i - 1)).otherwise(0)
        kept = F.transform(spans, lambda s, i: F.when(s["start"] >= past(i), F.concat(_piece(parts, past(i), s["start"]), F.lit(mask))))  # overlapping ones: null, not joined
        return F.concat(F.array_join(kept, ""), _piece(parts, F.get(ends, F.size(ends) - 1), F.length(F.col(text))))

    new = F.when(F.size("__secrets") > 0, _let(F.struct(far.alias("ends"), chunks.alias("chunks")), masked)).otherwise(F.col(text))
    return own.withColumn("__new", new).select(*[F.col("__new").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("secrets", lambda s: s["kind"] < len(BASE))
    return own.select("doc_id", *[n(k).alias(f"n_{x}") for k, x in enumerate(BASE)], F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("secrets")).alias("spans"))


def _sql() -> str:
    q = lambda s: s.replace("'", "''")
    parts = [
        f"""SELECT doc_id, {k} AS k, '{r.kind}' AS kind, string_split_regex(t, '{q(r.pattern)}') AS gap,
  regexp_extract_all(t, '{q(r.pattern)}', 0) AS m, regexp_extract_all(t, '{q(r.pattern)}', {r.group}) AS v, {r.least} AS least FROM doc"""
        for k, r in enumerate(RULES)
    ]
    return f"""
WITH doc AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
raw AS ({" UNION ALL ".join(parts)}),
cut AS (SELECT doc_id, k, kind, least, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS x, unnest(v) AS v, unnest(gap[1:len(m)]) AS g FROM raw WHERE len(m) > 0),
pos AS (SELECT doc_id, k, kind, length(x) AS n, length(v) AS nv, least,
  sum(length(g) + length(x)) OVER (PARTITION BY doc_id, k ORDER BY i) - length(x) AS s FROM cut),
fit AS (SELECT doc_id, k, s, kind || ':' || s || ':' || (s + n) AS x FROM pos WHERE nv >= least),
per AS (SELECT doc_id, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c,
  string_agg(x, ',' ORDER BY s, k) FILTER (k < {len(BASE)}) AS base, string_agg(x, ',' ORDER BY s, k) AS spans FROM fit GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM doc LEFT JOIN per USING (doc_id)
"""


SQL = _sql()
