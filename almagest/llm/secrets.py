"""Secret scans through a trigram inverted index.

For each rule a Boolean query over trigrams is derived from its regular expression: whatever matches must hold all trigrams of one clause.
The index has a posting list of documents for each trigram that a query names; lists are intersected clause by clause, and only
the candidates are verified with the expression.  Rules without mandatory trigrams scan every document.

All on DataFrame functions.  Texts are indexed lower-cased, so a query serves either case; the verification is exact.

Spans are code points, end exclusive.  Defined cases: a null text counts as empty; rows are scanned one by one, whatever their ids (null, repeated, of any
type), and rows that repeat id and text are looked up once; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parse
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAP = "\0"
MOST = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret; a match counts if its group ``group`` has at least ``at_least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    at_least: int = 1


#: The contract's rules. Longer repeats stand for "n characters or more": a maximal run that is too short holds no match.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: What the method adds.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("payment_key", r"[sr]k_(?:live|test)_[A-Za-z0-9]{10,}"),
)


def _strings(parsed: object) -> list[str]:
    """What a parsed expression can match, as strings with gaps; always covers every match."""
    out = [""]
    for op, arg in parsed:
        if op is sre.LITERAL:
            found = [chr(arg).lower()]
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg) and len(arg) <= 8:
            found = sorted({chr(c).lower() for _, c in arg})
        elif op is sre.BRANCH:
            found = [s for branch in arg[1] for s in _strings(branch)]
        elif op is sre.SUBPATTERN:
            found = _strings(arg[3])
        elif op is sre.AT:
            found = [""]
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, inner = arg
            once = _strings(inner)
            if (low, high) == (0, 1):
                found = ["", *once]
            elif low == 0 or once == [GAP]:
                found = [GAP]
            else:
                found = ["".join(p) for p in product(once, repeat=low)] if len(once) ** low <= MOST else [GAP]
                found = [f + GAP for f in found] if high != low else found
        else:
            found = [GAP]
        out = [a + b for a in out for b in found] if len(out) * len(found) <= MOST else [a + GAP for a in out]
    return out


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Clauses of trigrams, one of which every match holds in full (lower-cased); None without mandatory trigrams."""
    clauses = [frozenset(s[i : i + 3] for i in range(len(s) - 2) if GAP not in s[i : i + 3]) for s in _strings(sre_parse.parse(pattern))]
    if not all(clauses):
        return None
    return sorted({c for c in clauses if not any(d < c for d in clauses)}, key=sorted)


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """trigram, key: the documents (columns key, text) whose lower-cased text holds it."""
    low = F.lower("text")
    held = F.filter(F.array(*map(F.lit, trigrams)), lambda g: F.contains(F.col("low"), g))
    return docs.select("key", low.alias("low")).select("key", F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame | None:
    """key, kinds: which indexed rules each document may match; None if no rule has an index query."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    rows = [(kind, n, g, len(clause)) for kind, clauses in queries.items() for n, clause in enumerate(clauses) for g in sorted(clause)]
    if not rows:
        return None
    # As many rows as the rules' trigrams: a bound that no table changes.
    clauses = docs.sparkSession.createDataFrame(rows, "kind string, clause int, trigram string, size int")
    found = postings(docs, sorted({r[2] for r in rows})).join(F.broadcast(clauses), "trigram")
    # Rows that share an id may list a trigram twice, which can only add candidates if trigrams are counted once each.
    met = found.distinct().groupBy("key", "kind", "clause", "size").agg(F.count(F.lit(1)).alias("met"))
    return met.filter("met = size").groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def running_sums(values: Column) -> Column:
    """The sums up to each element, by doubling distances: as many steps as the number of elements has binary digits."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int"))
    shifted = lambda xs, k: F.concat(F.array_repeat(F.lit(0).cast("long"), F.pow(F.lit(2), k).cast("int")), F.slice(xs, 1, F.greatest(F.size(xs) - F.pow(F.lit(2), k).cast("int"), F.lit(0))))
    return F.when(F.size(values) > 1, F.aggregate(steps, values, lambda xs, k: F.when(F.pow(F.lit(2), k) < F.size(xs), F.zip_with(xs, shifted(xs, k), lambda a, b: a + b)).otherwise(xs))).otherwise(values)


def spans(text: Column, rule: Rule, place: int) -> Column:
    """array<struct<start, place, kind, end>> of the rule's leftmost non-overlapping matches that count."""
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    sized = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else matches
    between = F.split(text, F.lit(rule.pattern), -1)
    lengths = lambda xs: F.transform(xs, lambda x: F.length(x).cast("long"))
    parts = F.struct(lengths(matches).alias("m"), lengths(between).alias("b"), lengths(sized).alias("s"))

    def at(parts: Column) -> Column:
        steps = F.zip_with(F.slice(parts["b"], 1, F.size(parts["m"])), parts["m"], lambda b, m: b + m)
        ends = F.zip_with(running_sums(steps), parts["m"], lambda e, m: F.struct(e.alias("end"), m.alias("m")))
        every = F.zip_with(ends, parts["s"], lambda e, s: F.struct((e["end"] - e["m"]).alias("start"), F.lit(place).alias("place"), F.lit(rule.kind).alias("kind"), e["end"].alias("end"), s.alias("s")))
        counted = F.filter(every, lambda x: x["s"] >= rule.at_least)
        return F.when(F.size(parts["m"]) > 0, F.transform(counted, lambda x: F.struct(x["start"].alias("start"), x["place"].alias("place"), x["kind"].alias("kind"), x["end"].alias("end"))))

    none = F.array().cast("array<struct<start:bigint,place:int,kind:string,end:bigint>>")
    found = F.element_at(F.transform(F.array(parts), at), 1)
    return F.coalesce(F.when(F.rlike(text, F.lit(rule.pattern)), found), none)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and ``found``, all spans (start, place, kind, end) by start, then by the order of the rules."""
    ident = F.col(f"`{id_col}`")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    # A key of id and text: neither null ids nor copies share one. Two rows with one key would only be verified for each other's rules too.
    rows = docs.select(ident.alias("id"), F.xxhash64(ident.cast("string"), text).alias("key"), text.alias("text"))
    chosen = candidates(rows.select("key", "text"), rules)
    kinds = F.array().cast("array<string>")
    if chosen is not None:
        rows = rows.join(chosen, "key", "left")
        kinds = F.coalesce("kinds", kinds)
    found = [spans(F.col("text"), r, i) if trigram_query(r.pattern) is None else F.when(F.array_contains(kinds, r.kind), spans(F.col("text"), r, i)) for i, r in enumerate(rules)]
    none = F.array().cast("array<struct<start:bigint,place:int,kind:string,end:bigint>>")
    return rows.select(F.col("id").alias(id_col), F.array_sort(F.concat(*[F.coalesce(f, none) for f in found])).alias("found"))


def written_out(found: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
