"""Operator 8 [native]: secret scan by a trigram inverted index.

Each rule's regular expression yields a Boolean query of the trigrams that every match must hold (Python's parser of
patterns does this once, when the plan is built). The index is a written table of postings (trigram, text's digest) for
the queries' trigrams. A query becomes alternatives of trigrams that must all be held; each begins with the postings of
its rarest trigram and intersects them with the others' postings. Only candidates run a rule's expression. A rule
without mandatory trigrams (``hex``) scans every text where it lies. DataFrame functions only.

Spans depend on the text alone, so that texts are known by their MD5: postings, candidates and spans move as digests. A
bitmap of the candidates' digests, of a fixed size, tells which texts have to move to meet them; the others stay. Trigrams
are taken over texts with A-Z lower-cased, which makes queries of case-sensitive rules weaker, never wrong.

Null and empty texts have no spans; repeated rows give repeated rows; null ids are allowed. Spans are ordered by start,
ties by the rules' order. An empty table gives no rows. A very long text is matched whole, in one row's expression. Other
columns are not read.
"""

from __future__ import annotations

import itertools
import re
import re._constants as sre
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import lower_col, materialize, parted, quoted, read


@dataclass(frozen=True)
class Rule:
    """``pattern`` must mean the same in Java and in RE2. A match counts if group ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
)
RULES = BASE + MORE
#: Strings that one part of a pattern may stand for, beyond which it counts as unknown.
SET_LIMIT = 64

# A query is None (any text), a trigram, or ("and" | "or", frozenset of queries).


def _all(queries):
    parts = set()
    for q in queries:
        parts |= q[1] if isinstance(q, tuple) and q[0] == "and" else {q} if q is not None else set()
    return None if not parts else next(iter(parts)) if len(parts) == 1 else ("and", frozenset(parts))


def _any(queries):
    queries = set(queries)
    return None if None in queries or not queries else next(iter(queries)) if len(queries) == 1 else ("or", frozenset(queries))


def _of_strings(strings):
    """One of ``strings`` is in the text."""
    return _any(_all(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _walk(nodes) -> tuple[list[set[str] | None], list]:
    """The parts of a sequence, each a set of its possible strings or None, and queries of parts inside."""
    parts: list[set[str] | None] = []
    inner = []
    for op, arg in nodes:
        if op is sre.LITERAL:
            parts.append({chr(arg).lower()})
        elif op is sre.IN:
            chars = set()
            for kind, value in arg:
                if kind is sre.LITERAL:
                    chars.add(chr(value).lower())
                elif kind is sre.RANGE and value[1] - value[0] < SET_LIMIT:
                    chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
                else:
                    chars = None
                    break
            parts.append(chars if chars and len(chars) <= 8 else None)
        elif op is sre.SUBPATTERN:
            got, more = _walk(arg[3])
            parts += got
            inner += more
        elif op is sre.BRANCH:
            strings, queries = set(), []
            for branch in arg[1]:
                got, more = _walk(branch)
                whole = _joined(got)
                strings = None if whole is None or strings is None else strings | whole
                queries.append(_query(got, more))
            parts.append(strings if strings and len(strings) <= SET_LIMIT else None)
            if strings is None:
                inner.append(_any(queries))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) or getattr(sre, "POSSESSIVE_REPEAT", None) is op:
            low, high, what = arg
            got, more = _walk(what)
            whole = _joined(got)
            if (low, high) == (0, 1) and whole is not None:
                parts.append(whole | {""})
            elif low >= 1:
                parts += [*got, None]  # one copy is certain; what follows it isn't
                inner += more
            else:
                parts.append(None)
        elif op is not sre.AT:
            parts.append(None)
    return parts, inner


def _joined(parts) -> set[str] | None:
    out = {""}
    for p in parts:
        if p is None or len(out) * len(p) > SET_LIMIT:
            return None
        out = {a + b for a in out for b in p}
    return out


def _query(parts, inner):
    queries = list(inner)
    known: set[str] = {""}
    for p in [*parts, None]:
        if p is not None and len(known) * len(p) <= SET_LIMIT:
            known = {a + b for a in known for b in p}
        else:
            queries.append(_of_strings(known))
            known = {""} if p is None else set(p)
    return _all(queries)


def trigram_query(pattern: str):
    """The Boolean trigram query that every match's text satisfies; None where nothing is mandatory."""
    return _query(*_walk(parser.parse(pattern)))


def trigrams(query) -> set[str]:
    return set() if query is None else {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def conjunctions(query) -> list[frozenset[str]]:
    """The query as alternatives, each a set of trigrams that must all be held."""
    if isinstance(query, str):
        return [frozenset({query})]
    parts = [conjunctions(q) for q in sorted(query[1], key=str)]
    if query[0] == "or":
        return list(dict.fromkeys(c for p in parts for c in p))
    return list(dict.fromkeys(frozenset().union(*choice) for choice in itertools.product(*parts)))


def digest(text: str = "text") -> Column:
    return F.unhex(F.md5(F.col(text)))


def postings(df: DataFrame, wanted: set[str], text: str = "text") -> DataFrame:
    """The index: (trigram, digest) for each wanted trigram that a text holds."""
    low = lower_col(F.col(text))
    held = df.where(F.length(text) > 0).select(digest(text).alias("digest"), low.alias("low"))
    tests = F.array_compact(F.array(*[F.when(F.col("low").contains(t), F.lit(t)) for t in sorted(wanted)]))
    return held.select(F.explode(tests).alias("trigram"), "digest")


def small_table(spark: SparkSession, kind: str, rows: list[tuple]) -> DataFrame:
    """Literal rows."""
    return spark.range(1).select(F.inline(F.array(*[F.struct(*map(F.lit, r)) for r in rows]).cast(f"array<struct<{', '.join(f'{n}: {t}' for n, t in (c.split() for c in kind.split(', ')))}>>")))


def candidates(df: DataFrame, rules: tuple[Rule, ...], text: str = "text") -> DataFrame:
    """(digest, kinds): the rules whose query a text's postings satisfy.

    Each alternative of a query begins with the postings of its rarest trigram and intersects them with those of its
    others. The tables of rules and trigrams have a fixed size; postings and seeds are written.
    """
    spark = df.sparkSession
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    lists = [(kind, terms) for kind, q in queries.items() for terms in conjunctions(q)]
    index = materialize(postings(df, set().union(*(terms for _, terms in lists)), text), "postings")
    count = {r["trigram"]: r["n"] for r in index.groupBy("trigram").agg(F.count(F.lit(1)).alias("n")).collect()}  # no more than the rules have
    lists = [(i, kind, sorted(terms, key=lambda t: (count[t], t))) for i, (kind, terms) in enumerate(lists) if terms <= count.keys()]
    first = small_table(spark, "part int, trigram string", [(i, terms[0]) for i, _, terms in lists])
    rest = small_table(spark, "part int, trigram string, bit long", [(i, t, 1 << k) for i, _, terms in lists for k, t in enumerate(terms[1:])])
    whole = small_table(spark, "part int, kind string, all long", [(i, kind, (1 << len(terms) - 1) - 1) for i, kind, terms in lists])
    seeds = materialize(index.join(F.broadcast(first), "trigram").select("part", "digest").distinct(), "seeds")
    others = index.join(F.broadcast(rest), "trigram").select("part", "digest", "bit").join(seeds.hint("merge"), ["part", "digest"], "left_semi")
    held = seeds.select("part", "digest", F.lit(0).cast("long").alias("bit")).union(others).groupBy("part", "digest").agg(F.bit_or("bit").alias("held"))
    sure = held.join(F.broadcast(whole), "part").where(F.col("held") == F.col("all"))
    return materialize(sure.groupBy("digest").agg(F.collect_set("kind").alias("kinds")), "candidates")


def matches(text: Column, rule: Rule) -> Column:
    """Spans (start, end, kind's place) of leftmost non-overlapping matches; those that fail the length are dropped."""
    pattern = rule.pattern
    if rule.kind == "hex":  # runs are disjoint, so that the least length can be part of the pattern
        pattern = f"(?<![0-9a-f])[0-9a-f]{{{rule.least},}}"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    held = F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group)) if rule.group else found
    gaps = F.transform(F.split(text, pattern, -1), lambda s: F.length(s).cast("long"))
    sizes = F.transform(found, lambda s: F.length(s).cast("long"))
    order = [r.kind for r in RULES].index(rule.kind)
    steps = F.arrays_zip(gaps.alias("gap"), sizes.alias("size"), F.transform(held, F.length).alias("part"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>").alias("out"))

    def step(acc, x):
        begin = acc["at"] + x["gap"]
        end = begin + x["size"]
        one = F.struct(begin.alias("start"), F.lit(order).alias("kind"), end.alias("end"))
        return F.struct(F.coalesce(end, begin).alias("at"), F.when(x["part"] >= rule.least, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(steps, start, step, lambda acc: acc["out"])


def found_spans(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """(digest, spans: array of start, kind's place, end; sorted) of every text that has any, written.

    Rules without a query scan each text where it lies; the others meet the texts of their candidates.
    """
    indexed = [r for r in rules if trigram_query(r.pattern) is not None]
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    hit = lambda r: F.col(text).rlike(f"[0-9a-f]{{{r.least}}}") if r.kind == "hex" else F.length(text) > 0
    scanned = [F.when(hit(r), matches(F.col(text), r)).otherwise(none) for r in rules if r not in indexed]
    named = candidates(df, rules, text)
    _, asked = parted(df.select(digest(text).alias("digest"), text), "digest", named.select("digest"))
    asked = asked.join(named.hint("merge"), "digest")
    verified = [F.when(F.array_contains("kinds", r.kind), matches(F.col(text), r)).otherwise(none) for r in indexed]
    parts = [(df.select(digest(text).alias("digest"), text), scanned), (asked, verified)]
    spans = [rows.select("digest", F.concat(*each).alias("spans")).where(F.size("spans") > 0).dropDuplicates(["digest"]) for rows, each in parts if each]
    both = spans[0] if len(spans) == 1 else spans[0].union(spans[1])
    return materialize(both.groupBy("digest").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")), "spans")  # two rows a text at most


def with_spans(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` as c0, c1, .. and ``spans`` (empty without a match), one row per input row."""
    names = [f"c{i}" for i in range(len(keep))]
    rows = df.select(*[F.col(quoted(k)).alias(c) for k, c in zip(keep, names)], digest(quoted(text)).alias("digest"))
    found = found_spans(df.select(F.col(quoted(text)).alias("text")), rules)
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    without, may = parted(rows, "digest", found.select("digest"))
    met = may.join(found.hint("merge"), "digest", "left").select(*names, F.coalesce("spans", none).alias("spans"))
    return without.select(*names, none.alias("spans")).union(met)


def spans_text(spans: Column) -> Column:
    names = F.array(*[F.lit(r.kind) for r in RULES])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans."""
    found = with_spans(df, RULES, text, (id_col,))
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        F.col("c0").alias(id_col), *[count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)], F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"),
    )


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The rows with every span replaced by ``mark``; overlapping spans are replaced once. Columns stay as they are, whatever their names."""
    found = with_spans(df, RULES, text, tuple(df.columns))
    at = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    own = F.col(f"c{df.columns.index(text)}")

    def step(acc, s):
        before = F.substring(own, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], before, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate("spans", at, step, lambda acc: F.concat(acc["out"], F.substring(own, (acc["at"] + 1).cast("int"), F.length(own))))
    out = [F.when(F.size("spans") > 0, clean).otherwise(own) if c == text else F.col(f"c{i}") for i, c in enumerate(df.columns)]
    return found.select(*[c.alias(n) for c, n in zip(out, df.columns)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read(spark, sf_dir, "documents"))
