"""Secret scan with a trigram inverted index, in DataFrame operations only.

Each rule's regular expression gives a Boolean query over trigrams that any
match must contain (lower case). The index lists, for every trigram of these
queries, the documents that contain it; intersecting the lists of a query gives
the candidates of its rule, and only those are searched with the expression
itself. A rule without a mandatory trigram is run over every text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from re import _parser as parser  # the standard library's own reading of an expression

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelworks.session import materialise

MOST_STRINGS = 16
MOST_LETTERS = 8


@dataclass(frozen=True)
class Rule:
    """``pattern`` runs as it is, leftmost and not overlapping; a match is dropped
    when its ``group`` has fewer than ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# fixed values: the base rules
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
# fixed values: widely published token formats
MORE = (
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("url_login", r"://[A-Za-z0-9_.~%-]+:[A-Za-z0-9_.~%!$&*+,;=-]+@"),
)
RULES = BASE + MORE


def trigram_query(pattern: str) -> list[frozenset[frozenset[str]]]:
    """Clauses that all must hold; a clause holds when all trigrams of one of its sets occur."""
    clauses: list[frozenset[frozenset[str]]] = []

    def close(strings: set[str]) -> set[str]:
        if strings and all(len(s) >= 3 for s in strings):
            clauses.append(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))
        return {""}

    def letters(items) -> set[str] | None:
        found: set[str] = set()
        for kind, value in items:
            if str(kind) == "LITERAL":
                found.add(chr(value).lower())
            elif str(kind) == "RANGE" and value[1] - value[0] < MOST_LETTERS:
                found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return found if len(found) <= MOST_LETTERS else None

    def exact(nodes) -> set[str] | None:
        """All strings the nodes can match, when they are few."""
        strings = {""}
        for kind, value in nodes:
            more = options(str(kind), value)
            if more is None or len(strings) * len(more) > MOST_STRINGS:
                return None
            strings = {s + m for s in strings for m in more}
        return strings

    def options(kind: str, value) -> set[str] | None:
        if kind == "LITERAL":
            return {chr(value).lower()}
        if kind == "IN":
            return letters(value)
        if kind == "SUBPATTERN":
            return exact(value[3])
        if kind == "BRANCH":
            parts = [exact(branch) for branch in value[1]]
            return None if None in parts else set().union(*parts)
        if kind == "MAX_REPEAT" and value[1] == 1:
            once = exact(value[2])
            return None if once is None else once | ({""} if value[0] == 0 else set())
        return None

    def walk(nodes, strings: set[str]) -> set[str]:
        for kind, value in nodes:
            more = options(str(kind), value)
            if more is not None and len(more) <= MOST_STRINGS:
                if len(strings) * len(more) > MOST_STRINGS:
                    strings = close(strings)
                strings = {s + m for s in strings for m in more}
            elif str(kind) == "SUBPATTERN":
                strings = walk(value[3], strings)
            else:
                strings = close(strings)
                if str(kind) == "MAX_REPEAT" and value[0] >= 1:
                    close(walk(value[2], {""}))
        return strings

    close(walk(parser.parse(pattern), {""}))
    return clauses


def trigrams_of(rules: tuple[Rule, ...]) -> list[str]:
    return sorted({t for r in rules for clause in trigram_query(r.pattern) for some in clause for t in some})


def build_index(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Postings (trigram, doc_id) of the rules' trigrams, as a stored table."""
    grams = trigrams_of(rules)
    if not grams:
        return docs.select(F.lit("").alias("trigram"), "doc_id").where("false")
    low = docs.select("doc_id", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.col("low").contains(g), F.lit(g)) for g in grams]))
    postings = low.select("doc_id", F.explode(held).alias("trigram"))
    return materialise(postings.select("trigram", "doc_id"), "trigram-index")


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and the kinds whose trigram query it satisfies, by intersecting postings."""
    uses: dict[str, list[tuple]] = {}
    clauses_of: dict[str, int] = {}
    for rule in rules:
        clauses = trigram_query(rule.pattern)
        clauses_of[rule.kind] = len(clauses)
        for c, clause in enumerate(clauses):
            for s, some in enumerate(sorted(clause, key=sorted)):
                for gram in some:
                    uses.setdefault(gram, []).append((rule.kind, c, s, len(some)))
    if not uses:
        return index.select("doc_id", F.array(F.lit("")).alias("kinds")).where("false")

    def struct(kind, c, s, size) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(c).alias("clause"), F.lit(s).alias("some"), F.lit(size).alias("size"))

    plan = F.create_map(*[x for g, us in sorted(uses.items()) for x in (F.lit(g), F.array(*[struct(*u) for u in us]))])
    wanted = index.select("doc_id", "trigram", F.inline(F.element_at(plan, F.col("trigram"))))
    met = wanted.groupBy("doc_id", "kind", "clause", "some", "size").agg(F.count_distinct("trigram").alias("n")).where("n = size")
    needed = F.create_map(*[x for k, n in sorted(clauses_of.items()) if n for x in (F.lit(k), F.lit(n))])
    whole = met.groupBy("doc_id", "kind").agg(F.count_distinct("clause").alias("n")).where(
        F.col("n") == F.element_at(needed, F.col("kind")))
    return whole.groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


SPANS = "array<struct<start:int,rank:int,stop:int,kind:string>>"
FOLD = 256  # elements a fold puts together before it adds them to what it has


def folded(steps: Column, step, kind: str, around=None) -> Column:
    """All elements that ``step`` gives from left to right, flat.

    ``step`` takes the place reached so far, an element of ``steps`` and what holds
    for its block, and returns the next place and an array of new elements, of type
    ``kind``. A block's own struct has the place it begins at (``base``) and what
    ``around`` makes of that place and the block's steps (``held``). A growing array is
    copied at every step, so steps are folded in blocks and only the blocks' results
    are added to a long array: the work is linear in the number of steps, but for a
    square of the number of blocks that stays far below it.
    """
    none = f"cast(array() as {kind})"

    def inner(part: Column, own: Column) -> Column:
        def grown(done: Column, x: Column) -> Column:
            at, new = step(done["at"], x, own)
            return F.struct(at.alias("at"), F.concat(done["out"], new).alias("out"))

        return F.aggregate(part, F.struct(own["base"].alias("at"), F.expr(none).alias("out")), grown)

    def block(done: Column, part: Column) -> Column:
        held = around(done["at"], part) if around else F.lit(None)
        # arrays of one bind what a block has and what its fold gives, so that each is made once
        own = F.array(F.struct(done["at"].alias("base"), held.alias("held")))
        return F.transform(F.transform(own, lambda o: inner(part, o)), lambda r: F.struct(
            r["at"].alias("at"), F.concat(done["out"], F.array(r["out"])).alias("out")))[0]

    starts = F.sequence(F.lit(0), F.floor((F.greatest(F.size(steps), F.lit(1)) - 1) / FOLD).cast("int"))
    parts = F.transform(starts, lambda b: F.slice(steps, b * FOLD + 1, FOLD))
    whole = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{kind}>)").alias("out")), block)
    return F.flatten(whole["out"])


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """Sorted spans of one rule: the texts between matches and the matches give the places."""
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    kept = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else hits
    gaps = F.split(text, rule.pattern, -1)
    steps = F.arrays_zip(
        F.transform(hits, F.length).alias("hit"), F.transform(kept, F.length).alias("kept"), F.transform(gaps, F.length).alias("gap"))
    none = F.expr(f"cast(array() as {SPANS})")

    def step(at: Column, x: Column, own: Column) -> tuple[Column, Column]:
        begin = at + x["gap"]
        end = begin + F.coalesce(x["hit"], F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("stop"), F.lit(rule.kind).alias("kind"))
        return end, F.when(x["kept"] >= rule.least, F.array(span)).otherwise(none)

    # one array binds the steps, so that the expression runs once over the text
    found = F.transform(F.array(steps), lambda s: folded(s, step, SPANS))[0]
    return F.when(F.regexp_like(text, F.lit(rule.pattern)), found).otherwise(none)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, most_broadcast: int = 1_000_000) -> DataFrame:
    """Every row as struct ``row`` with ``spans``: (start, rank, stop, kind), sorted.

    Places count code points, stop exclusive; rank is the rule's place in
    ``rules``. A null or empty text has no spans. Rows repeat as they come, a null
    doc_id is matched to its candidates like any other, and columns of any name
    pass through inside ``row``. Candidates, some 100 bytes a document, are
    broadcast up to ``most_broadcast`` documents and joined by a shuffle beyond.
    """
    indexed = tuple(r for r in rules if trigram_query(r.pattern))
    rows = docs.select(F.struct("*").alias("row"))
    if indexed:
        found = materialise(candidates(build_index(docs, indexed), indexed), "secret-candidates")
        if found.count() <= most_broadcast:
            found = F.broadcast(found)
        rows = rows.join(found, rows["row"]["doc_id"].eqNullSafe(found["doc_id"]), "left").select("row", "kinds")
    else:
        rows = rows.withColumn("kinds", F.expr("cast(null as array<string>)"))
    text = F.col("row.text")
    none = F.expr(f"cast(array() as {SPANS})")
    parts = []
    for rank, rule in enumerate(rules):
        spans = _spans(text, rule, rank)
        if rule in indexed:
            spans = F.when(F.array_contains("kinds", rule.kind), spans)
        parts.append(F.coalesce(spans, none))
    return rows.select("row", F.array_sort(F.concat(*parts)).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])))


def digests(scanned: DataFrame, base: int = len(BASE)) -> DataFrame:
    """doc_id, the number of spans of each base kind, and the spans as text."""
    own = F.filter("spans", lambda s: s["rank"] < base)

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scanned.select(
        F.col("row.doc_id").alias("doc_id"), *[number(r.kind) for r in BASE],
        F.sha2(_joined(own), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every secret replaced by ``[kind]``; overlapping secrets become one mark.

    A null or empty text stays as it is, rows repeat as they come, and n_chars, where
    the table has it, is counted again for changed texts and the others.
    """
    text = F.coalesce(F.col("row.text"), F.lit(""))

    def last(spans) -> Column:
        return F.array_max(F.transform(spans, lambda s: s["stop"]))

    def region(at: Column, spans: Column) -> Column:
        """The text of a block's spans: a place in it is found by counting from its own begin."""
        return F.substring(text, at + 1, last(spans) - at)

    def step(at: Column, s: Column, own: Column) -> tuple[Column, Column]:
        gap = F.substring(own["held"], at - own["base"] + 1, s["start"] - at)
        pieces = F.array(gap, F.concat(F.lit("["), s["kind"], F.lit("]")))
        return F.greatest(at, s["stop"]), F.when(s["start"] >= at, pieces).otherwise(F.expr("cast(array() as array<string>)"))

    pieces = folded(F.col("spans"), step, "array<string>", region)
    clean = F.concat(F.array_join(pieces, ""), F.substring(text, last("spans") + 1, F.length(text)))
    new = F.when(F.size("spans") > 0, clean).otherwise(F.col("row.text"))
    fresh = {"text": new} | ({"n_chars": F.length(new).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return scan(docs, rules).select(*[fresh.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def oracle(rules: tuple[Rule, ...] = RULES, base: int = len(BASE)) -> str:
    """The same result in DuckDB SQL, by plain search of every text."""
    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def spans(rank: int, rule: Rule) -> str:
        p = quoted(rule.pattern)
        return (
            f"list_filter(list_transform(range(1, len(regexp_extract_all(t, {p})) + 1), lambda i: "
            f"{{'start': (list_sum(list_transform(list_slice(string_split_regex(t, {p}), 1, i), lambda x: length(x))) + "
            f"coalesce(list_sum(list_transform(list_slice(regexp_extract_all(t, {p}), 1, i - 1), lambda x: length(x))), 0))::BIGINT, "
            f"'rank': {rank}, 'size': length(regexp_extract_all(t, {p})[i])::BIGINT, "
            f"'kept': length(regexp_extract_all(t, {p}, {rule.group})[i]), 'kind': {quoted(rule.kind)}}}), "
            f"lambda s: s.kept >= {rule.least})")

    every = ", ".join(spans(k, r) for k, r in enumerate(rules))
    text = "list_transform({}, lambda s: concat(s.kind, ':', s.start, ':', s.start + s.size))"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, list_sort(flatten([{every}])) AS spans FROM d)
SELECT doc_id,
  len(list_filter(spans, lambda s: s.kind = 'assign'))::BIGINT AS n_assign,
  len(list_filter(spans, lambda s: s.kind = 'access'))::BIGINT AS n_access,
  len(list_filter(spans, lambda s: s.kind = 'hex'))::BIGINT AS n_hex,
  sha256(array_to_string({text.format(f"list_filter(spans, lambda s: s.rank < {base})")}, ',')) AS base_sha256,
  array_to_string({text.format("spans")}, ',') AS spans
FROM s"""
