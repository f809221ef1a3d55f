"""Personal data by patterns, and the terms that disclose it, with DataFrame functions only.

Emails, ip addresses, card and phone numbers are found by pattern. Protected are their values and what recurs of them: an
email's domain, an ip's network of 24 bits, a card's issuer (six digits) and a phone's first four digits. Corpus
co-occurrence then tells how strongly a word reveals such an entity. With n documents, an entity e in n(e), a term t in
n(t) and both in n(e, t), the chance p(e | t) is estimated by the lower end of Wilson's interval of n(e, t) / n(t), so
that few documents prove little. A term discloses an entity if

* at most ``DOUBT`` bits of doubt are left: -log2 p(e | t) <= ``DOUBT``;
* it tells ``GAIN`` bits at least: log2 p(e | t) - log2 (n(e) / n) >= ``GAIN``; and
* that is no chance meeting: n(e, t) * log2(n / n(e)) bits are ``SURE`` bits more than it takes to name one of all pairs of
  entities and terms that met.

A word that stands in one or two documents is never marked, however rare: two documents can't tell what goes with an entity
from what happens to stand beside it. An entity of one or two documents is protected by its domain, network, issuer or
first digits. Rows that are alike count as documents of their own, as all rows do. ``sanitise`` replaces marked spans by
their kind, and disclosing terms by what they are: a number, a name (a capital first) or a term.

Terms are runs of letters, marks and digits of any length, in lower case. Positions are code points, the end exclusive.
Work is near to linear in a text's length: places are running sums over blocks of matches, and terms meet words by a join. A null
text counts as empty and has no spans; ``sanitise`` keeps it null. Rows are judged one by one, so repeated rows and rows
without an id get spans as well. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Bits of doubt that a term may leave at most, bits that it must tell, and bits of evidence over naming a pair.
DOUBT, GAIN, SURE = 1.0, 1.0, 7.0
#: Standard deviations of the interval (one-sided 95 %); fewer documents than its square leave more than a bit of doubt.
Z = 1.64
#: Values that one fold goes over, and code points of a text's block.
FOLD, BLOCK = 64, 1024

#: What each kind's match must look like. Repetitions that cannot give back are possessive, and a match
#: begins where its run does or where the last match ended, so that long runs are read once. A card's shorter runs of
#: digits are left out here, as they fail its test.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GUARDS = {"email": "@", "phone": "+"}
TERM = r"[\p{L}\p{M}\p{N}]++"

_SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"


def _let(value: Column, f) -> Column:
    """``f`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _running(values: Column, more, levels: int = 2) -> Column:
    """For each of an array of whole numbers, ``more`` over those before it, from 0 on.

    Appending to an array copies it, so values are folded ``FOLD`` at a time, from what the folds before came to.
    """

    def fold(part: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), F.expr("CAST(array() AS array<int>)").alias("out"))
        return F.aggregate(
            part, first, lambda a, v: F.struct(more(a["at"], v).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"]
        )

    if not levels:
        return fold(values, F.lit(0))
    count = F.ceil(F.size(values) / FOLD).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: F.slice(values, i * FOLD + 1, FOLD))
    return _let(parts, lambda ps: F.flatten(F.zip_with(
        ps, _running(F.transform(ps, lambda p: F.aggregate(p, F.lit(0), more)), more, levels - 1), fold
    )))


def _passes(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        byte = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
        return value.rlike(rf"^{byte}(?:\.{byte}){{3}}$")
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _matches(text: Column, kind: str, pattern: str) -> Column:
    """All leftmost non-overlapping matches; a match ends after the gaps and matches up to it."""

    def placed(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
        lengths = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: g + F.length(m))
        ends = _let(lengths, lambda own: F.zip_with(_running(own, lambda x, y: x + y), own, lambda x, y: x + y))
        return F.zip_with(ends, found, lambda end, m: F.struct(
            F.lit(kind).alias("kind"), (end - F.length(m)).alias("start"), end.alias("end"), m.alias("value")
        ))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def base_spans(text: Column) -> Column:
    """The pattern spans of a text column that holds no null, by kind, then start."""
    none = F.expr(f"CAST(array() AS {_SPANS})")
    parts = []
    for kind, pattern in PATTERNS.items():
        there = text.rlike(pattern)
        if kind in GUARDS:
            there = F.contains(text, F.lit(GUARDS[kind])) & there
        parts.append(F.when(there, _kept(text, kind, pattern)).otherwise(none))
    return F.concat(*parts)


def _kept(text: Column, kind: str, pattern: str) -> Column:
    return F.filter(_matches(text, kind, pattern), lambda s: _passes(kind, s["value"]))


def _with_spans(docs: DataFrame, keep_text: bool) -> DataFrame:
    """Staged rows with a number each and their pattern spans; the text stays where there are any, or everywhere."""
    rows = docs.withColumn("spans", base_spans(F.coalesce("text", F.lit("")))).withColumn("row", F.monotonically_increasing_id())
    return staged(rows if keep_text else rows.withColumn("text", F.when(F.size("spans") > 0, F.col("text"))), "spans")


def _protected(s: Column) -> Column:
    """A span's value and what recurs of it."""
    value, digits = F.lower(s["value"]), F.regexp_replace(s["value"], "[^0-9]", "")
    own = F.when(s["kind"].isin("email", "ip"), value).otherwise(digits)
    wider = (
        F.when(s["kind"] == "email", F.concat(F.lit("domain:"), F.substring_index(value, "@", -1)))
        .when(s["kind"] == "ip", F.concat(F.lit("network:"), F.substring_index(value, ".", 3)))
        .when(s["kind"] == "card", F.concat(F.lit("issuer:"), F.substring(digits, 1, 6)))
        .otherwise(F.concat(F.lit("first:"), F.substring(digits, 1, 4)))
    )
    return F.array(F.concat(s["kind"], F.lit(":"), own), wider)


def _terms(text: Column) -> Column:
    """The distinct words of a text in lower case."""
    return F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0))), lambda w: F.lower(w)))


def lower_bound(both: Column, among: Column) -> Column:
    """The lower end of Wilson's interval of a share."""
    p, z2 = both / among, Z * Z
    return (p + z2 / (2 * among) - Z * F.sqrt(p * (1 - p) / among + z2 / (4 * among * among))) / (1 + z2 / among)


def disclosing_terms(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(``row``, ``term``): the terms that disclose an entity of the row.

    Entities of the same documents are judged as one. An entity or a term of fewer than ``Z`` squared documents, and a term of
    twice an entity's documents or more, leave too much doubt; so they go before terms meet entities, without loss.
    """
    total, least, often = found.count(), Z * Z / (2**DOUBT - 1), 2.0**DOUBT
    held = found.where("size(spans) > 0")
    named = held.select("row", F.explode(F.array_distinct(F.flatten(F.transform("spans", _protected)))).alias("entity"))
    entities = named.groupBy("entity").agg(
        F.count("*").alias("n_entity"), F.bit_xor(F.xxhash64("row")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), "row")).alias("b")
    ).where((F.col("n_entity") >= least) & (F.col("n_entity") * 2**GAIN <= total))
    group = ["n_entity", "a", "b"]
    holders = staged(named.join(entities, "entity").select("row", *group).distinct(), "holders")
    tops = holders.groupBy("row").agg(F.max("n_entity").alias("top"))
    most = holders.agg(F.max("n_entity")).first()[0] or 0
    in_reach = lambda n_entity: (F.col("n_term") >= least) & (F.col("n_term") < often * n_entity)
    words = docs.select(F.explode(_terms(F.col("text"))).alias("term"))
    terms = words.groupBy("term").agg(F.count("*").alias("n_term")).where(in_reach(F.lit(most)))
    there = held.join(tops, "row").select("row", "top", F.explode(_terms(F.col("text"))).alias("term"))
    near = there.join(terms, "term").where(in_reach(F.col("top"))).drop("top")
    pairs = staged(near.join(holders, "row").where(in_reach(F.col("n_entity"))), "pairs")
    both = staged(pairs.groupBy(*group, "term", "n_term").agg(F.count("*").alias("both")), "both")
    chance, rate = lower_bound(F.col("both"), F.col("n_term")), F.col("n_entity") / F.lit(float(max(total, 1)))
    sure = F.log2(F.lit(float(max(both.count(), 1)))) + SURE
    flagged = both.where(
        (-F.log2(chance) <= DOUBT) & (F.log2(chance) - F.log2(rate) >= GAIN) & (-F.col("both") * F.log2(rate) >= sure)
    ).select(*group, "term")
    return pairs.join(flagged, [*group, "term"]).select("row", "term").distinct()


def _with_terms(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` with the spans of disclosing terms outside of pattern spans; only rows with such terms are joined.

    Words and pattern spans are put in order together, and a word is left alone if a pattern span before it ends after its
    start or one after it starts before its end.
    """
    marked = staged(disclosing_terms(docs, found), "marked")
    rows = found.join(marked.select("row").distinct(), "row", "left_semi")
    words = rows.select("row", F.explode(_matches(F.col("text"), "term", TERM)).alias("s")).select("row", "s.start", "s.end", "s.value")
    words = words.withColumn("term", F.lower("value")).join(marked, ["row", "term"]).drop("term")
    spans = rows.select("row", F.explode("spans").alias("s")).select("row", "s.start", "s.end", F.lit(None).cast("string").alias("value"))
    base, order = F.col("value").isNull(), Window.partitionBy("row").orderBy("start", "end")
    placed = words.unionByName(spans).withColumn(
        "before", F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn("after", F.min(F.when(base, F.col("start"))).over(order.rowsBetween(0, Window.unboundedFollowing)))
    free = placed.where(~base & (F.coalesce("before", F.lit(0)) <= F.col("start")) & (F.coalesce("after", F.col("end")) >= F.col("end")))
    terms = free.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end", "value"))).alias("t")).select(
        "row", F.transform("t", lambda t: F.struct(F.lit("term").alias("kind"), t["start"].alias("start"), t["end"].alias("end"), t["value"].alias("value"))).alias("terms")
    )
    held = F.size("spans") > 0
    return found.where(held).join(terms, "row", "left").unionByName(found.where(~held).withColumn("terms", F.lit(None).cast(_SPANS)))


def find(docs: DataFrame) -> DataFrame:
    """``doc_id``, its pattern ``spans`` and the spans of its disclosing ``terms``."""
    docs = docs.select("doc_id", "text")
    found = _with_spans(docs, keep_text=False)
    rows = _with_terms(docs, found)
    return rows.select("doc_id", "spans", F.coalesce("terms", F.expr(f"CAST(array() AS {_SPANS})")).alias("terms"))


def listed(spans: Column) -> Column:
    """The spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _general(s: Column) -> Column:
    """What a span is replaced by."""
    kind = F.when(s["kind"] != "term", s["kind"]).when(s["value"].rlike(r"^\p{N}+$"), "number").when(s["value"].rlike(r"^\p{Lu}"), "name")
    return F.concat(F.lit("<"), kind.otherwise("term"), F.lit(">"))


def _replaced(text: Column, spans: Column) -> Column:
    """``text`` with its spans, in the order of their starts, replaced; of spans that overlap the first one names all.

    A piece of text is cut from the blocks that it lies in, as a cut counts code points from its string's beginning.
    """

    def rebuilt(blocks: Column) -> Column:
        def piece(start: Column, end: Column) -> Column:
            cut = lambda i: F.substring(
                F.get(blocks, i), F.greatest(start - i * BLOCK, F.lit(0)) + 1, F.least(end - i * BLOCK, F.lit(BLOCK)) - F.greatest(start - i * BLOCK, F.lit(0))
            )
            span = F.sequence(F.floor(start / BLOCK).cast("int"), F.floor((end - 1) / BLOCK).cast("int"))
            return F.when(start < end, F.array_join(F.transform(span, cut), "")).otherwise("")

        def joined(over: Column) -> Column:
            parts = F.zip_with(spans, over, lambda s, at: F.when(s["start"] >= at, F.concat(piece(at, s["start"]), s["by"])).otherwise(""))
            last = F.greatest(F.element_at(over, -1), F.element_at(spans, -1)["end"])
            return F.concat(F.array_join(parts, ""), piece(last, F.length(text)))

        return _let(_running(F.transform(spans, lambda s: s["end"]), lambda x, y: F.greatest(x, y)), joined)

    return _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), rebuilt)


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with every marked span of ``text`` replaced by what it is in angle brackets."""
    columns = docs.columns
    packed = docs.select(F.struct(*columns).alias("doc"), "text")
    found = _with_spans(packed, keep_text=True)
    rows = _with_terms(packed, found)
    marked = F.concat("spans", F.coalesce("terms", F.expr(f"CAST(array() AS {_SPANS})")))
    inner = F.array_sort(F.transform(marked, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), _general(s).alias("by"))))
    clean = F.when(F.size("spans") > 0, _let(inner, lambda spans: _replaced(F.col("text"), spans))).otherwise(F.col("text"))
    return rows.withColumn("clean", clean).select(*[F.col("clean").alias(c) if c == "text" else F.col(f"doc.{c}").alias(c) for c in columns])
