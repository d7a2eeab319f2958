"""Sanitisation of personal data with DataFrame functions only: what is found by pattern, and what gives it away.

Base spans are the emails, addresses, card and phone numbers of ``KINDS``; each distinct one is a protected entity.
A term (letters and digits, ``MIN_CHARS`` at least) that stands in the context of an entity reveals it by their
pointwise mutual information over all lines of the corpus, PMI = log2(P(e | t) N / n(e)), set against
the information of the entity, IC = -log2(n(e) / N). At PMI >= ``DISCLOSURE`` * IC the term gives
the entity away. Every entity is judged, however rare. P(e | t) is the lower end of Wilson's interval for the share
n(e, t) / n(t) of the term's lines, at ``CONFIDENCE`` standard deviations, so few meetings count for less and none is cut
off; copies of a line are one meeting. Two contexts are tried, each with its own counts: the entity's line,
and that line with its two neighbours; a term that passes in either is telling. In every
document that holds the entity, such terms get spans of kind ``term`` beside the base spans, and ``sanitize`` puts a
general mark in their place or removes them.

Offsets count code points; ends are exclusive. A kind's matches are leftmost and do not overlap; matches that fail
their test are dropped and not tried again. Null text is empty and has no spans. Rows of one id share the terms that
their entities call for. A row without id is searched for base spans only. An empty table gives an empty
one. Other columns pass through; those named like the results are replaced.
"""

from __future__ import annotations

from typing import Callable, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import stored

DISCLOSURE = 0.9
# One-sided, 95 %.
CONFIDENCE = 1.645
MIN_CHARS = 4
TERM = "term"
TERM_PATTERN = r"[\p{L}\p{N}]+"


def repeated(part: str) -> str:
    """One or more of a part, as many as possible; atomic groups keep Java's recursion shallow on long texts."""
    return f"(?>(?>(?:{part}){{1,100}}){{1,100}})+"


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def valid_ip(match: Column) -> Column:
    def small(part: Column) -> Column:
        bare = F.ltrim(part, F.lit("0"))
        return (F.length(bare) <= 3) & (F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(match, r"\."), small)


def luhn(number: Column) -> Column:
    backwards = F.reverse(number)

    def add(total: Column, place: Column) -> Column:
        digit = F.substring(backwards, place, F.lit(1)).cast("int")
        doubled = digit * 2
        return total + F.when(place % 2 == 1, digit).when(doubled > 9, doubled - 9).otherwise(doubled)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def valid_card(match: Column) -> Column:
    n = F.length(digits(match))
    return (n >= 12) & (n <= 19) & luhn(digits(match))


def valid_phone(match: Column) -> Column:
    return F.length(digits(match)).between(9, 15)


class Kind(NamedTuple):
    name: str
    guard: str  # found in every text that holds a span of the kind
    pattern: str
    valid: Callable[[Column], Column]


# A match can begin only at the border of a run or where the last match ended; saying so keeps long runs linear.
LOCAL = "[A-Za-z0-9._%+-]"
KINDS = [
    Kind("email", "@[A-Za-z0-9-]", rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++{repeated(r'\.[A-Za-z0-9-]++')}", lambda m: F.lit(True)),
    Kind("ip", r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", valid_ip),
    Kind("card", "[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]",
         f"[0-9]{repeated('[ -]?+[0-9]')}", valid_card),
    Kind("phone", r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]", valid_phone),
]
SPAN = "struct<start: int, ord: int, stop: int, kind: string, match: string>"


def located(text: Column, pattern: str, ord_: int, kind: str, wanted: Callable[[Column, Column, Column], Column]) -> Column:
    """Spans of the matches of a pattern for which ``wanted(match, start, stop)`` holds, in order.

    Splitting by the pattern gives what lies between the matches, so offsets are running sums of lengths.
    """
    between, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(between.alias("gap"), matches.alias("hit"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def step(state: Column, pair: Column) -> Column:
        hit = F.coalesce(pair["hit"], F.lit(""))
        start = state["at"] + F.length(pair["gap"])
        stop = start + F.length(hit)
        span = F.struct(start.alias("start"), F.lit(ord_).alias("ord"), stop.alias("stop"), F.lit(kind).alias("kind"), hit.alias("match"))
        more = F.when((F.length(hit) > 0) & wanted(hit, start, stop), F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(stop.alias("at"), more.alias("spans"))

    return F.aggregate(pairs, begin, step, lambda state: state["spans"])


def base_spans(text: Column) -> Column:
    """All base spans of a text, by start and then by kind."""
    none = F.array().cast(f"array<{SPAN}>")

    def of_kind(ord_: int, kind: Kind) -> Column:
        matches = located(text, kind.pattern, ord_, kind.name, lambda match, start, stop: F.lit(True))
        return F.when(text.rlike(kind.guard), F.filter(matches, lambda span: kind.valid(span["match"]))).otherwise(none)

    found = [of_kind(i, kind) for i, kind in enumerate(KINDS)]
    return F.when(text.rlike("[0-9@]"), F.array_sort(F.concat(*found))).otherwise(none)


def terms_of(line: Column) -> Column:
    """Distinct terms of a line."""
    return F.filter(F.array_distinct(F.split(F.lower(line), r"[^\p{L}\p{N}]+", -1)), lambda t: F.length(t) >= MIN_CHARS)


def least_share(hits: Column, n: Column, different: Column) -> Column:
    """Lower end of Wilson's interval for hits / n, where only ``different`` of the hits are no copies."""
    share, z2 = hits / n, CONFIDENCE ** 2
    tries = n * different / hits
    spread = CONFIDENCE * F.sqrt(share * (1 - share) / tries + z2 / (4 * tries * tries))
    return (share + z2 / (2 * tries) - spread) / (1 + z2 / tries)


def contexts(text: Column, entity: Column) -> Column:
    """The lines that hold an entity (``own``) and their neighbours."""
    lines = F.split(text, "\n", -1)
    holds, no = F.transform(lines, lambda x: F.contains(x, entity)), F.array(F.lit(False))
    around = F.arrays_zip(lines.alias("line"), holds.alias("own"), F.concat(no, holds).alias("after"),
                          F.concat(F.slice(holds, F.lit(2), F.size(holds)), no).alias("before"))
    return F.filter(around, lambda x: x["line"].isNotNull() & (x["own"] | x["after"] | x["before"]))


def disclosing_terms(docs: DataFrame, disclosure: float = DISCLOSURE) -> DataFrame:
    """(id, terms) for documents (id, text): the terms that give away an entity of the document."""
    found = docs.where("id is not null").select("id", "text", base_spans(F.col("text")).alias("spans")).where(F.size("spans") > 0)
    entities = found.select("id", "text", F.explode(F.array_distinct(F.transform("spans", lambda s: s["match"]))).alias("entity"))
    # Entities and their lines are few; they are stored so that the patterns run once over the texts.
    near = entities.select("id", "entity", F.explode(contexts(F.col("text"), F.col("entity"))).alias("x"))
    lines = stored(near.select("id", "entity", F.col("x.line").alias("line"), F.col("x.own").alias("own")), "pii")
    bare = F.col("line")
    for kind in KINDS:
        bare = F.regexp_replace(bare, kind.pattern, " ")
    own = F.col("own").cast("bigint")
    n_entity = lines.groupBy("entity").agg(F.sum(own).alias("n_e_own"), F.count("*").alias("n_e"))
    met = (lines.select("entity", F.xxhash64("line").alias("h"), own.alias("own"), F.explode(terms_of(bare)).alias("term"))
           .groupBy("entity", "term", "h").agg(F.sum("own").alias("own"), F.count("*").alias("n"))
           .groupBy("entity", "term").agg(F.sum("own").alias("n_et_own"), F.count_if(F.col("own") > 0).alias("d_own"),
                                          F.sum("n").alias("n_et"), F.count("*").alias("d")))
    all_lines = docs.select(F.split("text", "\n", -1).alias("lines"))
    n_term = (all_lines.select(F.explode(F.flatten(F.transform("lines", terms_of))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t")))
    total = all_lines.agg(F.sum(F.size("lines")).alias("n"))
    n = float(total.first()["n"] or 1)

    def tells(share: Column, n_e: str) -> Column:
        """PMI >= disclosure * IC."""
        return F.coalesce(F.log2(share * n / F.col(n_e)) >= disclosure * F.log2(n / F.col(n_e)), F.lit(False))

    def judged(hits: str, different: str, n_e: str) -> Column:
        return (F.col(hits) > 0) & tells(least_share(F.col(hits), F.col("n_t"), F.col(different)), n_e)

    telling = (met.join(n_entity, "entity").join(n_term, "term")
               .where(judged("n_et_own", "d_own", "n_e_own") | judged("n_et", "d", "n_e")).select("entity", "term"))
    return (lines.select("id", "entity").distinct().join(telling, "entity").groupBy("id").agg(F.collect_set("term").alias("terms")))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosure: float = DISCLOSURE) -> DataFrame:
    """Adds ``base`` and ``spans``: arrays of spans (start, ord, stop, kind, match), by start and then by kind."""
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    telling = disclosing_terms(texts, disclosure).select(F.col("id").alias("_pd_id"), F.col("terms").alias("_pd_terms"))
    rest = [c for c in docs.columns if c not in ("base", "spans")]
    text = F.coalesce(F.col(text_col), F.lit(""))
    joined = docs.select(*rest).join(telling, F.col(id_col) == F.col("_pd_id"), "left").withColumn("base", base_spans(text))

    def telling_term(match: Column, start: Column, stop: Column) -> Column:
        free = ~F.exists(F.col("base"), lambda s: (s["start"] < stop) & (start < s["stop"]))
        return F.array_contains(F.col("_pd_terms"), F.lower(match)) & free

    more = F.when(F.col("_pd_terms").isNotNull() & (F.size("base") > 0), located(text, TERM_PATTERN, len(KINDS), TERM, telling_term))
    spans = F.when(more.isNull(), F.col("base")).otherwise(F.array_sort(F.concat(F.col("base"), more)))
    return joined.select(*rest, "base", spans.alias("spans"))


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda span: span["kind"] == kind)).cast("bigint")


def written(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def sanitize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", remove_terms: bool = False, **limits) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; telling terms can be removed instead."""
    found = find_personal_data(docs, id_col, text_col, **limits)
    text = F.coalesce(F.col(text_col), F.lit(""))

    def step(state: Column, span: Column) -> Column:
        mark = F.concat(F.lit("["), F.upper(span["kind"]), F.lit("]"))
        mark = F.when(span["kind"] == TERM, F.lit("")).otherwise(mark) if remove_terms else mark
        before = F.substring(text, state["at"] + 1, span["start"] - state["at"])
        overlaps = span["start"] < state["at"]
        return F.struct(F.greatest(state["at"], span["stop"]).alias("at"),
                        F.when(overlaps, state["out"]).otherwise(F.concat(state["out"], before, mark)).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate("spans", begin, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return found.select(*[clean.alias(c) if c == text_col else F.col(c) for c in docs.columns])
