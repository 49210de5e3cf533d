"""Personal data: patterns propose spans, checksums confirm, context adjusts.

Every pattern is anchored where its maximal run starts and uses possessive
repeats, so matching takes time linear in the text and no stack, also on long
runs of digits or letters; the matches are those of the plain patterns.

Offsets come from splitting a text at its matches: a match starts after all
earlier gaps and matches, a running sum over the matches of one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import text_or_empty

#: kind -> (pattern, score without context, context words). In the order in which spans are listed.
KINDS: dict[str, tuple[str, float, str]] = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9,
              "mail|contact|write"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, "ip|address|host|server|login"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", 0.8, "card|visa|credit|payment"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", 0.7, "phone|call|tel|mobile|fax"),
    # takes one letter at each place where an account number may start; groups: the rest of it at its longest, what follows
    "iban": (r"(?<![A-Za-z0-9])[A-Z](?=([A-Z][0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?))"
             r"((?s:.{0,40})))", 0.9, "iban|account|bank|transfer"),
    "ssn": (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.4, "ssn|social|security"),
}
#: Kinds whose spans are all reported once confirmed; others need a score of `threshold`.
BASE_KINDS = ("email", "ip", "card", "phone")
#: A text without a match of this holds no match of the kind.
HINTS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
#: Characters before and after a span that count as its context, and what a context word adds.
CONTEXT, CONTEXT_SCORE = 40, 0.3
_OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    places = F.split(F.reverse(digits), "")
    value = lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)
    each = F.transform(places, lambda c, i: value(c.cast("int"), i))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account number passes the mod-97 check (remainder 1)."""
    compact = F.regexp_replace(code, r"\x20", "")
    moved = F.concat(F.substr(compact, F.lit(5)), F.substring(compact, 1, 4))
    step = lambda a, c: F.when(c.rlike("[A-Z]"), (a * 100 + F.ascii(c) - 55) % 97).otherwise(
        (a * 10 + c.cast("int")) % 97)
    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


def _account(longest: Column, after: Column) -> Column:
    """The longest start of a proposed account number, cut between its groups of four, that passes the checks; or null."""
    whole = F.when(~after.rlike("^[A-Za-z0-9]") & mod97(longest), longest)
    spaced = F.substring(longest, 5, 1) == " "
    starts = [(F.char_length(longest) > 4 + 5 * n, F.substring(longest, 1, 4 + 5 * n)) for n in range(7, 1, -1)]
    return F.coalesce(whole, *[F.when(spaced & longer & mod97(start), start) for longer, start in starts])


def _confirmed() -> Column:
    hit, digits = F.col("hit"), _digits(F.col("hit"))
    n = F.length(digits)
    alone = ~F.col("left").rlike("[A-Za-z0-9]$") & ~F.col("right").rlike("^[A-Za-z0-9]")
    return (F.when(F.col("kind") == "email", F.lit(True))
            .when(F.col("kind") == "ip", hit.rlike(_OCTETS))
            .when(F.col("kind") == "card", F.when(n.between(16, 19), luhn(digits)).otherwise(False))
            .when(F.col("kind") == "phone", n.between(8, 15))
            .when(F.col("kind") == "iban", hit.isNotNull())
            .otherwise(alone))


def find_spans(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per found span: doc_id, text_mark, kind, start, end, value, score.

    Offsets are code points, the end exclusive; ``text_mark`` is the text's
    64-bit hash and tells rows of one id apart. Rows repeated with the same
    id and text give each span once. The score is the kind's, raised if one
    of its context words stands within 40 characters; spans of the kinds
    beyond email, ip, card and phone need ``threshold``. An account number may
    be followed by other words in capitals or by a second number; one within
    an earlier one is not listed. Null and empty texts have no spans; a null
    id is an id like any other.
    """
    whole = text_or_empty(text)
    found = []
    for kind, (pattern, _, _) in KINDS.items():
        hits, rest, after = (F.regexp_extract_all(whole, F.lit(pattern), F.lit(g if kind == "iban" else 0)) for g in range(3))
        pairs = F.transform(F.arrays_zip(F.split(whole, pattern, -1).alias("gap"), hits.alias("hit"),
                                         rest.alias("rest"), after.alias("after")),
                            lambda p, i: F.struct(
                                F.lit(kind).alias("kind"), i.alias("nth"),
                                F.char_length(p["gap"]).alias("gap"),
                                F.right(p["gap"], F.lit(CONTEXT)).alias("left"),
                                F.left(p["gap"], F.lit(CONTEXT)).alias("head"),
                                F.char_length(p["hit"]).alias("taken"),
                                (F.concat(p["hit"], p["rest"]) if kind == "iban" else p["hit"]).alias("hit"),
                                (p["after"] if kind == "iban" else F.lit(None).cast("string")).alias("after")))
        may = F.contains(whole, F.lit(HINTS[kind])) & whole.rlike(pattern) if kind in HINTS else whole.rlike(pattern)
        found.append(F.when(may, pairs))
    none = F.array().cast("array<struct<kind:string,nth:int,gap:int,left:string,head:string,taken:int,hit:string,after:string>>")
    proposals = (docs.select("doc_id", F.xxhash64(whole).alias("text_mark"),
                             F.explode(F.concat(*[F.coalesce(f, none) for f in found])).alias("p"))
                 .select("doc_id", "text_mark", "p.*"))
    # one row for each match even where rows are repeated, then running offsets within a text
    once = proposals.repartition("doc_id", "text_mark").dropDuplicates(["doc_id", "text_mark", "kind", "nth"])
    order = W.partitionBy("doc_id", "text_mark", "kind").orderBy("nth")
    taken = F.coalesce("taken", F.lit(0))
    iban = F.col("kind") == "iban"
    account = F.when(iban, _account(F.col("hit"), F.col("after"))).otherwise(F.col("hit"))
    beyond = F.substr(F.concat("longest", "after"), F.char_length("hit") + 1, F.lit(CONTEXT))
    spans = (once.withColumn("start", F.sum(F.col("gap") + taken).over(order) - taken)
             .withColumn("right", F.coalesce(F.lead("head").over(order), F.lit("")))
             .filter(F.col("hit").isNotNull())
             .withColumn("longest", F.col("hit")).withColumn("hit", account)
             .withColumn("right", F.when(iban, beyond).otherwise(F.col("right")))
             .withColumn("end", F.col("start") + F.char_length("hit")))
    score, words = F.lit(0.0), F.lit("")
    for kind, (_, base, context) in KINDS.items():
        score = F.when(F.col("kind") == kind, F.lit(base)).otherwise(score)
        words = F.when(F.col("kind") == kind, F.lit(rf"(?i)\b(?:{context})\b")).otherwise(words)
    near = F.regexp_like(F.concat_ws(" ", "left", "right"), words)
    score = F.least(score + F.when(near, F.lit(CONTEXT_SCORE)).otherwise(F.lit(0.0)), F.lit(1.0))
    reached = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    return (spans.filter(_confirmed()).withColumn("score", score)
            .filter(F.col("kind").isin(*BASE_KINDS) | (F.col("score") >= threshold))
            .withColumn("reached", reached).filter(~iban | F.col("reached").isNull() | (F.col("end") > F.col("reached")))
            .select("doc_id", "text_mark", "kind", "start", "end",
                    F.col("hit").alias("value"), "score"))


def pii_report(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: counts of the base kinds, their digest and all spans as text.

    Null and empty texts have no spans, long ones are searched whole;
    repeated rows repeat their result; a null id is an id like any other;
    other columns are not read; an empty table gives no rows.
    """
    spans = find_spans(docs, text)
    place = F.lit(0)
    for i, kind in enumerate(KINDS):
        place = F.when(F.col("kind") == kind, i).otherwise(place)
    entry = F.struct(place.alias("place"), "start", F.concat_ws(
        ":", "kind", F.col("start").cast("string"), F.col("end").cast("string")).alias("said"))
    joined = lambda a: F.array_join(F.transform(F.array_sort(a), lambda x: x["said"]), ",")
    base = F.col("kind").isin(*BASE_KINDS)
    per_text = spans.groupBy("doc_id", "text_mark").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(joined(F.collect_list(F.when(base, entry))), 256).alias("base_sha256"),
        joined(F.collect_list(entry)).alias("spans"))
    rows = docs.select("doc_id", F.xxhash64(text_or_empty(text)).alias("text_mark"))
    r, s = rows.alias("r"), per_text.alias("s")
    both = r.join(s, F.col("r.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("r.text_mark") == F.col("s.text_mark")), "left")
    nothing = F.sha2(F.lit(""), 256)
    return both.select(F.col("r.doc_id").alias("doc_id"),
                       *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
                       F.coalesce("base_sha256", nothing).alias("base_sha256"),
                       F.coalesce("spans", F.lit("")).alias("spans"))
