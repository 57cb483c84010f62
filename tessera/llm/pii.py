"""Personal data: base patterns, and information-theoretic sanitisation of telling terms.

Everything here is DataFrame and SQL expressions.

Base spans are e-mail addresses, IP addresses, card and phone numbers.  Around each span
the nearest words are its context terms.  Over the whole corpus, a term t discloses an
entity kind c by the share of c's information that it gives away,

    log2(p(c | t) / p(c)) / -log2 p(c),

with p(c | t) the share of t's occurrences that are in a context of c and p(c) the share
of all words that are.  It is 1 for a term that occurs in such contexts only, 0 for one
that is independent of them.  The same is done for each value of a kind (one person's
address) in place of the kind, and the larger disclosure counts.  Terms at or over the
threshold are spans of kind ``term`` wherever they stand, and ``sanitised`` generalises
base spans to their kind and removes such terms.

A share needs evidence: a term counts by its occurrences in contexts of the kind, or of
the value, in at least ``LEAST_TEXTS`` different texts.  Below that every word that is rare
by chance and stands by an address once would tell.
The terms are counted: up to ``PLAN_TERMS`` are part of the plan of the second pass, which
then needs no shuffle; more are met by a join with the words of the texts.

Defined results: null and empty texts have no spans; overlapping matches of different
kinds are all reported; terms inside base spans are not; of equal disclosures the kinds are
all listed; repeated rows each count as occurrences, equal texts as one text of evidence;
very long texts are read whole; without any text or span no term tells; an empty table gives
an empty result; columns that are passed through may have any name but base and terms.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.lineage import release, reliable

CONTEXT_WORDS = 3
CONTEXT_CHARS = 48
THRESHOLD = 0.8
LEAST_TEXTS = 5
PLAN_TERMS = 5000
SALTS = 16

# Fixed patterns, each equal to the plain pattern of its kind but free of repeated scans:
# a match can only begin where a run begins or where the last match ended (\G).
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
TERM = r"\p{L}{2,}"


def matches(text: Column, pattern: str) -> Column:
    """All leftmost matches that do not overlap: (s, e, m) in code points, end exclusive."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    parts = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("g"), m.alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,m:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["g"]
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m")))).alias("out"))

    return F.aggregate(parts, start, step, lambda acc: acc["out"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _low_parts(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def base_spans(text: Column) -> Column:
    """All base spans as (kind, s, e, m), by kind and then start."""
    digits = lambda x: F.length(_digits(x["m"]))
    rules = {
        "email": (F.contains(text, F.lit("@")), EMAIL, lambda x: F.lit(True)),
        "ip": (text.rlike(r"[0-9]\.[0-9]"), IP, lambda x: _low_parts(x["m"])),
        "card": (text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), CARD, lambda x: digits(x).between(13, 19) & luhn(_digits(x["m"]))),
        "phone": (F.contains(text, F.lit("+")), PHONE, lambda x: digits(x).between(9, 15)),
    }
    none = F.array().cast("array<struct<kind:string,s:int,e:int,m:string>>")
    found = []
    for kind in KINDS:
        some, pattern, good = rules[kind]
        name = F.lit(kind).alias("kind")
        spans = F.transform(F.filter(matches(text, pattern), good), lambda x: F.struct(name, x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m")))  # noqa: B023
        found.append(F.when(some, spans).otherwise(none))
    return F.concat(*found)


def context_terms(text: Column, spans: Column) -> Column:
    """The nearest words on either side of each base span: (kind, value, term, s, e); none inside a base span."""

    def around(x: Column) -> Column:
        low = F.greatest(x["s"] - CONTEXT_CHARS, F.lit(0))
        before = F.substring(text, low + 1, x["s"] - low)
        after = F.substring(text, x["e"] + 1, F.lit(CONTEXT_CHARS))
        # A word cut by the edge of the context is no term.
        left = F.filter(matches(before, TERM), lambda t: (t["s"] > 0) | (low == 0))
        right = F.filter(matches(after, TERM), lambda t: (t["e"] < CONTEXT_CHARS) | (F.length(after) < CONTEXT_CHARS))
        near = F.when(F.size(left) > CONTEXT_WORDS, F.slice(left, -CONTEXT_WORDS, CONTEXT_WORDS)).otherwise(left)
        named = lambda at: lambda t: F.struct(x["kind"].alias("kind"), x["m"].alias("value"), F.lower(t["m"]).alias("term"), (t["s"] + at).alias("s"), (t["e"] + at).alias("e"))
        found = F.concat(F.transform(near, named(low)), F.transform(F.slice(right, 1, CONTEXT_WORDS), named(x["e"])))
        # Only spans that reach into the context can hold its words; they are found once a span.
        beside = F.filter(spans, lambda y: (y["s"] < x["e"] + CONTEXT_CHARS) & (y["e"] > low))
        free = lambda ys: F.filter(found, lambda t: ~F.exists(ys, lambda y: (y["s"] < t["e"]) & (t["s"] < y["e"])))
        return F.flatten(F.transform(F.array(beside), free))

    return F.flatten(F.transform(spans, around))


def telling_terms(docs: DataFrame, threshold: float = THRESHOLD, least_texts: int = LEAST_TEXTS) -> DataFrame:
    """Rows (kind, term, disclosure) of the terms at or over the threshold, from all of docs (text)."""
    text = F.col("text").cast("string")
    spanned = docs.select(text.alias("text")).withColumn("spans", base_spans(F.col("text"))).where(F.size("spans") > 0)
    contexts = spanned.select(F.xxhash64("text").alias("tk"), F.explode(context_terms(F.col("text"), F.col("spans"))).alias("c"))
    contexts = contexts.select("c.kind", "c.term", F.xxhash64("c.value").alias("value"), "tk")
    by_text = reliable(contexts.groupBy("kind", "term", "value", "tk").agg(F.count("*").alias("n")))
    joint = F.sum("n").alias("joint")
    by_kind = by_text.groupBy("kind", "term").agg(joint, F.count_distinct("tk").alias("texts")).where(F.col("texts") >= least_texts)
    by_value = by_text.groupBy("kind", "value", "term").agg(joint, F.count("*").alias("texts")).where(F.col("texts") >= least_texts)
    kinds = by_text.groupBy("kind").agg(F.sum("n").alias("held"))
    values = by_text.groupBy("kind", "value").agg(F.sum("n").alias("held"))
    common = by_kind.join(kinds, "kind").select("kind", "term", "joint", "held").unionByName(by_value.join(values, ["kind", "value"]).select("kind", "term", "joint", "held"))
    common = reliable(common)
    release(by_text)
    # One scan counts the words of all texts; those that may tell are few among them.
    words = docs.select(F.explode(F.regexp_extract_all(text, F.lit(TERM), F.lit(0))).alias("term"))
    totals = words.groupBy(F.lower("term").alias("term")).agg(F.count("*").alias("total"))
    kept = common.select(F.col("term").alias("wanted")).distinct()
    some = totals.join(kept, F.col("term") == F.col("wanted"), "left").withColumn("at", F.when(F.col("wanted").isNotNull(), F.col("term")))
    # The others add up in one row, so that the sum of all words comes with them.
    some = reliable(some.groupBy("at").agg(F.sum("total").alias("total")))
    every = some.agg(F.sum("total").alias("every"))
    counted = common.join(some.select(F.col("at").alias("term"), "total"), "term").withColumn("every", every.scalar())
    share = F.col("held") / F.col("every")
    disclosure = F.log2(F.least(F.col("joint") / F.col("total"), F.lit(1.0)) / share) / -F.log2(share)
    told = counted.where(F.col("every") > F.col("held")).select("kind", "term", disclosure.alias("disclosure")).where(F.col("disclosure") >= threshold)
    return told.groupBy("kind", "term").agg(F.max("disclosure").alias("disclosure"))


def _words(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower)


def _spans_of(text: Column, is_told: Callable[[Column], Column]) -> Column:
    """(s, e) of all words that are told; only those are listed, so the cost is the length of the text."""
    found, between = F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.split(text, TERM, -1)
    parts = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("g"), m.alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["g"]
        e = s + F.length(x["m"])
        more = F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"))))
        return F.struct(e.alias("at"), F.when(is_told(F.lower(x["m"])), more).otherwise(acc["out"]).alias("out"))

    return F.when(F.exists(_words(text), is_told), F.aggregate(parts, start, step, lambda acc: acc["out"]))


def with_spans(docs: DataFrame, threshold: float = THRESHOLD, least_texts: int = LEAST_TEXTS, plan_terms: int = PLAN_TERMS) -> DataFrame:
    """docs with columns ``base`` and ``terms``: spans (kind, s, e, m) and (kind, s, e)."""
    text = F.col("text").cast("string")
    told = reliable(telling_terms(docs, threshold, least_texts).select("term").distinct())
    out = docs.withColumn("base", F.coalesce(base_spans(text), F.array().cast("array<struct<kind:string,s:int,e:int,m:string>>")))
    none = F.array().cast("array<struct<s:int,e:int>>")
    few = sorted(r.term for r in told.limit(plan_terms + 1).collect())
    if not few:
        return out.withColumn("terms", none)
    if len(few) <= plan_terms:
        is_told = lambda t: t.isin(few)
    else:
        # Texts meet their terms by an equi-join; a frequent one is dealt over the salts.
        names = docs.select(F.xxhash64(text).alias("_tk"), F.explode(F.array_distinct(_words(text))).alias("term"))
        names = names.withColumn("salt", F.pmod("_tk", F.lit(SALTS)))
        salted = told.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
        hits = names.join(salted, ["term", "salt"]).groupBy("_tk").agg(F.collect_set("term").alias("_told"))
        out = out.withColumn("_tk", F.xxhash64(text)).join(hits, "_tk", "left").drop("_tk")
        is_told = lambda t: F.array_contains(F.col("_told"), t)
    free = lambda t: ~F.exists("base", lambda x: (x["s"] < t["e"]) & (t["s"] < x["e"]))
    return out.withColumn("terms", F.coalesce(F.filter(_spans_of(text, is_told), free), none)).drop("_told")


def _joined(spans: Column, kind: Column | None = None) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", kind if kind is not None else x["kind"], x["s"].cast("string"), x["e"].cast("string")))


def sanitised(docs: DataFrame, threshold: float = THRESHOLD, least_texts: int = LEAST_TEXTS) -> DataFrame:
    """docs with ``text`` sanitised: base spans become their kind in brackets, telling terms go."""
    marked = with_spans(docs.select("doc_id", F.col("text").cast("string").alias("text")), threshold, least_texts)
    parts = F.concat(
        F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.concat(F.lit("["), x["kind"], F.lit("]")).alias("by"))),
        F.transform("terms", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit("").alias("by"))),
    )
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        # Of overlapping spans the first gives the replacement, the others only lengthen the cut.
        fresh = x["s"] >= acc["at"]
        kept = F.when(fresh, F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, x["s"] - acc["at"]), x["by"])).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), kept.alias("out"))

    clean = F.aggregate(F.array_sort(parts), start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return marked.select("doc_id", clean.alias("text"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = with_spans(docs)
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    every = F.concat(_joined(F.col("base")), _joined(F.col("terms"), F.lit("term")))
    return marked.select("doc_id", *[count(k) for k in KINDS], F.sha2(F.array_join(_joined(F.col("base")), ","), 256).alias("base_sha256"), F.array_join(every, ",").alias("spans"))
