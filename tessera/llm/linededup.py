"""Line dedup by a fixed-depth log-template tree.

A line descends by its token count and its ``LEADING`` first tokens (a token with a digit is
a variable field wherever it stands) to a leaf.  A log parser then clusters a leaf's lines
one after the other, which depends on their order and cannot be distributed.  Here the
leaf's own counts say which places are fixed: the support of a token at a place is the
number of lines, counted once for each different text, that have it there.  A line's
template keeps its ``AGREE`` share of best supported places beyond the leading ones (of
equals the first) and generalises all others.  Words of a fixed text have the support of all
its lines, the words of a field only that of some, so lines that differ in their fields get
one template, wherever the fields stand and however many words they take, while the lines of
a template agree in that share of places at least.  Fields never count as agreement; a line
with too few words for that share is its own template, with its fields generalised.

A template recurs if ``min_docs`` different texts have it; ``SHORT_DOCS`` for lines of fewer than
``SHORT_TOKENS`` tokens.  A line of ``LONG_TOKENS`` tokens or more, a passage, also recurs as a
whole, fields generalised, if ``long_docs`` texts have it.  Recurring templates are dropped
from every document but the first (smallest identifier) that has them.  Exact copies of a
text count once, so copies alone make no template recur.

How it runs: one scan counts texts by leaf, through slots of a fixed number; a bitmap of the
slots that can recur (4 MB, whatever the corpus) goes to the second scan, which
gives out the lines of such leaves only.  Slots that several leaves share only let more lines
through; the counts that decide are by 128-bit identities of leaf and tokens.  Texts move
once, to meet the numbers of the lines that they lose.

Defined results: null and empty texts have no lines; lines without tokens are kept; repeated
rows are treated alike; a null identifier comes before all others; of documents with one
identifier the one with the smaller text hash is first; very long texts are read whole, a
slice each; an empty table gives an empty result; columns to pass on may have any name but
doc_id, n_lines, n_dropped and text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import GOLDEN, MIX_A, MIX_B, SPACED, Shared, filled, hash_words, kept_schema, map_slices, mixed, powers, raw
from tessera.operators.lineage import release, reliable

MIN_DOCS = 5
LONG_DOCS = 2
LONG_TOKENS = 50
SHORT_DOCS = 20
SHORT_TOKENS = 4
LEADING = 2
AGREE = 0.6
#: Bits of the leaf bitmap: 2**23 slots in four kinds, 4 MB.
SLOT_BITS = 23
SHORT, PLAIN, LONG, OFTEN = 0, 1, 2, 3
LEAST = -(1 << 63)
FIELD = np.uint64(0x5DEECE66D)


class Lines:
    """The lines of some texts that have tokens: row, number in the row, leaf, identity, and their tokens."""

    def __init__(self, texts: pa.Array) -> None:
        data, offsets = raw(texts)
        mapped = SPACED[data]
        inside = mapped != 32
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        heads = offsets[:-1][offsets[:-1] < len(data)]
        begins[heads] = inside[heads]
        at = np.flatnonzero(begins)
        letters = mapped[inside]
        ends = np.append(np.cumsum(inside, dtype=np.int64)[at] - 1, len(letters)) if len(at) else np.zeros(1, np.int64)
        self.tokens = hash_words(letters, ends)
        if not len(at):
            none = np.zeros(0, np.int64)
            self.row = self.number = self.first = self.size = self.leaf = self.a = self.b = self.words = self.field = none
            return
        self.field = np.maximum.reduceat(((letters >= 48) & (letters <= 57)).view(np.int8), ends[:-1]) > 0
        self.tokens[self.field] = FIELD
        row = np.searchsorted(offsets, at, side="right") - 1
        breaks = np.append(0, np.cumsum(data == 10))
        line = breaks[at] + row
        self.first = first = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
        self.size = size = np.diff(np.append(first, len(line)))
        place = np.arange(len(line)) - np.repeat(first, size)
        leaf = mixed(size.astype(np.uint64) * GOLDEN)
        for j in range(LEADING):
            leaf = mixed(leaf * MIX_A + np.where(size > j, self.tokens[np.minimum(first + j, len(line) - 1)], np.uint64(1)))
        places = powers(int(size.max()))[place]
        whole = [np.add.reduceat(mixed(self.tokens * odd + places * even), first) for odd, even in ((np.uint64(1), MIX_A), (MIX_B, GOLDEN))]
        self.leaf, self.a, self.b = leaf, mixed(leaf + whole[0]).view(np.int64), mixed(leaf * MIX_B + whole[1]).view(np.int64)
        self.row, self.number = row[first], line[first] - breaks[offsets[:-1]][row[first]] - row[first]
        self.words = np.add.reduceat((~self.field & (place >= LEADING)).astype(np.int64), first)

    def codes(self, slot_bits: int) -> np.ndarray:
        """Slot and kind of each line."""
        kind = np.where(self.size < SHORT_TOKENS, SHORT, np.where(self.size < LONG_TOKENS, PLAIN, LONG))
        return (self.leaf >> np.uint64(64 - slot_bits)).astype(np.int64) * 4 + kind if len(self.row) else self.row

    def can_generalise(self) -> np.ndarray:
        """Which lines have words enough for a template of their own share."""
        return (self.size >= SHORT_TOKENS) & (self.words >= kept_places(self.size))


def kept_places(size: np.ndarray) -> np.ndarray:
    """How many places beyond the leading ones a template keeps (AGREE in hundredths, rounded up)."""
    return -(-np.maximum(size - LEADING, 0) * round(100 * AGREE) // 100)


def _keyed(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    text = F.col("text").cast("string")
    passed = [F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)]
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("dk"), F.xxhash64(text).alias("tk"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *passed)


def leaf_bitmap(docs: DataFrame, min_docs: int, long_docs: int, slot_bits: int) -> np.ndarray:
    """One bit a code: whether enough different texts have a line in the slot."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        lines = Lines(filled(part.column("text")))
        pairs = np.unique(lines.row.astype(np.int64) << 32 | lines.codes(slot_bits))
        ends = np.searchsorted(pairs, np.arange(part.num_rows + 1, dtype=np.int64) << 32)
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array((pairs & 0xFFFFFFFF).astype(np.int32)))
        return pa.RecordBatch.from_arrays([part.column("tk"), lists], ["tk", "codes"])

    texts = map_slices(_keyed(docs).select("tk", "text"), run, "tk long, codes array<int>").groupBy("tk").agg(F.first("codes").alias("codes"))
    counted = texts.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    kind = F.pmod("code", F.lit(4))
    floor = F.when(kind == SHORT, SHORT_DOCS).when(kind == PLAIN, min_docs).otherwise(long_docs)
    often = (kind == LONG) & (F.col("n") >= min_docs)
    marks = F.concat(F.when(F.col("n") >= floor, F.array("code")).otherwise(F.array().cast("array<int>")), F.when(often, F.array(F.col("code") + (OFTEN - LONG))).otherwise(F.array().cast("array<int>")))
    marked = counted.select(F.explode(marks).alias("at")).select((F.col("at") + 1).cast("long").alias("at"))
    parts = marked.groupBy(F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros((4 << slot_bits) // 8, np.uint8)
    for r in parts.collect():  # 4 << slot_bits bits at most
        out[(r.part - 1) * 4096 : r.part * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def candidate_lines(docs: DataFrame, bitmap: np.ndarray, min_docs: int, long_docs: int, slot_bits: int) -> DataFrame:
    """Rows (dk, tk, number, leaf, a, b, floor, tokens) of the lines in marked slots.

    ``floor`` is what the line needs as a whole, null if only its template counts; ``tokens``
    is null if it has none; a field is null among the tokens.
    """
    shared = Shared(docs.sparkSession, bitmap)  # of a fixed size

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        lines = Lines(filled(part.column("text")))
        codes, bits = lines.codes(slot_bits), shared.value
        has = lambda c: bits[c >> 3] >> (c & 7) & 1 > 0
        chosen = np.flatnonzero(has(codes))
        size, long_ = lines.size[chosen], codes[chosen] % 4 == LONG
        general = lines.can_generalise()[chosen] & (~long_ | has(codes[chosen] + long_ * (OFTEN - LONG)))
        floor = np.where(codes[chosen] % 4 == SHORT, SHORT_DOCS, np.where(long_, long_docs, min_docs))
        taken = np.where(general, size, 0)
        ends = np.append(0, np.cumsum(taken))
        of = np.repeat(lines.first[chosen] - ends[:-1], taken) + np.arange(ends[-1])
        tokens = pa.array(lines.tokens[of].view(np.int64), mask=lines.field[of].astype(bool)) if len(of) else pa.array([], pa.int64())
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), tokens)
        row = pa.array(lines.row[chosen])
        arrays = [part.column("dk").take(row), part.column("tk").take(row), pa.array(lines.number[chosen].astype(np.int32)), pa.array(lines.leaf[chosen].astype(np.uint64).view(np.int64)), pa.array(lines.a[chosen]), pa.array(lines.b[chosen]), pa.array(floor.astype(np.int32), mask=general & ~long_), lists]
        return pa.RecordBatch.from_arrays(arrays, ["dk", "tk", "number", "leaf", "a", "b", "floor", "tokens"])

    return map_slices(_keyed(docs).select("dk", "tk", "text"), run, "dk long, tk long, number int, leaf long, a long, b long, floor int, tokens array<long>")


def line_templates(lines: DataFrame) -> DataFrame:
    """Rows (a, b, ta, tb): the template (ta, tb) of each different line that can generalise.

    lines has rows (a, b, leaf, tokens, n): n texts have the line.
    """
    places = lines.select("a", "b", "leaf", "n", F.size("tokens").alias("size"), F.posexplode("tokens").alias("place", "token")).where((F.col("place") >= LEADING) & F.col("token").isNotNull())
    places = places.withColumn("spot", F.xxhash64("leaf", "place", "token"))
    support = places.groupBy("spot").agg(F.sum("n").alias("support"))
    ranked = places.join(support, "spot").groupBy("a", "b").agg(
        F.first("leaf").alias("leaf"), F.first("size").alias("size"),
        F.array_sort(F.collect_list(F.struct((-F.col("support")).alias("s"), "place", "token"))).alias("p"),
    )
    need = F.ceil((F.col("size") - LEADING) * round(100 * AGREE) / 100).cast("int")
    kept = F.array_sort(F.transform(F.slice("p", F.lit(1), need), lambda x: F.struct(x["place"], x["token"])))
    return ranked.select("a", "b", F.xxhash64("leaf", kept).alias("ta"), F.xxhash64(F.lit(7), kept, "leaf", "size").alias("tb"))


def lines_to_drop(docs: DataFrame, min_docs: int = MIN_DOCS, long_docs: int = LONG_DOCS, slot_bits: int = SLOT_BITS) -> DataFrame:
    """Rows (dk, tk, gone): the numbers of the lines that each document loses."""
    found = reliable(candidate_lines(docs, leaf_bitmap(docs, min_docs, long_docs, slot_bits), min_docs, long_docs, slot_bits))
    by_text = found.groupBy("tk", "a", "b").agg(F.min("dk").alias("dk"), F.first("floor").alias("floor"), F.first("leaf").alias("leaf"), F.first("tokens").alias("tokens"))
    by_text = reliable(by_text)
    lines = by_text.groupBy("a", "b").agg(F.count("*").alias("n"), F.first("leaf").alias("leaf"), F.first("tokens").alias("tokens"), F.first("floor").alias("floor"), F.min(F.struct("dk", "tk")).alias("owner"))
    lines = reliable(lines)
    templates = reliable(line_templates(lines.where(F.size("tokens") > 0)))
    # Different texts of a template: a text's lines of one template count once.
    met = by_text.select("a", "b", "dk", "tk").join(templates, ["a", "b"])
    once = met.groupBy("ta", "tb", "tk").agg(F.min("dk").alias("dk"))
    often = once.groupBy("ta", "tb").agg(F.count("*").alias("n"), F.min(F.struct("dk", "tk")).alias("owner")).where(F.col("n") >= min_docs)
    general = templates.join(often, ["ta", "tb"]).select("a", "b", "owner")
    whole = lines.where(F.col("n") >= F.col("floor")).select("a", "b", "owner")
    hits = found.select("dk", "tk", "number", "a", "b").join(general.union(whole), ["a", "b"]).where(F.struct("dk", "tk") != F.col("owner"))
    drops = reliable(hits.groupBy("dk", "tk").agg(F.collect_set("number").alias("gone")))
    release(found, by_text, lines, templates)
    return drops


def _drop_lines(text: str, gone: set[int]) -> str:
    return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, keep: tuple[str, ...] = (), long_docs: int = LONG_DOCS, slot_bits: int = SLOT_BITS) -> DataFrame:
    """Rows (doc_id, n_lines, n_dropped, text, *keep), one for each row of docs; text is without its dropped lines."""
    drops = lines_to_drop(docs, min_docs, long_docs, slot_bits)
    passed = tuple(f"keep_{i}" for i in range(len(keep)))
    joined = _keyed(docs, keep).join(drops, ["dk", "tk"], "left").select("doc_id", "text", "gone", *passed)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = raw(filled(part.column("text")))
        breaks = np.append(0, np.cumsum(data == 10))[offsets]
        lines = np.where(np.diff(offsets) > 0, np.diff(breaks) + 1, 0)
        gone, text = part.column("gone"), part.column("text").cast(pa.string())
        some = np.flatnonzero(gone.is_valid().to_numpy(zero_copy_only=False))
        dropped = np.zeros(part.num_rows, np.int64)
        if len(some):  # only documents that lose lines are taken apart
            new = text.to_pylist()
            for i in some:
                numbers = set(gone[i].as_py())
                dropped[i], new[i] = len(numbers), _drop_lines(new[i], numbers)
            text = pa.array(new, pa.string())
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lines, pa.int64()), pa.array(dropped), text, *map(part.column, passed)], ["doc_id", "n_lines", "n_dropped", "text", *passed])

    out = map_slices(joined, run, "doc_id long, n_lines long, n_dropped long, text string" + kept_schema(joined, passed))
    return out.withColumnsRenamed(dict(zip(passed, keep)))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents
), lines AS (
  SELECT r, doc_id, text, i, string_split(text, chr(10))[i] AS line FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM docs WHERE text <> '')
), tokens AS (
  SELECT r, doc_id, text, i, line, list_transform(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+'), lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS w FROM lines
), worded AS (SELECT *, ceil(60 * (len(w) - 2) / 100.0) AS need FROM tokens WHERE len(w) > 0
), by_text AS (SELECT text, w, need, min(doc_id) AS doc_id FROM worded GROUP BY ALL
), different AS (SELECT row_number() OVER () AS d, w, need, count(*) AS n, min(doc_id) AS owner FROM by_text GROUP BY w, need
), places AS (
  SELECT d, len(w) AS size, w[1] AS t1, w[2] AS t2, need, n, p, w[p] AS t FROM (SELECT *, unnest(range(3, len(w) + 1)) AS p FROM different WHERE len(w) >= 4)
  WHERE w[p] <> '<*>'
), supported AS (SELECT *, sum(n) OVER (PARTITION BY size, t1, t2, p, t) AS support FROM places
), ranked AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY support DESC, p) AS k FROM supported
), templates AS (
  SELECT d, size || ' ' || t1 || ' ' || t2 || ' ' || string_agg(p || '=' || t, ' ' ORDER BY p) AS template FROM ranked WHERE k <= need GROUP BY d, size, t1, t2, need HAVING count(*) = need
), often AS (
  SELECT template, min(doc_id) AS owner FROM (SELECT template, b.text, min(b.doc_id) AS doc_id FROM templates JOIN different x USING (d) JOIN by_text b ON b.w = x.w GROUP BY template, b.text) GROUP BY template HAVING count(*) >= 5
), owners AS (
  SELECT x.w, o.owner FROM templates JOIN often o USING (template) JOIN different x USING (d)
  UNION ALL SELECT x.w, x.owner FROM different x LEFT JOIN templates t USING (d)
  WHERE x.n >= CASE WHEN len(x.w) < 4 THEN 20 WHEN len(x.w) >= 50 THEN 2 ELSE 5 END AND (t.d IS NULL OR len(x.w) >= 50)
), gone AS (SELECT DISTINCT s.r, s.i FROM worded s JOIN owners o ON o.w = s.w WHERE s.doc_id <> o.owner
), kept AS (
  SELECT l.r, count(*) AS n_lines, count(g.i) AS n_dropped, coalesce(string_agg(CASE WHEN g.i IS NULL THEN l.line END, chr(10) ORDER BY l.i), '') AS text
  FROM lines l LEFT JOIN gone g ON g.r = l.r AND g.i = l.i GROUP BY l.r
)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped, CASE WHEN k.n_dropped > 0 THEN k.text ELSE d.text END AS text
FROM docs d LEFT JOIN kept k ON k.r = d.r
"""
