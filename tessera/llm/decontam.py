"""Benchmark decontamination by a hash set of normalised test n-grams.

The windows of the benchmark (ten consecutive words of an item; the whole item where it
has fewer) become numbers over the benchmark's vocabulary and a sorted table of their
hashes, all flat arrays.  Documents are scanned: words are mapped to vocabulary numbers,
every run of known words is looked up, and each hit is verified on the numbers themselves.

Items are cut into pieces that share all but one word of a window, so that every window is
in a piece and no piece is large.  A block is at most about ``BLOCK_WORDS`` words of pieces;
one block at a time is built, broadcast and scanned with, and let go before the next.  A
benchmark of one block marks documents in a single pass without a shuffle; with more, each
pass stores the hits only, and they meet their documents by key in the end.

Defined results: null and empty texts have no words and no hits; items without words, or
without an identifier, have no windows; items that repeat, or share windows, are all
counted, each by its identifier once; repeated documents count each on their own; very long
texts and items are read whole; an empty benchmark hits nothing, an empty table of documents
gives an empty result; columns to pass on may have any name but doc_id, n_words, hits, items
and clean_text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ALNUM, Shared, bounded_batches, filled, kept_schema, map_slices, mixed, raw, sliced, split_words, word_array
from tessera.llm.urlfilter import LOWER, UPPER
from tessera.operators.lineage import release, reliable

WINDOW = 10
#: Words of benchmark pieces in a block: 100 to 200 MB at the most while it is built.
BLOCK_WORDS = 1 << 20
PIECE_WORDS = 4096


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each of several runs, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


class Windows:
    """The windows of a block of pieces (item, text), by length."""

    def __init__(self, items: list[str], texts: list[str], window: int) -> None:
        self.names = sorted(set(items))
        number = {x: i for i, x in enumerate(self.names)}
        owner = np.array([number[x] for x in items], np.int64)
        letters, offsets, counts = split_words(filled(pa.array(texts, pa.string())), ALNUM)
        coded = word_array(letters, offsets).dictionary_encode()
        self.vocabulary, self.ids = coded.dictionary, coded.indices.to_numpy().astype(np.int32)
        begins = np.append(0, np.cumsum(counts))[:-1]
        self.tables = {}
        for m in np.unique(np.minimum(counts, window)).tolist():
            some = np.flatnonzero(np.minimum(counts, window) == m)
            if m:
                self.tables[m] = self._table(m, _spread(begins[some], counts[some] - m + 1), np.repeat(owner[some], counts[some] - m + 1))

    def _table(self, m: int, starts: np.ndarray, owner: np.ndarray) -> tuple:
        """Seed, hashes of the different windows, a place of each, and its items (ends, numbers)."""
        seed = 1
        while True:
            h = self.hashed([self.ids[starts + j] for j in range(m)], seed)
            order = np.argsort(h, kind="stable")
            h, at = h[order], starts[order]
            new = np.append(True, h[1:] != h[:-1])
            same = np.flatnonzero(~new)
            if all((self.ids[at[same] + j] == self.ids[at[same - 1] + j]).all() for j in range(m)):
                break
            seed += 1  # two windows met in one hash
        pairs = np.unique((np.cumsum(new) - 1) * len(self.names) + owner[order])
        ends = np.searchsorted(pairs // len(self.names), np.arange(new.sum() + 1))
        return seed, h[new], at[new], ends, (pairs % len(self.names)).astype(np.int32)

    @staticmethod
    def hashed(columns: list[np.ndarray], seed: int) -> np.ndarray:
        h = np.full(len(columns[0]), seed, np.uint64)
        for c in columns:
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64))
        return h

    def scan(self, letters: np.ndarray, offsets: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list[list[str]]]:
        """Which words are hit, and the items that each row holds windows of."""
        n = len(offsets) - 1
        rows = np.repeat(np.arange(len(counts)), counts)
        edges, found = np.zeros(n + 1, np.int64), []
        known = pc.index_in(word_array(letters, offsets), value_set=self.vocabulary)
        ids = pc.fill_null(known, -1).to_numpy(zero_copy_only=False).astype(np.int32)
        strange = np.append(0, np.cumsum(ids < 0))
        for m, (seed, hashes, places, ends, owners) in self.tables.items():
            if n < m:
                continue
            at = np.flatnonzero((strange[m:] == strange[: n - m + 1]) & (rows[m - 1 :] == rows[: n - m + 1]))
            if not len(at):
                continue
            h = self.hashed([ids[at + j] for j in range(m)], seed)
            which = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            near = hashes[which] == h
            at, which = at[near], which[near]
            for j in range(m):
                good = ids[at + j] == self.ids[places[which] + j]
                at, which = at[good], which[good]
            np.add.at(edges, at, 1)
            np.add.at(edges, at + m, -1)
            met = np.unique(rows[at] * len(hashes) + which)
            row, which = met // len(hashes), met % len(hashes)
            many = ends[which + 1] - ends[which]
            found.append(np.repeat(row, many) * len(self.names) + owners[_spread(ends[which], many)])
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        cuts = np.searchsorted(pairs // max(1, len(self.names)), np.arange(len(counts) + 1))
        items = [[self.names[i] for i in pairs[a:b] % len(self.names)] for a, b in zip(cuts[:-1], cuts[1:])]
        return np.cumsum(edges[:-1]) > 0, items


def pieces(benchmark: DataFrame, window: int = WINDOW, piece_words: int = PIECE_WORDS) -> DataFrame:
    """Rows (item, piece, words): normalised pieces whose windows are the item's, and how many words they have."""
    held = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        letters, offsets, counts = split_words(filled(part.column("text")), ALNUM)
        bounds, blob, out = np.append(0, np.cumsum(counts)).tolist(), letters.tobytes(), []
        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
            for x in range(a, max(a + (b > a), b - window + 1), piece_words):
                y = min(b, x + piece_words + window - 1)
                out.append((i, b" ".join(blob[offsets[j] : offsets[j + 1]] for j in range(x, y)).decode("utf-8"), y - x))
        arrays = [part.column("item").take(pa.array([o[0] for o in out], pa.int64())), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, ["item", "piece", "words"])

    return map_slices(held, run, "item string, piece string, words long").distinct()


def blocks(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> tuple[int, Iterator[Windows]]:
    """How many blocks the benchmark has, and the blocks, each built when it is asked for."""
    cut = reliable(pieces(benchmark, window, min(PIECE_WORDS, block_words)))
    n = (cut.agg(F.sum("words")).first()[0] or 0) // block_words + 1

    def built() -> Iterator[Windows]:
        for i in range(n):
            rows = cut.where(F.pmod(F.xxhash64("item", "piece"), F.lit(n)) == i).select("item", "piece").collect()  # about block_words words
            yield Windows([r.item for r in rows], [r.piece for r in rows], window)
        release(cut)

    return n, built()


def mark_contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep_text: bool = False, keep: tuple[str, ...] = (), block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows (doc_id, n_words, hits, items[, clean_text], *keep), one for each document row.

    ``hits`` are word numbers in runs [begin, end, begin, end, ...]; ``clean_text`` is the
    text without the bytes from the first to the last word of each run.
    """
    bounded_batches(spark)
    passed = tuple(f"keep_{i}" for i in range(len(keep)))
    text = F.col("text").cast("string")
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *[F.col(c).alias(p) for c, p in zip(keep, passed)])
    n, built = blocks(benchmark, window, block_words)
    if n == 1:
        shared = Shared(spark, next(built))
        next(built, None)
        marked = given.withColumns({"hits": F.lit(None).cast("array<long>"), "items": F.lit(None).cast("array<string>")})
    else:
        shared = None
        key = [F.coalesce("doc_id", F.lit(-(1 << 63))).alias("dk"), F.xxhash64("text").alias("tk")]
        texts, parts = given.select(*key, "text"), []
        for block in built:
            held = Shared(spark, block)
            parts.append(reliable(map_slices(texts, _hits_of(held), "dk long, tk long, hits array<long>, items array<string>")))
            held.destroy()
        found = parts[0]
        for part in parts[1:]:
            found = found.unionByName(part)
        merged = found.groupBy("dk", "tk").agg(F.flatten(F.collect_set("hits")).alias("hits"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
        marked = given.withColumns({"dk": key[0], "tk": key[1]}).join(merged, ["dk", "tk"], "left").select("doc_id", "text", *passed, "hits", "items")
    out = marked.mapInArrow(_marker(shared, keep_text, passed), "doc_id long, text string, n_words long, hits array<long>, items array<string>" + kept_schema(given, passed))
    out = out.withColumnsRenamed(dict(zip(passed, keep)))
    return out.withColumnRenamed("text", "clean_text") if keep_text else out.drop("text")


def _runs(hit: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))


def _hits_of(block):
    """A stage that gives the documents with hits in one block."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        letters, offsets, counts = split_words(filled(part.column("text")), ALNUM)
        hit, items = block.value.scan(letters, offsets, counts)
        bounds = np.append(0, np.cumsum(counts))
        some = [i for i, x in enumerate(items) if x]
        runs = [_runs(hit[bounds[i] : bounds[i + 1]]) for i in some]
        taken = pa.array(some, pa.int64())
        return pa.RecordBatch.from_arrays([part.column("dk").take(taken), part.column("tk").take(taken), pa.array(runs, pa.list_(pa.int64())), pa.array([items[i] for i in some], pa.list_(pa.string()))], ["dk", "tk", "hits", "items"])

    return run


def _marker(block, keep_text: bool, passed: tuple[str, ...]):
    """The last stage: hits of the one block, or those that were found before, as runs and items."""
    names = ["doc_id", "text", "n_words", "hits", "items", *passed]

    def mark(part: pa.RecordBatch) -> pa.RecordBatch:
        letters, offsets, counts = split_words(filled(part.column("text")), ALNUM)
        bounds = np.append(0, np.cumsum(counts))
        if block is not None:
            hit, items = block.value.scan(letters, offsets, counts)
        else:
            hit, items = np.zeros(len(offsets) - 1, bool), [sorted(x or []) for x in part.column("items").to_pylist()]
            for i, old in enumerate(part.column("hits").to_pylist()):
                for a, b in zip((old or [])[::2], (old or [])[1::2]):
                    hit[bounds[i] + a : bounds[i] + b] = True
        runs = [_runs(hit[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
        if keep_text:
            text = part.column("text").cast(pa.string())
            if any(map(len, runs)):
                text = pa.array([_cut(t, r) for t, r in zip(text.to_pylist(), runs)], pa.string())
        else:
            text = pa.nulls(len(counts), pa.string())
        return pa.RecordBatch.from_arrays([part.column("doc_id"), text, pa.array(counts), pa.array(runs, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string())), *map(part.column, passed)], names)

    def run(batches):
        for part in sliced(batches, "text"):
            yield mark(part)

    return run


def _cut(text: str | None, runs: np.ndarray) -> str | None:
    """The text without the given runs of words."""
    if text is None or not len(runs):
        return text
    data, _ = raw(pa.array([text]))
    inside = np.concatenate([[False], ALNUM[data] != 32, [False]])
    begins, ends = np.flatnonzero(inside[1:-1] & ~inside[:-2]), np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
    keep = np.ones(len(data), bool)
    for a, b in zip(runs[::2], runs[1::2]):
        keep[begins[a] : ends[b - 1]] = False
    return data[keep].tobytes().decode("utf-8")


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, remove: str = "documents") -> DataFrame:
    """Documents (doc_id, text) without the contaminated ones, or without the hit spans."""
    marked = mark_contamination(spark, docs, benchmark, window, keep_text=True)
    if remove == "documents":
        marked = marked.where(F.size("hits") == 0)
    return marked.select("doc_id", F.col("clean_text").alias("text"))


def hit_words() -> F.Column:
    """Number of words in the runs of ``hits``."""
    return F.aggregate(F.transform("hits", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    marked = mark_contamination(spark, docs, benchmark)
    return marked.select(
        "doc_id",
        "n_words",
        hit_words().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP4_SQL = f"""
WITH items AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
starts AS (SELECT item, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, m, array_to_string(w[i : i + m - 1], ' ') AS g FROM starts),
lengths AS (SELECT DISTINCT m FROM windows),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
places AS (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM docs, lengths WHERE len(w) >= m),
hits AS (SELECT p.r, p.i, p.m, x.item FROM (SELECT r, m, i, array_to_string(w[i : i + m - 1], ' ') AS g FROM places) p JOIN windows x ON p.m = x.m AND p.g = x.g),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + m)) AS p FROM hits) GROUP BY r),
owners AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(o.n, 0) AS n_items, sha256(coalesce(o.s, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered c ON docs.r = c.r LEFT JOIN owners o ON docs.r = o.r
"""
