"""Near-duplicate detection: fast similarity sketches, banding, exact verification.

Each document is a set of hashed word shingles.  Its sketch has ``BANDS * ROWS``
coordinates, filled by rounds of hashed bin placement: in round i every element falls
into the bin that the round's hash names, an empty bin takes the smallest value it got,
and a document stops once all bins are full.  After as many rounds as there are bins, the
i-th further round fills bin i outright, so every coordinate is filled; most documents
need one to three rounds, and the share of equal coordinates concentrates about the
Jaccard similarity.

Documents with equal sets form a class; only classes go on.  Bands of coordinates are
bucket keys.  Within a bucket nothing is paired with everything.  A bucket's leader is the
class that meets most others.  First every class is verified on full shingle sets against
the most famous leader that it meets, then, in buckets whose members the links so far do
not connect, against each bucket's own leader.  Buckets whose other members then lie in one
component are done.  What is left are families of buckets that share members; a family is
joined exactly, block against block, with a prefix filter that loses no pair.  So every
pair of a bucket is verified or already connected, whatever the bucket's size.

A pair of similarity 0.8 shares one of 32 bands of 5 coordinates with probability
1 - 3e-6 or more.

Defined results: null and empty texts have an empty set and no links; equal texts are one
class; a null identifier never names a component unless all of the component's are null;
an empty table gives an empty result; repeated rows each get their row; a very long text is
a slice of its own and its set is compared whole; ties of fame go to the larger class id;
other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import GOLDEN, MIX_A, SPACED, filled, hash_words, map_slices, mixed, split_words
from tessera.operators.graph import components
from tessera.operators.lineage import reliable, release

BANDS, ROWS = 32, 5
LEAST = -(1 << 63)
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text as sorted 64-bit hashes, and their offsets.

    A text with fewer than k words has one shingle, the whole sequence.
    """
    letters, offsets, counts = split_words(texts, SPACED)
    words = hash_words(letters, offsets)
    bounds = np.append(0, np.cumsum(counts))
    size = max(0, len(words) - k + 1)
    grams = np.full(size, np.uint64(k))
    for j in range(k):
        grams = mixed(grams * MIX_A + words[j : j + size])
    sets = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= k:
            s = np.sort(grams[a : b - k + 1])
            sets.append(s[np.append(True, s[1:] != s[:-1])])
        else:
            h = np.full(min(1, b - a), np.uint64(b - a))
            for w in words[a:b]:
                h = mixed(h * MIX_A + w)
            sets.append(h)
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int64)


def sketches(elements: np.ndarray, offsets: np.ndarray, t: int) -> np.ndarray:
    """The sketch of each non-empty set: a matrix of sets by t coordinates."""
    n = len(offsets) - 1
    out = np.full((n, t), TOP)
    empty = np.ones((n, t), bool)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    e = elements
    for i in range(2 * t):
        if not len(e):
            break
        v = mixed(e + np.uint64(int(GOLDEN) * (i + 1) & int(TOP)))
        if i < t:
            bins = ((v >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64)
        else:
            bins = np.full(len(e), i - t)
        key = owner * t + bins
        open_ = empty.reshape(-1)[key]
        key, v = key[open_], v[open_]
        np.minimum.at(out.reshape(-1), key, v)
        empty.reshape(-1)[key] = False
        live = empty.any(axis=1)[owner] if i < 3 or i % 8 == 0 or i >= t else None
        if live is not None:
            e, owner = e[live], owner[live]
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    s = sketch.reshape(len(sketch), BANDS, ROWS)
    key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(s), 1))
    for j in range(ROWS):
        key = mixed(key * MIX_A + s[:, :, j])
    return key.view(np.int64)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """Rows (doc_id, tkey, n_shingles, cid, bands); cid names the set and is null for an empty one."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        elements, offsets = shingle_sets(filled(part.column("text")), k)
        sizes = np.diff(offsets)
        full = np.flatnonzero(sizes)
        keys = band_keys(sketches(elements, np.append(0, np.cumsum(sizes[full])), BANDS * ROWS))
        cids, bands = [None] * len(sizes), [None] * len(sizes)
        for row, i in enumerate(full):
            cids[i] = hashlib.blake2b(elements[offsets[i] : offsets[i + 1]].tobytes(), digest_size=16).digest()
            bands[i] = keys[row]
        arrays = [part.column("doc_id"), part.column("tkey"), pa.array(sizes), pa.array(cids, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "tkey", "n_shingles", "cid", "bands"])

    return map_slices(_keyed(docs), run, "doc_id long, tkey long, n_shingles long, cid binary, bands array<long>")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tkey"), text.alias("text"))


def _place() -> F.Column:
    """Where a row stands among its group's: known identifiers first, then by identifier and text."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(LEAST)).alias("dk"), F.col("tkey"))


def full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """Rows (cid, elements) for the representative rows in wanted."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        elements, offsets = shingle_sets(filled(part.column("text")), k)
        cids = [hashlib.blake2b(elements[a:b].tobytes(), digest_size=16).digest() for a, b in zip(offsets[:-1], offsets[1:])]
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(elements.view(np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(cids, pa.binary()), lists], ["cid", "elements"])

    found = _keyed(docs).withColumn("rep", _place()).join(wanted, F.col("rep") == F.col("wanted_rep"), "left_semi").select("text")
    return map_slices(found, run, "cid binary, elements array<long>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have a Jaccard similarity of percent/100 or more."""
    left = sets.select(F.col("cid").alias("a"), F.col("elements").alias("xs"))
    right = sets.select(F.col("cid").alias("b"), F.col("elements").alias("ys"))
    both = pairs.join(left, "a").join(right, "b")  # a leader's set is sent to its members' sets, not with each of them
    shared = F.size(F.array_intersect("xs", "ys"))
    return both.where(100 * shared >= percent * (F.size("xs") + F.size("ys") - shared)).select("a", "b")


def similar_sizes(a: str, b: str, percent: int) -> F.Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with ``comp``, the component that the links so far give to their class."""
    return rows.join(labels.select(F.col("node").alias("cid"), "label"), "cid", "left").withColumn("comp", F.coalesce("label", "cid")).drop("label")


def _open(rows: DataFrame) -> DataFrame:
    """A table of the rows of buckets whose members are not all of one component."""
    rows = reliable(rows)
    apart = reliable(rows.groupBy("key").agg(F.min("comp").alias("one"), F.max("comp").alias("other")).where("one <> other").select("key"))
    out = reliable(rows.join(apart, "key", "left_semi"))
    release(rows, apart)
    return out


def class_links(docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame | None:
    """Rows (node, label) for the classes that have links, None if no two classes meet."""
    rows = classes.select("cid", "n_shingles", F.explode("bands").alias("key"))
    # What is said of a bucket is stored before it meets its members: a small table is then sent
    # to them, and a large bucket stays dealt over the tasks that read it.
    often = reliable(rows.groupBy("key").agg(F.count("*").alias("met")).where("met > 1"))
    multi = reliable(rows.join(often, "key"))
    release(often)
    if multi.isEmpty():
        release(multi)
        return None
    fame = multi.groupBy("cid").agg(F.sum("met").alias("fame"))
    live = reliable(multi.join(fame, "cid").select("key", "cid", "n_shingles", F.struct("fame", "cid").alias("place")))
    sets = reliable(full_sets(docs, classes.join(fame, "cid", "left_semi").select(F.col("rep").alias("wanted_rep")), k))
    release(multi)
    # First every class meets one leader, the most famous of its buckets: a set moves once.
    lead = reliable(live.groupBy("key").agg(F.max("place").alias("lead"), F.max_by("n_shingles", "place").alias("lead_size")))
    below = live.join(lead, "key").where((F.col("place") < F.col("lead")) & similar_sizes("n_shingles", "lead_size", percent))
    tried = reliable(below.groupBy("cid").agg(F.max("lead").alias("lead")).select(F.col("cid").alias("a"), F.col("lead.cid").alias("b")))
    edges = reliable(verified(tried, sets, percent))
    labels = components(edges)
    # Then each bucket that is still open meets its own leader, who is then done with.
    now = reliable(_labelled(live, labels))
    release(lead)
    lead = reliable(now.groupBy("key").agg(F.max("place").alias("lead"), F.max_by(F.struct("n_shingles", "comp"), "place").alias("of")))
    below = reliable(now.join(lead, "key").where(F.col("place") < F.col("lead")))
    release(live, now, lead)
    apart = below.where((F.col("comp") != F.col("of.comp")) & similar_sizes("n_shingles", "of.n_shingles", percent))
    pairs = apart.select(F.col("cid").alias("a"), F.col("lead.cid").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    more = reliable(verified(pairs, sets, percent))
    release(labels)
    labels = components(edges.union(more))
    # What other members of a bucket may share is joined exactly.
    open_ = _open(_labelled(below.select("key", "cid"), labels))
    release(below, tried)
    if open_.isEmpty():
        release(open_, edges, more, sets)
        return labels
    heads = open_.groupBy("key").agg(F.min("cid").alias("b"))
    families = components(open_.join(heads, "key").where(F.col("cid") != F.col("b")).select(F.col("cid").alias("a"), "b"))
    members = open_.select("cid", "comp").distinct().join(families.withColumnRenamed("node", "cid"), "cid")
    found = reliable(family_links(members, sets, percent))
    release(open_, families, sets)
    if not found.isEmpty():
        release(labels)
        labels = components(edges.union(more).union(found))
    release(edges, more, found)
    return labels


BLOCK_ELEMENTS = 1 << 20
BLOCK_SETS, SET_BLOCKS = 256, 16


def family_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect the components of each family: an exact join, block against block.

    members has rows (cid, comp, label), label being the family.  Blocks hold at most about
    ``BLOCK_ELEMENTS`` elements; a family of many small sets is dealt into up to
    ``SET_BLOCKS`` more, so that it keeps several tasks busy.
    """
    full = members.join(sets, "cid")
    more = F.sum(F.size("elements").cast("long")) / BLOCK_ELEMENTS + F.least(F.count("*") / BLOCK_SETS, F.lit(SET_BLOCKS))
    sizes = members.join(sets, "cid").groupBy("label").agg(more.cast("int").alias("more"))
    spread = full.join(sizes, "label").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("more") + 1).cast("int"))
    meets = spread.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("more"))))
    pairs = meets.select("label", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "cid", "comp", "elements")
    pairs = pairs.repartition("label", "i", "j")  # else a family's blocks stay where the family was counted

    def join(group: pa.Table) -> pa.Table:
        found = exact_links(group, percent)
        return pa.table({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})

    return pairs.groupBy("label", "i", "j").applyInArrow(join, "a binary, b binary")


def exact_links(group: pa.Table, percent: int) -> list[tuple[bytes, bytes]]:
    """Links between sets of different components, at most one for two components that meet.

    Sets of different blocks are joined, or those of the one block that there is.
    """
    group = group.combine_chunks()
    cids, block = group.column("cid").to_pylist(), group.column("block").to_numpy()
    across = group.column("i")[0].as_py() != group.column("j")[0].as_py()
    lists = group.column("elements").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    ends = lists.offsets.to_numpy().astype(np.int64)
    tokens = lists.values.to_numpy()[ends[0] : ends[-1]].view(np.uint64)
    ends -= ends[0]
    n, sizes = len(cids), np.diff(ends)
    owner = np.repeat(np.arange(n), sizes)
    # How many sets have each element; elements of one set only can be shared with none.
    order = np.argsort(tokens, kind="stable")
    run = np.append(True, tokens[order][1:] != tokens[order][:-1])
    number = np.cumsum(run) - 1
    often = np.bincount(number)[number]
    shared = order[often > 1]
    often, number = often[often > 1], number[often > 1]
    # A set's prefix: its size - ceil(percent% of it) + 1 rarest elements.
    budget = sizes + (-percent * sizes) // 100 + 1 - (sizes - np.bincount(owner[shared], minlength=n))
    by_set = np.lexsort([number, often, owner[shared]])
    who, number = owner[shared][by_set], number[by_set]
    first = np.searchsorted(who, np.arange(n))
    taken = np.arange(len(who)) - first[who] < budget[who]
    who, number = who[taken], number[taken]
    by_token = np.argsort(number, kind="stable")
    posting, token = who[by_token], number[by_token]
    first = np.searchsorted(who, np.arange(n + 1))
    parent = {c: c for c in group.column("comp").to_pylist()}

    def root(c: bytes) -> bytes:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    comps, out = group.column("comp").to_pylist(), []
    for x in range(n):
        mine = number[first[x] : first[x + 1]]
        if not len(mine):
            continue
        begin, end = np.searchsorted(token, mine), np.searchsorted(token, mine, side="right")
        if (end - begin).max() < 2:
            continue
        near = np.unique(np.concatenate([posting[b:e] for b, e in zip(begin, end)]))
        near = near[near < x]
        near = near[100 * np.minimum(sizes[near], sizes[x]) >= percent * np.maximum(sizes[near], sizes[x])]
        if across:
            near = near[block[near] != block[x]]
        xs = tokens[ends[x] : ends[x + 1]]
        for y in near.tolist():
            if root(comps[x]) == root(comps[y]):
                continue
            both = len(np.intersect1d(xs, tokens[ends[y] : ends[y + 1]], assume_unique=True))
            if 100 * both >= percent * (sizes[x] + sizes[y] - both):
                out.append((cids[x], cids[y]))
                parent[root(comps[x])] = root(comps[y])
    return out


def decisions(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Rows (doc_id, tkey, n_shingles, component_id, kept, stays), one for each row of docs.

    ``stays`` is true for the rows of the one document that a group keeps: its first known
    identifier, and of several texts under that the one with the smallest hash.
    """
    signed = reliable(signatures(docs, k))
    classes = signed.where(F.col("cid").isNotNull()).groupBy("cid").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.min(_place()).alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    classes = reliable(classes)
    labels = class_links(docs, classes, k, percent)
    known = classes.select("cid", "least", "copies", "rep")
    alone = F.col("copies") > 1
    if labels is None:
        named = known.where(alone).select("cid", F.col("least").alias("component"), "rep")
    else:
        joined = known.join(labels.withColumnRenamed("node", "cid"), "cid", "left")
        linked = joined.where(F.col("label").isNotNull()).select("cid", "label", "least", "rep")
        lowest = linked.groupBy("label").agg(F.min("least").alias("component"), F.min("rep").alias("rep"))
        named = linked.select("cid", "label").join(lowest, "label").select("cid", "component", "rep").union(joined.where(F.col("label").isNull() & alone).select("cid", F.col("least").alias("component"), "rep"))
    out = signed.select("doc_id", "tkey", "n_shingles", "cid").join(named.withColumn("known", F.lit(True)), "cid", "left")
    component = F.when(F.col("known"), F.col("component")).otherwise(F.col("doc_id"))
    stays = F.col("known").isNull() | (_place() == F.col("rep"))
    return out.select("doc_id", "tkey", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), stays.alias("stays"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one for each row of docs.

    component_id is the smallest doc_id among the documents that links reach.
    """
    return decisions(docs, k, percent).drop("tkey", "stays")


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs, all columns, for each group; rows without any word each stay, but for exact repeats.

    Of rows that repeat both identifier and text one stays, the first by the other columns;
    all but one of them go before anything is shuffled, however many there are.
    """
    gone = decisions(docs, k, percent).where(~F.col("stays")).select(F.coalesce("doc_id", F.lit(LEAST)).alias("gone_dk"), F.col("tkey").alias("gone_tk")).distinct()
    keyed = docs.withColumns({"_dk": F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)), "_tk": F.xxhash64(F.col("text").cast("string"))})
    left = keyed.join(gone, (F.col("_dk") == F.col("gone_dk")) & (F.col("_tk") == F.col("gone_tk")), "left_anti")
    others = [F.col(c).cast("string") for c in docs.columns if c not in ("doc_id", "text")]
    once = Window.partitionBy("_dk", "_tk").orderBy(*(others or [F.lit(0)]))
    return left.withColumn("_nth", F.row_number().over(once)).where("_nth = 1").drop("_dk", "_tk", "_nth")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4, percent=80)


OP2_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT DISTINCT r, array_to_string(w[i : i + least(4, len(w)) - 1], ' ') AS g
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 0) + 2)) AS i FROM docs WHERE len(w) > 0)
), sizes AS (SELECT r, count(*) AS n FROM grams GROUP BY r
), links AS (
  SELECT a.r AS x, b.r AS y FROM grams a JOIN grams b ON a.g = b.g AND a.r < b.r JOIN sizes s ON s.r = a.r JOIN sizes t ON t.r = b.r
  WHERE 100 * least(s.n, t.n) >= 80 * greatest(s.n, t.n)
  GROUP BY a.r, b.r, s.n, t.n HAVING 100 * count(*) >= 80 * (s.n + t.n - count(*))
), both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links
), reach AS (
  SELECT r AS x, r AS y FROM docs UNION SELECT reach.x, b.y FROM reach JOIN both_ways b ON reach.y = b.x
), component AS (SELECT reach.x AS r, min(d.doc_id) AS component_id FROM reach JOIN docs d ON d.r = reach.y GROUP BY reach.x)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id, d.doc_id IS NOT DISTINCT FROM c.component_id AS kept
FROM docs d JOIN component c ON c.r = d.r LEFT JOIN sizes s ON s.r = d.r
"""
