"""Language identification by a linear-chain conditional random field over words.

A word's features are its prefixes and suffixes (one to three characters), its trigrams,
and itself where the training lexicon holds it.  Transitions between the languages of
neighbouring words are learned too, from runs of words of one document and from runs
that switch from one document's language to another's.  Forward-backward gives each
word's language marginals; a document's language is the one with the largest sum, and
its score is that language's share.  ``word_languages`` returns the words' own labels,
for code-switched text.

Whole texts are labelled, each as one chain however long.  Forward-backward works on blocks
of ``BLOCK`` words: the product of a block's moves is a small matrix, blocks pass their messages
on as a chain of their own, and then all words of all blocks are finished together, so the
marginals are those of the undivided chain.

Training uses a bounded sample of labelled runs: every document's whole text is cut into runs
of ``RUN`` words, and of each language's runs the ``RUNS_PER_LANGUAGE`` with the smallest hashes are
taken, wherever in a text they stand.

Defined results: ``und`` with score 0 for a null text, one without a letter, or where
nothing could be learned; a text whose letters make no word of the field (none in any
alphabet it saw) still gets the likeliest language; of equal sums the language that comes
first by name; repeated rows are labelled each; very long texts are labelled whole; an empty
table gives an empty result; columns to pass on may have any name but doc_id, lang_pred and
score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import ALPHA, GOLDEN, Shared, bounded_batches, filled, hash_words, kept_schema, map_slices, mixed, sliced, split_words, word_array

RUN = 64
BLOCK = 64
BITS = 16
RUNS_PER_LANGUAGE = 900
DEALT = 16
#: Runs that go through forward-backward at a time in training, so its memory does not grow with the sample.
BATCH = 1024
#: Bytes of text labelled at a time: marginals take about 30 times as much memory.
PART_BYTES = 1 << 20


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the identifier as text, modulo folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def word_features(letters: np.ndarray, offsets: np.ndarray, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each word, and the word that each belongs to."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    # Words with a mark at either end: two more places each.
    at = offsets[:-1] + 2 * np.arange(n)
    owner = np.repeat(np.arange(n), sizes + 2)
    marked = np.full(len(letters) + 2 * n, 1, np.uint64)
    inner = np.arange(len(letters)) + 2 * np.repeat(np.arange(n), sizes) + 1
    marked[inner] = letters
    features, owners = [], []

    def add(tag: int, h: np.ndarray, who: np.ndarray) -> None:
        features.append((mixed(h * GOLDEN + np.uint64(tag)) >> np.uint64(64 - BITS)).astype(np.int64))
        owners.append(who)

    span = marked[:-2] | marked[1:-1] << np.uint64(8) | marked[2:] << np.uint64(16)
    same = np.flatnonzero(owner[:-2] == owner[2:])
    add(1, span[same], owner[same])
    for k in (1, 2, 3):
        who = np.flatnonzero(sizes >= k)
        first = last = np.zeros(len(who), np.uint64)
        for j in range(k):
            first = first << np.uint64(8) | marked[at[who] + 1 + j]
            last = last << np.uint64(8) | marked[at[who] + sizes[who] - j]
        add(10 + k, first, who)
        add(20 + k, last, who)
    whole = hash_words(letters, offsets)
    if len(lexicon):
        place = np.minimum(np.searchsorted(lexicon, whole), len(lexicon) - 1)
        who = np.flatnonzero(lexicon[place] == whole)
        add(30, whole[who], who)
    return np.concatenate(features), np.concatenate(owners)


def _scaled(x: np.ndarray, axes: tuple[int, ...]) -> np.ndarray:
    return x / x.sum(axis=axes, keepdims=True)


def forward_backward(emit: np.ndarray, counts: np.ndarray, move: np.ndarray, begin: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Word marginals (words, languages) and expected moves summed over all chains.

    ``emit`` has the log scores of all chains' words, one after the other; ``counts`` their lengths.
    """
    n, k = emit.shape
    if not n:
        return np.zeros((0, k)), np.zeros((k, k))
    step, first_word = np.exp(move), np.exp(begin)
    local = np.exp(emit - emit.max(axis=1, keepdims=True))
    counts = counts[counts > 0]
    heads = np.append(0, np.cumsum(counts))[:-1]
    # Blocks in order of their length, so that those that reach a place come first.
    many = -(-counts // block)
    of = np.repeat(np.arange(len(counts)), many)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    start = heads[of] + nth * block
    size = np.minimum(block, counts[of] - nth * block)
    order = np.argsort(-size, kind="stable")
    start, size, opens = start[order], size[order], nth[order] == 0
    reach = np.searchsorted(-size, -np.arange(1, block + 1), side="right")

    def moved(x: np.ndarray, i: int, m: int) -> np.ndarray:
        """Messages after the move to place i; the first word of a chain is entered from its beginning."""
        out = x @ step
        return np.where(opens[:m].reshape(-1, *[1] * (x.ndim - 1)), x * first_word, out) if i == 0 else out

    whole = np.broadcast_to(np.eye(k), (len(start), k, k)).copy()
    for i in range(block):
        if m := reach[i]:
            whole[:m] = _scaled(moved(whole[:m], i, m) * local[start[:m] + i][:, None, :], (1, 2))
    # Messages between blocks: chains with many blocks go on longest.
    place = np.empty(len(of), np.int64)
    place[order] = np.arange(len(of))  # where a chain's blocks are, in chain order
    at = np.append(0, np.cumsum(many))[:-1]
    longest = np.argsort(-many, kind="stable")
    left = np.ones((len(of), k))
    right = np.ones((len(of), k))
    for j in range(1, int(many.max())):
        some = longest[: np.searchsorted(-many[longest], -j, side="left")]
        before, here = place[at[some] + j - 1], place[at[some] + j]
        left[here] = _scaled(np.einsum("nk,nkl->nl", left[before], whole[before]), (1,))
        last, here = place[at[some] + many[some] - j], place[at[some] + many[some] - j - 1]
        right[here] = _scaled(np.einsum("nkl,nl->nk", whole[last], right[last]), (1,))
    ahead = np.zeros((len(start), block, k))
    a = left
    for i in range(block):
        if m := reach[i]:
            a = _scaled(moved(a[:m], i, m) * local[start[:m] + i], (1,))
            ahead[:m, i] = a
    out, moves, back = np.empty((n, k)), np.zeros((k, k)), right.copy()
    for i in range(block - 1, -1, -1):
        if not (m := reach[i]):
            continue
        out[start[:m] + i] = _scaled(ahead[:m, i] * back[:m], (1,))
        after = local[start[:m] + i] * back[:m]
        prior = left[:m] if i == 0 else ahead[:m, i - 1]
        enters = ~opens[:m] if i == 0 else np.ones(m, bool)  # the first word of a chain is no move
        if enters.any():
            p, q = prior[enters], after[enters]
            moves += step * (p.T @ (q / ((p @ step) * q).sum(axis=1, keepdims=True)))
        back[:m] = _scaled(after @ step.T, (1,))
    return out, moves


@dataclass
class Field:
    """A trained field."""

    languages: list[str]
    weights: np.ndarray
    move: np.ndarray
    begin: np.ndarray
    lexicon: np.ndarray

    def marginals(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Language marginals of all words in order, and the number of words of each text."""
        letters, offsets, counts = split_words(pc.utf8_lower(texts), ALPHA)
        k = len(self.languages)
        if not counts.sum():
            return np.zeros((0, k)), counts
        coded = word_array(letters, offsets).dictionary_encode()
        words = coded.dictionary
        ends = np.frombuffer(words.buffers()[1], np.int32)[: len(words) + 1].astype(np.int64)
        blob = np.frombuffer(words.buffers()[2], np.uint8)[: ends[-1]]
        features, owners = word_features(blob, ends, self.lexicon)
        scores = np.stack([np.bincount(owners, weights=self.weights[features, j], minlength=len(words)) for j in range(k)], axis=1)
        return forward_backward(scores[coded.indices.to_numpy()], counts, self.move, self.begin)[0], counts


def fit(runs: list[list[bytes]], labels: list[int], languages: list[str], steps: int = 50, penalty: float = 0.5, rate: float = 0.1) -> Field:
    """Train on runs of words, each of one language, and on as many runs that switch."""
    k = len(languages)
    rng = np.random.default_rng(7)
    by_language = {j: [r for r, y in zip(runs, labels) if y == j] for j in set(labels)}
    chained, tagged = [r[:RUN] for r in runs], [[y] * len(r[:RUN]) for r, y in zip(runs, labels)]
    for r, y in zip(runs, labels):
        others = [j for j in by_language if j != y]
        if not others or len(r) < 2:
            continue
        z = others[rng.integers(len(others))]
        other = by_language[z][rng.integers(len(by_language[z]))]
        cut = int(rng.integers(1, min(len(r), RUN)))
        joined = r[:cut] + other[: RUN - cut]
        chained.append(joined)
        tagged.append([y] * cut + [z] * (len(joined) - cut))
    lengths = np.array([len(r) for r in chained])
    coded = pa.array([w for r in chained for w in r], pa.binary()).dictionary_encode()
    words = coded.dictionary
    ends = np.frombuffer(words.buffers()[1], np.int32)[: len(words) + 1].astype(np.int64)
    blob = np.frombuffer(words.buffers()[2], np.uint8)[: ends[-1]]
    ids = coded.indices.to_numpy()
    often = np.bincount(ids, minlength=len(words)) >= 3
    lexicon = np.unique(hash_words(blob, ends)[often])
    features, owners = word_features(blob, ends, lexicon)
    size = 1 << BITS
    params = [np.zeros((size, k)), np.zeros((k, k)), np.zeros(k)]
    squares = [np.full_like(p, 1e-8) for p in params]
    tags, ends_of = np.concatenate([np.array(t) for t in tagged]), np.append(0, np.cumsum(lengths))
    within = np.ones(len(tags) - 1, bool)
    within[ends_of[1:-1] - 1] = False
    gold_moves = np.bincount(tags[:-1][within] * k + tags[1:][within], minlength=k * k).reshape(k, k)
    gold_begin = np.bincount(tags[ends_of[:-1]], minlength=k)
    gold_words = np.bincount(ids.astype(np.int64) * k + tags, minlength=len(words) * k).reshape(-1, k)
    for _ in range(steps):
        scores = np.stack([np.bincount(owners, weights=params[0][features, j], minlength=len(words)) for j in range(k)], axis=1)
        by_word, moves, begin = -gold_words.astype(float), -gold_moves.astype(float), -gold_begin.astype(float)
        for a in range(0, len(chained), BATCH):
            n = lengths[a : a + BATCH]
            of = ids[ends_of[a] : ends_of[a + len(n)]]
            flat, moved = forward_backward(scores[of], n, params[1], params[2], RUN)
            moves += moved
            begin += flat[np.cumsum(n) - n].sum(axis=0)
            by_word += np.stack([np.bincount(of, weights=flat[:, j], minlength=len(words)) for j in range(k)], axis=1)
        by_feature = np.stack([np.bincount(features, weights=by_word[owners, j], minlength=size) for j in range(k)], axis=1)
        for p, s, g in zip(params, squares, (by_feature, moves, begin)):
            g = g + penalty * p
            s += g * g
            p -= rate * g / np.sqrt(s) * 2
    return Field(languages, params[0].astype(np.float32), params[1], params[2], lexicon)


def training_runs(docs: DataFrame, per_language: int = RUNS_PER_LANGUAGE) -> tuple[list[list[bytes]], list[int], list[str]]:
    """Runs of words, a bounded sample by hash from all runs of all documents (doc_id, text, lang)."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    spot = F.xxhash64(F.lit(10), F.col("doc_id"), F.col("text"))
    rows = known.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), spot.alias("spot"))
    bounded_batches(docs.sparkSession)

    def run(batches):
        """The smallest hashes of each language in a task: no more than it may have in all."""
        best: dict[str, list[tuple[int, bytes]]] = {}
        for part in sliced(batches, "text"):
            letters, offsets, counts = split_words(pc.utf8_lower(filled(part.column("text"))), ALPHA)
            many = -(-counts // RUN)
            row = np.repeat(np.arange(len(counts)), many)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            begins = np.append(0, np.cumsum(counts))
            hashes = mixed(part.column("spot").to_numpy().view(np.uint64)[row] + nth.astype(np.uint64) * GOLDEN).view(np.int64)
            blob, langs = letters.tobytes(), np.array(part.column("lang").to_pylist(), object)
            for lang in sorted(set(langs[row])):
                held = best.setdefault(lang, [])
                mine = np.flatnonzero(langs[row] == lang)
                mine = mine[np.argsort(hashes[mine], kind="stable")[:per_language]]
                most = held[-1][0] if len(held) == per_language else None
                for i in mine[hashes[mine] < most] if most is not None else mine:
                    a = begins[row[i]] + nth[i] * RUN
                    z = min(a + RUN, begins[row[i] + 1])
                    held.append((int(hashes[i]), b" ".join(blob[offsets[j] : offsets[j + 1]] for j in range(a, z))))
                best[lang] = sorted(held)[:per_language]
        rows = [(lang, h, w) for lang, held in best.items() for h, w in held]
        kinds = (pa.string(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["lang", "spot", "words"])

    # What the tasks hold meets in parts first, so that no task gets more than DEALT times what a language may have.
    taken = rows.mapInArrow(run, "lang string, spot long, words binary").withColumn("part", F.pmod("spot", F.lit(DEALT)))
    for by in (["lang", "part"], ["lang"]):
        taken = taken.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("spot", "words"))).where(F.col("n") <= per_language)
    got = sorted((r.lang, r.spot, bytes(r.words)) for r in taken.collect())  # at most per_language runs a language
    languages = sorted({lang for lang, _, _ in got})
    return [w.split(b" ") for _, _, w in got], [languages.index(lang) for lang, _, _ in got], languages


def train(docs: DataFrame, per_language: int = RUNS_PER_LANGUAGE) -> Field | None:
    runs, labels, languages = training_runs(docs, per_language)
    return fit(runs, labels, languages) if runs else None


def _has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def identify(docs: DataFrame, field: Field | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, lang_pred, score, *keep), one for each row of docs; keep names columns of docs."""
    passed = tuple(f"keep_{i}" for i in range(len(keep)))
    shared = Shared(docs.sparkSession, field)  # a fixed number of weights a language

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        n = part.num_rows
        names, scores = np.full(n, "und", object), np.zeros(n)
        f = shared.value
        if f is not None:
            marginal, counts = f.marginals(filled(part.column("text")))
            row = np.repeat(np.arange(n), counts)
            sums = np.stack([np.bincount(row, weights=marginal[:, j], minlength=n) for j in range(len(f.languages))], axis=1)
            good = np.array([_has_letter(t) for t in part.column("text").to_pylist()], bool) & (counts > 0)
            best = sums.argmax(axis=1)
            names[good] = np.array(f.languages, object)[best[good]]
            scores[good] = np.clip(sums.max(axis=1)[good] / sums.sum(axis=1)[good], 0, 1)
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(scores), *map(part.column, passed)], ["doc_id", "lang_pred", "score", *passed])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c).alias(p) for c, p in zip(keep, passed)])
    out = map_slices(narrow, run, "doc_id long, lang_pred string, score double" + kept_schema(narrow, passed), limit=PART_BYTES)
    return out.withColumnsRenamed(dict(zip(passed, keep)))


def word_languages(docs: DataFrame, field: Field) -> DataFrame:
    """Rows (doc_id, words): the language of each word, in order."""
    shared = Shared(docs.sparkSession, field)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        marginal, counts = shared.value.marginals(filled(part.column("text")))
        best = np.array(shared.value.languages, object)[marginal.argmax(axis=1)] if len(marginal) else np.zeros(0, object)
        cuts = np.append(0, np.cumsum(counts))
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([best[a:b] for a, b in zip(cuts[:-1], cuts[1:])], pa.list_(pa.string()))], ["doc_id", "words"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_slices(narrow, run, "doc_id long, words array<string>", limit=PART_BYTES)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(fold_of(F.col("doc_id"), 3) == 1, F.lit(False))
    field = train(docs.where(~held_out))
    return identify(docs, field).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
