"""Token counts by rank-synchronous array merging.

The vocabulary is a sentencepiece BPE model.  Texts are cut into pre-tokens (a run of
spaces with what follows it up to the next space); no piece of such a vocabulary has a
space after another character, so merges never cross a cut.  The distinct pre-tokens of
a slice are one ragged array of symbols, and every round applies the lowest-rank pair of
each sequence in all sequences at once, until no pair is left.  The surviving symbols are
the tokens; a character outside the vocabulary counts once per UTF-8 byte.

Two things are done otherwise for speed, with the same counts.  A sequence of over ``LONG``
symbols (one "word" of that length) is merged one pair at a time from a heap, by the same rule.
In a run of over 160 spaces, whole periods are taken out first: merging a run of one symbol
depends only on its length, and when the model is loaded the counts of all lengths to 159
are checked to go up by one with every period (if they do not, nothing is taken out).

Defined results: null and empty texts have 0 tokens; of equal ranks the leftmost pair merges;
repeated rows are counted each; very long texts are counted whole; an empty table gives an
empty result; columns other than the identifier and the text are not read, whatever their
names.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Shared, filled, map_slices, raw

NONE = np.iinfo(np.int32).max
SPACE = "▁"
#: Sequences longer than this are merged one by one from a heap: same rule, cost n log n.
LONG = 8192
#: Bytes of text counted at a time: the more, the more often a pre-token repeats.
PART_BYTES = 4 << 20


class Merges:
    """The merge table of a sentencepiece BPE model as flat arrays."""

    def __init__(self, pieces: list[str], scores: list[float]) -> None:
        by_score = {s: r for r, s in enumerate(sorted(set(scores), reverse=True))}
        rank = np.array([by_score[s] for s in scores], np.int32)
        ids = {p: i for i, p in enumerate(pieces)}
        self.size = len(pieces) + 1
        chars = [(ord(p), i) for p, i in ids.items() if len(p) == 1]
        self.points = np.array([c for c, _ in chars], np.int64)
        self.symbols = np.array([i for _, i in chars], np.int32)
        keys, into = [], []
        often = np.bincount(rank, minlength=len(by_score))
        #: A rank is safe if merging it cannot open a better or equal pair: then all its places merge at once.
        self.safe = often == 1
        for piece, i in ids.items():
            for cut in range(1, len(piece)):
                left, right = ids.get(piece[:cut]), ids.get(piece[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.size + right)
                    into.append(i)
                    for part in (left, right):
                        if rank[part] >= rank[i]:
                            self.safe[rank[part]] = False
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.array(keys, np.int64)[order]
        self.into = np.array(into, np.int32)[order]
        self.rank = rank[self.into]
        self._ready()
        spaced = "".join(" " * k + "\n" for k in range(1, 160))
        counts = self.count_points(np.frombuffer(spaced.encode("utf-32-le"), np.uint32), np.cumsum([0, *range(2, 161)]))
        #: Length of a space run after which the count only goes up by one; 0 if there is none.
        self.period = next((p for p in range(16, 65) if (counts[48 + p :] == counts[48 : len(counts) - p] + 1).all()), 0)

    def _ready(self) -> None:
        self.char = np.full(0x110000, self.size - 1, np.int32)
        self.char[self.points] = self.symbols
        if len(self.keys) and self.char[ord(SPACE)] != self.size - 1:
            self.char[0x20] = self.char[ord(SPACE)]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "char"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._ready()

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        return np.where(found, self.rank[at], NONE).astype(np.int32), np.where(found, self.into[at], -1).astype(np.int32)

    def count_points(self, points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each sequence of code points."""
        n = len(offsets) - 1
        lengths = np.diff(offsets)
        sym = self.char[points]
        seq = np.repeat(np.arange(n), lengths)
        p = points.astype(np.int64)
        over = np.where(sym == self.size - 1, (p > 0x7F).astype(np.int64) + (p > 0x7FF) + (p > 0xFFFF), 0)
        out = np.bincount(seq, weights=over, minlength=n).astype(np.int64)
        long = lengths > LONG
        if long.any():
            for i in np.flatnonzero(long):
                out[i] += self._count_long(sym[offsets[i] : offsets[i + 1]])
            keep = ~long[seq]
            sym, seq = sym[keep], seq[keep]
        if not len(sym):
            return out
        rank = np.full(len(sym), NONE, np.int32)
        into = np.full(len(sym), -1, np.int32)
        rank[:-1], into[:-1] = self.pair(sym[:-1], sym[1:])
        rank[:-1][seq[:-1] != seq[1:]] = NONE
        while len(sym):
            starts = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            sizes = np.diff(np.append(starts, len(sym)))
            best = np.minimum.reduceat(rank, starts)
            ended = best == NONE
            if ended.any():
                out[seq[starts[ended]]] += sizes[ended]
                keep = np.repeat(~ended, sizes)
                sym, seq, rank, into = sym[keep], seq[keep], rank[keep], into[keep]
                starts, sizes, best = None, sizes[~ended], best[~ended]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(best, sizes))
            first = np.append(True, seq[at[1:]] != seq[at[:-1]])
            fresh = first | np.append(True, np.diff(at) != 1)
            place = np.arange(len(at))
            since = place - np.maximum.accumulate(np.where(fresh, place, 0))
            at = at[first | (self.safe[rank[at]] & (since % 2 == 0))]
            sym[at] = into[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, seq, rank, into = sym[keep], seq[keep], rank[keep], into[keep]
            now = at - np.arange(len(at))
            near = np.union1d(now, now[now > 0] - 1)
            inner = near[near < len(sym) - 1]
            rank[near], into[near] = NONE, -1
            inner = inner[seq[inner] == seq[inner + 1]]
            rank[inner], into[inner] = self.pair(sym[inner], sym[inner + 1])
        return out

    def _count_long(self, sym: np.ndarray) -> int:
        """The same merges for one outsized sequence: lowest rank first, then leftmost."""
        n = len(sym)
        rank, into = self.pair(sym[:-1], sym[1:])
        table: dict[tuple[int, int], tuple[int, int]] = {}
        symbols, after, before = sym.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(int(r), i, symbols[i], symbols[i + 1], int(t)) for i, (r, t) in enumerate(zip(rank, into)) if r != NONE]
        heapq.heapify(heap)
        left = n

        def look(a: int, b: int) -> tuple[int, int]:
            if (a, b) not in table:
                r, t = self.pair(np.array([a]), np.array([b]))
                table[a, b] = int(r[0]), int(t[0])
            return table[a, b]

        while heap:
            _, i, a, b, t = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = t, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            left -= 1
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n:
                    r, into_ = look(symbols[x], symbols[y])
                    if r != NONE:
                        heapq.heappush(heap, (r, x, symbols[x], symbols[y], into_))
        return left

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text."""
        n = len(texts)
        lead = pc.binary_join_element_wise(pa.scalar(" "), pc.replace_substring(texts, SPACE, " "), "")
        data, offsets = raw(lead)
        space = data == 0x20
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        cut[offsets[:-1]] = True
        begins = np.flatnonzero(cut)
        tokens = pa.Array.from_buffers(
            pa.binary(), len(begins), [None, pa.py_buffer(np.append(begins, len(data)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]
        )
        coded = tokens.dictionary_encode()
        words, more = coded.dictionary.cast(pa.binary()), 0
        if self.period:
            words, more = self._without_long_runs(words)
        blob, ends = raw(words.cast(pa.string()))
        points = np.frombuffer(blob.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        starts = np.append(0, np.cumsum((blob & 0xC0) != 0x80))
        counts = self.count_points(points, starts[ends]) + more
        sums = np.append(0, np.cumsum(counts[coded.indices.to_numpy()]))
        bounds = np.searchsorted(begins, offsets)
        out = sums[bounds[1:]] - sums[bounds[:-1]]
        out[pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)] = 0
        return out

    def _without_long_runs(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Take whole periods out of very long runs of spaces; they add one token each."""
        blob, ends = raw(words.cast(pa.string()))
        more = np.zeros(len(words), np.int64)
        wide = np.flatnonzero(np.diff(ends) > 160)
        if not len(wide):
            return words, more
        values = words.to_pylist()
        for i in wide:
            w = values[i]
            run = len(w) - len(w.lstrip(b" "))
            if run > 160:
                more[i] = (run - 100) // self.period
                values[i] = w[more[i] * self.period :]
        return pa.array(values, pa.binary()), more


def load_merges(path: str) -> Merges:
    """Read a sentencepiece BPE model; only models without text normalisation are taken."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    probe = "A  éﬁ Ａ\n b "
    if sp.normalize(probe) != SPACE + probe.replace(" ", SPACE):
        raise ValueError(f"{path}: the model normalises texts, which this counter does not")
    ids = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    pieces = [sp.id_to_piece(i) for i in ids]
    if any(SPACE in p.lstrip(SPACE) for p in pieces):
        raise ValueError(f"{path}: a piece has a space after another character")
    return Merges(pieces, [sp.get_score(i) for i in ids])


def count_tokens(spark: SparkSession, docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_bytes, n_tokens), one for each row of docs.

    The merge table has the size of the vocabulary, a fixed bound, so it is broadcast.
    """
    shared = Shared(spark, load_merges(path))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = filled(part.column("text"))
        sizes = pc.binary_length(texts).cast(pa.int64())
        return pa.RecordBatch.from_arrays([part.column("doc_id"), sizes, pa.array(shared.value.count(texts))], ["doc_id", "n_bytes", "n_tokens"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_slices(narrow, run, "doc_id long, n_bytes long, n_tokens long", limit=PART_BYTES)


def op5_token_counts(spark: SparkSession, sf_dir: str, limit: int = 4096) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = count_tokens(spark, docs, public_tokenizers.path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
