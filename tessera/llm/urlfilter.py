"""URL filter: a bit-parallel wildcard automaton over canonical URLs.

All glob rules (``*`` any run, ``?`` one character) are packed into one multiword
Shift-And machine: a bit per pattern position, a mask per character, and a second mask
of the positions that a star lets stay.  Every URL steps through all rules at once, and
all URLs of a batch step together.

A host/path rule such as ``example.net/en/`` is two globs (the host itself and its
subdomains).  Where several host/path rules fit, the longest rule decides; where none
fits, a block glob decides; else the URL is allowed.

Defined results: a null URL, or one without ``://``, has an empty host and path, no rule
and verdict ``allow``; of rules that fit the longest decides, and no two of a length fit one
URL; repeated rows are judged each; very long URLs are stepped through whole; an empty table
gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import filled, map_slices, raw

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Host/path rules of the query.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
#: Globs over the canonical URL (host and path) that block where no host/path rule fits.
BLOCK_GLOBS = ("*cheap-pills*", "*spam-farm*", "*casino*/*", "*.exe", "*/wp-login.php*")
OTHER = 128


class ShiftAnd:
    """Glob patterns as one bit-parallel automaton."""

    def __init__(self, patterns: list[str]) -> None:
        bits: list[str] = []
        starts, accepts, stays = [], [], []
        for p in patterns:
            # A pattern is its literal positions; a star before one lets the state before it stay.
            bits.append("")  # the state before the first position
            starts.append(len(bits) - 1)
            for c in p:
                if c == "*":
                    stays.append(len(bits) - 1)
                else:
                    bits.append(c)
            accepts.append(len(bits) - 1)
        self.words = -(-len(bits) // 64)
        self.accepts = np.array(accepts)

        def mask(places: list[int]) -> np.ndarray:
            out = np.zeros(self.words, np.uint64)
            for i in places:
                out[i // 64] |= np.uint64(1 << i % 64)
            return out

        self.start, self.stay = mask(starts), mask(stays)
        self.moves = np.stack([mask([i for i, c in enumerate(bits) if c == "?" or (k < OTHER and c == chr(k))]) for k in range(OTHER + 1)])

    def match(self, texts: pa.Array) -> np.ndarray:
        """A boolean matrix: texts by patterns."""
        data, offsets = raw(texts)
        # One step is a code point: continuation bytes are taken out, what is beyond ASCII is one class.
        lead = (data & 0xC0) != 0x80
        codes = np.minimum(data[lead], OTHER)
        offsets = np.append(0, np.cumsum(lead))[offsets]
        n = len(offsets) - 1
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        at, sizes = offsets[:-1][order], lengths[order]
        state = np.tile(self.start, (n, 1))
        live = n
        for step in range(int(sizes[0]) if n else 0):
            while live and sizes[live - 1] <= step:
                live -= 1
            old = state[:live]
            new = old << np.uint64(1)
            new[:, 1:] |= old[:, :-1] >> np.uint64(63)
            new &= self.moves[codes[at[:live] + step]]
            new |= old & self.stay
            state[:live] = new
        out = np.empty((n, len(self.accepts)), bool)
        out[order] = (state[:, self.accepts // 64] >> (self.accepts % 64).astype(np.uint64)) & np.uint64(1) != 0
        return out


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judge_urls(df: DataFrame, id_col: str, url_col: str, rules: dict[str, str], block_globs: tuple[str, ...]) -> DataFrame:
    """Rows (id, host, path, rule, verdict)."""
    ordered = sorted(rules, key=lambda r: (-len(r), r))
    # Hosts and paths hold no "#", so with one between them a rule's host cannot match in a path.
    marked = [r.replace("/", "#/", 1) for r in ordered]
    ruled, spammed = ShiftAnd([f"{r}*" for r in marked] + [f"*.{r}*" for r in marked]), ShiftAnd(list(block_globs))
    k = len(ordered)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        hit = ruled.match(filled(part.column("marked")))
        fits = hit[:, :k] | hit[:, k:]
        some = fits.any(axis=1)
        rule = np.where(some, fits.argmax(axis=1), k)
        spam = spammed.match(filled(part.column("url"))).any(axis=1)
        names = pa.array([*ordered, None], pa.string()).take(pa.array(rule))
        verdicts = np.array([rules[r] for r in ordered] + ["allow"], object)[rule]
        verdicts[~some & spam] = "block"
        return pa.RecordBatch.from_arrays([part.column("id"), part.column("host"), part.column("path"), names, pa.array(verdicts, pa.string())], ["id", "host", "path", "rule", "verdict"])

    url = F.col(url_col).cast("string")
    narrow = df.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    narrow = narrow.withColumns({"url": F.concat("host", "path"), "marked": F.concat("host", F.lit("#"), "path")})
    kind = narrow.schema["id"].dataType.simpleString()
    return map_slices(narrow, run, f"id {kind}, host string, path string, rule string, verdict string", "url").withColumnRenamed("id", id_col)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge_urls(pages, "page_id", "url", RULES, BLOCK_GLOBS)


def _like(glob: str) -> str:
    return "canonical LIKE '" + glob.replace("_", r"\_").replace("%", r"\%").replace("*", "%").replace("?", "_") + "' ESCAPE '\\'"


OP3_SQL = f"""
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), judged AS (
  SELECT *, host || path AS canonical,
         CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
              WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
              WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
              WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts
)
SELECT page_id, host, path, rule,
       CASE rule WHEN 'net/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'example.com/de/' THEN 'block' WHEN 'org/fr/' THEN 'allow'
            ELSE CASE WHEN {" OR ".join(map(_like, BLOCK_GLOBS))} THEN 'block' ELSE 'allow' END END AS verdict
FROM judged
"""
