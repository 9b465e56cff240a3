"""Benchmark decontamination: one Aho-Corasick automaton over windows of benchmark words.

Texts are lower-cased (A-Z only); words are runs of ASCII letters and digits and of any
non-ASCII characters.  NULL and empty texts have no words; an item without words or with a NULL
item_id has no windows.  Items that share an id are one item; windows that several items share
name all of them.  Documents are handled row by row, so repeated rows repeat in the result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import kept_in_worker, own_name, slices
from codequarry.session import materialize

WINDOW = 10
#: Characters of windows in one automaton; more benchmark text takes further scans.
AUTOMATON_CHARS = 2 << 20

_KEEP = bytes(
    b if b >= 0x80 or chr(b).isdigit() or "a" <= chr(b) <= "z" else ord(chr(b).lower()) if "A" <= chr(b) <= "Z" else 0x20
    for b in range(256)
)


def word_spans(raw: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The folded bytes, of the same length, and where each word starts and ends in them."""
    folded = raw.translate(_KEEP)
    inside = np.frombuffer(folded, np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    return folded, edges[::2], edges[1::2]


def windows(benchmark: DataFrame, length: int = WINDOW) -> DataFrame:
    """(item_id, window): every run of ``length`` words of an item, or all its words if fewer."""
    folded = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(folded, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    items = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), words.alias("words"))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - length + 1))
    each = items.where(F.size("words") > 0).select("item_id", "words", F.explode(starts).alias("start"))
    return each.select("item_id", F.array_join(F.slice("words", F.col("start"), F.lit(length)), " ").alias("window")).distinct()


class Matcher:
    """The automaton of a set of windows."""

    def __init__(self, found: dict[str, tuple[str, ...]]):
        self.automaton = ahocorasick.Automaton()
        for window, items in found.items():
            self.automaton.add_word(f" {window} ", (window.count(" ") + 1, items))
        if found:
            self.automaton.make_automaton()

    def scan(self, words: list[str]) -> list[tuple[int, int, tuple[str, ...]]]:
        """(first word, word after the last, items) of every occurrence in a text's words."""
        if not len(self.automaton) or not words:
            return []
        hits = list(self.automaton.iter(f" {' '.join(words)} "))
        if not hits:
            return []
        # an occurrence ends on the space after its last word; these are the places of those spaces
        spaces = np.cumsum([len(w) + 1 for w in words])
        after = np.searchsorted(spaces, [end for end, _ in hits]) + 1
        return [(k - n, k, items) for k, (_, (n, items)) in zip(after.tolist(), hits, strict=True)]


def _portions(found: DataFrame, most: int) -> list:
    """Broadcasts of windows with their items, each of about ``most`` characters.

    However large the benchmark is, what is sent at a time is bounded: every portion is an
    automaton of its own and takes a scan of its own.
    """
    grouped = found.groupBy("window").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    sized = materialize(grouped, "windows")
    total = sized.agg(F.sum(F.length("window") + 16 * (F.size("items") + 1))).first()[0] or 0
    parts = -(-total // most) or 1
    out = []
    for part in range(parts):
        chosen = sized.where(F.pmod(F.xxhash64("window"), F.lit(parts)) == part)
        out.append(sized.sparkSession.sparkContext.broadcast({w: tuple(i) for w, i in chosen.toLocalIterator()}))
    return out


def _runs(raw: bytes, starts: np.ndarray, ends: np.ndarray, hit: np.ndarray) -> list[tuple[int, int]]:
    """Runs of hit words as (start, end) in characters of the text whose bytes are given."""
    edges = np.flatnonzero(np.diff(hit, prepend=False, append=False))
    if not len(edges):
        return []
    chars = np.r_[0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)]  # characters before each byte
    return list(zip(chars[starts[edges[::2]]].tolist(), chars[ends[edges[1::2] - 1]].tolist(), strict=True))


_HITS = "array<struct<first:bigint,after:bigint,items:array<string>>>"
_FOUND = "struct<n_words:bigint,n_hit:bigint,items:array<string>,spans:array<struct<start:bigint,end:bigint>>>"
_HITS_TYPE = pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64()), ("items", pa.list_(pa.string()))]))
_FOUND_TYPE = pa.struct([
    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
])


def _scanned(docs: DataFrame, carried: list[str], shared, last: bool, hits_name: str, found_name: str) -> DataFrame:
    """``carried`` columns with the hits so far or, after the last portion, with what was found."""
    key = uuid.uuid4().hex
    name, kind, arrow = (found_name, _FOUND, _FOUND_TYPE) if last else (hits_name, _HITS, _HITS_TYPE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = kept_in_worker("benchmark", key, lambda: Matcher(shared.value))
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for text, before in zip(part.column("text").to_pylist(), part.column(hits_name).to_pylist(), strict=True):
                    raw = (text or "").encode()
                    folded, starts, ends = word_spans(raw)
                    words = [w for w in folded.decode().split(" ") if w]
                    hits = [(h["first"], h["after"], h["items"]) for h in before] + matcher.scan(words)
                    if not last:
                        out.append([dict(zip(("first", "after", "items"), h, strict=True)) for h in hits])
                        continue
                    cover = np.zeros(len(words) + 1, np.int64)
                    for first, after, _ in hits:
                        cover[first] += 1
                        cover[after] -= 1
                    hit = np.cumsum(cover[:-1]) > 0
                    spans = [{"start": a, "end": b} for a, b in _runs(raw, starts, ends, hit)]
                    items = sorted({i for h in hits for i in h[2]})
                    out.append({"n_words": len(words), "n_hit": int(hit.sum()), "items": items, "spans": spans})
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), pa.array(out, arrow)], [*carried, name])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried), f"{name} {kind}"])
    return docs.mapInArrow(run, schema)


def _found(docs: DataFrame, benchmark: DataFrame, carried: list[str], length: int, most: int, name: str) -> DataFrame:
    portions = _portions(windows(benchmark, length), most)
    hits = own_name()
    state = docs.select(*dict.fromkeys([*carried, "text"]), F.array().cast(_HITS).alias(hits))
    for n, shared in enumerate(portions):
        last = n + 1 == len(portions)
        state = _scanned(state, carried if last else list(dict.fromkeys([*carried, "text"])), shared, last, hits, name)
        state = state if last else materialize(state, "hits")
    return state


def spans(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW, most: int = AUTOMATON_CHARS) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans) of every row.

    ``spans`` are (start, end) in characters of the original text, ends exclusive, of the runs of
    hit words; ``items`` the sorted ids of the items of which a window occurs.
    """
    found = own_name()
    return _found(docs, benchmark, ["doc_id"], length, most, found).select("doc_id", f"{found}.*")


def clean(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW, most: int = AUTOMATON_CHARS) -> DataFrame:
    """The rows in which no window of the benchmark occurs, with all their columns."""
    found = own_name()
    return _found(docs, benchmark, docs.columns, length, most, found).where(F.col(found)["n_hit"] == 0).drop(found)
