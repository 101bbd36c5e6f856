"""Benchmark decontamination by winnowing.

Of every ``window - gram + 1`` neighbouring word k-grams the one with the least
hash (the rightmost of equals) is kept as a fingerprint.  A document and an item
that share ``window`` words in a row share all hashes of one such stretch, hence
a fingerprint: no shared span of that length is missed.  Documents are joined with
items by fingerprint; a hit is extended word by word to its full shared span, and
spans of at least ``window`` words count.

A benchmark of at most ``MOST_SENT`` bytes is broadcast, and the join is a look-up
in the tasks that read the documents.  A larger one is joined by shuffle: the
fingerprints of both sides meet, each pair of a document and an item once, and
a document is then extended against its own items, ``PART`` at a time.

Defined results: null or wordless texts have no words, no spans, no items.  An
item of fewer than ``window`` words but not none is one window, found by its own
hash.  Repeated items count once by id; an item whose id is null marks words but
is not listed.  Other columns of ``docs`` are kept, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.llm.common import bounded_batches, by_value, durable, fresh, give_back, quoted, text_bytes, worker_cache

by_value(__name__)

#: Bytes of item text that are broadcast at most, and items that one row carries to its document beyond that, about.
MOST_SENT, PART = 16_000_000, 64
#: Word hashes kept in a worker; beyond that it starts anew. Affects time only.
CACHED_WORDS = 200_000
#: Bytes of words: 0-9, a-z, A-Z (lower-cased) and all beyond ASCII; others separate.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

HITS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def hashes_of(words: list[bytes], known: WordHashes) -> np.ndarray:
    if len(known) > CACHED_WORDS:
        known.clear()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def gram_hashes(hashes: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each run of ``gram`` words."""
    count = len(hashes) - gram + 1
    out = np.zeros(max(0, count), np.uint64)
    if count > 0:
        for k in range(gram):
            out *= np.uint64(0x9E3779B97F4A7C15)
            out += hashes[k : k + count]
            out ^= out >> np.uint64(29)
    return out


def winnow(grams: np.ndarray, width: int) -> np.ndarray:
    """Positions of the rightmost least hash of each window of ``width`` grams."""
    if not len(grams):
        return np.empty(0, np.int64)
    width = min(width, len(grams))
    windows = np.lib.stride_tricks.sliding_window_view(grams, width)
    at = np.arange(len(windows)) + (width - 1 - np.argmin(windows[:, ::-1], axis=1))
    return at[np.r_[True, at[1:] != at[:-1]]]


def prints_of(words: list[bytes], window: int, gram: int, known: WordHashes) -> tuple[int, np.ndarray]:
    """The number of words and the whole hash of a short item; 0 and the fingerprints of another."""
    hashes = hashes_of(words, known)
    if len(words) < window:
        return len(words), gram_hashes(hashes, max(1, len(words)))
    grams = gram_hashes(hashes, gram)
    return 0, np.unique(grams[winnow(grams, window - gram + 1)])


class ItemIndex:
    """Fingerprints of some items (names, text), and whole hashes of the short ones; equal texts are one item."""

    def __init__(self, items: list[tuple[list[str], bytes]], window: int, gram: int):
        self.window, self.gram, self.known = window, gram, WordHashes()
        named: dict[tuple[bytes, ...], set[str]] = {}
        for names, text in items:
            named.setdefault(tuple(words_of(text)), set()).update(names)
        self.items = list(named.items())
        self.prints: dict[int, list[tuple[int, int]]] = {}
        self.short: dict[int, dict[int, list[int]]] = {}
        for k, (words, _) in enumerate(self.items):
            hashes = hashes_of(words, self.known)
            if 0 < len(words) < window:
                self.short.setdefault(len(words), {}).setdefault(int(gram_hashes(hashes, len(words))[0]), []).append(k)
            elif words:
                grams = gram_hashes(hashes, gram)
                for at in winnow(grams, window - gram + 1).tolist():
                    self.prints.setdefault(int(grams[at]), []).append((k, at))
        self.sorted_prints = np.array(sorted(self.prints), np.uint64)
        self.sorted_short = {n: np.array(sorted(x), np.uint64) for n, x in self.short.items()}

    @staticmethod
    def _in(values: np.ndarray, among: np.ndarray) -> np.ndarray:
        if not len(among):
            return np.zeros(len(values), bool)
        return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Shared spans, and the names of the items they belong to."""
        hashes = hashes_of(words, self.known)
        spans, found, size = [], set(), len(words)
        grams = gram_hashes(hashes, self.gram)
        at = winnow(grams, self.window - self.gram + 1)
        reached: dict[tuple[int, int], int] = {}  # on an item's diagonal: where the last extension ended
        for p in at[self._in(grams[at], self.sorted_prints)].tolist():
            for k, q in self.prints[int(grams[p])]:
                if reached.get((k, p - q), -1) > p:
                    continue
                other = self.items[k][0]
                low, high, end = p, p, len(other)
                while low > 0 and low - p + q > 0 and words[low - 1] == other[low - 1 - p + q]:
                    low -= 1
                while high < size and high - p + q < end and words[high] == other[high - p + q]:
                    high += 1
                reached[k, p - q] = max(high, p + 1)
                if high - low >= self.window:
                    spans.append((low, high))
                    found |= self.items[k][1]
        for n, table in self.short.items():
            grams = gram_hashes(hashes, n)
            for p in np.flatnonzero(self._in(grams, self.sorted_short[n])).tolist():
                for k in table[int(grams[p])]:
                    if tuple(words[p : p + n]) == self.items[k][0]:
                        spans.append((p, p + n))
                        found |= self.items[k][1]
        return spans, found


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _hit(size: int, spans: list[tuple[int, int]], names: set[str]) -> tuple:
    return size, [{"start": a, "stop": b} for a, b in joined(spans)], sorted(names)


def _looked_up(docs: DataFrame, items: DataFrame, output: str, text: str, window: int, gram: int) -> DataFrame:
    """``docs`` with its hits, by a look-up in the broadcast items (i, t)."""
    every = [([] if r.i is None else [r.i], bytes(r.t)) for r in items.collect()]  # MOST_SENT bytes at most
    sent, name = docs.sparkSession.sparkContext.broadcast(every), f"winnow:{uuid.uuid4().hex}"

    @F.pandas_udf(HITS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        index = worker_cache(name, lambda: ItemIndex(sent.value, window, gram))
        for texts in batches:
            rows = []
            for text in texts:
                words = words_of(text)
                rows.append(_hit(len(words), *index.hits(words)))
            yield pd.DataFrame(rows, columns=["n_words", "spans", "items"])
        index.known.clear()  # the index itself serves the worker's next task
        give_back()

    return docs.withColumn(output, run(text_bytes(F.col(text))))


def _joined(docs: DataFrame, items: DataFrame, output: str, text: str, window: int, gram: int) -> DataFrame:
    """The same by a join of fingerprints."""
    row = fresh(docs.columns, "_row")
    base = durable(docs.withColumn(row, F.monotonically_increasing_id()), "decontaminate")  # the numbers are drawn once
    each = items.groupBy("t").agg(F.collect_set("i").alias("names")).withColumn("item", F.monotonically_increasing_id())
    each = durable(each, "items")

    def of_items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for batch in batches:
            for number, raw in zip(batch["item"], batch["t"]):
                short, prints = prints_of(words_of(raw), window, gram, known)
                yield pd.DataFrame({"short": short, "print": prints.view(np.int64), "item": number})

    prints = durable(each.select("item", "t").mapInPandas(of_items, "short int, print long, item long"), "item-prints")
    lengths = [r.short for r in prints.where("short > 0").select("short").distinct().collect()]  # fewer than window

    def of_docs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for batch in batches:
            for number, raw in zip(batch["row"], batch["raw"]):
                hashes = hashes_of(words_of(raw), known)
                grams = gram_hashes(hashes, gram)
                every = [(0, grams[winnow(grams, window - gram + 1)])] + [(n, gram_hashes(hashes, n)) for n in lengths]
                for short, own in every:
                    yield pd.DataFrame({"short": short, "print": np.unique(own).view(np.int64), "row": number})
        del known
        give_back()

    texts = base.select(quoted(row).alias("row"), text_bytes(F.col(text)).alias("raw"))
    met = texts.mapInPandas(of_docs, "short int, print long, row long").join(prints, ["short", "print"]).select("row", "item").distinct()
    met = durable(met, "met")
    parts = met.groupBy("row").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts"))
    met = met.join(parts, "row").select("row", "item", F.pmod(F.xxhash64("item"), F.col("parts")).alias("part")).join(each, "item")
    lists = met.groupBy("row", "part").agg(F.collect_list(F.struct("names", "t")).alias("items"))

    def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for number, raw, own in zip(batch["row"], batch["raw"], batch["items"]):
                spans, names = ItemIndex([(list(x["names"]), bytes(x["t"])) for x in own], window, gram).hits(words_of(raw))
                rows.append((number, [{"start": a, "stop": b} for a, b in joined(spans)], sorted(names)))
            yield pd.DataFrame(rows, columns=["row", "spans", "items"])
        give_back()

    kinds = {f.name: f.dataType for f in HITS}
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("spans", kinds["spans"]), T.StructField("items", kinds["items"])])
    found = lists.join(texts, "row").mapInPandas(extend, schema)
    found = found.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    @F.pandas_udf(HITS)
    def whole(raws: pd.Series, spans: pd.Series, names: pd.Series) -> pd.DataFrame:
        rows = [_hit(len(words_of(raw)), [] if own is None else [(x["start"], x["stop"]) for x in own], set() if listed is None else set(listed)) for raw, own, listed in zip(raws, spans, names)]
        return pd.DataFrame(rows, columns=["n_words", "spans", "items"])

    kept = fresh(docs.columns, "_found")
    out = base.join(found.select(F.col("row").alias(row), F.struct("spans", "items").alias(kept)), row, "left")
    return out.withColumn(output, whole(text_bytes(F.col(text)), quoted(kept)["spans"], quoted(kept)["items"])).drop(row, kept)


def find_overlaps(
    docs: DataFrame, benchmark: DataFrame, *, output: str = "overlap", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, gram: int = 5
) -> DataFrame:
    """``docs`` with a struct column ``output``: n_words, spans (in words, merged), items (ids as sorted strings)."""
    if not 0 < gram <= window:
        raise ValueError("gram must lie between 1 and window")
    bounded_batches(docs.sparkSession)
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), text_bytes(F.col(item_text)).alias("t"))
    total = items.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    held = fresh(docs.columns, "_overlap")
    out = (_looked_up if total <= MOST_SENT else _joined)(docs, items, held, text, window, gram)
    return out.select(*(quoted(c) for c in docs.columns if c.lower() != output.lower()), quoted(held).alias(output))


def hit_words(overlap: Column) -> Column:
    return F.aggregate(overlap["spans"], F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that share no span with the benchmark, all columns kept."""
    name = fresh(docs.columns, "_contamination")
    return find_overlaps(docs, benchmark, output=name, **options).where(F.size(F.col(name)["spans"]) == 0).drop(name)
