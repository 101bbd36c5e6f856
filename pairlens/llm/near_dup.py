"""MinHash near-duplicates by an inverted join over signature coordinates.

Texts with equal shingle sets become one node.  A node's signature has
``COORDINATES`` coordinates, each the least hash of its shingles under one of
that many functions.  Nodes are posted under every (coordinate, value) pair they
share with another node.  Two nodes must agree on ``threshold`` coordinates, so
a node posted fewer times than that is done, and of the others' postings, rarest
first, only the prefix that such a pair cannot avoid is kept; the long lists
that remain are skipped.  Within a list, collisions are counted over whole
signatures.

Lists never become all their pairs: a list gives a spanning forest of the pairs
that agree often enough.  One longer than ``BLOCK`` is dealt by bands of set size,
each node in its own and the next, since similar sets lie at most one band apart;
a band that is still longer links all its nodes.  Nodes so linked are a family,
and no similar pair can leave one.  Families are
then settled on full shingle sets, in blocks of bounded size: a small family is
one block; a large one is divided into parts that each meet a hub of the nodes
whose values are commonest, and afterwards every node outside its largest
component meets all others of a size that could match.  Blocks give only links
that join components, so what travels grows with nodes and blocks, not with pairs.
Sets too small to match any other (three shingles at 0.8) are not posted at all.

A pair at the least similarity of 0.8 reaches the threshold of 26 of 48 with a
chance of 0.99999; every link is confirmed exactly.

Defined results: texts without words, null ones among them, have an empty set
and are linked with nothing.  A text of fewer words than a shingle has its whole
sequence as its one shingle.  Repeated rows and equal texts are linked.  A
component is named by its least id; rows without id take part but name nothing,
and a component of such rows alone has a null name.  Other columns are ignored
by ``classes``, and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.llm.common import bounded_batches, by_value, durable, fresh, give_back, join_totals, text_bytes
from pairlens.llm.components import components

by_value(__name__)

COORDINATES, THRESHOLD = 48, 26
#: Nodes, and bytes of text, of a block at most, about; nodes of a hub.
BLOCK, BLOCK_BYTES, HUB = 1024, 6_000_000, 256
#: Tasks among which a large family's nodes are dealt when they meet its facts.
SALT = 32
CACHED_WORDS = 300_000
#: Odd multipliers and offsets of the hash functions, from a fixed seed.
FUNCTIONS = np.random.default_rng(20).integers(0, 2**64, (2, COORDINATES), np.uint64) | np.array([[1], [0]], np.uint64)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: bytes, width: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    if len(known) > CACHED_WORDS:
        known.clear()
    words = text.lower().split()  # bytes: A-Z only, and the six ASCII spaces
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    count = len(words) - width + 1
    out = np.full(count, width, np.uint64)
    for k in range(width):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + count]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The upper halves of the least hashes, one for each function."""
    least = np.full(COORDINATES, 2**64 - 1, np.uint64)
    for start in range(0, len(shingles), 8192):
        part = shingles[start : start + 8192]
        for k in range(COORDINATES):
            least[k] = min(least[k], (part * FUNCTIONS[0, k] + FUNCTIONS[1, k]).min())
    return (least >> np.uint64(32)).astype("<u4")


def signed(docs: DataFrame, id_column: str, text: str, width: int) -> DataFrame:
    """id, text_hash, set_hash (16 bytes), n, signature of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for batch in batches:
            sets, sizes, signs = [], [], []
            for raw in batch["raw"]:
                shingles = shingle_set(raw, width, known)
                sizes.append(len(shingles))
                sets.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                signs.append(signature(shingles).tobytes() if len(shingles) else b"")
            yield pd.DataFrame({"id": batch["id"], "text_hash": batch["text_hash"], "set_hash": sets, "n": sizes, "signature": signs})
        del known
        give_back()

    kind = dict(docs.dtypes)[id_column]
    rows = docs.select(F.col(id_column).cast("string").alias("id"), F.xxhash64(text_bytes(F.col(text))).alias("text_hash"), text_bytes(F.col(text)).alias("raw"))
    out = rows.mapInPandas(run, "id string, text_hash long, set_hash binary, n long, signature binary")
    return out.withColumn("id", F.col("id").cast(kind))


def forest(counts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a maximum spanning forest of the graph of counts of at least ``least`` (Prim)."""
    size = len(counts)
    best, parent, out = counts[0].copy(), np.zeros(size, np.int64), np.zeros(size, bool)
    out[0] = True
    best[0] = -1
    left, right = [], []
    for _ in range(size - 1):
        at = int(best.argmax())
        if best[at] < 0:
            at = int(np.argmin(out))
        if best[at] >= least:
            left.append(parent[at])
            right.append(at)
        out[at], best[at] = True, -1
        closer = (counts[at] > best) & ~out
        best[closer], parent[closer] = counts[at][closer], at
    return np.array(left, np.int64), np.array(right, np.int64)


class Sets(dict):
    """Disjoint sets of nodes, each named by its least."""

    def find(self, x: int) -> int:
        while self.setdefault(x, x) != x:
            self[x] = x = self[self[x]]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        self[max(x, y)] = min(x, y)

    def links(self) -> pd.DataFrame:
        rows = [(self.find(x), x) for x in self]
        return pd.DataFrame([r for r in rows if r[0] != r[1]], columns=["a", "b"], dtype="int64")


def pairs_of_list(signs: np.ndarray, sizes: np.ndarray, least: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs that one list gives."""
    if len(signs) == 2:
        fine = sizes.min() >= share * sizes.max() and (signs[0] == signs[1]).sum() >= least
        return (np.array([0]), np.array([1])) if fine else (np.empty(0, np.int64),) * 2
    counts = np.zeros((len(signs), len(signs)), np.int16)
    for k in range(COORDINATES):
        column = signs[:, k]
        counts += column[:, None] == column
    # a link needs sizes in this proportion
    counts[(sizes[:, None] < share * sizes) | (sizes < share * sizes[:, None])] = 0
    np.fill_diagonal(counts, 0)
    return forest(counts, least)


def candidate_links(lists: DataFrame, least: int, share: float) -> DataFrame:
    """Links (a, b) of nodes that agree often enough, joined to disjoint sets in each task. ``lists``: list, node, n, signature."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, sets = None, Sets()

        def take(rows: pd.DataFrame, starts: np.ndarray) -> None:
            if not len(rows):
                return
            signs = np.frombuffer(b"".join(rows["signature"]), "<u4").reshape(len(rows), COORDINATES)
            nodes, sizes = rows["node"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
            for low, high in zip(starts[:-1].tolist(), starts[1:].tolist()):
                if high - low > 1:
                    left, right = pairs_of_list(signs[low:high], sizes[low:high], least, share)
                    for a, b in zip(nodes[low:high][left].tolist(), nodes[low:high][right].tolist()):
                        sets.join(a, b)

        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            names = held["key"].to_numpy()
            starts = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
            take(held.iloc[: starts[-1]], starts)
            held = held.iloc[starts[-1] :].reset_index(drop=True)  # the last list may go on
        if held is not None:
            take(held, np.array([0, len(held)]))
        yield sets.links()
        del held, sets
        give_back()

    return lists.repartition("key").sortWithinPartitions("key").mapInPandas(run, "a long, b long")


def band(n: Column, share: float) -> Column:
    """Sizes in the proportion ``share`` or nearer lie in the same band or in neighbours."""
    return F.floor(F.log(n.cast("double")) / float(-np.log(share)) + 1e-9).cast("int") if share < 1 else n.cast("int")


def family_links(able: DataFrame, least: int, share: float) -> DataFrame:
    """Links (a, b) that hold families together: candidates of short lists, and all nodes of long ones."""
    lists = able.select("node", "n", "signature", F.explode("keys").alias("key"))
    stats = durable(lists.groupBy("key").agg(F.count(F.lit(1)).alias("length")).where("length > 1"), "lists")
    short = lists.join(stats.where(F.col("length") <= BLOCK).select("key"), "key")
    # the signatures of a list's nodes join those bands that are short
    own = band(F.col("n"), share)
    long = able.select("node", "n", F.explode("keys").alias("key")).join(stats.where(F.col("length") > BLOCK).select("key"), "key")
    long = long.select("node", F.explode(F.array(F.xxhash64("key", own), F.xxhash64("key", own + 1))).alias("key"))
    bands = durable(long.groupBy("key").agg(F.count(F.lit(1)).alias("length"), F.min("node").alias("least")).where("length > 1"), "bands")
    dealt = long.join(bands, "key")
    brief = dealt.where(F.col("length") <= BLOCK).select("node", "key").join(able.select("node", "n", "signature"), "node").select(*short.columns)
    # a node joins the first of its lists' first nodes, and those join each other once, not at every node
    firsts = dealt.where(F.col("length") > BLOCK).groupBy("node").agg(F.array_distinct(F.collect_list("least")).alias("firsts"))  # two for each coordinate at most
    first = F.array_min("firsts").alias("a")
    whole = firsts.select(first, F.col("node").alias("b")).unionByName(firsts.select(first, F.explode("firsts").alias("b")).distinct()).where("a != b")
    return candidate_links(short.unionByName(brief), least, share).unionByName(whole)


#: Shares of a family below its hub; the hub is the first that leaves at most ``HUB`` nodes.
RANKS = [1 - m / 10**e for e in range(1, 10) for m in (5, 2, 1)]


def _parts(n: Column, size: Column) -> Column:
    return F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES), F.lit(1)).cast("int")


def _spot(count: Column) -> Column:
    return F.pmod(F.xxhash64("node", F.lit(3)), count).cast("int")


def _every(count: Column) -> Column:
    return F.sequence(F.lit(0), count - 1)


def with_family(rows: DataFrame, table: DataFrame, how: str = "inner", keys: tuple[str, ...] = ("family",)) -> DataFrame:
    """``rows`` joined by family to a table of large families, each of which meets its nodes in ``SALT`` tasks."""
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(5)), F.lit(SALT)).cast("int")).join(salted, [*keys, "salt"], how).drop("salt")


def family_blocks(members: DataFrame) -> DataFrame:
    """(block, left, node, component, raw) of all families: small ones whole, large ones in parts with their hub.

    ``members``: family, node, weight, raw. Every node is its own component.
    """
    totals = members.groupBy("family").agg(_parts(F.count(F.lit(1)), F.sum(F.octet_length("raw"))).alias("parts"), F.count(F.lit(1)).alias("length"))
    rows = with_family(members, durable(totals.where("parts > 1"), "large-families"), "left")
    small, large = rows.where("parts is null").withColumn("i", F.lit(-1)), rows.where("parts is not null")
    # weights are drawn apart by the node, so that equal ones do not crowd into the hub
    large = large.withColumn("weight", F.col("weight") + F.pmod(F.xxhash64("node", F.lit(7)), F.lit(2**20)) / 2**20)
    edges = large.groupBy("family", "length").agg(F.percentile_approx("weight", RANKS, 100_000).alias("edges"))
    fits = F.array_position(F.transform(F.array(*map(F.lit, RANKS)), lambda r: (1 - r) * F.col("length") <= HUB), True)
    large = with_family(large, edges.select("family", F.element_at("edges", fits.cast("int")).alias("edge")))
    large = large.withColumn("i", F.explode(F.when(F.col("weight") >= F.col("edge"), _every(F.col("parts"))).otherwise(F.array(_spot(F.col("parts"))))))
    wanted = [F.xxhash64("family", "i").alias("block"), F.lit(False).alias("left"), "node", F.col("node").alias("component"), "raw"]
    return small.select(*wanted).unionByName(large.select(*wanted))


def stray_blocks(members: DataFrame, share: float) -> DataFrame:
    """(block, left, node, component, raw): nodes outside their family's largest component (``left``) against all its nodes of their own and the neighbouring bands of size.

    ``members``: family, node, n, component, raw of families in several parts and components.
    """
    sizes = members.groupBy("family", "component").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("family").agg(F.max_by("component", F.struct("n", "component")).alias("main"))
    rows = with_family(members, main).withColumn("band", band(F.col("n"), share))
    lefts, rights = rows.where("component != main"), rows.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    count = lambda side, name: side.groupBy("family", "band").agg(_parts(F.count(F.lit(1)), F.sum(F.octet_length("raw"))).alias(name))
    both = durable(count(lefts, "lefts").join(count(rights, "rights"), ["family", "band"]), "strays")
    key = ("family", "band")
    as_left = with_family(lefts, both, keys=key).withColumn("i", _spot(F.col("lefts"))).withColumn("j", F.explode(_every(F.col("rights")))).withColumn("left", F.lit(True))
    as_right = with_family(rights, both, keys=key).withColumn("j", _spot(F.col("rights"))).withColumn("i", F.explode(_every(F.col("lefts")))).withColumn("left", F.lit(False))
    return as_left.unionByName(as_right).select(F.xxhash64("family", "band", "i", "j").alias("block"), "left", "node", "component", "raw")


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of one side with every set of the other."""
    same = left is right
    values = [np.concatenate(side) for side in ((left,) if same else (left, right))]
    if same:
        shared, times = np.unique(values[0], return_counts=True)
        shared = shared[times > 1]
    else:
        shared = np.intersect1d(*map(np.unique, values), assume_unique=True)
    both = np.zeros((len(left), len(right)), np.float32)  # counts stay below 2**24, so float32 is exact
    for start in range(0, len(shared), 2048):
        part = shared[start : start + 2048]
        tables = []
        for side, own in zip((left, right), values):
            at = np.minimum(np.searchsorted(part, own), len(part) - 1)
            there = part[at] == own
            table = np.zeros((len(side), len(part)), np.float32)
            table[np.repeat(np.arange(len(side)), list(map(len, side)))[there], at[there]] = 1
            tables.append(table)
        both += tables[0] @ tables[-1].T
    return both.astype(np.int64)


def settle(sets: Sets, left: list[tuple[int, int, np.ndarray]], right: list[tuple[int, int, np.ndarray]], percent: int) -> None:
    """Join the components of all similar pairs. Items: (node, component, shingles)."""
    if len(left) * len(right) <= 64:
        for i, (_, c, x) in enumerate(left):
            for _, d, y in right[i + 1 :] if left is right else right:
                if sets.find(c) != sets.find(d) and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        sets.join(c, d)
        return
    one = [s for *_, s in left]
    both = common_counts(one, one if left is right else [s for *_, s in right])
    sizes = [np.array([len(s) for *_, s in side]) for side in (left, right)]
    for i, j in zip(*(x.tolist() for x in np.nonzero(100 * both >= percent * (sizes[0][:, None] + sizes[1] - both)))):
        sets.join(left[i][1], right[j][1])


def links_in_blocks(blocks: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between components, joined to disjoint sets in each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, sets = WordHashes(), Sets()
        name, left, right = None, [], []
        for batch in batches:
            for block, is_left, node, component, raw in zip(*(batch[c].tolist() for c in ("block", "left", "node", "component", "raw"))):
                if block != name:
                    settle(sets, left or right, right, percent)
                    name, left, right = block, [], []
                (left if is_left else right).append((node, component, shingle_set(raw, width, known)))
        settle(sets, left or right, right, percent)
        yield sets.links()
        del known, sets, left, right
        give_back()

    return blocks.repartition("block").sortWithinPartitions("block").mapInPandas(run, "a long, b long")


def posted(nodes: DataFrame, threshold: int) -> DataFrame:
    """node, n, signature, keys (the prefix of its postings), weight of the nodes that may have a partner."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        high = np.arange(COORDINATES, dtype=np.int64) << 32
        for batch in batches:
            signs = np.frombuffer(b"".join(batch["signature"]), "<u4").reshape(-1, COORDINATES)
            yield pd.DataFrame({"key": (high + signs).ravel(), "node": np.repeat(batch["node"].to_numpy(np.int64), COORDINATES)})

    postings = nodes.select("node", "signature").mapInPandas(run, "key long, node long")
    shared = postings.groupBy("key").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    own = postings.join(shared, "key").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("often", "key"))).alias("by"))  # COORDINATES at most
    own = own.where(F.size("by") >= threshold)
    prefix = F.slice("by", F.lit(1), F.size("by") - (threshold - 1))
    own = own.select("node", F.transform(prefix, lambda x: x["key"]).alias("keys"), F.aggregate("by", F.lit(0).cast("double"), lambda t, x: t + x["often"]).alias("weight"))
    return own.join(nodes.select("node", "n", "signature"), "node")


def classes(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, numbered: bool = False) -> DataFrame:
    """id, text_hash, n (set size), component (least id reachable, its own included) of every row.

    Rows with an empty set have component = id.  ``numbered`` adds the component's number, which rows without any id have too.
    """
    bounded_batches(docs.sparkSession)
    rows = durable(signed(docs, id_column, text, width), "signed")
    named = rows.where("n > 0").groupBy("set_hash").agg(F.first("n").alias("n"), F.first("signature").alias("signature"), F.min("id").alias("id"), F.min(F.struct("id", "text_hash")).alias("one"))
    nodes = durable(named.withColumn("node", F.monotonically_increasing_id()), "nodes")  # the numbers are drawn once
    # two unlike sets of which the smaller has n shingles share at most n of n + 1
    able = durable(posted(nodes.where(F.col("n") * (100 - percent) >= percent), THRESHOLD), "posted")
    families = durable(components(family_links(able, THRESHOLD, percent / 100)), "families")
    ones = families.join(able.select("node", "n", "weight"), "node").join(nodes.select("node", "one"), "node")
    ones = ones.select("node", F.col("component").alias("family"), "n", "weight", F.col("one.id").alias("i"), F.col("one.text_hash").alias("h"))
    source = docs.select(F.col(id_column).alias("id"), text_bytes(F.col(text)).alias("raw")).withColumn("text_hash", F.xxhash64("raw"))
    members = source.join(ones, F.col("id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("h"))).groupBy("node").agg(*(F.first(c).alias(c) for c in ("family", "n", "weight", "raw")))
    members = durable(members, "members")
    links = durable(links_in_blocks(family_blocks(members), width, percent), "links")
    found = durable(components(links), "components")
    # what parts of large families may have missed
    large = members.groupBy("family").agg(_parts(F.count(F.lit(1)), F.sum(F.octet_length("raw"))).alias("parts")).where("parts > 1").select("family")
    rest = with_family(members, large).join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = rest.groupBy("family").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 != c1").select("family")
    mixed = durable(mixed, "mixed")
    if not mixed.isEmpty():
        late = durable(links_in_blocks(stray_blocks(with_family(rest, mixed), percent / 100), width, percent), "late-links")
        found = durable(components(links.unionByName(late)), "components")

    placed = nodes.select("node", "set_hash", "id").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = placed.groupBy("component").agg(F.min("id").alias("name"))
    placed = join_totals(placed, names, "component").select("set_hash", "name", F.col("component").alias("number"))
    out = rows.select("id", "text_hash", "n", "set_hash").join(placed, "set_hash", "left")
    return out.select("id", "text_hash", "n", F.when(F.col("n") > 0, F.col("name")).otherwise(F.col("id")).alias("component"), *(["number"] if numbered else []))


def keep_one(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each component, the one with its name, and all rows with an empty set; columns as they were."""
    known = durable(classes(docs, id_column=id_column, text=text, numbered=True, **options), "classes")
    wordless = known.where("n = 0").select("id", "text_hash").distinct().withColumn("times", F.lit(1).cast("long"))
    # a component of rows without id keeps the one of them whose text hashes lowest
    named = known.where("n > 0").groupBy("component", F.when(F.col("component").isNull(), F.col("number")).alias("own"))
    kept = named.agg(F.min(F.struct(F.col("id").isNull(), "id", "text_hash")).alias("one")).select(F.col("one.id").alias("id"), F.col("one.text_hash").alias("text_hash"))
    often = known.where("n > 0").groupBy("id", "text_hash").agg(F.count(F.lit(1)).alias("times"))
    kept = kept.join(often, kept["id"].eqNullSafe(often["id"]) & (kept["text_hash"] == often["text_hash"])).select(kept["id"], kept["text_hash"], "times").unionByName(wordless)
    taken = list(docs.columns)
    names = [fresh(taken, f"_near_{x}") for x in ("hash", "id", "kept", "times")]
    kept = kept.select(F.col("id").alias(names[1]), F.col("text_hash").alias(names[2]), F.col("times").alias(names[3]))
    rows = docs.withColumn(names[0], F.xxhash64(text_bytes(F.col(text))))
    rows = rows.join(kept, (F.col(names[0]) == F.col(names[2])) & F.col(id_column).eqNullSafe(F.col(names[1])))
    once, repeated = rows.where(F.col(names[3]) == 1), rows.where(F.col(names[3]) > 1)
    return once.unionByName(repeated.dropDuplicates([id_column, names[0]])).select(*taken)
