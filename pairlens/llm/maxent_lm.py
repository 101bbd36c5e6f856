"""A hashed maximum-entropy language model with a class-factored softmax.

P(word | context) = P(class | context) * P(word | class, context).  A class is one
of the most frequent words, or the words with some ending.  The class is
predicted by a log-linear model over hashed features: the word before (n-gram),
the one before that alone (skip), and the pair of classes before.

The word is predicted within its class by ``DEPTH`` log-linear decisions down a
binary tree over the bits of its hash.  Each begins at the shares of the counts
on both sides and adds the weights of the word before and of the one before that,
if those are frequent enough to tell anything, hashed whole together with the
decision into a table whose size follows the training tokens.  Words of one leaf
divide it by their counts plus a half each.  Each class has one share for unknown
words beside its tree, so the probabilities of all words sum to one.

Training: exact token counts over all training text, by one shuffle.  Then one pass
over all training texts gathers the gradient of the first step, whose predictions
are the shares, and writes every distinct class context with its count.  Later
steps of the class weights read those counts, which stand for all training tokens
exactly; later steps of the word weights, if any are asked for, read the texts again.  Tasks sum what they
send locally, and it is summed up in a tree of bounded fan-in.  Scoring is one pass
of sparse numpy batches.  The counts of the ``COMMON`` most frequent tokens travel
to the tasks (a fixed size); all other tokens meet their counts in a join.

Tokens are identified by a 64-bit hash.  Defined results: null text is empty and
has the end token alone; a null id is never held out; with no training text only
unknown shares remain and every class is equally likely.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.llm.common import bounded_batches, by_value, durable, give_back, text_bytes

by_value(__name__)

#: Classes, how many of them are single words, hashed buckets of a word, buckets of endings, frequent tokens sent to tasks.
CLASSES, OWN, BUCKETS, ENDINGS, COMMON = 64, 24, 1024, 4096, 1 << 17
#: Gradient steps of class weights and of word weights, the first of either from the shares.
CLASS_ROUNDS, WORD_ROUNDS = 8, 1
#: Rows of the weights: two word positions and the pair of classes before.
ROWS = 2 * BUCKETS + CLASSES * CLASSES
#: Step length, and the pull towards zero in expected counts.
RATE, PULL = 0.15, 20.0
#: Decisions of a word, step length and pull of their weights, least count of a word that they look back to.
DEPTH, WORD_RATE, WORD_PULL, LEAST_CONTEXT = 10, 0.75, 4.0, 32
#: Training tokens for each word weight, and the bits of the least and largest table (what tasks and driver hold).
TOKENS_A_WEIGHT, LEAST_BITS, MOST_BITS = 8, 12, 21
#: Numbers in a gradient block, training tokens of a task for each number it sends, blocks summed at once, tasks of a small table.
BLOCK, TOKENS_A_NUMBER, FAN_IN, LEAST_TASKS = 16_384, 4, 64, 6
#: Tokens whose contexts a task holds before it counts them, and bytes of contexts of a task.
CONTEXTS_HELD, CONTEXT_BYTES = 1_000_000, 8_000_000
#: Distinct tokens that a counting task holds before it passes them on, and rows that it sends at once.
WORDS_KEPT, ROWS_SENT = 400_000, 30_000
CHUNK = 4096
#: The end token's place among the hashes.
END_HASH = np.int64(0x5DEECE66D1234567)


#: A random word for each byte, capitals as small letters, and the base of the polynomial hash (odd, so it has an inverse).
_RANDOM = np.random.default_rng(4).integers(1, 2**63, 257, np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
BYTE_WORDS, BASE = _RANDOM[LOWER], int(_RANDOM[256])
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
SIGN = np.isin(np.arange(256), list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))
#: Text bytes hashed at once, about; a piece ends behind a space.
HASHED_BYTES = 1 << 18


def powers(base: int, count: int) -> np.ndarray:
    """base ** 0, 1, ... modulo 2 ** 64."""
    out = np.ones(count, np.uint64)
    have = 1
    while have < count:
        more = min(have, count - have)
        out[have : have + more] = out[:more] * np.uint64(pow(base, have, 2**64))
        have += more
    return out


class Hasher:
    """Hashes and endings of all tokens of many texts at once: polynomial hashes as differences of prefix sums."""

    def __init__(self):
        self.up = self.down = powers(BASE, 0)

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash and ending of every token, an end token after each text, and the number of each text's tokens."""
        raw = np.frombuffer(b"".join(x for t in texts for x in (t, b" ")), np.uint8)
        parts, start = [], 0
        while start < len(raw):  # pieces end behind a space
            stop = min(len(raw), start + HASHED_BYTES)
            while not SPACE[raw[stop - 1]]:
                more = SPACE[raw[stop : stop + 4096]]
                stop += int(more.argmax()) + 1 if more.any() else len(more)
            parts.append(self._piece(raw[start:stop], start))
            start = stop
        starts, hashes, endings = (np.concatenate(x) for x in zip(*parts))
        texts_end = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
        own = np.searchsorted(texts_end, starts, side="right")
        lengths = np.bincount(own, minlength=len(texts)) + 1
        all_hashes, all_endings = np.full(lengths.sum(), END_HASH), np.zeros(lengths.sum(), np.int64)
        at = np.arange(len(starts)) + own
        all_hashes[at], all_endings[at] = hashes, endings
        return all_hashes, all_endings, lengths

    def _piece(self, raw: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the words of a piece start in the whole, their hashes and their endings."""
        if len(self.up) < len(raw):
            room = max(HASHED_BYTES + 4096, len(raw))
            self.up, self.down = powers(BASE, room), powers(pow(BASE, -1, 2**64), room)
        space = SPACE[raw]
        before = np.r_[True, space[:-1]]
        starts, ends = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
        sums = np.cumsum(BYTE_WORDS[raw] * self.up[: len(raw)])
        hashes = (sums[ends - 1] - np.where(starts > 0, sums[starts - 1], np.uint64(0))) * self.down[starts]
        del sums
        hashes = (hashes ^ hashes >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        hashes ^= hashes >> np.uint64(29)
        # the last byte of a word that is no sign, and the one before it
        core = np.maximum.accumulate(np.where(SIGN[raw], np.int32(-1), np.arange(len(raw), dtype=np.int32)))[ends - 1]
        last = LOWER[raw[np.maximum(core, 0)]].astype(np.int64)
        second = np.where(core > starts, LOWER[raw[np.maximum(core - 1, 0)]], 0).astype(np.int64)
        endings = 2 + (second * 263 + last * 7919) % (ENDINGS - 2)
        return starts + first, hashes.view(np.int64), np.where(core < starts, 0, np.where((last >= 48) & (last <= 57), 1, endings))


def portions(texts: list[bytes]) -> Iterator[list[bytes]]:
    """The texts in runs of about ``HASHED_BYTES``, so that what is worked out for them stays small."""
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text) + 1
        if size >= HASHED_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


def counted(hashes: np.ndarray, endings: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, their endings, and the sums of their counts."""
    if not len(hashes):
        return hashes, endings, counts
    order = np.argsort(hashes)
    hashes, endings, counts = hashes[order], endings[order], counts[order]
    first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
    return hashes[first], endings[first], np.add.reduceat(counts, first)


def token_counts(docs: DataFrame) -> DataFrame:
    """token (hash), ending, c over all texts in ``raw``; tasks count before the shuffle."""

    def told(held: tuple[np.ndarray, ...]) -> Iterator[pd.DataFrame]:
        for at in range(0, len(held[0]), ROWS_SENT):
            yield pd.DataFrame({name: x[at : at + ROWS_SENT] for name, x in zip(("token", "ending", "c"), held)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, none = Hasher(), np.empty(0, np.int64)
        held = none, none, none
        for batch in batches:
            for texts in portions(batch["raw"].tolist()):
                hashes, endings, _ = hasher.of(texts)
                new = counted(hashes, endings, np.ones(len(hashes), np.int64))
                held = counted(*(np.concatenate(x) for x in zip(held, new)))
                if len(held[0]) > WORDS_KEPT:
                    yield from told(held)
                    held = none, none, none
        yield from told(held)
        held = none, none, none
        give_back()

    return docs.mapInPandas(run, "token long, ending int, c long").groupBy("token").agg(F.min("ending").alias("ending"), F.sum("c").alias("c"))


class Lookup:
    """Values of known hashes by open addressing, many at a time; -1 for others."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray):
        bits = max(4, (2 * len(hashes)).bit_length())
        self.mask, self.keys, self.values = (1 << bits) - 1, np.zeros(1 << bits, np.int64), np.full(1 << bits, -1)
        todo, step = np.arange(len(hashes)), 0
        while len(todo):
            slot = hashes[todo] + step & self.mask
            _, first = np.unique(slot, return_index=True)
            first = first[self.values[slot[first]] < 0]
            self.keys[slot[first]], self.values[slot[first]] = hashes[todo[first]], values[todo[first]]
            todo, step = np.delete(todo, first), step + 1

    def of(self, hashes: np.ndarray) -> np.ndarray:
        slot = hashes & self.mask
        out = np.where(self.keys[slot] == hashes, self.values[slot], -1)
        todo = np.flatnonzero((self.values[slot] >= 0) & (self.keys[slot] != hashes))
        step = 1
        while len(todo):
            slot = hashes[todo] + step & self.mask
            hit, more = self.keys[slot] == hashes[todo], self.values[slot] >= 0
            out[todo[hit & more]] = self.values[slot[hit & more]]
            todo, step = todo[more & ~hit], step + 1
        return out


@dataclass
class Model:
    """Counts of common tokens, classes, and the weights of the class softmax (natural logarithms)."""

    tokens: np.ndarray  # hashes of the common tokens, sorted
    counts: np.ndarray
    own: np.ndarray  # hashes that are a class of their own, in the order of their classes
    class_of_ending: np.ndarray
    mass: np.ndarray  # by class: sum of counts plus a half each, and a half for unknown words
    weights: np.ndarray  # the classes' shares to begin with, in the rows of the word before
    total: int
    distinct: int
    offsets: np.ndarray  # by class and tree node: log of the right side's counts to the left side's
    word_weights: np.ndarray

    def tables(self) -> tuple[Lookup, Lookup]:
        """The count of a common token, and the class of one that is a class of its own; made once in a task."""
        return Lookup(self.tokens, self.counts), Lookup(self.own, np.arange(len(self.own)))

    def facts(self, hashes: np.ndarray, endings: np.ndarray, tables: tuple[Lookup, Lookup]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By token: class, feature bucket, count (-1 where a join must tell)."""
        own, counts = tables[1].of(hashes), tables[0].of(hashes)
        classes = np.where(own >= 0, own, self.class_of_ending[endings])
        # frequent words have hashed buckets of their own, others share those of their endings
        frequent = counts * 20_000 >= max(1, self.total)
        buckets = np.where(frequent, BUCKETS // 2 + (hashes >> 7) % (BUCKETS // 2), CLASSES + endings % (BUCKETS // 2 - CLASSES))
        return classes, buckets, counts

    @staticmethod
    def features(classes: np.ndarray, buckets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The feature rows of every token; bucket 0 and class 0 (the end) stand before a text."""
        starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
        place = np.arange(len(classes)) - starts
        out = np.empty((len(classes), 3), np.int64)
        before = []
        for k in (1, 2):
            back = np.maximum(np.arange(len(classes)) - k, 0)
            out[:, k - 1] = (k - 1) * BUCKETS + np.where(place >= k, buckets[back], k % CLASSES)
            before.append(np.where(place >= k, classes[back], 0))
        out[:, 2] = 2 * BUCKETS + before[0] * CLASSES + before[1]
        return out

    @staticmethod
    def exponents(raised: np.ndarray, features: np.ndarray, room: np.ndarray) -> np.ndarray:
        """Unnormalised probabilities of all classes for a chunk of tokens from the raised weights; the bias is one of their parts."""
        out, spare = room[0, : len(features)], room[1, : len(features)]
        np.take(raised, features[:, 0], axis=0, out=out, mode="clip")
        for k in range(1, features.shape[1]):
            np.take(raised, features[:, k], axis=0, out=spare, mode="clip")
            out *= spare
        return out

    def log_probabilities(self, features: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Log probability of each token's own class."""
        room, ones, raised = np.empty((2, CHUNK, CLASSES), np.float32), np.ones(CLASSES, np.float32), np.exp(self.weights)
        out = self.weights[features, classes[:, None]].sum(1, dtype=np.float64)
        for start in range(0, len(features), CHUNK):
            out[start : start + CHUNK] -= np.log(self.exponents(raised, features[start : start + CHUNK], room) @ ones)
        return out

    def decisions(self, hashes: np.ndarray, classes: np.ndarray, before: Before) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By token and depth: 1 for right or -1 for left, the node, and by word before the place of its weight; the last place, always 0, if it is too rare."""
        bits, depth = (hashes.view(np.uint64) >> np.uint64(64 - DEPTH)).astype(np.int64)[:, None], np.arange(DEPTH)
        nodes = (classes << DEPTH)[:, None] + (1 << depth) + (bits >> DEPTH - depth)
        side = (2 * (bits >> DEPTH - 1 - depth & 1) - 1).astype(np.float32)
        mixed, width = nodes.astype(np.uint64) * MIX[0], len(self.word_weights) - 1
        shift = np.uint64(65 - width.bit_length())
        words, usual = before
        places = np.stack([np.where(usual[:, k, None], ((words[:, k, None] * MIX[k + 1] ^ mixed) * MIX[3] >> shift).astype(np.int64), width) for k in range(2)])
        return side, nodes, places

    def word_odds(self, hashes: np.ndarray, classes: np.ndarray, before: Before) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By token and depth: the odds against the side taken; side and places."""
        side, nodes, places = self.decisions(hashes, classes, before)
        logit = np.take(self.word_weights, places[0])
        logit += np.take(self.word_weights, places[1])
        logit += np.take(self.offsets, nodes)
        logit *= -side
        return np.exp(logit, out=logit), side, places

    def leaf_logs(self) -> np.ndarray:
        """By class and leaf: the log probability of the leaf within its class without any context."""
        offsets = self.offsets.reshape(CLASSES, 1 << DEPTH).astype(np.float64)
        out = np.zeros((CLASSES, 1))
        for depth in range(DEPTH):
            here = offsets[:, 1 << depth : 2 << depth]
            out = np.stack([out - np.logaddexp(0, here), out - np.logaddexp(0, -here)], 2).reshape(CLASSES, -1)
        return out

    def word_gains(self, hashes: np.ndarray, classes: np.ndarray, before: Before, leaves: np.ndarray) -> np.ndarray:
        """What context adds to the log probability of each token within its class, if the token is known; ``leaves``: ``leaf_logs``."""
        out, treed = np.zeros(len(hashes)), np.flatnonzero((classes >= len(self.own)) & before[1].any(1))
        with np.errstate(over="ignore", invalid="ignore"):  # only unknown words go where no counts are
            for start in range(0, len(treed), CHUNK):
                at = treed[start : start + CHUNK]
                odds, _, _ = self.word_odds(hashes[at], classes[at], (before[0][at], before[1][at]))
                odds += 1
                out[at] = -np.log(odds.prod(1, dtype=np.float64)) - leaves[classes[at], (hashes[at].view(np.uint64) >> np.uint64(64 - DEPTH)).astype(np.int64)]
        return np.nan_to_num(out, posinf=0.0, neginf=0.0)


#: Hashes of the word before each token and of the one before that, and whether these are frequent enough.
Before = tuple[np.ndarray, np.ndarray]
#: Odd multipliers: of tree nodes, of the two words before, and of both together.
MIX = np.random.default_rng(5).integers(1, 2**63, 4, np.uint64) * np.uint64(2) + np.uint64(1)


def words_before(hashes: np.ndarray, counts: np.ndarray, lengths: np.ndarray) -> Before:
    """The two words before each token; the end token stands before a text."""
    at, place = np.arange(len(hashes)), np.arange(len(hashes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    back = [(place >= k, np.maximum(at - k, 0)) for k in (1, 2)]
    words = np.stack([np.where(there, hashes[of], END_HASH) for there, of in back], 1).view(np.uint64)
    return words, np.stack([np.where(there, counts[of] >= LEAST_CONTEXT, True) for there, of in back], 1)


def tree_offsets(leaves: np.ndarray) -> np.ndarray:
    """Offsets of all tree nodes from the mass of leaves by class; a side without mass is out of reach."""
    out, mass = np.zeros((len(leaves), 1 << DEPTH), np.float32), leaves
    for depth in reversed(range(DEPTH)):
        left, right = mass[:, 0::2], mass[:, 1::2]
        with np.errstate(divide="ignore", invalid="ignore"):
            offset = np.log(right) - np.log(left)
        out[:, 1 << depth : 2 << depth] = np.clip(np.nan_to_num(offset, nan=0.0, posinf=40.0, neginf=-40.0), -40, 40)
        mass = left + right
    return out.ravel()


def class_layout(endings: pd.DataFrame, common: pd.DataFrame, total: int, distinct: int) -> Model:
    """Classes from the counts of endings (ending, c, v) and of common tokens (token, ending, c; most frequent first)."""
    own = common["token"].to_numpy(np.int64)[:OWN]
    if END_HASH in own:  # the end is class 0
        own = np.r_[END_HASH, own[own != END_HASH]]
    first = common.iloc[: len(own)]
    mass_of_ending = np.zeros(ENDINGS)
    mass_of_ending[endings["ending"].to_numpy(np.int64)] = endings["c"].to_numpy(np.float64) + 0.5 * endings["v"].to_numpy(np.float64)
    np.subtract.at(mass_of_ending, first["ending"].to_numpy(np.int64), first["c"].to_numpy(np.float64) + 0.5)
    mass = np.full(CLASSES, 0.5)
    count_of = dict(zip(first["token"].tolist(), first["c"].tolist()))
    for k, token in enumerate(own.tolist()):
        mass[k] += count_of[token] + 0.5
    # endings by falling mass, each to the lightest class so far: the frequent ones stay alone
    class_of_ending, load = np.zeros(ENDINGS, np.int64), np.zeros(CLASSES - OWN)
    for e in np.argsort(-mass_of_ending, kind="stable").tolist():
        k = int(load.argmin())
        class_of_ending[e] = OWN + k
        load[k] += max(0.0, mass_of_ending[e]) + 1e-3
        mass[OWN + k] += max(0.0, mass_of_ending[e])
    order = np.argsort(common["token"].to_numpy(np.int64))
    weights = np.zeros((ROWS, CLASSES), np.float32)
    weights[:BUCKETS] = np.log(mass / mass.sum())
    return Model(
        common["token"].to_numpy(np.int64)[order], common["c"].to_numpy(np.int64)[order], own, class_of_ending, mass,
        weights, total, distinct, np.zeros(CLASSES << DEPTH, np.float32), np.zeros((1 << min(MOST_BITS, max(LEAST_BITS, (total // TOKENS_A_WEIGHT).bit_length() - 1))) + 1, np.float32),
    )


def observed(features: np.ndarray, classes: np.ndarray, sums: np.ndarray) -> None:
    """Add to ``sums`` how often each feature row stands before each class."""
    for k in range(features.shape[1]):
        sums += np.bincount(features[:, k] * CLASSES + classes, minlength=ROWS * CLASSES).reshape(ROWS, CLASSES)


def packed(features: np.ndarray) -> np.ndarray:
    """The three feature rows of a context in one number, the first one highest."""
    return ((features[:, 0] << 22 | features[:, 1] - BUCKETS << 12) | features[:, 2] - 2 * BUCKETS).astype(np.uint32)


def unpacked(keys: np.ndarray) -> np.ndarray:
    keys = keys.astype(np.int64)
    return np.stack([keys >> 22, (keys >> 12 & BUCKETS - 1) + BUCKETS, (keys & 4095) + 2 * BUCKETS], 1)


def expected(weights: np.ndarray, keys: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> None:
    """Add to ``sums`` how often the model expects each class behind each feature row of these contexts."""
    room, ones, raised = np.empty((2, CHUNK, CLASSES), np.float32), np.ones(CLASSES, np.float32), np.exp(weights)
    for start in range(0, len(keys), CHUNK):
        part = unpacked(keys[start : start + CHUNK])
        share = Model.exponents(raised, part, room)
        share *= (counts[start : start + CHUNK] / (share @ ones))[:, None].astype(np.float32)
        for k in range(part.shape[1]):
            order = np.argsort(part[:, k].astype(np.int16), kind="stable")
            named = part[order, k]
            firsts = np.flatnonzero(np.r_[True, named[1:] != named[:-1]])
            np.take(share, order, axis=0, out=room[1, : len(part)], mode="clip")
            sums[named[firsts]] += np.add.reduceat(room[1, : len(part)], firsts, axis=0)


def word_gradient(model: Model, hashes: np.ndarray, classes: np.ndarray, before: Before, sums: np.ndarray, bend: np.ndarray | None) -> None:
    """Add to ``sums`` the gradient of the word weights; with ``bend``, that of the first step, and its curvature to ``bend``."""
    treed = np.flatnonzero((classes >= len(model.own)) & before[1].any(1))
    shares = None if bend is None else 1 / (1 + np.exp(-model.offsets))
    for start in range(0, len(treed), CHUNK):
        at = treed[start : start + CHUNK]
        own = hashes[at], classes[at], (before[0][at], before[1][at])
        if bend is None:
            odds, side, places = model.word_odds(*own)
            wrong = side * (odds / (1 + odds))
        else:
            side, nodes, places = model.decisions(*own)
            right = np.take(shares, nodes)
            wrong, curve = ((side > 0) - right).astype(np.float32), (right * (1 - right)).astype(np.float32)
        for k in range(2):
            usual = before[1][at, k]
            np.add.at(sums, places[k][usual].ravel(), wrong[usual].ravel())
            if bend is not None:
                np.add.at(bend, places[k][usual].ravel(), curve[usual].ravel())


def step(model: Model, sums: np.ndarray, seen: np.ndarray) -> None:
    """One damped diagonal Newton step, curvature taken from the classes' shares."""
    share = model.mass / model.mass.sum()
    model.weights += (RATE * sums / (seen[:, None] * share * (1 - share) + PULL)).astype(np.float32)
    np.clip(model.weights, -20, 20, out=model.weights)


def word_step(model: Model, sums: np.ndarray, bend: np.ndarray) -> None:
    model.word_weights += (WORD_RATE * (sums - WORD_PULL * model.word_weights) / (bend + WORD_PULL)).astype(np.float32)
    np.clip(model.word_weights, -10, 10, out=model.word_weights)
    model.word_weights[-1] = 0


PARTS = "block int, twig int, data binary"


def parts_of(arrays: list[np.ndarray]) -> Iterator[pd.DataFrame]:
    """What a task sends: the numbers of all arrays in blocks, of which the last of an array may be shorter."""
    twig, number = TaskContext.get().partitionId() // FAN_IN, 0
    for array in arrays:
        flat = array.ravel()
        for start in range(0, len(flat), BLOCK * 16):
            some = [flat[at : at + BLOCK].astype(np.float32).tobytes() for at in range(start, min(len(flat), start + BLOCK * 16), BLOCK)]
            yield pd.DataFrame({"block": range(number, number + len(some)), "twig": twig, "data": some})
            number += len(some)


def summed(parts: DataFrame, tasks: int, sizes: list[int]) -> list[np.ndarray]:
    """The sums of what at most ``tasks`` tasks sent, as arrays of these sizes; no group holds more than ``FAN_IN`` blocks."""

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in group["data"])
        return pd.DataFrame({"block": [group["block"].iloc[0]], "twig": [group["twig"].iloc[0] // FAN_IN], "data": [total.astype(np.float32).tobytes()]})

    while True:
        parts, tasks = parts.groupBy("block", "twig").applyInPandas(add, PARTS), -(-tasks // FAN_IN)
        if tasks <= 1:
            break
    got = parts.toPandas().sort_values("block")  # a bounded number of rows
    every = np.frombuffer(b"".join(got["data"]), np.float32).astype(np.float64) if len(got) else np.zeros(sum(sizes))
    return np.split(every, np.cumsum(sizes)[:-1])


def first_round(docs: DataFrame, model: Model, tasks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, DataFrame]:
    """Over all texts in ``raw``: observed classes by feature row, gradient and curvature of the word weights, and the table of contexts (data: keys, then counts)."""
    sent, width = docs.sparkSession.sparkContext.broadcast(model), len(model.word_weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, hasher = sent.value, Hasher()
        tables = model.tables()
        sums, word_sums, bend = np.zeros((ROWS, CLASSES)), np.zeros(width, np.float32), np.zeros(width, np.float32)
        held, size, any_rows = [], 0, False

        def contexts() -> pd.DataFrame:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            return pd.DataFrame({"block": [-1], "twig": [0], "data": [keys.tobytes() + counts.astype(np.uint32).tobytes()]})

        for batch in batches:
            any_rows = True
            for texts in portions(batch["raw"].tolist()):
                hashes, endings, lengths = hasher.of(texts)
                classes, buckets, counts = model.facts(hashes, endings, tables)
                features = model.features(classes, buckets, lengths)
                observed(features, classes, sums)
                held.append(packed(features))
                size += len(features)
                if size >= CONTEXTS_HELD:
                    yield contexts()
                    held, size = [], 0
                word_gradient(model, hashes, classes, words_before(hashes, counts, lengths), word_sums, bend)
        if held:
            yield contexts()
        if any_rows:
            yield from parts_of([sums, word_sums, bend])
        del model, hasher, tables, sums, word_sums, bend
        give_back()

    rows = durable(docs.coalesce(tasks).mapInPandas(run, PARTS), "first-round")
    sent.unpersist()
    sums, word_sums, bend = summed(rows.where("block >= 0"), tasks, [ROWS * CLASSES, width, width])
    return sums.reshape(ROWS, CLASSES), word_sums, bend, rows.where("block < 0").select("data")


def class_round(contexts: DataFrame, model: Model, tasks: int) -> np.ndarray:
    """The classes that the model expects behind each feature row, over all training tokens."""
    sent = contexts.sparkSession.sparkContext.broadcast(model.weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, any_rows = np.zeros((ROWS, CLASSES)), False
        for batch in batches:
            for data in batch["data"]:
                any_rows, numbers = True, np.frombuffer(data, np.uint32)
                expected(sent.value, numbers[: len(numbers) // 2], numbers[len(numbers) // 2 :], sums)
        if any_rows:
            yield from parts_of([sums])
        give_back()

    out = summed(contexts.coalesce(tasks).mapInPandas(run, PARTS), tasks, [ROWS * CLASSES])[0].reshape(ROWS, CLASSES)
    sent.unpersist()
    return out


def word_round(docs: DataFrame, model: Model, tasks: int) -> np.ndarray:
    """The gradient of the word weights over all texts in ``raw``."""
    sent, width = docs.sparkSession.sparkContext.broadcast(model), len(model.word_weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, hasher, sums, any_rows = sent.value, Hasher(), np.zeros(width, np.float32), False
        tables = model.tables()
        for batch in batches:
            any_rows = True
            for texts in portions(batch["raw"].tolist()):
                hashes, endings, lengths = hasher.of(texts)
                classes, _, counts = model.facts(hashes, endings, tables)
                word_gradient(model, hashes, classes, words_before(hashes, counts, lengths), sums, None)
        if any_rows:
            yield from parts_of([sums])
        del model, hasher, tables, sums
        give_back()

    out = summed(docs.coalesce(tasks).mapInPandas(run, PARTS), tasks, [width])[0]
    sent.unpersist()
    return out


def fit(docs: DataFrame, learn: Column, *, text: str = "text") -> tuple[Model, DataFrame]:
    """The model and the table of all token counts, from the documents where ``learn`` holds."""
    bounded_batches(docs.sparkSession)
    train = docs.where(learn).select(text_bytes(F.col(text)).alias("raw"))
    counts = durable(token_counts(train), "token-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    endings = counts.groupBy("ending").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).toPandas()  # ENDINGS rows
    # the tokens above the least level of counts (sixteen levels a doubling) that leaves at most COMMON of them
    level = F.floor(F.log2(F.col("c")) * 16).cast("int")
    levels = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("level", ascending=False)
    low = levels["level"][levels["n"].cumsum() <= COMMON]
    common = counts.where(level >= int(low.min() if len(low) else 2**30)).toPandas().sort_values(["c", "token"], ascending=[False, True])
    model = class_layout(endings, common, total, distinct)
    model.offsets = tree_offsets(leaf_masses(counts, model))
    # merged tasks keep what is sent in proportion to the input
    tasks = max(LEAST_TASKS, total // (TOKENS_A_NUMBER * len(model.word_weights)))
    seen_classes, word_sums, bend, contexts = first_round(train, model, tasks)
    seen, share = seen_classes.sum(1), model.mass / model.mass.sum()
    size = contexts.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()[0]
    step(model, seen_classes - seen[:, None] * share, seen)
    for _ in range(CLASS_ROUNDS - 1):
        step(model, seen_classes - class_round(contexts, model, max(LEAST_TASKS, size // CONTEXT_BYTES)), seen)
    word_step(model, word_sums, bend)
    for _ in range(WORD_ROUNDS - 1):
        word_step(model, word_round(train, model, tasks), bend)
    return model, counts


def leaf_masses(counts: DataFrame, model: Model) -> np.ndarray:
    """Counts plus a half a token by class and leaf, of the classes that hold more than one word."""
    own = counts.sparkSession.createDataFrame([(k, int(c)) for k, c in enumerate(model.class_of_ending)], "ending int, class int")
    leaf = F.shiftrightunsigned("token", 64 - DEPTH).cast("int")
    inside = counts.where(~F.col("token").isin([int(x) for x in model.own])) if len(model.own) else counts
    rows = inside.join(F.broadcast(own), "ending").groupBy("class", leaf.alias("leaf")).agg(F.sum(F.col("c") + 0.5).alias("mass")).toPandas()  # at most a leaf of each class
    out = np.zeros((CLASSES, 1 << DEPTH))
    out[rows["class"].to_numpy(np.int64), rows["leaf"].to_numpy(np.int64)] = rows["mass"].to_numpy(np.float64)
    return out


def score(docs: DataFrame, model: Model, counts: DataFrame, *, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_tokens, n_known, base_score, score (log10) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, hasher, done = sent.value, Hasher(), 0
        tables = model.tables()
        log_mass, leaves, task = np.log10(model.mass), model.leaf_logs(), TaskContext.get().partitionId()
        for batch in batches:
            if batch.empty:
                continue
            out = []
            for texts in portions(batch["raw"].tolist()):
                hashes, endings, lengths = hasher.of(texts)
                classes, buckets, counts = model.facts(hashes, endings, tables)
                features = model.features(classes, buckets, lengths)
                gain = model.log_probabilities(features, classes) / np.log(10) - log_mass[classes]
                there = counts >= 0
                word_gain = model.word_gains(hashes, classes, words_before(hashes, counts, lengths), leaves) / np.log(10)
                gain += np.where(counts > 0, word_gain, 0.0)
                logs = np.where(there, np.log10(np.maximum(counts, 0) + 0.5), 0.0)
                starts = np.cumsum(lengths) - lengths
                sums = [np.add.reduceat(x, starts) for x in ((counts > 0).astype(np.int64), logs, gain, (~there).astype(np.int64))]
                out.append((lengths, *sums, hashes[~there], word_gain[~there].astype(np.float32)))
            lengths, known, logs, gain, n_rare, rare, rare_gain = (np.concatenate(x) for x in zip(*out))
            cuts = np.cumsum(n_rare)[:-1]
            yield pd.DataFrame(
                {
                    "row": (np.int64(task) << 33) + done + np.arange(len(batch)), "id": batch["id"], "n_tokens": lengths, "n_known": known,
                    "logs": logs, "gain": gain, "rare": np.split(rare, cuts), "rare_gain": np.split(rare_gain, cuts),
                }
            )
            done += len(batch)
        del model, hasher, tables, leaves
        give_back()

    kind = dict(docs.dtypes)[id_column]
    rows = docs.select(F.col(id_column).cast("string").alias("id"), text_bytes(F.col(text)).alias("raw"))
    parts = durable(rows.mapInPandas(run, "row long, id string, n_tokens long, n_known long, logs double, gain double, rare array<long>, rare_gain array<float>"), "scored")
    met = parts.select("row", F.explode(F.arrays_zip("rare", "rare_gain")).alias("r")).select("row", F.col("r.rare").alias("token"), F.col("r.rare_gain").alias("g"))
    met = met.join(counts.select("token", "c"), "token", "left")
    # an unknown word stands beside the tree of its class
    known_gain = F.sum(F.when(F.col("c").isNotNull(), F.col("g").cast("double")).otherwise(0.0))
    met = met.groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("more"), F.count("c").alias("met"), known_gain.alias("more_gain"))
    whole = parts.drop("rare", "rare_gain").join(met, "row", "left").withColumn("logs", F.col("logs") + F.coalesce("more", F.lit(0.0))).withColumn("gain", F.col("gain") + F.coalesce("more_gain", F.lit(0.0)))
    base = F.col("logs") - F.col("n_tokens") * float(np.log10(model.total + 0.5 * (model.distinct + 1)))
    return whole.select(F.col("id").cast(kind).alias("id"), "n_tokens", (F.col("n_known") + F.coalesce("met", F.lit(0))).alias("n_known"), base.alias("base_score"), (F.col("logs") + F.col("gain")).alias("score"))
