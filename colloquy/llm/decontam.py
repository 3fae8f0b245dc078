"""Benchmark passages in documents, by CGK embedding and bit sampling, verified by edit distance.

A CGK embedding walks over a string: every step writes the byte under it, and a random bit that
depends on the step and that byte says whether to move on. Two strings a few edits apart fall
into step again after each edit, so their embeddings differ in few places; equality of sampled
places then finds them. Windows start, in items and documents alike, at the bytes whose next
GRAM_BYTES hash least among some SPREAD neighbours. The choice looks at nothing else, so it is the
same on both sides in any script, with or without spaces: each passage of SPREAD starts that is
copied as it is has one in common. Each common start is a trial in every table of every walk.
Walks are added until items that are edited at random, as much as is allowed, are met with the
target recall; one table more holds the windows' plain bytes, so that no exact passage depends
on chance. What meets is verified by exact edit distance against the whole item.

Benchmarks are made from templates: a window that many items share says little about any of
them. Such a place of a table names its items as one group, which meets a text once; the
distances of all its items are then taken together, item by item character in sorted order, so
that what items begin with alike is worked out once, and items go as soon as they are too far.
No item is left out of any place.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import materialise, qualified, scratch_path, small

#: Edits that a passage may have, as a share of the item's characters.
MOST_EDITS = 0.15
#: Items with fewer normalised characters are found only word by word as they are, or not at all.
SHORTEST = 16
#: Items in one place of a table from which on they are verified together.
CROWDED = 16
#: Characters after which items that are too far leave a group, words of bits that a group holds, and the share of regions that become one.
LEAVE = 8
GROUP_WORDS = 1 << 20
GROUP_SHARE = 0.6
#: Length of the character grams that rule out most chance meetings before the exact distance is taken.
GRAM = 5
#: Share of items with the most edits that walks are added for, by trial on TRIALS edited items of a class.
TARGET_RECALL = 0.98
TRIALS = 400
MOST_WALKS = 64
TABLES = 8
SAMPLED = 12
#: Bytes of a window, for items with room for ROOM of them; shorter items have the smaller ones.
WINDOWS = (8, 16, 32)
ROOM = 2
GRAM_BYTES = 4
SPREAD = 8
SEED = 5
#: Bytes of items in one index, which takes about 60 times as many; a larger benchmark is met in several passes.
INDEX_BYTES = 2_000_000
#: Bytes of documents that a task holds while it goes through several indexes.
PASS_BYTES = 32_000_000
#: Windows that walk together, and bytes of documents that are laid out together.
BLOCK = 1 << 14
SLICE_BYTES = 1_000_000
_P = np.uint64(0x9E3779B97F4A7C15)
#: Least number of bits that are looked up before a hash is searched for.
BITMAP = 18
#: Items whose grams a worker keeps.
KEPT_ITEMS = 4096


def normalise(text: str | None) -> str:
    """Lower case, with single spaces."""
    return " ".join((text or "").lower().split())


def edit_distance_within(pattern: str, text: str) -> int:
    """Least edit distance of the pattern to any part of the text, by bit-parallel columns."""
    if not pattern or pattern in text:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << len(pattern)) - 1, 1 << (len(pattern) - 1)
    up, down = full, 0  # where a column rises and falls by one
    score = best = len(pattern)
    for c in text:
        match = masks.get(c, 0)
        level = ((((match & up) + up) ^ up) | match | down) & full
        rise, fall = (down | ~(level | up)) & full, up & level
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        rise, fall = rise << 1 & full, fall << 1 & full  # no carry: the text may begin anywhere
        up, down = (fall | ~(level | rise)) & full, rise & level
        best = min(best, score)
    return best


@dataclass
class Table:
    """Hashes of one sampling of one walk, sorted, the entry of each, and which first bits they have.

    An entry is a window or, behind these, a place that a group shares.
    """

    steps: frozenset[int]
    hashes: np.ndarray
    entry: np.ndarray
    shift: np.uint64
    bitmap: np.ndarray

    def meetings(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``hashes`` and entries of the index with the same hash."""
        at = np.flatnonzero(self.bitmap.take((hashes >> self.shift).astype(np.int64)))
        low, high = (np.searchsorted(self.hashes, hashes[at], side=s) for s in ("left", "right"))
        many = high - low
        return np.repeat(at, many), self.entry[np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())]


@dataclass
class Group:
    """Items that share a place, by rank, and how far from the first one's beginning their regions reach."""

    ranks: np.ndarray
    before: int
    after: int
    step: int


@dataclass
class WindowClass:
    """Items of one window size: where their windows are, and their tables by walk, the plain bytes first.

    ``item`` and ``offset`` go on, behind the windows, with the groups as -1, -2, ... and the place in their first items.
    """

    size: int
    item: np.ndarray
    offset: np.ndarray
    moves: list[np.ndarray]  # for each walk: (steps, 256) bits
    tables: list[list[Table]]


def walked(data: np.ndarray, starts: np.ndarray, moves: np.ndarray, samples: list[frozenset[int]]) -> np.ndarray:
    """(samples, windows) hashes of the sampled places of one walk."""
    at = starts.astype(np.int64)
    found = np.zeros((len(samples), len(at)), np.uint64)
    last = max(map(max, samples))
    for step in range(last + 1):
        c = data.take(at)
        for k, steps in enumerate(samples):
            if step in steps:
                np.multiply(found[k], _P, out=found[k])
                np.add(found[k], c + np.uint64(1), out=found[k])
        at += moves[step].take(c)
    return found ^ (found >> np.uint64(31))


class PassageIndex:
    """Index of benchmark items, small enough to broadcast."""

    def __init__(self, items: list[tuple[int, str]], target_recall: float = TARGET_RECALL, tables: int = TABLES, sampled: int = SAMPLED, seed: int = SEED, most_edits: float = MOST_EDITS):
        self.most_edits = most_edits
        by_text: dict[str, set[int | None]] = {}
        for i, t in items:
            by_text.setdefault(normalise(t), set()).add(i)
        self.texts = list(by_text)
        self.ids = [sorted(i, key=lambda x: (x is None, x)) for i in by_text.values()]
        self.short = {t: k for k, t in enumerate(self.texts) if 0 < len(t) < SHORTEST}
        self.steps = np.array([max(1, int(most_edits * len(t) / 2)) for t in self.texts], np.int64)
        self.kept_grams: dict[int, set[str]] = {}
        self.allowed = np.array([int(most_edits * len(t)) for t in self.texts], np.int64)
        self.n_bytes = np.array([len(t.encode()) for t in self.texts], np.int64)
        self.lengths = np.array([len(t) for t in self.texts], np.int64)
        # Room for the edits and for the rounding of the place, in bytes.
        self.slack = (self.allowed + self.allowed // 2 + 4) * self.n_bytes // np.maximum(1, self.lengths) + 8
        self.sort_texts()
        self.groups: list[Group] = []
        known: dict[tuple[bytes, bytes], int] = {}
        by_size: dict[int, list[int]] = {}
        for k, text in enumerate(self.texts):
            if len(text) >= SHORTEST:
                by_size.setdefault(self.window_size(text), []).append(k)
        rng = np.random.default_rng(seed)
        self.classes = []
        for size, members in sorted(by_size.items()):
            data, begins = laid_out([self.texts[k].encode() for k in members], 2 * size)
            start = window_starts(data)
            owner = np.searchsorted(begins, start, side="right") - 1
            whole = begins[owner + 1] - 1 - start >= size
            owner, start = owner[whole], start[whole]
            own = WindowClass(size, np.array(members, np.int32)[owner], (start - begins[owner]).astype(np.int32), [], [])
            self.classes.append(own)
            self.add_walk(own, data, start, np.ones((size, 256), np.int8), [frozenset(range(size))], known)
            # Walks until the target is reached, on items with the most edits at random.
            tried = [int(k) for k in rng.choice(members, TRIALS)]
            edited = [edited_at_random(self.texts[k], int(most_edits * len(self.texts[k])), rng) for k in tried]
            place = laid_out([t.encode() for t in edited], 2 * size)
            seen = np.zeros(TRIALS, bool)
            while True:
                text, item, _ = self.met(own, len(own.moves) - 1, *place, window_starts(place[0]))
                for text, item in np.unique(np.stack([text, item]), axis=1).T.tolist():
                    seen[text] |= item == tried[text] if item >= 0 else self.rank[tried[text]] in self.groups[-1 - item].ranks
                if seen.mean() >= target_recall or len(own.moves) > MOST_WALKS:
                    break
                steps = size + size // 2  # moves over three quarters of the window, give or take
                samples = [frozenset(rng.choice(steps, min(sampled, steps // 2), replace=False).tolist()) for _ in range(tables)]
                self.add_walk(own, data, start, rng.integers(0, 2, (steps, 256)).astype(np.int8), samples, known)

    def sort_texts(self) -> None:
        """The items' ranks by text, with the characters that each shares with the one before it."""
        self.order = np.array(sorted(range(len(self.texts)), key=self.texts.__getitem__), np.int64)
        self.rank = np.argsort(self.order)
        points = np.frombuffer("".join(self.texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.alphabet, self.codes = np.unique(points, return_inverse=True)
        self.codes = self.codes.astype(np.int32)
        self.begin = np.cumsum(self.lengths) - self.lengths
        self.shared = np.full(len(self.texts), -1, np.int64)
        for r in range(1, len(self.order)):
            a, b = self.order[r - 1], self.order[r]
            n = min(self.lengths[a], self.lengths[b])
            other = self.codes[self.begin[a] : self.begin[a] + n] != self.codes[self.begin[b] : self.begin[b] + n]
            self.shared[r] = other.argmax() if other.any() else n

    def add_walk(self, own: WindowClass, data: np.ndarray, start: np.ndarray, moves: np.ndarray, samples: list[frozenset[int]], known: dict[tuple[bytes, bytes], int]) -> None:
        bits = max(BITMAP, (4 * len(start)).bit_length())
        made = []
        for s, hashes in zip(samples, walked(data, start, moves, samples), strict=True):
            full = crowded(hashes, own.item[: len(start)])
            places, entries = np.split(np.flatnonzero(full)[np.argsort(hashes[full], kind="stable")], np.flatnonzero(np.diff(np.sort(hashes[full]))) + 1), []
            for windows in places if full.any() else ():
                entries.append((hashes[windows[0]], *self.group(own.item[windows], own.offset[windows], known)))
            kept = np.flatnonzero(~full)
            every = np.concatenate([hashes[kept], np.array([e[0] for e in entries], np.uint64)])
            entry = np.concatenate([kept, len(own.item) + np.arange(len(entries))])
            own.item = np.concatenate([own.item, np.array([-1 - e[1] for e in entries], np.int32)])
            own.offset = np.concatenate([own.offset, np.array([e[2] for e in entries], np.int32)])
            order, shift = np.argsort(every, kind="stable"), np.uint64(64 - bits)
            bitmap = np.zeros(1 << bits, bool)
            bitmap[(every >> shift).astype(np.int64)] = True
            made.append(Table(s, every[order], entry[order].astype(np.int32), shift, bitmap))
        own.moves.append(moves)
        own.tables.append(made)

    def group(self, item: np.ndarray, offset: np.ndarray, known: dict[tuple[bytes, bytes], int]) -> tuple[int, int]:
        """The group of these items with these distances between their places, and the place in the first item."""
        order = np.lexsort((offset, item))
        item, offset = item[order], offset[order].astype(np.int64)
        base = int(offset[0])
        key = item.tobytes(), (offset - base).tobytes()
        if key not in known:
            known[key] = len(self.groups)
            before = int((offset - base + self.slack[item]).max())
            after = int((self.n_bytes[item] - (offset - base) + self.slack[item]).max())
            self.groups.append(Group(np.unique(self.rank[item]), before, after, int(self.steps[item].min())))
        return known[key], base

    @staticmethod
    def window_size(text: str) -> int:
        """The largest size of which the item has room for ROOM windows."""
        return max((w for w in WINDOWS if ROOM * w <= len(text.encode())), default=WINDOWS[0])

    def matches(self, texts: list[str | None], short: bool = True) -> list[tuple[int, int, int]]:
        """(text, item, edits) of all items found in the texts, each pair once with its least distance."""
        whole = [normalise(t) for t in texts]
        found = self.short_matches(whole) if short and self.short else {}
        normal = [t.encode("utf-8", "replace") for t in whole]
        i = 0
        while i < len(normal):
            stop, size = i + 1, len(normal[i])
            while stop < len(normal) and size + len(normal[stop]) <= SLICE_BYTES:
                size += len(normal[stop])
                stop += 1
            alone: dict[int, list[tuple[int, int]]] = {}
            together: dict[int, list[tuple[int, int]]] = {}
            for text, item, at in self.candidates(normal[i:stop]):
                (alone if item >= 0 else together).setdefault(i + text, []).append((item, at))
            for text in sorted({*alone, *together}):
                own = normal[text]
                done = np.full((2, len(self.texts) if text in together else 0), -1, np.int64)
                for item, edits in self.verified_together(own, together.get(text, []), done):
                    found[text, item] = min(edits, found.get((text, item), edits))
                for item, at in alone.get(text, ()):
                    start, end = self.region(own, item, at)
                    held = text in together and done[0, self.rank[item]] <= start and end <= done[1, self.rank[item]]
                    if not held and found.get((text, item)) != 0:
                        edits = self.verified(own[start:end], item)
                        if edits is not None:
                            found[text, item] = min(edits, found.get((text, item), edits))
            i = stop
        return [(text, item, edits) for (text, item), edits in sorted(found.items())]

    def short_matches(self, whole: list[str]) -> dict[tuple[int, int], int]:
        """The short items that stand in the texts as whole words."""
        words = ahocorasick.Automaton()
        for text, k in self.short.items():
            words.add_word(f" {text} ", k)
        words.make_automaton()
        return {(i, k): 0 for i, text in enumerate(whole) for _, k in words.iter(f" {text} ")}

    def candidates(self, normal: list[bytes]) -> set[tuple[int, int, int]]:
        """(text, item, place where the item would begin), places in steps of the edits allowed; groups as -1, -2, ..."""
        data, begins = laid_out(normal, 2 * max((c.size for c in self.classes), default=0))
        starts = window_starts(data)
        parts = [np.zeros((3, 0), np.int64)]
        for own in self.classes:
            for walk in range(len(own.moves)):
                parts.append(np.unique(np.stack(self.met(own, walk, data, begins, starts)), axis=1))
        return {tuple(x) for x in np.concatenate(parts, axis=1).T.tolist()}

    def met(self, own: WindowClass, walk: int, data: np.ndarray, begins: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(texts, items or groups, places) of what meets in one walk."""
        tables, found = own.tables[walk], []
        for b in range(0, len(starts), BLOCK):
            block = starts[b : b + BLOCK]
            for table, hashes in zip(tables, walked(data, block, own.moves[walk], [t.steps for t in tables]), strict=True):
                at, entries = table.meetings(hashes)
                found.append((block[at], entries))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        at, entries = (np.concatenate(x) for x in zip(*found, strict=True))
        text, item = np.searchsorted(begins, at, side="right") - 1, own.item[entries].astype(np.int64)
        step = np.where(item < 0, 1, self.steps[item])
        if self.groups:
            step = np.where(item < 0, np.array([g.step for g in self.groups])[np.where(item < 0, -1 - item, 0)], step)
        return text, item, (at - begins[text] - own.offset[entries]) // step * step

    def grams(self, item: int) -> set[str]:
        if item not in self.kept_grams:
            if len(self.kept_grams) >= KEPT_ITEMS:
                self.kept_grams.clear()
            text = self.texts[item]
            self.kept_grams[item] = {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}
        return self.kept_grams[item]

    def region(self, normal: bytes, item: int, at: int) -> tuple[int, int]:
        """Where to look for an item that would begin there."""
        slack = int(self.slack[item])
        return max(0, at - slack), min(len(normal), max(0, at) + int(self.n_bytes[item]) + slack)

    def verified(self, part: bytes, item: int) -> int | None:
        text, allowed = self.texts[item], int(self.allowed[item])
        region = part.decode("utf-8", "ignore")
        # An edit spoils at most GRAM of the item's grams.
        if len(self.grams(item).difference([region[i : i + GRAM] for i in range(len(region))])) > GRAM * allowed:
            return None
        edits = edit_distance_within(text, region)
        return edits if edits <= allowed else None

    def verified_together(self, normal: bytes, met: list[tuple[int, int]], done: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item, edits) of the groups' items that are near enough to the text at the places where the groups met it.

        Regions that are mostly the same are made one. ``done`` is told where each item, by rank, was last looked for.
        """
        regions: list[tuple[int, int, list[int]]] = []
        reach = [(max(0, at - own.before - own.step), min(len(normal), max(0, at) + own.after + own.step), -1 - g) for g, at in met for own in [self.groups[-1 - g]]]
        for start, stop, g in sorted(x for x in reach if x[0] < x[1]):
            if regions:
                first, last, inside = regions[-1]
                # Neither gets much longer by it.
                if GROUP_SHARE * (max(stop, last) - first) <= min(stop - start, last - first):
                    regions[-1] = first, max(stop, last), [*inside, g]
                    continue
            regions.append((start, stop, [g]))
        # Items of several regions are looked for once in one that holds the others.
        for start, stop, inside in sorted(regions, key=lambda r: (r[0] - r[1], r[0])):
            ranks = np.unique(np.concatenate([self.groups[g].ranks for g in set(inside)]))
            ranks = ranks[(done[0, ranks] > start) | (done[1, ranks] < stop)]
            done[0, ranks], done[1, ranks] = start, stop
            region = normal[start:stop].decode("utf-8", "ignore")
            most = max(1, GROUP_WORDS // (len(region) // 64 + 1))
            for k in range(0, len(ranks), most):
                edits = self.edits_together(ranks[k : k + most], region)
                near = np.flatnonzero(edits >= 0)
                yield from zip(self.order[ranks[k + near]].tolist(), edits[near].tolist(), strict=True)

    def edits_together(self, ranks: np.ndarray, region: str) -> np.ndarray:
        """Least edit distance of each item, by ascending rank, to any part of the region; -1 if more than allowed.

        Bits go along the region and steps along the items; items that begin alike share a state.
        """
        items = self.order[ranks]
        begin, length, allowed = self.begin[items], self.lengths[items], self.allowed[items]
        masks, local = self.masks(region)
        result = np.full(len(items), -1, np.int64)
        alive, shared = np.arange(len(items)), thinned(self.shared, ranks)
        node, up, down = np.zeros(len(items), np.int64), *np.zeros((2, len(masks), 1), np.uint64)
        step, left = 0, False
        while len(alive):
            new = shared <= step
            first = np.flatnonzero(new)
            if left or len(first) != up.shape[1]:
                up, down = up[:, node[first]], down[:, node[first]]
                node, left = np.cumsum(new) - 1, False
            up, down = advanced(up, down, masks[:, local[self.codes[begin[alive[first]] + step]]])
            step += 1
            ends = length[alive] == step
            if ends.any():
                at = np.flatnonzero(ends)
                edits = step + lowest(up[:, node[at]], down[:, node[at]])
                result[alive[at]] = np.where(edits <= allowed[alive[at]], edits, -1)
            if step % LEAVE == 0:
                ends |= (step + lowest(up, down))[node] > allowed[alive]
            if ends.any():
                kept, left = np.flatnonzero(~ends), True
                alive, node, shared = alive[kept], node[kept], thinned(shared, kept)
        return result

    def masks(self, region: str) -> tuple[np.ndarray, np.ndarray]:
        """(words, characters) bits of where each character is in the region, and the column of each letter of the alphabet; 0 is nowhere."""
        points = np.frombuffer(region.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        places = np.flatnonzero(self.alphabet[at] == points)
        letters, column = np.unique(at[places], return_inverse=True)
        local = np.zeros(len(self.alphabet), np.int32)
        local[letters] = np.arange(1, len(letters) + 1)
        masks = np.zeros((len(points) // 64 + 1, len(letters) + 1), np.uint64)
        np.bitwise_or.at(masks, (places >> 6, column + 1), np.uint64(1) << (places & 63).astype(np.uint64))
        return masks, local


def thinned(shared: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Characters that each kept text shares with the kept one before it, from those of neighbours."""
    if not len(kept):
        return shared[:0]
    found = np.minimum.reduceat(shared[: kept[-1] + 1], np.concatenate([[0], kept[:-1] + 1]))
    found[0] = -1
    return found


def advanced(up: np.ndarray, down: np.ndarray, match: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the next rows of (words, states) distances rise and fall by one along the region."""
    level, carry = match & up, np.zeros(up.shape[1], np.uint64)
    for own, word in zip(level, up, strict=True):
        own += word
        over = own < word
        own += carry
        carry = (over | (own < carry)).astype(np.uint64)
    level ^= up
    level |= match
    either = np.bitwise_or(match, down, out=match)
    fall = up & level
    rise = np.bitwise_or(level, up, out=level)
    np.invert(rise, out=rise)
    rise |= down
    top, one = np.uint64(63), np.uint64(1)
    rise_in, fall_in = rise[:-1] >> top, fall[:-1] >> top
    rise <<= one
    fall <<= one
    rise[0] |= one  # leaving out an item's character costs one
    rise[1:] |= rise_in
    fall[1:] |= fall_in
    new = either | rise
    np.invert(new, out=new)
    new |= fall
    return new, np.bitwise_and(rise, either, out=rise)


@cache
def byte_sums() -> tuple[np.ndarray, np.ndarray]:
    """For each byte of rises and byte of falls their sum, and the least sum on the way."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int8)
    sums = np.cumsum(bits[:, None, :] - bits[None, :, :], axis=2, dtype=np.int8).reshape(1 << 16, 8)
    return sums[:, -1].copy(), sums.min(axis=1)


def lowest(up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """Least distance of each state's row, against that of its beginning."""
    total, least = byte_sums()
    at = np.ascontiguousarray(up.T).view(np.uint8).astype(np.uint16) << np.uint16(8) | np.ascontiguousarray(down.T).view(np.uint8)
    sums = total[at].astype(np.int32)
    return np.minimum(0, (np.cumsum(sums, axis=1) - sums + least[at]).min(axis=1))


def crowded(hashes: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Which windows have a hash that windows of more than CROWDED items have."""
    _, place = np.unique(hashes, return_inverse=True)
    each = np.unique(place * (int(item.max(initial=0)) + 1) + item)
    return np.bincount(each // (int(item.max(initial=0)) + 1))[place] > CROWDED if len(place) else np.zeros(0, bool)


def laid_out(texts: list[bytes], room: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, each text ended by a zero, with room after the last; and where each begins, and the end."""
    data = np.frombuffer(b"\0".join(texts) + bytes(room + GRAM_BYTES + 1), np.uint8)
    return data, np.cumsum([0, *(len(t) + 1 for t in texts)])


def window_starts(data: np.ndarray) -> np.ndarray:
    """Places, of bytes that are not zero, whose next GRAM_BYTES hash least in some run of SPREAD places."""
    n = len(data) - GRAM_BYTES + 1
    gram = np.zeros(n, np.uint32)
    for k in range(GRAM_BYTES):
        gram = gram << np.uint32(8) | data[k : k + n]
    gram = (gram ^ gram >> np.uint32(15)) * np.uint32(0x9E3779B1)
    gram ^= gram >> np.uint32(16)
    edge = np.full(SPREAD - 1, np.iinfo(np.uint32).max, np.uint32)
    least, width = np.concatenate([edge, gram, edge]), 1
    while width < SPREAD:  # least of the run that begins at each place
        more = min(width, SPREAD - width)
        least, width = np.minimum(least[:-more], least[more:]), width + more
    width = 1
    while width < SPREAD:  # greatest of these in the runs that hold each place
        more = min(width, SPREAD - width)
        least, width = np.maximum(least[:-more], least[more:]), width + more
    return np.flatnonzero((gram == least) & (data[:n] != 0))


def edited_at_random(text: str, edits: int, rng: np.random.Generator) -> str:
    """The text with so many characters replaced, left out or put in."""
    found = list(text)
    for _ in range(edits):
        at, kind, other = int(rng.integers(len(found))), int(rng.integers(3)), text[rng.integers(len(text))]
        found[at : at + (kind != 2)] = [other] * (kind != 1)
    return "".join(found)


@dataclass
class Passages:
    """The indexes of a benchmark: none, one that is broadcast, or files of the shared folder that tasks load one by one."""

    shared: Broadcast | None
    files: list[str]

    def each(self) -> Iterator[PassageIndex]:
        if self.shared is not None:
            yield self.shared.value
        for uri in self.files:
            system, path = pafs.FileSystem.from_uri(uri)
            with system.open_input_stream(path) as found:
                yield pickle.loads(found.read())

    def held(self, batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
        """Batches that go through the indexes together: of bounded size, and one by one if there is one index."""
        kept, size = [], 0
        for batch in batches:
            kept.append(batch)
            size += batch.nbytes
            if size >= PASS_BYTES or not self.files:
                yield kept
                kept, size = [], 0
        if kept:
            yield kept


def passages(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", **options) -> Passages:
    """Indexes over all items, each of a bounded part of the benchmark; if there are several, tasks make and write them."""
    spark = benchmark.sparkSession
    items = benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // INDEX_BYTES)

    def made(rows: list[tuple[int | None, str]]) -> PassageIndex:
        return PassageIndex(sorted(rows, key=lambda x: (x[0] is None, *x)), **options)

    if parts <= 1:
        return Passages(spark.sparkContext.broadcast(made([tuple(r) for r in items.collect()])) if parts else None, [])
    folder = qualified(spark, scratch_path(spark))

    def write(rows: pa.Table) -> pa.Table:
        index = made(list(zip(rows["item_id"].to_pylist(), rows["text"].to_pylist(), strict=True)))
        system, base = pafs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        # A task that runs again writes a file of its own; the one that Spark takes the name from is read.
        name = uuid.uuid4().hex
        with system.open_output_stream(f"{base}/{name}") as out:
            out.write(pickle.dumps(index))
        return pa.table({"uri": [f"{folder}/{name}"]})

    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    written = materialise(items.withColumn("part", part).repartition(parts, "part").groupBy("part").applyInArrow(write, "uri string"))
    return Passages(None, sorted(r.uri for r in written.collect()))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", short: bool = True, **options) -> DataFrame:
    """Rows (doc_id, item_id, edits, item_chars): each benchmark item found in each document.

    Texts are compared in lower case with single spaces; up to MOST_EDITS edits a character of
    the item count as found. Items of fewer than SHORTEST characters are found where they stand as
    whole words, unless ``short`` is false. Null and empty texts hold nothing; null and empty items
    are never found, repeated ones count once. A benchmark of one index is broadcast; a larger one is
    met in passes inside each task, which holds one index at a time. The documents are only read:
    repeated rows each give their rows, and null ids need no care.
    """
    indexes = passages(benchmark, **options)
    schema = "doc_id long, item_id long, edits int, item_chars int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in indexes.held(batches):
            for own in indexes.each():
                for batch in held:
                    matches = [(text, i, edits, item) for text, item, edits in own.matches(batch.column(1).to_pylist(), short) for i in own.ids[item]]
                    ids = batch.column(0).take(pa.array([m[0] for m in matches], pa.int64()))
                    columns = [pa.array([m[1] for m in matches], pa.int64()), pa.array([m[2] for m in matches], pa.int32()), pa.array([len(own.texts[m[3]]) for m in matches], pa.int32())]
                    yield pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", "item_id", "edits", "item_chars"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", short: bool = False, **options) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no benchmark item; rules as in ``find_leaks``.

    Items of a word or two are no evidence of a leak: they are looked for only if ``short`` is true.
    """
    indexes, place = passages(benchmark, **options), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in indexes.held(small(batches)):
            keep = [np.ones(batch.num_rows, bool) for batch in held]
            for own in indexes.each():
                for kept, batch in zip(keep, held, strict=True):
                    left = np.flatnonzero(kept)
                    found = own.matches(batch.column(place).take(pa.array(left)).to_pylist(), short)
                    kept[left[np.array([m[0] for m in found], np.int64)]] = False
            for kept, batch in zip(keep, held, strict=True):
                yield batch.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
