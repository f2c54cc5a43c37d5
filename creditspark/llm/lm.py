"""Language-model scores: logistic context mixing over all bytes of the texts, and a base of word counts."""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditspark.llm.text import BLANKS_TO_SPACE, LOWER_BYTES, ROWS, materialise, words

#: Bytes of context that predictors look back on, across word ends. Three more know the last two bytes and the text's
#: group, the bytes of the word so far, and these with the word before.
ORDERS = (4,)
PREDICTORS = len(ORDERS) + 3
#: Each predictor has 2 ** SLOT_BITS counters, one for a context and a node of the byte's code.
SLOT_BITS = 20
#: What a counter has before it counts, the step of the online learning, and how finely probabilities are refined.
PRIOR, RATE, BINS, REACH, FINE = 0.4, 0.02, 24, 8.0, 16
#: Bytes whose contexts are made and mixed at a time, and up to twice as many; bytes of text that one learning task sees.
STEP, TASK_BYTES = 32768, 64_000_000
#: Texts of more bytes are cut; a piece starts with so many bytes of the piece before it as context.
PIECE, LEAD = 1 << 16, 64
#: A text's group is guessed from its first bytes, up to so many; they themselves are foretold without one.
GUESS = 64
#: Slots that travel together.
CHUNK = 1 << 16
#: The most frequent words, at most so many and each at most so long, are broadcast and looked up in the map task. All
#: others are joined.
HOT, HOT_BYTES = 200_000, 64
#: The largest groups of texts are told apart, up to so many.
GROUPS = 8
#: Words, and bytes of them, that a task holds before it counts and sends them.
REMEMBERED, HELD_BYTES = 2_000_000, 32_000_000
#: The token that ends every text, and the byte that ends every word: neither stands in a word.
END, STOP = b"\n", b" "
LOWER_TO_SPACE = LOWER_BYTES.translate(BLANKS_TO_SPACE)
#: The pair of bytes before the first byte of any word; only the most frequent pairs have a code of their own.
START, PAIRS = STOP[0] * 257, 1024
MIX, BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
UNBASE = np.uint64(pow(int(BASE), -1, 1 << 64))


def squash(x):
    return 1 / (1 + np.exp(-x))


class Code:
    """Bits for a byte: a Huffman tree for each pair of bytes before it; eight bits each, highest first, where nothing is known.

    counts: (pair, byte, how often) of the pairs that have a tree. A byte that never followed its pair has the eight bits behind
    an escape; the little that an escape says of the other bytes is lost, so bytes sum to one or slightly less. Nothing
    before a word's first byte is looked at.
    """

    def __init__(self, pairs: np.ndarray | None = None, after: np.ndarray | None = None, n: np.ndarray | None = None):
        plain = [[(256 | 1 << k | byte >> (8 - k), byte >> (7 - k) & 1) for k in range(8)] for byte in range(256)]
        lengths, steps = [], []

        def keep(paths: list[list[tuple[int, int]]]) -> None:
            # a step of a path: its node, nine bits; its place in the path, three; the bit. Packed at once: the lists are large
            lengths.append([len(p) for p in paths])
            steps.append(np.array([node << 4 | min(depth, 7) << 1 | bit for p in paths for depth, (node, bit) in enumerate(p)], dtype=np.int16))

        keep(plain)
        self.tree = np.zeros(1 << 16, dtype=np.int64)
        for pair in [] if pairs is None else np.unique(pairs).tolist():
            self.tree[pair] = 256 * len(lengths)
            own = self.huffman(dict(zip(after[pairs == pair].tolist(), n[pairs == pair].tolist(), strict=True)))
            keep([own[byte] if byte in own else own[256] + plain[byte] for byte in range(256)])
        self.length, self.steps = np.array(lengths).reshape(-1), np.concatenate(steps)
        self.start = np.cumsum(self.length) - self.length

    @staticmethod
    def huffman(counts: dict[int, int]) -> dict[int, list[tuple[int, int]]]:
        """(node, bit) down to each byte, and to the escape, which is 256. Nodes are numbered from the root, which is 0."""
        # scaled, so that no path is long
        total = sum(counts.values())
        heap = [(1, 256, 256), *((1 + (v << 20) // total, byte, byte) for byte, v in counts.items())]
        heapq.heapify(heap)
        children, node, root = {}, 256, 256 + len(counts)
        while len(heap) > 1:
            (v, _, a), (w, _, b) = heapq.heappop(heap), heapq.heappop(heap)
            node += 1
            children[node] = a, b
            heapq.heappush(heap, (v + w, node, node))
        paths, open_ = {}, [(node, [])]
        while open_:
            node, path = open_.pop()
            for bit, child in enumerate(children[node]):
                further = [*path, (root - node, bit)]
                if child <= 256:
                    paths[child] = further
                else:
                    open_.append((child, further))
        return paths


PLAIN = Code()
POWERS = [np.ones(1, dtype=np.uint64)] * 2


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of BASE and of its inverse, made once for all texts of a task."""
    if len(POWERS[0]) < n:
        for k, x in enumerate((BASE, UNBASE)):
            made = np.full(max(n, 2 * PIECE), x)
            made[0] = 1
            POWERS[k] = np.cumprod(made)
    return POWERS[0][:n], POWERS[1][:n]


class Spelling:
    """Rows of bytes with the context that each predictor has for every byte.

    No context reaches back beyond its row. groups: a number for each row, 0 for none, which acts from byte `GUESS` of the
    text on; leads: the bytes at a row's start that are context alone.
    """

    def __init__(self, raw: list[bytes], groups: list[int] | None = None, leads: list[int] | None = None, code: Code = PLAIN):
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        codes = np.frombuffer(b"".join(raw), dtype=np.uint8)
        n = len(codes)
        starts = np.cumsum(sizes) - sizes
        wide = codes.astype(np.uint64)
        last = np.zeros(n, dtype=np.uint64)
        contexts = {}
        for back in range(1, max(ORDERS) + 1):
            seen = np.zeros(n, dtype=np.uint64)
            np.left_shift(wide[:-back], np.uint64(8 * (back - 1)), out=seen[back:])
            for k in range(back):
                seen[starts[sizes > k] + k] = 0
            last |= seen
            contexts[back] = last.copy() if back in (2, *ORDERS) else None
        contexts[2][starts[sizes > 1] + 1] |= np.uint64(STOP[0] << 8)
        # a word's bytes so far, as a polynomial in BASE: sums up to a byte less the sums up to the word's start
        power, back_power = powers(n)
        sums = np.zeros(n + 1, dtype=np.uint64)
        wide += np.uint64(1)
        wide *= power
        np.cumsum(wide, out=sums[1:])
        first = np.zeros(n, dtype=bool)
        np.equal(codes[:-1], STOP[0], out=first[1:])
        first[starts[sizes > 0]] = True
        begins = np.flatnonzero(first)
        ends = np.append(begins[1:], n)
        whole = (sums[ends] - sums[begins]) * back_power[begins]
        previous = np.zeros(len(begins), dtype=np.uint64)
        previous[1:] = whole[:-1]
        previous[np.isin(begins, starts[sizes > 0], assume_unique=True)] = 0
        # of the word that a byte is in: what its sums start from, their power, and the word before
        word = np.cumsum(first) - 1
        so_far = sums[:-1] - sums[begins][word]
        so_far *= back_power[begins][word]
        lead = np.zeros(len(raw), dtype=np.int64) if leads is None else np.array(leads, dtype=np.int64)
        hashed = [contexts[2].copy(), *(contexts[order] for order in ORDERS), so_far, so_far + ((previous + np.uint64(1)) * MIX)[word]]
        if groups is not None:
            group = np.repeat(np.array(groups, dtype=np.uint64) << np.uint64(32), sizes)
            for start, size, led in zip(starts.tolist(), sizes.tolist(), lead.tolist(), strict=True):
                if not led:
                    group[start : start + min(GUESS, size)] = 0
            hashed[0] |= group
        self.hashes = [self.spread(h + np.uint64(k + 1 << 60)) for k, h in enumerate(hashed)]
        pair = contexts[2].astype(np.int64)
        pair[begins] = START
        self.keys = code.tree[pair]
        self.keys += codes
        self.code, self.sizes = code, sizes - lead
        if lead.any():
            counted_ = np.arange(n) - np.repeat(starts, sizes) >= np.repeat(lead, sizes)
            self.hashes, self.keys = [h[counted_] for h in self.hashes], self.keys[counted_]

    @staticmethod
    def spread(h: np.ndarray) -> np.ndarray:
        """The counter of a context's first node."""
        h ^= h >> np.uint64(32)
        h *= MIX
        h ^= h >> np.uint64(29)
        h *= BASE
        h >>= np.uint64(64 - SLOT_BITS)
        return h.view(np.int64)

    def parts(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
        """For some bytes at a time: the bits of each byte's code, their number, their depth, and each predictor's counters.

        A context's nodes lie around its first one, the frequent ones next to it, so that a byte's counters share a cache line.
        """
        n = len(self.keys)
        step = -(-n // max(1, n // STEP)) or 1
        for at in range(0, n, step):
            keys = self.keys[at : at + step]
            length = self.code.length[keys]
            stops = np.cumsum(length)
            of = np.zeros(stops[-1], dtype=np.int64)
            of[stops[:-1]] = 1
            of = np.cumsum(of)
            path = (self.code.start[keys] - stops + length)[of]
            path += np.arange(len(path))
            steps = self.code.steps[path]
            node = (steps >> np.int16(4)).astype(np.int64)
            slots = []
            for h in self.hashes:
                slot = h[at : at + step][of]
                slot ^= node
                slots.append(slot)
            steps = steps.astype(np.int8)
            yield steps & np.int8(1), length, steps >> np.int8(1) & np.int8(7), slots


def ended(tokens: list[bytes]) -> Spelling:
    """Each token and its end, as a row of its own."""
    return Spelling([t + END for t in tokens])


class Mixer:
    """Gated weights over the predictors, and the table that refines the mixed probability.

    The gate is the number of predictors that have an opinion and the bit's place in its code;
    it chooses a set of weights, and a row of the refining table, which is read
    between the two bins next to the probability. The result is the mean of both.
    """

    SETS = (PREDICTORS + 1) * 8

    def __init__(self, weights: np.ndarray | None = None, table: np.ndarray | None = None):
        self.weights = np.full((PREDICTORS, self.SETS), 0.35) if weights is None else weights
        even = squash(np.linspace(-REACH, REACH, BINS))
        self.table = np.tile(even, (self.SETS, 1)) if table is None else table

    def gate(self, depth: np.ndarray, x: list[np.ndarray]) -> np.ndarray:
        met = np.zeros(len(depth), dtype=np.int8)
        for one in x:
            met += one != 0
        return (met * np.int8(8) + depth).astype(np.int64)

    def mix(self, x: list[np.ndarray], gate: np.ndarray) -> tuple[np.ndarray, ...]:
        """The mixed probability of a one, the bin of the refining table below it, and how near the one above is."""
        weights = (self.weights / FINE).astype(np.float32)
        dot = np.zeros(len(gate), dtype=np.float32)
        for one, w in zip(x, weights, strict=True):
            share = w[gate]
            share *= one
            dot += share
        np.clip(dot, -REACH, REACH, out=dot)
        share = dot + np.float32(REACH)
        share *= np.float32((BINS - 1) / (2 * REACH))
        low = np.minimum(share.astype(np.int32), np.int32(BINS - 2))
        share -= low.astype(np.float32)
        cell = gate * BINS
        cell += low
        return squash(dot), cell, share

    def refine(self, mixed: np.ndarray, cell: np.ndarray, share: np.ndarray) -> np.ndarray:
        """The probability of a one."""
        table = self.table.reshape(-1).astype(np.float32)
        share *= np.diff(table, append=table[-1:])[cell]
        share += table[cell]
        share += mixed
        share *= np.float32(0.5)
        return np.clip(share, 1e-6, 1 - 1e-6, out=share).astype(np.float64)

    def learn(self, x: list[np.ndarray], gate: np.ndarray, mixed: np.ndarray, cell: np.ndarray, bit: np.ndarray) -> None:
        """One step against the coding error, for all sets that the bits used."""
        error = (bit - mixed) / np.float32(FINE)
        zeros, ones = np.bincount(cell * 2 + bit, minlength=2 * self.SETS * BINS).reshape(-1, 2).T
        met = zeros + ones
        used = met.reshape(self.SETS, BINS).sum(axis=1)
        scale = RATE * np.sqrt(np.maximum(used, 1)) / np.maximum(used, 1)
        for w, one in zip(self.weights, x, strict=True):
            w += scale * np.bincount(gate, weights=error * one, minlength=self.SETS)
        pull = 1.0 - (1.0 - RATE) ** met
        flat = self.table.reshape(-1)
        flat += pull * (np.where(met > 0, ones / np.maximum(met, 1), flat) - flat)


def opinions(tables: np.ndarray) -> list[np.ndarray]:
    """The logarithm of each counter's odds in steps of a sixteenth: a byte each, so that the caches hold them."""
    said = np.empty(tables.shape[:2], dtype=np.int8)
    for table, out in zip(tables, said, strict=True):
        for at in range(0, len(table), STEP):
            some = table[at : at + STEP].astype(np.float32)
            some += np.float32(PRIOR)
            odds = np.log(some[:, 1] / some[:, 0])
            odds *= np.float32(FINE)
            out[at : at + STEP] = np.clip(np.rint(odds, out=odds), -127, 127, out=odds)
    return list(said)


def count(tables: np.ndarray, bit: np.ndarray, slots: list[np.ndarray]) -> None:
    for table, slot in zip(tables.reshape(PREDICTORS, -1), slots, strict=True):
        np.add.at(table, slot * 2 + bit, np.int32(1))  # of the table's own type, or numpy takes its slow way


def counted(rows: Iterator, spelling: Callable[..., Spelling] = ended) -> list[np.ndarray]:
    """How often each counter saw a zero and a one."""
    tables = np.zeros((PREDICTORS, 1 << SLOT_BITS, 2), dtype=np.int32)
    for some in rows:
        for bit, _, _, slots in spelling(some).parts():
            count(tables, bit, slots)
    return [t.reshape(-1) for t in tables]


def learned(rows: Iterator, tables: np.ndarray, spelling: Callable[..., Spelling] = ended) -> tuple[Mixer, int]:
    """A mixer that has seen the rows online, and the bytes it saw: each part is foretold, then counted into `tables`.

    What the counters say is taken anew whenever the bytes seen have grown by half.
    """
    mixer, seen, due = Mixer(), 0, 0.0
    for some in rows:
        for bit, length, depth, slots in spelling(some).parts():
            if seen >= due:
                said, due = opinions(tables), 1.5 * seen + STEP
            x = [o[slot] for o, slot in zip(said, slots, strict=True)]
            gate = mixer.gate(depth, x)
            mixed, cell, share = mixer.mix(x, gate)
            cell += share > 0.5
            mixer.learn(x, gate, mixed, cell, bit)
            count(tables, bit, slots)
            seen += len(length)
    return mixer, seen


class Speller:
    """Scores rows with counters that no longer change: each predictor's opinion is looked up."""

    def __init__(self, tables: np.ndarray, mixer: Mixer):
        self.mixer, self.opinions = mixer, opinions(tables)

    def bytes_log2(self, spelled: Spelling) -> np.ndarray:
        """The logarithm of each byte's probability, given the bytes before it in its row."""
        out = [np.zeros(0)]
        for bit, length, depth, slots in spelled.parts():
            x = [o[slot] for o, slot in zip(self.opinions, slots, strict=True)]
            p = self.mixer.refine(*self.mixer.mix(x, self.mixer.gate(depth, x)))
            # the bit's own share: p of a one, 1 - p of a zero
            out.append(np.log2(np.multiply.reduceat(np.abs(p - (bit ^ np.int8(1))), np.cumsum(length) - length)))
        return np.concatenate(out)

    def log2(self, tokens: list[bytes]) -> np.ndarray:
        return self.bytes_log2(ended(tokens))

    def rows_log10(self, spelled: Spelling) -> np.ndarray:
        """log10 of each row's probability."""
        return np.add.reduceat(self.bytes_log2(spelled), np.cumsum(spelled.sizes) - spelled.sizes) * math.log10(2)

    def log10(self, tokens: list[bytes]) -> np.ndarray:
        return self.rows_log10(ended(tokens))


def plain(text: str | None) -> bytes:
    """A text's words, each with one blank behind it."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_TO_SPACE)
    if b"  " in raw or raw[:1] == b" " or raw[-1:] == b" ":
        raw = b" ".join(raw.split())
    return raw and raw + STOP


class Reader:
    """Makes the rows of texts: their code, and the guess of each text's group from the triples of its first bytes."""

    def __init__(self, code: Code = PLAIN, votes: np.ndarray | None = None):
        self.code, self.votes = code, votes

    def guesses(self, heads: list[bytes]) -> list[int]:
        """The group, from 1, whose words hold these bytes likeliest; 0 if there is no choice."""
        if self.votes is None or not heads:
            return [0] * len(heads)
        sizes = np.fromiter(map(len, heads), dtype=np.int64, count=len(heads))
        return (np.add.reduceat(self.votes[Spelling(heads, code=self.code).keys], np.cumsum(sizes) - sizes).argmax(axis=1) + 1).tolist()

    def spellings(self, texts: Iterator[list[bytes] | bytes]) -> Iterator[tuple[list[int], Spelling]]:
        """Texts, given as words or as `plain` bytes, in rows of at most `PIECE` bytes and some at a time, with the number of each row's text."""
        def made() -> tuple[list[int], Spelling]:
            nonlocal group
            fresh = iter(self.guesses([raw[:GUESS] for _, raw, lead in held if not lead]))
            groups = []
            for _, _, lead in held:
                group = group if lead else next(fresh)
                groups.append(group)
            number, raw, leads = zip(*held, strict=True)
            return list(number), Spelling(list(raw), groups, list(leads), self.code)

        held, size, group = [], 0, 0
        for i, text in enumerate(texts):
            whole = text + END if isinstance(text, bytes) else b" ".join([*text, END])
            for at in range(0, len(whole), PIECE):
                held.append((i, whole[max(0, at - LEAD) : at + PIECE], min(at, LEAD)))
                size += len(held[-1][1])
                if size >= STEP:
                    yield made()
                    held, size = [], 0
        if held:
            yield made()


def tally(found: pa.Array, side: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(side, word's number, how often) of every word on every side, and the distinct words."""
    coded = found.dictionary_encode()
    width = max(1, len(coded.dictionary))
    pair, n = np.unique(side * width + coded.indices.to_numpy(), return_counts=True)
    return *np.divmod(pair, width), n, coded.dictionary


def tallied(tokens: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, word's number, how often) of every word in every row, and the distinct words."""
    row = np.repeat(np.arange(len(tokens)), np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)))
    return tally(pa.array([w for t in tokens for w in t], pa.binary()), row)


def count_words(texts: DataFrame, groups: list[str]) -> DataFrame:
    """(word, t0, t1, .., train, n): how often each word, and the end of text, stands in the teaching texts of each group, in all that teach, and in all.

    Input: (text, teaches, grp).
    """
    index = {g: i for i, g in enumerate(groups)}
    none, untaught = len(groups), len(groups) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            side, word, n, met = tally(pa.chunked_array(found, pa.binary()).combine_chunks(), np.concatenate(sides))
            return pa.RecordBatch.from_arrays([met.take(pa.array(word)), pa.array(side, pa.int32()), pa.array(n)], names=["word", "side", "c"])

        found, sides, held, size = [], [], 0, 0
        for b in batches:
            for at in range(0, b.num_rows, ROWS // 4):
                text, teaches, group = (c.to_pylist() for c in b.slice(at, ROWS // 4).columns)
                tokens = [[*words(t, lower=True), END] for t in text]
                own = [index.get(g, none) if t else untaught for t, g in zip(teaches, group, strict=True)]
                sides.append(np.repeat(own, [len(t) for t in tokens]))
                found.append(pa.array([w for t in tokens for w in t], pa.binary()))
                held, size = held + len(found[-1]), size + found[-1].nbytes
                if held > REMEMBERED or size > HELD_BYTES:
                    yield rows()
                    found, sides, held, size = [], [], 0, 0
        if held:
            yield rows()

    sent = texts.mapInArrow(count, "word binary, side int, c long")
    of = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("c"))), F.lit(0))
    return sent.groupBy("word").agg(
        *[of(F.col("side") == k).alias(f"t{k}") for k in range(len(groups))], of(F.col("side") != untaught).alias("train"), F.sum("c").alias("n"),
    )


def triples(counts: DataFrame, sides: list[str]) -> DataFrame:
    """(pair, byte, and for each side n): how often a byte follows two others inside the words, each as often as it was counted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [w if w == END else w + STOP for w in b.column(0).to_pylist()]
            sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
            if not len(raw):
                continue
            codes = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.int64)
            starts = np.cumsum(sizes) - sizes
            one, two = (np.concatenate([np.full(k, STOP[0]), codes[:-k]])[: len(codes)] for k in (1, 2))
            one[starts] = two[starts] = STOP[0]
            later = starts[sizes > 1] + 1
            two[later] = STOP[0]
            key, at = np.unique((two * 256 + one) * 256 + codes, return_inverse=True)
            n = [np.bincount(at, weights=np.repeat(b.column(1 + k).to_numpy(), sizes), minlength=len(key)).astype(np.int64) for k in range(len(sides))]
            yield pa.RecordBatch.from_arrays([pa.array(key >> 8), pa.array(key & 255), *map(pa.array, n)], names=["pair", "byte", *sides])

    found = counts.where("train > 0").select("word", *sides).mapInArrow(run, ", ".join(f"{c} long" for c in ("pair", "byte", *sides)))
    return found.groupBy("pair", "byte").agg(*[F.sum(c).alias(c) for c in sides])


def reader(counts: DataFrame, groups: int) -> Reader:
    """Codes and votes from the words that teach; the driver holds 256 triples of each of the most frequent pairs."""
    sides = ["train", *(f"t{k}" for k in range(groups))]
    met = triples(counts, sides)
    frequent = met.groupBy("pair").agg(F.sum("train").alias("all")).orderBy(F.desc("all"), "pair").limit(PAIRS)
    rows = np.array(met.join(frequent.select("pair"), "pair").orderBy("pair", "byte").select("pair", "byte", *sides).collect(), dtype=np.int64)
    if not len(rows):
        return Reader()
    code = Code(*rows[:, :3].T)
    if groups < 2:
        return Reader(code)
    votes = np.zeros((len(code.length), groups), dtype=np.float32)
    own = rows[:, 3:]
    votes[code.tree[rows[:, 0]] + rows[:, 1]] = np.log((own + 0.5) / (own.sum(axis=0) + 0.5 * len(own)))
    return Reader(code, votes)


def teach(texts: DataFrame, shipped) -> tuple[np.ndarray, Mixer]:
    """Counters over all bytes of the texts, and a mixer that learned online from all of them.

    Every task foretells its share of the texts byte by byte and counts them; counts are added, weights and table are
    averaged by the bytes seen. The driver holds these, of fixed size whatever the corpus.
    """
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = np.zeros((PREDICTORS, 1 << SLOT_BITS, 2), dtype=np.int32)
        given = (plain(t) for b in batches for at in range(0, b.num_rows, ROWS) for t in b.column(0).slice(at, ROWS).to_pylist())
        mixer, seen = learned(shipped.value.spellings(given), tables, lambda some: some[1])
        names = ["k", "c", "at", "n"]
        kinds = pa.int32(), pa.int32(), pa.binary(), pa.binary()
        if seen:
            numbers = np.concatenate([mixer.weights.reshape(-1), mixer.table.reshape(-1)])
            row = [-1], [0], [np.float64(seen).tobytes()], [numbers.tobytes()]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, row, kinds)), names=names)
        for k, total in enumerate(tables.reshape(PREDICTORS, -1)):
            for c, chunk in enumerate(total.reshape(-1, CHUNK)):
                used = np.flatnonzero(chunk)
                if len(used):
                    row = [k], [c], [used.astype(np.uint16).tobytes()], [chunk[used].astype(np.uint32).tobytes()]
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, row, kinds)), names=names)

    def add(group: pa.Table) -> pa.Table:
        k, c = group.column("k")[0].as_py(), group.column("c")[0].as_py()
        pairs = zip(group.column("at").to_pylist(), group.column("n").to_pylist(), strict=True)
        if k < 0:  # the mixers, in an order that does not depend on the tasks
            seen, numbers = zip(*((np.frombuffer(at)[0], np.frombuffer(n)) for at, n in sorted(pairs)), strict=True)
            out = np.average(numbers, axis=0, weights=seen)
        else:
            total = np.zeros(CHUNK, dtype=np.int64)
            for at, n in pairs:
                total[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.uint32)
            out = np.minimum(total, np.iinfo(np.int32).max).astype(np.int32)
        return pa.table({"k": pa.array([k], pa.int32()), "c": pa.array([c], pa.int32()), "n": pa.array([out.tobytes()], pa.binary())})

    sums = texts.mapInArrow(learn, "k int, c int, at binary, n binary").groupBy("k", "c").applyInArrow(add, "k int, c int, n binary")
    tables, mixer = np.zeros((PREDICTORS, 2 << SLOT_BITS), dtype=np.int32), Mixer()
    for k, c, n in sums.toLocalIterator():
        if k < 0:
            numbers, cut = np.frombuffer(bytes(n)), Mixer.SETS * PREDICTORS
            mixer = Mixer(numbers[:cut].reshape(PREDICTORS, -1), numbers[cut:].reshape(Mixer.SETS, -1))
        else:
            tables[k, c * CHUNK : (c + 1) * CHUNK] = np.frombuffer(bytes(n), dtype=np.int32)
    return tables.reshape(PREDICTORS, 1 << SLOT_BITS, 2), mixer


class Words:
    """All distinct words with their counts, the teaching tokens and distinct words, and what scores whole texts."""

    def __init__(self, table: DataFrame, tokens: int, types: int, reader: Reader, speller: Speller):
        self.table, self.tokens, self.types, self.reader, self.speller = table, tokens, types, reader, speller

    def base(self) -> Column:
        return F.log10((F.col("train") + 1) / F.lit(float(self.tokens + self.types + 1)))


def texts_log10(read: Reader, speller: Speller, texts: list[list[bytes] | bytes]) -> np.ndarray:
    """log10 of the probability of each text, given as `Reader.spellings` takes it, and its end."""
    out = np.zeros(len(texts))
    for number, spelled in read.spellings(iter(texts)):
        np.add.at(out, number, speller.rows_log10(spelled))
    return out


def learn_words(texts: DataFrame) -> Words:
    """Count the words of (text, teaches, grp), and teach the bit predictors and their mixer all bytes of the texts that teach."""
    spark = texts.sparkSession
    sizes = texts.where("teaches and grp is not null").groupBy("grp").count().orderBy(F.desc("count"), "grp").limit(GROUPS)
    groups = [r[0] for r in sizes.collect()]
    counts = materialise(count_words(texts, groups), "word-counts")
    size = F.when(F.col("word") == F.lit(END), 1).otherwise(F.octet_length("word") + 1)
    tokens, types, taught = counts.agg(
        F.coalesce(F.sum("train"), F.lit(0)), F.count_if(F.col("train") > 0), F.coalesce(F.sum(F.col("train") * size), F.lit(0)),
    ).first()
    read = reader(counts, len(groups))
    share = texts.where("teaches").select("text").coalesce(max(1, -(-taught // TASK_BYTES)))
    return Words(counts, tokens, types, read, Speller(*teach(share, spark.sparkContext.broadcast(read))))


def frequent(counts: DataFrame) -> DataFrame:
    """At most `HOT` words, from the most frequent down to some count."""
    short, level = counts.where(F.octet_length("word") <= HOT_BYTES), F.floor(4 * F.log2("n"))
    least, taken = math.inf, 0
    for at, n in sorted(short.groupBy(level).count().collect(), reverse=True):
        taken += n
        if taken > HOT:
            break
        least = at
    return short.where(level >= F.lit(least))


def score_texts(docs: DataFrame, teaches: Column, key: str = "doc_id", text: str = "text", group: str | None = None) -> DataFrame:
    """(doc_id under its own name, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row.

    Tokens are words, A-Z lower-cased, and one end for every text. Learns from all rows
    where `teaches` is true (null counts as false). `base_score` is the log10 probability
    by counts plus one; `score` that of the model, whose bits over the bytes of all
    words, each with its end, are `bits_per_byte`.

    The model foretells every bit of a text's bytes, words with one blank behind each and
    the text's end. Bits are those of a Huffman code for each pair of bytes before. Predictors
    with hashed counters for the last bytes, across word ends, for the word so far, and for
    that and the word before, give every bit a probability; weights chosen by a gate mix them in the logistic
    domain and learn online, and a table refines the mix. Counters and mixer learn from
    all bytes of all teaching texts, each foretold before it is counted. If `group` names a column, the words of
    the largest groups of teaching texts tell from a text's first 64 bytes which it is like,
    and one predictor knows that for the rest. The group of a text itself is not looked at. Texts
    over 65,536 bytes are foretold in pieces that look back 64 bytes at most.

    The most frequent words, at most 200,000, are looked up where they are met;
    all others are joined, after they were summed up in their text.

    Null and empty texts are their end alone. Repeated rows repeat their scores; null
    identifiers are scored like others. Without teaching rows every byte
    has eight bits. An empty table gives an empty one; other columns are not carried.
    """
    grp = F.lit(None).cast("string") if group is None else F.col(f"`{group}`").cast("string")
    given = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.coalesce(teaches, F.lit(False)).alias("teaches"), grp.alias("grp"))
    learnt = learn_words(given.select("text", "teaches", "grp"))
    size = F.when(F.col("word") == F.lit(END), 1).otherwise(F.octet_length("word") + 1)
    numbers = [(F.col("train") > 0).cast("double"), size.cast("double"), learnt.base()]
    width = len(numbers)
    named = [f"s{i}" for i in range(width)]
    collected = frequent(learnt.table).select("word", *[x.alias(name) for x, name in zip(numbers, named, strict=True)]).toArrow().combine_chunks()
    looked_up = docs.sparkSession.sparkContext.broadcast((collected.column("word"), [collected.column(name).to_numpy() for name in named]))
    model = docs.sparkSession.sparkContext.broadcast((learnt.reader, learnt.speller))
    sent = pa.list_(pa.float64())

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, columns = looked_up.value
        place = {w: i for i, w in enumerate(held.to_pylist())}
        for b in batches:
            for at in range(0, b.num_rows, ROWS // 4):
                some = b.slice(at, ROWS // 4)
                rows = some.num_rows
                texts = [t or "" for t in some.column(1).to_pylist()]
                tokens = [words(t, lower=True) for t in texts]
                score = texts_log10(*model.value, [plain(t) for t in texts])
                row, word, c, met = tallied([[*t, END] for t in tokens])
                at_ = np.fromiter((place.get(w, -1) for w in met.to_pylist()), dtype=np.int64, count=len(met))[word]
                hot, rare = at_ >= 0, at_ < 0
                own = [np.bincount(row[hot], weights=c[hot] * x[at_[hot]], minlength=rows) for x in columns]
                own = np.stack([*own, score], axis=1)
                # the rare words of all texts, then a row for each text; no word holds a blank, so the row of the sums meets none
                of = np.concatenate([row[rare], np.arange(rows)])
                key_ = some.column(0)
                whole = pa.array([b" %d" % zlib.crc32(b"%d %r" % (i, k)) for i, k in enumerate(key_.to_pylist())], pa.binary())
                marks = np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in texts], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([
                    key_.take(pa.array(of)), pa.array(marks[of]), pa.concat_arrays([met.take(pa.array(word[rare])), whole]),
                    pa.array(np.concatenate([c[rare], np.bincount(row, weights=c, minlength=rows).astype(np.int64)])),
                    pa.concat_arrays([
                        pa.nulls(len(of) - rows, sent), pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * own.shape[1]), pa.array(own.reshape(-1))),
                    ]),
                ], names=["key", "mark", "word", "c", "own"])

    kind = given.schema["key"].dataType.simpleString()
    parts = given.select("key", "text").mapInArrow(sums, f"key {kind}, mark long, word binary, c long, own array<double>")
    # counts travel, not logarithms; a text's rows then meet in one task, which adds them
    met = parts.join(learnt.table.select("word", "train"), "word", "left").withColumn("__size", size).select(
        "key", "mark", "c", "own", "__size", "train",
    ).repartition("key", "mark")
    whole = F.col("own").isNotNull()
    wide = [F.when(whole, F.get("own", F.lit(i))).otherwise(F.col("c") * x) for i, x in enumerate([numbers[0], F.col("__size"), *numbers[2:]])]
    # rows equal in identifier and text are summed together and share the sums out again
    per_text = met.groupBy("key", "mark").agg(
        F.count_if(whole).alias("rows"), F.sum(F.when(whole, F.col("c"))).alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(wide)],
        F.sum(F.get("own", F.lit(width))).alias("score"),
    )
    return per_text.withColumn("score", F.col("score") / F.col("rows")).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).select(
        F.col("key").alias(key), F.expr("n div rows").alias("n_tokens"), F.round(F.col("s0") / F.col("rows")).cast("long").alias("n_known"),
        F.lit(learnt.tokens).cast("long").alias("train_tokens"), (F.col("s2") / F.col("rows")).alias("base_score"), "score",
        (-F.col("score") * F.lit(math.log2(10)) * F.col("rows") / F.col("s1")).alias("bits_per_byte"),
    )
