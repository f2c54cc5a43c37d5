"""Byte-pair encoding with word ends by an index of pair occurrences, and decoding."""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The tokenizer's pattern of pieces (a fixed value): a piece never crosses blanks, and merges stay inside it.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Code points that the pattern library counts as letters and the tokenizer's older Unicode tables do not (fixed values).
NOT_LETTERS = (
    "\\u0558\\u058b-\\u058c\\u088f\\u0c5c\\u0cdc\\u208f\\u209d-\\u209f\\ua7ce-\\ua7cf\\ua7d2\\ua7d4\\ua7dd\\ua7e2\\ua7f1\\uab6c-\\uab6d"
    "\\U000107bb-\\U000107bf\\U00010940-\\U00010959\\U00010ec5-\\U00010ec7\\U00010ed9-\\U00010eee\\U00011b0a"
    "\\U00011db0-\\U00011ddb\\U00011df1\\U00016ea0-\\U00016eb8\\U00016ebb-\\U00016ed3\\U00016ff2-\\U00016ff3"
    "\\U000187f8-\\U000187ff\\U00018cd6-\\U00018cda\\U00018d09-\\U00018d20\\U00018d80-\\U00018df2\\U00018e00-\\U00019191"
    "\\U000191a0-\\U000191d2\\U0001b123-\\U0001b128\\U0001b168\\U0001d6a6\\U0001df1f-\\U0001df24\\U0001df2b-\\U0001df81"
    "\\U0001df90-\\U0001df96\\U0001dfcd-\\U0001dfff\\U0001e6c0-\\U0001e6de\\U0001e6e0-\\U0001e6e2\\U0001e6e4-\\U0001e6e5"
    "\\U0001e6e7-\\U0001e6ed\\U0001e6f0-\\U0001e6f4\\U0001e6fe-\\U0001e6ff\\U0002b73a-\\U0002b73f\\U0002b81e"
    "\\U0002cea2-\\U0002cead\\U000323b0-\\U00033479\\U0003d000-\\U0003fc3f"
)
#: Capital letters that Python's Unicode tables do not know yet, beside the letter that the tokenizer makes of them (fixed values).
LATE_CAPITALS = {
    0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B,
    **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}
#: The final sigma is not told apart: letters are lowered one by one.
LOWERED_FIRST = {ord("Σ"): "σ", **LATE_CAPITALS}
#: Pieces remembered by a Python worker; new pieces encoded at once; texts held meanwhile.
CACHED, AT_ONCE, TEXTS_AT_ONCE = 250_000, 30_000, 250
#: Rows of a batch that leave a worker together.
ROWS = 1_000
#: A pair of symbols as one number.
SHIFT = 32


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where printable, else the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Bpe:
    """A tokenizer file's vocabulary, merges and special tokens."""

    def __init__(self, definition: str):
        parsed = json.loads(definition)
        model = parsed["model"]
        vocab: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"]
        added = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        self.first = np.array([vocab[c] for c in byte_characters()])
        self.last = np.array([vocab[c + end] for c in byte_characters()])
        pairs = [pair if isinstance(pair, list) else pair.split(" ") for pair in model["merges"]]
        self.parts = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.rank_of = {a << SHIFT | b: rank for rank, (a, b, _) in enumerate(self.parts)}
        self.pairs = np.array(sorted(self.rank_of))
        self.pair_ranks = np.array([self.rank_of[p] for p in self.pairs.tolist()])
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")")
        self.specials = {t: np.int32(i).tobytes() for t, i in added.items()}
        self.pieces = regex.compile(PIECES)
        self.late = re.compile(f"[{NOT_LETTERS}{''.join(map(chr, LOWERED_FIRST))}]")
        letters, others = rf"[\p{{L}}--[{NOT_LETTERS}]]", rf"[[^\s\p{{L}}\p{{N}}]||[{NOT_LETTERS}]]"
        late = PIECES.replace(r"[^\s\p{L}\p{N}]", others).replace(r"[\p{L}]", letters)
        self.late_pieces = regex.compile(late, regex.VERSION1)
        self.cache: dict[str, bytes] = dict(self.specials)

    def split(self, text: str) -> list[str]:
        """Pieces of a text in order. Special tokens, found in the text as given, are pieces of their own."""
        if "<|" not in text:
            return self.ordinary(text)
        out: list[str] = []
        for i, part in enumerate(self.special.split(text)):
            out.extend([part] if i % 2 else self.ordinary(part))
        return out

    def ordinary(self, text: str) -> list[str]:
        if text.isascii():
            return self.pieces.findall(text.lower())
        text = unicodedata.normalize("NFC", text)
        if self.late.search(text):
            return self.late_pieces.findall(text.translate(LOWERED_FIRST).lower())
        return self.pieces.findall(text.lower())

    def encode_pieces(self, pieces: Sequence[str]) -> list[bytes]:
        """Ids of several pieces at once, as bytes of 32-bit numbers.

        `where` maps every pair of neighbouring symbols, named by its rank, to its
        positions in all pieces. Active ranks come off a heap in ascending order; a
        rank's positions are merged from left to right, and the pairs that
        a merge makes join the lists of their own ranks. Positions whose pair has gone
        meanwhile are recognised by their symbols and passed over.
        """
        if not pieces:
            return []
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        ends = np.cumsum(np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)))
        codes = np.frombuffer(b"".join(raw), dtype=np.uint8)
        coded = self.first[codes]
        coded[ends - 1] = self.last[codes[ends - 1]]
        joined = np.ones(len(codes), dtype=bool)
        joined[ends - 1] = False
        following, before = np.arange(1, len(codes) + 1), np.arange(-1, len(codes) - 1)
        following[ends - 1] = -1
        before[ends[:-1]] = -1
        left = np.flatnonzero(joined)
        wanted = coded[left] << SHIFT | coded[left + 1]
        found = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        real = self.pairs[found] == wanted
        ranks, left = self.pair_ranks[found[real]], left[real]
        order = np.argsort(ranks, kind="stable")
        active, cuts = np.unique(ranks[order], return_index=True)
        lists = np.split(left[order], cuts[1:])
        where = {r: at.tolist() for r, at in zip(active.tolist(), lists, strict=False)}
        active = active.tolist()  # sorted, and so a heap
        symbols, following, before, parts, rank_of = coded.tolist(), following.tolist(), before.tolist(), self.parts, self.rank_of
        while active:
            a, b, made = parts[rank := heapq.heappop(active)]
            at = where.pop(rank)
            at.sort()
            for i in at:
                j = following[i]
                if symbols[i] != a or j < 0 or symbols[j] != b:
                    continue
                symbols[i], symbols[j] = made, -1
                following[i] = after = following[j]
                if after >= 0:
                    before[after] = i
                    if (new := rank_of.get(made << SHIFT | symbols[after])) is not None:
                        if new not in where:
                            where[new] = []
                            heapq.heappush(active, new)
                        where[new].append(i)
                if (left := before[i]) >= 0 and (new := rank_of.get(symbols[left] << SHIFT | made)) is not None:
                    if new not in where:
                        where[new] = []
                        heapq.heappush(active, new)
                    where[new].append(left)
        left_over = np.array(symbols)
        kept = left_over >= 0
        stops = np.concatenate([[0], np.cumsum(kept)[ends - 1]]).tolist()
        ids = left_over[kept].astype(np.int32).tobytes()
        return [ids[4 * x : 4 * y] for x, y in zip(stops, stops[1:], strict=False)]

    def encode(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """Ids of every text. Texts are taken together until they have `AT_ONCE` pieces that are not remembered."""
        out: list[np.ndarray] = []
        waiting: list[list[str]] = []
        unknown: set[str] = set()
        for text in texts:
            waiting.append(pieces := self.split(text) if text else [])
            unknown |= set(pieces).difference(self.cache)
            if len(unknown) >= AT_ONCE or len(waiting) >= TEXTS_AT_ONCE:
                out += self.looked_up(waiting, unknown)
                waiting, unknown = [], set()
        return out + self.looked_up(waiting, unknown)

    def looked_up(self, waiting: list[list[str]], unknown: set[str]) -> list[np.ndarray]:
        new = list(unknown)
        self.cache.update(zip(new, self.encode_pieces(new), strict=True))
        known = self.cache.__getitem__
        out = [np.frombuffer(b"".join(map(known, pieces)), dtype=np.int32) for pieces in waiting]
        if len(self.cache) > CACHED:
            self.cache = dict(self.specials)
        return out


def token_table(definition: str) -> pa.Array:
    """The token of every id."""
    parsed = json.loads(definition)
    by_id = {i: t for t, i in parsed["model"]["vocab"].items()} | {t["id"]: t["content"] for t in parsed["added_tokens"]}
    return pa.array([by_id.get(i) for i in range(max(by_id) + 1)])


_built: dict[tuple, Bpe | pa.Array] = {}


def built(kind: Callable[[str], Bpe | pa.Array], definition) -> Bpe | pa.Array:
    """What `kind` makes of a broadcast definition, once in a Python worker."""
    name, text = definition.value
    if (kind.__name__, name) not in _built:
        _built[kind.__name__, name] = kind(text)
    return _built[kind.__name__, name]


def shipped(df: DataFrame, path: str):
    """The tokenizer file, read on the driver (a few MB whatever the input) and broadcast."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    return df.sparkSession.sparkContext.broadcast((hash(text), text))


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Every row with the token ids of its whole text, as the tokenizer file at `path` defines them.

    Special tokens are recognised where they stand in a text; none are added. Null
    and empty texts have no ids. Rows are encoded one by one, so repeated rows
    repeat their ids and an empty table gives an empty one; a column that
    already has the name `ids` is replaced.
    """
    definition = shipped(docs, path)

    @F.arrow_udf("array<int>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenizer = built(Bpe, definition)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                coded = tokenizer.encode(t.as_py() for t in batch[at : at + ROWS])
                offsets = np.cumsum([0, *map(len, coded)], dtype=np.int32)
                yield pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.empty(0, np.int32), *coded])))

    return docs.withColumn(ids, encoded(F.col(f"`{text}`")))


def joined(lists: pa.Array, tokens: pa.Array) -> pa.Array:
    """Texts of lists of ids."""
    lists = lists.fill_null([])
    values = lists.flatten()
    known = pc.if_else(pc.and_(pc.greater_equal(values, 0), pc.less(values, len(tokens))), values, None)
    parts = pa.ListArray.from_arrays(pc.subtract(lists.offsets, lists.offsets[0]), tokens.take(known))
    if parts.values.null_count:
        parts = pa.array([[t for t in row if t is not None] for row in parts.to_pylist()], type=pa.list_(pa.string()))
    return pc.binary_join(parts, " ")


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Every row with the text of its ids: their tokens, special ones too, with one space between.

    The tokenizer file names no decoder, so word ends stay visible. No ids or null
    give an empty text; ids outside the vocabulary and null ids are passed over.
    """
    definition = shipped(df, path)

    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = built(token_table, definition)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                yield joined(batch[at : at + ROWS], tokens)

    return df.withColumn(decoded, texts(F.col(f"`{ids}`")))


def encode_and_decode(docs: DataFrame, path: str, columns: Sequence[str], text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """The named columns of every row, the token ids of its whole text, and the text of these ids.

    As `encode` and then `decode`, in one Python worker a core in place of two; texts end
    there, and a few of them leave at a time. Null and empty texts have no ids and an empty text.
    """
    definition = shipped(docs, path)
    kept = docs.select(*[F.col(f"`{c}`") for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, tokens = built(Bpe, definition), built(token_table, definition)
        for b in batches:
            for at in range(0, b.num_rows, TEXTS_AT_ONCE):
                some = b.slice(at, TEXTS_AT_ONCE)
                coded = tokenizer.encode(t.as_py() for t in some.column(len(columns)))
                offsets = np.cumsum([0, *map(len, coded)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.empty(0, np.int32), *coded])))
                yield pa.RecordBatch.from_arrays([*some.columns[: len(columns)], lists, joined(lists, tokens)], names=[*columns, ids, decoded])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + f", `{ids}` array<int>, `{decoded}` string"
    return docs.select(*[F.col(f"`{c}`") for c in columns], F.col(f"`{text}`").alias("__text")).mapInArrow(run, schema)
