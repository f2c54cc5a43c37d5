"""Language identification by unigram pieces, summed over all segmentations of a text's words."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditspark.llm.text import materialise

UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")
#: Letters of a word that are scored together; a longer word is taken in parts of so many.
LONGEST = 40
#: Words that a task remembers, new words scored at once, characters of texts that wait for them.
REMEMBERED, AT_ONCE, WAITING = 300_000, 30_000, 2_000_000
#: What every piece has before its expected count, and how often counts are expected anew.
PRIOR, ROUNDS = 0.1, 2


def letter_words(text: str | None) -> list[str]:
    """Lower-case runs of letters; other alphanumeric signs part them."""
    found = LETTERS.findall(text.lower()) if text else []
    if all(len(w) <= LONGEST and w.isalpha() for w in found):
        return found
    letters = ("".join(c if c.isalpha() else " " for c in w).split() for w in found)
    return [p[i : i + LONGEST] for w in letters for p in w for i in range(0, len(p), LONGEST)]


def piece_vocabulary(path: str) -> list[bytes]:
    """Pieces of a public sentencepiece model that words of lower-case letters can hold; a space marks a word's start.

    Every byte is a piece, so every word has a segmentation.
    """
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {bytes([b]) for b in range(256)}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            piece = model.id_to_piece(i)
            body = piece.removeprefix("▁")
            if (not body or body.isalpha()) and body == body.lower():
                pieces.add(piece.replace("▁", " ").encode())
    return sorted(pieces)


class Pieces:
    """All places where pieces stand in words, found by walking a trie at all places at once."""

    def __init__(self, pieces: Sequence[bytes]):
        node_of: dict[bytes, int] = {b"": 0}
        for p in pieces:
            for i in range(1, len(p) + 1):
                node_of.setdefault(p[:i], len(node_of))
        steps = sorted((node_of[n[:-1]] << 8 | n[-1], node) for n, node in node_of.items() if n)
        self.steps, self.next = np.array([s for s, _ in steps]), np.array([n for _, n in steps])
        self.piece = np.full(len(node_of), -1)
        self.piece[[node_of[p] for p in pieces]] = np.arange(len(pieces))
        self.n = len(pieces)

    def places(self, words: Sequence[str]) -> tuple[np.ndarray, ...]:
        """Matches (from, to, piece) ordered by their end's place in its word, the words' first and last places, and each end's place.

        Places number the gaps between bytes: a word of n bytes and its leading
        space have n + 2 of them.
        """
        raw = [b" " + w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        last_byte = np.cumsum(sizes)
        codes = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.int64)
        word = np.repeat(np.arange(len(raw)), sizes)
        stop = last_byte[word]
        at, node, length = np.arange(len(codes)), np.zeros(len(codes), dtype=np.int64), 0
        starts, ends, pieces = [], [], []
        while len(at):
            wanted = node << 8 | codes[at + length]
            found = np.minimum(np.searchsorted(self.steps, wanted), len(self.steps) - 1)
            good = self.steps[found] == wanted
            at, node, length = at[good], self.next[found[good]], length + 1
            hit = self.piece[node] >= 0
            starts.append(at[hit])
            ends.append(at[hit] + length)
            pieces.append(self.piece[node[hit]])
            inside = at + length < stop[at]
            at, node = at[inside], node[inside]
        start, end, piece = np.concatenate(starts), np.concatenate(ends), np.concatenate(pieces)
        of = word[start]
        depth = end - (last_byte - sizes)[of]
        order = np.lexsort((end, depth))
        start, end, piece, of, depth = start[order], end[order], piece[order], of[order], depth[order]
        first = last_byte - sizes + np.arange(len(raw))
        return start + of, end + of, piece, first, last_byte + np.arange(len(raw)), depth


def steps_of(key: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


def log_forward(p: np.ndarray, places: tuple[np.ndarray, ...]) -> np.ndarray:
    """Logarithm of every place's probability: the sum over all segmentations of the word up to it. p: (piece, language).

    In logarithms, as a long word of rare letters has fewer than the smallest double.
    """
    start, end, piece, first, last, depth = places
    log_p = np.log(p)
    alpha = np.full((int(last[-1]) + 1, p.shape[1]), -np.inf)
    alpha[first] = 0.0
    for a, b in steps_of(depth):
        part, to = alpha[start[a:b]] + log_p[piece[a:b]], end[a:b]
        begins = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        top = np.maximum.reduceat(part, begins, axis=0)
        part -= np.repeat(top, np.diff(np.append(begins, len(to))), axis=0)
        alpha[to[begins]] = top + np.log(np.add.reduceat(np.exp(part), begins, axis=0))
    return alpha


def forward(p: np.ndarray, places: tuple[np.ndarray, ...]) -> np.ndarray:
    """Probability of every place, which is 0 where a double cannot hold it."""
    return np.exp(log_forward(p, places))


def expected(p: np.ndarray, places: tuple[np.ndarray, ...], weight: np.ndarray, pieces: int) -> np.ndarray:
    """Expected counts of the pieces over all segmentations of weighted words. p: (piece,) of one language."""
    start, end, piece, first, last, depth = places
    alpha = log_forward(p[:, None], places)[:, 0]
    # the share of each match in its end's probability, then the weight that passes its end
    n = np.exp(alpha[start] + np.log(p)[piece] - alpha[end])
    through = np.zeros_like(alpha)
    through[last] = weight
    for a, b in reversed(steps_of(depth)):
        n[a:b] *= through[end[a:b]]
        np.add.at(through, start[a:b], n[a:b])
    return np.bincount(piece, weights=n, minlength=pieces)


_tries: dict[int, Pieces] = {}


def trie(shipped) -> Pieces:
    """The trie of a broadcast vocabulary, built once in a Python worker."""
    key, pieces = shipped.value
    if key not in _tries:
        _tries[key] = Pieces(pieces)
    return _tries[key]


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) over all of `docs` (lang, text); tasks send sums."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            langs = [k for k, c in counts.items() for _ in range(len(c))]
            words, n = [w for c in counts.values() for w in c], [v for c in counts.values() for v in c.values()]
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(n, pa.int64())], names=["lang", "word", "n"])

        counts: dict[str, Counter] = defaultdict(Counter)
        for b in batches:
            for lang, text in zip(b.column(0), b.column(1), strict=True):
                counts[lang.as_py()].update(letter_words(text.as_py()))
                if sum(map(len, counts.values())) > REMEMBERED:
                    yield rows()
                    counts.clear()
        yield rows()

    return docs.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Model:
    """Languages with the logarithm of their share of documents, and piece probabilities (piece, language)."""

    def __init__(self, langs: list[str], log_share: np.ndarray, p: np.ndarray):
        self.langs, self.log_share, self.p = langs, log_share, p


def train(docs: DataFrame, pieces: list[bytes], rounds: int = ROUNDS) -> Model:
    """Learn from `docs` (lang, text): all words count, through their expected pieces over all segmentations.

    The driver holds languages x pieces numbers, whatever the corpus.
    """
    spark = docs.sparkSession
    shares = sorted((r[0], r[1]) for r in docs.groupBy("lang").count().collect())
    langs = [k for k, _ in shares]
    log_share = np.log(np.array([n for _, n in shares], dtype=float) / max(1, sum(n for _, n in shares)))
    p = np.full((len(pieces), len(langs)), 1.0 / len(pieces))
    if not langs:
        return Model(langs, log_share, p)
    counts = materialise(word_counts(docs), "words")
    shipped = spark.sparkContext.broadcast((hash(tuple(pieces)), pieces))
    for _ in range(rounds):
        now = spark.sparkContext.broadcast((langs, p))

        def expect(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            vocabulary, (names, p_) = trie(shipped), now.value
            total = np.zeros(p_.shape)
            for b in batches:
                lang = np.array(b.column(0).to_pylist())
                words, n = np.array(b.column(1).to_pylist(), dtype=object), b.column(2).to_numpy().astype(float)
                for k, name in enumerate(names):
                    if (own := lang == name).any():
                        total[:, k] += expected(p_[:, k], vocabulary.places(words[own].tolist()), n[own], vocabulary.n)
            piece, k = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(k, pa.int32()), pa.array(total[piece, k])], names=["piece", "k", "n"])

        sums = counts.mapInArrow(expect, "piece int, k int, n double").groupBy("piece", "k").agg(F.sum("n").alias("n")).toPandas()
        total = np.full(p.shape, PRIOR)
        total[sums["piece"], sums["k"]] += sums["n"]
        p = total / total.sum(axis=0)
    return Model(langs, log_share, p)


class Scorer:
    """Language scores of texts; words are scored once and remembered."""

    def __init__(self, vocabulary: Pieces, model: Model):
        self.vocabulary, self.model = vocabulary, model
        self.row: dict[str, int] = {}
        self.scores = np.empty((0, len(model.langs)))

    def learn(self, words: set[str]) -> None:
        new = list(words)
        blocks = [self.scores]
        for at in range(0, len(new), AT_ONCE):
            places = self.vocabulary.places(new[at : at + AT_ONCE])
            blocks.append(log_forward(self.model.p, places)[places[4]])
        self.row.update(zip(new, range(len(self.row), len(self.row) + len(new)), strict=True))
        self.scores = np.concatenate(blocks)

    def judge(self, texts: Iterator[str | None]) -> Iterator[tuple[str, float]]:
        waiting: list[list[str]] = []
        new: set[str] = set()
        size = 0
        for text in texts:
            waiting.append(words := letter_words(text))
            new |= set(words).difference(self.row)
            size += len(text or "")
            if len(new) >= AT_ONCE or size >= WAITING:
                yield from self.answers(waiting, new)
                waiting, new, size = [], set(), 0
        yield from self.answers(waiting, new)

    def answers(self, waiting: list[list[str]], new: set[str]) -> Iterator[tuple[str, float]]:
        if new:
            self.learn(new)
        for words in waiting:
            if not words or not self.model.langs:
                yield UNKNOWN, 0.0
                continue
            rows = np.fromiter(map(self.row.__getitem__, words), dtype=np.int64, count=len(words))
            total = self.model.log_share + self.scores[rows].sum(axis=0)
            best = int(total.argmax())
            yield self.model.langs[best], float(1.0 / np.exp(total - total[best]).sum())
        if len(self.row) > REMEMBERED:
            self.row, self.scores = {}, self.scores[:0]


def identify(docs: DataFrame, training: Column, path: str, text: str = "text", lang: str = "lang", rounds: int = ROUNDS) -> DataFrame:
    """Every row with `lang_pred` and `score`, the predicted language's share of probability.

    Learns from the rows where `training` is true and the language is not null.
    Only the text is judged: its words are runs of letters, lower-cased, and a word's
    probability in a language is the sum over all its segmentations into the pieces
    of the sentencepiece model at `path`; words multiply.

    Texts that are null or hold no letter are `und` with score 0, as is everything if no
    row teaches a language. Null languages and empty texts teach nothing. Equal texts
    are judged alike; an empty table gives an empty one; columns of the input named
    like a result are replaced.
    """
    spark, pieces = docs.sparkSession, piece_vocabulary(path)
    taught = docs.where(training & F.col(f"`{lang}`").isNotNull()).select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"))
    model = spark.sparkContext.broadcast(train(taught, pieces, rounds))
    shipped = spark.sparkContext.broadcast((hash(tuple(pieces)), pieces))

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(trie(shipped), model.value)
        for b in batches:
            answers = list(scorer.judge(t.as_py() for t in b))
            yield pa.StructArray.from_arrays(
                [pa.array([a for a, _ in answers], pa.string()), pa.array([s for _, s in answers], pa.float64())], names=["lang_pred", "score"],
            )

    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score", "__judged")]
    return docs.select(*own, judged(F.col(f"`{text}`")).alias("__judged")).select(
        *own, F.col("__judged.lang_pred").alias("lang_pred"), F.col("__judged.score").alias("score"),
    )
