"""Language ID by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word is summed over
all its segmentations by a forward algorithm, and a text scores the sum of the logarithms over its words. Pieces never
cross white space, so the text factorises by word, and each distinct word of a batch is computed once. Words are taken
whole, of any length: sums are scaled on the way, so that none vanishes.

The probabilities are learned by expectation-maximisation over the same segmentations, from the word counts of a
sample of labelled documents, about ``sample_docs`` different texts of each language and one at least, drawn by a hash
of the text, so that repeated rows change nothing.
At most ``max_langs`` languages can be learned, else ValueError.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; with no labelled document that holds a word everything
is ``und``; of equal languages the first by code point wins; whole texts count, of any length, and so do whole words;
words are parted by ASCII white space only, in learning and in scoring; repeated rows each get a row; null languages
teach nothing; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from larkmill.llm.batches import bound_batches
from larkmill.llm.words import WORD, words

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
UNDETERMINED = "und"
MARK = "▁"  # begins the first piece of a word
RESCALE = 4  # characters after which sums are scaled anew
LETTER = re.compile(r"[^\W\d_]")
FOREIGN = 0.05


def vocabulary_pieces(path: str = VOCABULARY) -> list[str]:
    """The pieces of a sentencepiece model file, without control, byte and unknown pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = []
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)):
            found.append(model.id_to_piece(i))
    return sorted({p.lower() for p in found})


@dataclass
class Unigrams:
    """Log-probability of each piece (the last row: an unknown character) for each language."""

    langs: list[str]
    index: dict[str, int]
    longest: int
    prob: np.ndarray
    _finder: PieceFinder | None = None

    def log_words(self, found: list[str]) -> np.ndarray:
        """Log-probability of each word, summed over its segmentations."""
        out = np.zeros((len(found), len(self.langs)))
        for some, codes, lengths in like_lengths([MARK + w for w in found], (1 << 22) // len(self.langs)):
            out[some] = self.forward(codes, lengths)
        return out

    def forward(self, codes: np.ndarray, lengths: np.ndarray, edges: list | None = None) -> np.ndarray:
        """The forward algorithm over words, longest first, a row of code points each. Gives their log-probabilities.

        Places are reached at a scale that is renewed every few characters, by word and language. ``edges`` collects
        (end, size, rows, pieces, share): of all that reaches ``end``, the share that came over this piece.
        """
        finder, widest = self.finder(), self.longest
        n, k = len(codes), len(self.langs)
        active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(codes.shape[1] + 2))
        heads, alphas = {0: np.zeros(n, np.uint64)}, {0: np.ones((n, k))}
        scale, out = np.zeros((n, k)), np.zeros((n, k))
        for j in range(1, codes.shape[1] + 1):
            m = active[j]
            head = heads[j - 1][:m] * finder.base + codes[:m, j - 1].astype(np.uint64) + np.uint64(1)
            reached, steps = np.zeros((m, k)), []
            for size in range(1, min(j, widest) + 1):
                rows, piece = finder.find(head - heads[j - size][:m] * finder.powers[size])
                if size == 1 and len(rows) < m:  # a character that is no piece
                    every = np.full(m, len(self.index))
                    every[rows] = piece
                    rows, piece = np.arange(m), every
                elif not len(rows):
                    continue
                if len(rows) == m:
                    step = alphas[j - size][:m] * self.prob[piece]
                    reached += step
                else:
                    step = alphas[j - size][rows] * self.prob[piece]
                    reached[rows] += step
                steps.append((size, rows, piece, step))
            if edges is not None:
                edges += [(j, size, rows, piece, step / reached[rows]) for size, rows, piece, step in steps]
            heads[j], alphas[j] = head, reached
            heads.pop(j - widest, None)
            alphas.pop(j - widest, None)
            done = active[j + 1]
            out[done:m] = np.log(reached[done:]) + scale[done:m]
            if j % RESCALE == 0:
                top = reached.copy()
                scale[:m] += np.log(top)
                for at, alpha in alphas.items():
                    alphas[at] = alpha[:m] / top
        return out

    def expected(self, groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]], weight: np.ndarray) -> np.ndarray:
        """Expected piece counts, with ``weight`` times each word in each language."""
        counts = np.zeros_like(self.prob)
        for some, codes, lengths in groups:
            edges: list = []
            self.forward(codes, lengths, edges)
            # How much passes each place, from the ends of the words back to their beginnings.
            passing = np.zeros((codes.shape[1] + 1, len(codes), counts.shape[1]))
            passing[lengths, np.arange(len(codes))] = weight[some]
            for j, size, rows, piece, share in reversed(edges):
                mass = passing[j, rows] * share
                passing[j - size, rows] += mass
                for k in range(counts.shape[1]):
                    counts[:, k] += np.bincount(piece, mass[:, k], len(counts))
        return counts

    def finder(self) -> PieceFinder:
        if self._finder is None:
            self._finder = PieceFinder(self.index, self.longest)
        return self._finder


def like_lengths(words: list[str], cells: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, code points, lengths) of words of like lengths, longest first: about ``cells`` code points at a time."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(-lengths, kind="stable")
    out, low = [], 0
    while low < len(order):
        longest = int(lengths[order[low]])
        some = order[low : low + max(1, cells // longest)]
        own = lengths[some]
        raw = "".join([words[i] for i in some]).encode("utf-32-le", "surrogatepass")
        codes = np.zeros((len(some), longest), np.uint32)
        codes[np.arange(longest) < own[:, None]] = np.frombuffer(raw, np.uint32)
        out.append((some, codes, own))
        low += len(some)
    return out


class PieceFinder:
    """Finds pieces by a 64-bit polynomial hash of their code points: a byte filter, then a sorted search."""

    base = np.uint64(0x9E3779B97F4A7C15)
    bits = 20

    def __init__(self, index: dict[str, int], longest: int):
        hashes = np.array([self.hashed(p) for p in index], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.pieces = hashes[order], np.array(list(index.values()), np.int64)[order]
        self.powers = [np.uint64(pow(int(self.base), k, 1 << 64)) for k in range(longest + 1)]
        self.filter = np.zeros(1 << self.bits, bool)
        self.filter[self.slot(self.hashes)] = True

    def hashed(self, piece: str) -> int:
        out = 0
        for c in piece:
            out = (out * int(self.base) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return out

    def slot(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - self.bits)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that hold a piece, and the pieces."""
        rows = np.flatnonzero(self.filter[self.slot(hashes)])
        at = np.searchsorted(self.hashes, hashes[rows])
        at[at == len(self.hashes)] = 0
        right = self.hashes[at] == hashes[rows]
        return rows[right], self.pieces[at[right]]


def fit(
    langs: list[str], words: list[str], weight: np.ndarray, pieces: list[str], rounds: int = 4, smooth: float = 0.05
) -> Unigrams:
    """Piece probabilities from ``weight``, the count of each word (row) in each language (column)."""
    index = {p: i for i, p in enumerate(pieces)}
    prob = np.full((len(pieces) + 1, len(langs)), 1.0 / (len(pieces) + 1))
    prob[-1] = 1e-7
    model = Unigrams(langs, index, max(map(len, pieces)), prob)
    groups = like_lengths([MARK + w for w in words], (1 << 18) // len(langs))  # what is kept grows with both
    for _ in range(rounds):
        expected = model.expected(groups, weight) + smooth
        model.prob = expected / expected.sum(0)
    return model


def _lowered(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def learn(
    docs: DataFrame,
    lang: str = "lang",
    text: str = "text",
    sample_docs: int = 250,
    max_langs: int = 256,
    vocabulary: str = VOCABULARY,
) -> Unigrams | None:
    """A model of the labelled rows of ``docs`` that hold a word; None without any. The sample holds about
    ``sample_docs`` different texts of each language, at least one, however often each is repeated: its words and their
    counts are what reaches the driver."""
    lowered = _lowered(F.col(text))
    labelled = docs.where(F.col(lang).isNotNull() & lowered.rlike(WORD)).select(
        F.col(lang).alias("lang"), lowered.alias("text"), F.pmod(F.xxhash64(lowered), F.lit(1 << 53)).alias("h")
    )
    # Different texts are counted by a sketch, to some two per cent: that is as near as the draw comes anyway.
    have = (
        labelled.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n"), F.min("h").alias("least")).limit(max_langs + 1).collect()
    )
    if not have:
        return None
    if len(have) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    below = [(r["lang"], max(r["least"], math.ceil(min(1.0, sample_docs / r["n"]) * (1 << 53)))) for r in have]
    rates = docs.sparkSession.createDataFrame(below, "r_lang string, most long")
    drawn = labelled.join(F.broadcast(rates), F.col("lang") == F.col("r_lang")).where(F.col("h") <= F.col("most"))
    counted = (
        drawn.select("lang", "text").distinct().select("lang", F.explode(words(F.col("text"))).alias("word"))
        .groupBy("lang", "word").count()
    )
    table = counted.toArrow()
    langs = sorted(r["lang"] for r in have)
    own, word = (table[c].combine_chunks().dictionary_encode() for c in ("lang", "word"))
    found = word.dictionary.to_pylist()
    column = np.array([langs.index(x) for x in own.dictionary.to_pylist()])
    weight = np.zeros((len(found), len(langs)))
    np.add.at(weight, (word.indices.to_numpy(), column[own.indices.to_numpy()]), table["count"].to_numpy())
    # In an order of their own, so that the model doesn't hang on that of the rows.
    order = sorted(range(len(found)), key=found.__getitem__)
    return fit(langs, [found[i] for i in order], weight[order], vocabulary_pieces(vocabulary))


def has_letter(text: str) -> bool:
    """Numerals that aren't decimal digits pass the pattern, but are no letters."""
    return any(m[0].isalpha() for m in LETTER.finditer(text))


def tempered(scores: np.ndarray, foreign: float = FOREIGN) -> np.ndarray:
    """Each word comes from the language or, with probability ``foreign``, from all of them mixed: so a passage in
    another language weighs no more than its number of words."""
    mixed = np.logaddexp.reduce(scores, axis=1, keepdims=True) - np.log(scores.shape[1])
    return np.logaddexp(np.log1p(-foreign) + scores, np.log(foreign) + mixed)


def mostly_letters(word: str) -> bool:
    return 2 * sum(map(str.isalpha, word)) > len(word)


class WordCache:
    """Scores of up to ``most`` words: tempered log-probabilities, and for words mostly of letters the plain ones and the
    length. When full, the half met most often stays."""

    def __init__(self, model: Unigrams, most: int):
        self.model, self.most, self.k = model, most, len(model.langs)
        self.places: dict[bytes, int] = {}
        self.scores = np.zeros((0, 2 * self.k + 1))
        self.met = np.zeros(0, np.int64)

    def scored(self, words: list[str]) -> np.ndarray:
        plain = self.model.log_words(words)
        lettered = np.fromiter(map(mostly_letters, words), bool, len(words))[:, None]
        sizes = np.fromiter(map(len, words), np.float64, len(words))[:, None] + 1
        return np.concatenate([tempered(plain), np.where(lettered, plain, 0.0), np.where(lettered, sizes, 0.0)], axis=1)

    def totals(self, bags: list[Counter[bytes]]) -> list[tuple[np.ndarray, float | None]]:
        """For each bag of words its tempered log-probability by language, and the plain one of its best language for
        each character, over words mostly of letters; None without such words."""
        places = self.places
        fresh = list({w for bag in bags for w in bag if w not in places})
        for low in range(0, len(fresh), 100_000):
            part = fresh[low : low + 100_000]
            places.update(zip(part, range(len(self.scores), len(self.scores) + len(part)), strict=True))
            said = [w.decode("utf-8", "surrogatepass") for w in part]
            self.scores = np.concatenate([self.scores, self.scored(said)])
        self.met = np.concatenate([self.met, np.zeros(len(fresh), np.int64)])
        out = []
        for bag in bags:
            at = np.fromiter(map(places.__getitem__, bag), np.int64, len(bag))
            self.met[at] += 1
            total = np.fromiter(bag.values(), np.float64, len(bag)) @ self.scores[at]
            fit = float(total[self.k : -1].max() / total[-1]) if total[-1] else None
            out.append((total[: self.k], fit))
        if len(places) > self.most:
            stay = np.argpartition(-self.met, self.most // 2)[: self.most // 2]
            fresh_place = dict(zip(stay.tolist(), range(len(stay)), strict=True))
            self.places = {w: fresh_place[p] for w, p in places.items() if p in fresh_place}
            self.scores, self.met = self.scores[stay], self.met[stay] // 2
        return out


def identify(
    docs: DataFrame,
    model: Unigrams | None,
    doc_id: str = "doc_id",
    text: str = "text",
    cache: int = 120_000,
    keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """The columns ``keep`` (else the id as doc_id) with lang_pred, score and fit of each row. score is the posterior of
    the language, all equally likely before; fit tells how well even the best language explains the text: its
    log-probability for each character, over words mostly of letters (null without such words).

    The model (a row for each piece, a column for each language) is broadcast. Each Python worker keeps up to ``cache``
    words' scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    bound_batches(docs.sparkSession)
    kept = [F.col(f"`{c}`") for c in keep] if keep else [F.col(doc_id).cast("long").alias("doc_id")]
    slim = docs.select(*kept, _lowered(F.col(text)).alias("_scored_text"))
    names = slim.columns[:-1]
    made = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("fit", DoubleType())]
    schema = StructType([*slim.schema.fields[:-1], *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known = WordCache(model, cache) if model else None
        for batch in batches:
            texts = batch.column("_scored_text")
            labels, values, fits = [UNDETERMINED] * len(texts), [0.0] * len(texts), [None] * len(texts)
            for low in range(0, len(texts) if model else 0, 512):
                bags = []
                for k, text in enumerate(texts.slice(low, 512), low):
                    body = text.as_py()
                    if has_letter(body):
                        bags.append((k, Counter(body.encode("utf-8", "surrogatepass").split())))
                for (k, _), (total, fits[k]) in zip(bags, known.totals([bag for _, bag in bags]), strict=True):
                    best = int(total.argmax())
                    labels[k] = model.langs[best]
                    values[k] = float(1.0 / np.exp(np.maximum(total - total[best], -700)).sum())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(labels, pa.string()), pa.array(values, pa.float64()), pa.array(fits, pa.float64())],
                [*names, *(field.name for field in made)],
            )

    return slim.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Documents that must not teach: crc32 of the id as text, modulo 4, is 2. A null id teaches nothing either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
