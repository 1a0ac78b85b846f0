"""Language identification with segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.
The likelihood of a word is the sum, over all ways to cut it into pieces, of
the products of their probabilities; a forward pass over the word computes it.
A text's likelihood is the product over its words, whole text, every word.

The probabilities are learned by expectation maximisation over a bounded sample
of the labelled rows: Spark counts the sample's words, tasks compute expected
piece counts with a forward and a backward pass, and a table of at most
(languages x pieces) sums comes back in each round.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import stored
from tessera.operators.ordering import broadcast_if_small

UNKNOWN = "und"
WORD = regex.compile(r"\p{L}+")
#: Marks the start of a word in the vocabulary.
START = "▁"
#: Words longer than this are passed over one at a time, in chunks of positions; others together with those as long.
ALONE, CHUNK = 512, 1 << 16
#: Positions between two scalings: what lies between is far within the range of doubles.
RESCALE = 8
#: Characters and words of text handled at a time; words whose scores a worker remembers.
SLICE_CHARS = 2_000_000
SLICE_WORDS = 400_000
REMEMBERED = 300_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


def words_of(text: str) -> Iterator[list[str]]:
    """The lower-cased letter runs of a text, in lists of bounded length."""
    low = text.lower()
    if len(low) <= SLICE_CHARS:
        yield WORD.findall(low)
        return
    found = WORD.finditer(low)
    while part := [m.group() for m in islice(found, SLICE_WORDS)]:
        yield part


def public_pieces(name: str) -> list[str]:
    """Pieces of a public SentencePiece vocabulary that lower-cased words can hold: letters, and the start mark."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    every = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    shape = regex.compile(START + r"?\p{L}*")
    return sorted({p for p in every if p and shape.fullmatch(p) and p == p.lower()} | {START})


class Pieces:
    """Hash table from the rolling hash of a substring to the number of its piece.

    Number ``len(pieces)`` stands for a letter that is no piece, ``len(pieces) + 1`` for no piece at all.
    """

    def __init__(self, pieces: list[str]):
        self.n = len(pieces)
        self.longest = max(map(len, pieces))
        size = 1 << int(np.ceil(np.log2(self.n * 8)))
        self.mask = size - 1
        self.keys = np.zeros(size, np.uint64)
        self.values = np.full(size, self.n + 1, np.int32)
        self.probes = 1
        for number, piece in enumerate(pieces):
            h = 0
            for ch in piece:
                h = (h * int(_BASE) + ord(ch) + 1) & (2**64 - 1)
            at, probe = int(self._place(np.array([h], np.uint64))[0]), 1
            while self.values[at] <= self.n:
                at, probe = (at + 1) & self.mask, probe + 1
            self.keys[at], self.values[at] = h, number
            self.probes = max(self.probes, probe)

    def _place(self, h: np.ndarray) -> np.ndarray:
        return (((h ^ (h >> np.uint64(31))) * _SPREAD) >> np.uint64(40)).astype(np.int64) & self.mask

    def find(self, h: np.ndarray) -> np.ndarray:
        at = self._place(h)
        out = np.where(self.keys[at] == h, self.values[at], self.n + 1)
        open_ = np.flatnonzero((out > self.n) & (self.values[at] <= self.n))  # another piece sits there
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & self.mask
            own = at[open_]
            out[open_] = np.where(self.keys[own] == h[open_], self.values[own], self.n + 1)
            open_ = open_[(out[open_] > self.n) & (self.values[own] <= self.n)]
        return out


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of the words, their code points with the start mark) for each length, a few at a time."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(sizes):
        which = np.flatnonzero(sizes == n)
        step = max(1, 400_000 // int(n))
        for low in range(0, len(which), step):
            own = which[low : low + step]
            codes = np.frombuffer("".join([START + words[i] for i in own]).encode("utf-32-le"), np.uint32)
            yield own, codes.reshape(len(own), -1)


def _spans(pieces: Pieces, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(start, end, piece number of each word's substring), ends in ascending order."""
    m, n = codes.shape
    rolling: list[np.ndarray] = []  # rolling[d]: hash of the substring that ended before and started d earlier
    for end in range(1, n + 1):
        code = codes[:, end - 1].astype(np.uint64) + np.uint64(1)
        rolling = [code] + [h * _BASE + code for h in rolling[: pieces.longest - 1]]
        for back, h in enumerate(rolling, 1):
            number = pieces.find(h)
            if back == 1:
                number = np.minimum(number, pieces.n)  # a letter of its own
            if back == 1 or (number < pieces.n).any():
                yield end - back, end, number


def _ends(pieces: Pieces, codes: np.ndarray, low: int, high: int) -> np.ndarray:
    """Piece numbers of the substrings of one word that end before the positions low + 1 .. high, by length (1 first)."""
    first = max(0, low - pieces.longest + 1)
    code = codes[first:high].astype(np.uint64) + np.uint64(1)
    out = np.full((high - low, pieces.longest), pieces.n + 1, np.int32)
    rolling = code
    for back in range(1, pieces.longest + 1):
        if back > 1:
            rolling = rolling[:-1] * _BASE + code[back - 1 :]
        number = pieces.find(rolling)
        if back == 1:
            number = np.minimum(number, pieces.n)  # a letter of its own
        ends = np.arange(first + back, high + 1)
        out[ends[ends > low] - low - 1, back - 1] = number[ends > low]
    return out


def _long_log_likelihood(word: str, pieces: Pieces, probs: np.ndarray) -> np.ndarray:
    """``log_likelihood`` of one word of any length, with a window of the longest piece."""
    codes = np.frombuffer((START + word).encode("utf-32-le"), np.uint32)
    d, scale = pieces.longest, np.zeros(probs.shape[1])
    window = np.zeros((d, probs.shape[1]))
    window[-1] = 1
    for low in range(0, len(codes), CHUNK):
        steps = probs[_ends(pieces, codes, low, min(low + CHUNK, len(codes)))[:, ::-1]]
        held = np.concatenate([window, np.zeros((len(steps), probs.shape[1]))])
        for j, step in enumerate(steps):
            held[d + j] = (held[j : j + d] * step).sum(axis=0)
            if j % RESCALE == RESCALE - 1:
                top = held[j + 1 : j + d + 1].max(axis=0)
                held[j + 1 : j + d + 1] /= top
                scale += np.log(top)
        window = held[len(steps) :].copy()
    return np.log(window[-1]) + scale


def log_likelihood(words: list[str], pieces: Pieces, probs: np.ndarray) -> np.ndarray:
    """Log of the sum over all segmentations, for each word (rows) and language (columns of ``probs``).

    ``probs`` has a row per piece, one for a letter that is no piece, and a row of zeros.
    """
    out = np.zeros((len(words), probs.shape[1]))
    alone = [i for i, w in enumerate(words) if len(w) > ALONE]
    for i in alone:
        out[i] = _long_log_likelihood(words[i], pieces, probs)
    rest = np.array([i for i, w in enumerate(words) if len(w) <= ALONE], np.int64) if alone else np.arange(len(words))
    for own, codes in _by_length([words[i] for i in rest] if alone else words):
        m, n = codes.shape
        forward = np.zeros((n + 1, m, probs.shape[1]))
        forward[0] = 1
        scale, at = np.zeros((m, probs.shape[1])), 0
        for start, end, number in _spans(pieces, codes):
            if end > at and end % RESCALE == 1 and end > 1:
                low = max(0, end - pieces.longest)
                top = forward[low:end].max(axis=0)
                forward[low:end] /= top
                scale += np.log(top)
            at = end
            forward[end] += forward[start] * probs[number]
        out[rest[own]] = np.log(forward[n]) + scale
    return out


def _long_expected_counts(word: str, weight: float, pieces: Pieces, probs: np.ndarray, out: np.ndarray) -> None:
    """Add the expected counts of one word of any length."""
    codes = np.frombuffer((START + word).encode("utf-32-le"), np.uint32)
    n, d = len(codes), pieces.longest
    # values are scaled in the window that is still used; logs[i] is what position i was divided by in all
    forward, forward_log = np.zeros(n + 1 + d), np.zeros(n + 1 + d)  # position i is at i + d
    forward[d], now = 1, 0.0
    for low in range(0, n, CHUNK):
        steps = probs[_ends(pieces, codes, low, min(low + CHUNK, n))[:, ::-1]]
        for j, step in enumerate(steps, low + 1):
            forward[d + j], forward_log[d + j] = (forward[j : j + d] * step).sum(), now
            if j % RESCALE == 0:
                top = forward[j + 1 : j + d + 1].max()
                forward[j + 1 : j + d + 1] /= top
                forward_log[j + 1 : j + d + 1] += np.log(top)
                now += np.log(top)
    backward, backward_log = np.zeros(n + 1 + d), np.zeros(n + 1 + d)  # position i is at i
    backward[n], now = 1, 0.0
    total = np.log(forward[d + n]) + forward_log[d + n]
    for low in reversed(range(0, n, CHUNK)):
        high = min(low + CHUNK, n)
        ends = _ends(pieces, codes, low, min(high + d, n))  # by end; taken by start below
        number = np.full((high - low, d), pieces.n + 1, np.int32)
        for back in range(1, d + 1):
            starts = np.arange(low, min(high, n - back + 1))
            number[starts - low, back - 1] = ends[starts + back - low - 1, back - 1]
        steps = probs[number]
        for i in range(high - 1, low - 1, -1):
            backward[i], backward_log[i] = (backward[i + 1 : i + d + 1] * steps[i - low]).sum(), now
            if (n - i) % RESCALE == 0:
                top = backward[i : i + d].max()
                backward[i : i + d] /= top
                backward_log[i : i + d] += np.log(top)
                now += np.log(top)
        starts = np.arange(low, high)
        for back in range(1, d + 1):
            at = starts[starts + back <= n]
            share = np.exp(forward_log[d + at] + backward_log[at + back] - total)
            used = forward[d + at] * steps[at - low, back - 1] * backward[at + back] * share
            out += np.bincount(number[at - low, back - 1], used * weight, len(out))


def expected_counts(words: list[str], weights: np.ndarray, pieces: Pieces, probs: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece under ``probs`` (one language), words counted ``weights`` times."""
    out = np.zeros(pieces.n + 2)
    for w, weight in zip(words, weights):
        if len(w) > ALONE:
            _long_expected_counts(w, weight, pieces, probs, out)
    short = [i for i, w in enumerate(words) if len(w) <= ALONE]
    words, weights = [words[i] for i in short], weights[short]
    for own, codes in _by_length(words):
        m, n = codes.shape
        spans = list(_spans(pieces, codes))
        passes = []
        for order, first, turn in ((spans, 0, 1), (sorted(spans, key=lambda s: -s[0]), n, -1)):
            value, logs, now, at = np.zeros((n + 1, m)), np.zeros((n + 1, m)), np.zeros(m), first
            value[first] = 1
            for start, end, number in order:
                source, to = (start, end) if turn == 1 else (end, start)
                if to != at:
                    if abs(at - first) % RESCALE == 0 and at != first:
                        near = slice(max(0, at - pieces.longest + 1), at + 1) if turn == 1 else slice(at, at + pieces.longest)
                        top = value[near].max(axis=0)
                        value[near] /= top
                        logs[near] += np.log(top)
                        now = now + np.log(top)
                    at, logs[to] = to, now
                value[to] += value[source] * probs[number]
            passes.append((value, logs))
        (forward, forward_log), (backward, backward_log) = passes
        weight = weights[own] / forward[n]
        for start, end, number in spans:
            share = np.exp(forward_log[start] + backward_log[end] - forward_log[n])
            out += np.bincount(number, forward[start] * probs[number] * backward[end] * share * weight, len(out))
    out[-1] = 0
    return out


@dataclass(frozen=True)
class Model:
    """``probs`` has a row per piece, one for unknown letters and one of zeros; a column per language."""

    languages: tuple[str, ...]
    vocabulary: str
    probs: np.ndarray


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          vocabulary: str = "piece_bpe_32k.model", docs_per_language: int = 400, rounds: int = 3,
          smoothing: float = 0.05) -> Model:
    """Piece probabilities of every language of ``labelled``.

    At most ``docs_per_language`` rows of a language are used: those whose id hashes lowest, so the same
    rows at any partitioning. They are chosen from ids and labels alone (rows are counted per language, and
    only ids with hashes in the lowest part that surely holds enough are ranked); their texts (whole) are
    read afterwards. Rows with a null id, text or label are not used; no row at all gives a model without
    languages, which answers ``und``.
    """
    spark = labelled.sparkSession
    usable = labelled.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    hashed = usable.select(id_col, lang_col, F.xxhash64(F.col(id_col).cast("string")).alias("__hash"))
    part = F.least(F.lit(1.0), F.lit(4.0 * docs_per_language + 100) / F.col("count"))
    limits = usable.groupBy(F.col(lang_col).alias("__lang")).count().select(  # a row per language
        "__lang", (part * 2.0**64 - 2.0**63).alias("__limit"))
    near = hashed.join(broadcast_if_small(limits), F.col(lang_col) == F.col("__lang")).where(
        F.col("__hash").cast("double") <= F.col("__limit"))
    order = Window.partitionBy(lang_col).orderBy("__hash", id_col)
    chosen = near.withColumn("__rank", F.row_number().over(order))
    chosen = stored(chosen.where(F.col("__rank") <= docs_per_language).select(F.col(id_col).alias("__id")), "lang-rows")
    sample = usable.join(broadcast_if_small(chosen), F.col(id_col) == F.col("__id"), "left_semi").select(lang_col, text_col)

    def count(batches):
        for pdf in batches:
            for lang, text in zip(pdf[lang_col], pdf[text_col]):
                for found in words_of(text):
                    if found:
                        kinds = pd.Series(found).value_counts()
                        yield pd.DataFrame({"lang": lang, "word": kinds.index, "n": kinds.to_numpy()})

    words = stored(sample.mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(
        F.sum("n").alias("n")), "lang-words")
    languages = tuple(sorted(r["lang"] for r in words.select("lang").distinct().collect()))
    names = public_pieces(vocabulary)
    rows = len(names) + 2
    probs = np.ones((rows, max(1, len(languages))))
    # every letter costs the same at first, so that a cut into longer pieces is neither favoured nor hindered
    probs[:-2] = np.array([(1 / 64.0) ** len(p) for p in names])[:, None]
    probs[-2], probs[-1] = 1 / 4096.0, 0
    for _ in range(rounds if languages else 0):
        sent = spark.sparkContext.broadcast(probs)  # one row per piece of the fixed vocabulary

        def expect(batches):
            pieces, got = Pieces(public_pieces(vocabulary)), {}
            for pdf in batches:
                for lang, group in pdf.groupby("lang"):
                    p = sent.value[:, languages.index(lang)]
                    c = expected_counts(group.word.tolist(), group.n.to_numpy(float), pieces, p)
                    got[lang] = got.get(lang, 0) + c
            for lang, c in got.items():
                used = np.flatnonzero(c)
                yield pd.DataFrame({"lang": lang, "piece": used, "n": c[used]})

        sums = words.mapInPandas(expect, "lang string, piece int, n double").groupBy("lang", "piece").agg(
            F.sum("n").alias("n")).toPandas()  # languages x pieces rows at most
        counts = np.zeros_like(probs)
        counts[sums.piece.to_numpy(int), [languages.index(x) for x in sums.lang]] = sums.n.to_numpy(float)
        counts[:-1] += smoothing
        probs = counts / counts.sum(axis=0)
        if not np.isfinite(probs).all():
            raise ArithmeticError("piece probabilities are not finite")
    return Model(languages, vocabulary, probs)


def identify(docs: DataFrame, model: Model, text_col: str = "text", carry: Sequence[str] = ("doc_id",),
             pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """The carried columns, the predicted language and its score of every row, from its whole text alone.

    ``score`` is the posterior of the predicted language under equal priors. A null text, one without a
    letter, or a model without languages gives ``und`` with score 0; a tie goes to the language that
    sorts first. Repeated rows are predicted each; columns not named in ``carry`` are not read, carried ones
    with the names of the two new columns are replaced; an empty table gives no rows.
    """
    kept = [c for c in carry if c not in (pred_col, score_col)]
    schema = docs.select(kept).schema.add(pred_col, "string").add(score_col, "double")
    sent = docs.sparkSession.sparkContext.broadcast(model)  # one row per piece of the fixed vocabulary

    def predict(batches):
        languages, probs = sent.value.languages, sent.value.probs
        pieces = Pieces(public_pieces(sent.value.vocabulary)) if languages else None
        numbers: dict[str, int] = {}
        table = np.zeros((0, probs.shape[1]))

        def look_up(found: list[str]) -> np.ndarray:
            nonlocal table
            new = [w for w in set(found) if w not in numbers]
            if len(numbers) + len(new) > REMEMBERED:
                numbers.clear()
                table, new = table[:0], list(set(found))
            if new:
                rows = log_likelihood(new, pieces, probs)
                numbers.update(zip(new, range(len(table), len(table) + len(new))))
                table = np.concatenate([table, rows])
            return table[np.fromiter(map(numbers.__getitem__, found), np.int64, len(found))]

        for batch in batches:
            total = np.zeros((len(batch), probs.shape[1]))
            letters = np.zeros(len(batch), bool)
            held: list[str] = []
            owner: list[tuple[int, int]] = []

            def settle():
                if held:
                    at = np.repeat([i for i, _ in owner], [n for _, n in owner])
                    got = look_up(held)
                    for g in range(got.shape[1]):
                        total[:, g] += np.bincount(at, got[:, g], len(total))
                    held.clear()
                    owner.clear()

            for i, text in enumerate(batch.column(len(kept)) if languages else []):
                for found in words_of(text.as_py() or ""):
                    letters[i] |= bool(found)
                    held += found
                    owner.append((i, len(found)))
                    if len(held) >= SLICE_WORDS:
                        settle()
            settle()
            best = total.argmax(axis=1)
            odds = np.exp(total - total.max(axis=1, keepdims=True))
            score = np.where(letters, 1 / odds.sum(axis=1), 0.0)
            pred = [languages[b] if has else UNKNOWN for b, has in zip(best, letters)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(pred, pa.string()), pa.array(score)],
                                             schema.names)

    return docs.select(*kept, F.col(text_col).alias("__text")).mapInArrow(predict, schema)


def held_out(id_col: str = "doc_id"):
    """True for a third of the ids, by checksum; they are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
