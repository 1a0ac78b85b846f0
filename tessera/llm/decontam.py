"""Benchmark decontamination: BM25 retrieval of test items by training passages, then overlap checks.

The test items form an inverted index with BM25 impacts, in blocks of items of
which each term keeps the largest impact. Every passage of every document is a
query. Its upper bound over a block is the sum of the block maxima of its
terms, for many passages in one step; passages that reach the threshold in no block
are done, for the others block-max WAND finds every item above the threshold. A retrieved item counts as
leaked if the passage holds at least ``min_overlap`` of its five-word shingles and both its question and its
answer are verified there: at least ``min_part`` of the different words of each. So a whole question with
another answer, or without one, is no leak, however long the question; an item of one sentence has no answer to verify.

Items are indexed by length class (a power of two words, ``LEAST_CLASS`` at least), and a class has passages of
its own: four times its length, one beginning with every length. So a stretch of three lengths lies whole in a passage,
and whether an item is found does not depend on which other items there are.

An item's impacts are divided by its own score as a query and by the least share
of that score that a passage holding ``min_overlap`` of its shingles can have, so
that the threshold is 1 for every item and retrieval loses none that the overlap
accepts. Passages are searched with the same words that the overlap looks at. Items are read in parts of bounded size
(an index for each class of each, made in the tasks from the broadcast texts); documents are
scanned once for each part, without a shuffle.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of item texts of one index part (a posting takes two of them at least, about 90 in memory), items of one block, words of a shingle, words of the shortest class.
PART_BYTES = 4 << 20
BLOCK_ITEMS = 4
SHINGLE = 5
LEAST_CLASS = 64
#: A passage is so many lengths of its class.
STEPS = 4
#: Words of texts searched in one step (a longer text is a step of its own), and block maxima added up in one.
SLICE_WORDS = 100_000
SLICE_MAXIMA = 400_000
K1, B = 1.2, 0.75
#: Least share of the different words of an item's question, and of its answer, that a passage must hold.
MIN_PART = 0.5
_LETTERS = bytes.maketrans(bytes(c for c in range(128) if not chr(c).isalnum()),
                           b" " * sum(not chr(c).isalnum() for c in range(128)))


def terms_of(text: str | None) -> list[bytes]:
    """Lower-cased words without ASCII punctuation."""
    return (text or "").lower().encode().translate(_LETTERS).split()


def question_and_answer(text: str | None) -> tuple[str, str]:
    """An item's last sentence is its answer, what stands before it the question (all, if it is one sentence)."""
    parts = re.split(r"(?<=[.?!])\s+", (text or "").strip())
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (parts[0], "")


def shingles(words: list[bytes], size: int = SHINGLE) -> set[tuple[bytes, ...]]:
    """Runs of ``size`` words; fewer words are one run."""
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def share_held(part: list[bytes], passage: list[bytes]) -> float | None:
    """Share of the part's shingles that the passage holds; null for a part without words."""
    if not part:
        return None
    own = shingles(part)
    return len(own & shingles(passage, min(SHINGLE, len(part)))) / len(own)


def words_held(part: list[bytes], passage: set[bytes]) -> float:
    """Share of the part's different words that the passage holds; 1 for a part without words."""
    own = set(part)
    return len(own & passage) / len(own) if own else 1.0


def least_share(words: list[bytes], weight: dict[bytes, float], min_overlap: float) -> float:
    """Lower bound of the weight of the item's terms in a text that holds ``min_overlap`` of its shingles.

    ``weight`` sums to 1. A term is missing only if all shingles with it are, so each missing shingle takes
    at most an equal part of each of its terms.
    """
    own = shingles(words)
    missing = len(own) - math.ceil(min_overlap * len(own) - 1e-9)
    among = Counter(t for s in own for t in set(s))
    parts = sorted((sum(weight[t] / among[t] for t in set(s)) for s in own), reverse=True)
    return max(1e-9, 1 - sum(parts[:missing]))


class Maxima:
    """The largest impact of each term in each block of items that it occurs in, term by term."""

    def __init__(self, postings: list[list[tuple[int, float]]], items: int, n: int):
        sizes = np.fromiter((len(own) for own in postings), np.int64, len(postings))
        term = np.repeat(np.arange(len(postings)), sizes)
        block = np.fromiter((i // items for own in postings for i, _ in own), np.int32, len(term))
        impact = np.fromiter((x for own in postings for _, x in own), np.float32, len(term))
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        first = np.flatnonzero(new)
        self.n_blocks = max(1, -(-n // items))
        self.block = block[first]
        self.top = np.maximum.reduceat(impact, first) if len(first) else impact
        self.start = np.concatenate([[0], np.cumsum(np.bincount(term[first], minlength=len(postings)))])

    def of(self, term: int) -> dict[int, float]:
        low, high = self.start[term], self.start[term + 1]
        return dict(zip(self.block[low:high].tolist(), self.top[low:high].tolist()))

    def bounds(self, window: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """For each of ``n`` windows the largest sum over one block of its terms' maxima; pairs come sorted by window."""
        sizes = self.start[term + 1] - self.start[term]
        cost = np.cumsum(np.bincount(window, sizes + 1, n) + self.n_blocks)
        out, low = np.zeros(n), 0
        while low < n:
            done = cost[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(cost, done + SLICE_MAXIMA)))
            own = slice(*np.searchsorted(window, (low, high)))
            k = sizes[own]
            at = np.repeat(self.start[term[own]] - np.cumsum(k) + k, k) + np.arange(k.sum())
            place = (np.repeat(window[own], k) - low) * self.n_blocks + self.block[at]
            out[low:high] = np.bincount(place, self.top[at], (high - low) * self.n_blocks).reshape(high - low, -1).max(axis=1)
            low = high
        return out


class Index:
    """Postings of the items' terms with normalised impacts, and their maxima per block of items.

    With ``min_overlap`` the impacts are also divided by ``least_share``, kept in ``least``.
    """

    def __init__(self, items: list[tuple[object, str | None]], min_overlap: float | None = None):
        self.items = [(item, terms_of(text)) for item, text in items]
        self.items = [x for x in self.items if x[1]]
        texts = dict(items)
        self.parts = [[terms_of(x) for x in question_and_answer(texts[item])] for item, _ in self.items]
        counts = [Counter(words) for _, words in self.items]
        df = Counter(t for c in counts for t in c)
        self.number = {t: i for i, t in enumerate(sorted(df))}
        n, mean = len(counts), sum(len(w) for _, w in self.items) / max(1, len(self.items))
        idf = {t: math.log(1 + (n - d + 0.5) / (d + 0.5)) for t, d in df.items()}
        self.postings: list[list[tuple[int, float]]] = [[] for _ in df]
        self.least = [1.0] * n
        for i, c in enumerate(counts):
            length = sum(c.values())
            raw = {t: idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean)) for t, tf in c.items()}
            own = sum(raw.values())
            if min_overlap is not None:
                self.least[i] = least_share(self.items[i][1], {t: x / own for t, x in raw.items()}, min_overlap)
                own *= self.least[i]
            for t, x in raw.items():
                self.postings[self.number[t]].append((i, x / own))
        self.fine = Maxima(self.postings, BLOCK_ITEMS, n)
        self.term_max = [max(x for _, x in own) for own in self.postings]
        self.step = length_class(max((len(w) for _, w in self.items), default=0))

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """Block-max WAND: every (item, score) of at least ``threshold``; ``terms`` are distinct."""
        lists = [self.postings[t] for t in terms]
        at = [0] * len(lists)
        slack = threshold - 1e-6  # bounds are single precision
        live = list(range(len(lists)))
        found: list[tuple[int, float]] = []
        terms_max = [self.term_max[t] for t in terms]
        blocks_max = [self.fine.of(t) for t in terms]
        while live:
            live.sort(key=lambda c: lists[c][at[c]][0])
            bound, pivot = 0.0, -1
            for rank, c in enumerate(live):
                bound += terms_max[c]
                if bound >= slack:
                    pivot = rank
                    break
            if pivot < 0:
                break
            item = lists[live[pivot]][at[live[pivot]]][0]
            while pivot + 1 < len(live) and lists[live[pivot + 1]][at[live[pivot + 1]]][0] == item:
                pivot += 1
            block = item // BLOCK_ITEMS
            if sum([blocks_max[c].get(block, 0.0) for c in live[: pivot + 1]]) < slack:
                # nothing in this block reaches the threshold by the lists up to the pivot
                target = (block + 1) * BLOCK_ITEMS
                if pivot + 1 < len(live):
                    target = min(target, lists[live[pivot + 1]][at[live[pivot + 1]]][0])
                moved = live[: pivot + 1]
            elif lists[live[0]][at[live[0]]][0] == item:
                score = 0.0
                for c in live[: pivot + 1]:
                    score += lists[c][at[c]][1]
                if score >= threshold:
                    found.append((item, score))
                target, moved = item + 1, live[: pivot + 1]
            else:
                target, moved = item, [c for c in live[: pivot + 1] if lists[c][at[c]][0] < item]
            for c in moved:
                at[c] = bisect_left(lists[c], (target, -1.0), at[c])
            live = [c for c in live if at[c] < len(lists[c])]
        return found


def length_class(words: int) -> int:
    return max(LEAST_CLASS, 1 << max(0, words - 1).bit_length())


def _open_passages(texts: list[list[bytes]], index: Index, threshold: float) -> Iterator[tuple[int, int, list[int]]]:
    """(text, first word, distinct terms) of the passages that may reach the threshold: ``STEPS`` steps every step."""
    known, step = index.number, index.step
    n = np.array([len(words) for words in texts])
    ids = np.concatenate([np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words)) for words in texts])
    passages = np.maximum(1, -(-n // step) - STEPS + 1)
    first = np.cumsum(passages) - passages
    text = np.repeat(np.arange(len(texts)), n)
    place = np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)
    seen = ids >= 0
    ids, text, at = ids[seen], text[seen], place[seen] // step
    # a word lies in the passage that begins with its step and in those that began with the steps before
    per_step = np.unique((text * (int(at.max(initial=0)) + 1) + at) * len(known) + ids)
    rest, ids = np.divmod(per_step, len(known))
    text, at = np.divmod(rest, int(at.max(initial=0)) + 1)
    held = [(at >= back) & (at - back < passages[text]) for back in range(STEPS)]
    pairs = np.unique(np.concatenate([(first[text] + at - back)[own] * len(known) + ids[own] for back, own in enumerate(held)]))
    if not len(pairs):
        return
    window, term = np.divmod(pairs, len(known))
    total = int(passages.sum())
    for w in np.flatnonzero(index.fine.bounds(window, term, total) >= threshold - 1e-3).tolist():
        k = int(np.searchsorted(first, w, "right")) - 1
        yield k, (w - int(first[k])) * step, term[slice(*np.searchsorted(window, (w, w + 1)))].tolist()


def leaks_in(texts: list[list[bytes]], index: Index, min_overlap: float, min_part: float = MIN_PART) -> Iterator[tuple[int, int, tuple]]:
    """(text, item, (score, overlap, question's share, answer's share)) of all leaks, the best passage of each.

    ``index`` is one for ``min_overlap``.
    """
    threshold = 1 - 1e-6
    best: dict[tuple[int, int], tuple] = {}
    for k, start, terms in _open_passages(texts, index, threshold):
        for item, score in index.search(terms, threshold):
            around = texts[k][start : start + STEPS * index.step]
            share = share_held(index.items[item][1], around)
            if share >= min_overlap and all(words_held(part, set(around)) >= min_part for part in index.parts[item]):
                got = (score * index.least[item], share, *(share_held(part, around) for part in index.parts[item]))
                best[k, item] = max(best.get((k, item), got), got, key=lambda x: (x[1], x[0]))
    for (k, item), got in best.items():
        yield k, item, got


def leaks_of(words: list[bytes], index: Index, min_overlap: float, min_part: float = MIN_PART) -> dict[int, tuple]:
    """item -> (score, overlap, question's share, answer's share) of the items that one text leaks."""
    return {item: got for _, item, got in leaks_in([words], index, min_overlap, min_part)} if words else {}


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text", min_overlap: float = 0.8,
               min_part: float = MIN_PART) -> DataFrame:
    """(id, item, score, overlap, question_overlap, answer_overlap): the items that each row leaks.

    ``score`` is BM25 of the best passage as a part of the item's own score; ``overlap`` the share of the
    item's five-word shingles in that passage, ``question_overlap`` and ``answer_overlap`` those of its two
    parts (null where the part has no word). The passage must also hold ``min_part`` of the different words of the
    question and of the answer (0 switches that off). Rows with null or empty text leak nothing; items with null
    or empty text are never leaked; repeated rows and items are answered each; null ids are carried;
    other columns are not read; empty tables give no rows. Whole texts are searched. Which items are found does not
    depend on the others; ``score`` does, as its idf and mean length are those of the item's part and class.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    item_type = items.schema[item_col].dataType.simpleString()
    own = items.select(item_col, F.col(item_text_col).alias("__text")).where(F.col("__text").isNotNull())
    own = own.groupBy(item_col, "__text").agg(F.count("*").alias("__rows"))
    total = own.agg(F.coalesce(F.sum(F.octet_length("__text")), F.lit(0))).first()[0]
    n_parts = max(1, -(-total // PART_BYTES))
    schema = (f"`{id_col}` {id_type}, `{item_col}` {item_type}, score double, overlap double, "
              "question_overlap double, answer_overlap double")
    out = None
    for k in range(n_parts):
        part = own if n_parts == 1 else own.where(F.pmod(F.xxhash64("__text", item_col), F.lit(n_parts)) == k)
        # about PART_BYTES of items; one repeated with its id is sent once with its number of rows
        rows = [(i, r[0], r[1], r[2]) for i, r in enumerate(part.collect())]
        sent = spark.sparkContext.broadcast(rows)

        def search(batches, sent=sent):
            classes: dict[int, list] = {}
            for i, _, text, _ in sent.value:
                classes.setdefault(length_class(len(terms_of(text))), []).append((i, text))
            indexes = [Index(own, min_overlap) for own in classes.values()]
            names = {i: (item, n) for i, item, _, n in sent.value}
            for batch in batches:
                at, hits, held, first = [], [], [], 0

                def settle(first, held):
                    for index in indexes:
                        for k, item, got in leaks_in(held, index, min_overlap, min_part):
                            name, n = names[index.items[item][0]]
                            at.extend([first + k] * n)
                            hits.extend([(name, *got)] * n)

                size = 0
                for i, text in enumerate(batch.column(1)):
                    words = terms_of(text.as_py())
                    if held and size + len(words) > SLICE_WORDS:
                        settle(first, held)
                        first, held, size = i, [], 0
                    held.append(words)
                    size += len(words)
                if held:
                    settle(first, held)
                if at:
                    columns = list(zip(*hits))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(at)), pa.array(columns[0]),
                         *[pa.array(c, pa.float64()) for c in columns[1:]]],
                        [id_col, item_col, "score", "overlap", "question_overlap", "answer_overlap"])

        found = docs.select(id_col, text_col).mapInArrow(search, schema)
        out = found if out is None else out.unionByName(found)
    return out
