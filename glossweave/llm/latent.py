"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into passages of ``PASSAGE`` words, each half over the next, and
written as TF-IDF rows over the terms of the benchmark. A randomised singular
value decomposition of these rows, together with those of the benchmark items, is
computed by Spark: a task multiplies its own rows with a random matrix and back,
and the small products are added up. Passages and items meet in the latent space;
what is near by cosine, or has ``SEED_WORDS`` words of an item in sequence (so every
verbatim item), is checked word by word where enough of the item's words are there, by the longest common subsequence
with the item and by whether the item's answer, its last sentence, is there.

Texts are read once: of each document the places of benchmark terms are kept,
which is all that the later passes, the checks included, need, since an item's
words are benchmark terms. The benchmark is a stated set of queries, run against
all passages in blocks of ``ITEMS`` items; what goes to every task is bounded by
a block.

A term takes part in the rows if few passages have it, or if it is among the
``KEPT_TERMS`` rarest of an item, so an item that leaked everywhere keeps terms. Its
weight has a floor for the same reason.

Defined results: null and empty texts, and items without words, match nothing; an
item of under ``SHORT`` words matches where it stands whole and in sequence; items
with equal texts are all reported; rows with equal keys are searched as rows and
reported once per item; a null key is reported as null. Empty tables give no rows.
Only the named columns are read, so extra columns cannot clash, except in
:func:`clean_documents`, which keeps the columns as given.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import in_pieces

PASSAGE = 64
STEP = PASSAGE // 2
ITEMS = 2_000
MAX_SHARE = 0.01
KEPT_TERMS = 12
MIN_WEIGHT = 0.5
#: Dimensions at least; a block of many items has one for so many items.
RANK = 96
ITEMS_PER_RANK = 4
OVERSAMPLE = 16
MIN_COSINE = 0.4
#: Share of an item's words, in order, that makes a passage a copy; or, with as much of the answer, a paraphrase.
COPY_SHARE = 0.8
PARAPHRASE_SHARE = 0.6
ANSWER_SHARE = 0.8
SHORT = 8
#: Words of an item in sequence that make a passage a candidate whatever its cosine.
SEED_WORDS = 4
MIN_ANSWER = 3
#: A term that few passages and items have, and words of an item, for which shared rare words are counted.
RARE_SHARE = 0.05
RARE_ITEMS = 16
RARE_LENGTH = 4 * PASSAGE
#: Row entries held at a time, and made a dense block of.
GROUP_ENTRIES = 20_000
DENSE_ENTRIES = 2_000
#: Places about the passages of candidates that are compared with items at a time.
PAIR_PLACES = 200_000
#: Partial products added up by one task at a time.
FAN_IN = 64

_PUNCTUATION = ".,;:!?()[]{}\"'`<>|*#$%&"
_BLANKS = bytes.maketrans(_PUNCTUATION.encode(), b" " * len(_PUNCTUATION))


def terms_of(text: str | None) -> list[bytes]:
    """Lower-cased words without punctuation, in UTF-8."""
    return text.lower().encode().translate(_BLANKS).split() if text else []


class Item(NamedTuple):
    ids: list[int]
    terms: np.ndarray
    answer: np.ndarray


class Queries(NamedTuple):
    vocabulary: dict[bytes, int]
    items: list[Item]


def build_queries(rows: list[tuple[int, str | None]]) -> Queries:
    """Items with different texts, and the numbers of their terms."""
    by_text: dict[str, list[int]] = {}
    for item_id, text in rows:
        if terms_of(text):
            by_text.setdefault(text, []).append(item_id)
    vocabulary: dict[bytes, int] = {}
    items = []
    for text, ids in sorted(by_text.items()):
        numbers = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in terms_of(text)], np.int64)
        answer: list[bytes] = []
        for sentence in reversed(re.split(r"[.?!\n]+", text)):
            answer = terms_of(sentence) + answer
            if len(answer) >= MIN_ANSWER:
                break
        items.append(Item(sorted(ids, key=lambda i: (i is not None, i)), numbers,
                          np.array([vocabulary[w] for w in answer], np.int64)))
    return Queries(vocabulary, items)


# --- places of terms --------------------------------------------------------

_PLACES = "n int, at array<int>, term array<int>"


def places_of_terms(docs: DataFrame, vocabulary: dict[bytes, int], key: str, text: str) -> DataFrame:
    """Rows (key, n words, places and numbers of benchmark terms) of whole texts."""
    narrow = docs.select(F.col(key).alias(key), F.col(text).alias("text"))

    def run(batches):
        get = vocabulary.get
        for batch in in_pieces(batches):
            counts, offsets, ats, terms = [], [0], [], []
            for body in batch.column(1).to_pylist():
                words = terms_of(body)
                numbers = np.fromiter(map(get, words, repeat(-1)), np.int32, len(words))
                at = np.flatnonzero(numbers >= 0).astype(np.int32)
                counts.append(len(words))
                offsets.append(offsets[-1] + len(at))
                ats.append(at)
                terms.append(numbers[at])
            lists = [
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), np.concatenate([np.zeros(0, np.int32), *parts]))
                for parts in (ats, terms)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int32()), *lists], names=[key, "n", "at", "term"]
            )

    return narrow.mapInArrow(run, f"{key} {dict(narrow.dtypes)[key]}, {_PLACES}")


class Places(NamedTuple):
    """Places of terms of several documents, end to end."""
    first: int  # row of the first document in its batch
    words: np.ndarray
    offsets: np.ndarray
    at: np.ndarray
    term: np.ndarray

    @property
    def passages(self) -> np.ndarray:
        """Passages per document."""
        return np.maximum(-(-self.words // STEP) - 1, 1)


def _groups(batch: pa.RecordBatch, n: int, at: int, term: int, kept: np.ndarray | None, limit: int = GROUP_ENTRIES):
    """Documents of a batch in groups of about ``limit`` entries that count in the rows."""
    lists = batch.column(at), batch.column(term)
    offsets = lists[0].offsets.to_numpy().astype(np.int64)
    base = int(offsets[0]) if len(offsets) else 0
    ats, terms = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
    offsets = offsets - base
    words = batch.column(n).to_numpy().astype(np.int64)
    weighty = np.ones(len(terms), np.int64) if kept is None else kept[terms].astype(np.int64)
    load = np.concatenate([[0], np.cumsum(weighty)])[offsets]
    start = 0
    while start < len(words):
        stop = max(start + 1, int(np.searchsorted(load, load[start] + limit, side="right")) - 1)
        stop = min(stop, len(words))
        part = slice(offsets[start], offsets[stop])
        yield Places(start, words[start:stop], offsets[start:stop + 1] - offsets[start], ats[part], terms[part])
        start = stop


class Rows(NamedTuple):
    """Entries (row, term, count) of a sparse matrix, sorted by row."""
    row: np.ndarray
    term: np.ndarray
    count: np.ndarray
    rows: int


def passage_rows(places: Places, kept: np.ndarray | None, size: int) -> Rows:
    passages = places.passages
    firsts = np.cumsum(passages) - passages
    document = np.repeat(np.arange(len(passages)), np.diff(places.offsets))
    at, term = places.at, places.term
    if kept is not None:
        chosen = kept[term]
        document, at, term = document[chosen], at[chosen], term[chosen]
    block = at // STEP
    pairs = []
    for passage in (block - 1, block):
        inside = (passage >= 0) & (passage < passages[document])
        pairs.append((firsts[document[inside]] + passage[inside]) * size + term[inside])
    cells, counts = np.unique(np.concatenate(pairs), return_counts=True)
    return Rows(cells // size, cells % size, counts, int(passages.sum()))


def weighted(rows: Rows, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows, where each starts, and unit-length TF-IDF values."""
    values = weights[rows.term] * (1 + np.log(rows.count))
    starts = np.flatnonzero(np.concatenate([[True], rows.row[1:] != rows.row[:-1]])) if len(rows.row) else np.zeros(0, np.int64)
    if not len(starts):
        return np.zeros(0, np.int64), starts, values.astype(np.float32)
    lengths = np.diff(np.append(starts, len(values)))
    norms = np.sqrt(np.add.reduceat(values * values, starts))
    return rows.row[starts], starts, (values / np.repeat(norms, lengths)).astype(np.float32)


def item_rows(queries: Queries, kept: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, Rows, np.ndarray, np.ndarray]:
    """Items cut into passages as documents are: item of each row, entries, starts, values."""
    offsets = np.cumsum([0, *(len(i.terms) for i in queries.items)])
    places = Places(
        0, np.diff(offsets), offsets, np.concatenate([np.arange(len(i.terms)) for i in queries.items]),
        np.concatenate([i.terms for i in queries.items]),
    )
    rows = passage_rows(places, kept, len(kept))
    own = np.repeat(np.arange(len(queries.items)), places.passages)
    row, starts, values = weighted(rows, weights)
    return own[row], rows, starts, values


# --- weights ----------------------------------------------------------------

def passage_counts(stored: DataFrame, size: int) -> tuple[int, np.ndarray]:
    """Number of passages, and of passages with each term."""

    def count(batches):
        total, with_term = 0, np.zeros(size, np.int64)
        for batch in batches:
            for places in _groups(batch, 0, 1, 2, None, 200_000):
                rows = passage_rows(places, None, size)
                total += rows.rows
                with_term += np.bincount(rows.term, minlength=size)
        yield pa.RecordBatch.from_pydict(
            {"term": pa.array(range(-1, size), pa.int32()), "n": np.concatenate([[total], with_term])}
        )

    found = stored.select("n", "at", "term").mapInArrow(count, "term int, n long").groupBy("term").agg(
        F.sum("n").alias("n")
    ).toArrow()
    out = np.zeros(size + 1, np.int64)
    out[found["term"].to_numpy() + 1] = found["n"].to_numpy()
    return int(out[0]), out[1:]


def term_weights(queries: Queries, passages: int, with_term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which terms take part, and their weights."""
    kept = with_term <= MAX_SHARE * passages
    for item in queries.items:
        own = np.unique(item.terms)
        kept[own[np.argsort(with_term[own], kind="stable")[:KEPT_TERMS]]] = True
    idf = np.log1p(passages / np.maximum(with_term, 1)) / np.log1p(max(passages, 1))
    return kept, np.maximum(idf, MIN_WEIGHT)


# --- decomposition ----------------------------------------------------------

def added_up(parts: DataFrame) -> DataFrame:
    """Sum of packed float arrays (part, task, data) per part, in steps of bounded size."""

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(d, np.float32).astype(np.float64) for d in group["data"].to_pylist())
        return pa.table({
            "part": group["part"].slice(0, 1), "task": group["task"].slice(0, 1),
            "data": pa.array([total.astype(np.float32).tobytes()], pa.binary()),
        })

    schema = "part int, task int, data binary"
    near = parts.withColumn("task", (F.col("task") / FAN_IN).cast("int")).groupBy("part", "task").applyInArrow(add, schema)
    return near.groupBy("part").applyInArrow(add, schema)


def product(stored: DataFrame, kept: np.ndarray, weights: np.ndarray, right: np.ndarray, parts: int = 16) -> np.ndarray:
    """A'A times ``right`` for the passage rows A, tasks multiplying their own rows."""
    size, width = right.shape
    edges = np.linspace(0, size, parts + 1).astype(int)

    def multiply(batches):
        total = np.zeros((size, width), np.float32)
        for batch in batches:
            for places in _groups(batch, 0, 1, 2, kept):
                for _, terms, block in dense_blocks(passage_rows(places, kept, size), weights):
                    total[terms] += block.T @ (block @ right[terms])
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({
            "part": pa.array(range(parts), pa.int32()), "task": pa.array([task] * parts, pa.int32()),
            "data": [total[s:e].tobytes() for s, e in zip(edges, edges[1:])],
        })

    partial = stored.select("n", "at", "term").mapInArrow(multiply, "part int, task int, data binary")
    out = np.zeros((size, width), np.float32)
    for row in added_up(partial).toArrow().to_pylist():
        s, e = edges[row["part"]], edges[row["part"] + 1]
        out[s:e] = np.frombuffer(row["data"], np.float32).reshape(e - s, width)
    return out


def dense_blocks(rows: Rows, weights: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows in dense blocks of bounded size: numbers of rows, terms of the block, values."""
    row, starts, values = weighted(rows, weights)
    ends = np.append(starts, len(values))
    first = 0
    while first < len(row):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + DENSE_ENTRIES, side="right")) - 1)
        part = slice(ends[first], ends[last])
        terms, column = np.unique(rows.term[part], return_inverse=True)
        block = np.zeros((last - first, len(terms)), np.float32)
        block[np.repeat(np.arange(last - first), np.diff(ends[first:last + 1])), column] = values[part]
        yield row[first:last], terms, block
        first = last


def back_and_forth(rows: Rows, weights: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A'(A right) for the weighted rows A."""
    out = np.zeros(right.shape, np.float32)
    for _, terms, block in dense_blocks(rows, weights):
        out[terms] += block.T @ (block @ right[terms])
    return out


def latent_space(stored: DataFrame, queries: Queries, passages: int, kept: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Leading right singular vectors of the passage rows and the item rows.

    The range of A'A is probed with a random matrix, the basis found is multiplied
    once more, and the small matrix in that basis is decomposed. Item rows are
    weighted so that together they are as heavy as all passages.
    """
    size = len(kept)
    rank = max(RANK, -(-len(queries.items) // ITEMS_PER_RANK))
    width = min(rank + OVERSAMPLE, size)
    own, rows, _, _ = item_rows(queries, kept, weights)
    balance = np.float32(max(1.0, passages / max(len(own), 1)))

    def times(right: np.ndarray) -> np.ndarray:
        right = right.astype(np.float32)
        return product(stored, kept, weights, right) + balance * back_and_forth(rows, weights, right)

    probe = np.random.default_rng(0).standard_normal((size, width))
    basis, _ = np.linalg.qr(times(probe).astype(np.float64))
    small = basis.T @ times(basis).astype(np.float64)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    best = np.argsort(values)[::-1][: min(rank, size)]
    return (basis @ vectors[:, best]).astype(np.float32)


def latent_rows(rows: Rows, weights: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with a term, and their unit vectors in the latent space."""
    found = [(row, block @ space[terms]) for row, terms, block in dense_blocks(rows, weights)]
    if not found:
        return np.zeros(0, np.int64), np.zeros((0, space.shape[1]), np.float32)
    vectors = np.concatenate([v for _, v in found])
    return np.concatenate([r for r, _ in found]), vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


# --- checks -----------------------------------------------------------------

def common_length(masks: dict[int, int], length: int, terms: list[int]) -> int:
    """Length of the longest common subsequence; masks tell where an item has a term."""
    full = (1 << length) - 1
    state = full
    for term in terms:
        match = state & masks.get(term, 0)
        state = ((state + match) | (state - match)) & full
    return length - state.bit_count()


def masks_of(terms: np.ndarray) -> dict[int, int]:
    masks: dict[int, int] = {}
    for i, term in enumerate(terms.tolist()):
        masks[term] = masks.get(term, 0) | (1 << i)
    return masks


def documents_with_sequence(item: np.ndarray, places: Places) -> list[int]:
    """Documents in which an item's words stand one after the other."""
    starts = np.arange(len(places.term) - len(item) + 1)
    for i, term in enumerate(item.tolist()):
        starts = starts[(places.term[starts + i] == term) & (places.at[starts + i] == places.at[starts] + i)]
    document = np.searchsorted(places.offsets, starts, side="right") - 1
    # Places rise by one over the end of a document only by chance; the last must be of the same.
    whole = starts + len(item) <= places.offsets[document + 1]
    return np.unique(document[whole]).tolist()


def term_cells(items: list[Item]) -> tuple[np.ndarray, np.ndarray]:
    """Terms of items, each as its number times the items plus the item's, sorted, and how often the item has it."""
    item = np.repeat(np.arange(len(items)), [len(i.terms) for i in items])
    return np.unique(np.concatenate([i.terms for i in items]) * len(items) + item, return_counts=True)


class Checks:
    """Word-by-word checks of items against the words about a passage."""

    def __init__(self, items: list[Item]):
        self.items = items
        self.masks = [masks_of(i.terms) for i in items]
        self.answers = [masks_of(i.answer) for i in items]

        self.length = np.array([len(i.terms) for i in items])
        self.cells, self.counts = term_cells(items)

    def possible(self, places: Places, firsts: np.ndarray, passage: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Which pairs have enough of the item's words about the passage, in any order, to pass ``compare``."""
        out = np.zeros(len(item), bool)
        width, terms = int(places.words.max(initial=0)) + 1, int(places.term.max(initial=0)) + 1
        document = np.searchsorted(firsts, passage, side="right") - 1
        first, margin = (passage - firsts[document]) * STEP, np.maximum(STEP, self.length[item] - STEP)
        at = np.repeat(np.arange(len(firsts)), np.diff(places.offsets)) * width + places.at
        low, high = (np.searchsorted(at, document * width + np.clip(edge, 0, width))
                     for edge in (first - margin, first + PASSAGE + margin))
        ends = np.cumsum(high - low)
        start = 0
        while start < len(item):
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + PAIR_PLACES, side="right")))
            part = slice(start, stop)
            sizes = high[part] - low[part]
            begin = np.cumsum(sizes) - sizes
            term = places.term[np.repeat(low[part] - begin, sizes) + np.arange(int(sizes.sum()))]
            pair, term = np.divmod(np.unique(np.repeat(np.arange(stop - start), sizes) * terms + term), terms)
            wanted = term * len(self.items) + item[part][pair]
            cell = np.minimum(np.searchsorted(self.cells, wanted), len(self.cells) - 1)
            hit = self.cells[cell] == wanted
            common = np.bincount(pair[hit], weights=self.counts[cell[hit]], minlength=stop - start)
            out[part] = common / self.length[item[part]] >= PARAPHRASE_SHARE
            start = stop
        return out

    def compare(self, number: int, at: np.ndarray, terms: np.ndarray, passage: int) -> tuple[float, float] | None:
        """Shares of item and answer found; None if this is neither copy nor paraphrase."""
        item = self.items[number]
        n = len(item.terms)
        margin = max(STEP, n - STEP)
        low, high = np.searchsorted(at, (passage * STEP - margin, passage * STEP + PASSAGE + margin))
        near = terms[low:high]
        near = near.tolist()
        share = common_length(self.masks[number], n, near) / n
        if share < PARAPHRASE_SHARE:
            return None
        answer = common_length(self.answers[number], len(item.answer), near) / len(item.answer)
        return (share, answer) if share >= COPY_SHARE or answer >= ANSWER_SHARE else None


class RareWords:
    """Words of items that few passages have, counted about many passages at once.

    An item that misses so many of its rare words about a passage that all its other words
    would not make a paraphrase cannot pass :meth:`Checks.compare` there.
    """

    def __init__(self, items: list[Item], rare: np.ndarray):
        lengths = np.array([len(i.terms) for i in items])
        cells, counts = term_cells(items)
        terms, item = np.divmod(cells, len(items))
        starts = np.searchsorted(terms, np.arange(len(rare) + 1))
        rare = rare & (np.diff(starts) <= RARE_ITEMS)
        used = rare[terms] & (lengths[item] <= RARE_LENGTH)
        self.starts = np.searchsorted(terms[used], np.arange(len(rare) + 1))
        self.item, self.counts = item[used], counts[used]
        self.lengths = lengths
        self.others = lengths - np.bincount(self.item, weights=self.counts, minlength=len(items)).astype(np.int64)
        counted = lengths[lengths <= RARE_LENGTH]
        self.margin = max(STEP, int(counted.max(initial=0)) - STEP)

    def possible(self, places: Places, firsts: np.ndarray, passage: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Which of the pairs, sorted by passage and item, may have enough words in common."""
        document = np.repeat(np.arange(len(firsts)), np.diff(places.offsets))
        chosen = self.starts[places.term + 1] > self.starts[places.term]
        document, at, term = document[chosen], places.at[chosen].astype(np.int64), places.term[chosen].astype(np.int64)
        # Passages whose words, with the margin, a place is among.
        low = np.maximum((at - PASSAGE - self.margin) // STEP + 1, 0)
        high = np.minimum((at + self.margin) // STEP + 1, places.passages[document])
        spans = np.maximum(high - low, 0)
        begin = np.cumsum(spans) - spans
        near = np.repeat(firsts[document] + low - begin, spans) + np.arange(int(spans.sum()))
        size = len(self.starts) - 1
        near, term = np.divmod(np.unique(near * size + np.repeat(term, spans)), size)
        many = self.starts[term + 1] - self.starts[term]
        begin = np.cumsum(many) - many
        at = np.repeat(self.starts[term] - begin, many) + np.arange(int(many.sum()))
        keys, asked = np.repeat(near, many) * len(self.lengths) + self.item[at], passage * len(self.lengths) + item
        place = np.minimum(np.searchsorted(asked, keys), max(len(asked) - 1, 0))
        hit = asked[place] == keys if len(asked) else np.zeros(0, bool)
        common = np.bincount(place[hit], weights=self.counts[at[hit]], minlength=len(asked)) if len(asked) else np.zeros(0)
        return (common + self.others[item]) / self.lengths[item] >= PARAPHRASE_SHARE


class Seeds:
    """Runs of ``SEED_WORDS`` words of items, looked for exactly."""

    def __init__(self, items: list[Item]):
        runs = [self._hashes(i.terms) for i in items]
        hashes = np.concatenate(runs)
        item = np.repeat(np.arange(len(items)), [len(r) for r in runs])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.item = hashes[order], item[order]

    @staticmethod
    def _hashes(terms: np.ndarray) -> np.ndarray:
        count = max(len(terms) - SEED_WORDS + 1, 0)
        out = np.zeros(count, np.uint64)
        for i in range(SEED_WORDS):
            out = (out ^ (terms[i:i + count].astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out

    def candidates(self, places: Places, firsts: np.ndarray, items: int) -> np.ndarray:
        """Passages over a run, by number, times ``items`` plus the item's number."""
        hashes = self._hashes(places.term)
        at = places.at.astype(np.int64)
        start = np.flatnonzero(at[SEED_WORDS - 1:] - at[:len(hashes)] == SEED_WORDS - 1) if len(hashes) else np.zeros(0, np.int64)
        low, high = (np.searchsorted(self.hashes, hashes[start], side=side) for side in ("left", "right"))
        hit = high > low
        start, low, counts = start[hit], low[hit], (high - low)[hit]
        begin = np.cumsum(counts) - counts
        item = self.item[np.repeat(low - begin, counts) + np.arange(int(counts.sum()))]
        start = np.repeat(start, counts)
        document = np.searchsorted(places.offsets, start, side="right") - 1
        block, last = at[start] // STEP, places.passages[document] - 1
        # An item about the run lies in the words that are compared with one of the two passages over it.
        over = [firsts[document] + np.clip(p, 0, last) for p in (block - 1, block)]
        return np.unique(np.concatenate([o * items + item for o in over]))


# --- the search -------------------------------------------------------------

_FOUND = "item int, cosine double, share double, answer double"


def search(
    stored: DataFrame, queries: Queries, kept: np.ndarray, weights: np.ndarray, space: np.ndarray, key: str, rare: np.ndarray,
) -> DataFrame:
    """Rows (key, item number, cosine, shares) of documents in which an item is found; ``rare`` tells the terms few passages have."""
    own, rows, _, _ = item_rows(queries, kept, weights)
    _, asked = latent_rows(rows, weights, space)
    asked = np.ascontiguousarray(asked.T)
    size, items = len(kept), len(queries.items)

    def run(batches):
        checks, seeds, words = Checks(queries.items), Seeds(queries.items), RareWords(queries.items, rare)
        short = [q for q, item in enumerate(queries.items) if len(item.terms) < SHORT]
        for batch in batches:
            found: list[tuple] = []
            for places in _groups(batch, 1, 2, 3, kept):
                row, vectors = latent_rows(passage_rows(places, kept, size), weights, space)
                passages = places.passages
                firsts = np.cumsum(passages) - passages
                best: dict[tuple[int, int], tuple] = {}
                pairs = [seeds.candidates(places, firsts, items)]
                for part in range(0, len(row), 2048):
                    where, query = np.nonzero(vectors[part:part + 2048] @ asked >= MIN_COSINE)
                    pairs.append(np.unique(row[part + where] * items + own[query]))
                passage, item = np.divmod(np.unique(np.concatenate(pairs)), items)
                long = checks.length[item] >= SHORT
                passage, item = passage[long], item[long]
                for test in (words.possible, checks.possible):
                    likely = test(places, firsts, passage, item)
                    passage, item = passage[likely], item[likely]
                edges = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1], [True]])) if len(passage) else [0]
                for first, last in zip(edges[:-1], edges[1:]):
                    at = int(passage[first])
                    d = int(np.searchsorted(firsts, at, side="right")) - 1
                    span, p = slice(places.offsets[d], places.offsets[d + 1]), at - int(firsts[d])
                    for q in item[first:last].tolist():
                        shares = checks.compare(q, places.at[span], places.term[span], p)
                        if shares:
                            n = int(np.searchsorted(row, at))
                            mine = slice(*np.searchsorted(own, (q, q + 1)))
                            known = n < len(row) and row[n] == at and mine.stop > mine.start
                            cosine = float((vectors[n] @ asked[:, mine]).max()) if known else 0.0
                            best[d, q] = max(best.get((d, q), ((0.0, 0.0), 0.0)), (shares, cosine))
                # Too few words for a cosine to tell: looked for everywhere.
                for q in short:
                    for d in documents_with_sequence(queries.items[q].terms, places):
                        best[d, q] = ((1.0, 1.0), 1.0)
                found += [(places.first + d, q, c, *shares) for (d, q), (shares, c) in best.items()]
            found.sort()
            columns = list(zip(*found)) or [()] * 5
            taken = batch.column(0).take(pa.array(columns[0], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [taken, pa.array(columns[1], pa.int32()), *(pa.array(c, pa.float64()) for c in columns[2:])],
                names=[key, "item", "cosine", "share", "answer"],
            )

    return stored.select(key, "n", "at", "term").mapInArrow(run, f"{key} {dict(stored.dtypes)[key]}, {_FOUND}")


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
    item: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """Rows (key, item_id, cosine, lcs_share, answer_share), one for each item found in a document."""
    spark = docs.sparkSession
    asked = cut(benchmark.select(F.col(item).cast("long").alias("item_id"), F.col(item_text).alias("text")), "items")
    blocks = max(1, -(-asked.count() // ITEMS))
    kind = dict(docs.dtypes)[key]
    results = [spark.createDataFrame([], f"{key} {kind}, item_id long, cosine double, lcs_share double, answer_share double")]
    for block in range(blocks):
        mine = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block
        queries = build_queries([tuple(r) for r in asked.where(mine).toLocalIterator()])
        if queries.items:
            results.append(_block_leaks(docs, queries, key, text))
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out


def _block_leaks(docs: DataFrame, queries: Queries, key: str, text: str) -> DataFrame:
    stored = cut(places_of_terms(docs, queries.vocabulary, key, text), "places")
    passages, with_term = passage_counts(stored, len(queries.vocabulary))
    kept, weights = term_weights(queries, passages, with_term)
    space = latent_space(stored, queries, passages, kept, weights)
    found = search(stored, queries, kept, weights, space, key, with_term <= RARE_SHARE * passages)
    # As many entries as the block has items.
    names = F.array(*[F.array(*[F.lit(i).cast("long") for i in item.ids]) for item in queries.items])
    rows = found.select(key, F.explode(F.get(names, F.col("item"))).alias("item_id"), "cosine", "share", "answer")
    return rows.groupBy(key, "item_id").agg(
        F.max("cosine").alias("cosine"), F.max("share").alias("lcs_share"), F.max("answer").alias("answer_share")
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents in which no item is found, columns as given."""
    leaks = find_leaks(docs, benchmark, key, text).select(F.col(key).alias("_leak")).distinct()
    stored = cut(leaks, "leaks")
    return docs.join(stored, docs[key].eqNullSafe(stored["_leak"]), "left_anti")
