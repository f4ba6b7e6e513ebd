"""Language identification by error-correcting output codes.

Every language has a codeword of bits. A classifier over character n-grams of
words is learned for each bit: its weights are log-odds of an n-gram between the
languages with the bit set and those without. A text's margins are compared with
the codewords by a loss that weighs every bit by how reliably it separates the
languages; a text whose best two codewords are near each other is ambiguous.

N-gram counts come from all training documents, added up by task and summed by
Spark per language and hashed n-gram; the driver gets one table of 2^``BITS``
cells per language.

Defined results: a text that is null or without a letter is ``und`` with score 0;
with no language to learn from everything is ``und``; with one language all
other texts are of it with score 1. Repeated rows count as often as they occur;
a row without a key is never learned from. Only the named columns are read, so
extra columns cannot clash; :func:`accepted_documents` keeps the columns as given.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, in_pieces, text_pieces
from .host_rules import grouped_words

UNKNOWN = "und"
ORDERS = 3
BITS = 15
SMOOTHING = 0.5
#: Least difference of the losses of the best two codewords.
AMBIGUITY = 0.05
#: Steepness of the score over losses.
STEEPNESS = 4.0
GROUP_WORDS = 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Model(NamedTuple):
    languages: list[str]
    code: np.ndarray  # [language, bit] of -1 and 1
    weights: np.ndarray  # [cell, bit]
    scale: np.ndarray  # [bit]
    trust: np.ndarray  # [bit]


def codewords(n: int) -> np.ndarray:
    """Code of n words. Up to five words have all distinct splits; more have the random
    code of the largest least distance among a fixed number of tries."""
    if n < 2:
        return np.zeros((n, 0), np.int8)
    if n <= 5:
        splits = np.arange(1, 1 << (n - 1))
        rows = [np.ones(len(splits), np.int64)]
        rows += [1 - 2 * ((splits >> k) & 1) for k in range(n - 1)]
        return np.array(rows, np.int8)
    length = int(np.ceil(10 * np.log2(n)))
    random = np.random.default_rng(n)
    best, distance = None, -1.0
    for _ in range(200):
        code = random.choice(np.array([-1, 1], np.int8), (n, length))
        same = code.astype(np.int32) @ code.T.astype(np.int32)
        least = (length - same[~np.eye(n, dtype=bool)]).min() / 2
        mixed = (np.abs(code.sum(axis=0)) < n).all()
        if mixed and least > distance:
            best, distance = code, least
    return best


def word_cells(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of distinct words with their edges, and the word each is of."""
    joined = "\n" + "\n".join(w.decode() for w in words) + "\n"
    signs = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    edge = signs == 10
    # A word holds no line end, so edges tell words apart.
    word = np.cumsum(edge) - 1
    inner = np.flatnonzero(~edge)
    starts = np.flatnonzero(edge)[:-1]
    shift = np.uint64(64 - BITS)

    def cell(at, *offsets):
        h = np.full(len(at), len(offsets), np.uint64)
        for k in offsets:
            h = (h + signs[at + k]) * _MIX
            h ^= h >> np.uint64(32)
        return (h * _MIX >> shift).astype(np.int64)

    cells = [cell(inner, 0), cell(inner, 0, 1), cell(starts, 0, 1), cell(inner, -1, 0, 1)]
    return np.concatenate(cells), np.concatenate([word[inner], word[inner], word[starts], word[inner]])


def _numbered(texts: list[str | None]):
    """Groups of texts: first index, number of texts, distinct words, word and text of every word."""
    for first, words, _ in grouped_words((t.lower() if t else t for t in texts), GROUP_WORDS):
        lengths = np.array([len(w) for w in words], np.int64)
        flat = np.empty(int(lengths.sum()), object)
        flat[:] = [w for own in words for w in own]
        codes, distinct = pd.factorize(flat)
        yield first, len(words), distinct, codes, np.repeat(np.arange(len(words)), lengths)


def count_ngrams(rows: DataFrame) -> DataFrame:
    """Counts (lang, cell, n) over rows (lang, text)."""

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in in_pieces(batches):
            langs = batch.column(0).to_pylist()
            for first, n, distinct, codes, of in _numbered(batch.column(1).to_pylist()):
                if not len(distinct):
                    continue
                cells, word = word_cells(distinct)
                own, names = pd.factorize(np.array(langs[first:first + n], object))
                uses = np.bincount(own[of] * len(distinct) + codes, minlength=len(names) * len(distinct))
                for k, name in enumerate(names):
                    share = uses[k * len(distinct):(k + 1) * len(distinct)]
                    add = np.bincount(cells, share[word], 1 << BITS).astype(np.int64)
                    totals[name] = totals.get(name, 0) + add
        for name, cells in totals.items():
            at = np.flatnonzero(cells)
            yield pa.RecordBatch.from_pydict(
                {"lang": [name] * len(at), "cell": pa.array(at, pa.int32()), "n": cells[at]}
            )

    parts = rows.mapInArrow(count, "lang string, cell int, n long")
    return parts.groupBy("lang", "cell").agg(F.sum("n").alias("n"))


def fit(languages: list[str], counts: np.ndarray) -> Model:
    """Bit classifiers from counts [language, cell]; every language has equal weight in a bit."""
    code = codewords(len(languages))
    share = (counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * counts.shape[1])
    up, down = (code.T > 0).astype(float), (code.T < 0).astype(float)
    with_bit = up @ share / np.maximum(up.sum(axis=1, keepdims=True), 1)
    without = down @ share / np.maximum(down.sum(axis=1, keepdims=True), 1)
    weights = np.log(with_bit / without).T if code.shape[1] else np.zeros((counts.shape[1], 0))
    expected = (share @ weights) * code
    scale = 1 / np.maximum(np.abs(expected).sum(axis=0) / max(len(languages), 1), 1e-9)
    # A bit is as good as it is on the language it tells apart worst.
    trust = np.clip((expected * scale).min(axis=0), 0.05, None) if len(languages) else np.zeros(0)
    return Model(languages, code.astype(float), weights.astype(np.float32), scale, trust)


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Model of all given documents with a language."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    found = count_ngrams(rows.select(F.col(lang).alias("lang"), F.col(text).alias("text"))).toArrow()
    names = found["lang"].to_pylist()
    languages = sorted(set(names))
    at = {name: i for i, name in enumerate(languages)}
    counts = np.zeros((len(languages), 1 << BITS))
    counts[np.array([at[n] for n in names], np.int64), found["cell"].to_numpy()] = found["n"].to_numpy()
    return fit(languages, counts)


def margins(model: Model, texts: list[str | None]) -> np.ndarray:
    """Mean weight of a text's n-grams for each bit."""
    out = np.zeros((len(texts), model.weights.shape[1]))
    for first, n, distinct, codes, of in _numbered(texts):
        if not len(distinct):
            continue
        cells, word = word_cells(distinct)
        grams = np.bincount(word, minlength=len(distinct))
        total = np.maximum(np.bincount(of, grams[codes], n), 1)
        for b in range(out.shape[1]):
            sums = np.bincount(word, model.weights[cells, b], len(distinct))
            out[first:first + n, b] = np.bincount(of, sums[codes], n) / total
    return out


def decode(model: Model, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest codeword, its score and whether the next is as near, per text."""
    n = len(model.languages)
    if n == 1:
        rows = len(margin)
        return np.zeros(rows, np.int64), np.ones(rows), np.zeros(rows, bool)
    scaled = np.clip(margin * model.scale, -20, 20)
    trust = model.trust / model.trust.sum()
    losses = np.stack([(trust * np.exp(-code * scaled)).sum(axis=1) for code in model.code], axis=1)
    ranked = np.sort(losses, axis=1)
    best = losses.argmin(axis=1)
    odds = np.exp(-STEEPNESS * np.minimum(losses - ranked[:, :1], 100))
    return best, 1 / odds.sum(axis=1), ranked[:, 1] - ranked[:, 0] < AMBIGUITY


def predict(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` with lang_pred, score and ambiguous. ``text`` alone decides."""
    read = keep if text in keep else [*keep, text]
    narrow = docs.select(*read)
    at = read.index(text)

    def run(batches):
        for batch in in_pieces(batches):
            texts = batch.column(at).to_pylist()
            known = [bool(model.languages) and t is not None and any(map(str.isalpha, t)) for t in texts]
            best, score, close = (
                decode(model, margins(model, texts)) if model.languages and texts
                else (np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts), bool))
            )
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[: len(keep)],
                    pa.array([model.languages[b] if k else UNKNOWN for b, k in zip(best, known)], pa.string()),
                    pa.array(np.where(known, score, 0.0), pa.float64()),
                    pa.array(np.asarray(known, bool) & close),
                ],
                names=[*keep, "lang_pred", "score", "ambiguous"],
            )

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[: len(keep)]]
    schema = ", ".join([*fields, "lang_pred string", "score double", "ambiguous boolean"])
    return narrow.mapInArrow(run, schema)


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Rows (key, held_out, lang_pred, score, ambiguous); held-out rows are not learned from."""
    rows = docs.select(key, text, lang, held_out(F.col(key)).alias("held_out"))
    model = train(rows.where("not held_out"), text, lang)
    return predict(rows, model, [key, "held_out"], text)


def accepted_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Documents in some language, without the ambiguous; the columns as given.

    The verdict is a filter by a scalar Arrow function of the text alone: only that
    column goes to Python, in runs bounded by their size, and the rows stay in the JVM.
    """
    model = train(docs.where(~held_out(F.col(key))), text, lang)

    @F.arrow_udf("boolean")
    def accepted(texts: pa.Array) -> pa.Array:
        out = []
        for piece in text_pieces(texts):
            known = [bool(model.languages) and t is not None and any(map(str.isalpha, t)) for t in piece]
            if model.languages:
                _, _, close = decode(model, margins(model, piece))
            else:
                close = np.zeros(len(piece), bool)
            out += (np.asarray(known, bool) & ~np.asarray(close, bool)).tolist()
        return pa.array(out, pa.bool_())

    return docs.where(accepted(F.col(text)))
