"""Quality rules per document, and a verdict per host from their failure rates.

Documents are measured once. Failures are added up by domain, every domain's rate
is shrunk towards the rate of all with a beta prior that is itself estimated from
the domains, and domains whose shrunk rate is too high are rejected as a whole.

Defined results: a null text has no words and fails; a null source belongs to no
host and is judged by its own rules alone; an empty table gives no rows; repeated
rows count as often as they occur. Only the named columns are read, so extra
columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import in_pieces

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_SYMBOL_PERCENT = 10
MAX_DUP_LINE_PERCENT = 30
MAX_HOST_RATE = 0.5
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = b"#*$%&|<>"
#: Words measured together; a longer document is measured alone.
GROUP_WORDS = 200_000

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def grouped_words(texts: Iterable[str | None], limit: int = GROUP_WORDS) -> Iterator[tuple[int, list[list[bytes]], list[bytes]]]:
    """Runs of texts of about ``limit`` words: first index, words of each, UTF-8 of each."""
    first, words, coded, count = 0, [], [], 0
    for i, text in enumerate(texts):
        raw = text.encode() if text else b""
        own = raw.split()
        if words and count + len(own) > limit:
            yield first, words, coded
            first, words, coded, count = i, [], [], 0
        words.append(own)
        coded.append(raw)
        count += len(own)
    if words:
        yield first, words, coded


def repeated_words(words: list[list[bytes]], window: int = WINDOW) -> np.ndarray:
    """Per text, words inside a window that the text has twice or more.

    Windows are compared exactly: a window's number is that of its first words
    joined with the next word, numbered anew for each length.
    """
    lengths = np.array([len(w) for w in words], np.int64)
    total = int(lengths.sum())
    if total < window:
        return np.zeros(len(words), np.int64)
    flat = np.empty(total, object)
    flat[:] = [w for own in words for w in own]
    text = np.repeat(np.arange(len(words)), lengths)
    word = pd.factorize(flat)[0].astype(np.int64)
    # A number per text and word, so that equal windows always lie in one text.
    word = pd.factorize(word * len(words) + text)[0].astype(np.int64)
    base = int(word.max()) + 1
    number = word
    for k in range(1, window):
        joined = number[: total - k] * base + word[k:]
        number = joined if k == window - 1 else pd.factorize(joined)[0].astype(np.int64)
    starts = np.flatnonzero(pd.Series(number).duplicated(keep=False).to_numpy())
    # Windows over the end of a text begin in one text and end in another.
    starts = starts[text[starts] == text[starts + window - 1]]
    edges = np.zeros(total + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    covered = np.cumsum(edges[:-1]) > 0
    return np.bincount(text[covered], minlength=len(words))


def measure(words: list[list[bytes]], coded: list[bytes]) -> dict[str, np.ndarray]:
    out = {name: np.zeros(len(words), np.int64) for name in MEASURES}
    for i, (own, raw) in enumerate(zip(words, coded)):
        out["n_words"][i] = len(own)
        # Continuation bytes begin no sign.
        signs = raw.translate(None, SPACE)
        out["word_chars"][i] = len(signs) if signs.isascii() else len(signs.decode())
        out["n_symbols"][i] = len(raw) - len(raw.translate(None, SYMBOLS))
        lines = [line for line in raw.split(b"\n") if line.strip()]
        out["n_lines"][i] = len(lines)
        out["n_dup_lines"][i] = len(lines) - len(set(lines))
    out["n_repeat_words"] = repeated_words(words)
    return out


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Rows (key, source, measures...) of whole texts."""
    narrow = docs.select(F.col(key).alias(key), F.col(source).alias("source"), F.col(text).alias("text"))
    kinds = dict(narrow.dtypes)

    def run(batches):
        for batch in in_pieces(batches):
            for first, words, coded in grouped_words(batch.column(2).to_pylist()):
                kept = batch.slice(first, len(words))
                found = measure(words, coded)
                yield pa.RecordBatch.from_arrays(
                    [kept.column(0), kept.column(1), *(pa.array(found[m]) for m in MEASURES)],
                    names=[key, "source", *MEASURES],
                )

    schema = f"{key} {kinds[key]}, source {kinds['source']}, " + ", ".join(f"{m} long" for m in MEASURES)
    return narrow.mapInArrow(run, schema)


def base_failed() -> Column:
    few = F.col("n_words") < MIN_WORDS
    return few | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def any_rule_failed() -> Column:
    symbols = F.col("n_symbols") * 100 > F.col("word_chars") * MAX_SYMBOL_PERCENT
    lines = F.col("n_dup_lines") * 100 > F.col("n_lines") * MAX_DUP_LINE_PERCENT
    return base_failed() | symbols | lines


def host_rates(rows: DataFrame) -> DataFrame:
    """Per source: documents, failures and the shrunk rate.

    The prior's mean is the rate of all documents. Its weight follows from how far
    the rates of domains vary beyond what chance gives documents of that number;
    where they vary no further, it is the number of all documents.
    """
    hosts = rows.where("source is not null").groupBy("source").agg(
        F.count("*").alias("n"), F.sum(any_rule_failed().cast("long")).alias("failed")
    )
    # Three numbers, whatever the number of hosts.
    sums = hosts.agg(
        F.sum("n").alias("n"), F.sum("failed").alias("failed"), F.count("*").alias("hosts"),
        F.sum(F.col("failed").cast("double") * F.col("failed") / F.col("n")).alias("squares"),
    ).first()
    mean, weight = beta_prior(sums["n"] or 0, sums["failed"] or 0, sums["hosts"], sums["squares"] or 0.0)
    return hosts.withColumn("rate", (F.col("failed") + F.lit(mean * weight)) / (F.col("n") + F.lit(weight)))


def beta_prior(n: int, failed: int, hosts: int, squares: float) -> tuple[float, float]:
    """Mean and weight (alpha + beta) of the prior by moments; squares: sum of failed^2 / n."""
    if n == 0:
        return 0.0, 1.0
    mean = failed / n
    spread = mean * (1 - mean)
    between = squares / n - mean * mean - spread * max(hosts - 1, 0) / n
    return mean, float(min(n, spread / between)) if between > 0 and spread > 0 else float(n)


def judge_documents(
    docs: DataFrame, max_host_rate: float = MAX_HOST_RATE,
    key: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """Rows (key, measures..., base_failed, host_rate, kept)."""
    rows = cut(measured(docs, key, text, source), "measured")
    # A table of known size: few hosts are broadcast, and rows are not dealt out by host for them.
    rates = cut(host_rates(rows).select("source", F.col("rate").alias("host_rate")), "host-rates")
    rejected = F.coalesce(F.col("host_rate") > max_host_rate, F.lit(False))
    return rows.join(rates, "source", "left").select(
        key, *MEASURES, base_failed().alias("base_failed"), "host_rate",
        (~base_failed() & ~rejected).alias("kept"),
    )
