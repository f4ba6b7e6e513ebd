"""URL filter: rules on host and path, and a language-model ratio for the rest.

URLs that a rule allows or blocks train two character models, one of each kind.
A model is a Markov model of variable order: the chance of a sign is smoothed
from order 0 upwards, and an order takes part only where its context was seen
often enough. The difference of the log-likelihoods per sign is held against a
cut that is calibrated on a fold of ruled URLs the models have not seen.

Counts are taken over all ruled URLs, per hashed context: tasks add them up, Spark
sums them, and the driver gets at most two tables of 2^``bits`` cells per order.

Defined results: a URL that is null or has no ``://`` has an empty host and path
and fits no rule. Without ruled URLs of both kinds, or without any sign to score,
the difference is 0, and 0 is allowed. Repeated rows count as often as they
occur. Only the named columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import fold_case


class Rule(NamedTuple):
    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host):]


class Model(NamedTuple):
    grams: np.ndarray  # [kind, order, cell]
    contexts: np.ndarray
    cut: float


ORDER = 4
BITS = 17
PRIOR = 2.0
MIN_CONTEXT = 3
_MIX = np.uint64(0x9E3779B97F4A7C15)


# --- rules ------------------------------------------------------------------

def host_and_path(url: Column) -> tuple[Column, Column]:
    body = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return fold_case(F.regexp_extract(body, pattern, 1)), F.regexp_extract(body, pattern, 2)


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        chosen = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(chosen)
    return chosen


# --- character models -------------------------------------------------------

def _signs(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signs of all texts with ``order`` blanks before and one end sign after each;
    which of them are scored; and the text each scored one belongs to."""
    coded = [t.encode() for t in texts]
    lengths = np.array([len(c) + 1 for c in coded], np.int64)
    pad = b"\x00" * order
    signs = np.frombuffer(b"".join(pad + c + b"\x01" for c in coded), np.uint8).astype(np.uint64)
    scored = np.ones(len(signs), bool)
    starts = np.cumsum(lengths + order) - (lengths + order)
    scored[(starts[:, None] + np.arange(order)).ravel()] = False
    return signs, np.flatnonzero(scored), np.repeat(np.arange(len(texts)), lengths)


def _cells(signs: np.ndarray, at: np.ndarray, order: int, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Cells of context and of context with sign, for each order from 0."""
    shift = np.uint64(64 - bits)
    context = np.full(len(at), 1, np.uint64)
    out = []
    for k in range(order + 1):
        if k:
            context = (context + signs[at - k] + np.uint64(1)) * _MIX
            context ^= context >> np.uint64(29)
        gram = (context ^ (signs[at] + np.uint64(257))) * _MIX
        gram ^= gram >> np.uint64(31)
        out.append(((context * _MIX >> shift).astype(np.int64), (gram * _MIX >> shift).astype(np.int64)))
    return out


def count_cells(texts: DataFrame, order: int, bits: int) -> DataFrame:
    """Counts (kind, order, cell, gram, context) over rows (text, kind); kind 1 is accepted."""

    def count(batches):
        counts = np.zeros((2, 2, order + 1, 1 << bits), np.int64)
        for batch in batches:
            kinds = np.array(batch.column(1).to_pylist(), np.int64)
            signs, at, of = _signs(batch.column(0).to_pylist(), order)
            for k, (context, gram) in enumerate(_cells(signs, at, order, bits)):
                for kind in (0, 1):
                    mine = kinds[of] == kind
                    counts[0, kind, k] += np.bincount(gram[mine], minlength=1 << bits)
                    counts[1, kind, k] += np.bincount(context[mine], minlength=1 << bits)
        kind, k, cell = np.nonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_pydict({
            "kind": pa.array(kind, pa.int32()), "order": pa.array(k, pa.int32()),
            "cell": pa.array(cell, pa.int32()),
            "gram": counts[0, kind, k, cell], "context": counts[1, kind, k, cell],
        })

    parts = texts.mapInArrow(count, "kind int, order int, cell int, gram long, context long")
    return parts.groupBy("kind", "order", "cell").agg(F.sum("gram").alias("gram"), F.sum("context").alias("context"))


def differences(
    texts: list[str], grams: np.ndarray, contexts: np.ndarray,
    prior: float = PRIOR, min_context: int = MIN_CONTEXT,
) -> np.ndarray:
    """Log-likelihood of accepted less that of rejected, per sign (the end is one)."""
    order = grams.shape[1] - 1
    signs, at, of = _signs(texts, order)
    logs = []
    for kind in (1, 0):
        chance = np.full(len(at), 1.0 / 257)
        for k, (context, gram) in enumerate(_cells(signs, at, order, int(grams.shape[2]).bit_length() - 1)):
            seen = contexts[kind, k][context]
            smooth = (grams[kind, k][gram] + prior * chance) / (seen + prior)
            chance = np.where(seen >= min_context, smooth, chance)
        logs.append(np.log(chance))
    lengths = np.bincount(of, minlength=len(texts))
    return np.bincount(of, logs[0] - logs[1], len(texts)) / np.maximum(lengths, 1)


def train(ruled: DataFrame, order: int = ORDER, bits: int = BITS) -> Model | None:
    """Models and cut from rows (text, kind, fold); the rows of ``fold`` calibrate."""
    counts = count_cells(ruled.where("not fold").select("text", "kind"), order, bits).toArrow()
    kind, k, cell = (counts[c].to_numpy() for c in ("kind", "order", "cell"))
    if len(set(kind.tolist())) < 2:
        return None
    tables = []
    for name in ("gram", "context"):
        cells = np.zeros((2, order + 1, 1 << bits), np.float32)
        cells[kind, k, cell] = counts[name].to_numpy()
        tables.append(cells)
    grams, contexts = tables

    def bins(batches):
        for batch in batches:
            score = differences(batch.column(0).to_pylist(), grams, contexts)
            yield pa.RecordBatch.from_pydict({
                "bin": pa.array(np.clip(np.floor(score * 50), -500, 500).astype(np.int32)),
                "kind": batch.column(1).cast(pa.int32()),
            })

    binned = ruled.where("fold").select("text", "kind").mapInArrow(bins, "bin int, kind int")
    found = binned.groupBy("bin", "kind").count().toArrow()
    return Model(grams, contexts, calibrated_cut(*(found[c].to_numpy() for c in ("bin", "kind", "count"))))


def calibrated_cut(bins: np.ndarray, kinds: np.ndarray, counts: np.ndarray) -> float:
    """Cut between bins of width 1/50 with the least sum of both error rates; of equal
    ones the middle. 0 if one kind is missing."""
    if len(set(kinds.tolist())) < 2:
        return 0.0
    edges = np.arange(-500, 502)
    both = np.zeros((2, len(edges)))
    np.add.at(both, (kinds, bins + 500), counts)
    both /= both.sum(axis=1, keepdims=True)
    below = np.concatenate([np.zeros((2, 1)), np.cumsum(both, axis=1)], axis=1)
    error = below[1, :-1] + (1 - below[0, :-1])
    best = np.flatnonzero(error <= error.min() + 1e-12)
    return float(edges[best[len(best) // 2]] / 50)


# --- the filter -------------------------------------------------------------

def judge_urls(pages: DataFrame, rules: Sequence[Rule], key: str = "page_id", url: str = "url") -> DataFrame:
    """Rows (key, host, path, rule, verdict, score); score is null where a rule decides."""
    host, path = host_and_path(F.col(url))
    parsed = pages.select(F.col(key).alias(key), host.alias("host"), path.alias("path"))
    found = fitting_rule(F.col("host"), F.col("path"), rules)
    stored = cut(parsed.withColumn("_found", found).select(key, "host", "path", "_found.*"), "urls")
    text = F.concat("host", "path").alias("text")
    ruled = stored.where("verdict is not null").select(
        text, (F.col("verdict") == "allow").cast("int").alias("kind"),
        (F.crc32(F.concat("host", "path").cast("binary")) % 5 == 0).alias("fold"),
    )
    model = train(ruled)

    def score(batches):
        for batch in batches:
            hosts, paths, ruled_by = (batch.column(c).to_pylist() for c in (1, 2, 3))
            scores = np.zeros(batch.num_rows)
            if model is not None and batch.num_rows:
                scores = differences([h + p for h, p in zip(hosts, paths)], model.grams, model.contexts)
            values = [None if r is not None else 0.0 if not (h or p) else s
                      for s, h, p, r in zip(scores.tolist(), hosts, paths, ruled_by)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(values, pa.float64())], names=[*batch.schema.names, "score"]
            )

    limit = model.cut if model is not None else 0.0
    kind = dict(stored.dtypes)[key]
    scored = stored.mapInArrow(score, f"{key} {kind}, host string, path string, rule string, verdict string, score double")
    blank = (F.col("host") == "") & (F.col("path") == "")
    by_method = F.when(blank | (F.col("score") >= limit), F.lit("allow")).otherwise(F.lit("block"))
    return scored.withColumn("verdict", F.coalesce("verdict", by_method))


def rules_of(lines: Sequence[str]) -> list[Rule]:
    """Rules from lines such as ``allow org/``."""
    return [Rule(*line.split(" ", 1)) for line in lines]
