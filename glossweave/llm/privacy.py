"""Information-theoretic sanitisation of personal data.

Addresses and numbers are found by pattern. The terms of the documents that hold
them are then weighed by what they give away: over all documents, the pointwise mutual information of a
term and an entity, as a share of the entity's own information. A share of 1 says
that who reads the term knows the entity. Terms above one threshold are
generalised to their shape, above a higher one removed, wherever they stand: in
documents without the entity as well, by the highest share with any entity.

Every text is read twice. The first time its spans are kept, the terms of documents
with entities and, per task, in how many documents a word occurs; the second time
the places of the terms found to disclose.

Defined results: a null text is empty and has no spans; a term never covers a
word that touches a pattern's span, and counts only if it has a letter and
``MIN_TERM`` signs, edge punctuation aside. A term must stand with the entity in
``MIN_SUPPORT`` different texts, so copies of one text are no evidence. Entities
in all documents carry no information and reveal nothing. Repeated rows count as
often as they occur. Only the named columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import in_pieces
from .host_rules import grouped_words

# In the order in which kinds are listed.
KINDS = ("email", "ip", "card", "phone", "term")
MIN_TERM = 3
MIN_SUPPORT = 2
GENERALISE = 0.75
REMOVE = 0.9
#: Terms whose counts a task holds before it hands them on.
HELD_TERMS = 300_000
EDGES = ".,;:!?()[]{}\"'`<>|*#$%&"

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match cannot begin inside a run of digits unless it begins at its start, and
# saying so keeps long runs linear.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- patterns ---------------------------------------------------------------

def emails(text: str) -> Iterator[tuple[int, int]]:
    """Spans of e-mail addresses, found from their @ so that long runs stay linear."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = done + len(text[done:at].rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if start < at else None
        done = found.end() if found else at + 1
        if found:
            yield start, done
        at = text.find("@", done)


def small_part(part: str) -> bool:
    value = part.lstrip("0")
    return len(value) < 3 or (len(value) == 3 and value <= "255")


def luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans (start, kind, end) by start, then kind, in code points."""
    found = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    for match in IP.finditer(text):
        if all(map(small_part, match[0].split("."))):
            found.append((match.start(), 1, match.end()))
    for match in CARD.finditer(text):
        if match.end() - match.start() >= 14:
            digits = _digits(match[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((match.start(), 2, match.end()))
    if "+" in text:
        for match in PHONE.finditer(text):
            if 10 <= len(_digits(match[0])) <= 15:
                found.append((match.start(), 3, match.end()))
    return sorted(found)


def as_term(word: str) -> str | None:
    term = word.strip(EDGES).lower()
    return term if len(term) >= MIN_TERM and any(map(str.isalpha, term)) else None


def term_spans(
    text: str, spans: list[tuple[int, int, int]], words: set[str] | None = None
) -> Iterator[tuple[str, int, int]]:
    """All terms (term, start, end) of a text that touch none of its spans; of ``words`` alone, if given."""
    ends = sorted((s, e) for s, _, e in spans)
    reach = list(accumulate((e for _, e in ends), max))
    starts = [s for s, _ in ends]
    for match in WORD.finditer(text):
        if words is not None and match[0] not in words:
            continue
        first, last = match.span()
        at = bisect_left(starts, last)
        if at and reach[at - 1] > first:
            continue
        term = as_term(match[0])
        if term:
            lead = len(match[0]) - len(match[0].lstrip(EDGES))
            yield term, first + lead, first + lead + len(match[0].strip(EDGES))


# --- one pass over the texts ------------------------------------------------

_ROWS = (
    "tag int, row long, same long, entities array<string>, terms array<string>, term string, n long, "
    "spans array<struct<start:int,kind:int,stop:int>>"
)
_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32())])
_TYPES = [
    pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.int64(),
    pa.list_(_SPAN),
]
_NAMES = ["tag", "row", "same", "entities", "terms", "term", "n", "spans"]
DOCUMENT, TOGETHER, WORDS = range(3)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=_NAMES)


def document_words(texts: list[str | None]) -> Iterator[tuple[list[str], np.ndarray]]:
    """Terms of groups of texts with the number of texts each is in."""
    for _, words, _ in grouped_words(texts):
        lengths = np.array([len(w) for w in words], np.int64)
        if not lengths.sum():
            continue
        flat = np.empty(int(lengths.sum()), object)
        flat[:] = [w for own in words for w in own]
        codes, distinct = pd.factorize(flat)
        numbers, terms = pd.factorize(np.array([as_term(w.decode()) for w in distinct], object))
        of = np.repeat(np.arange(len(words)), lengths)
        number = numbers[codes]
        pairs = pd.unique((of * (len(terms) + 1) + number)[number >= 0])
        yield terms.tolist(), np.bincount(pairs % (len(terms) + 1), minlength=len(terms))


def read_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows of three kinds from (row, same, text): spans of a document, its
    entities and terms if it has entities, and in how many documents of a group a word occurs."""

    def words(counts: dict[str, int]) -> pa.RecordBatch:
        columns = [pa.nulls(len(counts), t) for t in _TYPES]
        columns[0] = pa.array(np.full(len(counts), WORDS, np.int32))
        columns[5], columns[6] = pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())
        return pa.RecordBatch.from_arrays(columns, names=_NAMES)

    def run(batches):
        totals: dict[str, int] = {}
        for batch in in_pieces(batches):
            texts = batch.column(2).to_pylist()
            rows = []
            for row, same, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts):
                spans = base_spans(body) if body else []
                shown = [{"start": s, "kind": k, "stop": e} for s, k, e in spans]
                rows.append((DOCUMENT, row, same, None, None, None, None, shown))
                if spans:
                    entities = sorted({body[s:e] for s, _, e in spans})
                    terms = sorted({t for t, _, _ in term_spans(body, spans)})
                    rows.append((TOGETHER, row, same, entities, terms, None, None, None))
                if len(rows) >= 500:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)
            for terms, counts in document_words(texts):
                for term, count in zip(terms, counts.tolist()):
                    totals[term] = totals.get(term, 0) + count
                if len(totals) > HELD_TERMS:
                    yield words(totals)
                    totals = {}
        yield words(totals)

    return docs.select("row", "same", F.col(text)).mapInArrow(run, _ROWS)


# --- disclosure -------------------------------------------------------------

def disclosures(read: DataFrame, documents: int) -> DataFrame:
    """Rows (entity, term, share) for terms with enough support whose share is large enough."""
    held = read.where(F.col("tag") == TOGETHER)
    entities = held.select("row", "same", F.explode("entities").alias("entity"))
    of_entity = entities.groupBy("entity").agg(F.count("*").alias("n_entity"))
    # Entities of fewer texts than a term needs have no term, and other rows none to add. Where
    # the least and the greatest text differ there are two, as MIN_SUPPORT asks.
    often = entities.groupBy("entity").agg(F.min("same").alias("x"), F.max("same").alias("y")).where("x <> y").select("entity")
    entities = cut(entities.join(often, "entity", "left_semi"), "private-entities")
    bearing = entities.select("row").distinct()
    terms = held.select("row", "terms").join(bearing, "row", "left_semi").select("row", F.explode("terms").alias("term"))
    # A term of a single document has no support.
    counts = cut(
        read.where(F.col("tag") == WORDS).groupBy("term").agg(F.sum("n").alias("n_term")).where(F.col("n_term") >= MIN_SUPPORT),
        "private-counts",
    )
    # The largest share of a pair has the term only with the entity: above that count it is below the threshold.
    most = of_entity.join(often, "entity", "left_semi").agg(F.max("n_entity")).first()[0] or 1
    limit = max(documents, 1) ** (1 - GENERALISE) * most ** GENERALISE * 1.0001
    rare = counts.where(F.col("n_term") <= limit)
    pairs = terms.join(rare.select("term"), "term", "left_semi").join(entities, "row")
    pairs = pairs.groupBy("entity", "term").agg(
        F.count("*").alias("n_both"), F.min("same").alias("x"), F.max("same").alias("y")
    ).where("x <> y")
    of_term = rare
    total = F.lit(float(max(documents, 1)))
    own = F.log2(total / F.col("n_entity"))
    mutual = F.log2(F.col("n_both") * total / (F.col("n_entity") * F.col("n_term")))
    share = F.when(own > 0, F.least(F.try_divide(mutual, own), F.lit(1.0))).otherwise(0.0)
    weighed = pairs.join(of_entity, "entity").join(of_term, "term").select("entity", "term", share.alias("share"))
    return weighed.where(F.col("share") >= GENERALISE)


def places_of_terms(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (row, term, start, stop) of all places of (row, text) at which a found term stands.

    Tasks get the terms' hashes alone, eight bytes each; the caller joins by the term itself.
    """
    hashes = found.select("term").mapInArrow(_hashes, "hash long").toArrow()["hash"].to_numpy()
    hashes = np.unique(hashes)

    def run(batches):
        for batch in in_pieces(batches, 200):
            texts = batch.column(1).to_pylist()
            words = [set(WORD.findall(body)) if body else set() for body in texts]
            of_word = {w: as_term(w) for w in set().union(*words)}
            terms = list({t for t in of_word.values() if t})
            mine = np.array([xxhash.xxh64_intdigest(t.encode()) for t in terms], np.uint64).view(np.int64)
            wanted = {t for t, known in zip(terms, np.isin(mine, hashes).tolist()) if known}
            showing = {w for w, t in of_word.items() if t in wanted}
            out = []
            for row, body, own in zip(batch.column(0).to_pylist(), texts, words):
                # A text without a wanted word has no place to look for.
                if not showing.isdisjoint(own):
                    out += [(row, t, s, e) for t, s, e in term_spans(body, base_spans(body), showing) if t in wanted]
            columns = list(zip(*out)) or [()] * 4
            types = (pa.int64(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=["row", "term", "start", "stop"]
            )

    return rows.mapInArrow(run, "row long, term string, start int, stop int")


def _hashes(batches):
    for batch in batches:
        values = [xxhash.xxh64_intdigest(t.encode()) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_pydict({"hash": np.array(values, np.uint64).view(np.int64)})


def find_private(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (row, key, spans, terms): pattern spans and term spans of every document.

    ``terms`` has structs (start, kind, stop, remove); ``row`` is a number of the row.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.xxhash64(body).alias("same"), F.col(text).alias("text"),
        F.col(key).alias("_key"),
    )
    keys = cut(rows.select("row", "_key"), "private-keys")
    read = cut(read_texts(rows), "private-read")
    shares = disclosures(read, keys.count())
    found = cut(shares.groupBy("term").agg(F.max("share").alias("share")), "private-shares")
    hits = cut(places_of_terms(rows.select("row", "text"), found), "private-places").join(found, "term")
    span = F.struct(
        "start", F.lit(KINDS.index("term")).alias("kind"), "stop", (F.col("share") >= REMOVE).alias("remove")
    )
    terms = hits.select("row", "start", "stop", "share").groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("terms"))
    spans = read.where(F.col("tag") == DOCUMENT).select("row", "spans")
    none = F.array().cast("array<struct<start:int,kind:int,stop:int,remove:boolean>>")
    return (
        keys.join(spans, "row").join(terms, "row", "left")
        .select("row", F.col("_key").alias(key), "spans", F.coalesce("terms", none).alias("terms"))
    )


def written(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ","
    )


def digest_columns(found: DataFrame, key: str = "doc_id") -> DataFrame:
    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    plain = F.transform("terms", lambda t: F.struct(t["start"], t["kind"], t["stop"]))
    every = F.array_sort(F.concat("spans", plain))
    return found.select(
        key, *map(count, KINDS[:4]), F.sha2(written(F.col("spans")).cast("binary"), 256).alias("base_sha256"),
        written(every).alias("spans"), F.size("terms").cast("long").alias("n_term"),
    )


# --- the sanitised texts ----------------------------------------------------

def shape(word: str) -> str:
    """What a generalised term still tells: a number, a name or a word."""
    return "[NUMBER]" if any(map(str.isdigit, word)) else "[NAME]" if word[:1].isupper() else "[WORD]"


def sanitised_text(text: str, spans: list[tuple[int, int, str | None]]) -> str:
    """Text with spans replaced: by the given words, or by their shape if none are given.

    Spans that overlap are replaced as one, with the words of the first.
    """
    out, done = [], 0
    for start, stop, instead in sorted(spans, key=lambda s: (s[0], s[1])):
        if start < done:
            done = max(done, stop)
            continue
        out += [text[done:start], shape(text[start:stop]) if instead is None else instead]
        done = stop
    return "".join([*out, text[done:]])


def sanitise(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, text) with personal data replaced by its kind, and revealing terms
    generalised or removed. Documents with the same key are expected to have the same text."""
    one = found.groupBy(key).agg(F.first("spans").alias("_spans"), F.first("terms").alias("_terms"))
    rows = docs.select(key, F.col(text).alias("text")).join(one, key, "left")

    def run(batches):
        for batch in in_pieces(batches):
            texts = []
            for body, spans, terms in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3))):
                cuts = [(s["start"], s["stop"], f"[{KINDS[s['kind']].upper()}]") for s in spans or []]
                cuts += [(t["start"], t["stop"], "" if t["remove"] else None) for t in terms or []]
                texts.append(sanitised_text(body, cuts) if body and cuts else body)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return rows.mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, text string")
