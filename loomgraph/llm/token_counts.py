"""Token counts of the sections of documents, by offsets of one encoding.

A document is encoded whole, once. Each token covers a span of characters; the
spans are joined with the sections of the document as intervals, by binary
search, and each token is allocated:

``first``  to the section of its first character;
``most``   to the section with most of its characters, the earlier on a tie;
``share``  to its sections in proportion to the characters that lie in each.

A token that shares no character with a section goes to section -1. The counts
of a document's rows therefore always add up to its tokens.

Without a table of sections the sections of a document are its lines, each
with the line feed that ends it.

Defined results: a null or empty text has no tokens and one section, 0, of no
characters when sections are lines; of sections that overlap the later one
begins where the earlier one ends; a section without bounds, or that ends
before it begins, has no tokens and is returned as it is; sections beyond the text are cut at its end; repeated documents are counted
each; a document without sections has all its tokens in section -1.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textvec import portions
from .tokenize import encoder, vocabulary

RULES = ("first", "most", "share")
SCHEMA = "doc_id long, section long, start long, end long, tokens double, crossing long, doc_tokens long"


def lines(text: str) -> np.ndarray:
    """Where lines begin, and the end of the text."""
    feeds = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == 10) + 1
    return np.unique(np.concatenate([[0], feeds[feeds < len(text)], [len(text)]])) if text else np.zeros(2, np.int64)


def allocate(a: np.ndarray, b: np.ndarray, start: np.ndarray, end: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens [a, b) to disjoint sorted sections: counts, the last for no section; and crossing tokens per section."""
    n = len(start)
    counts, crossing = np.zeros(n + 1), np.zeros(n, np.int64)
    if not len(a):
        return counts, crossing
    if not n:
        counts[0] = len(a)
        return counts, crossing
    low = np.searchsorted(end, a, side="right")  # first section that ends after the token begins
    high = np.searchsorted(start, b, side="left")  # sections before this begin before the token ends
    touched = np.maximum(high - low, 0)
    inside = touched == 1
    fits = inside & (start[np.minimum(low, n - 1)] <= a) & (b <= end[np.minimum(low, n - 1)])
    np.add.at(counts, low[fits], 1.0)
    counts[n] += np.count_nonzero(touched == 0)
    for t in np.flatnonzero((touched > 0) & ~fits):
        s = np.arange(low[t], high[t])
        share = np.minimum(end[s], b[t]) - np.maximum(start[s], a[t])
        s, share = s[share > 0], share[share > 0]
        if not len(s):
            counts[n] += 1
            continue
        crossing[s] += 1
        if rule == "first":
            counts[s[0] if start[s[0]] <= a[t] else n] += 1
        elif rule == "most":
            counts[s[np.argmax(share)]] += 1
        else:
            counts[s] += share / (b[t] - a[t])
            counts[n] += 1 - share.sum() / (b[t] - a[t])
    return counts, crossing


def disjoint(given: list[dict], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[dict]]:
    """Sections in order without overlap: starts, ends, numbers; and those that cannot hold anything."""
    bad = lambda s: s["start"] is None or s["end"] is None or s["end"] < s["start"]
    good = sorted((s for s in given if not bad(s)), key=lambda s: (s["start"], s["end"]))
    end = np.clip(np.array([s["end"] for s in good], np.int64), 0, length)
    start = np.clip(np.array([s["start"] for s in good], np.int64), 0, length)
    if len(good):
        reached = np.maximum.accumulate(end)
        start[1:] = np.maximum(start[1:], reached[:-1])
        end = np.maximum(start, end)
    return start, end, np.array([s["section"] for s in good], object), [s for s in given if bad(s)]


def attribute_fields(docs: DataFrame, fields: Sequence[str], joint: str = "\n", rule: str = "most", tokenizer: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """Tokens of each of several text columns, encoded as one text with ``joint`` between; ``section`` is the number of the field.

    A null field is empty. Tokens of what lies between fields go to section -1.
    """
    texts = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    spans, at = [], F.lit(0).cast("long")
    for k, text in enumerate(texts):
        end = at + F.char_length(text)
        spans.append(F.struct(at.alias("start"), end.alias("end"), F.lit(k).cast("long").alias("section")))
        at = end + len(joint)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.concat_ws(joint, *texts).alias("text"), F.array(*spans).alias("spans"))
    return counted(rows, rule, tokenizer)


def attribute(
    docs: DataFrame,
    sections: DataFrame | None = None,
    rule: str = "most",
    tokenizer: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Tokens of each section; ``sections`` has doc_id, section, start and end in code points."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if sections is not None:
        spans = sections.groupBy(F.col("doc_id").cast("long").alias("_doc")).agg(
            F.sort_array(F.collect_list(F.struct(*[F.col(c).cast("long").alias(c) for c in ("start", "end", "section")]))).alias("spans")
        )
        rows = rows.join(spans, F.col("doc_id") == F.col("_doc"), "left").select("doc_id", "text", F.coalesce("spans", F.expr("cast(array() as array<struct<start:bigint,end:bigint,section:bigint>>)")).alias("spans"))

    return counted(rows, rule, tokenizer)


def counted(rows: DataFrame, rule: str, tokenizer: str | None) -> DataFrame:
    """Tokens of each section of ``rows`` (doc_id, text[, spans])."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {', '.join(RULES)}")
    path = tokenizer or vocabulary()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(path, added=True)
        encode = ids_of.encode_spans
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            given = batch.column(2).to_pylist() if batch.num_columns > 2 else None
            parts = [(i, s) for i, t in enumerate(texts) for s in ids_of.segments(t)]
            found: list[list] = [[[], [], 0] for _ in texts]
            for lo, hi in portions([s for _, s in parts]):
                _, a, b, off = encode([s for _, s in parts[lo:hi]])
                for k in range(lo, hi):
                    f, p, q = found[parts[k][0]], off[k - lo], off[k - lo + 1]
                    f[0].append(a[p:q] + f[2])
                    f[1].append(b[p:q] + f[2])
                    f[2] += len(parts[k][1])
            columns: list[list] = [[] for _ in range(7)]
            for i, text in enumerate(texts):
                a, b = np.concatenate(found[i][0]), np.concatenate(found[i][1])
                if given is None:
                    edge = lines(text)
                    start, end, names = edge[:-1], edge[1:], np.arange(len(edge) - 1)
                else:
                    start, end, names, empty = disjoint(given[i], len(text))
                counts, crossing = allocate(a, b, start, end, rule)
                if counts[-1] > 1e-9 or not len(names):
                    start, end, names, crossing = np.append(start, 0), np.append(end, 0), np.append(names, -1), np.append(crossing, 0)
                else:
                    counts = counts[:-1]
                if given is not None and empty:
                    for column, values in zip(columns, zip(*[(ids[i], s["section"], s["start"], s["end"], 0.0, 0, len(a)) for s in empty], strict=True), strict=True):
                        column.extend(values)
                    if not len(start):
                        continue
                for column, values in zip(columns, ([ids[i]] * len(names), names, start, end, counts, crossing, [len(a)] * len(names)), strict=True):
                    column.extend(values if isinstance(values, list) else values.tolist())
            kinds = [pa.int64()] * 4 + [pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "section", "start", "end", "tokens", "crossing", "doc_tokens"])

    return rows.mapInArrow(count, SCHEMA)


def op3(spark, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document; a token of two lines counts for the one with most of it."""
    return attribute(spark.read.parquet(f"{sf_dir}/documents.parquet"))
