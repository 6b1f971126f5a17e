"""Token counts of the fields or sections of documents, by offset-mapped attribution.

A document is encoded once, as a whole; every token has a span of characters there (a token that holds a part of a
character only has that whole character as its span). The spans are joined to the sections' spans, both in order: a
token belongs to the sections that its span overlaps, and where these are several a rule says who gets it:

    first     the section that holds the token's first character
    last      the section that holds its last character
    majority  the section that holds most of its characters, the earlier one where two hold as many

A token that overlaps no section at all is counted in none of them. Sections are given as a column of (start, end) in
characters, ordered and disjoint; without one a text's lines are its sections, each with its newline.

Defined cases: a null or empty text has one empty line, without tokens; an empty section gets no tokens; repeated rows
and null ids are counted row by row; a null list of sections gives no rows; an empty table gives an empty result;
further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernweave.llm.bpe import default_files, load
from fernweave.llm.common import slices

RULES = ("first", "last", "majority")


def token_spans(text: str, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end character of each token of text; sizes: bytes of each token."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1
    ends = np.cumsum(sizes)
    return char[ends - sizes], char[ends - 1] + 1


def line_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each line in characters, newline included. A text that ends in a newline has an empty last line."""
    sizes = np.array([len(x) + 1 for x in text.split("\n")], dtype=np.int64)
    sizes[-1] -= 1
    ends = np.cumsum(sizes)
    return ends - sizes, ends


def attributed(first: np.ndarray, end: np.ndarray, starts: np.ndarray, stops: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section by the rule, and tokens that overlap it without belonging to it alone.

    Tokens and sections are in order, so the sections that a token overlaps are a range found by binary search.
    """
    n = len(starts)
    full = np.flatnonzero(stops > starts)
    s, e = starts[full], stops[full]
    low, high = np.searchsorted(e, first, "right"), np.searchsorted(s, end, "left")  # sections low .. high - 1 are overlapped
    hit = np.flatnonzero(high > low)
    low, high, first, end = low[hit], high[hit], first[hit], end[hit]
    if rule == "first":
        owner = low
    elif rule == "last":
        owner = high - 1
    else:
        owner = low.copy()
        held = np.minimum(e[low], end) - np.maximum(s[low], first)
        for k in range(1, int((high - low).max(initial=1))):
            at = np.flatnonzero(low + k < high)
            other = low[at] + k
            more = np.minimum(e[other], end[at]) - np.maximum(s[other], first[at])
            better = more > held[at]
            owner[at[better]], held[at[better]] = other[better], more[better]
    counts, crossing = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    np.add.at(counts, full[owner], 1)
    for i in np.flatnonzero(high - low > 1):
        crossing[full[low[i] : high[i]]] += 1
    return counts, crossing


def section_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sections: Column | None = None, rule: str = "first", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row for each section: doc_id, section (0, 1, ...), start_char, end_char, n_tokens, n_crossing, and doc_tokens.

    n_crossing: tokens that overlap this section and another one. doc_tokens: tokens of the whole document.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {', '.join(RULES)}")
    path, pattern = default_files(path, pattern)
    spans = F.lit(None).cast("array<struct<start:bigint,end:bigint>>") if sections is None else sections.cast("array<struct<start:bigint,end:bigint>>")
    kept = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), spans.alias("spans"))
    lines = sections is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for part in slices(batches, "text"):
            texts = part.column(1).to_pylist()
            given = None if lines else part.column(2).to_pylist()
            ids, offsets = bpe.encode(texts)
            sizes = bpe.lengths[ids]
            rows, columns = [], []
            for i, value in enumerate(texts):
                if lines:
                    starts, stops = line_spans(value)
                elif given[i] is None:
                    continue
                else:
                    starts, stops = (np.array([x[k] for x in given[i]], dtype=np.int64) for k in ("start", "end"))
                own = sizes[offsets[i] : offsets[i + 1]]
                first, end = token_spans(value, own) if len(own) else (own, own)
                counts, crossing = attributed(first, end, starts, stops, rule)
                rows.append(np.full(len(starts), i))
                columns.append(np.stack([np.arange(len(starts)), starts, stops, counts, crossing, np.full(len(starts), len(own))]))
            if columns:
                told = np.concatenate(columns, axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.concatenate(rows))), *[pa.array(x) for x in told]], names)

    names = ["doc_id", "section", "start_char", "end_char", "n_tokens", "n_crossing", "doc_tokens"]
    kind = kept.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} bigint" for n in names[1:]))
