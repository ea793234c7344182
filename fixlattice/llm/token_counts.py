"""Token counts of fields and sections by offset mapping.

A document is rendered once (its fields, one a line, then the lines of its text), encoded once as a
whole, and its tokens' character spans are joined to the sections' spans, which cover the rendering without
gaps: a line owns its line break. A token inside one section counts there; one that crosses a boundary
is allocated by a rule:

- ``largest``: the section that holds most of its characters, the earlier on a tie (default);
- ``first`` / ``last``: the section of its first / last character.

A character whose bytes are shared by two tokens belongs to both spans. Null fields and texts
count as empty; an empty line is a section that holds its break alone, the last one may hold nothing.
The counts of a document's sections add up to its tokens. Very long texts are encoded whole. Repeated rows
give repeated sections. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixlattice.llm.text import encoder, slices

RULES = ("largest", "first", "last")


def token_spans(text: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and the one after the last of each token."""
    ends = np.cumsum(lengths)
    starts = ends - lengths
    heads = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    number = np.cumsum(heads) - 1  # of the character that each byte is part of
    return number[starts], number[ends - 1] + 1


def allocate(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str = "largest") -> tuple[np.ndarray, np.ndarray]:
    """(section of each token, whether it crosses); section i is [bounds[i], bounds[i+1])."""
    first = np.searchsorted(bounds, starts, side="right") - 1
    last = np.searchsorted(bounds, ends - 1, side="right") - 1
    crosses = first != last
    own = last.copy() if rule == "last" else first.copy()
    if rule == "largest":
        for i in np.flatnonzero(crosses).tolist():
            parts = np.arange(first[i], last[i] + 1)
            held = np.minimum(bounds[parts + 1], ends[i]) - np.maximum(bounds[parts], starts[i])
            own[i] = parts[int(np.argmax(held))]
    return own, crosses


def section_tokens(docs: DataFrame, path: str, fields: tuple[str, ...] = ("source", "lang"), text: str = "text", rule: str = "largest") -> DataFrame:
    """(doc_id, section, field, start, end, n_tokens, n_crossing): one row for each field and each line of the text. No shuffle.

    start and end count characters of the rendering; n_crossing: tokens counted here that also reach into another section.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    rendered = F.concat_ws("\n", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*fields, text)])
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), rendered.alias("_text"), F.array(*[F.size(F.split(F.coalesce(F.col(c).cast("string"), F.lit("")), "\n")) for c in fields]).cast("array<int>").alias("_lines"))
    names = ("doc_id", "section", "field", "start", "end", "n_tokens", "n_crossing")
    kinds = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, byte_level=True)
        for batch in batches:
            for part in slices(batch, "_text"):
                cols: list[list] = [[] for _ in names]
                texts = part.column("_text").cast(pa.binary()).to_pylist()
                for doc_id, raw, coded, lines in zip(part.column("doc_id").to_pylist(), texts, map(enc.encode, texts), part.column("_lines").to_pylist()):
                    sizes = np.fromiter((len(x) + 1 for x in raw.decode().split("\n")), np.int64)
                    sizes[-1] -= 1
                    # a field that has line breaks of its own is one section
                    heads = np.concatenate([np.cumsum([0, *lines]), np.arange(sum(lines) + 1, len(sizes))]).astype(np.int64)
                    bounds = np.append(np.concatenate([[0], np.cumsum(sizes)])[heads], sizes.sum())
                    n = len(bounds) - 1
                    starts, ends = token_spans(raw, enc.widths[np.frombuffer(coded, enc.dtype)]) if raw else (np.empty(0, np.int64),) * 2
                    section, crosses = allocate(starts, ends, bounds, rule)
                    cols[0] += [doc_id] * n
                    cols[1] += range(n)
                    cols[2] += [*fields, *[text] * (n - len(fields))]
                    cols[3] += bounds[:-1].tolist()
                    cols[4] += bounds[1:].tolist()
                    cols[5] += np.bincount(section, minlength=n).tolist()
                    cols[6] += np.bincount(section[crosses], minlength=n).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=list(names))

    return own.mapInArrow(run, "doc_id long, section int, field string, start long, end long, n_tokens long, n_crossing long")
