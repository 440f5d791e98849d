"""Token counts of the sections of documents, from one encoding of each whole document.

A document is encoded once. A byte-level vocabulary loses no byte, so the lengths of its tokens give every token's place, and a token
belongs to each section that holds its anchor: by the rule ``first`` its first byte, ``last`` its last byte, ``most`` the byte in its middle. Sections
that part a document thus share out its tokens exactly, those across a boundary too. Tokens and sections meet by binary search.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyfold.llm.shared import slices

VOCABULARY = "byte_bpe_50k.tiktoken"
RULES = ("first", "last", "most")


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def _encoding(path: str):
    """The encoding of a rank file and the byte length of each token, once for each worker process."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def line_bounds(raw: np.ndarray) -> np.ndarray:
    """Byte bounds of lines, each with its line break; an empty text is one empty line."""
    ends = np.flatnonzero(raw == 10) + 1
    if not raw.size or not ends.size or ends[-1] < raw.size:
        ends = np.append(ends, raw.size)
    return np.stack([np.concatenate(([0], ends[:-1])), ends], axis=1)


def attribute(docs: DataFrame, rule: str = "first", sections: str | None = None, path: str | None = None) -> DataFrame:
    """One row per section: ``doc_id``, ``section`` (from 0), ``start``, ``end`` (code points), ``n_tokens``, ``n_crossing`` (tokens partly inside
    and partly outside) and ``doc_tokens``.

    ``sections`` names a column of ``array<struct<start, end>>`` in code points, cut to the text where they go beyond; without it the lines of
    the text are its sections. A null text is empty: its one line, or its given sections, hold nothing; null sections give no row. Rows that repeat and null ids
    are rows like others."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    place = path or vocabulary()
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, sizes = _encoding(place)
        for batch in batches:
            for part in slices(batch, "text", 2_000_000):
                owner, columns = [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    text = text or ""
                    raw = np.frombuffer(text.encode(), np.uint8)
                    ends = np.cumsum(sizes[encoding.encode_to_numpy(text, disallowed_special=())]) if text else np.empty(0, np.int64)
                    starts = np.concatenate(([0], ends[:-1])) if ends.size else ends
                    anchor = {"first": starts, "last": ends - 1, "most": (starts + ends - 1) // 2}[rule]
                    leads = (raw & 0xC0) != 0x80
                    if sections is None:
                        bounds = line_bounds(raw)
                        before = np.concatenate(([0], np.cumsum(leads)))
                        chars = before[bounds]
                    else:
                        given = part.column(sections)[i].as_py()
                        chars = np.array([(s["start"], s["end"]) for s in given or [] if s], np.int64).reshape(-1, 2)
                        chars = np.clip(chars, 0, len(text))
                        bounds = np.append(np.flatnonzero(leads), raw.size)[chars] if len(chars) else chars
                    low, high = bounds[:, 0], np.maximum(bounds[:, 0], bounds[:, 1])
                    n = np.searchsorted(anchor, high) - np.searchsorted(anchor, low)
                    crossing = _across(starts, ends, low, low, high) + _across(starts, ends, high, low, high)
                    both = np.searchsorted(ends, low, "right") == np.searchsorted(ends, high, "right")
                    over = both & (_across(starts, ends, low, low, high) == 1) & (_across(starts, ends, high, low, high) == 1)
                    m = len(low)
                    owner.append(np.full(m, i))
                    columns.append((np.arange(m), chars[:, 0], chars[:, 1], n, crossing - over, np.full(m, ends.size)))
                made = [np.concatenate(c) for c in zip(*columns)] if columns else [np.empty(0, np.int64)] * 6
                ids = part.column("doc_id").take(pa.array(np.concatenate(owner) if owner else np.empty(0, np.int64)))
                names = ("section", "start", "end", "n_tokens", "n_crossing", "doc_tokens")
                yield pa.record_batch({"doc_id": ids} | {k: pa.array(v.astype(np.int64)) for k, v in zip(names, made)})

    columns = ["doc_id", "text", *([sections] if sections else [])]
    return docs.select(*columns).mapInArrow(
        run, f"doc_id {kind}, section long, start long, end long, n_tokens long, n_crossing long, doc_tokens long"
    )


def _across(starts: np.ndarray, ends: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """1 where the token over the place ``at`` begins before and ends after it, and the section is not empty."""
    if not ends.size:
        return np.zeros(at.size, np.int64)
    token = np.minimum(np.searchsorted(ends, at, "right"), ends.size - 1)
    return ((starts[token] < at) & (ends[token] > at) & (low < high)).astype(np.int64)
