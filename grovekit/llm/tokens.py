"""Token counts: whole documents encoded once, token spans joined to sections by interval."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts as sliced


@cache
def encoding(path: str, pattern: str):
    """The tokenizer and the bytes of each token, by id."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes


def default_tokenizer() -> tuple[str, str]:
    import public_tokenizers as P

    return P.path("byte_bpe_50k.tiktoken"), P.PATTERN


def sections(raw: bytes, separator: bytes = b"\n") -> np.ndarray:
    """Ends (bytes) of the sections: each line with its separator; the last may have none. No bytes: one empty section."""
    at = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(at == separator[0]) + 1
    return ends if len(ends) and ends[-1] == len(raw) else np.append(ends, len(raw))


def attribute(token_ends: np.ndarray, section_ends: np.ndarray) -> np.ndarray:
    """Number of tokens of each section.

    Both lists of ends tile the same bytes. A token belongs to the section that
    holds most of its bytes, the earlier one on a tie; so counts add up to the
    number of tokens, and a section can have none.
    """
    counts = np.zeros(len(section_ends), np.int64)
    if not len(token_ends):
        return counts
    starts = np.append(0, token_ends[:-1])
    first = np.searchsorted(section_ends, starts, side="right")  # the section of the first byte
    last = np.searchsorted(section_ends, token_ends - 1, side="right")  # of the last byte
    owner = first.copy()
    for i in np.flatnonzero(first != last):
        cuts = np.append(np.append(starts[i], section_ends[first[i] : last[i]]), token_ends[i])
        owner[i] = first[i] + np.argmax(np.diff(cuts))
    return counts + np.bincount(owner, minlength=len(counts))


def shared(token_ends: np.ndarray, section_ends: np.ndarray) -> np.ndarray:
    """Number of tokens of which each section holds some bytes, but not all."""
    counts = np.zeros(len(section_ends) + 1, np.int64)
    starts = np.append(0, token_ends[:-1])[: len(token_ends)]
    first = np.searchsorted(section_ends, starts, side="right")
    last = np.searchsorted(section_ends, token_ends - 1, side="right")
    cut = first != last
    np.add.at(counts, first[cut], 1)
    np.add.at(counts, last[cut] + 1, -1)
    empty = section_ends == np.append(0, section_ends[:-1])[: len(section_ends)]
    return np.where(empty, 0, np.cumsum(counts)[:-1])


def token_counts(docs: DataFrame, fields: tuple = ("text",), tokenizer: tuple | None = None, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, field, section int, start long, end long, n_tokens long, n_split long): a row a section.

    A document is its fields laid end to end with one line feed between them, and
    is encoded once, as a whole; sections are the lines of each field (with their
    line feed), start and end code points within the document. A token across a
    boundary belongs to the section that holds most of its bytes, the earlier on
    a tie; n_split counts the tokens a section shares with others. Sections of a
    document so add up to its tokens. Null fields are empty; an empty field has
    one empty section with no tokens. Repeated rows appear as often as given, an
    empty table gives no rows, other columns are ignored. Token files must exist
    on every node.
    """
    path, pattern = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, sizes = encoding(path, pattern)
        for b in sliced(batches):
            rows, names, numbers, starts, ends, counts, splits = [], [], [], [], [], [], []
            texts = [c.to_pylist() for c in b.columns[1:]]
            for row, parts in enumerate(zip(*texts, strict=True)):
                parts = [p or "" for p in parts]
                text = "\n".join(parts)
                raw = text.encode()
                token_ends = np.cumsum(sizes[np.array(coder.encode_ordinary(text), np.int64)])
                at, bounds = 0, []
                for name, part in zip(fields, parts, strict=True):
                    own = sections(part.encode()) + at
                    at = int(own[-1]) + 1
                    names += [name] * len(own)
                    numbers += range(len(own))
                    bounds.append(own)
                tiles = np.concatenate(bounds)
                last = np.array([len(x) for x in bounds]).cumsum()[:-1] - 1
                tiles[last] += 1  # the line feed between fields goes to the section before it
                counts.append(attribute(token_ends, tiles))
                chars = np.append(0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))
                begins = np.append(0, tiles[:-1])
                starts.append(chars[begins])
                ends.append(chars[tiles])
                splits.append(shared(token_ends, tiles))
                rows.append(np.full(len(tiles), row))
            if rows:
                ids = b.column(0).take(pa.array(np.concatenate(rows)))
                cols = [ids, pa.array(names), pa.array(numbers, pa.int32()), *[pa.array(np.concatenate(x).astype(np.int64)) for x in (starts, ends, counts, splits)]]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "field", "section", "start", "end", "n_tokens", "n_split"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = [F.col(f"`{c}`").cast("string").alias(f"_{i}") for i, c in enumerate(fields)]
    return docs.select(F.col(f"`{id_col}`"), *texts).mapInArrow(run, f"doc_id {kind}, field string, section int, start bigint, end bigint, n_tokens bigint, n_split bigint")
