"""Token counts of whole texts by overlap resynchronisation.

A text longer than ``chunk_chars`` is cut into overlapping chunks that are
encoded on their own, each with the offsets of its words.  Two facts make
splicing exact for a byte-level BPE tokenizer:

* the word pattern never looks back, so a chunk that starts anywhere and
  has a word boundary at p where the true text has one too is right from
  p on;
* a boundary at least ``margin`` characters before a chunk's end was
  decided by characters inside the chunk (endings and special strings
  look ahead less than that), so in a chunk that is right so far it is a
  boundary of the true text.

Left and right chunk are therefore spliced at the first boundary that
both have in their overlap and that is proven in the left one.  If there
is none (one word spans the overlap), the left chunk is encoded again
with its overlap doubled, until one is found or the text ends.

Defined results: null text counts as empty (0 tokens, 0 bytes); null or
repeated doc_ids are kept row by row; an empty table gives no rows; extra
columns are never read.  No shuffle: each row is counted where it is
read.  Memory per task: ``batch_chars`` characters of chunks plus the
word table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import only, text_or_empty
from tidemark.llm.pretoken import Splitter, WordTable, library_words, slices


class Chunks:
    """Chunks encoded with offsets, and the splicing of a document's chunks."""

    def __init__(self, tokenizer: str, chunk_chars: int, overlap: int, batch_chars: int = 2_000_000):
        self.splitter = Splitter(tokenizer)
        self.table = WordTable(library_words(self.splitter))
        self.chunk, self.overlap, self.batch_chars = chunk_chars, overlap, batch_chars

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per text: offsets of its words (from its start) and their numbers of ids."""
        for lo, hi in slices(texts, self.batch_chars):
            part = texts[lo:hi]
            joined, starts, ends, first = self.splitter.split(part)
            n = self.table.counts(self.table.rows(joined, starts, ends))
            at = 0
            for k, t in enumerate(part):
                a, b = first[k], first[k + 1]
                yield starts[a:b] - at, n[a:b]
                at += len(t) + 1

    def ranges(self, length: int) -> list[tuple[int, int]]:
        """Overlapping (from, to) of a text's chunks."""
        if length <= self.chunk + self.overlap:
            return [(0, length)]
        starts = range(0, length - self.overlap, self.chunk)
        return [(a, min(length, a + self.chunk + self.overlap)) for a in starts]

    def splice(self, text: str, ranges: list[tuple[int, int]], encoded) -> int:
        """Number of ids of the whole text from its encoded chunks."""
        total, (_, end), (at, n) = 0, ranges[0], encoded[0]
        # at, n: words known to be right from at[0] on, as far as they are proven
        for (start, stop), (words, ids) in zip(ranges[1:], encoded[1:]):
            if stop <= end:
                continue                                # a widened chunk covers this one
            words = words + start
            width = self.overlap
            while True:
                sure = len(text) if end == len(text) else end - self.splitter.margin
                both = np.intersect1d(at[at <= sure], words, assume_unique=True)
                if len(both) or end == len(text):
                    break
                width *= 2
                end = min(len(text), end + width)
                begin = int(at[0])
                (at, n), = self.encode([text[begin:end]])
                at = at + begin
            if not len(both):
                break                                   # the left chunk holds the rest
            p = int(both[0])
            total += int(n[at < p].sum())
            keep = words >= p
            at, n, end = words[keep], ids[keep], stop
        return total + int(n.sum())

    def counts(self, texts: list[str]) -> list[int]:
        """Number of ids of each whole text, a bounded batch of chunks at a time."""
        out: list[int] = []
        for lo, hi in slices(texts, self.batch_chars):
            part = texts[lo:hi]
            spans = [self.ranges(len(t)) for t in part]
            encoded = self.encode([t[a:b] for t, r in zip(part, spans) for a, b in r])
            for t, r in zip(part, spans):
                out.append(self.splice(t, r, [next(encoded) for _ in r]))
        return out


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, chunk_chars: int = 16_384,
                 overlap: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = Chunks(tokenizer, chunk_chars, overlap)
        for batch in batches:
            n = chunks.counts(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_bytes": batch.column(1),
                                              "n_tokens": pa.array(n, pa.int64())})

    return (only(docs, id=id_col, text=text_col)
            .select(F.col("id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
            .select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
            .mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > F.lit(limit)))
