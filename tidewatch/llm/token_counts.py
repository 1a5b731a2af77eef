"""Token counts with overlap resynchronisation (operator 2).

A huge document is encoded in overlapping chunks, each with character offsets.  Two
neighbours are spliced at a boundary that both have and that is proven stable; where the
overlap holds none, it is widened until it does or the text ends.  A document of ordinary
length is cut at all of its stable boundaries, and the counts of short parts, words mostly,
are remembered; one with other white space than ``BLANKS`` is encoded in one call.

A boundary is *stable* when the character before it is not white space and the one after
it is.  The pre-tokenizer never puts both into one piece, it does not look behind, and the
only thing it looks ahead for (what follows white space) lies right of the boundary.  So
pieces left of a stable boundary do not depend on what is right of it, and the other way
round.  An added token with white space in it would break this; ``Encoder`` refuses one.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import pick

CHUNK_CHARS = 16_384
OVERLAP_CHARS = 256
TOKEN_LIMIT = 512
BLANKS = " \n\t\r"
CACHED_PARTS = 400_000
CACHED_CHARS = 32  # longer parts are rare and not remembered
LEARNT = 1024  # parts encoded at a time
_PART = re.compile(rf"[{BLANKS}]*[^{BLANKS}]+|[{BLANKS}]+")  # from one stable boundary to the next
_OTHER_SPACE = re.compile(rf"[^\S{BLANKS}]")


class Encoder:
    """The tokenizer of a file, set for exact counts: no truncation, no padding."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        for token in self.tokenizer.get_added_tokens_decoder().values():
            if any(c.isspace() for c in token.content) or token.lstrip or token.rstrip:
                raise ValueError(f"the added token {token.content!r} reaches over white space: chunks can't be spliced")
        self.known: dict[str, int] = {}

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text, every text in one call."""
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def count_by_parts(self, texts: list[str]) -> list[int]:
        """What ``count`` gives, from the counts of the parts between stable boundaries."""
        whole = [i for i, t in enumerate(texts) if _OTHER_SPACE.search(t)]
        counts = dict(zip(whole, self.count([texts[i] for i in whole])))
        for i, text in enumerate(texts):
            if i not in counts:
                parts = _PART.findall(text)
                try:
                    counts[i] = sum(map(self.known.__getitem__, parts))
                except KeyError:
                    counts[i] = self._learn(parts)
        return [counts[i] for i in range(len(texts))]

    def _learn(self, parts: list[str]) -> int:
        """Tokens of the parts; the short ones are known from now on."""
        new = list(set(parts).difference(self.known))
        fresh: dict[str, int] = {}
        for at in range(0, len(new), LEARNT):
            some = new[at : at + LEARNT]
            fresh.update(zip(some, self.count(some)))
        n = sum(self.known[p] if p in self.known else fresh[p] for p in parts)
        if len(self.known) > CACHED_PARTS:
            self.known.clear()
        self.known.update((p, c) for p, c in fresh.items() if len(p) <= CACHED_CHARS)
        return n

    def encode(self, text: str, low: int, high: int) -> Pieces:
        return Pieces(self.tokenizer.encode(text[low:high], add_special_tokens=False), low)


class Pieces:
    """The pieces of a part of a text that begins at the character ``low`` of it."""

    def __init__(self, encoding, low: int):
        self.encoding, self.low, self.ids = encoding, low, encoding.ids

    def first_at(self, at: int) -> int | None:
        """The first piece that begins at a character of the whole text."""
        piece = self.encoding.char_to_token(at - self.low)
        return piece if piece is not None and self.encoding.token_to_chars(piece)[0] == at - self.low else None


def is_stable(text: str, at: int) -> bool:
    return 0 < at < len(text) and text[at] in BLANKS and not text[at - 1].isspace()


def _common_boundary(text: str, left: Pieces, right: Pieces, low: int, high: int) -> tuple[int, int, int] | None:
    """The last stable character in [low, high) where a piece begins on both sides, and those pieces."""
    for at in range(high - 1, low - 1, -1):
        if is_stable(text, at):
            mine, other = left.first_at(at), right.first_at(at)
            if mine is not None and other is not None:
                return at, mine, other
    return None


def encode_huge(encoder: Encoder, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[int]:
    """Ids of a whole text, encoded chunk by chunk; equal to one call on all of it."""
    done: list[int] = []
    start, end = 0, min(len(text), chunk)  # text[start:end] is encoded, from the piece ``first`` on, not yet in done
    left, first = encoder.encode(text, start, end), 0
    while end < len(text):
        width = overlap
        while True:
            low = max(start, end - width)
            new_end = min(len(text), end + max(chunk, width))
            right = encoder.encode(text, low, new_end)
            found = _common_boundary(text, left, right, low + 1, end)
            if found is not None or low == start:
                break
            width *= 2
        if found is not None:
            start, cut, begin = found
            done += left.ids[first:cut]
            left, first = right, begin
        else:  # no stable place in all of the left chunk: both are one chunk from now on
            left, first = right, 0
        end = new_end
    return done + left.ids[first:]


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = TOKEN_LIMIT, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, n_chunked`` for every row.

    Null texts count as empty; a null doc_id stays null; repeated rows are counted each;
    an empty table gives an empty result; other columns are ignored.  ``n_chunked`` is 1
    for a document that went through overlapping chunks.  Rows are worked on where they
    are read: there is no shuffle, and memory holds one Arrow batch and one chunk.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_path)
        for batch in batches:
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            small = [i for i, t in enumerate(texts) if len(t) <= chunk]
            counts = [0] * len(texts)
            for i, n in zip(small, encoder.count_by_parts([texts[i] for i in small])):
                counts[i] = n
            large = [int(len(t) > chunk) for t in texts]
            for i, is_large in enumerate(large):
                if is_large:
                    counts[i] = len(encode_huge(encoder, texts[i], chunk, overlap))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array(large, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens", "n_chunked"],
            )

    out = pick(docs, doc_id="long", text="string").mapInArrow(scan, "doc_id long, n_bytes long, n_tokens long, n_chunked long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
