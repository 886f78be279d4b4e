"""Byte-level BPE as a monoid: texts are encoded by halves and the halves joined at their boundary.

Two facts make a join exact. (1) Some places are match boundaries of the pattern in any text (`sure_cut`). A window
between two of them can be encoded apart from the rest. (2) Inside one match, a row of tokens is the encoding of its
bytes if each two neighbours are the encoding of theirs: the first merge across a boundary would be the lowest-ranked
merge of that pair alone, too. So a window inside a long match is settled once its first and last tokens agree with
the neighbours outside.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from shelfcast.llm.bpe import WHITE, Ordinary
from shelfcast.llm.common import ship

ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Two characters with a sure match boundary between them: a class other than white space ends and the next one can't
#: take its last character along, as an apostrophe before a letter might be. White space looks ahead, so no cut follows it.
SURE = regex.compile(
    rf"\p{{L}}(?=\P{{L}})|\p{{N}}(?=\P{{N}})|[^{WHITE}\p{{L}}\p{{N}}](?=[{WHITE}\p{{N}}])|[^'{WHITE}\p{{L}}\p{{N}}](?=\p{{L}})"
)
ONE_CLASS = regex.compile(rf"\p{{L}}+|\p{{N}}+|[^{WHITE}\p{{L}}\p{{N}}]+")


@dataclass(frozen=True)
class Vocabulary:
    """leaf_chars: characters of a leaf of the tree, which the library encodes; anything longer is joined from halves. window: characters on either side of a join that are encoded anew at first."""

    ranks_path: str
    pattern: str
    leaf_chars: int = 256
    window: int = 32


class TreeCodec:
    def __init__(self, how: Vocabulary):
        self.how = how
        self.ordinary = Ordinary(how.ranks_path, how.pattern)
        self.library = self.ordinary.library
        self.bytes_of = [b""] * (self.library.n_vocab)
        for token, i in self.library._mergeable_ranks.items():
            self.bytes_of[i] = token
        self.agree = functools.lru_cache(maxsize=100_000)(self._agree)

    def encode(self, text: str, a: int = 0, b: int | None = None) -> list[int]:
        """Token ids of text[a:b]."""
        b = len(text) if b is None else b
        if b - a <= self.how.leaf_chars:
            return self.ordinary(text[a:b])
        m = (a + b) // 2
        return self.join(text, a, m, b, self.encode(text, a, m), self.encode(text, m, b))

    def join(self, text: str, a: int, m: int, b: int, left: list[int], right: list[int]) -> list[int]:
        """left + right as the encoding of text[a:b]. The window around m grows until the tokens outside it are settled."""
        k = self.how.window
        while True:
            lo, hi = max(a, m - k), min(b, m + k)
            if (inner := ONE_CLASS.match(text, lo, hi)) and inner.end() == hi and a < lo and hi < b:
                if (out := self.inside(text, lo, m, hi, left, right)) is not None:
                    return out
            else:
                p, q = self.cut_before(text, lo, m), self.cut_after(text, m, hi)
                p, q = a if p is None and lo == a else p, b if q is None and hi == b else q
                if p is not None and q is not None:
                    keep = len(left) - self.tokens_of(reversed(left), len(text[p:m].encode()))
                    skip = self.tokens_of(right, len(text[m:q].encode()))
                    return left[:keep] + self.ordinary(text[p:q]) + right[skip:]
            k *= 2

    @staticmethod
    def cut_before(text: str, lo: int, m: int) -> int | None:
        """The last sure boundary that text[lo:m] shows before m, if any."""
        found = None
        for x in SURE.finditer(text, lo, m):
            found = x.end()
        return found

    @staticmethod
    def cut_after(text: str, m: int, hi: int) -> int | None:
        found = SURE.search(text, m, hi)
        return found.end() if found else None

    def tokens_of(self, ids, n_bytes: int) -> int:
        """How many of the ids, from their start, make up n_bytes: the boundary there is sure, so no token crosses it."""
        count = 0
        for i in ids:
            if n_bytes <= 0:
                break
            n_bytes -= len(self.bytes_of[i])
            count += 1
        return count

    def inside(self, text: str, lo: int, m: int, hi: int, left: list[int], right: list[int]) -> list[int] | None:
        """The join where text[lo:hi] lies inside one match; None where the window's ends disagree with the tokens outside."""
        x = self.tokens_of(reversed(left), len(text[lo:m].encode()))
        y = self.tokens_of(right, len(text[m:hi].encode()))
        if x >= len(left) or y >= len(right):
            return None
        raw = b"".join(map(self.bytes_of.__getitem__, left[len(left) - x :] + right[:y]))
        mid = self.library._core_bpe.encode_single_piece(raw)
        before, after = left[len(left) - x - 1], right[y]
        # The neighbours themselves must lie in the same match, or the pair test says nothing about them.
        back, ahead = max(0, lo - 200), hi + 200
        run = regex.compile(ONE_CLASS.pattern).match(text, lo, min(ahead, len(text)))
        spare = len(text[hi : run.end()].encode()) if run else 0
        taken = sum(len(self.bytes_of[i]) for i in right[:y]) - len(text[m:hi].encode())
        if taken + len(self.bytes_of[after]) > spare:
            return None
        head = text[back:lo]
        same = 0
        for c in reversed(head):
            if not ONE_CLASS.fullmatch(c + text[lo]):
                break
            same += len(c.encode())
        taken = sum(len(self.bytes_of[i]) for i in left[len(left) - x :]) - len(text[lo:m].encode())
        if taken + len(self.bytes_of[before]) > same:
            return None
        if self.agree(before, mid[0]) and self.agree(mid[-1], after):
            return left[: len(left) - x] + mid + right[y:]
        return None

    def _agree(self, a: int, b: int) -> bool:
        return self.library._core_bpe.encode_single_piece(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def decode(self, ids: list[int], a: int = 0, b: int | None = None) -> bytes:
        """Bytes of ids[a:b]: halves are decoded apart and put together."""
        b = len(ids) if b is None else b
        if b - a <= 65536:
            return b"".join(map(self.bytes_of.__getitem__, ids[a:b]))
        m = (a + b) // 2
        return self.decode(ids, a, m) + self.decode(ids, m, b)


@functools.lru_cache(maxsize=2)
def codec(how: Vocabulary) -> TreeCodec:
    return TreeCodec(how)


@functools.lru_cache(maxsize=2)
def decimals(n: int) -> list[str]:
    return [str(i) for i in range(n)]


def encode_decode(docs: DataFrame, how: Vocabulary) -> DataFrame:
    """Encodes and decodes every whole text: doc_id, n_tokens, ids_sha256, decoded_sha256.

    docs needs doc_id and text; other columns are ignored. A null text counts as empty: no tokens, digests of
    nothing. One row out for each row in, repeated rows and null doc_ids included; an empty table gives none.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = codec(how)
        names = decimals(len(tree.bytes_of))
        for batch in batches:
            n, sha, back = [], [], []
            for text in batch.column(1):
                ids = tree.encode(text.as_py() or "")
                n.append(len(ids))
                sha.append(hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(tree.decode(ids)).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, ENCODED)
