"""Byte-pair vocabularies in Python workers.

A place between a character that is not white space and a white-space character is a match boundary of the
pattern in every text, whatever surrounds it: only the first character of a match may be white space before
something else, and no alternative looks behind. So a text may be cut there and its chunks encoded apart.
"""

from __future__ import annotations

import array
import base64
import functools
import os
import re
import sys

#: Unicode White_Space, which the pattern's \s means.
WHITE = " \t\n\r\x0b\x0c\x85\xa0  -     　"
RUNS = re.compile(rf"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
TWO = re.compile(rf"[{WHITE}]{{2}}")
#: Up to here the Unicode tables of both libraries agree; chunks with later characters go to the reference library itself.
PLAIN = re.compile("[\x00-ɏ]*")
#: The one alternative that looks ahead. It matters only where two white-space characters meet; without it the pattern
#: runs on an automaton that never steps back.
LOOKAHEAD = r"\s+(?!\S)|"
SPECIAL = "<|endoftext|>"


@functools.lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


class Ordinary:
    """Encodes texts by ranks, each match of the pattern apart; texts in which no two white-space characters meet go by the pattern without its lookahead."""

    def __init__(self, ranks_path: str, pattern: str):
        self.library = encoding(ranks_path, pattern)
        self.full = self.library._core_bpe.encode_ordinary
        self.plain = encoding(ranks_path, pattern.replace(LOOKAHEAD, ""))._core_bpe.encode_ordinary

    def __call__(self, text: str) -> list[int]:
        return (self.full if TWO.search(text) else self.plain)(text)


@functools.lru_cache(maxsize=4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Tokenizer.from_file(path)


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit ids."""
    out = array.array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


class PackedEncoder:
    """Texts to packed ids, exactly as the tokenizer file's library gives them.

    json_path: the file of the tokenizers library, which decides; ranks_path: the same vocabulary as ranks, for speed.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        self.slow = tokenizer(json_path)
        self.fast = Ordinary(ranks_path, pattern)

    def whole(self, text: str) -> bytes:
        return packed(self.slow.encode(text, add_special_tokens=False).ids)

    def __call__(self, text: str) -> bytes:
        if SPECIAL in text:
            return self.whole(text)
        if text.isascii() or PLAIN.fullmatch(text):
            return packed(self.fast(text))
        return b"".join([packed(self.fast(x)) if PLAIN.fullmatch(x) else self.whole(x) for x in RUNS.findall(text)])


@functools.lru_cache(maxsize=2)
def packed_encoder(json_path: str, ranks_path: str, pattern: str) -> PackedEncoder:
    return PackedEncoder(json_path, ranks_path, pattern)
