"""Token ids of a public byte-level BPE vocabulary, per batch of texts."""

from __future__ import annotations

import base64
import os
import re
import sys
from array import array
from functools import cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Texts with characters from here on, or with a special token's string, take the slower reference path.
_OTHER = re.compile("[ɐ-\U0010ffff]|<\\|endoftext\\|>")
#: Runs without a break longer than this take the reference path too.
_LONG_RUN = re.compile(r"\S{20000}|\s{20000}")
EOS = 2
VOCABULARY = "byte_bpe_50k.json"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@cache
def _reference(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _fast(path: str):
    """The same vocabulary for tiktoken, if its ranks lie beside the file. It gives equal ids at several times the speed."""
    ranks = os.path.splitext(path)[0] + ".tiktoken"
    if not os.path.exists(ranks):
        return None
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def encode(text: str | None, path: str) -> list[int]:
    """The ids that tokenizers gives for the file at path with add_special_tokens=False; null is empty."""
    if not text:
        return []
    fast = _fast(path)
    if fast is None or (not text.isascii() or "<|" in text) and _OTHER.search(text) or len(text) >= 20000 and _LONG_RUN.search(text):
        return _reference(path).encode(text, add_special_tokens=False).ids
    return fast.encode_ordinary(text)


def width(path: str) -> int:
    """Bytes that hold an id of the file at path: 2 up to 65,536 of them, else 4."""
    return 2 if _reference(path).get_vocab_size() <= 1 << 16 else 4


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()
