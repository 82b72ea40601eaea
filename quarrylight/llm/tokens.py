"""The byte-level BPE of ``byte_bpe_50k``, as ids.

Ids are those of the ``tokenizers`` library on ``byte_bpe_50k.json`` with
``add_special_tokens=False``: the literal of the file's added token in a text is
that token. The vocabulary exists in a second form, as ranks for ``tiktoken``,
which takes a seventh of the time and gives equal ids (a test compares them) but
for one case: its pattern matcher recurses over runs of white space and fails at
about a million. Texts with such a run of ``LONG`` or more go to ``tokenizers``.
Files are found by path and never copied."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np

#: The id that ends a document; the file's added token and its id.
END = 1
ADDED = {"<|endoftext|>": 50256}
LONG = 100_000
_BLANK_RUN = re.compile(r"\s{%d}" % LONG)


@lru_cache(maxsize=4)
def _encoding(path: str | None):
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED)


@lru_cache(maxsize=1)
def _plain():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def _ids(text: str, path: str | None) -> list[int]:
    if len(text) >= LONG and _BLANK_RUN.search(text):
        return _plain().encode(text, add_special_tokens=False).ids
    return _encoding(path).encode(text, allowed_special="all")


def encode(text: str, path: str | None = None) -> np.ndarray:
    return np.array(_ids(text, path), np.uint32)


def count(text: str, path: str | None = None) -> int:
    return len(_ids(text, path))


@lru_cache(maxsize=4)
def sentence_ends(path: str | None = None) -> np.ndarray:
    """For each id, whether its bytes end a sentence or hold a line end."""
    encoding = _encoding(path)
    out = np.zeros(encoding.n_vocab, bool)
    for token in encoding.token_byte_values():
        out[encoding.encode_single_token(token)] = token.rstrip(b"\"')]")[-1:] in (b".", b"!", b"?") or b"\n" in token
    out[list(ADDED.values())] = True
    return out
