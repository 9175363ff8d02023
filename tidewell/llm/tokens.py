"""Tokenizers as workers hold them: one of each kind for the life of a worker."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import public_tokenizers
import sentencepiece
import tiktoken

#: The vocabulary's one special token, which is encoded as such where a text has its string.
END_OF_TEXT = "<|endoftext|>"
#: Runs of white space from so many characters on are cut out: the pattern's matcher steps back over a run character by character, and gives up at some hundred thousand.
LONG_RUN = 10_000
_LONG_RUN = re.compile(rf"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{LONG_RUN},}}")


@lru_cache(maxsize=2)
def byte_bpe_array(ranks: str) -> Callable[[str], np.ndarray]:
    """Encodes a text as byte_bpe_50k.json does; the same vocabulary as ranks is several times as fast."""
    with open(ranks, "rb") as f:
        merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    encoding = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={END_OF_TEXT: len(merges)})

    def encode(text: str) -> np.ndarray:
        parts, at = [], 0
        for run in _LONG_RUN.finditer(text):
            # a run's last character goes with what follows, if that is text
            whole = run.end() == len(text) or text.startswith(END_OF_TEXT, run.end())
            end = run.end() - (not whole)
            parts += [encoding.encode_to_numpy(text[at : run.start()], allowed_special="all"), np.array(encoding._encode_single_piece(text[run.start() : end]), np.uint32)]
            at = end
        parts.append(encoding.encode_to_numpy(text[at:], allowed_special="all"))
        return np.concatenate(parts) if len(parts) > 1 else parts[0]

    return encode


def byte_bpe(ranks: str) -> Callable[[str], list[int]]:
    encode = byte_bpe_array(ranks)
    return lambda text: encode(text).tolist()


@lru_cache(maxsize=2)
def sentencepiece_model(path: str) -> Callable[[str], list[int]]:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda text: model.encode(text, num_threads=1)


def marked_pieces(path: str) -> list[str]:
    """The pieces of a sentencepiece vocabulary that begin with the word mark."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [p for p in map(model.id_to_piece, range(model.get_piece_size())) if p.startswith("\u2581")]
