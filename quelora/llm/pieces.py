"""The public SentencePiece vocabulary that language ID and encoding share."""

from __future__ import annotations

import functools
import math

import numpy as np

DEFAULT = "piece_bpe_32k.model"
#: What a byte piece costs beyond the last rank's log-probability: bytes serve only where no other piece fits.
BYTE_COST = 10.0


def model_path(name: str = DEFAULT) -> str:
    """Place of an installed public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Vocabulary:
    """Pieces with the word mark written as a leading space, and Zipf log-probabilities from their ranks.

    The file's scores are merge ranks, not probabilities; a piece of rank r gets -log(r + 1) - log(sum of 1/(k + 1)),
    the usual rank law. Control and unknown symbols are left out."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.ids: dict[str, int] = {}
        self.byte_ids = np.zeros(256, dtype=np.int64)
        #: the bytes that each id stands for
        self.bytes_of = [b""] * self.size
        plain = []
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.bytes_of[i] = bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                text = piece.replace("▁", " ")
                self.bytes_of[i] = text.encode()
                if " " in text.lstrip(" "):
                    raise ValueError("a piece holds a space after its start")
                self.ids[text] = i
                plain.append((-model.get_score(i), i))
        plain.sort()
        total = math.log(sum(1 / (r + 1) for r in range(len(plain))))
        self.logp = np.full(self.size, -math.log(len(plain)) - total - BYTE_COST)
        self.logp[[i for _, i in plain]] = [-math.log(r + 1) - total for r in range(len(plain))]
        self.longest = max(map(len, self.ids))


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)
