"""SentencePiece vocabulary (BPE with byte fallback) and where a text may be cut without changing its encoding."""

from __future__ import annotations

import functools
import re

import public_tokenizers
import sentencepiece

SPACE = "▁"
#: The model is a parameter; the vocabulary files stay where the package has them.
MODEL = "piece_bpe_32k.model"


@functools.cache
def processor(model: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))


class Vocabulary:
    """Pieces by id. `plain` has those that match text; `fallback` the ids of the 256 byte pieces."""

    def __init__(self, model: str):
        sp = processor(model)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(len(self.pieces))]
        self.byte_of = {i: int(p[3:5], 16) for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.fallback = {b: i for i, b in self.byte_of.items()}
        self.plain = {p: i for i, p in enumerate(self.pieces) if i not in self.byte_of and not special[i]}
        self.score = {p: sp.get_score(i) for p, i in self.plain.items()}
        self.bigrams = {p[k : k + 2] for p in self.plain for k in range(len(p) - 1)}
        # a text may be cut before every run of spaces if no piece has a space after another character
        self.cut_at_spaces = not any(b == SPACE and a != SPACE for a, b in self.bigrams)


@functools.cache
def vocabulary(model: str) -> Vocabulary:
    return Vocabulary(model)


#: A run of spaces and what follows it up to the next one: the library's encoding of a text is
#: that of these units, one after the other (after the prefix space that the library adds).
UNITS = re.compile(" +[^ ]*")


def units(text: str, vocab: Vocabulary) -> list[str]:
    """The units of a text that isn't empty. Each starts with the space that the library would put
    before it (or, first, with the library's own prefix): without it, it encodes by itself as in the text."""
    text = " " + text.replace(SPACE, " ")  # the library encodes both characters alike
    return UNITS.findall(text) if vocab.cut_at_spaces else [text]
