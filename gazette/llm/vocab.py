"""Pieces of an existing subword vocabulary file (a parameter; never copied, never trained)."""

from __future__ import annotations

from dataclasses import dataclass

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"                       # the vocabulary's word mark
MARK_BYTES = MARK.encode()


@dataclass(frozen=True)
class Vocabulary:
    """``pieces[i]`` are UTF-8 bytes (b"" for control ids), ``scores[i]`` the file's scores, ``byte_ids[b]`` the
    fallback id of byte ``b``. About 32,000 entries, so it may be shipped to every task."""

    pieces: tuple[bytes, ...]
    scores: tuple[float, ...]
    byte_ids: tuple[int, ...]


def load(path: str = DEFAULT_MODEL) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces, byte_ids = [], [-1] * 256
    for i in range(n):
        if sp.is_byte(i):
            byte_ids[int(sp.id_to_piece(i)[3:5], 16)] = i
            pieces.append(b"")
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            pieces.append(b"")
        else:
            pieces.append(sp.id_to_piece(i).encode())
    if min(byte_ids) < 0:
        raise ValueError("the vocabulary has no byte fallback")
    return Vocabulary(tuple(pieces), tuple(float(sp.get_score(i)) for i in range(n)), tuple(byte_ids))
