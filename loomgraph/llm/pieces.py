"""A SentencePiece model's pieces, read once a worker."""

from __future__ import annotations

from functools import lru_cache

SPACE = "▁"


@lru_cache(maxsize=4)
def vocabulary(path: str) -> tuple[list[str], list[float], list[str]]:
    """Piece, score and kind ('normal', 'byte' or 'other') of every id."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    kinds = ["byte" if sp.is_byte(i) else "other" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "normal" for i in range(n)]
    return [sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)], kinds


def public_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
