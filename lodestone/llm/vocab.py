"""Reading the public tokenizers' vocabulary files. Paths are parameters; nothing is copied or trained."""

from __future__ import annotations

import base64
import os

TOKENIZERS = os.environ.get("LODESTONE_TOKENIZERS", "/opt/tokenizers")
#: The published split pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> id of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def pieces(path: str) -> list[bytes]:
    """The distinct byte strings of a sentencepiece model, sorted: '▁' is a space, <0xNN> the byte itself; control pieces have none."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {bytes([b]) for b in range(256)}
    for i in range(sp.vocab_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
            found.add(sp.id_to_piece(i).replace("▁", " ").encode())
    return sorted(found)
