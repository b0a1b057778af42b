"""Where the public tokenizers' vocabulary files lie."""

from __future__ import annotations

import os


def vocabulary_path(name: str) -> str:
    """``$QUARRY_TOKENIZERS/name``, else the file that the installed package of public ones has."""
    if folder := os.environ.get("QUARRY_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
