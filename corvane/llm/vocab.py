"""Where the public vocabulary files are; they are read in place and never copied."""

from __future__ import annotations

import os


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """The place of a vocabulary file: in ``folder``, or else where the public_tokenizers package has it."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
