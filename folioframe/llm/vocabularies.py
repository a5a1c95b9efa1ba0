"""Places of tokenizer files; operators take a path, this gives the default ones."""

from __future__ import annotations


def tokenizer_path(name: str) -> str:
    """Path of a public tokenizer file that is installed on every machine of the cluster."""
    import public_tokenizers

    return public_tokenizers.path(name)
