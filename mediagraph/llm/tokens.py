"""Byte-level BPE with the public vocabulary files: building an encoder, and its pattern."""

from __future__ import annotations

import base64
import json

from mediagraph.llm.words import in_worker

from pyspark.sql import SparkSession


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies in JSON write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def rank_file(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def vocabulary_file(path: str) -> dict[bytes, int] | None:
    """Ranks of a byte-level BPE in a tokenizers file, or None if its merges don't follow its ids (then only that library encodes it)."""
    with open(path, encoding="utf-8") as text:
        told = json.load(text)
    model, before, letters = told["model"], told.get("pre_tokenizer") or {}, byte_letters()
    special = {x["content"] for x in told.get("added_tokens", [])}
    if model.get("type", "BPE") != "BPE" or told.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or model.get("dropout") or model.get("ignore_merges"):
        return None
    merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    ids = [model["vocab"][m] for m in merges]
    if ids != sorted(ids) or any(len(t) == 1 and i > min(ids, default=i) for t, i in model["vocab"].items() if t not in special):
        return None
    return {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in special}


def ranks_of(path: str) -> dict[bytes, int] | None:
    return rank_file(path) if path.endswith(".tiktoken") else vocabulary_file(path)


def encoder(path: str, pattern: str):
    """A tiktoken encoder over a vocabulary file, with no special tokens; one per worker process."""
    def make():
        import tiktoken

        ranks = ranks_of(path)
        return None if ranks is None else tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    return in_worker(f"encoder {path}", make)
