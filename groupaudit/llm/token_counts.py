"""Token counts with a whole-token shortcut.

Byte-level BPE first cuts a text into pre-tokens.  Most of them are words that the vocabulary holds
whole.  ``whole_tokens`` proves once, on the driver, which vocabulary strings the library encodes
alone as that one token; such pre-tokens count 1 without any merging.  Only the others are merged,
by the library, and a worker remembers their counts.

The shortcut cuts pre-tokens with the published pattern.  It is used for texts made of characters
whose classes no Unicode version disputes; a text with any other character, and every tokenizer that
is not plain byte-level BPE, goes to the library whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from typing import TYPE_CHECKING

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groupaudit.llm.common import small_batches

if TYPE_CHECKING:
    import pandas as pd

# fixed value: the published pre-token pattern of byte-level BPE
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DISPUTED = regex.compile(r"[^\t\n\r\x20-\x7e\xa0-ɏ‐-‧€]")
MEMORY_PRE_TOKENS = 1_000_000  # remembered counts of one worker; beyond it the memory starts anew
_WORKER: dict[str, tuple] = {}


def _is_plain_byte_level(path: str) -> bool:
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    return (
        pre.get("type") == "ByteLevel"
        and bool(pre.get("use_regex"))
        and not pre.get("add_prefix_space")
        and spec.get("normalizer") is None
        and model["type"] == "BPE"
        and not model.get("dropout")
        and all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in spec["added_tokens"])
    )


def _library(path: str):
    """Counts of whole texts as the file's own library gives them."""
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in sp.encode(list(texts), num_threads=1)]
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return lambda texts: [len(e) for e in tok.encode_batch_fast(list(texts), add_special_tokens=False)]


def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings that are one pre-token and that the library encodes alone as one token.

    At most as many as the vocabulary has entries.
    """
    if not _is_plain_byte_level(path):
        return frozenset()
    from tokenizers import Tokenizer, decoders

    tok, to_text = Tokenizer.from_file(path), decoders.ByteLevel()
    pattern = regex.compile(PRE_TOKEN)
    texts = {s for token in tok.get_vocab() if "�" not in (s := to_text.decode([token])) and s}
    texts = [s for s in texts if not DISPUTED.search(s) and pattern.fullmatch(s) and len(pattern.findall(s)) == 1]
    return frozenset(s for s, e in zip(texts, tok.encode_batch_fast(texts, add_special_tokens=False)) if len(e.ids) == 1)


class _Counter(dict):
    """pre-token -> number of tokens; whole tokens are there from the start."""

    def __init__(self, whole: frozenset[str], library):
        super().__init__(dict.fromkeys(whole, 1))
        self.merged: dict[str, int] = {}
        self.library = library

    def __missing__(self, piece: str) -> int:
        n = self.merged.get(piece)
        if n is None:
            if len(self.merged) >= MEMORY_PRE_TOKENS:
                self.merged.clear()
            self.merged[piece] = n = self.library([piece])[0]
        return n


def _counter(path: str, whole: frozenset[str]) -> tuple:
    if path not in _WORKER:
        special = []
        if path.endswith(".json"):
            with open(path, encoding="utf-8") as f:
                special = [t["content"] for t in json.load(f).get("added_tokens") or []]
        cut = regex.compile("|".join(map(regex.escape, special))) if special else None
        library = _library(path)
        _WORKER[path] = (_Counter(whole, library), library, cut, regex.compile(PRE_TOKEN).findall)
    return _WORKER[path]


def count_text(text: str, path: str, whole: frozenset[str]) -> int:
    counter, library, cut, pre_tokens = _counter(path, whole)
    if not whole or DISPUTED.search(text):
        return library([text])[0]
    parts = [text] if cut is None or "<" not in text else cut.split(text)
    return len(parts) - 1 + sum(sum(map(counter.__getitem__, pre_tokens(p))) for p in parts)


def token_counts(
    docs: DataFrame, *, path: str, limit: int = 1024, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row (doc_id, n_bytes, n_tokens, over_limit) per input row, whole texts, no shuffle.

    A null text counts as empty (0 bytes, 0 tokens); null ids and repeated rows are kept as they
    are; other columns of ``docs`` are ignored.  Special strings inside texts are one token each, as
    the library treats them by default.
    """
    small_batches(docs.sparkSession)
    proven = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = proven.value
        for pdf in batches:
            texts = [t or "" for t in pdf.pop("_text")]
            yield pdf.assign(
                n_bytes=[len(t.encode("utf-8")) for t in texts], n_tokens=[count_text(t, path, whole) for t in texts]
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    counted = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")).mapInPandas(
        count, f"doc_id {kind}, n_bytes long, n_tokens long"
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
