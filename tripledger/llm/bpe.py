"""Byte-level BPE encoding and decoding over distinct words.

Texts are split by the vocabulary's pattern, keeping positions; each distinct pre-token is encoded once in the
whole corpus (``blocks``), its ids are joined back and every text's ids are put together by position. Decoding
looks the ids up in the table of token bytes, which has one entry for each rank.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tripledger.llm.blocks import distinct_word_join, gathered, unpacked


def vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[str, str]:
    """Path and pattern."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def ranks(content: bytes) -> dict[bytes, int]:
    """content: a rank file's lines."""
    import base64

    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}


@functools.lru_cache(2)
def token_table(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' bytes one after the other, and where each starts; made once for each worker."""
    table = ranks(content)
    tokens = [b""] * (max(table.values()) + 1)
    for token, rank in table.items():
        tokens[rank] = token
    starts = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)
    return np.frombuffer(b"".join(tokens), np.uint8), starts


def bpe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None, outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and those of ids (array<int>) and decoded (binary) that ``outputs`` names.

    A null text counts as empty and has no ids. Null and repeated identifiers pass through, a row each; an empty
    input gives an empty result; other columns play no part.
    """
    own_path, own_pattern = vocabulary()
    path, pattern = path or own_path, pattern or own_pattern
    with open(path, "rb") as file:  # executors need not have the file
        content = file.read()

    def split():
        import regex

        return regex.compile(pattern).findall

    def evaluate():
        import tiktoken

        one = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks(content), special_tokens={})._encode_single_piece
        return lambda w: np.asarray(one(w), "<u4").tobytes()

    def finish(texts, lengths, data) -> pd.DataFrame:
        ids = np.frombuffer(data, "<u4")
        starts = np.concatenate([[0], np.cumsum(lengths) // 4])
        codes = unpacked(texts.codes)
        bytes_of, byte_starts = token_table(content)
        rows, at = [], 0
        for key, n in zip(texts.ids, texts.n_codes):
            own = gathered(ids, starts, codes[at : at + n])
            at += n
            decoded = gathered(bytes_of, byte_starts, own.astype(np.int64)).tobytes()
            row = (None if key is None else int(key), len(own), hashlib.sha256(own.tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest())
            rows.append((*row, *({"ids": own.astype(np.int32), "decoded": decoded}[c] for c in outputs)))
        out = pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *outputs])
        return out.assign(doc_id=pd.array(out.doc_id.tolist(), dtype="Int64"))

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + "".join(f", {c} {'array<int>' if c == 'ids' else 'binary'}" for c in outputs)
    return distinct_word_join(docs, id_col, text_col, split, evaluate, finish, schema, counted=False)


def op9(spark, sf_dir: str) -> DataFrame:
    from tripledger.llm.common import table

    return bpe(table(spark, sf_dir, "documents"), outputs=())
