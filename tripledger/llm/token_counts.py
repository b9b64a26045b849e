"""Token counts from distinct pre-tokens, without materialising ids.

SentencePiece BPE merges neighbouring symbols only into pieces of its vocabulary. No piece holds a space mark
after another character, and none holds a line feed, so a text falls apart, exactly, before each run of space
marks and around each line feed; the model is asked once for each distinct part (``blocks``), and a document's
count is the sum over its own part frequencies.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tripledger.llm.blocks import distinct_word_join, unpacked

SPACE = "▁"


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def check_model(path: str) -> None:
    """The split into parts is exact only for such a vocabulary; any other is refused."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if "\n" in piece or SPACE in piece.lstrip(SPACE):
            raise ValueError(f"{path}: piece {piece!r} spans parts")
    if model.encode("a  b\nc ", out_type=str) != model.encode("a", out_type=str) + model.encode("\n", out_type=str)[:1] + [SPACE + "b", "<0x0A>", "c", SPACE]:
        raise ValueError(f"{path}: its normaliser changes white space")


def splitter():
    """Parts of a text, which starts with the mark that the model puts there: space runs open a part, line feeds stand alone."""
    import re

    parts = re.compile(f"[ {SPACE}]*[^ {SPACE}\n]+|[ {SPACE}]+|\n").findall
    return lambda text: parts(" " + text) if text else []


def counter(content: bytes):
    """content: a model file's."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=content)
    after_line = len(model.encode("\n"))  # the mark and the line feed

    def count(part: str) -> int:
        if part == "\n":
            return after_line - 1
        if part[0] not in f" {SPACE}":  # follows a line feed, which keeps the model from putting a mark before it
            return len(model.encode("\n" + part)) - after_line
        return len(model.encode(part[1:])) if len(part) > 1 else 1  # the model puts the first mark back

    return count


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for every row.

    A null text counts as empty: 0 bytes, 0 tokens. Null and repeated identifiers pass through, a row each.
    An empty input gives an empty result, and other columns play no part.
    """
    path = path or model_path()
    check_model(path)
    with open(path, "rb") as file:  # executors need not have the file
        content = file.read()

    def evaluate():
        count = counter(content)
        return lambda w: np.uint32(count(w.decode())).tobytes()

    def finish(texts, lengths, data) -> pd.DataFrame:
        of_word = np.frombuffer(data, "<u4").astype(np.int64)
        freqs, steps, n_codes = unpacked(texts.freqs), unpacked(texts.codes), np.asarray(texts.n_codes, np.int64)
        ends = np.cumsum(n_codes)
        summed = np.concatenate([[0], np.cumsum(steps)])  # each text's codes are steps from 0
        codes = summed[1:] - np.repeat(summed[ends - n_codes], n_codes)
        upto = np.concatenate([[0], np.cumsum(of_word[codes] * freqs)])
        n = upto[ends] - upto[ends - n_codes]
        ids = pd.array([None if x is None else int(x) for x in texts.ids], dtype="Int64")
        return pd.DataFrame({"doc_id": ids, "n_bytes": np.asarray(texts.n_bytes, np.int64), "n_tokens": n, "over_limit": n > limit})

    schema = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
    return distinct_word_join(docs, id_col, text_col, splitter, evaluate, finish, schema, counted=True)


def op4(spark, sf_dir: str) -> DataFrame:
    from tripledger.llm.common import table

    return token_counts(table(spark, sf_dir, "documents"))
