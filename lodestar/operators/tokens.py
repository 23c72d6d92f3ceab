"""Token-array inputs of models: layouts, targets, tokenizers."""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: Layouts as the parts between separators: P prefix, D docstring, M method, G signature. The first has an empty last part.
LAYOUTS = {"tc_only": "P", "tc_doc": "PD", "tc_mutsig": "PG", "tc_mut": "PM", "tc_mut_doc": "PDM", "tc_mutsig_doc": "PDG"}


def ids(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<int>"))


def train_layout(layout: str, parts: dict[str, Column], sep: int) -> Column:
    """The parts joined by the separator; an empty part keeps its separator."""
    s = F.array(F.lit(sep))
    names = LAYOUTS[layout]
    if len(names) == 1:
        return F.concat(ids(parts["P"]), s)
    out = [ids(parts["P"])]
    for n in names[1:]:
        out += [s, ids(parts[n])]
    return F.concat(*out)


def serve_layout(prefix: Column, method: Column, doc: Column, sep: int) -> Column:
    """As serving builds it: a missing docstring goes together with its separator."""
    s = F.array(F.lit(sep))
    return F.concat(ids(prefix), F.when(F.size(ids(doc)) > 0, F.concat(s, doc)).otherwise(F.array().cast("array<int>")), s, ids(method))


def target(output: Column, eos: int) -> Column:
    return F.concat(ids(output), F.array(F.lit(eos)))


def fallback_prefix(prefix: Column, layout: str, sep: int) -> Column:
    """What stands in for an input that is too long: with the separator for tc_mut, without it for tc_mut_doc."""
    return F.concat(ids(prefix), F.array(F.lit(sep))) if layout == "tc_mut" else ids(prefix)


def separator_id(sep: int | None, model: str, eos: int) -> int:
    """The model's own separator; 2 for PolyCoder, which has none; else the end id."""
    return sep if sep is not None else 2 if "polycoder" in model.lower() else eos


class Tokenizer(Protocol):
    def encode(self, text: str) -> list[int]: ...

    def decode(self, ids: list[int]) -> str: ...


class CodePointTokenizer:
    """A deterministic stand-in whose decode(encode(x)) is x."""

    def encode(self, text: str) -> list[int]:
        return [ord(c) + 3 for c in text]

    def decode(self, ids: list[int]) -> str:
        return "".join(chr(i - 3) for i in ids if i >= 3)


class FileTokenizer:
    """A tokenizer of an installed library from its file: .json (tokenizers), .model (sentencepiece) or .tiktoken. Loaded
    where it is first used, once a process, so that only the path travels. Ids are without special tokens; decoding skips
    them. pattern: what a .tiktoken file's texts are cut by."""

    loaded: dict[tuple, tuple] = {}

    def __init__(self, path: str, pattern: str | None = None):
        self.path, self.pattern = path, pattern

    def _library(self) -> tuple:
        key = (self.path, self.pattern)
        if key not in self.loaded:
            if self.path.endswith(".json"):
                from tokenizers import Tokenizer as Library

                t = Library.from_file(self.path)
                self.loaded[key] = (lambda x: t.encode(x, add_special_tokens=False).ids, lambda i: t.decode(i, skip_special_tokens=True))
            elif self.path.endswith(".model"):
                from sentencepiece import SentencePieceProcessor

                p = SentencePieceProcessor(model_file=self.path)
                self.loaded[key] = (p.encode, p.decode)
            else:
                import base64

                import tiktoken

                with open(self.path, "rb") as f:
                    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
                e = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
                self.loaded[key] = (e.encode_ordinary, e.decode)
        return self.loaded[key]

    def encode(self, text: str) -> list[int]:
        return self._library()[0](text)

    def decode(self, ids: list[int]) -> str:
        return self._library()[1]([int(i) for i in ids])


def encode(df: DataFrame, column: str, out: str, tokenizer: Tokenizer, normalise: bool = False) -> DataFrame:
    """Token ids of a text column (null: empty), by Arrow batches; normalise: encode, decode and encode again."""
    ship(df.sparkSession)

    @F.pandas_udf("array<int>")
    def run(s: pd.Series) -> pd.Series:
        first = s.fillna("").map(tokenizer.encode)
        return first.map(tokenizer.decode).map(tokenizer.encode) if normalise else first

    return df.withColumn(out, run(column))


def decode(df: DataFrame, column: str, out: str, tokenizer: Tokenizer) -> DataFrame:
    ship(df.sparkSession)
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: tokenizer.decode(list(x)) if x is not None else None)

    return df.withColumn(out, run(column))
