"""Token counts by a separator scan over flat token files.

A token file is one stream of 16-bit ids, documents ended by an end-of-document
id, cut into blocks of equal size without regard to documents; no index says
where a document starts.  Each block is searched for separators at once.  A
prefix scan over the block summaries (one row per block: size, separators, last
separator) gives every block its place in the stream, the documents ended
before it, and where the document that is open at its start began.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import load_ranks
from .common import materialize

#: Tokens in a block; documents longer than a block span several.
BLOCK_TOKENS = 1 << 18
#: Texts given to the tokenizer at once.
TEXTS = 256

FILE_SCHEMA = "file string, block long, tokens binary, ids array<string>"


def write_token_files(
    docs: DataFrame, ranks_path: str, pattern: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
    block_tokens: int | None = None,
) -> DataFrame:
    """Documents -> (file, block, tokens, ids), a table in the shared folder.

    A task writes one file.  ``ids`` lists, in stream order, the identifiers of
    the documents added since the block before; it holds no lengths.
    """
    size = block_tokens or BLOCK_TOKENS
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})
        if max(ranks.value.values()) >= end_id or end_id >= 1 << 16:
            raise ValueError("the end-of-document id must follow the vocabulary and fit 16 bits")
        file, block = f"file-{TaskContext.get().partitionId():08d}", 0
        open_parts: list[np.ndarray] = []
        held, ids = 0, []
        for batch in batches:
            names, bodies = batch["id"].tolist(), batch["body"].tolist()
            for at in range(0, len(names), TEXTS):
                for name, found in zip(
                    names[at : at + TEXTS], map(codec.encode_ordinary, bodies[at : at + TEXTS]), strict=True
                ):
                    open_parts.append(np.array([*found, end_id], "<u2"))
                    held += len(found) + 1
                    ids.append(name)
                    if held >= size:
                        stream = np.concatenate(open_parts)
                        full = held // size
                        for k in range(full):
                            cut = stream[k * size : (k + 1) * size].tobytes()
                            yield pd.DataFrame({"file": [file], "block": [block], "tokens": [cut], "ids": [ids]})
                            block, ids = block + 1, []
                        open_parts, held = [stream[full * size :]], held - full * size
        if held or ids:
            cut = np.concatenate(open_parts).tobytes()
            yield pd.DataFrame({"file": [file], "block": [block], "tokens": [cut], "ids": [ids]})

    source = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    return materialize(source.mapInPandas(write, FILE_SCHEMA), "token-files")


def scan_blocks(files: DataFrame, end_id: int) -> DataFrame:
    """Per block: its size, and the places of its separators."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes, ends = [], []
            for raw in batch["tokens"]:
                tokens = np.frombuffer(raw, "<u2")
                sizes.append(len(tokens))
                ends.append(np.flatnonzero(tokens == end_id))
            yield pd.DataFrame({"file": batch["file"], "block": batch["block"], "size": sizes, "ends": ends})

    blocks = files.select("file", "block", "tokens")
    return blocks.mapInPandas(scan, "file string, block long, size long, ends array<long>")


def count_documents(files: DataFrame, end_id: int) -> DataFrame:
    """(file, ordinal, n_tokens) of every document, stitched across blocks."""
    blocks = materialize(scan_blocks(files, end_id), "separators")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = F.when(F.size("ends") > 0, F.col("start") + F.element_at("ends", -1))
    summary = blocks.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
    summary = (
        summary.withColumn("done", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)))
        .withColumn("last", last)
        .withColumn("opened", F.coalesce(F.max("last").over(before), F.lit(-1)))
    )
    placed = summary.select("file", "done", "start", "opened", "ends", F.posexplode("ends").alias("k", "end"))
    previous = F.when(F.col("k") == 0, F.col("opened")).otherwise(F.col("start") + F.get("ends", F.col("k") - 1))
    return placed.select(
        "file", (F.col("done") + F.col("k")).alias("ordinal"), (F.col("start") + F.col("end") - previous - 1).alias("n_tokens")
    )


def document_names(files: DataFrame) -> DataFrame:
    """(file, ordinal, id): the manifest's identifiers, numbered in stream order."""
    lists = files.select("file", "block", "ids")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = lists.select("file", "block", F.size("ids").alias("n")).withColumn(
        "first", F.coalesce(F.sum("n").over(before), F.lit(0))
    )
    return (
        lists.select("file", "block", F.posexplode("ids").alias("k", "id"))
        .join(sizes, ["file", "block"])
        .select("file", (F.col("first") + F.col("k")).alias("ordinal"), "id")
    )


def token_counts(docs: DataFrame, ranks_path: str, pattern: str, end_id: int, id_col: str = "doc_id") -> DataFrame:
    """(id_col, n_tokens): a row per row, counted from flat token files alone.

    A null or empty text counts no tokens.  Null and repeated identifiers pass
    through.  Other columns are ignored; an empty table writes no file.
    """
    files = write_token_files(docs, ranks_path, pattern, end_id, id_col)
    id_type = dict(docs.select(id_col).dtypes)[id_col]
    counted = count_documents(files, end_id).join(document_names(files), ["file", "ordinal"])
    return counted.select(F.col("id").cast(id_type).alias(id_col), "n_tokens")
