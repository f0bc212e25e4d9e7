"""Packing documents into sequences of a fixed length: shortest-pack-first over the histogram of lengths."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import long_list, many_buckets, ranked, small_batches, stored

#: Id put after each document.
END = 0
#: Rows of the sums by length and bucket up to which these are broadcast.
BROADCAST_ROWS = 262_144
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Fixed value: how byte-level BPE cuts a text before merging.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Blanks in a row above which the fast library's pattern matcher runs out of stack; such texts go to the other.
LONG_GAP = 65_536


def _has_long_gap(text: str) -> bool:
    return len(text) >= LONG_GAP and any(m.end() - m.start() >= LONG_GAP for m in re.finditer(r"\s+", text))


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """text -> ids of the tokenizer in a tokenizers JSON file, special tokens recognised, none added.

    Where the file holds plain byte-level BPE whose ids are in order of merging, its vocabulary runs in tiktoken, which gives the
    same ids in a fifth of the time; any other file runs in tokenizers, and so does any text with LONG_GAP blanks in a row.
    """
    from tokenizers import Tokenizer

    whole: list[Tokenizer] = []

    def plainly(text: str) -> np.ndarray:
        if not whole:
            whole.append(Tokenizer.from_file(path))
        return np.array(whole[0].encode(text, add_special_tokens=False).ids, dtype="u4")

    spec = json.loads(Path(path).read_text())
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    vocabulary = {k: v for k, v in model["vocab"].items()} if isinstance(model.get("vocab"), dict) else {}
    added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    plain = {k: v for k, v in vocabulary.items() if k not in added}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges") or []]
    fast = (
        model.get("type") in (None, "BPE") and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space", True) and cut.get("use_regex", True) and not spec.get("normalizer")
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        and [plain.get(a + b) for a, b in merges] == list(range(256, 256 + len(merges))) and len(plain) == 256 + len(merges)
        and not any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in spec.get("added_tokens", []))
    )
    if not fast:
        return plainly
    import tiktoken

    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
    ranks = {bytes(byte_of[c] for c in k): v for k, v in plain.items()}
    coding = tiktoken.Encoding("file", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens=added)
    return lambda text: plainly(text) if _has_long_gap(text) else coding.encode_to_numpy(text, allowed_special="all")


def pieces(docs: DataFrame, tokenizer_path: str, *, width: int = 1024, with_ids: bool = False) -> DataFrame:
    """Cut every document's ids (END last) into pieces of `width`, the last one shorter: doc_id, start, length, ids_crc32, doc_tokens, and ids if asked.

    tokenizer_path must exist on every executor. A null or empty text is one piece of the end id alone; a text of any length is coded whole; repeated
    rows give pieces each; an empty table gives none. Extra columns are not read.
    """
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                doc_ids, texts = part.column(0), part.column(1).to_pylist()
                row, start, length, crc, total, ids = [], [], [], [], [], []
                for k, text in enumerate(texts):
                    coded = np.append(encode(text or ""), END).astype("<u4")
                    for begin in range(0, len(coded), width):
                        piece = coded[begin : begin + width]
                        row.append(k)
                        start.append(begin)
                        length.append(len(piece))
                        crc.append(zlib.crc32(piece))
                        total.append(len(coded))
                        if with_ids:
                            ids.append(piece.astype("int32"))
                columns = [doc_ids.take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    columns, names = [*columns, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, schema)


def packing_patterns(histogram: dict[int, int], width: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, longest first) with the number of sequences each fills.

    Lengths are placed longest first. Each goes to the pattern with the least in it so far (most room) that it fits;
    as many of the pattern's sequences take one as there are of the length, and the rest of the pattern stays for more. What no
    pattern has room for opens sequences of its own. Patterns that fill up leave the search. There are at most
    `width` lengths, so this does not grow with the documents.
    """
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left > 0:
            fits = max((r for r in room if room[r]), default=-1)
            if fits < length:
                room.setdefault(width - length, []).append(((length,), left))
                break
            pattern, n = room[fits].pop()
            used = min(n, left)
            room.setdefault(fits - length, []).append(((*pattern, length), used))
            if n > used:
                room[fits].append((pattern, n - used))
            left -= used
    return [x for r in sorted(room) for x in room[r]]


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """For each length and pattern: ranks [first, first + many * count) of that length, sequences from `sequence`, offsets from `offset`."""
    rows, sequence, rank = [], 0, {}
    for pattern, count in patterns:
        offset = 0
        for length in dict.fromkeys(pattern):
            many = pattern.count(length)
            rows.append((length, rank.get(length, 0), many, sequence, offset))
            rank[length] = rank.get(length, 0) + many * count
            offset += many * length
        sequence += count
    return pd.DataFrame(rows, columns=["length", "first", "many", "sequence", "offset"], dtype="int64")


def pack(cut: DataFrame, *, width: int = 1024) -> DataFrame:
    """Add sequence_id and offset to stored pieces. Only the histogram, of `width` lengths at most, goes to the driver, and the patterns back.

    A piece's rank among those of its length picks its place. Ranks follow a hash of doc_id, start and ids, so reruns agree;
    repeated rows take a place each; no pieces give no sequences. Columns besides length stay as they are.
    """
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = _slots(packing_patterns(histogram, width)).sort_values(["length", "first"], ignore_index=True)
    # one number for (length, rank), so that one search finds the slot
    base = 1 << 48
    starts = (slots["length"] * base + slots["first"]).to_numpy()
    many, sequence, offset, first = (slots[k].to_numpy() for k in ("many", "sequence", "offset", "first"))
    # lengths of many pieces (most are whole ones) have as many buckets as keep each at the same size
    buckets = [many_buckets(histogram.get(k, 0)) for k in range(width + 1)]
    of = F.get(long_list(buckets), F.col("length").cast("int"))
    hashed = cut.withColumn("_u", F.shiftrightunsigned(F.xxhash64("doc_id", "start", "ids_crc32"), 11) / float(2**53))
    with_rank = ranked(hashed, ["length"], ["_u", "doc_id", "start", "ids_crc32"], F.floor(F.col("_u") * of), "_rank", few=sum(buckets) <= BROADCAST_ROWS)

    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        length, rank = length.to_numpy(), rank.to_numpy()
        at = np.searchsorted(starts, length * base + rank, side="right") - 1
        within = rank - first[at]
        return pd.DataFrame({"sequence_id": sequence[at] + within // many[at], "offset": offset[at] + within % many[at] * length})

    placed = F.pandas_udf(place, "sequence_id long, offset long")
    return with_rank.withColumn("_at", placed("length", "_rank")).select(*cut.columns, F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, *, width: int = 1024, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequences. Each document is tokenized once; the pieces are written to the shared folder, and shuffled once to be ranked."""
    with small_batches(docs.sparkSession):
        cut = stored(pieces(docs, tokenizer_path, width=width, with_ids=with_ids), "pieces")
    return pack(cut, width=width)
