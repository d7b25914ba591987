"""Token counts without token ids, and the tokenizer that other operators share.

``token_counts``: a block of documents is split into pre-tokens; the block
keeps, for each document, the distinct pre-tokens and their frequencies as
numbers into the block's list of distinct pre-tokens.  The lists are dealt out
by a hash of the pre-token, so that all blocks' copies of a pre-token meet and
its pieces are counted once; the counts go back to their blocks, where they
are joined to the documents' frequencies and summed.  A block's list travels
as one packed row for each partition: what is shuffled is a few bytes for each
distinct pre-token of a block, and no key can be hot.

The pre-token pattern runs on Python's ``re`` where a text has only characters
on which all Unicode tables agree; any other text goes through the tokenizer
library's own splitter, so that results equal the library's everywhere.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import materialize

VOCABULARY = "byte_bpe_50k"
SPECIAL = "<|endoftext|>"     # the vocabulary's added token; the library finds it in texts
SPECIAL_ID = 50256
BLOCK_CHARS = 6_000_000       # characters of text in a block, about
BLOCK_DOCS = 5_000
LIMIT = 1024

#: characters that every Unicode version and regex engine sorts alike
PLAIN = re.compile("[^\x00-\x1b\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧‰-⁞]")
#: the byte-level pre-token pattern, for such texts
PRE_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def library(path: str | None = None):
    """The tokenizers library's tokenizer of the vocabulary, one thread."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path or vocabulary_path(f"{VOCABULARY}.json"))


@lru_cache(maxsize=2)
def fast_encoder(path: str | None = None):
    """The same vocabulary as ranks, several times as fast."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path or vocabulary_path(f"{VOCABULARY}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(VOCABULARY, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={SPECIAL: SPECIAL_ID})


def encode(text: str | None) -> np.ndarray:
    """The ids that the tokenizers library gives (add_special_tokens=False)."""
    if not text:
        return np.zeros(0, dtype=np.uint32)
    if PLAIN.search(text):
        return np.array(library().encode(text, add_special_tokens=False).ids, dtype=np.uint32)
    return fast_encoder().encode_to_numpy(text, allowed_special="all").astype(np.uint32)


def pre_tokens(text: str) -> list[str]:
    """The text's pre-tokens; an added token in it is one of them."""
    out: list[str] = []
    for k, part in enumerate(text.split(SPECIAL)):
        if k:
            out.append(SPECIAL)
        if PLAIN.search(part):
            split = library().pre_tokenizer.pre_tokenize_str(part)
            out += [part[a:b] for _, (a, b) in split]
        else:
            out += PRE_TOKEN.findall(part)
    return out


def count_pieces(words: list[str]) -> np.ndarray:
    """How many tokens each pre-token is."""
    got = library().encode_batch_fast(words, add_special_tokens=False)
    return np.fromiter((len(e) for e in got), dtype=np.int32, count=len(words))


def _pack(words: list[str]) -> bytes:
    return zlib.compress(json.dumps(words, ensure_ascii=False).encode("utf-8", "surrogatepass"), 1)


def _unpack(data: bytes) -> list[str]:
    return json.loads(zlib.decompress(data).decode("utf-8", "surrogatepass"))


def _pack_numbers(parts: list[np.ndarray]) -> bytes:
    """Numbers compressed byte plane by byte plane: most are small."""
    flat = np.concatenate([np.zeros(0, dtype="<i4"), *parts]).astype("<i4")
    return zlib.compress(flat.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpack_numbers(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


BLOCK_SCHEMA = ("block string, doc_ids array<long>, n_bytes array<long>, ends array<int>, words binary, "
                "freqs binary, parts array<struct<part: int, words: binary>>")


def _blocks(batches, n_parts: int):
    """Blocks of documents, their frequencies, and their words by partition."""
    from pyspark import TaskContext

    task, number = TaskContext.get().partitionId(), 0
    ids, counts, sizes, chars = [], [], [], 0

    def block():
        order: dict[str, int] = {}
        words, freqs, ends = [], [], []
        for c in counts:
            words.append(np.array([order.setdefault(w, len(order)) for w in c], dtype=np.int64))
            freqs.append(np.fromiter(c.values(), dtype=np.int32, count=len(c)))
            ends.append((ends[-1] if ends else 0) + len(c))
        # the block's words in order of their partition, and within it of first use
        hashed = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in order), dtype=np.int64, count=len(order)) % n_parts
        place = np.argsort(hashed, kind="stable")
        rank = np.empty(len(place), dtype=np.int32)
        rank[place] = np.arange(len(place), dtype=np.int32)
        for k, own in enumerate(words):  # each document's numbers in ascending order, as differences
            own = rank[own]
            by_rank = np.argsort(own)
            words[k], freqs[k] = np.diff(own[by_rank], prepend=np.int32(0)), freqs[k][by_rank]
        listed = list(order)
        cuts = np.searchsorted(hashed[place], np.arange(n_parts + 1))
        parts = [{"part": p, "words": _pack([listed[j] for j in place[a:b]])}
                 for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if a < b]
        return pd.DataFrame([{"block": f"{task}-{number}", "doc_ids": list(ids), "n_bytes": list(sizes), "ends": ends,
                              "words": _pack_numbers(words), "freqs": _pack_numbers(freqs), "parts": parts}])

    for pdf in batches:
        for i, text in zip(pdf["i"], pdf["t"]):
            text = text or ""
            ids.append(None if pd.isna(i) else int(i))
            sizes.append(len(text.encode("utf-8", "surrogatepass")))
            counts.append(Counter(pre_tokens(text)))
            chars += len(text)
            if chars >= BLOCK_CHARS or len(ids) >= BLOCK_DOCS:
                yield block()
                number += 1
                ids, counts, sizes, chars = [], [], [], 0
    if ids:
        yield block()


def _count_parts(batches):
    """Piece counts of packed words; a pre-token comes to one task only, which counts it once."""
    known: dict[str, int] = {}
    for pdf in batches:
        out = []
        for packed in pdf["words"]:
            words = _unpack(packed)
            new = [w for w in words if w not in known]
            known.update(zip(new, count_pieces(new).tolist()))
            out.append(zlib.compress(np.array([known[w] for w in words], dtype=np.int32).tobytes(), 1))
        yield pd.DataFrame({"block": pdf["block"], "part": pdf["part"], "counts": out})


def _sum_blocks(batches):
    """Join a block's piece counts to its documents' frequencies and sum."""
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            got = sorted(r.counts, key=lambda x: x["part"]) if r.counts is not None else []
            pieces = np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(zlib.decompress(x["counts"]), np.int32) for x in got)])
            ends = np.asarray(r.ends, dtype=np.int64)
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            steps = np.cumsum(_unpack_numbers(r.words).astype(np.int64))  # differences start anew in each document
            words = steps - np.repeat(np.concatenate([[0], steps])[starts], ends - starts)
            running = np.concatenate([[0], np.cumsum(pieces[words].astype(np.int64) * _unpack_numbers(r.freqs))])
            yield pd.DataFrame({"doc_id": pd.array(list(r.doc_ids), dtype="Int64"), "n_bytes": list(r.n_bytes),
                                "n_tokens": running[ends] - running[starts]})


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens of every whole text (null: empty, no tokens)."""
    spark: SparkSession = docs.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).alias("t"))
    blocks = materialize(rows.mapInPandas(lambda it: _blocks(it, n_parts), BLOCK_SCHEMA), "token-blocks")
    parts = blocks.select("block", F.explode("parts").alias("p")).select("block", "p.part", "p.words")
    counted = parts.repartition(n_parts, "part").mapInPandas(_count_parts, "block string, part int, counts binary")
    back = counted.groupBy("block").agg(F.collect_list(F.struct("part", "counts")).alias("counts"))
    # at most n_parts rows a block, which its size bounds
    joined = blocks.select("block", "doc_ids", "n_bytes", "ends", "words", "freqs").join(back, "block", "left")
    return joined.mapInPandas(_sum_blocks, "doc_id long, n_bytes long, n_tokens long")


def token_table(docs: DataFrame) -> DataFrame:
    return token_counts(docs).withColumn("over_limit", F.col("n_tokens") > LIMIT)
