"""Token counts per document from counts per distinct pre-token, without ids per document."""

from __future__ import annotations

import json
import os
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm.base import row_numbers
from dialoom.llm.patterns import Pattern

# Fixed value: the pre-token pattern of the vocabulary file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"

#: A task's memory: characters of a block of documents, and sums kept before they are passed on.
BLOCK_CHARS = 8_000_000
SUMS = 1_000_000
LISTS = "pretoken string, block long, postings binary"
SUMMED = "block long, documents binary, sums binary"
_LISTS = pa.schema([("pretoken", pa.string()), ("block", pa.int64()), ("postings", pa.binary())])
_SUMMED = pa.schema([("block", pa.int64()), ("documents", pa.binary()), ("sums", pa.binary())])


def _load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _frequencies(path: str):
    """Pre-token frequencies of documents, as posting lists per block of documents.

    A row holds a pre-token, the row number of the block's first document, and pairs (document's
    place in the block, times). A row without pre-token holds (doc_id, bytes) of every document.
    """

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _load(path)
        specials = sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()),
                          key=len, reverse=True)
        special = regex.compile("|".join(map(regex.escape, specials)) or r"(?!)")
        normal, pattern = tokenizer.normalizer, Pattern(PATTERN)
        numbers = row_numbers()
        postings: dict[str, list[int]] = defaultdict(list)
        documents: list[tuple] = []
        chars, first = 0, 0

        def block() -> pa.RecordBatch:
            packed = [np.array(pairs, "<i4").tobytes() for pairs in postings.values()]
            packed.append(json.dumps(documents).encode())
            return pa.RecordBatch.from_arrays(
                [pa.array([*postings, None], pa.string()), pa.array([first] * len(packed), pa.int64()),
                 pa.array(packed, pa.binary())], schema=_LISTS)

        for batch in source:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                text = text or ""
                number = next(numbers)
                if not documents:
                    first = number
                documents.append((doc_id, len(text.encode())))
                counts: Counter = Counter()
                parts: list[str] | tuple[str] = (text,)
                if "<" in text:
                    counts.update(special.findall(text))
                    parts = special.split(text)
                for part in parts:
                    plain = normal.normalize_str(part)
                    counts.update(pattern.engine(plain).findall(plain))
                for pretoken, times in counts.items():
                    postings[pretoken] += (number - first, times)
                chars += len(text)
                if chars >= BLOCK_CHARS:
                    yield block()
                    postings.clear()
                    documents.clear()
                    chars = 0
        if documents:
            yield block()

    return batches


def _joined(path: str):
    """Sums of pieces x times, as an array over the documents of each block.

    All lists of a pre-token are here and next to each other, so it is encoded once, then joined
    to each of them. Rows about documents pass through.
    """

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _load(path)
        sums: dict[int, np.ndarray] = {}
        last, last_pieces = None, 0

        def out(documents: list[tuple[int, bytes]], summed: dict[int, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([*(b for b, _ in documents), *summed], pa.int64()),
                 pa.array([*(d for _, d in documents), *[None] * len(summed)], pa.binary()),
                 pa.array([*[None] * len(documents), *(s.tobytes() for s in summed.values())], pa.binary())],
                schema=_SUMMED)

        for batch in source:
            pretokens, blocks, postings = (c.to_pylist() for c in batch.columns)
            about = [(b, p) for t, b, p in zip(pretokens, blocks, postings) if t is None]
            if about:
                yield out(about, {})
                kept = [r for r in zip(pretokens, blocks, postings) if r[0] is not None]
                pretokens, blocks, postings = zip(*kept) if kept else ((), (), ())
            if not pretokens:
                continue
            new = [p for p in dict.fromkeys(pretokens) if p != last]
            found = tokenizer.encode_batch_fast(new, add_special_tokens=False)
            pieces = dict(zip(new, map(len, found)))
            if last is not None:
                pieces.setdefault(last, last_pieces)
            last, last_pieces = pretokens[-1], pieces[pretokens[-1]]
            each = np.fromiter(map(pieces.__getitem__, pretokens), np.int64, len(pretokens))
            sizes = np.fromiter(map(len, postings), np.int64, len(postings)) // 8
            pairs = np.frombuffer(b"".join(postings), "<i4").reshape(-1, 2)
            tokens = np.repeat(each, sizes) * pairs[:, 1]
            block = np.repeat(np.array(blocks, np.int64), sizes)
            order = np.argsort(block, kind="stable")
            names, at = np.unique(block[order], return_index=True)
            for name, rows in zip(names.tolist(), np.split(order, at[1:])):
                added = np.bincount(pairs[rows, 0], tokens[rows]).astype(np.int64)
                before = sums.get(name)
                if before is None or len(before) < len(added):
                    before, added = added, before
                if added is not None:
                    before[:len(added)] += added
                sums[name] = before
            if sum(map(len, sums.values())) >= SUMS:
                yield out([], sums)
                sums = {}
        if sums:
            yield out([], sums)

    return batches


def _per_document(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents, from the parts of each block, which stand together."""
    block, documents, total = None, [], np.zeros(0, np.int64)

    def rows() -> list[tuple]:
        tokens = np.zeros(len(documents), np.int64)
        tokens[:len(total)] = total
        return [(*d, n) for d, n in zip(documents, tokens.tolist())]

    for batch in source:
        made: list[tuple] = []
        for name, about, packed in zip(*(c.to_pylist() for c in batch.columns)):
            if name != block:
                made += rows()
                block, documents, total = name, [], np.zeros(0, np.int64)
            if about is not None:
                documents = json.loads(about)
            else:
                part = np.frombuffer(packed, "<i8")
                if len(part) > len(total):
                    total, part = part.copy(), total
                total[:len(part)] += part
        yield _counted(made)
    yield _counted(rows())


def _counted(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs.

    Frequencies leave each task as posting lists, one per pre-token and block of documents, so a
    pre-token that every document holds costs a row per block. They are dealt out and sorted by
    pre-token; each distinct pre-token is encoded once and joined to its lists, and the sums of a
    task are added up before they are shuffled. No ids are kept.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows and doc_ids are counted each;
    other columns are not read. A null doc_id is kept as null.
    """
    lists = docs.select("doc_id", "text").mapInArrow(_frequencies(path), LISTS)
    dealt = F.coalesce("pretoken", F.col("block").cast("string"))
    sums = (lists.repartition(dealt).sortWithinPartitions("pretoken")
            .mapInArrow(_joined(path), SUMMED))
    return (sums.repartition("block").sortWithinPartitions("block")
            .mapInArrow(_per_document, "doc_id long, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > limit))
