"""Token-id files: documents encoded, written as range-coded blocks in order of their ids, and read back.

Documents are dealt by ranges of doc_id, so file after file holds them in ascending order. A task encodes its documents,
closes a block at ``BLOCK_IDS`` ids, in the middle of a document if need be, and codes up to ``LANES`` blocks at once: no
array grows with the length of a text. Files are Spark's: rows of (file, block, first id and document in the file, the
block's bytes), written to the shared folder and retried as any other. Parts of a document are put together when read. Where a document starts overall follows from the sums of the files before, a table of one row per file.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotwise.llm.common import stage, whole_text
from lotwise.llm.rangecoder import BEGUN, GOES_ON, LANES, decode_blocks, encode_blocks, pack, unpack

BLOCK_IDS = 1 << 14
END = 0
REMEMBERED = 300_000
# White space as the tokenizer's own splitting sees it
_S = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNK = f" ?[^{_S}]+|[{_S}]+(?![^{_S}])|[{_S}]+"


class _Encoder:
    """Ids of texts by a byte-level tokenizer, which cuts them at white space first: each distinct cut is encoded once."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.size = self.tokenizer.get_vocab_size()
        self.cut = re.compile(_CHUNK).findall
        # Ids as bytes, 32 bits little endian each
        self.known: dict[str, bytes] = {}

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        cuts = [None if any(s in t for s in self.special) else self.cut(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list(set().union(*[c for c in cuts if c is not None]) - self.known.keys())
        for c, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
            self.known[c] = _packed(e.ids)
        out = []
        for text, parts in zip(texts, cuts):
            if parts is None:
                ids = _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
            else:
                ids = b"".join(map(self.known.__getitem__, parts))
            out.append(np.frombuffer(ids + _packed([END]), "<u4"))
        return out


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()


def _write(path: str, block_ids: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, file = _Encoder(path), TaskContext.get().partitionId()
        keys: list = []
        parts: list[np.ndarray] = []
        waiting: list[tuple] = []
        number = first = held = doc = 0
        begun = False

        def close(goes_on: bool) -> None:
            nonlocal held, begun
            if parts:
                waiting.append((list(keys), [len(d) for d in parts], np.concatenate(parts), begun, goes_on))
                keys.clear()
                parts.clear()
                held, begun = 0, goes_on

        def flush() -> pd.DataFrame:
            nonlocal number, first, doc
            rows = []
            for (names, sizes, ids, before, after), units in zip(waiting, encode_blocks([w[2] for w in waiting], encoder.size)):
                rows.append((file, number, first, doc, len(ids), pack(names, sizes, ids, units, encoder.size, before, after)))
                number, first, doc = number + 1, first + len(ids), doc + len(names) - after
            waiting.clear()
            return pd.DataFrame(rows, columns=["file", "number", "first", "first_doc", "n_ids", "block"])

        for batch in batches:
            names = [None if pd.isna(k) else int(k) for k in batch["doc_id"]]
            texts = batch["text"].tolist()
            for a in range(0, len(texts), 256):
                for key, ids in zip(names[a : a + 256], encoder(texts[a : a + 256])):
                    while len(ids):
                        part, ids = ids[: block_ids - held], ids[block_ids - held :]
                        keys.append(key)
                        parts.append(part)
                        held += len(part)
                        if held >= block_ids:
                            close(len(ids) > 0)
                        if len(waiting) >= LANES:
                            yield flush()
        close(False)
        yield flush()

    return run


def write(docs: DataFrame, tokenizer: str, block_ids: int = BLOCK_IDS) -> DataFrame:
    """The blocks of all documents (doc_id long, text; other columns are ignored), as written and read again.

    ``tokenizer`` is the path of a tokenizer file on every machine. A null text is empty: its ids are the end id alone. A
    null doc_id comes first. Repeated rows are written each. An empty table writes no block.
    """
    rows = docs.select("doc_id", whole_text(F.col("text")).alias("text"))
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return stage(rows.mapInPandas(_write(tokenizer, block_ids), "file int, number int, first long, first_doc long, n_ids long, block binary"))


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for a in range(0, len(batch), LANES):
            part = batch.iloc[a : a + LANES]
            heads = [unpack(b) for b in part["block"]]
            every = decode_blocks([h[2] for h in heads], [int(h[1].sum()) for h in heads], heads[0][3])
            rows = []
            for (keys, sizes, _, _, crc, marks), ids, file, first, doc in zip(heads, every, part["file"], part["first"], part["first_doc"]):
                data = ids.astype("<u4")
                if zlib.crc32(data.tobytes()) != crc:
                    raise ValueError("a block decodes to other ids")
                ends = np.cumsum(sizes)
                for i, (key, size, end, mark) in enumerate(zip(keys, sizes.tolist(), ends.tolist(), marks.tolist())):
                    whole = not mark & (BEGUN | GOES_ON)
                    rows.append((key, file, doc + i, whole, first + end - size, size, data[end - size : end].tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "file", "doc", "whole", "at", "n_tokens", "ids"]).astype({"doc_id": "Int64"})


def read_back(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the blocks; ids are bytes, 32 bits little endian each, the end id included.

    A document of several blocks is put together by its place in the file; its own ids must fit into a task.
    """
    files = blocks.groupBy("file").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("file")) - F.col("n")
    files = F.broadcast(files.select("file", before.alias("before")))
    # As many tasks as full sets of lanes, whatever the sizes of the files.
    tasks = -(-(blocks.agg(F.count("*")).first()[0] or 1) // LANES)
    dealt = blocks.select("file", "first", "first_doc", "block", "n_ids").repartition(tasks, F.xxhash64("file", "number"))
    # Written once: whole documents and parts are both read from it.
    rows = stage(dealt.mapInPandas(_read, "doc_id long, file int, doc long, whole boolean, at long, n_tokens long, ids binary"))
    pieces = F.array_sort(F.collect_list(F.struct("at", "ids")))
    joined = rows.where("NOT whole").groupBy("file", "doc").agg(
        F.any_value("doc_id").alias("doc_id"), F.min("at").alias("at"), F.sum("n_tokens").alias("n_tokens"),
        F.aggregate(pieces, F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
    )
    names = ["doc_id", "file", "at", "n_tokens", "ids"]
    rows = rows.where("whole").select(*names).unionByName(joined.select(*names))
    return rows.join(files, "file").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids")
