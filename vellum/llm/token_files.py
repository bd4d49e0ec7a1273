"""Token-ID / binary output (operator 1).

A corpus becomes flat files of unsigned integers, in ascending ``doc_id`` order::

    part-00007.ids   the ids of its documents, each with the end id, uint16 or uint32
    part-00007.off   int64, where each document starts in the file, and the file's length
    part-00007.doc   int64, the document's id; the smallest int64 stands for null
    manifest.json    the width, the end id, and for each part its counts and its bases

Every task writes the files of its own key range under a temporary name and renames them,
so that a task that runs again (a lost executor, speculation) puts the same bytes in the
same place.  The driver gets one row a part, and prefix sums over the parts give each the
number of documents and ids before it; no file is written twice.  Readers map the files
into memory and touch only the pages they need, hence the folder has to have a POSIX path
on every executor.

The integers are 16 bits wide if the vocabulary allows it, else 32.

Defined results: a null text counts as empty and has the end id only; null ids come first;
rows that share an id are ordered by a hash of their text and kept each; an empty table
gives a manifest without parts; further columns are not written.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, batched

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import in_arrow, slices, sole
from .staging import local_path
from .units import UnitEncoder, buffers, spread, texts_of

NULL_ID = np.iinfo(np.int64).min
#: Bytes of text that are encoded at a time.
TOGETHER = 1 << 20


class LibraryEncoder:
    """The tokenizers library, asked once for each distinct unit while it is remembered.

    Cutting at spaces is right for byte-level pre-tokenizers without a normalizer; with any
    other tokenizer whole texts are passed on.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tool = Tokenizer.from_file(path)
        self.tool.no_truncation()
        self.tool.no_padding()
        self.size = self.tool.get_vocab_size(with_added_tokens=True)
        pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        by_word = (
            pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space")
            and not spec.get("normalizer")
            and not any(x["lstrip"] or x["rstrip"] or x["single_word"] or " " in x["content"] for x in added)
        )
        self.units = UnitEncoder(self._learn, np.dtype(np.uint32), [x["content"].encode() for x in added]) if by_word else None
        #: Tokens that begin with a space: of a single unit only the first does.
        self.opens = np.zeros(self.size, bool)
        self.opens[[i for text, i in self.tool.get_vocab(with_added_tokens=True).items() if text[:1] == "\u0120"]] = True

    def _learn(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, single: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units; those that open with a space are passed on many in one text, where they are cut apart again."""
        joined = single & (data[starts] == 32) & (sizes > 1)
        some, rest = np.flatnonzero(joined), np.flatnonzero(~joined)
        parts = ["".join(x) for x in batched((u.decode("utf-8", "replace") for u in texts_of(data, starts[some], sizes[some])), 200)]
        flat = self._ask(parts)
        first = np.flatnonzero(self.opens[flat])
        if len(first) != len(some):
            raise ValueError("units do not come apart at the tokens that open with a space")
        counts = np.zeros(len(sizes), np.int64)
        counts[some] = np.diff(first, append=len(flat))
        found = self.tool.encode_batch_fast([u.decode("utf-8", "replace") for u in texts_of(data, starts[rest], sizes[rest])], add_special_tokens=False)
        alone = [e.ids for e in found]
        counts[rest] = [len(x) for x in alone]
        at = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.uint32)
        out[spread(at[some], counts[some])] = flat
        out[spread(at[rest], counts[rest])] = np.fromiter((i for x in alone for i in x), np.uint32)
        return out, counts

    def _ask(self, texts: list[str]) -> np.ndarray:
        parts = [np.array(e.ids, np.uint32) for e in self.tool.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts of a column, one after the other, and where each text's begin (and the end)."""
        if self.units:
            return self.units.encode(*buffers(column))
        found = [np.array(e.ids, np.uint32) for e in self.tool.encode_batch_fast([t or "" for t in column.to_pylist()], add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.cumsum([0, *map(len, found)])


@lru_cache(maxsize=1)
def encoder(path: str) -> LibraryEncoder:
    """One encoder a worker process."""
    return LibraryEncoder(path)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0) -> dict:
    """Encode ``docs`` (doc_id, text) into ``folder``; returns the manifest.

    Texts are dealt by ranges of the key before they are encoded, so the shuffle carries
    the text and the files are the only copy of the ids.
    """
    target = local_path(folder)
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .drop("tie")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole("token_files", encoder.cache_clear)
        tool, task = encoder(tokenizer), TaskContext.get()
        dtype = np.dtype("<u2" if max(tool.size - 1, end_id) < 1 << 16 else "<u4")
        name = f"part-{task.partitionId():05d}"
        stem = f"{target}/{name}"
        spare = f"{target}/.{name}-{task.taskAttemptId()}"
        ids_out, lengths, keys = None, [], []
        try:
            for whole in batches:
                for batch in slices(whole, size=TOGETHER):
                    if ids_out is None:
                        os.makedirs(target, exist_ok=True)
                        ids_out = open(f"{spare}.ids", "wb")
                    ids, offsets = tool.encode(batch.column("text"))
                    counts = np.diff(offsets)
                    ended = np.full(len(ids) + len(counts), end_id, dtype)  # the end id after each document
                    ended[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
                    ended.tofile(ids_out)
                    lengths.append(counts + 1)
                    keys.append(batch.column("doc_id").fill_null(NULL_ID).to_numpy())
            if ids_out is None:
                return
            ids_out.close()
            offsets = np.concatenate(([0], np.cumsum(np.concatenate(lengths)))).astype("<i8")
            offsets.tofile(f"{spare}.off")
            np.concatenate(keys).astype("<i8").tofile(f"{spare}.doc")
            for kind in ("ids", "off", "doc"):
                os.replace(f"{spare}.{kind}", f"{stem}.{kind}")
        finally:
            for kind in ("ids", "off", "doc"):
                if os.path.exists(f"{spare}.{kind}"):
                    os.remove(f"{spare}.{kind}")
        yield pa.RecordBatch.from_pydict({"part": [name], "docs": [len(offsets) - 1], "ids": [int(offsets[-1])], "width": [dtype.itemsize]})

    parts = sorted(in_arrow(ordered, run, "part string, docs long, ids long, width long").collect())  # one row a file
    ids_before = list(accumulate((p["ids"] for p in parts), initial=0))
    docs_before = list(accumulate((p["docs"] for p in parts), initial=0))
    manifest = {
        "width": parts[0]["width"] if parts else 4,
        "end_id": end_id,
        "docs": docs_before[-1],
        "ids": ids_before[-1],
        "parts": [p.asDict() | {"first_doc": d, "first_id": i} for p, d, i in zip(parts, docs_before, ids_before, strict=False)],
    }
    os.makedirs(target, exist_ok=True)
    with open(f"{target}/.manifest", "w") as f:
        json.dump(manifest, f)
    os.replace(f"{target}/.manifest", f"{target}/manifest.json")
    return manifest


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """The documents of ``folder``, from memory-mapped files: doc_id, start, n_tokens, ids_crc32 and, if wanted, ids."""
    target = local_path(folder)
    with open(f"{target}/manifest.json") as f:
        manifest = json.load(f)
    dtype = np.dtype(f"<u{manifest['width']}")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    parts = [(p["part"], p["first_id"]) for p in manifest["parts"]]
    listed = spark.createDataFrame(parts, "part string, first_id long")
    if parts:
        listed = listed.repartition(min(len(parts), 10_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, base in ((r["part"], r["first_id"]) for b in batches for r in b.to_pylist()):
            ids = np.memmap(f"{target}/{part}.ids", dtype, "r")
            offsets = np.memmap(f"{target}/{part}.off", "<i8", "r")
            keys = np.memmap(f"{target}/{part}.doc", "<i8", "r")
            step = 512
            for a in range(0, len(keys), step):
                b = min(a + step, len(keys))
                bounds = offsets[a : b + 1]
                cut = [ids[i:j].astype("<u4") for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                out = {
                    "doc_id": pa.array(keys[a:b], mask=np.asarray(keys[a:b] == NULL_ID)),
                    "start": pa.array(np.asarray(bounds[:-1]) + base),
                    "n_tokens": pa.array(np.diff(bounds)),
                    "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in cut], pa.int64()),
                }
                if with_ids:
                    out["ids"] = pa.array([x.tolist() for x in cut], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(out)

    return in_arrow(listed, run, schema)
