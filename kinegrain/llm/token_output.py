"""Token-ID output: texts to ids, ids to Simple-8b shard files, and back.

Documents are dealt into ranges of doc_id and sorted inside them, so shard files in
the order of their names hold the documents in ascending doc_id order. Each range
writes shards of about ``shard_ids`` ids; memory holds one shard and one batch. A
shard is written under its own temporary name and renamed, and its name carries the
task attempt: a lost executor's files are never listed in the manifest, which is
what readers follow. Starts are sums over the manifest's ranges, one row for each.

File (little-endian): magic ``KGS8B001``; unsigned 64-bit: documents, ids, blocks,
words, escapes, values in a block; then arrays of unsigned 64-bit: ids by document,
word offsets of blocks, escape offsets of blocks, words, escapes; then the doc_ids
as signed 64-bit, and a byte for each that says whether it is null.

Defined cases: strings of special tokens become what the library makes of them;
null and empty text is the end id alone; null doc_ids come first;
equal doc_ids are ordered by text; an empty table writes no file and reads back as
an empty result.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import simple8b
from .common import checked_broadcast, fresh_path, stored

MAGIC = b"KGS8B001"
SHARD_IDS = 1 << 21
END_ID = 0

#: The split of byte-level BPE before merges: no merge crosses a piece, so equal pieces have equal ids.
PIECES = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: The same split for texts of ASCII and the Latin letters up to U+024F, all of whose classes are ranges; the standard module is faster.
_L, _S = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", " \t\n\x0b\x0c\r"
PLAIN = re.compile(rf"[\x00-\x1b\x20-\x7f{_L}]*")
PLAIN_PIECES = re.compile(rf" ?[{_L}]+|'(?:[sdmt]|ll|ve|re)| ?[0-9]+| ?[^{_S}{_L}0-9]+|[{_S}]+(?![^{_S}])|[{_S}]+")
#: Texts with a space beside other white space, or at the end, for RE2.
ODD_SPACE = " (?:[ \\n]|$)|\\n |[\\t\\x0b-\\r\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
#: Pieces that a worker remembers, and bytes of text that it encodes at a time.
MEMO, TOGETHER = 3 << 18, 4 << 20

_CODERS: dict[str, _Coder] = {}


def pieces_of(text: str) -> list[str]:
    return (PLAIN_PIECES if PLAIN.fullmatch(text) else PIECES).findall(text)


def _gather(values: np.ndarray, size: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The given rows of a ragged array, one after the other; size is that of every row."""
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values[: ends[-1]])).take(pa.array(rows)).flatten().to_numpy()


class _Places(dict):
    """Places of pieces in a coder's table; a new piece gets the next one."""

    def __init__(self, *known):
        super().__init__(*known)
        self.base, self.fresh = len(self), []

    def __missing__(self, piece: str) -> int:
        place = self[piece] = self.base + len(self.fresh)
        self.fresh.append(piece)
        return place


class _Coder:
    """Encodes texts by their pieces, each distinct one of which the tokenizers library encodes once.

    A single space between others begins a piece, and nothing before it reaches behind it. So
    texts are cut at spaces, and only the distinct cuts of a batch are split into pieces.
    Texts that hold a special token's string, and all texts of a tokenizer that doesn't
    split as PIECES does, are encoded by the library whole.
    """

    def __init__(self, library, by_piece: bool | None = None, memo: int | None = None):
        """by_piece says that the tokenizer splits as PIECES does; None: its own form tells."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library, self.memo = library, memo or MEMO
        self.library.no_truncation()
        self.library.no_padding()
        form = json.loads(self.library.to_str())
        split = form.get("pre_tokenizer") or {}
        self.by_piece = (
            split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
            and form.get("normalizer") is None and form["model"].get("type") == "BPE"
        )
        if by_piece is not None:
            self.by_piece = by_piece
        self.special = [t["content"] for t in form.get("added_tokens") or ()]
        self.places, self.held = _Places(), 0
        self.ids, self.size, self.seen = (np.zeros(1 << 14, t) for t in (np.uint32, np.int64, np.int64))

    def _forget(self) -> None:
        """Keeps the pieces seen most often, half of the memo at most."""
        n = len(self.places)
        seen = self.seen[:n]
        least = max(2, int(np.partition(seen, n - self.memo // 2)[n - self.memo // 2]) + 1)
        keep = np.flatnonzero(seen >= least)
        ids, size = _gather(self.ids, self.size[:n], keep), self.size[keep]
        names = list(self.places)
        self.places, self.held = _Places((names[k], i) for i, k in enumerate(keep.tolist())), 0
        self.seen[: len(keep)] = seen[keep]
        self.seen[len(keep) :] = 0
        self._add(0, size, ids)

    def _add(self, place: int, counts: np.ndarray, ids: np.ndarray) -> None:
        while self.held + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while place + len(counts) > len(self.size):
            self.size, self.seen = (np.concatenate([x, np.zeros_like(x)]) for x in (self.size, self.seen))
        self.ids[self.held : self.held + len(ids)] = ids
        self.size[place : place + len(counts)] = counts
        self.held += len(ids)

    def _learn(self, together: int = 512) -> None:
        """Ids of fresh pieces. One that begins with a space ends where the next one's space is, so many are encoded as one text, whose tokens the library numbers by piece."""
        at, fresh = self.places.base, self.places.fresh
        for k in range(0, len(fresh), together):
            some = fresh[k : k + together]
            runs = [i for i, p in enumerate(some) if p[0] == " " < p[1:2]]
            e = self.library.encode("".join([some[i] for i in runs]), add_special_tokens=False)
            size, ids = np.bincount(np.array(e.word_ids, np.int64), minlength=len(runs)), np.array(e.ids, np.uint32)
            if len(size) != len(runs) or not size.all():
                runs, size, ids = [], size[:0], ids[:0]
            taken = set(runs)
            rest = [i for i in range(len(some)) if i not in taken]
            own = [e.ids for e in self.library.encode_batch_fast([some[i] for i in rest], add_special_tokens=False)]
            size = np.concatenate([size, np.fromiter(map(len, own), np.int64, len(own))])
            ids = np.concatenate([ids, np.fromiter(itertools.chain.from_iterable(own), np.uint32)])
            row = np.empty(len(some), np.int64)
            row[runs + rest] = np.arange(len(some))
            self._add(at + k, size[row], _gather(ids, size, row))
        self.places.base, self.places.fresh = at + len(fresh), []

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each piece) of pieces one after the other."""
        at = np.fromiter(map(self.places.__getitem__, pieces), np.int64, len(pieces))
        self._learn()
        n = len(self.places)
        self.seen[:n] += np.bincount(at, minlength=n)
        return _gather(self.ids, self.size[:n], at), self.size[at]

    def _text_ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        cut = [pieces_of(t) for t in texts]
        ids, size = self._ids(list(itertools.chain.from_iterable(cut)))
        ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum([0, *map(len, cut)])].tolist()
        return [ids[ends[k] : ends[k + 1]] for k in range(len(texts))]

    def _cut_ids(self, cuts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each cut) of cuts with a space before each."""
        if not len(cuts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(cuts)], pa.int32()), cuts), " ")
        pieces = pieces_of(" " + joined[0].as_py())
        ids, size = self._ids(pieces)
        first = np.frombuffer("".join(map(itemgetter(0), pieces)).encode("utf-32-le"), np.uint32) == 32
        return ids, np.bincount(np.cumsum(first) - 1, size, minlength=len(cuts)).astype(np.int64)

    def encode(self, texts: pa.Array, end_id: int | None) -> list[np.ndarray]:
        """Ids of each text with the end id, if there is one; texts hold no null."""
        if len(self.places) > self.memo:
            self._forget()
        whole, alone = np.zeros(len(texts), bool) | (not self.by_piece), np.zeros(len(texts), bool)
        if self.by_piece:
            for x in self.special:
                whole |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
            alone = pc.match_substring_regex(texts, ODD_SPACE).to_numpy(zero_copy_only=False) & ~whole
        out: list[np.ndarray | None] = [None] * len(texts)
        for k in np.flatnonzero(whole):
            out[k] = np.array(self.library.encode(texts[k].as_py(), add_special_tokens=False).ids, np.uint32)
        for k, x in zip(np.flatnonzero(alone), self._text_ids(texts.filter(pa.array(alone)).to_pylist())):
            out[k] = x
        even = np.flatnonzero(~whole & ~alone)
        if len(even):
            lists = pc.split_pattern(texts.take(pa.array(even)), " ")
            ends = lists.offsets.to_numpy()
            flat = lists.values.slice(ends[0], ends[-1] - ends[0])
            ends = ends - ends[0]
            heads = self._text_ids(flat.take(pa.array(ends[:-1])).to_numpy(zero_copy_only=False))
            coded = flat.filter(pa.array(~np.isin(np.arange(len(flat)), ends[:-1]))).dictionary_encode()
            ids, size = self._cut_ids(coded.dictionary)
            code = coded.indices.to_numpy()
            all_ids = _gather(ids, size, code)
            # each text has one cut less than parts
            done = np.concatenate([[0], np.cumsum(size[code])])[ends - np.arange(len(ends))].tolist()
            for i, k in enumerate(even):
                out[k] = np.concatenate([heads[i], all_ids[done[i] : done[i + 1]]])
        if end_id is None:
            return out
        end = np.array([end_id], np.uint32)
        return [np.concatenate([x, end]) for x in out]


def token_ids(texts: list[str] | pa.Array, path: str, end_id: int = END_ID) -> list[np.ndarray]:
    """Ids of each text with the end id, as unsigned 32-bit: those that the tokenizers library gives for the whole text."""
    if path not in _CODERS:
        from tokenizers import Tokenizer

        _CODERS[path] = _Coder(Tokenizer.from_file(path))
    return _CODERS[path].encode(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), end_id)


def _runs(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, number) of runs of texts of about TOGETHER bytes."""
    run = np.cumsum(sizes) // TOGETHER
    starts = np.flatnonzero(np.r_[True, np.diff(run) > 0]) if len(run) else np.zeros(0, int)
    yield from zip(starts.tolist(), np.diff(np.r_[starts, len(run)]).tolist())


def pack(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """The bytes of a shard file."""
    flat = np.concatenate(ids).astype(np.uint64) if ids else np.zeros(0, np.uint64)
    s = simple8b.encode(flat)
    lens = np.array([len(x) for x in ids], np.uint64)
    head = struct.pack("<6Q", len(ids), len(flat), len(s["offsets"]) - 1, len(s["words"]), len(s["escaped"]), simple8b.BLOCK)
    names = np.array([0 if d is None else d for d in doc_ids], np.int64)
    null = np.array([d is None for d in doc_ids], np.uint8)
    arrays = (lens, s["offsets"], s["escape_offsets"], s["words"], s["escaped"], names, null)
    return MAGIC + head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, ids by document, all ids) of a shard file."""
    if data[:8] != MAGIC:
        raise ValueError("not a shard of token ids")
    docs, n, blocks, words, escapes, block = struct.unpack_from("<6Q", data, 8)
    at = 8 + 48

    def take(count: int, kind) -> np.ndarray:
        nonlocal at
        a = np.frombuffer(data, kind, count, at)
        at += a.nbytes
        return a

    lens = take(docs, "<u8")
    s = {"offsets": take(blocks + 1, "<u8"), "escape_offsets": take(blocks + 1, "<u8"), "words": take(words, "<u8"), "escaped": take(escapes, "<u8")}
    names, null = take(docs, "<i8"), take(docs, "u1")
    ids = simple8b.decode(s, n, block=block)
    return [None if z else int(d) for d, z in zip(names, null)], lens.astype(np.int64), ids


def _filesystem(folder: str):
    from pyarrow import fs

    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    if "://" not in folder:
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(folder)


def _writer(folder: str, path: str, end_id: int, shard_ids: int):
    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _filesystem(folder)
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        shard, held, names, ids = 0, 0, [], []

        def flush() -> pa.RecordBatch:
            nonlocal shard, held, names, ids
            name = f"shard-{part:06d}-{shard:06d}-{attempt}.s8b"
            data = pack(names, ids)
            with files.open_output_stream(f"{root}/.{name}.tmp") as out:
                out.write(data)
            files.move(f"{root}/.{name}.tmp", f"{root}/{name}")
            row = pa.RecordBatch.from_pydict(
                {"part": [part], "shard": [shard], "file": [name], "n_docs": [len(ids)], "n_ids": [held], "n_bytes": [len(data)]},
                pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())]),
            )
            shard, held, names, ids = shard + 1, 0, [], []
            return row

        for batch in parts:
            texts, keys = pc.fill_null(batch["text"], ""), batch["doc_id"].to_pylist()
            for lo, n in _runs(pc.binary_length(texts).to_numpy(zero_copy_only=False)):
                for d, x in zip(keys[lo : lo + n], token_ids(texts.slice(lo, n), path, end_id)):
                    names.append(d)
                    ids.append(x)
                    held += len(x)
                    if held >= shard_ids:
                        yield flush()
        if names:
            yield flush()

    return write


def write_token_shards(
    docs: DataFrame, tokenizer_path: str, *, folder: str | None = None, end_id: int = END_ID, shard_ids: int = SHARD_IDS, parts: int | None = None
) -> tuple[str, DataFrame]:
    """Writes the ids of docs (doc_id, text) in ascending doc_id order; returns the folder and the stored manifest.

    manifest: part, shard, file, n_docs, n_ids, n_bytes, start (ids of all documents before the file).
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "tokens")
    files, root = _filesystem(folder)
    files.create_dir(root, recursive=True)
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64("text")
    dealt = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange(n, F.col("doc_id").asc_nulls_first(), tie)
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)
    )
    schema = "part int, shard int, file string, n_docs long, n_ids long, n_bytes long"
    manifest = stored(dealt.mapInArrow(_writer(folder, tokenizer_path, end_id, shard_ids), schema), "manifest")
    ranges = manifest.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    own = manifest.withColumn("prior", F.coalesce(F.sum("n_ids").over(inner), F.lit(0)))
    placed = own.join(ranges, "part").select(*manifest.columns, (F.col("base") + F.col("prior")).alias("start"))
    return folder, stored(placed, "manifest")


def read_token_shards(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, ids (as binary, unsigned 32-bit little-endian) of each document, from the files."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.s8b").schema(
        "path string, modificationTime timestamp, length long, content binary"
    ).load(folder)
    found = found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    want = checked_broadcast(manifest).select("file", "start")

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for content, start in zip(pdf["content"], pdf["start"]):
                names, lens, ids = unpack(content)
                ends = np.cumsum(lens)
                raw = ids.astype("<u4")
                for k in range(0, len(names), 4096):
                    few = range(k, min(k + 4096, len(names)))
                    yield pd.DataFrame(
                        {
                            "doc_id": pd.array([names[i] for i in few], "Int64"),
                            "start": [int(start + ends[i] - lens[i]) for i in few],
                            "ids": [raw[ends[i] - lens[i] : ends[i]].tobytes() for i in few],
                        }
                    )

    return found.join(want, "file").select("content", "start").mapInPandas(read, "doc_id long, start long, ids binary")


def token_digest(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of read_token_shards()."""

    return rows.select(
        "doc_id", "start", F.floor(F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


def crc32_of(ids: np.ndarray) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())
